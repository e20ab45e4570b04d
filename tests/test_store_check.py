"""The integrity check of a whole store finds each planted fault, and nothing in a sound store."""

from collections import Counter

import pytest

from stratalake.functions import codec as C
from stratalake.functions.hashing import blake3_many
from stratalake.operators import fsck
from stratalake.sources.store_check import check_store

PAGES = [bytes([k]) * 4096 for k in range(6)]
NAMED = list(zip(blake3_many(PAGES), PAGES, strict=True))
NODES = "experiment_id string, node_id bigint, status int, snapshot_ref binary, input_log_id binary"


def layer(*pages):
    return C.encode_manifest(C.Manifest(4096 * len(pages), [(i, NAMED[p][0]) for i, p in enumerate(pages)], None, b"", 0))


def put_pack(root, number, pages, sidecar=True, sealed=True, body=None):
    raw = body or C.encode_pack(number, pages, sealed=sealed)
    (root / "pages" / f"pack-{number:08x}.spk").write_bytes(raw)
    if sidecar:
        (root / "pages" / f"pack-{number:08x}.idx").write_bytes(C.encode_sidecar([(h, number, 20 + 4133 * k) for k, (h, _) in enumerate(pages)]))
    return raw


def put_layer(root, raw, name=None):
    (root / "manifests" / "aa").mkdir(exist_ok=True)
    (root / "manifests" / "aa" / f"{(name or raw[-32:]).hex()}.spm").write_bytes(raw)


@pytest.fixture
def sound(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "manifests").mkdir()
    put_pack(tmp_path, 1, NAMED[:2])
    put_pack(tmp_path, 2, NAMED[2:3], sidecar=False, sealed=False)
    put_layer(tmp_path, layer(0, 1, 2))
    return tmp_path


def check(spark, root, nodes=(), pins=(), logs=(), deep=False):
    found = check_store(spark, f"file://{root}", spark.createDataFrame(nodes, NODES), spark.createDataFrame(pins, "snapshot_ref binary, note string, created_at bigint"), spark.createDataFrame(logs, "log_id binary, content binary"), deep)
    return Counter(r["violation"] for r in found.collect())


def test_sound_store(spark, sound):
    ref, log = layer(0, 1, 2)[-32:], C.encode_log(1, b"in")
    state = {"nodes": [("e", 0, 0, ref, log[-32:])], "pins": [(ref, "n", 0)], "logs": [(log[-32:], log)]}
    assert not check(spark, sound, **state) and not check(spark, sound, **state, deep=True)


def test_command_line(spark, sound, tmp_path):
    import io
    import json
    from contextlib import redirect_stdout

    from stratalake import cli

    put_layer(sound, layer(5))  # a page that no pack has
    out = io.StringIO()
    with redirect_stdout(out):
        code = cli.main([f"file://{tmp_path}/catalog", "fsck", "--deep", "--files", f"file://{sound}"])
    assert (code, [json.loads(x) for x in out.getvalue().splitlines()]) == (1, [{"violation": "MissingPage", "n": 1}])


def test_empty_store(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "manifests").mkdir()
    assert not check(spark, tmp_path, deep=True)


def test_each_class_is_found(spark, sound):
    idx = sound / "pages" / "pack-00000001.idx"
    idx.write_bytes(idx.read_bytes()[:-1] + bytes([idx.read_bytes()[-1] ^ 1]))  # its pages are read from the pack
    put_pack(sound, 3, NAMED[3:5])
    (sound / "pages" / "pack-00000003.idx").write_bytes(C.encode_sidecar([(NAMED[3][0], 3, 20)]))  # lists one page of two
    flipped = bytearray(C.encode_pack(4, NAMED[5:6]))
    flipped[100] ^= 1
    put_pack(sound, 4, NAMED[5:6], body=bytes(flipped))
    torn = bytearray(layer(0))
    torn[70] ^= 1
    put_layer(sound, bytes(torn), b"1" * 32)
    foreign = b"X" + layer(1)[1:-32]
    foreign += blake3_many([foreign])[0]
    put_layer(sound, foreign)
    put_layer(sound, C.encode_manifest(C.Manifest(4096, [(0, b"?" * 32)], None, b"", 0)))
    ref, gone = layer(0, 1, 2)[-32:], b"g" * 32
    nodes = [("e", 0, 0, ref, b"l" * 32), ("e", 1, 0, gone, None), ("e", 2, 0, foreign[-32:], None)]
    log = C.encode_log(1, b"in")
    state = {"nodes": nodes, "pins": [(gone, "n", 0), (ref, "n", 0)], "logs": [(log[-32:], log), (b"m" * 32, log)]}
    shallow = {"BadSidecarCrc": 1, "SidecarRecordCountMismatch": 1, "BadPackFooter": 1, "BadManifestFooter": 1, "BadManifestDecode": 1, "MissingPage": 1, "MissingManifest": 2, "DanglingPin": 1, "MissingInputLog": 1}
    assert check(spark, sound, **state) == shallow
    deep = check(spark, sound, **state, deep=True)
    assert deep == shallow | {"BadPackBodyHash": 1, "RecordHashMismatch": 1, "BadInputLogFooter": 1}
    assert sorted(deep) == sorted(fsck.CLASSES)
