"""Containers: golden vectors, round trips, one rejection for each fault, damaged files."""

import random
import struct
import zlib

import pytest

from stratalake.functions import codec as C
from stratalake.functions.hashing import blake3, blake3_many
from stratalake.sources import containers

FULL = C.Manifest(16384, [(i, bytes([i]) * 32) for i in range(4)], None, b"device-state", 7)


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(3000))
    known = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"}
    assert [h.hex() for h in blake3_many([data[:n] for n in known])] == list(known.values())
    sizes = [0, 5, 64, 65, 1023, 1024, 1025, 2048, 2049, 3000]
    assert blake3_many([data[:n] for n in sizes]) == [blake3(data[:n]) for n in sizes]


def test_golden_containers():
    full = C.encode_manifest(FULL)
    assert (len(full), full[-32:].hex()) == (300, "bc14e648dd8743ab5b150ab80e1ce8e3303adb7cfbf0a20f6a6c136e10d3c7b2")
    delta = C.encode_manifest(C.Manifest(16384, [(0, b"\xaa" * 32), (2, b"\xbb" * 32)], full[-32:], b"delta-dev", 7))
    assert (len(delta), delta[-32:].hex()) == (217, "39fe4e695727291785a8626ad93df38b914c0a8b09bfbae6032759e44322f429")
    assert C.container_id(delta) == delta[-32:]
    assert C.decode_manifest(delta).parent == full[-32:]


def signed(body: bytes) -> bytes:
    return body + blake3(body)


def changed(at: int, raw: bytes, of: bytes | None = None) -> bytes:
    body = bytearray((of or C.encode_manifest(FULL))[:-32])
    body[at : at + len(raw)] = raw
    return signed(bytes(body))


def delta_with(entries, parent=b"p" * 32) -> bytes:
    body = struct.pack("<8sHHI32sQQQQQII", b"SPSMAN01", 1, 1, 96, parent, 16384, 4096, len(entries), 0, 0, 0, 0)
    return signed(body + b"".join(struct.pack("<Q32s", i, b"h" * 32) for i in entries))


@pytest.mark.parametrize(
    "raw, fault",
    [
        (b"short", "Truncated"),
        (C.encode_manifest(FULL)[:-1] + b"\0", "FooterMismatch"),
        (changed(0, b"X"), "BadMagic"),
        (changed(8, b"\x02\0"), "UnsupportedVersion"),
        (changed(10, b"\x80\0"), "UnknownFlags"),
        (changed(12, b"\x61"), "BadHeaderLen"),
        (changed(92, b"\x01"), "ReservedNonZero"),
        (changed(56, b"\x01"), "BadPageSize"),
        (changed(48, b"\x01"), "GuestRamNotAligned"),
        (changed(64, b"\x05"), "Truncated"),
        (signed(C.encode_manifest(FULL)[:-32] + b"z"), "TrailingBytes"),
        (changed(96, struct.pack("<Q", 9)), "EntriesNotAscending"),
        (changed(48, struct.pack("<Q", 20480)), "FullCountMismatch"),
        (changed(96 + 40 * 3, struct.pack("<Q", 4)), "FullNotContiguous"),
        (changed(16, b"\x01"), "FullNonZeroParent"),
        (delta_with([0, 1], bytes(32)), "DeltaZeroParent"),
        (delta_with([0, 4]), "DeltaIndexOutOfRange"),
        (delta_with([1, 1]), "EntriesNotAscending"),
        (changed(80, b"\x01"), "NonZstdRawLenMismatch"),
        (changed(10, b"\x02\0"), "ZstdRawLenMismatch"),
    ],
)
def test_manifest_faults(raw, fault):
    assert C.decode_manifest(raw) == fault


def test_compressed_blob():
    import zstandard

    m = C.Manifest(4096, [(0, b"h" * 32)], None, zstandard.compress(b"x" * 1000), 1, True, 1000)
    assert C.decode_manifest(C.encode_manifest(m)).blob_raw_len == 1000


def test_compressed_blobs_in_frames_and_damaged():
    import zstandard

    two = zstandard.compress(b"x" * 600) + zstandard.compress(b"y" * 400)
    checked = zstandard.ZstdCompressor(write_checksum=True).compress(b"x" * 1000)
    for blob, size, fault in ((two, 1000, None), (checked, 1000, None), (b"", 0, None), (b"garbage", 0, "ZstdRawLenMismatch"), (checked[:-4], 1000, "ZstdRawLenMismatch"), (two[:-1], 1000, "ZstdRawLenMismatch"), (two + b"z", 1000, "ZstdRawLenMismatch"), (two, 600, "ZstdRawLenMismatch")):
        assert C.build_fault(C.Manifest(4096, [(0, b"h" * 32)], None, blob, 1, True, size)) == fault


def test_any_truncation_is_rejected():
    raw = C.encode_manifest(FULL)
    assert all(isinstance(C.decode_manifest(raw[:n]), str) for n in range(len(raw)))
    rng = random.Random(5)
    for _ in range(200):
        bad = bytearray(raw)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        assert C.decode_manifest(bytes(bad)) == "FooterMismatch"


def test_logs():
    raw = C.encode_log(3, b"payload")
    assert C.decode_log(raw) == (3, b"payload")
    assert C.decode_log(raw[:40]) == "Truncated"
    body = raw[:-32]
    for at, x, fault in ((0, b"X", "BadMagic"), (4, b"\2", "UnsupportedVersion"), (6, b"\1", "NonZeroFlags"), (12, b"\1", "ReservedNonZero"), (16, b"\xff", "PayloadLenMismatch"), (16, b"\1", "TrailingBytes")):
        assert C.decode_log(signed(body[:at] + x + body[at + 1 :])) == fault


def pack(n=3, **kw):
    pages = [bytes([k]) * 4096 for k in range(n)]
    return C.encode_pack(5, list(zip(blake3_many(pages), pages, strict=True)), **kw)


def test_packs_and_sidecars():
    raw = pack()
    got = C.decode_pack(raw, True)
    assert (got.pack_id, got.sealed, got.error, [r[0] for r in got.records]) == (5, True, None, [20, 4153, 8286])
    assert C.bad_records(got) == []
    torn = pack(sealed=False)[:-10]
    assert (len(C.decode_pack(torn).records), C.decode_pack(torn).torn_at) == (2, 8286)
    assert C.decode_pack(raw[:10]).error == "Runt"
    assert C.decode_pack(b"XXXX" + raw[4:]).error == "BadMagic"
    assert C.decode_pack(raw[:-40] + b"\x09" + raw[-39:]).error == "FooterMismatch"
    flipped = bytearray(raw)
    flipped[100] ^= 1
    assert C.decode_pack(bytes(flipped), True).error == "BadBodyHash"
    assert C.bad_records(C.decode_pack(bytes(flipped))) == [20]
    entries = [(bytes([k]) * 32, 5, 20 + 4133 * k) for k in (2, 0, 1)]
    idx = C.encode_sidecar(entries)
    assert C.decode_sidecar(idx) == sorted(entries)
    assert C.decode_sidecar(idx[:-1] + bytes([idx[-1] ^ 1])) == "BadCrc"
    assert C.decode_sidecar(b"") == "Truncated"
    body = struct.pack("<I", 9)
    assert C.decode_sidecar(body + struct.pack("<I", zlib.crc32(body))) == "Truncated"


def test_damaged_store_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratalake.operators import fsck

    good, bad = pack(), bytearray(pack())
    bad[100] ^= 1
    (tmp_path / "pack-00000005.spk").write_bytes(good)
    (tmp_path / "pack-00000006.spk").write_bytes(bytes(bad))
    (tmp_path / "pack-00000005.idx").write_bytes(C.encode_sidecar([(b"h" * 32, 5, 20)])[:-1] + b"\0")
    ref = C.encode_manifest(FULL)
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / f"{ref[-32:].hex()}.spm").write_bytes(ref)
    (tmp_path / "ab" / f"{'0' * 64}.spm").write_bytes(changed(0, b"X"))
    records = containers.read_packs(containers.files(spark, str(tmp_path), "*.spk"), True)
    assert sorted(r["error"] for r in records.where("error IS NOT NULL").collect()) == ["BadBodyHash", "HashMismatch"]
    assert containers.rebuilt_index(records).count() == 3
    sidecars = containers.read_sidecars(containers.files(spark, str(tmp_path), "*.idx"))
    layers = containers.decode_manifests(containers.files(spark, str(tmp_path), "*.spm"))
    assert containers.manifest_refs(spark, str(tmp_path)).count() == 2
    name = F.lower(F.hex("snapshot_ref"))
    found = {r["violation"]: r["n"] for r in fsck.report(fsck.failed(sidecars, "BadSidecarCrc", "path"), fsck.failed(records.where("offset IS NULL"), "BadPackBodyHash", "path"), fsck.failed(records.where("error = 'HashMismatch'"), "RecordHashMismatch", "offset"), fsck.failed(layers.withColumn("name", name), "BadManifestDecode", "name")).collect()}
    assert found == {"BadSidecarCrc": 1, "BadPackBodyHash": 1, "RecordHashMismatch": 1, "BadManifestDecode": 1}


def test_hash_columns(spark):
    from pyspark.sql import functions as F

    from stratalake.functions.hashing import batch_hash, content_hash

    df = spark.createDataFrame([(bytearray(b"a"),), (None,)], "x binary")
    got = [r[0] for r in df.select(content_hash(F.col("x"), "blake3")).collect()]
    assert (bytes(got[0]), got[1]) == (blake3(b"a"), None)
    one = spark.range(1).select(batch_hash(F.array(F.unhex(F.lit("61")), F.unhex(F.lit("62"))), "blake3")).first()[0]
    assert bytes(one) == blake3(b"ab")


def test_guest(spark):
    from stratalake.sources import guest

    small = guest.Profile(200, 0.4, 0.4, 0.5)
    first, again = (guest.pages(spark, small, 3).collect() for _ in range(2))
    assert first == again and all(len(r["payload"]) == 4096 for r in first)
    later = guest.pages(spark, small, 3, 1).collect()
    assert 60 < sum(a["payload"] != b["payload"] for a, b in zip(sorted(first), sorted(later), strict=True)) < 140


def test_recovery_after_a_crash(spark, tmp_path):
    pages = [bytes([k]) * 4096 for k in range(5)]
    named = list(zip(blake3_many(pages), pages, strict=True))
    whole = C.encode_pack(1, named[:3])
    (tmp_path / "pack-00000001.spk").write_bytes(whole)
    (tmp_path / "pack-00000001.idx").write_bytes(C.encode_sidecar([(h, 1, 20 + 4133 * k) for k, (h, _) in enumerate(named[:3])]))
    (tmp_path / "pack-00000002.spk").write_bytes(C.encode_pack(2, named[2:], sealed=False)[:-9])  # torn, no sidecar
    (tmp_path / "pack-00000003.spk").write_bytes(b"SPK1")  # a runt
    got = {bytes(r["page_hash"]): (r["pack_id"], r["offset"]) for r in containers.recover_index(spark, str(tmp_path)).collect()}
    assert got == {h: (1, 20 + 4133 * k) for k, (h, _) in enumerate(named[:3])} | {named[3][0]: (2, 4153)}


def test_get_and_purge_manifests(spark, tmp_path):
    good = C.encode_manifest(FULL)
    bad = bytearray(good)
    bad[100] ^= 1
    (tmp_path / f"{good[-32:].hex()}.spm").write_bytes(good)
    (tmp_path / f"{'1' * 64}.spm").write_bytes(good)
    (tmp_path / f"{'2' * 64}.spm").write_bytes(bytes(bad))
    found = containers.files(spark, str(tmp_path), "*.spm")
    assert sorted(r["error"] for r in containers.bad_manifests(found).collect()) == ["FooterMismatch", "NameMismatch"]
    refs = spark.createDataFrame([(good[-32:],)], "snapshot_ref binary")
    assert sorted(str(r["error"]) for r in containers.get_snapshots(found, refs).collect()) == ["ManifestCorrupt", "None", "None"]
