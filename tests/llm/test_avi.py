"""AVI: exact round trips, an independent baseline encoder, damaged files, shots."""

import hashlib
import struct
import zlib

import numpy as np
from tables import SF

from stratalake.llm import avi, queries


def test_round_trip_of_any_bytes():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes() for n in (1, 2, 7)] + [b"\0\xff" * 288, b"\xff" * 576, b"\0" * 1152, bytes(range(256)) * 9]
    files = avi.encode_files(payloads, 25)
    got = avi.decode_files(files)
    assert [x[0].tobytes() for x in got] == payloads and all(x[2] is None for x in got)
    frames, fps = avi.frames_of(files[2])
    assert fps == 25 and len(frames) == 7
    assert all((avi.decode_frame(f) == own).all() for f, own in zip(frames, got[2][0], strict=True))  # the general decoder agrees


def test_payload():
    assert avi.payload_of("") == (b"\xff" * 576, 0)
    assert [len(avi.payload_of("é" * n)[0]) for n in (1, 288, 289)] == [576, 576, 1152]


def test_query(spark):
    got = {r["doc_id"]: r for r in queries.op3_avi_round_trip(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        p, n = avi.payload_of(r["text"])
        x = got[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert x["media_sha256"] == hashlib.sha256(avi.encode_files([p], 25)[0]).hexdigest()


def baseline(image: np.ndarray, q: int = 3) -> bytes:
    """A grey baseline JPEG with plain fixed-length Huffman codes of eight bits."""
    h, w = image.shape
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    dct = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    dc_symbols, ac_symbols = list(range(12)), sorted({(r << 4) | s for r in range(16) for s in range(1, 11)} | {0, 0xF0})
    bits, last = "", 0

    def put(symbols, symbol, value, size):
        nonlocal bits
        bits += format(symbols.index(symbol), "08b")
        if size:
            bits += format(value if value > 0 else value + (1 << size) - 1, f"0{size}b")

    for y in range(0, h, 8):
        for xx in range(0, w, 8):
            c = np.rint(dct @ (image[y : y + 8, xx : xx + 8].astype(float) - 128) @ dct.T / q).astype(int).ravel()[avi.ZIGZAG]
            d = int(c[0]) - last
            last = int(c[0])
            put(dc_symbols, abs(d).bit_length(), d, abs(d).bit_length())
            run = 0
            for v in map(int, c[1:]):
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(ac_symbols, 0xF0, 0, 0)
                    run -= 16
                size = abs(v).bit_length()
                put(ac_symbols, run << 4 | size, v, size)
                run = 0
            if run:
                put(ac_symbols, 0, 0, 0)
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    table = lambda c, s: b"\xff\xc4" + struct.pack(">HB", 19 + len(s), c) + bytes([0] * 7 + [len(s)] + [0] * 8) + bytes(s)
    return b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([q] * 64) + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, h, w, 1, 1, 0x11, 0) + table(0, dc_symbols) + table(0x10, ac_symbols) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0) + data + b"\xff\xd9"


def test_baseline_frames():
    rng = np.random.default_rng(1)
    image = np.clip(np.add.outer(np.arange(32) * 5, np.arange(40) * 2) + rng.integers(0, 20, (32, 40)), 0, 255).astype(np.uint8)
    frame = baseline(image)
    assert np.abs(avi.decode_frame(frame).astype(int) - image).max() <= 8
    got, fps, error = avi.decode_files([avi.avi_file([frame, frame], 10, 40)])[0]
    assert error is None and fps == 10 and len(got) == 2


def test_without_an_index_and_damaged():
    raw = avi.encode_files([b"a" * 1152], 25)[0]
    cut = raw.index(b"idx1")
    bare = raw[:4] + struct.pack("<I", cut - 8) + raw[8:cut]
    assert avi.decode_files([bare])[0][0].tobytes() == b"a" * 1152
    errors = [x[2] for x in avi.decode_files([b"", b"RIFF\0\0\0\0WAVE", raw[:200], raw, None, raw[: raw.index(b"\xff\xda") + 10]])]
    assert errors[3:5] == [None, None] and all(errors[k] for k in (0, 1, 2, 5))


def test_shots():
    dark, light = np.zeros((24, 24), np.uint8), np.full((24, 24), 200, np.uint8)
    first, d = avi.shots(np.stack([dark] * 10 + [light] * 5 + [dark] * 9), avi.ShotConfig())
    assert first == [0, 10, 15] and d[10] == 1 and len(d) == 24
    assert avi.shots(np.stack([dark, light] * 10), avi.ShotConfig())[0] == [0]  # where all flickers nothing is a cut
    assert avi.shots([], avi.ShotConfig())[0] == []


def test_clips(spark, awkward, nothing):
    stored = avi.store(awkward)
    got = avi.clips(stored).collect()
    assert sum(r["shot"] == 0 for r in got) == 11 and all(r["error"] is None for r in got)
    assert all(r["end_s"] > r["start_s"] for r in got)
    broken = spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "doc_id bigint, media binary")
    assert [(r["doc_id"], r["error"]) for r in avi.clips(broken).collect()] == [(1, "no RIFF AVI")]
    assert avi.round_trip(awkward).count() == 11 and avi.round_trip(nothing).count() == 0
