"""Media columns: AVI with motion-JPEG.

A payload becomes the samples of square grey frames, each a lossless JPEG (process 14: Huffman codes of differences to
the left neighbour), in a RIFF AVI with an idx1 index. Reading parses the RIFF tree, takes the frames that the index
names (or, without an index, the chunks of movi), decodes each frame on its own, and detects shots: a cut is where the
histogram difference of two frames exceeds a threshold that adapts to the differences around it. Baseline JPEG frames
(grey or colour, as cameras write them) decode too; their luma is used.

Arrays hold all frames of a slice of rows, and decoding advances one symbol of every frame at a time.

Defined results: a null or empty text is one frame of padding; a null media value has no clips; bytes that are no AVI,
or a frame that does not decode, give an error row in ``clips`` (error tells why) and never end the job; repeated
rows get equal results; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, texts_of

SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
#: Huffman code lengths that the writer gives the difference categories 0 to 8.
LENGTHS = {4: 2, 7: 2, 2: 3, 3: 3, 0: 4, 1: 4, 6: 4, 5: 5, 8: 6}
#: The order of the coefficients of a baseline block.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])


@dataclass(frozen=True)
class ShotConfig:
    fps: int = 25
    bins: int = 16
    window: int = 8  #: differences on each side that the threshold adapts to
    factor: float = 2.5  #: standard deviations above their mean
    least: float = 0.25  #: a smaller difference is never a cut


# ---------------------------------------------------------------- writing


@cache
def _codes() -> tuple[bytes, np.ndarray, np.ndarray]:
    """The DHT segment, and value and number of bits of each difference from -255 to 255."""
    order = sorted(LENGTHS, key=lambda c: (LENGTHS[c], c))
    counts = bytes(sum(LENGTHS[c] == n for c in order) for n in range(1, 17))
    segment = b"\xff\xc4" + struct.pack(">HB", 19 + len(order), 0) + counts + bytes(order)
    code, last, codes = 0, 0, {}
    for c in order:
        code <<= LENGTHS[c] - last
        last = LENGTHS[c]
        codes[c] = code
        code += 1
    value, bits = np.zeros(511, np.uint32), np.zeros(511, np.uint32)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        value[d + 255] = codes[c] << c | (d if d >= 0 else d + (1 << c) - 1)
        bits[d + 255] = LENGTHS[c] + c
    return segment, value, bits


def _jpeg_head() -> bytes:
    sof = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    sos = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    return b"\xff\xd8" + sof + _codes()[0] + sos


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A lossless JPEG of each frame; samples: frames x SIDE x SIDE, 8 bits."""
    s = samples.astype(np.int16)
    diff = np.empty_like(s)
    diff[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    diff[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    diff[:, 0, 0] = s[:, 0, 0] - 128
    _, value, bits = _codes()
    at = diff.reshape(len(s), -1) + 255
    v, n = value[at], bits[at].astype(np.int64)
    ends = n.cumsum(1)
    sizes = (ends[:, -1] + 7) // 8
    base = np.zeros(len(s), np.int64)
    np.cumsum(sizes[:-1], out=base[1:])
    begin = (ends - n + 8 * base[:, None]).ravel()
    # each code lies in three bytes at most; bits never overlap, so adding joins them
    where = begin >> 3
    v = (v.ravel() << (24 - n.ravel() - (begin & 7)).astype(np.uint32)).astype(np.uint32)
    total = int(sizes.sum())
    out = np.zeros(total + 3)
    for k in range(3):
        out[: total + 3] += np.bincount(where + k, (v >> np.uint32(16 - 8 * k)) & np.uint32(255), total + 3)
    out = out[:total].astype(np.uint8)
    tail = base + sizes - 1
    out[tail] |= ((1 << (8 * sizes - ends[:, -1])) - 1).astype(np.uint8)  # the last byte fills up with ones
    stuffed = 1 + (out == 255)
    to = np.cumsum(stuffed)
    full = np.zeros(int(to[-1]), np.uint8)
    full[to - stuffed] = out
    cuts = np.concatenate([[0], to[tail]]).tolist()
    raw, head = full.tobytes(), _jpeg_head()
    return [head + raw[a:b] + b"\xff\xd9" for a, b in zip(cuts, cuts[1:], strict=False)]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi_file(frames: list[bytes], fps: int, side: int = SIDE) -> bytes:
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(c := _chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def payload_of(text: str) -> tuple[bytes, int]:
    """The text in UTF-8 up to a positive multiple of a frame, and its length before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + PAD * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def encode_files(payloads: list[bytes], fps: int) -> list[bytes]:
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE))
    out, at = [], 0
    for p in payloads:
        out.append(avi_file(frames[at : at + len(p) // FRAME], fps))
        at += len(p) // FRAME
    return out


# ---------------------------------------------------------------- reading


def _chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError(f"chunk {name!r} is longer than what holds it")
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def frames_of(raw: bytes) -> tuple[list[bytes], float]:
    """The JPEG frames that the index names, in its order, and the frames a second."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("no RIFF AVI")
    movi, index, fps = None, None, 25.0
    for name, at, size in _chunks(raw, 12, min(len(raw), 8 + struct.unpack_from("<I", raw, 4)[0])):
        kind = raw[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n, a, s in _chunks(raw, at + 4, at + size):
                if n == b"LIST" and raw[a : a + 4] == b"strl":
                    for m, b, _ in _chunks(raw, a + 4, a + s):
                        if m == b"strh" and raw[b : b + 4] == b"vids":
                            scale, rate = struct.unpack_from("<II", raw, b + 20)
                            fps = rate / max(1, scale)
        elif name == b"LIST" and kind == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return [raw[a : a + s] for n, a, s in _chunks(raw, movi[0] + 4, movi[0] + movi[1]) if n[2:] in (b"dc", b"db")], fps
    out = []
    entries = list(struct.iter_unpack("<4sIII", raw[index[0] : index[0] + index[1] // 16 * 16]))
    # offsets count from the list's kind, or in some files from the start
    base = movi[0] if entries and raw[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
    for name, _, offset, size in entries:
        if name[2:] in (b"dc", b"db"):
            if raw[base + offset : base + offset + 4] != name:
                raise ValueError("the index names no frame")
            out.append(raw[base + offset + 8 : base + offset + 8 + size])
    return out, fps


@dataclass
class _Jpeg:
    kind: int
    height: int
    width: int
    parts: list[tuple[int, int, int, int]]  #: id, horizontal, vertical, quantisation table
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  #: class and number: symbol and length by 16 bits
    quant: dict[int, np.ndarray]
    scan: list[tuple[int, int]]  #: component id, tables
    predictor: int
    restart: int
    data: int


def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    symbol, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            lo = code << (16 - n)
            symbol[lo : lo + (1 << (16 - n))], length[lo : lo + (1 << (16 - n))] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def parse_jpeg(raw: bytes) -> _Jpeg:
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, j = 2, _Jpeg(-1, 0, 0, [], {}, {}, [], 0, 0, 0)
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("broken JPEG header")
        mark, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if mark in (0xC0, 0xC1, 0xC3):
            j.kind, (j.height, j.width) = mark, struct.unpack_from(">HH", body, 1)
            j.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"JPEG process {mark:x} is not for motion JPEG")
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                j.tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDB:
            while body:
                wide = body[0] >> 4
                j.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif mark == 0xDD:
            j.restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            j.scan = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            j.predictor, j.data = body[1 + 2 * body[0]], at
            return j


@cache
def _own_table() -> tuple[np.ndarray, np.ndarray]:
    """Difference and bits used, by the next 14 bits, for the writer's own codes."""
    _, value, bits = _codes()
    d, n = np.zeros(1 << 14, np.int16), np.zeros(1 << 14, np.uint8)
    for k in range(511):
        lo = int(value[k]) << (14 - int(bits[k]))
        d[lo : lo + (1 << (14 - int(bits[k])))], n[lo : lo + (1 << (14 - int(bits[k])))] = k - 255, bits[k]
    return d, n


def decode_own(frames: list[bytes]) -> np.ndarray:
    """Frames as the writer makes them: frames x SIDE x SIDE."""
    if not frames:
        return np.empty((0, SIDE, SIDE), np.uint8)
    skip = len(_jpeg_head())
    raw = np.frombuffer(b"".join(f[skip:-2] for f in frames), np.uint8)
    sizes = np.array([len(f) - skip - 2 for f in frames], np.int64)
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 255))
    first = np.cumsum(sizes) - sizes
    keep[first[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    pos = 8 * kept[first]
    data = np.append(raw[keep], np.zeros(4, np.uint8)).astype(np.uint32)
    words = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    table_d, table_n = _own_table()
    diff = np.empty((FRAME, len(frames)), np.int16)
    for k in range(FRAME):
        peek = (words[np.minimum(pos >> 3, len(words) - 1)] >> (10 - (pos & 7)).astype(np.uint32)) & np.uint32(0x3FFF)
        diff[k] = table_d[peek]
        pos += table_n[peek]
    if (pos > 8 * kept[first + sizes]).any():
        raise ValueError("a frame ends early")
    d = np.ascontiguousarray(diff.T).reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = d[:, :, 0].cumsum(1)
    return (d.cumsum(2) & 255).astype(np.uint8)


class _Bits:
    def __init__(self, raw: bytes, at: int):
        end = at
        while True:  # up to a marker that is no stuffing and no restart
            end = raw.find(b"\xff", end)
            if end < 0 or end + 1 >= len(raw):
                end = len(raw)
                break
            if raw[end + 1] == 0 or 0xD0 <= raw[end + 1] <= 0xD7:
                end += 2
                continue
            break
        self.raw, self.at, self.end, self.hold, self.n = raw, at, end, 0, 0

    def _fill(self) -> None:
        while self.n < 32:
            b = 0
            if self.at < self.end:
                b = self.raw[self.at]
                if b == 255 and self.at + 1 < self.end and self.raw[self.at + 1] != 0:
                    b = 0  # a restart marker: nothing more before restart()
                else:
                    self.at += 1 + (b == 255)
            self.hold, self.n = (self.hold << 8 | b) & ((1 << 64) - 1), self.n + 8

    def restart(self) -> None:
        self.hold = self.n = 0
        while self.at + 1 < self.end and not (self.raw[self.at] == 255 and 0xD0 <= self.raw[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        self._fill()
        peek = self.hold >> (self.n - 16) & 0xFFFF
        n = int(table[1][peek])
        if not n:
            raise ValueError("no such Huffman code")
        self.n -= n
        return int(table[0][peek])

    def extend(self, c: int) -> int:
        if not c:
            return 0
        self._fill()
        self.n -= c
        v = self.hold >> self.n & ((1 << c) - 1)
        return v if v >> (c - 1) else v - (1 << c) + 1


@cache
def _dct() -> np.ndarray:
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def decode_frame(raw: bytes) -> np.ndarray:
    """The luma of any baseline frame, or the first component of a lossless one with one component."""
    j = parse_jpeg(raw)
    bits = _Bits(raw, j.data)
    if j.kind == 0xC3:
        if len(j.parts) != 1 or j.predictor != 1:
            raise ValueError("a lossless frame must have one component and the left predictor")
        table = j.tables[j.scan[0][1] >> 4]
        out = np.zeros((j.height, j.width), np.int64)
        for y in range(j.height):
            left = 128 if y == 0 else int(out[y - 1, 0])
            for x in range(j.width):
                left = (left + bits.extend(bits.symbol(table))) & 0xFFFF
                out[y, x] = left
        return out.astype(np.uint8)
    if j.kind < 0:
        raise ValueError("no frame header")
    part = {p[0]: p for p in j.parts}
    high, wide = max(p[2] for p in j.parts), max(p[1] for p in j.parts)
    if len(j.parts) == 1:
        part = {p[0]: (p[0], 1, 1, p[3]) for p in j.parts}
        high = wide = 1
    down, across = -(-j.height // (8 * high)), -(-j.width // (8 * wide))
    first = j.scan[0][0]
    luma = np.zeros((down * part[first][2], across * part[first][1], 64), np.int64)
    last = dict.fromkeys(part, 0)
    for mcu in range(down * across):
        if j.restart and mcu and mcu % j.restart == 0:
            bits.restart()
            last = dict.fromkeys(part, 0)
        for c, tables in j.scan:
            dc, ac = j.tables[tables >> 4], j.tables[0x10 | tables & 15]
            for v in range(part[c][2]):
                for h in range(part[c][1]):
                    block = np.zeros(64, np.int64)
                    last[c] += bits.extend(bits.symbol(dc))
                    block[0], k = last[c], 1
                    while k < 64:
                        rs = bits.symbol(ac)
                        run, size = rs >> 4, rs & 15
                        if not size:
                            if run != 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise ValueError("a block has too many coefficients")
                        block[ZIGZAG[k]] = bits.extend(size)
                        k += 1
                    if c == first:
                        luma[mcu // across * part[c][2] + v, mcu % across * part[c][1] + h] = block
    q = np.zeros(64, np.int64)
    q[ZIGZAG] = j.quant[part[first][3]]
    blocks = (luma * q).reshape(*luma.shape[:2], 8, 8)
    pixels = np.einsum("ky,abkl,lx->abyx", _dct(), blocks, _dct()) + 128
    image = pixels.transpose(0, 2, 1, 3).reshape(luma.shape[0] * 8, luma.shape[1] * 8)
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)[: j.height, : j.width]


def decode_files(files: list[bytes | None]) -> list[tuple[list[np.ndarray] | np.ndarray, float, str | None]]:
    """Frames, frames a second and what is wrong, of each file. Frames of the writer's own kind decode together."""
    found, own = [], []
    head = _jpeg_head()
    for raw in files:
        try:
            frames, fps = ([], 0.0) if raw is None else frames_of(raw)
            found.append((frames, fps, None))
            if frames and all(f.startswith(head) for f in frames):
                own.append(len(found) - 1)
        except (ValueError, struct.error, IndexError) as e:
            found.append(([], 0.0, str(e)))
    out: list = [None] * len(found)
    try:
        arrays = decode_own([f for k in own for f in found[k][0]])
        at = 0
        for k in own:
            n = len(found[k][0])
            out[k] = (arrays[at : at + n], found[k][1], None)
            at += n
    except ValueError:
        pass  # one is broken: each alone, below
    for k, (frames, fps, error) in enumerate(found):
        if out[k] is None:
            try:
                out[k] = ([decode_frame(f) for f in frames], fps, error)
            except (ValueError, KeyError, IndexError, struct.error) as e:
                out[k] = ([], 0.0, f"frame: {e}")
    return out


def shots(frames: list[np.ndarray] | np.ndarray, config: ShotConfig) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and the histogram difference (0 to 1) of each frame to the one before."""
    n = len(frames)
    if not n:
        return [], np.zeros(0)
    if isinstance(frames, np.ndarray):
        at = np.repeat(np.arange(n), frames[0].size) * config.bins + (frames.reshape(-1).astype(np.int64) * config.bins >> 8)
        hist = np.bincount(at, minlength=n * config.bins).reshape(n, -1) / frames[0].size
    else:
        hist = np.array([np.bincount(f.ravel().astype(np.int64) * config.bins >> 8, minlength=config.bins) / f.size for f in frames])
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    if not len(d):
        return [0], np.zeros(1)
    sums, squares = np.concatenate([[0.0], np.cumsum(d)]), np.concatenate([[0.0], np.cumsum(d * d)])
    lo, hi = np.maximum(0, np.arange(len(d)) - config.window), np.minimum(len(d), np.arange(len(d)) + config.window + 1)
    m = np.maximum(1, hi - lo - 1)  # the differences around, without this one
    mean = (sums[hi] - sums[lo] - d) / m
    std = np.sqrt(np.maximum(0.0, (squares[hi] - squares[lo] - d * d) / m - mean**2))
    cut = (d >= config.least) & (d > mean + config.factor * std)
    return [0, *(np.flatnonzero(cut) + 1).tolist()], np.concatenate([[0.0], d])


def store(df: DataFrame, config: ShotConfig = ShotConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and media: each text as an AVI."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode_files([payload_of(t)[0] for t in texts_of(batch)], config.fps), pa.binary())], names=["doc_id", "media"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def clips(df: DataFrame, config: ShotConfig = ShotConfig(), doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each shot: doc_id, shot, first_frame, frames, start_s, end_s, change (difference at its start), error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc, (frames, fps, error) in zip(batch.column(0).to_pylist(), decode_files(batch.column(1).to_pylist()), strict=True):
                if error:
                    rows.append((doc, None, None, None, None, None, None, error))
                first, d = shots(frames, config)
                for k, a in enumerate(first):
                    b = first[k + 1] if k + 1 < len(first) else len(frames)
                    rows.append((doc, k, a, b - a, a / fps, b / fps, float(d[a]), None))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "shot", "first_frame", "frames", "start_s", "end_s", "change", "error"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(media).cast("binary").alias("media")).mapInArrow(run, "doc_id long, shot int, first_frame long, frames long, start_s double, end_s double, change double, error string")


ROUND_TRIP = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip(df: DataFrame, config: ShotConfig = ShotConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as an AVI and read back from those bytes, with digests of both and its shots as a feature."""
    prepare(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=2 << 20):
            made = [payload_of(t) for t in texts_of(batch)]
            files = encode_files([p for p, _ in made], config.fps)
            rows = []
            for doc, (_, n), raw, (frames, fps, error) in zip(batch.column(0).to_pylist(), made, files, decode_files(files), strict=True):
                if error:
                    raise ValueError(error)
                back = frames.tobytes()
                first, d = shots(frames, config)
                feature = f"frames={len(frames)};seconds={len(frames) / fps:.2f};shots={len(first)};cuts={','.join(map(str, first[1:]))};change={d.mean():.6f}"
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in ROUND_TRIP.split(", ")])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ROUND_TRIP)
