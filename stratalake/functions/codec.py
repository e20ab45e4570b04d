"""The store's containers: manifests, input logs, packs and index sidecars, to bytes and back.

Decoders never raise on bad bytes: they give an error by name, the first that a reader meets, footer before fields.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .hashing import blake3, blake3_many

#: Fixed values of the formats (all integers little-endian).
MANIFEST_MAGIC, MANIFEST_VERSION, MANIFEST_HEADER = b"SPSMAN01", 1, 96
DELTA, ZSTD = 1, 2
LOG_MAGIC, LOG_VERSION, LOG_HEADER = b"SILG", 1, 24
PACK_MAGIC, PACK_END, PACK_VERSION = b"SPK1", b"SPKF", 1
PACK_HEADER, RECORD_HEADER, PACK_FOOTER = 20, 37, 44
PAGE, FOOTER, RAW_PAGE = 4096, 32, 1

_MANIFEST = struct.Struct("<8sHHI32sQQQQQII")
_LOG = struct.Struct("<4sHHIIQ")
_ENTRY = np.dtype([("page_index", "<u8"), ("page_hash", "V32")])
_SIDECAR = np.dtype([("page_hash", "V32"), ("pack_id", "<u4"), ("offset", "<u8")])


@dataclass
class Manifest:
    guest_ram_bytes: int
    entries: list[tuple[int, bytes]]
    parent: bytes | None = None  #: none: FULL
    blob: bytes = b""
    blob_format: int = 0
    blob_zstd: bool = False
    blob_raw_len: int | None = None  #: none: as long as the blob
    version: int = MANIFEST_VERSION

    @property
    def is_delta(self) -> bool:
        return self.parent is not None


def _packed(entries: list[tuple[int, bytes]]) -> np.ndarray:
    out = np.empty(len(entries), _ENTRY)
    out["page_index"] = [i for i, _ in entries]
    out["page_hash"] = np.frombuffer(b"".join(h for _, h in entries), "V32")
    return out


def _unzipped_size(blob: bytes) -> int:
    """The summed sizes of all zstd frames of the blob; -1 if one is unfinished, or anything else is in it."""
    import zstandard

    size = 0
    while blob:
        frame = zstandard.ZstdDecompressor().decompressobj()
        try:
            size += len(frame.decompress(blob))
        except zstandard.ZstdError:
            return -1
        if not frame.eof:
            return -1
        blob = frame.unused_data
    return size


def _entry_fault(index: np.ndarray, delta: bool, parent: bytes, ram: int) -> str | None:
    pages, rooted = ram // PAGE, parent == bytes(32)
    if len(index) > 1 and not (index[1:] > index[:-1]).all():
        return "EntriesNotAscending"
    if delta:
        return "DeltaZeroParent" if rooted else "DeltaIndexOutOfRange" if len(index) and index[-1] >= pages else None
    if not rooted:
        return "FullNonZeroParent"
    if len(index) != pages:
        return "FullCountMismatch"
    return "FullNotContiguous" if len(index) and index[-1] != pages - 1 else None


def build_fault(m: Manifest) -> str | None:
    """What keeps a manifest from being encoded."""
    if m.guest_ram_bytes % PAGE:
        return "GuestRamNotAligned"
    fault = _entry_fault(np.array([i for i, _ in m.entries], np.uint64), m.is_delta, m.parent or bytes(32), m.guest_ram_bytes)
    if fault:
        return fault
    raw = len(m.blob) if m.blob_raw_len is None else m.blob_raw_len
    if m.blob_zstd:
        return None if _unzipped_size(m.blob) == raw else "ZstdRawLenMismatch"
    return None if raw == len(m.blob) else "NonZstdRawLenMismatch"


def manifest_body(m: Manifest) -> bytes:
    """A container without its footer."""
    if fault := build_fault(m):
        raise ValueError(fault)
    flags = (DELTA if m.is_delta else 0) | (ZSTD if m.blob_zstd else 0)
    raw = len(m.blob) if m.blob_raw_len is None else m.blob_raw_len
    head = _MANIFEST.pack(MANIFEST_MAGIC, m.version, flags, MANIFEST_HEADER, m.parent or bytes(32), m.guest_ram_bytes, PAGE, len(m.entries), len(m.blob), raw, m.blob_format, 0)
    return head + _packed(m.entries).tobytes() + m.blob


def encode_manifest(m: Manifest) -> bytes:
    body = manifest_body(m)
    return body + blake3(body)


def decode_manifest(raw: bytes, digest: bytes | None = None) -> Manifest | str:
    """The manifest, or the name of its fault. digest: the hash of all before the footer, if known."""
    if len(raw) < MANIFEST_HEADER + FOOTER:
        return "Truncated"
    body = raw[:-FOOTER]
    if (digest or blake3(body)) != raw[-FOOTER:]:
        return "FooterMismatch"
    magic, version, flags, header, parent, ram, page, count, blob_len, blob_raw, blob_format, reserved = _MANIFEST.unpack_from(body)
    need = MANIFEST_HEADER + _ENTRY.itemsize * count + blob_len
    faults = {
        "BadMagic": magic != MANIFEST_MAGIC,
        "UnsupportedVersion": version != MANIFEST_VERSION,
        "UnknownFlags": flags & ~(DELTA | ZSTD),
        "BadHeaderLen": header != MANIFEST_HEADER,
        "ReservedNonZero": reserved,
        "BadPageSize": page != PAGE,
        "GuestRamNotAligned": ram % PAGE,
        "Truncated": len(body) < need,
        "TrailingBytes": len(body) > need,
    }
    if fault := next((k for k, v in faults.items() if v), None):
        return fault
    entries = np.frombuffer(body, _ENTRY, count, MANIFEST_HEADER)
    if fault := _entry_fault(entries["page_index"], bool(flags & DELTA), parent, ram):
        return fault
    blob = body[need - blob_len :]
    if flags & ZSTD and _unzipped_size(blob) != blob_raw:
        return "ZstdRawLenMismatch"
    if not flags & ZSTD and blob_raw != blob_len:
        return "NonZstdRawLenMismatch"
    rows = [(int(i), h.tobytes()) for i, h in zip(entries["page_index"], entries["page_hash"], strict=True)]
    return Manifest(ram, rows, parent if flags & DELTA else None, blob, blob_format, bool(flags & ZSTD), blob_raw, version)


def container_id(raw: bytes) -> bytes:
    """The name of a container: the hash of all before its footer."""
    return blake3(raw[:-FOOTER])


def log_body(inner_version: int, payload: bytes) -> bytes:
    return _LOG.pack(LOG_MAGIC, LOG_VERSION, 0, inner_version, 0, len(payload)) + payload


def encode_log(inner_version: int, payload: bytes) -> bytes:
    body = log_body(inner_version, payload)
    return body + blake3(body)


def decode_log(raw: bytes, digest: bytes | None = None) -> tuple[int, bytes] | str:
    if len(raw) < LOG_HEADER + FOOTER:
        return "Truncated"
    body = raw[:-FOOTER]
    if (digest or blake3(body)) != raw[-FOOTER:]:
        return "FooterMismatch"
    magic, version, flags, inner, reserved, size = _LOG.unpack_from(body)
    faults = {"BadMagic": magic != LOG_MAGIC, "UnsupportedVersion": version != LOG_VERSION, "NonZeroFlags": flags, "ReservedNonZero": reserved, "PayloadLenMismatch": len(body) < LOG_HEADER + size, "TrailingBytes": len(body) > LOG_HEADER + size}
    return next((k for k, v in faults.items() if v), None) or (inner, body[LOG_HEADER:])


def encode_pack(pack_id: int, pages: list[tuple[bytes, bytes]], created: int = 0, sealed: bool = True) -> bytes:
    """pages: hash and payload of each record."""
    records = b"".join(h + struct.pack("<BI", RAW_PAGE, len(p)) + p for h, p in pages)
    head = PACK_MAGIC + struct.pack("<IIQ", PACK_VERSION, pack_id, created)
    return head + records + (PACK_END + struct.pack("<Q", len(pages)) + blake3(records) if sealed else b"")


@dataclass
class Pack:
    pack_id: int
    records: list[tuple[int, bytes, bytes]] = field(default_factory=list)  #: offset, hash, payload
    sealed: bool = False
    error: str | None = None  #: of the whole pack
    torn_at: int | None = None  #: where an unsealed pack stops being whole
    promised: int | None = None  #: records by the footer of a sealed pack


def decode_pack(raw: bytes, verify: bool = False) -> Pack:
    """All whole records. A sealed pack is checked against its footer, with verify also its body's hash; an unsealed one
    is read up to its first torn record."""
    if len(raw) < PACK_HEADER:
        return Pack(-1, error="Runt")
    version, pack_id, _ = struct.unpack_from("<IIQ", raw, 4)
    if raw[:4] != PACK_MAGIC or version != PACK_VERSION:
        return Pack(-1, error="BadMagic")
    out, at, size = Pack(pack_id), PACK_HEADER, RECORD_HEADER + PAGE
    out.sealed = len(raw) >= PACK_HEADER + PACK_FOOTER and raw[-PACK_FOOTER : -PACK_FOOTER + 4] == PACK_END and (len(raw) - PACK_HEADER - PACK_FOOTER) % size == 0
    end = len(raw) - (PACK_FOOTER if out.sealed else 0)
    while at + RECORD_HEADER <= end:
        flag, length = struct.unpack_from("<BI", raw, at + 32)
        if flag != RAW_PAGE or length != PAGE or at + size > end:
            break
        out.records.append((at, raw[at : at + 32], raw[at + RECORD_HEADER : at + size]))
        at += size
    if at < end:
        out.torn_at = at
        out.error = "TruncatedRecord" if out.sealed else None
    if out.sealed:
        count, body = struct.unpack_from("<Q32s", raw, len(raw) - PACK_FOOTER + 4)
        out.promised = count
        if count != len(out.records):
            out.error = "FooterMismatch"
        elif verify and blake3(raw[PACK_HEADER:-PACK_FOOTER]) != body:
            out.error = "BadBodyHash"
    return out


def bad_records(pack: Pack) -> list[int]:
    """Offsets of records whose payload has another hash."""
    found = blake3_many([p for _, _, p in pack.records])
    return [at for (at, h, _), own in zip(pack.records, found, strict=True) if own != h]


def encode_sidecar(entries: list[tuple[bytes, int, int]]) -> bytes:
    """hash, pack, offset of each page, sorted by hash."""
    table = np.empty(len(entries), _SIDECAR)
    for k, (h, pack, offset) in enumerate(sorted(entries)):
        table[k] = (h, pack, offset)
    body = struct.pack("<I", len(entries)) + table.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_sidecar(raw: bytes) -> list[tuple[bytes, int, int]] | str:
    if len(raw) < 8:
        return "Truncated"
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        return "BadCrc"
    count = struct.unpack_from("<I", raw)[0]
    if len(raw) - 8 < count * _SIDECAR.itemsize:
        return "Truncated"
    table = np.frombuffer(raw, _SIDECAR, count, 4)
    return [(r["page_hash"].tobytes(), int(r["pack_id"]), int(r["offset"])) for r in table]


def digests(containers: list[bytes], of: Callable[[bytes], bytes] = lambda c: c[:-FOOTER]) -> list[bytes]:
    """Hashes of the containers' bodies, those of one length together."""
    return blake3_many([of(c) if len(c) >= FOOTER else b"" for c in containers])
