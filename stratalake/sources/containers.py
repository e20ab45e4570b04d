"""Readers and writers of the store's files: DataFrames of containers, packs and sidecars.

Files are read with Spark's binaryFile source, so any store that Spark reads will do; writers use names that sort and
never overwrite.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.hashing import blake3_many

MANIFEST = "snapshot_ref binary, version int, is_delta boolean, parent_ref binary, guest_ram_bytes bigint, entry_count bigint, device_blob struct<format: bigint, zstd: boolean, bytes: binary, raw_len: bigint>, entries array<struct<page_index: bigint, page_hash: binary>>, error string"
LOG = "log_id binary, inner_format_version bigint, payload binary, error string"
RECORD = "path string, pack_id bigint, offset bigint, page_hash binary, payload binary, sealed boolean, error string"
SIDECAR = "path string, page_hash binary, pack_id bigint, offset bigint, error string"


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, content of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return found.select("path", "content")


def manifest_refs(spark: SparkSession, folder: str) -> DataFrame:
    """snapshot_ref of each manifest file, from its name alone; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.spm").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    name = F.regexp_extract("path", r"([0-9a-fA-F]{64})\.spm$", 1)
    return found.select(name.alias("name")).where("name != ''").select(F.unhex("name").alias("snapshot_ref"))


def decode_manifests(df: DataFrame, content: str = "content") -> DataFrame:
    schema = _arrow(df.sparkSession, MANIFEST)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x or b"" for x in batch.column(0).to_pylist()]
            rows = []
            for raw, digest in zip(raws, codec.digests(raws), strict=True):
                m = codec.decode_manifest(raw, digest)
                if isinstance(m, str):
                    rows.append({"snapshot_ref": raw[-32:] if len(raw) >= 32 else None, "error": m})
                else:
                    rows.append({"snapshot_ref": digest, "version": m.version, "is_delta": m.is_delta, "parent_ref": m.parent, "guest_ram_bytes": m.guest_ram_bytes, "entry_count": len(m.entries), "device_blob": {"format": m.blob_format, "zstd": m.blob_zstd, "bytes": m.blob, "raw_len": m.blob_raw_len}, "entries": [{"page_index": i, "page_hash": h} for i, h in m.entries], "error": None})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select(F.col(content).cast("binary").alias("content")).mapInArrow(run, MANIFEST)


def encode_manifests(df: DataFrame) -> DataFrame:
    """df: parent_ref?, guest_ram_bytes, entries, device_blob. Returns snapshot_ref, container, error."""
    out = "snapshot_ref binary, container binary, error string"
    schema = _arrow(df.sparkSession, out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults, bodies = [], []
            for r in batch.to_pylist():
                blob = r["device_blob"] or {"format": 0, "zstd": False, "bytes": b"", "raw_len": 0}
                m = codec.Manifest(r["guest_ram_bytes"], [(e["page_index"], e["page_hash"]) for e in r["entries"] or []], r["parent_ref"], blob["bytes"], blob["format"], blob["zstd"], blob["raw_len"])
                faults.append(codec.build_fault(m))
                bodies.append(b"" if faults[-1] else codec.manifest_body(m))
            refs = blake3_many(bodies)
            rows = [{"error": f} if f else {"snapshot_ref": h, "container": b + h, "error": None} for f, b, h in zip(faults, bodies, refs, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select("parent_ref", "guest_ram_bytes", "entries", "device_blob").mapInArrow(run, out)


def decode_logs(df: DataFrame, content: str = "content") -> DataFrame:
    schema = _arrow(df.sparkSession, LOG)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x or b"" for x in batch.column(0).to_pylist()]
            rows = []
            for raw, digest in zip(raws, codec.digests(raws), strict=True):
                got = codec.decode_log(raw, digest)
                rows.append({"log_id": digest, "error": got} if isinstance(got, str) else {"log_id": digest, "inner_format_version": got[0], "payload": got[1], "error": None})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select(F.col(content).cast("binary").alias("content")).mapInArrow(run, LOG)


def encode_logs(df: DataFrame, payload: str = "payload", version: int = 1) -> DataFrame:
    """log_id, content of each payload."""
    out = "log_id binary, content binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [codec.log_body(version, x or b"") for x in batch.column(0).to_pylist()]
            ids = blake3_many(bodies)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([b + h for b, h in zip(bodies, ids, strict=True)], pa.binary())], names=["log_id", "content"])

    return df.select(F.col(payload).cast("binary").alias("payload")).mapInArrow(run, out)


def read_packs(df: DataFrame, verify: bool = False) -> DataFrame:
    """df: path, content. A row for each record, and one with the error alone for a damaged pack or record."""
    schema = _arrow(df.sparkSession, RECORD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pack = codec.decode_pack(raw, verify)
                bad = set(codec.bad_records(pack)) if verify else set()
                rows = [{"path": path, "pack_id": pack.pack_id, "offset": at, "page_hash": h, "payload": p, "sealed": pack.sealed, "error": "HashMismatch" if at in bad else None} for at, h, p in pack.records]
                if pack.error:
                    rows.append({"path": path, "pack_id": pack.pack_id, "offset": pack.torn_at, "sealed": pack.sealed, "error": pack.error})
                for at in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 1024], schema)

    return df.select("path", "content").mapInArrow(run, RECORD)


def read_sidecars(df: DataFrame) -> DataFrame:
    schema = _arrow(df.sparkSession, SIDECAR)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = codec.decode_sidecar(raw)
                rows = [{"path": path, "error": got}] if isinstance(got, str) else [{"path": path, "page_hash": h, "pack_id": p, "offset": o, "error": None} for h, p, o in got]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select("path", "content").mapInArrow(run, SIDECAR)


def rebuilt_index(records: DataFrame) -> DataFrame:
    """The index of packs without a usable sidecar, from their records: the first place of each page."""
    first = F.min(F.struct("pack_id", "offset"))
    return records.where("error IS NULL").groupBy("page_hash").agg(first.alias("at")).select("page_hash", F.col("at.pack_id").cast("int").alias("pack_id"), F.col("at.offset").alias("offset"))


def write_packs(pages: DataFrame, folder: str, sealed: bool = True) -> DataFrame:
    """pages: page_hash, payload, pack_id, offset. Writes pack-%08x.spk and its .idx, by temporary name and rename; a pack is
    one task's, its records in order of offset. Returns path, pack_id, records."""
    from pyarrow.fs import FileSystem

    out = "path string, pack_id bigint, records bigint"

    def put(fs: FileSystem, path: str, raw: bytes) -> None:
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temporary) as f:
            f.write(raw)
        fs.move(temporary, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        done: list[tuple[str, int, int]] = []
        held: list[tuple[bytes, bytes]] = []

        def close(pack: int | None) -> None:
            if pack is None:
                return
            path = f"{top}/pack-{pack:08x}"
            put(fs, f"{path}.spk", codec.encode_pack(pack, held, sealed=sealed))
            put(fs, f"{path}.idx", codec.encode_sidecar([(h, pack, 20 + 4133 * k) for k, (h, _) in enumerate(held)]))
            done.append((f"{path}.spk", pack, len(held)))
            held.clear()

        last = None
        for batch in batches:
            for pack, h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pack != last:
                    close(last)
                    last = pack
                held.append((h, p))
        close(last)
        cols = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "pack_id", "records"])

    rows = pages.repartition("pack_id").sortWithinPartitions("pack_id", "offset").select("pack_id", "page_hash", "payload")
    return rows.mapInArrow(run, out)


def get_snapshots(layers: DataFrame, refs: DataFrame) -> DataFrame:
    """layers: content of manifest files. The containers of the asked refs (snapshot_ref), with an error where the bytes are
    not what the ref names."""
    out = "snapshot_ref binary, container binary, error string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x or b"" for x in batch.column(0).to_pylist()]
            named = [r[-32:] if len(r) >= 32 else None for r in raws]
            faults = [None if h == own else "ManifestCorrupt" for h, own in zip(codec.digests(raws), named, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.binary()), pa.array(raws, pa.binary()), pa.array(faults, pa.string())], names=["snapshot_ref", "container", "error"])

    found = layers.select(F.col("content").cast("binary").alias("content")).mapInArrow(run, out)
    return found.join(refs.select("snapshot_ref").distinct(), "snapshot_ref", "left_semi")


def bad_manifests(df: DataFrame) -> DataFrame:
    """path, error of the manifest files that a start-up purge removes: those that do not decode, or carry another name."""
    schema = _arrow(df.sparkSession, "path string, error string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x or b"" for x in batch.column(1).to_pylist()]
            rows = []
            for path, raw, digest in zip(batch.column(0).to_pylist(), raws, codec.digests(raws), strict=True):
                got = codec.decode_manifest(raw, digest)
                if isinstance(got, str):
                    rows.append({"path": path, "error": got})
                elif not path.lower().endswith(f"{digest.hex()}.spm"):
                    rows.append({"path": path, "error": "NameMismatch"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select("path", "content").mapInArrow(run, "path string, error string")


def pack_facts(df: DataFrame, deep: bool = False) -> DataFrame:
    """df: path, content. A row for each pack: whether it is sealed, its whole records, the count in its footer; with deep,
    whether its body has another hash and the offsets of records that do. A runt or a foreign file has no records."""
    out = "path string, sealed boolean, records bigint, promised bigint, bad_body boolean, bad_records array<bigint>"
    schema = _arrow(df.sparkSession, out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pack = codec.decode_pack(raw)
                body = raw[codec.PACK_HEADER : -codec.PACK_FOOTER]
                bad_body = deep and pack.sealed and blake3_many([body])[0] != raw[-32:]
                rows.append({"path": path, "sealed": pack.sealed, "records": len(pack.records), "promised": pack.promised, "bad_body": bad_body, "bad_records": codec.bad_records(pack) if deep else []})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select("path", "content").mapInArrow(run, out)


def layer_facts(df: DataFrame) -> DataFrame:
    """df: path, content. A row for each manifest file with a ref for a name: snapshot_ref, entries, and as error either
    BadFooter, where its bytes are not what the name says, or the decoder's."""
    out = "path string, snapshot_ref binary, error string, entries array<struct<page_index: bigint, page_hash: binary>>"
    schema = _arrow(df.sparkSession, out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x or b"" for x in batch.column(1).to_pylist()]
            rows = []
            for path, raw, digest in zip(batch.column(0).to_pylist(), raws, codec.digests(raws), strict=True):
                named = bytes.fromhex(path[-68:-4])
                got = "BadFooter" if len(raw) < 32 or digest != raw[-32:] or digest != named else codec.decode_manifest(raw, digest)
                rows.append({"path": path, "snapshot_ref": named, "error": got} if isinstance(got, str) else {"path": path, "snapshot_ref": named, "entries": [{"page_index": i, "page_hash": h} for i, h in got.entries]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select("path", "content").where(F.col("path").rlike(r"(^|/)[0-9a-fA-F]{64}\.spm$")).mapInArrow(run, out)


def log_facts(df: DataFrame) -> DataFrame:
    """df: log_id, content. error is BadFooter where the content's body has another hash than the id."""
    out = "log_id binary, error string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column(0), [x or b"" for x in batch.column(1).to_pylist()]
            faults = [None if len(raw) >= 32 and h == own else "BadFooter" for raw, h, own in zip(raws, codec.digests(raws), ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(faults, pa.string())], names=["log_id", "error"])

    return df.select(F.col("log_id").cast("binary").alias("log_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, out)


def recover_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a folder of packs after a crash: page_hash, pack_id, offset. Sealed packs with a sound sidecar are indexed
    by it alone; all others by scanning their records up to the first torn one; runts and foreign files have none. Of
    several places of a page the first counts."""
    sidecars = read_sidecars(files(spark, folder, "*.idx"))
    stem = F.regexp_extract("path", r"(pack-[0-9a-fA-F]{8})\.(spk|idx)$", 1)
    sound = sidecars.groupBy(stem.alias("stem")).agg(F.count_if(F.col("error").isNotNull()).alias("bad")).where("bad = 0").select("stem")
    loaded = sidecars.withColumn("stem", stem).join(sound, "stem", "left_semi")
    scanned = read_packs(files(spark, folder, "*.spk").withColumn("stem", stem).join(sound, "stem", "left_anti"))
    both = loaded.select("page_hash", "pack_id", "offset").unionByName(scanned.where("error IS NULL").select("page_hash", "pack_id", "offset"))
    return both.groupBy("page_hash").agg(F.min(F.struct("pack_id", "offset")).alias("at")).select("page_hash", F.col("at.pack_id").cast("int").alias("pack_id"), F.col("at.offset").alias("offset"))
