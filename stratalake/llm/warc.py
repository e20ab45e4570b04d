"""WARC: a deterministic sharded writer, and a reader.

Records are range-sorted by page id. Ranges of ids are counted exactly, and those with too many bytes are cut further
until each fits a shard or is one id, so the same table always gives the same shards of about the same size, wherever
its ids lie; an id with more bytes than a shard is cut by ranges of payload digests. Each shard is a partition of its
own: a task writes its records in order and rolls to a new file when the compressed size reaches ``file_bytes``.
Headers and digests are made anew. Of records with equal payloads the least page id is the response and the others
revisit it.

A file is written under a temporary name that no other attempt uses. The manifest, a table written by Spark's own
commit protocol, lists the files of the attempts that count; ``commit`` renames just those to their final names, and
temporary files that no manifest lists are removed. It may be called again after a crash at any point, with the same
outcome; ``write_archives`` on a folder that has a manifest raises FileExistsError.

Defined results: a null payload is empty; a null URL is an empty one; rows with equal ids and payloads are one response
and revisits of it, in one shard; rows with a null id are responses, in the last shards, unless a row with an id has the
same payload, which they then revisit; texts of any length are one record each; an empty table gives no files; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare, remove

#: Bytes of a file that are unpacked at a time.
STEP = 1 << 16

MANIFEST = "name string, temporary string, shard int, records long, bytes long, sha256 string"
RECORD = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long"
#: Fixed value: the profile of a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    shard_bytes: int = 16 << 20  #: of payload, about, in a shard
    most_shards: int = 50_000  #: about; a larger table has larger shards
    file_bytes: int = 8 << 20  #: compressed size at which a file ends
    revisit_bytes: int = 0  #: shorter payloads are always responses
    date: str = "2000-01-01T00:00:00Z"  #: of every record; the tables have no capture time
    level: int = 6
    fan: int = 4  #: ranges that a range is cut into, for each shard it would fill


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes, config: WarcConfig) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Date", config.date), ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(config.level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_record(page_id: int | None, url: str, payload: bytes, first: int | None, config: WarcConfig) -> bytes:
    """A gzip member; first: the response's page id if this is a revisit."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    headers = [("WARC-Record-ID", _id(page_id, digest)), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if first is None:
        return _record("response", headers, http + payload, config)
    return _record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(first, digest)), ("X-Refers-To-Page-ID", str(first))], http, config)


class _Files:
    """Files of one task, rolled by size; rows tells what was written."""

    def __init__(self, folder: str, config: WarcConfig):
        self.fs, self.top = FileSystem.from_uri(folder)
        self.config, self.rows, self.out = config, [], None
        self.attempt = uuid.uuid4().hex

    def start(self, shard: int) -> None:
        self.close()
        self.shard, self.number = shard, 0

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.top}/{self.temporary}")
            self.size, self.count, self.sha = 0, 0, hashlib.sha256()
            self._put(_record("warcinfo", [("WARC-Record-ID", _id(None, self.name)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.config))
        self._put(member)
        self.count += 1
        if self.size >= self.config.file_bytes:
            self.close()

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.temporary, self.shard, self.count, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def _literal(values: list[int]) -> Column:
    """An array that is folded into one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


class Shards:
    """A tree of ranges of ids, each with its exact bytes; a leaf fits a shard or is a single id.

    The driver holds the tree alone, ``fan`` leaves for each shard of the table: a few times ``most_shards`` numbers."""

    def __init__(self, sized: DataFrame, config: WarcConfig):
        """sized: page_id, size."""
        held = [F.sum("size").alias("bytes"), F.min("page_id").alias("low"), F.max("page_id").alias("high")]
        loose, root = (sized.where(x).agg(*held).first() for x in ("page_id IS NULL", "page_id IS NOT NULL"))
        total = (loose["bytes"] or 0) + (root["bytes"] or 0)
        target = max(config.shard_bytes, -(-total // config.most_shards))
        self.low, self.width, self.base, self.levels = [root["low"] or 0], [0], [0], 0
        held_bytes, high, fresh = [root["bytes"] or 0], [root["high"] or 0], [0]
        while heavy := [k for k in fresh if held_bytes[k] > target and self.low[k] < high[k]]:
            start = len(self.low)
            for k in heavy:
                span = high[k] - self.low[k] + 1
                fan = min(span, max(2, config.fan * -(-held_bytes[k] // target)))
                self.width[k], self.base[k] = -(-span // fan), len(self.low)
                for column in (self.low, self.width, self.base, held_bytes, high):
                    column += [0] * fan
            self.levels += 1
            for r in self._noded(sized.where("page_id IS NOT NULL")).where(F.col("_node") >= start).groupBy("_node").agg(*held).collect():
                k = r["_node"]
                self.low[k], high[k], held_bytes[k] = r["low"], r["high"], r["bytes"]
            fresh = range(start, len(self.low))
        self.first, self.pieces, used, self.count = [0] * len(self.low), [1] * len(self.low), 0, 0
        todo = [0]
        while todo:
            k = todo.pop()
            if self.width[k]:
                fan = -(-(high[k] - self.low[k] + 1) // self.width[k])
                todo += reversed(range(self.base[k], self.base[k] + fan))
                continue
            if used and used + held_bytes[k] > target:
                self.count, used = self.count + 1, 0
            self.first[k], used = self.count, used + held_bytes[k]
            if held_bytes[k] > target:
                self.pieces[k] = -(-held_bytes[k] // target)
                self.count, used = self.count + self.pieces[k], 0
        self.count += bool(used)
        self.loose, self.loose_pieces = self.count, -(-(loose["bytes"] or 0) // target)
        self.count = max(1, self.count + self.loose_pieces)

    def _noded(self, df: DataFrame) -> DataFrame:
        """df with the leaf of each page_id; the steps are in decimals, as ids may lie 2^64 apart."""
        low, width, base = _literal(self.low), _literal(self.width), _literal(self.base)
        df = df.withColumn("_node", F.lit(0))
        for _ in range(self.levels):
            df = df.withColumns({"_low": F.get(low, F.col("_node")), "_width": F.get(width, F.col("_node")), "_base": F.get(base, F.col("_node"))})
            down = F.expr("CASE WHEN _width = 0 THEN _node ELSE CAST(_base + (CAST(page_id AS DECIMAL(20, 0)) - _low) div _width AS INT) END")
            df = df.withColumn("_node", F.when(F.col("page_id").isNotNull(), down).otherwise(0)).drop("_low", "_width", "_base")
        return df

    def dealt(self, df: DataFrame, everywhere: bool = False) -> DataFrame:
        """df (page_id, print, url) with its shard; everywhere: a row of a null id goes to all shards of null ids."""
        df = self._noded(df).withColumns({"_first": F.get(_literal(self.first), F.col("_node")), "_pieces": F.get(_literal(self.pieces), F.col("_node"))})
        part = lambda digest, pieces: F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * pieces / F.lit(1 << 32))
        own = F.col("_first") + part(F.col("print"), F.col("_pieces"))
        if everywhere:
            loose = F.sequence(F.lit(self.loose), F.lit(self.loose + max(1, self.loose_pieces) - 1))
            df = df.withColumn("shard", F.explode(F.when(F.col("page_id").isNotNull(), F.array(own.cast("int"))).otherwise(loose)))
        else:
            loose = F.lit(self.loose) + part(F.sha2(F.concat("print", "url"), 256), F.lit(max(1, self.loose_pieces)))
            df = df.withColumn("shard", F.when(F.col("page_id").isNotNull(), own).otherwise(loose).cast("int"))
        return df.drop("_node", "_first", "_pieces")


def write_archives(df: DataFrame, folder: str, config: WarcConfig = WarcConfig(), page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write df's records below folder, a URI that pyarrow and Spark know. Returns the manifest."""
    spark = df.sparkSession
    fs, top = FileSystem.from_uri(folder)
    if fs.get_file_info(f"{top}/manifest/_SUCCESS").is_file:
        raise FileExistsError(f"{folder} has a manifest; commit(spark, folder) finishes it")
    prepare(spark)
    pages = df.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    shards = Shards(pages.select("page_id", (F.octet_length("payload") + 400).cast("long").alias("size")), config)
    prints = pages.select("page_id", F.sha2("payload", 256).alias("print"), F.octet_length("payload").alias("size"))
    first = prints.where(F.col("size") >= config.revisit_bytes).groupBy("print").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    first = materialise(first, "first-pages")  # so that adaptive execution can split the join at a payload of many pages
    refers = prints.select("page_id", "print").join(first, "print").where("NOT page_id <=> first").distinct()
    # References and pages meet in the one shuffle that carries payloads; a reference sorts before its page.
    columns = ["page_id", "print", "first", "url", "payload", "shard"]
    refers = shards.dealt(refers.select("page_id", "print", "first", F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload")), True)
    own = shards.dealt(pages.select("page_id", F.sha2("payload", 256).alias("print"), F.lit(None).cast("long").alias("first"), "url", "payload"))
    both = refers.select(*columns).unionByName(own.select(*columns))
    both = both.repartitionById(shards.count, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "print", F.col("payload").isNotNull(), "url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, shard, refer, last = _Files(folder, config), None, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, digest, first, url, payload, own = row
                if own != shard:
                    files.start(shard := own)
                    refer = last = None
                if payload is None:
                    refer = (page, digest, first)
                    continue
                to = refer[2] if refer is not None and refer[:2] == (page, digest) else None
                if to is None and page is not None and last == (page, digest) and len(payload) >= config.revisit_bytes:
                    to = page
                last = (page, digest)
                files.write(page_record(page, url, payload, to, config))
        files.close()
        cols = list(zip(*files.rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "temporary", "shard", "records", "bytes", "sha256"])

    fs.create_dir(f"{top}/_temporary", recursive=True)
    both.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return commit(spark, folder)


def commit(spark: SparkSession, folder: str) -> DataFrame:
    """Give the files that the manifest lists their final names and remove all other attempts. Returns the manifest."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                done = fs.get_file_info(f"{top}/{name}")
                if not (done.is_file and done.size == size):
                    fs.move(f"{top}/{temporary}", f"{top}/{name}")
            yield batch.select(["name"])

    renamed, listed = manifest.select("name", "temporary", "bytes").mapInArrow(rename, "name string").count(), manifest.count()
    if renamed != listed:
        raise RuntimeError(f"{renamed} of {listed} files of {folder} were renamed; call commit again")
    remove(spark, f"{folder}/_temporary")
    return manifest


def members(raw: bytes) -> Iterator[bytes]:
    """Records of a file, each a gzip member of its own; the rest of the file is never copied."""
    view, at = memoryview(raw), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            piece = view[at : at + STEP]
            if not piece:
                raise ValueError("the last record of a file is cut off")
            parts.append(unpack.decompress(piece))
            at += len(piece)
        at -= len(unpack.unused_data)
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or headers.get("warc-block-digest", f"sha1:{_digest(block)}") != f"sha1:{_digest(block)}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit of the folder's files. Digests of blocks and payloads are verified."""
    prepare(spark)
    schema = RECORD + (", payload binary" if with_payload else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for record in members(raw.as_py()):
                    headers, block = parse_record(record)
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if headers["warc-type"] == "response" and (size != len(payload) or digest != _digest(payload)):
                        raise ValueError(f"damaged payload {headers['warc-record-id']}")
                    page, first = (int(headers[k]) if k in headers else None for k in ("x-page-id", "x-refers-to-page-id"))
                    rows.append((page, headers["warc-type"], headers["warc-target-uri"], size, digest, first, payload)[: len(names)])
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("content").mapInArrow(run, schema)


#: The query: base32 digits are cut from the hex digest, five hex digits to four of them.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, upper(sha1(html)) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
