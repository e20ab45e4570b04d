"""A store as a directory of tables in immutable generations.

A commit writes new Parquet tables for what changed below gen=N+1 and then creates the pointer of generation N+1, which
fails if another writer was first. Readers resolve the newest pointer once and see that generation alone, whatever
happens meanwhile: that stands for locks, read retries and copy-on-write packs. Nodes are partitioned by experiment and
sorted by created_at within files, so scoped queries prune partitions and skip row groups.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..schema import SCHEMA_VERSION, TABLES

PARTITIONED = {"nodes": "experiment_id"}
SORTED = {"nodes": ["created_at"], "pages": ["page_hash"], "manifest_entries": ["snapshot_ref", "page_index"]}
#: Bytes of payload never ride along with the index; the index is a table of its own.
EXTRA = {"page_index": "page_hash binary, pack_id int, offset bigint"}


class ConflictingCommit(RuntimeError):
    """Another writer committed this generation first."""


class UnsupportedSchema(RuntimeError):
    """The store was written by a later version."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, generation: int) -> str:
        return f"{self.root}/pointers/{generation:012d}.json"

    def generation(self) -> int:
        """The newest generation; 0 for an empty store."""
        folder = self._path(f"{self.root}/pointers")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def snapshot(self, generation: int | None = None) -> Snapshot:
        number = self.generation() if generation is None else generation
        if not number:
            return Snapshot(self, 0, {}, {"schema_version": SCHEMA_VERSION, "logical_counter": 0})
        stream = self._fs.open(self._path(self._pointer(number)))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if told["meta"]["schema_version"] > SCHEMA_VERSION:
            raise UnsupportedSchema(f"schema version {told['meta']['schema_version']}")
        return Snapshot(self, number, told["tables"], told["meta"])

    def commit(self, base: Snapshot, changed: dict[str, DataFrame], **meta: int) -> Snapshot:
        """Write the changed tables as the generation after base. Nothing becomes visible before all is written."""
        number = base.number + 1
        tables = dict(base.tables)
        for name, df in changed.items():
            path = f"{self.root}/{name}/gen={number:012d}-{self.spark.sparkContext.applicationId}"
            out = df.sortWithinPartitions(*SORTED[name]) if name in SORTED else df
            writer = out.write.mode("overwrite")
            if name in PARTITIONED:
                writer = writer.partitionBy(PARTITIONED[name])
            writer.parquet(path)
            tables[name] = path
        told = json.dumps({"tables": tables, "meta": base.meta | meta}).encode()
        try:
            stream = self._fs.create(self._path(self._pointer(number)), False)  # not overwriting: the commit point
        except Exception as e:
            raise ConflictingCommit(f"generation {number} exists") from e
        stream.write(bytearray(told))
        stream.close()
        return Snapshot(self, number, tables, base.meta | meta)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete pointers older than the newest ``keep``, and tables that no remaining one names."""
        newest = self.generation()
        alive = {p for g in range(max(1, newest - keep + 1), newest + 1) for p in self.snapshot(g).tables.values()}
        dead = [p for g in range(1, newest - keep + 1) if self._fs.exists(self._path(self._pointer(g))) for p in self.snapshot(g).tables.values() if p not in alive]
        for g in range(1, newest - keep + 1):
            self._fs.delete(self._path(self._pointer(g)), False)
        for p in set(dead):
            self._fs.delete(self._path(p), True)
        return sorted(set(dead))


class Snapshot:
    """The tables of one generation."""

    def __init__(self, catalog: Catalog, number: int, tables: dict[str, str], meta: dict[str, int]):
        self.catalog, self.number, self.tables, self.meta = catalog, number, tables, meta

    def table(self, name: str) -> DataFrame:
        schema = (TABLES | EXTRA)[name]
        spark = self.catalog.spark
        if name not in self.tables:
            return spark.createDataFrame([], schema)
        columns = [c.strip().split()[0] for c in _split(schema)]
        return spark.read.schema(schema).parquet(self.tables[name]).select(*columns)


def _split(ddl: str) -> list[str]:
    """Columns of a DDL text; commas inside <> belong to a type."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:k])
            start = k + 1
    return [*out, ddl[start:]]
