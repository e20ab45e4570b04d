"""Integrity checks: every class of violation is an anti-join or a hash computed again. Each check returns rows of
violation, subject and detail, so reports are unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PRUNED
from . import pages

#: The classes of violation, shallow ones first.
CLASSES = ["MissingManifest", "DanglingPin", "MissingPage", "BadSidecarCrc", "BadManifestFooter", "BadPackFooter", "SidecarRecordCountMismatch", "MissingInputLog", "BadManifestDecode", "RecordHashMismatch", "BadPackBodyHash", "BadInputLogFooter"]


def _rows(df: DataFrame, kind: str, subject: str, detail) -> DataFrame:
    return df.select(F.lit(kind).alias("violation"), F.col(subject).cast("string").alias("subject"), detail.cast("string").alias("detail"))


def missing_manifests(nodes: DataFrame, manifests: DataFrame) -> DataFrame:
    """Nodes that are not pruned and whose snapshot is not stored."""
    bad = nodes.where(F.col("status") != PRUNED).join(manifests.select("snapshot_ref"), "snapshot_ref", "left_anti")
    return _rows(bad, "MissingManifest", "snapshot_ref", F.concat_ws("/", "experiment_id", "node_id"))


def dangling_pins(pins: DataFrame, manifests: DataFrame) -> DataFrame:
    return _rows(pins.join(manifests.select("snapshot_ref"), "snapshot_ref", "left_anti"), "DanglingPin", "snapshot_ref", F.col("note"))


def missing_pages(entries: DataFrame, index: DataFrame) -> DataFrame:
    return page_violations(pages.missing_pages(entries, index))


def page_violations(lost: DataFrame) -> DataFrame:
    """Entries whose page is not stored, as violations."""
    return _rows(lost, "MissingPage", "page_hash", F.concat_ws("#", "snapshot_ref", "page_index"))


def missing_input_logs(nodes: DataFrame, logs: DataFrame) -> DataFrame:
    bad = nodes.where("input_log_id IS NOT NULL").join(logs.select(F.col("log_id").alias("input_log_id")), "input_log_id", "left_anti")
    return _rows(bad, "MissingInputLog", "input_log_id", F.concat_ws("/", "experiment_id", "node_id"))


def count_mismatches(index: DataFrame, packs: DataFrame) -> DataFrame:
    """packs: pack_id, record_count. Packs whose index has another number of records."""
    held = index.groupBy("pack_id").agg(F.count("*").alias("indexed"))
    both = packs.join(held, "pack_id", "left").withColumn("indexed", F.coalesce("indexed", F.lit(0))).where("indexed != record_count")
    return _rows(both, "SidecarRecordCountMismatch", "pack_id", F.concat_ws("!=", "indexed", "record_count"))


def failed(checks: DataFrame, kind: str, subject: str, error: str = "error") -> DataFrame:
    """Rows of a decoder whose error is not null, as violations of a kind."""
    return _rows(checks.where(F.col(error).isNotNull()), kind, subject, F.col(error))


def report(*found: DataFrame) -> DataFrame:
    """violation, n of each class that occurs."""
    return reduce(DataFrame.unionByName, found).groupBy("violation").agg(F.count("*").alias("n"))


def is_ok(*found: DataFrame) -> bool:
    return reduce(DataFrame.unionByName, found).isEmpty()


def reconcile_plan(nodes: DataFrame, manifests: DataFrame) -> DataFrame:
    """Nodes that a start-up repair marks as pruned, without a tombstone: their snapshot is not stored."""
    bad = nodes.where(F.col("status") != PRUNED).join(manifests.select("snapshot_ref"), "snapshot_ref", "left_anti")
    return bad.select("experiment_id", "node_id", "snapshot_ref", F.lit(PRUNED).alias("new_status"))
