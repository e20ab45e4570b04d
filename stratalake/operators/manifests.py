"""Manifests: validation, commit, resolution.

A layer is a row of manifests (snapshot_ref, parent_ref, is_delta, guest_ram_bytes); its entries are rows of
manifest_entries (snapshot_ref, page_index, page_hash).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHAIN_CAP, PAGE_SIZE
from .closure import ascend
from .pages import missing_pages


def validate(layers: DataFrame, entries: DataFrame) -> DataFrame:
    """snapshot_ref, entry_count, error of each layer, as a builder checks it: RAM is a positive multiple of the page,
    indices are unique and inside, a FULL layer covers them all, a DELTA has a parent and a FULL has none."""
    # distinct counts of every layer at once would expand rows; a first pass by index does not
    per_index = entries.groupBy("snapshot_ref", "page_index").agg(F.count("*").alias("n"))
    facts = per_index.groupBy("snapshot_ref").agg(F.sum("n").alias("entry_count"), F.max("n").alias("most"), F.min("page_index").alias("low"), F.max("page_index").alias("high"), F.count("*").alias("indices"))
    all_of = layers.join(facts, "snapshot_ref", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))
    pages = F.col("guest_ram_bytes") / PAGE_SIZE
    error = (
        F.when((F.col("guest_ram_bytes") <= 0) | (F.col("guest_ram_bytes") % PAGE_SIZE != 0), "BadRamSize")
        .when(F.col("most") > 1, "DuplicateIndex")
        .when((F.col("low") < 0) | (F.col("high") >= pages), "IndexOutOfRange")
        .when(F.col("is_delta") & F.col("parent_ref").isNull(), "DeltaWithoutParent")
        .when(~F.col("is_delta") & F.col("parent_ref").isNotNull(), "FullWithParent")
        .when(~F.col("is_delta") & (F.coalesce("indices", F.lit(0)) != pages), "Coverage")
    )
    return all_of.select("snapshot_ref", F.col("entry_count").cast("bigint").alias("entry_count"), error.alias("error"))


def put(candidates: DataFrame, entries: DataFrame, manifests: DataFrame, index: DataFrame) -> DataFrame:
    """Outcome of committing each candidate: EXISTING, UNKNOWN_PARENT, RAM_MISMATCH, MISSING_PAGES (with their number,
    duplicates counted) or INSERTED. The parent must be stored before the batch."""
    known = manifests.select("snapshot_ref", F.lit(True).alias("_known"))
    parent = manifests.select(F.col("snapshot_ref").alias("parent_ref"), F.col("guest_ram_bytes").alias("_parent_ram"))
    lacking = missing_pages(entries, index).groupBy("snapshot_ref").agg(F.count("*").alias("missing"))
    out = candidates.join(known, "snapshot_ref", "left").join(parent, "parent_ref", "left").join(lacking, "snapshot_ref", "left")
    outcome = (
        F.when(F.col("_known"), "EXISTING")
        .when(F.col("parent_ref").isNotNull() & F.col("_parent_ram").isNull(), "UNKNOWN_PARENT")
        .when(F.col("_parent_ram") != F.col("guest_ram_bytes"), "RAM_MISMATCH")
        .when(F.col("missing") > 0, "MISSING_PAGES")
        .otherwise("INSERTED")
    )
    return out.select("snapshot_ref", outcome.alias("outcome"), F.when(outcome == "MISSING_PAGES", F.col("missing")).otherwise(F.lit(0)).cast("bigint").alias("missing"))


def chain(manifests: DataFrame, heads: DataFrame, cap: int = CHAIN_CAP) -> DataFrame:
    """head, snapshot_ref, chain_pos (0: the head) of every layer from each head (column snapshot_ref) to its root."""
    links = manifests.select(F.col("snapshot_ref").alias("id"), F.col("parent_ref").alias("parent"))
    walk = ascend(links, heads.select(F.col("snapshot_ref").alias("start")), cap)
    return walk.select(F.col("start").alias("head"), F.col("id").alias("snapshot_ref"), F.col("distance").alias("chain_pos"))


def flatten(chained: DataFrame, entries: DataFrame) -> DataFrame:
    """head, page_index, page_hash: for each index the entry nearest to the head. A partial minimum for each map task, no
    sort and no window over a head's entries."""
    return chained.join(entries, "snapshot_ref").groupBy("head", "page_index").agg(F.min_by("page_hash", "chain_pos").alias("page_hash"))


def flatten_by_rank(chained: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by a window; for comparison."""
    w = Window.partitionBy("head", "page_index").orderBy("chain_pos")
    return chained.join(entries, "snapshot_ref").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select("head", "page_index", "page_hash")


def flatten_errors(chained: DataFrame, manifests: DataFrame, flat: DataFrame) -> DataFrame:
    """head, error of each head that cannot be resolved in full: UnknownRef, RootNotFull, RamMismatch or Coverage."""
    facts = chained.join(manifests.select("snapshot_ref", "is_delta", "guest_ram_bytes"), "snapshot_ref", "left").groupBy("head").agg(
        F.max_by("is_delta", "chain_pos").alias("root_is_delta"),
        F.min("guest_ram_bytes").alias("low"),
        F.max("guest_ram_bytes").alias("high"),
        F.count_if(F.col("is_delta").isNull()).alias("unknown"),
    )
    held = flat.groupBy("head").agg(F.count("*").alias("n"))
    error = F.when(F.col("unknown") > 0, "UnknownRef").when(F.col("root_is_delta"), "RootNotFull").when(F.col("low") != F.col("high"), "RamMismatch").when(F.coalesce("n", F.lit(0)) != F.col("high") / PAGE_SIZE, "Coverage")
    return facts.join(held, "head", "left").select("head", error.alias("error")).where("error IS NOT NULL")


def resolve_full(manifests: DataFrame, entries: DataFrame, heads: DataFrame) -> DataFrame:
    """The whole page table of each head."""
    return flatten(chain(manifests, heads), entries)


def resolve_delta(manifests: DataFrame, entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: head, baseline. What a holder of the baseline lacks: the entries of the layers above it, nearest to the head
    first; an entry with the baseline's own hash stays. A baseline that is not on the chain gives nothing."""
    chained = chain(manifests, pairs.select(F.col("head").alias("snapshot_ref")))
    at = chained.join(pairs.select("head", F.col("baseline").alias("snapshot_ref")), ["head", "snapshot_ref"]).select("head", "snapshot_ref", F.col("chain_pos").alias("baseline_pos"))
    above = chained.join(at.select("head", F.col("snapshot_ref").alias("baseline"), "baseline_pos"), "head").where("chain_pos < baseline_pos")
    return above.join(entries, "snapshot_ref").groupBy("head", "baseline", "page_index").agg(F.min_by("page_hash", "chain_pos").alias("page_hash"))


def has_manifest(refs: DataFrame, manifests: DataFrame) -> DataFrame:
    return refs.join(manifests.select("snapshot_ref", F.lit(True).alias("present")), "snapshot_ref", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def counters(manifests: DataFrame) -> DataFrame:
    """manifest_count, logical_bytes."""
    return manifests.agg(F.count("*").alias("manifest_count"), F.coalesce(F.sum("guest_ram_bytes"), F.lit(0)).alias("logical_bytes"))
