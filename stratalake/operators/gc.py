"""Garbage collection: reachability from roots, sweep plans of packs and manifests, and the cycle over one generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHAIN_CAP, PACK_HEADER, RECORD_SIZE
from ..session import discard, materialise
from .closure import ChainDepthExceeded
from .mutations import orphan_logs, reap


@dataclass(frozen=True)
class GcOptions:
    threshold: float = 0.5  #: a sealed pack with a smaller share of live pages is compacted
    rotate: bool = False  #: seal the active pack first, so that it can be swept
    grace: int = 1  #: 0: reap every tombstone; else those not newer than the last cycle's fence

    @staticmethod
    def aggressive() -> GcOptions:
        return GcOptions(threshold=0.9, rotate=True)


class MissingManifest(ValueError):
    """A manifest below a root is not stored: the store is damaged, and nothing may be swept."""


def due_tombstones(tombstones: DataFrame, options: GcOptions, last_fence: int) -> DataFrame:
    return tombstones if options.grace == 0 else tombstones.where(F.col("created_at") <= last_fence)


def roots(nodes: DataFrame, pins: DataFrame) -> DataFrame:
    """References of all nodes, whatever their status, and of pins."""
    return nodes.select("snapshot_ref").union(pins.select("snapshot_ref")).distinct()


def mark(manifests: DataFrame, root_refs: DataFrame, cap: int = CHAIN_CAP) -> tuple[DataFrame, DataFrame]:
    """Reachable manifests (snapshot_ref), and roots that are not stored. A chain shared by many roots is walked once: after
    each round only new references go on."""
    stored = manifests.select("snapshot_ref")
    known = root_refs.join(stored, "snapshot_ref", "left_semi")
    missing = root_refs.join(stored, "snapshot_ref", "left_anti")
    links = manifests.select(F.col("snapshot_ref").alias("id"), F.col("parent_ref").alias("parent"))
    live = ascend_set(links, known.select(F.col("snapshot_ref").alias("start")), cap)
    if not live.join(stored, live["id"] == stored["snapshot_ref"], "left_anti").isEmpty():
        raise MissingManifest("a reachable manifest is not stored")
    return live.select(F.col("id").alias("snapshot_ref")), missing


def ascend_set(links: DataFrame, starts: DataFrame, cap: int = CHAIN_CAP) -> DataFrame:
    """All ids on the walks from starts, each once. Jump pointers double; a set has at most as many rows as links."""
    jump = links.where("parent IS NOT NULL").select("id", F.col("parent").alias("to"))
    found, step = starts.select(F.col("start").alias("id")).distinct(), 1
    while True:
        old = jump
        if step > 1:
            jump = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to")
        jump = materialise(jump, "jump")
        discard(old)
        if jump.isEmpty():
            return found
        if step >= cap:
            if not found.join(jump, "id", "left_semi").isEmpty():
                raise ChainDepthExceeded(f"more than {cap} links")
            return found
        fewer, found = found, materialise(found.unionByName(found.join(jump, "id").select(F.col("to").alias("id"))).distinct(), "marked")
        discard(fewer)
        step *= 2


def live_pages(live: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages of all entries of reachable manifests; one that a nearer layer shadows is live too."""
    return entries.join(live, "snapshot_ref", "left_semi").select("page_hash").distinct()


def pack_liveness(index: DataFrame, live: DataFrame) -> DataFrame:
    """pack_id, total, live_count, liveness (0 for a pack without entries)."""
    flagged = index.join(live.withColumn("_live", F.lit(1)), "page_hash", "left")
    counts = flagged.groupBy("pack_id").agg(F.count("*").alias("total"), F.count("_live").alias("live_count"))
    return counts.withColumn("liveness", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("live_count") / F.col("total")))


def sweep_plan(liveness: DataFrame, fence_pack: int, threshold: float) -> DataFrame:
    """What to do with each sealed pack: DELETE (nothing live), KEEP or COMPACT. Packs from the fence on are not swept."""
    action = F.when(F.col("live_count") == 0, "DELETE").when(F.col("liveness") >= threshold, "KEEP").otherwise("COMPACT")
    return liveness.where(F.col("pack_id") < fence_pack).withColumn("action", action)


def sweep_report(plan: DataFrame) -> DataFrame:
    """Totals of a plan: packs deleted and compacted, pages copied and reclaimed, bytes reclaimed."""
    gone = F.col("action") != "KEEP"
    copied = F.when(F.col("action") == "COMPACT", F.col("live_count")).otherwise(0)
    freed = F.when(gone, F.col("total") - copied).otherwise(0)
    zero = F.lit(0)
    return plan.agg(
        F.count_if(F.col("action") == "DELETE").alias("packs_deleted"),
        F.count_if(F.col("action") == "COMPACT").alias("packs_compacted"),
        F.coalesce(F.sum(copied), zero).cast("bigint").alias("pages_copied"),
        F.coalesce(F.sum(freed), zero).cast("bigint").alias("pages_reclaimed"),
        F.coalesce(F.sum(freed * RECORD_SIZE), zero).cast("bigint").alias("bytes_reclaimed"),
    )


def dead_manifests(manifests: DataFrame, live: DataFrame) -> DataFrame:
    return manifests.select("snapshot_ref").join(live, "snapshot_ref", "left_anti")


def swept_index(index: DataFrame, plan: DataFrame, live: DataFrame, new_pack: int) -> DataFrame:
    """The index afterwards: deleted packs are gone, live pages of compacted packs are in new packs (one for each old one,
    numbered from new_pack in the old order), other entries stay, dead ones of kept packs too."""
    acts = plan.where("action != 'KEEP'").select("pack_id", "action")
    stay = index.join(acts, "pack_id", "left_anti")
    number = F.row_number().over(Window.orderBy("pack_id")) - 1 + new_pack  # a row for each compacted pack
    moved_to = acts.where("action = 'COMPACT'").select("pack_id", number.cast("int").alias("_new"))
    moved = index.join(moved_to, "pack_id").join(live, "page_hash", "left_semi")
    rank = F.row_number().over(Window.partitionBy("_new").orderBy("offset")) - 1
    moved = moved.withColumn("_at", PACK_HEADER + RECORD_SIZE * rank)
    return stay.unionByName(moved.select("page_hash", F.col("_new").alias("pack_id"), F.col("_at").cast("bigint").alias("offset")).select(*stay.columns))


@dataclass
class GcResult:
    """Tables after a cycle, and what it did."""

    nodes: DataFrame
    tombstones: DataFrame
    input_logs: DataFrame
    manifests: DataFrame
    entries: DataFrame
    index: DataFrame
    report: DataFrame


def cycle(tables: dict[str, DataFrame], options: GcOptions, last_fence: int, fence_pack: int, next_pack: int) -> GcResult:
    """One cycle over one generation: reap, mark, sweep packs, sweep manifests. tables: nodes, tombstones, input_logs, pins,
    manifests, manifest_entries, page_index. Nothing is changed in place, so readers of the generation see none of it."""
    due = due_tombstones(tables["tombstones"], options, last_fence)
    nodes, tombstones, reaped = reap(tables["nodes"], tables["tombstones"], due)
    logs = tables["input_logs"].join(orphan_logs(tables["input_logs"], nodes).select("log_id"), "log_id", "left_anti")
    live, missing = mark(tables["manifests"], roots(nodes, tables["pins"]))
    pages = live_pages(live, tables["manifest_entries"])
    fence = next_pack if options.rotate else fence_pack
    plan = sweep_plan(pack_liveness(tables["page_index"], pages), fence, options.threshold)
    counts = reaped.agg(F.coalesce(F.sum("reaped"), F.lit(0)).alias("nodes_reaped")).crossJoin(missing.agg(F.count("*").alias("missing_roots"))).crossJoin(dead_manifests(tables["manifests"], live).agg(F.count("*").alias("manifests_deleted")))
    return GcResult(
        nodes,
        tombstones,
        logs,
        tables["manifests"].join(live, "snapshot_ref", "left_semi"),
        tables["manifest_entries"].join(live, "snapshot_ref", "left_semi"),
        swept_index(tables["page_index"], plan, pages, next_pack),
        sweep_report(plan).crossJoin(counts),
    )

