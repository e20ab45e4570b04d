"""Batches of writes on trees, logs, pins and key-value metadata.

A batch is a DataFrame with an ordinal for each command; nothing is applied in place: each operator gives outcomes, or
the table as it is afterwards. Counters are base + ordinal, so a failing command uses one up as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LOG_MAX, LOG_MIN, PRUNED, VALUE_MAX
from ..session import materialise
from .tree import subtree

KEY = ["experiment_id", "node_id"]


class MissingNodes(ValueError):
    """An update names nodes that do not exist; none of the batch is applied."""


def create_outcomes(nodes: DataFrame, creates: DataFrame, logs: DataFrame) -> DataFrame:
    """creates: ordinal, experiment_id, node_id, parent_node_id?, snapshot_ref, input_log_id?. Parents must be stored before the
    batch; of equal keys in a batch the first counts as stored for the others. The parent is checked before the key, so a
    repeated create fails once its parent is pruned. Outcomes: INVALID, PARENT_NOT_FOUND, PARENT_PRUNED, LOG_NOT_FOUND,
    EXISTING (same parent, snapshot and log), ALREADY_EXISTS, INSERTED."""
    parent = nodes.select("experiment_id", F.col("node_id").alias("parent_node_id"), F.col("status").alias("_parent_status"), F.col("depth").alias("_parent_depth"))
    stored = nodes.select(*KEY, F.struct("parent_node_id", "snapshot_ref", "input_log_id").alias("_stored"))
    # a table of its own, so that adaptive execution can split the join at a log of many creates; those without one are dealt out
    known = materialise(logs.where("log_id IS NOT NULL").select(F.col("log_id").alias("input_log_id"), F.lit(0).cast("bigint").alias("_salt")).distinct(), "known-logs").withColumn("_log", F.lit(True))
    both = creates.join(parent, ["experiment_id", "parent_node_id"], "left").join(stored, KEY, "left")
    both = both.withColumn("_salt", F.when(F.col("input_log_id").isNull(), F.xxhash64(*KEY, "ordinal")).otherwise(0)).join(known, ["input_log_id", "_salt"], "left")
    own = F.struct("parent_node_id", "snapshot_ref", "input_log_id")
    fine = (
        F.when(~F.octet_length("experiment_id").between(1, 128) | F.col("snapshot_ref").isNull(), "INVALID")
        .when(F.col("parent_node_id").isNotNull() & F.col("_parent_status").isNull(), "PARENT_NOT_FOUND")
        .when(F.col("_parent_status") == PRUNED, "PARENT_PRUNED")
        .when(F.col("input_log_id").isNotNull() & F.col("_log").isNull(), "LOG_NOT_FOUND")
    )
    both = both.withColumn("_fault", fine)
    w = Window.partitionBy(*KEY, F.col("_fault").isNull()).orderBy("ordinal")
    before = F.coalesce("_stored", F.when(F.row_number().over(w) > 1, F.first(own).over(w)))
    both = both.withColumn("_before", before)
    outcome = F.when(F.col("_fault").isNotNull(), F.col("_fault")).when(F.col("_before").isNull(), "INSERTED").when(F.col("_before").eqNullSafe(own), "EXISTING").otherwise("ALREADY_EXISTS")
    return both.select("ordinal", *KEY, outcome.alias("outcome"), (F.coalesce("_parent_depth", F.lit(-1)) + 1).cast("int").alias("depth"))


def apply_creates(nodes: DataFrame, creates: DataFrame, outcomes: DataFrame, counter: int) -> DataFrame:
    """nodes and the inserted rows, stamped counter + ordinal. Columns of nodes that creates lacks are null or 0."""
    new = creates.join(outcomes.where("outcome = 'INSERTED'").select("ordinal", *KEY, F.col("depth").alias("_depth")), ["ordinal", *KEY])
    stamp = (F.lit(counter) + F.col("ordinal")).cast("bigint")
    given = {"depth": F.col("_depth"), "created_at": stamp, "updated_at": stamp}
    zero = {"status", "visit_count", "icount", "virtual_ns", "last_visited_at"}
    cols = [(given[f.name] if f.name in given else F.col(f.name) if f.name in creates.columns else F.lit(0 if f.name in zero else None)).cast(f.dataType).alias(f.name) for f in nodes.schema]
    return nodes.unionByName(new.select(*cols))


def missing_nodes(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Keys of updates that no node has; all of them."""
    return updates.select(*KEY).distinct().join(nodes.select(*KEY), KEY, "left_anti")


def apply_updates(nodes: DataFrame, updates: DataFrame, counter: int, checked: bool = False) -> DataFrame:
    """updates: ordinal, key, and any of status, score, icount, virtual_ns, attrs, last_visited_at (null: unchanged) and visit_delta. All rows
    get one stamp. Of several updates of a node the last value that is not null counts, and deltas add up. If a key is
    missing nothing is applied: MissingNodes, unless the caller has checked."""
    if not checked and not missing_nodes(nodes, updates).isEmpty():
        raise MissingNodes("update of nodes that do not exist")
    values = [c for c in ("status", "score", "icount", "virtual_ns", "attrs", "last_visited_at") if c in updates.columns and c in nodes.columns]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(f"_{c}") for c in values]
    delta = F.sum("visit_delta") if "visit_delta" in updates.columns else F.lit(None).cast("bigint")
    folded = updates.groupBy(*KEY).agg(*last, delta.alias("_delta"), F.lit(True).alias("_hit"))
    both = nodes.join(folded, KEY, "left")
    new = {c: F.coalesce(f"_{c}", c) for c in values}
    new["visit_count"] = F.col("visit_count") + F.coalesce("_delta", F.lit(0))
    new["updated_at"] = F.when(F.col("_hit"), F.lit(counter)).otherwise(F.col("updated_at"))
    return both.select(*[new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in nodes.schema])


def prune(nodes: DataFrame, tombstones: DataFrame, starts: DataFrame, counter: int, allow_root: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """starts: key. The nodes and tombstones afterwards, and outcomes: key, outcome (PRUNED, NOT_FOUND, ROOT_DENIED), pruned
    (rows of the subtree; those pruned before count and are stamped again)."""
    there = starts.select(*KEY).distinct().join(nodes.select(*KEY, "parent_node_id", F.lit(True).alias("_there")), KEY, "left")
    outcome = F.when(F.col("_there").isNull(), "NOT_FOUND").when(F.col("parent_node_id").isNull() & F.lit(not allow_root), "ROOT_DENIED").otherwise("PRUNED")
    asked = there.select(*KEY, outcome.alias("outcome"))
    below = subtree(nodes, asked.where("outcome = 'PRUNED'"))
    sizes = below.groupBy("experiment_id", F.col("root").alias("node_id")).agg(F.count("*").alias("pruned"))
    outcomes = asked.join(sizes, KEY, "left").withColumn("pruned", F.coalesce("pruned", F.lit(0)))
    hit = below.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    both = nodes.join(hit, KEY, "left")
    changed = {"status": F.when(F.col("_hit"), F.lit(PRUNED)).otherwise(F.col("status")), "updated_at": F.when(F.col("_hit"), F.lit(counter)).otherwise(F.col("updated_at"))}
    after = both.select(*[changed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    marks = outcomes.where("outcome = 'PRUNED'").select(*KEY, F.lit(counter).cast("bigint").alias("created_at")).join(tombstones.select(*KEY), KEY, "left_anti")
    return after, tombstones.unionByName(marks), outcomes


def reap(nodes: DataFrame, tombstones: DataFrame, due: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """due: key of tombstones. The nodes and tombstones afterwards, and outcomes: key, outcome (REAPED, GONE if the root row
    is no more, REFUSED if a row below is not pruned), reaped. The tombstone of a root that is gone is removed as well."""
    below = subtree(nodes, due)
    states = below.join(nodes.select(*KEY, "status"), KEY).groupBy("experiment_id", F.col("root").alias("node_id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") != PRUNED).alias("alive"))
    outcomes = due.select(*KEY).distinct().join(states, KEY, "left")
    outcomes = outcomes.select(*KEY, F.when(F.col("n").isNull(), "GONE").when(F.col("alive") > 0, "REFUSED").otherwise("REAPED").alias("outcome"), F.when(F.col("alive") == 0, F.col("n")).otherwise(F.lit(0)).alias("reaped"))
    roots = outcomes.where("outcome = 'REAPED'").select("experiment_id", F.col("node_id").alias("root"))
    gone = below.join(roots, ["experiment_id", "root"], "left_semi").select(*KEY).distinct()
    return nodes.join(gone, KEY, "left_anti"), tombstones.join(outcomes.where("outcome != 'REFUSED'").select(*KEY), KEY, "left_anti"), outcomes


def orphan_logs(logs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Logs that no node of any experiment refers to; reaping deletes them, with those not attached yet."""
    used = nodes.where("input_log_id IS NOT NULL").select(F.col("input_log_id").alias("log_id"))
    return logs.join(used, "log_id", "left_anti")


def put_logs(logs: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming: ordinal, log_id, content, digest (hash of the content's body). outcome: INVALID_SIZE, HASH_MISMATCH, or newly stored
    or not. The first of equal ids in a batch counts."""
    known = logs.select("log_id").distinct().withColumn("_known", F.lit(True))
    n = F.octet_length("content")
    fault = F.when(~n.between(LOG_MIN, LOG_MAX), "INVALID_SIZE").when(F.col("digest") != F.col("log_id"), "HASH_MISMATCH")
    both = incoming.withColumn("_fault", fault).join(known, "log_id", "left")
    rank = F.row_number().over(Window.partitionBy("log_id", F.col("_fault").isNull()).orderBy("ordinal"))
    both = both.withColumn("_rank", rank)
    outcome = F.when(F.col("_fault").isNotNull(), F.col("_fault")).when(F.col("_known") | (F.col("_rank") > 1), "EXISTING").otherwise("STORED")
    return both.select("ordinal", "log_id", outcome.alias("outcome"))


def pin(pins: DataFrame, asked: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """asked: ordinal, snapshot_ref, note, created_at. outcome: UNKNOWN_REF (with manifests), EXISTING (its note stays) or PINNED."""
    both = asked.join(pins.select("snapshot_ref", F.lit(True).alias("_pinned")), "snapshot_ref", "left")
    fault = F.lit(None).cast("string")
    if manifests is not None:
        both = both.join(manifests.select("snapshot_ref", F.lit(True).alias("_there")).distinct(), "snapshot_ref", "left")
        fault = F.when(F.col("_there").isNull(), "UNKNOWN_REF")
    rank = F.row_number().over(Window.partitionBy("snapshot_ref").orderBy("ordinal"))
    both = both.withColumn("_rank", rank)
    outcome = F.coalesce(fault, F.when(F.col("_pinned") | (F.col("_rank") > 1), "EXISTING").otherwise("PINNED"))
    return both.select("ordinal", "snapshot_ref", "note", "created_at", outcome.alias("outcome"))


def apply_pins(pins: DataFrame, outcomes: DataFrame) -> DataFrame:
    return pins.unionByName(outcomes.where("outcome = 'PINNED'").select(*pins.columns))


def unpin(pins: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pins afterwards, and snapshot_ref, removed of each asked one."""
    asked = refs.select("snapshot_ref").distinct()
    removed = asked.join(pins.select("snapshot_ref", F.lit(True).alias("removed")), "snapshot_ref", "left").withColumn("removed", F.coalesce("removed", F.lit(False)))
    return pins.join(asked, "snapshot_ref", "left_anti"), removed


def kv_put(kv: DataFrame, puts: DataFrame) -> DataFrame:
    """puts, at most one for each key: key, value, expected (null: unconditional; 0: create only; n: replace generation n).
    outcome: INVALID, CONFLICT or STORED, with the key's generation afterwards (null: none)."""
    both = puts.join(kv.select("key", F.col("generation").alias("_generation")), "key", "left")
    n = F.octet_length("key")
    now, expected = F.coalesce("_generation", F.lit(0)), F.col("expected")
    outcome = F.when(~n.between(1, 512) | (F.octet_length("value") > VALUE_MAX), "INVALID").when(expected.isNotNull() & (expected != now), "CONFLICT").otherwise("STORED")
    return both.select("key", "value", outcome.alias("outcome"), F.when(outcome == "STORED", now + 1).otherwise(F.col("_generation")).cast("bigint").alias("generation"))


def kv_fold(kv: DataFrame, commands: DataFrame) -> DataFrame:
    """Any number of commands for each key, in order: ordinal, key, op (put or delete), value, expected (as in kv_put; a delete
    with another generation is a conflict). Returns the state after each: ordinal, key, outcome, generation (null: no such
    key), value. A key's commands depend on each other, so they are folded together; keys are dealt by hash."""
    start = kv.select("key", F.lit(-1).cast("bigint").alias("ordinal"), F.lit("state").alias("op"), "value", F.col("generation").alias("expected"))
    asked = commands.select("key", F.col("ordinal").cast("bigint").alias("ordinal"), "op", "value", F.col("expected").cast("bigint").alias("expected"))
    kind = dict(kv.dtypes)["value"]

    # The fold needs one pass over a key's commands in order, not the whole key in memory: sorted within partitions.
    rows = start.join(asked.select("key").distinct(), "key", "left_semi").unionByName(asked).repartition("key").sortWithinPartitions("key", "ordinal")

    def fold(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, generation, value = object(), None, None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.key != key:
                    key, generation, value = r.key, None, None
                want = None if pd.isna(r.expected) else int(r.expected)
                if r.op == "state":
                    generation, value = want, r.value
                    continue
                if r.op == "put":
                    if want is not None and want != (generation or 0):
                        outcome = "CONFLICT"
                    else:
                        generation, value, outcome = (generation or 0) + 1, r.value, "STORED"
                elif generation is None:
                    outcome = "ABSENT"
                elif want is not None and want != generation:
                    outcome = "CONFLICT"
                else:
                    generation, value, outcome = None, None, "DELETED"
                out.append((r.ordinal, r.key, outcome, generation, value))
            table = pd.DataFrame(out, columns=["ordinal", "key", "outcome", "generation", "value"])
            yield table.astype({"generation": "Int64"})

    return rows.mapInPandas(fold, f"ordinal bigint, key {dict(kv.dtypes)['key']}, outcome string, generation bigint, value {kind}")


def kv_delete(kv: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """deletes, at most one for each key: key, expected (null: any). The table afterwards, and key, outcome: ABSENT (even
    with an expected generation), CONFLICT or DELETED."""
    both = deletes.join(kv.select("key", F.col("generation").alias("_generation")), "key", "left")
    outcome = F.when(F.col("_generation").isNull(), "ABSENT").when(F.col("expected").isNotNull() & (F.col("expected") != F.col("_generation")), "CONFLICT").otherwise("DELETED")
    outcomes = both.select("key", outcome.alias("outcome"))
    return kv.join(outcomes.where("outcome = 'DELETED'").select("key"), "key", "left_anti"), outcomes


def set_gc_state(state: DataFrame, **values: int) -> DataFrame:
    return state.select(*[(F.lit(values[f.name]).cast(f.dataType) if f.name in values else F.col(f.name)).alias(f.name) for f in state.schema])
