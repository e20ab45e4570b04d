"""Exploration trees: reads.

Every read is scoped to an experiment. Predicates are plain conjunctions, so Catalyst pushes them to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import QUERY_CAP, QUERY_DEFAULT
from .closure import ascend, descend

ORDERS = ("created_at", "updated_at", "node_id")


def get_node(nodes: DataFrame, experiment: str, node_id: int) -> DataFrame:
    return nodes.where((F.col("experiment_id") == experiment) & (F.col("node_id") == node_id))


def get_children(nodes: DataFrame, experiment: str, node_id: int) -> DataFrame:
    return nodes.where((F.col("experiment_id") == experiment) & (F.col("parent_node_id") == node_id)).orderBy("node_id")


def matching(nodes: DataFrame, experiment: str, *, status: int | None = None, parent: int | None = None, min_depth: int | None = None, max_depth: int | None = None, created_after: int | None = None, updated_after: int | None = None) -> DataFrame:
    """All nodes of an experiment with the given properties; the bounds of the counters are exclusive."""
    checks = [
        F.col("experiment_id") == experiment,
        *([F.col("status") == status] if status is not None else []),
        *([F.col("parent_node_id") == parent] if parent is not None else []),
        *([F.col("depth") >= min_depth] if min_depth is not None else []),
        *([F.col("depth") <= max_depth] if max_depth is not None else []),
        *([F.col("created_at") > created_after] if created_after is not None else []),
        *([F.col("updated_at") > updated_after] if updated_after is not None else []),
    ]
    return nodes.where(reduce(lambda a, b: a & b, checks))


def effective_limit(limit: int | None) -> int:
    """512 if unset or 0, and never more than 4096."""
    return min(limit or QUERY_DEFAULT, QUERY_CAP)


def query_nodes(nodes: DataFrame, experiment: str, *, order: str = "created_at", limit: int | None = None, **filters: int | None) -> DataFrame:
    """The first rows by an order; ties of a counter come by node id."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    return matching(nodes, experiment, **filters).orderBy(*dict.fromkeys([order, "node_id"])).limit(effective_limit(limit))


def stream_nodes(nodes: DataFrame, experiment: str, *, order: str = "created_at", **filters: int | None) -> DataFrame:
    """All rows, in order; the limit of a query does not hold here. Read with toLocalIterator()."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    return matching(nodes, experiment, **filters).orderBy(*dict.fromkeys([order, "node_id"]))


def page_after(nodes: DataFrame, experiment: str, order: str, cursor: tuple[int, int] | None, size: int, **filters: int | None) -> DataFrame:
    """Keyset paging: the next rows after (counter, node id). Rows with equal counters are never skipped."""
    found = matching(nodes, experiment, **filters)
    if cursor is not None:
        value, node = cursor
        found = found.where((F.col(order) > value) | ((F.col(order) == value) & (F.col("node_id") > node)))
    return found.orderBy(order, "node_id").limit(size)


def get_path(nodes: DataFrame, starts: DataFrame, cap: int | None = None) -> DataFrame:
    """starts: experiment_id, node_id. The nodes from the root to each start, with start (its id); none for an unknown
    start. Order by depth to have the root first."""
    key = F.struct("experiment_id", "node_id")
    links = nodes.select(key.alias("id"), F.when(F.col("parent_node_id").isNotNull(), F.struct("experiment_id", F.col("parent_node_id").alias("node_id"))).alias("parent"))
    walk = ascend(links, starts.select(key.alias("start")), cap).select(F.col("start.node_id").alias("start"), F.col("id.experiment_id").alias("experiment_id"), F.col("id.node_id").alias("node_id"))
    return nodes.join(walk, ["experiment_id", "node_id"])


def with_logs(path: DataFrame, input_logs: DataFrame) -> DataFrame:
    """The path with the content of each node's input log, null without one."""
    return path.join(input_logs.select(F.col("log_id").alias("input_log_id"), F.col("content").alias("log_content")).dropDuplicates(["input_log_id"]), "input_log_id", "left")


def subtree(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """experiment_id, node_id, root, level of each start (experiment_id, node_id) and all below it."""
    known = starts.join(nodes.select("experiment_id", "node_id"), ["experiment_id", "node_id"], "left_semi")
    return descend(nodes.select("experiment_id", "node_id", F.col("parent_node_id").alias("parent")), known, ["experiment_id", "node_id"])


def list_experiments(nodes: DataFrame) -> DataFrame:
    return nodes.select("experiment_id").distinct().orderBy("experiment_id")


def list_pins(pins: DataFrame) -> DataFrame:
    return pins.orderBy("created_at")


def list_tombstones(tombstones: DataFrame, horizon: int) -> DataFrame:
    return tombstones.where(F.col("created_at") <= min(horizon, 2**63 - 1)).orderBy("created_at")


def changes_since(nodes: DataFrame, counter: int) -> DataFrame:
    """The change feed: rows stamped after a counter."""
    return nodes.where(F.col("updated_at") > counter)
