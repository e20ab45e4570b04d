"""Statistics of a store. Each table is read once; one-row results are put side by side."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..schema import RECORD_SIZE, STATUS
from ..session import materialise


def _row(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), parts)  # of one row each


def global_stats(nodes: DataFrame, pins: DataFrame, tombstones: DataFrame, kv: DataFrame, input_logs: DataFrame) -> DataFrame:
    return _row(
        nodes.agg(F.count("*").alias("nodes_total"), F.countDistinct("experiment_id").alias("experiments")),
        pins.agg(F.count("*").alias("pins")),
        tombstones.agg(F.count("*").alias("tombstones")),
        kv.agg(F.count("*").alias("kv_entries")),
        input_logs.agg(F.count("*").alias("input_logs"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("bigint").alias("input_log_bytes")),
    )


def experiment_stats(nodes: DataFrame, input_logs: DataFrame) -> DataFrame:
    """One row for each experiment. input_log_bytes_global is the sum over the whole table, as the store reports it for an
    experiment; input_log_bytes is that of its own logs."""
    counts = [F.count_if(F.col("status") == code).alias(f"nodes_{name.lower()}") for name, code in STATUS.items()]
    per = nodes.groupBy("experiment_id").agg(*counts, F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.countDistinct("input_log_id").alias("input_logs"))
    sizes = input_logs.select(F.col("log_id").alias("input_log_id"), F.octet_length("content").alias("n")).dropDuplicates(["input_log_id"])
    own = nodes.select("experiment_id", "input_log_id").distinct().join(sizes, "input_log_id").groupBy("experiment_id").agg(F.sum("n").cast("bigint").alias("input_log_bytes"))
    total = input_logs.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("bigint").alias("input_log_bytes_global"))
    return per.join(own, "experiment_id", "left").withColumn("input_log_bytes", F.coalesce("input_log_bytes", F.lit(0))).crossJoin(total)


def dedup_ratio(manifests: DataFrame, index: DataFrame) -> DataFrame:
    """logical_bytes, physical_bytes, dedup_ratio (0 for an empty store)."""
    both = _row(manifests.agg(F.coalesce(F.sum("guest_ram_bytes"), F.lit(0)).alias("logical_bytes")), index.agg((F.count("*") * RECORD_SIZE).alias("physical_bytes")))
    return both.withColumn("dedup_ratio", F.when(F.col("physical_bytes") > 0, F.round(F.col("logical_bytes") / F.col("physical_bytes"), 6)).otherwise(F.lit(0.0)))


def next_counter(persisted: int, *tables: DataFrame) -> DataFrame:
    """The logical counter after a restart: beyond the persisted one and every stamp, saturating."""
    maxima = [t.agg(F.greatest(*[F.coalesce(F.max(c), F.lit(0)) for c in ("created_at", "updated_at") if c in t.columns], F.lit(0)).alias(f"m{k}")) for k, t in enumerate(tables)]
    top = F.greatest(F.lit(persisted), *[F.col(f"m{k}") for k in range(len(tables))])
    return _row(*maxima).select(F.when(top >= 2**63 - 1, F.lit(2**63 - 1)).otherwise(top + 1).cast("bigint").alias("next_counter"))


def percentiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at each rank ceil(p n) of the sorted column (discrete percentiles; nulls do not count). Equal values are
    counted first; the counts lie in ranges of values, and only the range that holds a rank is ordered by a task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    # a table of its own, as bounds of ranges come from samples and may differ when they are made again
    counts = materialise(counts.repartitionByRange("_value").withColumn("_part", F.spark_partition_id()), "counts")
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect()  # a row for each partition
    total, found = sum(r["n"] for r in parts), []
    for p in at:
        rank, before = max(1, ceil(Decimal(str(p)) * total)), 0
        for r in parts:
            if before + r["n"] >= rank:
                w = Window.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
                inside = counts.where(F.col("_part") == r["_part"]).withColumn("_upto", F.sum("_n").over(w))
                found.append(inside.where(F.col("_upto") >= rank - before).agg(F.min("_value").alias(f"p{round(p * 100)}")))
                break
            before += r["n"]
        else:
            found.append(counts.agg(F.min("_value").alias(f"p{round(p * 100)}")))  # no rows: null
    return _row(*found)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with counters that are known once it has been written: rows, and bytes of a payload column if it has one."""
    seen = Observation(name)
    metrics = [F.count("*").alias("rows")]
    if "payload" in df.columns:
        metrics.append(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("payload_bytes"))
    return df.observe(seen, *metrics), seen
