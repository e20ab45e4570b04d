"""Streams: page ingest in micro-batches, exact deduplication, key-value commands.

The store itself has no event time; these are its batch operators over Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import pages
from ..sources.catalog import Catalog


def distinct_pages(stream: DataFrame) -> DataFrame:
    """The first arrival of each page; the state holds the hashes alone."""
    return stream.dropDuplicates(["page_hash"])


def distinct_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The same with bounded state: repeats that come later than the delay count as new."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["page_hash"])


def ingest_into(catalog: Catalog, pages_per_pack: int = 259_000):
    """A foreachBatch function: each micro-batch (ordinal, page_hash, payload) becomes a generation. A batch that is run
    again after a failure finds its pages stored, and its number in meta, and adds nothing."""

    def batch(df: DataFrame, number: int) -> None:
        base = catalog.snapshot()
        if base.meta.get("last_batch", -1) >= number:
            return
        index = base.table("page_index")
        df = df.persist()
        try:
            outcomes = pages.ingest(df.select("ordinal", "page_hash"), index)
            top = index.agg(F.max("pack_id")).first()[0]
            new = pages.stored(outcomes, 0 if top is None else top + 1, pages_per_pack)
            payload = df.dropDuplicates(["page_hash"]).select("page_hash", "payload")
            stored = base.table("pages").unionByName(new.join(payload, "page_hash"))
            catalog.commit(base, {"page_index": index.unionByName(new), "pages": stored}, last_batch=number)
        finally:
            df.unpersist()

    return batch


def kv_state(stream: DataFrame) -> DataFrame:
    """Commands (key, op, value, expected, ordinal) folded by key with the generation as state; outcomes as they come."""
    out = "key string, ordinal long, outcome string, generation long"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(frames)).sort_values("ordinal").itertuples(index=False):
            want = None if pd.isna(r.expected) else int(r.expected)
            if r.op == "put":
                if want is not None and want != (generation or 0):
                    outcome = "CONFLICT"
                else:
                    generation, outcome = (generation or 0) + 1, "STORED"
            elif generation is None:
                outcome = "ABSENT"
            elif want is not None and want != generation:
                outcome = "CONFLICT"
            else:
                generation, outcome = None, "DELETED"
            rows.append((key[0], r.ordinal, outcome, generation))
        state.update((generation,))
        yield pd.DataFrame(rows, columns=["key", "ordinal", "outcome", "generation"]).astype({"generation": "Int64"})

    return stream.groupBy("key").applyInPandasWithState(fold, out, "generation long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str = "ts", delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """New and repeated pages by window of event time, with late rows up to the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("pages"), F.approx_count_distinct("page_hash").alias("distinct_pages"))
