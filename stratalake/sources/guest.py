"""A synthetic guest: deterministic pages for tests and benchmarks, made by built-in functions from a seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAGE_SIZE


@dataclass(frozen=True)
class Profile:
    pages: int
    zero: float
    text: float
    dirty: float


#: Shares of all-zero and text-like pages, and of pages that an epoch changes.
PROFILES = {"idle_linux": Profile(262_144, 0.4, 0.4, 0.05), "busy_workload": Profile(262_144, 0.1, 0.3, 0.2), "all_unique": Profile(262_144, 0.0, 0.0, 1.0)}


def pages(spark: SparkSession, profile: Profile, seed: int = 1, epoch: int = 0) -> DataFrame:
    """page_index, payload (4096 bytes) of a guest after so many epochs; an epoch makes a share of the pages random."""
    share = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1_000_000)) / 1_000_000
    df = spark.range(profile.pages).withColumnRenamed("id", "page_index")
    roll = share("page_index", F.lit(seed), F.lit("kind"))
    last = F.lit(0)
    for e in range(1, epoch + 1):
        last = F.when(share("page_index", F.lit(seed), F.lit(e)) < profile.dirty, F.lit(e)).otherwise(last)
    words = F.transform(F.sequence(F.lit(0), F.lit(PAGE_SIZE // 32 - 1)), lambda i: F.sha2(F.concat_ws(":", "page_index", F.lit(seed), last, i), 256))
    random = F.unhex(F.array_join(words, ""))
    letter = F.pmod(F.xxhash64("page_index", F.lit(seed)), F.lit(26)) + 97
    line = F.concat(F.repeat(F.chr(letter), 63), F.lit("\n"))
    text = F.repeat(line, PAGE_SIZE // 64).cast("binary")
    payload = F.when(last > 0, random).when(roll < profile.zero, F.repeat(F.lit("\x00"), PAGE_SIZE).cast("binary")).when(roll < profile.zero + profile.text, text).otherwise(random)
    return df.select("page_index", payload.alias("payload"))
