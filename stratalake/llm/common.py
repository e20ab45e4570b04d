"""Helpers shared by the training-data operators.

Every operator selects the columns it needs and renames them first, so extra columns of the input,
whatever their names, never reach it. Texts are processed whole, in slices of bounded size.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise, remove, scratch, shared_dir

__all__ = ["SLICE_CHARS", "WordHash", "bounded", "discard", "held_out", "labelled_sample", "materialise", "prepare", "remove", "scratch", "segments", "shared_dir", "slices", "texts_of", "trim", "word_lists", "words_of"]

WORD = re.compile(r"\w+")
NO_WORD = re.compile(r"\W")
#: Characters of text that a Python worker turns into arrays at once; a longer text makes a slice alone.
SLICE_CHARS = 4 << 20


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch where the session has no bound of its own; a longer row is a batch alone.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes. The setting is read when a plan runs, so it stays; one that the session has is
    left alone."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def trim() -> None:
    """Hand freed memory back to the system; the allocators of Python and Arrow keep what a fit has used, and a driver has
    little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo modulus, is remainder. A null id counts as the text of no characters."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def bounded(rows: DataFrame, keys: list[str], size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The first different rows by keys (a total order that starts with a hash) with at most so many rows and bytes.

    Only keys and sizes are ordered, and at most most_rows of them reach the driver; rows with equal keys are one row.
    The cut is made at a whole first key, so that the result is the same however the rows are dealt."""
    light = rows.select(*keys, F.col(size).alias("_size")).distinct().orderBy(*keys).limit(most_rows + 1).collect()
    used, cut = 0, len(light)
    for k, r in enumerate(light):
        used += r["_size"]
        if used > most_bytes or k >= most_rows:
            cut = k
            break
    if cut < len(light):
        while cut and light[cut - 1][keys[0]] == light[cut][keys[0]]:
            cut -= 1
    if not cut:
        return rows.where("false")
    return rows.where(F.col(keys[0]) <= light[cut - 1][keys[0]]).dropDuplicates(keys)


def labelled_sample(documents: DataFrame, labels: DataFrame, usable: Column, label: str, most_rows: int, most_bytes: int, seed: int) -> list[tuple[str, int]]:
    """(text, label) of at most so many different rows of documents whose doc_id has a label 0 or 1 and is usable."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(usable & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    told = told.withColumn("place", F.xxhash64("doc_id", F.lit(seed))).withColumn("_one", F.lit(1))
    told = bounded(told, ["place", "doc_id", "y"], "_one", most_rows, most_rows).select("doc_id", "y", "place")  # at most most_rows, thus broadcast
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(told), "doc_id").withColumn("own", F.xxhash64("text")).withColumn("bytes", F.octet_length("text").cast("long"))
    # the hash of id and text is the first key, so that a hot id is cut too
    rows = rows.withColumn("place", F.xxhash64("place", "own"))
    got = bounded(rows, ["place", "doc_id", "own", "y"], "bytes", most_rows, most_bytes).select("place", "doc_id", "y", "text").toArrow().to_pydict()
    return [(t, y) for _, _, y, t in sorted(zip(got["place"], got["doc_id"], got["y"], got["text"], strict=True))]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so much text each, at least a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + chars, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class WordHash(dict):
    """Word to 64-bit hash; forgets everything when it has grown to limit words, so it is only a cache."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return value


def words_of(text: str) -> list[str]:
    """Lower-cased words: runs of letters, digits and underscores."""
    return WORD.findall(text.lower())


def word_lists(text: str, chars: int = 1 << 20) -> Iterator[list[str]]:
    """The words of a text, at least one list, each of the words of about so many characters."""
    text, at = text.lower(), 0
    while True:
        end = NO_WORD.search(text, at + chars) if at + chars < len(text) else None
        yield WORD.findall(text, at, end.start() if end else len(text))
        if end is None:
            return
        at = end.start()


def segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of segments with these lengths, and the segment of each element."""
    starts = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=starts[1:])
    return starts, np.repeat(np.arange(len(counts)), counts)
