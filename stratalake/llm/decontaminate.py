"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

Items (longer ones in segments of ``segment`` words) are indexed by their words. A posting's weight is its BM25 part
divided by the item's score for its own words, so a score of 1 says that a passage has every word of an item, and one
threshold holds for items of all lengths. Passages are all windows of two half windows, so that each segment is whole
in one of them. A bound over ranges of items, made from each half window's different words, skips most passages;
block-max WAND retrieves, for the rest, every item above the threshold. A retrieved item counts as leaked when enough
of its question's word trigrams are in the passage, and enough of its answer's words. An item of several segments is
verified as a whole, over all passages in which one of them was retrieved and the words around these.

Document frequencies, the number of segments and their mean length are counted over the whole item table, so an item's
scores do not depend on how items are dealt. The index is broadcast in slices of at most about ``slice_items`` segments;
one scan of the documents asks ``scan_slices`` of them, and more items take more scans.

Defined results: a null or empty text has no passage and no leak; an item of fewer than ``least_words`` words says
nothing about a text and leaks nowhere; a null item id is one more id; repeated rows of documents each have their leaks,
repeated rows of items leak once; different items with one id leak once, by the best of them; empty tables give empty
results; texts and items of any length are processed whole; other columns are ignored. Ties of passages go to the
first. Without separate columns the last sentence of an item is its answer; an item of one sentence is a question alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, slices, texts_of, words_of

LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, last_word long"
#: Characters at a time; the bounds of their half windows take the most memory.
SLICE = 2 << 20
SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class LeakConfig:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6  #: of an item's score for its own words
    question: float = 0.5  #: share of the question's trigrams
    answer: float = 0.5  #: share of the answer's words
    segment: int = 64  #: words of an indexed segment at most; also half a window
    block: int = 32  #: postings with one maximum
    ranges: int = 64  #: of items, for the first bound
    slice_items: int = 20_000  #: segments of a broadcast index, about
    scan_slices: int = 4  #: indexes that one scan of the documents asks
    least_words: int = 3  #: of an item; fewer are found anywhere by chance


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    parts = [p for p in SENTENCE.split(text.strip()) if words_of(p)]
    if len(parts) < 2:
        return words_of(text), []
    return words_of(" ".join(parts[:-1])), words_of(parts[-1])


def _grams(words: Iterable[str]) -> set[tuple[str, ...]]:
    """Trigrams; of fewer words, these."""
    words = list(words)
    return set(zip(words, words[1:], words[2:], strict=False)) or {tuple(words)}


@dataclass
class Segment:
    item: int | None
    question: list[str]
    answer: list[str]
    whole: tuple | None = None  #: id, question and answer of the item, if it has more segments


def segments_of(item: int | None, question: list[str], answer: list[str], config: LeakConfig) -> Iterator[Segment]:
    """An item's segments; the last one starts earlier, so that all of a long item have the full length."""
    words, size = question + answer, config.segment
    if len(words) < config.least_words:
        return
    # of a long item, all is verified: its key tells its segments from those of equal ids
    whole = (item, tuple(question), tuple(answer)) if len(words) > size else None
    seen = set()
    for at in range(0, len(words), size):
        at = min(at, max(0, len(words) - size))
        q, a = question[at : at + size], answer[max(0, at - len(question)) : max(0, at + size - len(question))]
        if (key := (tuple(q), tuple(a))) not in seen:
            seen.add(key)
            yield Segment(item, q, a, whole)


@dataclass(frozen=True)
class Counts:
    """Of all segments of the item table: their number, mean length, and the segments with each word (of a slice's)."""

    segments: int
    mean: float
    df: dict[str, int]

    @staticmethod
    def of(segments: list[Segment]) -> Counts:
        sizes = [len(s.question) + len(s.answer) for s in segments]
        return Counts(len(sizes), sum(sizes) / max(1, len(sizes)), Counter(w for s in segments for w in set(s.question + s.answer)))


class Index:
    def __init__(self, items: list[tuple[int | None, list[str], list[str]]], config: LeakConfig, whole: Counts | None = None):
        """whole: the counts of the item table that these items are a slice of."""
        self.config = config
        segments = [s for item in dict.fromkeys((i, tuple(q), tuple(a)) for i, q, a in items) for s in segments_of(item[0], list(item[1]), list(item[2]), config)]
        whole = whole or Counts.of(segments)
        df, mean = whole.df, whole.mean
        counts = [Counter(s.question + s.answer) for s in segments]
        weighed = []
        for s, c in zip(segments, counts, strict=True):
            n = c.total()
            w = {t: math.log(1 + (whole.segments - df[t] + 0.5) / (df[t] + 0.5)) * f * (config.k1 + 1) / (f + config.k1 * (1 - config.b + config.b * n / mean)) for t, f in c.items()}
            own = sum(w.values())
            weighed.append((n, s, {t: x / own for t, x in w.items()}))
        weighed.sort(key=lambda x: (x[0], x[1].item if x[1].item is not None else -1, x[1].question))  # alike lengths share blocks
        self.segments = [s for _, s, _ in weighed]
        self.grams = [set(zip(s.question, s.question[1:], s.question[2:], strict=False)) or {tuple(s.question)} for s in self.segments]
        self.terms = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        n_ranges = max(1, min(config.ranges, len(self.segments)))
        self.range_max = np.zeros((len(self.terms), n_ranges), np.float32)
        for k, (_, _, w) in enumerate(weighed):
            for t, x in w.items():
                t = self.terms[t]
                lists[t].append((k, x))
                r = k * n_ranges // len(self.segments)
                self.range_max[t, r] = max(self.range_max[t, r], x)
        self.whole = {s.whole: (_grams(s.whole[1]), s.whole[2]) for s in self.segments if s.whole}
        #: of each term: item numbers, weights, maximum, maximum and last item of each block
        self.postings = {}
        for t, p in lists.items():
            p.sort()
            own = [p[k : k + config.block] for k in range(0, len(p), config.block)]
            self.postings[t] = ([x[0] for x in p], [x[1] for x in p], max(x[1] for x in p), [max(x[1] for x in o) for o in own], [o[-1][0] for o in own])

    def retrieve(self, terms: Iterable[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every segment with a score of at least the threshold, with its score."""
        least, block, end = self.config.threshold - 1e-9, self.config.block, len(self.segments)
        lists = [[0, *self.postings[t]] for t in terms if t in self.postings]
        out = []
        at = [(x[1][0], k) for k, x in enumerate(lists)]
        while at:
            at.sort()
            bound, pivot = 0.0, -1
            for p, (_, k) in enumerate(at):
                bound += lists[k][3]
                if bound >= least:
                    pivot = p
                    break
            if pivot < 0:
                break
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            # the bound by the blocks in which the pivot would be
            tight, skip = 0.0, end
            for _, k in at[: pivot + 1]:
                x = lists[k]
                b = x[0] // block
                while b < len(x[5]) and x[5][b] < item:
                    b += 1
                if b < len(x[5]):
                    tight += x[4][b]
                    skip = min(skip, x[5][b] + 1)
            if tight >= least:
                if at[0][0] == item:
                    score = 0.0
                    for _, k in at[: pivot + 1]:
                        score += lists[k][2][lists[k][0]]
                    if score >= least:
                        out.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:
                to = max(item + 1, min(skip, at[pivot + 1][0] if pivot + 1 < len(at) else end))
            moved = []
            for first, k in at:
                if first < to:
                    x = lists[k]
                    i, ids = x[0], x[1]
                    while i < len(ids) and ids[i] < to:
                        i += 1
                    x[0] = i
                    if i < len(ids):
                        moved.append((ids[i], k))
                else:
                    moved.append((first, k))
            at = moved
        return out

    def verify(self, segment: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's trigrams and of the answer's words that the passage has."""
        s, grams = self.segments[segment], self.grams[segment]
        words = set(passage)
        if s.question:
            have = set(zip(passage, passage[1:], passage[2:], strict=False)) if len(s.question) >= 3 else {tuple(passage[k : k + len(s.question)]) for k in range(len(passage))}
            question = len(grams & have) / len(grams)
        else:
            question = 1.0
        return question, (sum(w in words for w in s.answer) / len(s.answer) if s.answer else 1.0)

    def long_leaks(self, whole: tuple, hits: list[tuple[int, float]], words: list[str]) -> list[tuple]:
        """The leak of an item of several segments, if enough of its whole question and answer is near those found."""
        item, question, _ = whole
        grams, answer = self.whole[whole]
        window = 2 * self.config.segment
        reach = len(question) + len(answer) + window
        spans: list[list[int]] = []
        for begin in sorted({begin for begin, _ in hits}):
            first, last = max(0, begin - reach), min(len(words), begin + window + reach)
            if spans and first <= spans[-1][1]:
                spans[-1][1] = last
            else:
                spans.append([first, last])
        n, have, own = min(3, len(question)), set(), set()
        for first, last in spans:
            own.update(words[first:last])
            have.update(zip(*(words[first + k : last] for k in range(n)), strict=False))
        q = len(grams & have) / len(grams) if question else 1.0
        a = sum(w in own for w in answer) / len(answer) if answer else 1.0
        if q < self.config.question or a < self.config.answer:
            return []
        begin, score = min(hits, key=lambda x: (-x[1], x[0]))
        return [(item, min(1.0, score), q, a, begin, min(len(words), begin + window) - 1)]

    def leaks(self, texts: list[str]) -> list[list[tuple]]:
        """For each text: (item, score, question, answer, first word, last word), one for each leaked item."""
        half, get = self.config.segment, self.terms.get
        split = [words_of(t) for t in texts]
        out: list[list[tuple]] = [[] for _ in texts]
        parts: list[dict[tuple, list[tuple[int, float]]]] = [defaultdict(list) for _ in texts]
        if not self.segments:
            return out
        n_terms = len(self.terms)
        halves = [-(-len(w) // half) for w in split]
        first = np.concatenate([[0], np.cumsum(halves)]).astype(np.int64)
        counts = np.array([len(w) for w in split], np.int64)
        ids = np.fromiter((get(w, -1) for ws in split for w in ws), np.int64, int(counts.sum()))
        if not len(ids):
            return out
        place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = np.repeat(first[:-1], counts) + place // half
        known = ids >= 0
        pairs = np.unique(own[known] * n_terms + ids[known])
        at, term = pairs // n_terms, pairs % n_terms
        bound = np.zeros((int(first[-1]) + 1, self.range_max.shape[1]), np.float32)
        if len(pairs):
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            bound[at[cuts]] = np.add.reduceat(self.range_max[term], cuts, axis=0)
        both = bound[:-1] + bound[1:]
        last = first[1:][np.array(halves) > 0] - 1
        both[last] = bound[last]  # the last half of a text stands alone; it is also in the window before
        for h in np.flatnonzero(both.max(1) >= self.config.threshold - 1e-5).tolist():
            doc = int(np.searchsorted(first, h, "right")) - 1
            begin = (h - int(first[doc])) * half
            passage = split[doc][begin : begin + 2 * half]
            terms = sorted({t for w in passage if (t := get(w)) is not None})
            if self.range_max[terms].sum(0).max() < self.config.threshold - 1e-5:
                continue  # words in both halves counted twice
            for segment, score in self.retrieve(terms):
                s = self.segments[segment]
                if s.whole:
                    parts[doc][s.whole].append((begin, score))
                    continue
                question, answer = self.verify(segment, passage)
                if question >= self.config.question and answer >= self.config.answer:
                    out[doc].append((s.item, min(1.0, score), question, answer, begin, begin + len(passage) - 1))
        for doc, found in enumerate(parts):
            for whole, hits in found.items():
                out[doc] += self.long_leaks(whole, hits, split[doc])
        return [best_of(found) for found in out]


def best_of(found: list[tuple]) -> list[tuple]:
    """The best leak of each item."""
    best: dict = {}
    for x in sorted(found, key=lambda x: (-x[1], -x[2], x[4])):
        best.setdefault(x[0], x)
    return sorted(best.values(), key=lambda x: (x[0] is None, x[0] or 0))


TOLD = "item_id long, question array<string>, answer array<string>, words array<string>, segments long, length long, part long"


def _items(items: DataFrame, config: LeakConfig, item_id: str, text: str, question: str | None, answer: str | None) -> DataFrame:
    """Different items of the table in words, with the different words of each segment, one after another."""
    q = F.col(question or text).cast("string").alias("q")
    a = (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a")
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), q, a).distinct().withColumn("part", F.xxhash64("q", "a"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "q", SLICE):
            cols: list[list] = [[] for _ in range(7)]
            for item, q, a, part in zip(*(batch.column(n).to_pylist() for n in ("item_id", "q", "a", "part")), strict=True):
                split = (words_of(q or ""), words_of(a or "")) if answer else split_item(q or "")
                own = list(segments_of(item, *split, config))
                words = [w for s in own for w in sorted(set(s.question + s.answer))]
                for c, x in zip(cols, (item, *split, words, len(own), sum(len(s.question) + len(s.answer) for s in own), part), strict=True):
                    c.append(x)
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), text, text, text, pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in TOLD.split(", ")])

    return rows.mapInArrow(run, TOLD).where("segments > 0")


def indexes(items: DataFrame, config: LeakConfig, item_id: str = "item_id", text: str = "text", question: str | None = None, answer: str | None = None) -> Iterator[list[Index]]:
    """The indexes of each scan. An item id is in one scan alone, so that it leaks once."""
    told = materialise(_items(items, config, item_id, text, question, answer), "benchmark-items")
    facts = told.agg(F.sum("segments").alias("n"), F.sum("length").alias("length")).first()
    total = facts["n"] or 0
    if not total:
        yield [Index([], config)]
        return
    df = told.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    scans = -(-total // (config.slice_items * config.scan_slices))
    if total > config.slice_items:
        df = materialise(df, "benchmark-words")
    for scan in range(scans):
        here = told.where(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == scan)
        parts = max(1, -(-(here.agg(F.sum("segments")).first()[0] or 0) // config.slice_items))
        made = []
        for part in range(parts):
            own = here.where(F.pmod("part", F.lit(parts)) == part)
            words = own.select(F.explode("words").alias("word")).distinct().join(df, "word")
            held = {r["word"]: r["df"] for r in words.collect()}  # words of a slice of bounded segments
            rows = [(r["item_id"], r["question"], r["answer"]) for r in own.select("item_id", "question", "answer").collect()]
            made.append(Index(rows, config, Counts(total, facts["length"] / total, held)))
        yield made


def _leaks(indexes: list[Index], texts: list[str]) -> list[list[tuple]]:
    """The leaks of each text over all indexes of a scan."""
    found = [index.leaks(texts) for index in indexes]
    return found[0] if len(found) == 1 else [best_of([x for own in one for x in own]) for one in zip(*found, strict=True)]


def leaks(df: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), doc_id: str = "doc_id", text: str = "text", **columns: str) -> DataFrame:
    """A row for each document and each item that leaked into it, with the best passage."""
    spark = df.sparkSession
    prepare(spark)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for scan in indexes(items, config, **columns):
        shared = [spark.sparkContext.broadcast(index) for index in scan]

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = [x.value for x in shared]
            for batch in slices(batches, chars=SLICE):
                rows = [(doc, *x) for doc, found in zip(batch.column(0).to_pylist(), _leaks(own, texts_of(batch)), strict=True) for x in found]
                cols = list(zip(*rows, strict=True)) or [()] * 7
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "last_word"])

        found = source.mapInArrow(run, LEAK)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(df: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), text: str = "text", **columns: str) -> DataFrame:
    """The rows of df, all columns, into which no item leaked."""
    prepare(df.sparkSession)
    for scan in indexes(items, config, **columns):
        shared = [df.sparkSession.sparkContext.broadcast(index) for index in scan]

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = [x.value for x in shared]
            for batch in slices(batches, text, SLICE):
                yield batch.filter(pa.array([not x for x in _leaks(own, texts_of(batch, text))], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
