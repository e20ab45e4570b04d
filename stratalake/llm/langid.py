"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is one blank, and hashed n-grams of one to three characters are counted. A
feature's value is its share of the text's n-grams times its inverse document frequency times a constant. Weights are
learned by follow-the-regularised-leader with elastic-net penalties (most stay exactly 0), then one temperature is
fitted on held-back rows of the sample so that scores are calibrated.

The classifier is fitted on a bounded sample of labelled rows (``sample`` rows, ``sample_bytes`` of text, chosen by hash of
id and text in a total order); features are made on the executors, so texts never reach the driver. Every text is
scored whole; as counts of n-grams add up, a long one goes by parts, and the n-grams over each cut are put right.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0; without labelled rows every
text is ``und``; with one label every text with a letter gets it with score 1; an empty table gives an empty result;
repeated rows get equal results and are learned from once; a null id stays null; rows with a null label or a null text
are not learned from; of languages with equal scores the first by name is taken; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, prepare, segments, slices, texts_of, trim

UND = "und"
#: Characters at a time: a text of n characters takes about 60 n bytes of arrays.
SLICE = 1 << 20


@dataclass(frozen=True)
class LangConfig:
    bits: int = 18  #: of a feature's hash
    sample: int = 4000  #: labelled rows learned from, at most; the bound of the fit
    sample_bytes: int = 64 << 20  #: of the texts learned from, at most
    passes: int = 3
    alpha: float = 0.3  #: FTRL learning rate
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.5
    scale: float = 40.0
    held_back: float = 0.2  #: of the sample, for the temperature
    seed: int = 3


@cache
def _letters() -> np.ndarray:
    """Lower-cased code point of each letter, 32 for anything else."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x33480):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the text of each, and whether each text has a letter."""
    raw = " ".join(texts).encode("utf-32-le", "surrogatepass")
    codes = _letters()[np.frombuffer(" ".encode("utf-32-le") + raw + " ".encode("utf-32-le"), np.uint32)]
    # every text keeps the blank before it, and the blank after it belongs to it too for its n-grams
    counts = np.array([len(t) + 1 for t in texts], np.int64)
    of = np.append(np.repeat(np.arange(len(texts)), counts), len(texts) - 1).astype(np.int32)
    letter = codes != 32
    has = np.zeros(len(texts), bool)
    has[of[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of blanks the first stays
    starts, _ = segments(counts)
    first = np.zeros(len(codes), bool)
    first[starts] = True
    keep |= first
    codes, of = codes[keep], of[keep]
    shift = np.uint32(32 - bits)
    parts_h, parts_of = [], []
    with np.errstate(over="ignore"):
        rolled = codes * np.uint32(0x9E3779B1)
        own = codes != 32
        parts_h.append((rolled[own] * np.uint32(0x85EBCA6B)) >> shift)
        parts_of.append(of[own])
        for n in (2, 3):
            if len(codes) < n:
                break
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + codes[n - 1 :]
            h = (rolled ^ (rolled >> np.uint32(13))) * np.uint32(0x85EBCA6B + 2 * n)
            # the blank that starts the next text may end this one, after a letter
            start, within, end = of[: len(rolled)], of[n - 2 : n - 2 + len(rolled)], of[n - 1 :]
            same = (within == start) & ((end == start) | (codes[n - 2 : n - 2 + len(rolled)] != 32))
            parts_h.append(h[same] >> shift)
            parts_of.append(of[: len(rolled)][same])
    h, of = np.concatenate(parts_h), np.concatenate(parts_of)
    return h, of, has


def _edge(text: str, at: int, to: int) -> str:
    """An end of text[:at] (to < 0) or start of text[at:to] with the two letters that n-grams over a cut can reach, or
    all of it."""
    size = 16
    while True:
        got = text[max(0, at - size) : at] if to < 0 else text[at : min(to, at + size)]
        if len(got) < size or sum(map(str.isalpha, got)) >= 2:
            return got
        size *= 2


def counted(texts: list[str], bits: int, chars: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed n-grams of the texts by groups of about so many characters: hashes, the text of each, how often it counts
    (1, or -1), and the letters as ``features`` tells them. A text AB has the n-grams of A and of B, and those that its
    edges have together but not alone."""
    parts: list[tuple[str, int, int]] = []
    size = 0

    def group() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, of, has = features([p[0] for p in parts], bits)
        owner, sign = np.array([p[1] for p in parts], np.int32), np.array([p[2] for p in parts], np.int8)
        letter = np.zeros(len(texts), bool)
        letter[owner[has]] = True
        return h, owner[of], sign[of], letter

    for k, t in enumerate(texts):
        cuts = range(0, max(1, len(t)), chars)
        for at in cuts:
            own = [(t[at : at + chars], 1)]
            if at:
                a, b = _edge(t, at, -1), _edge(t, at, at + chars)
                own += [(a + b, 1), (a, -1), (b, -1)]
            parts += [(x, k, sign) for x, sign in own]
            size += sum(len(x) + 1 for x, _ in own)
            if size >= chars:
                yield group()
                parts, size = [], 0
    if parts:
        yield group()


@dataclass
class LangModel:
    languages: list[str]
    weights: np.ndarray  #: features x languages, float32, times idf and scale
    bias: np.ndarray
    temperature: float
    bits: int

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its n-grams' weights and their number. Both add up over texts, but for the n-grams
        across them."""
        sums, totals, _ = self._sums(texts)
        return sums, totals

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums, totals, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for h, of, sign, letter in counted(texts, self.bits):
            plain = len(sign) == 0 or sign.min() > 0
            totals += np.bincount(of, None if plain else sign, len(texts))
            has |= letter
            for c in range(len(self.languages)):
                w = self.weights[:, c][h]
                sums[:, c] += np.bincount(of, w if plain else w * sign, len(texts))
        return sums, totals, has

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of probabilities, and whether each text has a letter."""
        sums, totals, has = self._sums(texts)
        logits = (sums / np.maximum(totals, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True), has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        p, has = self.probabilities(texts)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        return [self.languages[b] if ok else UND for b, ok in zip(best, has, strict=True)], np.where(has, score, 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], config: LangConfig) -> LangModel:
    """rows: label, feature ids, counts."""
    languages = sorted({r[0] for r in rows})
    size, k = 1 << config.bits, len(languages)
    if k < 2:
        return LangModel(languages, np.zeros((size, k), np.float32), np.zeros(k), 1.0, config.bits)
    y = np.array([languages.index(r[0]) for r in rows])
    rng = np.random.default_rng(config.seed)
    order = rng.permutation(len(rows))
    back = order[: int(len(rows) * config.held_back)]
    fit = order[len(back) :]
    df = np.zeros(size, np.int64)
    for i in fit:
        df[rows[i][1]] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    idf[df == 0] = 0.0  # never learned
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def values(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Made each time: kept for all rows, they would be most of a fit's memory."""
        _, ids, counts = rows[i]
        return ids, config.scale * idf[ids] * counts / max(1, counts.sum())

    def solved(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((config.beta + np.sqrt(n)) / config.alpha + config.l2))

    for _ in range(config.passes):
        for i in rng.permutation(fit):
            ids, v = values(i)
            wi, wb = solved(z[ids], n[ids], config.l1), solved(z[size], n[size], 0.0)
            err = _softmax(v @ wi + wb)
            err[y[i]] -= 1
            g = v[:, None] * err
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / config.alpha
            z[ids] += g - sigma * wi
            n[ids] += g * g
            sb = (np.sqrt(n[size] + err * err) - np.sqrt(n[size])) / config.alpha
            z[size] += err - sb * wb
            n[size] += err * err
    w = np.empty((size, k))
    for c in range(k):  # one at a time takes less memory
        w[:, c] = solved(z[:size, c], n[:size, c], config.l1)
    bias = solved(z[size], n[size], 0.0)
    temperature = 1.0
    if len(back):
        logits = np.array([v @ w[ids] + bias for ids, v in map(values, back)])

        def loss(t: float) -> float:
            return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(back)), y[back]], 1e-12)).mean()

        temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    w *= config.scale * idf[:, None]
    return LangModel(languages, w.astype(np.float32), bias, temperature, config.bits)


def fit(df: DataFrame, usable: Column, config: LangConfig = LangConfig(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LangModel:
    """Learn from the rows of df where usable holds."""
    prepare(df.sparkSession)
    labelled = df.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    count = labelled.select(lang).count()
    if not count:
        return LangModel([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, config.bits)
    rate = min(1.0, 2 * config.sample / count)
    chosen = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("order"))
    # the rate only thins what is ordered; the bound is that of rows and bytes
    chosen = chosen.where(F.pmod("order", F.lit(1_000_003)) < rate * 1_000_003).withColumn("place", F.xxhash64("order")).withColumn("bytes", F.octet_length("text").cast("long"))
    chosen = bounded(chosen, ["place", "order", "lang"], "bytes", config.sample, config.sample_bytes).select("text", "lang", "order")
    bits = config.bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=SLICE):
            keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
            for h, of, sign, _ in counted(texts_of(batch), bits):
                keys, own = np.unique(np.concatenate([keys, of.astype(np.int64) << bits | h]), return_inverse=True)
                sums = np.bincount(own, np.concatenate([sums, sign]), len(keys)).astype(np.int64)
            keys, sums = keys[sums > 0], sums[sums > 0]
            cuts = np.searchsorted(keys, np.arange(1, batch.num_rows) << bits)
            ids, counts = np.split((keys & ((1 << bits) - 1)).astype(np.uint32), cuts), np.split(sums.astype(np.uint32), cuts)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in counts], pa.binary())], names=["lang", "order", "ids", "counts"])

    got = chosen.mapInArrow(run, "lang string, order long, ids binary, counts binary").toArrow()
    # what is learned from are views of the table, not copies
    own = lambda name: [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column(name)]
    rows = sorted(zip(got.column("order").to_pylist(), got.column("lang").to_pylist(), own("ids"), own("counts"), strict=True), key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    model = train([(lang, i, c) for _, lang, i, c in rows if len(i)], config)
    del got, rows
    trim()
    return model


def predict(df: DataFrame, model: LangModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=SLICE):
            lang, score = shared.value.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(df: DataFrame, model: LangModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text has a language with a score of at least ``least``."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            lang, score = shared.value.predict(texts_of(batch, text))
            keep = [x != UND and s >= least for x, s in zip(lang, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
