"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of the embeddings of its hashed parts: the whole word and its prefixes of 3 to 7
characters. Filters of several widths slide over the words, each filter's maximum over the whole text feeds a
logistic output. All weights start at random and are trained together, filters and output by Adam, embeddings by
Adagrad, as a step touches few of them; the pass with the least loss on held-back rows counts.

Scores are calibrated by language: the character n-gram model of operator 6, learned from the same documents, tells a
text's language by its words. The logit threshold of each language with enough positives is the one with the best F1 on
held-back rows, that of all others the best over all, and it maps to a score of ``at``. The classifier is fitted on a
bounded sample of labelled rows (``sample`` rows, ``sample_bytes`` of text, chosen by hash in a total order).

Defined results: null and empty texts score as the output without any word, with maxima of 0; without labels of both
kinds every score is 0; an empty table gives an empty result; repeated rows of documents score alike and are learned
from once; of several labels of an id all count; rows with a null id or a null label are not learned from, and a null id
stays null; texts are scored whole, very long ones in blocks of words that overlap; a score of exactly ``at`` counts as
toxic; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import langid
from .common import labelled_sample, prepare, segments, slices, texts_of, trim, word_lists

#: Characters at a time, words whose activations are in memory at once, and different words whose parts or n-grams are.
SLICE, BLOCK, SOME = 1 << 21, 1 << 17, 1 << 14


@dataclass(frozen=True)
class ToxicConfig:
    bits: int = 16  #: of a part's hash
    size: int = 12  #: of an embedding
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  #: of each width
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    sample: int = 6000  #: labelled rows learned from, at most; the bound of the fit
    sample_bytes: int = 32 << 20  #: of the texts learned from, at most
    passes: int = 8  #: at most, or so many that there are ``steps``
    steps: int = 800
    patience: int = 2  #: passes without a loss less by a twentieth, after which learning ends
    batch: int = 32
    rate: float = 0.01  #: of filters and output
    word_rate: float = 0.3  #: of embeddings
    held_back: float = 0.15
    at: float = 0.7  #: the score that a threshold maps to
    least_positives: int = 15  #: of a language with its own threshold
    seed: int = 5

    @property
    def parts(self) -> int:
        return 1 + len(self.prefixes)


class _Numbers(dict):
    """Numbers its keys in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Vocabulary:
    """Numbers the words of a few texts and gives each one's hashed parts."""

    def __init__(self, config: ToxicConfig):
        self.config = config

    def parts(self, words: list[str]) -> np.ndarray:
        """Hashes of each word and of its prefixes (of the whole word, where it is shorter), all words at once: code
        points are digits of a number in a fixed base."""
        count, base = np.array([len(w) for w in words], np.int64), np.uint64(0x9E3779B97F4A7C15)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum(count) - count
        out = np.empty((len(words), self.config.parts), np.int32)
        hashed, at = np.zeros(len(words), np.uint64), 0
        shift = np.uint64(64 - self.config.bits)
        order = np.argsort(-count, kind="stable")
        longer = np.searchsorted(-count[order], -np.arange(1, int(count.max(initial=0)) + 1), "right").tolist()
        wanted = {n: k + 1 for k, n in enumerate(self.config.prefixes)}
        with np.errstate(over="ignore"):
            for n in range(1, max([*self.config.prefixes, len(longer)]) + 1):
                if n <= len(longer):
                    some = order[: longer[n - 1]]  # the words with an n-th character
                    hashed[some] = (hashed[some] + codes[starts[some] + n - 1] + np.uint64(1)) * base
                if n in wanted:
                    at = wanted[n]
                    out[:, at] = ((hashed ^ (hashed >> np.uint64(29))) * (base + np.uint64(2 * at))) >> shift
            out[:, 0] = ((hashed ^ (hashed >> np.uint64(29))) * base) >> shift
        return out

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
        """Word numbers of each text; parts of each number; the words."""
        number = _Numbers()
        ids = []
        for t in texts:  # a text's words are let go of before the next one's
            own = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in word_lists(t)]
            ids.append(own[0] if len(own) == 1 else np.concatenate(own))
        words = list(number)
        return ids, self.parts(words), words


def languages_of(model: langid.LangModel | None, ids: list[np.ndarray], words: list[str]) -> np.ndarray:
    """The number of each text's language by the n-grams of its words, -1 without one."""
    if model is None or not model.languages or not words:
        return np.full(len(ids), -1)
    sums, totals = map(np.concatenate, zip(*(model.sums(words[at : at + SOME]) for at in range(0, len(words), SOME)), strict=True))
    out = []
    for x in ids:
        n = np.bincount(x, minlength=1)
        used = np.flatnonzero(n)
        count = n[used] @ totals[used] if len(used) else 0.0
        out.append(int((n[used] @ sums[used] / count + model.bias).argmax()) if count else -1)
    return np.array(out, np.int64)


@dataclass
class ToxicModel:
    config: ToxicConfig
    emb: np.ndarray
    conv: list[np.ndarray]  #: for each width: width x size x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: langid.LangModel | None = None
    thresholds: dict[int, float] = field(default_factory=dict)
    slope: float = 1.0
    trained: bool = True

    def projected(self, words: np.ndarray) -> list[np.ndarray]:
        """Contribution of each word at each place of each filter, width by width."""
        weights = np.concatenate([c[j] for c in self.conv for j in range(len(c))], 1)
        out = np.empty((len(words), weights.shape[1]), np.float32)
        for at in range(0, len(words), 256):  # in products too small for threads, which would wait for each other
            np.matmul(words[at : at + 256], weights, out=out[at : at + 256])
        return np.split(out, weights.shape[1] // self.config.filters, 1)

    def forward(self, ids: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest activation of each filter in each text, at least 0; where its window starts in the texts one after
        another (-1: nowhere above 0); these texts' words."""
        f, n = self.config.filters, len(ids)
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if n else np.empty(0, np.int32)
        ends, of, full = np.cumsum(counts), np.repeat(np.arange(n), counts), np.flatnonzero(counts)
        best, where = np.zeros((n, f * len(self.conv)), np.float32), np.full((n, f * len(self.conv)), -1)
        if not len(flat):
            return best, where, flat
        left = ends[of] - np.arange(len(flat))
        # the contribution of each word at each place of each filter
        parts = self.projected(words)
        for k, c in enumerate(self.conv):
            own, parts = parts[: len(c)], parts[len(c) :]
            act = own[0][flat]
            for j in range(1, len(c)):
                act[: len(flat) - j] += own[j][flat[j:]]
            act[left < len(c)] = -np.inf  # the window would leave the text
            top = np.full((n, f), -np.inf, np.float32)
            top[full] = np.maximum.reduceat(act, (ends - counts)[full], axis=0)
            place, column = np.nonzero(act == top[of])
            at = np.full((n, f), -1)
            at[of[place][::-1], column[::-1]] = place[::-1]  # the first of equal ones
            top += self.bias[k * f : (k + 1) * f]
            best[:, k * f : (k + 1) * f] = np.maximum(top, 0)
            where[:, k * f : (k + 1) * f] = np.where(top > 0, at, -1)
        return best, where, flat

    def logits(self, ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Texts go by blocks of words; a long one's blocks overlap by a window, and their maxima are its own."""
        words, over = np.empty((len(table), self.config.size), np.float32), max(self.config.widths) - 1
        for at in range(0, len(table), SOME):
            words[at : at + SOME] = self.emb[table[at : at + SOME]].mean(1)
        best = np.zeros((len(ids), len(self.out)), np.float32)
        held, owner, size = [], [], 0

        def flush() -> None:
            if held:
                np.maximum.at(best, np.array(owner), self.forward(held, words)[0])

        for k, x in enumerate(ids):
            for at in range(0, max(1, len(x) - over), BLOCK):
                held.append(x[at : at + BLOCK + over])
                owner.append(k)
                size += len(held[-1])
                if size >= BLOCK:
                    flush()
                    held, owner, size = [], [], 0
        flush()
        return best @ self.out + self.out_bias

    def scores(self, texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
        if not self.trained or not texts:
            return np.zeros(len(texts))
        ids, table, words = vocabulary(texts)
        z, language = self.logits(ids, table), languages_of(self.languages, ids, words)
        threshold = np.array([self.thresholds.get(int(g), self.thresholds[-1]) for g in language])
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - threshold) + math.log(self.config.at / (1 - self.config.at)), -30, 30)))


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Between two logits, where F1 is best; in the middle of the widest such gap."""
    order = np.argsort(-z)
    z, y = z[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    gap = np.append(z[:-1] - z[1:], 1.0)
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda k: gap[k])
    return float(z[best] - gap[best] * 0.5)


def start(config: ToxicConfig) -> ToxicModel:
    """A network before training."""
    rng, f = np.random.default_rng(config.seed), config.filters
    total = f * len(config.widths)
    emb = rng.normal(0, 0.3, (1 << config.bits, config.size)).astype(np.float32)
    conv = [rng.normal(0, 1 / math.sqrt(w * config.size), (w, config.size, f)).astype(np.float32) for w in config.widths]
    return ToxicModel(config, emb, conv, np.zeros(total, np.float32), rng.normal(0, 0.3, total).astype(np.float32), 0.0)


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.steps = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.steps += 1
        for p, g, m, v in zip(self.params, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean())


def _alone(ids: list[np.ndarray], some: np.ndarray, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Some of the texts with a numbering of their own words, the parts of these, and their numbers in table."""
    used, local = np.unique(np.concatenate([np.empty(0, np.int32), *(ids[i] for i in some)]), return_inverse=True)
    starts, _ = segments(np.array([len(ids[i]) for i in some], np.int64))
    return np.split(local.astype(np.int32), starts[1:]), table[used], used


def learn(model: ToxicModel, ids: list[np.ndarray], table: np.ndarray, y: np.ndarray, fit: np.ndarray, back: np.ndarray) -> ToxicModel:
    """The network of the pass with the least loss on the held-back rows (on all rows without any)."""
    config, rng = model.config, np.random.default_rng(model.config.seed + 1)
    f, bias = config.filters, np.array([model.out_bias], np.float32)
    adam = _Adam([model.bias, model.out, bias, *model.conv], config.rate)
    seen = np.full(1 << config.bits, 1e-4)
    judged = back if len(back) else fit
    judged_ids, judged_table, _ = _alone(ids, judged, table)

    def copy() -> tuple:
        return model.emb.copy(), [c.copy() for c in model.conv], model.bias.copy(), model.out.copy(), float(bias[0])

    best, waited = None, 0
    for _ in range(max(config.passes, -(-config.steps * config.batch // len(fit))) if config.passes else 0):
        shuffled = rng.permutation(fit)
        for at in range(0, len(shuffled), config.batch):
            some = shuffled[at : at + config.batch]
            used, local = np.unique(np.concatenate([ids[i] for i in some]), return_inverse=True)
            words = model.emb[table[used]].mean(1)
            top, where, flat = model.forward(np.split(local, np.cumsum([len(ids[i]) for i in some])[:-1]), words)
            z = top @ model.out + bias[0]
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)).astype(np.float32)
            down = error[:, None] * model.out
            down[where < 0] = 0
            d_words, d_conv = np.zeros_like(words), [np.zeros_like(c) for c in model.conv]
            for k, c in enumerate(model.conv):
                text, own = np.nonzero(where[:, k * f : (k + 1) * f] >= 0)
                d, place = down[text, k * f + own][:, None], where[text, k * f + own]
                for j in range(len(c)):
                    w = flat[place + j]
                    np.add.at(d_conv[k][j].T, own, d * words[w])
                    np.add.at(d_words, w, d * c[j].T[own])
            adam.step([down.sum(0), top.T @ error, np.array([error.sum()]), *d_conv])
            touched = np.flatnonzero(np.abs(d_words).sum(1))
            parts, own = np.unique(table[used[touched]], return_inverse=True)
            own, d = own.ravel(), np.repeat(d_words[touched] / config.parts, config.parts, 0)
            d = np.stack([np.bincount(own, d[:, j], len(parts)) for j in range(config.size)], 1)
            seen[parts] += (d * d).mean(1)
            model.emb[parts] -= (config.word_rate * d / np.sqrt(seen[parts])[:, None]).astype(np.float32)
        model.out_bias = float(bias[0])
        loss = _loss(model.logits(judged_ids, judged_table), y[judged])
        waited = 0 if best is None or loss < 0.95 * best[0] else waited + 1
        if best is None or loss < best[0]:
            best = (loss, copy())
        if loss < 1e-3 or waited > config.patience:
            break
    if best:
        model.emb, model.conv, model.bias, model.out, model.out_bias = best[1]
    return model


def train(texts: list[str], labels: list[int], config: ToxicConfig, languages: langid.LangModel | None = None) -> ToxicModel:
    return _train(Vocabulary(config)(texts), labels, config, languages)


def _train(numbered: tuple[list[np.ndarray], np.ndarray, list[str]], labels: list[int], config: ToxicConfig, languages: langid.LangModel | None) -> ToxicModel:
    model = start(config)
    model.languages = languages
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        model.trained = False
        return model
    order = np.random.default_rng(config.seed).permutation(len(y))
    back, fit = order[: int(len(y) * config.held_back)], order[int(len(y) * config.held_back) :]
    if y[fit].min() == y[fit].max():
        back, fit = order[:0], order
    model.out_bias = float(np.log(max(1.0, y[fit].sum()) / max(1.0, (1 - y[fit]).sum())))
    ids, table, words = numbered
    learn(model, ids, table, y, fit, back)
    judged = back if len(back) and y[back].min() < y[back].max() else fit
    judged_ids, judged_table, used = _alone(ids, judged, table)
    z, yj = model.logits(judged_ids, judged_table), y[judged]
    own = languages_of(languages, judged_ids, [words[k] for k in used.tolist()])
    model.thresholds[-1] = _best_threshold(z, yj)
    for g in range(len(languages.languages) if languages else 0):
        mine = own == g
        if yj[mine].sum() >= config.least_positives and (1 - yj[mine]).sum() >= config.least_positives:
            model.thresholds[g] = _best_threshold(z[mine], yj[mine])
    return model


def fit(documents: DataFrame, labels: DataFrame, usable: Column, config: ToxicConfig = ToxicConfig(), label: str = "toxic", languages: langid.LangModel | None = None) -> ToxicModel:
    """Learn from documents whose doc_id has a label and for which usable (of column doc_id) holds. Without languages one
    threshold is for all texts."""
    rows = labelled_sample(documents, labels, usable, label, config.sample, config.sample_bytes, config.seed)
    numbered, own = Vocabulary(config)([t for t, _ in rows]), [y for _, y in rows]
    del rows  # the texts do not stay in memory while the network learns
    trim()
    model = _train(numbered, own, config, languages)
    del numbered
    trim()
    return model


def score(df: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value.config)
        for batch in slices(batches, chars=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(texts_of(batch), vocabulary), pa.float64())], names=["doc_id", "score"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(df: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """The rows of df, all columns, with a score below the threshold."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value.config)
        for batch in slices(batches, text, SLICE):
            yield batch.filter(pa.array(shared.value.scores(texts_of(batch, text), vocabulary) < shared.value.config.at, pa.bool_()))

    return df.mapInArrow(run, df.schema)
