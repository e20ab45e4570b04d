"""Quality: a compression classifier.

Pairs of zstandard dictionaries are trained, one of a pair on texts labelled good and one on texts labelled bad, for
each of three chunk sizes. A text is compressed chunk by chunk with each; the normalised difference (bad - good) /
(bad + good) of the summed sizes says which kind it resembles. As text that repeats itself in place of saying something
is short by any dictionary, its size as one piece, by the bad dictionary and what it said before, and its size as it is
are set against that of its chunks by the good one in the same way. Nothing else of a text counts, least of all its
length. A logistic calibration on held-back rows, piecewise linear in these differences, turns them into a score.

The classifier is fitted on a bounded sample of labelled rows (``sample`` rows, ``sample_bytes`` of text, chosen by hash
in a total order), of which each dictionary is trained on at most ``learn_bytes``, its chunks taken evenly. Texts are
scored whole, in chunks.

Defined results: a null or empty text has differences of 0 and scores by the calibration there; without labels of
both kinds every score is the share of good ones (0.5 without labels); an empty table gives an empty result; repeated
rows of documents score alike and are learned from once; of several labels of an id all count; rows with a null id or a
null label are not learned from, and a null id stays null; a very long text costs time in proportion and memory for one
copy; scores that tie the threshold of a query are on its upper side; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, prepare, slices, texts_of


@dataclass(frozen=True)
class QualityConfig:
    dictionary: int = 64 << 10  #: bytes of each dictionary
    chunks: tuple[int, ...] = (64, 160, 400)  #: bytes compressed at a time, for each pair of dictionaries
    level: int = 3
    sample: int = 6000  #: labelled rows learned from, at most; the bound of the fit
    sample_bytes: int = 32 << 20  #: of the texts learned from, at most
    learn_bytes: int = 12 << 20  #: bytes that each dictionary is trained on, taken evenly from the sample's chunks
    held_back: float = 0.25  #: of the sample, for the calibration
    seed: int = 13


class Differences:
    """Normalised compressed-size differences of texts, one for each chunk size, that of the text as one piece, and that of
    the text as it is."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], config: QualityConfig):
        self.config = config
        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        params = zstandard.ZstdCompressionParameters.from_level(config.level, **plain)
        self.packers = []
        for pair in pairs:
            made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in pair]  # trained ones keep their entropy tables
            for d in made:
                d.precompute_compress(level=config.level)
            self.packers.append([zstandard.ZstdCompressor(dict_data=d, compression_params=params) for d in made])

    def __call__(self, text: str) -> tuple[float, ...]:
        raw = memoryview(text.encode("utf-8", "replace"))
        if not raw:
            return (0.0,) * (len(self.config.chunks) + 2)
        out = []
        for step, (good, bad) in zip(self.config.chunks, self.packers, strict=True):
            g = b = 0
            for k in range(0, len(raw), step):
                part = raw[k : k + step]
                g += len(good.compress(part))
                b += len(bad.compress(part))
            out.append((b - g) / (b + g))
        whole = len(bad.compress(raw))
        return (*out, (whole - g) / (whole + g), (len(raw) - g) / (len(raw) + g))


def _basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Piecewise linear functions of each difference."""
    cols = [np.ones(len(x))]
    for k in range(x.shape[1]):
        cols.append(x[:, k])
        cols += [np.maximum(0.0, x[:, k] - q) for q in knots[k]]
    return np.stack(cols, 1)


@dataclass
class QualityModel:
    config: QualityConfig
    pairs: list[tuple[bytes, bytes]]
    knots: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float
    trained: bool = True

    def scores(self, texts: list[str], differences: Differences | None) -> np.ndarray:
        if not self.trained or differences is None:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        x = (np.array([differences(t) for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(_basis(x, self.knots) @ self.weights, -30, 30)))

    def differences(self) -> Differences | None:
        return Differences(self.pairs, self.config) if self.trained else None


def _dictionary(texts: list[str], chunk: int, config: QualityConfig) -> bytes:
    """A trained dictionary, or for few texts their own end."""
    parts = [raw[k : k + chunk] for t in texts for raw in [t.encode("utf-8", "replace")] for k in range(0, len(raw), chunk)]
    keep = max(1, -(-sum(map(len, parts)) // config.learn_bytes))
    parts = [p for p in parts[::keep] if len(p) >= 8]
    try:
        return zstandard.train_dictionary(config.dictionary, parts, level=config.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-config.dictionary :] or b"\0" * 8


def train(texts: list[str], labels: list[int], config: QualityConfig) -> QualityModel:
    y = np.array(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    none = np.zeros(1)
    if not len(y) or y.min() == y.max():
        return QualityModel(config, [], none, none, none, none, share, False)
    rng = np.random.default_rng(config.seed)
    order = rng.permutation(len(y))
    back, fit = order[: int(len(y) * config.held_back)], order[int(len(y) * config.held_back) :]
    if min(y[back].sum(), (1 - y[back]).sum(), y[fit].sum(), (1 - y[fit]).sum()) < 1:
        back = fit = order
    pairs = [tuple(_dictionary([texts[i] for i in fit if y[i] == k], chunk, config) for k in (1, 0)) for chunk in config.chunks]
    differences = Differences(pairs, config)
    x = np.array([differences(texts[i]) for i in back])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    knots = np.quantile(x, [0.05, 0.2, 0.4, 0.6, 0.8, 0.95], axis=0).T
    basis, w = _basis(x, knots), None
    w = np.zeros(basis.shape[1])
    penalty = np.full(len(w), 0.3)
    penalty[0] = 1e-6
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(basis @ w, -30, 30)))
        step = np.linalg.solve(basis.T @ (basis * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), basis.T @ (p - y[back]) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return QualityModel(config, pairs, knots, mean, scale, w, share)


def fit(documents: DataFrame, labels: DataFrame, usable: Column, config: QualityConfig = QualityConfig(), label: str = "quality") -> QualityModel:
    """Learn from documents whose doc_id has a label and for which usable (of column doc_id) holds."""
    # Both kinds at their own rate would move the base rate; the calibration needs it, so one rate holds for both.
    rows = labelled_sample(documents, labels, usable, label, config.sample, config.sample_bytes, config.seed)
    return train([t for t, _ in rows], [y for _, y in rows], config)


def score(df: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differences = shared.value.differences()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(texts_of(batch), differences), pa.float64())], names=["doc_id", "score"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
