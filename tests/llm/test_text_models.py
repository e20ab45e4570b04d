"""Classifiers: held-out accuracy, defined results, and what they must not depend on."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import SF

from stratalake.llm import langid, quality, queries, toxicity
from stratalake.llm.common import held_out, words_of

BIG = SF.replace("0.001", "0.1")


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def auc(scores, y):
    rank = np.argsort(np.argsort(scores))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_held_out(spark):
    got = spark.range(300).select("id", held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r["h"] == (crc(r["id"], 3) == 1) for r in got)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["ab c", "d", "", "Éa--b ", " x", "1 2", "", "zz"]
    h, of, has = langid.features(texts, 18)
    for k, t in enumerate(texts):
        alone, _, own = langid.features([t], 18)
        assert sorted(h[of == k]) == sorted(alone) and own[0] == has[k]


def test_language(spark):
    got = queries.op6_language_id(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, ok = got.count(), got.where("lang_pred = lang").count()
    assert n > 2000 and ok / n > 0.97


def test_language_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(200):
        own = rng.integers(0, 50, 30) + (50 if k % 2 else 0)
        ids, counts = np.unique(np.append(own, rng.integers(100, 150, 10)), return_counts=True)
        rows.append(("b" if k % 2 else "a", ids, counts.astype(float)))
    m = langid.train(rows, langid.LangConfig(bits=8))
    assert 0 < (m.weights != 0).mean() < 0.7 and m.temperature > 0


def test_language_awkward(spark, awkward, nothing):
    model = langid.fit(spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate([("one two three", "en"), ("eins zwei drei", "de"), (None, "fr"), ("x", None)] * 5)], "doc_id bigint, text string, lang string"), F.lit(True))
    assert model.languages == ["de", "en"]
    got = langid.predict(awkward, model).collect()
    assert len(got) == 11
    assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3, 4, 8)] == [("und", 0.0)] * 5
    assert langid.predict(nothing, model).count() == 0
    empty = langid.fit(awkward.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(awkward, empty).collect()} == {"und"}
    kept = langid.keep_known(awkward, model, 0.0)
    assert kept.columns == awkward.columns and kept.count() == 5


def test_toxicity(spark):
    y = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic")
    got = queries.op2_toxicity(spark, BIG).join(y, "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.93
    assert got.toxic[got.predicted == 1].mean() > 0.75


def test_toxicity_learns_words_and_prefixes():
    rng = np.random.default_rng(0)
    plain = lambda: " ".join(f"w{rng.integers(300)}" for _ in range(40))
    texts, labels = [], []
    for k in range(600):
        y = k % 4 == 0
        texts.append(plain() + (f" vile{rng.integers(10**6)} " if y else " ") + plain())
        labels.append(int(y))
    m = toxicity.train(texts, labels, toxicity.ToxicConfig(bits=12))
    v = toxicity.Vocabulary(m.config)
    assert (m.scores([plain() + " vilezzz " + plain() * 50], v) >= 0.7).all()  # a new word, in a long text
    assert (m.scores([plain() for _ in range(20)], v) < 0.7).mean() > 0.9


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(41, None), (None, 1)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(k, "bad thing here" if k % 2 else "good thing here") for k in range(40)] + [(41, "x")], "doc_id bigint, text string")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(awkward, model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3, 4)}) == 1
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(awkward, none).collect()} == {0.0}
    assert toxicity.keep_clean(awkward, none).columns == awkward.columns


def test_quality(spark):
    y = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality")
    got = queries.op5_compression_quality(spark, BIG).join(y, "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.97
    assert (got.predicted == got.quality).mean() > 0.96
    assert got.predicted[got.quality == 1].mean() > 0.98


def test_quality_awkward(spark, awkward, nothing):
    docs = spark.createDataFrame([(k, f"some plain words {k} and more of them" if k % 2 else f"!!$$ {k} %%&& !!$$") for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(61, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(awkward, model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    own = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert auc(np.array(list(own.values())), np.array([k % 2 for k in own])) > 0.95
    assert quality.score(nothing, model).count() == 0
    assert {r["score"] for r in quality.score(awkward, quality.fit(docs, labels.where("quality = 1"), F.lit(True))).collect()} == {1.0}


@pytest.mark.parametrize("name", ["op2_toxicity", "op5_compression_quality", "op6_language_id"])
def test_scores_depend_on_the_text_alone(spark, name, tmp_path):
    """With other ids, sources and languages of the rows that are scored, scores of a model stay; here: equal texts, equal scores."""
    got = getattr(queries, name)(spark, SF).select("doc_id", "score")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got.join(docs, "doc_id").groupBy("text").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    plain = lambda: " ".join(f"{rng.choice(['wa', 'xe', 'yo'])}{rng.integers(60)}" for _ in range(int(rng.integers(1, 40))))
    return [plain() + (f" vile{rng.integers(10)} " if k % 3 == 0 else " ") + plain() for k in range(n)], [int(k % 3 == 0) for k in range(n)]


def test_toxicity_equals_loops():
    """The network by loops over one text, without numpy's batches."""
    texts, y = corpus(300)
    languages = langid.train([(l, *map(np.asarray, np.unique(langid.features([t], 18)[0].astype(np.int64), return_counts=True))) for l, t in [("a", "wa xe"), ("b", "yo vile")] * 20], langid.LangConfig())
    m = toxicity.train(texts, y, toxicity.ToxicConfig(bits=10, passes=2, least_positives=3), languages)
    v = toxicity.Vocabulary(m.config)

    def part(w):
        out = []
        for k, p in enumerate([w, *(w[:n] for n in m.config.prefixes)]):
            h = 0
            for c in p:
                h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 % 2**64
            out.append(((h ^ (h >> 29)) * (0x9E3779B97F4A7C15 + 2 * k) % 2**64) >> (64 - m.config.bits))
        return out

    def by_hand(text):
        emb = [[sum(float(m.emb[p][d]) for p in part(w)) / m.config.parts for d in range(m.config.size)] for w in words_of(text)]
        z, q = m.out_bias, 0
        for c in m.conv:
            for f in range(m.config.filters):
                acts = [sum(emb[i + j][d] * float(c[j, d, f]) for j in range(len(c)) for d in range(m.config.size)) + float(m.bias[q]) for i in range(len(emb) - len(c) + 1)]
                z += max([0.0, *acts]) * float(m.out[q])
                q += 1
        sums, count = [0.0, 0.0], 0
        for w in words_of(text):
            for h in langid.features([w], 18)[0].tolist():
                count += 1
                sums = [s + float(x) for s, x in zip(sums, languages.weights[h], strict=True)]
        own = max(range(2), key=lambda k: (sums[k] / count + languages.bias[k], -k)) if count else -1
        return 1 / (1 + np.exp(-(z - m.thresholds.get(own, m.thresholds[-1]) + np.log(0.7 / 0.3))))

    some = [*texts[:25], "", "new words only", "vile1"]
    assert np.allclose(m.scores(some, v), [by_hand(t) for t in some], atol=1e-4)


def test_toxicity_of_long_texts(monkeypatch):
    """Blocks of words change nothing."""
    texts, y = corpus(200, 1)
    m = toxicity.train(texts, y, toxicity.ToxicConfig(bits=10, passes=2))
    v = toxicity.Vocabulary(m.config)
    long = [" ".join(texts[:150]), texts[0], "", " ".join(texts[50:]), " ".join(texts[1:90:3])]
    whole = m.scores(long, v)
    for block in (7, 64):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(m.scores(long, v), whole)


def test_toxicity_is_learned():
    """Training matters: before it, a network tells nothing."""
    texts, y = corpus(600, 2)
    y = np.array(y)
    got = []
    for passes in (0, 8):
        m = toxicity.train(texts[:400], y[:400].tolist(), toxicity.ToxicConfig(passes=passes))
        got.append(auc(m.scores(texts[400:], toxicity.Vocabulary(m.config)), y[400:]))
    assert got[0] < 0.75 and got[1] > 0.98


def test_quality_equals_loops():
    import zstandard

    texts = [f"some plain words {k} and more of them " * (k % 9) if k % 2 else f"!!$$ {k * 7919} %%&& !!$$ " * (k % 9 + 1) for k in range(200)]
    m = quality.train(texts, [k % 2 for k in range(200)], quality.QualityConfig(dictionary=2048))

    def by_hand(text):
        raw, out = text.encode(), m.weights[0]
        at, bad, good = 1, 0, 0
        for k, chunk in enumerate([*m.config.chunks, None, 0]):
            pair, sizes = m.pairs[min(k, len(m.pairs) - 1)], []
            chunk = max(1, len(raw)) if chunk is None else chunk
            for d in pair:
                params = zstandard.ZstdCompressionParameters.from_level(m.config.level, write_checksum=False, write_content_size=False, write_dict_id=False)
                made = zstandard.ZstdCompressionDict(d)
                made.precompute_compress(level=m.config.level)
                sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress(raw[i : i + chunk])) for i in range(0, len(raw) if chunk else 0, chunk or 1)))
            good = sizes[0] if k < len(m.pairs) else good  # the text as one piece is set against its last chunks
            bad = sizes[1] if chunk or not raw else len(raw)  # at last, the text as it is
            d = (bad - good) / (bad + good) if raw else 0.0
            x = (d - m.mean[k]) / m.scale[k]
            for q in [x, *[max(0.0, x - knot) for knot in m.knots[k]]]:
                out += m.weights[at] * q
                at += 1
        return 1 / (1 + np.exp(-out))

    some = [*texts[:20], "", "x", "é" * 500]
    assert np.allclose(m.scores(some, m.differences()), [by_hand(t) for t in some], atol=1e-9)


def grams(text):
    """The n-grams of a text by hand: letters lower-cased, runs of anything else one blank, a blank before and after."""
    out, codes = [], [" "]
    for c in text:
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or codes[-1] != " ":
            codes.append(c)
    if codes[-1] != " ":
        codes.append(" ")
    for n in (1, 2, 3):
        out += [tuple(codes[k : k + n]) for k in range(len(codes) - n + 1) if n > 1 or codes[k] != " "]
    return out


def test_language_equals_loops():
    rows = [(l, *map(np.asarray, np.unique(langid.features([t], 18)[0].astype(np.int64), return_counts=True))) for l, t in [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chien et le chat")] * 30]
    m = langid.train(rows, langid.LangConfig())

    def by_hand(text):
        own = grams(text)
        hashes = {g: langid.features(["".join(g)], 18) for g in set(own)}
        z = [float(b) for b in m.bias]
        for g in own:
            h = code(g)
            z = [x + float(w) / len(own) for x, w in zip(z, m.weights[h], strict=True)]
        e = np.exp(np.array(z) / m.temperature - max(z) / m.temperature)
        return (e / e.sum()) if hashes else e

    def code(g):
        """The hash of one n-gram, step by step."""
        mask, rolled = 0xFFFFFFFF, ord(g[0]) * 0x9E3779B1 & 0xFFFFFFFF
        if len(g) == 1:
            return (rolled * 0x85EBCA6B & mask) >> 14
        for n, c in enumerate(g[1:], 2):
            rolled = ((rolled ^ (rolled >> 15)) * 0x2C1B3C6D + ord(c)) & mask
        return ((rolled ^ (rolled >> 13)) * (0x85EBCA6B + 2 * n) & mask) >> 14

    for text in ("the cat", "Der HUND, und!", "le  chat é", "a", "x y z", " dog. "):
        assert np.allclose(m.probabilities([text])[0][0], by_hand(text), atol=1e-6), text


@pytest.mark.parametrize("chars", [1, 2, 5, 17])
def test_language_features_of_long_texts_by_parts(chars):
    texts = ["ab c d", "", "Éa--b      ............................................ x yz", "abcdefgh" * 9, " x", "...", "a" + " " * 90 + "b", "one two three four five"]
    want = langid.features(texts, 18)
    for k in range(len(texts)):
        held, has = {}, False
        for h, of, sign, letter in langid.counted(texts, 18, chars):
            has |= letter[k]
            for x, s in zip(h[of == k].tolist(), sign[of == k].tolist(), strict=True):
                held[x] = held.get(x, 0) + s
        u, c = np.unique(want[0][want[1] == k], return_counts=True)
        assert {x: n for x, n in held.items() if n} == dict(zip(u.tolist(), c.tolist(), strict=True)) and has == want[2][k]


def test_samples_are_bounded_and_do_not_depend_on_partitions(spark):
    from stratalake.llm.common import bounded, labelled_sample

    hot = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("hot text "), F.col("id")).alias("text"))
    docs = hot.unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text")))
    docs = docs.unionByName(docs.where("doc_id > 200"))  # repeated rows
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = [labelled_sample(docs.repartition(n), labels, F.lit(True), "toxic", 500, 20_000, 1) for n in (2, 7)]
    assert got[0] == got[1] and 400 < len(got[0]) <= 500
    small = labelled_sample(docs, labels, F.lit(True), "toxic", 5000, 3000, 1)
    assert 0 < sum(len(t) for t, _ in small) <= 3000
    assert bounded(spark.range(5).withColumn("n", F.lit(10)), ["id"], "n", 10, 5).count() == 0


def peak_mb(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_a_fit_leaves_the_driver_its_memory():
    """Beside its input, a fit holds neither features of all rows nor embeddings of all words."""
    rng = np.random.default_rng(6)
    rows = [("ab"[k % 2], rng.choice(1 << 12, 2000, replace=False), np.ones(2000, np.int64)) for k in range(400)]
    assert peak_mb(lambda: langid.train(rows, langid.LangConfig(bits=12, passes=1))) < 5
    texts = [" ".join(f"w{k}x{j}" for j in range(400)) for k in range(150)]
    config = toxicity.ToxicConfig(bits=8, passes=1, steps=1)
    numbered = toxicity.Vocabulary(config)(texts)
    assert peak_mb(lambda: toxicity._train(numbered, [k % 2 for k in range(150)], config, None)) < 15


def test_a_very_long_text(spark):
    """Five million characters in one row, next to an empty one."""
    long = "Word by word, the text goes on and on. " * 130_000
    df = spark.createDataFrame([(1, long), (2, "")], "doc_id bigint, text string")
    texts, y = corpus(60)
    rows = [(l, *map(np.asarray, np.unique(langid.features([t], 18)[0].astype(np.int64), return_counts=True))) for l, t in [("en", "the text goes on"), ("de", "der hund und die katze")] * 30]
    languages = langid.train(rows, langid.LangConfig())
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, languages).collect()} == {1: "en", 2: "und"}
    assert toxicity.score(df, toxicity.train(texts, y, toxicity.ToxicConfig(bits=10, passes=1), languages)).count() == 2
    assert quality.score(df, quality.train(texts, y, quality.QualityConfig())).count() == 2
