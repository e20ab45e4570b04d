"""Leaks: WAND against brute-force BM25, planted items, clean documents."""

import random
from collections import Counter

import pytest
from tables import SF

from stratalake.llm import decontaminate as D
from stratalake.llm import queries
from stratalake.llm.common import words_of

BIG = SF.replace("0.001", "0.01")


def items(spark):
    return [(r["item_id"], *D.split_item(r["text"])) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()]


@pytest.mark.parametrize("block", [1, 4, 32])
def test_wand_equals_brute_force(spark, block):
    index = D.Index(items(spark), D.LeakConfig(block=block, threshold=0.4))
    rng = random.Random(block)
    found = 0
    for _ in range(200):
        s = rng.choice(index.segments)
        terms = {index.terms[w] for w in s.question + s.answer if rng.random() < 0.6} | {rng.randrange(len(index.terms)) for _ in range(60)}
        scores = Counter()
        for t in terms:
            for i, w in zip(*index.postings[t][:2], strict=True):
                scores[i] += w
        want = sorted(i for i, x in scores.items() if x >= 0.4 - 1e-9)
        assert sorted(i for i, _ in index.retrieve(sorted(terms))) == want
        found += len(want)
    assert found > 100


def test_query_finds_what_brute_force_finds(spark):
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, BIG).collect()}
    bench = {r["item_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()}
    grams = {i: set(zip(w, w[1:], w[2:], w[3:], strict=False)) for i, w in bench.items()}
    want = set()
    for r in spark.read.parquet(f"{BIG}/documents.parquet").collect():
        w = words_of(r["text"])
        have = set(zip(w, w[1:], w[2:], w[3:], strict=False))
        want |= {(r["doc_id"], i) for i, g in grams.items() if len(g & have) >= 0.5 * len(g)}
    assert got == want and len(got) > 10


def planted(rng, item, changes):
    words = [f"f{rng.randrange(5000)}" for _ in range(700)]
    own = item.split()
    for k in rng.sample(range(len(own)), changes):
        own[k] = "changed"
    at = rng.randrange(650)
    return " ".join(words[:at] + own + words[at:])


def test_planted(spark):
    rng = random.Random(7)
    bench = spark.read.parquet(f"{BIG}/benchmark.parquet")
    rows = bench.collect()
    docs = [(k, planted(rng, r["text"], 0)) for k, r in enumerate(rows)] + [(100 + k, planted(rng, r["text"], 1)) for k, r in enumerate(rows)] + [(1000 + k, " ".join(f"f{rng.randrange(5000)}" for _ in range(500))) for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()}
    assert {(k, r["item_id"]) for k, r in enumerate(rows)} <= got
    assert not [x for x in got if x[0] >= 1000]
    assert {r["doc_id"] for r in D.without_leaks(df, bench).collect()} == {i for i, _ in docs} - {d for d, _ in got}


def test_long_items_and_slices(spark):
    rng = random.Random(8)
    long = " ".join(f"q{rng.randrange(10**6)}" for _ in range(150))
    bench = spark.createDataFrame([(1, long), (1, long), (2, "Is this it? Yes it is."), (3, ""), (4, None), (None, "some item without any number at all")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"before {long} after"), (2, "Nothing."), (3, "x some item without any number at all y"), (3, "x some item without any number at all y")], "doc_id bigint, text string")
    for config in (D.LeakConfig(), D.LeakConfig(slice_items=2)):
        got = sorted(((r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench, config).collect()), key=str)
        assert got == [(1, 1), (3, None), (3, None)]
    own = spark.createDataFrame([(5, "what is it", "forty two")], "n bigint, q string, a string")
    text = spark.createDataFrame([(1, "what is it forty two"), (2, "what is it then")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in D.leaks(text, own, item_id="n", question="q", answer="a").collect()] == [1]


def test_awkward(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "no id here at all")], "item_id bigint, text string")
    assert [r["doc_id"] for r in D.leaks(awkward, bench).collect()] == [None]
    assert D.without_leaks(awkward, bench).columns == awkward.columns
    assert D.without_leaks(awkward, bench).count() == 10
    assert D.leaks(nothing, bench).count() == 0
    assert D.leaks(awkward, bench.where("false")).count() == 0
    assert D.without_leaks(awkward, bench.where("false")).count() == 11
