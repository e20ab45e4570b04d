"""The join against brute force over all pairs."""

import numpy as np
import pytest

from stratalake.llm import ngram_join as N
from stratalake.llm.common import WordHash, words_of

from texts import sentence


def brute(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = words_of(t or "")
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    links = {}
    for i, a in enumerate(sets):
        links[i] = {j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9}
    return links


def copies(seed, n_groups=12):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n_groups):
        base = sentence(rng, int(rng.integers(3, 200))).split()
        for _ in range(int(rng.integers(1, 12))):
            words = list(base)
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(1000)}"
            texts.append(" ".join(words))
    return texts + ["", None, "one two"]


@pytest.mark.parametrize("config", [N.JoinConfig(), N.JoinConfig(bucket=3, block_grams=400), N.JoinConfig(block_rows=2)])
def test_links_equal_brute_force(spark, config):
    texts = copies(1)
    links = brute(texts)
    got = {r["doc_id"]: r for r in N.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), config).collect()}
    assert {i: r["links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    group = {}

    def reach(i):
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        return seen

    for i in links:
        group[i] = min(reach(i))
    assert {i: r["class_id"] for i, r in got.items()} == group


def test_one_hot_group_of_near_copies(spark):
    """Three hundred texts that differ in a word each: every pair is linked, no pair is a row."""
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join([*base[:k % 100], f"x{k}", *base[k % 100 + 1 :]]) for k in range(300)] + [" ".join(base)] * 200
    links = brute(texts)
    got = {r["doc_id"]: r["links"] for r in N.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: len(x) for i, x in links.items()}


def test_a_chain_of_near_copies(spark, monkeypatch):
    """Each text is alike to its neighbours alone: buckets are dealt, not pairs of blocks of the whole component."""
    words = [f"w{k}" for k in range(1800)]
    texts = [" ".join(words[4 * k : 4 * k + 120]) for k in range(400)]
    links = brute(texts)
    assert 2 <= max(len(x) for x in links.values()) < 12
    dealt = {}
    monkeypatch.setattr(N, "_dealt", lambda rows, home, *a, own=N._dealt: dealt.update({home: rows.count()}) or own(rows, home, *a))
    got = {r["doc_id"]: r for r in N.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), N.JoinConfig(block_rows=2)).collect()}
    assert {i: r["links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {r["class_id"] for r in got.values()} == {0}
    assert dealt["bucket"] > 100 and dealt["root"] < 20


def test_awkward(spark, awkward, nothing):
    got = N.jaccard_join(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted(r["links"] for r in got) == [0] * 9 + [1, 1]
    assert N.jaccard_join(nothing).count() == 0
    kept = N.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == 10


def test_one_of_each(spark):
    texts = copies(2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    links = brute(texts)
    kept = {r["doc_id"] for r in N.one_of_each(df).collect()}
    assert all(i in kept or min(links[i] | {i}) != i for i in links)
    assert all(not (links[i] & kept) for i in kept)
    assert all(i in kept for i in links if not links[i])


def test_pruning_keeps_what_the_posterior_keeps():
    table = N.least_matches(N.JoinConfig())
    assert all(a[1] <= b[1] for a, b in zip(table, table[1:], strict=False))
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(3000):  # pairs at the threshold
        equal = rng.random(160) < 0.8
        lost += any(equal[:n].sum() < m for n, m in table)
    assert lost == 0


def test_minhash_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    other = np.concatenate([base[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    v = N.MinHasher(N.JoinConfig())([np.unique(base), np.unique(other)])
    assert abs((v[0] == v[1]).mean() - 0.6) < 0.12


def test_grams():
    h = WordHash(0)
    a, b, c, d = N.gram_sets(["a b c d e f", "A, b; c d e f!", "a b", ""], 5, h)
    assert (a == b).all() and len(a) == 2 and len(c) == 1 and len(d) == 0
