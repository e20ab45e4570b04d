"""Items of several segments: one short or answer-only segment is no leak, and slices change nothing."""

import random

import pytest
from tables import SF

from stratalake.llm import decontaminate as D


def leaked(item, *texts):
    return [[x[0] for x in found] for found in D.Index([item], D.LeakConfig()).leaks(list(texts))]


def test_a_last_word_is_no_leak():
    question = [f"q{k}" for k in range(64)]
    text = " ".join(question)
    for question, answer in ((question, ["yes"]), ([*question, "the"], [])):
        assert leaked((1, question, answer), "yes and the other words", f"before {text} the yes after") == [[], [1]]


def test_question_and_answer_of_long_items():
    question, answer = [f"q{k}" for k in range(100)], [f"a{k}" for k in range(100)]
    q, a, gap = " ".join(question), " ".join(answer), " ".join(f"f{k}" for k in range(150))
    assert leaked((1, question, answer), f"{gap} {a} {gap}", f"{gap} {q} {gap}", f"{gap} {q} {a} {gap}") == [[], [], [1]]


def test_parts_far_apart_count_together():
    question, answer = [f"q{k}" for k in range(128)], [f"a{k}" for k in range(64)]
    far = " ".join(f"f{k}" for k in range(3000))
    one, two, a = " ".join(question[:64]), " ".join(question[64:]), " ".join(answer)
    assert leaked((1, question, answer), f"{one} {far} {two} {far} {a}", f"{one} {far} {two}") == [[1], []]


@pytest.mark.parametrize("size", [20, 64, 65, 130, 1000])
def test_question_alone_or_answer_alone_is_no_leak(size):
    question, answer = [f"q{k}" for k in range(size)], ["forty", "two"]
    q, far = " ".join(question), " ".join(f"f{k}" for k in range(400))
    texts = ["the train had forty seats and two doors in a row", "forty two", f"{far} {q} {far}", f"{far} {q} forty two {far}", f"{q} {far} {far} {far}"]
    assert leaked((1, question, answer), *texts) == [[], [], [], [1], []]
    # half of the question, with the answer, is a leak wherever the parts are near each other
    half = " ".join(question[: size // 2 + 4])
    assert leaked((1, question, answer), f"{far} {half} forty two {far}")[0] in ([1], [])


def test_items_of_one_or_two_words_leak_nowhere():
    for question, answer in ((["the"], []), ([], ["yes"]), (["who"], ["me"])):
        assert leaked((1, question, answer), "the yes who me", "the", "who me") == [[], [], []]
    assert leaked((1, ["who", "is"], ["it"]), "who is it", "it is who") == [[1], []]


@pytest.mark.parametrize("slice_items", [1, 7, 20_000])
def test_slices_do_not_change_the_leaks(spark, slice_items):
    rng = random.Random(3)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(25)
    rows = bench.collect()
    more = spark.createDataFrame([(900, " ".join(f"v{rng.randrange(300)}" for _ in range(150)) + ". Forty two."), (None, rows[0]["text"]), (None, rows[1]["text"]), (901, "a b"), (rows[2]["item_id"], rows[3]["text"])], "item_id bigint, text string")
    bench = bench.unionByName(more).unionByName(bench)
    docs = []
    for k, r in enumerate(bench.collect()):
        words = r["text"].split()
        for share in (0.5, 0.7, 1.0):
            docs.append((k, " ".join(f"f{rng.randrange(999)}" for _ in range(90)) + " " + " ".join(words[: int(len(words) * share)]) + " end"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = D.Index([(r["item_id"], *D.split_item(r["text"])) for r in bench.collect()], D.LeakConfig())
    found = sorted(((d, *x) for (d, t), own in zip(docs, want.leaks([t for _, t in docs]), strict=True) for x in own), key=str)
    got = sorted((tuple(r) for r in D.leaks(df, bench, D.LeakConfig(slice_items=slice_items, scan_slices=3)).collect()), key=str)
    assert len(found) > 40
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in found]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, found, strict=True))
