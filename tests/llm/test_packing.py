"""Packing: an exact round trip of ids, gapless places, and close to the fewest sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratalake.llm import packing as K

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    letters = "aeT'sd.,!?_-éÉßİΣς ñ1२½́​ \n\t\x1d\x07ｆ字$%''ve<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(4000)] + ["", "<|endoftext|> a", "don't WE'LL they've", "ΑΣ ΣΑΣ", "é É"]
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    got = K.WordTokenizer(PATH).encode(texts)
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_letters_go_to_the_merges_alone(monkeypatch):
    """Words of lower-case Latin letters, each letter included, have the tokenizer's ids without its normalisers and split."""
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    rng = random.Random(4)
    words = letters + [f"a{c}" for c in letters] + ["".join(rng.choice(letters if k % 2 else "aeionrst") for _ in range(rng.randrange(1, 16))) for k in range(6000)]
    w = K.WordTokenizer(PATH)
    want = {c: w.ids(c).tobytes() for x in words for c in w.chunks(x)}
    whole, ids = [], w.ids
    monkeypatch.setattr(w, "ids", lambda text: whole.append(text) or ids(text))
    w.learn(list(want))
    assert {c: w.known[c] for c in want} == want
    assert not any(K.PLAIN.fullmatch(c) for text in whole for c in text.split() if c != K.MARK)


def test_a_tokenizer_of_another_kind_is_used_as_it_is():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    own = K.WordTokenizer(path)
    assert not own.by_chunk
    assert np.frombuffer(own.encode(["a  b\n"])[0], "<u4").tolist() == own.own.encode("a  b\n", add_special_tokens=False).ids


def checked(rows, texts, cap):
    """The placed pieces are the documents' ids, cut at cap, in sequences without gaps."""
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), cap))
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + cap], "<u4")
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap
    return len(seqs)


def test_pack(spark):
    rng = random.Random(2)
    texts = {k: " ".join(f"word{rng.randrange(99)}" for _ in range(int(rng.lognormvariate(3, 1)))) for k in range(600)}
    texts |= {1000: None, 1001: "", 1002: "long " * 900}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    config = K.PackConfig(capacity=256, block_items=150)
    rows = K.pack_documents(df, PATH, config).collect()
    n = checked(rows, texts, 256)
    assert n <= -(-sum(r["length"] for r in rows) // 256) + 2
    again = K.pack_documents(df, PATH, config).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    with_ids = K.token_pieces(df, PATH, config).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)


def test_awkward(spark, awkward, nothing):
    rows = K.pack_documents(awkward, PATH).collect()
    assert sorted(r["doc_id"] for r in rows if r["piece"] == 0 and r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert sum(r["doc_id"] is None and r["piece"] == 0 for r in rows) == 2
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert K.pack_documents(nothing, PATH).count() == 0


def test_crossover_keeps_every_document_once():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 120) for _ in range(200)]
    parents = []
    for k in range(2):
        b = K.Bins(128)
        b.best_fit(sorted(range(200), key=lambda i, k=k: sizes[i] * (1 if k else rng.random())), sizes)
        parents.append(b)
    for child in (K.crossover(*parents, sizes, rng), K.mutate(parents[0], sizes, rng)):
        assert sorted(i for b in child.items for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) == 128 - r and r >= 0 for b, r in zip(child.items, child.room, strict=True))


def triples(seed, n=40, cap=1000):
    """Sizes that fill n bins exactly, three to a bin: hard for best fit."""
    rng, sizes = random.Random(seed), []
    for _ in range(n):
        a = rng.randrange(380, 490)
        b = rng.randrange(250, cap - a - 250)
        sizes += [a, b, cap - a - b]
    return sizes


def test_evolution_beats_best_fit():
    saved = []
    for seed in range(4):
        sizes = triples(seed)
        first = K.best_fit_decreasing(sizes, 1000)
        best = K.evolve(sizes, [], K.PackConfig(capacity=1000, population=10, generations=150), seed)
        assert sorted(i for b in best.items for i in b) == list(range(120)) and len(best.items) >= 40
        saved.append(len(first.items) - len(best.items))
    assert min(saved) >= 1 and sum(saved) >= 6


def test_islands_save_sequences(spark):
    """The whole operator on hard blocks: fewer sequences than best fit, by its report and in its result."""
    sizes = [s for seed in range(3) for s in triples(seed)]
    rows = [(k, 0, 0, s, 0, k) for k, s in enumerate(sizes)]
    pieces = spark.createDataFrame(rows, K.PIECE)
    config = K.PackConfig(capacity=1000, block_items=1000, population=8, generations=40, epochs=3)
    report = K.evolution_report(pieces, config).collect()
    assert [r["pieces"] for r in report] == [360]
    assert report[0]["least"] == 120 <= report[0]["evolved"] < report[0]["best_fit"]
    placed = K.pack(pieces, config).collect()
    assert len({r["sequence_id"] for r in placed}) == report[0]["evolved"] and len(placed) == 360


def test_replacing_keeps_documents():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.randrange(1, 60) for _ in range(14)]
        items, loose = list(range(4)), sorted((sizes[i], i) for i in range(4, 14))
        room = rng.randrange(0, 30)
        cap = sum(sizes[i] for i in items) + room
        left = K.replace_smaller(items, room, loose, sizes)
        assert sorted([*items, *(i for _, i in loose)]) == list(range(14)) and loose == sorted(loose)
        assert left == cap - sum(sizes[i] for i in items) and 0 <= left <= room
