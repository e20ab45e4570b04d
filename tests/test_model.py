"""Seeded operation tapes against plain Python models, and the rules of each write."""

import random

import pytest
from pyspark.sql import functions as F

from stratalake.operators import gc, mutations, pages, tree
from stratalake.operators.closure import ChainDepthExceeded, ascend
from stratalake.schema import PRUNED

NODE = "experiment_id string, node_id bigint, parent_node_id bigint, depth int, snapshot_ref string, input_log_id string, status int, score double, visit_count bigint, created_at bigint, updated_at bigint"


def node(e, i, p, d, ref="s", log=None, status=0, score=None, t=0):
    return (e, i, p, d, ref, log, status, score, 0, t, t)


@pytest.fixture(scope="module")
def mini(spark):
    """Two trees of one shape: 0 -> 1, 2; 1 -> 3; 3 -> 4."""
    shape = [(0, None, 0), (1, 0, 1), (2, 0, 1), (3, 1, 2), (4, 3, 3)]
    rows = [node(e, i, p, d, f"m{i}", f"l{i}" if i % 2 else None, i % 3, float(i), i + 1) for e in ("a", "b") for i, p, d in shape]
    return spark.createDataFrame(rows, NODE)


def keys(df):
    return {(r["experiment_id"], r["node_id"]) for r in df.collect()}


def test_scopes_do_not_mix(spark, mini):
    assert keys(tree.get_children(mini, "a", 0)) == {("a", 1), ("a", 2)}
    path = tree.get_path(mini, spark.createDataFrame([("b", 4)], "experiment_id string, node_id bigint"))
    assert [r["node_id"] for r in path.orderBy("depth").collect()] == [0, 1, 3, 4]
    assert tree.get_path(mini, spark.createDataFrame([("b", 99)], "experiment_id string, node_id bigint")).count() == 0
    below = tree.subtree(mini, spark.createDataFrame([("a", 1), ("a", 77)], "experiment_id string, node_id bigint"))
    assert keys(below) == {("a", 1), ("a", 3), ("a", 4)}


def test_cursor_misses_nothing(spark, mini):
    tied = mini.withColumn("updated_at", F.lit(7))
    seen, cursor = [], None
    while part := tree.page_after(tied, "a", "updated_at", cursor, 2).collect():
        seen += [r["node_id"] for r in part]
        cursor = (part[-1]["updated_at"], part[-1]["node_id"])
    assert seen == [0, 1, 2, 3, 4]


def test_limits():
    assert [tree.effective_limit(x) for x in (None, 0, 3, 9999)] == [512, 512, 3, 4096]
    with pytest.raises(ValueError):
        tree.query_nodes(None, "a", order="score")


def test_chain_cap_and_cycles(spark):
    links = spark.createDataFrame([(i, i + 1 if i < 30 else None) for i in range(31)], "id int, parent int")
    start = spark.createDataFrame([(0,)], "start int")
    assert ascend(links, start).count() == 31
    with pytest.raises(ChainDepthExceeded):
        ascend(links, start, cap=16)
    loop = spark.createDataFrame([(0, 1), (1, 0)], "id int, parent int")
    with pytest.raises(ChainDepthExceeded):
        ascend(loop, start, cap=8)


def test_deep_trees_have_no_cap(spark):
    """A path of 10,000 nodes; a cycle is still an error."""
    nodes = spark.range(10_000).selectExpr("'a' AS experiment_id", "id AS node_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_node_id")
    start = spark.createDataFrame([("a", 9_999)], "experiment_id string, node_id bigint")
    assert tree.get_path(nodes, start).count() == 10_000
    loop = nodes.where("node_id < 9").withColumn("parent_node_id", F.coalesce("parent_node_id", F.lit(8)))
    with pytest.raises(ChainDepthExceeded):
        tree.get_path(loop, start.withColumn("node_id", F.lit(3).cast("long"))).count()
    with pytest.raises(ChainDepthExceeded):
        tree.subtree(loop, start.withColumn("node_id", F.lit(3).cast("long"))).count()


def test_replayed_create_fails_under_a_pruned_parent(spark, mini):
    pruned = mini.withColumn("status", F.when(F.col("node_id") == 1, PRUNED).otherwise(0))
    ask = spark.createDataFrame([(0, "a", 3, 1, "m3", "l3"), (1, "a", 2, 0, "m2", None), (2, "a", 2, 0, "x", None), (3, "", 9, None, "s", None)], "ordinal bigint, experiment_id string, node_id bigint, parent_node_id bigint, snapshot_ref string, input_log_id string")
    logs = spark.createDataFrame([("l3",)], "log_id string")
    got = {r["ordinal"]: r["outcome"] for r in mutations.create_outcomes(pruned, ask, logs).collect()}
    assert got == {0: "PARENT_PRUNED", 1: "EXISTING", 2: "ALREADY_EXISTS", 3: "INVALID"}


def test_updates_are_all_or_nothing(spark, mini):
    up = spark.createDataFrame([(0, "a", 1, 2, None, 5), (1, "a", 1, None, 9.0, -2), (2, "a", 99, 1, None, None)], "ordinal bigint, experiment_id string, node_id bigint, status int, score double, visit_delta bigint")
    assert keys(mutations.missing_nodes(mini, up)) == {("a", 99)}
    with pytest.raises(mutations.MissingNodes):
        mutations.apply_updates(mini, up, 50)
    after = mutations.apply_updates(mini, up.where("node_id = 1"), 50)
    r = after.where("experiment_id = 'a' AND node_id = 1").first()
    assert (r["status"], r["score"], r["visit_count"], r["updated_at"]) == (2, 9.0, 3, 50)
    assert after.where("updated_at = 50").count() == 1


def test_prune_then_reap(spark, mini):
    marks = spark.createDataFrame([], "experiment_id string, node_id bigint, created_at bigint")
    start = lambda *x: spark.createDataFrame(list(x), "experiment_id string, node_id bigint")
    nodes, marks, told = mutations.prune(mini, marks, start(("a", 0), ("a", 1), ("a", 8)), 9)
    assert {(r["node_id"], r["outcome"], r["pruned"]) for r in told.collect()} == {(0, "ROOT_DENIED", 0), (1, "PRUNED", 3), (8, "NOT_FOUND", 0)}
    nodes, marks, told = mutations.prune(nodes, marks, start(("a", 3)), 10)  # pruned rows count and are stamped again
    assert told.first()["pruned"] == 2
    after, left, told = mutations.reap(nodes, marks, marks.where("node_id = 1"))
    assert told.first()["reaped"] == 3 and keys(after.where("experiment_id = 'a'")) == {("a", 0), ("a", 2)}
    _, left, told = mutations.reap(after, left, left)  # the inner root is gone: its tombstone goes too
    assert told.first()["outcome"] == "GONE" and left.count() == 0
    refused = mutations.reap(mini, marks, marks)[2]
    assert {r["outcome"] for r in refused.collect()} == {"REFUSED"}


def test_ingest_tape(spark):
    rng = random.Random(3)
    arrivals = [(k, f"h{rng.randrange(40)}") for k in range(200)]
    stored = {f"h{k}" for k in range(0, 40, 3)}
    df = spark.createDataFrame(arrivals, "ordinal bigint, page_hash string")
    index = spark.createDataFrame([(h, 0, 20) for h in stored], "page_hash string, pack_id int, offset bigint")
    want, seen = {}, set(stored)
    for k, h in arrivals:
        want[k] = h not in seen
        seen.add(h)
    out = pages.ingest(df, index)
    assert {r["ordinal"]: r["newly_written"] for r in out.collect()} == want
    placed = pages.stored(out, 4, 5).collect()
    order = [h for k, h in arrivals if want[k]]
    assert {r["page_hash"]: (r["pack_id"], r["offset"]) for r in placed} == {h: (4 + k // 5, 20 + 4133 * (k % 5)) for k, h in enumerate(order)}


def test_kv_tape(spark):
    rng = random.Random(4)
    state = {f"k{k}": (k % 3 + 1, "old") for k in range(5)}
    kv = spark.createDataFrame([(k, v, g, 0) for k, (g, v) in state.items()], "key string, value string, generation bigint, updated_at bigint")
    cmds = [(k, f"k{rng.randrange(9)}", rng.choice(["put", "put", "delete"]), f"v{k}", rng.choice([None, None, 0, 1, 2])) for k in range(150)]
    want = {}
    for k, key, op, value, expected in cmds:
        g, v = state.get(key, (None, None))
        if op == "put":
            if expected is not None and expected != (g or 0):
                out = "CONFLICT"
            else:
                state[key], out = ((g or 0) + 1, value), "STORED"
        elif g is None:
            out = "ABSENT"
        elif expected is not None and expected != g:
            out = "CONFLICT"
        else:
            del state[key]
            out = "DELETED"
        want[k] = (out, *state.get(key, (None, None)))
    df = spark.createDataFrame(cmds, "ordinal bigint, key string, op string, value string, expected bigint")
    got = {r["ordinal"]: (r["outcome"], r["generation"], r["value"]) for r in mutations.kv_fold(kv, df).collect()}
    assert got == want


def test_pin_keeps_its_note(spark):
    pins = spark.createDataFrame([("m1", "first", 1)], "snapshot_ref string, note string, created_at bigint")
    ask = spark.createDataFrame([(0, "m1", "second", 2), (1, "m2", "a", 2), (2, "m2", "b", 2), (3, "m9", "c", 2)], "ordinal bigint, snapshot_ref string, note string, created_at bigint")
    out = mutations.pin(pins, ask, spark.createDataFrame([("m1",), ("m2",)], "snapshot_ref string"))
    assert {r["ordinal"]: r["outcome"] for r in out.collect()} == {0: "EXISTING", 1: "PINNED", 2: "EXISTING", 3: "UNKNOWN_REF"}
    assert {(r["snapshot_ref"], r["note"]) for r in mutations.apply_pins(pins, out).collect()} == {("m1", "first"), ("m2", "a")}


@pytest.mark.parametrize("seed", range(3))
def test_gc_model(spark, seed):
    """Safety (nothing reachable goes), completeness (nothing else stays, but dead pages of kept packs), correct reads."""
    rng = random.Random(seed)
    layers, entries = [], []
    for m in range(25):
        parent = None if m < 4 else rng.randrange(m)
        layers.append((f"m{m}", None if parent is None else f"m{parent}", parent is not None, 8 * 4096))
        entries += [(f"m{m}", i, f"p{rng.randrange(60)}") for i in (range(8) if parent is None else rng.sample(range(8), 3))]
    nodes = [node("e", i, None if i == 0 else rng.randrange(i), 0, f"m{rng.randrange(25)}", None, 0) for i in range(12)]
    stones = {rng.randrange(1, 12) for _ in range(3)}

    def below(i):
        return {i} | {x for n in nodes if n[2] == i for x in below(n[1])}

    pruned = {x for s in stones for x in below(s)}
    nodes = [n[:6] + (PRUNED if n[1] in pruned else 0,) + n[7:] for n in nodes]
    all_pages = sorted({p for _, _, p in entries})
    index = [(p, k // 7, 20 + 4133 * (k % 7)) for k, p in enumerate(all_pages)]
    top = max(x[1] for x in index)
    pin = f"m{rng.randrange(25)}"
    t = {
        "nodes": spark.createDataFrame(nodes, NODE),
        "tombstones": spark.createDataFrame([("e", s, 1) for s in stones], "experiment_id string, node_id bigint, created_at bigint"),
        "input_logs": spark.createDataFrame([], "log_id string, content string"),
        "pins": spark.createDataFrame([(pin, "", 1)], "snapshot_ref string, note string, created_at bigint"),
        "manifests": spark.createDataFrame(layers, "snapshot_ref string, parent_ref string, is_delta boolean, guest_ram_bytes bigint"),
        "manifest_entries": spark.createDataFrame(entries, "snapshot_ref string, page_index bigint, page_hash string"),
        "page_index": spark.createDataFrame(index, "page_hash string, pack_id int, offset bigint"),
    }
    done = gc.cycle(t, gc.GcOptions(grace=0), 0, top, top + 1)
    parent = {a: b for a, b, _, _ in layers}
    live = set()
    for ref in {n[4] for n in nodes if n[1] not in pruned} | {pin}:
        while ref and ref not in live:
            live.add(ref)
            ref = parent[ref]
    live_pages = {p for m, _, p in entries if m in live}
    assert keys(done.nodes) == {("e", n[1]) for n in nodes if n[1] not in pruned}
    assert {r[0] for r in done.manifests.select("snapshot_ref").collect()} == live
    want = {}
    for p, pack, off in index:
        own = [q for q, k, _ in index if k == pack]
        n = sum(q in live_pages for q in own)
        if pack >= top or (n and n / len(own) >= 0.5):
            want[p] = (pack, off)
    got = {r["page_hash"]: (r["pack_id"], r["offset"]) for r in done.index.collect()}
    assert live_pages <= set(got)
    assert {p: x for p, x in got.items() if p in want} == want
    assert set(got) == set(want) | live_pages
    assert len(set(got.values())) == len(got)


def test_damaged_chain_stops_the_sweep(spark):
    layers = spark.createDataFrame([("m1", "gone")], "snapshot_ref string, parent_ref string")
    with pytest.raises(gc.MissingManifest):
        gc.mark(layers, spark.createDataFrame([("m1",)], "snapshot_ref string"))
    live, missing = gc.mark(layers.withColumn("parent_ref", F.lit(None).cast("string")), spark.createDataFrame([("m1",), ("m7",)], "snapshot_ref string"))
    assert [r[0] for r in live.collect()] == ["m1"] and [r[0] for r in missing.collect()] == ["m7"]
