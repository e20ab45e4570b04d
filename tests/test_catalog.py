"""Generations, the command line over them, and streams into them."""

import io
import json
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from stratalake import cli
from stratalake.schema import NODES, from_hex, hex_text, signed, status_code, status_name, unsigned
from stratalake.sources.catalog import Catalog, ConflictingCommit
from stratalake.streaming import ingest


def ref(k):
    return bytes([k]) * 32


@pytest.fixture
def store(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/store")
    rows = [("e", i, None if i == 0 else (i - 1) // 2, 0 if i == 0 else 1, ref(1), None, 0, 0.5, 0, 0, 0, i, i, 0, None) for i in range(5)]
    layers = spark.createDataFrame([(ref(1), 1, False, None, 4096, 1, None, None)], "snapshot_ref binary, version int, is_delta boolean, parent_ref binary, guest_ram_bytes bigint, entry_count bigint, device_blob struct<format: bigint, zstd: boolean, bytes: binary, raw_len: bigint>, container binary")
    tables = {
        "nodes": spark.createDataFrame(rows, NODES),
        "manifests": layers,
        "manifest_entries": spark.createDataFrame([(ref(1), 0, ref(9))], "snapshot_ref binary, page_index bigint, page_hash binary"),
        "page_index": spark.createDataFrame([(ref(9), 0, 20), (ref(8), 0, 4153)], "page_hash binary, pack_id int, offset bigint"),
        "pages": spark.createDataFrame([(ref(9), b"x", 0, 20), (ref(8), b"y", 0, 4153)], "page_hash binary, payload binary, pack_id int, offset bigint"),
    }
    c.commit(c.snapshot(), tables, logical_counter=10)
    return c


def run(store, *argv):
    out = io.StringIO()
    with redirect_stdout(out):
        code = cli.main([store.root, *argv])
    return code, [json.loads(x) for x in out.getvalue().splitlines()]


def test_generations(spark, store):
    old = store.snapshot()
    assert old.number == 1 and old.table("pins").count() == 0
    store.commit(old, {"nodes": old.table("nodes").where("node_id < 2")})
    assert store.snapshot().table("nodes").count() == 2
    assert old.table("nodes").count() == 5  # a reader keeps its generation
    with pytest.raises(ConflictingCommit):
        store.commit(old, {"nodes": old.table("nodes")})
    assert len(store.vacuum()) == 1
    assert store.snapshot().table("manifests").count() == 1


def test_command_line(store):
    assert run(store, "stats")[1][0]["nodes_total"] == 5
    assert [r["node_id"] for r in run(store, "query", "e", "--min-depth", "1", "--limit", "3")[1]] == [1, 2, 3]
    assert run(store, "get-node", "e", "3")[1][0]["parent_node_id"] == 1
    assert run(store, "dump-manifest", ref(1).hex().upper())[1][1]["page_hash"] == ref(9).hex()
    assert run(store, "pin", ref(1).hex(), "--note", "n")[1] == [{"outcome": "PINNED"}]
    assert run(store, "unpin", ref(1).hex())[1] == [{"outcome": "REMOVED"}]
    assert run(store, "kv", "put", "k", "v", "--expected", "0") == (0, [{"outcome": "STORED"}])
    assert run(store, "kv", "put", "k", "v", "--expected", "7") == (1, [{"outcome": "CONFLICT"}])
    assert run(store, "kv", "get", "k")[1][0]["generation"] == 1
    assert run(store, "kv", "delete", "k")[1] == [{"outcome": "DELETED"}]
    assert run(store, "prune", "e", "0")[0] == 1
    assert run(store, "prune", "e", "1")[1] == [{"pruned": 3}]
    assert run(store, "fsck") == (0, [])
    report = run(store, "gc", "--aggressive")[1][0]
    assert report["packs_compacted"] == 1 and report["pages_reclaimed"] == 1
    assert [bytes(r["payload"]) for r in store.snapshot().table("pages").collect()] == [b"x"]


def test_stream_into_a_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/store")
    source = spark.createDataFrame([(k, bytes([k % 3]) * 32, bytes([k % 3])) for k in range(9)], "ordinal bigint, page_hash binary, payload binary")
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    batch = ingest.ingest_into(c, 2)
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert c.snapshot().table("pages").count() == 3
    batch(source, 0)  # the same batch again adds nothing
    assert c.generation() == 1


def test_stateful_commands(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "put", "x", None), ("a", 1, "put", "y", 1), ("a", 2, "put", "z", 1), ("b", 3, "delete", None, None)], "key string, ordinal bigint, op string, value string, expected bigint")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = ingest.kv_state(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("kv_out").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert {(r["ordinal"], r["outcome"], r["generation"]) for r in spark.table("kv_out").collect()} == {(0, "STORED", 1), (1, "STORED", 2), (2, "CONFLICT", 2), (3, "ABSENT", None)}


def test_values(spark):
    df = spark.createDataFrame([("PRUNED", 3), ("nothing", 0), (None, 1)], "name string, code int")
    assert [tuple(r) for r in df.select(status_code(F.col("name")), status_name(F.col("code"))).collect()] == [(3, "PRUNED"), (0, "FRONTIER"), (0, "EXPANDED")]
    big = spark.sql("SELECT cast(18446744073709551615 AS decimal(20,0)) AS x")
    assert big.select(signed(F.col("x")).alias("s")).select("s", unsigned(F.col("s"))).first() == (-1, 18446744073709551615)
    text = spark.createDataFrame([("AB" * 32,), ("zz",)], "x string")
    assert [r[0] for r in text.select(hex_text(from_hex(F.col("x")))).collect()] == ["ab" * 32, None]
