"""The store's tables projected from the star-schema and text tables, so that SQL can express the same rows.

Each projection has its SQL next to it (``CTE``). Hashes are SHA-256 as hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 64
RAM_PAGES = 64
ZERO = "zero"
#: First node of each depth of a tree with eight children a node.
FIRST_OF_DEPTH = [(8**k - 1) // 7 for k in range(12)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, payload, page_hash, ordinal (arrival order)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # one pass over a text; cutting each block out by its number would start from the text's beginning every time
    cut = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("i", "payload"))
    return cut.select("doc_id", F.col("i").cast("bigint").alias("page_index"), "payload", F.sha2("payload", 256).alias("page_hash"), (F.col("doc_id") * 1_000_000 + F.col("i")).alias("ordinal"))


def page_index(blocks: DataFrame) -> DataFrame:
    """page_hash, pack_id, offset: where the first writer of each page put it; packs take 50 documents' pages."""
    first = blocks.groupBy("page_hash").agg(F.min("ordinal").alias("first_ordinal"))
    first = first.withColumn("pack_id", F.floor(F.col("first_ordinal") / 50_000_000).cast("int"))
    rank = F.row_number().over(Window.partitionBy("pack_id").orderBy("first_ordinal"))
    return first.select("page_hash", "pack_id", (F.lit(20) + 4133 * (rank - 1)).cast("bigint").alias("offset"))


def depth_of(node_id: Column) -> Column:
    out = F.lit(0)
    for k, first in enumerate(FIRST_OF_DEPTH):
        out = F.when(node_id >= first, F.lit(k)).otherwise(out)
    return out.cast("int")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of eight children a node, one for each event type."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    n = (F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1).cast("bigint")
    e = e.withColumn("node_id", n)
    logs = input_logs(spark, sf_dir).select(F.col("page_id").alias("node_id"), F.col("log_id"))
    out = e.join(logs, "node_id", "left")
    i = F.col("node_id")
    return out.select(
        F.col("event_type").alias("experiment_id"),
        "node_id",
        F.when(i > 0, F.floor((i - 1) / 8).cast("bigint")).alias("parent_node_id"),
        depth_of(i).alias("depth"),
        sha("snap:", F.col("event_type"), ":", (i % 97).cast("string")).alias("snapshot_ref"),
        F.col("log_id").alias("input_log_id"),
        (i % 4).cast("int").alias("status"),
        F.col("value").alias("score"),
        (F.col("event_id") % 7).alias("visit_count"),
        (F.col("event_id") + 1).alias("created_at"),
        (F.col("event_id") + 1 + F.col("event_id") % 13).alias("updated_at"),
    )


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that are one path each: conversations."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    n = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("bigint")
    c = c.withColumn("node_id", n)
    return c.select(F.col("conv_id").cast("string").alias("experiment_id"), "node_id", F.when(F.col("node_id") > 0, F.col("node_id") - 1).alias("parent_node_id"), F.col("node_id").cast("int").alias("depth"), "role")


def input_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", F.sha2("html", 256).alias("log_id"), F.col("html").alias("content"), (F.col("page_id") + 1).alias("created_at"))


def ref(key: Column | str) -> Column:
    """The hash of the layer of an order."""
    return sha("m:", (F.col(key) if isinstance(key, str) else key).cast("string"))


def page(name: Column | str) -> Column:
    """The hash of the page of that text."""
    return F.sha2(name, 256)


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of layers, a chain for each customer, a layer for each order; the first is FULL. snapshot_ref and parent_ref
    are keys of orders: operators only compare them, and keys take an eighth of the bytes of hashes. ref() has the hash."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = o.withColumn("parent_ref", F.lag("o_orderkey").over(w)).withColumn("next_key", F.lead("o_orderkey").over(w))
    return o.select(
        "o_orderkey",
        F.col("o_custkey").alias("chain"),
        F.col("o_orderkey").alias("snapshot_ref"),
        "parent_ref",
        F.col("parent_ref").isNotNull().alias("is_delta"),
        F.lit(RAM_PAGES * 4096).cast("bigint").alias("guest_ram_bytes"),
        F.col("next_key").isNull().alias("is_head"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layers() by their hashes."""
    return layers(spark, sf_dir).withColumns({"snapshot_ref": ref("snapshot_ref"), "parent_ref": ref("parent_ref")})


def layer_entries(spark: SparkSession, sf_dir: str, layers: DataFrame) -> DataFrame:
    """snapshot_ref, page_index, page_hash: the last line of each layer and index; FULL layers have every index. A layer is
    its order's key and a page its text, which page() hashes. The rows of a layer are made after the join with its lines,
    as the size of what explode() makes is not known to Spark, which would broadcast it."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    l = l.withColumn("page_index", F.col("l_partkey") % RAM_PAGES)
    # the greatest (line, part, quantity) of each layer and index, without a sort
    best = l.groupBy("l_orderkey", "page_index").agg(F.max(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("b"))
    text = F.concat_ws(":", F.col("b.l_partkey").cast("string"), F.col("b.l_quantity").cast("bigint").cast("string"), F.col("b.l_linenumber").cast("string"))
    whole = F.col("b.l_partkey").isNotNull() & F.col("b.l_quantity").isNotNull() & F.col("b.l_linenumber").isNotNull()
    own = best.select(F.col("l_orderkey").alias("snapshot_ref"), "page_index", F.when(whole, text).alias("page_hash"))
    held = own.repartition("snapshot_ref").groupBy("snapshot_ref").agg(F.collect_list(F.struct("page_index", "page_hash")).alias("held"))  # one for each index
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(RAM_PAGES - 1).cast("bigint"))
    lines = F.coalesce("held", F.array().cast("array<struct<page_index: bigint, page_hash: string>>"))
    inside = F.filter(lines, lambda e: e["page_index"].between(0, RAM_PAGES - 1) & e["page_hash"].isNotNull())
    zeros = F.transform(F.array_except(every, inside["page_index"]), lambda i: F.struct(i.alias("page_index"), F.lit(ZERO).alias("page_hash")))
    both = layers.select("snapshot_ref", "is_delta").join(held, "snapshot_ref", "left")
    return both.select("snapshot_ref", F.explode(F.when(F.col("is_delta"), lines).otherwise(F.concat(inside, zeros))).alias("e")).select("snapshot_ref", "e.page_index", "e.page_hash")


def kv_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    return l.select(F.col("doc_id").cast("string").alias("key"), F.concat_ws(":", "quality", "toxic").alias("value"), (1 + F.col("quality") + F.col("toxic")).cast("bigint").alias("generation"), (F.col("doc_id") + 1).alias("updated_at"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.where("s_suppkey % 5 = 0").select(sha("m:", F.col("s_suppkey").cast("string")).alias("snapshot_ref"), F.col("s_name").alias("note"), (F.col("s_suppkey") + 1).alias("created_at"))


def pin_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_ref of the pins as in layers()."""
    return table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").cast("bigint").alias("snapshot_ref"))


def tombstones(tree: DataFrame) -> DataFrame:
    return tree.where("node_id % 100 = 11").select("experiment_id", "node_id", F.col("updated_at").alias("created_at"))


_DEPTH = " ".join(f"WHEN node_id >= {first} THEN {k}" for k, first in reversed(list(enumerate(FIRST_OF_DEPTH))))
#: The same rows in SQL, by name; a query's SQL starts with those that it needs.
CTE = {
    "page_blocks": f"page_blocks AS (SELECT doc_id, i AS page_index, substr(text, 1 + {BLOCK} * i, {BLOCK}) AS payload, sha256(substr(text, 1 + {BLOCK} * i, {BLOCK})) AS page_hash, doc_id * 1000000 + i AS ordinal FROM (SELECT doc_id, text, unnest(range(0, (length(text) + {BLOCK - 1}) // {BLOCK})) AS i FROM documents))",
    "page_index": "page_index AS (SELECT page_hash, pack_id, CAST(20 + 4133 * (row_number() OVER (PARTITION BY pack_id ORDER BY first_ordinal) - 1) AS BIGINT) AS \"offset\" FROM (SELECT page_hash, min(ordinal) AS first_ordinal, CAST(min(ordinal) // 50000000 AS INT) AS pack_id FROM page_blocks GROUP BY page_hash))",
    "input_logs": "input_logs AS (SELECT page_id, sha256(html) AS log_id, html AS content, page_id + 1 AS created_at FROM pages)",
    "nodes": f"numbered AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS node_id FROM events), nodes AS (SELECT event_type AS experiment_id, node_id, CASE WHEN node_id > 0 THEN (node_id - 1) // 8 END AS parent_node_id, CAST(CASE {_DEPTH} END AS INT) AS depth, sha256('snap:' || event_type || ':' || (node_id % 97)) AS snapshot_ref, log_id AS input_log_id, CAST(node_id % 4 AS INT) AS status, value AS score, event_id % 7 AS visit_count, event_id + 1 AS created_at, event_id + 1 + event_id % 13 AS updated_at FROM numbered LEFT JOIN input_logs ON node_id = page_id)",
    "chains": "chains AS (SELECT experiment_id, node_id, CASE WHEN node_id > 0 THEN node_id - 1 END AS parent_node_id, CAST(node_id AS INT) AS depth, role FROM (SELECT CAST(conv_id AS VARCHAR) AS experiment_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS node_id, role FROM conversations))",
    "manifests": "manifests AS (SELECT o_orderkey, o_custkey AS chain, sha256('m:' || o_orderkey) AS snapshot_ref, sha256('m:' || lag(o_orderkey) OVER w) AS parent_ref, lag(o_orderkey) OVER w IS NOT NULL AS is_delta, CAST(262144 AS BIGINT) AS guest_ram_bytes, lead(o_orderkey) OVER w IS NULL AS is_head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))",
    "manifest_entries": "own AS (SELECT l_orderkey AS o_orderkey, l_partkey % 64 AS page_index, sha256(l_partkey || ':' || CAST(l_quantity AS BIGINT) || ':' || l_linenumber) AS page_hash FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey % 64 ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1), manifest_entries AS (SELECT snapshot_ref, page_index, page_hash FROM manifests JOIN own USING (o_orderkey) WHERE is_delta UNION ALL SELECT snapshot_ref, i AS page_index, coalesce(page_hash, sha256('zero')) AS page_hash FROM (SELECT o_orderkey, snapshot_ref, unnest(range(0, 64)) AS i FROM manifests WHERE NOT is_delta) f LEFT JOIN own ON own.o_orderkey = f.o_orderkey AND own.page_index = f.i)",
    "kv_metadata": "kv_metadata AS (SELECT CAST(doc_id AS VARCHAR) AS key, quality || ':' || toxic AS value, CAST(1 + quality + toxic AS BIGINT) AS generation, doc_id + 1 AS updated_at FROM labels)",
    "pins": "pins AS (SELECT sha256('m:' || s_suppkey) AS snapshot_ref, s_name AS note, s_suppkey + 1 AS created_at FROM supplier WHERE s_suppkey % 5 = 0)",
    "tombstones": "tombstones AS (SELECT experiment_id, node_id, updated_at AS created_at FROM nodes WHERE node_id % 100 = 11)",
}
_NEEDS = {"page_index": ["page_blocks"], "nodes": ["input_logs"], "manifest_entries": ["manifests"], "tombstones": ["nodes"]}


def with_sql(names: str, rest: str, recursive: bool = False) -> str:
    """WITH the named projections and what they need, then rest (further CTEs after ``, `` and the query)."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(CTE[n] for n in order) + rest
