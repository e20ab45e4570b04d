"""The registered queries: each operator over the projected store, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fsck, gc, manifests, mutations, pages, stats, tree
from ..session import materialise, remove, scratch
from ..sources import containers
from ..sources import projections as P
from ..sources.projections import sha, with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NODE = ["experiment_id", "node_id", "parent_node_id", "depth", "status", "score", "created_at", "updated_at"]
NODE_SQL = ", ".join(NODE)
EXPERIMENT = "click"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


class Store:
    """The projected tables, each made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def blocks(self) -> DataFrame:
        return P.page_blocks(self.spark, self.sf_dir)

    @property
    def stored_blocks(self) -> DataFrame:
        """The pages of documents with an even id were stored before."""
        return self.blocks.where("doc_id % 2 = 0")

    @property
    def binary_blocks(self) -> DataFrame:
        """The pages by the bytes of their hashes, half the size of the text."""
        return self.blocks.withColumn("page_hash", F.unhex("page_hash"))

    @property
    def nodes(self) -> DataFrame:
        return P.nodes(self.spark, self.sf_dir)

    @property
    def chains(self) -> DataFrame:
        return P.chains(self.spark, self.sf_dir)

    @property
    def logs(self) -> DataFrame:
        return P.input_logs(self.spark, self.sf_dir)

    @property
    def layers(self) -> DataFrame:
        return P.manifests(self.spark, self.sf_dir)

    @cached_property
    def numbered(self) -> DataFrame:
        """The layers by number, a table of its own: walks and entries read them several times."""
        return materialise(P.layers(self.spark, self.sf_dir), "layers")

    @property
    def entries(self) -> DataFrame:
        """Of the numbered layers, with pages by their text."""
        return P.layer_entries(self.spark, self.sf_dir, self.numbered)

    @property
    def kv(self) -> DataFrame:
        return P.kv_metadata(self.spark, self.sf_dir)

    @property
    def pins(self) -> DataFrame:
        return P.pins(self.spark, self.sf_dir)

    def experiment(self) -> str:
        return EXPERIMENT


def _hex(df: DataFrame) -> DataFrame:
    return df.withColumn("page_hash", F.lower(F.hex("page_hash")))


# ------------------------------------------------------------------ pages


@query(with_sql("page_blocks", """,
seen AS (SELECT DISTINCT page_hash FROM page_blocks WHERE doc_id % 2 = 0),
inc AS (SELECT doc_id, page_index, page_hash, ordinal, row_number() OVER (PARTITION BY page_hash ORDER BY ordinal) AS rn FROM page_blocks)
SELECT doc_id, page_index, inc.page_hash, rn = 1 AND seen.page_hash IS NULL AS newly_written FROM inc LEFT JOIN seen ON inc.page_hash = seen.page_hash"""))
def page_ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return pages.ingest(s.blocks, P.page_index(s.stored_blocks)).select("doc_id", "page_index", "page_hash", "newly_written")


@query(with_sql("page_blocks", """,
seen AS (SELECT DISTINCT page_hash FROM page_blocks WHERE doc_id % 2 = 0),
inc AS (SELECT doc_id, page_hash, ordinal, row_number() OVER (PARTITION BY page_hash ORDER BY ordinal) AS rn FROM page_blocks),
o AS (SELECT doc_id, inc.page_hash, ordinal, rn = 1 AND seen.page_hash IS NULL AS newly_written FROM inc LEFT JOIN seen ON inc.page_hash = seen.page_hash)
SELECT doc_id, count(*) FILTER (WHERE newly_written) AS pages_new, count(*) FILTER (WHERE NOT newly_written) AS pages_deduped, sha256(string_agg(page_hash, '' ORDER BY ordinal)) AS batch_hash FROM o GROUP BY doc_id"""))
def page_ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return pages.ingest_totals(pages.ingest(s.blocks, P.page_index(s.stored_blocks)), "doc_id")


@query(with_sql("page_blocks", """,
ix AS (SELECT DISTINCT page_hash FROM page_blocks WHERE doc_id % 2 = 0)
SELECT doc_id AS request, page_index AS pos, b.page_hash, ix.page_hash IS NOT NULL AS present FROM page_blocks b LEFT JOIN ix ON b.page_hash = ix.page_hash"""))
def has_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    request = s.blocks.select(F.col("doc_id").alias("request"), F.col("page_index").alias("pos"), "page_hash")
    return pages.has_pages(request, P.page_index(s.stored_blocks), cap=None)


@query(with_sql("page_blocks", """
SELECT doc_id, page_index, page_hash FROM page_blocks WHERE page_hash NOT IN (SELECT page_hash FROM page_blocks WHERE doc_id % 2 = 0)"""))
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return pages.missing_pages(s.blocks.select("doc_id", "page_index", "page_hash"), P.page_index(s.stored_blocks))


@query(with_sql("page_index", " SELECT count(*) AS unique_pages FROM page_index"))
def unique_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.unique_pages(P.page_index(Store(spark, sf_dir).blocks))


@query(with_sql("page_index", """ SELECT doc_id, page_index, b.page_hash, pack_id, "offset", payload FROM page_blocks b JOIN page_index i ON b.page_hash = i.page_hash"""))
def page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    payloads = s.binary_blocks.select("page_hash", "payload").dropDuplicates(["page_hash"])
    return _hex(pages.fetch(s.binary_blocks.select("doc_id", "page_index", "page_hash"), P.page_index(s.binary_blocks), payloads))


@query(with_sql("page_index", """ SELECT page_hash, pack_id, "offset" FROM page_index WHERE pack_id = 2"""))
def pack_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pack_entries(P.page_index(Store(spark, sf_dir).blocks), 2)


@query(with_sql("page_blocks", """,
seen AS (SELECT DISTINCT page_hash FROM page_blocks WHERE doc_id % 2 = 0),
new AS (SELECT page_hash, row_number() OVER (ORDER BY first) - 1 AS r FROM (SELECT page_hash, min(ordinal) AS first FROM page_blocks GROUP BY page_hash) WHERE page_hash NOT IN (SELECT page_hash FROM seen))
SELECT page_hash, CAST(100 + r // 128 AS INT) AS pack_id, CAST(20 + 4133 * (r % 128) AS BIGINT) AS "offset" FROM new"""))
def pack_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    blocks = s.binary_blocks.select("page_hash", "ordinal")
    return _hex(pages.stored(pages.ingest(blocks, P.page_index(s.binary_blocks.where("doc_id % 2 = 0"))), 100, 128))


@query(with_sql("page_index", """ SELECT CAST(strpos('0123456789abcdef', substr(page_hash, 1, 1)) * 16 + strpos('0123456789abcdef', substr(page_hash, 2, 1)) - 17 AS INT) AS shard, count(*) AS pages FROM page_index GROUP BY 1"""))
def shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_index(Store(spark, sf_dir).blocks).groupBy(pages.shard_of_hex(F.col("page_hash")).alias("shard")).agg(F.count("*").alias("pages"))


@query(with_sql("page_index", """ SELECT page_hash, CASE WHEN pack_id = 1 AND "offset" % 2 = 0 THEN 900 ELSE pack_id END AS pack_id, CASE WHEN pack_id = 1 AND "offset" % 2 = 0 THEN "offset" + 7 ELSE "offset" END AS "offset" FROM page_index"""))
def index_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.page_index(Store(spark, sf_dir).blocks)
    moves = ix.where("offset % 2 = 0").select("page_hash", F.lit(900).alias("new_pack"), (F.col("offset") + 7).alias("new_offset"))
    return pages.repoint(ix, moves, 1)


@query(with_sql("page_index", """ SELECT page_hash, pack_id, "offset" FROM page_index WHERE NOT (pack_id = 1 AND "offset" % 2 = 0)"""))
def index_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.page_index(Store(spark, sf_dir).blocks)
    return pages.remove_from_pack(ix, ix.where("offset % 2 = 0").select("page_hash"), 1)


# ------------------------------------------------------------------ manifests

_CHAIN = """,
chain(head, snapshot_ref, parent_ref, chain_pos) AS (
  SELECT snapshot_ref, snapshot_ref, parent_ref, 0 FROM manifests WHERE is_head
  UNION ALL SELECT c.head, m.snapshot_ref, m.parent_ref, c.chain_pos + 1 FROM chain c JOIN manifests m ON m.snapshot_ref = c.parent_ref)"""
_FLAT = _CHAIN + """
SELECT head, page_index, page_hash FROM chain JOIN manifest_entries USING (snapshot_ref) QUALIFY row_number() OVER (PARTITION BY head, page_index ORDER BY chain_pos) = 1"""


def _heads(layers: DataFrame) -> DataFrame:
    return layers.where("is_head").select("snapshot_ref")


def _hashed(df: DataFrame) -> DataFrame:
    """Hashes for the numbers of layers and the texts of pages."""
    return df.select(*[(P.ref(c) if c in ("head", "baseline", "snapshot_ref") else P.page(c) if c == "page_hash" else F.col(c)).alias(c) for c in df.columns])


@query(with_sql("manifest_entries", _FLAT, True))
def resolve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return _hashed(manifests.resolve_full(s.numbered, s.entries, _heads(s.numbered)))


@query(with_sql("manifest_entries", _FLAT, True))
def flatten_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return _hashed(manifests.flatten_by_rank(manifests.chain(s.numbered, _heads(s.numbered)), s.entries))


@query(with_sql("manifest_entries", _CHAIN + """,
base AS (SELECT head, max(chain_pos) AS baseline_pos FROM chain WHERE chain_pos <= 2 GROUP BY head)
SELECT c.head, b.snapshot_ref AS baseline, page_index, page_hash FROM chain c JOIN base USING (head) JOIN chain b ON b.head = c.head AND b.chain_pos = baseline_pos
JOIN manifest_entries e ON e.snapshot_ref = c.snapshot_ref WHERE c.chain_pos < baseline_pos QUALIFY row_number() OVER (PARTITION BY c.head, page_index ORDER BY c.chain_pos) = 1""", True))
def resolve_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the layer two below each head, or the root of a shorter chain."""
    s = Store(spark, sf_dir)
    m = s.numbered.select("snapshot_ref", "parent_ref", "is_head")
    up = m.select(F.col("snapshot_ref").alias("p1"), F.col("parent_ref").alias("p2"))
    pairs = m.where("is_head").join(up, F.col("parent_ref") == F.col("p1"), "left").select(F.col("snapshot_ref").alias("head"), F.coalesce("p2", "p1", "snapshot_ref").alias("baseline"))
    return _hashed(manifests.resolve_delta(s.numbered, s.entries, pairs))


@query(with_sql("manifest_entries", """,
stored AS (SELECT DISTINCT page_hash FROM manifest_entries JOIN manifests USING (snapshot_ref) WHERE chain % 3 != 0),
lacking AS (SELECT snapshot_ref, count(*) AS missing FROM manifest_entries WHERE page_hash NOT IN (SELECT page_hash FROM stored) GROUP BY 1),
known AS (SELECT * FROM manifests WHERE o_orderkey % 4 != 0)
SELECT m.snapshot_ref, CASE WHEN k.snapshot_ref IS NOT NULL THEN 'EXISTING' WHEN m.parent_ref IS NOT NULL AND p.snapshot_ref IS NULL THEN 'UNKNOWN_PARENT' WHEN p.guest_ram_bytes != m.guest_ram_bytes + CASE WHEN m.o_orderkey % 5 = 0 THEN 4096 ELSE 0 END THEN 'RAM_MISMATCH' WHEN missing > 0 THEN 'MISSING_PAGES' ELSE 'INSERTED' END AS outcome,
CASE WHEN k.snapshot_ref IS NULL AND (m.parent_ref IS NULL OR p.guest_ram_bytes = m.guest_ram_bytes + CASE WHEN m.o_orderkey % 5 = 0 THEN 4096 ELSE 0 END) THEN coalesce(missing, 0) ELSE 0 END AS missing
FROM manifests m LEFT JOIN known k USING (snapshot_ref) LEFT JOIN known p ON p.snapshot_ref = m.parent_ref LEFT JOIN lacking l ON l.snapshot_ref = m.snapshot_ref"""))
def put_snapshot_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the layers are not stored yet; pages of every third chain are not; some candidates have another RAM size."""
    s = Store(spark, sf_dir)
    layers, entries = s.numbered, s.entries
    index = entries.join(layers.where("chain % 3 != 0").select("snapshot_ref"), "snapshot_ref", "left_semi").select("page_hash").distinct()
    candidates = layers.withColumn("guest_ram_bytes", F.col("guest_ram_bytes") + F.when(F.col("o_orderkey") % 5 == 0, 4096).otherwise(0))
    return _hashed(manifests.put(candidates, entries, layers.where("o_orderkey % 4 != 0"), index))


@query(with_sql("manifest_entries", """,
bad AS (SELECT snapshot_ref, page_index FROM manifest_entries UNION ALL SELECT snapshot_ref, page_index FROM manifest_entries JOIN manifests USING (snapshot_ref) WHERE o_orderkey % 11 = 0 AND page_index < 3),
f AS (SELECT snapshot_ref, count(*) AS n, count(DISTINCT page_index) AS d FROM bad GROUP BY 1)
SELECT snapshot_ref, coalesce(n, 0) AS entry_count, CASE WHEN n > d THEN 'DuplicateIndex' WHEN NOT is_delta AND coalesce(d, 0) != 64 THEN 'Coverage' END AS error FROM manifests LEFT JOIN f USING (snapshot_ref)"""))
def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh layer has its first indices twice."""
    s = Store(spark, sf_dir)
    layers, entries = s.numbered, s.entries
    twice = entries.where("page_index < 3").join(layers.where("o_orderkey % 11 = 0").select("snapshot_ref"), "snapshot_ref", "left_semi")
    return _hashed(manifests.validate(layers, entries.unionByName(twice.select(*entries.columns))))


@query(with_sql("manifests", " SELECT count(*) AS manifest_count, CAST(sum(guest_ram_bytes) AS BIGINT) AS logical_bytes FROM manifests"))
def manifest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.counters(Store(spark, sf_dir).layers)


@query(with_sql("manifests pins", " SELECT pins.snapshot_ref, m.snapshot_ref IS NOT NULL AS present FROM pins LEFT JOIN manifests m ON pins.snapshot_ref = m.snapshot_ref"))
def has_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return manifests.has_manifest(s.pins.select("snapshot_ref"), s.layers)


@query(with_sql("manifest_entries", _CHAIN + ", broken AS (SELECT head, max(chain_pos) AS n FROM chain GROUP BY head) SELECT head, 'RootNotFull' AS error FROM broken WHERE n > 4", True))
def flatten_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains cut after five layers: their root is a DELTA."""
    s = Store(spark, sf_dir)
    layers = s.numbered
    chained = manifests.chain(layers, _heads(layers)).where("chain_pos < 5")
    return _hashed(manifests.flatten_errors(chained, layers, manifests.flatten(chained, s.entries)).where("error = 'RootNotFull'"))


# ------------------------------------------------------------------ trees


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).nodes


@query(with_sql("nodes", f" SELECT {NODE_SQL} FROM nodes WHERE experiment_id = '{EXPERIMENT}' AND node_id = 5"))
def get_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.get_node(_nodes(spark, sf_dir), EXPERIMENT, 5).select(*NODE)


@query(with_sql("nodes", f" SELECT {NODE_SQL} FROM nodes WHERE experiment_id = '{EXPERIMENT}' AND parent_node_id = 3"))
def get_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.get_children(_nodes(spark, sf_dir), EXPERIMENT, 3).select(*NODE)


def _filtered(name: str, where: str, order: str = "created_at", limit: int | None = None, **filters: int) -> None:
    """A query of the first rows that match."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tree.query_nodes(_nodes(spark, sf_dir), EXPERIMENT, order=order, limit=limit, **filters).select(*NODE)

    run.__name__ = f"query_nodes_{name}"
    query(with_sql("nodes", f" SELECT {NODE_SQL} FROM nodes WHERE experiment_id = '{EXPERIMENT}' AND {where} ORDER BY {order}, node_id LIMIT {tree.effective_limit(limit)}"))(run)


_filtered("status", "status = 2", status=2)
_filtered("parent", "parent_node_id = 7", parent=7)
_filtered("depth", "depth BETWEEN 2 AND 3", min_depth=2, max_depth=3)
_filtered("created_after", "created_at > 500", created_after=500)
_filtered("updated_after", "updated_at > 900", updated_after=900)
_filtered("order_updated", "true", order="updated_at")
_filtered("order_node_id", "true", order="node_id", limit=100)
_filtered("limit_cap", "true", limit=1_000_000)
_filtered("conjunction", "status = 1 AND depth >= 2 AND created_at > 100 AND updated_at > 200", status=1, min_depth=2, created_after=100, updated_after=200)


@query(with_sql("nodes", f" SELECT {NODE_SQL} FROM nodes WHERE experiment_id = '{EXPERIMENT}' AND status = 0"))
def stream_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.stream_nodes(_nodes(spark, sf_dir), EXPERIMENT, status=0).select(*NODE)


@query(with_sql("nodes", f" SELECT {NODE_SQL} FROM nodes WHERE experiment_id = '{EXPERIMENT}' AND (updated_at > 300 OR (updated_at = 300 AND node_id > 10)) ORDER BY updated_at, node_id LIMIT 50"))
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.page_after(_nodes(spark, sf_dir), EXPERIMENT, "updated_at", (300, 10), 50).select(*NODE)


_PATH = """,
path(start, experiment_id, node_id, parent_node_id) AS (
  SELECT node_id, experiment_id, node_id, parent_node_id FROM nodes WHERE node_id % 50 = 0
  UNION ALL SELECT p.start, n.experiment_id, n.node_id, n.parent_node_id FROM path p JOIN nodes n ON n.experiment_id = p.experiment_id AND n.node_id = p.parent_node_id)"""


@query(with_sql("nodes", _PATH + " SELECT start, experiment_id, node_id, depth, score FROM path JOIN nodes USING (experiment_id, node_id)", True))
def get_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from the root to every fiftieth node of every tree."""
    nodes = _nodes(spark, sf_dir)
    return tree.get_path(nodes, nodes.where("node_id % 50 = 0").select("experiment_id", "node_id")).select("start", "experiment_id", "node_id", "depth", "score")


@query(with_sql("chains", """,
path(start, experiment_id, node_id, parent_node_id) AS (
  SELECT node_id, experiment_id, node_id, parent_node_id FROM chains
  UNION ALL SELECT p.start, n.experiment_id, n.node_id, n.parent_node_id FROM path p JOIN chains n ON n.experiment_id = p.experiment_id AND n.node_id = p.parent_node_id)
SELECT start, experiment_id, node_id, depth, role FROM path JOIN chains USING (experiment_id, node_id)""", True))
def get_path_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths to every turn of every conversation."""
    chains = Store(spark, sf_dir).chains
    return tree.get_path(chains, chains.select("experiment_id", "node_id")).select("start", "experiment_id", "node_id", "depth", "role")


@query(with_sql("nodes", _PATH + " SELECT start, experiment_id, node_id, depth, l.content AS log_content FROM path JOIN nodes USING (experiment_id, node_id) LEFT JOIN (SELECT log_id, any_value(content) AS content FROM input_logs GROUP BY log_id) l ON l.log_id = input_log_id", True))
def get_path_with_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    nodes = s.nodes
    path = tree.get_path(nodes, nodes.where("node_id % 50 = 0").select("experiment_id", "node_id"))
    return tree.with_logs(path, s.logs).select("start", "experiment_id", "node_id", "depth", "log_content")


_SUBTREE = """,
sub(root, experiment_id, node_id, level) AS (
  SELECT node_id, experiment_id, node_id, 0 FROM nodes WHERE node_id IN (1, 12)
  UNION ALL SELECT s.root, n.experiment_id, n.node_id, s.level + 1 FROM sub s JOIN nodes n ON n.experiment_id = s.experiment_id AND n.parent_node_id = s.node_id)"""


@query(with_sql("nodes", _SUBTREE + " SELECT root, experiment_id, node_id, level FROM sub", True))
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return tree.subtree(nodes, nodes.where("node_id IN (1, 12)").select("experiment_id", "node_id"))


_PATH_WHOLE = """,
path(start, experiment_id, node_id, parent_node_id) AS (
  SELECT node_id, experiment_id, node_id, parent_node_id FROM nodes
  UNION ALL SELECT p.start, n.experiment_id, n.node_id, n.parent_node_id FROM path p JOIN nodes n ON n.experiment_id = p.experiment_id AND n.node_id = p.parent_node_id)"""


@query(with_sql("nodes", _PATH_WHOLE + " SELECT start, experiment_id, node_id, depth, score FROM path JOIN nodes USING (experiment_id, node_id)", True))
def get_path_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from the root to every node of every tree."""
    nodes = _nodes(spark, sf_dir)
    return tree.get_path(nodes, nodes.select("experiment_id", "node_id")).select("start", "experiment_id", "node_id", "depth", "score")


@query(with_sql("nodes", _PATH_WHOLE + " SELECT start, experiment_id, node_id, depth, l.content AS log_content FROM path JOIN nodes USING (experiment_id, node_id) LEFT JOIN (SELECT log_id, any_value(content) AS content FROM input_logs GROUP BY log_id) l ON l.log_id = input_log_id", True))
def get_path_with_logs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths to every node, each node of them with its log."""
    s = Store(spark, sf_dir)
    nodes = s.nodes
    path = tree.get_path(nodes, nodes.select("experiment_id", "node_id"))
    return tree.with_logs(path, s.logs).select("start", "experiment_id", "node_id", "depth", "log_content")


@query(with_sql("nodes", """,
sub(root, experiment_id, node_id, level) AS (
  SELECT node_id, experiment_id, node_id, 0 FROM nodes
  UNION ALL SELECT s.root, n.experiment_id, n.node_id, s.level + 1 FROM sub s JOIN nodes n ON n.experiment_id = s.experiment_id AND n.parent_node_id = s.node_id) SELECT root, experiment_id, node_id, level FROM sub""", True))
def subtree_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtree below every node of every tree."""
    nodes = _nodes(spark, sf_dir)
    return tree.subtree(nodes, nodes.select("experiment_id", "node_id"))


@query(with_sql("nodes", " SELECT DISTINCT experiment_id FROM nodes"))
def list_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.list_experiments(_nodes(spark, sf_dir))


@query(with_sql("input_logs", " SELECT log_id, content FROM input_logs WHERE page_id = 3"))
def get_input_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = Store(spark, sf_dir).logs
    return logs.join(logs.where("page_id = 3").select("log_id").distinct(), "log_id", "left_semi").where("page_id = 3").select("log_id", "content")


@query(with_sql("kv_metadata", " SELECT key, value, generation FROM kv_metadata WHERE key = '4'"))
def get_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).kv.where("key = '4'").select("key", "value", "generation")


@query(with_sql("pins", " SELECT snapshot_ref, note, created_at FROM pins"))
def pin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.list_pins(Store(spark, sf_dir).pins)


@query(with_sql("tombstones", " SELECT experiment_id, node_id, created_at FROM tombstones WHERE created_at <= 3000"))
def tombstone_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.list_tombstones(P.tombstones(_nodes(spark, sf_dir)), 3000)


@query(with_sql("nodes", " SELECT experiment_id, node_id, updated_at FROM nodes WHERE updated_at > 1500"))
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.changes_since(_nodes(spark, sf_dir), 1500).select("experiment_id", "node_id", "updated_at")


# ------------------------------------------------------------------ statistics


@query(with_sql("nodes pins tombstones kv_metadata", """
SELECT (SELECT count(*) FROM nodes) AS nodes_total, (SELECT count(DISTINCT experiment_id) FROM nodes) AS experiments, (SELECT count(*) FROM pins) AS pins, (SELECT count(*) FROM tombstones) AS tombstones, (SELECT count(*) FROM kv_metadata) AS kv_entries, (SELECT count(*) FROM input_logs) AS input_logs, (SELECT CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) FROM input_logs) AS input_log_bytes"""))
def stats_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return stats.global_stats(s.nodes, s.pins, P.tombstones(s.nodes), s.kv, s.logs)


@query(with_sql("nodes", """,
own AS (SELECT experiment_id, CAST(sum(n) AS BIGINT) AS b FROM (SELECT DISTINCT experiment_id, input_log_id FROM nodes WHERE input_log_id IS NOT NULL) JOIN (SELECT log_id, any_value(strlen(content)) AS n FROM input_logs GROUP BY 1) ON log_id = input_log_id GROUP BY 1)
SELECT experiment_id, count(*) FILTER (WHERE status = 0) AS nodes_frontier, count(*) FILTER (WHERE status = 1) AS nodes_expanded, count(*) FILTER (WHERE status = 2) AS nodes_terminal, count(*) FILTER (WHERE status = 3) AS nodes_pruned, max(depth) AS max_depth, count(DISTINCT input_log_id) AS input_logs, coalesce(any_value(b), 0) AS input_log_bytes, (SELECT CAST(sum(strlen(content)) AS BIGINT) FROM input_logs) AS input_log_bytes_global
FROM nodes LEFT JOIN own USING (experiment_id) GROUP BY experiment_id"""))
def stats_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return stats.experiment_stats(s.nodes, s.logs)


@query(with_sql("manifest_entries", """,
ix AS (SELECT DISTINCT page_hash FROM manifest_entries)
SELECT logical_bytes, physical_bytes, round(logical_bytes / physical_bytes, 6) AS dedup_ratio FROM (SELECT CAST(sum(guest_ram_bytes) AS BIGINT) AS logical_bytes FROM manifests), (SELECT count(*) * 4133 AS physical_bytes FROM ix)"""))
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return stats.dedup_ratio(s.numbered, s.entries.select("page_hash").distinct())


@query(with_sql("nodes", """ SELECT greatest(1000, max(created_at), max(updated_at), (SELECT max(created_at) FROM input_logs)) + 1 AS next_counter FROM nodes"""))
def logical_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return stats.next_counter(1000, s.nodes, s.logs)


@query("SELECT quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(P.table(spark, sf_dir, "lineitem"), "l_extendedprice")


# ------------------------------------------------------------------ writes


def _creates(s: Store) -> DataFrame:
    """Replays of stored nodes (some with another snapshot), new children, children of unknown parents, repeated keys."""
    n = s.nodes
    key = F.col("node_id")
    replay = n.where("node_id % 10 = 1").select((key * 10 + 1).alias("ordinal"), "experiment_id", "node_id", "parent_node_id", F.when(key % 30 == 1, sha("other")).otherwise(F.col("snapshot_ref")).alias("snapshot_ref"), "input_log_id")
    child = n.where("node_id % 10 = 2").select((key * 10 + 2).alias("ordinal"), "experiment_id", (key + 10_000_000).alias("node_id"), key.alias("parent_node_id"), "snapshot_ref", F.lit(None).cast("string").alias("input_log_id"))
    lost = n.where("node_id % 10 = 4").select((key * 10 + 4).alias("ordinal"), "experiment_id", (key + 20_000_000).alias("node_id"), (key + 30_000_000).alias("parent_node_id"), "snapshot_ref", F.lit(None).cast("string").alias("input_log_id"))
    log = n.where("node_id % 10 = 6").select((key * 10 + 6).alias("ordinal"), "experiment_id", (key + 40_000_000).alias("node_id"), key.alias("parent_node_id"), "snapshot_ref", sha("nolog").alias("input_log_id"))
    again = child.withColumn("ordinal", F.col("ordinal") + 100_000_000).withColumn("snapshot_ref", F.when(key % 20 == 2, F.col("snapshot_ref")).otherwise(sha("clash")))
    return replay.unionByName(child).unionByName(lost).unionByName(log).unionByName(again)


_CREATES = """,
creates AS (
 SELECT node_id * 10 + 1 AS ordinal, experiment_id, node_id, parent_node_id, CASE WHEN node_id % 30 = 1 THEN sha256('other') ELSE snapshot_ref END AS snapshot_ref, input_log_id, 'replay' AS kind FROM nodes WHERE node_id % 10 = 1
 UNION ALL SELECT node_id * 10 + 2, experiment_id, node_id + 10000000, node_id, snapshot_ref, NULL, 'child' FROM nodes WHERE node_id % 10 = 2
 UNION ALL SELECT node_id * 10 + 4, experiment_id, node_id + 20000000, node_id + 30000000, snapshot_ref, NULL, 'lost' FROM nodes WHERE node_id % 10 = 4
 UNION ALL SELECT node_id * 10 + 6, experiment_id, node_id + 40000000, node_id, snapshot_ref, sha256('nolog'), 'log' FROM nodes WHERE node_id % 10 = 6
 UNION ALL SELECT node_id * 10 + 2 + 100000000, experiment_id, node_id + 10000000, node_id, CASE WHEN node_id % 20 = 2 THEN snapshot_ref ELSE sha256('clash') END, NULL, 'again' FROM nodes WHERE node_id % 10 = 2),
judged AS (SELECT c.*, p.depth AS parent_depth, CASE WHEN c.parent_node_id IS NOT NULL AND p.node_id IS NULL THEN 'PARENT_NOT_FOUND' WHEN p.status = 3 THEN 'PARENT_PRUNED' WHEN kind = 'log' THEN 'LOG_NOT_FOUND' WHEN kind = 'replay' THEN CASE WHEN c.snapshot_ref = n.snapshot_ref THEN 'EXISTING' ELSE 'ALREADY_EXISTS' END WHEN kind = 'child' THEN 'INSERTED' WHEN c.snapshot_ref = sha256('clash') THEN 'ALREADY_EXISTS' ELSE 'EXISTING' END AS outcome
 FROM creates c LEFT JOIN nodes p ON p.experiment_id = c.experiment_id AND p.node_id = c.parent_node_id LEFT JOIN nodes n ON n.experiment_id = c.experiment_id AND n.node_id = c.node_id)"""


@query(with_sql("nodes", _CREATES + " SELECT ordinal, experiment_id, node_id, outcome, CAST(coalesce(parent_depth, -1) + 1 AS INT) AS depth FROM judged"))
def create_node_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return mutations.create_outcomes(s.nodes, _creates(s), s.logs)


@query(with_sql("nodes", _CREATES + " SELECT experiment_id, node_id, parent_node_id, depth, created_at, status FROM nodes UNION ALL SELECT experiment_id, node_id, parent_node_id, CAST(parent_depth + 1 AS INT), 5000 + ordinal, 0 FROM judged WHERE outcome = 'INSERTED'"))
def create_node_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    creates = _creates(s)
    return mutations.apply_creates(s.nodes, creates, mutations.create_outcomes(s.nodes, creates, s.logs), 5000).select("experiment_id", "node_id", "parent_node_id", "depth", "created_at", "status")


def _updates(s: Store, lost: bool) -> DataFrame:
    n = s.nodes
    key = F.col("node_id")
    first = n.where("node_id % 6 = 0").select(key.alias("ordinal"), "experiment_id", "node_id", F.lit(2).alias("status"), F.lit(None).cast("double").alias("score"), F.lit(3).cast("bigint").alias("visit_delta"))
    then = n.where("node_id % 12 = 0").select((key + 1_000_000).alias("ordinal"), "experiment_id", "node_id", F.lit(None).cast("int").alias("status"), (F.col("score") + 1).alias("score"), F.lit(-1).cast("bigint").alias("visit_delta"))
    both = first.unionByName(then)
    if lost:
        both = both.withColumn("node_id", F.when(key % 36 == 0, key + 90_000_000).otherwise(key))
    return both


@query(with_sql("nodes", " SELECT experiment_id, node_id, CAST(CASE WHEN node_id % 6 = 0 THEN 2 ELSE status END AS INT) AS status, CASE WHEN node_id % 12 = 0 THEN score + 1 ELSE score END AS score, visit_count + CASE WHEN node_id % 12 = 0 THEN 2 WHEN node_id % 6 = 0 THEN 3 ELSE 0 END AS visit_count, CASE WHEN node_id % 6 = 0 THEN 777777 ELSE updated_at END AS updated_at FROM nodes"))
def update_nodes_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return mutations.apply_updates(s.nodes, _updates(s, False), 777_777).select("experiment_id", "node_id", "status", "score", "visit_count", "updated_at")


@query(with_sql("nodes", " SELECT DISTINCT experiment_id, node_id + 90000000 AS node_id FROM nodes WHERE node_id % 36 = 0"))
def update_nodes_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return mutations.missing_nodes(s.nodes, _updates(s, True))


_PRUNED = _SUBTREE.replace("node_id IN (1, 12)", "node_id IN (11, 90, 91)") + ", hit AS (SELECT DISTINCT experiment_id, node_id FROM sub)"


@query(with_sql("nodes", _PRUNED + " SELECT n.experiment_id, n.node_id, CAST(CASE WHEN h.node_id IS NOT NULL THEN 3 ELSE status END AS INT) AS status, CASE WHEN h.node_id IS NOT NULL THEN 999999 ELSE updated_at END AS updated_at FROM nodes n LEFT JOIN hit h USING (experiment_id, node_id)", True))
def prune_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    starts = nodes.where("node_id IN (11, 90, 91)").select("experiment_id", "node_id")
    return mutations.prune(nodes, P.tombstones(nodes), starts, 999_999)[0].select("experiment_id", "node_id", "status", "updated_at")


@query(with_sql("nodes", _PRUNED + ", n AS (SELECT experiment_id, root AS node_id, count(*) AS pruned FROM sub GROUP BY 1, 2) SELECT experiment_id, node_id, 'PRUNED' AS outcome, pruned FROM n UNION ALL SELECT experiment_id, 0, 'ROOT_DENIED', 0 FROM nodes WHERE node_id = 0 UNION ALL SELECT experiment_id, 77000000, 'NOT_FOUND', 0 FROM nodes WHERE node_id = 0", True))
def prune_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    starts = nodes.where("node_id IN (0, 11, 90, 91)").select("experiment_id", "node_id")
    starts = starts.unionByName(nodes.where("node_id = 0").select("experiment_id", F.lit(77_000_000).cast("bigint").alias("node_id")))
    return mutations.prune(nodes, P.tombstones(nodes), starts, 999_999)[2]


_REAP = """,
due AS (SELECT experiment_id, node_id FROM tombstones WHERE created_at <= 4000),
sub(root, experiment_id, node_id) AS (SELECT node_id, experiment_id, node_id FROM due UNION ALL SELECT s.root, n.experiment_id, n.node_id FROM sub s JOIN nodes n ON n.experiment_id = s.experiment_id AND n.parent_node_id = s.node_id),
state AS (SELECT experiment_id, root, count(*) AS n, count(*) FILTER (WHERE status != 3) AS alive FROM sub JOIN nodes USING (experiment_id, node_id) GROUP BY 1, 2)"""


@query(with_sql("tombstones", _REAP + " SELECT experiment_id, root AS node_id, CASE WHEN alive > 0 THEN 'REFUSED' ELSE 'REAPED' END AS outcome, CASE WHEN alive > 0 THEN 0 ELSE n END AS reaped FROM state", True))
def reap_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    marks = P.tombstones(nodes)
    return mutations.reap(nodes, marks, marks.where("created_at <= 4000"))[2]


@query(with_sql("tombstones", _REAP + " SELECT experiment_id, node_id FROM nodes WHERE (experiment_id, node_id) NOT IN (SELECT (s.experiment_id, s.node_id) FROM sub s JOIN state t ON t.experiment_id = s.experiment_id AND t.root = s.root WHERE alive = 0)", True))
def reap_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    marks = P.tombstones(nodes)
    return mutations.reap(nodes, marks, marks.where("created_at <= 4000"))[0].select("experiment_id", "node_id")


@query(with_sql("nodes", " SELECT page_id, log_id FROM input_logs WHERE log_id NOT IN (SELECT input_log_id FROM nodes WHERE input_log_id IS NOT NULL AND node_id % 3 = 0)"))
def orphan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return mutations.orphan_logs(s.logs, s.nodes.where("node_id % 3 = 0")).select("page_id", "log_id")


@query(with_sql("input_logs", """,
inc AS (SELECT page_id AS ordinal, log_id, content, sha256(CASE WHEN page_id % 7 = 0 THEN 'x' ELSE content END) AS digest FROM input_logs UNION ALL SELECT page_id + 1000000, sha256('short'), 'short', sha256('short') FROM input_logs WHERE page_id < 3),
f AS (SELECT *, CASE WHEN NOT strlen(content) BETWEEN 56 AND 16777216 THEN 'INVALID_SIZE' WHEN digest != log_id THEN 'HASH_MISMATCH' END AS fault FROM inc)
SELECT ordinal, log_id, CASE WHEN fault IS NOT NULL THEN fault WHEN log_id IN (SELECT log_id FROM input_logs WHERE page_id % 5 = 0) OR row_number() OVER (PARTITION BY log_id, fault IS NULL ORDER BY ordinal) > 1 THEN 'EXISTING' ELSE 'STORED' END AS outcome FROM f"""))
def put_input_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = Store(spark, sf_dir).logs
    body = F.when(F.col("page_id") % 7 == 0, F.lit("x")).otherwise(F.col("content"))
    incoming = logs.select(F.col("page_id").alias("ordinal"), "log_id", "content", F.sha2(body, 256).alias("digest"))
    short = logs.where("page_id < 3").select((F.col("page_id") + 1_000_000).alias("ordinal"), sha("short").alias("log_id"), F.lit("short").alias("content"), sha("short").alias("digest"))
    return mutations.put_logs(logs.where("page_id % 5 = 0"), incoming.unionByName(short))


@query(with_sql("pins manifests", """
SELECT s_suppkey AS ordinal, sha256('m:' || s_suppkey) AS snapshot_ref, CASE WHEN m.snapshot_ref IS NULL THEN 'UNKNOWN_REF' WHEN s_suppkey % 5 = 0 THEN 'EXISTING' ELSE 'PINNED' END AS outcome FROM supplier LEFT JOIN manifests m ON m.snapshot_ref = sha256('m:' || s_suppkey)"""))
def pin_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    asked = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ordinal"), sha("m:", F.col("s_suppkey").cast("string")).alias("snapshot_ref"), F.col("s_name").alias("note"), F.col("s_suppkey").alias("created_at"))
    return mutations.pin(s.pins, asked, s.layers).select("ordinal", "snapshot_ref", "outcome")


@query(with_sql("pins", " SELECT sha256('m:' || s_suppkey) AS snapshot_ref, s_suppkey % 5 = 0 AS removed FROM supplier WHERE s_suppkey % 2 = 0"))
def unpin_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = P.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(sha("m:", F.col("s_suppkey").cast("string")).alias("snapshot_ref"))
    return mutations.unpin(Store(spark, sf_dir).pins, refs)[1]


def _puts(s: Store, expected) -> DataFrame:
    return P.table(s.spark, s.sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("value"), expected.cast("bigint").alias("expected"))


def _kv_sql(expected: str) -> str:
    return with_sql("kv_metadata", f"""
SELECT CAST(d.doc_id AS VARCHAR) AS key, lang AS value, CASE WHEN {expected} IS NOT NULL AND {expected} != coalesce(generation, 0) THEN 'CONFLICT' ELSE 'STORED' END AS outcome, CASE WHEN {expected} IS NOT NULL AND {expected} != coalesce(generation, 0) THEN generation ELSE coalesce(generation, 0) + 1 END AS generation
FROM documents d LEFT JOIN kv_metadata k ON k.key = CAST(d.doc_id AS VARCHAR)""")


@query(_kv_sql("CAST(NULL AS BIGINT)"))
def kv_put_unconditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return mutations.kv_put(s.kv, _puts(s, F.lit(None)))


@query(_kv_sql("0"))
def kv_put_create_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return mutations.kv_put(s.kv, _puts(s, F.lit(0)))


@query(_kv_sql("1 + d.doc_id % 2"))
def kv_put_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return mutations.kv_put(s.kv, _puts(s, 1 + F.col("doc_id") % 2))


@query(with_sql("kv_metadata", """ SELECT CAST(d.doc_id AS VARCHAR) AS key, CASE WHEN generation IS NULL THEN 'ABSENT' WHEN generation != 1 + d.doc_id % 2 THEN 'CONFLICT' ELSE 'DELETED' END AS outcome FROM documents d LEFT JOIN kv_metadata k ON k.key = CAST(d.doc_id AS VARCHAR)"""))
def kv_delete_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return mutations.kv_delete(s.kv, _puts(s, 1 + F.col("doc_id") % 2))[1]


@query(with_sql("kv_metadata", """,
d AS (SELECT CAST(doc_id AS VARCHAR) AS key, coalesce(generation, 0) AS g, doc_id FROM documents LEFT JOIN kv_metadata k ON k.key = CAST(doc_id AS VARCHAR))
SELECT 1 AS ordinal, key, 'STORED' AS outcome, g + 1 AS generation, 'a' AS value FROM d
UNION ALL SELECT 2, key, CASE WHEN g = 1 THEN 'STORED' ELSE 'CONFLICT' END, CASE WHEN g = 1 THEN 3 ELSE g + 1 END, CASE WHEN g = 1 THEN 'b' ELSE 'a' END FROM d
UNION ALL SELECT 3, key, 'DELETED', NULL, NULL FROM d
UNION ALL SELECT 4, key, 'STORED', 1, 'c' FROM d"""))
def kv_command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four commands for each key in order: put, put if the generation is 2, delete, create."""
    s = Store(spark, sf_dir)
    keys = _puts(s, F.lit(None)).select("key")
    step = [(1, "put", "a", None), (2, "put", "b", 2), (3, "delete", None, None), (4, "put", "c", 0)]
    cmds = keys.select("key", F.explode(F.array(*[F.struct(F.lit(o).cast("bigint").alias("ordinal"), F.lit(op).alias("op"), F.lit(v).cast("string").alias("value"), F.lit(e).cast("bigint").alias("expected")) for o, op, v, e in step])).alias("c")).select("key", "c.*")
    return mutations.kv_fold(s.kv, cmds)


# ------------------------------------------------------------------ garbage collection


@query(with_sql("tombstones", " SELECT experiment_id, node_id, created_at FROM tombstones WHERE created_at <= 5000"))
def reap_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gc.due_tombstones(P.tombstones(_nodes(spark, sf_dir)), gc.GcOptions(), 5000)


@query(with_sql("nodes pins", " SELECT snapshot_ref FROM nodes UNION SELECT snapshot_ref FROM pins"))
def gc_root_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return gc.roots(s.nodes, s.pins)


def _gc(s: Store) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Layers, entries, index of their pages (a pack for each shard of eight hashes), live manifests, live pages. Roots are every
    fifth chain's third layer from the root, and the pins."""
    layers, entries = s.numbered, s.entries
    refs = layers.where("chain % 5 = 0 AND o_orderkey % 3 = 0").select("snapshot_ref").union(P.pin_keys(s.spark, s.sf_dir)).distinct()
    live, _ = gc.mark(layers, refs)
    index = entries.select("page_hash").distinct().withColumn("pack_id", (pages.shard_of_hex(P.page("page_hash")) / 8).cast("int"))
    return layers, entries, index, live, gc.live_pages(live, entries)


_LIVE = """,
live(snapshot_ref, parent_ref) AS (
  SELECT snapshot_ref, parent_ref FROM manifests WHERE (chain % 5 = 0 AND o_orderkey % 3 = 0) OR snapshot_ref IN (SELECT snapshot_ref FROM pins)
  UNION SELECT m.snapshot_ref, m.parent_ref FROM live l JOIN manifests m ON m.snapshot_ref = l.parent_ref),
live_pages AS (SELECT DISTINCT page_hash FROM manifest_entries WHERE snapshot_ref IN (SELECT snapshot_ref FROM live)),
ix AS (SELECT page_hash, CAST((strpos('0123456789abcdef', substr(page_hash, 1, 1)) * 16 + strpos('0123456789abcdef', substr(page_hash, 2, 1)) - 17) // 8 AS INT) AS pack_id FROM (SELECT DISTINCT page_hash FROM manifest_entries)),
liveness AS (SELECT pack_id, count(*) AS total, count(p.page_hash) AS live_count FROM ix LEFT JOIN live_pages p USING (page_hash) GROUP BY pack_id),
plan AS (SELECT pack_id, total, live_count, round(live_count / total, 6) AS liveness, CASE WHEN live_count = 0 THEN 'DELETE' WHEN live_count / total >= 0.2 THEN 'KEEP' ELSE 'COMPACT' END AS action FROM liveness WHERE pack_id < 30)"""


@query(with_sql("manifest_entries pins", _LIVE + " SELECT snapshot_ref FROM live", True))
def gc_live_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(_gc(Store(spark, sf_dir))[3])


@query(with_sql("manifest_entries pins", _LIVE + " SELECT page_hash FROM live_pages", True))
def gc_live_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(_gc(Store(spark, sf_dir))[4])


@query(with_sql("manifest_entries pins", _LIVE + " SELECT pack_id, total, live_count, round(live_count / total, 6) AS liveness FROM liveness", True))
def gc_pack_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, _, live = _gc(Store(spark, sf_dir))
    return gc.pack_liveness(index, live).withColumn("liveness", F.round("liveness", 6))


@query(with_sql("manifest_entries pins", _LIVE + " SELECT pack_id, total, live_count, liveness, action FROM plan", True))
def gc_sweep_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, _, live = _gc(Store(spark, sf_dir))
    return gc.sweep_plan(gc.pack_liveness(index, live), 30, 0.2).withColumn("liveness", F.round("liveness", 6))


@query(with_sql("manifest_entries pins", _LIVE + """ SELECT count(*) FILTER (WHERE action = 'DELETE') AS packs_deleted, count(*) FILTER (WHERE action = 'COMPACT') AS packs_compacted, CAST(coalesce(sum(live_count) FILTER (WHERE action = 'COMPACT'), 0) AS BIGINT) AS pages_copied,
CAST(coalesce(sum(total - CASE WHEN action = 'COMPACT' THEN live_count ELSE 0 END) FILTER (WHERE action != 'KEEP'), 0) AS BIGINT) AS pages_reclaimed, CAST(coalesce(sum(total - CASE WHEN action = 'COMPACT' THEN live_count ELSE 0 END) FILTER (WHERE action != 'KEEP'), 0) * 4133 AS BIGINT) AS bytes_reclaimed FROM plan""", True))
def gc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, index, _, live = _gc(Store(spark, sf_dir))
    return gc.sweep_report(gc.sweep_plan(gc.pack_liveness(index, live), 30, 0.2))


@query(with_sql("manifest_entries pins", _LIVE + " SELECT snapshot_ref FROM manifests WHERE snapshot_ref NOT IN (SELECT snapshot_ref FROM live)", True))
def gc_manifest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers, _, _, live, _ = _gc(Store(spark, sf_dir))
    return _hashed(gc.dead_manifests(layers, live))


@query(with_sql("manifest_entries pins", _LIVE + """ SELECT page_hash, CAST(CASE WHEN action = 'COMPACT' THEN 32 + dense_rank() OVER (PARTITION BY action = 'COMPACT' ORDER BY pack_id) - 1 ELSE pack_id END AS INT) AS pack_id
FROM ix LEFT JOIN (SELECT pack_id, action FROM plan) USING (pack_id) WHERE action IS NULL OR action = 'KEEP' OR (action = 'COMPACT' AND page_hash IN (SELECT page_hash FROM live_pages))""", True))
def gc_swept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a sweep; a pack's entries are in the order of their hashes."""
    _, _, index, _, live = _gc(Store(spark, sf_dir))
    index = materialise(index.withColumn("offset", F.xxhash64("page_hash")), "index")  # read four times
    live = materialise(live, "live")
    plan = gc.sweep_plan(gc.pack_liveness(index, live), 30, 0.2)
    return _hashed(gc.swept_index(index, plan, live, 32).select("page_hash", "pack_id"))


# ------------------------------------------------------------------ integrity

_LOST = "SELECT snapshot_ref FROM manifests WHERE o_orderkey % 10 != 0"


@query(with_sql("pins manifests", f" SELECT 'DanglingPin' AS violation, snapshot_ref AS subject, note AS detail FROM pins WHERE snapshot_ref NOT IN ({_LOST})"))
def fsck_dangling_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return fsck.dangling_pins(s.pins, s.layers.where("o_orderkey % 10 != 0"))


def _bound(s: Store) -> DataFrame:
    """Nodes whose snapshots are layers."""
    return s.nodes.withColumn("snapshot_ref", sha("m:", F.col("node_id").cast("string")))


_BOUND = ", bound AS (SELECT experiment_id, node_id, status, sha256('m:' || node_id) AS snapshot_ref FROM nodes)"


@query(with_sql("nodes manifests", _BOUND + f" SELECT 'MissingManifest' AS violation, snapshot_ref AS subject, experiment_id || '/' || node_id AS detail FROM bound WHERE status != 3 AND snapshot_ref NOT IN ({_LOST})"))
def fsck_missing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return fsck.missing_manifests(_bound(s), s.layers.where("o_orderkey % 10 != 0"))


@query(with_sql("nodes manifests", _BOUND + f" SELECT experiment_id, node_id, snapshot_ref, 3 AS new_status FROM bound WHERE status != 3 AND snapshot_ref NOT IN ({_LOST})"))
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return fsck.reconcile_plan(_bound(s), s.layers.where("o_orderkey % 10 != 0"))


@query(with_sql("manifest_entries", " SELECT 'MissingPage' AS violation, page_hash AS subject, snapshot_ref || '#' || page_index AS detail FROM manifest_entries WHERE page_hash LIKE '0%'"))
def fsck_missing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = Store(spark, sf_dir).entries
    index = entries.where(~P.page("page_hash").startswith("0")).select("page_hash").distinct()
    return fsck.page_violations(_hashed(pages.missing_pages(entries, index)))


@query(with_sql("nodes", " SELECT 'MissingInputLog' AS violation, input_log_id AS subject, experiment_id || '/' || node_id AS detail FROM nodes WHERE input_log_id IS NOT NULL AND input_log_id NOT IN (SELECT log_id FROM input_logs WHERE page_id % 4 != 0)"))
def fsck_missing_input_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return fsck.missing_input_logs(s.nodes, s.logs.where("page_id % 4 != 0"))


@query(with_sql("page_index", """, packs AS (SELECT pack_id, count(*) + CASE WHEN pack_id % 3 = 0 THEN 1 ELSE 0 END AS record_count FROM page_index GROUP BY pack_id)
SELECT 'SidecarRecordCountMismatch' AS violation, CAST(pack_id AS VARCHAR) AS subject, (record_count - 1) || '!=' || record_count AS detail FROM packs WHERE pack_id % 3 = 0"""))
def fsck_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = P.page_index(Store(spark, sf_dir).blocks)
    packs = ix.groupBy("pack_id").agg((F.count("*") + F.when(F.col("pack_id") % 3 == 0, 1).otherwise(0)).alias("record_count"))
    return fsck.count_mismatches(ix, packs)


@query(with_sql("nodes pins manifest_entries", _BOUND + f""",
found AS (SELECT 'MissingManifest' AS violation FROM bound WHERE status != 3 AND snapshot_ref NOT IN ({_LOST}) UNION ALL SELECT 'DanglingPin' FROM pins WHERE snapshot_ref NOT IN ({_LOST}) UNION ALL SELECT 'MissingPage' FROM manifest_entries WHERE page_hash LIKE '0%' UNION ALL SELECT 'MissingInputLog' FROM nodes WHERE input_log_id IS NOT NULL AND input_log_id NOT IN (SELECT log_id FROM input_logs WHERE page_id % 4 != 0))
SELECT violation, count(*) AS n FROM found GROUP BY violation"""))
def fsck_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsck.report(*[f(spark, sf_dir) for f in (fsck_missing_manifest, fsck_dangling_pin, fsck_missing_page, fsck_missing_input_log)])


# ------------------------------------------------------------------ containers and streams


@query(with_sql("manifest_entries", " SELECT page_index, page_hash FROM manifest_entries"))
def manifest_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers as containers and back: the entries that were decoded."""
    s = Store(spark, sf_dir)
    layers = s.numbered
    entry = F.struct("page_index", F.unhex(P.page("page_hash")).alias("page_hash"))
    held = s.entries.groupBy("snapshot_ref").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    blob = F.struct(F.lit(7).cast("bigint").alias("format"), F.lit(False).alias("zstd"), F.lit("device").cast("binary").alias("bytes"), F.lit(6).cast("bigint").alias("raw_len"))
    made = layers.join(held, "snapshot_ref").select(F.unhex(P.ref("parent_ref")).alias("parent_ref"), "guest_ram_bytes", "entries", blob.alias("device_blob"))
    back = containers.decode_manifests(containers.encode_manifests(made), "container").where("error IS NULL")
    return back.select(F.explode("entries").alias("e")).select("e.page_index", F.lower(F.hex("e.page_hash")).alias("page_hash"))


@query(with_sql("input_logs", " SELECT content FROM input_logs"))
def input_log_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = containers.decode_logs(containers.encode_logs(Store(spark, sf_dir).logs, "content"))
    return back.where("error IS NULL").select(F.col("payload").cast("string").alias("content"))


@query("""SELECT c_custkey // 1000 AS pack_id, 20 + 4133 * (row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1) AS "offset", sha256(c_name) AS page_hash, sha256(repeat(sha256(c_name), 64)) AS payload_hash FROM customer""")
def pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as pack files and read back from them."""
    c = P.table(spark, sf_dir, "customer").select(F.sha2("c_name", 256).alias("h"), F.floor(F.col("c_custkey") / 1000).alias("pack_id"), F.col("c_custkey").alias("offset"))
    folder = scratch(spark, "packs")
    written = containers.write_packs(c.select(F.unhex("h").alias("page_hash"), F.repeat("h", 64).cast("binary").alias("payload"), "pack_id", "offset"), folder)
    written.count()
    back = containers.read_packs(containers.files(spark, folder, "*.spk")).where("error IS NULL")
    return back.select("pack_id", "offset", F.lower(F.hex("page_hash")).alias("page_hash"), F.sha2("payload", 256).alias("payload_hash"))


@query("""SELECT c_custkey // 1000 AS pack_id, 20 + 4133 * (row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1) AS "offset", sha256(c_name) AS page_hash FROM customer""")
def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as loaded from the sidecars of those packs."""
    c = P.table(spark, sf_dir, "customer").select(F.sha2("c_name", 256).alias("h"), F.floor(F.col("c_custkey") / 1000).alias("pack_id"), F.col("c_custkey").alias("offset"))
    folder = scratch(spark, "packs")
    containers.write_packs(c.select(F.unhex("h").alias("page_hash"), F.repeat("h", 64).cast("binary").alias("payload"), "pack_id", "offset"), folder).count()
    back = containers.read_sidecars(containers.files(spark, folder, "*.idx")).where("error IS NULL")
    return back.select("pack_id", "offset", F.lower(F.hex("page_hash")).alias("page_hash"))


@query("""SELECT CAST(c_custkey // 1000 AS INT) AS pack_id, 20 + 4133 * (row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1) AS "offset", sha256(c_name) AS page_hash FROM customer""")
def recovered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index when the sidecars of odd packs are lost and read again from the records."""
    c = P.table(spark, sf_dir, "customer").select(F.sha2("c_name", 256).alias("h"), F.floor(F.col("c_custkey") / 1000).alias("pack_id"), F.col("c_custkey").alias("offset"))
    folder = scratch(spark, "packs")
    written = containers.write_packs(c.select(F.unhex("h").alias("page_hash"), F.repeat("h", 64).cast("binary").alias("payload"), "pack_id", "offset"), folder)
    for row in written.where("pack_id % 2 = 1").select("path").collect():
        remove(spark, f"{folder}/{row['path'].rsplit('/', 1)[1][:-4]}.idx")
    return containers.recover_index(spark, folder).select("pack_id", "offset", F.lower(F.hex("page_hash")).alias("page_hash"))


@query(with_sql("tombstones", " SELECT CAST(count(*) AS BIGINT) AS cycles_total, max(created_at) AS last_fence_counter, CAST(77 AS BIGINT) AS last_finished_at, CAST(4133 AS BIGINT) AS last_freed_bytes FROM tombstones"))
def gc_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state row after a cycle."""
    state = P.tombstones(_nodes(spark, sf_dir)).agg(F.count("*").alias("cycles_total"), F.max("created_at").alias("last_fence_counter"), F.lit(0).cast("bigint").alias("last_finished_at"), F.lit(0).cast("bigint").alias("last_freed_bytes"))
    return mutations.set_gc_state(state, last_finished_at=77, last_freed_bytes=4133)


@query("SELECT sha256(event_type || ':' || (user_id % 50)) AS page_hash FROM events GROUP BY 1")
def stream_distinct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of pages, deduplicated with state, all that is there."""
    from ..streaming.ingest import distinct_pages

    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/events*.parquet")
    hashed = stream.select(sha(F.col("event_type"), ":", (F.col("user_id") % 50).cast("string")).alias("page_hash"))
    out = scratch(spark, "stream")
    run = distinct_pages(hashed).writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("page_hash string").parquet(f"{out}/table")


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


@cache
def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
