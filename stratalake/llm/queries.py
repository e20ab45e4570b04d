"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json"))).drop("uid")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import langid, toxicity
    from .common import held_out

    documents = _table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"), ~held, languages=langid.fit(documents, ~held))
    return toxicity.score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_avi_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .avi import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import quality
    from .common import held_out

    documents = _table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(documents, _table(spark, sf_dir, "labels"), ~held)
    return quality.score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import langid
    from .common import held_out

    documents = _table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(documents, ~held)
    return langid.predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import RULES, STANDARD, judge

    return judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(STANDARD, RULES))


def op9_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import registry, scan

    return scan(_table(spark, sf_dir, "documents"), registry(spark))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .warc import read_archives, write_archives

    folder = scratch(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: All pairs that share an n-gram, for small tables: the classes and links that the join must find.
NGRAM_JOIN_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM split WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y, ky.k AS ky, kx.k = ky.k AS same FROM pairs JOIN sets kx ON kx.doc_id = x JOIN sets ky ON ky.doc_id = y WHERE c >= 0.8 * (kx.n + ky.n - c) - 1e-9),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
counts AS (SELECT x AS doc_id, count(*) AS links, count(DISTINCT ky) FILTER (WHERE NOT same) AS class_links FROM links GROUP BY x),
copies AS (SELECT k, min(doc_id) AS copy_id, count(*) AS copies FROM sets GROUP BY k)
SELECT doc_id, class_id, coalesce(copy_id, doc_id) AS copy_id, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links, coalesce(class_links, 0) AS class_links
FROM classes LEFT JOIN sets USING (doc_id) LEFT JOIN copies USING (k) LEFT JOIN counts USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import licenses, urlfilter, warc

    return {"op7_ngram_jaccard_join": NGRAM_JOIN_SQL, "op8_url_filter": urlfilter.ORACLE_SQL, "op9_license_digest": licenses.ORACLE_SQL, "op10_warc_round_trip": warc.ORACLE_SQL}
