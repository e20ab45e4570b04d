"""URL filters: host-suffix and path-prefix rules by hash prefix.

A URL's host and its suffixes at dots, of as many labels as hosts of rules have, each with the path's prefixes of the
lengths that rules have, are its expressions. Distinct expressions equi-join the rules on the first hex digits of their
SHA-256; then full digests decide, and of the rules that fit the longest wins (then the longer host, then block before
allow).

Rules are broadcast only up to ``broadcast_rules`` of them and ``broadcast_bytes`` of text; beyond that both sides
shuffle on the hash prefix, with the URL side salted, as one expression (``com/``) may be in most rows. Columns of
built-in functions alone.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits, and so the default
verdict; an empty rule table gives the default everywhere; a rule without a host or a ``/`` fits nothing; a URL of any
length is judged whole, at a cost in proportion to its length; repeated rows get equal results; of equal rules with
different verdicts block wins; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

RULES = "rule string, verdict string"
#: The rules of the registered query.
STANDARD = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds host (A-Z lower-cased) and path, both empty without ``://``."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    return (
        df.withColumn("_rest", rest)
        .withColumn("host", F.translate(host, string.ascii_uppercase, string.ascii_lowercase))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url", digits: int = 8, broadcast_rules: int = 100_000, broadcast_bytes: int = 16 << 20, salts: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict of each row. rules: rule (host and path, as one string), verdict."""
    pages = split_url(urls.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")), "url").select("page_id", "host", "path")
    known = rules.where(F.instr("rule", "/") > 1).groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block > allow
    known = known.withColumns({"digest": F.sha2("rule", 256), "cut": F.instr("rule", "/")}).withColumn("prefix", F.substring("digest", 1, digits))
    rule_labels = F.size(F.split(F.expr("substring(rule, 1, cut - 1)"), r"\."))
    facts = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("rule")).alias("bytes"), F.sort_array(F.collect_set(F.length("rule") - F.col("cut") + 1)).alias("lengths"), F.sort_array(F.collect_set(rule_labels)).alias("labels")).first()
    n, lengths = facts["n"], facts["lengths"]
    if not n:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    sites = pages.where("host != '' AND path != ''").select("host", "path").distinct()
    # a suffix of k labels stands only in a host of at least k
    most = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*[F.when(most >= k, F.substring_index("host", ".", -k)) for k in facts["labels"]]))
    fits = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda k: k <= F.length("path"))
    exploded = sites.select("host", "path", F.explode(suffixes).alias("suffix"), fits.alias("fits")).select("host", "path", "suffix", F.explode("fits").alias("k"))
    digest = F.sha2(F.concat("suffix", F.expr("substring(path, 1, k)")), 256)
    exploded = exploded.select("host", "path", digest.alias("full")).withColumn("prefix", F.substring("full", 1, digits))
    table = known.select("prefix", "digest", "rule", "verdict", "cut")
    if n <= broadcast_rules and facts["bytes"] <= broadcast_bytes:
        found = exploded.join(F.broadcast(table), "prefix")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = exploded.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")).join(salted, ["prefix", "salt"])
    best = found.where("full = digest").groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "cut", "verdict", "rule")).alias("best"))
    # a table of its own and a merge join, so that adaptive execution can split the join at a URL of many rows
    best = materialise(best, "verdicts").hint("merge")
    return pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


_VALUES = ", ".join(f"('{r}', '{v}')" for r, v in STANDARD)
ORACLE_SQL = f"""
WITH rules(rule, rule_verdict) AS (VALUES {_VALUES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
cut AS (SELECT rule, rule_verdict, substr(rule, 1, strpos(rule, '/') - 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
best AS (SELECT host, path, max(struct_pack(size := length(rule), rule := rule, verdict := rule_verdict)) AS best
    FROM (SELECT DISTINCT host, path FROM split) JOIN cut
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT s.page_id, s.host, s.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM split s LEFT JOIN best ON s.host = best.host AND s.path = best.path
"""
