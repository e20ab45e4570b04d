"""What plans send between tasks."""

import re

import pytest
from tables import SF

from stratalake.operators import pages, stats
from stratalake.plans import queries as plans


def below(df, node):
    """The parts of the plan below each node of that name, as text."""
    found, lines = [], df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].split("\n")
    depth = [len(re.match(r"[\s:+|-]*(\*\(\d+\) )?", x)[0].removesuffix(" ").rstrip("*()0123456789")) for x in lines]
    for i, line in enumerate(lines):
        if re.match(rf"[\s:+|-]*{node} ", line):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i + 1 : end]))
    return found


@pytest.mark.parametrize("name", ["gc_report", "gc_sweep_plan", "gc_swept_index"])
def test_no_broadcast_of_exploded_rows(spark, name):
    """Spark takes what explode() makes for as small as what goes in. The 64 rows of each FULL layer, 150 kB here, were under 20 kB to it."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        df = plans.queries()[name](spark, SF)
        assert not [x for x in below(df, "BroadcastExchange") if "Generate explode" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("lost", [False, True])
def test_hot_page_is_not_in_one_task(spark, monkeypatch, lost):
    """A page of most entries, stored or lost, beside ones with few, one of them lost."""
    monkeypatch.setattr(pages, "HOT_PAGE", 10)
    entries = spark.range(4000).selectExpr("id AS snapshot_ref", "0L AS page_index", "CASE WHEN id % 100 < 98 THEN 'zero' ELSE concat('p', id) END AS page_hash")
    index = entries.select("page_hash").distinct().where("page_hash != 'p99'" + " AND page_hash != 'zero'" * lost)
    found = pages.missing_pages(entries, index, 50)
    assert sorted(r["snapshot_ref"] for r in found.collect()) == sorted([99] + [i for i in range(4000) if lost and i % 100 < 98])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [len(x) for x in pages.missing_pages(entries, index, 50).rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == (3921 if lost else 1) and max(sizes) < 2000


@pytest.mark.parametrize("n", [0, 1, 2, 101, 5000])
def test_percentiles_in_ranges(spark, duck, n):
    """Ties, nulls, no rows; no task gets all values."""
    df = spark.range(n).selectExpr("CASE WHEN id % 7 = 6 THEN NULL ELSE CAST(id * 7919 % 1013 AS double) END AS v")
    got = stats.percentiles(df, "v")
    want = duck.sql(f"SELECT quantile_disc(v, 0.5), quantile_disc(v, 0.95), quantile_disc(v, 0.99) FROM (SELECT CASE WHEN id % 7 = 6 THEN NULL ELSE CAST(id * 7919 % 1013 AS DOUBLE) END AS v FROM range({n}) r(id))").fetchall()
    assert [tuple(r) for r in got.collect()] == want
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_new_pages_read_a_table(spark):
    """Counts, bounds and places of new pages do not make the outcomes anew."""
    outcomes = spark.range(300).selectExpr("id AS ordinal", "sha2(CAST(id AS string), 256) AS page_hash", "id % 3 = 0 AS newly_written")
    placed = pages.stored(outcomes, 100, 10)
    assert "Range (" not in placed._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["pack_id"], r["offset"]) for r in placed.collect())
    assert got == [(100 + k // 10, 20 + 4133 * (k % 10)) for k in range(100)]


def test_pages_are_fetched_by_binary_hashes(spark):
    dealt = below(plans.queries()["page_fetch"](spark, SF), "Exchange")
    assert dealt and all("unhex" in x for x in dealt)


def test_creates_without_a_log_are_dealt_out(spark):
    """They have one key, null, and would meet in one task."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.queries()["create_node_apply"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert re.search(r"hashpartitioning\(input_log_id#\d+, _salt#\d+L?,", plan)
