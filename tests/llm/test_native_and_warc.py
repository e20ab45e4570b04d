"""URL rules, licence digests and archives: DuckDB, brute force, exact round trips."""

import base64
import gzip
import hashlib
import random

import pytest
from tables import SF, rows

from stratalake.llm import licenses, queries, urlfilter, warc


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF).toArrow()
    assert rows(got) == rows(duck.sql(queries.oracle_sql()[name]).to_arrow_table())


def judged(url, rules, default):
    """One URL by hand."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r.index("/"), v, r) for r, v in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.mark.parametrize("bound", [100_000, 0])
def test_rules(spark, bound):
    rng = random.Random(bound)
    hosts = ["a.com", "b.a.com", "com", "xa.com", "A.Com", "a.com:80", "", "..a.com", "é.a.com"]
    paths = ["", "/", "/x", "/x/y", "/xyz", "/x/y/z?q#f", "?q", "#f", "/é"]
    rules = [(f"{rng.choice(['com', 'a.com', 'b.a.com', 'a.com:80'])}{rng.choice(['/', '/x', '/x/', '/x/y', '/é'])}", rng.choice(["allow", "block"])) for _ in range(14)]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "", "x") for h in hosts for p in paths] + [None, "://", "http://u@a.com/x", "a://b://c.com/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, spark.createDataFrame(rules, urlfilter.RULES), broadcast_rules=bound).collect()}
    assert got == {k: judged(u, rules, "allow") for k, u in enumerate(urls)}


def test_rules_awkward(spark):
    df = spark.createDataFrame([(None, "http://a.com/x", "k"), (1, None, "k"), (1, None, "k")], "page_id bigint, url string, rule string")
    none = spark.createDataFrame([], urlfilter.RULES)
    assert {r["verdict"] for r in urlfilter.judge(df, none, "block").collect()} == {"block"}
    some = spark.createDataFrame([("com/", "allow"), ("com/", "block")], urlfilter.RULES)
    assert sorted(r["verdict"] for r in urlfilter.judge(df, some).collect()) == ["allow", "allow", "block"]
    assert urlfilter.judge(df.where("false"), some).count() == 0


def test_licences(spark, awkward, nothing):
    mit = licenses.KNOWN[4][1]
    british = mit.replace("software", "Software").upper() + "\n\nCopyright (c) 2020 Somebody\n"
    texts = [(1, mit), (2, "Copyright 1999 A\n" + mit), (3, british), (4, "  released UNDER the mit licence!  "), (5, "words\nReleased under the MIT License.\nmore\nLicensed under CC BY-NC 4.0."), (6, mit + " more")]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), licenses.registry(spark)).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("MIT", "MIT"), 5: (None, "CC-BY-NC-4.0,MIT"), 6: (None, "")}
    known = licenses.registry(spark)
    assert licenses.scan(awkward, known).count() == 11 and licenses.scan(nothing, known).count() == 0
    empty = {r["digest"] for r in licenses.scan(awkward, known).collect() if r["doc_id"] in (1, 2, 3, 4)}
    assert empty == {hashlib.sha256(b"").hexdigest()}


PAGES = [(k, f"http://h/{k}\r\nX: y", f"page {k % 7} é") for k in range(40)] + [(5, "u", "page 5 é"), (90, None, None), (91, "u", ""), (None, "u", "page 1 é"), (None, "u", "alone"), (92, "x y", "\r\n\r\nWARC/1.1\r\n")]


def test_archives(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(5)
    config = warc.WarcConfig(shard_bytes=4000, file_bytes=700)
    one = warc.write_archives(df, f"file://{tmp_path}/one", config)
    two = warc.write_archives(df.repartition(3), f"file://{tmp_path}/two", config)
    assert sorted(map(tuple, one.drop("temporary").collect())) == sorted(map(tuple, two.drop("temporary").collect()))  # the same files
    assert one.count() > 4 and not (tmp_path / "one" / "_temporary").exists()
    for r in one.collect():
        raw = (tmp_path / "one" / r["name"]).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == r["sha256"] and len(raw) == r["bytes"]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    got = warc.read_archives(spark, f"file://{tmp_path}/one", True).collect()
    assert sorted((str(r["page_id"]), bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response") == sorted((str(i), h or "") for i, _, h in {(i, None, h) for i, _, h in PAGES if h not in [x for j, _, x in PAGES if j is not None and (i is None or j < i)] and not (i == 91)})
    first = {}
    for i, _, h in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    for r in got:
        if r["page_id"] is not None and r["record_type"] == "revisit":
            assert r["refers_to"] <= r["page_id"]
    want = {}
    for i, _, h in PAGES:
        raw = (h or "").encode()
        want.setdefault(str(i), set()).add((len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), first.get(h or "") if i is None or first[h or ""] != i else None))
    for r in got:
        options = {x[:2] for x in want[str(r["page_id"])]}
        assert (r["payload_bytes"], r["payload_digest"]) in options
        if r["page_id"] is not None and r["page_id"] != 5:
            assert r["refers_to"] in {x[2] for x in want[str(r["page_id"])]}
    assert sum(r["page_id"] == 5 and r["record_type"] == "response" for r in got) == 1
    assert len(got) == len(PAGES)


def test_small_payloads_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id bigint, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w", warc.WarcConfig(revisit_bytes=5))
    assert {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()} == {1: None, 2: None, 3: None, 4: 3}
    warc.write_archives(df.where("false"), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_damage_is_noticed():
    raw = warc.page_record(1, "u", b"payload", None, warc.WarcConfig())
    record = next(warc.members(raw))
    assert warc.parse_record(record)[1].endswith(b"payload")
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload", b"poyload"))
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1")


def archive_of(spark, folder, rows, **config):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write_archives(df, folder, warc.WarcConfig(**config)).collect()
    got = warc.read_archives(spark, folder, True).collect()
    assert len(got) == len(rows)
    return manifest, got


def test_shards_with_outlying_and_null_ids(spark, tmp_path):
    """One outlying id, an id with many rows and many null ids: no shard is much larger than asked for."""
    html = lambda k: f"{k} " + "x" * 600
    rows = [(k, f"u{k}", html(k)) for k in range(300)] + [(2**63 - 1, "u", "out"), (-(2**63), "u", "low")] + [(400, f"u{k}", html(1000 + k)) for k in range(300)] + [(None, f"u{k}", html(5)) for k in range(300)]
    manifest, got = archive_of(spark, f"file://{tmp_path}/w", rows, shard_bytes=20_000, file_bytes=1 << 30)
    assert max(r["records"] for r in manifest) <= 45 and len(manifest) >= 35
    assert sorted(r["shard"] for r in manifest) == [r["shard"] for r in sorted(manifest, key=lambda r: r["name"])]
    assert all(r["refers_to"] == 5 for r in got if r["page_id"] is None)
    by_file = {}
    for r in sorted(manifest, key=lambda r: r["name"]):
        raw = (tmp_path / "w" / r["name"]).read_bytes()
        by_file[r["name"]] = [int(h["x-page-id"]) for h in (warc.parse_record(m)[0] for m in warc.members(raw)) if "x-page-id" in h]
    ids = [i for own in by_file.values() for i in own]
    assert ids == sorted(ids)


def test_a_crash_between_manifest_and_renames(spark, tmp_path, monkeypatch):
    rows = [(k, "u", f"page {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    with monkeypatch.context() as m:
        m.setattr(warc, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            warc.write_archives(df, folder, warc.WarcConfig(file_bytes=1000))
    assert not list((tmp_path / "w").glob("*.warc.gz"))
    with pytest.raises(FileExistsError):
        warc.write_archives(df, folder)
    for _ in range(2):
        assert warc.commit(spark, folder).count() == len(list((tmp_path / "w").glob("*.warc.gz"))) > 2
        assert warc.read_archives(spark, folder).count() == 50
    assert not (tmp_path / "w" / "_temporary").exists()


def test_long_payloads_and_torn_files(spark, tmp_path):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh é") for _ in range(1_500_000))
    _, got = archive_of(spark, f"file://{tmp_path}/w", [(1, "u", long), (2, "u", "x"), (3, "u", long)])
    assert {r["page_id"]: len(r["payload"]) for r in got if r["record_type"] == "response"} == {1: len(long.encode()), 2: 1}
    raw = warc.page_record(1, "u", b"payload", None, warc.WarcConfig())
    assert len(list(warc.members(raw * 3))) == 3
    with pytest.raises(ValueError):
        list(warc.members(raw + raw[:-3]))


def test_extra_columns_of_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a", 5, "s", 7), (2, "u", "a", 6, "t", 8)], "page_id bigint, url string, html string, shard int, print string, first bigint")
    warc.write_archives(df, f"file://{tmp_path}/w")
    assert {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()} == {1: None, 2: 1}


def test_very_long_urls(spark):
    host, path = "a." * 400_000 + "b.a.com", "/x" * 200_000
    urls = [f"http://{host}/x/y", f"http://a.com{path}", f"http://{'a' * 10**6}.com/x", f"x://a.com?{path}"]
    rules = [("a.com/x", "block"), ("b.a.com/x/", "allow"), ("com/", "allow")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"])) for r in urlfilter.judge(df, spark.createDataFrame(rules, urlfilter.RULES), "none").collect()}
    assert got == {0: ("b.a.com/x/", "allow", len(host)), 1: ("a.com/x", "block", 5), 2: ("com/", "allow", 10**6 + 4), 3: (None, "none", 5)}
