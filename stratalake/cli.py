"""Command line over a catalog: python -m stratalake.cli ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .operators import fsck, gc, mutations, stats, tree
from .schema import STATUS, from_hex, hex_text
from .session import materialise, session
from .sources.catalog import Catalog
from .sources.containers import log_facts
from .sources.store_check import check_store


def _show(df, out=None) -> None:
    """One JSON object a line; binary columns as hex. Rows stream from the executors."""
    out = out or sys.stdout
    cols = [hex_text(F.col(c)).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    for row in df.select(*cols).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str), file=out)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalake")
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("stats").add_argument("--experiment")
    d = sub.add_parser("dump-manifest")
    d.add_argument("ref")
    g = sub.add_parser("get-node")
    g.add_argument("experiment")
    g.add_argument("node", type=int)
    q = sub.add_parser("query")
    q.add_argument("experiment")
    q.add_argument("--status", choices=list(STATUS))
    for name in ("parent", "min-depth", "max-depth", "created-after", "updated-after", "limit"):
        q.add_argument(f"--{name}", type=int)
    q.add_argument("--order", choices=tree.ORDERS, default="created_at")
    r = sub.add_parser("prune")
    r.add_argument("experiment")
    r.add_argument("node", type=int)
    r.add_argument("--allow-root", action="store_true")
    pin = sub.add_parser("pin")
    pin.add_argument("ref")
    pin.add_argument("--note", default="")
    sub.add_parser("unpin").add_argument("ref")
    kv = sub.add_parser("kv").add_subparsers(dest="action", required=True)
    for action in ("get", "put", "delete"):
        k = kv.add_parser(action)
        k.add_argument("key")
        if action == "put":
            k.add_argument("value")
        if action != "get":
            k.add_argument("--expected", type=int)
    c = sub.add_parser("gc")
    c.add_argument("--aggressive", action="store_true")
    f = sub.add_parser("fsck")
    f.add_argument("--files", help="folder with pages and manifests, whose files are checked too")
    f.add_argument("--deep", action="store_true", help="hash every record, pack and input log again")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = session("stratalake-cli")
    catalog = Catalog(spark, a.root)
    base = catalog.snapshot()
    counter = base.meta["logical_counter"] + 1
    nodes, pins, kv = base.table("nodes"), base.table("pins"), base.table("kv_metadata")
    if a.command == "stats":
        if a.experiment:
            _show(stats.experiment_stats(nodes.where(F.col("experiment_id") == a.experiment), base.table("input_logs")))
        else:
            _show(stats.global_stats(nodes, pins, base.table("tombstones"), kv, base.table("input_logs")).crossJoin(stats.dedup_ratio(base.table("manifests"), base.table("page_index"))))
    elif a.command == "dump-manifest":
        ref = from_hex(F.lit(a.ref))
        _show(base.table("manifests").where(F.col("snapshot_ref") == ref).drop("container", "device_blob"))
        _show(base.table("manifest_entries").where(F.col("snapshot_ref") == ref).orderBy("page_index"))
    elif a.command == "get-node":
        _show(tree.get_node(nodes, a.experiment, a.node))
    elif a.command == "query":
        filters = {k: getattr(a, k) for k in ("parent", "min_depth", "max_depth", "created_after", "updated_after")}
        _show(tree.query_nodes(nodes, a.experiment, order=a.order, limit=a.limit, status=None if a.status is None else STATUS[a.status], **filters))
    elif a.command == "prune":
        start = spark.createDataFrame([(a.experiment, a.node)], "experiment_id string, node_id bigint")
        after, marks, outcome = mutations.prune(nodes, base.table("tombstones"), start, counter, a.allow_root)
        told = outcome.first()
        if told["outcome"] != "PRUNED":
            print(told["outcome"], file=sys.stderr)
            return 1
        catalog.commit(base, {"nodes": after, "tombstones": marks}, logical_counter=counter)
        print(json.dumps({"pruned": told["pruned"]}))
    elif a.command in ("pin", "unpin"):
        ref = spark.range(1).select(from_hex(F.lit(a.ref)).alias("snapshot_ref"))
        if a.command == "pin":
            asked = ref.select(F.lit(0).alias("ordinal"), "snapshot_ref", F.lit(a.note).alias("note"), F.lit(counter).cast("bigint").alias("created_at"))
            outcome = mutations.pin(pins, asked, base.table("manifests"))
            told = outcome.first()["outcome"]
            after = mutations.apply_pins(pins, outcome)
        else:
            after, removed = mutations.unpin(pins, ref)
            told = "REMOVED" if removed.first()["removed"] else "ABSENT"
        if told in ("PINNED", "REMOVED"):
            catalog.commit(base, {"pins": after}, logical_counter=counter)
        print(json.dumps({"outcome": told}))
    elif a.command == "kv":
        key = F.lit(a.key).cast("binary")
        if a.action == "get":
            _show(kv.where(F.col("key") == key))
            return 0
        ask = spark.range(1).select(key.alias("key"), F.lit(getattr(a, "value", None)).cast("binary").alias("value"), F.lit(a.expected).cast("bigint").alias("expected"))
        if a.action == "put":
            outcomes = mutations.kv_put(kv, ask)
            told = outcomes.first()["outcome"]
            new = outcomes.where("outcome = 'STORED'").select("key", "value", "generation", F.lit(counter).cast("bigint").alias("updated_at"))
            after = kv.join(new.select("key"), "key", "left_anti").unionByName(new)
        else:
            after, outcomes = mutations.kv_delete(kv, ask)
            told = outcomes.first()["outcome"]
        if told in ("STORED", "DELETED"):
            catalog.commit(base, {"kv_metadata": after}, logical_counter=counter)
        print(json.dumps({"outcome": told}))
        return int(told in ("CONFLICT", "INVALID"))
    elif a.command == "gc":
        names = ["nodes", "tombstones", "input_logs", "pins", "manifests", "manifest_entries", "page_index"]
        tables = {n: base.table(n) for n in names}
        state = base.meta
        top = tables["page_index"].agg(F.max("pack_id")).first()[0]
        next_pack = 0 if top is None else top + 1
        done = gc.cycle(tables, gc.GcOptions.aggressive() if a.aggressive else gc.GcOptions(), state.get("last_fence", 0), max(0, next_pack - 1), next_pack)
        _show(done.report)
        pages = base.table("pages")
        kept = pages.drop("pack_id", "offset").join(done.index, "page_hash").select(*pages.columns)
        changed = {"nodes": done.nodes, "tombstones": done.tombstones, "input_logs": done.input_logs, "manifests": done.manifests, "manifest_entries": done.entries, "page_index": done.index, "pages": kept}
        catalog.commit(base, changed, logical_counter=counter, last_fence=counter, gc_cycles=state.get("gc_cycles", 0) + 1)
    elif a.command == "fsck":
        layers, index = base.table("manifests"), base.table("page_index")
        if a.files:
            bad = materialise(check_store(spark, a.files, nodes, pins, base.table("input_logs"), a.deep), "violations")
            _show(fsck.report(bad))
            return int(not fsck.is_ok(bad))
        found = [fsck.missing_manifests(nodes, layers), fsck.dangling_pins(pins, layers), fsck.missing_pages(base.table("manifest_entries"), index), fsck.missing_input_logs(nodes, base.table("input_logs"))]
        if a.deep:
            found.append(fsck.failed(log_facts(base.table("input_logs")), "BadInputLogFooter", "log_id"))
        _show(fsck.report(*found))
        return int(not fsck.is_ok(*found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
