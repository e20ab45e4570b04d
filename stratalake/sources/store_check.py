"""The integrity check of a whole store: its files and its tables, shallow or deep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fsck
from ..session import materialise
from . import containers


def _stem() -> Column:
    """The name that a pack and its sidecar share."""
    return F.regexp_extract("path", r"(pack-[0-9a-fA-F]{8})\.(spk|idx)$", 1)


def _hexed(table: DataFrame) -> DataFrame:
    """The binary ids of a table as hex text."""
    ids = [c for c, t in table.dtypes if t == "binary" and c in ("snapshot_ref", "input_log_id", "log_id")]
    return table.withColumns({c: F.lower(F.hex(c)) for c in ids})


def pack_violations(packs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """packs: containers.pack_facts with stem; sidecars: stem, listed, damaged. All that is wrong with a pack in one pass; its own
    records stand in for a sidecar that is missing or damaged."""
    both = packs.join(sidecars, "stem", "left")
    damaged = F.coalesce("damaged", F.lit(False))
    usable = F.col("listed").isNotNull() & ~damaged
    listed = F.when(usable, F.col("listed")).otherwise(F.col("records"))
    sealed = F.col("sealed")

    def hit(when, kind: str, subject, detail):
        return F.when(when, F.struct(F.lit(kind).alias("violation"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")))

    path = F.col("path")
    whole = F.array(
        hit(sealed & damaged, "BadSidecarCrc", path, F.lit("sidecar")),
        hit(sealed & usable & (F.col("listed") != F.col("records")), "SidecarRecordCountMismatch", path, F.concat_ws("!=", "listed", "records")),
        hit(sealed & (F.col("promised") != listed), "BadPackFooter", path, F.concat_ws("!=", F.col("promised"), listed)),
        hit(F.col("bad_body"), "BadPackBodyHash", path, F.lit("body")),
    )
    records = F.transform("bad_records", lambda at: F.struct(F.lit("RecordHashMismatch").alias("violation"), path.alias("subject"), at.cast("string").alias("detail")))
    return both.select(F.explode(F.concat(F.filter(whole, lambda x: x.isNotNull()), records)).alias("v")).select("v.violation", "v.subject", "v.detail")


def check_store(spark: SparkSession, folder: str, nodes: DataFrame, pins: DataFrame, input_logs: DataFrame, deep: bool = False) -> DataFrame:
    """violation, subject, detail of all that is wrong with a store: folder has pages (packs and sidecars) and manifests;
    nodes, pins and input_logs (log_id, content) are its tables.

    Shallow, all classes but RecordHashMismatch, BadPackBodyHash and BadInputLogFooter, which deep adds. A damaged
    manifest counts as not stored. Unsealed packs are read up to their first torn record and need no sidecar.
    """
    packs = containers.files(spark, f"{folder}/pages", "*.spk").withColumn("stem", _stem())
    entries = materialise(containers.read_sidecars(containers.files(spark, f"{folder}/pages", "*.idx")).withColumn("stem", _stem()), "sidecars")
    empty = containers.files(spark, f"{folder}/pages", "*.idx").select(_stem().alias("stem"))
    counted = entries.groupBy("stem").agg(F.count_if(F.col("error").isNull()).alias("listed"), (F.count_if(F.col("error").isNotNull()) > 0).alias("damaged"))
    sidecars = materialise(empty.join(counted, "stem", "left").select("stem", F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("damaged", F.lit(False)).alias("damaged")), "sidecar-counts")
    facts = materialise(containers.pack_facts(packs, deep).withColumn("stem", _stem()), "pack-facts")

    layers = materialise(containers.layer_facts(containers.files(spark, f"{folder}/manifests", "*.spm")), "layer-facts")
    sound = layers.where("error IS NULL")
    # pages of sealed packs are where their sidecars say; of all others where their records are
    by_sidecar = facts.where("sealed").join(sidecars.where("NOT damaged"), "stem", "left_semi").select("stem")
    scanned = containers.read_packs(packs.join(by_sidecar, "stem", "left_anti")).where("page_hash IS NOT NULL").select("page_hash")
    index = entries.where("error IS NULL").join(by_sidecar, "stem", "left_semi").select("page_hash").unionByName(scanned)
    needed = sound.select("snapshot_ref", F.explode("entries").alias("e")).select(F.lower(F.hex("snapshot_ref")).alias("snapshot_ref"), "e.page_index", F.col("e.page_hash").alias("page_hash"))
    absent = needed.join(index, "page_hash", "left_anti")

    found = [
        pack_violations(facts, sidecars),
        fsck.failed(layers.where("error = 'BadFooter'"), "BadManifestFooter", "path"),
        fsck.failed(layers.where("error != 'BadFooter'").withColumn("ref", F.lower(F.hex("snapshot_ref"))), "BadManifestDecode", "ref"),
        absent.select(F.lit("MissingPage").alias("violation"), F.lower(F.hex("page_hash")).alias("subject"), F.concat_ws("#", "snapshot_ref", "page_index").alias("detail")),
        fsck.missing_manifests(_hexed(nodes), _hexed(sound)),
        fsck.dangling_pins(_hexed(pins), _hexed(sound)),
        fsck.missing_input_logs(_hexed(nodes), _hexed(input_logs)),
    ]
    if deep:
        found.append(fsck.failed(containers.log_facts(input_logs).withColumn("id", F.lower(F.hex("log_id"))), "BadInputLogFooter", "id"))
    return reduce(DataFrame.unionByName, found)
