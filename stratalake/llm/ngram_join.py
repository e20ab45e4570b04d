"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word n-grams are one class of copies. MinHash values of each class are cut into bands;
classes that agree in a band are candidates. Pairs of candidates compare their MinHash values a few at a time: with m
of n values equal and a uniform prior, a pair is dropped once the posterior probability of a similarity of at least
the threshold is below the tolerance. What remains joins into candidate components, whose pairs that survive the same
pruning are verified exactly on their n-gram sets: a small component as one group, a larger one cut into blocks of
bounded rows and n-grams, each pair of blocks a group. Where a component is a long chain rather than a cluster, so that
its blocks would be copied more often than those of its buckets, its buckets are the groups instead, and a pair counts in
the first one that it shares. Which is cheaper is counted exactly beforehand. Only counts and spanning links leave a
group, never all pairs.

At the defaults a pair at the threshold shares no band with probability (1 - 0.8^5)^32 = 3e-6, and pruning loses one
with less than 1e-6; pairs above it less.

Defined results: a null or empty text, or one without words, has no n-grams, links to nothing and is a class of its
own; a text of fewer words than n has one n-gram, all its words; repeated rows are copies of each other; a null id
counts as an id; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, discard, materialise, prepare, segments, slices, texts_of, words_of

U = np.uint64


@dataclass(frozen=True)
class JoinConfig:
    n: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    tolerance: float = 1e-7  #: posterior probability below which a pair is dropped
    step: int = 16  #: MinHash values compared at a time
    bucket: int = 512  #: classes of a bucket whose pairs are pruned there; a larger bucket links up whole, its pairs are pruned in blocks
    block_grams: int = 1_000_000  #: n-grams of a block, about
    block_rows: int = 512  #: classes of a block, about
    seed: int = 11


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def gram_sets(texts: list[str], n: int, hashes: WordHash) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    split = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    all_words = np.fromiter((hashes[w] for ws in split for w in ws), U, int(counts.sum()))
    out, at = [], 0
    combined = np.zeros(max(0, len(all_words) - n + 1), U)
    with np.errstate(over="ignore"):
        for k in range(n):
            combined = combined * U(0x9E3779B97F4A7C15) + all_words[k : k + len(combined)]
        combined = _mix(combined)
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(combined[at : at + c - n + 1]))
        elif c:
            out.append(np.array([xxhash.xxh3_64_intdigest(all_words[at : at + c].tobytes(), n)], U))
        else:
            out.append(np.empty(0, U))
        at += c
    return out


class MinHasher:
    def __init__(self, config: JoinConfig):
        rng = np.random.default_rng(config.seed)
        self.size = config.bands * config.rows
        self.a = rng.integers(1, 1 << 32, self.size, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.size, dtype=np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """Values of each set that is not empty, a row for each."""
        counts = np.array([len(s) for s in sets], np.int64)
        starts, _ = segments(counts)
        flat = (np.concatenate(sets) >> U(32)).astype(np.uint32)
        out, h = np.empty((len(sets), self.size), np.uint32), np.empty_like(flat)
        with np.errstate(over="ignore"):
            for k in range(self.size):
                np.bitwise_xor(flat, self.b[k], out=h)
                np.multiply(h, self.a[k], out=h)
                out[:, k] = np.minimum.reduceat(h, starts)
        return out


def least_matches(config: JoinConfig) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m equal ones is dropped. The posterior under a uniform prior is a
    binomial tail: P(J >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    from math import comb

    out, t = [], config.threshold
    for n in range(config.step, config.bands * config.rows + 1, config.step):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= config.tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def surviving_pairs(a: np.ndarray, b: np.ndarray, table: list[tuple[int, int]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that are never dropped; with same, pairs i < j of one block."""
    left, right = [], []
    for i in range(len(a)):
        js = np.arange(i + 1 if same else 0, len(b))
        hits, before = np.zeros(len(js), np.int32), 0
        for n, m in table:
            if not len(js):
                break
            hits += (b[js, before:n] == a[i, before:n]).sum(1, dtype=np.int32)
            keep = hits >= m
            js, hits, before = js[keep], hits[keep], n
        if len(js):
            left.append(np.full(len(js), i))
            right.append(js)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def fingerprints(df: DataFrame, config: JoinConfig = JoinConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (of the n-gram set, null without words), grams (their number), sig (16 low bits of each value), bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHash(config.seed), MinHasher(config)
        for batch in slices(batches):
            sets = gram_sets(texts_of(batch), config.n, hashes)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            sigs, bands = list(keys), list(keys)
            if full:
                values = minhash([sets[k] for k in full])
                low = values.astype("<u2")
                joined = np.ascontiguousarray(values.reshape(len(full), config.bands, config.rows))
                for row, k in enumerate(full):
                    keys[k] = xxhash.xxh3_128_digest(sets[k].tobytes(), config.seed)
                    sigs[k] = low[row].tobytes()
                    bands[k] = b"".join(xxhash.xxh3_64_digest(x.tobytes(), i) for i, x in enumerate(joined[row]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "key", "grams", "sig", "bands"])

    prepare(df.sparkSession)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, key binary, grams int, sig binary, bands binary")


def groups_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Consecutive rows with the same key, whole; the input is sorted by it within the partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(key)).to_pylist()
        cuts = [0, *(k for k in range(1, len(col)) if col[k] != col[k - 1]), len(col)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if held and col[at] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            last = col[at]
    if held:
        yield last, pa.Table.from_batches(held)


def _roots(n: int, left: Iterable[int], right: Iterable[int]) -> list[int]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(left, right, strict=True):
        x, y = root(i), root(j)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) between binary ids. Returns id, root (least id of its component) for each id on an edge.

    Alternating large and small stars; each round is a table in the shared folder, nothing comes to the driver but a
    count of changes.
    """
    before = now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        # large star: every larger neighbour of a joins the least of a's neighbourhood
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own, so that adaptive execution can split the join at a hub
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialise(large, "large-star")
        # small star: a and its smaller neighbours join the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        small = materialise(small, "small-star")
        stars = small.groupBy("a").agg(F.count("*").alias("n"))
        roots = small.select("b").distinct()
        if stars.where("n > 1").isEmpty() and small.join(roots.withColumnRenamed("b", "a"), "a", "left_semi").isEmpty():
            now = small
            break
        discard(before, least, large)
        before = now = small
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _shared_buckets(classes: DataFrame, config: JoinConfig, width: int) -> DataFrame:
    """bucket, key, band of the classes in buckets that have more than one."""
    banded = classes.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda i: F.substring("bands", i * 8 + 1, F.lit(8)))).alias("band", "value"))
    banded = banded.select(F.xxhash64("band", "value").alias("bucket"), "key", F.col("band").cast("byte").alias("band"))

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of buckets with more than one class."""
        held: pa.RecordBatch | None = None  # the last row, in case its bucket goes on
        shares = False  # the held row's bucket has had another row
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            b = batch.column(0).to_numpy()
            same = b[1:] == b[:-1]
            keep = np.zeros(len(b), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= shares
            held, shares, keep[-1] = batch.slice(len(b) - 1, 1), bool(keep[-1]), False
            if keep.any():
                yield batch.filter(pa.array(keep))
        if held is not None and shares:
            yield held

    return banded.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(shared, "bucket long, key binary, band byte")


def _candidate_edges(classes: DataFrame, buckets: DataFrame, config: JoinConfig, width: int) -> DataFrame:
    """Spanning links (a, b) of the pairs in each bucket that are not dropped."""
    table = least_matches(config)
    with_sig = buckets.select("bucket", "key").join(classes.select("key", "sig"), "key").select("bucket", "key", "sig")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[bytes] = []
        out_b: list[bytes] = []
        for _, group in groups_of(batches, "bucket"):
            keys = group.column("key").to_pylist()
            if len(keys) > config.bucket:
                edges = [(k, keys[0]) for k in keys[1:]]
            else:
                sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(keys), -1)
                i, j = surviving_pairs(sig, sig, table, True)
                edges = [(keys[k], keys[r]) for k, r in enumerate(_roots(len(keys), i.tolist(), j.tolist())) if k != r]
            for a, b in edges:
                out_a.append(a)
                out_b.append(b)
            if len(out_a) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return with_sig.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(link, "a binary, b binary")


def _dealt(rows: DataFrame, home: str, cuts: str, config: JoinConfig) -> DataFrame:
    """rows (home, cuts, key, copies, sig, set, band, bands) in groups: each home is cut into blocks, and each pair of
    blocks is one group, so a class is read once for each block."""
    own = F.pmod(F.xxhash64("key", F.lit(config.seed)), F.col(cuts)).cast("int")
    rows = rows.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col(cuts) - 1)).alias("other"))
    group = F.xxhash64(home, "band", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(group.alias("group"), "key", "copies", F.col("own").alias("side"), (F.col("own") == F.col("other")).alias("diagonal"), "sig", "set", "band", "bands")


def _verify(dealt: DataFrame, config: JoinConfig, width: int) -> DataFrame:
    """dealt: group, key, copies, side, diagonal, sig, set (packed n-gram hashes), band (-1, or that of the bucket), bands.
    Returns a (key), b (a key linked to it through any number of links), links and class_links (partial counts for a)."""
    table = least_matches(config)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups_of(batches, "group"):
            keys, copies, side = group.column("key").to_pylist(), group.column("copies").to_numpy(), group.column("side").to_numpy()
            if len(keys) < 2:
                continue
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(keys), -1)
            sets = [np.frombuffer(x, U) for x in group.column("set").to_pylist()]
            same = bool(group.column("diagonal")[0].as_py())
            if same:
                i, j = surviving_pairs(sig, sig, table, True)
            else:
                p, q = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
                i, j = surviving_pairs(sig[p], sig[q], table, False)
                i, j = p[i], q[j]
            band = group.column("band")[0].as_py()
            if band > 0 and len(i):  # a pair that meets in an earlier band is verified there
                hashes = np.frombuffer(b"".join(group.column("bands").to_pylist()), "<u8").reshape(len(keys), -1)[:, :band]
                fresh = np.concatenate([~(hashes[i[k : k + 4096]] == hashes[j[k : k + 4096]]).any(1) for k in range(0, len(i), 4096)])
                i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            # exact: number the n-grams of this group, mark those of one text, count the marks of its partners
            sizes = np.array([len(s) for s in sets], np.int64)
            starts, _ = segments(sizes)
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(int(flat.max()) + 1, bool)
            linked = np.zeros(len(i), bool)
            cuts = np.flatnonzero(np.diff(i)) + 1
            for part in np.split(np.arange(len(i)), cuts):
                x = i[part[0]]
                mine = flat[starts[x] : starts[x] + sizes[x]]
                mark[mine] = True
                for k in part.tolist():
                    y = j[k]
                    common = int(np.count_nonzero(mark[flat[starts[y] : starts[y] + sizes[y]]]))
                    linked[k] = common >= config.threshold * (sizes[x] + sizes[y] - common) - 1e-9
                mark[mine] = False
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            class_links = np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
            links = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
            roots = _roots(len(keys), i.tolist(), j.tolist())
            some = np.flatnonzero(class_links).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in some], pa.binary()), pa.array([keys[roots[k]] for k in some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array(class_links[some].astype(np.int64))],
                names=["a", "b", "links", "class_links"],
            )

    return dealt.repartition(width, "group").sortWithinPartitions("group").mapInArrow(run, "a binary, b binary, links long, class_links long")


def jaccard_join(df: DataFrame, config: JoinConfig = JoinConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, class_id (least id of the documents joined by links, through any number of them),
    copy_id (least id of those with the same n-gram set), copies (their number, this one included), links (documents
    with a similarity of at least the threshold, this one excluded), class_links (classes of copies linked)."""
    spark = df.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    prints = materialise(fingerprints(df, config, doc_id, text), "fingerprints")
    worded = prints.where(F.col("key").isNotNull())
    classes = materialise(worded.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    buckets = materialise(_shared_buckets(classes, config, width), "buckets")
    roots = materialise(components(_candidate_edges(classes, buckets, config, width)), "roots")

    # The n-gram sets of candidates alone, made anew from one text of each class.
    # How many blocks a component takes is known before its sets join, so these are dealt by key and group alone.
    wanted = materialise(classes.select("key", "copies", "grams", "sig", "bands").join(roots.withColumnRenamed("id", "key"), "key"), "candidates")
    cuts = lambda rows, grams: F.greatest(F.lit(1), F.ceil(rows / config.block_rows), F.ceil(grams / config.block_grams)).cast("int")
    totals = materialise(wanted.groupBy("root").agg(F.count("*").alias("rows"), cuts(F.count("*"), F.sum("grams")).alias("cuts")), "totals")
    # of components that are cut: their buckets, and whether to deal these costs fewer copies
    cut = wanted.select("key", "grams", "root").join(totals.where("cuts > 1"), "root")
    placed = materialise(buckets.join(cut, "key").select("bucket", "band", "key", "root", "grams"), "placed")
    sizes = materialise(placed.groupBy("root", "bucket").agg(F.count("*").alias("n"), cuts(F.count("*"), F.sum("grams")).alias("bucket_cuts")), "bucket-sizes")
    chains = sizes.where("n > 1").groupBy("root").agg(F.sum(F.col("n") * F.col("bucket_cuts")).alias("cost")).join(totals, "root").where("cost < rows * cuts").select("root")
    chains = materialise(chains, "chains")

    def resets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(config.seed)
        for batch in slices(batches):
            sets = gram_sets(texts_of(batch), config.n, hashes)
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes(), config.seed) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])

    chosen = wanted.select("key").join(classes, "key").select(F.col("copy_id").alias("doc_id")).distinct()
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    again = source.join(chosen, source["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi").select("text").mapInArrow(resets, "key binary, set binary")
    members = materialise(wanted.drop("grams").join(again.dropDuplicates(["key"]), "key"), "members")
    whole = members.join(totals.drop("rows").join(chains, "root", "left_anti"), "root")
    whole = _dealt(whole.withColumns({"band": F.lit(-1).cast("byte"), "bands": F.lit(None).cast("binary")}), "root", "cuts", config)
    chained = placed.join(chains, "root", "left_semi").select("bucket", "band", "key").join(sizes.where("n > 1").select("bucket", "bucket_cuts"), "bucket").join(members.drop("root"), "key")
    found = materialise(_verify(whole.unionByName(_dealt(chained, "bucket", "bucket_cuts", config)), config, width), "links")
    linked = components(found.select("a", "b"))
    sums = found.groupBy("a").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    info = classes.select("key", "copy_id", "copies").join(sums.withColumnRenamed("a", "key"), "key", "left").join(linked.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    info = materialise(info, "class-links")
    discard(buckets, wanted, placed, sizes, members, found)
    least = info.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    info = info.join(least, "root").select("key", "class_id", "copy_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links"))
    zero = F.lit(0).cast("long")
    alone = prints.where(F.col("key").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("copies"), zero.alias("links"), zero.alias("class_links"))
    return worded.select("doc_id", "key").join(info, "key").drop("key").unionByName(alone)


def one_of_each(df: DataFrame, config: JoinConfig = JoinConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay when one document of each linked group does: that with the least id. Texts without
    words all stay, but a repeated row (of an id and a text) stays once; of an id with several texts all stay if one does;
    rows with a null id count as copies if their texts are equal, and come after all ids."""
    own = "_row_" + uuid.uuid4().hex
    anonymous = F.coalesce(F.xxhash64(text), F.lit(0)).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = df.withColumn(own, F.coalesce(F.col(doc_id).cast("long"), anonymous))
    found = jaccard_join(rows, config, own, text)
    keep = materialise(found.where("doc_id = class_id").select(F.col("doc_id").alias(own)).distinct(), "kept")
    return rows.join(keep, own, "left_semi").dropDuplicates([own, text]).select(*df.columns)
