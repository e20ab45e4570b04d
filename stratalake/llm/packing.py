"""Best-fit packing with a grouping genetic algorithm.

Documents become token pieces of at most ``capacity`` tokens, and the pieces are packed into as few sequences as
possible. Full pieces are sequences of their own. The rest is dealt by hash into blocks of bounded size; on each
block several islands evolve populations of packings independently, and after each epoch every island's elite moves
to the next island through a shuffle. The first island starts from best fit of falling sizes, the others from weaker
packings of shuffled sizes. A crossover injects whole well-filled bins of one parent into the other, dissolves the bins
that then hold a document twice, lets displaced documents take the place of smaller ones where they fill a bin better,
and best-fits the rest. An island ends when no packing can have fewer bins, which best fit often reaches by itself;
``evolution_report`` tells what the evolution saved. Bins that stay badly filled are dissolved, their pieces dealt into
fewer blocks and packed again, until they fit one block.

Defined results: a null or empty text has the end token alone (one piece of length 1); a very long one is cut into
pieces; repeated rows are packed once each; a null id stays null; an empty table gives an empty result; ties are broken by id, piece and row number.
Rows are numbered and dealt by where they lie, so that a hot id is spread: the same files, split in the same way, give
the same packing, and another split another one. Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import codecs
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, prepare, slices, texts_of

#: A character that stands between chunks, and what keeps a text from being encoded by chunks: this character, and white space for str.split alone.
MARK = "\x07"
ODD = "\x07\x1c\x1d\x1e\x1f"
#: Beyond the letters that lower case and composition treat alone, so that they may come first.
WIDE = re.compile(r"[^\x00-\u024f]")
#: A run of punctuation that a full stop or comma goes on, or any other run (besides underscores; one set comes first, as
#: the search is then three times as fast); and where a run follows a letter or digit.
RUN = re.compile(r"[^\s\w](?:[.,]|(?<=[^.,'])[^\s\w])")
RUN_STARTS = re.compile(r"(?<=[^\W_])(?=[^\s\w'])")
#: The split of a tokenizer that takes a run of letters whole, and the letters that its normalisers leave as they are.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower()) + "]+")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
PIECE_IDS = f"{PIECE}, ids array<int>"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


BYTES = _byte_letters()
#: By bytes, with blanks left as they are.
LETTERS = "".join(" " if b == 32 else c for b, c in enumerate(BYTES))


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 2048
    end_id: int = 0
    block_items: int = 4096  #: pieces per block on average
    islands: int = 3
    epochs: int = 2  #: with a migration before each but the first
    population: int = 4
    generations: int = 12  #: per epoch and island
    well_filled: float = 0.97  #: bins below are dissolved and packed again in the next round
    rounds: int = 6
    seed: int = 7


class WordTokenizer:
    """Token ids of a tokenizer that never joins characters across white space: chunks are encoded once and remembered.

    That holds for a tokenizer file with a Split pattern whose separators are removed and the normalisers NFC, white
    space replacement and lower case; any other tokenizer, and a text with separators that count as white space in
    Python alone, is encoded directly. Chunks not seen yet are encoded together, joined by blanks. Where the file is known
    to take a run of letters whole and as bytes, those of lower-case Latin letters go to its merges without normalisers; a word's
    last token tells its end.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norms = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        mark = self.ids(MARK)
        self.by_chunk = len(steps) == 2 and steps[0].get("behavior") == "Removed" and norms == ["NFC", "Replace", "Lowercase"] and len(mark) == 1
        self.mark = int(mark[0]) if len(mark) else -1
        self.merges = None
        if self.by_chunk and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True):
            vocab, suffix = told["model"]["vocab"], told["model"].get("end_of_word_suffix")
            if suffix and all(c in vocab and c + suffix in vocab for c in BYTES):
                self.merges = Tokenizer(self.own.model)  # shares the vocabulary
                self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
                self.ends = np.zeros(max(vocab.values()) + 1, bool)
                self.ends[[n for token, n in vocab.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.limit = limit

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Where the pattern cuts anyway, between a letter and punctuation, and with letters lower-cased, there are fewer
        different chunks."""
        if not text.isascii() and WIDE.search(text):
            return text.split()
        text = text.lower()
        return (RUN_STARTS.sub(" ", text) if "_" in text or RUN.search(text) else text.replace(".", " .").replace(",", " ,")).split()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, chunks: list[str]) -> None:
        """Encode the chunks, a few thousand at a time."""
        plain, other = [], []
        for c in chunks:
            (plain if self.merges and PLAIN.fullmatch(c) else other).append(c)
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            text = codecs.charmap_decode(" ".join(part).encode(), "strict", LETTERS)[0]
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            self._remember(part, ids, np.flatnonzero(self.ends[ids]) + 1, 0)
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]  # with a mark after each, which is in none of them
            ids = self.ids(f" {MARK} ".join([*part, ""]))
            self._remember(part, ids, np.flatnonzero(ids == self.mark), 1)

    def _remember(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """ends: where each chunk's ids end; the next one's begin after a gap."""
        all_ids, first = ids.tobytes(), 0
        for chunk, end in zip(chunks, (4 * ends).tolist(), strict=True):
            self.known[chunk] = all_ids[first:end]
            first = end + 4 * gap

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        direct = [not self.by_chunk or any(c in t for c in ODD) for t in texts]
        split = [[] if d else self.chunks(t) for t, d in zip(texts, direct, strict=True)]
        if len(self.known) > self.limit:
            self.known.clear()
        new = set().union(*split)
        new.difference_update(self.known)
        self.learn(list(new))
        get = self.known.__getitem__
        return [self.ids(t).tobytes() if d else b"".join(map(get, cs)) for t, cs, d in zip(texts, split, direct, strict=True)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(df: DataFrame, tokenizer_path: str, config: PackConfig = PackConfig(), doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, uid and, unless dropped, the ids."""
    prepare(df.sparkSession)
    cap, end = config.capacity, config.end_id

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, row = tokenizer(tokenizer_path).encode, TaskContext.get().partitionId() << 38, 0
        for batch in slices(batches):
            cols: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "uid", "ids")}
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch)), strict=True):
                ids += end.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids) // 4, cap)):
                    own = ids[4 * at : 4 * (at + cap)]
                    for name, value in zip(cols, (doc, k, at, len(own) // 4, zlib.crc32(own), base + row, np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None), strict=True):
                        cols[name].append(value)
                    row += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types, strict=False)], names=list(cols)[: len(types)])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECE_IDS if with_ids else PIECE)


class Bins:
    """A packing under way: bins by the room they have left, found by the lowest set bit."""

    def __init__(self, cap: int):
        self.cap, self.mask = cap, 0
        self.by_room: list[list[int]] = [[] for _ in range(cap + 1)]
        self.items: list[list[int]] = []
        self.room: list[int] = []

    def add(self, items: list[int], size: int) -> None:
        room = self.cap - size
        self.by_room[room].append(len(self.items))
        self.mask |= 1 << room
        self.items.append(items)
        self.room.append(room)

    def best_fit(self, order: Iterable[int], sizes: list[int]) -> None:
        by_room = self.by_room
        for i in order:
            s = sizes[i]
            rest = self.mask >> s
            if rest:
                room = s + (rest & -rest).bit_length() - 1
                own = by_room[room]
                b = own.pop()
                if not own:
                    self.mask ^= 1 << room
                self.items[b].append(i)
                left = room - s
                by_room[left].append(b)
                self.mask |= 1 << left
                self.room[b] = left
            else:
                self.add([i], s)


def _fitness(b: Bins) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean squared fill)."""
    return (-len(b.items), sum(((b.cap - r) / b.cap) ** 2 for r in b.room) / max(1, len(b.room)))


def _from_assignment(of: np.ndarray, sizes: list[int], cap: int) -> Bins:
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    out = Bins(cap)
    for own in np.split(order, cuts):
        items = own.tolist()
        out.add(items, sum(sizes[i] for i in items))
    return out


def _assignment(b: Bins, n: int) -> np.ndarray:
    of = np.empty(n, np.int32)
    for k, items in enumerate(b.items):
        of[items] = k
    return of


def replace_smaller(items: list[int], room: int, loose: list[tuple[int, int]], sizes: list[int]) -> int:
    """Let loose pieces (sorted pairs of size and number) take the place of one or two smaller ones of a bin, where that
    fills it better. Returns the room that is left; items and loose are changed."""
    while room:
        best = (0, 0, ())
        for x in range(len(items)):
            for own in [(x,), *((x, y) for y in range(x))]:
                held = sum(sizes[items[k]] for k in own)
                at = bisect.bisect_right(loose, (held + room, len(sizes))) - 1
                if at >= 0 and loose[at][0] - held > best[0]:
                    best = (loose[at][0] - held, at, own)
        gain, at, own = best
        if not gain:
            break
        _, new = loose.pop(at)
        for k in own:
            bisect.insort(loose, (sizes[items[k]], items[k]))
        items[:] = [i for k, i in enumerate(items) if k not in own] + [new]
        room -= gain
    return room


def crossover(a: Bins, b: Bins, sizes: list[int], rng: random.Random, swaps: int = 24) -> Bins:
    """Inject about half of b's best-filled bins into a, drop a's bins that share a document with them, let the displaced
    documents replace smaller ones in bins of a few documents, and best-fit the rest. swaps: the most documents of a bin
    that are tried."""
    full = sorted(range(len(b.items)), key=lambda k: b.room[k])[: max(1, len(b.items) * 2 // 3)]
    chosen = [k for k in full if rng.random() < 0.5] or full[:1]
    child, taken = Bins(a.cap), bytearray(len(sizes))
    for k in chosen:
        child.add(list(b.items[k]), a.cap - b.room[k])
        for i in b.items[k]:
            taken[i] = 1
    displaced, kept = [], []
    for items, room in zip(a.items, a.room, strict=True):
        if any(taken[i] for i in items):
            displaced += [i for i in items if not taken[i]]
        else:
            kept.append((list(items), room))
    loose = sorted((sizes[i], i) for i in displaced)
    for items, room in kept:
        if room and len(items) <= swaps and loose:
            room = replace_smaller(items, room, loose, sizes)
        child.add(items, a.cap - room)
    child.best_fit([i for _, i in sorted(loose, key=lambda x: (-x[0], x[1]))], sizes)
    return child


def mutate(a: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """Dissolve the emptiest bin and a few others, and best-fit their documents in a shuffled order of size."""
    n = len(a.items)
    gone = {max(range(n), key=lambda k: a.room[k]), *(rng.randrange(n) for _ in range(min(n, 3 + n // 20)))}
    out, loose = Bins(a.cap), []
    for k in range(n):
        if k in gone:
            loose += a.items[k]
        else:
            out.add(list(a.items[k]), a.cap - a.room[k])
    loose.sort(key=lambda i: (-sizes[i] * (0.8 + 0.4 * rng.random()), i))
    out.best_fit(loose, sizes)
    return out


def best_fit_decreasing(sizes: list[int], cap: int) -> Bins:
    out = Bins(cap)
    out.best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes)
    return out


def evolve(sizes: list[int], elites: list[np.ndarray], config: PackConfig, seed: int, island: int = 0) -> Bins:
    """The best packing of an island after an epoch; stops as soon as no packing can have fewer bins. Only the first
    island starts from best fit of falling sizes."""
    cap, rng, n = config.capacity, random.Random(seed), len(sizes)
    least = -(-sum(sizes) // cap)
    people = [_from_assignment(e, sizes, cap) for e in elites]
    first = best_fit_decreasing(sizes, cap)
    best = max([*people, first], key=_fitness)
    if len(best.items) <= least:
        return best
    if not island and not people:
        people.append(first)
    while len(people) < config.population:
        other = Bins(cap)
        other.best_fit(sorted(range(n), key=lambda i: (-sizes[i] * (0.7 + 0.6 * rng.random()), i)), sizes)
        people.append(other)
    scored = sorted(((_fitness(p), k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    for g in range(config.generations):
        if -scored[0][0][0] <= least:
            break
        (_, _, a), (_, _, b) = rng.sample(scored, 2)
        child = mutate(scored[0][2], sizes, rng) if g % 3 == 2 else crossover(a, b, sizes, rng)
        scored.append((_fitness(child), len(people) + g, child))
        scored.sort(key=lambda x: x[:2], reverse=True)
        scored.pop()
    return scored[0][2]


BLOCK = "block long, island int, lengths binary, best binary, bins int, fill double"


def _pack_blocks(blocks: DataFrame, config: PackConfig) -> DataFrame:
    """blocks: block, items (sorted array of structs). Returns block, items, best (bin of each item)."""
    spark = blocks.sparkSession

    def epoch(number: int):
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for r in frame.itertuples(index=False):
                    sizes = np.frombuffer(r.lengths, np.int32).tolist()
                    elites = [np.frombuffer(e, np.int32) for e in sorted(r.elites)] if r.elites is not None else []
                    best = evolve(sizes, elites, config, hash((config.seed, number, int(r.block), int(r.island))), int(r.island))
                    fit = _fitness(best)
                    rows.append((r.block, r.island, r.lengths, _assignment(best, len(sizes)).tobytes(), -fit[0], fit[1]))
                yield pd.DataFrame(rows, columns=["block", "island", "lengths", "best", "bins", "fill"])

        return run

    def lengths(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"block": frame["block"], "lengths": [np.asarray(x, np.int32).tobytes() for x in frame["lengths"]]})

    start = blocks.select("block", F.transform("items", lambda x: x["length"].cast("int")).alias("lengths")).mapInPandas(lengths, "block long, lengths binary")
    state = start.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(config.islands)]))).withColumn("elites", F.lit(None).cast("array<binary>"))
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done = None
    for e in range(config.epochs):
        if e:
            both = done.withColumn("to", F.explode(F.array(F.col("island"), (F.col("island") + 1) % config.islands)))
            state = both.groupBy("block", F.col("to").alias("island")).agg(F.first("lengths").alias("lengths"), F.collect_list("best").alias("elites"))
        else:
            state = state.repartition(width, "block", "island")
        done = state.select("block", "island", "lengths", "elites").mapInPandas(epoch(e), BLOCK)
    order = F.struct("bins", -F.col("fill"), "island")
    pick = done.groupBy("block").agg(F.min_by("best", order).alias("best"), F.min("bins").alias("bins"))
    return blocks.join(pick, "block")


def _blocks(pieces: DataFrame, count: int, config: PackConfig, number: int) -> tuple[DataFrame, int]:
    """block and items (sorted) of the pieces of a round, and the number of blocks."""
    n_blocks = max(1, round(count / config.block_items))
    item = F.struct((-F.col("length")).alias("order"), "doc_id", "piece", "uid", "start", "length", "ids_crc32")
    block = F.pmod(F.xxhash64("uid", F.lit(config.seed + number)), F.lit(n_blocks)).alias("block")
    return materialise(pieces.groupBy(block).agg(F.sort_array(F.collect_list(item)).alias("items")), "pack-blocks"), n_blocks


def evolution_report(pieces: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """For each block of the first round: block, pieces, least (no packing has fewer sequences), best_fit (of falling
    sizes) and evolved, the numbers of sequences."""
    todo = pieces.where(F.col("length") < config.capacity)
    blocks, _ = _blocks(todo, todo.count(), config, 0)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                sizes = [x["length"] for x in r.items]
                rows.append((r.block, len(sizes), -(-sum(sizes) // config.capacity), len(best_fit_decreasing(sizes, config.capacity).items), r.bins))
            yield pd.DataFrame(rows, columns=["block", "pieces", "least", "best_fit", "evolved"])

    return _pack_blocks(blocks, config).select("block", "items", "bins").mapInPandas(run, "block long, pieces long, least long, best_fit long, evolved long")


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, filled long"


def pack(pieces: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """pieces: columns of ``token_pieces`` without ids, already materialised. Adds sequence_id and offset."""
    spark = pieces.sparkSession
    cap = config.capacity
    out = pieces.where(F.col("length") >= cap).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    todo = pieces.where(F.col("length") < cap)
    count = todo.count()
    for number in range(config.rounds):
        if not count:
            break
        blocks, n_blocks = _blocks(todo, count, config, number)
        base = (1 << 62) + (number << 58)

        def place(frames: Iterable[pd.DataFrame], base: int = base) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    of = np.frombuffer(r.best, np.int32)
                    length = np.array([x["length"] for x in r.items], np.int64)
                    order = np.argsort(of, kind="stable")
                    before = np.cumsum(length[order]) - length[order]
                    first = np.searchsorted(of[order], of[order], "left")
                    offset = np.empty(len(of), np.int64)
                    offset[order] = before - before[first]
                    filled = np.bincount(of, length).astype(np.int64)
                    made = {k: [x[k] for x in r.items] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "uid")}
                    made["doc_id"] = pd.array(made["doc_id"], "Int64")
                    yield pd.DataFrame(made | {"sequence_id": base + (int(r.block) << 24) + of.astype(np.int64), "offset": offset, "filled": filled[of]})

        placed = materialise(_pack_blocks(blocks, config).select("block", "items", "best").mapInPandas(place, PLACED), "pack-placed")
        last = n_blocks == 1 or number == config.rounds - 1
        keep = F.lit(True) if last else F.col("filled") >= int(config.well_filled * cap)
        out = out.unionByName(placed.where(keep).drop("filled"))
        if last:
            break
        discard(blocks)
        todo = placed.where(~keep).select(*pieces.columns)
        count = todo.count()
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, config: PackConfig = PackConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their places; join ``token_pieces`` on doc_id and piece where the ids are wanted."""
    return pack(materialise(token_pieces(df, tokenizer_path, config, doc_id, text, with_ids=False), "pack-pieces"), config)
