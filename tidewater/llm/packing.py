"""Operator 4, best-fit packing by a grouping genetic algorithm on islands.

Documents become token sequences (closed by the token 2); longer ones are cut into pieces of CAPACITY tokens, the first
piece taking what is left over. Pieces are dealt by hash to shards of about SHARD pieces, which are packed by
themselves. For each shard ISLANDS populations evolve as rows of their own in Spark. A solution is a set of bins, and
crossover works on whole bins: well-filled bins of one parent are injected into another, bins of the other that hold
the same pieces are dissolved, and the displaced pieces go back by best fit after larger ones of them were exchanged for smaller
items of bins that they fill better. After each epoch every island's elite moves to the next island of its shard. The
best solution of a shard lays out its sequences; those of all shards that are not full are emptied and packed once more.
A shard that reaches the least possible number of sequences stops early.

Nulls: a null text is empty, which leaves one token; null ids stay null. Empty tables give no rows. Repeated rows are
packed each for itself. Ties: pieces of equal length are taken by id, piece and checksum. Very long texts give many
pieces, which go to many shards. Columns besides doc_id and text are ignored. Everything random is seeded by shard and
island, and pieces are dealt by their place in a written table, so a lost task repeats its result.
"""

from __future__ import annotations

import base64
import random
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, combinations, compress
from operator import attrgetter, not_

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.bpe import portions
from tidewater.llm.common import batch, map_batches, materialize, read_table, spread, texts

CAPACITY = 1024
END = np.uint32(2)
ROOM = attrgetter("room")
SHARD = 8192
#: Sequences below this share of the capacity are packed again, over all shards.
REST = 0.9
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
#: Generations of an epoch, fewer only where a solution has as few sequences as can be.
GENERATIONS = 40
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The vocabulary of byte_bpe_50k.json (its ranks are in the .tiktoken file beside it), with its special token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_to_numpy
        for b in (s for x in batches for s in portions(x)):
            rows = []
            for doc, t in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                ids = np.append(encode(t, allowed_special="all"), END).astype("<u4", copy=False)
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids)))]
            yield batch(PIECES, *zip(*rows, strict=True))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bin(list):
    """Item numbers, and the room that they leave. Solutions share bins, so a bin never changes, and what is found out about
    it (wanted) holds in all of them."""

    __slots__ = ("_wanted", "room")

    def __init__(self, items: Iterable[int], room: int) -> None:
        super().__init__(items)
        self.room = room
        self._wanted: int | None = None

    def wanted(self, sizes: list[int]) -> int:
        """Sizes, as a bit set, of items that would fill it better in the place of one or two of its own."""
        if self._wanted is None:
            out, gains = 0, (1 << self.room) - 1
            if len(self) <= 12:
                held = [sizes[i] for i in self]
                for size in chain(held, map(sum, combinations(held, 2))):
                    out |= gains << (size + 1)
            self._wanted = out
        return self._wanted


def measured(bins: list[list[int]], sizes: list[int]) -> list[Bin]:
    """bins with their rooms. All of them are lists, or all are measured already."""
    return bins if bins and isinstance(bins[0], Bin) else [Bin(b, CAPACITY - sum(map(sizes.__getitem__, b))) for b in bins]


class Packing:
    """Bins that items go into; best fit by one bit set of the rooms that occur. Full bins, which are most, aren't filed."""

    def __init__(self, sizes: list[int], bins: Iterable[Bin] = ()) -> None:
        self.sizes, self.bins, self.by_room, self.rooms = sizes, list(bins), defaultdict(set), 0
        for k, b in enumerate(self.bins):
            if b.room:
                self._file(k, b.room)

    def _file(self, k: int, room: int) -> None:
        self.by_room[room].add(k)
        self.rooms |= 1 << room

    def replace(self, k: int, new: Bin) -> None:
        room = self.bins[k].room
        self.by_room[room].remove(k)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        self.bins[k] = new
        if new.room:
            self._file(k, new.room)

    def best_fit(self, items: list[int]) -> None:
        """Each item into the fullest bin that has room for it, else into a new one."""
        sizes, bins, by_room, rooms = self.sizes, self.bins, self.by_room, self.rooms
        grown: dict[int, list[int]] = {}
        rest: dict[int, int] = {}
        for i in items:
            size = sizes[i]
            fits = rooms >> size
            if fits:
                room = (fits & -fits).bit_length() - 1 + size
                some = by_room[room]
                k = max(some) if len(some) < 8 else next(iter(some))
                some.remove(k)
                if not some:
                    rooms ^= 1 << room
                left = room - size
                if k in grown:
                    grown[k].append(i)
                else:
                    grown[k] = [*bins[k], i]
            else:
                k, left = len(bins), CAPACITY - size
                bins.append(())
                grown[k] = [i]
            rest[k] = left
            if left:
                by_room[left].add(k)
                rooms |= 1 << left
        for k, own in grown.items():
            bins[k] = Bin(own, rest[k])
        self.rooms = rooms


def rooms_of(bins: list[Bin]) -> np.ndarray:
    return np.fromiter(map(ROOM, bins), np.int64, len(bins))


def fitness(bins: list[Bin]) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones (squared fill)."""
    return (-len(bins), int(((CAPACITY - rooms_of(bins)) ** 2).sum()) / CAPACITY**2)


def exchange(packing: Packing, displaced: list[int]) -> list[int]:
    """Larger displaced items take the places of one or two smaller ones in bins that they fill better. The items that are
    displaced afterwards, largest first."""
    sizes = packing.sizes
    free = sorted(sorted(displaced), key=sizes.__getitem__)
    lengths = [sizes[i] for i in free]
    there = 0
    for n in {*lengths}:
        there |= 1 << n
    # full bins aren't filed; of the others only those are looked at that gain by one of the displaced items
    for k in sorted(chain.from_iterable(packing.by_room.values())):
        own = packing.bins[k]
        if not there & own.wanted(sizes):
            continue
        room, best = own.room, (0, 0, ())
        for some in (*((i,) for i in own), *combinations(own, 2)):
            size = sizes[some[0]] + (sizes[some[1]] if len(some) == 2 else 0)
            at = bisect_right(lengths, size + room) - 1
            if at >= 0 and lengths[at] - size > best[0]:
                best = (lengths[at] - size, at, some)
                if best[0] == room:
                    break
        gain, at, some = best
        n = lengths.pop(at)
        if not (at and lengths[at - 1] == n):  # it was the last of its size
            there &= ~(1 << n)
        packing.replace(k, Bin([*(i for i in own if i not in some), free.pop(at)], room - gain))
        for i in some:
            to = bisect_right(lengths, sizes[i])
            lengths.insert(to, sizes[i])
            free.insert(to, i)
            there |= 1 << sizes[i]
    return free[::-1]


def crossover(into: list[list[int]], given: list[list[int]], sizes: list[int], rng: random.Random) -> list[Bin]:
    """The bins of into with well-filled bins of given injected whole; displaced items are exchanged for smaller ones and
    go back by best fit."""
    into, given = measured(into, sizes), measured(given, sizes)
    ranked = [given[k] for k in np.argsort(rooms_of(given), kind="stable")[: max(1, len(given) // 2)].tolist()]
    injected = [b for b in ranked if rng.random() < 0.5] or ranked[:1]
    taken = set(chain.from_iterable(injected))
    untouched = [*map(taken.isdisjoint, into)]
    out = Packing(sizes, chain(injected, compress(into, untouched)))
    displaced = [i for b in compress(into, map(not_, untouched)) for i in b if i not in taken]
    out.best_fit(exchange(out, displaced))
    return out.bins


def mutate(bins: list[list[int]], sizes: list[int], rng: random.Random) -> list[Bin]:
    """The emptiest bins and a few others are dissolved, their items exchanged and put back by best fit."""
    bins = measured(bins, sizes)
    ranked = np.argsort(-rooms_of(bins), kind="stable").tolist()
    n = max(1, len(bins) // 50)
    gone = ranked[:n] + rng.sample(ranked[n:], min(2 * n, len(ranked) - n))
    stays = bytearray(b"\1") * len(bins)
    for k in gone:
        stays[k] = 0
    out = Packing(sizes, compress(bins, stays))
    out.best_fit(exchange(out, [i for k in gone for i in bins[k]]))
    return out.bins


def least_bins(sizes: list[int]) -> int:
    return -(-sum(sizes) // CAPACITY)


def descending(sizes: list[int], noise: random.Random | None = None) -> list[Bin]:
    """Best fit of the items from the largest on; with noise, of a somewhat disturbed order."""
    p = Packing(sizes)
    p.best_fit(sorted(range(len(sizes)), key=(lambda i: (-sizes[i], i)) if noise is None else (lambda i: (-sizes[i] * noise.uniform(0.8, 1.0), i))))
    return p.bins


def evolve(sizes: list[int], known: list[list[list[int]]], seed: int, generations: int = GENERATIONS) -> list[Bin]:
    """The best of a population after some generations, fewer where a solution has as few bins as can be. known:
    solutions to begin with; best fit is among the first ones."""
    rng, bound = random.Random(seed), least_bins(sizes)
    scored = lambda bins: (fitness(bins), bins)
    population = [scored(measured(b, sizes)) for b in known or [descending(sizes)]]
    best = lambda: max(population, key=lambda p: p[0])[1]
    while len(population) < POPULATION and len(best()) > bound:
        population.append(scored(mutate(best(), sizes, rng) if len(population) % 2 else descending(sizes, rng)))
    for _ in range(generations):
        if len(best()) <= bound:
            break
        (_, a), (_, b) = rng.sample(population, 2)
        children = [scored(mutate(crossover(a, b, sizes, rng), sizes, rng)), scored(mutate(best(), sizes, rng))]
        population = sorted(population + children, key=lambda p: p[0], reverse=True)[:POPULATION]
    return best()


def genome(bins: list[list[int]], n: int) -> bytes:
    """The bin of each item, as little-endian 32-bit numbers."""
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def solution(data: bytes) -> list[list[int]]:
    at = np.frombuffer(data, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(at.max(initial=-1)) + 1)]
    for i, k in enumerate(at.tolist()):
        bins[k].append(i)
    return bins


STATE = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int64())), ("elite", pa.binary()), ("bins", pa.int64())])
STATE_SQL = "shard long, island int, sizes array<long>, elite binary, bins long"


def _epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            known = [solution(x) for x in (r["elite"], r["guest"]) if x is not None]
            best = evolve(r["sizes"], known, zlib.crc32(f"{r['shard']}:{r['island']}:{len(known)}".encode()))
            yield batch(STATE, [r["shard"]], [r["island"]], [r["sizes"]], [genome(best, len(r["sizes"]))], [len(best)])


PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
PACKED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def _lay_out(found: pa.Table, best: pa.Table) -> pa.Table:
    """Sequences of a shard: its pieces in the order of the solution's items, and whole pieces in sequences of their own."""
    found = found.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    length = found["length"].to_numpy()
    small = length < CAPACITY
    bin_of = np.frombuffer(best["elite"][0].as_py(), "<i4").astype(np.int64) if len(best) else np.empty(0, np.int64)
    seq = np.empty(len(found), np.int64)
    seq[small] = bin_of
    seq[~small] = bin_of.max(initial=-1) + 1 + np.arange((~small).sum())
    order = np.argsort(seq, kind="stable")
    before = np.cumsum(length[order]) - length[order]
    head = np.concatenate([[True], seq[order][1:] != seq[order][:-1]]) if len(seq) else np.empty(0, bool)
    offset = np.empty(len(seq), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(head, before, 0)) if len(seq) else before
    fill = np.bincount(seq, weights=length).astype(np.int64)[seq] if len(seq) else seq
    name = (found["shard"].to_numpy() << 32) + seq
    return pa.Table.from_arrays([*(found[c].combine_chunks() for c in PIECES.names), pa.array(name), pa.array(offset), pa.array(fill)], schema=PACKED)


def packed(found: DataFrame, first: int) -> DataFrame:
    """Pieces in sequences, with the tokens of each (fill). Shards, and so sequence_id, are numbered from first on.
    Rows are dealt by their place in a written table, as any number of them may be alike."""
    found = materialize(found.select(*PIECES.names, F.monotonically_increasing_id().alias("at")), "pieces")
    shards = max(1, -(-found.count() // SHARD))
    found = found.withColumn("shard", spread("at", buckets=shards) + first)
    # sizes in the order in which _lay_out() sorts the pieces; a shard holds about SHARD pieces, whatever the input
    sizes = found.filter(F.col("length") < CAPACITY).groupBy("shard").agg(F.sort_array(F.collect_list("length"), asc=False).alias("sizes"))
    islands = sizes.select("shard", F.explode(F.array(*(F.lit(k) for k in range(ISLANDS)))).alias("island"), "sizes")
    state = islands.withColumns({"elite": F.lit(None).cast("binary"), "guest": F.lit(None).cast("binary")})
    for _ in range(EPOCHS):
        # a row is seconds of work and a few KB: a stated number of partitions, which isn't coalesced by bytes
        state = materialize(state.repartition(ISLANDS * shards, "shard", "island").mapInArrow(_epoch, STATE_SQL), "islands")
        elites = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
        evolved, state = state, state.join(elites, ["shard", "island"])
    best = evolved.groupBy("shard").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"))
    return found.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_lay_out, PACKED_SQL)


def pack(found: DataFrame) -> DataFrame:
    """pieces() with sequence_id and offset. Every shard may end with a sequence that is not full: those of less than
    REST of the capacity are emptied, and their pieces of all shards are packed once more."""
    once = materialize(packed(found, 0), "packed")
    rest = F.col("fill") < REST * CAPACITY
    again = packed(once.filter(rest), 1 << 30)
    return once.filter(~rest).unionByName(again).drop("fill")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read_table(spark, sf_dir, "documents")))
