"""Operator 7, byte-level BPE encoding and decoding as a reduction over a tree of text parts.

An encoding is a monoid: halves of a piece are encoded by themselves, down to leaves of LEAF bytes, and neighbours are
joined. To join, the last tokens of the left part and the first of the right one are re-encoded together, in a window
that grows until the tokens just outside it stay as they are: a sequence of tokens is the encoding of its bytes if
each two neighbours are the encoding of theirs, so it is enough to look at the two seams. The leaves of all new pieces
of a batch are merged at once in numpy, one merge per leaf and round. Pieces (matches of the pattern) are encoded
separately, so the encoding of a text joins theirs by concatenation; a bounded cache keeps those met before.

Nulls: a null text is empty; an empty text has no tokens. Very long texts are encoded whole, in slices of some MB of rows
but one text at least; a long match of the pattern is a deeper tree. Ties don't occur: the lowest rank and, of equal
ones, the leftmost pair merges. Empty tables give no rows, repeated rows repeated results; columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, map_batches, read_table, texts

LEAF = 16
CACHE = 300_000
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Token bytes and ranks of a file of base64 tokens and ranks, and a hash table of the pairs that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, k in self.rank.items():
            self.bytes[k] = token
        self.decimal = [b"%d" % k for k in range(len(self.bytes))]
        self.byte = np.array([self.rank[bytes([k])] for k in range(256)], np.int32)
        pairs = [((a << 32) + b, k) for t, k in self.rank.items() for c in range(1, len(t)) if (a := self.rank.get(t[:c])) is not None and (b := self.rank.get(t[c:])) is not None]
        keys, ids = (np.array(x) for x in zip(*pairs, strict=True))
        self.bits = int(4 * len(keys)).bit_length()
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):  # linear probing, all that are left at once
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[slot] == keys
            self.ids[slot[won]] = ids[won]
            keys, ids, slot = keys[~won], ids[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into; NONE where it doesn't."""
        keys = (left.astype(np.int64) << 32) + right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ids[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ids[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """The encoding of a short piece, by merging its lowest-ranked pair again and again."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
            if (low := min(ranks)) == NONE:
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.rank[x] for x in parts]

    def merge_leaves(self, leaves: list[bytes]) -> list[np.ndarray]:
        """The encodings of many leaves, each round merging the lowest-ranked pair of each."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(leaves)
        lengths = np.fromiter(map(len, leaves), np.int64, len(leaves))
        names = np.flatnonzero(lengths)  # leaves still at work
        tokens = self.byte[np.frombuffer(b"".join(leaves), np.uint8)]
        sizes = lengths[names]
        leaf = np.repeat(np.arange(len(names)), sizes)
        merged = np.full(len(tokens), NONE, np.int32)
        if len(tokens) > 1:
            merged[:-1] = np.where(leaf[1:] == leaf[:-1], self.merges(tokens[:-1], tokens[1:]), NONE)
        while len(names):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(merged, starts)
            done = low == NONE
            if done.any():
                ends = np.flatnonzero(done)
                for k, a, n in zip(names[ends].tolist(), starts[ends].tolist(), sizes[ends].tolist(), strict=True):
                    out[k] = tokens[a : a + n]
                rest = ~done[leaf]
                tokens, merged, names, sizes, low = tokens[rest], merged[rest], names[~done], sizes[~done], low[~done]
                leaf = np.repeat(np.arange(len(names)), sizes)
                if not len(names):
                    break
            at = np.flatnonzero(merged == low[leaf])
            at = at[np.concatenate([[True], leaf[at][1:] != leaf[at][:-1]])]  # the leftmost of each leaf
            tokens[at] = low
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, merged, leaf, sizes = tokens[keep], merged[keep], leaf[keep], sizes - 1
            at = at - np.arange(len(at))
            for k in (at, at[at > 0] - 1):
                inner = k[(k + 1 < len(tokens))]
                merged[k] = NONE
                inner = inner[leaf[inner] == leaf[inner + 1]]
                merged[inner] = self.merges(tokens[inner], tokens[inner + 1])
        return out

    @lru_cache(maxsize=100_000)  # noqa: B019  one vocabulary per process and file
    def apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        return self.merge_one(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two parts' bytes in a row, from their encodings."""
        if not left or not right:
            return left + right
        i = j = 0
        window: list[int] = []
        while True:
            a = left[-i - 1] if i < len(left) else None
            b = right[j] if j < len(right) else None
            first = window[0] if window else b
            last = window[-1] if window else a
            if a is not None and first is not None and not self.apart(a, first):
                i += 1
            elif b is not None and last is not None and window and not self.apart(last, b):
                j += 1
            else:
                return left[: len(left) - i] + window + right[j:]
            if not window and j == 0:
                j = 1
            window = self.merge_one(b"".join(self.bytes[k] for k in left[len(left) - i :] + right[:j]))

    def encode_pieces(self, pieces: list[bytes], leaf: int = LEAF) -> list[list[int]]:
        """The encoding of each piece: leaves first, then joins up the tree."""
        flat: list[bytes] = []

        def plant(p: bytes):
            if len(p) <= leaf:
                flat.append(p)
                return len(flat) - 1
            return plant(p[: len(p) // 2]), plant(p[len(p) // 2 :])

        trees = [plant(p) for p in pieces]
        coded = self.merge_leaves(flat)

        def reduce(t) -> list[int]:
            return coded[t].tolist() if isinstance(t, int) else self.join(reduce(t[0]), reduce(t[1]))

        return [reduce(t) for t in trees]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a token sequence, halves concatenated."""
        if len(ids) <= 1 << 16:
            return b"".join(map(self.bytes.__getitem__, ids))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts by a vocabulary and a pattern, with a cache of at most CACHE pieces."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.vocabulary, self.pattern, self.cache = vocabulary(path), regex.compile(pattern), {}

    def encode_batch(self, some: list[str]) -> list[np.ndarray]:
        """The ids (unsigned 32-bit) of each text."""
        split = [self.pattern.findall(t) for t in some]
        known = self.cache
        new = list({p for s in split for p in s if p not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({p for s in split for p in s})
        for p, ids in zip(new, self.vocabulary.encode_pieces([p.encode() for p in new]), strict=True):
            known[p] = np.array(ids, np.uint32).tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, s)), np.uint32) for s in split]
        if len(known) > CACHE:
            known.clear()
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def portions(b: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some MB of text each, one row at least."""
    sizes = np.cumsum([len(x) for x in texts(b["text"])])
    a = 0
    while a < len(sizes):
        to = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield b.slice(a, to - a)
        a = to


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in portions(x)):
            yield batch(CODED, b["doc_id"], [x.astype(np.int32) for x in encoder(path).encode_batch(texts(b["text"]))])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of encoded documents (doc_id, ids)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(out, b["doc_id"], [vocabulary(path).decode(x or []) for x in b["ids"].to_pylist()])

    return map_batches(coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document its number of tokens, and digests of its ids and of the bytes that they decode to."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in portions(x)):
            v, rows = vocabulary(path), []
            for x in encoder(path).encode_batch(texts(b["text"])):
                ids = x.tolist()
                rows.append((len(ids), hashlib.sha256(b" ".join(map(v.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()))
            yield batch(DIGEST, b["doc_id"], *zip(*rows, strict=True))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
