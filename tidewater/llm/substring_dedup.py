"""Operator 2, substring dedup: words go that lie in a window of WIDTH = 13 words which also starts in a document with a
smaller doc_id.

Words are runs of bytes other than \\x20 and \\x09-\\x0D, unchanged; windows lie within one document and are judged on the
input. Texts are cut into segments by minimizers (see repeats.py), so that windows that may be equal meet in one class.
Whole classes form shards, each with a compressed index: the Burrows-Wheeler transform of its segments' words in a
wavelet tree of packed bits with counts. All segments of the shard are then streamed against it: backward search from
every word gives its matching statistics (how many words up to it are in a smaller document), and the rows of the
interval found tell the smallest document that holds the match. Intervals where the statistics reach WIDTH go.

Segments that one of a smaller document equals as a whole are found by their hashes before that. A class of more than
HOT segments is compared by hashes of its single windows.

Nulls: a null text has no words; a row without doc_id is a document of its own behind all others, in the order of a hash
of its text (equal ones repeat their result). Rows of one doc_id never remove each other's words. Empty tables give no rows; extra columns are ignored by substring_dedup and kept by substring_filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, byte_texts, map_batches, materialize, read_table, unused
from tidewater.llm.repeats import HOT, SEGMENT_SQL, Rolling, covered, fetched, id_of, keyed, keys, known_in_batch, narrowed, places, portions, repeated_windows, segments, split_repeats
from tidewater.llm.suffix_dedup import ROWS, RUNS, VALUES, by_class

WIDTH = 13
GRAM = 4
#: Words of segments in one index: whole classes, so at most this and one class more.
SHARD = 60_000
#: Parts of a segment's windows that are looked at for partners before it is indexed.
PARTS = 3


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in an array of bytes: where they start and end, and their hashes."""
    space = (text == 32) | ((text >= 9) & (text <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, end, Rolling(VALUES[text])(start, end)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches):
        texts = byte_texts(b["text"])
        start, _, h = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
        sizes = np.diff(np.append(np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])), len(start)))
        text, pos, n, mini, content, rep, anchor = segments(h, sizes, WIDTH, GRAM)
        doc, tid = (b[c].to_numpy()[text] for c in ("doc", "tid"))
        yield batch(ROWS, mini, content, doc, tid, pos.astype(np.int32), n.astype(np.int32), rep, anchor.astype(np.int32), known_in_batch(mini, content, doc, tid, pos, by_start=False))


class Bits:
    """A bit sequence, packed into 64-bit words, with the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, to: np.ndarray) -> np.ndarray:
        """The ones in front of each place."""
        word, bit = to >> 6, (to & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletTree:
    """Rank over a sequence of numbers below a bound: level by level, one bit of each number, those with 0 first."""

    def __init__(self, values: np.ndarray, bound: int) -> None:
        self.levels, self.zeros = [], []
        for level in range(max(1, int(bound - 1).bit_length()) - 1, -1, -1):
            bit = (values >> level) & 1
            self.levels.append((level, Bits(bit)))
            self.zeros.append(int((bit == 0).sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, to: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each value in front of to and of start."""
        zero = np.zeros(len(value), np.int64)
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = ((value >> level) & 1).astype(bool)
            n = bits.ones(np.concatenate([zero, start, to])).reshape(3, -1)
            zero = np.where(one, zeros + n[0], zero - n[0])
            start = np.where(one, zeros + n[1], start - n[1])
            to = np.where(one, zeros + n[2], to - n[2])
        return to - zero, start - zero


class Index:
    """A full-text index over segments of words: wavelet tree of the transform, symbol counts, documents by row."""

    def __init__(self, texts: list[np.ndarray], doc: np.ndarray, depth: int = WIDTH) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.words, flat = np.unique(np.concatenate(texts), return_inverse=True)
        # each segment is followed by an end that sorts first; ends are alike, and no match runs over one
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(len(flat) + len(texts), np.int64)
        symbols[np.delete(np.arange(len(symbols)), ends)] = flat + 1
        order = self._order(symbols, depth)
        self.tree = WaveletTree(symbols[order - 1], len(self.words) + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.words) + 1))])
        owner = doc[np.repeat(np.arange(len(texts)), sizes + 1)[order]]
        self.least = [owner]
        while 2 ** len(self.least) <= len(owner):  # minima of runs of 2, 4, 8 ... rows
            half = self.least[-1]
            step = 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(half[: len(half) - step], half[step:]))
        self.symbols, self.ends, self.sizes = symbols, ends, sizes

    @staticmethod
    def _order(symbols: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes by their first depth symbols at least, by doubling."""
        rank, k = symbols.copy(), 1
        n = len(symbols)
        while True:
            behind = np.zeros(n, np.int64)
            behind[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (int(rank.max(initial=0)) + 3) + behind
            order = np.argsort(key, kind="stable")
            k *= 2
            if k >= depth:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document of the rows from low up to high - 1."""
        out, log = np.empty(len(low), np.int64), np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(log):
            at = log == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - 2**k])
        return out

    def statistics(self, doc: np.ndarray, depth: int = WIDTH) -> np.ndarray:
        """Matching statistics of all segments' words in a row: how many words that end at each are in a smaller document
        than the segment's, up to depth. Backward search from every word; a search ends when no smaller document matches
        any longer, or with the segment."""
        out = np.zeros(int(self.sizes.sum()), np.int64)
        segment = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.arange(len(out)) + segment  # ends lie between the segments
        name, first = np.arange(len(out)), (self.ends - self.sizes)[segment]
        low, high = np.zeros(len(out), np.int64), np.full(len(out), len(self.symbols), np.int64)
        for _ in range(depth):
            word = self.symbols[at]
            to, start = self.tree.rank(word, high, low)
            low, high = self.less[word] + start, self.less[word] + to
            held = self.smallest(low, high) < doc[segment]
            out[name[held]] += 1
            held &= at > first  # the segment goes on to the left
            name, segment, at, first, low, high = name[held], segment[held], at[held] - 1, first[held], low[held], high[held]
        return out

    def intervals(self, doc: np.ndarray, depth: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, offset, n): the runs of n windows of depth words from offset on whose statistics reach depth."""
        segment = np.repeat(np.arange(len(self.sizes)), self.sizes)
        hit = np.flatnonzero(self.statistics(doc, depth) >= depth)
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(hit)), bool), (hit[1:] != hit[:-1] + 1) | (segment[hit[1:]] != segment[hit[:-1]])]))
        n = np.diff(np.append(head, len(hit)))
        begin = (np.cumsum(self.sizes) - self.sizes)[segment[hit[head]]]
        return segment[hit[head]], hit[head] - begin - depth + 1, n


SLICES = pa.schema([("mini", pa.int64()), ("doc", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32()), ("anchor", pa.int32()), ("key", pa.int64()), ("words", pa.list_(pa.int64()))])
SLICE_SQL = "mini long, doc long, tid long, pos int, anchor int, key long, words array<long>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, tid, text, wanted in zip(b["doc"].to_pylist(), b["tid"].to_pylist(), byte_texts(b["text"]), b["wanted"].to_pylist(), strict=True):
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), np.uint64).view(np.int64)
            for w in wanted:
                p, n = w["pos"], w["n"]
                if w["size"] <= HOT:
                    rows.append((w["mini"], doc, tid, p, w["anchor"], None, words[p : p + n + WIDTH - 1]))
                else:
                    rows += ((w["mini"], doc, tid, q, None, xxhash.xxh3_64_intdigest(words[q : q + WIDTH].tobytes()) - 2**63, None) for q in range(p, p + n))
            if len(rows) > 20_000:
                yield batch(SLICES, *zip(*rows, strict=True))
                rows = []
        if rows:
            yield batch(SLICES, *zip(*rows, strict=True))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in by_class(batches, 2 * SHARD, lambda r: len(r["words"])):
        rows, texts, pos = narrowed(rows, [np.array(r["words"], np.int64) for r in rows], WIDTH, GRAM, PARTS)
        if not rows:
            continue
        doc, tid = (np.array([r[c] for r in rows], np.int64) for c in ("doc", "tid"))
        at = places(doc, tid)
        segment, offset, n = Index(texts, at).intervals(at)
        yield batch(RUNS, doc[segment], tid[segment], (pos[segment] + offset).astype(np.int32), n.astype(np.int32))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, tid, pos, n): the windows from word pos to pos + n - 1 of a document that a smaller one holds as well."""
    texts = keyed(docs)
    gone, open_ = split_repeats(map_batches(texts, _segments, SEGMENT_SQL), by_start=False)
    sliced = materialize(map_batches(fetched(open_, texts), _slices, SLICE_SQL), "slices", clean=True)
    indexed = sliced.filter("key is null").select("mini", "doc", "tid", "pos", "anchor", "words").repartition("mini").sortWithinPartitions("mini", "doc", "tid", "pos")
    indexed = map_batches(indexed, _index, "doc long, tid long, pos int, n int")
    hot = repeated_windows(sliced.filter("key is not null"), by_start=False)
    return materialize(gone.unionByName(indexed).unionByName(hot), "runs", clean=True)


def spans_of(text: bytes, runs) -> tuple[np.ndarray, np.ndarray, int]:
    """Removed spans of words (starts, ends) of a text from its runs of windows, and its words."""
    total = len(text.split())
    if runs.is_valid and len(runs.values):
        starts, n = (runs.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        return *covered(starts, n, WIDTH, total), total
    return np.empty(0, np.int64), np.empty(0, np.int64), total


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
REMOVED_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, tid, text, runs in zip(b["doc"].to_pylist(), b["tid"].to_pylist(), byte_texts(b["text"]), b["runs"], strict=True):
            a, e, total = spans_of(text, runs)
            words = text.split()
            for s, t in zip(a[::-1].tolist(), e[::-1].tolist(), strict=True):
                del words[s:t]
            rows.append((id_of(doc, tid), total, total - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), [{"start": s, "end": t} for s, t in zip(a.tolist(), e.tolist(), strict=True)]))
        yield batch(REMOVED, *(list(zip(*rows, strict=True)) or [[]] * 5))


def _with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs (with doc and tid) and the runs of each."""
    return docs.join(runs.groupBy("doc", "tid").agg(F.collect_list(F.struct("pos", "n")).alias("runs")).hint("shuffle_hash"), ["doc", "tid"], "left")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed spans of words of every document."""
    return map_batches(_with_runs(keyed(docs), repeated_runs(docs)).select("doc", "tid", "text", "runs"), _remove, REMOVED_SQL)


def _cut(text: str | None, runs) -> str | None:
    """A text without the words of its runs, and without the white space after them."""
    if text is None or not runs.is_valid:
        return text
    raw = text.encode()
    a, e, _ = spans_of(raw, runs)
    start, end, _ = word_hashes(np.frombuffer(raw, np.uint8))
    parts, at = [], 0
    for s, t in zip(a.tolist(), e.tolist(), strict=True):
        parts.append(raw[at : start[s]])
        at = int(start[t]) if t < len(start) else len(raw)
    return b"".join([*parts, raw[at:]]).decode()


def substring_filter(docs: DataFrame) -> DataFrame:
    """docs with the repeated words taken out of text (with the white space after them); documents that lose all their
    words go. All columns stay, whatever their names; null texts, and texts without words, stay as they are."""
    own, tid, found, had = (unused(docs, c) for c in ("_doc", "_tid", "_runs", "_had"))
    runs = repeated_runs(docs).groupBy("doc", "tid").agg(F.collect_list(F.struct("pos", "n")).alias(found)).withColumnsRenamed({"doc": own, "tid": tid})
    same = (keys()[0] == F.col(own)) & (keys()[1] == F.col(tid))
    joined = docs.join(runs.hint("shuffle_hash"), same, "left").drop(own, tid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([_cut(t, r) for t, r in zip(b["text"].to_pylist(), b[found], strict=True)], pa.string())
            names = [n for n in b.schema.names if n != found]
            yield pa.RecordBatch.from_arrays([out if n == "text" else b.column(n) for n in names], names=names)

    cut = map_batches(joined.withColumn(had, F.col(found).isNotNull()), run, docs.withColumn(had, F.lit(True)).schema)
    return cut.filter(~F.col(had) | (F.length(F.regexp_replace("text", r"[ \t\n\x0B\f\r]", "")) > 0)).drop(had)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).drop("spans")
