"""Operator 1, suffix-array dedup: every byte that a string of WIDTH = 100 bytes covers which also starts earlier goes.

"Earlier" is a smaller doc_id, or an earlier start in the same document; strings lie within one document and are judged
on the input. Documents are cut into segments by minimizers (see repeats.py), so that strings that may be equal meet in
one class. Classes are shards of a collection index: a multi-document suffix array built column by column. Each round
inserts one symbol of every segment, from its end on, and updates the collection's Burrows-Wheeler transform, the
longest common prefixes of neighbouring suffixes and the suffixes' places, which are read from and written to
sequential files. Neighbours with a common prefix of WIDTH bytes are equal strings; all but the earliest go.

Segments that an earlier one equals as a whole are found by their hashes before that, so that copies aren't indexed. A
class of more than HOT segments is compared by hashes of its single windows, which spreads it over all tasks.

Nulls: a null text is empty; a row without doc_id is a document of its own behind all others, in the order of a hash of
its text. Rows of one doc_id (or none) and equal text repeat their result; rows of one doc_id and different texts are one
document's in the order of starts. Texts shorter than WIDTH
stay whole; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, byte_texts, map_batches, materialize, read_table
from tidewater.llm.repeats import HOT, SEGMENT_SQL, covered, fetched, id_of, keyed, known_in_batch, narrowed, places, portions, repeated_windows, segments, split_repeats

WIDTH = 100
GRAM = 24
#: Bytes of segments in one index: whole classes, so at most this and one class more.
SHARD = 256 << 10
#: Parts of a segment's windows that are looked at for partners before it is indexed.
PARTS = 8
DONE = 0xFF  # no byte of UTF-8

#: A random value for each byte, the same in every process.
VALUES = np.random.default_rng(20240101).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ROWS = pa.schema([("mini", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("rep", pa.bool_()), ("anchor", pa.int32()), ("gone", pa.bool_())])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches):
        texts = byte_texts(b["text"])
        text, pos, n, mini, content, rep, anchor = segments(VALUES[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts]), WIDTH, GRAM)
        doc, tid = (b[c].to_numpy()[text] for c in ("doc", "tid"))
        yield batch(ROWS, mini, content, doc, tid, pos.astype(np.int32), n.astype(np.int32), rep, anchor.astype(np.int32), known_in_batch(mini, content, doc, tid, pos, by_start=True))


class Column:
    """An array in a file that is read and written from its start to its end. It never shrinks, so that the file is
    overwritten in place."""

    def __init__(self, folder: str, name: str) -> None:
        self.file, self.size = os.open(os.path.join(folder, name), os.O_RDWR | os.O_CREAT), 0

    def read(self) -> np.ndarray:
        return np.frombuffer(os.pread(self.file, self.size, 0), np.uint8)

    def write(self, values: np.ndarray) -> None:
        self.size = os.pwrite(self.file, values.astype(np.uint8, copy=False), 0)

    def close(self) -> None:
        os.close(self.file)


def collection_index(strings: list[bytes], most: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of all strings in order, without the empty ones: (string, offset, common prefix with the one before,
    up to most, which is below 255). Equal suffixes are in the order of their strings."""
    m, sizes = len(strings), np.fromiter(map(len, strings), np.int64, len(strings))
    text, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes)
    with tempfile.TemporaryDirectory() as folder:
        bwt, common = Column(folder, "bwt"), Column(folder, "lcp")
        # the empty suffixes, in the strings' order: nothing in common, as their ends differ
        bwt.write(np.where(sizes > 0, text[np.maximum(ends - 1, 0)] if len(text) else DONE, DONE))
        common.write(np.zeros(m))
        at = np.arange(m)  # where each string's symbol of the last round stands
        active = np.flatnonzero(sizes > 0)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            old, low = bwt.read(), common.read()
            order = ranked(old)  # the suffixes that have been extended, by the next rank
            rank = np.empty(len(old), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            active = active[sizes[active] >= step]
            k = rank[at[active]]
            new, owner = np.zeros(len(order) + 2, bool), np.empty(len(order), np.int32)
            new[k], owner[k] = True, active
            k = np.flatnonzero(new)
            active = owner[k]
            at[active] = to = m + k
            fresh = np.zeros(m + len(order), bool)
            fresh[to] = True
            stays = ~fresh
            # common prefixes: one symbol more than the least between two neighbouring occurrences of that symbol
            new_low = np.empty(len(fresh), np.uint8)
            new_low[stays] = low
            new[k + 1] = True
            new[0] = False
            # the last pair first, so that reduceat looks at nothing between the pairs of a symbol
            pairs = np.flatnonzero(new[: len(order)])[::-1]
            p, q = order[pairs], order[pairs - 1]
            same = old[p] == old[q]
            value = np.zeros(len(pairs), np.uint8)
            if same.any():
                least = np.minimum.reduceat(np.append(low, np.uint8(0)), np.column_stack([q[same] + 1, p[same] + 1]).ravel())[::2]
                value[same] = np.minimum(least, most - 1) + np.uint8(1)
            new_low[m] = 0
            new_low[m + pairs] = value
            symbols = np.empty(len(fresh), np.uint8)
            symbols[stays] = old
            symbols[to] = np.where(sizes[active] > step, text[np.maximum(ends[active] - step - 1, 0)], DONE)
            bwt.write(symbols)
            common.write(new_low)
        last, low = bwt.read(), common.read()
        bwt.close()
        common.close()
    # from each empty suffix back through the whole transform: the places of the longer and longer suffixes
    rank = np.empty(len(last), np.int64)
    order = ranked(last)
    rank[order] = m + np.arange(len(order))
    name, place = np.empty(len(last), np.int64), np.empty(len(last), np.int64)
    at, active = np.arange(m), np.arange(m)
    for step in range(1, int(sizes.max(initial=0)) + 1):
        active = active[sizes[active] >= step]
        at[active] = to = rank[at[active]]
        name[to], place[to] = active, sizes[active] - step
    return name[m:], place[m:], low[m:]


def ranked(symbols: np.ndarray) -> np.ndarray:
    """The places of all symbols but DONE, by symbol and place."""
    order = np.argsort(symbols, kind="stable")
    return order[: len(symbols) - int(np.count_nonzero(symbols == DONE))]


def later_windows(strings: list[bytes], doc: np.ndarray, pos: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each window that also starts earlier, in the strings at pos of doc."""
    name, place, common = collection_index(strings, width)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    whole = place + width <= sizes[name]
    group = np.cumsum(common < width)
    name, place, group = name[whole], place[whole], group[whole]
    order = np.lexsort((pos[name] + place, doc[name], group))
    name, place, group = name[order], place[order], group[order]
    start = pos[name] + place
    head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0)) if len(group) else np.empty(0, np.int64)
    later = (doc[name] != doc[name[head]]) | (start != start[head])
    return name[later], place[later]


SLICES = pa.schema([("mini", pa.int64()), ("doc", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32()), ("anchor", pa.int32()), ("key", pa.int64()), ("bytes", pa.binary())])
RUNS = pa.schema([("doc", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, tid, text, wanted in zip(b["doc"].to_pylist(), b["tid"].to_pylist(), byte_texts(b["text"]), b["wanted"].to_pylist(), strict=True):
            for w in wanted:
                if w["size"] <= HOT:
                    rows.append((w["mini"], doc, tid, w["pos"], w["anchor"], None, text[w["pos"] : w["pos"] + w["n"] + WIDTH - 1]))
                else:
                    rows += ((w["mini"], doc, tid, p, None, xxhash.xxh3_64_intdigest(text[p : p + WIDTH]) - 2**63, None) for p in range(w["pos"], w["pos"] + w["n"]))
            if len(rows) > 20_000:
                yield batch(SLICES, *zip(*rows, strict=True))
                rows = []
        if rows:
            yield batch(SLICES, *zip(*rows, strict=True))


def by_class(batches: Iterator[pa.RecordBatch], most: int, size) -> Iterator[list[dict]]:
    """Rows sorted by mini, in lists of whole classes of about most units of size."""
    held: list[dict] = []
    total = 0
    for b in batches:
        for r in b.to_pylist():
            if total >= most and r["mini"] != held[-1]["mini"]:
                yield held
                held, total = [], 0
            held.append(r)
            total += size(r)
    if held:
        yield held


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in by_class(batches, 2 * SHARD, lambda r: len(r["bytes"])):
        rows, strings, pos = narrowed(rows, [r["bytes"] for r in rows], WIDTH, GRAM, PARTS)
        if not rows:
            continue
        doc, tid = (np.array([r[c] for r in rows], np.int64) for c in ("doc", "tid"))
        # strings of other classes can't equal, whatever their order
        name, place = later_windows(strings, places(doc, tid), pos)
        order = np.lexsort((place, name))
        name, place = name[order], place[order]
        head = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (place[1:] != place[:-1] + 1)])) if len(name) else name
        n = np.diff(np.append(head, len(name)))
        name, place = name[head], place[head]
        yield batch(RUNS, doc[name], tid[name], (pos[name] + place).astype(np.int32), n.astype(np.int32))


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
REMOVED_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, tid, text, runs in zip(b["doc"].to_pylist(), b["tid"].to_pylist(), byte_texts(b["text"]), b["runs"], strict=True):
            if runs.is_valid and len(runs.values):
                starts, n = (runs.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                a, e = covered(starts, n, WIDTH, len(text))
            else:
                a = e = np.empty(0, np.int64)
            spans = list(zip(a.tolist(), e.tolist(), strict=True))
            kept, end = [], 0
            for s, t in spans:
                kept.append(text[end:s])
                end = t
            kept.append(text[end:])
            rows.append((id_of(doc, tid), len(text), int((e - a).sum()), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": s, "end": t} for s, t in spans]))
        yield batch(REMOVED, *(list(zip(*rows, strict=True)) or [[]] * 6))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, tid, pos, n): the windows from pos to pos + n - 1 of a document that also start earlier."""
    texts = keyed(docs)
    gone, open_ = split_repeats(map_batches(texts, _segments, SEGMENT_SQL), by_start=True)
    sliced = materialize(map_batches(fetched(open_, texts), _slices, "mini long, doc long, tid long, pos int, anchor int, key long, bytes binary"), "slices", clean=True)
    indexed = sliced.filter("key is null").select("mini", "doc", "tid", "pos", "anchor", "bytes").repartition("mini").sortWithinPartitions("mini", "doc", "tid", "pos")
    indexed = map_batches(indexed, _index, "doc long, tid long, pos int, n int")
    hot = repeated_windows(sliced.filter("key is not null"), by_start=True)
    return materialize(gone.unionByName(indexed).unionByName(hot), "runs", clean=True)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every document."""
    runs = repeated_runs(docs).groupBy("doc", "tid").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))
    return map_batches(keyed(docs).join(runs.hint("shuffle_hash"), ["doc", "tid"], "left").select("doc", "tid", "text", "runs"), _remove, REMOVED_SQL)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents")).drop("spans")
