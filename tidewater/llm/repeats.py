"""What the two operators on repeated strings share: cutting texts into segments by minimizers.

A window is WIDTH symbols (bytes, or words) in a row. Of the hashes of its k-grams the least is its minimizer, so equal
windows have equal minimizers, wherever they are. Consecutive windows of one minimizer form a segment, and all windows
that may be equal are in segments of one class (that minimizer). Segments that occur again as a whole need no index:
only their first occurrences do, and of those only the ones whose class has further segments. Nothing is sampled: every
window of every text is in exactly one segment.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialize

#: Windows of one segment at most; longer runs (of periodic text) are several segments.
RUN = 80
#: Classes of more distinct segments than this are compared window by window instead of in one index.
HOT = 4096
#: The largest and the least number of 64 bits.
LAST, FIRST = 2**63 - 1, -(2**63)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT_SQL = "mini long, content long, doc long, tid long, pos int, n int, rep boolean, anchor int, gone boolean"

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any substring of a symbol sequence, from sums over powers modulo 2 ** 64."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(INVERSE, n)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(BASE, len(self.sums))[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * powers(BASE, len(self.sums))[:n]) if n > 0 else np.empty(0, np.uint64)


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def segments(symbols: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """The segments of texts whose symbols lie in a row: (text, start in it, windows, minimizer, content, rep,
    anchor). rep says that the minimizer stands at several places of the segment, so that windows of it may be equal to
    each other; anchor is where it stands first. content is a hash of 64 bits: equal ones are removed unverified."""
    empty = np.empty(0, np.int64)
    none = empty, empty, empty, empty, empty, empty.astype(bool), empty
    if len(symbols) < width:
        return none
    roll, w = Rolling(symbols), width - gram + 1
    grams = roll.grams(gram)
    least = minima(grams, w)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    at = np.arange(len(least))
    valid = at + width <= (begin + sizes)[text]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return none
    total = np.cumsum(valid)
    n = np.diff(np.append(total[start] - 1, total[-1]))
    parts = -(-n // RUN)
    if (parts > 1).any():
        of = np.repeat(np.arange(len(start)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, n = start[of] + k * RUN, np.minimum(RUN, n[of] - k * RUN)
    first = np.empty(len(start), np.int64)
    last = np.empty(len(start), np.int64)
    for s in range(0, len(start), 1 << 14):
        some = slice(s, s + (1 << 14))
        first[some] = start[some] + grams[start[some, None] + np.arange(w)].argmin(axis=1)
        end = start[some] + n[some] - 1
        last[some] = end + w - 1 - grams[end[:, None] + np.arange(w - 1, -1, -1)].argmin(axis=1)
    content = roll(start, start + n + width - 1).view(np.int64)
    return text[start], start - begin[text[start]], n, least[start].view(np.int64), content, first != last, first - start


def places(doc: np.ndarray, tid: np.ndarray) -> np.ndarray:
    """Numbers of documents in their order, for the rows of one batch; see keyed()."""
    own = np.where((doc == LAST) & (tid >= 0), tid, -1)
    order = np.lexsort((own, doc))
    d, o = doc[order], own[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([np.zeros(min(1, len(order)), bool), (d[1:] != d[:-1]) | (o[1:] != o[:-1])]))
    return out


def known_in_batch(mini: np.ndarray, content: np.ndarray, doc: np.ndarray, tid: np.ndarray, pos: np.ndarray, by_start: bool) -> np.ndarray:
    """Which segments have an earlier occurrence in the same batch; these needn't be shuffled by minimizer."""
    doc = places(doc, tid)
    order = np.lexsort((pos, doc, content, mini))
    same = np.zeros(len(order), bool)
    m, c, d = mini[order], content[order], doc[order]
    same[1:] = (m[1:] == m[:-1]) & (c[1:] == c[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    gone = np.zeros(len(order), bool)
    gone[order] = (same & ((d != d[head]) | (pos[order] != pos[order][head]))) if by_start else d != d[head]
    return gone


def portions(batches: Iterator, most: int = 1 << 20) -> Iterator:
    """Arrow batches with a text column in slices of about a MB of text, one row at least; a kernel's arrays take some
    hundred bytes for each byte."""
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(sizes):
            to = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
            yield b.slice(a, to - a)
            a = to


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tid, text: rows by id and content, so that rows of one id stay apart."""
    doc, tid = keys()
    return docs.select(doc.alias("doc"), tid.alias("tid"), F.coalesce("text", F.lit("")).alias("text"))


def keys() -> tuple[Column, Column]:
    """doc and tid of a row with doc_id and text. A null id stands behind all others, as LAST with a tid that isn't negative;
    the id LAST has negative ones. Each text without an id is a document of its own, in the order of tid."""
    given, tid = F.col("doc_id").cast("long"), F.xxhash64("text")
    own = F.when(given.isNull(), tid.bitwiseAND(F.lit(LAST))).when(given == LAST, tid.bitwiseOR(F.lit(FIRST))).otherwise(tid)
    return F.coalesce(given, F.lit(LAST)), own


def id_of(doc: int, tid: int) -> int | None:
    """The doc_id behind doc and tid."""
    return None if doc == LAST and tid >= 0 else doc


def place(*more: str) -> Column:
    """What orders the documents of rows with doc and tid (see keys()), and the columns more after that."""
    return F.struct("doc", F.when((F.col("doc") == LAST) & (F.col("tid") >= 0), F.col("tid")).otherwise(-1).alias("own"), *more)


def split_repeats(found: DataFrame, by_start: bool) -> tuple[DataFrame, DataFrame]:
    """From the segments of all documents: those that an earlier occurrence covers as a whole (doc, tid, pos, n), and
    first occurrences whose class has further segments (mini, doc, tid, pos, n, anchor, size), size being the class's segments
    and anchor -1 where the minimizer stands at several places.
    by_start: an earlier start in the same document counts as earlier as well."""
    found = materialize(found, "segments", clean=True)
    same = Window.partitionBy("mini", "content")
    own = place("pos") if by_start else place()
    early = F.min(own).over(same)
    # equal rows are one: their results are joined to each of them
    seen = found.filter("not gone").withColumn("gone", own > early).dropDuplicates(["mini", "content", "doc", "tid", "pos"])
    seen = materialize(seen.drop("content"), "firsts", clean=True)
    gone = found.filter("gone").select("doc", "tid", "pos", "n").unionByName(seen.filter("gone").select("doc", "tid", "pos", "n"))
    gone = materialize(gone, "gone", clean=True)
    discard(found)
    first = seen.filter("not gone")
    # first occurrences in a class differ, but for repeats within a document where those don't count as earlier
    classes = first.groupBy("mini").agg(F.count("*").alias("size"), F.max("rep").alias("rep"))
    classes = materialize(classes.filter((F.col("size") > 1) | (F.col("rep") if by_start else F.lit(False))).select("mini", "size"), "classes", clean=True)
    open_ = materialize(first.join(classes, "mini").select("mini", "doc", "tid", "pos", "n", F.when(F.col("rep"), -1).otherwise(F.col("anchor")).alias("anchor"), "size"), "open", clean=True)
    discard(seen, classes)
    return gone, open_


def fetched(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """The open segments by document with its text: doc, tid, text, wanted array<struct<mini, pos, n, anchor, size>>."""
    wanted = open_.groupBy("doc", "tid").agg(F.collect_list(F.struct("mini", "pos", "n", "anchor", "size")).alias("wanted"))
    return texts.join(wanted.hint("shuffle_hash"), ["doc", "tid"])


def repeated_windows(windows: DataFrame, by_start: bool) -> DataFrame:
    """Of single windows (mini, key, doc, tid, pos) those with an earlier equal one: doc, tid, pos, n = 1. The earliest of
    each is found by partial minima before the shuffle, and joined back, so that a frequent window is split."""
    own = place("pos") if by_start else place()
    early = windows.groupBy(F.col("mini").alias("m"), F.col("key").alias("k")).agg(F.min(own).alias("early"), F.max(own).alias("late")).filter("early <> late").drop("late")
    joined = windows.join(early, (F.col("mini") == F.col("m")) & (F.col("key") == F.col("k")))
    return joined.filter(own > F.col("early")).select("doc", "tid", "pos", F.lit(1).alias("n"))


def covered(starts: np.ndarray, n: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (starts, ends) of symbols that runs of n windows from starts cover."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.minimum(starts[order] + n[order] + width - 1, size)
    if not len(a):
        return a, b
    reach = np.maximum.accumulate(b)
    head = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(a) - 1)]


def partners(minis: list[int], anchors: list[int], sizes: list[int], strings: list, width: int, gram: int, parts: int) -> list[tuple[int, int] | None]:
    """Which windows of the segments of whole classes may be equal to others: from and to, or None. A window that has l
    symbols to the left of its minimizer has width - gram - l to the right. For each part of the range of l, segments
    that share with no other what all its windows have there hold no repeated window of that part. A segment of anchor
    -1 may hold any window of its class at any of its places, so that all segments of such a class stay whole."""
    span = width - gram
    step = -(-(span + 1) // parts)
    reach = [(a, min(a + step, span + 1) - 1) for a in range(0, span + 1, step)]

    def keys(m: int, a: int, s) -> Iterator:
        for low, high in reach:
            to = a + gram + span - high
            yield (m, low, bytes(s[a - low : to])) if low <= a and to <= len(s) else None

    whole = {m for m, a in zip(minis, anchors, strict=True) if a < 0}
    found = [[] if m in whole else list(keys(m, a, s)) for m, a, s in zip(minis, anchors, strings, strict=True)]
    seen = Counter(k for own in found for k in own if k)
    out: list[tuple[int, int] | None] = []
    for m, a, n, own in zip(minis, anchors, sizes, found, strict=True):
        if m in whole:
            out.append((0, n))
            continue
        shared = [r for r, k in zip(reach, own, strict=True) if k and seen[k] > 1]
        low, high = (max(0, a - shared[-1][1]), min(n, a - shared[0][0] + 1)) if shared else (0, 0)
        out.append((low, high) if low < high else None)
    return out


def narrowed(rows: list[dict], strings: list, width: int, gram: int, parts: int) -> tuple[list[dict], list, np.ndarray]:
    """The rows that partners() leaves, their strings without what it excludes, and where those begin."""
    sizes = [len(s) - width + 1 for s in strings]
    spans = partners([r["mini"] for r in rows], [r["anchor"] for r in rows], sizes, strings, width, gram, parts)
    kept = [(r, s[x[0] : x[1] + width - 1], r["pos"] + x[0]) for r, s, x in zip(rows, strings, spans, strict=True) if x]
    return [k[0] for k in kept], [k[1] for k in kept], np.array([k[2] for k in kept], np.int64)
