"""Operator 5, quality rules: a document's counts against thresholds that adapt to its language and source.

Each metric's distribution is kept as a logarithmic bucket sketch: the bucket of a value x is ceil(log(x) / log(GAMMA)),
so a quantile read from the counts is within (GAMMA - 1) / 2 of a value at that rank. Sketches are plain bucket counts:
they merge by addition, in any order and with the same result, from (language, source) up to language and to all.
A document fails where a metric lies beyond the upper quartile by more than WIDTH times the spread between quartiles
(at least SPREAD), read from the sketch of its language and source; groups of fewer than LEAST documents use the
sketch of their language, then that of all documents. Documents that fail the base rules don't enter the sketches.

Very long texts are counted whole, in a task that holds one. Ties: a metric that equals its limit is kept. Nulls: a null
text has no words; null languages and sources are groups of their own. Empty tables give no rows.
Repeated rows are judged one by one. Columns besides doc_id, text, lang and source are ignored by quality_verdicts and
kept by quality_filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import batch, byte_texts, map_batches, materialize, read_table, unused

GAMMA = 1.05
WIDTH = 6.0
LEAST = 100
#: Least spread between quartiles, by metric.
SPREAD = {"symbol_ratio": 0.01, "upper_ratio": 0.03, "bar_ratio": 0.03, "word_length": 1.0, "dup_line_ratio": 0.1, "repeat_ratio": 0.05, "stutter_ratio": 0.05}
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
INSIDE = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bars", "n_lines", "n_stutter")


def repeated_words(hashes: np.ndarray, width: int = 8) -> int:
    """How many words lie in windows of width words that occur twice or more, the first occurrence included."""
    if len(hashes) - width + 1 < 2:
        return 0
    h, done, mul = hashes, 1, 0x9E3779B97F4A7C15
    while done < width:  # doubling: h[i] stands for words i .. i + done - 1
        step = min(done, width - done)
        h = (h[: len(h) - step] * np.uint64(mul)) ^ (h[step:] + (h[step:] >> np.uint64(29)))
        done, mul = done + step, (mul * mul + 2) % 2**64
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[back] > 1)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.split()  # of bytes: splits at exactly \\x20 and \\x09-\\x0D
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (
        len(words), len(text.translate(None, SPACE + INSIDE)), len(text) - len(text.translate(None, SYMBOLS)), dup, repeated_words(hashes),
        len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), text.count(b"|"), lines, int((hashes[1:] == hashes[:-1]).sum()),
    )


COUNTED = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in COUNTS)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [counts(t) for t in byte_texts(b["text"])]
        yield batch(COUNTED, b["doc_id"], b["tid"], b["lang"], b["source"], *(list(zip(*rows, strict=True)) or [[]] * len(COUNTS)))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, tid (hash of the text), lang, source and COUNTS of every document, with base_failed and the metrics of SPREAD."""
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    c = map_batches(of, _count, "doc_id long, tid long, lang string, source string, " + ", ".join(f"{x} long" for x in COUNTS))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return c.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "symbol_ratio": part("n_symbols", "word_chars"), "upper_ratio": part("n_upper", "word_chars"), "bar_ratio": part("n_bars", "n_words"),
        "word_length": part("word_chars", "n_words"), "dup_line_ratio": part("n_dup_lines", "n_lines"), "repeat_ratio": part("n_repeat_words", "n_words"),
        "stutter_ratio": part("n_stutter", "n_words"),
    })


def sketches(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts (keys, metric, bucket, n) of the documents that pass the base rules; bucket null stands for 0."""
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in SPREAD)))
    long = metrics.filter("not base_failed").select(*keys, one.alias("e")).select(*keys, "e.*")
    return long.groupBy(*keys, "metric", F.when(F.col("x") > 0, F.ceil(F.log("x") / F.log(F.lit(GAMMA)))).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The same sketches for coarser groups."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its documents, and the limit of each metric."""
    group = Window.partitionBy(*keys, "metric")
    up = group.orderBy(F.asc_nulls_first("bucket"))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    ranked = sketch.withColumns({"to": F.sum("n").over(up), "total": F.sum("n").over(group), "value": value})
    at = lambda q: F.min(F.when(F.col("to") >= q * F.col("total"), F.col("value")))
    quartiles = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    spread = F.create_map(*(x for m, s in SPREAD.items() for x in (F.lit(m), F.lit(s))))
    limit = quartiles.select(*keys, "metric", "docs", (F.col("q3") + WIDTH * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("metric")])).alias("limit"))
    return limit.groupBy(*keys).agg(F.max("docs").alias("docs"), *(F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"max_{m}") for m in SPREAD))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the metrics and the limits that applied, for every document."""
    metrics = materialize(counted(docs), "quality")
    fine = materialize(sketches(metrics, ["lang", "source"]), "sketch")
    by_lang = merged(fine, ["lang"])
    levels = [fences(fine, ["lang", "source"]), fences(by_lang, ["lang"]), fences(merged(by_lang, []), [])]
    pairs, langs, every = (x.select(*(F.col(c).alias(f"{c}_{i}") for c in x.columns)) for i, x in enumerate(levels))
    # limits of each (language, source) first: a small table; then one join with the documents
    table = pairs.join(langs, F.col("lang_0").eqNullSafe(F.col("lang_1")), "left").join(F.broadcast(every), F.lit(True), "left")  # every: one row
    pick = lambda c: F.when(F.col("docs_0") >= LEAST, F.col(f"{c}_0")).when(F.col("docs_1") >= LEAST, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    table = materialize(table.select(F.col("lang_0").alias("l"), F.col("source_0").alias("s"), *(pick(f"max_{m}").alias(f"max_{m}") for m in SPREAD)), "limits")
    # a group all of whose documents fail the base rules has no sketch: nothing of it is kept anyway
    joined = metrics.join(table, metrics.lang.eqNullSafe(table.l) & metrics.source.eqNullSafe(table.s), "left").drop("l", "s")
    beyond = F.greatest(*(F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False)) for m in SPREAD))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns. Rows that share a doc_id, or have none, are judged each by
    its own text, language and source."""
    names = {c: unused(docs, f"bad_{c}") for c in ("doc_id", "tid", "lang", "source")}
    bad = quality_verdicts(docs).filter("not kept").select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    same = lambda c, kind: F.col(c).cast(kind).eqNullSafe(F.col(names[c]))
    own = same("doc_id", "long") & (F.xxhash64("text") == F.col(names["tid"]))
    return docs.join(bad, own & same("lang", "string") & same("source", "string"), "left_anti")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
