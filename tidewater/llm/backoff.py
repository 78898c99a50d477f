"""Operator 6, language-model scores by stupid backoff over counts of the whole corpus, computed relationally.

Every document is scored by a model of all other documents: the n-gram counts of the corpus less its own. With c those
counts, a word w after the context h is worth c(h w) / c(h) if that is not zero, else BACKOFF times what it is worth
after the context without its first word; at the end stands its share of all words, or BACKOFF over one more than the
number of words for a word that no other document has. The score is the mean base-10 logarithm over a document's words.

An n-gram is known by a hash of its prefix and suffix of n - 1 words, a word by a hash of its bytes. The plan:

1. Count tables. Tasks explode n-grams of all orders, with what they have counted of them so far (so that a frequent one
   is a row for each BUNDLE words, not for each time); rows are partitioned by hash and summed. n-grams of one document
   alone are worth nothing to any other and go.
2. A count's row meets those of its prefix and its suffix, by joins on their hashes: (hash, count, counts of prefix,
   suffix and of what both share).
3. The documents' n-grams are exploded, one row for each different one of a document with the document's own counts,
   and joined to the count tables. Since a document of others that has an n-gram has its parts as well, the logarithm
   of what a word is worth is a sum over the orders n at which its n-gram is found: log c(n-gram) - log c(prefix) less
   the same of the next lower order, and less log BACKOFF. So each joined row adds a number of its own; they are summed
   per document.

Steps 1 and 3 take one range of hashes after the other (COUNTED_IN, SCORED_IN), and each range's shuffle files go before
the next, which bounds the disk. Rows are in proportion to the input everywhere. A frequent n-gram's rows in step 3 are
the hot key of a join whose partitions adaptive execution can split.

Words are runs of bytes other than \\x20 and \\x09-\\x0D with A-Z lower-cased. n-grams lie within one document; the first
words of a document have shorter contexts. Hashes have 64 bits (128 where counts are summed) and are not compared
further: at 10^10 different n-grams a wrong match is expected about three times.

Nulls: a null text has no words; texts without words have a null score. Rows are documents each, whatever their ids;
equal rows have equal scores. Very long texts are exploded whole, in a task that holds one at a time. Ties don't occur.
Empty tables give no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, byte_texts, discard, map_batches, materialize, read_table, tasks
from tidewater.llm.repeats import mix, portions

ORDER = 3
BACKOFF = 0.4
#: Words of the documents whose n-grams a task counts before it hands them on.
BUNDLE = 3_000_000
#: Words of the documents whose n-grams are exploded at once, and bytes of them.
PORTION = 4 << 20
#: Ranges of hashes, one after the other, for the count tables and for the scores.
COUNTED_IN, SCORED_IN = 4, 6

COUNTS = pa.schema([("n", pa.int32()), ("pre", pa.int64()), ("suf", pa.int64()), ("occ", pa.int64()), ("docs", pa.int64())])
OWN = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
SIZES = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("n_words", pa.int64())])


def turn(n: int) -> int:
    """By how many bits an n-gram's prefix is rotated before its suffix is added; different for each order."""
    return (18 * n + 5) % 64 | 1


def gram(pre: np.ndarray, suf: np.ndarray, n: int) -> np.ndarray:
    k = np.uint64(turn(n))
    return ((pre << k) | (pre >> (np.uint64(64) - k))) ^ suf


def gram_column(pre: str, suf: str, n: int) -> Column:
    """gram() in Spark."""
    return F.shiftleft(pre, turn(n)).bitwiseOR(F.shiftrightunsigned(pre, 64 - turn(n))).bitwiseXOR(F.col(suf))


def part(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of hashes that each is in."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def part_column(h: str, parts: int) -> Column:
    """part() in Spark."""
    return F.shiftrightunsigned(F.shiftrightunsigned(h, 32) * parts, 32)


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words in a row, and the number of each text's words."""
    words = [t.lower().split() for t in texts]  # of bytes: only A-Z change, only \x20 and \x09-\x0D split
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    return one, sizes


def grams(one: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each word's text, its place there, and for n = 1 .. order the hash of the n-gram that ends at it (of no meaning
    where the place is below n - 1)."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = [one]
    for n in range(2, order + 1):
        h = hashes[-1].copy()
        h[1:] = gram(hashes[-1][:-1], hashes[-1][1:], n)
        hashes.append(h)
    return text, place, hashes


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys in which equal ones are neighbours, where those begin, and how many they are."""
    order = np.argsort(keys)
    k = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    return order, starts, np.diff(np.append(starts, len(k)))


def counted(one: np.ndarray, sizes: np.ndarray, order: int, which: int, parts: int) -> Iterator[pa.RecordBatch]:
    """COUNTS of some texts: n-grams of one range of hashes, how often they occur, and whether in 1 or in more texts."""
    text, place, hashes = grams(one, sizes, order)
    for n, h in enumerate(hashes, 1):
        at = np.flatnonzero((place >= n - 1) & (part(h, parts) == which))
        if not len(at):
            continue
        by, starts, occ = groups(h[at])
        of = text[at[by]]
        many = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
        i = at[by[starts]]
        pre, suf = (h[i], np.zeros(len(i), np.uint64)) if n == 1 else (hashes[n - 2][i - 1], hashes[n - 2][i])
        yield batch(COUNTS, np.full(len(i), n, np.int32), pre.view(np.int64), suf.view(np.int64), occ, 1 + many)


def own_counts(text: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the n-gram that ends at a word occurs in its text, for the words at; and one of the words of each."""
    own = np.zeros(len(h), np.int64)
    by, starts, n = groups(mix(h[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    own[at[by]] = np.repeat(n, n)
    return own, at[by[starts]]


def exploded(one: np.ndarray, sizes: np.ndarray, doc: np.ndarray, order: int, which: int, parts: int) -> Iterator[pa.RecordBatch]:
    """OWN of some texts: a row for each different n-gram of a text in one range of hashes. a and b pack the text's own
    counts of it and its suffix, and of its prefix and what both share (0 where that is no n-gram)."""
    text, place, hashes = grams(one, sizes, order)
    none = np.zeros(len(one), np.int64)
    lower, lowest = none, none
    for n, h in enumerate(hashes, 1):
        whole = place >= n - 1
        own, i = own_counts(text, h, np.flatnonzero(whole if n < order else whole & (part(h, parts) == which)))
        i = i[part(h[i], parts) == which]
        if len(i):
            before = i - 1 if n > 1 else i
            yield batch(OWN, h[i].view(np.int64), doc[text[i]], own[i] << 32 | lower[i], lower[before] << 32 | lowest[before])
        lower, lowest = own, lower


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of both that names a document in what follows (equal rows share it)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.xxhash64("doc_id", "text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, doc, n_words of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(SIZES, b["doc_id"], b["doc"], [len(t.split()) for t in byte_texts(b["text"])])

    return map_batches(docs, run, "doc_id long, doc long, n_words long")


def explode_counts(docs: DataFrame, order: int, which: int, parts: int) -> DataFrame:
    """COUNTS of all documents, for one range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in portions(batches, PORTION):
            held.append(split(byte_texts(b["text"])))
            if sum(len(one) for one, _ in held) >= BUNDLE:
                yield from counted(*map(np.concatenate, zip(*held, strict=True)), order, which, parts)
                held = []
        if held:
            yield from counted(*map(np.concatenate, zip(*held, strict=True)), order, which, parts)

    return map_batches(docs.select("text"), run, "n int, pre long, suf long, occ long, docs long")


def count_tables(docs: DataFrame, order: int) -> DataFrame:
    """h, n, c, c_suf, c_pre, c_mid: the counts of the n-grams that more than one document has, and of their suffix,
    prefix and what both share (1 for what is no n-gram)."""
    spark, raw = docs.sparkSession, []
    for which in range(COUNTED_IN):
        # partitioned before any sum: what a task hands on is summed already
        rows = explode_counts(docs, order, which, COUNTED_IN).repartition(2 * tasks(spark), "pre", "suf")
        sums = rows.groupBy("pre", "suf").agg(F.max("n").alias("n"), F.sum("occ").alias("c"), F.sum("docs").alias("docs"))
        raw.append(materialize(sums.filter("docs > 1").drop("docs"), "counts", clean=True))
    every = reduce(DataFrame.unionByName, raw)
    one = F.lit(1).cast("long")
    tables = [materialize(every.filter("n = 1").select(F.col("pre").alias("h"), "n", "c", *(one.alias(x) for x in ("c_suf", "c_pre", "c_mid"))), "table")]
    for n in range(2, order + 1):
        pre = tables[-1].select(F.col("h").alias("pre"), F.col("c").alias("c_pre"), F.col("c_suf").alias("c_mid"))
        suf = tables[-1].select(F.col("h").alias("suf"), F.col("c").alias("c_suf"))
        both = every.filter(F.col("n") == n).join(pre, "pre").join(suf, "suf")
        tables.append(materialize(both.select(gram_column("pre", "suf", n).alias("h"), "n", "c", "c_suf", "c_pre", "c_mid"), "table", clean=True))
    discard(*raw)
    return reduce(DataFrame.unionByName, tables)


def explode_documents(docs: DataFrame, order: int, which: int, parts: int) -> DataFrame:
    """OWN of all documents, for one range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, PORTION):
            yield from exploded(*split(byte_texts(b["text"])), b["doc"].to_numpy(), order, which, parts)

    return map_batches(docs.select("doc", "text"), run, "h long, doc long, a long, b long")


def found_sums(docs: DataFrame, tables: DataFrame, order: int) -> DataFrame:
    """doc, value (natural logarithms that the found n-grams add), f_1, f_2, f_more, f_top (words whose 1-gram, 2-gram,
    n-grams of 2 and more words, and n-gram of order words is found); several rows of a document."""
    high, low = lambda c: F.shiftrightunsigned(c, 32), lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    occ = high("a")
    worth = F.log((F.col("c") - occ) * (F.col("c_mid") - low("b")).cast("double") / ((F.col("c_suf") - low("a")).cast("double") * (F.col("c_pre") - high("b"))))
    total = lambda c: F.coalesce(F.sum(F.when(c, occ)), F.lit(0))
    out = []
    for which in range(SCORED_IN):
        known = tables.filter(part_column("h", SCORED_IN) == which)
        joined = explode_documents(docs, order, which, SCORED_IN).join(known.hint("shuffle_hash"), "h")
        n = F.col("n")
        sums = joined.groupBy("doc").agg(F.sum(occ * worth).alias("value"), total(n == 1).alias("f_1"), total(n == 2).alias("f_2"), total(n > 1).alias("f_more"), total(n == order).alias("f_top"))
        out.append(materialize(sums, "sums", clean=True))
    return reduce(DataFrame.unionByName, out)


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, n_top (words whose n-gram of order words other documents have) and score of every document."""
    docs = keyed(docs)
    sizes = materialize(word_counts(docs), "sizes")
    words = sizes.agg(F.sum("n_words")).first()[0] or 0
    names = ("value", "f_1", "f_2", "f_more", "f_top")
    sums = found_sums(docs, count_tables(docs, order), order).groupBy("doc").agg(*(F.sum(c).alias(c) for c in names))
    # equal rows have been summed together
    copies = sizes.groupBy("doc").agg(F.count("*").alias("copies"))
    sums = sums.join(copies, "doc").select(F.col("doc").alias("of"), *((F.col(c) / F.col("copies")).alias(c) for c in names))
    all_ = sizes.join(sums, F.col("doc") == F.col("of"), "left").na.fill(0, list(names))
    n, rest = F.col("n_words"), F.greatest(F.lit(words) - F.col("n_words"), F.lit(0))
    contexts = reduce(lambda x, y: x + y, (F.greatest(n - (k - 1), F.lit(0)) for k in range(2, order + 1)), F.lit(0))
    logs = F.col("value") + (F.col("f_2") - F.col("f_1")) * F.log(F.greatest(rest, F.lit(1)))
    logs += (n - F.col("f_1")) * (math.log(backoff) - F.log(rest + 1)) + (contexts - F.col("f_more")) * math.log(backoff)
    return all_.select("doc_id", "n_words", F.col("f_top").cast("long").alias("n_top"), F.when(n > 0, logs / n / math.log(10)).alias("score"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))
