"""Operator 13, resampling by importance for a target distribution, over hashed n-grams.

DuckDB counts in every partition: SQL lower-cases, cuts words, unnests them and windows runs of consecutive words, and a
registered function hashes each different run with zlib's CRC to one of BUCKETS buckets. Each document's bucket counts (at
most BUCKETS, however long the text) go to Parquet through Spark's own writer, so that a lost executor's part is simply
written again. Spark adds them up to the source's and the target's distribution, whose smoothed log ratio is a bucket's
gain, and scores each document from its own counts: the text is read once. A document's weight is its mean gain; with
noise of the Gumbel distribution from a hash of its id on top, the highest scores are a draw without replacement.

Ranks are given by ranges: rows are dealt by score into as many sorted ranges as there are tasks, and a range's ranks begin
behind the rows of those before it. The gains are BUCKETS numbers, so that they may be broadcast.

Very long texts are counted whole, alone in a statement. Ties of scores go to the smaller doc_id, null last. Nulls: a null text
has no words, weight 0 and no rank; a null doc_id is hashed as no digits. Repeated rows are documents each, and count each.
Empty tables give no rows; an empty target leaves only the smoothing. Columns besides doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from duckdb import DuckDBPyConnection
from duckdb.sqltypes import UINTEGER, VARCHAR
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, materialize, read_table, tasks
from tidewater.llm.duck import answers, connection, slices

BUCKETS = 10_000
#: Runs of so many consecutive words, from the first to the second number.
ORDERS = (1, 1)
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

COUNTED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

WORDS = r"""
SELECT doc_id, row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM docs
"""

COUNT = """
WITH cut AS MATERIALIZED ({words}),
word AS (SELECT row_no, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM cut),
gram AS ({grams}),
hashed AS (SELECT gram, (crc32(gram) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT gram FROM gram)),
bucket AS (SELECT row_no, bucket, count(*) AS n FROM gram JOIN hashed USING (gram) GROUP BY row_no, bucket),
listed AS (SELECT row_no, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts, sum(n)::BIGINT AS n_features FROM bucket GROUP BY row_no)
SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts FROM cut LEFT JOIN listed USING (row_no)
"""


def _grams(orders: tuple[int, int]) -> str:
    """SQL for all runs of orders[0] to orders[1] words of a document, by a window over its words."""
    one = lambda n: f"SELECT row_no, concat_ws(' ', {', '.join(f'lead(word, {k}) OVER w' for k in range(n))}) AS gram FROM word WINDOW w AS (PARTITION BY row_no ORDER BY place) QUALIFY lead(word, {n - 1}) OVER w IS NOT NULL"
    return " UNION ALL ".join("SELECT row_no, word AS gram FROM word" if n == 1 else one(n) for n in range(orders[0], orders[1] + 1))


def crc32(grams: pa.ChunkedArray) -> pa.Array:
    """zlib's CRC of each string's UTF-8 bytes."""
    raw = grams.cast(pa.binary()).to_pylist()
    return pa.array(np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)))


def _register(con: DuckDBPyConnection) -> None:
    con.create_function("crc32", crc32, [VARCHAR], UINTEGER, type="arrow")


def _kernel(orders: tuple[int, int], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    sql = COUNT.format(words=WORDS, grams=_grams(orders), buckets=buckets)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with connection() as con:
            _register(con)
            for b in batches:
                for part in slices(b):
                    yield from answers(con, sql, COUNTED, docs=part.append_column("row_no", pa.array(range(part.num_rows), pa.int64())))

    return kernel


def bucket_counts(docs: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the document's buckets and their counts, spilled to Parquet."""
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_batches(of, _kernel(orders, buckets), "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>")
    return materialize(counted, "bucket-counts")


def distribution(counted: DataFrame) -> DataFrame:
    """(bucket, n) over all documents."""
    return counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e")).groupBy(F.col("e.buckets").alias("bucket")).agg(F.sum("e.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: gains, an array with the gain of each bucket, a thousand times the log ratio of target and source with one
    count more in every bucket, floored."""
    spark = source.sparkSession
    of = lambda d, n: d.select("bucket", F.col("n").alias(n))
    table = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(of(source, "s"), "bucket", "left").join(of(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = table.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets))
    down = (F.col("s") + 1.0) * (F.col("all_t") + float(buckets))
    gain = F.floor(1000 * F.log(up / down)).cast("long")
    one = table.crossJoin(F.broadcast(totals)).select("bucket", gain.alias("gain"))  # totals: one row
    return one.agg(F.array_sort(F.collect_list(F.struct("bucket", "gain"))).alias("g")).select(F.col("g.gain").alias("gains"))


def scored(counted: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get("gains", b) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = counted.crossJoin(F.broadcast(gain)).select("doc_id", "n_words", "n_features", total.alias("total"))  # gain: one row of BUCKETS numbers
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return rows.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight")).withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row with its rank: 1, 2, 3 and so on for the highest scores, as many as `percent` of the documents of at least
    least_words words come to (rounded down), and null for the others."""
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "scores")
    may = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    ranges = materialize(rows.filter(may).repartitionByRange(tasks(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "score-ranges")
    # one row a range: a window over them is small however many documents there are
    up = Window.orderBy("_range")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(up) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    ranked = ranges.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn("_rank", F.col("_before") + F.col("_place"))
    ranked = ranked.withColumn("rank", F.when(F.col("_rank") <= F.expr(f"({percent} * _all) div 100"), F.col("_rank")))
    rest = rows.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest).drop("_row")


def resampled(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; target has a column text."""
    counted = bucket_counts(docs, orders, buckets)
    aim = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets)
    gain = materialize(gains(distribution(counted), distribution(aim), buckets), "gains")
    return drawn(scored(counted, gain, seed), percent, least_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: zlib's CRC of each different word, byte by byte from its table of 256 entries, which SQL makes first.
SQL = r"""
WITH one AS (SELECT list(list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS tab FROM (SELECT range::UBIGINT AS i FROM range(256))),
w AS (SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
x AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM w)),
y AS (SELECT word, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i::INTEGER + 1, 2))::UBIGINT) AS bytes FROM x),
z AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM y, one),
f AS (SELECT side, id, bucket FROM w JOIN z USING (word)),
b AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM b),
v AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::UINTEGER::DOUBLE AS h FROM documents LEFT JOIN v ON doc_id = id),
r AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS docs FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * docs // 100 THEN place END AS rank FROM k
"""
