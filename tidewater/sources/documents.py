"""Readers of price documents: nested market charts, flat series, OHLCV CSV, correlation and holder documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "array<array<double>>"
CHART = f"fetched_at bigint, endpoint string, days string, `interval` string, coin_ids array<string>, data map<string, struct<prices: {PAIRS}, market_caps: {PAIRS}, total_volumes: {PAIRS}, volumes: {PAIRS}>>"
OHLCV = "Date date, Open double, High double, Low double, Close double, Volume double"


def chart_documents(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Whole documents; files that aren't JSON are skipped, gzip is read as it is. pattern: of file names."""
    reader = spark.read.schema(CHART).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)


def chart_series(documents: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """asset, ts, price, volume: prices with the volumes of equal time (none: null). assets: only these (asset)."""
    one = documents.select(F.explode("data").alias("asset", "s"))
    if assets is not None:
        one = one.join(assets.select("asset").distinct(), "asset", "left_semi")
    pair = lambda c, to: one.select("asset", F.explode(c).alias("p")).select("asset", F.timestamp_millis(F.get("p", F.lit(0)).cast("bigint")).cast("timestamp_ntz").alias("ts"), F.get("p", F.lit(1)).alias(to))
    return pair("s.prices", "price").join(pair(F.coalesce("s.volumes", "s.total_volumes"), "volume"), ["asset", "ts"], "left")


def zipped_series(documents: DataFrame) -> DataFrame:
    """asset, ts, price, volume: prices and volumes paired by position."""
    one = documents.select(F.explode("data").alias("asset", "s"))
    z = one.select("asset", F.posexplode(F.arrays_zip(F.col("s.prices").alias("p"), F.coalesce("s.volumes", "s.total_volumes").alias("v"))).alias("at", "z"))
    return z.select("asset", "at", F.timestamp_millis(F.get("z.p", F.lit(0)).cast("bigint")).cast("timestamp_ntz").alias("ts"), F.get("z.p", F.lit(1)).alias("price"), F.get("z.v", F.lit(1)).alias("volume"))


def flat_series(spark: SparkSession, path: str | list[str], name: str = r"([^/]+?)\.[^/.]*$") -> DataFrame:
    """asset, ts, value of files that hold an array of [ms, value]; name is a pattern whose group is the asset in a path:
    the file's name, unless told otherwise."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), name, 1).alias("asset"), F.explode(F.from_json("value", PAIRS)).alias("p"))
    return text.select("asset", F.timestamp_millis(F.get("p", F.lit(0)).cast("bigint")).cast("timestamp_ntz").alias("ts"), F.get("p", F.lit(1)).alias("value"))


def ohlcv(spark: SparkSession, path: str | list[str], since: str | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """OHLCV rows of CSV files with a header."""
    df = spark.read.csv(path, schema=OHLCV, header=True, dateFormat=date_format, mode="DROPMALFORMED")
    return df.filter(F.col("Date") >= F.lit(since).cast("date")) if since else df


def column_pairs(df: DataFrame, symbol: Column, category: str) -> DataFrame:
    """Each symbol and its series [[ms, value], ...] of one OHLCV column, in order."""
    point = F.struct(F.unix_millis(F.col("Date").cast("timestamp")).cast("double").alias("t"), F.col(category).alias("v"))
    return df.groupBy(symbol.alias("symbol")).agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.array(p["t"], p["v"])).alias(category.lower()))


def holder_ledger(spark: SparkSession, path: str) -> DataFrame:
    """holder, ts, amount of documents {holder: {time: "1,234.50"}}."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("holder", "points"))
    rows = text.select("holder", F.explode("points").alias("time", "amount"))
    return rows.select("holder", F.to_timestamp_ntz("time").alias("ts"), F.regexp_replace("amount", ",", "").cast("double").alias("amount"))


def freshness(documents: DataFrame, now: DataFrame, hours: float = 4) -> DataFrame:
    """asset, fetched_at, fresh, with the time in ms as now's one row (now): whether each asset's newest document was fetched within some hours, so that another fetch can
    be skipped."""
    newest = documents.select("fetched_at", F.explode(F.map_keys("data")).alias("asset")).groupBy("asset").agg(F.max("fetched_at").alias("fetched_at"))
    x = newest.crossJoin(F.broadcast(now.select("now")))
    return x.select("asset", "fetched_at", (F.col("now") - F.col("fetched_at") < int(hours * 3_600_000)).alias("fresh"))
