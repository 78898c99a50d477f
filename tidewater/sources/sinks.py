"""Writers: JSON with a codec, per-asset files, CSV, ranked Markdown tables, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODECS = ("none", "gzip", "bzip2", "deflate", "snappy", "lz4")


def write_json(df: DataFrame, path: str, codec: str = "gzip") -> None:
    df.write.mode("overwrite").option("compression", codec).json(path)


def write_split(df: DataFrame, path: str, keys: tuple[str, ...] = ("asset",)) -> None:
    """A folder for each key."""
    df.write.mode("overwrite").partitionBy(*keys).json(path)


def points(ts: str, value: str) -> Column:
    """A series as an array of [ms, value], in order; for a grouped aggregate."""
    p = F.struct(F.unix_millis(F.col(ts).cast("timestamp")).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    return F.transform(F.array_sort(F.collect_list(p)), lambda x: F.array(x["t"], x["v"]))


def write_charts(series: DataFrame, path: str, fetched_at: int | None = None) -> None:
    """Market charts of series(asset, ts, price, volume): a document for each asset, compressed by gzip. fetched_at: in ms;
    None: the time of the asset's last point."""
    at = F.max(F.unix_millis(F.col("ts").cast("timestamp"))) if fetched_at is None else F.max(F.lit(fetched_at))
    one = series.groupBy("asset").agg(at.alias("at"), F.struct(points("ts", "price").alias("prices"), points("ts", "volume").alias("total_volumes")).alias("s"))
    doc = one.select(F.col("at").alias("fetched_at"), F.array("asset").alias("coin_ids"), F.create_map("asset", "s").alias("data"), "asset")
    doc.repartition("asset").drop("asset").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 1).json(path)


def write_metrics(bars: DataFrame, path: str, metrics: dict[str, str]) -> None:
    """A folder for each asset and metric (name: column), with rows of ms and value."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in metrics.items())))
    x = bars.select("asset", F.unix_millis(F.col("bar").cast("timestamp")).alias("ms"), each.alias("m")).select("asset", "ms", "m.metric", "m.value")
    write_split(x, path, ("asset", "metric"))


def write_flat(bars: DataFrame, path: str, value: str = "close") -> None:
    """A folder for each asset with one array of [ms, value]."""
    text = bars.groupBy("asset").agg(F.to_json(points("bar", value)).alias("value"))
    text.repartition("asset").write.mode("overwrite").partitionBy("asset").text(path)


def write_ledger(rows: DataFrame, path: str, files: int = 8) -> None:
    """Documents {holder: {time: amount}} of rows(holder, ts, amount), amounts with commas and two decimals, in some files
    of many holders each."""
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("k"), F.format_number("amount", 2).alias("v"))
    one = rows.groupBy("holder").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    of = F.pmod(F.xxhash64("holder"), F.lit(files))
    # one object a file: the reader takes files as whole documents
    doc = one.groupBy(of.alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("holder", "m")))).alias("value"))
    doc.repartition("file").select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def compared_codecs(df: DataFrame, path: str, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """codec, n, bytes: df written as JSON with each codec, its rows when read again, and the size of its files."""
    out = None
    for c in codecs:
        write_json(df, f"{path}/{c}", c)
        n = df.sparkSession.read.schema(df.schema).json(f"{path}/{c}").agg(F.count("*").alias("n"))
        size = df.sparkSession.read.format("binaryFile").load(f"{path}/{c}/part-*").agg(F.sum("length").alias("bytes"))
        one = n.join(F.broadcast(size)).select(F.lit(c).alias("codec"), "n", "bytes")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def indicator_documents(df: DataFrame, every: str = "day") -> DataFrame:
    """The documents of assets in parts, one row for each asset and day (or month), so that rows are bounded: symbol, since, timestamp, price and every indicator as lists in order,
    and the times and prices of buy and sell signals. df: asset, bar, signal and indicators."""
    names = [c for c in df.columns if c not in ("asset", "bar", "signal", "open", "high", "low", "close", "volume")]
    row = F.struct("bar", F.col("close").alias("price"), "signal", *names)
    x = df.groupBy(F.col("asset").alias("symbol"), F.date_format(F.date_trunc(every, "bar"), "yyyy-MM-dd").alias("since")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    at = lambda a: F.transform(a, lambda s: F.date_format(s["bar"], "yyyy-MM-dd HH:mm:ss"))
    of = lambda k: F.filter("r", lambda s: s["signal"] == k)
    lists = [F.col(f"r.{n}").alias(n) for n in ("price", *names)]
    sides = [c for k, side in ((1, "buy"), (-1, "sell")) for c in (at(of(k)).alias(f"{side}_signals"), F.transform(of(k), lambda s: s["price"]).alias(f"{side}_prices"))]
    return x.select("symbol", "since", at(F.col("r")).alias("timestamp"), *lists, *sides)


def write_csv(df: DataFrame, path: str, keys: tuple[str, ...] = ()) -> None:
    """CSV with a header, in a folder for each value of the keys."""
    df.write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)


def markdown_ranks(df: DataFrame, value: str, name: str = "asset", limit: int = 1000) -> str:
    """A Markdown table of the ranks by value, largest first; limit bounds what the driver formats."""
    rows = df.select(name, value).orderBy(F.desc(value), name).limit(limit).collect()
    return "\n".join([f"| Rank | {name} | {value} |", "| --- | --- | --- |", *(f"| {k} | {r[0]} | {r[1]:.4f} |" for k, r in enumerate(rows, 1))])


def upsert_histories(old: DataFrame, new: DataFrame) -> DataFrame:
    """holder, last, history: the keys of new with their newest amount (their order) and their old histories with the new
    points. Keys that new doesn't have go. old: holder, history map<ts, amount>; new: holder, ts, amount."""
    fresh = new.groupBy("holder").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("ts", "amount")))).alias("now"), F.max_by("amount", "ts").alias("last"))
    joined = fresh.join(old.withColumnRenamed("history", "was"), "holder", "left")
    merged = F.when(F.col("was").isNull(), F.col("now")).otherwise(F.map_concat(F.map_filter("was", lambda k, _: ~F.map_contains_key("now", k)), "now"))
    return joined.select("holder", "last", merged.alias("history"))
