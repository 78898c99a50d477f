"""Windows over long series: rows get their place in the series, and windows run over bounded chunks of it.

A window partitioned by asset alone is one task for each asset, however long its series is. Here the place of a row is
its number within its day plus the rows of the days before (a small table), and rows are dealt into chunks of CHUNK
places. A window that reaches back by halo rows needs the last halo rows of the chunk before as well: those are copied
to the next chunk and dropped afterwards. So the tasks grow with the rows, not with the assets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 8192


def placed(df: DataFrame, by: str = "asset", ts: str = "bar", tie: tuple[str, ...] = ()) -> DataFrame:
    """df with _at, each row's place (from 0) in its series by ts and ties."""
    d = df.withColumn("_day", F.to_date(F.col(ts)))
    sizes = d.groupBy(by, "_day").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(by).alias("_of_by"), F.col("_day").alias("_of_day"), before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(by, "_day").orderBy(ts, *tie))
    return d.join(offsets, (F.col(by) == F.col("_of_by")) & (F.col("_day") == F.col("_of_day"))).withColumn("_at", F.col("_before") + rank - 1).drop("_of_by", "_of_day", "_day", "_before")


def over_chunks(df: DataFrame, halo: int, *stages: Callable[[WindowSpec], dict[str, Column]], by: str = "asset", ts: str = "bar", chunk: int = CHUNK, ahead: int = 0) -> DataFrame:
    """df with the columns of stages, each a function of a window ordered by place. All stages together may reach halo
    rows back and ahead rows forward."""
    if max(halo, ahead) > chunk:
        raise ValueError("a window may reach one chunk at most")
    of = F.floor(F.col("_at") / chunk)
    left = F.col("_at") % chunk
    copies = F.array_compact(F.array(of, F.when(left >= chunk - halo, of + 1), F.when((left < ahead) & (of > 0), of - 1)))
    x = placed(df, by, ts).withColumn("_own", of).withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy(by, "_chunk").orderBy("_at")
    for stage in stages:
        x = x.withColumns(stage(w))
    return x.filter(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk", "_at")


def running(df: DataFrame, outs: dict[str, tuple[str, Column]], by: str = "asset", ts: str = "bar", chunk: int = CHUNK, backwards: bool = False) -> DataFrame:
    """df with running aggregates: outs name a kind (sum, min, max, or last: the last value that is not null) and a
    column. Chunks run by themselves; what the chunks before hand on comes from a table of one row for each chunk.
    backwards: from the series' end (last is then the next value)."""
    x = placed(df, by, ts).withColumn("_part", F.floor(F.col("_at") / chunk))
    x = x.withColumns({f"_val_{o}": v for o, (_, v) in outs.items()})
    aggregates = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}
    order = lambda c: F.desc(c) if backwards else F.asc(c)
    own = Window.partitionBy(by, "_part").orderBy(order("_at")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_own_{o}": aggregates[kind](f"_val_{o}").over(own) for o, (kind, _) in outs.items()})
    farthest = F.min_by if backwards else F.max_by
    before = Window.partitionBy(by).orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(by, "_part").agg(*(farthest(f"_own_{o}", "_at").alias(f"_end_{o}") for o in outs))
    carried = ends.select(F.col(by).alias("_of_by"), F.col("_part").alias("_of_part"), *(aggregates[kind](f"_end_{o}").over(before).alias(f"_bef_{o}") for o, (kind, _) in outs.items()))
    joined = x.join(carried, (F.col(by) == F.col("_of_by")) & (F.col("_part") == F.col("_of_part")))

    def both(o: str, kind: str) -> Column:
        a, c = F.col(f"_own_{o}"), F.col(f"_bef_{o}")
        if kind == "sum":
            return F.when(c.isNull(), a).otherwise(c + F.coalesce(a, F.lit(0)))
        return F.coalesce(a, c) if kind == "last" else (F.least if kind == "min" else F.greatest)(a, c)

    drop = [f"_{k}_{o}" for o in outs for k in ("val", "own", "end", "bef")]
    return joined.withColumns({o: both(o, kind) for o, (kind, _) in outs.items()}).drop("_of_by", "_of_part", "_part", "_at", *drop)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(w: WindowSpec, n: int, x: str | Column, agg: Callable = F.avg) -> Column:
    """An aggregate over the last n rows; null until they hold n values."""
    r = trailing(w, n)
    return F.when(F.count(x).over(r) >= n, agg(x).over(r))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a / F.nullif(b, F.lit(0.0))


def change(w: WindowSpec, x: str, k: int = 1) -> Column:
    return F.col(x) - F.lag(x, k).over(w)


def simple_return(w: WindowSpec, x: str = "close", k: int = 1) -> Column:
    return ratio(x, F.lag(x, k).over(w)) - 1


def crossed_over(w: WindowSpec, a: Column, b: Column) -> Column:
    return F.coalesce((a > b) & (F.lag(a).over(w) <= F.lag(b).over(w)), F.lit(False))


def crossed_under(w: WindowSpec, a: Column, b: Column) -> Column:
    return F.coalesce((a < b) & (F.lag(a).over(w) >= F.lag(b).over(w)), F.lit(False))
