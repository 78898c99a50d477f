"""Queries of calendar effects, cross-asset statistics, portfolios and holders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import over_chunks, ratio, simple_return
from tidewater.functions.selection import percentiles
from tidewater.operators import calendar as cal
from tidewater.operators import cross
from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.sources.series import daily, holdings, hourly, order_days, table

r6 = lambda x: F.round(x, 6)
RET = f"r AS (SELECT *, close / nullif(lag(close) {b.W}, 0) - 1 AS ret FROM bars)"
ODAYS = "bars AS (SELECT o_orderpriority AS asset, date_trunc('day', o_orderdate)::TIMESTAMP AS bar, avg(o_totalprice) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL)"
WEEK = "((day(bar) - 1) // 7 + 1)::INTEGER"


def returns(df):
    return over_chunks(df, 1, lambda w: {"ret": simple_return(w)})


@query("weekday_returns", f"WITH {ODAYS}, {RET} SELECT asset, (isodow(bar) - 1)::INTEGER AS weekday, round(avg(ret), 6) AS mean_return, round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END), 6) AS positive FROM r WHERE ret IS NOT NULL GROUP BY ALL")
def weekday_returns(spark, d):
    x = returns(order_days(spark, d)).filter("ret is not null")
    return x.groupBy("asset", F.weekday("bar").alias("weekday")).agg(r6(F.avg("ret")).alias("mean_return"), r6(F.avg((F.col("ret") > 0).cast("double"))).alias("positive"))


@query("week_weekday_grouping_sets", f"WITH {ODAYS}, {RET}, w AS (SELECT {WEEK} AS week, (isodow(bar) - 1)::INTEGER AS weekday, ret FROM r WHERE ret IS NOT NULL) SELECT coalesce(week, 0)::INTEGER AS week, weekday, round(avg(ret), 6) AS mean_return, count(*) AS n FROM w GROUP BY GROUPING SETS ((weekday), (week, weekday))")
def week_weekday(spark, d):
    x = returns(order_days(spark, d)).filter("ret is not null").select(cal.week_of_month("bar").alias("week"), F.weekday("bar").alias("weekday"), "ret")
    return x.groupingSets([["weekday"], ["week", "weekday"]], "week", "weekday").agg(r6(F.avg("ret")).alias("mean_return"), F.count("*").alias("n")).select(F.coalesce("week", F.lit(0)).alias("week"), "weekday", "mean_return", "n")


@query("best_days", f"WITH {ODAYS}, {RET}, w AS (SELECT asset, {WEEK} AS week, (isodow(bar) - 1)::INTEGER AS weekday, avg(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY ALL) SELECT asset, week, weekday, round(m, 6) AS mean_return, row_number() OVER (PARTITION BY asset ORDER BY m, week, weekday)::INTEGER AS rank FROM w")
def best_days(spark, d):
    x = returns(order_days(spark, d)).filter("ret is not null").groupBy("asset", cal.week_of_month("bar").alias("week"), F.weekday("bar").alias("weekday")).agg(F.avg("ret").alias("m"))
    return x.select("asset", "week", "weekday", r6("m").alias("mean_return"), F.row_number().over(Window.partitionBy("asset").orderBy("m", "week", "weekday")).alias("rank"))


@query("swings", f"{b.DAILY}, l AS (SELECT asset, lag(bar) {b.W} AS from_bar, bar AS to_bar, lag(close) {b.W} AS p, close FROM bars) SELECT asset, from_bar, to_bar, round(100 * (close - p) / p, 6) AS change, round((p + close) / 2, 6) AS midpoint FROM l WHERE p <> 0 AND abs(100 * (close - p) / p) >= 30")
def swings(spark, d):
    x = over_chunks(daily(spark, d), 1, lambda w: {"from_bar": F.lag("bar").over(w), "p": F.lag("close").over(w)}).filter("p <> 0").withColumn("change", 100 * (F.col("close") - F.col("p")) / F.nullif(F.col("p"), F.lit(0.0)))
    return x.filter(F.abs("change") >= 30).select("asset", "from_bar", F.col("bar").alias("to_bar"), r6("change").alias("change"), r6((F.col("p") + F.col("close")) / 2).alias("midpoint"))


@query("hourly_pivot", f"{b.HOURLY} SELECT hour(bar)::INTEGER AS hour, {', '.join(f'round(avg(CASE WHEN isodow(bar) = {k + 1} THEN close END), 6) AS day_{k}' for k in range(7))} FROM bars GROUP BY ALL")
def hourly_pivot(spark, d):
    return hourly(spark, d).groupBy(F.hour("bar").alias("hour")).agg(*(r6(F.avg(F.when(F.weekday("bar") == k, F.col("close")))).alias(f"day_{k}") for k in range(7)))


CHEAP = "h AS (SELECT asset, date_trunc('day', bar)::TIMESTAMP AS day, hour(bar)::INTEGER AS hour, avg(close) AS p FROM bars GROUP BY ALL), ch AS (SELECT asset, day, first(hour ORDER BY p, hour) AS hour FROM h GROUP BY ALL)"


@query("cheapest_hour", f"{b.HOURLY}, {CHEAP} SELECT * FROM ch")
def cheapest_hour(spark, d):
    h = hourly(spark, d).groupBy("asset", F.date_trunc("day", "bar").cast("timestamp_ntz").alias("day"), F.hour("bar").alias("hour")).agg(F.avg("close").alias("p"))
    return h.groupBy("asset", "day").agg(F.min_by("hour", F.struct("p", "hour")).alias("hour"))


@query("best_trading_hours", f"{b.HOURLY}, {CHEAP} SELECT asset, (isodow(day) - 1)::INTEGER AS weekday, round(avg(hour), 6) AS mean_hour, count(*) AS days FROM ch GROUP BY ALL")
def best_trading_hours(spark, d):
    return cheapest_hour(spark, d).groupBy("asset", F.weekday("day").alias("weekday")).agg(r6(F.avg("hour")).alias("mean_hour"), F.count("*").alias("days"))


@query("avg_time_of_day", "SELECT event_type AS asset, printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS mean_time FROM (SELECT event_type, floor(avg(hour(ts) * 3600 + minute(ts) * 60 + second(ts)))::INTEGER AS s FROM events GROUP BY ALL)")
def avg_time_of_day(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("asset")).agg(cal.clock(F.avg(cal.seconds_of_day("ts"))).alias("mean_time"))


@query("recent_weekdays", f"{b.HOURLY}, m AS (SELECT asset, bar, close, dense_rank() OVER (PARTITION BY asset ORDER BY bar::DATE DESC) AS k FROM bars WHERE isodow(bar) = 2) SELECT asset, bar, close FROM m WHERE k <= 2")
def recent_weekdays(spark, d):
    """Bars of the two latest Tuesdays of each asset."""
    x = hourly(spark, d).filter(F.weekday("bar") == 1).withColumn("k", F.dense_rank().over(Window.partitionBy("asset").orderBy(F.desc(F.to_date("bar")))))
    return x.filter("k <= 2").select("asset", "bar", "close")


@query("weekend_filter", f"{b.HOURLY} SELECT asset, bar, close FROM bars WHERE isodow(bar) < 6 AND ((day(bar) - 1) // 7 + 1) = 2")
def weekend_filter(spark, d):
    return cal.without_weekends(hourly(spark, d)).filter(cal.week_of_month("bar") == 2).select("asset", "bar", "close")


# ---- cross-asset


@query("volatility_rank", f"{b.DAILY}, {RET} SELECT asset, round(stddev_samp(ret) * 100, 6) AS volatility, count(ret) AS n, row_number() OVER (ORDER BY stddev_samp(ret) DESC, asset)::INTEGER AS rank FROM r GROUP BY asset")
def volatility_rank(spark, d):
    v = returns(daily(spark, d)).groupBy("asset").agg((F.stddev_samp("ret") * 100).alias("v"), F.count("ret").alias("n"))
    return v.select("asset", r6("v").alias("volatility"), "n", F.row_number().over(Window.orderBy(F.desc("v"), "asset")).alias("rank"))  # one row an asset


@query("mean_return_rank", f"{b.DAILY}, {RET} SELECT asset, round(avg(ret), 6) AS mean_return, round(50000 * (1 + avg(ret)), 4) AS final, row_number() OVER (ORDER BY avg(ret) DESC, asset)::INTEGER AS rank FROM r GROUP BY asset")
def mean_return_rank(spark, d):
    v = returns(daily(spark, d)).groupBy("asset").agg(F.avg("ret").alias("m"))
    return v.select("asset", r6("m").alias("mean_return"), F.round(50000 * (1 + F.col("m")), 4).alias("final"), F.row_number().over(Window.orderBy(F.desc("m"), "asset")).alias("rank"))


ASSETS = ("click", "error", "purchase", "signup", "view")


@query("prices_wide", f"{b.DAILY} SELECT bar, {', '.join(f'max(CASE WHEN asset = {a!r} THEN close END) AS {a}' for a in ASSETS)} FROM bars GROUP BY bar")
def prices_wide(spark, d):
    return daily(spark, d).groupBy("bar").pivot("asset", list(ASSETS)).agg(F.first("close"))


EXPAND = f"b0 AS (SELECT bar, close AS b, volume AS bv FROM bars WHERE asset = 'view'), j AS (SELECT asset, bar, close AS a, volume AS av, b, bv FROM bars JOIN b0 USING (bar) WHERE asset <> 'view')"


def _corr(a: str, c: str) -> str:
    run = "OVER (PARTITION BY asset ORDER BY bar ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN count(*) {run} >= 2 AND max({a}) {run} > min({a}) {run} AND max({c}) {run} > min({c}) {run} THEN corr({a}, {c}) {run} END"


@query("expanding_corr", f"{b.DAILY}, {EXPAND} SELECT asset, bar, round({_corr('a', 'b')}, 6) AS correlation FROM j")
def expanding_corr(spark, d):
    return cross.expanding_correlation(daily(spark, d), "view").withColumn("correlation", r6("correlation"))


@query("volume_corr", f"{b.DAILY}, {EXPAND} SELECT asset, bar, round({_corr('av', 'bv')}, 6) AS correlation FROM j")
def volume_corr(spark, d):
    return cross.expanding_correlation(daily(spark, d), "view", "volume").withColumn("correlation", r6("correlation"))


@query("corr_latest", f"{b.DAILY}, {EXPAND}, c AS (SELECT asset, bar, {_corr('a', 'b')} AS c FROM j) SELECT asset, round(c, 6) AS correlation, row_number() OVER (ORDER BY c DESC, asset)::INTEGER AS rank FROM c WHERE bar = (SELECT max(bar) FROM c)")
def corr_latest(spark, d):
    c = cross.expanding_correlation(daily(spark, d), "view")
    last = c.agg(F.max("bar").alias("last"))  # one row
    return c.join(F.broadcast(last), F.col("bar") == F.col("last")).select("asset", r6("correlation").alias("correlation"), F.row_number().over(Window.orderBy(F.desc("correlation"), "asset")).alias("rank"))


@query("aligned_start", f"{b.HOURLY} SELECT asset, min(bar) AS first_bar, count(*) AS n FROM bars WHERE bar >= (SELECT min(bar) FROM bars WHERE asset = 'signup') GROUP BY asset")
def aligned_start(spark, d):
    return cross.aligned(hourly(spark, d), "signup").groupBy("asset").agg(F.min("bar").alias("first_bar"), F.count("*").alias("n"))


@query("lookup_semi_anti", "SELECT c_mktsegment, count(*) FILTER (WHERE has) AS with_orders, count(*) FILTER (WHERE NOT has) AS without_orders FROM (SELECT c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer) GROUP BY c_mktsegment")
def lookup_semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda x, name: x.groupBy("c_mktsegment").agg(F.count("*").alias(name))
    both = n(c.join(o, "c_custkey", "left_semi"), "with_orders").join(n(c.join(o, "c_custkey", "left_anti"), "without_orders"), "c_mktsegment", "full")
    return both.fillna(0, ["with_orders", "without_orders"])


@query("asof_signal", f"{b.HOURLY}, e AS (SELECT asset, bar, close FROM bars WHERE close > 300) SELECT b.asset, b.bar, e.close AS last_high FROM bars b ASOF LEFT JOIN e ON b.asset = e.asset AND b.bar >= e.bar")
def asof_signal(spark, d):
    """The last price above 300 as of each bar: one window instead of a range join."""
    w = Window.partitionBy("asset").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    return hourly(spark, d).select("asset", "bar", F.last(F.when(F.col("close") > 300, F.col("close")), ignorenulls=True).over(w).alias("last_high"))


# ---- portfolios


EXPECTED = f"wide AS (SELECT bar FROM bars GROUP BY bar HAVING count(DISTINCT asset) = 5), {RET}, ex AS (SELECT asset, avg(ret) AS m FROM r SEMI JOIN wide USING (bar) GROUP BY asset)"


def expected(spark, d):
    x = daily(spark, d)
    whole = x.groupBy("bar").agg(F.count_distinct("asset").alias("n")).filter("n = 5")
    return returns(x).join(whole, "bar", "left_semi").groupBy("asset").agg(F.avg("ret").alias("m"))


@query("expected_returns", f"{b.DAILY}, {EXPECTED} SELECT asset, h.h::INTEGER AS months, round(m * 21 * h.h, 6) AS expected FROM ex, (VALUES (1), (3), (6), (12)) h(h)")
def expected_returns(spark, d):
    return expected(spark, d).select("asset", F.explode(F.array(*(F.lit(k) for k in (1, 3, 6, 12)))).alias("months"), "m").select("asset", "months", r6(F.col("m") * 21 * F.col("months")).alias("expected"))


@query("lp_allocation", f"{b.DAILY}, {EXPECTED} SELECT asset, 1000.0::DOUBLE + CASE WHEN asset = (SELECT asset FROM ex ORDER BY m DESC, asset DESC LIMIT 1) AND (SELECT max(m) FROM ex) > 0 THEN 10000 * (1 - 5 * 0.1) ELSE 0 END AS amount FROM ex")
def lp_allocation(spark, d):
    return cross.allocation(expected(spark, d).withColumnRenamed("m", "expected"), 10_000.0, 0.1)


@query("kelly", f"{b.DAILY}, {RET}, k AS (SELECT asset, avg(ret) / nullif(var_pop(ret), 0) AS f, stddev_pop(ret) AS s FROM r GROUP BY asset) SELECT asset, round(f, 6) AS fraction, round(least(CASE WHEN s > 0.05 THEN f * 0.5 WHEN s < 0.01 THEN f * 1.5 ELSE f END, 1.0), 6) AS adjusted, round(greatest(0, f * (50000 - 10000)), 2) AS investment FROM k")
def kelly(spark, d):
    return cross.kelly(returns(daily(spark, d))).select("asset", r6("fraction").alias("fraction"), r6("adjusted").alias("adjusted"), F.round(F.greatest(F.lit(0.0), F.col("fraction") * 40000), 2).alias("investment"))


T = "(1 / (1 + 0.2316419 * abs(x)))"
_poly = " + ".join(f"{c} * pow({T}, {k})" for k, c in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 1))


def _cdf(x: str) -> str:
    tail = f"(exp(-({x}) * ({x}) / 2) / 2.5066282746310002 * ({_poly.replace('abs(x)', f'abs({x})')}))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


@query("black_scholes", f"{b.DAILY}, l AS (SELECT asset, close, ln(close / nullif(lag(close) {b.W}, 0)) AS lr, bar FROM bars), v AS (SELECT asset, last(close ORDER BY bar) AS s, stddev_pop(lr) * sqrt(252) AS sigma FROM l GROUP BY asset), e AS (SELECT *, (ln(s / (s * 1.05)) + (0.03 + sigma * sigma / 2) * 0.5) / (sigma * sqrt(0.5)) AS d1 FROM v), f AS (SELECT *, d1 - sigma * sqrt(0.5) AS d2 FROM e) SELECT asset, round(sigma, 6) AS sigma, round(s * {_cdf('d1')} - s * 1.05 * exp(-0.03 * 0.5) * {_cdf('d2')}, 5) AS call, round(s * 1.05 * exp(-0.03 * 0.5) * {_cdf('(-d2)')} - s * {_cdf('(-d1)')}, 5) AS put FROM f")
def black_scholes(spark, d):
    """Options half a year ahead, struck 5 % above the last price."""
    x = over_chunks(daily(spark, d), 1, lambda w: {"lr": F.log(ratio("close", F.lag("close").over(w)))})
    v = x.groupBy("asset").agg(F.max_by("close", "bar").alias("s"), (F.stddev_pop("lr") * F.sqrt(F.lit(252.0))).alias("sigma"))
    call, put = cross.black_scholes(F.col("s"), F.col("s") * 1.05, F.lit(0.5), F.lit(0.03), F.col("sigma"))
    return v.select("asset", r6("sigma").alias("sigma"), F.round(call, 5).alias("call"), F.round(put, 5).alias("put"))


@query("threshold_p99", "SELECT event_type AS asset, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, round(greatest(quantile_cont(value, 0.99), max(value)), 6) AS threshold FROM events GROUP BY event_type")
def threshold_p99(spark, d):
    """Both from one selection: the largest value is the percentile of share 1."""
    g = percentiles(table(spark, d, "events").withColumnRenamed("event_type", "asset"), ["asset"], "value", [0.99, 1.0])
    p, most = (F.get("percentiles", F.lit(k)) for k in (0, 1))
    return g.select("asset", r6(p).alias("p99"), most.alias("most"), r6(F.greatest(p, most)).alias("threshold"))


# ---- holders


@query("holders_bucket_avg", "SELECT user_id AS holder, n.n::INTEGER AS hours, date_trunc('day', ts)::TIMESTAMP + to_hours(CAST((hour(ts) // n.n) * n.n AS BIGINT)) AS bucket, round(avg(value), 6) AS amount FROM events, (VALUES (1), (2), (5), (24)) n(n) GROUP BY ALL")
def holders_bucket_avg(spark, d):
    """Means by 1, 2, 5 and 24 hours of the day."""
    x = holdings(spark, d).withColumn("hours", F.explode(F.array(*(F.lit(k) for k in (1, 2, 5, 24)))))
    at = (F.date_trunc("day", "ts") + F.make_interval(hours=F.floor(F.hour("ts") / F.col("hours")) * F.col("hours"))).cast("timestamp_ntz")
    return x.groupBy("holder", "hours", at.alias("bucket")).agg(r6(F.avg("amount")).alias("amount"))


HDAY = "hd AS (SELECT user_id AS holder, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS amount FROM events GROUP BY ALL)"


def holder_days(spark, d):
    return holdings(spark, d).groupBy("holder", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.sum("amount").alias("amount"))


@query("holders_pct", f"WITH {HDAY} SELECT holder, day, round(100 * amount / sum(amount) OVER (PARTITION BY day), 6) AS percent FROM hd")
def holders_pct(spark, d):
    x = holder_days(spark, d)
    total = x.groupBy("day").agg(F.sum("amount").alias("total"))  # partial sums before the shuffle, not one day in one task
    return x.join(total, "day").select("holder", "day", r6(100 * F.col("amount") / F.nullif(F.col("total"), F.lit(0.0))).alias("percent"))


@query("holders_zero_filled", f"WITH {HDAY}, g AS (SELECT holder, day FROM (SELECT DISTINCT holder FROM hd), (SELECT DISTINCT day FROM hd)) SELECT holder, day, round(coalesce(amount, 0), 6) AS amount FROM g LEFT JOIN hd USING (holder, day)")
def holders_zero_filled(spark, d):
    """Every holder on every day that occurs; the days are few, so each holder carries their list."""
    x = holder_days(spark, d)
    days = x.select(F.lit(1).alias("_k"), "day").distinct().groupBy("_k").agg(F.collect_list("day").alias("days"))
    grid = x.select("holder").distinct().join(F.broadcast(days)).select("holder", F.explode("days").alias("day"))  # days: one row
    return grid.join(x, ["holder", "day"], "left").select("holder", "day", r6(F.coalesce("amount", F.lit(0.0))).alias("amount"))


@query("holders_halves", f"WITH {HDAY}, t AS (SELECT holder, sum(amount) AS total FROM hd GROUP BY holder) SELECT holder, round(total, 4) AS total, ntile(2) OVER (ORDER BY round(total, 4) DESC, holder)::INTEGER AS half FROM t")
def holders_halves(spark, d):
    t = holder_days(spark, d).groupBy("holder").agg(F.round(F.sum("amount"), 4).alias("total"))
    return cross.halves(t, "total", "holder")


@query("holders_upsert", f"WITH {HDAY}, o AS (SELECT * FROM hd WHERE day < TIMESTAMP '2024-01-15'), n AS (SELECT * FROM hd WHERE day = TIMESTAMP '2024-01-15') SELECT n.holder, count(o.day) + 1 AS points, round(any_value(n.amount), 6) AS last FROM n LEFT JOIN o USING (holder) GROUP BY n.holder")
def holders_upsert(spark, d):
    from tidewater.sources.sinks import upsert_histories

    x = holder_days(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old = x.filter(F.col("day") < cut).groupBy("holder").agg(F.map_from_entries(F.collect_list(F.struct("day", "amount"))).alias("history"))
    new = x.filter(F.col("day") == cut).select("holder", F.col("day").alias("ts"), "amount")
    return upsert_histories(old, new).select("holder", F.size("history").cast("bigint").alias("points"), r6("last").alias("last"))
