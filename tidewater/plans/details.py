"""Queries of single steps: names and formats, look-ups, slices, lists, resampling, documents' series, regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import over_chunks, ratio, simple_return
from tidewater.operators import calendar as cal
from tidewater.operators import cross, markov, models, spectral, trades
from tidewater.operators import text as names
from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.plans.calendar import ODAYS, RET, returns
from tidewater.plans.chains import CUTS, MOVES, moves
from tidewater.sources.series import daily, hourly, order_days, table

r6 = lambda x: F.round(x, 6)


@query("clean_symbols", "SELECT DISTINCT 'X:' || upper(event_type) || 'USD' AS symbol, event_type AS asset FROM events")
def clean_symbols(spark, d):
    """Quoted symbols without their market's prefix and currency."""
    x = table(spark, d, "events").select(F.concat(F.lit("X:"), F.upper("event_type"), F.lit("USD")).alias("symbol")).distinct()
    return x.withColumn("asset", names.clean_symbol(F.col("symbol")))


_unit = "CASE WHEN contains(lower(f), 'minute') THEN 'Minutes' WHEN contains(lower(f), 'hour') THEN 'Hours' WHEN contains(lower(f), 'day') THEN 'Days' ELSE 'Time Units' END"


@query("file_units", f"WITH n AS (SELECT n_name || s.s AS f FROM nation, (VALUES ('-1-minute.json'), ('-Hourly.json'), ('-90-day.json'), ('.json')) s(s)) SELECT f AS file, {_unit} AS unit FROM n")
def file_units(spark, d):
    """The time unit that a file's name tells."""
    x = table(spark, d, "nation").select("n_name", F.explode(F.array(*(F.lit(s) for s in ("-1-minute.json", "-Hourly.json", "-90-day.json", ".json")))).alias("s"))
    return x.select(F.concat("n_name", "s").alias("file")).withColumn("unit", names.time_unit(F.col("file")))


@query("number_formats", "SELECT s_suppkey AS id, format('{:,.2f}', s_acctbal) AS shown, round(s_acctbal, 2) AS parsed, s_acctbal::DOUBLE / 1000000 AS units FROM supplier")
def number_formats(spark, d):
    """Amounts with thousands commas and two decimals, read back, and scaled by a token's six decimals."""
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("v"))
    x = x.withColumn("shown", names.with_commas(F.col("v")))
    return x.select("id", "shown", names.number(F.col("shown")).alias("parsed"), names.scaled(F.col("v"), 6).alias("units"))


@query("date_formats", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%a') AS weekday, (isodow(ts) - 1)::INTEGER AS number, round(hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0, 6) AS hours FROM events")
def date_formats(spark, d):
    """Times as text, weekdays by their short names and back to numbers, and hours since midnight."""
    x = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.date_format("ts", "E").alias("weekday"), "ts")
    return x.select("event_id", "at", "weekday", cal.day_number(F.col("weekday")).cast("int").alias("number"), r6(cal.hours_of_day("ts")).alias("hours"))


@query("trailing_slice", f"{b.HOURLY}, k AS (SELECT asset, bar, close, row_number() OVER (PARTITION BY asset ORDER BY bar DESC) AS k FROM bars) SELECT asset, bar, close FROM k WHERE k <= 30")
def trailing_slice(spark, d):
    """The last 30 bars of each asset."""
    return cal.last_rows(hourly(spark, d), 30).select("asset", "bar", "close")


@query("since_earliest", f"{b.HOURLY} SELECT asset, bar, close FROM bars WHERE bar >= (SELECT min(bar) FROM bars)")
def since_earliest(spark, d):
    """Bars from the earliest one of all assets on (which keeps all)."""
    return cross.since_earliest(hourly(spark, d)).select("asset", "bar", "close")


@query("lookup_merge", f"{b.DAILY}, {RET}, v AS (SELECT asset, round(100 * stddev_samp(ret), 6) AS volatility FROM r GROUP BY asset) SELECT asset, bar, close, volatility FROM bars LEFT JOIN v USING (asset)")
def lookup_merge(spark, d):
    """Bars with their asset's volatility, looked up in the table of assets."""
    x = daily(spark, d)
    v = returns(x).groupBy("asset").agg(r6(100 * F.stddev_samp("ret")).alias("volatility"))
    return cross.looked_up(x, v).select("asset", "bar", "close", "volatility")


@query("return_lists", f"WITH {ODAYS}, {RET} SELECT asset, (isodow(bar) - 1)::INTEGER AS weekday, count(*) AS n, string_agg(round(ret * 1000, 0)::BIGINT::VARCHAR, ',' ORDER BY bar) AS thousandths FROM r WHERE ret IS NOT NULL GROUP BY ALL")
def return_lists(spark, d):
    """The returns of each weekday as a list, in order."""
    x = cal.return_lists(returns(order_days(spark, d)), F.weekday("bar").alias("weekday"))
    return x.select("asset", "weekday", F.size("returns").cast("long").alias("n"), F.array_join(F.transform("returns", lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",").alias("thousandths"))


@query("volatility_lists", f"{b.DAILY}, {RET} SELECT asset, round(100 * stddev_samp(ret), 6) AS volatility, string_agg(strftime(bar, '%Y-%m-%d') || ':' || round(ret * 1000, 0)::BIGINT, ',' ORDER BY bar) AS listed FROM r WHERE ret IS NOT NULL GROUP BY asset")
def volatility_lists(spark, d):
    """Volatility with the dated returns behind it."""
    x = returns(daily(spark, d)).filter("ret is not null").groupBy("asset").agg(r6(100 * F.stddev_samp("ret")).alias("volatility"), F.array_sort(F.collect_list(F.struct("bar", "ret"))).alias("l"))
    return x.select("asset", "volatility", F.array_join(F.transform("l", lambda s: F.concat_ws(":", F.date_format(s["bar"], "yyyy-MM-dd"), F.round(s["ret"] * 1000).cast("bigint").cast("string"))), ",").alias("listed"))


@query("entry_and_exit", f"{b.HOURLY}, {CUTS}, m AS (SELECT asset, state, avg(close) AS mid, count(*) AS n FROM s GROUP BY ALL) SELECT asset, first(state ORDER BY n DESC, state) AS fullest, first(state ORDER BY mid, state) AS entry, first(state ORDER BY mid DESC, state) AS exit FROM m GROUP BY asset")
def entry_and_exit(spark, d):
    """The bins to enter and to leave at, and the one with most bars."""
    m = markov.quantile_bins(hourly(spark, d), 5).groupBy("asset", "state").agg(F.avg("close").alias("mid"), F.count("*").alias("n"))
    return m.groupBy("asset").agg(F.max_by("state", F.struct(F.col("n"), -F.col("state"))).alias("fullest"), F.min_by("state", F.struct("mid", "state")).alias("entry"), F.max_by("state", F.struct(F.col("mid"), -F.col("state"))).alias("exit"))


@query("dates_of_both", "SELECT DISTINCT day FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day FROM events UNION ALL SELECT date_trunc('day', o_orderdate)::TIMESTAMP FROM orders)")
def dates_of_both(spark, d):
    """All days that occur in either table."""
    day = lambda t, c: table(spark, d, t).select(F.date_trunc("day", c).cast("timestamp_ntz").alias("day")).distinct()
    return day("events", "ts").unionByName(day("orders", "o_orderdate")).distinct().orderBy("day")


@query("index_resampled", f"{b.DAILY}, a AS (SELECT asset, list(close ORDER BY bar) AS x FROM bars GROUP BY asset), g AS (SELECT asset, i, x, i * (len(x) - 1) / 99.0 AS p FROM a, generate_series(0, 99) t(i)) SELECT asset, i::INTEGER AS i, round(x[floor(p)::INTEGER + 1] * (1 - (p - floor(p))) + coalesce(x[ceil(p)::INTEGER + 1], 0) * (p - floor(p)), 6) AS close FROM g")
def index_resampled(spark, d):
    """Each series on the line between its values at 100 equally spaced places."""
    return spectral.resampled(daily(spark, d), 100).select("asset", "i", r6("close").alias("close"))


@query("correlation_series", f"{b.DAILY}, p AS (SELECT a.asset AS coin, b.asset AS other, a.bar, a.close AS x, b.close AS y FROM bars a JOIN bars b ON a.bar = b.bar AND a.asset <> b.asset) SELECT coin, other, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS value FROM p GROUP BY ALL")
def correlation_series(spark, d):
    """From documents of correlations with all others (a map for each asset) back to rows."""
    x = daily(spark, d)
    a, c = x.select(F.col("asset").alias("coin"), "bar", F.col("close").alias("x")), x.select(F.col("asset").alias("other"), "bar", F.col("close").alias("y"))
    pairs = a.join(c, "bar").filter("coin <> other").groupBy("coin", "other").agg(cross.correlation("x", "y").alias("v"))
    documents = pairs.groupBy("coin").agg(F.map_from_entries(F.collect_list(F.struct("other", "v"))).alias("correlations"))
    return cross.document_series(documents, "correlations").select("coin", F.col("key").alias("other"), r6("value").alias("value"))


@query("swing_rows", f"{b.DAILY}, {RET} SELECT asset, (row_number() {b.W} - 1)::INTEGER AS x, 0 AS y, round(100 * ret, 6) AS change, round(min(100 * ret) OVER (PARTITION BY asset), 6) AS low, round(max(100 * ret) OVER (PARTITION BY asset), 6) AS high FROM r WHERE ret IS NOT NULL")
def swing_rows(spark, d):
    """Changes as rows of a heat map, with the range of their colours."""
    x = returns(daily(spark, d)).filter("ret is not null").select("asset", "bar", (100 * F.col("ret")).alias("change"))
    ends = x.groupBy(F.col("asset").alias("_a")).agg(r6(F.min("change")).alias("low"), r6(F.max("change")).alias("high"))
    return over_chunks(x, 1, lambda w: {"x": F.col("_at").cast("int")}).join(ends, F.col("asset") == F.col("_a")).select("asset", "x", F.lit(0).alias("y"), r6("change").alias("change"), "low", "high")


@query("clipped_band", f"{b.DAILY}, m AS (SELECT asset, bar, avg(close) {b.rows(5)} AS m, stddev_pop(close) {b.rows(5)} AS s FROM bars) SELECT asset, bar, round(greatest(m - 3 * s, 0), 6) AS low, round(least(m + 3 * s, 400), 6) AS high FROM m")
def clipped_band(spark, d):
    """A band that stays between a floor and a ceiling."""
    x = over_chunks(daily(spark, d), 5, lambda w: {"m": F.avg("close").over(w.rowsBetween(-4, 0)), "s": F.stddev_pop("close").over(w.rowsBetween(-4, 0))})
    return x.select("asset", "bar", r6(F.greatest(F.col("m") - 3 * F.col("s"), F.lit(0.0))).alias("low"), r6(F.least(F.col("m") + 3 * F.col("s"), F.lit(400.0))).alias("high"))


BEST_PAIRS = "h AS (SELECT asset, date_trunc('day', bar)::TIMESTAMP AS day, hour(bar)::INTEGER AS hour, close FROM bars), bp AS (SELECT a.asset, a.day, a.hour AS buy, s.hour AS sell, s.close - a.close AS profit FROM h a JOIN h s ON a.asset = s.asset AND a.day = s.day AND s.hour > a.hour AND s.close > a.close), bd AS (SELECT asset, day, first(buy ORDER BY profit DESC, buy, sell) AS buy, first(sell ORDER BY profit DESC, buy, sell) AS sell, max(profit) AS profit FROM bp GROUP BY ALL)"


@query("trading_hours_by_weekday", f"{b.HOURLY}, {BEST_PAIRS} SELECT asset, (isodow(day) - 1)::INTEGER AS weekday, count(*) AS days, round(avg(buy), 6) AS buy_hour, round(avg(sell), 6) AS sell_hour, round(avg(profit), 6) AS profit FROM bd GROUP BY ALL")
def trading_hours_by_weekday(spark, d):
    """The mean hours of the best buy and sale within a day, by weekday."""
    best = cal.best_hours(hourly(spark, d))
    return best.groupBy("asset", F.weekday("day").alias("weekday")).agg(F.count("*").alias("days"), r6(F.avg("buy")).alias("buy_hour"), r6(F.avg("sell")).alias("sell_hour"), r6(F.avg("profit")).alias("profit"))


@query("trading_hours_by_week", f"{b.HOURLY}, {BEST_PAIRS} SELECT asset, ((day(day) - 1) // 7 + 1)::INTEGER AS week, round(avg(buy), 6) AS buy_hour, round(avg(sell), 6) AS sell_hour FROM bd GROUP BY ALL")
def trading_hours_by_week(spark, d):
    """The same by week of the month."""
    return cal.best_hours(hourly(spark, d)).groupBy("asset", cal.week_of_month("day").alias("week")).agg(r6(F.avg("buy")).alias("buy_hour"), r6(F.avg("sell")).alias("sell_hour"))


@query("dca_intervals", f"{b.DAILY}, {RET}, k AS (SELECT asset, avg(ret) / nullif(var_pop(ret), 0) AS f FROM r GROUP BY asset), m AS (SELECT asset, bar, row_number() {b.W} - 1 AS i, CASE WHEN row_number() {b.W} > 5 THEN avg(close) OVER (PARTITION BY asset ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS ma FROM bars), c AS (SELECT asset, count(*) AS n FROM bars GROUP BY asset), g AS (SELECT asset, i // (n // 4) AS part, avg(ma) AS price FROM m JOIN c USING (asset) WHERE i < 4 * (n // 4) GROUP BY ALL) SELECT asset, part::INTEGER AS part, round(greatest(0, least(f, 1.0) * (50000 - 10000)) / 4, 4) AS amount, round(coalesce(price, 0), 6) AS price FROM g JOIN k USING (asset)")
def dca_intervals(spark, d):
    """An investment by Kelly's fraction in four parts, each at its interval's mean of the prior means."""
    x = daily(spark, d)
    f = returns(x).groupBy(F.col("asset").alias("_a")).agg((F.avg("ret") / F.nullif(F.var_pop("ret"), F.lit(0.0))).alias("f"))
    return cross.cost_averaged(x, 5, 4).join(f, F.col("asset") == F.col("_a")).select("asset", "part", F.round(cross.investment(F.col("f"), 50_000.0, 10_000.0) / 4, 4).alias("amount"), r6("price").alias("price"))


_powers = ", ".join(f"sum(pow(t, {k})) AS s{k}" for k in range(5)) + ", " + ", ".join(f"sum(y * pow(t, {k})) AS y{k}" for k in range(3))


def _det(a: str, b_: str, c: str, d_: str, e: str, f: str, g: str, h: str, i: str) -> str:
    return f"({a} * ({e} * {i} - {f} * {h}) - {b_} * ({d_} * {i} - {f} * {g}) + {c} * ({d_} * {h} - {e} * {g}))"


_M = ("s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
_C = [_det(*(f"y{k // 3}" if k % 3 == j else m for k, m in enumerate(_M))) for j in range(3)]


POLY_TREND = f"{b.HOURLY}, p AS (SELECT asset, hour(bar)::DOUBLE AS t, close AS y FROM bars), s AS (SELECT asset, {_powers} FROM p GROUP BY asset), c AS (SELECT asset, {_C[0]} / {_det(*_M)} AS c0, {_C[1]} / {_det(*_M)} AS c1, {_C[2]} / {_det(*_M)} AS c2 FROM s) SELECT asset, round(any_value(c0), 4) AS c0, round(any_value(c1), 4) AS c1, round(any_value(c2), 5) AS c2, round(1.96 * stddev_pop(y - c0 - c1 * t - c2 * t * t), 4) AS band FROM p JOIN c USING (asset) GROUP BY asset"


@query("poly_trend", POLY_TREND)
@query("trend_by_hour", POLY_TREND)
def trend_by_hour(spark, d):
    """A quadratic trend over the hours of the day, with its band."""
    x = models.quadratic_trend(hourly(spark, d).select("asset", F.hour("bar").alias("hour"), "close"), "asset", "hour", "close")
    return x.select("asset", F.round("c0", 4).alias("c0"), F.round("c1", 4).alias("c1"), F.round("c2", 5).alias("c2"), F.round("band", 4).alias("band"))


@query("regime_fit", f"{b.HOURLY}, {CUTS}, p AS (SELECT *, row_number() OVER (PARTITION BY asset, state ORDER BY bar) - 1 AS i FROM s) SELECT asset, state, round(corr(close, i), 5) AS r, round(sqrt((1 - corr(close, i) * corr(close, i)) / (count(*) - 2)) * stddev_pop(close) / stddev_pop(i), 6) AS stderr FROM p GROUP BY ALL")
def regime_fit(spark, d):
    """Correlation and standard error of each regime's line."""
    x = models.regime_stats(markov.quantile_bins(hourly(spark, d), 5), "state")
    return x.select("asset", "state", F.round("r", 5).alias("r"), r6("stderr").alias("stderr"))


@query("regime_p_values")
def regime_p_values(spark, d):
    """The two-sided p-value of each regime's slope."""
    return models.with_p_value(models.regime_stats(markov.quantile_bins(hourly(spark, d), 5), "state")).select("asset", "state", "n", "slope", "stderr", "p_value")


@query("regime_cubics")
def regime_cubics(spark, d):
    """A cubic through each regime's prices."""
    x = markov.quantile_bins(hourly(spark, d), 5).withColumn("regime", F.concat_ws(":", "asset", F.col("state").cast("string")))
    x = over_chunks(x, 1, lambda w: {"i": F.col("_at")}, by="regime")
    return models.polynomial_trend(x, "regime", "i", "close", 3)


@query("kmeans_bins")
def kmeans_bins(spark, d):
    """Prices in six bins, whose edges are the least and largest price and five cluster centres."""
    return markov.kmeans_bins(hourly(spark, d), 5).groupBy("state").agg(F.count("*").alias("n"), F.min("close").alias("low"), F.max("close").alias("high"))


@query("day_of_month_clusters")
def day_of_month_clusters(spark, d):
    """Days of the month in four clusters."""
    x = order_days(spark, d).select("asset", "bar", F.day("bar").cast("double").alias("day"))
    return models.kmeans_states(x, 4, "day")[0].groupBy("state").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.count("*").alias("n"))


@query("cycle_schedule", f"{b.DAILY}, t AS (SELECT asset, row_number() {b.W} - 1 AS i, close, count(*) OVER (PARTITION BY asset) AS n FROM bars), f AS (SELECT asset, k, any_value(n) AS n, sum(close * cos(-2 * pi() * ((k * i) % n) / n)) AS re, sum(close * sin(-2 * pi() * ((k * i) % n) / n)) AS im FROM t, LATERAL (SELECT unnest(generate_series(1, n // 2 - 1)) AS k) GROUP BY ALL), m AS (SELECT asset, k, n, n / k AS period, sqrt(re * re + im * im) AS magnitude FROM f), h AS (SELECT *, avg(magnitude) OVER (PARTITION BY asset) AS level FROM m), e AS (SELECT asset, k, period, unnest(generate_series(1, k)) AS turn FROM h WHERE magnitude > level) SELECT asset, k::INTEGER AS k, turn::INTEGER AS turn, round(turn * period, 6) AS at FROM e")
def cycle_schedule(spark, d):
    """When the cycles that are stronger than the mean begin again."""
    return spectral.schedule(spectral.spectrum(daily(spark, d))).select("asset", "k", "turn", r6("at").alias("at"))


@query("cycle_dates", f"{b.DAILY}, t AS (SELECT asset, row_number() {b.W} - 1 AS i, close, count(*) OVER (PARTITION BY asset) AS n FROM bars), f AS (SELECT asset, k, any_value(n) AS n, sum(close * cos(-2 * pi() * ((k * i) % n) / n)) AS re, sum(close * sin(-2 * pi() * ((k * i) % n) / n)) AS im FROM t, LATERAL (SELECT unnest(generate_series(1, n // 2 - 1)) AS k) GROUP BY ALL), c AS (SELECT asset, k, n, n / k AS period, atan2(im, re) / (2 * pi()) * n / k AS p0, row_number() OVER (PARTITION BY asset ORDER BY round(sqrt(re * re + im * im), 6) DESC, k) AS rank FROM f), z AS (SELECT *, p0 - floor(p0 / period) * period AS first FROM c WHERE rank <= 5) SELECT asset, rank::INTEGER AS rank, k::INTEGER AS k, turn, round(first + turn * period, 4) AS at FROM (SELECT *, unnest(generate_series(0, floor((n - 1 - first) / period)::BIGINT)) AS turn FROM z)")
def cycle_dates(spark, d):
    """When the five strongest cycles of each asset begin, by their phases."""
    return spectral.cycle_dates(spectral.spectrum(daily(spark, d))).select("asset", "rank", "k", "turn", F.round("at", 4).alias("at"))


ABSORBING_STEPS = f"WITH RECURSIVE {b.TICKS}, {b._bars('hour')}, {CUTS}, {MOVES}, it AS (SELECT DISTINCT asset, from_state AS state, 0 AS k, 1.0::DOUBLE AS steps FROM mp UNION ALL SELECT asset, state, k, steps FROM (SELECT mp.asset, mp.from_state AS state, it.k + 1 AS k, CASE WHEN mp.from_state = 4 THEN 1.0 ELSE 1.0 + sum(CASE WHEN mp.to_state = 4 THEN 0.0 ELSE mp.p * it.steps END) END AS steps FROM mp JOIN it ON it.asset = mp.asset AND it.state = mp.to_state WHERE it.k < 600 GROUP BY mp.asset, mp.from_state, it.k)) SELECT asset, state::INTEGER AS state, round(steps, 4) AS steps FROM it WHERE k = 600"


@query("absorbing_steps", ABSORBING_STEPS)
@query("absorbing_means", ABSORBING_STEPS)
def absorbing_means(spark, d):
    """Expected moves until the highest bin, which itself counts one."""
    return markov.absorbing_steps(moves(spark, d), 4).select("asset", "state", F.round("steps", 4).alias("steps"))


_HAAR = "n0 AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY bar) - 1 AS i, close AS a FROM bars), " + ", ".join(f"n{k} AS (SELECT asset, i // 2 AS i, (first(a ORDER BY i) + last(a ORDER BY i)) / sqrt(2) AS a, (first(a ORDER BY i) - last(a ORDER BY i)) / sqrt(2) AS d FROM n{k - 1} GROUP BY asset, i // 2)" for k in range(1, 5))


WAVELET_ENTROPY = f"{b.HOURLY}, {_HAAR}, c AS (" + " UNION ALL ".join(f"SELECT asset, {k} AS level, d AS coef FROM n{k}" for k in range(1, 5)) + " UNION ALL SELECT asset, 0, a FROM n4), e AS (SELECT asset, level, min(coef) AS lo, (max(coef) - min(coef)) / 50 AS w, count(*) AS n FROM c GROUP BY ALL), h AS (SELECT asset, level, least(floor((coef - lo) / w), 49) AS bin, count(*) / any_value(n) AS p FROM c JOIN e USING (asset, level) GROUP BY ALL) SELECT asset, level, round(-sum(p * log2(p)), 5) AS entropy FROM h GROUP BY ALL"


@query("wavelet_entropy", WAVELET_ENTROPY)
@query("entropy_by_level", WAVELET_ENTROPY)
def entropy_by_level(spark, d):
    """Entropy of the wavelet coefficients of each level, in long form."""
    return spectral.entropy(spectral.haar(hourly(spark, d)), ["asset", "level"], "coef").withColumn("entropy", F.round("entropy", 5))


_DP = """st AS (SELECT asset, 0::BIGINT AS k, list_transform(range(11), lambda j: 0.0::DOUBLE) AS free, list_transform(range(11), lambda j: -1e18::DOUBLE) AS held FROM bars GROUP BY asset
 UNION ALL SELECT asset, k, list_transform(range(11), lambda j: CASE WHEN j = 0 THEN free[1] ELSE greatest(free[j + 1], h2[j + 1] + x) END), h2 FROM (SELECT st.asset, o.k, free, o.close AS x, list_transform(range(11), lambda j: CASE WHEN j = 0 THEN held[1] ELSE greatest(held[j + 1], free[j] - o.close) END) AS h2 FROM st JOIN o ON o.asset = st.asset AND o.k = st.k + 1))"""


@query("multi_trades", f"{b.DAILY_RECURSIVE}, o AS (SELECT asset, close, row_number() {b.W} AS k FROM bars), {_DP} SELECT asset, (list_position(f, list_max(f)) - 1)::INTEGER AS trades, round(list_max(f), 4) AS profit FROM (SELECT asset, last(free ORDER BY k) AS f FROM st GROUP BY asset)")
def multi_trades(spark, d):
    """The best at most ten trades, one after the other."""
    return trades.multi_trades(daily(spark, d)).withColumn("profit", F.round("profit", 4))


@query("best_selected_days", f"{b.DAILY}, o AS (SELECT asset, open, close, row_number() {b.W} AS k FROM bars) SELECT a.asset, round(greatest(0, max(s.close - a.open)), 4) AS profit FROM o a JOIN o s ON a.asset = s.asset AND s.k > a.k GROUP BY a.asset")
def best_selected_days(spark, d):
    """The best buying and selling day, as the choice of days with one of each."""
    return trades.selected_pairs(daily(spark, d), 1).select("asset", F.round("profit", 4).alias("profit"))


@query("selected_days")
def selected_days(spark, d):
    """At most ten days of each kind, where every pair of them counts."""
    return trades.selected_pairs(daily(spark, d), 10)


@query("expected_by_return", f"{b.DAILY}, {RET} SELECT asset, round(max(ret), 6) AS best, round(min(ret), 6) AS worst, bool_and(ret > -1) AS never_lost_all FROM r WHERE ret IS NOT NULL GROUP BY asset")
def expected_by_return(spark, d):
    """The largest and least return of a list, and whether all of it is above a total loss."""
    x = over_chunks(daily(spark, d), 1, lambda w: {"ret": simple_return(w)}).filter("ret is not null").groupBy("asset").agg(F.collect_list("ret").alias("l"))
    return x.select("asset", r6(F.array_max("l")).alias("best"), r6(F.array_min("l")).alias("worst"), F.forall("l", lambda v: v > -1).alias("never_lost_all"))


@query("rising_share", f"{b.HOURLY} SELECT asset, round(avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END), 6) AS rising, round(avg((high - low) / nullif(open, 0)), 6) AS span FROM bars GROUP BY asset")
def rising_share(spark, d):
    """How many bars rise, and how wide they are."""
    return hourly(spark, d).groupBy("asset").agg(r6(F.avg((F.col("close") > F.col("open")).cast("double"))).alias("rising"), r6(F.avg(ratio(F.col("high") - F.col("low"), F.col("open")))).alias("span"))


@query("holder_ranks", "WITH t AS (SELECT user_id AS holder, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT holder, total, row_number() OVER (ORDER BY total DESC, holder) AS rank FROM t ORDER BY rank LIMIT 40")
def holder_ranks(spark, d):
    """The 40 largest holders."""
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("holder")).agg(F.round(F.sum("value"), 4).alias("total"))
    top = t.orderBy(F.desc("total"), "holder").limit(40)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "holder")).cast("long"))  # 40 rows
