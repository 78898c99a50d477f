"""Queries of Markov chains, spectra, simulations, models and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import over_chunks, simple_return
from tidewater.operators import cross, markov, models, posterior, search, spectral, volatility
from tidewater.plans import base as b
from tidewater.plans.base import query
from tidewater.sources.series import daily, hourly, ticks
from tidewater.streaming import operators as st
from tidewater.streaming.delivery import delivered, periodic

r6 = lambda x: F.round(x, 6)
CUTS = "q AS (SELECT asset, quantile_cont(close, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM bars GROUP BY asset), s AS (SELECT asset, bar, close, len(list_filter(cuts, lambda c: c < close))::INTEGER AS state FROM bars JOIN q USING (asset))"
MOVES = f"m AS (SELECT asset, from_state, state AS to_state, count(*) AS n FROM (SELECT *, lag(state) {b.W} AS from_state FROM s) WHERE from_state IS NOT NULL GROUP BY ALL), mp AS (SELECT *, n / sum(n) OVER (PARTITION BY asset, from_state) AS p FROM m)"


def moves(spark, d):
    return markov.transitions(markov.quantile_bins(hourly(spark, d), 5), "state")


@query("markov_binned", f"{b.HOURLY}, {CUTS}, {MOVES} SELECT asset, from_state, to_state, n, round(p, 6) AS p FROM mp")
def markov_binned(spark, d):
    return moves(spark, d).withColumn("p", r6("p"))


@query("markov_exact", f"{b.HOURLY}, s AS (SELECT asset, bar, round(close / 50)::INTEGER AS state FROM bars), {MOVES} SELECT asset, from_state, to_state, n, round(p, 6) AS p FROM mp")
def markov_exact(spark, d):
    return markov.transitions(hourly(spark, d).withColumn("state", F.round(F.col("close") / 50).cast("int")), "state").withColumn("p", r6("p"))


@query("markov_whole", f"{b.HOURLY}, s AS (SELECT asset, bar, round(close / 10)::INTEGER AS state FROM bars), {MOVES}, k AS (SELECT DISTINCT asset, unnest([from_state, to_state]) AS s FROM mp), z AS (SELECT asset, count(*) AS n FROM k GROUP BY asset) SELECT f.asset, f.s AS from_state, t.s AS to_state, round(CASE WHEN EXISTS (SELECT 1 FROM mp q WHERE q.asset = f.asset AND q.from_state = f.s) THEN coalesce(p, 0) ELSE 1.0 / z.n END, 6) AS p FROM k f JOIN k t ON f.asset = t.asset JOIN z ON z.asset = f.asset LEFT JOIN mp ON mp.asset = f.asset AND mp.from_state = f.s AND mp.to_state = t.s")
def markov_whole(spark, d):
    """Every pair of states, with the uniform row of a state that was never left."""
    return markov.whole_table(markov.transitions(hourly(spark, d).withColumn("state", F.round(F.col("close") / 10).cast("int")), "state")).withColumn("p", r6("p"))


@query("equal_bins", f"{b.HOURLY}, e AS (SELECT asset, min(close) AS lo, max(close) AS hi FROM bars GROUP BY asset) SELECT asset, least(floor((close - lo) / ((hi - lo) / 5)), 4)::INTEGER AS state, count(*) AS n FROM bars JOIN e USING (asset) GROUP BY ALL")
def equal_bins(spark, d):
    return markov.equal_bins(hourly(spark, d), 5).groupBy("asset", "state").agg(F.count("*").alias("n"))


@query("up_down_prob", f"{b.HOURLY}, {CUTS}, {MOVES} SELECT asset, from_state, round(sum(CASE WHEN to_state > from_state THEN p ELSE 0 END), 6) AS up, round(sum(CASE WHEN to_state < from_state THEN p ELSE 0 END), 6) AS down FROM mp GROUP BY ALL")
def up_down_prob(spark, d):
    return moves(spark, d).groupBy("asset", "from_state").agg(r6(F.sum(F.when(F.col("to_state") > F.col("from_state"), F.col("p")).otherwise(0.0))).alias("up"), r6(F.sum(F.when(F.col("to_state") < F.col("from_state"), F.col("p")).otherwise(0.0))).alias("down"))


@query("expected_state", f"{b.HOURLY}, {CUTS}, {MOVES}, c AS (SELECT asset, state AS to_state, avg(close) AS mid FROM s GROUP BY ALL) SELECT asset, from_state, round(sum(p * mid), 6) AS expected FROM mp JOIN c USING (asset, to_state) GROUP BY ALL")
def expected_state(spark, d):
    """The mean price of the bin that follows each bin."""
    x = markov.quantile_bins(hourly(spark, d), 5)
    mid = x.groupBy("asset", F.col("state").alias("to_state")).agg(F.avg("close").alias("mid"))
    return markov.transitions(x, "state").join(mid, ["asset", "to_state"]).groupBy("asset", "from_state").agg(r6(F.sum(F.col("p") * F.col("mid"))).alias("expected"))


@query("steady_state", f"WITH RECURSIVE {b.TICKS}, {b._bars('hour')}, {CUTS}, {MOVES}, it AS (SELECT asset, from_state AS state, 0 AS k, 1.0 / count(*) OVER (PARTITION BY asset) AS share FROM (SELECT DISTINCT asset, from_state FROM mp) UNION ALL SELECT asset, state, k, share FROM (SELECT mp.asset, mp.to_state AS state, it.k + 1 AS k, sum(it.share * mp.p) AS share FROM it JOIN mp ON mp.asset = it.asset AND mp.from_state = it.state WHERE it.k < 80 GROUP BY mp.asset, mp.to_state, it.k)) SELECT asset, state, round(share, 5) AS share FROM it WHERE k = 80")
def steady_state(spark, d):
    return markov.steady_state(moves(spark, d)).select("asset", "state", F.round("share", 5).alias("share"))


@query("haar_dwt", f"{b.DAILY}, n0 AS (SELECT asset, row_number() {b.W} - 1 AS i, close AS a FROM bars), " + ", ".join(f"n{k} AS (SELECT asset, i // 2 AS i, (first(a ORDER BY i) + last(a ORDER BY i)) / sqrt(2) AS a, (first(a ORDER BY i) - last(a ORDER BY i)) / sqrt(2) AS d FROM n{k - 1} GROUP BY asset, i // 2)" for k in range(1, 5)) + " SELECT asset, level::INTEGER AS level, i, round(coef, 6) AS coef FROM (" + " UNION ALL ".join(f"SELECT asset, {k} AS level, i, d AS coef FROM n{k}" for k in range(1, 5)) + " UNION ALL SELECT asset, 0, i, a FROM n4)")
def haar_dwt(spark, d):
    return spectral.haar(daily(spark, d)).withColumn("coef", r6("coef"))


@query("price_entropy", f"{b.HOURLY}, e AS (SELECT asset, min(close) AS lo, (max(close) - min(close)) / 50 AS w, count(*) AS n FROM bars GROUP BY asset), h AS (SELECT asset, least(floor((close - lo) / w), 49) AS bin, count(*) / any_value(n) AS p FROM bars JOIN e USING (asset) GROUP BY ALL) SELECT asset, round(-sum(p * log2(p)), 6) AS entropy FROM h GROUP BY asset")
def price_entropy(spark, d):
    return spectral.entropy(hourly(spark, d), ["asset"], "close").withColumn("entropy", r6("entropy"))


DFT = f"t AS (SELECT asset, row_number() {b.W} - 1 AS i, close, count(*) OVER (PARTITION BY asset) AS n FROM bars), f AS (SELECT asset, k, any_value(n) AS n, sum(close * cos(-2 * pi() * ((k * i) % n) / n)) AS re, sum(close * sin(-2 * pi() * ((k * i) % n) / n)) AS im FROM t, LATERAL (SELECT unnest(generate_series(0, n // 2 - 1)) AS k) GROUP BY asset, k), sp AS (SELECT asset, k, k / n AS frequency, sqrt(re * re + im * im) AS magnitude FROM f)"


@query("dft_spectrum", f"{b.DAILY}, {DFT} SELECT asset, k::INTEGER AS k, round(frequency, 6) AS frequency, round(magnitude, 5) AS magnitude FROM sp")
def dft_spectrum(spark, d):
    return spectral.spectrum(daily(spark, d)).select("asset", "k", r6("frequency").alias("frequency"), F.round("magnitude", 5).alias("magnitude"))


@query("top_cycles", f"{b.DAILY}, {DFT} SELECT asset, rank::INTEGER AS rank, k::INTEGER AS k, round(1 / frequency, 6) AS period, round(magnitude, 5) AS magnitude FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(magnitude, 6) DESC, k) AS rank FROM sp WHERE k > 0) WHERE rank <= 5")
def top_cycles(spark, d):
    return spectral.top_cycles(spectral.spectrum(daily(spark, d))).select("asset", "rank", "k", r6("period").alias("period"), F.round("magnitude", 5).alias("magnitude"))


@query("regime_stats", f"{b.HOURLY}, {CUTS}, p AS (SELECT *, row_number() OVER (PARTITION BY asset, state ORDER BY bar) - 1 AS i FROM s) SELECT asset, state, count(*) AS n, round(avg(close), 6) AS mean, round(stddev_pop(close), 6) AS std, round(regr_slope(close, i), 6) AS slope, round(regr_intercept(close, i), 5) AS intercept FROM p GROUP BY ALL")
def regime_stats(spark, d):
    x = models.regime_stats(markov.quantile_bins(hourly(spark, d), 5), "state")
    return x.select("asset", "state", "n", *(r6(c).alias(c) for c in ("mean", "std", "slope")), F.round("intercept", 5).alias("intercept"))


@query("kmeans_regimes")
def kmeans_regimes(spark, d):
    return models.kmeans_states(hourly(spark, d), 3)[0].groupBy("state").agg(F.count("*").alias("n"), F.min("close").alias("low"), F.max("close").alias("high"))


@query("rf_forecast")
def rf_forecast(spark, d):
    return models.forest_forecast(hourly(spark, d))


@query("mcmc_paths")
def mcmc_paths(spark, d):
    """The ten paths that occur most of each asset."""
    x = markov.asset_paths(moves(spark, d), 5, 2, 7, 100, 1000, {3: 1.5})
    return x.withColumn("k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("n"), "path"))).filter("k <= 10").drop("k")


@query("jump_diffusion")
def jump_diffusion(spark, d):
    """27 combinations of jumps in each of three markets, 5000 paths of 200 days each; those that pass the highest price that
    there was are dropped."""
    x = over_chunks(daily(spark, d), 1, lambda w: {"ret": F.log1p(simple_return(w))})
    p = x.groupBy("asset").agg(F.max_by("close", "bar").alias("s0"), F.avg("ret").alias("mu"), F.stddev_pop("ret").alias("sigma")).join(markov.price_limit(daily(spark, d)), "asset")
    return markov.jump_paths(markov.market_grid(p), 5000, 200, 1.0).select("asset", "market", "config", "jump_rate", "jump_mean", "jump_std", "limit", "kept", "mean_final", "p5", "p95")


@query("stl_decompose")
def stl_decompose(spark, d):
    return models.decompose(daily(spark, d))


@query("garch")
def garch(spark, d):
    """The next five hours of each asset: means, bands and price paths."""
    return volatility.volatility_forecast(hourly(spark, d))


@query("garch_paths")
def garch_paths(spark, d):
    """Quantiles of simulated prices of the next five hours."""
    return volatility.simulated_prices(hourly(spark, d))


@query("prophet_like")
def prophet_like(spark, d):
    grid = spark.createDataFrame([(k, c, t, s, m) for k, (c, t, s, m) in enumerate((c, t, s, m) for c in (3, 8) for t in (0.1, 10.0) for s in (0.1, 10.0) for m in (False, True))], "config int, changepoints int, trend_ridge double, season_ridge double, multiplicative boolean")
    return models.additive_forecast(daily(spark, d), grid, 7)


@query("posterior_bands")
def posterior_bands(spark, d):
    """The next week of each asset from posterior samples, with the agreement of the chains."""
    return posterior.posterior_forecast(daily(spark, d))


# ---- streams, run over what is there and compared with the batch result


@query("stream_tumbling", "SELECT event_type AS asset, date_trunc('hour', ts)::TIMESTAMP AS bar, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high, min(value) AS low FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return delivered(st.tumbling(st.tick_stream(spark, d)), "complete").withColumn("mean", r6("mean"))


@query("stream_sliding", "SELECT event_type AS asset, (date_trunc('hour', ts) - to_hours(k.k))::TIMESTAMP AS bar, count(*) AS n, max(value) AS high FROM events, (VALUES (0), (1)) k(k) GROUP BY ALL")
def stream_sliding(spark, d):
    return delivered(st.tumbling(st.tick_stream(spark, d), "2 hours", "1 hour"), "complete").select("asset", "bar", "n", "high")


@query("stream_session", "WITH l AS (SELECT event_type AS asset, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT asset, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS until, count(*) AS n FROM g GROUP BY asset, s")
def stream_session(spark, d):
    return delivered(st.sessions(st.tick_stream(spark, d)), "complete")


@query("stream_dedupe", "SELECT event_type AS asset, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def stream_dedupe(spark, d):
    s = st.tick_stream(spark, d)
    twice = s.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    return delivered(st.deduplicated(twice)).groupBy("asset").agg(F.count("*").alias("n"))


@query("stream_stale_filter", "SELECT event_type AS asset, count(*) AS n FROM events WHERE (event_id % 300) <= 120 GROUP BY ALL")
def stream_stale_filter(spark, d):
    """Signals that arrive up to five minutes late; those of over two minutes are dropped."""
    s = st.tick_stream(spark, d).withColumn("now", (F.col("ts") + F.make_interval(secs=(F.col("event_id") % 300).cast("decimal(18,6)"))).cast("timestamp"))
    return delivered(st.fresh(s)).groupBy("asset").agg(F.count("*").alias("n"))


@query("stream_ema", "WITH RECURSIVE n AS (SELECT event_type AS asset, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events), y AS (SELECT asset, k, x AS v FROM n WHERE k = 1 UNION ALL SELECT n.asset, n.k, 0.9 * y.v + 0.1 * n.x FROM y JOIN n ON n.asset = y.asset AND n.k = y.k + 1) SELECT asset, max(k) AS n, round(last(v ORDER BY k), 4) AS ema FROM y GROUP BY asset")
def stream_ema(spark, d):
    x = delivered(st.running_ema(st.tick_stream(spark, d), 0.1), "update")
    return x.groupBy("asset").agg(F.max("n").alias("n"), F.round(F.max_by("ema", "n"), 4).alias("ema"))


@query("stream_session_profit", "WITH n AS (SELECT event_type AS asset, row_number() OVER w AS k, sum(value - 100) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), f AS (SELECT asset, min(k) AS k FROM n WHERE total >= 1000 GROUP BY asset), e AS (SELECT n.asset, coalesce(f.k, max(n.k) OVER (PARTITION BY n.asset)) AS last, n.k, total FROM n LEFT JOIN f ON f.asset = n.asset) SELECT asset, round(total, 4) AS profit, total >= 1000 AS done FROM e WHERE k = last")
def stream_session_profit(spark, d):
    return delivered(st.session_profit(st.tick_stream(spark, d).withColumn("amount", F.col("price") - 100)), "update").withColumn("profit", F.round("profit", 4))


@query("stream_orders", "WITH o AS (SELECT event_type AS asset, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, event_id, ts FROM events) SELECT asset, side, count(*) AS placed, count(*) - 1 AS cancelled, last(event_id ORDER BY ts, event_id) AS open, least(count(*), 100)::INTEGER AS known FROM o GROUP BY ALL")
def stream_orders(spark, d):
    s = st.tick_stream(spark, d).withColumn("side", F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell"))
    return delivered(st.replaced_orders(s), "update").groupBy("asset", "side").agg(*(F.max_by(c, "placed").alias(c) for c in ("cancelled", "open", "known")), F.max("placed").alias("placed"))


@query("stream_indicators", "WITH n AS (SELECT event_type AS asset, value AS p, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS d FROM events) SELECT asset, max(c) AS n, round(avg(p), 6) AS sma, round(CASE WHEN sum(greatest(-d, 0)) = 0 THEN 100 ELSE 100 - 100 / (1 + sum(greatest(d, 0)) / sum(greatest(-d, 0))) END, 6) AS rsi, max(p) AS high, min(p) AS low FROM n JOIN (SELECT event_type AS asset, count(*) AS c FROM events GROUP BY ALL) USING (asset) WHERE k <= 14 GROUP BY asset")
def stream_indicators(spark, d):
    x = delivered(st.running_indicators(st.tick_stream(spark, d)), "update")
    return x.groupBy("asset").agg(F.max("n").alias("n"), r6(F.max_by("sma", "n")).alias("sma"), r6(F.max_by("rsi", "n")).alias("rsi"), F.max_by("high", "n").alias("high"), F.max_by("low", "n").alias("low"))


@query("stream_periodic", "SELECT event_type AS asset, count(*) AS n, max(value) AS high FROM events GROUP BY ALL")
def stream_periodic(spark, d):
    """A batch each second until all is taken; then the stream is stopped."""
    return periodic(st.tick_stream(spark, d).groupBy("asset").agg(F.count("*").alias("n"), F.max("price").alias("high")))


@query("appended_batch", "SELECT event_type AS asset, count(*) AS n FROM events GROUP BY ALL")
def appended_batch(spark, d):
    """A later batch behind an earlier one."""
    x = ticks(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return st.appended(x.filter(F.col("ts") < cut), x.filter(F.col("ts") >= cut)).groupBy("asset").agg(F.count("*").alias("n"))


@query("forecast_scores")
def forecast_scores(spark, d):
    """120 configurations of the additive forecast of each asset, by their errors over the last week."""
    of = [(c, t, s, m) for c in (3, 8, 12) for t in (0.01, 0.1, 1.0, 10.0) for s in (0.01, 0.1, 1.0, 10.0, 100.0) for m in (False, True)]
    grid = spark.createDataFrame([(k, *g) for k, g in enumerate(of)], "config int, changepoints int, trend_ridge double, season_ridge double, multiplicative boolean")
    return models.forecast_scores(daily(spark, d), grid, 7)


@query("forecast_series")
def forecast_series(spark, d):
    """The best configuration's forecasts as series of each asset's document."""
    grid = spark.createDataFrame([(0, 3, 0.1, 0.1, False), (1, 3, 10.0, 10.0, True)], "config int, changepoints int, trend_ridge double, season_ridge double, multiplicative boolean")
    f = models.additive_forecast(daily(spark, d), grid, 7)
    series = f.groupBy("asset", "config").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "forecast"))), lambda v: v["forecast"]).alias("s"))
    documents = series.groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct("config", "s"))).alias("configs"))
    return cross.document_series(documents, "configs").select("asset", F.col("key").alias("config"), F.posexplode("value").alias("step", "forecast"))


@query("forest_search")
def forest_search(spark, d):
    """Settings of the forest by their errors over rolling origins."""
    return models.forest_search(hourly(spark, d), (5,), (3, 5), 2)


@query("forest_surrogate_search")
def forest_surrogate_search(spark, d):
    """Settings of the forest by a surrogate: 12 trials over three rolling origins."""
    space = {"trees": search.Whole(5, 20), "features": ("sqrt", "log2"), "depth": (3, 5, 8), "least": search.Whole(1, 4), "bootstrap": (True, False)}
    return search.forest_surrogate_search(hourly(spark, d), 12, 3, 6, 3, space)


@query("forest_recursive")
def forest_recursive(spark, d):
    """A day of bars ahead, each from the forecasts before it."""
    return models.recursive_forecast(hourly(spark, d), 24, 10, 5)
