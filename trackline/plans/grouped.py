"""Registered queries that run grouped matrix work or streams on the star schema.

The kernels of those without SQL are tested by themselves; the README names the queries that have neither.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.functions import kernels, moments
from trackline.operators import calendars, covariance, decay, drift, evaluate, matrix, reports, simulate, universe
from trackline.plans.registry import query
from trackline.plans.relational import ANN, Panel, _out, _sql
from trackline.sources.shared import stored
from trackline.sources.tables import table
from trackline.streaming import online

#: The default models of a study.
MODELS = ["rolling", "lw", "anls", "qis"]


def _covariances(p: Panel, methods: list[str], length: int = 36):
    return matrix.covariances(p.window(length), methods)


@query()
def cov_anls(spark, sf_dir):
    return _out(_covariances(Panel(spark, sf_dir), ["anls"]), 8)


@query()
def cov_qis(spark, sf_dir):
    return _out(_covariances(Panel(spark, sf_dir), ["qis"]), 8)


@query()
def cov_dcc(spark, sf_dir):
    return _out(_covariances(Panel(spark, sf_dir), ["dcc"]), 8)


@query()
def ewma_lambda_qmv(spark, sf_dir):
    p = Panel(spark, sf_dir)
    scores = stored(decay.scores(p.rets, p.cal, 24, least=10), "decay-scores")
    best = scores.agg(F.max_by("decay", F.struct("score", -F.col("decay"))).alias("_best"))
    return _out(scores.crossJoin(F.broadcast(best)).select(F.round("decay", 3).alias("decay"), "score", "n", (F.col("decay") == F.col("_best")).alias("best")), 4)


@query()
def cov_dcc_refit(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(matrix.dcc_refits(p.rets, calendars.calendar(p.bars), 12, 36), 8)


@query()
def cov_dcc_refit_garch(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(matrix.dcc_refits(p.rets, calendars.calendar(p.bars), 12, 36, "garch"), 8)


@query()
def garch_fit(spark, sf_dir):
    fits = matrix.volatility_fits(Panel(spark, sf_dir).rets, list(kernels.VOLATILITY))
    return _out(fits.select("asset", "model", "llf", "aic", "bic", "converged", "sigma"), 4)


@query()
def garch_select(spark, sf_dir):
    return _out(matrix.select_model(matrix.volatility_fits(Panel(spark, sf_dir).rets, list(kernels.VOLATILITY))), 4)


@query()
def garch_order(spark, sf_dir):
    fits = matrix.volatility_fits(Panel(spark, sf_dir).rets, ["garch", "gjr"], (1, 2, 3), (1, 2, 3))
    return _out(matrix.select_model(fits, "aic", ("asset", "model")), 4)


@query()
def garch_sigma_path(spark, sf_dir):
    fits = matrix.volatility_fits(Panel(spark, sf_dir).rets, ["garch"])
    return _out(fits.select("asset", F.posexplode("path").alias("t", "sigma")), 8)


def _targets(p: Panel, methods: list[str]):
    caps = p.bars.groupBy("asset").agg(F.sum("revenue").alias("cap"))
    small = universe.exclusions(caps.select("asset"), caps, 0.2)
    return matrix.tracking_minimal(_covariances(p, methods), p.quarter_starts, small)


@query()
def te_min_qp(spark, sf_dir):
    return _out(_targets(Panel(spark, sf_dir), MODELS))


def _backtest(p: Panel, methods: list[str]):
    """model, date, port_ret, bench_ret: drifting portfolios of least tracking error and the drifting benchmark."""
    targets = _targets(p, methods).select("model", "rebal_date", "asset", "weight")
    port = drift.path_return(drift.drift(p.rets, targets, ["model"]), "port_ret", ["model"])
    return port.join(drift.path_return(drift.drift(p.rets, p.quarter_starts), "bench_ret"), "date")


@query()
def backtest_te_min(spark, sf_dir):
    return _out(evaluate.expost_metrics(_backtest(Panel(spark, sf_dir), MODELS), ANN, ["model"]))


@query()
def backtest_yearly(spark, sf_dir):
    return _out(evaluate.yearly(_backtest(Panel(spark, sf_dir), MODELS), ANN, ["model"]))


@query()
def backtest_calibration(spark, sf_dir):
    p = Panel(spark, sf_dir)
    ante = _targets(p, MODELS).groupBy("model", "rebal_date").agg(F.max(F.col("te_ante") * F.col("te_ante")).alias("var_ante"))
    series = _backtest(p, MODELS).withColumn("active", evaluate.active())
    post = reports.realised_variance(series, ante.select("model", "rebal_date"), "active", ["model"])
    return _out(reports.calibration(ante, post, ANN, ["model"]), 4)


@query()
def te_threshold_rebalances(spark, sf_dir):
    return _out(matrix.threshold_rebalances(_backtest(Panel(spark, sf_dir), ["rolling", "lw"]), ["model"], 0.01, 12, ANN, cooldown=3))


@query()
def positions_backtest(spark, sf_dir):
    p = Panel(spark, sf_dir)
    targets = _targets(p, ["rolling", "lw"]).select("model", F.col("rebal_date").alias("date"), "asset", "weight")
    return _out(matrix.positions_backtest(targets, p.bars.select("date", "asset", "price"), ["model"], 1e6, bps=5), 2)


@query()
def mc_economic(spark, sf_dir):
    """Exclusion draws share one covariance a model and date: a scenario is only a list of what may not be held."""
    p = Panel(spark, sf_dir)
    scenarios = simulate.grid(spark, share=[0.1, 0.3], seed=[0, 1, 2, 3]).withColumn("scenario", F.concat_ws("/", "share", "seed"))
    left = stored(simulate.exclusion_draws(p.bars, scenarios), "exclusions")
    solved = matrix.tracking_minimal_scenarios(_covariances(p, ["lw"]), p.quarter_starts, left, scenarios)
    targets = solved.select("scenario", "rebal_date", "asset", "weight")
    port = drift.path_return(drift.drift(p.rets, targets, ["scenario"]), "port_ret", ["scenario"])
    series = port.join(drift.path_return(drift.drift(p.rets, p.quarter_starts), "bench_ret"), "date")
    return _out(evaluate.scenario_summary(series, ANN, ["scenario"]))


@query(_sql("SELECT asset AS model, idx AS seq, round(r2, 8) AS trace FROM (SELECT asset, idx, 0.06 * sum(power(ret, 2) * power(0.94, -idx)) OVER (PARTITION BY asset ORDER BY idx) * power(0.94, idx) AS r2 FROM (SELECT asset, idx, coalesce(ret, 0) AS ret FROM rets JOIN cal USING (date)))"))
def ewma_online_stream(spark, sf_dir):
    """Each asset's variance, moved on bar by bar by a stream; the closed form is its SQL."""
    from trackline.sources.shared import folder

    p = Panel(spark, sf_dir)
    rows = p.rets.join(p.cal, "date").select(F.col("asset").alias("model"), F.col("idx").alias("seq"), F.array(F.coalesce("ret", F.lit(0.0))).alias("r"))
    at = folder(spark, "ewma-stream")
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    return _out(online.run_to_table(online.ewma_updates(stream, 1), f"{at}/run").select("model", "seq", "trace"), 8)


@query("""
WITH e AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
SELECT start::VARCHAR AS start, event_type, n, round(total, 4) AS total FROM e WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
""")
def stream_tumbling_bars(spark, sf_dir):
    """Daily bars of the event stream; only windows that the watermark has closed."""
    from trackline.sources.shared import folder

    out = online.run_to_table(online.bars(online.event_stream(spark, sf_dir)), folder(spark, "bars-stream"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(_sql("""m AS (SELECT asset, avg(ret) AS mu, var_pop(ret) AS v FROM rets GROUP BY asset)
SELECT r.asset, count(ret) AS n, round(avg(ret), 6) AS mean, round(var_samp(ret), 6) AS var, round(avg(power(ret - mu, 3)) / power(any_value(v), 1.5), 6) AS skew, round(avg(power(ret - mu, 4)) / power(any_value(v), 2), 6) AS kurt FROM rets r JOIN m USING (asset) GROUP BY r.asset"""))  # fmt: skip
def moments_empirical(spark, sf_dir):
    return _out(moments.empirical(Panel(spark, sf_dir).rets, "ret", ["asset"]))


@query(_sql("SELECT asset, count(ret) AS n, round(avg(ret), 6) AS mean, round(var_pop(ret), 8) AS var, round(sqrt(2 * power(var_pop(ret), 2) / count(ret)), 8) AS var_se FROM rets GROUP BY asset"))
def moments_mle(spark, sf_dir):
    out = moments.empirical(Panel(spark, sf_dir).rets, "ret", ["asset"], ddof=0)
    return out.select("asset", "n", F.round("mean", 6).alias("mean"), F.round("var", 8).alias("var"), F.round(moments.variance_error(F.col("var"), F.col("n")), 8).alias("var_se"))


@query(_sql("""m AS (SELECT asset, avg(ret) AS mean, stddev_samp(ret) / sqrt(count(ret)) AS se FROM rets GROUP BY asset)
SELECT asset, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - 1.959963984540054 * se, 6) AS low, round(mean + 1.959963984540054 * se, 6) AS high, round(mean / se, 4) AS z FROM m"""))  # fmt: skip
def mean_ci_ztest(spark, sf_dir):
    out = moments.mean_error(Panel(spark, sf_dir).rets, "ret", ["asset"])
    return _out(out).withColumn("z", F.round("z", 4))


@query(_sql("""q AS (SELECT quantile_cont(ret, 0.25) AS q1, quantile_cont(ret, 0.75) AS q3, count(ret) AS m, min(ret) AS a, max(ret) AS b FROM rets), h AS (SELECT *, greatest(ceil((b - a) / (2 * (q3 - q1) / cbrt(m))), 1) AS bins FROM q)
SELECT least(floor((ret - a) / ((b - a) / bins)), bins - 1)::BIGINT AS bin, count(*) AS n, round(min(a + least(floor((ret - a) / ((b - a) / bins)), bins - 1) * (b - a) / bins), 6) AS low FROM rets, h WHERE ret IS NOT NULL GROUP BY 1"""))  # fmt: skip
def return_histogram(spark, sf_dir):
    return _out(moments.histogram(Panel(spark, sf_dir).rets, "ret").select("bin", "n", "low"))


@query("""
WITH o AS (SELECT n_name AS asset, o_orderpriority AS freq, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT DISTINCT asset, freq FROM o), d AS (SELECT asset, freq FROM o GROUP BY ALL HAVING sum(v) >= 0.9 * (SELECT avg(s) FROM (SELECT sum(v) AS s FROM o GROUP BY asset, freq)))
SELECT asset || '/' || freq AS scenario FROM g ANTI JOIN d USING (asset, freq)
""")
def scenario_grid_todo(spark, sf_dir):
    """Scenarios of nations and priorities whose run has not succeeded; a run is a group of orders, and one of a
    value well below the mean counts as failed."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    runs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    runs = stored(runs.groupBy(F.col("n_name").alias("asset"), F.col("o_orderpriority").alias("freq")).agg(F.sum("o_totalprice").alias("v")), "runs")
    mean = runs.agg(F.avg("v").alias("m"))
    log = runs.crossJoin(F.broadcast(mean)).select("asset", "freq", F.when(F.col("v") >= 0.9 * F.col("m"), "success").otherwise("error").alias("status"))
    return simulate.to_do(runs.select("asset", "freq"), log, ["asset", "freq"]).select(F.concat_ws("/", "asset", "freq").alias("scenario"))


@query()
def covariance_losses(spark, sf_dir):
    """Frobenius distance of each model's covariance to the rolling one, by date."""
    cov = stored(_covariances(Panel(spark, sf_dir), MODELS), "covariances")
    base = cov.filter("model = 'rolling'").drop("model")
    parts = [covariance.frobenius(cov.filter(F.col("model") == m), base, ["rebal_date"]).withColumn("model", F.lit(m)) for m in MODELS[1:]]
    return _out(parts[0].unionByName(parts[1]).unionByName(parts[2]), 8)
