"""Registered queries of slices, covariance paths, events around rebalances and further measures, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackline.functions import moments
from trackline.operators import calendars, covariance, covpath, drift, evaluate, events, reports, slices, universe
from trackline.plans.registry import query
from trackline.plans.relational import _ANTE, _CAPS, _D, _DRIFT, _SECTOR, _SHRINK, _TARGETS, _TURN, _WIN, ANN, Panel, _out, _paths, _sql
from trackline.sources.shared import folder

NAMES = ["NATION_1", "NATION_6", "NATION_7"]
_NAMES = "('NATION_1', 'NATION_6', 'NATION_7')"


@query(_sql(f"SELECT {_D}, asset, round(ret, 6) + 0 AS ret FROM rets WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-02-01' AND asset IN {_NAMES}"))
def panel_slice(spark, sf_dir):
    return _out(slices.take(Panel(spark, sf_dir).rets, "1996-03-01", "1998-02-01", NAMES))


@query(_sql("SELECT year(date) AS year, count(*) AS n, round(sum(price), 6) AS total FROM bars WHERE year(date) IN (1996, 1997) GROUP BY 1"))
def panel_years_pruned(spark, sf_dir):
    """The bars are stored by year; only the partitions of the range are opened."""
    at = f"{folder(spark, 'bars-by-year')}/bars"
    slices.write_years(Panel(spark, sf_dir).bars, at)
    rows = slices.read_years(spark, at, datetime.date(1996, 2, 1), datetime.date(1997, 11, 1))
    return _out(rows.groupBy("year").agg(F.count("*").alias("n"), F.sum("price").alias("total")))


@query(_sql(f"SELECT {_D}, asset, round(ret, 6) + 0 AS ret FROM rets WHERE date IN (SELECT date FROM rets GROUP BY date HAVING count(ret) = (SELECT count(DISTINCT asset) FROM rets))"))
def joint_complete_rows(spark, sf_dir):
    return _out(slices.complete_dates(Panel(spark, sf_dir).rets))


@query(_sql(f"n AS (SELECT date, year(date) AS year, product(1 + port_ret) OVER (ORDER BY date) AS nav FROM series) SELECT year, {_D}, round(nav / first_value(nav) OVER (PARTITION BY year ORDER BY date), 6) AS nav FROM n"))
def nav_year_rebased(spark, sf_dir):
    return _out(slices.rebased(evaluate.nav(Panel(spark, sf_dir).series, "port_ret"), "nav"))


@query(_sql(f"SELECT {_D}, asset, round(CASE WHEN price > 0 AND prev > 0 THEN ln(price / prev) END, 6) + 0 AS ret FROM (SELECT *, lag(price, 2) OVER (PARTITION BY asset ORDER BY date) AS prev FROM filled)"))
def returns_two_period_log(spark, sf_dir):
    bars = Panel(spark, sf_dir).dense.select("date", "asset", F.lit(0.0).alias("open"), F.col("price").alias("Adj Close"), F.lit(1.0).alias("Close"))
    return _out(slices.returns_of(bars, "log", 2, fill=True))


@query(_sql(f"SELECT {_D}, asset, round(CASE WHEN count(ret) OVER w = 6 THEN stddev_samp(ret) OVER w * sqrt(12) END, 6) AS vol FROM rets WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"))
def rolling_volatility(spark, sf_dir):
    return _out(slices.rolling_volatility(Panel(spark, sf_dir).rets, 6, ANN))


@query(_sql(_TARGETS + """ats AS (SELECT DISTINCT rebal_date, (SELECT max(date) FROM bars WHERE date <= rebal_date - 10) AS d FROM tg),
rk AS (SELECT rebal_date, asset, row_number() OVER (PARTITION BY rebal_date ORDER BY revenue, asset) AS r, count(*) OVER (PARTITION BY rebal_date) AS n FROM ats JOIN bars ON bars.date = d)
SELECT rebal_date::VARCHAR AS rebal_date, asset FROM rk WHERE r <= ceil(n * 0.2)"""))  # fmt: skip
def exclusion_smallcap_asof(spark, sf_dir):
    p = Panel(spark, sf_dir)
    at = p.quarter_starts.select("rebal_date").distinct().withColumn("date", F.date_sub("rebal_date", 10))
    return _out(universe.small_caps_as_of(p.bars.select("date", "asset", F.col("revenue").alias("cap")), at, 0.2))


@query(_sql(f"x AS (SELECT DISTINCT date, asset, price FROM bars WHERE upper(asset) NOT IN ('NATION_1', 'NATION_6')) SELECT asset, count(*) AS n, round(sum(price), 6) AS total FROM x GROUP BY asset"))
def exclusion_file_tickers(spark, sf_dir):
    """Names as a file would hold them; both sides are compared in their normal form."""
    named = spark.createDataFrame([(" nation_1 Equity",), ("Nation_6 equity ",), ("nowhere",)], "asset string")
    rows = universe.without_tickers(Panel(spark, sf_dir).bars, named)
    return _out(rows.groupBy("asset").agg(F.count("*").alias("n"), F.sum("price").alias("total")))


_ROLL = _WIN + f"vs AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS u3 FROM (SELECT DISTINCT rebal_date FROM roll)),"


@query(_sql(_ROLL.rstrip(",") + f" SELECT cal.date::VARCHAR AS date, rebal_date::VARCHAR AS rebal_date, i AS asset, round(cov, 8) AS variance FROM cal JOIN vs ON cal.date >= rebal_date AND (u3 IS NULL OR cal.date < u3) JOIN roll USING (rebal_date) WHERE i = j AND i IN {_NAMES}"))
def cov_path_asof(spark, sf_dir):
    """A stored path of covariances, and of it the variances of some assets as of every date."""
    p = Panel(spark, sf_dir)
    at = f"{folder(spark, 'cov-path')}/path"
    covpath.write(covariance.rolling(p.window(24), ["rebal_date"]), at)
    return _out(covpath.diagonal(covpath.as_of(covpath.read(spark, at, NAMES), p.cal)), 8)


@query(_sql("""ws AS (SELECT max(date) AS rebal_date FROM cal GROUP BY date_trunc('month', date)), e AS (SELECT rebal_date, idx AS e FROM ws JOIN cal ON cal.date = rebal_date WHERE idx >= 51),
win AS (SELECT rebal_date, r.date, asset, coalesce(ret, 0) AS ret FROM e JOIN cal c ON c.idx BETWEEN e - 51 AND e JOIN rets r ON r.date = c.date), wa AS (SELECT * FROM win WHERE (rebal_date, asset) IN (SELECT (rebal_date, asset) FROM win GROUP BY rebal_date, asset HAVING max(abs(ret)) > 0))
SELECT x.rebal_date::VARCHAR AS rebal_date, x.asset AS i, y.asset AS j, round(covar_samp(x.ret, y.ret), 8) AS cov FROM wa x JOIN wa y ON x.rebal_date = y.rebal_date AND x.date = y.date AND x.asset <= y.asset GROUP BY ALL""", "week"))  # fmt: skip
def cov_path_monthly_of_weeks(spark, sf_dir):
    """Weekly returns, and a covariance of all assets at the last week of each month."""
    p = Panel(spark, sf_dir, "week")
    path = covpath.compute(p.rets, p.cal, 52, freq="M")
    return _out(path, 8)


@query(_sql(_WIN + "vr AS (SELECT rebal_date, i AS asset FROM roll WHERE i = j AND cov > 0.002), k AS (SELECT * FROM tg WHERE (rebal_date, asset) IN (SELECT (rebal_date, asset) FROM vr)) SELECT rebal_date::VARCHAR AS rebal_date, asset, round(weight / sum(weight) OVER (PARTITION BY rebal_date), 6) AS weight FROM k"))
def zero_variance_purge(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(covpath.purge(covariance.rolling(p.window(24), ["rebal_date"]), p.quarter_starts, 0.002))


@query(_sql(_WIN + """ib AS (SELECT rebal_date, asset, covar_samp(ret, bench_ret) AS c FROM win JOIN series USING (date) GROUP BY ALL),
own AS (SELECT rebal_date, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov) / power((SELECT count(DISTINCT asset) FROM bars), 2) AS v FROM roll GROUP BY rebal_date), cr AS (SELECT rebal_date, sum(c) / (SELECT count(DISTINCT asset) FROM bars) AS c FROM ib JOIN tg USING (rebal_date, asset) GROUP BY rebal_date)
SELECT rebal_date::VARCHAR AS rebal_date, round(v - 2 * c, 8) AS value FROM own JOIN cr USING (rebal_date)"""))  # fmt: skip
def objective_vs_benchmark_returns(spark, sf_dir):
    p = Panel(spark, sf_dir)
    window = p.window(24)
    ib = window.join(p.series.select("date", "bench_ret"), "date").groupBy("rebal_date", "asset").agg(F.covar_samp("ret", "bench_ret").alias("cov_ib"))
    a = p.quarter_starts.select("rebal_date", "asset", p.equal.alias("a"))
    return _out(covpath.objective(covariance.rolling(window, ["rebal_date"]), ib, a), 8)


_KEPT = _CAPS + "kept AS (SELECT DISTINCT asset FROM bars WHERE asset NOT IN (SELECT asset FROM small)),"


def _kept(p: Panel):
    caps = p.bars.groupBy("asset").agg(F.sum("revenue").alias("cap"))
    return universe.keep_only(caps.select("asset"), universe.exclusions(caps.select("asset"), caps, 0.2))


@query(_sql(_WIN + _KEPT + """pw AS (SELECT rebal_date, asset, CASE WHEN asset IN (SELECT asset FROM kept) THEN weight / sum(CASE WHEN asset IN (SELECT asset FROM kept) THEN weight END) OVER (PARTITION BY rebal_date) ELSE 0 END - weight AS a FROM tg),
q AS (SELECT rebal_date, sum(CASE WHEN i = j THEN 1 ELSE 2 END * x.a * y.a * cov) AS v FROM roll JOIN pw x USING (rebal_date) JOIN pw y USING (rebal_date) WHERE x.asset = i AND y.asset = j GROUP BY rebal_date)
SELECT rebal_date::VARCHAR AS rebal_date, round(sqrt(v) * sqrt(12), 6) AS te_ante FROM q"""))  # fmt: skip
def weights_mode_projection(spark, sf_dir):
    """The benchmark's weights on what may be held, without a solver, and their tracking error."""
    p = Panel(spark, sf_dir)
    bench = p.quarter_starts
    held = events.project(bench, _kept(p), "rebal_date", strict=True)
    a = reports.active_weights(held, bench).select("rebal_date", "asset", F.col("active_weight").alias("a"))
    v = covariance.quadratic(covariance.rolling(p.window(24), ["rebal_date"]), a, ["rebal_date"])
    return _out(v.select("rebal_date", (F.sqrt("variance") * F.sqrt(F.lit(float(ANN)))).alias("te_ante")))


@query(_sql(_KEPT + "f AS (SELECT * FROM bench WHERE date = (SELECT min(date) FROM bench) AND asset IN (SELECT asset FROM kept)) SELECT date::VARCHAR AS date, asset, round(weight / sum(weight) OVER (), 6) AS weight FROM f"))
def initial_weights(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(events.initial_weights(p.bench, _kept(p)))


@query(_sql(f"SELECT {_D}, count(*) AS n FROM rets WHERE date IN (SELECT date FROM bench) GROUP BY date"))
def aligned_inputs(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(events.aligned(p.rets, p.bench, 10).groupBy("date").agg(F.count("*").alias("n")))


@query(_sql(_TARGETS + """te AS (SELECT date, CASE WHEN count(active) OVER w >= 12 THEN stddev_samp(active) OVER w * sqrt(12) END AS te FROM act WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
b AS (SELECT DISTINCT rebal_date, true AS c, false AS r FROM tg UNION ALL SELECT date, false, true FROM te WHERE te > 0.02) SELECT rebal_date::VARCHAR AS rebal_date, max(c) AS by_calendar, max(r) AS by_rule FROM b GROUP BY rebal_date"""))  # fmt: skip
def rebalance_triggers(spark, sf_dir):
    p = Panel(spark, sf_dir)
    rule = evaluate.rolling_te(p.series, 12, ANN).filter("te > 0.02").select(F.col("date").alias("rebal_date"))
    return _out(events.triggers(p.quarter_starts.select("rebal_date").distinct(), rule))


@query(_sql(_TARGETS + """ats AS (SELECT DISTINCT rebal_date, idx - 2 AS e FROM tg JOIN cal ON cal.date = rebal_date), win AS (SELECT rebal_date, asset, coalesce(ret, 0) AS ret FROM ats JOIN cal c ON c.idx BETWEEN e - 11 AND e JOIN rets r ON r.date = c.date WHERE e >= 11)
SELECT rebal_date::VARCHAR AS rebal_date, asset, round(var_samp(ret), 8) AS variance FROM win GROUP BY ALL HAVING max(abs(ret)) > 0"""))  # fmt: skip
def target_windows_lagged(spark, sf_dir):
    """The variances that a decision may know whose data come two bars late."""
    return _out(covpath.diagonal(covariance.rolling(Panel(spark, sf_dir).window(12, lag=2), ["rebal_date"])), 8)


_LATE = _DRIFT.replace("tg AS (SELECT * FROM targets WHERE rebal_date IS NOT NULL),", "tg AS (SELECT c2.date AS rebal_date, asset, weight FROM targets t JOIN cal c ON c.date = t.rebal_date JOIN cal c2 ON c2.idx = c.idx + 1),")


@query(_sql(_LATE.rstrip(",") + " SELECT date::VARCHAR AS date, round(sum(w_in_force * ret), 6) AS bench_ret FROM path GROUP BY date"))
def drift_pending_orders(spark, sf_dir):
    """Decisions that take effect one bar later."""
    p = Panel(spark, sf_dir)
    return _out(drift.path_return(drift.drift(p.rets, events.effective(p.quarter_starts, p.cal, 1)), "bench_ret"))


_COSTS = _DRIFT + """cx AS (SELECT date, asset, -w_close AS w FROM path UNION ALL SELECT rebal_date, asset, weight FROM tg),
cd AS (SELECT date, asset, abs(sum(w)) AS d FROM cx WHERE date IN (SELECT rebal_date FROM tg) AND date IN (SELECT date FROM path) GROUP BY ALL), co AS (SELECT date, sum(d) * 10 / 1e4 AS cost FROM cd GROUP BY date),
pr AS (SELECT date, sum(w_in_force * ret) AS port_ret FROM path GROUP BY date),"""


@query(_sql(_COSTS.rstrip(",") + " SELECT date::VARCHAR AS date, round((1 + port_ret) * (1 - coalesce(cost, 0)) - 1, 8) AS port_ret FROM pr LEFT JOIN co USING (date)"))
def returns_net_of_costs(spark, sf_dir):
    p = Panel(spark, sf_dir)
    path = drift.drift(p.rets, p.quarter_starts)
    return _out(events.net_of_costs(drift.path_return(path, "port_ret"), drift.cost_fraction(path, p.quarter_starts, 10)), 8)


@query(_sql(f"g AS (SELECT date, product(1 + port_ret) OVER (ORDER BY date) AS g FROM series) SELECT {_D}, round(g * (1000 + sum(CASE WHEN month(date) = 1 THEN 50 ELSE 0 END / g) OVER (ORDER BY date)), 4) AS value FROM g"))
def value_with_flows(spark, sf_dir):
    s = Panel(spark, sf_dir).series
    flows = s.filter("month(date) = 1").select("date", F.lit(50.0).alias("flow"))
    return _out(events.value_with_flows(s, flows, 1000.0), 4)


@query(_sql(_TARGETS + "f AS (SELECT * FROM act WHERE date >= (SELECT min(rebal_date) FROM tg)) SELECT count(*) AS n_days, round(product(1 + port_ret) / (1 + min_by(port_ret, date)), 6) AS final_nav, round(stddev_samp(active) * sqrt(12), 6) AS te_ann FROM f"))
def finalised_run(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(events.finalise(p.series, p.quarter_starts, ANN))


@query(_sql("""y AS (SELECT DISTINCT year(date) AS seed FROM series), s AS (SELECT seed, date, product(1 + port_ret) OVER (PARTITION BY seed ORDER BY date) AS nav FROM y JOIN series ON year(date) >= seed),
r AS (SELECT date, product(1 + bench_ret) OVER (ORDER BY date) AS level FROM series), f AS (SELECT seed, min(date) AS date FROM s GROUP BY seed)
SELECT seed, s.date::VARCHAR AS date, round(nav * level, 6) AS nav FROM s JOIN f USING (seed) JOIN r ON r.date = f.date"""))  # fmt: skip
def nav_anchored_starts(spark, sf_dir):
    """Paths that begin with each year, at the benchmark's level of their first date."""
    s = Panel(spark, sf_dir).series
    years = s.select(F.year("date").cast("long").alias("seed")).distinct()
    paths = evaluate.nav(years.join(s, F.year("date") >= F.col("seed")), "port_ret", ["seed"]).select("seed", "date", "nav")
    return _out(events.anchored_navs(paths, evaluate.nav(s, "bench_ret"), ["seed"]))


@query(_sql(_TURN + ", u AS (SELECT avg(turnover) * 12 AS turnover_ann FROM t WHERE turnover > 1e-6), e AS (SELECT stddev_samp(active) * sqrt(12) AS te_ann FROM act) SELECT round(te_ann, 6) AS te_ann, round(turnover_ann, 6) AS turnover_ann, round(te_ann / nullif(turnover_ann, 0), 6) AS te_per_unit_turnover FROM e, u"))
def summary_turnover(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(evaluate.with_turnover(evaluate.scenario_summary(p.series, ANN), p.bench.select("date", "asset", "weight"), ANN).select("te_ann", "turnover_ann", "te_per_unit_turnover"))


@query(_sql(_TARGETS + """sp AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS u FROM (SELECT DISTINCT rebal_date FROM tg))
SELECT rebal_date::VARCHAR AS rebal_date, round(product(1 + port_ret) - 1, 6) AS ptf_ret, round(product(1 + bench_ret) - 1, 6) AS bench_ret FROM sp JOIN series ON date >= rebal_date AND (u IS NULL OR date < u) GROUP BY rebal_date"""))  # fmt: skip
def allocation_period_returns(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(events.period_returns(p.series, p.quarter_starts))


@query(_sql(_ANTE + """own AS (SELECT rebal_date, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov) / power((SELECT count(DISTINCT asset) FROM bars), 2) AS va FROM roll JOIN tg x USING (rebal_date) JOIN tg y USING (rebal_date) WHERE x.asset = i AND y.asset = j GROUP BY rebal_date),
ps AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS u2 FROM (SELECT DISTINCT rebal_date FROM tg)),
post AS (SELECT rebal_date, CASE WHEN count(port_ret) >= 5 THEN var_samp(port_ret) ELSE power(product(1 + port_ret) - 1, 2) / count(port_ret) END AS vp FROM ps JOIN act ON date >= rebal_date AND (u2 IS NULL OR date < u2) GROUP BY rebal_date),
x AS (SELECT *, va / nullif(vp, 0) AS ratio FROM own JOIN post USING (rebal_date)) SELECT count(*) AS n, round(avg(least(greatest(ratio, 0), 5)), 4) AS clipped_ratio, round(avg(CASE WHEN ratio < 1 THEN 1.0 ELSE 0.0 END), 6) AS below, round(avg(va - vp) * 12, 8) AS bias_ann FROM x WHERE ratio IS NOT NULL"""))  # fmt: skip
def calibration_portfolio(spark, sf_dir):
    """The portfolio's own variance, before and after."""
    p = Panel(spark, sf_dir)
    a = p.quarter_starts.select("rebal_date", "asset", p.equal.alias("a"))
    ante = covariance.quadratic(covariance.rolling(p.window(24), ["rebal_date"]), a, ["rebal_date"]).withColumnRenamed("variance", "var_ante")
    post = reports.realised_variance(p.series, p.quarter_starts.select("rebal_date"), "port_ret")
    clipped = ante.join(post, "rebal_date").select(F.least(F.greatest(F.try_divide("var_ante", "var_post"), F.lit(0.0)), F.lit(5.0)).alias("r")).agg(F.avg("r").alias("clipped_ratio"))
    out = reports.calibration(ante, post, ANN).crossJoin(F.broadcast(clipped))
    return out.select("n", F.round("clipped_ratio", 4).alias("clipped_ratio"), F.round("below", 6).alias("below"), F.round("bias_ann", 8).alias("bias_ann"))


@query(_sql(_SECTOR + """wh AS (SELECT date, sum(wp * rp) AS tp, sum(wb * rb) AS tb FROM sd GROUP BY date), rr AS (SELECT product(1 + tp) AS p, product(1 + tb) AS b FROM wh),
lk AS (SELECT date, tb, (SELECT p FROM rr) / product(1 + tp) OVER (ORDER BY date) * product(1 + tb) OVER (ORDER BY date) / (SELECT b FROM rr) AS link FROM wh)
SELECT sector, round(sum(link * (wp - wb) * (rb - tb)), 6) AS allocation, round(sum(link * wb * (rp - rb)), 6) AS selection, round(sum(link * (wp - wb) * (rp - rb)), 6) AS interaction FROM sd JOIN lk USING (date) GROUP BY sector"""))  # fmt: skip
def brinson_ratio_linked(spark, sf_dir):
    """Effects linked by ratios of total to running growth."""
    p = Panel(spark, sf_dir)
    return _out(reports.brinson(_paths(p), p.rets, p.sectors, linking="ratio"))


@query(_sql("""m AS (SELECT asset, avg(ret) AS mean, stddev_samp(ret) / sqrt(count(ret)) AS se FROM rets GROUP BY asset)
SELECT asset, round(mean, 6) AS mean, round(mean - 1.959963984540054 * se, 6) AS low, round(mean + 1.959963984540054 * se, 6) AS high FROM m ORDER BY abs(mean) DESC, asset LIMIT 10"""))  # fmt: skip
def mean_ci_top(spark, sf_dir):
    """The ten means furthest from zero, for bars with intervals."""
    return _out(moments.largest_means(Panel(spark, sf_dir).rets, "ret", ["asset"], 10))


@query(_sql("""d AS (SELECT date, sum(coalesce(ret, 0)) / (SELECT count(DISTINCT asset) FROM bars) AS p FROM rets GROUP BY date), v AS (SELECT count(*) AS n, avg(p) AS mean, var_samp(p) AS v FROM d)
SELECT n, round(mean, 6) AS mean, round(sqrt(v / n), 8) AS se_mean, round(mean / sqrt(v / n), 4) AS z, round(v, 8) AS variance, round(sqrt(2 * v * v / n), 8) AS se_variance, round(greatest(v - 1.959963984540054 * sqrt(2 * v * v / n), 0), 8) AS low, round(v + 1.959963984540054 * sqrt(2 * v * v / n), 8) AS high, ceil(v / 0.000001)::BIGINT AS needed FROM v"""))  # fmt: skip
def portfolio_asymptotics(spark, sf_dir):
    """Errors of an equal portfolio's mean and variance from the covariance table."""
    p = Panel(spark, sf_dir)
    rows = p.rets.select(F.lit(1).alias("k"), "date", "asset", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    weights = p.rets.select("asset").distinct().select(F.lit(1).alias("k"), "asset", p.equal.alias("a"))
    v = covariance.quadratic(covariance.rolling(rows, ["k"]), weights, ["k"])
    mean = rows.join(weights, ["k", "asset"]).groupBy("k", "date").agg(F.sum(F.col("a") * F.col("ret")).alias("p")).groupBy("k").agg(F.count("*").alias("n"), F.avg("p").alias("mean"))
    out = moments.portfolio_errors(v.join(mean, "k"), 0.001)
    return _out(out.drop("k"), 8).withColumns({"mean": F.round("mean", 6), "z": F.round("z", 4)})


@query(_sql(_SHRINK + """k AS (SELECT *, ss - p * m * m AS d2, greatest((x4 - n * ss) / (n * n), 0) AS b2 FROM w JOIN x4 USING (rebal_date)), h AS (SELECT *, CASE WHEN d2 <= 1e-24 THEN 1 ELSE greatest(least(b2 / d2, 1), 0) END AS rho FROM k),
lw AS (SELECT rebal_date, i, j, rho * CASE WHEN i = j THEN m ELSE 0 END + (1 - rho) * s AS cov FROM s JOIN h USING (rebal_date)),
fl AS (SELECT rebal_date, sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * power(roll.cov - lw.cov, 2))) AS f, row_number() OVER (ORDER BY rebal_date) AS k FROM roll JOIN lw USING (rebal_date, i, j) GROUP BY rebal_date)
SELECT (SELECT round(stddev_samp(active) * sqrt(12), 6) FROM act) AS te_ann, count(*) AS n, round(avg(f), 8) AS frobenius_mean FROM fl WHERE k > 4"""))  # fmt: skip
def loss_after_burn_in(spark, sf_dir):
    """The mean loss over dates but the first four, beside the run's tracking error."""
    p = Panel(spark, sf_dir)
    w = p.window(24)
    losses = covariance.frobenius(covariance.rolling(w, ["rebal_date"]), covariance.ledoit_wolf(w, ["rebal_date"]), ["rebal_date"])
    mean = covariance.mean_loss(losses, "frobenius", 4)
    te = evaluate.expost_metrics(p.series, ANN).select("te_ann")
    return te.crossJoin(F.broadcast(mean)).select(F.round("te_ann", 6).alias("te_ann"), "n", F.round("frobenius_mean", 8).alias("frobenius_mean"))


@query(_sql(_SHRINK + """k AS (SELECT *, ss - p * m * m AS d2, greatest((x4 - n * ss) / (n * n), 0) AS b2 FROM w JOIN x4 USING (rebal_date)), h AS (SELECT *, CASE WHEN d2 <= 1e-24 THEN 1 ELSE greatest(least(b2 / d2, 1), 0) END AS rho FROM k),
lw AS (SELECT rebal_date, i, j, rho * CASE WHEN i = j THEN m ELSE 0 END + (1 - rho) * s AS cov FROM s JOIN h USING (rebal_date)),
g AS (SELECT asset, (dense_rank() OVER (ORDER BY asset) - 1) % 4 AS g FROM (SELECT DISTINCT asset FROM bars)),
d AS (SELECT rebal_date, x.g AS a, y.g AS b, CASE WHEN i = j THEN 1 ELSE 2 END AS t, roll.cov - lw.cov AS d FROM roll JOIN lw USING (rebal_date, i, j) JOIN g x ON x.asset = i JOIN g y ON y.asset = j),
l AS (SELECT seed, rebal_date, sqrt(sum(t * d * d)) AS frobenius, max(abs(d)) AS largest FROM d JOIN (SELECT DISTINCT g AS seed FROM g) ON a <> seed AND b <> seed GROUP BY ALL),
o AS (SELECT seed, avg(frobenius) AS frobenius, avg(largest) AS largest FROM l GROUP BY seed), u AS (UNPIVOT o ON frobenius, largest INTO NAME metric VALUE value)
SELECT metric, count(*) AS n, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS std FROM u GROUP BY metric"""))  # fmt: skip
def loss_over_seeds(spark, sf_dir):
    """Losses of the shrunk covariance against the sample's, with a quarter of the assets left out in turn: mean over
    dates, then mean and deviation over the four seeds."""
    p = Panel(spark, sf_dir)
    w = p.window(24)
    names = p.bars.select("asset").distinct()
    parts = names.select("asset", F.pmod(F.dense_rank().over(Window.orderBy("asset")) - 1, F.lit(4)).alias("part"))
    losses = covariance.held_out_losses(covariance.rolling(w, ["rebal_date"]), covariance.ledoit_wolf(w, ["rebal_date"]), parts, ["rebal_date"])
    means = losses.groupBy("seed").agg(F.avg("frobenius").alias("frobenius"), F.avg("largest").alias("largest"))
    return _out(covariance.over_seeds(means, ["frobenius", "largest"]), 8)


@query(_sql("""m AS (SELECT count(*)::DOUBLE AS n, stddev_samp(active) AS te_daily, avg(active * active) AS mse, avg(abs(active)) AS mae FROM act), u AS (UNPIVOT m ON n, te_daily, mse, mae INTO NAME name VALUE value)
SELECT name, round(value, 6) AS value FROM u"""))  # fmt: skip
def diagnostics_log(spark, sf_dir):
    row = evaluate.expost_metrics(Panel(spark, sf_dir).series, ANN).select("n", "te_daily", "mse", "mae")
    return _out(events.flat_log(row, []))


@query(_sql(f"SELECT {_D}, asset, round(last_value(ret IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date), 6) + 0 AS ret, (SELECT max(date) FROM cal c WHERE c.date < rets.date)::VARCHAR AS before FROM rets"))
def carry_returns_with_calendar(spark, sf_dir):
    p = Panel(spark, sf_dir)
    before = calendars.shift(p.cal.select("date"), p.cal, -1).withColumnRenamed("shifted", "before")
    return _out(evaluate.carry_forward(p.rets, "ret", ["asset"]).join(before, "date"))
