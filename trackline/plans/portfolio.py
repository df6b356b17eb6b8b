"""Registered queries of core allocations and resumable runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from trackline.operators import allocation, backtest, calendars, execution, matrix, returns, universe
from trackline.plans.registry import query
from trackline.plans.relational import _CAPS, ANN, Panel, _out, _sql
from trackline.sources.results import ResultStore, ResumableRun
from trackline.sources.shared import folder, stored
from trackline.sources.tables import table


def _core_sql(scale: float, budget: float, threshold: float, score: str, sector: bool) -> str:
    """The rules of core weights in SQL, for benchmarks that have open assets, and scores, on every date."""
    goal = f"w * {budget}"
    given = """CASE WHEN own > 1e-12 THEN own * (1 + CASE WHEN spill > 1e-12 THEN spill / live ELSE 0 END) * s / ss ELSE goal END""" if sector else "rest * s / ds"
    return _CAPS + f"""b AS (SELECT date, asset, coalesce(sector, 'UNKNOWN') AS sector, weight * {scale} AS w, asset IN (SELECT asset FROM small) AS x FROM bench LEFT JOIN sectors USING (asset)),
g AS (SELECT *, NOT x AND w >= {threshold} AS f, CASE WHEN x THEN 0 ELSE {goal} END AS goal FROM b),
h AS (SELECT *, CASE WHEN NOT x AND NOT f THEN {score} ELSE 0 END AS s, sum(CASE WHEN f THEN goal ELSE 0 END) OVER (PARTITION BY date) AS held,
  sum(w) OVER (PARTITION BY date, sector) * {budget} - sum(CASE WHEN f THEN goal ELSE 0 END) OVER (PARTITION BY date, sector) AS own FROM g),
k AS (SELECT *, {budget} - held AS rest, sum(s) OVER (PARTITION BY date) AS ds, sum(s) OVER (PARTITION BY date, sector) AS ss FROM h),
z AS (SELECT date, sum(CASE WHEN own > 1e-12 AND ss = 0 THEN own ELSE 0 END) AS spill, sum(CASE WHEN own > 1e-12 AND ss > 0 THEN own ELSE 0 END) AS live FROM (SELECT DISTINCT date, sector, own, ss FROM k) GROUP BY date),
m AS (SELECT k.*, CASE WHEN x OR f THEN goal ELSE {given} END AS v FROM k JOIN z USING (date)),
n AS (SELECT *, sum(v) OVER (PARTITION BY date) AS tv, sum(CASE WHEN f THEN 0 ELSE v END) OVER (PARTITION BY date) AS lv FROM m)
SELECT date::VARCHAR AS date, asset, round(CASE WHEN rest < -1e-10 THEN CASE WHEN f THEN goal / held * {budget} ELSE goal END
  WHEN {sector} AND abs(tv - {budget}) > 1e-8 AND NOT f THEN v * rest / lv ELSE v END, 6) AS weight, f AS frozen FROM n"""


def _core(spark, sf_dir, scale: float, budget: float, threshold: float, mode: str):
    p = Panel(spark, sf_dir)
    caps = p.bars.groupBy("asset").agg(F.sum("revenue").alias("cap"))
    small = universe.exclusions(caps.select("asset"), caps, 0.2)
    bench = p.bench.join(p.sectors, "asset", "left").select("date", "asset", "sector", (F.col("weight") * scale).alias("weight"))
    return _out(allocation.core_weights(bench, small, mode, budget, threshold))


@query(_sql(_core_sql(1.0, 0.6, 0.045, "1 / w", True)))
def core_budget_sector_inverse(spark, sf_dir):
    """60 % of a portfolio, weights of at least 4.5 % frozen, the small fifth excluded."""
    return _core(spark, sf_dir, 1.0, 0.6, 0.045, "sector_inv")


@query(_sql(_core_sql(0.9, 0.8, 0.06, "w", True)))
def core_budget_scaled_sectors(spark, sf_dir):
    """A benchmark that sums to 90 %: what is not frozen is scaled to the budget."""
    return _core(spark, sf_dir, 0.9, 0.8, 0.06, "sector_prop")


@query(_sql(_core_sql(1.8, 0.7, 0.05, "w", False)))
def core_budget_overshoot(spark, sf_dir):
    """A benchmark of 180 %: the frozen goals exceed the budget and are scaled down."""
    return _core(spark, sf_dir, 1.8, 0.7, 0.05, "global_prop")


@query("""
SELECT n_name AS asset, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
""")
def grid_run_resumed(spark, sf_dir):
    """A grid of nations and priorities, run for half of its batches, one batch repeated, one left half written, and finished by
    a second run that knows only the folder. The stored summary holds every scenario once."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    base = stored(joined.select(F.col("n_name").alias("asset"), F.col("o_orderpriority").alias("priority"), "o_totalprice"), "grid-base")
    at = folder(spark, "grid-run")
    summary = StructType().add("asset", StringType()).add("priority", StringType()).add("n", LongType()).add("total", DoubleType())

    def work(own):
        rows = base.join(own, ["asset", "priority"], "left_semi").groupBy("asset", "priority")
        known = [F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean")]
        return {"summary": rows.agg(*known)}

    def run():
        return ResumableRun(ResultStore(spark, at, {"summary": summary}), base.select("asset", "priority").distinct(), ["asset", "priority"], 25)

    first = run()
    ran = first.run(work, most=3)
    if ran:
        first.run_batch(ran[0], work)
    left = first.pending().agg(F.min("batch")).first()[0]
    if left is not None:
        # What remains of a driver that is lost before its commit.
        base.limit(1).selectExpr("asset", "priority", "-1L AS n").write.parquet(f"{at}/summary/batch={left}")
    second = run()
    second.run(work)
    return second.store.read("summary").select("asset", "priority", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"))


#: scenario, whether the calendar counts, threshold, window, cooldown.
_DECIDERS = [("calendar", True, None, None, None), ("rule", False, 0.012, 12, 6), ("both", True, 0.014, 18, 0), ("patient", False, 0.012, 12, 30)]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)


_LOOP = f"""names AS (SELECT DISTINCT asset FROM bars), dy AS (SELECT date, idx AS i, list(coalesce(ret, 0) ORDER BY asset) AS r FROM rets JOIN cal USING (date) GROUP BY ALL),
dd AS (SELECT dy.*, CASE WHEN i = 0 THEN 0 ELSE coalesce(bench_ret, 0) END AS b, year(date) <> year(date - INTERVAL 1 MONTH) AS mark FROM dy LEFT JOIN series USING (date)),
sc(s, cal_, thr, win, cool) AS (VALUES {_values(_DECIDERS)}), eq AS (SELECT list(1.0::DOUBLE / (SELECT count(*) FROM names)) AS e FROM names),
st AS (SELECT s, cal_, thr, win, cool, e, 0::BIGINT AS i, date, 0.0::DOUBLE AS ret, 1.0::DOUBLE AS nav, e AS w, [0.0::DOUBLE] AS act, NULL::BIGINT AS last, NULL::DOUBLE[] AS pend, NULL::VARCHAR AS why FROM sc, eq, dd WHERE i = 0
  UNION ALL SELECT s, cal_, thr, win, cool, e, i, date, ret, nav, list_transform(g, lambda x: x / list_sum(g)), act, CASE WHEN why = 'rule' THEN i ELSE last END, CASE WHEN why IS NOT NULL THEN e END, why FROM (
    SELECT *, CASE WHEN cal_ AND mark THEN 'calendar' WHEN thr IS NOT NULL AND i > 1 AND i + 1 >= win AND (cool = 0 OR last IS NULL OR i - last >= cool)
      AND list_aggregate(act[i - win + 2 : i + 1], 'stddev_samp') * sqrt(12) > thr THEN 'rule' END AS why FROM (
      SELECT s, cal_, thr, win, cool, e, i, date, last, mark, ret, nav * (1 + ret) AS nav, list_transform(range(1, len(v) + 1), lambda k: v[k] * (1 + r[k])) AS g, list_append(act, ret - b) AS act FROM (
        SELECT st.* EXCLUDE (i, date, ret), v, dd.i, dd.date, dd.r, dd.b, dd.mark, list_dot_product(v, dd.r) AS ret FROM (SELECT *, coalesce(pend, w) AS v FROM st) st JOIN dd ON dd.i = st.i + 1))))
SELECT s AS scenario, date::VARCHAR AS date, round(ret, 8) AS port_ret, round(nav, 6) AS nav, why AS decided FROM st"""


@query(_sql(_LOOP).replace("WITH ", "WITH RECURSIVE ", 1))
def backtest_rules_and_calendars(spark, sf_dir):
    """Back to equal weights each January, or whenever the tracking error of the last months is too large, or both.

    The SQL walks the days by recursion."""
    p = Panel(spark, sf_dir)
    cal = stored(p.cal, "calendar")
    scenarios = spark.createDataFrame(_DECIDERS, "scenario string, by_calendar boolean, threshold double, window int, cooldown int")
    equal = p.bars.select("asset").distinct().select("asset", p.equal.alias("weight"))
    targets = scenarios.select("scenario").crossJoin(F.broadcast(cal.select("date"))).crossJoin(F.broadcast(equal))
    januaries = cal.filter("year(date) <> year(add_months(date, -1))").select("date")
    marked = scenarios.filter("by_calendar").select("scenario").crossJoin(F.broadcast(januaries))
    out = backtest.run(p.rets, p.series.select("date", "bench_ret"), equal, targets, marked, scenarios, ANN)
    return out.select("scenario", F.col("date").cast("string").alias("date"), F.round("port_ret", 8).alias("port_ret"), F.round("nav", 6).alias("nav"), "decided")


@query()
def backtest_shares_with_flows(spark, sf_dir):
    """Whole shares bought at equal weights each January, with costs, interest on cash, and a payment each July."""
    p = Panel(spark, sf_dir)
    cal = stored(p.cal, "calendar")
    one = spark.createDataFrame([("lots", None, None, None)], "scenario string, threshold double, window int, cooldown int")
    equal = p.bars.select("asset").distinct().select("asset", p.equal.alias("weight"))
    januaries = cal.filter("year(date) <> year(add_months(date, -1))").select(F.lit("lots").alias("scenario"), "date")
    flows = cal.filter("month(date) = 7").select("date", F.lit(5_000.0).alias("flow"))
    panel = p.rets.join(p.dense.select("date", "asset", "price"), ["date", "asset"])
    book = backtest.Shares(reserve=0.01, min_trade=100, cash_return=0.001)
    out = backtest.run(panel, p.series.select("date", "bench_ret"), equal, januaries.crossJoin(F.broadcast(equal)), januaries, one, ANN, backtest.Settings(bps=5, start=1e6, shares=book), flows)
    return out.select("scenario", F.col("date").cast("string").alias("date"), F.round("port_ret", 8).alias("port_ret"), F.round("nav", 2).alias("nav"), F.round("cash", 2).alias("cash"), "n_trades", "traded")


@query()
def evaluation_of_models(spark, sf_dir):
    """From returns and compositions to the figures of each covariance model, with the lags of decisions."""
    p = Panel(spark, sf_dir)
    bench = p.bench.select("date", "asset", "weight")
    returns = p.rets.join(bench.select("date").distinct(), "date", "left_semi")
    resets = p.quarter_starts.select(F.col("rebal_date").alias("date")).distinct()
    found = backtest.full_evaluation(returns, bench, calendars.schedule(calendars.calendar(returns), "Q"), resets, ["rolling", "lw", "qis"], 36, ANN)
    return _out(found["summary"])


@query()
def te_min_ordered(spark, sf_dir):
    """Weights of least tracking error in the order of dates, each solve begun at the weights before; the same as te_min_qp's."""
    p = Panel(spark, sf_dir)
    caps = p.bars.groupBy("asset").agg(F.sum("revenue").alias("cap"))
    small = universe.exclusions(caps.select("asset"), caps, 0.2)
    cov = stored(matrix.covariances(p.window(36), ["rolling", "lw", "anls", "qis"]), "covariances")
    return _out(matrix.tracking_minimal_ordered(cov, p.quarter_starts, small).select("model", "rebal_date", "asset", "weight"), 5)


@query(_sql("""tgt AS (SELECT date, asset, weight, price FROM bench JOIN filled USING (date, asset)), w1 AS (SELECT *, CASE WHEN price > 0 THEN weight ELSE 0 END AS w FROM tgt),
w2 AS (SELECT *, coalesce(w / nullif(sum(w) OVER (PARTITION BY date), 0), 0) * 1000000.0 AS m FROM w1), sh AS (SELECT date, asset, price, round_even(coalesce(m / nullif(price, 0), 0) / 10, 0) * 10 AS shares FROM w2)
SELECT date::VARCHAR AS date, asset, shares, round(1000000.0 - sum(shares * price) OVER (PARTITION BY date), 2) AS cash FROM sh"""))  # fmt: skip
def weights_to_rounded_lots(spark, sf_dir):
    """A million in lots of ten, rounded to the nearest."""
    p = Panel(spark, sf_dir)
    targets = p.bench.select("date", "asset", "weight").join(returns.forward_fill(p.dense).select("date", "asset", "price"), ["date", "asset"])
    out = execution.to_shares(targets, 1_000_000.0, lot=10, rounding="round")
    return out.select(F.col("date").cast("string").alias("date"), "asset", "shares", F.round("cash", 2).alias("cash"))
