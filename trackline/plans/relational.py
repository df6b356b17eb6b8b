"""Registered queries that SQL can express, each with its SQL on the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackline.operators import allocation, calendars, covariance, drift, evaluate, execution, reports, returns, universe
from trackline.plans.registry import query
from trackline.sources import panel as source
from trackline.sources.shared import stored
from trackline.sources.tables import table

ANN = 12
DIGITS = 6

_BARS = """
lines AS (SELECT l_orderkey, date_trunc('{f}', l_shipdate)::DATE AS date, sum(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
bars AS (SELECT date, n_name AS asset, sum(v) / sum(q) AS price, sum(v) AS revenue FROM lines JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
sectors AS (SELECT n_name AS asset, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey),
grid AS (SELECT date, asset, price, revenue FROM (SELECT DISTINCT date FROM bars) CROSS JOIN (SELECT DISTINCT asset FROM bars) LEFT JOIN bars USING (date, asset)),
filled AS (SELECT date, asset, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date) AS price FROM grid),
rets AS (SELECT date, asset, price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS ret FROM filled),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)),
quarters AS (SELECT date_trunc('quarter', date)::DATE AS q, asset, sum(revenue) AS v FROM bars GROUP BY ALL),
compo AS (SELECT (q + INTERVAL 3 MONTH)::DATE AS eff_date, asset, v / sum(v) OVER (PARTITION BY q) AS weight FROM quarters),
versions AS (SELECT eff_date, lead(eff_date) OVER (ORDER BY eff_date) AS until FROM (SELECT DISTINCT eff_date FROM compo)),
held AS (SELECT * FROM compo JOIN versions USING (eff_date)),
bench AS (SELECT cal.date, asset, weight, eff_date FROM cal JOIN held ON cal.date >= eff_date AND (until IS NULL OR cal.date < until)),
series AS (SELECT date, p.port_ret, b.bench_ret FROM (SELECT date, avg(ret) AS port_ret FROM rets WHERE ret IS NOT NULL GROUP BY date) p
  JOIN (SELECT date, sum(weight * ret) AS bench_ret FROM rets JOIN bench USING (date, asset) WHERE ret IS NOT NULL GROUP BY date) b USING (date)),
act AS (SELECT *, port_ret - bench_ret AS active FROM series),
"""


def _sql(body: str, freq: str = "month") -> str:
    """The shared common tables, then `body`, which goes on with them or selects."""
    base = _BARS.replace("{f}", freq).strip()
    body = body.strip()
    return "WITH " + (base + "\n" + body if body.split()[1].upper() == "AS" else base.rstrip(",") + "\n" + body)


def _out(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Dates as text and doubles rounded, so that engines compare alike."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        cols.append((c.cast("string") if kind == "date" else F.round(c, digits) + F.lit(0.0) if kind == "double" else c.cast("long") if kind in ("int", "smallint") else c).alias(name))
    return df.select(*cols)


class Panel:
    """What most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str, freq: str = "month"):
        # Lines and orders are read once; bars are a few thousand rows at any scale, and all else starts from them.
        self.bars = stored(source.bars(spark, sf_dir, freq), "bars")
        self.sectors = source.sectors(spark, sf_dir)
        self.dense = returns.densify(self.bars)
        self.cal = calendars.calendar(self.bars)

    @property
    def equal(self) -> Column:
        """The weight of each asset in an equal portfolio of all of them."""
        return F.lit(1.0 / max(self.bars.select("asset").distinct().count(), 1))

    @property
    def rets(self) -> DataFrame:
        return returns.arithmetic(self.dense)

    @property
    def compo(self) -> DataFrame:
        return source.compositions(self.bars)

    @property
    def bench(self) -> DataFrame:
        return calendars.as_of(self.cal.select("date"), self.compo, [])

    @property
    def series(self) -> DataFrame:
        port = evaluate.weighted_return(self.rets, None, "port_ret")
        return port.join(evaluate.weighted_return(self.rets, self.bench.select("date", "asset", "weight"), "bench_ret"), "date")

    @property
    def quarter_starts(self) -> DataFrame:
        """The first bar of each quarter that has a composition, with its weights: the benchmark's targets."""
        first = calendars.snap(self.compo.select(F.col("eff_date").alias("date")), self.cal, "right").filter("snapped IS NOT NULL")
        return self.compo.join(first.withColumnRenamed("date", "eff_date"), "eff_date").select(F.col("snapped").alias("rebal_date"), "asset", "weight")

    def window(self, length: int, lag: int = 0) -> DataFrame:
        at = self.quarter_starts.select("rebal_date").distinct()
        return covariance.windows(self.rets, self.cal, at, length, lag)


_D = "date::VARCHAR AS date"
_TARGETS = "targets AS (SELECT (SELECT min(date) FROM cal WHERE date >= eff_date) AS rebal_date, asset, weight FROM compo), tg AS (SELECT * FROM targets WHERE rebal_date IS NOT NULL),"


@query(_sql(f"SELECT {_D}, asset, round(price, 6) AS price, round(revenue, 2) AS revenue FROM bars"))
def panel_monthly_vwap(spark, sf_dir):
    df = source.bars(spark, sf_dir)
    return df.select(F.col("date").cast("string").alias("date"), "asset", F.round("price", 6).alias("price"), F.round("revenue", 2).alias("revenue"))


@query(_sql(f"SELECT {_D}, asset, round(ret, 6) + 0 AS ret FROM rets"))
def returns_arithmetic_ffill(spark, sf_dir):
    return _out(Panel(spark, sf_dir).rets)


@query(_sql(f"SELECT {_D}, asset, round(CASE WHEN price > 0 AND prev > 0 THEN ln(price / prev) END, 6) + 0 AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY asset ORDER BY date) AS prev FROM grid)"))
def returns_log_masked(spark, sf_dir):
    return _out(returns.logarithmic(Panel(spark, sf_dir).dense))


@query(_sql(f"""z AS (SELECT *, avg(CASE WHEN coalesce(abs(ret), 0) <= 0.005 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY date) AS a FROM rets),
y AS (SELECT *, avg(CASE WHEN coalesce(abs(ret), 0) <= 0.005 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY asset) AS b FROM z WHERE a < 0.975)
SELECT {_D}, asset, round(ret, 6) + 0 AS ret FROM y WHERE b < 0.975"""))  # fmt: skip
def clean_zero_ratio(spark, sf_dir):
    return _out(returns.drop_mostly_zero(Panel(spark, sf_dir).rets, 0.975, 0.005))


@query(_sql(f"""d AS (SELECT date FROM rets GROUP BY date HAVING max(abs(ret)) > 0), r AS (SELECT * FROM rets WHERE date IN (SELECT date FROM d))
SELECT {_D}, asset, round(ret, 6) + 0 AS ret FROM r WHERE asset IN (SELECT asset FROM r GROUP BY asset HAVING max(abs(ret)) > 0)"""))  # fmt: skip
def clean_all_zero(spark, sf_dir):
    return _out(returns.drop_all_zero(Panel(spark, sf_dir).rets))


_FRI = "(d - 1 + ((5 - dayofweek(d - 1) + 6) % 7 + 1)::INT)"


@query(_sql(f"""r AS (SELECT date::DATE AS d, asset, ret FROM rets)
SELECT {_FRI}::DATE::VARCHAR AS date, asset, round(product(1 + coalesce(ret, 0)) - 1, 6) AS ret FROM r GROUP BY 1, 2""", "day"))  # fmt: skip
def resample_weekly_compound(spark, sf_dir):
    return _out(returns.compound(Panel(spark, sf_dir, "day").rets, returns.week_ending_friday()))


@query(_sql("SELECT asset, count(ret) AS n_obs, count(ret) >= 60 AND count(ret) / (SELECT count(*) FROM cal)::DOUBLE >= 0.95 AS covered FROM rets GROUP BY asset"))
def coverage_mask(spark, sf_dir):
    return returns.coverage(Panel(spark, sf_dir).rets, 0.95, 60)


@query(_sql("""a AS (SELECT date, asset, price FROM bars WHERE date < DATE '1998-06-01'), b AS (SELECT date, asset, price * 2 AS price FROM bars WHERE date >= DATE '1998-01-01')
SELECT date::VARCHAR AS date, asset, round(coalesce(b.price, a.price), 6) AS price FROM a FULL JOIN b USING (date, asset)"""))  # fmt: skip
def prices_union_last_wins(spark, sf_dir):
    bars = source.bars(spark, sf_dir)
    return _out(returns.union_prices(bars.filter("date < DATE '1998-06-01'"), bars.filter("date >= DATE '1998-01-01'").withColumn("price", F.col("price") * 2)))


@query(_sql("SELECT max(date)::VARCHAR AS rebal_date FROM cal GROUP BY last_day(date)", "week"))
def schedule_month_end(spark, sf_dir):
    return _out(calendars.schedule(Panel(spark, sf_dir, "week").cal, "M"))


@query(_sql("SELECT max(date)::VARCHAR AS rebal_date FROM cal GROUP BY date_trunc('quarter', date)", "week"))
def schedule_quarter_end(spark, sf_dir):
    return _out(calendars.schedule(Panel(spark, sf_dir, "week").cal, "Q"))


_ANCHORS = """a AS (SELECT DISTINCT (SELECT min(date) FROM cal WHERE date >= eff_date) AS anchor FROM compo), b AS (SELECT * FROM a WHERE anchor IS NOT NULL),
n AS (SELECT anchor, lead(anchor) OVER (ORDER BY anchor) AS nxt FROM b),
s AS (SELECT anchor, nxt, c2.date AS rebal_date FROM n JOIN cal c ON c.date = anchor JOIN cal c2 ON c2.idx = c.idx + 1),"""


@query(_sql(_ANCHORS.rstrip(",") + " SELECT DISTINCT rebal_date::VARCHAR AS rebal_date FROM s", "week"))
def schedule_anchored_k1(spark, sf_dir):
    p = Panel(spark, sf_dir, "week")
    return _out(calendars.anchored(p.cal, p.compo.select(F.col("eff_date").alias("date")).distinct()))


@query(_sql(_ANCHORS + """e AS (SELECT rebal_date, coalesce(nxt, (SELECT max(date) FROM cal) + 1) AS stop FROM s),
g AS (SELECT rebal_date, stop, unnest(generate_series(date_trunc('month', rebal_date), stop::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS d FROM e),
h AS (SELECT stop, (SELECT min(date) FROM cal WHERE date >= d) AS x FROM g WHERE d > rebal_date AND d < stop)
SELECT DISTINCT rebal_date::VARCHAR AS rebal_date FROM (SELECT rebal_date FROM s UNION SELECT x FROM h WHERE x < stop)""", "week"))  # fmt: skip
def schedule_anchored_monthly(spark, sf_dir):
    p = Panel(spark, sf_dir, "week")
    return _out(calendars.anchored(p.cal, p.compo.select(F.col("eff_date").alias("date")).distinct(), "M"))


@query(_sql("SELECT DISTINCT eff_date::VARCHAR AS date, (SELECT max(date) FROM cal WHERE date <= eff_date)::VARCHAR AS before, coalesce((SELECT min(date) FROM cal WHERE date >= eff_date), (SELECT max(date) FROM cal))::VARCHAR AS after FROM compo", "week"))
def snap_left_right(spark, sf_dir):
    p = Panel(spark, sf_dir, "week")
    d = p.compo.select(F.col("eff_date").alias("date"))
    left = calendars.snap(d, p.cal, "left").withColumnRenamed("snapped", "before")
    return _out(left.join(calendars.snap(d, p.cal, "right", fallback=True).withColumnRenamed("snapped", "after"), "date"))


@query(_sql("SELECT c.date::VARCHAR AS date, c2.date::VARCHAR AS shifted FROM cal c LEFT JOIN cal c2 ON c2.idx = c.idx - 2"))
def trading_shift(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(calendars.shift(p.cal.select("date"), p.cal, -2))


@query(_sql(f"SELECT {_D}, asset, eff_date::VARCHAR AS eff_date, round(weight, 8) AS weight FROM bench"))
def asof_benchmark_weights(spark, sf_dir):
    return _out(Panel(spark, sf_dir).bench, 8)


@query(_sql("SELECT date::VARCHAR AS date FROM cal WHERE date NOT IN (SELECT eff_date FROM compo)"))
def asof_exact_missing(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(calendars.missing_as_of(p.cal, p.compo))


@query(_sql("SELECT eff_date::VARCHAR AS eff_date, asset, round(v / sum(v) OVER (PARTITION BY eff_date), 8) AS weight FROM (SELECT date_trunc('quarter', date)::DATE AS eff_date, asset, sum(revenue) AS v FROM bars GROUP BY ALL)"))
def weights_normalise_validate(spark, sf_dir):
    raw = source.bars(spark, sf_dir).select(F.to_date(F.date_trunc("quarter", "date")).alias("eff_date"), "asset", F.col("revenue").alias("weight"))
    return _out(universe.normalise_weights(raw), 8)


_CAPS = "caps AS (SELECT asset, sum(revenue) AS cap FROM bars GROUP BY asset), small AS (SELECT asset FROM caps ORDER BY cap, asset LIMIT 5),"


@query(_sql(_CAPS + "x AS (SELECT asset FROM small UNION SELECT 'FRANCE') SELECT asset FROM x WHERE asset IN (SELECT asset FROM bars)"))
def exclusion_smallcap_pct(spark, sf_dir):
    bars = source.bars(spark, sf_dir)
    caps = bars.groupBy("asset").agg(F.sum("revenue").alias("cap"))
    named = spark.createDataFrame([("FRANCE",), ("NOWHERE",)], "asset string")
    return universe.exclusions(bars.select("asset").distinct(), caps, 0.2, named)


@query(_sql(_CAPS + "k AS (SELECT * FROM bars WHERE asset NOT IN (SELECT asset FROM small)) SELECT date::VARCHAR AS date, count(*) AS n, round(sum(price), 6) AS total FROM k GROUP BY date"))
def universe_anti_join(spark, sf_dir):
    bars = source.bars(spark, sf_dir)
    caps = bars.groupBy("asset").agg(F.sum("revenue").alias("cap"))
    left = universe.keep_only(bars, universe.exclusions(bars.select("asset").distinct(), caps, 0.2))
    return _out(left.groupBy("date").agg(F.count("*").alias("n"), F.sum("price").alias("total")))


@query("""
WITH m AS (SELECT o_orderdate::DATE AS date, o_orderpriority AS ticker, o_custkey AS id_global FROM orders),
l AS (SELECT id_global, arg_max(ticker, date::VARCHAR || ticker) AS t FROM m WHERE date <= DATE '1998-12-31' GROUP BY 1),
a AS (SELECT id_global, arg_max(ticker, date::VARCHAR || ticker) AS t FROM m GROUP BY 1)
SELECT c_custkey::VARCHAR AS id_global, coalesce(l.t, a.t, c_custkey::VARCHAR) AS asset FROM customer LEFT JOIN l ON l.id_global = c_custkey LEFT JOIN a ON a.id_global = c_custkey
""")
def id_mapping_asof(spark, sf_dir):
    mapping = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("ticker"), F.col("o_custkey").cast("string").alias("id_global"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id_global"))
    return universe.remap(rows, mapping, __import__("datetime").date(1998, 12, 31)).select("id_global", "asset")


@query(_sql(f"SELECT {_D}, round(product(1 + port_ret) OVER w, 6) AS nav, round(product(1 + bench_ret) OVER w, 6) AS bench_nav FROM series WINDOW w AS (ORDER BY date)"))
def nav_cumprod(spark, sf_dir):
    s = Panel(spark, sf_dir).series
    return _out(evaluate.nav(evaluate.nav(s, "port_ret"), "bench_ret", name="bench_nav").select("date", "nav", "bench_nav"))


@query(_sql(f"SELECT {_D}, round(CASE WHEN count(active) OVER w >= 12 THEN stddev_samp(active) OVER w * sqrt(12) END, 6) AS te FROM act WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"))
def rolling_te(spark, sf_dir):
    return _out(evaluate.rolling_te(Panel(spark, sf_dir).series, 12, ANN).select("date", "te"))


@query(_sql(f"SELECT {_D}, round(CASE WHEN count(active) OVER w >= 5 THEN stddev_samp(active) OVER w * sqrt(12) END, 6) AS te FROM act WINDOW w AS (ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"))
def expanding_te_min5(spark, sf_dir):
    return _out(evaluate.rolling_te(Panel(spark, sf_dir).series, 24, ANN, least=5).select("date", "te"))


@query(_sql(f"SELECT {_D}, round(last_value(CASE WHEN month(date) % 3 = 1 THEN active END IGNORE NULLS) OVER (ORDER BY date), 6) AS metric FROM act"))
def metric_forward_fill(spark, sf_dir):
    s = Panel(spark, sf_dir).series.withColumn("metric", F.when(F.month("date") % 3 == 1, evaluate.active()))
    return _out(evaluate.carry_forward(s, "metric").select("date", "metric"))


@query(_sql(f"c AS (SELECT date, product(1 + active) OVER (ORDER BY date) AS c FROM act) SELECT {_D}, round(c / max(c) OVER (ORDER BY date) - 1, 6) AS drawdown FROM c"))
def drawdown_active(spark, sf_dir):
    return _out(evaluate.drawdown(Panel(spark, sf_dir).series, evaluate.active()).select("date", "drawdown"))


_EXPOST = """SELECT count(*) AS n, round(stddev_samp(active), 6) AS te_daily, round(stddev_samp(active) * sqrt(12), 6) AS te_ann, round(avg(active) * 12, 6) AS active_mean_ann, round(avg(active * active), 6) AS mse,
round(avg(abs(active)), 6) AS mae, round(product(1 + bench_ret), 6) AS bench_cum, round(product(1 + port_ret), 6) AS port_cum, round(avg(active) * 12 / nullif(stddev_samp(active) * sqrt(12), 0), 6) AS information_ratio,
round(product(1 + port_ret) / nullif(product(1 + bench_ret), 0) - 1, 6) AS rel_cum FROM act"""


@query(_sql(_EXPOST))
def expost_metrics(spark, sf_dir):
    return _out(evaluate.expost_metrics(Panel(spark, sf_dir).series, ANN))


@query(_sql("SELECT count(*) AS n, round(avg(active * active), 6) AS te_mse, round(avg(abs(active)), 6) AS te_mae, round(sqrt(avg(active * active)), 6) AS te_vol, round(sqrt(avg(active * active)) * sqrt(12), 6) AS te_ann FROM act"))
def te_rms_metrics(spark, sf_dir):
    return _out(evaluate.te_metrics(Panel(spark, sf_dir).series, ANN))


@query(_sql("""y AS (SELECT year(date) AS year, * FROM act), m AS (SELECT year, count(*) AS n, product(1 + port_ret) - product(1 + bench_ret) AS r, stddev_samp(active) * sqrt(12) AS te, date_diff('day', min(date), max(date)) / 365.25 AS d FROM y GROUP BY year
UNION ALL SELECT 0, count(*), product(1 + port_ret) - product(1 + bench_ret), stddev_samp(active) * sqrt(12), date_diff('day', min(date), max(date)) / 365.25 FROM y)
SELECT year, n, round(r, 6) AS active_return, round(te, 6) AS te, round(r / nullif(te, 0), 6) AS ir, round(r / nullif(d, 0), 6) AS active_return_ann FROM m"""))  # fmt: skip
def yearly_ar_te_ir(spark, sf_dir):
    return _out(evaluate.yearly(Panel(spark, sf_dir).series, ANN))


_SUMMARY = """y AS (SELECT year(date) AS year, * FROM act), c AS (SELECT date, product(1 + active) OVER (ORDER BY date) AS c FROM act), d AS (SELECT min(x) AS dd FROM (SELECT c / max(c) OVER (ORDER BY date) - 1 AS x FROM c)),
z AS (SELECT stddev_samp(te) AS stab, min(r) AS worst, max(r) AS best FROM (SELECT CASE WHEN count(active) > 5 THEN stddev_samp(active) * sqrt(12) END AS te, product(1 + active) - 1 AS r FROM y GROUP BY year)),
mu AS (SELECT avg(active) AS m, var_pop(active) AS v FROM act)
SELECT round(stddev_samp(active), 6) AS te_daily, round(stddev_samp(active) * sqrt(12), 6) AS te_ann, round(avg(active) * 12, 6) AS active_mean_ann, round(product(1 + port_ret) - 1, 6) AS port_cum, round(product(1 + bench_ret) - 1, 6) AS bench_cum,
round((SELECT dd FROM d), 6) AS max_dd_active, round(avg(power(active - m, 3)) / power(min(v), 1.5), 6) AS skewness_active, round(avg(power(active - m, 4)) / power(min(v), 2) - 3, 6) AS kurtosis_active,
round(CASE WHEN count(*) FILTER (bench_ret < 0) > 5 THEN stddev_samp(active) FILTER (bench_ret < 0) * sqrt(12) END, 6) AS te_ann_bear, round(CASE WHEN count(*) FILTER (bench_ret >= 0) > 5 THEN stddev_samp(active) FILTER (bench_ret >= 0) * sqrt(12) END, 6) AS te_ann_bull,
round(avg(active) * 12 / nullif(stddev_samp(active) * sqrt(12), 0), 6) AS information_ratio, round(product(1 + port_ret) - product(1 + bench_ret), 6) AS rel_cum_vs_bench,
round((SELECT stab FROM z), 6) AS te_stability, round((SELECT worst FROM z), 6) AS worst_year_active, round((SELECT best FROM z), 6) AS best_year_active FROM act, mu"""


@query(_sql(_SUMMARY))
def scenario_summary(spark, sf_dir):
    return _out(evaluate.scenario_summary(Panel(spark, sf_dir).series, ANN))


@query(_sql("""t AS (SELECT date, active, port_ret, bench_ret, year(date) AS year, CASE WHEN count(active) OVER w >= 12 THEN stddev_samp(active) OVER w * sqrt(12) END AS te FROM act WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, product(1 + active) OVER (PARTITION BY year ORDER BY date) AS c FROM t), d AS (SELECT *, c / max(c) OVER (PARTITION BY year ORDER BY date) - 1 AS dd FROM c)
SELECT year, round(product(1 + port_ret) - 1, 6) AS port_return, round(product(1 + bench_ret) - 1, 6) AS bench_return, round(product(1 + active) - 1, 6) AS active_return, round(stddev_samp(te) * sqrt(12), 6) AS te_expost,
round(stddev_samp(active) * sqrt(12), 6) AS te_year, round(min(dd), 6) AS max_dd_active_yr, round(CASE WHEN count(active) > 2 THEN skewness(active) END, 4) AS skewness_active_yr, round(CASE WHEN count(active) > 3 THEN kurtosis(active) END, 4) AS kurtosis_active_yr FROM d GROUP BY year"""))  # fmt: skip
def yearly_series_rows(spark, sf_dir):
    out = _out(evaluate.yearly_series(Panel(spark, sf_dir).series, ANN, 12))
    return out.withColumns({c: F.round(c, 4) for c in ("skewness_active_yr", "kurtosis_active_yr")})


_DRIFT = _TARGETS + """sp AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS until FROM (SELECT DISTINCT rebal_date FROM tg)),
g AS (SELECT r.date, t.asset, t.rebal_date AS segment, coalesce(r.ret, 0) AS ret, t.weight * product(1 + coalesce(r.ret, 0)) OVER (PARTITION BY t.rebal_date, t.asset ORDER BY r.date) AS g
  FROM tg t JOIN sp USING (rebal_date) JOIN rets r ON r.asset = t.asset AND r.date > t.rebal_date AND (until IS NULL OR r.date <= until)),
path AS (SELECT date, asset, segment, ret, g / (1 + ret) / sum(g / (1 + ret)) OVER (PARTITION BY date) AS w_in_force, g / sum(g) OVER (PARTITION BY date) AS w_close FROM g),"""


@query(_sql(_DRIFT.rstrip(",") + " SELECT date::VARCHAR AS date, asset, segment::VARCHAR AS segment, round(ret, 6) + 0 AS ret, round(w_in_force, 6) AS w_in_force, round(w_close, 6) AS w_close FROM path"))
def benchmark_drift(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(drift.drift(p.rets, p.quarter_starts))


@query(_sql(_DRIFT + """q AS (SELECT date, sum(w_in_force * ret) AS bench_ret FROM path GROUP BY date), e AS (SELECT date, avg(coalesce(ret, 0)) AS port_ret FROM rets GROUP BY date)
SELECT date::VARCHAR AS date, round(port_ret, 6) AS port_ret, round(bench_ret, 6) AS bench_ret FROM q JOIN e USING (date)"""))  # fmt: skip
def portfolio_drift_segments(spark, sf_dir):
    p = Panel(spark, sf_dir)
    bench = drift.path_return(drift.drift(p.rets, p.quarter_starts), "bench_ret")
    port = p.rets.groupBy("date").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("port_ret"))
    return _out(port.join(bench, "date").select("date", "port_ret", "bench_ret"))


_TURN = """x AS (SELECT date, asset, weight AS w FROM bench UNION ALL SELECT nxt, asset, -weight FROM bench JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM bench)) USING (date) WHERE nxt IS NOT NULL),
t AS (SELECT date, sum(abs(d)) / 2 AS turnover FROM (SELECT date, asset, sum(w) AS d FROM x GROUP BY ALL) GROUP BY date HAVING date > (SELECT min(date) FROM bench))"""


@query(_sql(_TURN + " SELECT date::VARCHAR AS date, round(turnover, 6) AS turnover FROM t"))
def turnover_half_l1(spark, sf_dir):
    return _out(evaluate.turnover(Panel(spark, sf_dir).bench.select("date", "asset", "weight")))


@query(_sql(_TURN + " SELECT round(avg(turnover) * 12, 6) AS turnover_ann FROM t WHERE turnover > 1e-6"))
def turnover_annualised(spark, sf_dir):
    return _out(evaluate.turnover(Panel(spark, sf_dir).bench.select("date", "asset", "weight"), ann=ANN))


@query(_sql(_DRIFT + """x AS (SELECT date, asset, -w_close AS w FROM path UNION ALL SELECT rebal_date, asset, weight FROM tg),
d AS (SELECT date, asset, abs(sum(w)) AS d FROM x WHERE date IN (SELECT rebal_date FROM tg) AND date IN (SELECT date FROM path) GROUP BY ALL)
SELECT date::VARCHAR AS date, round(sum(d) * 10 / 1e4 + 0.0001, 8) AS cost FROM d GROUP BY date"""))  # fmt: skip
def transaction_cost(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(drift.cost_fraction(drift.drift(p.rets, p.quarter_starts), p.quarter_starts, 10, 0.0001), 8)


_WIN = _TARGETS + """ats AS (SELECT DISTINCT rebal_date, idx AS e FROM tg JOIN cal ON cal.date = rebal_date), win AS (SELECT rebal_date, r.date, asset, coalesce(ret, 0) AS ret, c.idx - e + 24 AS t
  FROM ats JOIN cal c ON c.idx BETWEEN e - 23 AND e JOIN rets r ON r.date = c.date WHERE e >= 23),
wa AS (SELECT * FROM win WHERE (rebal_date, asset) IN (SELECT (rebal_date, asset) FROM win GROUP BY rebal_date, asset HAVING max(abs(ret)) > 0)),
pr AS (SELECT x.rebal_date, x.date, x.asset AS i, y.asset AS j, x.ret AS ri, y.ret AS rj FROM wa x JOIN wa y ON x.rebal_date = y.rebal_date AND x.date = y.date AND x.asset <= y.asset),
roll AS (SELECT rebal_date, i, j, covar_samp(ri, rj) AS cov FROM pr GROUP BY ALL),
"""


@query(_sql(_WIN.rstrip().rstrip(",") + " SELECT rebal_date::VARCHAR AS rebal_date, i, j, round(cov, 8) AS cov FROM roll"))
def cov_rolling_pairs(spark, sf_dir):
    return _out(covariance.rolling(Panel(spark, sf_dir).window(24), ["rebal_date"]), 8)


@query(_sql("""r AS (SELECT date, asset, coalesce(ret, 0) AS ret, idx, (SELECT max(idx) FROM cal) AS last, sum(CASE WHEN coalesce(ret, 0) <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY date) AS busy FROM rets JOIN cal USING (date)),
p AS (SELECT x.asset AS i, y.asset AS j, x.ret AS ri, y.ret AS rj, x.idx, x.last, x.busy FROM r x JOIN r y ON x.date = y.date AND x.asset <= y.asset)
SELECT i, j, round(power(0.94, max(last) - 24 + 1) * covar_samp(ri, rj) FILTER (idx < 24) + 0.06 * sum(CASE WHEN idx >= 24 AND busy >= 2 THEN power(0.94, last - idx) * ri * rj ELSE 0 END), 8) AS cov FROM p GROUP BY i, j"""))  # fmt: skip
def cov_ewma_closed_form(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(covariance.ewma(p.rets, p.cal, 0.94, 24), 8)


_SHRINK = _WIN + """ce AS (SELECT *, ret - avg(ret) OVER (PARTITION BY rebal_date, asset) AS c FROM wa), x4 AS (SELECT rebal_date, sum(q * q) AS x4, count(*) AS n FROM (SELECT rebal_date, date, sum(c * c) AS q FROM ce GROUP BY ALL) GROUP BY rebal_date),
s AS (SELECT rebal_date, i, j, covar_pop(ri, rj) AS s FROM pr GROUP BY ALL),
w AS (SELECT rebal_date, count(*) FILTER (i = j) AS p, avg(s) FILTER (i = j) AS m, sum(s * s * CASE WHEN i = j THEN 1 ELSE 2 END) AS ss FROM s GROUP BY rebal_date),
"""


@query(_sql(_SHRINK + """k AS (SELECT *, ss - p * m * m AS d2, greatest((x4 - n * ss) / (n * n), 0) AS b2 FROM w JOIN x4 USING (rebal_date)), h AS (SELECT *, CASE WHEN d2 <= 1e-24 THEN 1 ELSE greatest(least(b2 / d2, 1), 0) END AS rho FROM k)
SELECT rebal_date::VARCHAR AS rebal_date, i, j, round(rho * CASE WHEN i = j THEN m ELSE 0 END + (1 - rho) * s, 8) AS cov, round(rho, 8) AS rho FROM s JOIN h USING (rebal_date)"""))  # fmt: skip
def cov_lw2004(spark, sf_dir):
    return _out(covariance.ledoit_wolf(Panel(spark, sf_dir).window(24), ["rebal_date"]), 8)


@query(_sql(_SHRINK + """k AS (SELECT *, ss / (p * p) AS alpha FROM w JOIN x4 USING (rebal_date)), h AS (SELECT *, CASE WHEN (n + 1) * (alpha - m * m / p) <= 0 THEN 1 ELSE least(1, (alpha + m * m) / ((n + 1) * (alpha - m * m / p))) END AS rho FROM k)
SELECT rebal_date::VARCHAR AS rebal_date, i, j, round(rho * CASE WHEN i = j THEN m ELSE 0 END + (1 - rho) * s, 8) AS cov, round(rho, 8) AS rho FROM s JOIN h USING (rebal_date)"""))  # fmt: skip
def cov_oas(spark, sf_dir):
    return _out(covariance.oas(Panel(spark, sf_dir).window(24), ["rebal_date"]), 8)


@query(_sql("SELECT asset, round(covar_samp(ret, bench_ret), 8) AS cov_ib FROM rets JOIN series USING (date) WHERE ret IS NOT NULL GROUP BY asset HAVING count(*) >= 10"))
def cov_asset_benchmark(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(covariance.with_benchmark(p.rets, p.series.select("date", "bench_ret")), 8)


_ANTE = _WIN + """av AS (SELECT rebal_date, asset, 1.0 / (SELECT count(DISTINCT asset) FROM bars) - weight AS a FROM tg),
ante AS (SELECT rebal_date, sum(CASE WHEN i = j THEN 1 ELSE 2 END * x.a * y.a * cov) AS variance FROM roll JOIN av x USING (rebal_date) JOIN av y USING (rebal_date) WHERE x.asset = i AND y.asset = j GROUP BY rebal_date),
"""


@query(_sql(_ANTE.rstrip().rstrip(",") + " SELECT rebal_date::VARCHAR AS rebal_date, round(sqrt(variance) * sqrt(12), 6) AS te_ante FROM ante"))
def te_ex_ante_quadratic(spark, sf_dir):
    p = Panel(spark, sf_dir)
    a = p.quarter_starts.select("rebal_date", "asset", (p.equal - F.col("weight")).alias("a"))
    v = covariance.quadratic(covariance.rolling(p.window(24), ["rebal_date"]), a, ["rebal_date"])
    return _out(v.select("rebal_date", (F.sqrt("variance") * F.sqrt(F.lit(12.0))).alias("te_ante")))


@query(_sql(_SHRINK + """k AS (SELECT *, ss - p * m * m AS d2, greatest((x4 - n * ss) / (n * n), 0) AS b2 FROM w JOIN x4 USING (rebal_date)), h AS (SELECT *, CASE WHEN d2 <= 1e-24 THEN 1 ELSE greatest(least(b2 / d2, 1), 0) END AS rho FROM k),
lw AS (SELECT rebal_date, i, j, rho * CASE WHEN i = j THEN m ELSE 0 END + (1 - rho) * s AS cov FROM s JOIN h USING (rebal_date))
SELECT rebal_date::VARCHAR AS rebal_date, round(sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * power(roll.cov - lw.cov, 2))), 8) AS frobenius FROM roll JOIN lw USING (rebal_date, i, j) GROUP BY rebal_date"""))  # fmt: skip
def frobenius_loss(spark, sf_dir):
    w = Panel(spark, sf_dir).window(24)
    return _out(covariance.frobenius(covariance.rolling(w, ["rebal_date"]), covariance.ledoit_wolf(w, ["rebal_date"]), ["rebal_date"]), 8)


def _redistribution(mode: str) -> str:
    prop = mode.endswith("prop")
    score = "weight" if prop else "1 / weight"
    share = (
        "s / sum(s) OVER (PARTITION BY date)"
        if mode.startswith("global")
        else "CASE WHEN ts > 0 THEN (own / live) * s / ts ELSE 0 END"
    )
    return _sql(
        _CAPS
        + f"""r AS (SELECT date, asset, sector, weight, asset IN (SELECT asset FROM small) OR weight <= 0 AS x FROM bench JOIN sectors USING (asset)),
f AS (SELECT *, NOT x AND weight >= 0.05 AS f FROM r), v AS (SELECT *, CASE WHEN NOT x AND NOT f THEN {score} ELSE 0 END AS s, CASE WHEN f THEN weight ELSE 0 END AS fw FROM f),
b AS (SELECT *, sum(weight) OVER (PARTITION BY date) - sum(fw) OVER (PARTITION BY date) AS budget, sum(weight) OVER (PARTITION BY date, sector) - sum(fw) OVER (PARTITION BY date, sector) AS own, sum(s) OVER (PARTITION BY date, sector) AS ts FROM v),
c AS (SELECT *, sum(CASE WHEN ts > 0 THEN weight - fw ELSE 0 END) OVER (PARTITION BY date) AS live FROM b)
SELECT date::VARCHAR AS date, asset, round(CASE WHEN f THEN weight ELSE coalesce(budget * {share}, 0) END, 6) AS weight FROM c"""
    )


def _redistribute(spark, sf_dir, mode):
    p = Panel(spark, sf_dir)
    caps = p.bars.groupBy("asset").agg(F.sum("revenue").alias("cap"))
    small = universe.exclusions(caps.select("asset"), caps, 0.2)
    bench = p.bench.select("date", "asset", "weight").join(F.broadcast(p.sectors), "asset")
    return _out(allocation.redistribute(bench, small, mode, threshold=0.05))


for _mode in allocation.MODES:

    def _f(spark, sf_dir, mode=_mode):
        return _redistribute(spark, sf_dir, mode)

    _f.__name__ = f"redistribute_{_mode}"
    query(_redistribution(_mode))(_f)


@query(_sql(_WIN + """v AS (SELECT rebal_date, asset, sector, nullif(stddev_samp(ret), 0) AS v FROM win JOIN sectors USING (asset) GROUP BY ALL),
s AS (SELECT *, 1 / avg(v) OVER (PARTITION BY rebal_date, sector) AS s, 1 / greatest(v, 1e-6) AS a, row_number() OVER (PARTITION BY rebal_date, sector ORDER BY asset) AS k FROM v)
SELECT rebal_date::VARCHAR AS rebal_date, asset, round(s / sum(CASE WHEN k = 1 THEN s END) OVER (PARTITION BY rebal_date) * a / sum(a) OVER (PARTITION BY rebal_date, sector), 6) AS weight FROM s"""))  # fmt: skip
def inverse_vol_hierarchical(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(allocation.inverse_volatility(p.window(24), p.sectors, ["rebal_date"]))


@query(_sql("SELECT date::VARCHAR AS date, asset, round((0.7 * weight + 0.3 / (SELECT count(DISTINCT asset) FROM bars)) / sum(0.7 * weight + 0.3 / (SELECT count(DISTINCT asset) FROM bars)) OVER (PARTITION BY date), 6) AS weight FROM bench"))
def core_satellite_blend(spark, sf_dir):
    p = Panel(spark, sf_dir)
    bench = p.bench.select("date", "asset", "weight")
    return _out(allocation.blend(bench, bench.withColumn("weight", p.equal), 0.7))


_SHARES = """tgt AS (SELECT date, asset, weight, price FROM bench JOIN filled USING (date, asset)), w1 AS (SELECT *, CASE WHEN weight >= 0.02 AND price > 0 THEN weight ELSE 0 END AS w FROM tgt),
w2 AS (SELECT *, coalesce(w / nullif(sum(w) OVER (PARTITION BY date), 0), 0) AS v FROM w1), n1 AS (SELECT *, CASE WHEN v * 980000.0 >= 20000 THEN v * 980000.0 ELSE 0 END AS n FROM w2),
n2 AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY date), 0), 0) * 980000.0 AS m FROM n1), sh AS (SELECT date, asset, price, greatest(floor(m / price), 0) AS shares FROM n2),"""


def _shares(p: Panel) -> DataFrame:
    targets = p.bench.select("date", "asset", "weight").join(returns.forward_fill(p.dense).select("date", "asset", "price"), ["date", "asset"])
    return execution.to_shares(targets, 1_000_000.0, reserve=0.02, min_weight=0.02, min_notional=20_000.0)


@query(_sql(_SHARES.rstrip(",") + " SELECT date::VARCHAR AS date, asset, round(price, 6) AS price, shares, round(1000000.0 - sum(shares * price) OVER (PARTITION BY date), 2) AS cash FROM sh"))
def weights_to_shares(spark, sf_dir):
    out = _shares(Panel(spark, sf_dir))
    return out.select(F.col("date").cast("string").alias("date"), "asset", F.round("price", 6).alias("price"), "shares", F.round("cash", 2).alias("cash"))


@query(_sql(_SHARES + """nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM sh)), cur AS (SELECT nxt AS date, asset, shares AS c FROM sh JOIN nx USING (date) WHERE nxt IS NOT NULL),
d AS (SELECT date, asset, price, shares - coalesce(c, 0) AS d FROM sh LEFT JOIN cur USING (date, asset)), e AS (SELECT *, sum(greatest(d, 0) * price) OVER w AS buys, sum(greatest(-d, 0) * price) OVER w AS sales FROM d WHERE d <> 0 AND abs(d * price) >= 500 WINDOW w AS (PARTITION BY date)),
k AS (SELECT *, least(1, greatest(0, coalesce((1000 + sales) / nullif(buys, 0), 1))) AS k FROM e), q AS (SELECT *, CASE WHEN d > 0 AND k < 1 THEN floor(d * k) ELSE d END AS qty FROM k)
SELECT date::VARCHAR AS date, asset, qty AS qty_delta, round(price, 6) AS price, round(qty * price, 4) AS notional, CASE WHEN qty > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM q WHERE qty <> 0"""))  # fmt: skip
def execute_orders(spark, sf_dir):
    target = _shares(Panel(spark, sf_dir))
    dates = target.select("date").distinct().withColumn("nxt", F.lead("date").over(Window.orderBy("date")))
    current = target.join(dates, "date").filter("nxt IS NOT NULL").select(F.col("nxt").alias("date"), "asset", "shares")
    cash = dates.select("date", F.lit(1000.0).alias("cash"))
    out = execution.orders(current, target.select("date", "asset", "price", "shares"), cash, min_notional=500.0)
    return out.select(F.col("date").cast("string").alias("date"), "asset", "qty_delta", F.round("price", 6).alias("price"), F.round("notional", 4).alias("notional"), "side")


_POST = """ps AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS u2 FROM (SELECT DISTINCT rebal_date FROM tg)),
post AS (SELECT rebal_date, count(active) AS n, CASE WHEN count(active) >= 5 THEN var_samp(active) ELSE power(product(1 + active) - 1, 2) / count(active) END AS var_post FROM ps JOIN act ON act.date >= rebal_date AND (u2 IS NULL OR act.date < u2) GROUP BY rebal_date)"""


@query(_sql(_ANTE + _POST + """, x AS (SELECT *, variance / nullif(var_post, 0) AS ratio FROM ante JOIN post USING (rebal_date))
SELECT count(*) AS n, round(avg(ratio), 4) AS mean_ratio, round(stddev_samp(ratio), 4) AS std_ratio, round(avg(CASE WHEN ratio < 1 THEN 1.0 ELSE 0.0 END), 6) AS below, round(avg(CASE WHEN ratio > 1 THEN 1.0 ELSE 0.0 END), 6) AS above, round(avg(variance - var_post) * 12, 8) AS bias_ann FROM x WHERE ratio IS NOT NULL"""))  # fmt: skip
def variance_calibration(spark, sf_dir):
    p = Panel(spark, sf_dir)
    at = p.quarter_starts
    a = at.select("rebal_date", "asset", (p.equal - F.col("weight")).alias("a"))
    ante = covariance.quadratic(covariance.rolling(p.window(24), ["rebal_date"]), a, ["rebal_date"]).withColumnRenamed("variance", "var_ante")
    post = reports.realised_variance(p.series.withColumn("active", evaluate.active()), at.select("rebal_date"), "active")
    out = reports.calibration(ante, post, ANN)
    return out.select("n", F.round("mean_ratio", 4).alias("mean_ratio"), F.round("std_ratio", 4).alias("std_ratio"), F.round("below", 6).alias("below"), F.round("above", 6).alias("above"), F.round("bias_ann", 8).alias("bias_ann"))


_SECTOR = """pa AS (SELECT date, asset, 1.0 / (SELECT count(DISTINCT asset) FROM bars) AS wp, weight AS wb FROM bench), sd AS (SELECT date, sector, sum(wp) AS wp, sum(wb) AS wb, coalesce(sum(wp * coalesce(ret, 0)) / nullif(sum(wp), 0), 0) AS rp, coalesce(sum(wb * coalesce(ret, 0)) / nullif(sum(wb), 0), 0) AS rb
  FROM pa JOIN rets USING (date, asset) JOIN sectors USING (asset) GROUP BY ALL),"""


def _paths(p: Panel) -> DataFrame:
    return p.bench.select("date", "asset", p.equal.alias("wp"), F.col("weight").alias("wb"))


@query(_sql(_SECTOR + """bs AS (SELECT sector, avg(wp) AS w_port, avg(wb) AS w_bench, product(1 + rp) - 1 AS r_port, product(1 + rb) - 1 AS r_bench FROM sd GROUP BY sector), cs AS (SELECT *, w_port * r_port AS c_port, w_bench * r_bench AS c_bench FROM bs),
tt AS (SELECT product(1 + p) - 1 AS r_port, product(1 + b) - 1 AS r_bench FROM (SELECT sum(wp * rp) AS p, sum(wb * rb) AS b FROM sd GROUP BY date)),
al AS (SELECT * FROM cs UNION ALL SELECT 'TOTAL', sum(w_port), sum(w_bench), any_value(tt.r_port), any_value(tt.r_bench), sum(c_port), sum(c_bench) FROM cs, tt)
SELECT sector, round(w_port, 6) AS w_port, round(w_bench, 6) AS w_bench, round(r_port, 6) AS r_port, round(r_bench, 6) AS r_bench, round(c_port, 6) AS c_port, round(c_bench, 6) AS c_bench, round(w_port - w_bench, 6) + 0 AS w_active, round(c_port - c_bench, 6) AS c_active FROM al"""))  # fmt: skip
def sector_attribution(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(reports.sector_attribution(_paths(p), p.rets, p.sectors))


@query(_sql(_SECTOR + """wh AS (SELECT date, sum(wp * rp) AS tp, sum(wb * rb) AS tb FROM sd GROUP BY date),
lk AS (SELECT date, tp, tb, coalesce(product(1 + tp) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * coalesce(product(1 + tb) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS link FROM wh)
SELECT sector, round(sum(link * (wp - wb) * (rb - tb)), 6) AS allocation, round(sum(link * wb * (rp - rb)), 6) AS selection, round(sum(link * (wp - wb) * (rp - rb)), 6) AS interaction FROM sd JOIN lk USING (date) GROUP BY sector"""))  # fmt: skip
def brinson_linked(spark, sf_dir):
    p = Panel(spark, sf_dir)
    return _out(reports.brinson(_paths(p), p.rets, p.sectors))


@query(_sql(_DRIFT + """ats AS (SELECT rebal_date, least(idx + 1, (SELECT max(idx) FROM cal)) AS x FROM (SELECT DISTINCT rebal_date FROM tg) JOIN cal ON cal.date = rebal_date),
fd AS (SELECT rebal_date, max(c.date) AS date FROM ats JOIN cal c ON c.idx <= x WHERE c.date IN (SELECT date FROM path) GROUP BY rebal_date)
SELECT 'portfolio' AS ptf_name, rebal_date::VARCHAR AS rebal_date, asset, round(w_in_force, 6) AS weight FROM path JOIN fd USING (date) WHERE w_in_force <> 0"""))  # fmt: skip
def inventory_snapshot(spark, sf_dir):
    p = Panel(spark, sf_dir)
    path = drift.drift(p.rets, p.quarter_starts).withColumn("weight", F.col("w_in_force"))
    return _out(reports.inventory(path, p.quarter_starts.select("rebal_date"), p.cal))


def _books(p: Panel) -> tuple[DataFrame, DataFrame]:
    """A portfolio of the benchmark's assets above 4 %, scaled to one, and the benchmark."""
    bench = p.quarter_starts
    big = bench.filter("weight > 0.04")
    return big.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("rebal_date"))), bench


_BOOKS = _TARGETS + """pf AS (SELECT rebal_date, asset, weight / sum(weight) OVER (PARTITION BY rebal_date) AS weight FROM tg WHERE weight > 0.04),
aw AS (SELECT rebal_date, asset, coalesce(pf.weight, 0) AS ptf_weight, coalesce(tg.weight, 0) AS bench_weight, coalesce(pf.weight, 0) - coalesce(tg.weight, 0) AS active_weight FROM pf FULL JOIN tg USING (rebal_date, asset)),"""


@query(_sql(_BOOKS.rstrip(",") + " SELECT rebal_date::VARCHAR AS rebal_date, asset, round(ptf_weight, 6) AS ptf_weight, round(bench_weight, 6) AS bench_weight, round(active_weight, 6) AS active_weight FROM aw"))
def active_weights_full_outer(spark, sf_dir):
    return _out(reports.active_weights(*_books(Panel(spark, sf_dir))))


@query(_sql(_BOOKS + """rk AS (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY active_weight DESC, asset) AS o, row_number() OVER (PARTITION BY rebal_date ORDER BY active_weight, asset) AS u, asset || ' ' || printf('%+.2f', active_weight * 100) || '%' AS s FROM aw),
dt AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS nxt FROM (SELECT DISTINCT rebal_date FROM aw)),
mv AS (SELECT rebal_date, asset, ptf_weight AS w FROM aw UNION ALL SELECT nxt, asset, -ptf_weight FROM aw JOIN dt USING (rebal_date) WHERE nxt IS NOT NULL),
tv AS (SELECT rebal_date, sum(abs(d)) / 2 AS turnover FROM (SELECT rebal_date, asset, sum(w) AS d FROM mv GROUP BY ALL) GROUP BY rebal_date HAVING rebal_date > (SELECT min(rebal_date) FROM aw)),
st AS (SELECT rebal_date, count(*) FILTER (ptf_weight > 0) AS n_positions, count(*) FILTER (bench_weight > 0 AND ptf_weight <= 0) AS n_excluded, sum(abs(active_weight)) / 2 AS active_share, sum(ptf_weight) AS sum_ptf, sum(bench_weight) AS sum_bench, sum(ptf_weight * ptf_weight) AS hhi_ptf, sum(bench_weight * bench_weight) AS hhi_bench,
  max(asset) FILTER (o = 1) AS max_over_ticker, max(active_weight) FILTER (o = 1) AS max_over_weight, max(asset) FILTER (u = 1) AS max_under_ticker, max(active_weight) FILTER (u = 1) AS max_under_weight, string_agg(s, ', ' ORDER BY o) FILTER (o <= 3) AS top3_over, string_agg(s, ', ' ORDER BY u) FILTER (u <= 3) AS top3_under FROM rk GROUP BY rebal_date)
SELECT rebal_date::VARCHAR AS rebal_date, n_positions, n_excluded, round(active_share, 6) AS active_share, round(sum_ptf, 6) AS sum_ptf, round(sum_bench, 6) AS sum_bench, round(hhi_ptf, 6) AS hhi_ptf, round(hhi_bench, 6) AS hhi_bench, max_over_ticker, round(max_over_weight, 6) AS max_over_weight,
max_under_ticker, round(max_under_weight, 6) AS max_under_weight, top3_over, top3_under, round(turnover, 6) AS turnover FROM st LEFT JOIN tv USING (rebal_date)"""))  # fmt: skip
def allocation_stats_top3(spark, sf_dir):
    return _out(reports.allocation_stats(reports.active_weights(*_books(Panel(spark, sf_dir)))))


@query(_sql("""m AS (SELECT asset AS model, stddev_samp(ret) AS te, avg(abs(ret)) AS mae, -avg(ret) AS loss FROM rets GROUP BY asset), l AS (UNPIVOT m ON te, mae, loss INTO NAME measure VALUE value), b AS (SELECT measure, arg_min(model, value) AS best FROM l WHERE value IS NOT NULL GROUP BY measure)
SELECT measure, best, count(*) OVER (PARTITION BY best) AS votes FROM b"""))  # fmt: skip
def model_vote(spark, sf_dir):
    m = Panel(spark, sf_dir).rets.groupBy(F.col("asset").alias("model")).agg(F.stddev_samp("ret").alias("te"), F.avg(F.abs("ret")).alias("mae"), (-F.avg("ret")).alias("loss"))
    return evaluate.best_model(m, ["te", "mae", "loss"])
