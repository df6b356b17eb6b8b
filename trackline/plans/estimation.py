"""Registered queries of estimates and their errors: joint moments, projections, quantiles and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.functions import moments, normal
from trackline.plans.registry import query
from trackline.plans.relational import Panel, _out, _sql
from trackline.sources.shared import folder, stored
from trackline.streaming import online, state


@query(_sql("""d AS (SELECT count(DISTINCT date) AS n FROM rets WHERE ret IS NOT NULL), mu AS (SELECT asset, avg(ret) AS m FROM rets GROUP BY asset),
pr AS (SELECT x.asset AS i, y.asset AS j, covar_pop(x.ret, y.ret) AS c, count(*) AS k FROM rets x JOIN rets y ON x.date = y.date AND x.asset <= y.asset WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL)
SELECT i, j, round(a.m, 8) AS mean_i, round(b.m, 8) AS mean_j, round(CASE WHEN k = n THEN c END, 8) AS cov, n FROM pr JOIN mu a ON a.asset = i JOIN mu b ON b.asset = j CROSS JOIN d"""))  # fmt: skip
def moments_joint_mle(spark, sf_dir):
    return _out(moments.joint_mle(Panel(spark, sf_dir).rets), 8)


@query(_sql("""f AS (SELECT date FROM rets GROUP BY date HAVING count(ret) = count(*)), r AS (SELECT rets.* FROM rets SEMI JOIN f USING (date)),
pf AS (SELECT 'all' AS portfolio, asset, 1.0 / count(*) OVER () AS a FROM (SELECT DISTINCT asset FROM bars)
  UNION ALL SELECT sector, asset, 1.0 / count(*) OVER (PARTITION BY sector) FROM sectors SEMI JOIN (SELECT DISTINCT asset FROM bars) USING (asset)
  UNION ALL SELECT 'revenue', asset, sum(revenue) / sum(sum(revenue)) OVER () FROM bars GROUP BY asset),
v AS (SELECT portfolio, date, sum(a * ret) AS x FROM r JOIN pf USING (asset) GROUP BY ALL),
c AS (SELECT p.portfolio AS p, q.portfolio AS q, covar_pop(p.x, q.x) AS c, count(*) AS n FROM v p JOIN v q ON p.date = q.date AND p.portfolio <= q.portfolio GROUP BY ALL),
s AS (SELECT c.*, sqrt((x.c * y.c + c.c * c.c) / c.n) AS se FROM c JOIN c x ON x.p = c.p AND x.q = c.p JOIN c y ON y.p = c.q AND y.q = c.q)
SELECT p, q, round(c, 8) AS covariance, round(se, 8) AS se, round(c - 1.959963984540054 * se, 8) AS low, round(c + 1.959963984540054 * se, 8) AS high, n FROM s"""))  # fmt: skip
def projected_covariance_errors(spark, sf_dir):
    """Portfolios of equal weights, of each sector and by revenue, over the dates on which all assets have a return.

    The SQL takes the covariances of the portfolios' own series instead."""
    p = Panel(spark, sf_dir)
    full = p.rets.groupBy("date").agg(F.count("ret").alias("k"), F.count("*").alias("m")).filter("k = m").select("date")
    cov = stored(moments.joint_mle(p.rets.join(full, "date", "left_semi")), "joint-mle")
    names = p.bars.groupBy("asset").agg(F.sum("revenue").alias("v"))
    total = names.agg(F.sum("v").alias("t"), F.count("*").alias("m"))
    shares = names.crossJoin(F.broadcast(total))
    sector = p.sectors.join(names.select("asset"), "asset", "left_semi")
    size = sector.groupBy("sector").agg(F.count("*").alias("k"))
    held = shares.select(F.lit("all").alias("portfolio"), "asset", (1 / F.col("m")).alias("a"))
    held = held.union(sector.join(size, "sector").select(F.col("sector").alias("portfolio"), "asset", 1 / F.col("k")))
    held = held.union(shares.select(F.lit("revenue").alias("portfolio"), "asset", F.col("v") / F.col("t")))
    return _out(moments.projected_covariances(cov, held, F.col("n")), 8)


@query(_sql(f"""x AS (SELECT ret, row_number() OVER (ORDER BY ret) AS rank, count(*) OVER () AS n FROM rets WHERE ret IS NOT NULL), t AS (SELECT *, (rank - 0.5) / n AS p FROM x),
q AS (SELECT rank, {normal.ppf("p")} AS z, ret FROM t), l AS (SELECT regr_slope(ret, z) AS b, regr_intercept(ret, z) AS a FROM q)
SELECT rank, round(z, 8) AS theoretical, round(ret, 8) AS empirical, round(a + b * z, 8) AS fitted FROM q CROSS JOIN l"""))
def qq_all_returns(spark, sf_dir):
    return _out(moments.qq_points(Panel(spark, sf_dir).rets, "ret"), 8)


@query(_sql(f"""x AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ret) AS rank, count(*) OVER (PARTITION BY asset) AS n FROM rets WHERE ret IS NOT NULL), t AS (SELECT *, (rank - 0.5) / n AS p FROM x),
q AS (SELECT asset, rank, {normal.ppf("p")} AS z, ret FROM t), l AS (SELECT asset, regr_slope(ret, z) AS b, regr_intercept(ret, z) AS a FROM q GROUP BY asset)
SELECT asset, rank, round(z, 8) AS theoretical, round(ret, 8) AS empirical, round(a + b * z, 8) AS fitted FROM q JOIN l USING (asset)"""))
def qq_by_asset(spark, sf_dir):
    return _out(moments.qq_points(Panel(spark, sf_dir).rets, "ret", ["asset"]), 8)


@query(_sql(f"""m AS (SELECT asset, avg(ret) AS mean, stddev_samp(ret) / sqrt(count(ret)) AS se FROM rets GROUP BY asset), t AS (SELECT *, mean / se AS z FROM m)
SELECT asset, round(mean, 6) AS mean, round(se, 6) AS se, round(z, 6) AS z, round(2 * (1 - {normal.cdf("abs(z)")}), 6) AS p FROM t"""))
def mean_pvalues(spark, sf_dir):
    return _out(moments.mean_test(Panel(spark, sf_dir).rets, "ret", ["asset"]))


@query(_sql("""x AS (SELECT idx, asset, coalesce(ret, 0) AS r FROM rets JOIN cal USING (date)), pr AS (SELECT a.idx, a.asset AS i, b.asset AS j, a.r * b.r AS p FROM x a JOIN x b ON a.idx = b.idx),
s AS (SELECT t.idx, p.i, p.j, 0.06 * sum(p.p * power(0.94, t.idx - p.idx)) AS c FROM cal t JOIN pr p ON p.idx <= t.idx GROUP BY ALL)
SELECT idx AS seq, round(sum(CASE WHEN i = j THEN c ELSE 0 END), 8) AS trace, round(sqrt(sum(c * c)), 8) AS frobenius FROM s GROUP BY idx"""))  # fmt: skip
def ewma_stream_resumed(spark, sf_dir):
    """The covariance of all assets by a stream that stops half way; another goes on from its stored snapshot."""
    p = Panel(spark, sf_dir)
    size = p.bars.select("asset").distinct().count()
    rows = p.rets.join(p.cal, "date").groupBy(F.col("idx").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("asset", F.coalesce("ret", F.lit(0.0)).alias("ret")))).alias("x"))
    rows = stored(rows.select(F.lit("all").alias("model"), "seq", F.col("x.ret").alias("r")), "stream-vectors")
    half = rows.agg(F.expr("max(seq) div 2")).first()[0] or 0
    at = folder(spark, "resumed-stream")
    model = state.Ewma(0.94)

    def part(name, own, snapshot):
        own.write.parquet(f"{at}/{name}-in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/{name}-in")
        return online.run_to_table(state.updates(stream, model, size, snapshot), f"{at}/{name}")

    with online.durable_state(spark):
        first = part("first", rows.filter(F.col("seq") <= half), None)
        state.snapshots(first).write.parquet(f"{at}/snapshot")
        second = part("second", rows.filter(F.col("seq") > half), spark.read.parquet(f"{at}/snapshot"))
    return _out(first.union(second).select("seq", "trace", "frobenius"), 8)
