"""Queries of the control charts over the daily event means: 20 days in control, 10 monitored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spc
from .bindings import daily
from .registry import query, sql_table

M0, KMAX = 20, 10

sql_table(
    "rank_ewma",
    """SELECT sim_id, feature_id, now AS t, sum(rank * pow(0.99, now - t)) AS e, least(now - 20, 10) AS win FROM (
      SELECT o.sim_id, o.feature_id, n.now, o.t, row_number() OVER (PARTITION BY o.sim_id, o.feature_id, n.now ORDER BY o.value, o.t) AS rank
      FROM obs o JOIN (SELECT DISTINCT t AS now FROM obs WHERE t > 20 AND t <= 30) n ON o.t <= n.now)
    WHERE t > now - least(now - 20, 10) GROUP BY ALL""",
    "obs",
)
sql_table(
    "rank_score",
    """SELECT sim_id, t, pow((e - (1-pow(0.99,win))/0.01*(t+1)/2) / sqrt((1-pow(0.9801,win))/(1-0.9801)*(t*t-1)/12
      - (pow((1-pow(0.99,win))/0.01, 2) - (1-pow(0.9801,win))/(1-0.9801))*(t+1)/12), 2) AS s FROM rank_ewma""",
    "rank_ewma",
)
_LONG = "SELECT sim_id, feature_id, t, value AS v FROM obs"
_Z = """SELECT n.sim_id, n.feature_id, n.t, avg(b.v) AS mean, sqrt(avg(b.v*b.v) - avg(b.v)*avg(b.v)) AS sd, count(*) AS n
  FROM {0} n JOIN {0} b ON b.sim_id=n.sim_id AND b.feature_id=n.feature_id AND b.t <= n.t - least(n.t-20, 10) WHERE n.t > 20 AND n.t <= 30 GROUP BY ALL"""
_W = """SELECT n.sim_id, n.feature_id, n.t, n.n, n.mean, n.sd, sum((b.v - n.mean)/n.sd * pow(0.99, n.t - b.t)) AS z
  FROM {1} n JOIN {0} b ON b.sim_id=n.sim_id AND b.feature_id=n.feature_id AND b.t <= n.t AND b.t > n.t - least(n.t-20, 10) GROUP BY ALL"""
sql_table("metric1", _LONG, "obs")
sql_table("metric2", _LONG.replace("value AS v", "value2 AS v"), "obs")
for _k in "12":
    sql_table(f"base{_k}", _Z.format(f"metric{_k}"), f"metric{_k}")
    sql_table(f"z{_k}", _W.format(f"metric{_k}", f"base{_k}"), f"metric{_k}", f"base{_k}")
    sql_table(f"mom{_k}", f"SELECT sim_id, t, avg(z) m1, avg(z*z) m2, avg(z*z*z) m3, avg(z*z*z*z) m4 FROM z{_k} GROUP BY ALL", f"z{_k}")
_STATS = """SELECT sim_id, t, {1} AS stat, m1 AS t_stat FROM mom{0} UNION ALL SELECT sim_id, t, {1}+1, m2-m1*m1 FROM mom{0}
 UNION ALL SELECT sim_id, t, {1}+2, (m3-3*m1*m2+2*pow(m1,3))/pow(m2-m1*m1,1.5) FROM mom{0} UNION ALL SELECT sim_id, t, {1}+3, (m4-4*m1*m3+6*m1*m1*m2-3*pow(m1,4))/pow(m2-m1*m1,2) FROM mom{0}"""
sql_table("moments", _STATS.format(1, 1) + " UNION ALL " + _STATS.format(2, 5), "mom1", "mom2")
# fixed limits for the alarm queries: each statistic's first monitored value, give or take 1.2
sql_table("limited", "SELECT m.*, f.t_stat - 1.2 AS lo, f.t_stat + 1.2 AS hi FROM moments m JOIN moments f ON f.sim_id=m.sim_id AND f.stat=m.stat AND f.t=21", "moments")
sql_table("marked", "SELECT *, (t_stat < lo OR t_stat > hi) AS alarm FROM limited", "limited")
sql_table("stopped", "SELECT m.* FROM marked m WHERE t <= coalesce((SELECT min(t) FROM marked x WHERE x.alarm AND x.sim_id = m.sim_id), 1000)", "marked")


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    chart = spc.moment_chart(daily(spark, sf_dir), M0, KMAX)
    first = chart.where(F.col("t") == M0 + 1).select("sim_id", "stat", F.col("t_stat").alias("f"))
    return chart.join(first, ["sim_id", "stat"]).select("sim_id", "t", "stat", "t_stat", (F.col("f") - 1.2).alias("lo"), (F.col("f") + 1.2).alias("hi"))


@query("SELECT sim_id, t, round(max(s), 6) AS t_stat FROM rank_score GROUP BY 1, 2", "rank_score")
def rank_chart_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.rank_chart(daily(spark, sf_dir), M0, KMAX).withColumn("t_stat", F.round("t_stat", 6))


@query("SELECT sim_id, t, round(avg(s), 6) AS t_stat FROM rank_score GROUP BY 1, 2", "rank_score")
def rank_chart_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.rank_chart(daily(spark, sf_dir), M0, KMAX, use_mean=True).withColumn("t_stat", F.round("t_stat", 6))


@query("SELECT n.feature_id, n.t, round(sum(b.v * pow(0.99, n.t - b.t)), 4) AS ewma FROM metric1 n JOIN metric1 b ON b.feature_id=n.feature_id AND b.t<=n.t AND b.t > n.t - least(n.t-20,10) WHERE n.t > 20 AND n.t <= 30 GROUP BY 1, 2", "metric1")
def ewma_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.ewma(daily(spark, sf_dir), M0, KMAX).select("feature_id", "t", F.round("ewma", 4).alias("ewma"))


@query("SELECT feature_id, t, n::INT AS n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(z, 5) AS z FROM z1", "z1")
def expanding_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.standardised_ewma(daily(spark, sf_dir), M0, KMAX).select("feature_id", "t", "n", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "z")])


@query("SELECT t, stat::INT AS stat, round(t_stat, 4) AS t_stat FROM moments", "moments")
def moment_chart_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.moment_chart(daily(spark, sf_dir), M0, KMAX).select("t", "stat", F.round("t_stat", 4).alias("t_stat"))


@query("SELECT t, stat::INT AS stat, round(t_stat, 4) AS t_stat, alarm FROM stopped", "stopped")
def chart_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.alarms(_limited(spark, sf_dir)).select("t", "stat", F.round("t_stat", 4).alias("t_stat"), "alarm")


sql_table("ends", "SELECT sim_id, t, bool_or(alarm) AS alarm FROM stopped s WHERE t = (SELECT max(t) FROM stopped x WHERE x.sim_id = s.sim_id) GROUP BY 1, 2", "stopped")


@query("SELECT sim_id, (t - 20 + CASE WHEN alarm THEN 0 ELSE 1 END)::INT AS run_length, NOT alarm AS censored FROM ends", "ends")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.run_lengths(spc.alarms(_limited(spark, sf_dir)), M0, KMAX)


# one run per statistic, as if each were a simulation
sql_table("single_runs", "SELECT stat, coalesce(min(CASE WHEN alarm THEN t END) - 20, 11) AS r FROM marked GROUP BY 1", "marked")


@query("SELECT round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(avg((r > 10)::INT), 6) AS beyond, min(r)::DOUBLE AS least, quantile_cont(r::DOUBLE, 0.25) AS q1, quantile_cont(r::DOUBLE, 0.5) AS median, quantile_cont(r::DOUBLE, 0.75) AS q3, max(r)::DOUBLE AS largest FROM single_runs", "single_runs")
def run_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _limited(spark, sf_dir).withColumn("sim_id", F.col("stat"))
    return spc.run_length_summary(spc.run_lengths(spc.alarms(runs), M0, KMAX), KMAX).select(*[F.round(c, 6).alias(c) for c in ("mean", "sd", "beyond")], "least", "q1", "median", "q3", "largest")


@query("""SELECT l_returnflag AS k, round(min(l_extendedprice) + 1e-12, 4) AS "limit" FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE r = least(ceil(n * 0.995)::BIGINT + 1, n) GROUP BY 1""")
def order_stat_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("value"))
    return spc.order_statistic_limit(rows, ["k"]).select("k", F.round("limit", 4).alias("limit"))


@query("SELECT t::INT AS n, least(t - 20, 10)::INT AS win, round((1-pow(0.99,least(t-20,10)))/0.01*(t+1)/2, 8) AS mean, round(sqrt((1-pow(0.9801,least(t-20,10)))/(1-0.9801)*(t*t-1)/12 - (pow((1-pow(0.99,least(t-20,10)))/0.01, 2) - (1-pow(0.9801,least(t-20,10)))/(1-0.9801))*(t+1)/12), 8) AS sd FROM (SELECT DISTINCT t::BIGINT AS t FROM obs WHERE t > 20)", "obs")
def rank_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the weighted rank sum at every charted day of the events."""
    t = daily(spark, sf_dir).where(F.col("t") > M0).select(F.col("t").alias("n")).distinct().withColumn("win", F.least(F.col("n") - M0, F.lit(KMAX)))
    mean, sd = spc.rank_moments(F.col("n").cast("double"), F.col("win"))
    return t.select("n", "win", F.round(mean, 8).alias("mean"), F.round(sd, 8).alias("sd"))


@query()
def permutation_limits_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.permutation_limits_rank(daily(spark, sf_dir), M0, KMAX)


@query()
def permutation_limits_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.permutation_limits_joint(daily(spark, sf_dir), M0, KMAX)
