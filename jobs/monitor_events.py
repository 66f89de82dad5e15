"""Control charts of arriving measurements, brought up to date by each run: a file stream that takes only new files.

Every run reads the files that came since the last one, adds them up by day and kind, and writes these sums beside those
of earlier runs, under the number of their batch; a batch that is repeated after a failure replaces its own sums. Late
events of an old day are thus added to it. The charts are then drawn anew from the sums, a row for each day, kind and
batch, so that no run reads an old event again.

``out`` holds ``checkpoint`` (the stream's mark), ``sums`` (by batch) and ``chart`` (by feature_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log, written
from meshspark.operators import spc

SETTINGS = {"m0": 20, "kmax": 10, "lam": spc.LAMBDA, "window": spc.WINDOW, "files_per_batch": 64}
SUMS = "day date, feature_id string, total double, n long, most double, batch long"
CHART = "day string, t int, n long, value double, value_most double, z double, t_stat double, feature_id string"


def sums(events: DataFrame) -> DataFrame:
    """(day, feature_id, total, n, most) of events(ts, event_type, value); rows without time, kind or value are left out."""
    held = events.where("ts is not null and event_type is not null and value is not null")
    by = held.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("feature_id"))
    return by.agg(F.sum(F.col("value").cast("double")).alias("total"), F.count("*").alias("n"), F.max(F.col("value").cast("double")).alias("most"))


def take_new(spark: SparkSession, source: str, out: str, files_per_batch: int) -> int:
    """Add the sums of files that no run has taken yet; how many rows these had."""

    def keep(batch: DataFrame, number: int) -> None:
        rows = sums(batch).withColumn("batch", F.lit(number).cast("long"))
        # the first batch of a checkpoint begins the table; any other replaces no more than itself
        mode = "static" if number == 0 else "dynamic"
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("batch").parquet(f"{out}/sums")

    schema = spark.read.parquet(source).select("ts", "event_type", "value").schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = new.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def charts(observed: DataFrame, config: dict) -> DataFrame:
    """The chart's rows of (day, feature_id, total, n, most), one for each day and kind; z and t_stat are null before the
    days that are monitored and beyond ``kmax`` of them. t counts days from the first, so a late event before it moves all."""
    first = observed.agg(F.min("day").alias("first"))
    days = observed.groupBy("day", "feature_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("value_most"))
    days = days.join(F.broadcast(first)).select("day", "feature_id", "n", "value_most", (F.datediff("day", "first") + 1).alias("t"), (F.col("total") / F.col("n")).alias("value"))
    obs = days.select(F.lit(1).alias("sim_id"), "t", "feature_id", "value")
    args = (config["m0"], config["kmax"], config["lam"], config["window"])
    z = spc.standardised_ewma(obs, *args).select("feature_id", "t", "z")
    stat = spc.rank_chart(obs, *args).select("t", "t_stat")
    met = days.join(z, ["feature_id", "t"], "left").join(stat, "t", "left")
    rounded = [F.round(c, 6).alias(c) for c in ("value", "value_most")] + [F.round("z", 5).alias("z"), F.round("t_stat", 6).alias("t_stat")]
    return met.select(F.col("day").cast("string").alias("day"), "t", "n", *rounded, "feature_id")


def run(spark: SparkSession, source: str, out: str, config: dict) -> DataFrame:
    """Bring the chart in ``out`` up to date with the files in ``source`` and return it as it stands."""
    config = SETTINGS | config
    n = take_new(spark, source, out, config["files_per_batch"])
    log.info("read %d new rows of %s", n, source)
    chart = charts(written(spark, f"{out}/sums", SUMS), config)
    chart.repartition("feature_id").write.mode("overwrite").partitionBy("feature_id").parquet(f"{out}/chart")
    result = written(spark, f"{out}/chart", CHART)
    log.info("wrote %d rows to %s/chart", result.count(), out)
    return result


if __name__ == "__main__":
    command(run, SETTINGS, "Control charts of arriving events", "monitor_events.json")
