"""Screening of documents by distribution-free limits: measures beyond an order statistic of their language are alarms.

The limit of a measure is the element of place ceil(n (1 - alpha)) of its language's sorted values, as control charts take
their limits from permutations: no distribution is assumed. Languages of fewer than ``least_rows`` rows get no limit.

``out`` holds ``documents`` (a row for each document, by lang) and ``limits`` (a row for each language and measure).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log, written
from meshspark.operators import relational, spc

SETTINGS = {"alpha": spc.ALPHA, "least_rows": 20}
MEASURES = ("n_chars", "n_words", "longest_word", "digit_share", "symbol_share", "repeat_share")
DOCUMENTS = "doc_id long, source string, " + ", ".join(f"{m} double" for m in MEASURES) + ", n_alarms int, alarms string, lang string"
LIMITS = "measure string, n long, least double, q1 double, median double, q3 double, largest double, upper double, lang string"


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, measures) of every whole text; a null text is empty, an empty language counts as null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    held = docs.select("doc_id", "source", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), text.alias("_t"), words.alias("_w"))
    chars, n = F.length("_t").cast("double"), F.size("_w").cast("double")
    share = lambda keep, of: F.round(F.length(F.regexp_replace("_t", f"[^{keep}]+", "")) / F.greatest(of, F.lit(1.0)), 9)
    longest = F.coalesce(F.array_max(F.transform("_w", lambda w: F.length(w))), F.lit(0)).cast("double")
    repeats = F.round((n - F.size(F.array_distinct("_w"))) / F.greatest(n, F.lit(1.0)), 9)
    values = {"n_chars": chars, "n_words": n, "longest_word": longest, "digit_share": share("0-9", chars), "symbol_share": share("#*$%&|<>", chars), "repeat_share": repeats}
    return held.select("doc_id", "source", "lang", *[values[m].alias(m) for m in MEASURES])


def limits(rows: DataFrame, config: dict) -> DataFrame:
    """(lang, measure, n, five numbers, upper) of every language and measure."""
    long = rows.select("lang", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])).alias("m")).select("lang", "m.*")
    keys = ["lang", "measure"]
    counts = long.groupBy(*keys).agg(F.count("*").alias("n"))
    five = relational.five_numbers(long, "value", keys)
    upper = spc.order_statistic_limit(long, keys, config["alpha"]).withColumnRenamed("limit", "upper")
    same = lambda a, b: a["lang"].eqNullSafe(b["lang"]) & (a["measure"] == b["measure"])
    met = counts.join(five, same(counts, five)).select(counts["lang"], counts["measure"], "n", "least", "q1", "median", "q3", "largest")
    met = met.join(upper, same(met, upper)).select(met["lang"], met["measure"], "n", "least", "q1", "median", "q3", "largest", upper["upper"])
    return met.withColumn("upper", F.when(F.col("n") >= config["least_rows"], F.col("upper")))


def screened(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` with how many measures lie beyond their limits, and which, in the order of MEASURES."""
    wide = bounds.groupBy("lang").agg(*[F.max(F.when(F.col("measure") == m, F.col("upper"))).alias(f"_{m}") for m in MEASURES]).withColumnRenamed("lang", "_lang")
    met = rows.join(wide, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    beyond = [F.when(F.col(m) > F.col(f"_{m}"), F.lit(m)) for m in MEASURES]
    count = reduce(lambda a, b: a + b, [F.when(b.isNotNull(), 1).otherwise(0) for b in beyond])
    return met.select("doc_id", "source", *MEASURES, count.alias("n_alarms"), F.concat_ws(",", *beyond).alias("alarms"), "lang")


def run(spark: SparkSession, source: str, out: str, config: dict) -> DataFrame:
    """Screen the documents in ``source`` into ``out``, replacing what a former run left, and return the screened rows."""
    config = SETTINGS | config
    docs = spark.read.parquet(source)
    log.info("read %d rows of %s", docs.count(), source)
    # the measures are written once, so limits and screening need not read texts again
    measured(docs).write.mode("overwrite").parquet(f"{out}/measures")
    rows = spark.read.parquet(f"{out}/measures")
    limits(rows, config).repartition(1).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/limits")  # a few rows a language
    bounds = written(spark, f"{out}/limits", LIMITS)
    screened(rows, bounds).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/documents")
    result = written(spark, f"{out}/documents", DOCUMENTS)
    log.info("wrote %d rows to %s/documents and %d to %s/limits", result.count(), out, bounds.count(), out)
    return result


if __name__ == "__main__":
    command(run, SETTINGS, "Screening of documents", "screen_documents.json")
