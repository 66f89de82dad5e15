"""Plain numeric tables: CSV matrices with or without a header count, ragged lists, metric output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import renumber


def _ordered(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): lines of one file with their places from 0."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where("trim(value) <> ''")
    return renumber(raw, ["block", "line"], "row", start=0).select("row", "value")


def read_dimension(spark: SparkSession, path: str) -> int:
    """The first cell of a file as a number."""
    return int(float(spark.read.text(path).first().value.split(",")[0]))


def read_matrix(spark: SparkSession, path: str, columns: list[str], header: bool = False, skip: int = 0, kind: str = "double") -> DataFrame:
    """(row, columns) of a CSV file; with ``header`` the first line's first cell counts the rows that follow and the rest
    is cut off; ``skip`` drops lines before that."""
    lines = _ordered(spark, path)
    if skip:
        lines = lines.where(F.col("row") >= skip).withColumn("row", F.col("row") - skip)
    if header:
        n = int(float(lines.where("row = 0").first().value.split(",")[0]))
        lines = lines.where((F.col("row") > 0) & (F.col("row") <= n)).withColumn("row", F.col("row") - 1)
    cells = F.split("value", r"\s*,\s*")
    return lines.select("row", *[F.try_element_at(cells, F.lit(k)).cast("double").cast(kind).alias(c) for k, c in enumerate(columns, 1)])


def read_lists(spark: SparkSession, path: str, counts: str | None = None, shift: int = 0) -> DataFrame:
    """(row, ids) of ragged lines parted by commas or blanks, ids moved by ``shift``; cut to the counts of a second file."""
    ids = F.transform(F.filter(F.split(F.trim("value"), r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("long") + shift)
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = renumber(raw, ["block", "line"], "row", start=0).select("row", ids.alias("ids"))
    if counts is None:
        return rows
    n = read_matrix(spark, counts, ["n"], kind="int")
    return rows.join(n, "row").select("row", F.slice("ids", 1, F.col("n")).alias("ids"))


def write_lists(lists: DataFrame, path: str, counts: str, separator: str = ", ") -> None:
    """Lists in order of row, one line each, and their counts in a parallel file."""
    rows = lists.orderBy("row")
    rows.select(F.array_join(F.transform("ids", lambda x: x.cast("string")), separator).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    rows.select(F.size("ids").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(counts)


def write_matrix(rows: DataFrame, path: str, order: list[str], header: bool = False) -> None:
    """CSV of the other columns in order; with ``header`` a first line of the row count and zeros."""
    columns = [c for c in rows.columns if c not in order]
    body = rows.select(F.lit(1).alias("_h"), *order, F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("value"))
    if header:
        first = rows.agg(F.concat_ws(",", F.count("*").cast("string"), *[F.lit("0")] * (len(columns) - 1)).alias("value")).select(F.lit(0).alias("_h"), *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in order], "value")
        body = body.unionByName(first)
    body.orderBy("_h", *order).select("value").coalesce(1).write.mode("overwrite").text(path)


def spread(matrix: DataFrame, columns: list[str], key: str = "row") -> DataFrame:
    """A wide matrix as (key, feature_id, value), the observation form."""
    cells = F.array(*[F.struct(F.lit(k).alias("feature_id"), F.col(c).alias("value")) for k, c in enumerate(columns)])
    return matrix.select(key, F.explode(cells).alias("c")).select(key, "c.*")
