"""What the jobs share: settings, the command line, reading back what was written."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")
Job = Callable[[SparkSession, str, str, dict], DataFrame]


def settings(spark: SparkSession, path: str, known: dict) -> dict:
    """``known`` overridden by the JSON file at ``path``, which may be on any store Spark reads; unknown names are an error."""
    rows = spark.read.text(path, wholetext=True).collect()
    given = json.loads(rows[0].value)
    if unknown := set(given) - set(known):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return known | given


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A partitioned table as it stands, with the columns and types of ``schema``."""
    return spark.read.schema(schema).parquet(path)


def command(job: Job, known: dict, description: str, config: str) -> None:
    """The command line of a job: it alone creates and stops the session."""
    p = argparse.ArgumentParser(description=description)
    p.add_argument("--source", required=True, help="folder of the input table's Parquet files")
    p.add_argument("--out", required=True, help="folder of the output, its marks included")
    p.add_argument("--config", default=str(Path(__file__).with_name(config)), help="JSON file of settings")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        path = args.config if ":" in args.config else Path(args.config).resolve().as_uri()
        job(spark, args.source, args.out, settings(spark, path, known))
    finally:
        spark.stop()
