"""The jobs as queries: each runs twice into one new folder of spark.checkpoint.dir and returns the output as it then stands."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import monitor_events, screen_documents
from jobs.common import Job
from meshspark.plans import charts  # noqa: F401  its SQL tables are used here
from meshspark.plans.registry import with_tables

Query = Callable[[SparkSession, str], DataFrame]


def _twice(job: Job, name: str, spark: SparkSession, source: str) -> DataFrame:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    out = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    job(spark, source, out, {})
    return job(spark, source, out, {})


def job1_monitor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, for the table may be one file, which file streams take only so
    return _twice(monitor_events.run, "job1", spark, f"{sf_dir}/event[s].parquet")


def job2_screen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(screen_documents.run, "job2", spark, f"{sf_dir}/documents.parquet")


_MONITOR = """SELECT strftime(o.day, '%Y-%m-%d') AS day, o.t, o.n, round(o.value, 6) AS value, round(o.most, 6) AS value_most, round(z.z, 5) AS z, round(r.t_stat, 6) AS t_stat, o.feature_id
  FROM (SELECT ts::DATE AS day, (date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + 1)::INT AS t, event_type AS feature_id, count(*) AS n, avg(value) AS value, max(value) AS most
    FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL GROUP BY ALL) o
  LEFT JOIN z1 z ON z.t = o.t AND z.feature_id = o.feature_id LEFT JOIN (SELECT t, max(s) AS t_stat FROM rank_score GROUP BY 1) r ON r.t = o.t"""


def _screen_sql() -> str:
    names = screen_documents.MEASURES
    alpha, least = screen_documents.SETTINGS["alpha"], screen_documents.SETTINGS["least_rows"]
    share = lambda keep: f"round(length(regexp_replace(t, '[^{keep}]+', '', 'g')) / greatest(length(t), 1)::DOUBLE, 9)"
    long = " UNION ALL ".join(f"SELECT lang, '{m}' AS measure, {m} AS value FROM measured" for m in names)
    upper = ", ".join(f"max(CASE WHEN measure = '{m}' THEN upper END) AS {m}" for m in names)
    beyond = ", ".join(f"CASE WHEN m.{m} > l.{m} THEN '{m}' END" for m in names)
    return rf"""
    WITH held AS (SELECT doc_id, source, nullif(lang, '') AS lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    measured AS (SELECT doc_id, source, lang, length(t)::DOUBLE AS n_chars, len(w)::DOUBLE AS n_words, coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS longest_word,
      {share("0-9")} AS digit_share, {share("#*$%&|<>")} AS symbol_share, round((len(w) - len(list_distinct(w))) / greatest(len(w), 1)::DOUBLE, 9) AS repeat_share FROM held),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, measure ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY lang, measure) AS n FROM ({long})),
    limits AS (SELECT lang, measure, CASE WHEN n >= {least} THEN value + 1e-12 END AS upper FROM ranked WHERE r = least(ceil(n * (1 - {alpha}::DOUBLE))::BIGINT, n - 1)),
    wide AS (SELECT lang, {upper} FROM limits GROUP BY lang),
    told AS (SELECT m.*, list_filter([{beyond}], lambda x: x IS NOT NULL) AS found FROM measured m LEFT JOIN wide l ON l.lang IS NOT DISTINCT FROM m.lang)
    SELECT doc_id, source, {", ".join(names)}, len(found)::INT AS n_alarms, array_to_string(found, ',') AS alarms, lang FROM told
    """


QUERIES: dict[str, Query] = {f.__name__: f for f in (job1_monitor_events, job2_screen_documents)}
ORACLE_SQL: dict[str, str] = {"job1_monitor_events": with_tables(_MONITOR, ("z1", "rank_score")), "job2_screen_documents": _screen_sql()}
