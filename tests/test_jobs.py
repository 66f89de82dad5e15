"""The jobs: over growing input, repeated, with odd rows; against a single run and against plain Python."""

import datetime as dt
import json
import math
import re
import uuid

import pytest
from pyspark.sql import functions as F

from jobs import monitor_events, queries, screen_documents
from jobs.common import settings

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def event(k, day, kind, value):
    return (k, None if day is None else START + dt.timedelta(days=day, minutes=k % 1000), k % 7, kind, value, "{}")


def events():
    rows = [event(k, k % 40, "abc"[k % 3], math.sin(k * k) * 10 + (5 if k % 40 > 30 else 0)) for k in range(3000)]
    return rows + [event(1, None, "a", 1.0), event(2, 3, None, 1.0), event(3, 3, "a", None)]


@pytest.fixture()
def place(spark, tmp_path):
    return lambda name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex[:8]}"


def add(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def collected(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_monitoring_takes_only_what_is_new(spark, place):
    rows, source, out = events(), place("in"), place("out")
    early = [r for r in rows if r[1] and r[1] < START + dt.timedelta(days=25) and r[0] % 5]
    add(spark, early, source)
    first = collected(monitor_events.run(spark, source, out, {"kmax": 15}))
    assert max(r[1] for r in first) == 24  # from the second day, as the first has only late rows
    sums = lambda: {r.batch: r.n for r in spark.read.parquet(f"{out}/sums").groupBy("batch").agg(F.sum("n").alias("n")).collect()}
    assert sums() == {0: len([r for r in early if r[3] and r[4] is not None])}
    again = collected(monitor_events.run(spark, source, out, {"kmax": 15}))
    assert again == first and list(sums()) == [0]
    add(spark, [r for r in rows if r not in early], source)  # new days, late events of old days, rows without time, kind or value
    whole = collected(monitor_events.run(spark, source, out, {"kmax": 15}))
    assert sums()[1] == 3000 - sums()[0]
    assert whole != first and len(whole) == 120
    at_once = place("once")
    assert whole == collected(monitor_events.run(spark, source, at_once, {"kmax": 15}))
    assert whole == collected(monitor_events.run(spark, source, out, {"kmax": 15}))
    last = [r for r in whole if r[1] == 35]
    assert len({r[6] for r in last}) == 1 and last[0][6] > 1 and all(r[6] is None for r in whole if r[1] <= 20 or r[1] > 35)


def test_a_batch_that_is_repeated_replaces_itself(spark, place):
    """A run that ends after its sums are written, before its mark is: the batch comes again."""
    source, out = place("in"), place("out")
    add(spark, events()[:500], source)
    monitor_events.run(spark, source, out, {})
    add(spark, events()[500:900], source)
    good = monitor_events.sums

    def failing(batch):
        out_rows = good(batch)
        failing.calls += 1
        if failing.calls == 1:
            out_rows.withColumn("batch", F.lit(1).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/sums")
            raise RuntimeError("lost")
        return out_rows

    failing.calls = 0
    monitor_events.sums = failing
    try:
        with pytest.raises(Exception, match="lost"):
            monitor_events.run(spark, source, out, {})
        result = collected(monitor_events.run(spark, source, out, {}))
    finally:
        monitor_events.sums = good
    assert failing.calls == 2 and result == collected(monitor_events.run(spark, source, place("once"), {}))


def documents():
    rows = [(k, " ".join(f"w{j}" for j in range(10 + k % 50)), "en", f"s{k % 3}") for k in range(300)]
    rows += [(k, "mot " * (k % 9), "fr", None) for k in range(300, 310)]
    return rows + [(900, None, None, None), (901, "", "", "s"), (902, "# " * 5000, "en", "s"), (903, "x" * 60_000 + " 12345", "en", "s"), (904, "same same " * 300, "en", "s"), (3, *documents_row(3))]


def documents_row(k):
    return " ".join(f"w{j}" for j in range(10 + k % 50)), "en", f"s{k % 3}"


def plain(rows, alpha, least):
    measured = []
    for doc_id, text, lang, source in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        share = lambda keep, of: round(len(re.findall(f"[{keep}]", text)) / max(of, 1), 9)  # noqa: E731, B023
        values = (len(text), len(words), max(map(len, words), default=0), share("0-9", len(text)), share(r"#*$%&|<>", len(text)), round((len(words) - len(set(words))) / max(len(words), 1), 9))
        measured.append((doc_id, source, lang or None, values))
    for doc_id, source, lang, values in measured:
        own = [v for _, _, x, v in measured if x == lang]
        place = min(math.ceil(len(own) * (1 - alpha)), len(own) - 1)
        found = [m for k, m in enumerate(screen_documents.MEASURES) if len(own) >= least and values[k] > sorted(v[k] for v in own)[place] + 1e-12]
        yield (doc_id, source, *map(float, values), len(found), ",".join(found), lang)


def test_screening_against_plain_python(spark, place):
    schema = "doc_id long, text string, lang string, source string"
    source, out = place("in"), place("out")
    spark.createDataFrame(documents(), schema).withColumn("value", F.lit(1)).repartition(3).write.parquet(source)
    config = {"alpha": 0.02, "least_rows": 20}
    got = collected_any(screen_documents.run(spark, source, out, config))
    assert got == sorted(plain(documents(), 0.02, 20), key=str)
    assert {r[0] for r in got if r[8]} >= {902, 903, 904} and not any(r[8] for r in got if r[10] != "en")
    assert got == collected_any(screen_documents.run(spark, source, out, config))
    limits = spark.read.parquet(f"{out}/limits")
    assert limits.where("lang = 'fr' and upper is not null").isEmpty() and limits.where("lang = 'en'").count() == len(screen_documents.MEASURES)


def collected_any(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_empty_tables(spark, place):
    source = place("docs")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(source)
    assert screen_documents.run(spark, source, place("out"), {}).collect() == []
    source = place("events")
    add(spark, [], source)
    assert monitor_events.run(spark, source, place("out"), {}).collect() == []


def test_settings(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"m0": 5}, indent=1))
    assert settings(spark, file.as_uri(), monitor_events.SETTINGS)["m0"] == 5
    file.write_text(json.dumps({"mo": 5}))
    with pytest.raises(ValueError, match="mo"):
        settings(spark, file.as_uri(), monitor_events.SETTINGS)


def test_queries_leave_settings_as_they_were(spark):
    before = {k: v for k, v in spark.sparkContext.getConf().getAll()} | dict(r for r in spark.sql("SET").collect())
    for job in queries.QUERIES.values():
        assert job(spark, "/root/testdata/sf0.001").count() > 0
    assert before == {k: v for k, v in spark.sparkContext.getConf().getAll()} | dict(r for r in spark.sql("SET").collect())
