"""Invertible Bloom fingerprints against plain sets and against their SQL."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from meshspark.llm import ibf, oracle

DOCS = "doc_id long, text string, own string, range int, low string"


def prose(seed, words):
    r = random.Random(seed)
    return " ".join(r.choice(["und", "the", "élan", "漢字", "x"]) + str(r.randrange(50)) + r.choice(["", "", "", "", ".", "!?", ".\n"]) for _ in range(words))


def docs():
    rows = [(k, prose(k, 1 + 7 * k % 400), "x", 1, "y") for k in range(60)]
    rows += [(100, None, None, None, None), (101, "", "x", 1, "y"), (102, " \n\t ", "x", 1, "y"), (103, prose(3, 15_000), "x", 1, "y"), (104, prose(3, 15_000) + " more", "x", 1, "y")]
    return rows + [(105, "word " * 3000, "x", 1, "y"), (106, "a" * 50_000, "x", 1, "y"), (107, rows[3][1], "x", 1, "y"), (108, "one", "x", 1, "y")]


def digests(text):
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in re.findall(ibf.PARAGRAPH, text)}


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: r[0])
    for k, (doc_id, text, *_) in enumerate(rows):
        text, follows = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follows[:cut]
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(digests(text), digests(edited)), near(digests(text), digests(follows))


def test_against_sets_and_sql(spark):
    frame = spark.createDataFrame(docs(), DOCS).repartition(3)
    out = ibf.fingerprints(frame)
    rows = out.collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows) == list(expected(docs()))
    by = {r.doc_id: r for r in rows}
    assert by[3].fingerprint == by[107].fingerprint and len({r.fingerprint for r in rows if r.doc_id < 60}) == 60
    assert by[103].near_next > 0.99 and by[100].near_next == by[101].near_next == 1.0
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text").toPandas())
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT {', '.join(out.columns)} FROM ({oracle.fingerprints_sql()})").fetchall())


def test_peeling_tells_each_side_or_says_it_cannot(spark):
    side = F.lit(8).cast("long")
    keys = lambda seed, n: [random.Random(seed + k).randrange(1 << 60) for k in range(n)]
    rows = [(n, keys(n * 1000, n) + keys(7, 300), keys(n * 2000 + 5, n // 2) + keys(7, 300)) for n in range(0, 16)] + [(99, keys(1, 200), keys(2, 200))]
    frame = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    told = frame.select("n", "a", "b", ibf.peeled(ibf.minus(ibf.sketch(F.col("a"), side), ibf.sketch(F.col("b"), side)), side).alias("p"), ibf.retried(F.col("a"), F.col("b")).alias("r"))
    whole = 0
    for r in told.collect():
        a, b = set(r.a), set(r.b)
        assert (r.r.lost, r.r.gained) == (len(a - b), len(b - a))
        if r.p.whole:
            whole += 1
            assert set(r.p.only_first) == a - b and set(r.p.only_second) == b - a
        else:
            assert r.n > 4
    assert whole >= 8


def test_a_page_that_fails_is_doubled(spark, monkeypatch):
    monkeypatch.setattr(ibf, "PAGE_SIDE", 1)
    a, b = list(range(1, 30)), list(range(20, 60))
    frame = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    r = frame.select(ibf._page(F.col("a"), F.col("b")).alias("p")).first().p
    assert sorted(r.only_first) == list(range(1, 20)) and sorted(r.only_second) == list(range(30, 60))


def test_repeats_null_ids_other_names_and_empty_tables(spark):
    rows = [(1, "Same text here.", "x", 1, "y")] * 30 + [(1, "Another text.", "x", 1, "y"), (None, "No id.", "x", 1, "y"), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    got = ibf.fingerprints(frame).collect()
    assert len(got) == len(rows) and sum(r.near_next == 1.0 for r in got if r.doc_id == 1) == 29
    named = frame.withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "next")
    assert sorted(map(str, ibf.fingerprints(named, id_col="a.b", text_col="next").collect())) == sorted(map(str, got))
    assert ibf.fingerprints(spark.createDataFrame([], DOCS)).collect() == []
    only = ibf.fingerprints(spark.createDataFrame(rows[:1], DOCS)).first()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"Same text heSam").hexdigest()
