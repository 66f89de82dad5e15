import random
import re

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meshspark.llm import gam, mixing, pii, simhash


def corpus(folder):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(500)]
    rows = []
    for k in range(240):
        text = " ".join(rng.choices(words, k=rng.randint(60, 160)))
        if k % 6 == 0:
            text = text.upper().replace(" ", "!! ")
        elif k % 6 == 1:
            text += f" mail me{k}@host.example.com today"
        rows.append((k, text))
    rows += [(300 + k, rows[2][1]) for k in range(8)] + [(400, None), (401, "")]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": [None if r[0] % 10 == 9 else f"s{r[0] % 3}" for r in rows], "n_chars": [len(r[1] or "") for r in rows]})
    pq.write_table(table, f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(240)), "quality": [int(k % 6 != 0) for k in range(240)], "toxic": [0] * 240}), f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    corpus(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        after = spark.read.parquet(f"{tmp_path}/out{k}")
        rows = after.collect()
        seen.append((docs, rows))
        if k < 4:
            assert after.columns == columns
        if k == 0:  # the accepted rows are those that the query accepts
            good = {r.doc_id for r in gam.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted}
            assert {r.doc_id for r in rows} == good and all(d % 6 for d in good if d < 240) and len(good) >= 200
        elif k == 1:
            comps = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(d for d, c in comps.items() if d == c)
            assert not {r.doc_id for r in rows} & set(range(300, 308)) and 2 in {r.doc_id for r in rows}
        elif k == 2:
            assert len(rows) == len(before)
            for r in rows:
                text = before[r.doc_id].text
                # the two words that stand by every address, and nowhere else, tell that there is one
                terms = [(pii.TERM, m.start(), m.end()) for m in re.finditer("mail(?= me)|today", text or "") if "@" in text]
                assert r.text == (text if text is None else pii.replace(text, [*pii.base_spans(text), *terms])) and "@" not in (r.text or "")
        elif k == 3:
            size = {d: len((r.text or "").split()) for d, r in before.items()}
            taken: dict = {}
            for r in rows:
                n = len(r.text.split())
                taken[r.doc_id] = taken.get(r.doc_id, 0) + n
                assert (before[r.doc_id].text or "").split()[:n] == r.text.split() and r.n_chars == len(r.text)
            assert all(n <= 3 * size[d] for d, n in taken.items())
            assert abs(sum(taken.values()) - sum(size.values())) < 0.05 * sum(size.values())
        else:
            plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = sorted(tuple(plain.encode(r.text, add_special_tokens=False).ids + [1]) for r in before)
            assert sum(r.length for r in rows) == sum(map(len, want))
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            whole = sorted(tuple(r.ids) for r in rows if r.length == r.doc_tokens)
            assert set(whole) <= set(want)
        docs = after


def test_run(spark, tmp_path):
    corpus(tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    lengths = [r.n for r in out.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths)


CLASHES = {"_terms": "long", "_key1": "string", "_near_id": "long", "_id": "string", "_key": "long", "_taken": "long", "_words": "string", "_label_id": "long", "a.b": "string", "doc": "long", "h0": "string", "slot": "int", "task": "int", "key1": "int", "terms": "string", "n_words": "string", "_w": "int", "_text": "string"}


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_of_any_name(spark, tmp_path, stage):
    corpus(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    wide = docs.selectExpr("*", *[f"cast(doc_id as {kind}) as `{name}`" for name, kind in CLASHES.items()])
    run = corpus_pipeline.STAGES[stage][1]
    got = run(spark, wide, str(tmp_path))
    if stage < 4:
        assert got.columns == wide.columns
        rows = got.collect()  # before the next stage begins, which deletes this one's tables
        for r in rows:
            assert all(str(r[name]) == str(r.doc_id) for name in CLASHES)
        plain = run(spark, docs, str(tmp_path)).collect()
        if stage != 3:  # the mix orders by the whole row's content alone, so its choice is the same
            assert sorted(map(str, (r[:2] for r in plain))) == sorted(str(r[:2]) for r in rows)
    else:
        assert got.count() > 0


def test_mixed_rows_follow_the_schedule(spark):
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(20 + k % 150)) + "\n", f"s{k % 3}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mixed_documents(docs)
    keyed = [F.xxhash64("doc_id", "text", "source").alias("h0"), F.lit(0).alias("h1")]
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.shuffled(F.col("doc_id"), F.col("text")).alias("_mix"), *keyed).cache()
    placed, turns, _ = mixing.plan(sized)
    of = {(r.k, r.block, r["pass"]): r.slot for r in turns.collect()}
    last = {}
    for k, block, turn in of:
        last[k] = max(last.get(k, (0, 0)), (turn, block))
    want = []
    text = {r[0]: r[1] for r in rows}
    for p in placed.collect():
        for turn in range(3):
            due = [b for b in range(p.start // 64, (p.start + p.size - 1) // 64 + 1) if (p.k, b, turn) in of]
            if due:  # the words of the document's blocks that are due in this pass
                n = min(p.size, (due[-1] + 1) * 64 - p.start)
                words = text[p.doc_id].split()[:n]
                want.append((of[p.k, due[0], turn], p.start, p.doc_id, text[p.doc_id] if n == p.size else " ".join(words)))
    assert [(r.doc_id, r.text) for r in got.collect()] == [w[2:] for w in sorted(want)]


def test_a_run_begins_where_it_broke_off(spark, tmp_path, monkeypatch):
    corpus(tmp_path)
    folder = f"file://{tmp_path}/run"
    first = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path), folder).collect()))

    def fail(*_):
        raise AssertionError("a written stage ran again")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, fail) for n, _ in corpus_pipeline.STAGES])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path), folder).collect())) == first


def test_a_folder_is_not_used_for_another_input(spark, tmp_path, monkeypatch):
    """Stages that only pass rows on, for it is the folder that is tested."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda _, docs, __: docs), ("two", lambda _, docs, __: docs.where("doc_id < 100"))])
    folder = f"file://{tmp_path}/run"
    for name, more in (("a", 0), ("b", 1000)):
        (tmp_path / name).mkdir()
        rows = corpus(tmp_path / name)
        shifted = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet").selectExpr(f"doc_id + {more} doc_id", "text", "lang", "source", "n_chars")
        shifted.write.parquet(f"{tmp_path}/{name}2/documents.parquet")
        spark.read.parquet(f"{tmp_path}/{name}/labels.parquet").write.parquet(f"{tmp_path}/{name}2/labels.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}2", folder).collect()}
        assert got == {r[0] + more for r in rows if r[0] + more < 100}


def test_a_run_leaves_tables_of_other_queries(spark, tmp_path):
    corpus(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lazy = mixing.mix(docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert lazy.count() == docs.count()
