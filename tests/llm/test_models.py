import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meshspark.llm import ann, brown_lm, gam

DOCS = "doc_id long, text string, held string"


def crc(doc_id, fold):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % fold == 0


def test_gam_finds_steps_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    logit = np.where(x[:, 0] > 0.6, 2.0, -1.0) + np.where((x[:, 1] > 0.5) == (x[:, 2] > 0.5), 2.0, -2.0)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logit))).astype(float)
    model = gam.fit(x, y)
    top = max(model.pairs, key=lambda p: np.ptp(model.pairs[p]))
    assert top == (1, 2)
    other = rng.random((2000, 4))
    truth = np.where(other[:, 0] > 0.6, 2.0, -1.0) + np.where((other[:, 1] > 0.5) == (other[:, 2] > 0.5), 2.0, -2.0)
    score = model.score(other)
    sure = truth != 0
    assert ((score > 0.5) == (truth > 0))[sure].mean() > 0.95 and score.min() >= 0 and score.max() <= 1


def test_gam_without_labels():
    assert gam.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = gam.fit(np.ones((8, 3)), np.ones(8))
    assert one.score(np.zeros((1, 3)))[0] == pytest.approx(0.9)


def junk_and_prose(n):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(30, 90)))
        rows.append((k, text.upper().replace(" ", "!! ") if k % 4 == 0 else text, "x"))
    return rows


def test_classifier(spark):
    rows = junk_and_prose(400) + [(None, None, "x"), (900, "", "x"), (7, "dup of seven", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(400)] + [(900, None, None), (None, 1, 0), (3, 5, 0)], "doc_id long, quality int, toxic int")
    got = gam.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == crc(r.doc_id, 5) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 7}
    assert all(by[k].predicted == int(k % 4 != 0) for k in range(400) if k != 7 and crc(k, 5))
    kept = gam.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 400 and doc_id % 4 = 0").count() == 0 and kept.where("doc_id < 400 and doc_id % 4 <> 0").count() >= 299
    empty = spark.createDataFrame([], DOCS)
    assert gam.classify(empty, labels).collect() == [] and gam.accepted(empty, labels).collect() == []
    assert {r.score for r in gam.classify(docs, spark.createDataFrame([], labels.schema)).collect()} == {0.5}


def corpus():
    rng = random.Random(2)
    rows = []
    for k in range(300):
        own = "abc"[k % 3]
        rows.append((k, " ".join(rng.choices([f"{own}{j}{own}n" for j in range(40)] + ["the", "The"], k=rng.randint(5, 40))), "x"))
    return rows + [(1000, None, "x"), (1001, "", "x"), (1002, "The the THE\x0bÉ é", "x"), (None, "a1an unseen", "x"), (5, rows[5][1], "x"), (1003, "w " * 30000, "x")]


def plain_tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "BLOCK", 500)
    rows = corpus()
    got = brown_lm.score(spark.createDataFrame(rows, DOCS).repartition(4), classes=8).collect()
    counts = Counter(t for d, text, _ in rows if not crc(d, 10) for t in plain_tokens(text))
    total = sum(counts.values())
    want = sorted((str(d), crc(d, 10), len(t := plain_tokens(text)), sum(counts[w] > 0 for w in t), total, round(sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in t), 6)) for d, text, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # words of three kinds that never mix: the classes must help on held-out texts
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out) * np.log10(2)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)
    assert brown_lm.score(spark.createDataFrame([], DOCS)).collect() == []


def test_model_adds_up_to_one():
    """Transitions over classes, and emissions over a class's words and one unknown, are probabilities."""
    rng = np.random.default_rng(0)
    bigrams = rng.integers(0, 5, (30, 30)).astype(float)
    place = brown_lm.exchange(bigrams, 5)
    table = np.zeros((5, 5))
    np.add.at(table, (place[:, None], place[None, :]), bigrams)
    shares = (table.sum(axis=0) + 1) / (table.sum() + 5)
    assert np.allclose(((table + 8 * shares) / (table.sum(axis=1, keepdims=True) + 8)).sum(axis=1), 1)


def test_exchange_finds_planted_classes_and_never_gets_worse():
    rng = np.random.default_rng(3)
    kind = np.arange(40) % 4
    bigrams = rng.poisson(np.where((kind[:, None] + 1) % 4 == kind[None, :], 20.0, 0.5)).astype(float)

    def likelihood(place):
        t = np.zeros((4, 4))
        np.add.at(t, (place[:, None], place[None, :]), bigrams)
        f = brown_lm._xlogx
        return f(t).sum() - f(t.sum(axis=0)).sum() - f(t.sum(axis=1)).sum()

    last = -np.inf
    for sweeps in (1, 2, 3, 8):
        place = brown_lm.exchange(bigrams, 4, sweeps)
        assert likelihood(place) >= last - 1e-9
        last = likelihood(place)
    assert last == pytest.approx(likelihood(kind))


def test_rare_words_are_exchanged_by_their_own_counts(spark, monkeypatch):
    """Words that share ending and length, none of them frequent, are told apart by the words they stand by."""
    rng = random.Random(7)
    kinds = [[f"{k}{j:03}zz" for j in range(1200)] for k in "ab"]
    rows = [(k, " ".join(w for _ in range(15) for w in ("the", rng.choice(kinds[0]), "of", rng.choice(kinds[1]))), "x") for k in range(700)]
    monkeypatch.setattr(brown_lm, "BLOCK", 4000)
    got = [r for r in brown_lm.score(spark.createDataFrame(rows, DOCS).repartition(3)).collect() if r.held_out]
    rare, tokens = 30 * len(got), sum(r.n_tokens for r in got)
    # one of 1,200 words, not of 2,400, and smoothing; by ending and length alone it is 12.5 bits a rare word
    spent = -sum(r.score for r in got) / np.log10(2)
    assert len(got) > 40 and tokens == 61 * len(got) and spent < rare * (np.log2(1200) + 1.7)


def test_exchange_by_neighbours_brings_a_word_to_its_class():
    rng = np.random.default_rng(4)
    kind = np.arange(40) % 4
    bigrams = rng.poisson(np.where((kind[:, None] + 1) % 4 == kind[None, :], 6.0, 0.3)).astype(int)
    for u in range(40):
        for start in range(4):
            place = np.where(np.arange(40) == u, start, kind)
            table = np.zeros((4, 4))
            np.add.at(table, (place[:, None], place[None, :]), bigrams)
            n = np.concatenate([np.bincount(place, bigrams[:, u], 4), np.bincount(place, bigrams[u], 4)]).astype(int)
            used = np.flatnonzero(n)
            assert brown_lm.Exchange(table).best(np.array([0]), used, n[used], place[u : u + 1], np.array([u]))[0] == kind[u]


def vectors():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[1000:1400] = x[1000]
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3, []]
    rows += [(50 * (100 + k), v, 0) for k, v in enumerate(odd)] + [(None, rows[0][1], 0), (7, rows[7][1], 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, rep int"


def test_neighbours(spark):
    rows = vectors()
    got = ann.search(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    good = {k: np.array(v, dtype=np.float64) for k, v, _ in rows[:3000]}
    ids = np.array(sorted(good))
    x = np.stack([good[k] for k in ids])
    size = np.sqrt((x * x).sum(axis=1))
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert sorted(found) == [k for k in ids if k % 50 == 0]
    hits = total = 0
    for q, mine in found.items():
        score = (good[q] * x).sum(axis=1) / (np.sqrt((good[q] ** 2).sum()) * size)
        score[q] = -9
        best = np.lexsort((ids, -score))[:5]
        assert all(s == score[v] for v, s in mine) and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        hits += len({ids[b] for b in best} & {v for v, _ in mine})
        total += 5
        if 1000 <= q < 1400:
            assert [v for v, _ in mine] == [v for v in range(1000, 1007) if v != q][:5]
    assert hits / total >= 0.9


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], SCHEMA)
    assert [(r.vec_id, round(r.score, 6)) for r in sorted(ann.search(few).collect())] == [(2, 0.707107), (1, 0.0)]
    assert ann.search(few.where("vec_id = 0")).collect() == [] and ann.search(spark.createDataFrame([], SCHEMA)).collect() == []


def test_crowded_lists_are_dealt_in_blocks(spark, monkeypatch):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, ann.search(frame).collect()))
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, ann.search(frame).collect())) == want


def test_lists_give_only_what_reaches_the_floor():
    vectors = pa.array([[1.0, 0.1], [0.1, 1.0], [1.0, 1.0]])
    candidates = pa.table({"rep": [10, 11, 12], "vec": vectors})
    ask = lambda floor: ann._best(3)(pa.table({"rep": [10], "vec": vectors[:1], "floor": [floor]}), candidates).column("rep").to_pylist()
    assert ask(float("-inf")) == [10, 12, 11]
    assert ask(0.2) == [10, 12] and ask(2.0) == []


def test_graph_search_against_all_centroids():
    rng = np.random.default_rng(8)
    centroids = ann.unit(rng.normal(size=(400, 12)))
    graph = ann.CentroidGraph.build(centroids)
    x = ann.unit(rng.normal(size=(100, 12)))
    ids, far = graph.search(x, 48)
    true = np.argsort(-(x @ centroids.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) for a, b in zip(true, ids, strict=True)]) > 9.5
    assert (np.diff(far, axis=1) >= 0).all() and all(len(set(r)) == len(r) for r in ids)
    sizes = [len(part) for part in (ann.balanced_centroids(x, 10),)]
    assert sizes == [16]


def exact(rows, k=5, every=50):
    """Neighbours by brute force over all rows."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    size = np.sqrt((x * x).sum(axis=1))
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        score = (x[at] * x).sum(axis=1) / (size[at] * size)
        score[at] = -9
        out[int(ids[at])] = [int(ids[b]) for b in np.lexsort((ids, -score))[:k]]
    return out


def clouds(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(4, n // 200), dim))
    x = centres[rng.integers(len(centres), size=n)] + 0.6 * rng.normal(size=(n, dim))
    return [(k, v.tolist(), 0) for k, v in enumerate(x)]


@pytest.mark.parametrize("n", [1000, 6000, 24000])
def test_recall_holds_as_tables_grow(spark, n):
    rows = clouds(n)
    want = exact(rows, every=200)
    got: dict = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA).repartition(6), every=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(v)) / 5 for q, v in want.items()]) >= 0.95


def test_all_lists_are_exact(spark):
    rows = clouds(3000, seed=9)
    got: dict = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, SCHEMA).repartition(5), recall=1.0).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows)


def test_one_vector_asked_for_by_very_many(spark):
    rows = [(50 * k, [1.0, 2.0, 3.0], 0) for k in range(4000)] + [(50 * k + 1, [1.0, 2.0, 3.0 + k / 50], 0) for k in range(400)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    of: dict = {}
    for r in sorted(got):
        of.setdefault(r.query_id, []).append(r.vec_id)
    assert len(of) == 4000 and of[199950] == [0, 1, 50, 100, 150] and of[0] == [1, 50, 100, 150, 200] and of[100] == [0, 1, 50, 150, 200]
