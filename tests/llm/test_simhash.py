import random

import numpy as np
import xxhash

from meshspark.llm import simhash as S
from meshspark.llm.components import connected_components

DOCS = "doc_id long, text string"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("Ab cd ef Gh ij kl".split(), k=rng.randint(0, 14))) for _ in range(150)]
    base = [f"w{i}" for i in range(400)]
    for k in range(60):
        near = list(base)
        near[rng.randrange(400)] = f"x{k}"
        texts.append(" ".join(near))
    texts += [None, "", " \t", "a b", "a b", "ä ö É", "w " * 5000]
    rows = list(enumerate(texts))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    fps = [plain(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == fps
    assert [got[i][1] for i in range(len(texts))] == groups(fps)


def test_links_of_crowded_buckets(spark):
    rng = np.random.default_rng(1)
    fps, at = [0x0123456789ABCDEF], 0
    for _ in range(300):  # a chain of near fingerprints around few places
        at = rng.integers(len(fps))
        fps.append(fps[at] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps = sorted(set(fps) | {int(x) for x in rng.integers(0, 1 << 63, 200)})
    signed = [int(np.array(f, dtype=np.uint64).view(np.int64)) for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = groups(fps)
    for bucket in (2, 10_000):
        comps = {r.node: r.root for r in connected_components(S.hamming_links(frame, bucket)).collect()}
        label = [comps.get(s, s) for s in signed]
        assert [label.index(x) for x in label] == want


def test_empty_nulls_and_kept_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(3, "a b c d", "p"), (2, "a b c d", "q"), (2, "a b c d", "q"), (None, "a b c d", "r"), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert {(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()} == {(3, 2), (2, 2), (None, 2), (9, 9)}
    assert sorted(S.keep_one(docs).collect(), key=str) == sorted([(2, "a b c d", "q"), (9, None, None)], key=str)


def test_keep_one_goes_by_row(spark):
    a, b = "one text of its own with several words in it", "another text that stands in two rows of this table"
    schema = "doc_id long, text string, `a.b` string, _near_id long, fp string, doc string, k0 int, root int, m map<string,int>"
    extra = ("x", 1, "y", "z", 3, 4, {"k": 1})
    frame = spark.createDataFrame([(5, a, *extra), (5, b, *extra), (3, b, *extra)], schema)
    got = S.keep_one(frame)
    assert got.columns == frame.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(3, b), (5, a)]
    # without ids one of each group stays too; rows equal throughout are one document
    frame = spark.createDataFrame([(None, a), (None, a), (None, b), (7, b), (7, b), (None, None), (8, ""), (9, "  ")], "doc_id long, text string").repartition(3)
    assert sorted(map(str, map(tuple, S.keep_one(frame).collect()))) == sorted(map(str, [(None, a), (7, b), (8, "")]))


def test_a_hot_fingerprint_is_joined_whole(spark, monkeypatch):
    from meshspark.llm import common

    rows = [(k, "the same text again and again" if k % 3 else f"text number {k} of many {k * k} others {k + 7}") for k in range(6000)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 6000 and {r.component_id for r in got if r.doc_id % 3} == {1}
    left = spark.createDataFrame([(k % 3, k) for k in range(9000)], "key long, v long")
    right = spark.createDataFrame([(0, 3000, "a"), (1, 3000, "b")], "key long, n long, name string")
    assert common.join_hot(left, right, "key", "n", 9000).count() == 6000
    assert common.join_hot(left, right, "key", "n", 9000, "left").where("name is null").count() == 3000
