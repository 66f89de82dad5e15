"""The Merkle manifest against a tree built in Python and against its SQL."""

import hashlib
import zlib

import duckdb

from meshspark.llm import merkle, oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(n):
    langs = ["en", "de", None, "élan", ""]
    rows = [(k, f"Text {k} ÀB" if k % 7 else f"text {k}", langs[0 if k % 3 else k % 5], None if k % 11 == 0 else f"s{k % 4}", k if k % 5 else None, "x", k) for k in range(n)]
    return rows + [(n, "The only one", "lone", "s", 3, "x", 1), (n + 1, None, "en", None, None, "x", 1), (n + 2, "", "en", None, 0, "x", 1), (n + 3, "Long " * 40_000, None, "s", 5, "x", 1)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars, *_):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((own, levels([leaf(*r) for r in own])))
    top = levels([t[-1][0] for _, t in trees])
    out = []
    for place, (own, tree) in enumerate(trees):
        for k, r in enumerate(own):
            tampered = zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 3 == 0
            now, proof = leaf(r[0], r[1] and r[1].translate(LOWER) if tampered else r[1], *r[2:]), ""
            for levels_, at in ((tree, k), (top, place)):
                for level in levels_[:-1]:
                    first = at // 8 * 8
                    run = level[first : first + 8]
                    proof += "".join(run[: at - first] + run[at - first + 1 :])
                    run[at - first] = now
                    now, at = sha("".join(run)), at // 8
            out.append((r[0], tree[0][k], tree[-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return out


def found(frame):
    rows = frame.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=str)


def test_against_a_plain_tree_and_sql(spark):
    rows = docs(1300)  # two blocks and a part in one tree, four levels
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    got = found(merkle.manifest(frame))
    assert got == sorted(expected(rows), key=str)
    assert {r[-1] for r in got} == {True, False}
    con = duckdb.connect()
    con.register("documents", frame.toPandas().astype({"n_chars": "Int64"}))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({oracle.manifest_sql()})").fetchall(), key=str)


def test_sizes_at_the_edges_of_runs(spark):
    for n in (1, 513):
        rows = [(k, f"T{k}", "en", "s", k, "x", 1) for k in range(n)]
        assert found(merkle.manifest(spark.createDataFrame(rows, DOCS))) == sorted(expected(rows), key=str)


def test_repeats_null_ids_other_names_and_empty_tables(spark):
    rows = [(1, "A", "en", "s", 1, "x", 1)] * 20 + [(1, "B", "en", "s", 1, "x", 1)] * 3 + [(None, "C", "en", "s", 1, "x", 1), (None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    want = sorted(expected(rows), key=str)
    assert found(merkle.manifest(frame)) == want
    named = frame.withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "at").withColumnRenamed("lang", "level")
    assert found(merkle.manifest(named, id_col="a.b", text_col="at", lang_col="level")) == want
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
