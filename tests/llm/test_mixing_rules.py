import math
import random

import duckdb
import pytest

from meshspark.llm import mixing, oracle, quality_rules, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_words string"


def docs():
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(20 + k % 60)), "en", f"s{k % 4}", "x") for k in range(300)]
    rows += [(1000, None, None, None, None), (1001, "", "en", None, None), (1002, "one two " * 30, "en", "s1", None), (1003, "a # b | " * 20, None, "s9", None), (1004, "line\nline\n\nline\n" * 9, "en", "s1", None), (1005, "é ü  漢字\t\x0bx " * 50, "en", "s2", None)]
    return rows + [(7, *rows[7][1:]), (1006, " ".join(f"long{k}" for k in range(20000)), "en", "s3", None)]


def compare(spark, con, frame, sql):
    got = sorted(map(str, (tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())))
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert sorted(names) == sorted(frame.columns)
    assert got == sorted(str(tuple(r[k] for k in order)) for r in result.fetchall())


@pytest.fixture()
def tables(spark, tmp_path):
    unique = [r for k, r in enumerate(docs()) if r[0] not in {x[0] for x in docs()[:k]}]
    frame = spark.createDataFrame(unique, DOCS)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return spark.read.parquet(str(tmp_path / "documents.parquet")), con


def test_rules_and_mix_against_sql(spark, tables):
    frame, con = tables
    compare(spark, con, quality_rules.judge(frame), oracle.quality_rules_sql())
    compare(spark, con, mixing.mix(frame), oracle.mixing_sql())


def test_repeats_and_empty_tables(spark):
    rows = quality_rules.judge(spark.createDataFrame(docs(), DOCS)).collect()
    assert len(rows) == len(docs())
    by = {r.doc_id: r for r in rows}
    assert (by[1000].n_words, by[1000].base_failed, by[1000].kept) == (0, True, False)
    assert (by[1002].n_repeat_words, by[1002].base_failed) == (60, True) and by[1004].n_dup_lines == 26
    assert by[1003].n_symbols == 40 and by[1005].word_chars == 50 * 5
    mixed = mixing.mix(spark.createDataFrame(docs(), DOCS)).collect()
    assert len(mixed) == len(docs()) and all(r.taken <= 3 * r.size for r in mixed)
    empty = spark.createDataFrame([], DOCS)
    assert quality_rules.judge(empty).collect() == [] and mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


def test_targets_by_filling(spark):
    sizes = {"a": 10, "b": 900, "c": 50, "d": 40, None: 1000}
    sized = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    order = ["a", "b", "c", "d", None]
    weight = dict(zip(order, (5, 2, 1, 5, 2), strict=True))
    want, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert got == pytest.approx(want)


def test_mixed_documents_hold_what_is_taken(spark):
    frame = spark.createDataFrame([r for r in docs() if r[0] < 1000][:300], DOCS)
    taken = {r.doc_id: r.taken for r in mixing.mix(frame).collect() if r.taken}
    got: dict = {}
    for r in mixing.mixed_documents(frame).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == taken


RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def test_url_filter(spark, tmp_path):
    urls = [f"http{'s' * (k % 2)}://{h}.example.{t}/{lang}/{k * 37 % 900}{'?q#x' * (k % 3)}" for k in range(60) for h in ("www", "cheap-pills") for t in ("com", "net", "org") for lang in ("en", "de", "es")]
    urls += [None, "", "no scheme", "x://", "x://HOST?q", "ftp://com/en/", "http://ecom/en/", "http://COM/en/x://y", "a://b.net/de/\nz", "http://exämple.net/de/8"]
    frame = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    judged = url_filter.judge(frame, RULES)
    compare(spark, con, judged.drop("ratio"), oracle.url_filter_sql(RULES))
    by = {r.page_id: r for r in judged.collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        assert (by[k].host, by[k].path, by[k].rule) == (host, path, best and best[1] + best[2])
        if best:
            assert by[k].verdict == best[0]
    assert url_filter.judge(spark.createDataFrame([], frame.schema), RULES).collect() == []
    alone = url_filter.judge(spark.createDataFrame([(1, "http://a.fr/x", "")], frame.schema), ()).collect()
    assert [(r.verdict, r.ratio) for r in alone] == [("allow", 0.0)]


OUTLIERS = {
    "symbols_per_word": lambda w: " ".join(x + "#$%" for x in w),
    "exclaims_per_word": lambda w: " ".join(x + "!!" for x in w),
    "dup_line_share": lambda w: "\n".join(" ".join(w[k : k + 5]) for k in range(0, len(w), 5)) + "\n" + "\n".join(["a line seen"] * 60),
    "repeat_share": lambda w: " ".join([*w, *w[:70]]),
    "upper_share": lambda w: " ".join(w).upper(),
    "mean_word_chars": lambda w: " ".join(x + "abcdefghijkl"[k % 9 :] for k, x in enumerate(w)),
    "short_word_share": lambda w: " ".join(f"{x[0]}{k}"[:3] for k, x in enumerate(w)),
    "distinct_word_share": lambda w: " ".join(random.Random(2).choices(w[:40], k=len(w))),
}


def prose(rng, n=300):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.choice((2, 3, 4, 5, 6, 7)))) for _ in range(n)]


@pytest.mark.parametrize("measure", list(OUTLIERS))
def test_each_measure_rejects_an_outlier_that_the_base_lets_pass(spark, measure):
    rng = random.Random(5)
    rows = [(k, " ".join(prose(rng)), "en", "s1", None) for k in range(60)] + [(1000, OUTLIERS[measure](prose(rng, 440)), "en", "s1", None)]
    measured = quality_rules.base_measures(spark.createDataFrame(rows, DOCS).drop("n_words")).drop("text").collect()
    outlier = next(r for r in measured if r.doc_id == 1000)
    assert not outlier.base_failed
    limit = quality_rules.thresholds(quality_rules.sketches(spark.createDataFrame(measured))).first()
    _, chance, per = quality_rules.MEASURES[measure]
    room = chance / (outlier.n_words**0.5 if per == "root" else max(1, outlier[per]))
    assert not limit[f"low_{measure}"] - room <= outlier[measure] <= limit[f"high_{measure}"] + room
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not kept[1000] and all(kept[k] for k in range(60))


def test_groups_of_any_size_are_judged_alike(spark):
    """Quartiles move with the number of rows by no leap."""
    def limit(n):
        rng = random.Random(7)
        rows = [(k, " ".join(prose(rng)), "en", "s1", None) for k in range(400)]
        rows += [(5000 + k, " ".join(x * 3 for x in prose(rng)), "en", "s2", None) for k in range(n)]
        found = quality_rules.thresholds(quality_rules.sketches(quality_rules.base_measures(spark.createDataFrame(rows, DOCS).drop("n_words")).drop("text"))).collect()
        return next(r.high_mean_word_chars for r in found if r.g_source == "s2")

    few, more, many = limit(20), limit(40), limit(100)
    assert few < more < many and many - few > 1 and max(more - few, many - more) < 4


def test_url_models_are_the_smoothed_markov_models(spark):
    """With all n-grams kept, the ratio is the difference of two interpolated models, position by position."""
    judged = [("a.net/de/1", True), ("b.net/de/22", True), ("a.com/en/7", False), ("spam.org/es/x", False), ("spam.org/es/yy", False)]
    frame = spark.createDataFrame(judged, "model_text string, accepted boolean")
    asked = ["a.net/de/1", "q.org/es/x!", "", "zzz"]
    model = url_filter.train(frame, None)
    got = {r.model_text: r.ratio for r in url_filter.score(spark.createDataFrame([(t,) for t in asked], "model_text string"), model, "model_text", False).collect()}

    def probability(accepted, context, char):
        counts, total, tail = 0, 0, context
        for text, kind in judged:
            if kind == accepted:
                padded = url_filter.BEGIN * url_filter.ORDER + text + url_filter.END
                for k in range(url_filter.ORDER, len(padded)):
                    if padded[k - len(tail) : k] == tail:
                        total += 1
                        counts += padded[k] == char
        lower = probability(accepted, context[1:], char) if context else 1 / url_filter.ALPHABET
        return (counts + url_filter.WEIGHT * lower) / (total + url_filter.WEIGHT)

    for text in asked:
        padded = url_filter.BEGIN * url_filter.ORDER + text + url_filter.END
        steps = [math.log(probability(True, padded[k - 4 : k], padded[k]) / probability(False, padded[k - 4 : k], padded[k])) for k in range(4, len(padded))]
        assert got[text] == pytest.approx(sum(steps) / len(steps), abs=1e-9)
