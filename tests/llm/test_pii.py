import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from meshspark.llm import pii

DOCS = "doc_id long, text string, spans string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def texts():
    rng = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-1234", "+12", "é", "..", "_", "%", "0001.2.3.4", "+49 30 123456-7)", "5500005555555559", "12", " ", "\n"]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(1500)]
    return out + ["", "a" * 20000 + "@", "1" * 20000, "a@" * 3000, "+1" * 3000, "1." * 5000, "é@ü.de a@b.c@d.e 漢字 x@y.z"]


def test_base_spans_against_the_patterns():
    for t in texts():
        if len(t) < 15000:
            assert pii.base_spans(t) == plain(t), t
        else:
            pii.base_spans(t)


def evidence():
    rng = random.Random(1)
    rows = []
    for k in range(400):
        w = [f"w{rng.randrange(3000)}" for _ in range(60)]
        if k % 40 == 0:
            w[30:30] = ["Zorblatt,", "bob@x.example.com"]
        elif k % 40 == 1:
            w[30:30] = ["common", "bob@x.example.com"]
        elif k % 3 == 0:
            w[10] = "common"
        rows.append((k, " ".join(w), "s"))
    return rows + [(1000 + k, "hello unique words here amy@x.example.org follow these rare terms", "s") for k in range(30)]


def test_revealing_terms_and_digest(spark):
    rows = evidence() + [(5000, None, "s"), (5001, "", None), (None, "call +1 (234) 555-1234 now", "s"), (40, evidence()[40][1], "s")]
    frame = spark.createDataFrame(rows, DOCS).repartition(6)
    got = pii.digest(pii.find(frame)).collect()
    assert len(got) == len(rows)
    of = dict((r[0], r[1] or "") for r in rows)
    for r in got:
        base = plain(of[r.doc_id])
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        more = [s.split(":") for s in r.spans.split(",")[len(base) :]] if r.spans != named else []
        assert r.spans.startswith(named)
        # only the name that stands by the address, and nowhere else, tells it; copies of a text tell nothing
        assert [of[r.doc_id][int(a) : int(b)] for _, a, b in more] == (["Zorblatt"] if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 40 == 0 else [])


def test_sanitised_texts(spark):
    frame = spark.createDataFrame([*evidence(), (9, None, None), (40, evidence()[40][1], "again")], DOCS)
    got = pii.sanitise(frame)
    assert got.columns == frame.columns
    rows = {(r.doc_id, r.spans): r.text for r in got.collect()}
    assert len(rows) == 432 and rows[(9, None)] is None or rows[(9, "s")]
    assert "<NAME>, <EMAIL>" in rows[(40, "s")] and rows[(40, "again")] == rows[(40, "s")] and "common <EMAIL>" in rows[(41, "s")]
    assert rows[(1000, "s")] == "hello unique words here <EMAIL> follow these rare terms" and rows[(2, "s")] == evidence()[2][1]
    empty = spark.createDataFrame([], DOCS)
    assert pii.find(empty).collect() == [] and pii.sanitise(empty).collect() == []


def test_counts_pass_the_filter_exactly(spark):
    frame = spark.createDataFrame([(k, f"alpha {'beta' if k % 3 else 'Beta,'} beta w{k}", "") for k in range(50)], DOCS)
    terms = spark.createDataFrame([("beta",), ("w7",), ("absent",)], "term string")
    hashed = terms.select("term", F.xxhash64("term").alias("t"))
    assert {r.term: r.df for r in pii.document_counts(frame, hashed).collect()} == {"beta": 50, "w7": 1}


def test_terms_far_from_the_entity_and_few_texts(spark):
    """A name 20 words and more from an address that three texts hold, all with a shared word that has the least hash."""
    rng = random.Random(6)
    filler = lambda n: [f"v{rng.randrange(40_000)}" for _ in range(n)]
    rows = [(k, " ".join(["contact", *filler(40)]), "s") for k in range(1500)]
    rows += [(2000 + k, " ".join(["contact", "Quillfeather", *filler(20), "eve@x.example.net", *filler(20), "(quillfeather)"]), "s") for k in range(3)]
    rows += [(3000 + k, rows[0][1] + " onlycopies ann@x.example.net", "s") for k in range(50)]
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    more = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == pii.TERM] for r in pii.find(frame).collect()}
    of = {r[0]: r[1] for r in rows}
    assert {k: [of[k][a:b] for a, b in v] for k, v in more.items() if v} == {2000 + k: ["Quillfeather", "quillfeather"] for k in range(3)}


def test_copies_count_once(spark):
    frame = spark.createDataFrame([(k, "alpha same" if k < 30 else f"alpha other{k}", "") for k in range(40)], DOCS)
    terms = spark.createDataFrame([("alpha",), ("same",)], "term string")
    copied = spark.createDataFrame([(pii.text_key_of(b"alpha same"),)], "copy long")
    hashed = terms.select("term", F.xxhash64("term").alias("t"))
    assert {r.term: r.df for r in pii.document_counts(frame, hashed, copied=copied).collect()} == {"alpha": 11, "same": 1}


def brute_force(rows):
    """(entity, term) pairs that disclose too much, counted in plain Python from the definition."""
    texts = {t for _, t in rows if t is not None}
    n = len({*texts, *([""] if any(t is None for _, t in rows) else [])})
    df, entity_df, both = {}, {}, {}
    for t in texts:
        own = pii.base_spans(t)
        own += pii.secret_spans(t, own)
        entities = {e for k, a, b in own for e in pii.entities_of(k, t[a:b])}
        words = {pii.term_of(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)} - {""}
        outside = {w for w, _, _ in pii.terms_of(t, own)}
        for w in words:
            df[w] = df.get(w, 0) + 1
        for e in entities:
            entity_df[e] = entity_df.get(e, 0) + 1
            for w in outside:
                both[e, w] = both.get((e, w), 0) + 1
    many = {p: b for p, b in both.items() if entity_df[p[0]] > 1}
    bound = math.log(pii.CHANCE / max(1, len(many)))
    xlogx = lambda x: x * math.log(max(x, 1))
    out = set()
    for (e, w), b in many.items():
        k, ic = entity_df[e], math.log2(n / entity_df[e])
        ways = xlogx(k) - xlogx(b) - xlogx(k - b)
        if b > 1 and ic > 0 and math.log2(b * n / (k * df[w])) >= pii.DISCLOSED * ic and ways + b * math.log(df[w] / n) <= bound:
            out.add((e, w))
    return out


def test_pairs_against_brute_force_on_unplanted_text(spark):
    """Texts drawn at random: addresses of three domains, secrets after one word that nothing else uses."""
    rng = random.Random(12)
    rows = []
    for k in range(900):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(5, 60))]
        if k % 5 == 0:
            words.insert(3, f"u{rng.randrange(60)}@d{rng.randrange(3)}.example.com")
        if k % 9 == 0:
            words[2:2] = ["token", "=", f'"{rng.getrandbits(160):040x}"']
        rows.append((k, " ".join(words)))
    rows += [(2000 + k, rows[k % 4][1]) for k in range(40)] + [(3000, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_force(rows)
    assert ("secret", "token") in want
    asked = frame.selectExpr("doc_id", "cast(spark_partition_id() as long) as task", "text")
    found = asked.mapInArrow(pii._find, pii.FOUND).cache()
    assert {(r.e, r.t) for r in pii.disclosing(frame, found).collect()} == {tuple(pii.hash_of(x.encode()) for x in pair) for pair in want}
    spans = pii.find(frame).collect()
    of = dict(rows)
    for r in spans:
        text = of[r.doc_id] or ""
        own = pii.base_spans(text)
        secrets = pii.secret_spans(text, own)
        entities = {e for k, a, b in own + secrets for e in pii.entities_of(k, text[a:b])}
        terms = [(pii.TERM, a, b) for w, a, b in pii.terms_of(text, own + secrets) if any((e, w) in want for e in entities)]
        assert [tuple(x) for x in r.spans] == own + secrets + sorted(terms)


def test_secrets_and_classes():
    text = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" password=b7db7aa4a5fcc78305, plain-words-and-2020 internationalisation me@mail7a8b9c0d1e2f3.example.com'
    own = pii.base_spans(text)
    assert [text[a:b] for _, a, b in pii.secret_spans(text, own)] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "b7db7aa4a5fcc78305"]
    assert pii.replace("Ann 12b me", [(pii.TERM, 0, 3), (pii.TERM, 4, 7), (pii.TERM, 8, 10)]) == "<NAME> <NUMBER> <WORD>"
    assert pii.entities_of("ip", "1.2.3.4") == ("ip 1.2.3.4", "ip part 1.2.3.", "ip") and pii.entities_of("email", "A@B.c")[1] == "email part @b.c"


def test_long_texts_with_very_many_entities(spark):
    """Addresses that two long texts share are one class: as many pairs as terms, and all term spans are found."""
    rng = random.Random(5)
    shared = [f"user{k}@host{k % 97}.example" for k in range(3000)]
    long = " ".join(f"{a} w{rng.randrange(4000)} v{rng.randrange(4000)}" for a in shared)
    other = " ".join(f"{a} u{rng.randrange(4000)}" for a in shared[:2000])
    rows = [(0, long), (1, other)] + [(10 + k, f"write to ann@site.example about zebra{'' if k % 2 else 's'} {k}") for k in range(8)] + [(100 + k, f"plain words {k} and {k + 1}") for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = frame.select("doc_id", F.lit(0).cast("long").alias("task"), "text").repartition(1).mapInArrow(pii._find, pii.FOUND)
    entities, _ = pii.disclosing_classes(frame, found)
    assert entities.count() > 2000
    assert entities.select("c").distinct().count() < 10
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == pii.TERM] for r in pii.find(frame).collect()}
    texts = dict(rows)
    assert all(texts[k][a:b] for k in spans for a, b in spans[k])
    assert {texts[k][a:b] for k in range(10, 18) for a, b in spans[k]} == {"zebra", "zebras", "write", "to", "about"}
    assert not spans[0] and not spans[1] and not any(spans[k] for k in range(100, 3100))


def test_secrets_are_those_outside_all_spans():
    rng = random.Random(8)
    for _ in range(50):
        text = " ".join(rng.choice(["a1b2c3d4e5f6g7h8", "x9y8z7w6v5u4t3s2@b.example", "+49 30 1234 5678", "words", "10.1.2.3"]) for _ in range(40))
        own = pii.base_spans(text)
        apart = [m.span() for m in re.finditer("[A-Za-z0-9+/_-]{16,}+", text) if not any(x < m.end() and m.start() < y for _, x, y in own)]
        assert [(a, b) for _, a, b in pii.secret_spans(text, own)] == [s for s in apart if re.search("[0-9][A-Za-z]", text[slice(*s)])]
