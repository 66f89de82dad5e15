"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that reveal them.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers; the method adds machine-made secrets (runs
of at least 16 letters, digits and ``+/_-`` in which letters and digits change at least four times). What a text holds is
protected at three levels: the value itself, the part of it that others share (domain, network, issuer, exchange) and its
kind. A term in the texts that hold such an entity reveals it in so far as seeing the term makes the entity likely: with
frequencies over the corpus's different texts, PMI(entity; term) = log2(p(entity, term) / (p(entity) p(term))) bits of the
entity's IC = -log2 p(entity) are disclosed. A term that discloses at least DISCLOSED of the entity, and whose texts with
the entity chance would not bring (CHANCE, over all pairs looked at), becomes a span of kind ``term`` wherever it stands
in a text that holds that entity. Sanitising generalises spans: values to their kind, terms to the class of their writing.

Texts of one hash count once everywhere, so copies of a text are no evidence.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from .common import join_hot, quoted, slices, split_words, store, unwrapped, wrapped

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
DISCLOSED = 0.8
#: Bound of the probability that any term that is independent of its entity is taken.
CHANCE = 0.01
#: Bits of the filter through which words pass to be counted; the exact join comes after.
FILTER_BITS = 1 << 23
#: Terms are first counted in these parts of all texts, which bounds their frequency from below and rules most out.
PARTS = (64, 8)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins at the first digit of a run, for one that begins later would fail in the same way
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")
_LONG = re.compile("[A-Za-z0-9+/_-]{16,}+")
_CHANGES = re.compile("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")
_MIXED = re.compile("[0-9][A-Za-z]").search
LEAST_CHANGES = 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", end if domain else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and start: leftmost matches that pass their kind's test."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs that look machine-made and lie outside all spans of the base, which are walked once beside the runs."""
    out, at, end = [], 0, 0
    taken = sorted((a, b) for _, a, b in base)
    for m in _LONG.finditer(text) if _MIXED(text) else ():
        a, b = m.span()
        while at < len(taken) and taken[at][0] < b:
            end = max(end, taken[at][1])
            at += 1
        if end <= a and sum(1 for _ in _CHANGES.finditer(m[0])) >= LEAST_CHANGES:
            out.append((SECRET, a, b))
    return out


def term_of(word: str) -> str:
    """A word as a term: A-Z lower-cased, without ASCII punctuation at its ends; empty if nothing is left."""
    return word.translate(_LOWER).strip(_EDGES)


def entity_of(kind: str, text: str) -> str:
    return f"{kind} {text.translate(_LOWER) if kind in ('email', 'ip') else text if kind == SECRET else _NO_DIGIT.sub('', text)}"


def entities_of(kind: str, text: str) -> tuple[str, ...]:
    """The value, the part that other values share, and the kind."""
    whole = entity_of(kind, text)
    value = whole[len(kind) + 1 :]
    if kind == "email":
        part = value[value.index("@") :]
    elif kind == "ip":
        part = value[: value.rindex(".") + 1]
    elif kind == "card":
        part = value[:6]
    elif kind == "phone":
        part = value[:-4]
    else:
        return whole, kind
    return whole, f"{kind} part {part}", kind


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all words of a text that lie outside all spans."""
    out, at, end = [], 0, 0
    taken = sorted((a, b) for _, a, b in spans)
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][0] < b:
            end = max(end, taken[at][1])
            at += 1
        word = m[0]
        if end <= a and (term := term_of(word)):
            skip = len(word) - len(word.translate(_LOWER).lstrip(_EDGES))
            out.append((term, a + skip, a + skip + len(term)))
    return out


def text_key_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


SPAN = "struct<kind:string,start:long,end:long>"
FOUND = f"doc_id long, task long, at long, copy long, spans array<{SPAN}>, entities array<string>, terms array<struct<term:string,start:long,end:long>>"


def _structs(offsets: list[int], **columns: pa.Array) -> pa.Array:
    """A list of structs for each row, from flat columns and where each row's begin."""
    flat = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, task, text, other columns) -> FOUND and the other columns; terms only of texts that hold an entity."""
    at = 0
    for whole in batches:
        for low, texts in slices(whole.column(2), 2 << 20, 2_000):
            copies: list[int] = []
            entities: list[list[str]] = []
            # flat columns, for a long text has very many terms
            span_of, term_of_, spans, starts, ends, words = [0], [0], [], array("q"), array("q"), []
            for raw in texts:
                raw = raw.as_py()
                text = raw.decode()
                own = base_spans(text)
                own += secret_spans(text, own)
                copies.append(text_key_of(raw))
                spans += own
                entities.append(sorted({e for k, a, b in own for e in entities_of(k, text[a:b])}))
                for word, a, b in terms_of(text, own) if own else ():
                    words.append(word)
                    starts.append(a)
                    ends.append(b)
                span_of.append(len(spans))
                term_of_.append(len(words))
            batch = whole.slice(low, len(copies))
            kinds, firsts, lasts = zip(*spans, strict=True) if spans else ((), (), ())
            found = [
                pa.array(np.arange(at, at + len(copies)), pa.int64()), pa.array(copies, pa.int64()),
                _structs(span_of, kind=pa.array(kinds, pa.string()), start=pa.array(firsts, pa.int64()), end=pa.array(lasts, pa.int64())),
                pa.array(entities, pa.list_(pa.string())),
                _structs(term_of_, term=pa.array(words, pa.string()), start=pa.array(np.frombuffer(starts, dtype=np.int64)), end=pa.array(np.frombuffer(ends, dtype=np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found, *batch.columns[3:]], names=["doc_id", "task", "at", "copy", "spans", "entities", "terms", *batch.schema.names[3:]])
            at += batch.num_rows


def hash_of(data: bytes) -> int:
    """As Spark's xxhash64 has it."""
    return (xxhash.xxh64_intdigest(data, 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def _slots(*keys: np.ndarray) -> np.ndarray:
    """The filter's slot of 64-bit keys, mixed one after the other."""
    mixed = np.zeros((), dtype=np.uint64)
    for key in keys:
        mixed = (mixed ^ key.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = mixed ^ (mixed >> np.uint64(32))
    return (mixed % np.uint64(FILTER_BITS)).astype(np.int64)


def _passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def _filter(keys: DataFrame) -> bytes:
    """The bit filter of rows of long keys, of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _slots(*[batch.column(k).to_numpy() for k in range(batch.num_columns)]) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots)], names=["slot"])

    slots = keys.mapInArrow(run, "slot long")
    word = slots.groupBy(F.floor(F.col("slot") / 32).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 AS int))")).alias("word"))
    whole = np.zeros(FILTER_BITS // 32, dtype="<u4")
    for row in word.collect():  # at most FILTER_BITS / 32 rows
        whole[row["at"]] = row["word"]
    return whole.tobytes()


def _term_hashes(words: pa.Array) -> np.ndarray:
    """The hash of each word's term; 0 where nothing is left of it."""
    edges = _EDGES.encode()
    out = np.zeros(len(words), dtype=np.int64)
    for k, word in enumerate(words.to_pylist()):
        if term := word.lower().strip(edges):
            out[k] = hash_of(term)
    return out


COUNTED = "copy long, t long, n long, terms array<long>"


def document_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text", copied: DataFrame | None = None) -> DataFrame:
    """(t, df): in how many different texts each term of hash ``t`` occurs; ``copied`` (copy) has the keys of repeated texts.

    Words reach the shuffle only through a bit filter of fixed size made from the terms, counted per task. A second such
    filter holds the repeated texts' keys: what passes it gives one row with its terms, and such rows of one key count once.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((_filter(terms.select("t")), _filter(copied.select("copy")) if copied is not None else bytes(FILTER_BITS // 8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, twice = (np.frombuffer(x, dtype=np.uint8) for x in shared.value)
        once: list[np.ndarray] = []
        kept: dict[int, list[int]] = {}  # the terms of texts that may be repeated

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(once) if once else np.zeros(0, dtype=np.int64), return_counts=True)
            m = len(kept)
            none = [None] * m
            columns = [[None] * len(t) + list(kept), [*t.tolist(), *none], [*n.tolist(), *none], [None] * len(t) + list(kept.values())]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            once.clear(), kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["copy", "t", "n", "terms"])

        size = 0
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                words, per_text = split_words(texts)
                coded = words.dictionary_encode()
                terms = _term_hashes(coded.dictionary)
                hit = _passes(asked, _slots(terms)) & (terms != 0) if len(terms) else np.zeros(0, dtype=bool)
                place = coded.indices.to_numpy(zero_copy_only=False)
                use = np.flatnonzero(hit[place]) if len(terms) else place[:0]
                if not len(use):
                    continue
                text = np.repeat(np.arange(len(per_text)), per_text)[use]
                distinct, term = np.unique(terms[place[use]], return_inverse=True)
                pair = np.unique(text * len(distinct) + term)
                text, term = pair // len(distinct), distinct[pair % len(distinct)]
                some, starts = np.unique(text, return_index=True)
                keys = np.array([text_key_of(texts[int(k)].as_py()) for k in some], dtype=np.int64)
                again = _passes(twice, _slots(keys))
                once.append(term[~np.repeat(again, np.diff(np.append(starts, len(term))))])
                for k in np.flatnonzero(again):
                    kept[int(keys[k])] = term[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(term)].tolist()
                size += len(term)
                if size > 1_000_000 or len(kept) > 1_000:
                    yield flush()
                    size = 0
        yield flush()

    counted = store(docs.select(quoted(text_col).cast("string")).mapInArrow(run, COUNTED), "counted")
    again = counted.where("copy is not null").dropDuplicates(["copy"]).select(F.explode("terms").alias("t"), F.lit(1).cast("long").alias("n"))
    sums = counted.where("copy is null").select("t", "n").unionByName(again).groupBy("t").agg(F.sum("n").alias("df"))
    return terms.join(sums, "t")


def disclosing_classes(docs: DataFrame, found: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((e, c, entity_df): entities and their classes, (c, t): the classes and terms that disclose too much of them).

    Entities that the same texts hold have the same counts with every term, so they are one class: a text with very many
    addresses brings as many classes as there are different sets of texts that share them, not a row for each address and
    term. A pair counts for something only in two texts at least, one of which is not the longest that holds the class;
    so pairs come from the others, and those found are looked up in the longest.
    """
    seen = store(found.groupBy("copy").agg(F.count("*").alias("rows")), "copies")
    n_docs = float(max(1, seen.count()))
    hashes = lambda column: F.array_distinct(F.transform(column, lambda x: F.xxhash64(x)))
    holding = found.where(F.size("entities") > 0).select("copy", hashes("entities").alias("entities"), hashes(F.transform("terms", lambda t: t.term)).alias("terms")).dropDuplicates(["copy"])
    holding = store(holding, "holding")
    # an entity or a term in one text alone tells nothing: whatever stands there may do so by chance
    each = holding.select("copy", F.size("terms").cast("long").alias("n_terms"), F.explode("entities").alias("e"))
    mixed = F.xxhash64("copy", F.lit(1))
    texts = F.xxhash64(F.count("*"), F.sum(F.xxhash64("copy").cast("decimal(38,0)")), F.bit_xor(mixed))  # of the set of texts, of one size at any number
    longest = F.max(F.struct("n_terms", "copy"))
    entities = each.groupBy("e").agg(F.count("*").alias("entity_df"), texts.alias("c"), longest.alias("longest")).where("entity_df > 1")
    entities = store(entities.select("e", "entity_df", "c", F.col("longest.copy").alias("longest"), F.col("longest.n_terms").alias("most")), "entities")
    classes = store(entities.groupBy("c").agg(F.first("entity_df").alias("entity_df"), F.first("longest").alias("longest"), F.first("most").alias("most"), F.count("*").alias("members")), "classes")
    of = join_hot(each.drop("n_terms"), entities, "e", "entity_df", each.count()).where("copy <> longest").groupBy("copy").agg(F.collect_set("c").alias("recurring"))
    pairs = holding.join(of, "copy").select(F.explode("recurring").alias("c"), "terms").select("c", F.explode("terms").alias("t"))
    others = pairs.groupBy("c", "t").agg(F.count("*").alias("others")).join(classes, "c")
    long = holding.join(classes.select(F.col("longest").alias("copy")).distinct(), "copy").select(F.col("copy").alias("longest"), F.explode("terms").alias("t"), F.lit(1).alias("more"))
    both = store(others.join(long, ["longest", "t"], "left").select("c", "t", "members", "entity_df", (F.col("others") + F.coalesce("more", F.lit(0))).alias("both"), F.isnull("more").alias("apart")), "both")
    # all pairs of an entity and a term: those of its longest text, and those found in the others alone
    elsewhere = both.where("apart").agg(F.sum("members").alias("n")).first().n or 0
    looked_at = elsewhere + (classes.agg(F.sum(F.col("members") * F.col("most")).alias("n")).first().n or 0)
    bound = float(np.log(CHANCE / max(1, looked_at)))
    xlogx = lambda x: x * F.log(F.greatest(x, F.lit(1)))
    e, b = F.col("entity_df"), F.col("both")
    ways = xlogx(e) - xlogx(b) - xlogx(e - b)  # at least the logarithm of the ways to choose the texts
    pmi, ic = F.log2(b * n_docs / (e * F.col("df"))), F.log2(n_docs / e)
    enough = (ic > 0) & (pmi >= DISCLOSED * ic) & (ways + b * F.log(F.col("df") / n_docs) <= bound)
    # a term is in as many texts at least as in those that hold an entity, and as in any part of all texts; what these
    # bounds leave is few, and is counted in all texts
    least = holding.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    more = both.where("both > 1").where(ways + b * F.log(b / n_docs) <= bound).select("c", "t", "entity_df", "both")
    apart = store(more.join(least, "t").where(enough).drop("df"), "apart")
    repeated = seen.where("rows > 1")
    for part in PARTS:
        some = docs.where(F.pmod(F.xxhash64(quoted(text_col).cast("string")), F.lit(part)) == 0)
        fewer = document_counts(some, apart.select("t").distinct(), text_col, repeated)
        apart = store(apart.join(fewer, "t", "left").where(F.col("df").isNull() | enough).drop("df"), "apart")
    counts = document_counts(docs, apart.select("t").distinct(), text_col, repeated)
    return entities.select("e", "c", "entity_df"), apart.join(counts, "t").where(enough).select("c", "t")


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(e, t): the hashes of the pairs of an entity and a term that discloses too much of it."""
    entities, pairs = disclosing_classes(docs, found, text_col)
    return entities.join(pairs, "c").select("e", "t")


#: Pairs of a class and a term that a worker looks up in the filter at a time.
LOOKED_UP = 1 << 20


def term_spans(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(task, at, terms): the spans that the method adds, in order; only rows that have some.

    A text's entities and terms are first cut down to those in any disclosing pair, then its entities to their classes;
    what is left is looked up in blocks, so a text with very many of both takes no more memory than others.
    """
    entities, pairs = disclosing_classes(docs, found, text_col)
    pairs = store(pairs, "pairs")
    members = store(entities.join(pairs.select("c").distinct(), "c"), "members")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(_filter(keys) for keys in (members.select("e"), pairs.select("t"), pairs.select("c", "t"))))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(x, dtype=np.uint8) for x in shared.value[:2]]
        for batch in batches:
            rows, kept = [], ([], [])
            for k, lists in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                some = [np.unique(x.values.to_numpy()) for x in lists]
                some = [x[_passes(own, _slots(x))] for own, x in zip(bits, some, strict=True)]
                if len(some[0]) and len(some[1]):
                    rows.append(k)
                    for column, values in zip(kept, some, strict=True):
                        column.append(values)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c) if c else [], pa.int64())) for c in kept]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *lists], names=["task", "at", "e", "t"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value[2], dtype=np.uint8)
        for batch in batches:
            for task, at, classes, terms in zip(*batch.columns, strict=True):
                c, t = classes.values.to_numpy(), terms.values.to_numpy()
                step = max(1, LOOKED_UP // len(t))
                for low in range(0, len(c), step):
                    a, b = np.nonzero(_passes(bits, _slots(c[low : low + step, None], t[None, :])))
                    columns = [pa.repeat(task, len(a)), pa.repeat(at, len(a)), pa.array(c[low + a]), pa.array(t[b])]
                    yield pa.RecordBatch.from_arrays(columns, names=["task", "at", "c", "t"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, columns = [0], ([], [])
            for row in zip(*batch.columns[2:], strict=True):
                t, asked, start, end = (x.values.to_numpy() for x in row)
                hit = np.isin(t, asked)
                ends.append(ends[-1] + int(hit.sum()))
                for column, values in zip(columns, (start, end), strict=True):
                    column.append(values[hit])
            first, last = (pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _structs(ends, kind=pa.array([TERM] * ends[-1], pa.string()), start=first, end=last)], names=["task", "at", "terms"])

    holding = found.where(F.size("entities") > 0)
    hashes = lambda column: F.transform(column, lambda x: F.xxhash64(x))
    words = hashes(F.transform("terms", lambda t: t.term)).alias("t")
    met = store(holding.select("task", "at", hashes("entities").alias("e"), words).mapInArrow(sift, "task long, at long, e array<long>, t array<long>"), "met")
    each = met.select("task", "at", F.explode("e").alias("e"))
    classed = join_hot(each, members, "e", "entity_df", each.count()).groupBy("task", "at").agg(F.collect_set("c").alias("c"))
    near = classed.join(met.select("task", "at", "t"), ["task", "at"]).select("task", "at", "c", "t").mapInArrow(meet, "task long, at long, c long, t long")
    asked = near.join(pairs, ["c", "t"]).groupBy("task", "at").agg(F.collect_set("t").alias("asked"))
    hits = holding.select("task", "at", "terms").join(asked, ["task", "at"])
    places = [F.transform("terms", lambda t: t.start).alias("first"), F.transform("terms", lambda t: t.end).alias("last")]
    return hits.select("task", "at", words, "asked", *places).mapInArrow(spans, f"task long, at long, terms array<{SPAN}>")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of every row, base ones by kind and start, then secrets and terms by start.

    Null texts count as empty. Repeated rows and null ids get a row each; copies of a text are no evidence that a term
    reveals anything. An empty table gives no rows.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.spark_partition_id().cast("long").alias("task"), quoted(text_col).cast("string").alias("text"))
    found = store(rows.mapInArrow(_find, FOUND), "found")
    terms = store(term_spans(docs, found, text_col), "terms")
    empty = F.array().cast(f"array<{SPAN}>")
    return found.select("doc_id", "task", "at", "spans").join(terms, ["task", "at"], "left").select("doc_id", F.concat("spans", F.coalesce("terms", empty)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, base_sha256, spans as text, and the counts of secrets, terms and all spans."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    more = [number(SECRET), number(TERM), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), *more)


def class_of(kind: str, text: str) -> str:
    """What a span is generalised to: its kind, and for a term the class of its writing."""
    if kind != TERM:
        return f"<{kind.upper()}>"
    return "<NUMBER>" if any(c.isdigit() for c in text) else "<NAME>" if text[:1].isupper() else "<WORD>"


def replace(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span generalised to its class; of overlapping ones the first to begin stands for all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], class_of(kind, text[start:end])]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of the text generalised, values to <EMAIL>, <IP>, <CARD>, <PHONE> or <SECRET>, terms to
    <NAME>, <NUMBER> or <WORD>; null texts stay null, all other columns as they are.

    Rows are stored beside what is found in them, so only those that hold an entity are dealt to meet their terms.
    """
    text = F.col("doc").getField(text_col).cast("string")
    rows = wrapped(docs).select(F.lit(None).cast("long").alias("doc_id"), F.spark_partition_id().cast("long").alias("task"), text.alias("text"), "doc")
    found = store(rows.mapInArrow(_find, StructType([*_parse_datatype_string(FOUND).fields, rows.schema["doc"]])), "found")
    terms = store(term_spans(docs, found, text_col), "terms")
    held = found.where(F.size("entities") > 0)
    packed = held.select("task", "at", "doc", "spans").join(terms, ["task", "at"], "left").select("doc", text.alias("text"), "spans", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans, terms in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                every = [*spans.as_py(), *(terms.as_py() or [])]
                texts.append(replace(text.as_py(), [(s["kind"], s["start"], s["end"]) for s in every]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=pa.schema([batch.schema.field(0), ("text", pa.string())]))

    cleaned = packed.mapInArrow(run, StructType([packed.schema["doc"], StructField("text", StringType())]))
    same = found.where(F.size("entities") == 0).select("doc", text.alias("text"))
    return unwrapped(same.unionByName(cleaned), docs.columns, {text_col: F.col("text")})
