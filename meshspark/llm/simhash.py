"""SimHash near-duplicates: pigeonring candidate filtering, then the full Hamming check and components.

Two fingerprints at distance 2 or less, cut into a ring of five segments, must have a start from which every
chain of k consecutive segments differs in at most floor(2k/5) bits: 0, 0, 1, 1, 2. The first two budgets are 0,
so candidates meet by equality on two neighbouring segments (about 26 bits, five placements), the longer chains
prune them, and the full distance decides.

A bucket of many different fingerprints (a large group of near copies) is not expanded into pairs: two fingerprints
lie within 2 bits exactly if some word lies within 1 bit of both, so each one is linked to its 65 such words instead.
That is linear and exact; exact copies are merged into one fingerprint before all of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import join_hot, quoted, store, unwrapped, wrapped
from .components import connected_components

SEED = 42
DISTANCE = 2
#: Widths of the ring's segments, from the lowest bit.
SEGMENTS = (13, 13, 13, 13, 12)
#: Buckets with more different fingerprints than this are linked through words one bit away.
PAIR_BUCKET = 32


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """The 64-bit SimHash of the word sequence, as an unsigned integer; 0 without words."""
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return int(hashes[0])
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            marks = np.fromiter((fingerprint((t.as_py() or b"").lower().split(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(marks.view(np.int64))], names=[*batch.schema.names[1:], "fp"])

    return run


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keys: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, k0, k1 .., fp): one row per input row; fp is the fingerprint's 64 bits as a signed long, k0 .. are ``keys``,
    longs. Null texts count as empty."""
    more = [k.cast("long").alias(f"k{n}") for n, k in enumerate(keys)]
    rows = docs.select(quoted(text_col).cast("string").alias("text"), quoted(id_col).cast("long").alias("doc_id"), *more)
    schema = ", ".join(f"{c} long" for c in [*rows.columns[1:], "fp"])
    return rows.mapInArrow(_fingerprints(shingle), schema)


def _segment(fp: Column, k: int) -> Column:
    at = sum(SEGMENTS[:k])
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << SEGMENTS[k]) - 1))


def _chain_ok(diff: Column, start: Column) -> Column:
    """Whether the chains from segment ``start`` of the xor stay within floor(DISTANCE * k / segments)."""
    m = len(SEGMENTS)
    bits = [F.bit_count(_segment(diff, k)) for k in range(m)]
    ok = F.lit(False)
    for i in range(m):
        total, here = F.lit(0), start == i
        for k in range(m):
            total = total + bits[(i + k) % m]
            here = here & (total <= DISTANCE * (k + 1) // m)
        ok = ok | here
    return ok


def hamming_links(fps: DataFrame, bucket: int = PAIR_BUCKET) -> DataFrame:
    """Distinct ``fp`` -> (a, b) links whose closure is that of all pairs within DISTANCE bits."""
    m = len(SEGMENTS)
    keys = F.array(*[F.struct(F.lit(k).alias("i"), (_segment(F.col("fp"), k) * (1 << 13) + _segment(F.col("fp"), (k + 1) % m)).alias("key")) for k in range(m)])
    keyed = fps.select("fp", F.explode(keys).alias("s")).select("fp", "s.i", "s.key")
    met = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = store(keyed.join(met, ["i", "key"]), "ring")
    few = rows.where(F.col("n") <= bucket)
    left, right = few.select("i", "key", F.col("fp").alias("a")), few.select("i", "key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = left.join(right, ["i", "key"]).where("a > b").where(_chain_ok(diff, F.col("i"))).where(F.bit_count(diff) <= DISTANCE).select("a", "b")
    many = rows.where(F.col("n") > bucket).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]
    near = many.select("fp", F.explode(F.array("fp", *flips)).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    hubs = near.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(hubs).distinct()


def groups(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` with other columns -> those and root, a fingerprint that names the component."""
    comps = connected_components(hamming_links(fps.select("fp")))
    return fps.join(comps.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    component_id is the smallest doc_id reachable over links of 2 or fewer differing bits. Texts without words have
    fingerprint zero and are linked like others. Repeated rows each give a row; a null doc_id gives a row with a null
    doc_id and joins its component without naming it (null only if no member has an id). An empty table gives none.
    """
    marks = store(simhash(docs, id_col, text_col, shingle), "simhash")
    fps = store(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fps")
    rooted = groups(fps)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = store(rooted.select("fp", "root", "n").join(named, "root").select("fp", "n", "component_id"), "named")
    total = marks.count()
    return join_hot(marks, final, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _without_maps(kind: DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one of each component, of the smallest id, null last.

    Rows are told apart by two hashes of their columns (map columns aside), never by their id alone, so repeated ids with
    different texts are documents of their own. Of several rows with the smallest id that of the smallest hash stays; rows
    equal throughout are one document.
    """
    fields = [F.col("doc").getField(f.name) for f in docs.schema.fields if _without_maps(f.dataType)]
    keys = (F.xxhash64(*fields), F.xxhash64(F.lit("second"), *fields))
    rows = wrapped(docs, F.col("doc").getField(id_col).alias("id"), F.col("doc").getField(text_col).alias("text"), *[k.alias(f"h{n}") for n, k in enumerate(keys)])
    marks = store(simhash(rows, "id", "text", keys=(F.col("h0"), F.col("h1"))), "simhash")
    # a component's rows are added up by fingerprint first, so no task gets all copies of a text
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("k0").alias("k0"), F.col("k1").alias("k1"))
    fps = store(marks.groupBy("fp").agg(F.min(order).alias("best")), "fps")
    best = store(groups(fps).groupBy("root").agg(F.min("best").alias("best")).select("best.k0", "best.k1"), "best")
    repeated = marks.groupBy("k0", "k1").agg(F.count("*").alias("n")).where("n > 1").select("k0", "k1", F.lit(True).alias("repeated"))
    stay = store(best.join(repeated, ["k0", "k1"], "left").select(F.col("k0").alias("s0"), F.col("k1").alias("s1"), F.col("repeated").isNotNull().alias("repeated")), "stay")
    kept = rows.join(stay, (F.col("h0") == F.col("s0")) & (F.col("h1") == F.col("s1")))
    if not stay.where("repeated").isEmpty():
        one = kept.where("repeated").dropDuplicates(["h0", "h1"])
        kept = kept.where("not repeated").unionByName(one)
    return unwrapped(kept, docs.columns)
