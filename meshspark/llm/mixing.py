"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot n of the mix belongs to the source whose stretch of the cumulative target weights holds the n-th van der Corput
point, so any run of slots is near the target proportions. Each source's documents are shuffled, laid end to end and cut
into blocks of equal token count; the r-th slot of a source takes its block r, beginning anew after the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, store, unwrapped, words_of, wrapped

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
MOST_REPEATS = 3
#: Tokens of a block.
BLOCK = 64
#: Slots whose ranks are counted together.
CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def shuffled(*content: Column) -> Column:
    """A fixed pseudo-random order of documents within their source, the same in any SQL engine."""
    parts = [x for c in content for x in (F.lit(" "), F.coalesce(c.cast("string"), F.lit("")))]
    return F.md5(F.concat(F.lit("mix"), *parts[1:]).cast("binary"))


#: Rows of a shard aimed at, and hexadecimal digits of a shard's name at most.
SHARD, MOST_DIGITS = 1 << 16, 6


def offsets(sized: DataFrame, order: list[str], rows: int, key: str = "source") -> DataFrame:
    """``sized``, of so many ``rows``, with ``start``, the sum of ``size`` before the row within its source, by ``order``.

    The order's first column is a hexadecimal hash of the row's content; its first digits make shards, as many as the
    rows need, so no task needs a whole source: sums of shards are added up first, then rows within a shard.
    """
    digits = min(MOST_DIGITS, max(2, math.ceil(math.log(max(1, rows / SHARD), 16)) + 1))
    rows_ = sized.withColumn("_shard", F.substring(order[0], 1, digits))
    sums = rows_.groupBy(key, "_shard").agg(F.sum("size").alias("_sum"))
    before = sums.select(F.col(key).alias("_key"), F.col("_shard").alias("_at"), (F.sum("_sum").over(Window.partitionBy(key).orderBy("_shard")) - F.col("_sum")).alias("_before"))
    own = F.sum("size").over(Window.partitionBy(key, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    local = rows_.withColumn("_own", F.coalesce(own, F.lit(0)))
    met = local.join(before, local[key].eqNullSafe(before._key) & (local._shard == before._at))
    return met.select(*sized.columns, (F.col("_own") + F.col("_before")).alias("start"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, k): tokens each source should give, k its place by code points, null last.

    Sources weigh WEIGHTS in turn and share the total; none exceeds MOST_REPEATS times its size, and what it leaves is
    shared by weight among the rest. With sources in order of cap/weight, those before the first that stays under its
    share are capped.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.withColumn("weight", F.get(weights, F.col("k") % len(WEIGHTS))).withColumn("cap", (MOST_REPEATS * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    step = placed.select(
        "*", F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    step = step.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    first_free = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("k"), F.col("level"))
    share = F.coalesce(F.min(F.when(F.col("free"), first_free)).over(everything).getField("level"), F.lit(float("inf")))
    return step.select("source", "source_size", F.least(F.col("cap"), share * F.col("weight")).alias("target"), F.col("k").cast("int").alias("k"))


def van_der_corput(n: Column) -> Column:
    """The base-2 radical inverse of n < 2**52, exact, in [0, 1)."""
    x = n.cast("long")
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = F.shiftrightunsigned(x, width).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), width))
    return F.shiftrightunsigned(x, 11).cast("double") / float(1 << 53)


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, k, rank): the source k of every slot of the mix and the slot's rank within its source.

    There are as many slots as whole blocks nearest the sum of targets. Ranks are counted in chunks of slots, whose
    counts per source are added up first, so a source with most of the slots needs no task of its own.
    """
    spark = goals.sparkSession
    upto = Window.orderBy("k")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    slots = max(1, round(total / block)) if total else 0
    edges = goals.select("k", F.sum("target").over(upto).alias("high")).withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    # stretches as counts of a slot's leading digits: equi-join on a cell of the unit interval, then the exact stretch
    cells = 4096
    cell = lambda x: F.least((x / float(total or 1) * cells).cast("int"), F.lit(cells))
    spread = edges.where("high > low").select("k", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (van_der_corput(F.col("id")) * total).alias("x")).withColumn("cell", cell(F.col("x")))
    owned = points.join(spread, "cell").where("x >= low and x < high").select("slot", "k", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = owned.groupBy("k", "chunk").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("k").alias("_k"), F.col("chunk").alias("_chunk"), (F.sum("_n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("_n")).alias("_before"))
    local = owned.withColumn("_own", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1)
    return local.join(before, (F.col("k") == F.col("_k")) & (F.col("chunk") == F.col("_chunk"))).select("slot", "k", (F.col("_own") + F.col("_before")).alias("rank"))


def size_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(source_col).cast("string").alias("source"), quoted(text_col).cast("string").alias("text"))
    return rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled(F.col("doc_id"), F.col("text")).alias("_mix"))


def plan(sized: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with source_size, target, start, k; turns (slot, k, pass, block); (k, blocks, turns) of each source).

    ``sized`` has _mix, the shuffled order's hash. A source's turns end after MOST_REPEATS passes.
    """
    goals = store(targets(sized), "targets")
    placed = offsets(sized, ["_mix", "doc_id", "size"], sized.count())
    right = goals.select(F.col("source").alias("_source"), "source_size", "target", "k")  # a row per source
    placed = placed.join(right, placed.source.eqNullSafe(right._source)).drop("_source")
    counts = goals.select(F.col("k").alias("_k"), F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).alias("_blocks"))
    turns = schedule(goals, block).join(counts, F.col("k") == F.col("_k")).where(F.col("rank") < MOST_REPEATS * F.col("_blocks"))
    turns = turns.select("slot", "k", F.floor(F.col("rank") / F.col("_blocks")).cast("int").alias("pass"), (F.col("rank") % F.col("_blocks")).alias("block"), "_blocks")
    return placed, turns, turns.groupBy("k").agg(F.first("_blocks").alias("blocks"), F.count("*").alias("turns"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per input row.

    size counts words (null: 0); taken counts the words the mix takes, repeats included, at most MOST_REPEATS times the
    size. The null source comes last. Rows of equal id and size share an order key, so they are interchangeable; rows
    with null ids take part like others. Documents without words are taken 0 times. An empty table gives no rows.
    """
    sized = store(size_documents(docs, id_col, text_col, source_col), "sizes")
    placed, turns, _ = plan(sized, block)
    taken = turns.groupBy("k", "block").agg(F.count("*").alias("times"))
    # each document joins the blocks that hold its ends; the blocks between are summed through running totals
    running = taken_before(taken, placed, block)
    return running.select("doc_id", "size", "source_size", "target", "taken")


def taken_before(taken: DataFrame, placed: DataFrame, block: int) -> DataFrame:
    """``placed`` with ``taken``: the sum over a document's words of the times its block is taken."""
    ends = placed.where("size > 0").select("*", F.posexplode(F.sequence((F.col("start") / block).cast("long"), ((F.col("start") + F.col("size") - 1) / block).cast("long"))).alias("_pos", "_block"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("_block") + 1) * block) - F.greatest(F.col("start"), F.col("_block") * block)
    right = taken.select(F.col("k").alias("_k"), F.col("block").alias("_b"), "times")
    met = ends.withColumn("_inside", inside).join(right, (F.col("k") == F.col("_k")) & (F.col("_block") == F.col("_b")))
    key = [F.col("k"), F.col("start")]
    sums = met.groupBy(*key).agg(F.sum(F.col("_inside") * F.col("times")).alias("_taken")).select(F.col("k").alias("_sk"), F.col("start").alias("_ss"), "_taken")
    joined = placed.join(sums, (F.col("k") == F.col("_sk")) & (F.col("start") == F.col("_ss")) & (F.col("size") > 0), "left")
    return joined.select(*placed.columns, F.coalesce("_taken", F.lit(0)).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, with its own white space."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """``docs`` in the order of the schedule, all columns kept: a row for every time a document is taken, where the slot of
    the block that holds its first word is due, range-partitioned and sorted by that slot.

    A source gives its blocks in the order of its stream, so in each pass the blocks due are those up to some block, and
    only the document in which a source's last pass breaks off is cut: it gives the words of its blocks that are due.
    Documents that the mix does not take, and those without words, are left out. Rows are told apart by hashes of their
    columns (map columns aside); rows equal throughout are each taken like the others.
    """
    fields = [F.col("doc").getField(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    own = lambda c: F.col("doc").getField(c)
    keys = [F.xxhash64(*fields).alias("h0"), F.xxhash64(F.lit("second"), *fields).alias("h1")]
    text = own(text_col).cast("string")
    rows = wrapped(docs, text.alias("text"), own(id_col).cast("long").alias("doc_id"), own(source_col).cast("string").alias("source"), *keys)
    sized = rows.select("doc_id", "source", "h0", "h1", word_count(F.col("text")).alias("size"), shuffled(F.col("doc_id"), F.col("text")).alias("_mix"))
    sized = store(sized, "sizes")
    placed, turns, ends = plan(sized, block)
    ends = ends.select(F.col("k").alias("_k"), "blocks", "turns")
    begun = placed.where("size > 0").select("h0", "h1", "k", "start", "size", F.floor(F.col("start") / block).alias("block"))
    due = begun.join(turns.select("k", "block", "pass", "slot"), ["k", "block"]).join(ends, F.col("k") == F.col("_k"))
    last = F.col("pass") == F.floor(F.col("turns") / F.col("blocks"))
    words = F.when(last, F.least("size", (F.col("turns") % F.col("blocks")) * block - F.col("start"))).otherwise(F.col("size"))
    taken = store(due.select("h0", "h1", "slot", "start", "size", words.alias("words")), "taken")
    repeated = not sized.groupBy("h0", "h1").count().where("count > 1").isEmpty()
    unique = rows.select("doc", "text", "h0", "h1")
    met = (unique.dropDuplicates(["h0", "h1"]) if repeated else unique).join(taken, ["h0", "h1"])
    cut = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(first_words(F.col("text"), F.col("words")))
    met = met.select("doc", cut.alias("text"), "slot", "start").repartitionByRange("slot", "start").sortWithinPartitions("slot", "start")
    replaced = {text_col: F.col("text")}
    for f in docs.schema.fields:
        if f.name == "n_chars" and f.name not in (id_col, source_col, text_col):
            replaced[f.name] = F.length("text").cast(f.dataType)
    return unwrapped(met, docs.columns, replaced)
