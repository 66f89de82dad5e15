"""A Merkle manifest of a dataset: a tree of runs of eight per group, a tree over the groups' roots, and proofs by lookup.

Nodes are materialised as rows (tree, level, at, digest). A leaf works out from its place and its tree's size which
coordinates (level, at) its proof needs, explodes them, joins the node table, and puts what it found in order: joined
together that is its proof, folded run by run with its own digest it is the root.

Each leaf looks up its coordinates of the LOW lowest levels. Those above are the same for all leaves of a block of
FAN ** LOW, so blocks look them up in the same way, and blocks of blocks: no node is asked for by more rows than a block has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, store, whole_number_crc

#: Nodes of a run.
FAN, BITS = 8, 3
#: Levels below a block's root.
LOW = 3
#: Where upper levels start when a path is put in order: after those of any tree.
ABOVE = 64
PLACE = (1 << 33) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is exploded, joined and put in order.
ENTRY = "struct<level: int, at: bigint, digest: string>"
COORDINATES = "array<struct<level: int, at: bigint>>"


def _digest(joined: Column) -> Column:
    return F.sha2(joined, 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _down(value: Column, level: Column) -> Column:
    """``value`` at the level, when runs of FAN become one."""
    return F.call_function("shiftright", value, (BITS * level).cast("int"))


def _size_at(n: Column, level: Column) -> Column:
    """How many nodes a tree of ``n`` leaves has at a level."""
    return _down(n + F.call_function("shiftleft", F.lit(1).cast("long"), (BITS * level).cast("int")) - 1, level)


def hashed(docs: DataFrame, id_col: str, source_col: str, lang_col: str, chars_col: str, text_col: str) -> DataFrame:
    """(doc_id, tree, leaf, tampered) of each row; ``tampered`` is null where the row isn't tampered with."""
    text = quoted(text_col).cast("string")
    head = F.concat(*[_field(quoted(c)) for c in (id_col, source_col, lang_col, chars_col)])
    tree = F.coalesce(F.concat(F.lit("="), quoted(lang_col).cast("string")), F.lit("-"))
    changed = F.when(whole_number_crc(quoted(id_col)) % 3 == 0, _digest(F.concat(head, _field(F.translate(text, UPPER, LOWER)))))
    return docs.select(quoted(id_col).alias("doc_id"), tree.alias("tree"), _digest(F.concat(head, _field(text))).alias("leaf"), changed.alias("tampered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 within their ``tree`` by ``order``, and ``n``, the rows of the tree.

    Ranges of (tree, order) are sorted each by itself; a row a range and tree is added up to give where each begins.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = store(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE)).alias("place")), "merkle-ranges")
    parts = ranged.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    begins = parts.select("tree", "part", F.expr("sum(rows) over (partition by tree order by part) - rows - first").alias("shift"), F.expr("sum(rows) over (partition by tree)").alias("n"))
    begins = begins.repartition("tree", "part")  # else all rows would be dealt by tree alone
    return ranged.join(begins, ["tree", "part"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("at"), "n")


def grown(leaves: DataFrame) -> list[DataFrame]:
    """The levels of all trees of (tree, at, n, digest), each a stored table of the same columns; ``n`` counts the level's nodes."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves.select("tree", "at", "n", "digest")]
    while most > 1:
        most = -(-most // FAN)
        runs = levels[-1].where("n > 1").groupBy("tree", _down(F.col("at"), F.lit(1)).alias("at"))
        run = runs.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"))
        levels.append(store(run.select("tree", "at", _size_at(F.col("n"), F.lit(1)).alias("n"), _digest(F.array_join(F.col("run.digest"), "")).alias("digest")), "merkle-level"))
    return levels


def siblings(at: Column, n: Column, low: int, high: int) -> Column:
    """The coordinates (level, at) that a proof needs from level ``low`` up to below ``high``, in order."""

    def of(level: Column) -> Column:
        own = _down(at, level)
        first = own - own % FAN
        run = F.sequence(first, F.least(first + (FAN - 1), _size_at(n, level) - 1))
        found = F.transform(F.filter(run, lambda p: p != own), lambda p: F.struct(level.alias("level"), p.alias("at")))
        return F.when(_size_at(n, level) > 1, found).otherwise(F.array().cast(COORDINATES))

    return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(max(low, high - 1))), of))


def nodes(levels: list[DataFrame], low: int, high: int) -> DataFrame:
    """(tree, level, at, digest) of the levels from ``low`` to below ``high``."""
    chosen = [t.select("tree", F.lit(low + k).alias("level"), "at", "digest") for k, t in enumerate(levels[low:high])]
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def looked_up(rows: DataFrame, keys: list[str], kept: list[str], coordinates: Column, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` by ``keys`` with ``path``: for each of its coordinates, (level, at, digest) of ``table``, in order."""
    asked = rows.select(*keys, *kept, F.explode_outer(coordinates).alias("c")).select(*keys, *kept, "c.level", F.col("c.at").alias("_at"))
    met = asked.join(table.withColumnRenamed("at", "_at"), [*on, "level", "_at"], "left")
    entry = F.when(F.col("digest").isNotNull(), F.struct("level", F.col("_at").alias("at"), "digest"))
    return met.groupBy(*keys).agg(*[F.first(c).alias(c) for c in kept], F.sort_array(F.collect_list(entry)).alias("path"))


def folded(digest: Column, path: Column, own: Column) -> Column:
    """The root from a digest, its path and its own coordinates ``own``, an array of (level, at, null)."""
    start = F.struct(F.lit("").alias("run"), digest.alias("digest"), F.lit(-1).alias("level"))

    def step(state: Column, e: Column) -> Column:
        up = (state.level >= 0) & (e.level != state.level)
        now = F.when(up, _digest(state.run)).otherwise(state.digest)
        return F.struct(F.concat(F.when(up, F.lit("")).otherwise(state.run), F.coalesce(e.digest, now)).alias("run"), now.alias("digest"), e.level.alias("level"))

    return F.aggregate(F.sort_array(F.concat(path, own)), start, step, lambda s: F.when(s.level < 0, s.digest).otherwise(_digest(s.run)))


def own_coordinates(at: Column, n: Column, high: int, above: int = 0) -> Column:
    """The row's own (level, at, null) at each level of its tree that has several nodes."""
    levels = F.filter(F.sequence(F.lit(0), F.lit(max(0, high - 1))), lambda k: _size_at(n, k) > 1)
    return F.transform(levels, lambda k: F.struct((k + above).cast("int").alias("level"), _down(at, k).alias("at"), F.lit(None).cast("string").alias("digest")))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A null field of a leaf is ``-``; null languages are a tree of their own, before the others. Rows of equal id stand
    by their leaf's digest, so repeated rows have equal leaves and each a proof of its own. Null ids stand first and
    count as the empty text where rows are chosen to be tampered with. An empty table gives no rows.
    """
    leaves = store(hashed(docs, id_col, source_col, lang_col, chars_col, text_col), "merkle-leaves")
    leaves = store(placed(leaves, "doc_id", "leaf"), "merkle-places")
    levels = grown(leaves.withColumnRenamed("leaf", "digest"))
    height = len(levels)
    roots = levels[0].where("n = 1").select("tree", "digest")  # a tree ends at the level at which it has one node
    for level in levels[1:]:
        roots = roots.unionByName(level.where("n = 1").select("tree", "digest"))
    roots = store(roots, "merkle-roots")
    tops = store(placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "of"), "merkle-tops")
    upper = grown(tops)
    crown = len(upper)
    root = nodes(upper, crown - 1, crown).select(F.col("digest").alias("root"))

    tops = tops.withColumnRenamed("digest", "subroot")
    paths = looked_up(tops, ["of"], ["tree", "at", "n", "subroot"], siblings(F.col("at"), F.col("n"), 0, crown), nodes(upper, 0, crown), ["tree"])
    raised = F.transform("path", lambda e: F.struct((e.level + ABOVE).cast("int").alias("level"), e.at.alias("at"), e.digest.alias("digest")))
    paths = paths.select(F.col("of").alias("tree"), "subroot", raised.alias("top_path"), own_coordinates(F.col("at"), F.col("n"), crown, ABOVE).alias("top_own"))
    paths = store(paths.crossJoin(F.broadcast(root)), "merkle-top-paths")  # one row

    high = paths.withColumns({"block": F.lit(0).cast("long"), "high_path": F.array().cast(f"array<{ENTRY}>")})
    for base in range((height - 1) // LOW * LOW, 0, -LOW):  # blocks of blocks first
        end = min(base + LOW, height)
        blocks = leaves.where(F.col("at") % FAN**base == 0).select("tree", _down(F.col("at"), F.lit(base)).alias("block"), "n")
        found = looked_up(blocks, ["tree", "block"], ["n"], siblings(F.col("block") * FAN**base, F.col("n"), base, end), nodes(levels, base, end), ["tree"])
        found = found.withColumn("_up", _down(F.col("block"), F.lit(LOW))).drop("n").join(high.withColumnRenamed("block", "_up"), ["tree", "_up"])
        joined = F.concat(F.col("path").cast(f"array<{ENTRY}>"), "high_path").alias("high_path")
        high = store(found.select("tree", "block", joined, "top_path", "top_own", "subroot", "root"), "merkle-block-paths")

    block = _down(F.col("at"), F.lit(LOW)).alias("block")
    near = nodes(levels, 0, LOW).select("tree", "level", F.col("at").alias("_at"), F.unhex("digest").alias("digest"))
    asked = leaves.select("tree", block, "at", F.explode(siblings(F.col("at"), F.col("n"), 0, min(LOW, height))).alias("c")).select("tree", "block", "at", "c.level", F.col("c.at").alias("_at"))
    entry, own = F.struct("level", F.col("_at").alias("at"), "digest"), F.struct("doc_id", "leaf", "tampered", "n")
    answers = asked.join(near.hint("merge"), ["tree", "level", "_at"]).select("tree", "block", "at", entry.alias("entry"))
    rows = answers.unionByName(leaves.select("tree", block, "at", own.alias("own")), allowMissingColumns=True).repartition("tree", "block")
    low = rows.groupBy("tree", "block", "at").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("entry")).alias("path"))
    met = low.join(high.hint("merge"), ["tree", "block"]).select("own.*", "at", "subroot", "root", "path", "high_path", "top_path", "top_own")
    hexed = F.transform("path", lambda e: F.struct(e.level.alias("level"), e.at.alias("at"), F.lower(F.hex(e.digest)).alias("digest")))
    whole = F.concat(hexed.cast(f"array<{ENTRY}>"), F.col("high_path"), F.col("top_path").cast(f"array<{ENTRY}>"))
    own = F.concat(own_coordinates(F.col("at"), F.col("n"), height).cast(f"array<{ENTRY}>"), F.col("top_own").cast(f"array<{ENTRY}>"))
    met = met.select("doc_id", "leaf", "tampered", "subroot", "root", whole.alias("path"), own.alias("own"))
    proved = met.select("doc_id", "leaf", "subroot", "root", _digest(F.array_join(F.col("path.digest"), "")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path"), F.col("own")).alias("folded_root"))
    return proved.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))
