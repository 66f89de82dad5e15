"""Dataflow operators: tolerance welding, numbering, sampling of lines, changed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

TOLERANCE = 1e-10


Order = list[str | Column]


def _dealt(rows: DataFrame, order: Order) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and stored, with _part, the number of the range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def _by_part(held: DataFrame, values: dict[int, float], name: str, kind: str) -> DataFrame:
    """``held`` with a value for each of its ranges."""
    return held.join(F.broadcast(held.sparkSession.createDataFrame(list(values.items()), f"_part int, {name} {kind}")), "_part", "left")


def _sum_before(held: DataFrame, order: Order, name: str) -> DataFrame:
    """Dealt rows with the sum of _amount over all rows before each: ranges are added up first, then rows within one."""
    upto, total = {}, 0
    for r in sorted(held.groupBy("_part").agg(F.sum("_amount").alias("s")).collect()):  # a row for each range
        upto[r["_part"]] = total
        total += r["s"] or 0
    own = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    local = _by_part(held.withColumn("_own", F.coalesce(own, F.lit(0))), upto, "_start", "long")
    return local.withColumn(name, (F.col("_own") + F.col("_start")).cast("long")).drop("_own", "_start")


def running(rows: DataFrame, order: Order, amount: Column | None = None, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``amount`` (1 if none is given) over the rows before each, in ``order``; no task needs more
    than a range of the rows."""
    held = _dealt(rows.withColumn("_amount", (amount if amount is not None else F.lit(1)).cast("long")), order)
    return _sum_before(held, order, name).drop("_part", "_amount")


def _islands(rows: DataFrame, value: str, tie: str, tolerance: float) -> DataFrame:
    order: Order = [value, tie]
    held = _dealt(rows, order)
    last, before = None, {}
    for r in sorted(held.groupBy("_part").agg(F.max(value).alias("top")).collect()):
        before[r["_part"]] = last
        last = r["top"] if r["top"] is not None else last
    held = _by_part(held, before, "_last", "double")
    previous = F.coalesce(F.lag(value).over(Window.partitionBy("_part").orderBy(*order)), F.col("_last"))
    marked = cut(held.withColumn("_amount", F.coalesce((F.col(value) - previous >= tolerance).cast("long"), F.lit(0))).drop("_last"))
    summed = _sum_before(marked, order, "_upto")
    return summed.withColumn(f"g_{value}", F.col("_upto") + F.col("_amount")).drop("_upto", "_amount", "_part")


def islands(rows: DataFrame, values: list[str], tie: str, tolerance: float = TOLERANCE, by: list[str] | None = None) -> DataFrame:
    """``rows`` with g_<value> for each value: the run to which the row belongs, a step of ``tolerance`` or more beginning
    a new one. Runs chain: many small steps in a row join distant values. One sort per value, by ranges where there is no
    ``by``; runs may go on from one range into the next."""
    out = rows
    for value in values:
        if not by:
            out = _islands(out, value, tie, tolerance)
            continue
        order = Window.partitionBy(*by).orderBy(value, tie)
        out = out.withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(order) >= tolerance).cast("long"), F.lit(0)))
        out = out.withColumn(f"g_{value}", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return out


def weld(rows: DataFrame, tolerance: float = TOLERANCE, by: list[str] | None = None, prefer: Column | None = None) -> DataFrame:
    """rows(row_id, x, y, z) -> with weld_id (dense from 0, by x, y and z island) and is_first, the row that stands for it.

    By default that is the first by row_id; with ``prefer`` the one of the largest value, then the first.
    """
    held = islands(rows, ["x", "y", "z"], "row_id", tolerance, by)
    cells = ["g_x", "g_y", "g_z"]
    order = ([prefer.desc()] if prefer is not None else []) + [F.col("row_id")]
    if by:
        ranked = held.withColumn("weld_id", (F.dense_rank().over(Window.partitionBy(*by).orderBy(*cells)) - 1).cast("long"))
    else:
        ranked = held.join(renumber(held.select(*cells).distinct(), cells, "weld_id", start=0), cells)
    return ranked.withColumn("is_first", F.row_number().over(Window.partitionBy(*(by or []), *cells).orderBy(*order)) == 1).drop(*cells)


def remap(triangles: DataFrame, mapping: DataFrame, old: str = "row_id", new: str = "weld_id") -> DataFrame:
    """Triangles with v1, v2, v3 replaced through the mapping: corners in rows, one join, faces again."""
    corner = triangles.select("fid", F.posexplode(F.array("v1", "v2", "v3")).alias("k", "_v"))
    met = corner.join(mapping.select(F.col(old).alias("_v"), F.col(new).alias("_n")), "_v", "left")
    return met.groupBy("fid").agg(*[F.max(F.when(F.col("k") == k, F.col("_n"))).alias(f"v{k + 1}") for k in range(3)])


def running_offsets(counts: DataFrame, order: str, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """``counts`` with first and last, the range of places each row takes when all are laid end to end."""
    if not by:
        return running(counts, [order], F.col(n), "first").withColumn("last", F.col("first") + F.col(n) - 1)
    upto = F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col(n) + 1)


def first_in_group(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def renumber(rows: DataFrame, order: Order, name: str = "row_id", by: list[str] | None = None, start: int = 1) -> DataFrame:
    if not by:
        return running(rows, order, name=name).withColumn(name, F.col(name) + start)
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)).cast("long"))


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of rows that differ between two aligned tables in any of the columns, null-safe."""
    right = new.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return old.join(right, key).where(differs).select(key)


def blend_defect(nominal: DataFrame, defective: DataFrame, key: str, share: float = 0.95) -> DataFrame:
    """The defective table moved towards the nominal one by ``share`` on the rows that differ."""
    right = nominal.select(F.col(key), *[F.col(d).alias(f"_{d}") for d in "xyz"])
    return defective.join(right, key).select(key, *[(F.col(d) + share * (F.col(f"_{d}") - F.col(d))).alias(d) for d in "xyz"])


def systematic_sample(lines: DataFrame, every: int, order: str) -> tuple[DataFrame, DataFrame]:
    """(every ``every``-th line, the rest) in the given order."""
    numbered = renumber(lines, [order], "_r")
    return numbered.where(F.col("_r") % every == 0).drop("_r"), numbered.where(F.col("_r") % every != 0).drop("_r")


def column_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], F.count("*").alias("n"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with batch, counting from 0."""
    return running(rows, [order], name="batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def on_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether a plane point lies on the line through a and b, by the line's equation as it stands."""
    return F.abs((ay - by) * px + (bx - ax) * py + (ax * by - bx * ay)) < tolerance


def permute(rows: DataFrame, key: str, uniform: Column) -> DataFrame:
    """``rows`` with place, a replayable random permutation from 0."""
    return running(rows, [uniform, F.col(key)], name="place")


def inverse_permutation(permuted: DataFrame, key: str, place: str = "place") -> DataFrame:
    """(place, key): which row stands at each place."""
    return permuted.select(F.col(place).alias("place"), F.col(key).alias("key"))


def first_lines(rows: DataFrame, order: Order, n: int) -> DataFrame:
    """The first ``n`` rows in ``order``; each task keeps only its own first ones."""
    return rows.orderBy(*order).limit(n)


def match_exact(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """``left`` with ``name`` of the row of ``right`` whose numbers are the very same; null where there is none.

    As doubles are compared, -0.0 meets 0.0 and NaN meets NaN; of several equal rows the least ``name`` counts.
    """
    unique = right.groupBy(*on).agg(F.min(name).alias(name))
    return left.join(unique, on, "left")


def rescale(rows: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    """``rows`` with ``value`` moved and stretched to [0, 1]; 0 where it does not vary."""
    ends = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    return rows.join(F.broadcast(ends)).withColumn(name, F.when(span > 0, (F.col(value) - F.col("_low")) / span).when(F.col(value).isNotNull(), 0.0)).drop("_low", "_high")

def fingerprint(rows: DataFrame, columns: list[str], scale: float = 1e4) -> DataFrame:
    """Order-free integer fingerprint of numeric columns."""
    return rows.agg(*[F.sum(F.round(F.col(c) * scale).cast("long")).alias(f"h_{c}") for c in columns])


def error_norm(rows: DataFrame, value: str, truth: str, p: float) -> DataFrame:
    """Relative error in the p-norm; p = inf takes the largest."""
    gap = F.abs(F.col(value) - F.col(truth))
    if p == float("inf"):
        return rows.agg((F.max(gap) / F.max(F.abs(truth))).alias("error"))
    return rows.agg((F.pow(F.sum(F.pow(gap, F.lit(p))), F.lit(1 / p)) / F.pow(F.sum(F.pow(F.abs(truth), F.lit(p))), F.lit(1 / p))).alias("error"))


def five_numbers(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    five = rows.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("five"))
    return five.select(*by, *[F.col("five")[k].alias(n) for k, n in enumerate(("least", "q1", "median", "q3", "largest"))])
