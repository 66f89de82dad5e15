"""Queries of the dataflow operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import mesh, relational as R
from .bindings import grid, points, table, uniform, uniform_sql
from .registry import query, sql_table

# the points twice, every second one again a hair's breadth off
sql_table("pieces", "SELECT vid AS row_id, x, y, z FROM pts UNION ALL SELECT vid + 1000000, x + 1e-12, y, z - 1e-12 FROM pts WHERE vid % 2 = 0", "pts")
sql_table("jumps", "SELECT *, " + ", ".join(f"coalesce(({d} - lag({d}) OVER (ORDER BY {d}, row_id) >= 1e-10)::BIGINT, 0) AS n{d}" for d in "xyz") + " FROM pieces", "pieces")
sql_table("isles", "SELECT row_id, x, y, z, " + ", ".join(f"(sum(n{d}) OVER (ORDER BY {d}, row_id ROWS UNBOUNDED PRECEDING))::BIGINT AS g_{d}" for d in "xyz") + " FROM jumps", "jumps")
sql_table("welded", "SELECT row_id, x, y, z, dense_rank() OVER (ORDER BY g_x, g_y, g_z) - 1 AS weld_id, row_number() OVER (PARTITION BY g_x, g_y, g_z ORDER BY row_id) = 1 AS is_first FROM isles", "isles")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    again = p.where("vid % 2 = 0").select((F.col("vid") + 1000000).alias("row_id"), (F.col("x") + 1e-12).alias("x"), "y", (F.col("z") - 1e-12).alias("z"))
    return p.select(F.col("vid").alias("row_id"), "x", "y", "z").unionByName(again)


@query("SELECT row_id, g_x, g_y, g_z FROM isles", "isles")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.islands(_pieces(spark, sf_dir), ["x", "y", "z"], "row_id").select("row_id", "g_x", "g_y", "g_z")


@query("SELECT row_id, weld_id, is_first FROM welded", "welded")
def gaps_islands_weld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weld(_pieces(spark, sf_dir)).select("row_id", "weld_id", "is_first")


@query("SELECT t.fid, a.weld_id AS v1, b.weld_id AS v2, c.weld_id AS v3 FROM tris t LEFT JOIN welded a ON a.row_id=v1 LEFT JOIN welded b ON b.row_id=v2 LEFT JOIN welded c ON c.row_id=v3", "tris", "welded")
def remap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remap(grid(points(spark, sf_dir)), R.weld(_pieces(spark, sf_dir)))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_in_group(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT vid, n, (sum(n) OVER (ORDER BY vid ROWS UNBOUNDED PRECEDING))::BIGINT - 1 AS \"last\", (sum(n) OVER (ORDER BY vid ROWS UNBOUNDED PRECEDING))::BIGINT - n AS \"first\" FROM (SELECT i AS vid, count(*) AS n FROM nbrs GROUP BY 1)", "nbrs")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.running_offsets(mesh.valence(grid(points(spark, sf_dir))).withColumnRenamed("valence", "n"), "vid")


@query("SELECT vid AS row_key, row_number() OVER (ORDER BY x, vid) AS row_id FROM pts", "pts")
def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.renumber(points(spark, sf_dir), ["x", "vid"]).select(F.col("vid").alias("row_key"), "row_id")


@query("SELECT vid FROM pts WHERE vid % 7 = 3", "pts")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    moved = p.withColumn("y", F.when(F.col("vid") % 7 == 3, F.col("y") + 0.5).otherwise(F.col("y")))
    return R.changed_rows(p, moved, "vid", ["x", "y", "z"])


@query("SELECT vid, round(x, 8) AS x, round(CASE WHEN vid % 7 = 3 THEN y + 0.5 - 0.95*0.5 ELSE y END, 8) AS y, round(z, 8) AS z FROM pts", "pts")
def blend_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    moved = p.withColumn("y", F.when(F.col("vid") % 7 == 3, F.col("y") + 0.5).otherwise(F.col("y")))
    return R.blend_defect(p, moved, "vid").select("vid", *[F.round(d, 8).alias(d) for d in "xyz"])


@query("SELECT vid FROM (SELECT vid, row_number() OVER (ORDER BY vid) AS r FROM pts) WHERE r % 10 = 0", "pts")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.systematic_sample(points(spark, sf_dir), 10, "vid")[0].select("vid")


@query("SELECT vid FROM (SELECT vid, row_number() OVER (ORDER BY vid) AS r FROM pts) WHERE r % 10 <> 0", "pts")
def systematic_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.systematic_sample(points(spark, sf_dir), 10, "vid")[1].select("vid")


@query("SELECT round(avg(x), 8) AS mean_x, round(avg(y), 8) AS mean_y, round(avg(z), 8) AS mean_z, count(*) AS n FROM pts", "pts")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.column_means(points(spark, sf_dir), ["x", "y", "z"]).select(*[F.round(f"mean_{d}", 8).alias(f"mean_{d}") for d in "xyz"], "n")


@query("SELECT floor((vid_rank - 1) / 64)::BIGINT AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY vid) AS vid_rank FROM pts) GROUP BY 1", "pts")
def batch_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batches(points(spark, sf_dir), "vid", 64).groupBy("batch").agg(F.count("*").alias("n"))


@query('SELECT fid, abs((ay-"by")*mx+(bx-ax)*my+(ax*"by"-bx*ay)) < 1e-10 AS e1, abs(("by"-cy)*mx+(cx-bx)*my+(bx*cy-cx*"by")) < 1e-10 AS e2, abs((cy-ay)*mx+(ax-cx)*my+(cx*ay-ax*cy)) < 1e-10 AS e3 FROM (SELECT *, (ax+bx)/2 AS mx, (ay+"by")/2 AS my FROM faces)', "faces")
def point_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    f = mesh.gather(grid(p), p).select("*", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"))
    side = lambda a, b: R.on_line(F.col("mx"), F.col("my"), F.col(a + "x"), F.col(a + "y"), F.col(b + "x"), F.col(b + "y"))
    return f.select("fid", side("a", "b").alias("e1"), side("b", "c").alias("e2"), side("c", "a").alias("e3"))


@query(f"SELECT vid, row_number() OVER (ORDER BY {uniform_sql('vid', 3)}, vid) - 1 AS place FROM pts", "pts")
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.permute(points(spark, sf_dir), "vid", uniform(F.col("vid"), 3)).select("vid", "place")


@query(f"SELECT vid FROM (SELECT vid, row_number() OVER (ORDER BY {uniform_sql('vid', 5)}, vid) AS r, count(*) OVER () AS n FROM pts) WHERE r <= floor(n * 0.25)", "pts")
def sample_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    total = p.agg(F.count("*").alias("_n"))
    return R.permute(p, "vid", uniform(F.col("vid"), 5)).join(total).where(F.col("place") < F.floor(F.col("_n") * 0.25)).select("vid")


@query("SELECT " + ", ".join(f"sum(round({d}*1e4)::BIGINT)::BIGINT AS h_{d}" for d in "xyz") + " FROM pts", "pts")
def mesh_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fingerprint(points(spark, sf_dir), ["x", "y", "z"])


@query("SELECT round(sqrt(sum((x-y)*(x-y)))/sqrt(sum(y*y)), 8) AS e2, round(max(abs(x-y))/max(abs(y)), 8) AS einf FROM pts", "pts")
def error_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    two, top = R.error_norm(p, "x", "y", 2.0), R.error_norm(p, "x", "y", float("inf"))
    return two.select(F.round("error", 8).alias("e2")).join(top.select(F.round("error", 8).alias("einf")))


@query("SELECT l_returnflag, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS largest FROM lineitem GROUP BY 1")
def five_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.five_numbers(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query("SELECT fid, k::INT AS k, vid FROM corners", "corners")
def corner_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.corners(grid(points(spark, sf_dir))).select("fid", F.col("k").cast("int").alias("k"), "vid")


sql_table("held", "SELECT vid FROM pts WHERE vid % 5 = 0", "pts")


@query("SELECT vid FROM pts EXCEPT SELECT vid FROM held", "pts", "held")
def unconstrained_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("vid")
    return p.join(p.where("vid % 5 = 0"), "vid", "left_anti")


@query("SELECT vid FROM pts INTERSECT SELECT vid FROM held", "pts", "held")
def landmarks_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("vid")
    return p.intersect(p.where("vid % 5 = 0"))


@query("SELECT a.fid, b.fid AS neighbour FROM half a JOIN half b ON b.i = a.j AND b.j = a.i", "half")
def edge_adjacent_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.edge_triangles(grid(points(spark, sf_dir))).where("other is not null").select("fid", F.col("other").alias("neighbour"))


@query("SELECT vid, list_sort(list(fid)) AS fids FROM corners GROUP BY 1", "corners")
def vertex_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.corners(grid(points(spark, sf_dir))).groupBy("vid").agg(F.sort_array(F.collect_list("fid")).alias("fids"))


@query(f"SELECT row_number() OVER (ORDER BY {uniform_sql('vid', 3)}, vid) - 1 AS place, vid AS key FROM pts", "pts")
def inverse_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inverse_permutation(R.permute(points(spark, sf_dir), "vid", uniform(F.col("vid"), 3)), "vid")


@query("SELECT vid, x FROM pts ORDER BY x, vid LIMIT 25", "pts")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_lines(points(spark, sf_dir), ["x", "vid"], 25).select("vid", "x")


# every third point again, and every fifth moved by a hair
sql_table("local_pts", "SELECT vid + 5000000 AS local_id, CASE WHEN vid % 5 = 0 THEN x + 1e-9 ELSE x END AS x, y FROM pts WHERE vid % 3 = 0", "pts")


@query("SELECT vid, (SELECT min(local_id) FROM local_pts l WHERE l.x = p.x AND l.y = p.y) AS local_id FROM pts p", "pts", "local_pts")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    local = p.where("vid % 3 = 0").select((F.col("vid") + 5000000).alias("local_id"), F.when(F.col("vid") % 5 == 0, F.col("x") + 1e-9).otherwise(F.col("x")).alias("x"), "y")
    return R.match_exact(p.select("vid", "x", "y"), local, ["x", "y"], "local_id").select("vid", "local_id")


@query("SELECT vid, round((x - (SELECT min(x) FROM pts)) / (SELECT max(x) - min(x) FROM pts), 8) AS scaled, round(1 - (x - (SELECT min(x) FROM pts)) / (SELECT max(x) - min(x) FROM pts), 8) AS red, round((x - (SELECT min(x) FROM pts)) / (SELECT max(x) - min(x) FROM pts), 8) AS blue FROM pts", "pts")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = R.rescale(points(spark, sf_dir), "x")
    red, _, blue = V.ramp(F.col("scaled"), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
    return held.select("vid", F.round("scaled", 8).alias("scaled"), F.round(red, 8).alias("red"), F.round(blue, 8).alias("blue"))


@query("SELECT fid, k::INT AS k, CASE k WHEN 0 THEN v2 WHEN 1 THEN v3 ELSE v1 END AS a, CASE k WHEN 0 THEN v3 WHEN 1 THEN v1 ELSE v2 END AS b, CASE k WHEN 0 THEN v3 WHEN 1 THEN v1 ELSE v2 END AS third FROM (SELECT *, unnest(range(0, 3)) AS k FROM tris)", "tris")
def other_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = mesh.corners(grid(points(spark, sf_dir))).join(grid(points(spark, sf_dir)), "fid")
    corners = [F.col(f"v{k}") for k in (1, 2, 3)]
    a, b = V.other_corners(corners, F.col("k"))
    return held.select("fid", F.col("k").cast("int").alias("k"), a.alias("a"), b.alias("b"), V.third_corner(corners, F.col("vid"), a).alias("third"))
