"""Queries of surface sampling and deviation metrics: the grid mesh as nominal, and moved a little as scan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import delaunay, graph, mesh, metrics as M, sampling, spatial, spc
from . import graphs  # noqa: F401  its SQL tables are used here
from .bindings import grid, points, uniform, uniform_sql
from .registry import TABLES, query, sql_table

U0, U1 = uniform_sql("sid", 0), uniform_sql("sid", 1)
sql_table("alloc", "SELECT *, ceil(area / (SELECT sum(area) FROM face_geo) * (SELECT 100.0::DOUBLE * count(*) FROM face_geo))::INT AS n FROM face_geo", "face_geo")
sql_table("spread", "SELECT *, first + k AS sid FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, (sum(n) OVER (ORDER BY fid) - n)::BIGINT AS first FROM alloc))", "alloc")
sql_table("folded", f"SELECT *, CASE WHEN u + w > 1 THEN 1 - u ELSE u END AS s, CASE WHEN u + w > 1 THEN 1 - w ELSE w END AS t FROM (SELECT *, {U0} AS u, {U1} AS w FROM spread)", "spread")
sql_table("samples", 'SELECT sid, fid, ax+s*(bx-ax)+t*(cx-ax) AS x, ay+s*("by"-ay)+t*(cy-ay) AS y, az+s*(bz-az)+t*(cz-az) AS z FROM folded', "folded")
# the scan: every vertex moved by its own small offset
_MOVE = f"x + 0.02*({uniform_sql('vid', 6)} - 0.5)", f"y + 0.02*({uniform_sql('vid', 7)} - 0.5)"
sql_table("scan_pts", f"SELECT vid, {_MOVE[0]} AS x, {_MOVE[1]} AS y, z FROM pts", "pts")
sql_table("scan_faces", TABLES["faces"][1].replace("JOIN pts", "JOIN scan_pts"), "tris", "scan_pts")
for _t, _needs in (("wide", ("samples", "scan_faces")), ("wide1", ("wide_s",)), ("wide2", ("wide1_s",)), ("wide3", ("wide2_s",)), ("tri_dist", ("wide3_s",))):
    _text = TABLES[_t][1].replace("SELECT p.vid, p.x", "SELECT p.sid AS vid, p.x").replace("FROM pts p", "FROM samples p").replace("FROM faces", "FROM scan_faces")
    for _w in ("wide3", "wide2", "wide1"):
        _text = _text.replace(f"FROM {_w}", f"FROM {_w}_s")
    sql_table(f"{_t}_s", _text.replace("FROM wide", "FROM wide_s") if _t == "wide1" else _text, *_needs)
sql_table("forward", "SELECT s.fid, count(*) AS weight, sum(sqrt(d.d2)) AS weighted_dist FROM samples s JOIN (SELECT vid, min(d2) AS d2 FROM tri_dist_s GROUP BY 1) d ON d.vid = s.sid GROUP BY 1", "samples", "tri_dist_s")


def _nominal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    triangles = grid(p)
    return p, triangles, mesh.gather(triangles, p)


def _scan(p: DataFrame, triangles: DataFrame) -> DataFrame:
    moved = p.select("vid", (F.col("x") + 0.02 * (uniform(F.col("vid"), 6) - 0.5)).alias("x"), (F.col("y") + 0.02 * (uniform(F.col("vid"), 7) - 0.5)).alias("y"), "z")
    return mesh.gather(triangles, moved)


#: Samples for each face: on average of the nominal surface, and of the scanned one.
FORWARD_DENSITY, BACKWARD_DENSITY = 100.0, 75.0


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _nominal(spark, sf_dir)
    return M.forward(faces, _scan(p, triangles), FORWARD_DENSITY * triangles.count(), uniform)


@query("SELECT sid, fid, round(x, 7) AS x, round(y, 7) AS y, round(z, 7) AS z FROM samples", "samples")
def area_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, triangles, faces = _nominal(spark, sf_dir)
    s = sampling.sample(faces, FORWARD_DENSITY * triangles.count(), uniform)
    return s.select("sid", "fid", *[F.round(d, 7).alias(d) for d in "xyz"])


@query("SELECT fid, weight, round(weighted_dist, 6) AS weighted_dist FROM forward", "forward")
def forward_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forward(spark, sf_dir).withColumn("weighted_dist", F.round("weighted_dist", 6))


@query("SELECT fid, weight::DOUBLE AS area, round(weighted_dist/weight, 6) AS dist FROM forward", "forward")
def metric_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ratio(_forward(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@query("SELECT f.fid, round(greatest(weighted_dist/weight, area/20), 6) AS dist FROM forward f JOIN face_geo g ON g.fid = f.fid", "forward", "face_geo")
def max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = mesh.face_area(_nominal(spark, sf_dir)[2]).select("fid", (F.col("area") / 20).alias("dist"))
    return M.larger(M.ratio(_forward(spark, sf_dir)), other).withColumn("dist", F.round("dist", 6))


#: Vertices have ids below this, and an edge's midpoint (i + 1) * this + j.
MIDPOINT = 1 << 31


def _children(p: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    fine, kids = M.subdivide(triangles, p, lambda i, j: ((F.col(i) if isinstance(i, str) else i) + 1) * MIDPOINT + j)
    faces = mesh.gather(kids, fine).join(kids.select("fid", "father_id"), "fid")
    corner = mesh.corners(kids)
    return faces, kids, corner.select("fid", "vid").join(corner.select(F.col("fid").alias("neigh"), "vid"), "vid").select("fid", "neigh").distinct()


@query(
    """SELECT 4*fid + k AS fid, fid AS father_id, CASE k WHEN 0 THEN v1 WHEN 1 THEN m1 WHEN 2 THEN m3 ELSE m1 END AS v1, CASE k WHEN 0 THEN m1 WHEN 1 THEN v2 WHEN 2 THEN m2 ELSE m2 END AS v2,
    CASE k WHEN 0 THEN m3 WHEN 1 THEN m2 WHEN 2 THEN v3 ELSE m3 END AS v3, k IN (0, 1) AS e1, k IN (1, 2) AS e2, k IN (0, 2) AS e3
    FROM (SELECT *, (least(v1,v2) + 1)*2147483648 + greatest(v1,v2) AS m1, (least(v2,v3) + 1)*2147483648 + greatest(v2,v3) AS m2, (least(v3,v1) + 1)*2147483648 + greatest(v3,v1) AS m3, unnest(range(0, 4)) AS k FROM tris)""",
    "tris",
)
def midpoint_subdivision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _nominal(spark, sf_dir)
    return _children(p, triangles)[1].select("fid", "father_id", "v1", "v2", "v3", "e1", "e2", "e3")


@query("SELECT fid AS father_id, 4::BIGINT AS n_children FROM tris", "tris")
def children_per_father(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _nominal(spark, sf_dir)
    return _children(p, triangles)[1].groupBy("father_id").agg(F.count("*").alias("n_children"))


@query()
def backward_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _nominal(spark, sf_dir)
    children, _, neighbours = _children(p, triangles)
    scan = _scan(p, triangles)
    area = mesh.mesh_area(scan).first()
    return M.backward(faces, children, neighbours, scan, BACKWARD_DENSITY * area.n_faces / area.area, 0.005, uniform)[0]


_GAUSS = "sqrt(-2*ln(1-{0}))*cos(2*pi()*{1})"


@query("SELECT vid, " + ", ".join(f"round({d} + 0.1*" + _GAUSS.format(uniform_sql("vid", 2 + 2 * k), uniform_sql("vid", 3 + 2 * k)) + f", 6) AS {d}" for k, d in enumerate("xyz")) + " FROM pts", "pts")
def vertex_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.perturb(points(spark, sf_dir), 0.1, uniform, "vid").select("vid", *[F.round(d, 6).alias(d) for d in "xyz"])


@query(
    """SELECT vid, round(cos(0.3)*x2 - sin(0.3)*y1 + 1, 6) AS x, round(sin(0.3)*x2 + cos(0.3)*y1 - 2, 6) AS y, round(z2 + 0.5, 6) AS z FROM (SELECT vid, y1, cos(-0.2)*x + sin(-0.2)*z1 AS x2, -sin(-0.2)*x + cos(-0.2)*z1 AS z2
    FROM (SELECT vid, x, cos(0.1)*y - sin(0.1)*z AS y1, sin(0.1)*y + cos(0.1)*z AS z1 FROM pts))""",
    "pts",
)
def rigid_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rigid_motion(points(spark, sf_dir), (0.1, -0.2, 0.3), (1.0, -2.0, 0.5)).select("vid", *[F.round(d, 6).alias(d) for d in "xyz"])


sql_table("side", "SELECT ceil(sqrt(count(*)))::BIGINT AS n FROM embeddings")
sql_table("cell_of", "SELECT n, unnest(range(0, n*n)) AS r FROM side", "side")


@query(f"SELECT r AS vid, round((r % n)/(n-1.0::DOUBLE) + 0.5*({uniform_sql('r', 0)} - 0.5)/(n-1), 7) AS x, round(floor(r/n)/(n-1.0::DOUBLE) + 0.5*({uniform_sql('r', 1)} - 0.5)/(n-1), 7) AS y, 0.0::DOUBLE AS z FROM cell_of", "cell_of")
def generated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A jittered grid of as many points as there are given ones, up to a whole row."""
    n = math.ceil(math.sqrt(points(spark, sf_dir).count()))
    return sampling.grid_points(n, spark, 0.5, uniform).select("vid", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"), "z")


_PART = "(vid * 150 + k)"
sql_table(
    "scans",
    "SELECT vid, k // 30 AS sim_id, k % 30 + 1 AS t, " + ", ".join(f"0.05*{_GAUSS.format(uniform_sql(_PART, 2 * n), uniform_sql(_PART, 2 * n + 1))}" + (" + CASE WHEN k % 30 + 1 > 20 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END" if d == "z" else "") + f" AS m{d}" for n, d in enumerate("xyz")) + " FROM pts, range(0, 150) r(k)",
    "pts",
)


@query("SELECT sim_id::INT AS sim_id, t::INT AS t, (vid % 20)::BIGINT AS feature_id, round(avg(sqrt(mx*mx + my*my + mz*mz)), 6) AS value, round(max(sqrt(mx*mx + my*my + mz*mz)), 6) AS value2 FROM scans GROUP BY ALL", "scans")
def simulated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five simulations of 30 scans of the given points, the last 10 of each with a defect: deviations by feature."""
    held = spc.simulate(points(spark, sf_dir), lambda key, stream: sampling.normal(uniform, key, stream))
    of = held.groupBy("sim_id", "t", (F.col("vid") % 20).alias("feature_id"))
    return of.agg(F.round(F.avg("d"), 6).alias("value"), F.round(F.max("d"), 6).alias("value2"))


sql_table("cut_n", "SELECT *, greatest(1, ceil(sqrt(area/0.004)))::BIGINT AS n FROM face_geo", "face_geo")
sql_table("cut_i", "SELECT *, unnest(range(0, n)) AS i FROM cut_n", "cut_n")
sql_table("cut_j", "SELECT *, unnest(range(0, n - i)) AS j FROM cut_i", "cut_i")
sql_table("cut_k", "SELECT *, unnest(CASE WHEN i + j < n - 1 THEN [0, 1] ELSE [0] END) AS down FROM cut_j", "cut_j")
_CORNERS = {"a": ("(i + down)", "j"), "b": ("(i + 1)", "(j + down)"), "c": ("i", "(j + 1)")}
_AT = ", ".join(f"""round(a{d} + {i}/n*("b{d}"-a{d}) + {j}/n*(c{d}-a{d}), 6) AS "{c}{d}\"""" for c, (i, j) in _CORNERS.items() for d in "xyz")


@query(f"SELECT fid AS father_id, ((down*n + i)*n + j)::BIGINT AS k, {_AT}, down = 0 AND j = 0 AS e1, down = 0 AND i + j = n - 1 AS e2, down = 0 AND i = 0 AS e3 FROM cut_k", "cut_k")
def refine_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    out = M.refine(mesh.gather(grid(p), p), 0.004)
    return out.select("father_id", "k", *[F.round(c + d, 6).alias(c + d) for c in "abc" for d in "xyz"], "e1", "e2", "e3")


MOST_AREA = 0.004
_PIECES = ", ".join(
    f"greatest(1, ceil(sqrt({' + '.join(f'(\"{b}{d}\" - \"{a}{d}\")^2' for d in 'xyz')}) / (2*sqrt({MOST_AREA}/sqrt(3.0::DOUBLE)))))::BIGINT AS n{k}" for k, (a, b) in enumerate(("ab", "bc", "ca"), 1)
)


@query()
def refine_delaunay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's faces cut into Delaunay ones of at most MOST_AREA, without hanging vertices."""
    p = points(spark, sf_dir)
    return delaunay.refine(mesh.gather(grid(p), p), MOST_AREA)


@query(f"SELECT fid AS father_id, {_PIECES}, round(area, 6) AS area, TRUE AS fits FROM face_geo", "face_geo")
def refine_delaunay_fathers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the refinement makes of each face: pieces of its sides, the children's total area, and whether all are small enough."""
    area = V.tri_area(V.vec("a"), V.vec("b"), V.vec("c"))
    children = refine_delaunay(spark, sf_dir)
    pieces = [F.sum(F.col(f"e{k}").cast("long")).alias(f"n{k}") for k in (1, 2, 3)]
    return children.groupBy("father_id").agg(*pieces, F.round(F.sum(area), 6).alias("area"), (F.max(area) <= MOST_AREA * (1 + 1e-6)).alias("fits"))
