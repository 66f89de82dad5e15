"""Queries of the mesh geometry operators over the grid mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import mesh
from .bindings import grid, points
from .registry import query, sql_table


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vertices = points(spark, sf_dir)
    return vertices, grid(vertices)


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = _mesh(spark, sf_dir)
    return mesh.gather(faces, vertices)


def _round(df: DataFrame, places: int = 6, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query("SELECT fid, round(area, 6) AS area FROM face_geo", "face_geo")
def tri_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.face_area(_faces(spark, sf_dir)))


@query("SELECT fid, round(nx/(2*area), 6) AS nx, round(ny/(2*area), 6) AS ny, round(nz/(2*area), 6) AS nz FROM face_geo", "face_geo")
def tri_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.face_normal(_faces(spark, sf_dir)))


@query('SELECT fid, round((ax+bx+cx)/3, 6) AS cx, round((ay+"by"+cy)/3, 6) AS cy, round((az+bz+cz)/3, 6) AS cz FROM faces', "faces")
def tri_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.face_centroid(_faces(spark, sf_dir)))


@query("SELECT round(sum(area), 5) AS area, count(*) AS n_faces FROM face_geo", "face_geo")
def mesh_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.mesh_area(_faces(spark, sf_dir)), 5)


@query("SELECT " + ", ".join(f"min({d}) AS min_{d}, max({d}) AS max_{d}, round((min({d})+max({d}))/2, 8) AS mid_{d}" for d in "xyz") + " FROM pts", "pts")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.bounds(points(spark, sf_dir)).select(*[F.round(f"{n}_{d}", 8).alias(f"{n}_{d}") if n == "mid" else f"{n}_{d}" for d in "xyz" for n in ("min", "max", "mid")])


@query("SELECT i AS vid, count(*) AS valence FROM nbrs GROUP BY 1", "nbrs")
def vertex_valence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.valence(_mesh(spark, sf_dir)[1])


@query("SELECT round(avg(d), 6) AS mean, round(sum(d*n_faces)/sum(n_faces), 6) AS mean_by_face, round(min(d), 6) AS least, round(max(d), 6) AS largest FROM lens WHERE i < j", "lens")
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = _mesh(spark, sf_dir)
    return _round(mesh.edge_stats(faces, vertices))


@query("SELECT i, j FROM edges WHERE n_faces = 1", "edges")
def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.boundary_edges(_mesh(spark, sf_dir)[1])


sql_table("rim", "SELECT DISTINCT unnest([i, j]) AS vid FROM edges WHERE n_faces = 1", "edges")


@query("SELECT fid, bool_or(r.vid IS NOT NULL) AS is_boundary FROM corners c LEFT JOIN rim r ON r.vid = c.vid GROUP BY 1", "corners", "rim")
def boundary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.boundary_faces(_mesh(spark, sf_dir)[1])


@query("SELECT h.i, h.j, h.fid, o.fid AS other FROM half h LEFT JOIN half o ON o.i = h.j AND o.j = h.i", "half")
def edge_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.edge_triangles(_mesh(spark, sf_dir)[1])


@query("SELECT (SELECT count(*) FROM pts) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM tris) AS n_faces, (SELECT count(DISTINCT vid) FROM corners) - (SELECT count(*) FROM edges) + (SELECT count(*) FROM tris) AS euler", "pts", "edges", "tris", "corners")
def mesh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = _mesh(spark, sf_dir)
    parts = vertices.agg(F.count("*").alias("n_vertices")).join(mesh.edges(faces).agg(F.count("*").alias("n_edges"))).join(faces.agg(F.count("*").alias("n_faces"), F.countDistinct("v1").alias("_")))
    used = mesh.corners(faces).agg(F.countDistinct("vid").alias("_used"))
    return parts.join(used).select("n_vertices", "n_edges", "n_faces", (F.col("_used") - F.col("n_edges") + F.col("n_faces")).alias("euler"))


_NORMAL = "SELECT i AS vid, round(sx/s, 5) AS nx, round(sy/s, 5) AS ny, round(sz/s, 5) AS nz FROM (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS s FROM (SELECT i, sum({0}x) AS sx, sum({0}y) AS sy, sum({0}z) AS sz FROM (SELECT v AS i, nx, ny, nz, nx/(2*area) AS ux, ny/(2*area) AS uy, nz/(2*area) AS uz FROM (SELECT *, unnest([v1,v2,v3]) AS v FROM face_geo)) GROUP BY 1))"


@query(_NORMAL.format("n"), "face_geo")
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.vertex_normals(_faces(spark, sf_dir)), 5)


@query(_NORMAL.format("u"), "face_geo")
def vertex_normals_faceavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.vertex_normals(_faces(spark, sf_dir), "uniform"), 5)


@query("SELECT i AS vid, round(sum(area), 6) AS area FROM turns GROUP BY 1", "turns")
def vertex_area_onering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.vertex_area(_faces(spark, sf_dir), "onering"))


@query("SELECT DISTINCT i AS vid, 1.0::DOUBLE AS area FROM turns", "turns")
def vertex_area_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.vertex_area(_faces(spark, sf_dir), "uniform")


sql_table(
    "areas",
    """SELECT fid, i, area, dp, bool_or(dp < 0) OVER (PARTITION BY fid) AS obtuse,
      ((px-rx)*(px-rx)+(py-ry)*(py-ry)+(pz-rz)*(pz-rz)) * ((px-qx)*(rx-qx)+(py-qy)*(ry-qy)+(pz-qz)*(rz-qz)) / cp / 8
      + ((px-qx)*(px-qx)+(py-qy)*(py-qy)+(pz-qz)*(pz-qz)) * ((px-rx)*(qx-rx)+(py-ry)*(qy-ry)+(pz-rz)*(qz-rz)) / cp / 8 AS vor FROM angles""",
    "angles",
)


@query("SELECT i AS vid, round(sum(vor), 5) AS area FROM areas GROUP BY 1", "areas")
def vertex_area_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.vertex_area(_faces(spark, sf_dir), "voronoi"), 5)


@query("SELECT i AS vid, round(sum(CASE WHEN NOT obtuse THEN vor WHEN dp < 0 THEN area/2 ELSE area/4 END), 6) AS area FROM areas GROUP BY 1", "areas")
def vertex_area_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mesh.vertex_area(_faces(spark, sf_dir), "mixed"))


@query("SELECT i AS vid, " + ", ".join(f"round(avg(q.{d}) - any_value(p.{d}), 6) AS l{d}" for d in "xyz") + " FROM nbrs b JOIN pts q ON q.vid = b.j JOIN pts p ON p.vid = b.i GROUP BY 1", "nbrs", "pts")
def laplacian_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = _mesh(spark, sf_dir)
    return _round(mesh.laplacian(mesh.uniform_neighbours(faces), vertices))


def _ball() -> Column:
    return V.sphere_distance(V.vec(""), V.lit(0.0, 0.0, 0.0), 0.25)


sql_table("inside", "SELECT vid, sqrt(x*x+y*y+z*z) - 0.25 < 0 AS ok FROM pts", "pts")
sql_table("inner_faces", "SELECT fid FROM corners c JOIN inside s ON s.vid = c.vid GROUP BY 1 HAVING bool_and(ok)", "corners", "inside")


@query("SELECT vid FROM pts WHERE 0.5*x + 0.25*y - z - 0.02 < 0", "pts")
def select_vertices_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.select_vertices(points(spark, sf_dir), V.plane_distance(V.vec(""), V.lit(0.04, 0.0, 0.0), V.lit(0.5, 0.25, -1.0))).select("vid")


@query("SELECT t.fid, v1, v2, v3 FROM tris t WHERE fid IN (SELECT fid FROM inner_faces)", "tris", "inner_faces")
def select_faces_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = _mesh(spark, sf_dir)
    return mesh.select_faces(faces, vertices, _ball()).select("fid", "v1", "v2", "v3")


sql_table("dense", "SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new_vid FROM (SELECT DISTINCT vid FROM corners WHERE fid IN (SELECT fid FROM inner_faces))", "corners", "inner_faces")


@query("SELECT row_number() OVER (ORDER BY t.fid) - 1 AS fid, a.new_vid AS v1, b.new_vid AS v2, c.new_vid AS v3 FROM tris t JOIN inner_faces f ON f.fid=t.fid JOIN dense a ON a.vid=v1 JOIN dense b ON b.vid=v2 JOIN dense c ON c.vid=v3", "tris", "dense", "inner_faces")
def submesh_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = _mesh(spark, sf_dir)
    return mesh.submesh(faces, mesh.select_faces(faces, vertices, _ball()))[1]


@query("SELECT p.vid, coalesce(p.x + CASE WHEN d.new_vid IS NOT NULL THEN d.new_vid END, p.x) AS x FROM pts p LEFT JOIN dense d ON d.vid = p.vid", "pts", "dense")
def roi_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = _mesh(spark, sf_dir)
    index, _ = mesh.submesh(faces, mesh.select_faces(faces, vertices, _ball()))
    edited = index.join(vertices, "vid").select("new_vid", (F.col("x") + F.col("new_vid")).alias("edited"))
    back = index.join(edited, "new_vid").select("vid", "edited")
    return vertices.join(back, "vid", "left").select("vid", F.coalesce("edited", "x").alias("x"))


@query("""SELECT fid, v1, CASE WHEN s < 0 THEN v3 ELSE v2 END AS v2, CASE WHEN s < 0 THEN v2 ELSE v3 END AS v3 FROM (SELECT *, (bx-ax)*(cy-ay)-("by"-ay)*(cx-ax) AS s FROM faces)""", "faces")
def orient_ccw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.orient_ccw(_faces(spark, sf_dir))


_EAR = "SELECT {0} AS pass, t.* FROM tris t WHERE true"
sql_table("ears", "SELECT fid FROM half h JOIN edges e ON e.i = least(h.i,h.j) AND e.j = greatest(h.i,h.j) WHERE e.n_faces = 1 GROUP BY 1 HAVING count(*) > 1", "half", "edges")
sql_table("tris2", "SELECT * FROM tris WHERE fid NOT IN (SELECT fid FROM ears)", "tris", "ears")
sql_table("half2", "SELECT fid, v1 AS i, v2 AS j FROM tris2 UNION ALL SELECT fid, v2, v3 FROM tris2 UNION ALL SELECT fid, v3, v1 FROM tris2", "tris2")
sql_table("ears2", "SELECT fid FROM half2 h JOIN (SELECT least(i,j) i, greatest(i,j) j, count(*) n FROM half2 GROUP BY 1, 2) e ON e.i = least(h.i,h.j) AND e.j = greatest(h.i,h.j) WHERE e.n = 1 GROUP BY 1 HAVING count(*) > 1", "half2")


@query("SELECT fid, v1, v2, v3 FROM tris2 WHERE fid NOT IN (SELECT fid FROM ears2)", "tris2", "ears2")
def clip_ears(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.clip_ears(_mesh(spark, sf_dir)[1], passes=2)


sql_table("ring_next", "SELECT opp AS vid, i AS f, j AS t FROM half", "half")
sql_table("ring_first", "SELECT vid, coalesce(min(CASE WHEN NOT EXISTS (SELECT 1 FROM ring_next o WHERE o.vid = r.vid AND o.t = r.f) THEN f END), min(f)) AS f FROM ring_next r GROUP BY 1", "ring_next")
sql_table("ring_walk", "SELECT vid, [f] AS ring FROM ring_first UNION ALL SELECT w.vid, list_append(w.ring, n.t) FROM ring_walk w JOIN ring_next n ON n.vid = w.vid AND n.f = w.ring[-1] WHERE n.t <> w.ring[1]", "ring_first", "ring_next")


@query("SELECT vid, pos - 1 AS pos, ring[pos] AS nbr FROM (SELECT vid, ring, unnest(range(1, len(ring) + 1)) AS pos FROM (SELECT vid, arg_max(ring, len(ring)) AS ring FROM ring_walk GROUP BY 1))", "ring_walk")
def one_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = mesh.one_ring(_mesh(spark, sf_dir)[1])
    return rings.select("vid", F.posexplode("ring").alias("pos", "nbr")).select("vid", F.col("pos").cast("long").alias("pos"), "nbr")


sql_table("rim_next", "SELECT h.j AS vid, h.i AS nxt FROM half h JOIN edges e ON e.i = least(h.i,h.j) AND e.j = greatest(h.i,h.j) WHERE e.n_faces = 1", "half", "edges")
sql_table("rim_walk", "SELECT min(vid) AS lp, 0::BIGINT AS pos, min(vid) AS vid FROM rim_next UNION ALL SELECT lp, pos + 1, n.nxt FROM rim_walk w JOIN rim_next n ON n.vid = w.vid WHERE n.nxt <> lp", "rim_next")


@query("SELECT lp AS loop, pos, vid FROM rim_walk", "rim_walk")
def boundary_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.boundary_loops(_mesh(spark, sf_dir)[1])


@query("""SELECT fid, round(sqrt(x*x+y*y+z*z), 6) AS mag, round(x*y+y*z+z*x, 6) AS dot, round(acos(least(1, greatest(-1, (x*y+y*z+z*x)/(x*x+y*y+z*z)))), 6) AS angle, round(CASE WHEN x > 0.1 THEN 0.1 WHEN x < -0.1 THEN -0.1 ELSE x END, 6) AS clamped, round(exp(-x*x/(2*1.6*1.6)), 6) AS gauss, round(-2*ln(1-abs(x)), 6) AS chi2 FROM (SELECT vid AS fid, x, y, z FROM pts)""", "pts")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.vec("")
    q = (p[1], p[2], p[0])
    rows = points(spark, sf_dir).select(F.col("vid").alias("fid"), V.mag(p).alias("mag"), V.dot(p, q).alias("dot"), V.angle(p, q).alias("angle"), V.clamp(p[0], -0.1, 0.1).alias("clamped"), V.gaussian_ratio(p[0], 1.6).alias("gauss"), V.chi2_quantile_2(F.abs(p[0])).alias("chi2"))
    return _round(rows)


@query("SELECT vid, round(sqrt(x*x+y*y+z*z), 6) AS r, round(acos(z/sqrt(x*x+y*y+z*z)), 6) AS polar, round(atan2(y, x), 6) AS azimuth FROM pts", "pts")
def spherical_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, polar, azimuth = V.to_spherical(V.vec(""))
    return _round(points(spark, sf_dir).select("vid", r.alias("r"), polar.alias("polar"), azimuth.alias("azimuth")))


@query("SELECT vid, round(x*cos(0.3)-y*sin(0.3), 6) AS x, round(x*sin(0.3)+y*cos(0.3), 6) AS y, round(z, 6) AS z FROM pts", "pts")
def axis_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = V.matvec(V.axis_rotation(V.lit(0.0, 0.0, 1.0), F.lit(0.3)), V.vec(""))
    return _round(points(spark, sf_dir).select("vid", *[c.alias(a) for c, a in zip(turned, "xyz", strict=True)]))


@query("SELECT vid, round(sqrt(x*x+y*y+z*z), 6) AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM pts", "pts")
def align_to_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.vec("")
    unit = points(spark, sf_dir).select("*", *[c.alias("u" + a) for c, a in zip(V.normalize(p), "xyz", strict=True)])
    unit = unit.select("*", *[c.alias("s" + a) for c, a in zip(V.tangent_frame(V.vec("u"))[0], "xyz", strict=True)])
    turned = V.matvec(V.align(V.vec("u"), V.lit(1.0, 0.0, 0.0), V.vec("s")), p)
    return unit.select("vid", *[(F.round(c, 6) + 0.0).alias(a) for c, a in zip(turned, "xyz", strict=True)])


@query("SELECT vid, round((x+z)/2 - sqrt((1 - d/4)/d)*(x-y), 6) AS u1, round((y+x)/2 + sqrt((1 - d/4)/d)*(z-x), 6) AS v1 FROM (SELECT *, (z-x)*(z-x)+(x-y)*(x-y) AS d FROM pts)", "pts")
def circle_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("x"), F.col("y")), (F.col("z"), F.col("x"))
    centre = V.circle_centres(a, b, F.lit(1.0))[0]
    return _round(points(spark, sf_dir).select("vid", centre[0].alias("u1"), centre[1].alias("v1")))


@query("SELECT vid, round(-b - sqrt(b*b - c), 6) AS t1, round(-b + sqrt(b*b - c), 6) AS t2 FROM (SELECT vid, x*0.6 + y*0.8 AS b, x*x + y*y - 1 AS c FROM pts)", "pts")
def line_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t1, t2 = V.line_circle((F.col("x"), F.col("y")), V.lit(0.6, 0.8), V.lit(0.0, 0.0), F.lit(1.0))
    return _round(points(spark, sf_dir).select("vid", t1.alias("t1"), t2.alias("t2")))


@query("SELECT vid, round(atan2(y, x), 6) AS azimuth, round(acos(z/sqrt(x*x+y*y+z*z)), 6) AS polar, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts", "pts")
def spherical_azimuth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    azimuth, polar, r = V.to_spherical_azimuth(V.vec(""))
    held = points(spark, sf_dir).select("vid", azimuth.alias("azimuth"), polar.alias("polar"), r.alias("r"))
    back = V.from_spherical_azimuth(F.col("azimuth"), F.col("polar"), F.col("r"))
    return _round(held.select("vid", "azimuth", "polar", *[c.alias(d) for c, d in zip(back, "xyz", strict=True)]))


@query("SELECT vid, round(-2*acos(z/sqrt(x*x+y*y+z*z))*x/sqrt(x*x+y*y), 6) AS u, round(-2*acos(z/sqrt(x*x+y*y+z*z))*y/sqrt(x*x+y*y), 6) AS v FROM pts", "pts")
def sphere_normal_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the pole of a sphere of radius 2, onto which the points are laid."""
    q = V.scale(V.normalize(V.vec("")), 2.0)
    u, v = V.sphere_normal_coordinates(2.0, V.lit(0.0, 0.0, 2.0), q, V.lit(1.0, 0.0, 0.0), V.lit(0.0, 1.0, 0.0))
    return _round(points(spark, sf_dir).select("vid", u.alias("u"), v.alias("v")))
