"""Queries of sparse operators, distortion, constraints, solves and embeddings over the grid mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deform, embed, fem, graph, linalg, mesh, spatial
from ..operators.lineage import cut
from . import meshes  # noqa: F401  its SQL tables are used here
from .bindings import WIDTH, grid, points, uniform
from .registry import query, sql_table

sql_table("stiff", "SELECT i, j, sum(w) AS w FROM (SELECT j AS i, o AS j, -dp/cp/2 AS w FROM angles UNION ALL SELECT o, j, -dp/cp/2 FROM angles UNION ALL SELECT j, j, dp/cp/2 FROM angles UNION ALL SELECT o, o, dp/cp/2 FROM angles) GROUP BY 1, 2", "angles")
sql_table("massm", "SELECT i, j, sum(w) AS w FROM (SELECT i, i AS j, area/6 AS w FROM angles UNION ALL SELECT i, j, area/12 FROM angles UNION ALL SELECT j, i, area/12 FROM angles) GROUP BY 1, 2", "angles")
sql_table("cotan", "SELECT i, j, sum(w) AS w, sum(wa) AS wa FROM (SELECT j AS i, o AS j, dp/cp AS w, dp/cp/area AS wa FROM angles UNION ALL SELECT o, j, dp/cp, dp/cp/area FROM angles) GROUP BY 1, 2", "angles")


def _faces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    triangles = grid(p)
    return p, triangles, mesh.gather(triangles, p)


def _r(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("SELECT i, j, round(w, 4) AS w FROM stiff", "stiff")
def fem_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fem.stiffness(_faces(spark, sf_dir)[2]), "w")


@query("SELECT i, j, round(w, 8) AS w FROM massm", "massm")
def fem_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fem.mass(_faces(spark, sf_dir)[2]), "w", places=8)


@query("SELECT i, j, round(w, 4) AS w FROM stiff WHERE i NOT IN (SELECT vid FROM rim) AND j NOT IN (SELECT vid FROM rim)", "stiff", "rim")
def fem_dirichlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, triangles, faces = _faces(spark, sf_dir)
    return _r(fem.dirichlet(fem.stiffness(faces), triangles), "w")


@query("SELECT i, j, round(w, 4) AS w FROM cotan", "cotan")
def cotan_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fem.cotan_weights(_faces(spark, sf_dir)[2]), "w")


@query("SELECT i, j, round(wa, 2) AS w FROM cotan", "cotan")
def cotan_weights_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fem.cotan_weights(_faces(spark, sf_dir)[2], area_weighted=True), "w", places=2)


sql_table("sides", "SELECT *, pow(qx-px,2)+pow(qy-py,2)+pow(qz-pz,2) AS pq2, pow(rx-px,2)+pow(ry-py,2)+pow(rz-pz,2) AS pr2 FROM angles", "angles")
sql_table("authalic", "SELECT i, j, sum(w) AS w FROM (SELECT j AS i, i AS j, dp/cp/pq2 AS w FROM sides UNION ALL SELECT o, i, dp/cp/pr2 FROM sides) GROUP BY 1, 2", "sides")
sql_table("meanv", "SELECT i, j, sum(w) AS w FROM (SELECT i, j, cp/(sqrt(pq2*pr2)+dp)/pq2 AS w FROM sides UNION ALL SELECT i, o, cp/(sqrt(pq2*pr2)+dp)/pr2 FROM sides) GROUP BY 1, 2", "sides")


@query("SELECT i, j, round(w, 2) AS w FROM authalic", "authalic")
def authalic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fem.cotan_weights(_faces(spark, sf_dir)[2], authalic=True), "w", places=2)


@query("SELECT i, j, round(w, 3) AS w FROM meanv", "meanv")
def meanvalue_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fem.mean_value_weights(_faces(spark, sf_dir)[2]), "w", places=3)


def _ring(mode: str, expression: str, source: str = "lens", *needs: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, triangles, faces = _faces(spark, sf_dir)
        return _r(fem.one_ring_weights(faces, triangles, p, mode, normalise=True), "w", places=6)

    f.__name__ = f"onering_weights_{mode}"
    query(f"SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS w FROM (SELECT i, j, {expression} AS w FROM {source})", source, *needs)(f)


_ring("uniform", "1.0::DOUBLE")
_ring("invdist", "1/(d+2.220446049250313e-16)")
_ring("invdist2", "1/(d*d+2.220446049250313e-16)")
_ring("gaussian", "exp(-d*d/4*(SELECT avg(d) FROM lens))")
_ring("meanvalue", "w", "meanv")


@query("SELECT w.i, w.j, round(w.w / a.area, 2) AS w FROM cotan w JOIN (SELECT i, sum(CASE WHEN NOT obtuse THEN vor WHEN dp < 0 THEN area/2 ELSE area/4 END) AS area FROM areas GROUP BY 1) a ON a.i = w.i", "cotan", "areas")
def onering_weights_cotan_mixed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _faces(spark, sf_dir)
    return _r(fem.one_ring_weights(faces, triangles, p, "cotan", area="mixed"), "w", places=2)


@query("SELECT i AS vid, " + ", ".join(f"round(sum(w.w*q.{d})/sum(w.w) - any_value(p.{d}), 4) AS l{d}" for d in "xyz") + " FROM meanv w JOIN pts q ON q.vid = w.j JOIN pts p ON p.vid = w.i GROUP BY 1", "meanv", "pts")
def laplacian_meanvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return _r(mesh.laplacian(fem.mean_value_weights(faces), p), "lx", "ly", "lz")


@query("SELECT i AS vid, " + ", ".join(f"round(sum(w.w*(q.{d}-p.{d})), 4) AS l{d}" for d in "xyz") + " FROM cotan w JOIN pts q ON q.vid = w.j JOIN pts p ON p.vid = w.i GROUP BY 1", "cotan", "pts")
def laplacian_cotan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    k = fem.stiffness(faces)
    parts = [fem.apply(k, p.select("vid", F.col(d).alias("u"))).select("vid", F.round(-2 * F.col("u"), 4).alias("l" + d)) for d in "xyz"]
    return parts[0].join(parts[1], "vid").join(parts[2], "vid")


@query("SELECT k.i AS vid, round(sqrt(kx*kx+ky*ky+kz*kz)/(2*area), 3) AS h FROM (SELECT w.i, sum(w.w*(p.x-q.x)) AS kx, sum(w.w*(p.y-q.y)) AS ky, sum(w.w*(p.z-q.z)) AS kz FROM cotan w JOIN pts q ON q.vid = w.j JOIN pts p ON p.vid = w.i GROUP BY 1) k JOIN (SELECT i, sum(CASE WHEN NOT obtuse THEN vor WHEN dp < 0 THEN area/2 ELSE area/4 END) AS area FROM areas GROUP BY 1) a ON a.i = k.i", "cotan", "areas", "pts")
def mean_curv_dmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return _r(fem.mean_curvature(faces, p), "h", places=3)


@query("SELECT round(sum(a.x*w*b.x)/2, 4) AS energy FROM stiff s JOIN pts a ON a.vid = s.i JOIN pts b ON b.vid = s.j", "stiff", "pts")
def dirichlet_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return fem.quadratic_form(fem.stiffness(faces), p.select("vid", F.col("x").alias("u"))).select(F.round(F.col("value") / 2, 4).alias("energy"))


sql_table("uv", "SELECT vid, (vid % 20)::DOUBLE AS u, floor(vid / 20)::DOUBLE AS v FROM pts", "pts")
# on the unit grid every face has plane area 1/2; its two gradients follow from the corner at the right angle
sql_table(
    "maps",
    """SELECT fid, area, """ + ", ".join(f"""CASE WHEN fid % 2 = 0 THEN {b}-{a} ELSE {b}-{c} END AS s{d}, CASE WHEN fid % 2 = 0 THEN {c}-{a} ELSE {b}-{a} END AS t{d}""" for d, a, b, c in (("x", "ax", "bx", "cx"), ("y", "ay", '"by"', "cy"), ("z", "az", "bz", "cz")))
    + ", ax, ay, az, bx, \"by\", bz, cx, cy, cz FROM face_geo",
    "face_geo",
)
sql_table("abc", "SELECT fid, area, sx*sx+sy*sy+sz*sz AS a, sx*tx+sy*ty+sz*tz AS b, tx*tx+ty*ty+tz*tz AS c FROM maps", "maps")
sql_table("stretched", "SELECT fid, area, 0.5::DOUBLE AS area_uv, sqrt((a+c)/2) AS l2, sqrt((a+c+sqrt((a-c)*(a-c)+4*b*b))/2) AS linf, sqrt(greatest((a+c-sqrt((a-c)*(a-c)+4*b*b))/2, 0)) AS smin FROM abc", "abc")
# cotangents at the three corners against squared opposite plane edges: 1, 1 and 2 by the corner's angle
sql_table(
    "distorted",
    """SELECT fid, any_value(area) AS area, sum(dp/cp * (CASE WHEN right_angle THEN 2 ELSE 1 END)) AS e_angle, any_value(area)/0.5 + 0.5/any_value(area) AS e_area FROM
    (SELECT a.*, CASE WHEN fid % 2 = 0 THEN i = (SELECT v1 FROM tris t WHERE t.fid = a.fid) ELSE i = (SELECT v2 FROM tris t WHERE t.fid = a.fid) END AS right_angle FROM angles a) GROUP BY fid""",
    "angles", "tris",
)


def _uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return fem.with_uv(faces, p.select("vid", (F.col("vid") % WIDTH).cast("double").alias("u"), F.floor(F.col("vid") / WIDTH).cast("double").alias("v")))


@query("SELECT fid, round(area, 6) AS area, area_uv, round(l2, 6) AS l2, round(linf, 6) AS linf, round(smin, 4) AS smin FROM stretched", "stretched")
def stretch_l2_linf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_r(fem.stretch(_uv(spark, sf_dir)), "area", "l2", "linf", places=6), "smin")


@query("SELECT fid, round(linf/smin, 3) AS qc, round(l2*l2*area_uv, 6) AS dirichlet FROM stretched", "stretched")
def face_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fem.stretch(_uv(spark, sf_dir))
    return s.select("fid", F.round(F.col("linf") / F.col("smin"), 3).alias("qc"), F.round(F.col("l2") * F.col("l2") * F.col("area_uv"), 6).alias("dirichlet"))


@query("SELECT fid, round(area, 6) AS area, round(e_angle, 4) AS e_angle, round(e_area, 3) AS e_area FROM distorted", "distorted")
def face_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fem.face_distortion(_uv(spark, sf_dir))
    return d.select("fid", F.round("area", 6).alias("area"), F.round("e_angle", 4).alias("e_angle"), F.round("e_area", 3).alias("e_area"))


@query("SELECT round(sum(e_angle*d.area)/sum(d.area), 5) AS e_angle, round(sum(e_area*d.area)/sum(d.area), 4) AS e_area, round(sum(l2*d.area)/sum(d.area), 6) AS l2, round(max(linf), 6) AS linf FROM distorted d JOIN stretched s ON s.fid = d.fid", "distorted", "stretched")
def mesh_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fem.mesh_distortion(_uv(spark, sf_dir))
    return d.select(F.round("e_angle", 5).alias("e_angle"), F.round("e_area", 4).alias("e_area"), F.round("l2", 6).alias("l2"), F.round("linf", 6).alias("linf"))


def _constraints(p: DataFrame) -> DataFrame:
    return p.where("vid % 50 = 0").select("vid", F.col("x").alias("value"), F.lit(2.0).alias("weight"))


@query("SELECT i, j, round(sum(w), 4) AS w FROM (SELECT i, j, w FROM stiff UNION ALL SELECT vid, vid, 4.0 FROM pts WHERE vid % 50 = 0) GROUP BY 1, 2", "stiff", "pts")
def soft_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return _r(fem.soft_constraints(fem.stiffness(faces), p.select("vid", F.lit(0.0).alias("u")), _constraints(p))[0], "w")


@query("SELECT i, j, round(w, 4) AS w FROM stiff WHERE i % 50 <> 0 UNION ALL SELECT vid, vid, 1.0 FROM pts WHERE vid % 50 = 0", "stiff", "pts")
def hard_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return _r(fem.hard_constraints(fem.stiffness(faces), p.select("vid", F.lit(0.0).alias("u")), _constraints(p))[0], "w")


@query("SELECT p.vid, round(-coalesce(sum(s.w*q.x), 0), 4) AS u FROM pts p LEFT JOIN stiff s ON s.i = p.vid AND s.j % 50 = 0 LEFT JOIN pts q ON q.vid = s.j WHERE p.vid % 50 <> 0 GROUP BY 1", "stiff", "pts")
def hard_constraints_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    right = fem.hard_constraints(fem.stiffness(faces), p.select("vid", F.lit(0.0).alias("u")), _constraints(p), eliminate=True)[1]
    return right.select("vid", (F.round("u", 4) + 0.0).alias("u"))


@query("SELECT 'stiffness' AS name, true AS symmetric UNION ALL SELECT 'meanvalue', false")
def is_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, faces = _faces(spark, sf_dir)
    tests = [fem.is_symmetric(op, 1e-6).select(F.lit(n).alias("name"), "symmetric") for n, op in (("stiffness", fem.stiffness(faces)), ("meanvalue", fem.mean_value_weights(faces)))]
    return tests[0].unionByName(tests[1])


@query("SELECT i, j, round(w/sum(w) OVER (PARTITION BY i), 6) AS w FROM meanv", "meanv")
def row_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(spatial.normalise_rows(fem.mean_value_weights(_faces(spark, sf_dir)[2])), "w", places=6)


@query("SELECT a.i, b.j, round(sum(a.w*b.w), 3) AS w FROM meanv a JOIN meanv b ON b.i = a.j GROUP BY 1, 2", "meanv")
def operator_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fem.mean_value_weights(_faces(spark, sf_dir)[2])
    return _r(fem.multiply(w, w), "w", places=3)


# --- solves and embeddings: no SQL, rows only; tests hold them against invariants


@query()
def lbs_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)[2]
    return linalg.spectrum(fem.stiffness(faces), fem.mass(faces), 15)


@query()
def lbs_spectrum_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)[2]
    values, _ = linalg.lowest_eigenpairs(fem.stiffness(faces), fem.mass(faces), 15, by_solves=True)
    return spark.createDataFrame(list(enumerate(values))[1:], "k int, value double")


@query()
def poisson_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    a, b = fem.soft_constraints(fem.stiffness(faces), p.select("vid", F.lit(0.0).alias("u")), _constraints(p))
    return linalg.solve(a, b)


@query()
def conjugate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return linalg.conjugate_gradient(fem.mass(faces), p.select("vid", F.col("x").alias("u")), 1e-6)


@query()
def tutte_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _faces(spark, sf_dir)
    return embed.tutte(triangles, p)


@query()
def dncp_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _faces(spark, sf_dir)
    return embed.dncp(faces, triangles, p)


@query()
def scp_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, triangles, faces = _faces(spark, sf_dir)
    return embed.scp(faces, triangles)


@query()
def lem_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, triangles, _ = _faces(spark, sf_dir)
    return embed.laplacian_eigenmaps(mesh.uniform_neighbours(triangles))


@query()
def lem_embed_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, triangles, _ = _faces(spark, sf_dir)
    return embed.eigenmaps_by_rounds(mesh.uniform_neighbours(triangles), by_solves=True)


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p, cut(spatial.knn(p, 8).select("i", "j", "d"))


@query()
def lle_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.optimal_weights(pairs, p)


@query()
def lle_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.lle(pairs, p)


@query()
def ltsa_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.ltsa(pairs, p)


@query()
def hlle_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.hessian_lle(pairs, p)


@query()
def isomap_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.isomap(pairs, p)[0]


@query()
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.pca(points(spark, sf_dir))


@query()
def diffusion_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.diffusion_map(pairs, 0.01, points=p)


@query()
def oneringexpmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _faces(spark, sf_dir)
    return embed.one_ring_map(triangles, p)


@query()
def expmap_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _faces(spark, sf_dir)
    edges = mesh.edge_lengths(triangles, p).select("i", "j", "d")
    return embed.exponential_map(edges, p, mesh.vertex_normals(faces), p.where("vid % 100 = 50").select("vid"), 0.6)


@query()
def tps_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return embed.thin_plate(p, p.select("vid", (F.col("x") + 0.01).alias("x"), "y"))


@query()
def rigid_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return embed.register_rigid(p.select("vid", (F.col("x") + 0.01).alias("x"), "y", "z"), faces, 2)


@query()
def mips_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _faces(spark, sf_dir)
    start = p.select("vid", (F.col("vid") % WIDTH).cast("double").alias("u"), F.floor(F.col("vid") / WIDTH).cast("double").alias("v"))
    return embed.mips(triangles, faces, start, 20)


def _handles(p: DataFrame) -> DataFrame:
    return p.where("vid % 50 = 0").select("vid", "x", "y", (F.col("z") + 0.1).alias("z"), F.lit(10.0).alias("weight"))


@query()
def deform_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return deform.laplacian(fem.stiffness(faces), p, _handles(p))


@query()
def deform_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return deform.poisson(faces, _handles(p))


@query()
def fair_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, faces = _faces(spark, sf_dir)
    return deform.fair_laplacian(fem.stiffness(faces), p, _handles(p))


@query("SELECT i AS vid, " + ", ".join(f"round(any_value(p.{d}) + 0.5*(avg(q.{d}) - any_value(p.{d})), 6) AS {d}" for d in "xyz") + " FROM nbrs b JOIN pts q ON q.vid = b.j JOIN pts p ON p.vid = b.i GROUP BY 1", "nbrs", "pts")
def fair_lflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _faces(spark, sf_dir)
    return _r(deform.flow(mesh.uniform_neighbours(triangles), p, 0.5, 1), "x", "y", "z", places=6)


@query()
def fair_curvature_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _faces(spark, sf_dir)
    return deform.curvature_flow(triangles, p, 1e-3, 2)


sql_table("loop_at", "SELECT w.pos, w.vid, p.x, p.y, p.z, lead(p.x) OVER o AS bx, lead(p.y) OVER o AS b_y, lead(p.z) OVER o AS bz FROM rim_walk w JOIN pts p ON p.vid = w.vid WINDOW o AS (ORDER BY w.pos)", "rim_walk", "pts")
sql_table("loop_len", "SELECT pos, vid, sqrt(pow(coalesce(bx, f.x)-l.x,2)+pow(coalesce(b_y, f.y)-l.y,2)+pow(coalesce(bz, f.z)-l.z,2)) AS d FROM loop_at l CROSS JOIN (SELECT x, y, z FROM loop_at WHERE pos = 0) f", "loop_at")


@query("SELECT vid, round(cos(2*pi()*(c-d)/s), 6) AS u, round(sin(2*pi()*(c-d)/s), 6) AS v FROM (SELECT vid, d, sum(d) OVER (ORDER BY pos) AS c, sum(d) OVER () AS s FROM loop_len)", "loop_len")
def embed_boundary_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _faces(spark, sf_dir)
    return _r(embed.embed_boundary(mesh.boundary_loops(triangles), p), "u", "v", places=6)


@query("SELECT 0::BIGINT AS loop, round(sum(atan2(eu*fv-ev*fu, eu*fu+ev*fv))/(2*pi())) AS turns FROM (SELECT eu, ev, coalesce(lead(eu) OVER (ORDER BY pos), first_value(eu) OVER (ORDER BY pos)) AS fu, coalesce(lead(ev) OVER (ORDER BY pos), first_value(ev) OVER (ORDER BY pos)) AS fv FROM (SELECT pos, coalesce(lead(u) OVER (ORDER BY pos), first_value(u) OVER (ORDER BY pos)) - u AS eu, coalesce(lead(v) OVER (ORDER BY pos), first_value(v) OVER (ORDER BY pos)) - v AS ev FROM rim_walk w JOIN uv ON uv.vid = w.vid))", "rim_walk", "uv")
def turning_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _faces(spark, sf_dir)
    uv = p.select("vid", (F.col("vid") % WIDTH).cast("double").alias("u"), F.floor(F.col("vid") / WIDTH).cast("double").alias("v"))
    return embed.turning_number(mesh.boundary_loops(triangles), uv)


@query("SELECT round(e, 3) AS dirichlet, round(a, 6) AS area, round(e - a, 3) AS conformal FROM (SELECT sum((p.u*q.u + p.v*q.v)*w)/2 AS e FROM stiff s JOIN uv p ON p.vid = s.i JOIN uv q ON q.vid = s.j), (SELECT count(*) * 0.5 AS a FROM tris)", "stiff", "uv", "tris")
def conformal_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _faces(spark, sf_dir)
    uv = p.select("vid", (F.col("vid") % WIDTH).cast("double").alias("u"), F.floor(F.col("vid") / WIDTH).cast("double").alias("v"))
    e = embed.conformal_energy(faces, triangles, uv)
    return e.select(F.round("dirichlet", 3).alias("dirichlet"), F.round("area", 6).alias("area"), F.round("conformal", 3).alias("conformal"))


@query()
def onering_weights_optimal3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _faces(spark, sf_dir)
    return embed.one_ring_optimal_weights(triangles, p)


@query()
def onering_weights_optimal2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, _ = _faces(spark, sf_dir)
    return embed.one_ring_optimal_weights(triangles, p, plane=True)


@query()
def vertex_normals_nbrsvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.neighbour_normals(pairs, p)


@query()
def mean_curv_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _faces(spark, sf_dir)
    return embed.local_mean_curvature(mesh.uniform_neighbours(triangles), p, mesh.vertex_normals(faces))


_RIM = "(SELECT count(*) FROM rim_walk)"
sql_table("rim_mean", "SELECT m.i, sum(m.w*q.u)/sum(m.w) AS u, sum(m.w*q.v)/sum(m.w) AS v FROM meanv m JOIN uv q ON q.vid = m.j WHERE m.i IN (SELECT vid FROM rim) GROUP BY 1", "meanv", "uv", "rim")
sql_table("rebuilt", "SELECT p.vid, coalesce(r.u, p.u) AS u, coalesce(r.v, p.v) AS v FROM uv p LEFT JOIN rim_mean r ON r.i = p.vid", "uv", "rim_mean")
sql_table("rim_beside", f"SELECT w.vid, n.vid AS nxt, b.vid AS prv FROM rim_walk w JOIN rim_walk n ON n.pos = (w.pos + 1) % {_RIM} JOIN rim_walk b ON b.pos = (w.pos + {_RIM} - 1) % {_RIM}", "rim_walk")
sql_table("eased", "SELECT r.vid, coalesce(0.5*r.u + 0.25*(n.u + b.u), r.u) AS u, coalesce(0.5*r.v + 0.25*(n.v + b.v), r.v) AS v FROM rebuilt r LEFT JOIN rim_beside s ON s.vid = r.vid LEFT JOIN rebuilt n ON n.vid = s.nxt LEFT JOIN rebuilt b ON b.vid = s.prv", "rebuilt", "rim_beside")
sql_table(
    "rim_sides",
    """SELECT s.vid, n.u - b.u AS tu, n.v - b.v AS tv, sqrt(pow(n.u-c.u,2)+pow(n.v-c.v,2)) AS un, sqrt(pow(b.u-c.u,2)+pow(b.v-c.v,2)) AS ub,
    sqrt(pow(q.x-p.x,2)+pow(q.y-p.y,2)+pow(q.z-p.z,2)) AS xn, sqrt(pow(r.x-p.x,2)+pow(r.y-p.y,2)+pow(r.z-p.z,2)) AS xb FROM rim_beside s
    JOIN eased c ON c.vid = s.vid JOIN eased n ON n.vid = s.nxt JOIN eased b ON b.vid = s.prv JOIN pts p ON p.vid = s.vid JOIN pts q ON q.vid = s.nxt JOIN pts r ON r.vid = s.prv""",
    "rim_beside", "eased", "pts",
)
sql_table("rim_moves", "SELECT vid, 0.1*greatest((xn+xb)/((un+ub)*sum(xn) OVER ()/sum(un) OVER ()) - 1, 0)/sqrt(tu*tu+tv*tv) AS step, tu, tv FROM rim_sides", "rim_sides")


@query("SELECT e.vid, round(e.u + coalesce(step*tv, 0), 5) AS u, round(e.v - coalesce(step*tu, 0), 5) AS v FROM eased e LEFT JOIN rim_moves m ON m.vid = e.vid", "eased", "rim_moves")
def contract_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, triangles, faces = _faces(spark, sf_dir)
    uv = p.select("vid", (F.col("vid") % WIDTH).cast("double").alias("u"), F.floor(F.col("vid") / WIDTH).cast("double").alias("v"))
    loops = cut(mesh.boundary_loops(triangles))
    rebuilt = embed.reconstruct_boundary(uv, spatial.normalise_rows(fem.mean_value_weights(faces)), mesh.boundary_vertices(triangles))
    return _r(embed.offset_loops(loops, p, embed.smooth_loops(loops, rebuilt)), "u", "v", places=5)


def _landmarks(p: DataFrame) -> DataFrame:
    """Fifty landmarks drawn at random, the operator's own parameter; every point is laid out by them."""
    return spatial.probes(p, 50, uniform(F.col("vid"), 5))


@query()
def landmark_isomap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.landmark_isomap(graph.symmetrise(pairs), p, _landmarks(p))


@query()
def conformal_isomap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs = _neighbours(spark, sf_dir)
    return embed.landmark_isomap(graph.symmetrise(pairs), p, _landmarks(p), conformal=True)
