"""Invariants of operators that SQL does not express, on meshes with known answers."""

import inspect
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshspark.functions import vec as V
from meshspark.operators import deform, embed, fem, graph, linalg, mesh, metrics, sampling, spatial, spc
from meshspark.plans.bindings import uniform


def plane(spark, n=6, height=lambda x, y: 0.0):
    """An n by n grid over the unit square; z by ``height``."""
    points = [(r * n + c, c / (n - 1), r / (n - 1)) for r in range(n) for c in range(n)]
    vertices = spark.createDataFrame([(k, float(x), float(y), float(height(x, y))) for k, x, y in points], "vid long, x double, y double, z double")
    faces = [(r * n + c, r * n + c + 1, r * n + c + n) for r in range(n - 1) for c in range(n - 1)] + [(r * n + c + 1, r * n + c + n + 1, r * n + c + n) for r in range(n - 1) for c in range(n - 1)]
    return vertices, spark.createDataFrame([(k, *f) for k, f in enumerate(faces)], "fid long, v1 long, v2 long, v3 long")


def table(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def flat(spark):
    vertices, triangles = plane(spark)
    return vertices, triangles, mesh.gather(triangles, vertices)


def test_finite_elements(flat):
    vertices, triangles, faces = flat
    k = fem.stiffness(faces)
    assert all(abs(r.s) < 1e-12 for r in k.groupBy("i").agg(F.sum("w").alias("s")).collect())
    assert fem.mass(faces).agg(F.sum("w")).first()[0] == pytest.approx(1.0)
    # a linear function has no Laplacian inside, and Dirichlet energy = area * slope^2
    inner = {r.vid for r in vertices.collect()} - {r.vid for r in mesh.boundary_vertices(triangles).collect()}
    image = table(fem.apply(k, vertices.select("vid", (2 * F.col("x") + F.col("y")).alias("u"))), "vid", "u")
    assert all(abs(image[v][0]) < 1e-12 for v in inner)
    assert fem.quadratic_form(k, vertices.select("vid", F.col("x").alias("u"))).first().value == pytest.approx(1.0)


def test_spectrum_of_the_square(spark):
    vertices, triangles = plane(spark, 14)
    faces = mesh.gather(triangles, vertices)
    got = [r.value for r in linalg.spectrum(fem.stiffness(faces), fem.mass(faces), 4).orderBy("k").collect()]
    assert got == pytest.approx([math.pi**2, math.pi**2, 2 * math.pi**2, 4 * math.pi**2], rel=0.06)


def test_solvers_agree(flat):
    vertices, _, faces = flat
    held = vertices.where("vid in (0, 5, 30)").select("vid", F.col("x").alias("value"), F.lit(2.0).alias("weight"))
    a, b = fem.soft_constraints(fem.stiffness(faces), vertices.select("vid", F.lit(0.0).alias("u")), held)
    dense, steps = table(linalg.solve(a, b), "vid", "u"), table(linalg.conjugate_gradient(a, b, 1e-12), "vid", "u")
    assert all(dense[v][0] == pytest.approx(steps[v][0], abs=1e-8) for v in dense)


def test_dense_solves_refuse_what_is_too_large(flat):
    out = linalg.gathered({"a": fem.mass(flat[2])}, lambda a: pd.DataFrame({"n": [len(a)]}), "n long", most_rows=10)
    with pytest.raises(Exception, match="too many rows for one task"):
        out.collect()
    with pytest.raises(ValueError, match="unknowns"):
        linalg.Index(np.arange(linalg.MOST + 1))


def test_minimise():
    f = lambda x: (float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2), np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    assert linalg.minimise(f, np.array([-1.2, 1.0]), 5000) == pytest.approx([1, 1], abs=1e-2)


def shape_error(spark, vertices, uv, columns=("u", "v")):
    """How far plane coordinates are from the vertices' x and y up to a similarity."""
    both = sorted((r.vid, r.x, r.y, r[columns[0]], r[columns[1]]) for r in vertices.join(uv, "vid").collect())
    p, q = np.array([[b[1], b[2]] for b in both]), np.array([[b[3], b[4]] for b in both])
    p, q = p - p.mean(0), q - q.mean(0)
    p, q = p / np.linalg.norm(p), q / np.linalg.norm(q)
    return 1 - np.linalg.svd(p.T @ q)[1].sum()


@pytest.mark.parametrize("method", ["dncp", "scp", "scp generalized", "mean value"])
def test_flat_meshes_are_reproduced(spark, flat, method):
    vertices, triangles, faces = flat
    if method == "dncp":
        uv = embed.dncp(faces, triangles, vertices)
    elif method.startswith("scp"):
        uv = embed.scp(faces, triangles, "generalized" if "gen" in method else "fiedler")
    else:
        uv = embed.embed_interior(fem.mean_value_weights(faces), embed.embed_boundary(mesh.boundary_loops(triangles), vertices, "copy"))
    assert shape_error(spark, vertices, uv) < (0.05 if method == "scp" else 1e-6)


def test_tutte_lies_in_the_circle(flat):
    vertices, triangles, _ = flat
    uv = table(embed.tutte(triangles, vertices), "vid", "u", "v")
    rim = {r.vid for r in mesh.boundary_vertices(triangles).collect()}
    assert len(uv) == 36 and all((math.hypot(*uv[v]) == pytest.approx(1)) if v in rim else math.hypot(*uv[v]) < 1 for v in uv)


def long_form(df):
    return df.groupBy("vid").agg(F.max(F.when(F.col("d") == 1, F.col("value"))).alias("u"), F.max(F.when(F.col("d") == 2, F.col("value"))).alias("v"))


@pytest.mark.parametrize("method", ["isomap", "ltsa", "hlle", "lle"])
def test_unrolled_sheets(spark, method):
    vertices, triangles = plane(spark, 9)
    rolled = vertices.select("vid", F.sin(2 * F.col("x")).alias("x"), F.col("y"), F.cos(2 * F.col("x")).alias("z"))
    pairs = spatial.knn(rolled, 8).select("i", "j", "d")
    if method == "isomap":
        out, residual = embed.isomap(pairs, rolled)
        assert residual.first().residual < 0.02
    else:
        out = {"ltsa": embed.ltsa, "hlle": embed.hessian_lle, "lle": embed.lle}[method](pairs, rolled)
    true = vertices.select("vid", (2 * F.col("x")).alias("x"), "y")
    rows = sorted((r.vid, r.x, r.y, r.u, r.v) for r in true.join(long_form(out), "vid").collect())
    p, q = np.array([[*r[1:3], 1.0] for r in rows]), np.array([r[3:] for r in rows])
    assert len(rows) == 81
    fit = q - p @ np.linalg.lstsq(p, q, rcond=None)[0]  # up to an affine map
    assert (fit**2).sum() / ((q - q.mean(0)) ** 2).sum() < {"isomap": 0.02, "ltsa": 0.02, "hlle": 0.02, "lle": 0.2}[method]


def test_one_ring_and_exponential_maps(flat):
    vertices, triangles, faces = flat
    rings = embed.one_ring_map(triangles, vertices).toPandas()
    xy = table(vertices, "vid", "x", "y")
    for vid, ring in rings.groupby("vid"):
        for r in ring.itertuples():
            assert math.hypot(r.u, r.v) == pytest.approx(math.dist(xy[vid], xy[r.nbr]))
        a = ring.sort_values("pos")[["u", "v"]].to_numpy()
        b = np.roll(a, -1, axis=0)
        assert (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] > 0).all()  # flattened faces keep their side
    edges = mesh.edge_lengths(triangles, vertices).select("i", "j", "d")
    uv = embed.exponential_map(edges, vertices, mesh.vertex_normals(faces), vertices.where("vid = 14").select("vid"), 0.7).toPandas()
    assert len(uv) > 15
    for r in uv.itertuples():
        assert math.hypot(r.u, r.v) == pytest.approx(math.dist(xy[14], xy[r.vid]), abs=1e-9)


def test_mips_keeps_a_perfect_map_and_improves_a_bad_one(flat):
    vertices, triangles, faces = flat
    start = vertices.select("vid", (F.col("x") * 2).alias("u"), F.col("y").alias("v"))
    out = embed.mips(triangles, faces, start, 200)
    uv = fem.with_uv(faces, out)
    angle = lambda f: fem.mesh_distortion(f).first().e_angle
    assert angle(fem.with_uv(faces, start)) > 2.4 and angle(uv) == pytest.approx(2.0, abs=0.02)


def test_thin_plate_goes_through_its_points(spark):
    points = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 2.0), (0.0, 1.0, 0.5), (1.0, 1.0, 3.0), (0.4, 0.7, -1.0)], "x double, y double, z double")
    at = points.select((F.col("z") * 10).cast("long").alias("vid"), "x", "y")
    assert all(r.z == pytest.approx(r.vid / 10) for r in embed.thin_plate(points, at).collect())


def test_pca_and_registration(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [3, 1, 0.2]
    rows = embed.pca(spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double, z double")).collect()
    assert [r.k for r in rows] == [1, 2] and rows[0].variance == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True))[-1]) and abs(rows[0].c_x) > 0.98
    vertices, triangles = plane(spark, 7, lambda a, b: math.sin(3 * a) * math.cos(2 * b))
    faces = mesh.gather(triangles, vertices)
    moved = sampling.rigid_motion(vertices, (0.02, -0.03, 0.02), (0.01, -0.02, 0.015))
    back = embed.register_rigid(moved, faces, 25)
    gap = lambda df: spatial.nearest_triangles(df, faces).agg(F.sqrt(F.max("d2"))).first()[0]
    assert gap(back) < 0.2 * gap(moved)


def test_deformations_keep_a_mesh_at_rest_and_follow_a_shift(spark):
    vertices, triangles = plane(spark, 6, lambda a, b: a * b)
    faces = mesh.gather(triangles, vertices)
    xyz = table(vertices, "vid", "x", "y", "z")
    for shift in (0.0, 0.5):
        held = vertices.where("vid in (0, 5, 30, 35, 14)").select("vid", "x", "y", (F.col("z") + shift).alias("z"), F.lit(100.0).alias("weight"))
        for out in (deform.laplacian(fem.stiffness(faces), vertices, held), deform.poisson(faces, held)):
            got = table(out, "vid", "x", "y", "z")
            assert all(got[v] == pytest.approx((xyz[v][0], xyz[v][1], xyz[v][2] + shift), abs=1e-4) for v in xyz)


def test_fairing_lowers_the_energy(spark):
    vertices, triangles = plane(spark, 8, lambda a, b: math.sin(17 * a + 31 * b) / 10)
    rough = lambda p: mesh.laplacian(mesh.uniform_neighbours(triangles), p).agg(F.sum(F.col("lz") * F.col("lz"))).first()[0]
    assert rough(deform.flow(mesh.uniform_neighbours(triangles), vertices, 0.5, 2)) < 0.5 * rough(vertices)


def test_closest_point_against_sampling():
    rng = np.random.default_rng(3)
    a, b, c, p = (rng.normal(size=(60, 3)) for _ in range(4))
    d2, q = spatial.closest(p, a, b, c)
    s = np.linspace(0, 1, 61)
    u, v = (g.reshape(-1) for g in np.meshgrid(s, s))
    u, v = u[u + v <= 1], v[u + v <= 1]
    grid = a[:, None] + u[:, None] * (b - a)[:, None] + v[:, None] * (c - a)[:, None]
    least = ((grid - p[:, None]) ** 2).sum(2).min(1)
    assert (d2 <= least + 1e-12).all() and np.allclose(d2, least, atol=0.1) and np.allclose(((p - q) ** 2).sum(1), d2)


def test_closest_point_columns(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(40, 12))] + [(0.0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0)]
    rows = [tuple(float(x) for x in r) for r in rows]
    names = [n + d for n in "pabc" for d in "xyz"]
    d2, spot = V.closest_on_triangle(*(V.vec(n) for n in "pabc"))
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(d2).collect()]
    x = np.array(rows)
    assert got == pytest.approx(spatial.closest(*(x[:, 3 * k : 3 * k + 3] for k in range(4)))[0].tolist())


def test_joins_by_cells_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.random((150, 3)) * [1, 2, 0.3]
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "vid long, x double, y double, z double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert {(r.i, r.j) for r in spatial.eps_ball(points, 0.25).collect()} == {(i, j) for i in range(150) for j in range(150) if i != j and d[i, j] < 0.25}
    got = {(r.i, r.r): r.j for r in spatial.knn(points, 5).collect()}
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): j for i in range(150) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    assert spatial.knn(points.limit(3), 8).count() == 6 and spatial.knn(points.limit(0), 8).count() == 0


def test_paths_components_and_filling(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 2.5), (2, 3, 1.0), (5, 6, 1.0)], "i long, j long, d double")
    vertices = spark.createDataFrame([(k,) for k in range(8)], "vid long")
    paths = graph.shortest_paths(edges, vertices.where("vid = 0"), 2.5)
    assert table(paths, "vid", "d", "pred") == {0: (0.0, None), 1: (1.0, 0), 2: (2.0, 1)}
    assert table(graph.components(vertices, edges), "vid", "component") == {0: (0,), 1: (0,), 2: (0,), 3: (0,), 4: (4,), 5: (5,), 6: (5,), 7: (7,)}
    assert sorted(r.vid for r in graph.largest_component(vertices, edges).collect()) == [0, 1, 2, 3] and sorted(r.vid for r in graph.largest_component(vertices, edges, 2).collect()) == [5, 6]
    values = spark.createDataFrame([(0, 1.0), (1, None), (2, None), (3, None), (4, None)], "fid long, dist double")
    weights = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 2, 2.0), (4, 4, 1.0)], "fid long, neigh long, w double")
    assert table(graph.fill_missing(values, weights), "fid", "dist") == {0: (1.0,), 1: (1.0,), 2: (1.0,), 3: (1.0,), 4: (None,)}


def test_loops_of_a_ring(spark):
    vertices, triangles = plane(spark, 5)
    ring = triangles.where("not (v1 = 6 and v2 = 7 and v3 = 11) and not (v1 = 7 and v2 = 12)")
    loops = mesh.boundary_loops(triangles).toPandas().sort_values("pos")
    assert loops["vid"].tolist()[0] == 0 and len(loops) == 16 and sorted(loops["pos"]) == list(range(16))
    edges = {tuple(sorted((r.i, r.j))) for r in mesh.boundary_edges(triangles).collect()}
    walk = loops["vid"].tolist()
    assert {tuple(sorted(e)) for e in zip(walk, walk[1:] + walk[:1], strict=True)} == edges
    inner = mesh.boundary_loops(ring).where("loop <> 0").toPandas().sort_values("pos")
    assert len(inner) == 4 and set(inner["vid"]) == {6, 7, 11, 12} and mesh.boundary_loops(ring).count() == 20
    pinched = triangles.where("v1 in (0, 6)")  # faces that touch in vertices alone
    assert mesh.boundary_loops(pinched).count() <= mesh.boundary_edges(pinched).count()


def test_backward_metric_splits_each_sample_once(spark):
    vertices, triangles = plane(spark, 4)
    fine, kids = metrics.subdivide(triangles, vertices, lambda i, j: 1000 + (F.col(i) if isinstance(i, str) else i) * 100 + j)
    children = mesh.gather(kids, fine).join(kids.select("fid", "father_id"), "fid")
    assert fem.V.tri_area and children.agg(F.sum(V.tri_area(V.vec("a"), V.vec("b"), V.vec("c")))).first()[0] == pytest.approx(1.0)
    around = kids.select("fid").crossJoin(kids.select(F.col("fid").alias("neigh")))
    scan = mesh.gather(triangles, vertices.withColumn("z", F.lit(0.125)))
    out, counts = metrics.backward(mesh.gather(triangles, vertices), children, around, scan, 200.0, 0.0, uniform)
    row, n = out.agg(F.sum("weight").alias("w"), F.sum("weighted_dist").alias("d")).first(), counts.first()
    assert row.w == pytest.approx(n.n_samples - n.n_dropped) and row.d / row.w == pytest.approx(0.125) and n.n_samples >= 200


def test_samples_lie_on_their_faces_and_follow_area(spark):
    vertices, triangles = plane(spark, 3, lambda a, b: a)
    faces = mesh.gather(triangles, vertices)
    got = sampling.sample(faces, 4000, uniform)
    assert got.where(F.abs(F.col("z") - F.col("x")) > 1e-12).count() == 0 and got.groupBy("fid").count().agg(F.min("count"), F.max("count")).first() == (500, 500)
    mean = got.agg(F.avg("x"), F.avg("y")).first()
    assert mean[0] == pytest.approx(0.5, abs=0.02) and mean[1] == pytest.approx(0.5, abs=0.02)


def test_rank_moments_are_those_of_sampling_without_replacement(spark):
    n, win, lam = 25, 7, 0.05
    w = (1 - lam) ** np.arange(win)
    var = (w * w).sum() * (n * n - 1) / 12 - (w.sum() ** 2 - (w * w).sum()) * (n + 1) / 12
    mean, sd = spc.rank_moments(F.lit(float(n)), F.lit(win), lam)
    row = spark.range(1).select(mean.alias("m"), sd.alias("s")).first()
    assert row.m == pytest.approx(w.sum() * (n + 1) / 2) and row.s == pytest.approx(math.sqrt(var))


def test_joint_limits_by_depth():
    rng = np.random.default_rng(7)
    stats = rng.normal(size=(400, 8))
    lo, hi = spc.joint_limits(stats, 0.05)
    inside = ((stats >= lo) & (stats <= hi)).all(axis=1).mean()
    assert inside > 0.95
    tighter = np.sort(stats, axis=0)
    cut = int((stats[:, 0] < lo[0]).sum()) + 1
    closer = ((stats >= tighter[cut]) & (stats <= tighter[399 - cut])).all(axis=1).mean()
    assert closer <= 0.95


@pytest.mark.parametrize("kind", ["rank", "joint"])
def test_permutation_limits_hold_their_rate(spark, kind):
    rng = np.random.default_rng(9)
    rows = [(s, t, f"f{k}", float(v), float(v * v + rng.normal())) for s in range(1, 9) for t in range(1, 27) for k, v in enumerate(rng.normal(size=5))]
    obs = spark.createDataFrame(rows, "sim_id int, t int, feature_id string, value double, value2 double")
    if kind == "rank":
        out = spc.permutation_limits_rank(obs, 20, 6, permutations=300, alpha=0.02)
        stat = {(r.sim_id, r.t): r.t_stat for r in spc.rank_chart(obs, 20, 6).collect()}
    else:
        out = spc.permutation_limits_joint(obs, 20, 6, permutations=200, alpha=0.05)
        stat = {(r.sim_id, r.t, r.stat): r.t_stat for r in spc.moment_chart(obs, 20, 6).collect()}
    got = out.collect()
    again = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and all(0.3 < r.acceptance <= 1 for r in got)
    for r in got:
        assert r.t_stat == pytest.approx(stat[(r.sim_id, r.t) if kind == "rank" else (r.sim_id, r.t, r.stat)], rel=1e-6, abs=1e-9)
    marked = spc.alarms(out)
    assert marked.where("alarm").select("sim_id").distinct().count() <= 4


def test_run_lengths(spark):
    chart = spark.createDataFrame([(1, 21, 1, False), (1, 22, 1, True), (2, 21, 1, False), (2, 22, 1, False), (2, 23, 1, False)], "sim_id int, t int, stat int, alarm boolean")
    assert table(spc.run_lengths(chart, 20, 3), "sim_id", "run_length", "censored") == {1: (2, False), 2: (4, True)}
    summary = spc.run_length_summary(spc.run_lengths(chart, 20, 3), 3).first()
    assert (summary["mean"], summary["beyond"], summary["median"]) == (3.0, 0.5, 3.0)


def test_gathered_tables_keep_empty_ones(spark):
    none = spark.createDataFrame([], "i long, w double")
    out = linalg.gathered({"a": none}, lambda a: pd.DataFrame({"n": [len(a)]}), "n long")
    assert out.collect() == [(0,)]


def test_normals_and_curvature_of_a_sphere(spark):
    vertices, triangles = plane(spark, 9, lambda a, b: math.sqrt(4 - (a - 0.5) ** 2 - (b - 0.5) ** 2))
    centred = vertices.select("vid", (F.col("x") - 0.5).alias("x"), (F.col("y") - 0.5).alias("y"), "z")
    pairs = mesh.uniform_neighbours(triangles)
    true = centred.select("vid", *[(F.col(d) / 2).alias("n" + d) for d in "xyz"])
    h = table(embed.local_mean_curvature(pairs, centred, true), "vid", "h")
    inner = [9 * r + c for r in range(1, 8) for c in range(1, 8)]
    assert all(h[v][0] == pytest.approx(-0.5, rel=0.02) for v in inner)
    got, want = table(embed.neighbour_normals(pairs, centred), "vid", "nx", "ny", "nz"), table(true, "vid", "nx", "ny", "nz")
    assert all(abs(np.dot(got[v], want[v])) > 0.99 for v in inner)
    weights = embed.one_ring_optimal_weights(triangles, centred, plane=True).groupBy("i").agg(F.sum("w").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in weights.collect())


def test_permutation_limits_draw_as_many_as_the_reference():
    """25,000, at which the joint limits of eight statistics do more than hold the whole sample."""
    for limits in (spc.permutation_limits_rank, spc.permutation_limits_joint):
        assert inspect.signature(limits).parameters["permutations"].default == 25_000
    sample = np.random.default_rng(2).normal(size=(spc.PERMUTATIONS, 8))
    lo, hi = spc.joint_limits(sample)
    assert (lo > sample.min(axis=0)).all() and (hi < sample.max(axis=0)).all()
    assert ((sample >= lo) & (sample <= hi)).all(axis=1).mean() > 1 - spc.ALPHA


@pytest.mark.parametrize("conformal", [False, True])
def test_landmark_isomap_unrolls_a_curve(spark, conformal):
    n = 9  # points on a helix, even steps: along the curve they are a line
    helix = [(k, math.cos(k / 4), math.sin(k / 4), k / 10) for k in range(n)] + [(100, 9.0, 9.0, 9.0)]
    p = spark.createDataFrame(helix, "vid long, x double, y double, z double")
    step = math.dist(helix[0][1:], helix[1][1:])
    edges = spark.createDataFrame([(k + a, k + b, step) for k in range(n - 1) for a, b in ((0, 1), (1, 0))], "i long, j long, d double")
    marks = spark.createDataFrame([(0,), (3,), (7,), (100,)], "vid long")
    out = {r["vid"]: r["value"] for r in embed.landmark_isomap(edges, p, marks, 1, conformal).collect()}
    assert sorted(out) == list(range(n))  # the point apart belongs to no component of theirs
    assert abs(np.corrcoef([out[k] for k in range(n)], range(n))[0, 1]) > (0.99 if conformal else 1 - 1e-9)
    if not conformal:
        assert embed.landmark_isomap(edges, p, marks.where("vid = 100")).count() == 0


def test_refine_keeps_area_and_edges(spark):
    faces = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0), (8, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0)], "fid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    out = metrics.refine(faces, 0.25).withColumnRenamed("k", "fid").toPandas()
    large = out[out["father_id"] == 7]
    assert len(large) == 9 and large["fid"].is_unique and len(out) == 10
    areas = mesh.face_area(spark.createDataFrame(large)).toPandas()["area"]
    assert np.allclose(areas, 2 / 9)
    assert [int(large[e].sum()) for e in ("e1", "e2", "e3")] == [3, 3, 3]


def test_probe_spacing(spark):
    line = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(10)], "vid long, x double, y double, z double")
    got = spatial.spacing(line, uniform(F.col("vid")), 100, 2).first()
    assert got["farthest"] == pytest.approx((8 * 1 + 2 * 2) / 10) and got["mean"] == pytest.approx((16 + 6) / 20)
    assert spatial.spacing(line.limit(0), uniform(F.col("vid"))).first()["mean"] is None


def test_numeric_gradient():
    assert linalg.numeric_gradient(lambda x: float(x @ x), np.array([1.0, 2.0]), 0.5) == pytest.approx([-1.25, -2.25])


def test_boundary_moves(spark):
    uv = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0), (3, 0.0, 2.0), (4, 1.0, 1.0)], "vid long, u double, v double")
    loops = spark.createDataFrame([(0, k, k) for k in range(4)], "loop long, pos long, vid long")
    weights = spark.createDataFrame([(0, 4, 1.0), (4, 0, 1.0)], "i long, j long, w double")
    assert table(embed.reconstruct_boundary(uv, weights, loops.where("vid < 2").select("vid")), "vid", "u", "v") == {0: (1.0, 1.0), 1: (0.0, 0.0), 2: (2.0, 2.0), 3: (0.0, 2.0), 4: (1.0, 1.0)}
    assert table(embed.smooth_loops(loops, uv), "vid", "u", "v") == {0: (0.5, 0.5), 1: (1.5, 0.5), 2: (1.5, 1.5), 3: (0.5, 1.5), 4: (1.0, 1.0)}
    space = uv.select("vid", F.col("u").alias("x"), F.col("v").alias("y"), F.lit(0.0).alias("z"))
    assert table(embed.offset_loops(loops, space, uv), "vid", "u", "v") == table(uv, "vid", "u", "v")


def test_simulated_parts_move_by_noise_and_defect(spark):
    given = spark.createDataFrame([(k, float(k), 0.0, 1.0) for k in range(200)] + [(200, None, 0.0, 0.0)], "vid long, x double, y double, z double")
    out = spc.simulate(given, lambda key, stream: sampling.normal(uniform, key, stream), 2, 6, 4, 0.1, 3.0).toPandas()
    assert len(out) == 201 * 12 and out["x"].isna().sum() == 12
    out = out[out["vid"] < 200]
    assert sorted(out["t"].unique()) == [1, 2, 3, 4, 5, 6] and sorted(out["sim_id"].unique()) == [0, 1]
    calm, moved = out[out["t"] <= 4], out[out["t"] > 4]
    assert abs((calm["x"] - calm["vid"]).std() - 0.1) < 0.01 and abs(calm["z"].mean() - 1) < 0.01 and abs(moved["z"].mean() - 4) < 0.02
    off = (out["x"] - out["vid"]) ** 2 + out["y"] ** 2 + (out["z"] - 1) ** 2
    assert np.allclose(np.sqrt(off), out["d"])
    assert spc.simulate(given.limit(0), lambda key, stream: sampling.normal(uniform, key, stream)).count() == 0


def test_distances_by_parts_are_those_of_shortest_paths(spark, monkeypatch):
    r = np.random.default_rng(21)
    xyz = r.normal(size=(160, 3))
    p = spark.createDataFrame([(k * 3, *map(float, row)) for k, row in enumerate(xyz)], "vid long, x double, y double, z double")
    edges = spatial.knn(p, 3).select("i", "j", "d")
    monkeypatch.setattr(graph, "PART", 12)
    parts = graph.parts_in_space(p)
    assert parts.select("part").distinct().count() > 15
    marks = p.where("vid % 40 = 0").select("vid")
    got = {(x.source, x.vid): x.d for x in graph.distances(edges, marks, parts).collect()}
    want = {(x.source, x.vid): x.d for x in graph.shortest_paths(edges, marks).collect()}
    assert got.keys() == want.keys() and len(want) > 160
    assert [got[k] for k in want] == pytest.approx([want[k] for k in want], abs=1e-12)
    assert graph.distances(edges, marks.where("vid < 0"), parts).count() == 0


def test_rounds_follow_parts_and_not_edges(spark):
    line = spark.range(400).select(F.col("id").alias("vid"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    edges = line.where("vid > 0").select(F.col("vid").alias("i"), (F.col("vid") - 1).alias("j"), F.lit(1.0).alias("d"))
    parts = line.select("vid", F.floor(F.col("vid") / 100).alias("part"))
    far = graph.distances(edges, line.where("vid = 0").select("vid"), parts, most_rounds=5)
    assert far.where("d = vid and source = 0").count() == 400
