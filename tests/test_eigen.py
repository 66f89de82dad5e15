"""The eigensolver by rounds against the dense one, and its odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.operators import embed, fem, graph, linalg, mesh, spatial


def sheet(spark, wide, high):
    at = spark.range(wide * high).withColumnRenamed("id", "vid")
    column, row = F.col("vid") % wide, F.floor(F.col("vid") / wide)
    vertices = at.select("vid", (column / 10).alias("x"), (row / 10).alias("y"), F.lit(0.0).alias("z"))
    v = F.col("vid")
    two = F.array(F.struct(v.alias("v1"), (v + 1).alias("v2"), (v + wide).alias("v3")), F.struct((v + 1).alias("v1"), (v + wide + 1).alias("v2"), (v + wide).alias("v3")))
    faces = at.where((column < wide - 1) & (row < high - 1)).select(F.posexplode(two).alias("k", "f"), "vid")
    triangles = faces.select((2 * F.col("vid") + F.col("k")).alias("fid"), "f.*")
    return triangles, mesh.gather(triangles, vertices)


def dense(df, ids):
    out = np.zeros((len(ids), len(ids)))
    for r in df.collect():
        out[ids[r.i], ids[r.j]] += r.w
    return out


def test_lowest_eigenpairs(spark):
    _, faces = sheet(spark, 9, 7)
    k, m = fem.stiffness(faces), fem.mass(faces)
    values, vectors = linalg.lowest_eigenpairs(k, m, 4)
    expected = [r.value for r in linalg.spectrum(k, m, 4).orderBy("k").collect()]
    assert abs(values[0]) < 1e-9 and values[1:] == pytest.approx(expected, rel=1e-6)
    got = vectors.orderBy("vid").collect()
    ids = {r.vid: n for n, r in enumerate(got)}
    a, b = dense(k, ids), dense(m, ids)
    u = np.array([[r[f"u{c}"] for c in range(5)] for r in got])
    assert u.T @ b @ u == pytest.approx(np.eye(5), abs=1e-8)
    assert u.T @ a @ u == pytest.approx(np.diag(values), abs=1e-6)
    # tables that are small, empty or not definite
    one = faces.where("fid = 0")
    few, three = linalg.lowest_eigenpairs(fem.stiffness(one), fem.mass(one), 9)
    assert len(few) == 3 and three.count() == 3
    assert few[1:] == pytest.approx([r.value for r in linalg.spectrum(fem.stiffness(one), fem.mass(one), 9).orderBy("k").collect()])
    none = linalg.lowest_eigenpairs(k.where("false"), m.where("false"))
    assert none[0] == [] and none[1].count() == 0
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        linalg.lowest_eigenpairs(k, m, 4, most_rounds=2)


def test_eigenmaps_by_rounds(spark):
    triangles, _ = sheet(spark, 9, 5)
    pairs = mesh.uniform_neighbours(triangles)
    got = {(r.vid, r.d): r.value for r in embed.eigenmaps_by_rounds(pairs, tolerance=1e-5).collect()}
    whole = {(r.vid, r.d): r.value for r in embed.laplacian_eigenmaps(pairs).collect()}
    assert got.keys() == whole.keys()
    for d in (1, 2):  # the sign of a vector whose largest entries are equal is free
        a, b = (np.array([x[key] for key in sorted(got) if key[1] == d]) for x in (got, whole))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-4 * np.abs(b).max()
    assert embed.eigenmaps_by_rounds(pairs.where("false")).count() == 0


def test_few_rounds_of_solves(spark):
    _, faces = sheet(spark, 4, 20)
    k, m = fem.stiffness(faces), fem.mass(faces)
    expected = [r.value for r in linalg.spectrum(k, m, 4).orderBy("k").collect()]
    values, _ = linalg.lowest_eigenpairs(k, m, 4, most_rounds=10, by_solves=True)
    assert abs(values[0]) < 1e-9 and values[1:] == pytest.approx(expected, rel=1e-5)


def test_eigenmaps_beyond_the_dense_bound(spark, monkeypatch):
    triangles, _ = sheet(spark, 4, 20)
    pairs = mesh.uniform_neighbours(triangles)
    whole = {(r.vid, r.d): r.value for r in embed.laplacian_eigenmaps(pairs).collect()}
    monkeypatch.setattr(linalg, "MOST", 79)
    monkeypatch.setattr(linalg, "PART", 40)
    got = {(r.vid, r.d): r.value for r in embed.laplacian_eigenmaps(pairs).collect()}
    assert got.keys() == whole.keys()
    for d in (1, 2):
        a, b = (np.array([x[key] for key in sorted(got) if key[1] == d]) for x in (got, whole))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-3 * np.abs(b).max()


def agree(a, b):
    """Whether two plane maps of the same vertices differ by a turn and a mirror alone."""
    p, q = (np.array([x[v] for v in sorted(x)]) for x in (a, b))
    turn = np.linalg.svd(p.T @ q)
    return a.keys() == b.keys() and np.abs(p @ (turn[0] @ turn[2]) - q).max() < 1e-3 * np.abs(q).max()


@pytest.mark.parametrize("method", ["dncp"])
def test_conformal_maps_beyond_the_dense_bound(spark, monkeypatch, method):
    triangles, faces = sheet(spark, 4, 20)
    vertices = faces.select(F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), F.col(c + "x").alias("x"), F.col(c + "y").alias("y"), (F.col(c + "x") * F.col(c + "y")).alias("z")) for k, c in ((1, "a"), (2, "b"), (3, "c"))])).alias("s")).select("s.*").distinct()
    faces = mesh.gather(triangles, vertices)  # not flat: the next eigenvalue stands apart from the null ones
    run = lambda: {r.vid: (r.u, r.v) for r in (embed.dncp(faces, triangles, vertices) if method == "dncp" else embed.scp(faces, triangles)).collect()}
    whole = run()
    monkeypatch.setattr(linalg, "MOST", 159)
    monkeypatch.setattr(linalg, "PART", 80)
    got = run()
    assert agree(got, whole)
    if method == "dncp":  # pinned, so that nothing turns
        assert all(got[v] == pytest.approx(whole[v], abs=1e-8) for v in whole)


@pytest.mark.parametrize("method", ["diffusion", "ltsa"])
def test_neighbourhood_embeddings_beyond_the_dense_bound(spark, monkeypatch, method):
    r = np.random.default_rng(6)
    points = spark.createDataFrame([(3 * k, *map(float, r.uniform(size=3) * [4, 2, 1])) for k in r.permutation(150).tolist()], "vid long, x double, y double, z double")
    pairs = linalg.cut(spatial.knn(points, 8).select("i", "j", "d"))
    make = {"ltsa": embed.ltsa}.get(method)
    run = lambda: {(x.vid, x.d): x.value for x in (make(pairs, points) if make else embed.diffusion_map(pairs, 0.05, points=points)).collect()}
    whole = run()
    monkeypatch.setattr(linalg, "MOST", 100)
    monkeypatch.setattr(graph, "PART", 40)
    got = run()
    assert got.keys() == whole.keys()
    for d in (1, 2):
        a, b = (np.array([x[key] for key in sorted(got) if key[1] == d]) for x in (got, whole))
        assert np.linalg.norm(a - b) < 0.05 * np.linalg.norm(b)
