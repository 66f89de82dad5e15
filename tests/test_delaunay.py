import itertools
import math

import numpy as np
import pytest

from meshspark.operators import delaunay, mesh

SCHEMA = "fid long, " + ", ".join(f"{c} double" for c in delaunay.CORNERS)


@pytest.mark.parametrize("seed", range(6))
def test_triangulation_against_brute_force(seed):
    """No point lies in the circle of any face; the faces fill the triangle and none is too large."""
    rng = np.random.default_rng(seed)
    corners = rng.random((3, 2)) * [1, 10 ** -(seed % 3)]
    if delaunay._areas(corners, np.array([[0, 1, 2]]))[0] < 0:
        corners = corners[[0, 2, 1]]
    area = delaunay._areas(corners, np.array([[0, 1, 2]]))[0]
    sides = [corners[k] + (corners[(k + 1) % 3] - corners[k]) * (np.arange(1, 4 + k) / (4 + k))[:, None] for k in range(3)]
    points, faces = delaunay.triangulate(corners, sides, area / 40)
    areas = delaunay._areas(points, faces)
    assert areas.min() > 0 and areas.sum() == pytest.approx(area) and areas.max() <= area / 40 * (1 + 1e-6)
    for f in faces:
        for p in set(range(len(points))) - set(f.tolist()):
            assert delaunay.in_circle(points, f[None, :], points[p])[0] <= 1e-9 * area**2
    inner = len(points) - 3 - sum(map(len, sides))
    assert len(faces) == 2 * inner + (3 + sum(map(len, sides))) - 2  # as Euler has it for a triangulated polygon


def test_neighbours_agree(spark):
    """A bent mesh of faces of very different sizes: every edge is in two faces, but those of the border."""
    rng = np.random.default_rng(3)
    at = {(i, j): (i**1.7, j**1.4, float(rng.random())) for i, j in itertools.product(range(4), repeat=2)}
    faces = []
    for i, j in itertools.product(range(3), repeat=2):
        a, b, c, d = (at[i, j], at[i + 1, j], at[i + 1, j + 1], at[i, j + 1])
        faces += [(*a, *b, *c), (*a, *c, *d)]
    frame = spark.createDataFrame([(k, *f) for k, f in enumerate(faces)], SCHEMA).repartition(3)
    out = delaunay.refine(frame, 0.2).toPandas()
    edges, border = {}, 0
    for row in out[delaunay.CORNERS].to_numpy().reshape(-1, 3, 3):
        corners = [tuple(p) for p in row]
        for k in range(3):
            edges.setdefault(frozenset((corners[k], corners[(k + 1) % 3])), []).append(1)
    rim = {p for (i, j), p in at.items() if i in (0, 3) or j in (0, 3)}
    once = [e for e, n in edges.items() if len(n) == 1]
    assert all(len(n) <= 2 for n in edges.values())
    # edges in one face alone make up the border and nothing else
    length = sum(math.dist(*e) for e in once)
    walk = [at[k, 0] for k in range(4)] + [at[3, k] for k in range(1, 4)] + [at[k, 3] for k in (2, 1, 0)] + [at[0, k] for k in (2, 1, 0)]
    assert length == pytest.approx(sum(math.dist(p, q) for p, q in itertools.pairwise(walk))) and len(rim) == 12
    areas = mesh.face_area(spark.createDataFrame(out.assign(fid=range(len(out))))).toPandas()["area"]
    assert areas.max() <= 0.2 * (1 + 1e-6) and len(out) > len(faces)
    total = mesh.face_area(frame).toPandas()["area"].sum()
    assert areas.sum() == pytest.approx(total)


def test_odd_faces(spark):
    """Small faces, faces without area and faces with missing coordinates stay whole; an empty table gives no rows."""
    rows = [(1, *[0.0] * 9), (2, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0), (3, None, *[1.0] * 8), (4, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 0.1, 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = delaunay.refine(frame, 0.25).toPandas()
    assert sorted(out["father_id"]) == [1, 2, 3, 4] and out[["e1", "e2", "e3"]].all().all()
    assert tuple(out[out["father_id"] == 4][delaunay.CORNERS].iloc[0]) == rows[3][1:]
    assert delaunay.refine(frame.limit(0), 0.25).count() == 0
    with pytest.raises(ValueError):
        delaunay.refine(frame, 0.0)
