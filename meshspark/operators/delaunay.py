"""Refinement of faces that conforms: edges are cut by their length alone, faces by Delaunay triangulation in their plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORNERS = [n + d for n in "abc" for d in "xyz"]
#: In-circle determinants of points scaled to a face of area one, below which a point counts as on the circle.
ON_CIRCLE = 1e-12
#: Faces whose children a worker hands over at a time.
FACES = 256


def edge_points(p: np.ndarray, q: np.ndarray, longest: float) -> np.ndarray:
    """The points that cut p q into equal pieces of at most ``longest``, from p on; the same doubles from either end."""
    swapped = tuple(p) > tuple(q)
    low, high = (q, p) if swapped else (p, q)
    n = max(1, int(np.ceil(np.linalg.norm(high - low) / longest)))
    points = low + (high - low) * (np.arange(1, n) / n)[:, None]
    return points[::-1] if swapped else points


def _areas(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    a, b, c = (points[faces[:, k]] for k in range(3))
    return ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2


def in_circle(points: np.ndarray, faces: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For counter-clockwise faces: above 0 where ``p`` lies in the circle through the corners."""
    a, b, c = (points[faces[:, k]] - p for k in range(3))
    square = lambda v: (v * v).sum(axis=1)
    cross = lambda v, w: v[:, 0] * w[:, 1] - v[:, 1] * w[:, 0]
    return square(a) * cross(b, c) + square(b) * cross(c, a) + square(c) * cross(a, b)


def _insert(points: np.ndarray, faces: np.ndarray, new: int, on: tuple[int, int] | None) -> np.ndarray:
    """The faces once point ``new`` is in: those whose circle holds it give way to a fan about it.

    ``on`` is the outer edge on which the point lies, which the fan leaves out.
    """
    p = points[new]
    if on is None:
        sides = [_areas(points, np.column_stack([faces[:, k], faces[:, (k + 1) % 3], np.full(len(faces), new)])) for k in range(3)]
        seed = int(np.argmax(np.min(sides, axis=0)))
    else:
        seed = next(k for k, f in enumerate(faces.tolist()) if on in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])))
    held = {seed, *np.flatnonzero(in_circle(points, faces, p) > ON_CIRCLE).tolist()}
    while True:
        owner = {(int(faces[f][k]), int(faces[f][(k + 1) % 3])): f for f in held for k in range(3)}
        reached, open_ = {seed}, [seed]
        while open_:
            f = open_.pop()
            for k in range(3):
                other = owner.get((int(faces[f][(k + 1) % 3]), int(faces[f][k])))
                if other is not None and other not in reached:
                    reached.add(other)
                    open_.append(other)
        rim = [(e, f) for e, f in owner.items() if f in reached and e != on and owner.get(e[::-1]) not in reached]
        fan = np.array([(*e, new) for e, _ in rim])
        # rounding may hold a face that the point does not see; without it the fan turns one way
        wrong = {f for (_, f), area in zip(rim, _areas(points, fan), strict=True) if area <= 0} - {seed}
        if not wrong:
            break
        held = reached - wrong
    return np.vstack([np.delete(faces, sorted(reached), axis=0), fan])


def triangulate(corners: np.ndarray, sides: list[np.ndarray], most_area: float) -> tuple[np.ndarray, np.ndarray]:
    """(points, faces) of a counter-clockwise triangle in the plane, Delaunay, none above ``most_area``.

    Points are the corners, then those of the three sides in order, then inner ones: the centroid of the largest face
    goes in until none is too large.
    """
    scale = np.sqrt(_areas(corners, np.array([[0, 1, 2]]))[0])
    points, faces = np.vstack([corners, *sides]) / scale, np.array([[0, 1, 2]])
    most, new = most_area / scale**2, 3
    for k, side in enumerate(sides):
        before = k
        for _ in range(len(side)):
            faces = _insert(points, faces, new, (before, (k + 1) % 3))
            before, new = new, new + 1
    while (areas := _areas(points, faces)).max() > most * (1 + 1e-9):
        points = np.vstack([points, points[faces[int(np.argmax(areas))]].mean(axis=0)])
        faces = _insert(points, faces, len(points) - 1, None)
    return points * scale, faces


def _cut(corners: np.ndarray, most_area: float, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(n, 9) corners of the children of one face in space, and (n, 3) whether they have a side on each of its sides."""
    a, b, c = corners
    u, normal = b - a, np.cross(b - a, c - a)
    area = np.linalg.norm(normal) / 2
    if not np.isfinite(area) or area <= 1e-14 * max(1e-300, np.max(np.abs(corners - a)) ** 2):
        return corners.reshape(1, 9), np.ones((1, 3), dtype=bool)
    u = u / np.linalg.norm(u)
    v = np.cross(normal / (2 * area), u)
    sides = [edge_points(corners[k], corners[(k + 1) % 3], longest) for k in range(3)]
    flat = lambda x: np.column_stack([(x - a) @ u, (x - a) @ v])
    points, faces = triangulate(flat(corners), [flat(x) for x in sides], most_area)
    outer = np.vstack([corners, *sides])  # as they were, so that neighbours' are equal
    space = np.vstack([outer, a + points[len(outer) :] @ np.vstack([u, v])])
    on = np.zeros((len(space), 3), dtype=bool)
    on[[0, 0, 1, 1, 2, 2], [0, 2, 0, 1, 1, 2]] = True
    on[np.arange(3, len(outer)), np.repeat(np.arange(3), [len(x) for x in sides])] = True
    return space[faces].reshape(len(faces), 9), on[faces].sum(axis=1) >= 2


def refine(faces: DataFrame, most_area: float) -> DataFrame:
    """Gathered faces (fid, ax .. cz) cut into Delaunay faces of at most ``most_area``, without hanging vertices.

    (father_id, k, ax .. cz, e1, e2, e3) as ``metrics.refine`` has them: k numbers the children of a father, e1 to e3 tell
    whether a child has a side on the father's first, second or third. An edge is cut into equal pieces no longer than
    the side of an equilateral face of ``most_area``, so both faces at it cut it at the same doubles, however they differ
    otherwise; ``relational.weld`` joins them. Rows are cut each where it lies, without a shuffle; the time of one face
    grows with the square of its children. Faces without area, or with null or non-finite coordinates, stay whole.
    """
    if not most_area > 0:
        raise ValueError("most_area must be above 0")
    longest = 2 * np.sqrt(most_area / np.sqrt(3))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fids, corners = batch["fid"].to_numpy(), batch[CORNERS].to_numpy(dtype=float).reshape(-1, 3, 3)
            for low in range(0, len(batch), FACES):
                cuts = [_cut(c, most_area, longest) for c in corners[low : low + FACES]]
                sizes = [len(cut) for cut, _ in cuts]
                out = pd.DataFrame(np.vstack([cut for cut, _ in cuts]), columns=CORNERS)
                out.insert(0, "father_id", np.repeat(fids[low : low + FACES], sizes))
                out.insert(1, "k", np.concatenate([np.arange(n) for n in sizes]))
                on = np.vstack([on for _, on in cuts])
                yield out.assign(**{f"e{m + 1}": on[:, m] for m in range(3)})

    columns = ", ".join(f"{c} double" for c in CORNERS)
    kind = faces.schema["fid"].dataType.simpleString()
    return faces.select("fid", *[F.col(c).cast("double") for c in CORNERS]).mapInPandas(run, f"father_id {kind}, k long, {columns}, e1 boolean, e2 boolean, e3 boolean")
