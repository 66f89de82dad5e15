"""Sparse operators over a mesh as rows (i, j, w): finite elements, weights, Laplacians, distortion, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from . import mesh
from .spatial import neighbour_weights, normalise_rows


def turns(faces: DataFrame) -> DataFrame:
    """(fid, area, i, j, o, p.., q.., r.., dp, cp): each corner i with the others in order; dp and cp are the dot product
    and the size of the cross product of its two edges, so its cotangent is dp / cp."""
    ids = {"a": "v1", "b": "v2", "c": "v3"}
    turn = lambda p, q, r: F.struct(F.col(ids[p]).alias("i"), F.col(ids[q]).alias("j"), F.col(ids[r]).alias("o"), *[F.col(s + d).alias(n + d) for n, s in (("p", p), ("q", q), ("r", r)) for d in "xyz"])
    flat = faces.select("fid", V.tri_area(V.vec("a"), V.vec("b"), V.vec("c")).alias("area"), F.explode(F.array(turn("a", "b", "c"), turn("b", "c", "a"), turn("c", "a", "b"))).alias("s")).select("fid", "area", "s.*")
    u, v = V.sub(V.vec("q"), V.vec("p")), V.sub(V.vec("r"), V.vec("p"))
    return flat.select("*", V.dot(u, v).alias("dp"), (2 * F.col("area")).alias("cp"))


def assemble(rows: DataFrame) -> DataFrame:
    """Sum duplicates of (i, j, w)."""
    return rows.groupBy("i", "j").agg(F.sum("w").alias("w"))


def _entries(*entries: tuple[str, str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), w.alias("w")) for i, j, w in entries]))


def stiffness(faces: DataFrame) -> DataFrame:
    """Linear finite elements: integrals of products of gradients; rows sum to 0."""
    half = F.col("dp") / F.col("cp") / 2
    t = turns(faces).select("j", "o", half.alias("h"))
    return assemble(t.select(_entries(("j", "o", -F.col("h")), ("o", "j", -F.col("h")), ("j", "j", F.col("h")), ("o", "o", F.col("h"))).alias("e")).select("e.*"))


def mass(faces: DataFrame) -> DataFrame:
    """Linear finite elements: integrals of products; all entries together sum to the area."""
    t = turns(faces)
    return assemble(t.select(_entries(("i", "i", F.col("area") / 6), ("i", "j", F.col("area") / 12), ("j", "i", F.col("area") / 12)).alias("e")).select("e.*"))


def dirichlet(operator: DataFrame, triangles: DataFrame) -> DataFrame:
    """The operator without rows and columns of boundary vertices."""
    rim = mesh.boundary_vertices(triangles)
    return operator.join(rim.select(F.col("vid").alias("i")), "i", "left_anti").join(rim.select(F.col("vid").alias("j")), "j", "left_anti").select("i", "j", "w")


def cotan_weights(faces: DataFrame, authalic: bool = False, area_weighted: bool = False) -> DataFrame:
    """(i, j, w): the sum over the faces of an edge of the cotangent opposite (over the face's area), or authalic ones:
    of the cotangent at j over the squared length."""
    cot = F.col("dp") / F.col("cp")
    t = turns(faces)
    if authalic:
        p, q, r = V.vec("p"), V.vec("q"), V.vec("r")
        pairs = (("j", "i", cot / V.mag2(V.sub(q, p))), ("o", "i", cot / V.mag2(V.sub(r, p))))
    else:
        w = cot / F.col("area") if area_weighted else cot
        pairs = (("j", "o", w), ("o", "j", w))
    return assemble(t.select(_entries(*pairs).alias("e")).select("e.*"))


def mean_value_weights(faces: DataFrame) -> DataFrame:
    """(i, j, w): tangents of half the angles at i beside the edge, over its squared length."""
    u, v = V.sub(V.vec("q"), V.vec("p")), V.sub(V.vec("r"), V.vec("p"))
    half = F.col("cp") / (V.mag(u) * V.mag(v) + F.col("dp"))
    return assemble(turns(faces).select(_entries(("i", "j", half / V.mag2(u)), ("i", "o", half / V.mag2(v))).alias("e")).select("e.*"))


def one_ring_weights(faces: DataFrame, triangles: DataFrame, vertices: DataFrame, mode: str, area: str | None = None, normalise: bool = False) -> DataFrame:
    """(i, j, w) to the neighbours: uniform, invdist, invdist2, gaussian exp(-d2 / 4 * t) with t the mean edge length,
    cotan, authalic or meanvalue; divided by the vertex area of kind ``area``; with ``normalise`` rows sum to 1."""
    if mode in ("cotan", "dcp"):
        w = cotan_weights(faces)
    elif mode in ("authalic", "dap"):
        w = cotan_weights(faces, authalic=True)
    elif mode == "meanvalue":
        w = mean_value_weights(faces)
    else:
        once = mesh.edge_lengths(triangles, vertices)
        pairs = once.select("i", "j", "d").unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
        if mode == "gaussian":
            t = once.agg(F.avg("d").alias("_t"))
            w = pairs.join(t).select("i", "j", F.exp(-F.col("d") * F.col("d") / 4 * F.col("_t")).alias("w"))
        else:
            w = neighbour_weights(pairs, mode, normalise=False)
    if area is not None:
        w = w.join(mesh.vertex_area(faces, area).withColumnRenamed("vid", "i"), "i").select("i", "j", (F.col("w") / F.col("area")).alias("w"))
    return normalise_rows(w) if normalise else w


def mean_curvature(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, h): the size of the curvature normal, the cotangent-weighted sum of edges over twice the mixed area."""
    w = cotan_weights(faces)
    a = vertices.select(F.col("vid").alias("i"), *[F.col(d).alias("a" + d) for d in "xyz"])
    b = vertices.select(F.col("vid").alias("j"), *[F.col(d).alias("b" + d) for d in "xyz"])
    sums = w.join(a, "i").join(b, "j").groupBy("i").agg(*[F.sum(F.col("w") * (F.col("a" + d) - F.col("b" + d))).alias("k" + d) for d in "xyz"])
    area = mesh.vertex_area(faces, "mixed")
    return sums.join(area, sums.i == area.vid).select("vid", (V.mag(V.vec("k")) / (2 * F.col("area"))).alias("h"))


def quadratic_form(operator: DataFrame, u: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(value): sum of u_i w_ij v_j for tables (vid, u)."""
    left, right = u.select(F.col("vid").alias("i"), F.col("u").alias("_a")), (v or u).select(F.col("vid").alias("j"), F.col("u").alias("_b"))
    return operator.join(left, "i").join(right, "j").agg(F.sum(F.col("_a") * F.col("w") * F.col("_b")).alias("value"))


def apply(operator: DataFrame, u: DataFrame) -> DataFrame:
    """(vid, u): the operator times a vector."""
    return operator.join(u.select(F.col("vid").alias("j"), "u"), "j").groupBy(F.col("i").alias("vid")).agg(F.sum(F.col("w") * F.col("u")).alias("u"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two operators."""
    met = a.select("i", F.col("j").alias("_k"), F.col("w").alias("_a")).join(b.select(F.col("i").alias("_k"), "j", F.col("w").alias("_b")), "_k")
    return met.groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("w"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def is_symmetric(operator: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(gap, symmetric): the sum of |w_ij - w_ji|."""
    back = transpose(operator).withColumnRenamed("w", "_w")
    met = operator.join(back, ["i", "j"], "full")
    gap = F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_w", F.lit(0.0))))
    return met.agg(gap.alias("gap")).select("gap", (F.col("gap") < tolerance).alias("symmetric"))


def soft_constraints(operator: DataFrame, rhs: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """constraints(vid, value, weight): weight squared on the diagonal, and times the value on the right side (vid, u)."""
    square = F.col("weight") * F.col("weight")
    more = constraints.select(F.col("vid").alias("i"), F.col("vid").alias("j"), square.alias("w"))
    right = rhs.select("vid", "u").unionByName(constraints.select("vid", (square * F.col("value")).alias("u"))).groupBy("vid").agg(F.sum("u").alias("u"))
    return assemble(operator.select("i", "j", "w").unionByName(more)), right


def hard_constraints(operator: DataFrame, rhs: DataFrame, constraints: DataFrame, eliminate: bool = False) -> tuple[DataFrame, DataFrame]:
    """constraints(vid, value): their rows become identity rows; with ``eliminate`` they leave rows and columns and move
    to the right side."""
    held = constraints.select(F.col("vid").alias("i"))
    free = operator.join(held, "i", "left_anti").select("i", "j", "w")
    if not eliminate:
        ones = constraints.select(F.col("vid").alias("i"), F.col("vid").alias("j"), F.lit(1.0).alias("w"))
        right = rhs.join(constraints.select("vid"), "vid", "left_anti").select("vid", "u").unionByName(constraints.select("vid", F.col("value").alias("u")))
        return free.unionByName(ones), right
    known = constraints.select(F.col("vid").alias("j"), "value")
    moved = free.join(known, "j").groupBy(F.col("i").alias("vid")).agg(F.sum(F.col("w") * F.col("value")).alias("_m"))
    right = rhs.join(constraints.select("vid"), "vid", "left_anti").join(moved, "vid", "left").select("vid", (F.col("u") - F.coalesce("_m", F.lit(0.0))).alias("u"))
    return free.join(known.select("j"), "j", "left_anti").select("i", "j", "w"), right


def with_uv(faces: DataFrame, uv: DataFrame) -> DataFrame:
    """Faces with the plane coordinates of their corners su, sv, tu, tv, wu, wv from uv(vid, u, v)."""
    out = faces
    for corner, name in (("v1", "s"), ("v2", "t"), ("v3", "w")):
        out = out.join(uv.select(F.col("vid").alias(corner), F.col("u").alias(name + "u"), F.col("v").alias(name + "v")), corner)
    return out


def stretch(faces_uv: DataFrame) -> DataFrame:
    """(fid, area, area_uv, l2, linf, smin): the root mean square, largest and least singular value of the map from the plane."""
    c = F.col
    area_uv = ((c("tu") - c("su")) * (c("wv") - c("sv")) - (c("wu") - c("su")) * (c("tv") - c("sv"))) / 2
    by = faces_uv.select("*", area_uv.alias("area_uv"), V.tri_area(V.vec("a"), V.vec("b"), V.vec("c")).alias("area"))
    ss = [(c("a" + d) * (c("tv") - c("wv")) + c("b" + d) * (c("wv") - c("sv")) + c("c" + d) * (c("sv") - c("tv"))) / (2 * c("area_uv")) for d in "xyz"]
    st = [(c("a" + d) * (c("wu") - c("tu")) + c("b" + d) * (c("su") - c("wu")) + c("c" + d) * (c("tu") - c("su"))) / (2 * c("area_uv")) for d in "xyz"]
    held = by.select("fid", "area", "area_uv", *[x.alias("s" + d) for x, d in zip(ss, "xyz", strict=True)], *[x.alias("t" + d) for x, d in zip(st, "xyz", strict=True)])
    a, b, d = V.mag2(V.vec("s")), V.dot(V.vec("s"), V.vec("t")), V.mag2(V.vec("t"))
    held = held.select("fid", "area", "area_uv", a.alias("_a"), b.alias("_b"), d.alias("_c"))
    root = F.sqrt((c("_a") - c("_c")) * (c("_a") - c("_c")) + 4 * c("_b") * c("_b"))
    return held.select("fid", "area", "area_uv", F.sqrt(0.5 * (c("_a") + c("_c"))).alias("l2"), F.sqrt(0.5 * (c("_a") + c("_c") + root)).alias("linf"), F.sqrt(F.greatest(0.5 * (c("_a") + c("_c") - root), F.lit(0.0))).alias("smin"))


def face_distortion(faces_uv: DataFrame) -> DataFrame:
    """(fid, area, e_angle, e_area): cotangents of the surface angles times squared opposite plane edges over twice the plane
    area, and the sum of the area ratio and its inverse."""
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    s, t, w = ((F.col(n + "u"), F.col(n + "v")) for n in "stw")
    area_uv = V.tri_area_signed(s, t, w)
    top = V.cot(V.sub(b, a), V.sub(c, a)) * V.mag2(V.sub(t, w)) + V.cot(V.sub(a, b), V.sub(c, b)) * V.mag2(V.sub(s, w)) + V.cot(V.sub(a, c), V.sub(b, c)) * V.mag2(V.sub(s, t))
    held = faces_uv.select("fid", V.tri_area(a, b, c).alias("area"), area_uv.alias("_u"), top.alias("_n"))
    return held.select("fid", "area", (F.col("_n") / (2 * F.col("_u"))).alias("e_angle"), (F.col("area") / F.col("_u") + F.col("_u") / F.col("area")).alias("e_area"))


def mesh_distortion(faces_uv: DataFrame) -> DataFrame:
    """Area-weighted means of the face distortions and the L2 stretch, and the largest stretch."""
    d, s = face_distortion(faces_uv), stretch(faces_uv).drop("area")
    w = F.col("area")
    mean = lambda x: F.sum(F.col(x) * w) / F.sum(w)
    return d.join(s, "fid").agg(mean("e_angle").alias("e_angle"), mean("e_area").alias("e_area"), mean("l2").alias("l2"), F.max("linf").alias("linf"))
