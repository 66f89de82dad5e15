"""Triangle meshes as tables: vertices(vid, x, y, z) and triangles(fid, v1, v2, v3), ids from 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from .lineage import cut
from .relational import renumber


def corners(triangles: DataFrame) -> DataFrame:
    """(fid, k, vid) for k = 0, 1, 2."""
    return triangles.select("fid", F.posexplode(F.array("v1", "v2", "v3")).alias("k", "vid"))


def gather(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with their corners' coordinates ax..cz: one join of the corner table, then one row per face again."""
    met = corners(triangles).join(vertices.select("vid", "x", "y", "z"), "vid")
    at = lambda k, name: F.max(F.when(F.col("k") == k, F.col(name)))
    columns = [at(k, axis).alias(p + axis) for k, p in enumerate("abc") for axis in "xyz"]
    return met.groupBy("fid").agg(*[at(k, "vid").alias(f"v{k + 1}") for k in range(3)], *columns)


def _abc() -> tuple[V.Vec, V.Vec, V.Vec]:
    return V.vec("a"), V.vec("b"), V.vec("c")


def face_area(faces: DataFrame) -> DataFrame:
    return faces.select("fid", V.tri_area(*_abc()).alias("area"))


def face_normal(faces: DataFrame) -> DataFrame:
    n = V.tri_normal(*_abc())
    return faces.select("fid", *[c.alias(a) for c, a in zip(n, ("nx", "ny", "nz"), strict=True)])


def face_centroid(faces: DataFrame) -> DataFrame:
    return faces.select("fid", *[((F.col("a" + d) + F.col("b" + d) + F.col("c" + d)) / 3).alias("c" + d) for d in "xyz"])


def mesh_area(faces: DataFrame) -> DataFrame:
    return faces.agg(F.sum(V.tri_area(*_abc())).alias("area"), F.count("*").alias("n_faces"))


def bounds(vertices: DataFrame) -> DataFrame:
    cells = [f(d).alias(f"{n}_{d}") for d in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return vertices.agg(*cells).select("*", *[((F.col(f"min_{d}") + F.col(f"max_{d}")) / 2).alias(f"mid_{d}") for d in "xyz"])


def half_edges(triangles: DataFrame) -> DataFrame:
    """(fid, k, i, j, opp): the directed edges of every face and the corner opposite."""
    edge = lambda k, i, j, o: F.struct(F.lit(k).alias("k"), F.col(i).alias("i"), F.col(j).alias("j"), F.col(o).alias("opp"))
    return triangles.select("fid", F.explode(F.array(edge(0, "v1", "v2", "v3"), edge(1, "v2", "v3", "v1"), edge(2, "v3", "v1", "v2"))).alias("h")).select("fid", "h.*")


def edges(triangles: DataFrame) -> DataFrame:
    """(i, j, n_faces) with i < j; 1 face at the boundary, 2 inside."""
    return half_edges(triangles).groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.count("*").alias("n_faces"))


def edge_triangles(triangles: DataFrame) -> DataFrame:
    """(i, j, fid, other): each directed edge's face and the face across, null at the boundary."""
    h = half_edges(triangles)
    other = h.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("fid").alias("other"))
    return h.select("i", "j", "fid").join(other, ["i", "j"], "left")


def both_ways(edge_table: DataFrame) -> DataFrame:
    return edge_table.select("i", "j", "n_faces").unionByName(edge_table.select(F.col("j").alias("i"), F.col("i").alias("j"), "n_faces"))


def boundary_edges(triangles: DataFrame) -> DataFrame:
    return edges(triangles).where("n_faces = 1").select("i", "j")


def boundary_vertices(triangles: DataFrame) -> DataFrame:
    return boundary_edges(triangles).select(F.explode(F.array("i", "j")).alias("vid")).distinct()


def boundary_faces(triangles: DataFrame) -> DataFrame:
    """(fid, is_boundary): whether any corner lies on the boundary."""
    marked = boundary_vertices(triangles).withColumn("b", F.lit(True))
    return corners(triangles).join(marked, "vid", "left").groupBy("fid").agg(F.bool_or(F.coalesce("b", F.lit(False))).alias("is_boundary"))


def valence(triangles: DataFrame) -> DataFrame:
    return both_ways(edges(triangles)).groupBy(F.col("i").alias("vid")).agg(F.count("*").alias("valence"))


def edge_lengths(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(i, j, n_faces, d) with i < j."""
    a = vertices.select(F.col("vid").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = vertices.select(F.col("vid").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    return edges(triangles).join(a, "i").join(b, "j").select("i", "j", "n_faces", V.mag(V.sub(V.vec("a"), V.vec("b"))).alias("d"))


def edge_stats(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean, least and largest edge length; mean_by_face counts inner edges twice."""
    return edge_lengths(triangles, vertices).agg(F.avg("d").alias("mean"), (F.sum(F.col("d") * F.col("n_faces")) / F.sum("n_faces")).alias("mean_by_face"), F.min("d").alias("least"), F.max("d").alias("largest"))


def vertex_normals(faces: DataFrame, weight: str = "area") -> DataFrame:
    """Mean of the normals of the faces around a vertex, normalised; weight is area or uniform."""
    n = V.tri_normal(*_abc())
    w = V.tri_area(*_abc()) if weight == "area" else F.lit(1.0)
    flat = faces.select(F.explode(F.array("v1", "v2", "v3")).alias("vid"), *[(c * w).alias(a) for c, a in zip(n, ("nx", "ny", "nz"), strict=True)])
    total = flat.groupBy("vid").agg(*[F.sum(a).alias(a) for a in ("nx", "ny", "nz")])
    unit = V.normalize(V.vec("n"))
    return total.select("vid", *[c.alias(a) for c, a in zip(unit, ("nx", "ny", "nz"), strict=True)])


def _by_corner(faces: DataFrame, *extra: Column) -> DataFrame:
    """(fid, vid, px.., qx.., rx.., obtuse): each corner p with the other two in order."""
    turn = lambda p, q, r, v: F.struct(F.col(v).alias("vid"), *[F.col(s + d).alias(n + d) for n, s in (("p", p), ("q", q), ("r", r)) for d in "xyz"])
    spread = F.explode(F.array(turn("a", "b", "c", "v1"), turn("b", "c", "a", "v2"), turn("c", "a", "b", "v3"))).alias("s")
    return faces.select("fid", V.tri_obtuse(*_abc()).alias("obtuse"), *extra, spread).select("fid", "obtuse", *[c for c in ("area",) if extra], "s.*")


def vertex_area(faces: DataFrame, mode: str = "mixed") -> DataFrame:
    """(vid, area): uniform (1), onering (sum of the faces around), voronoi or mixed (Voronoi unless the face is obtuse)."""
    by = _by_corner(faces, V.tri_area(*_abc()).alias("area"))
    p, q, r = V.vec("p"), V.vec("q"), V.vec("r")
    voronoi = (V.mag2(V.sub(p, r)) * V.cot(V.sub(p, q), V.sub(r, q)) + V.mag2(V.sub(p, q)) * V.cot(V.sub(p, r), V.sub(q, r))) / 8
    mixed = F.when(F.col("obtuse"), F.when(V.dot(V.sub(q, p), V.sub(r, p)) < 0, F.col("area") / 2).otherwise(F.col("area") / 4)).otherwise(voronoi)
    if mode == "uniform":
        return by.select("vid", F.lit(1.0).alias("area")).distinct()
    value = {"onering": F.col("area"), "voronoi": voronoi, "mixed": mixed}[mode]
    return by.groupBy("vid").agg(F.sum(value).alias("area"))


def select_vertices(vertices: DataFrame, inside: Column) -> DataFrame:
    """Vertices where the implicit function ``inside`` is negative."""
    return vertices.where(inside < 0)


def select_faces(triangles: DataFrame, vertices: DataFrame, inside: Column) -> DataFrame:
    """Faces all of whose corners lie where ``inside`` is negative."""
    marked = vertices.select("vid", (inside < 0).alias("ok"))
    kept = corners(triangles).join(marked, "vid").groupBy("fid").agg(F.bool_and("ok").alias("ok")).where("ok")
    return triangles.join(kept.select("fid"), "fid", "left_semi")


def submesh(triangles: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(map (vid, new_vid), triangles re-indexed densely): the faces of ``faces`` (fid) and the vertices they use."""
    kept = triangles.join(faces.select("fid").distinct(), "fid", "left_semi")
    used = corners(kept).select("vid").distinct()
    new = renumber(used, ["vid"], "new_vid", start=0)
    met = corners(kept).join(new, "vid").groupBy("fid").agg(*[F.max(F.when(F.col("k") == k, F.col("new_vid"))).alias(f"v{k + 1}") for k in range(3)])
    dense = renumber(met, ["fid"], "_dense", start=0).select(F.col("_dense").alias("fid"), "v1", "v2", "v3")
    return new, dense


def orient_ccw(faces: DataFrame) -> DataFrame:
    """Faces with v2 and v3 swapped where they run clockwise in the xy plane."""
    turned = V.tri_area_signed(V.vec("a", "xy"), V.vec("b", "xy"), V.vec("c", "xy")) < 0
    return faces.select("fid", "v1", F.when(turned, F.col("v3")).otherwise(F.col("v2")).alias("v2"), F.when(turned, F.col("v2")).otherwise(F.col("v3")).alias("v3"))


def clip_ears(triangles: DataFrame, passes: int = 10) -> DataFrame:
    """Remove faces with two or more boundary edges, again and again, at most ``passes`` times."""
    now = triangles
    for _ in range(passes):
        rim = boundary_edges(now)
        ears = half_edges(now).select("fid", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(rim, ["i", "j"], "left_semi").groupBy("fid").count().where("count > 1")
        if ears.isEmpty():
            break
        now = cut(now.join(ears.select("fid"), "fid", "left_anti"))
    return now


def laplacian(neighbours: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, lx, ly, lz): weighted mean of the neighbours minus the vertex; ``neighbours`` is (i, j, w)."""
    met = neighbours.join(vertices.select(F.col("vid").alias("j"), "x", "y", "z"), "j")
    mean = met.groupBy("i").agg(*[(F.sum(F.col("w") * F.col(d)) / F.sum("w")).alias("m" + d) for d in "xyz"])
    return mean.join(vertices, mean.i == vertices.vid).select("vid", *[(F.col("m" + d) - F.col(d)).alias("l" + d) for d in "xyz"])


def uniform_neighbours(triangles: DataFrame) -> DataFrame:
    return both_ways(edges(triangles)).select("i", "j", F.lit(1.0).alias("w"))


def one_ring(triangles: DataFrame) -> DataFrame:
    """(vid, ring): the neighbours of every vertex in the order of its faces, beginning at the boundary or the least id.

    Each face around a vertex leads from one neighbour to the next; the walk along these is bounded by the valence.
    """
    steps = half_edges(triangles).select(F.col("opp").alias("vid"), F.col("i").alias("f"), F.col("j").alias("t"))
    held = steps.groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("f", "t"))).alias("next"))
    starts = F.array_except(F.map_keys("next"), F.map_values("next"))
    held = held.withColumn("first", F.when(F.size(starts) > 0, F.array_min(starts)).otherwise(F.array_min(F.map_keys("next"))))
    step = lambda ring, _: F.when(F.coalesce(F.try_element_at("next", F.element_at(ring, -1)), F.element_at(ring, 1)) == F.element_at(ring, 1), ring).otherwise(F.concat(ring, F.array(F.try_element_at("next", F.element_at(ring, -1)))))
    walk = F.aggregate(F.sequence(F.lit(1), F.size("next") + 1), F.array("first"), step)
    return held.select("vid", walk.alias("ring"))


def boundary_loops(triangles: DataFrame) -> DataFrame:
    """(loop, pos, vid): the boundary edges walked against their faces; a loop is named by its least vertex.

    Where several boundary edges leave a vertex, the one to the least id is followed.

    Loops are found by pointer doubling: after k steps every vertex knows the one 2**k further on and the least on the
    way, so the number of joins grows with the logarithm of the longest loop.
    """
    h = half_edges(triangles)
    other = h.select(F.col("j").alias("i"), F.col("i").alias("j"))
    step = cut(h.join(other, ["i", "j"], "left_anti").groupBy(F.col("j").alias("vid")).agg(F.min("i").alias("next")))
    n = step.count()
    now = step.select("vid", "next", F.least("vid", "next").alias("loop"))
    for _ in range(max(1, math.ceil(math.log2(n + 1)))):
        far = now.select(F.col("vid").alias("next"), F.col("next").alias("next2"), F.col("loop").alias("loop2"))
        now = cut(now.join(far, "next").select("vid", F.col("next2").alias("next"), F.least("loop", "loop2").alias("loop")))
    named = step.join(now.select("vid", "loop"), "vid")
    # distance to the loop's least vertex, by doubling again; the least vertex points at itself
    reach = named.select("vid", "loop", F.when(F.col("vid") == F.col("loop"), F.col("vid")).otherwise(F.col("next")).alias("next"), F.when(F.col("vid") == F.col("loop"), 0).otherwise(1).cast("long").alias("d"))
    for _ in range(max(1, math.ceil(math.log2(n + 1)))):
        far = reach.select(F.col("vid").alias("next"), F.col("next").alias("next2"), F.col("d").alias("d2"))
        reach = cut(reach.join(far, "next").select("vid", "loop", F.col("next2").alias("next"), (F.col("d") + F.col("d2")).alias("d")))
    size = F.count("*").over(Window.partitionBy("loop"))
    return reach.select("loop", F.when(F.col("d") == 0, F.lit(0)).otherwise(size - F.col("d")).cast("long").alias("pos"), "vid")
