"""Graph operators over edges(i, j, d): geodesic edges, shortest paths, components, smoothing, filling of gaps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from .lineage import cut, discard

SLACK = 1e-10


def membership(triangles: DataFrame, midpoints: DataFrame | None = None) -> DataFrame:
    """(father, vid): the vertices inside or on each coarse triangle; with midpoints(i, j, vid) those of its edges too."""
    own = triangles.select(F.col("fid").alias("father"), F.explode(F.array("v1", "v2", "v3")).alias("vid"))
    if midpoints is None:
        return own
    sides = triangles.select(F.col("fid").alias("father"), F.explode(F.array(*[F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")) for a, b in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])).alias("s")).select("father", "s.*")
    return own.unionByName(sides.join(midpoints, ["i", "j"]).select("father", "vid"))


def geodesic_edges(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """(i, j, d), i < j: vertices that lie in or on a common triangle, with their distance. One self-join."""
    pairs = members.select("father", F.col("vid").alias("i")).join(members.select("father", F.col("vid").alias("j")), "father").where("i < j").select("i", "j").distinct()
    a = vertices.select(F.col("vid").alias("i"), *[F.col(d).alias("a" + d) for d in "xyz"])
    b = vertices.select(F.col("vid").alias("j"), *[F.col(d).alias("b" + d) for d in "xyz"])
    return pairs.join(a, "i").join(b, "j").select("i", "j", V.mag(V.sub(V.vec("a"), V.vec("b"))).alias("d"))


def prune(edges: DataFrame, cutoff: float) -> DataFrame:
    """Undirected edges once (i <= j) below the cutoff, and a loop of weight 0 at every vertex."""
    once = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d").groupBy("i", "j").agg(F.min("d").alias("d"))
    kept = once.where(F.col("d") < cutoff + SLACK)
    loops = edges.select(F.explode(F.array("i", "j")).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("d"))
    return kept.unionByName(loops)


def symmetrise(directed: DataFrame, how: str = "min") -> DataFrame:
    """Both directions of every edge, with the least or largest of the two weights."""
    both = directed.select("i", "j", "d").unionByName(directed.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.groupBy("i", "j").agg((F.min if how == "min" else F.max)("d").alias("d"))


def shortest_paths(edges: DataFrame, sources: DataFrame, cutoff: float = float("inf"), most_rounds: int = 1000) -> DataFrame:
    """(source, vid, d, pred): least distances up to the cutoff from each of sources(vid), over edges both ways.

    Only vertices whose distance fell in the last round are extended; each round is checkpointed. pred is the neighbour on
    the path, the least id of equally near ones in the round that set the distance, null at the source.
    """
    arcs = cut(symmetrise(edges.where("i <> j")))
    best = cut(sources.select(F.col("vid").alias("source"), "vid", F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("pred")).distinct())
    front = best
    for _ in range(most_rounds):
        ahead = front.join(arcs, front.vid == arcs.i).select("source", F.col("j").alias("vid"), (front.d + arcs.d).alias("d"), F.col("i").alias("pred")).where(F.col("d") < cutoff + SLACK)
        found = ahead.groupBy("source", "vid").agg(F.min(F.struct("d", "pred")).alias("s")).select("source", "vid", "s.d", "s.pred")
        old = best.select("source", "vid", F.col("d").alias("_old"))
        front = cut(found.join(old, ["source", "vid"], "left").where(F.col("_old").isNull() | (F.col("d") < F.col("_old") - 1e-15)).drop("_old"))
        if front.isEmpty():
            return best
        best = cut(best.join(front.select("source", "vid"), ["source", "vid"], "left_anti").unionByName(front))
    raise RuntimeError(f"paths did not settle in {most_rounds} rounds")


#: Vertices of a part that one task settles in a round of ``distances``.
PART = 2000
#: Sources that a part is settled for at a time.
COLUMNS = 512


def parts_in_space(points: DataFrame, most: int | None = None) -> DataFrame:
    """(vid, part): points(vid, x, y, z) by boxes between quantiles of each axis, some ``most`` (PART by default) to a box
    where they lie evenly."""
    n = points.count()
    side = max(1, math.ceil((n / (most or PART)) ** (1 / 3)))
    cuts = points.select(*[F.percentile_approx(d, [k / side for k in range(1, side)]).alias(d) for d in "xyz"]).first() if side > 1 else None
    place = [sum((F.coalesce((F.col(d) > c).cast("long"), F.lit(0)) for c in cuts[d] or []), F.lit(0)) if cuts else F.lit(0) for d in "xyz"]
    return points.select("vid", ((place[0] * side + place[1]) * side + place[2]).cast("long").alias("part"))


def _settle(own: np.ndarray, arcs: pd.DataFrame, d: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Least distances d (a row for each of the sorted ids ``own``) after arcs (i, j, w), both ways, among them, where those
    ``before`` were settled: vertices whose neighbours' distances fell are taken up in turn, to and fro."""
    arcs = arcs.sort_values("j", kind="stable")
    i, j, w = np.searchsorted(own, arcs["i"]), np.searchsorted(own, arcs["j"]), arcs["w"].to_numpy()[:, None]
    if not len(j):
        return d
    ends = np.searchsorted(j, np.arange(len(own) + 1))
    near = [(i[a:b], w[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out = d.copy()
    for k in range(0, d.shape[1], COLUMNS):
        now = np.ascontiguousarray(out[:, k : k + COLUMNS])
        due, onward = np.zeros(len(own), dtype=bool), True
        due[j[(now < before[:, k : k + COLUMNS]).any(axis=1)[i]]] = True
        while due.any():
            for v in np.flatnonzero(due)[:: 1 if onward else -1]:
                due[v] = False
                of, far = near[v]
                least = now[of]
                least += far
                least = least.min(axis=0)
                if (least < now[v]).any():
                    np.minimum(now[v], least, out=now[v])
                    due[of] = True
            onward = not onward
        out[:, k : k + COLUMNS] = now
    return out


def distances(edges: DataFrame, sources: DataFrame, parts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(source, vid, d): as ``shortest_paths`` without a cutoff or the neighbour, for few sources and many vertices. Vertices
    without a part are left out."""
    ids = [r.vid for r in sources.select("vid").distinct().orderBy("vid").collect()]  # landmarks: few by definition
    if not ids:
        return parts.select(F.col("vid").alias("source"), "vid", F.lit(0.0).alias("d")).where("false")
    order = F.array(*[F.lit(v).cast("long") for v in ids])
    numbered = sources.select("vid").distinct().withColumn("k", F.array_position(order, F.col("vid")) - 1).withColumn("block", F.lit(0).cast("long"))
    flat = distance_rows(edges, numbered, len(ids), parts, most_rounds).select("vid", F.posexplode("d").alias("_k", "d")).where(F.col("d") < float("inf"))
    return flat.select(F.get(order, F.col("_k")).alias("source"), "vid", "d")


def distance_rows(edges: DataFrame, sources: DataFrame, m: int, parts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(block, part, vid, d): for each vertex and block of sources the array of its least distances from sources(vid, block,
    k), k from 0 to m - 1, infinite where there is no path or no source.

    A vertex holds its distances from a block's sources as one row, and parts(vid, part) of vertices are settled by one task each;
    then only what fell at vertices beside other parts is sent there. So rounds follow the number of parts on a path, not
    that of its edges.
    """
    arcs = symmetrise(edges.where("i <> j"))
    at = lambda v, p: parts.select(F.col("vid").alias(v), F.col("part").alias(p))
    blocks = cut(sources.select("block").distinct())
    arcs = cut(arcs.join(at("i", "part"), "i").join(at("j", "to"), "j").select("part", "i", "j", F.col("d").alias("w"), "to")).crossJoin(F.broadcast(blocks))
    first = parts.crossJoin(F.broadcast(blocks)).select("block", "part", "vid")
    own = sources.select("block", "vid", F.col("k").alias("_k")).join(parts, "vid")
    start = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.when(k == F.col("_k"), 0.0).otherwise(float("inf")))
    # a source stands as its own message, so that the first round takes it as news
    state = first.select("block", "part", "vid", F.array_repeat(F.lit(float("inf")), m).alias("d"), F.lit(False).alias("sent"))
    state = cut(state.unionByName(own.select("block", "part", "vid", start.alias("d"), F.lit(True).alias("sent"))))

    def f(key: tuple, held: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        mine, news = held[~held["sent"]].sort_values("vid"), held[held["sent"]]
        own = mine["vid"].to_numpy()
        before = np.stack(mine["d"].to_list()) if len(own) else np.zeros((0, m))
        out = [pd.DataFrame({"block": key[0], "part": key[1], "vid": own, "d": list(before), "sent": False})]
        if len(own) and len(news):
            d = before.copy()
            np.minimum.at(d, np.searchsorted(own, news["vid"]), np.stack(news["d"].to_list()))
            d = _settle(own, arcs[arcs["to"] == key[1]], d, before)
            out[0]["d"] = list(d)
            fell = (d < before).any(axis=1)
            away = arcs[(arcs["to"] != key[1]).to_numpy() & fell[np.searchsorted(own, arcs["i"])]].sort_values("j", kind="stable")
            if len(away):
                j = away["j"].to_numpy()
                starts = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
                row = np.searchsorted(own, away["i"])
                # distances that did not fall were sent before
                reach = np.minimum.reduceat(np.where(d[row] < before[row], d[row], np.inf) + away["w"].to_numpy()[:, None], starts)
                out.append(pd.DataFrame({"block": key[0], "part": away["to"].to_numpy()[starts], "vid": j[starts], "d": list(reach), "sent": True}))
        return pd.concat(out)

    for _ in range(most_rounds):
        last, state = state, cut(state.groupBy("block", "part").cogroup(arcs.groupBy("block", "part")).applyInPandas(f, "block long, part long, vid long, d array<double>, sent boolean"))
        discard(last)
        if state.where("sent").isEmpty():
            return state.select("block", "part", "vid", "d")
    raise RuntimeError(f"distances did not settle in {most_rounds} rounds")


def components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(vid, component): the least id reachable. Labels jump along labels, so rounds grow with the logarithm of a path."""
    arcs = cut(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    labels = cut(vertices.select("vid", F.col("vid").alias("component")))
    for _ in range(most_rounds):
        around = arcs.join(labels, arcs.j == labels.vid).groupBy(F.col("i").alias("vid")).agg(F.min("component").alias("_near"))
        near = labels.join(around, "vid", "left").select("vid", F.least("component", F.coalesce("_near", "component")).alias("component"))
        jump = near.select(F.col("vid").alias("component"), F.col("component").alias("_far"))
        fresh = cut(near.join(jump, "component").select("vid", F.least("component", "_far").alias("component")))
        changed = fresh.join(labels.withColumnRenamed("component", "_old"), "vid").where("component <> _old").isEmpty()
        labels = fresh
        if changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def largest_component(vertices: DataFrame, edges: DataFrame, n: int = 1) -> DataFrame:
    """Vertices of the n-th largest component, equal sizes by least id."""
    labelled = cut(components(vertices, edges))
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    first = sizes.orderBy(F.desc("size"), "component").limit(n)  # n rows, kept in every task while it reads
    wanted = first.orderBy("size", F.desc("component")).limit(1) if n > 1 else first
    wanted = wanted.join(first.agg(F.count("*").alias("_n"))).where(F.col("_n") == n)
    return labelled.join(F.broadcast(wanted.select("component")), "component", "left_semi").select("vid")


def geodesic_neighbourhood(paths: DataFrame, triangles: DataFrame, cutoff: float) -> DataFrame:
    """(fid, neigh): triangles that touch any vertex within the cutoff of any corner; ``paths`` as of shortest_paths."""
    corner = triangles.select("fid", F.explode(F.array("v1", "v2", "v3")).alias("vid"))
    reach = corner.join(paths.where(F.col("d") < cutoff + SLACK).select("source", F.col("vid").alias("to")), corner.vid == F.col("source")).select("fid", "to").distinct()
    touched = corner.select(F.col("fid").alias("neigh"), F.col("vid").alias("to"))
    return reach.join(touched, "to").select("fid", "neigh").distinct()


def smoothing_weights(paths: DataFrame, triangles: DataFrame, cutoff: float = 6.0, sd: float = 1.6) -> DataFrame:
    """(fid, neigh, w): the largest Gaussian weight over a neighbour's vertices of their least distance to a corner."""
    corner = triangles.select("fid", F.explode(F.array("v1", "v2", "v3")).alias("vid"))
    near = corner.join(paths.where(F.col("d") < cutoff + SLACK).select("source", F.col("vid").alias("to"), "d"), corner.vid == F.col("source")).groupBy("fid", "to").agg(F.min("d").alias("d"))
    touched = corner.select(F.col("fid").alias("neigh"), F.col("vid").alias("to"))
    return near.join(touched, "to").groupBy("fid", "neigh").agg(F.max(V.gaussian_ratio(F.col("d"), sd)).alias("w"))


def smooth(metric: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """metric(fid, area, dist) -> (fid, area, dist): weighted sum of areas, and of distances over areas.

    A missing distance is left out of the numerator only.
    """
    keys = by or []
    met = weights.join(metric.withColumnRenamed("fid", "neigh"), "neigh")
    aw = F.col("area") * F.col("w")
    out = met.groupBy(*keys, "fid").agg(F.sum(aw).alias("area"), F.sum(F.coalesce(F.col("dist") * aw, F.lit(0.0))).alias("_n"))
    return out.select(*keys, "fid", "area", F.when(F.col("area") != 0, F.col("_n") / F.col("area")).alias("dist"))


def fill_missing(values: DataFrame, weights: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(fid, dist) with nulls replaced by the weighted mean of known neighbours, round by round until none changes.

    A gap without any known neighbour stays null.
    """
    now = cut(values.select("fid", "dist"))
    for _ in range(most_rounds):
        gaps = now.where(F.col("dist").isNull()).select("fid")
        known = now.where(F.col("dist").isNotNull()).select(F.col("fid").alias("neigh"), F.col("dist").alias("_v"))
        filled = cut(gaps.join(weights, "fid").join(known, "neigh").groupBy("fid").agg((F.sum(F.col("_v") * F.col("w")) / F.sum("w")).alias("_fill")))
        if filled.isEmpty():
            break
        now = cut(now.join(filled, "fid", "left").select("fid", F.coalesce("dist", "_fill").alias("dist")))
    return now


def floyd_warshall(edges: DataFrame, vertices: DataFrame, cutoff: float = float("inf")) -> DataFrame:
    """All-pairs least distances: shortest paths from every vertex."""
    return shortest_paths(edges, vertices.select("vid"), cutoff)
