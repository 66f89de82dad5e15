"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a sample, split by halves at the median so that lists are balanced; their number grows with the table.
An in-memory graph over the centroids finds those near a vector. Every vector goes into the list of its nearest centroid,
and a boundary vector also into those of other centroids nearly as near, unless a chosen centroid is nearer to that
centroid than the vector is. A query visits the lists whose centroids are within a ratio of its nearest one's distance.
That ratio is the least at which some queries, searched by brute force first, find the share of their neighbours that was
asked for; a share of 1 visits all lists. Lists are dealt in blocks of bounded size on both sides, so a crowded list needs
no task of its own.

Before that, a query is compared with the vectors whose own list is among its nearest HOMES ones. The last of the k + 1
best there is a floor: lists give only candidates that reach it, so a query's rows do not grow with the lists it visits,
and nothing that could be among its nearest is left out.

Equal vectors are merged first; each keeps its smallest ids, one more than neighbours are asked for, which is all that
any query can need of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, store

#: Vectors of a list aimed at, but at most LISTS_PER_ROOT lists for each in the root of their number.
LIST, LISTS_PER_ROOT = 100, 4
#: Sample vectors a centroid is made from, and least of all: those of the smallest hashes of their ids. The driver holds
#: PER_CENTROID * LISTS_PER_ROOT times the root of the table's rows, 1.5 million vectors for a billion rows.
PER_CENTROID, LEAST_SAMPLE = 12, 2_000
DEGREE, ENTRIES = 20, 16
#: A vector is replicated to centroids within this ratio of its nearest one's distance, to so many lists at most.
CLOSURE, REPLICAS = 1.15, 6
#: Share of the true neighbours that the distance ratio is chosen for, and queries it is chosen by.
RECALL, CALIBRATION = 0.98, 256
#: Nearest lists whose own vectors, without replicas, give a query's floor.
HOMES = 4
CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Taken off a floor, for scores that differ by rounding.
SLACK = 1e-9
#: Distances below this count as this where they are divided by.
TINY = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def balanced_centroids(x: np.ndarray, leaf: int) -> np.ndarray:
    """Means of parts of at most ``leaf`` rows, made by halving along the line between two means."""
    if len(x) <= max(1, leaf):
        mean = x.mean(axis=0)
        return unit(mean if (mean * mean).sum() > 1e-12 else x[0])[None]
    axis = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))] - x.mean(axis=0)
    for _ in range(4):  # two means; the median keeps the halves equal
        side = x @ axis
        upper = np.zeros(len(x), dtype=bool)
        upper[np.argsort(side, kind="stable")[len(x) // 2 :]] = True
        axis = x[upper].mean(axis=0) - x[~upper].mean(axis=0)
    return np.concatenate([balanced_centroids(x[~upper], leaf), balanced_centroids(x[upper], leaf)])


@dataclass
class CentroidGraph:
    """Centroids with links to near ones, searched best first from a few fixed entries."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        n = len(centroids)
        links = np.empty((n, min(DEGREE, n)), dtype=np.int32)
        spread = np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int32)
        for at in range(0, n, 1024):
            near = np.argsort(-(centroids[at : at + 1024] @ centroids.T), axis=1, kind="stable")
            links[at : at + 1024] = near[:, : links.shape[1]]
        if n > DEGREE:  # the last link leads along a ring through all centroids, so each can be reached
            links[:, -1] = (np.arange(n) + 1) % n
        return cls(centroids, links, spread)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the nearest found for each unit row, nearest first; -1 and inf where fewer."""
        n, rows = len(self.centroids), len(x)
        beam = min(beam, n)
        seen = np.zeros((rows, n), dtype=bool)
        ids = np.full((rows, beam + 2 * self.links.shape[1]), -1, dtype=np.int32)
        far = np.full(ids.shape, np.inf)
        open_ = np.zeros(ids.shape, dtype=bool)
        m = len(self.entries)
        start = 2 - 2 * (x @ self.centroids[self.entries].T)
        best = np.argsort(start, axis=1, kind="stable")[:, :beam]
        ids[:, : best.shape[1]] = self.entries[best]
        far[:, : best.shape[1]] = np.take_along_axis(start, best, axis=1)
        open_[:, : best.shape[1]] = True
        seen[:, self.entries] = True
        active = np.arange(rows)
        width = self.links.shape[1]
        for _ in range(4 * n // max(1, m) + 64):
            score = np.where(open_[active, :beam], far[active, :beam], np.inf)
            two = np.argsort(score, axis=1, kind="stable")[:, :2]
            some = np.isfinite(np.take_along_axis(score, two[:, :1], axis=1))[:, 0]
            active, two, score = active[some], two[some], score[some]
            if not len(active):
                break
            usable = np.isfinite(np.take_along_axis(score, two, axis=1))
            rows_of = active[:, None]
            open_[rows_of, two] = False
            node = np.where(usable, ids[rows_of, two], ids[rows_of, two[:, :1]])
            fresh = self.links[node].reshape(len(active), -1)
            old = seen[rows_of, fresh]
            seen[rows_of, fresh] = True
            order = np.argsort(fresh, axis=1, kind="stable")  # of a centroid reached twice in one step the first counts
            ranked = np.take_along_axis(fresh, order, axis=1)
            again = np.zeros_like(old)
            np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
            distance = np.where(old | again, np.inf, 2 - 2 * np.einsum("bd,bmd->bm", x[active], self.centroids[fresh]))
            span = beam + fresh.shape[1]
            ids[active, beam:span], far[active, beam:span], open_[active, beam:span] = fresh, distance, np.isfinite(distance)
            keep = np.argsort(far[active, :span], axis=1, kind="stable")[:, :beam]
            for a in (ids, far, open_):
                a[active, :beam] = np.take_along_axis(a[active, :span], keep, axis=1)
            assert fresh.shape[1] <= 2 * width
        distances = far[:, :beam]
        return np.where(np.isfinite(distances), ids[:, :beam], -1), np.sqrt(np.maximum(distances, 0))

    def lists_of(self, x: np.ndarray, closure: float = CLOSURE, replicas: int = REPLICAS) -> list[np.ndarray]:
        """The lists a vector is put into: its nearest centroid's, and at a boundary others'."""
        ids, far = self.search(x, max(2 * replicas, 24))
        out = []
        for near, distance in zip(ids, far, strict=True):
            chosen = [near[0]]
            for c, d in zip(near[1:], distance[1:], strict=True):
                if c < 0 or d > closure * distance[0] or len(chosen) == replicas:
                    break
                gaps = 2 - 2 * (self.centroids[chosen] @ self.centroids[c])
                if np.sqrt(np.maximum(gaps, 0)).min() >= 0.5 * d:
                    chosen.append(c)
            out.append(np.array(chosen, dtype=np.int32))
        return out

    def probes_of(self, x: np.ndarray, ratio: float, beam: int) -> list[np.ndarray]:
        """The lists a query visits: all within ``ratio`` of the nearest one's distance, of ``beam`` that are looked at."""
        if np.isinf(ratio):
            return [np.arange(len(self.centroids), dtype=np.int32)] * len(x)
        ids, far = self.search(x, beam)
        return [near[(distance <= ratio * max(distance[0], TINY)) & (near >= 0)] for near, distance in zip(ids, far, strict=True)]

    def needed(self, x: np.ndarray, lists: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(for each neighbour's lists the least ratio of distances that visits one of them; all ratios, a row per vector)."""
        far = np.sqrt(np.maximum(2 - 2 * (x @ self.centroids.T), 0))
        ratios = far / np.maximum(far.min(axis=1, keepdims=True), TINY)
        return np.array([row[one].min() for row, of in zip(ratios, lists, strict=True) for one in of]), ratios


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _deal(graph: CentroidGraph, lists_of):
    """(rep, vec) -> (list, place, rep, vec), a row per list that ``lists_of`` gives for a batch of unit vectors; the
    nearest list has place 0."""
    step = max(16, min(1024, (1 << 25) // len(graph.centroids)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = lists_of(graph, unit(_matrix(part.column(1)).astype(np.float64)))
                rows = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
                places = np.concatenate([np.arange(len(c)) for c in lists])
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int32()), pa.array(places, pa.int32()), *taken.columns], names=["list", "place", "rep", "vec"])

    return run


def _nearest(queries: np.ndarray, reps: np.ndarray, k: int):
    """(rep, vec) -> (query, rep, score): each task's ``k`` best for every query but its own row."""

    def run(batches):
        score, ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            near = queries @ unit(_matrix(batch.column(1)).astype(np.float64)).T
            near[reps[:, None] == own[None, :]] = -np.inf
            both, of = np.concatenate([score, near], axis=1), np.concatenate([ids, np.broadcast_to(own, near.shape)], axis=1)
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            score, ids = np.take_along_axis(both, top, axis=1), np.take_along_axis(of, top, axis=1)
        rows, places = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(reps[rows]), pa.array(ids[rows, places]), pa.array(score[rows, places])], names=["query", "rep", "score"])

    return run


def calibrated(graph: CentroidGraph, distinct: DataFrame, postings: DataFrame, sources: DataFrame, k: int, recall: float) -> tuple[float, int]:
    """(distance ratio, centroids to look at) with which queries find the share ``recall`` of their neighbours.

    At most CALIBRATION queries are compared with all vectors, in blocks, and only their neighbours reach the driver.
    """
    if recall >= 1:
        return float("inf"), len(graph.centroids)
    some = sources.orderBy(F.xxhash64("rep"), "rep").limit(CALIBRATION).toArrow()
    if not some.num_rows:
        return 1.0, 1
    reps, x = some.column("rep").to_numpy(), unit(_matrix(some.column("vec")).astype(np.float64))
    found = distinct.select("rep", "vec").mapInArrow(_nearest(x, reps, k), "query long, rep long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k)
    met = postings.select("rep", "list").join(F.broadcast(best.select("query", "rep")), "rep").groupBy("query", "rep").agg(F.collect_set("list").alias("lists"))
    lists: dict[int, list] = {int(r): [] for r in reps}
    for row in met.collect():
        lists[row["query"]].append(np.array(row["lists"]))
    least, ratios = graph.needed(x, [lists[int(r)] for r in reps])
    ratio = float(np.quantile(least, recall, method="higher")) + 1e-9 if len(least) else 1.0
    return ratio, min(len(graph.centroids), int(1.5 * (ratios <= ratio).sum(axis=1).max()) + 8)


def _best(k: int):
    """Queries (rep, vec, floor) and candidates (rep, vec) of a list -> (query, rep, score): the ``k`` best of the list, of
    which those below a query's floor are left out."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        empty = {"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not queries.num_rows or not candidates.num_rows:
            return pa.table(empty)
        q, c = _matrix(queries.column("vec")).astype(np.float64), _matrix(candidates.column("vec")).astype(np.float64)
        reps = candidates.column("rep").to_numpy()
        least = queries.column("floor").to_numpy()
        q_size, c_size = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
        out: list[list[np.ndarray]] = [[], [], []]
        take = min(k, len(c))
        step = max(1, 4_000_000 // len(c))
        for at in range(0, len(q), step):
            rough = (q[at : at + step] @ c.T) / q_size[at : at + step, None] / c_size
            floor = np.maximum(np.partition(rough, len(c) - take, axis=1)[:, len(c) - take], least[at : at + step]) - 1e-9
            for row, (line, low) in enumerate(zip(rough, floor, strict=True), at):
                near = np.flatnonzero(line >= low)
                exact = (q[row] * c[near]).sum(axis=1) / (q_size[row] * c_size[near])
                order = np.lexsort((reps[near], -exact))[:take]
                order = order[exact[order] >= least[row]]
                best = near[order]
                for a, b in zip(out, (np.full(len(best), queries.column("rep")[row].as_py()), reps[best], exact[order]), strict=True):
                    a.append(b)
        return pa.table({n: pa.array(np.concatenate(a)) for n, a in zip(empty, out, strict=True)})

    return run


def _met(probes: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): ``k`` + 1 best candidates of each list for the queries that visit it, dealt in blocks."""
    blocks = lambda df, name, size: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    shape = blocks(postings, "c_blocks", CANDIDATE_BLOCK).join(blocks(probes, "q_blocks", QUERY_BLOCK), "list")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = postings.join(shape, "list").select("list", "rep", "vec", own("c_blocks").alias("c"), each("q_blocks").alias("q"))
    left = probes.join(shape, "list").select("list", "rep", "vec", "floor", own("q_blocks").alias("q"), each("c_blocks").alias("c"))
    key = ["list", "c", "q"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k + 1), "query long, rep long, score double")


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec): rows with an id and a finite, non-zero vector of the commonest length (of equally common, the longest)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    bad: Column = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (sizes.n if sizes else -1))


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, recall: float = RECALL, closure: float = CLOSURE, replicas: int = REPLICAS) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every`` the nearest other rows found.

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller id. Rows with a null id or
    a null, zero, non-finite or partly null vector, or one of an uncommon length, take no part. Of repeated ids with equal
    vectors one counts. A query without other usable rows has no row; an empty table gives none. ``recall`` is the share of
    true neighbours that the visited lists are chosen for; 1 visits all lists, which is exact.
    """
    rows = usable(vectors, id_col, vec_col).withColumn("h", F.xxhash64("vec"))
    ranked = rows.select("id", "vec", "h", F.dense_rank().over(Window.partitionBy("h", "vec").orderBy("id")).alias("r")).where(F.col("r") <= k + 1)
    distinct = store(ranked.groupBy("h", "vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("rep", F.element_at("ids", 1)), "distinct")
    n = distinct.count()
    kind = dict(distinct.dtypes)["vec"]
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    lists = max(1, min(n // LIST, int(LISTS_PER_ROOT * n**0.5)))
    share = min(1.0, max(LEAST_SAMPLE, PER_CENTROID * lists) / n)
    sample = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30))).select("rep", "vec").toArrow().sort_by("rep")
    x = unit(_matrix(sample.column("vec")).astype(np.float64))
    graph = CentroidGraph.build(balanced_centroids(x, -(-len(x) // lists)))
    # a vector that very many rows ask for is met by a broadcast, so no task has all of them
    wanted = store(rows.where(F.col("id") % every == 0).select("id", "h", "vec").distinct(), "wanted")
    total = wanted.count()
    right = distinct.select("h", F.col("vec").alias("own"), "rep").join(wanted.groupBy("h").agg(F.count("*").alias("n")), "h")
    asked = store(join_hot(wanted, right, "h", "n", total).where("vec = own").select("id", "rep"), "asked")
    sources = store(distinct.select("rep", "vec").join(asked.select("rep").distinct(), "rep", "left_semi"), "sources")
    dealt = f"list int, place int, rep long, vec {kind}"
    postings = store(distinct.select("rep", "vec").mapInArrow(_deal(graph, lambda g, v: g.lists_of(v, closure, replicas)), dealt), "postings")
    ratio, beam = calibrated(graph, distinct, postings, sources, k, recall)
    probes = store(sources.mapInArrow(_deal(graph, lambda g, v: g.probes_of(v, ratio, beam)), dealt), "probes")
    none = F.lit(float("-inf"))
    first = _met(probes.where(F.col("place") < HOMES).withColumn("floor", none), postings.where("place = 0"), k)
    last = first.select("query", "score", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))).alias("r")).where(F.col("r") == k + 1)
    floors = store(last.select(F.col("query").alias("rep"), (F.col("score") - SLACK).alias("floor")), "floors")
    found = _met(probes.join(floors, "rep", "left").withColumn("floor", F.coalesce("floor", none)), postings, k)
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    top = found.select("*", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep")).alias("r")).where(F.col("r") <= k + 1)
    top = store(top.select("query", "rep", "score"), "top")
    ids = distinct.select("rep", "ids").join(top.groupBy("rep").agg(F.count("*").alias("n")), "rep")
    members = join_hot(top, ids, "rep", "n", top.count()).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("members"))  # k + 1 at most
    members = members.join(asked.groupBy(F.col("rep").alias("query")).agg(F.count("*").alias("n")), "query")
    pairs = join_hot(asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query")), members, "query", "n", total)
    pairs = pairs.select("query_id", F.explode("members").alias("m")).select("query_id", "m.score", F.explode("m.ids").alias("vec_id")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
