"""Solves and eigenproblems over sparse operators (i, j, w) and vectors (vid, u).

Dense ones gather their tables in one task and refuse more than MOST unknowns; ``solve`` eliminates parts beyond that, and
``conjugate_gradient`` and ``lowest_eigenpairs`` have no such bound, as every step is a join and an aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fem
from .lineage import cut, discard, placed
from .relational import renumber

#: Unknowns that a dense solve takes at most.
MOST = 6000


def gathered(tables: dict[str, DataFrame], f: Callable[..., pd.DataFrame], schema: str, most_rows: int = 40 * MOST) -> DataFrame:
    """Run ``f`` once on whole tables, given as structured arrays by name; raises beyond ``most_rows`` rows of any
    table, of which no more are gathered."""
    packed = None
    names = {}
    for name, df in tables.items():
        names[name] = df.columns
        one = df.limit(most_rows + 1).agg(F.count("*").alias(f"n_{name}"), F.collect_list(F.struct(*df.columns)).alias(name))
        packed = one if packed is None else packed.join(one)
    packed = packed.select(*[F.when(F.col(f"n_{n}") <= most_rows, F.col(n)).otherwise(F.raise_error(F.concat(F.lit(f"{n}: too many rows for one task: more than {most_rows}")))).alias(n) for n in tables])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(len(frame)):
                yield f(**{n: pd.DataFrame([tuple(r[c] for c in cols) for r in frame[n].iloc[k]], columns=cols) for n, cols in names.items()})

    return packed.mapInPandas(run, schema)


class Index:
    """Ids to places in a matrix and back."""

    def __init__(self, ids):
        self.ids = np.unique(np.asarray(ids, dtype=np.int64))
        if len(self.ids) > MOST:
            raise ValueError(f"{len(self.ids)} unknowns; a dense solve takes {MOST} at most")

    def __len__(self) -> int:
        return len(self.ids)

    def of(self, ids) -> np.ndarray:
        return np.searchsorted(self.ids, np.asarray(ids, dtype=np.int64))

    def matrix(self, coo: pd.DataFrame, value: str = "w") -> np.ndarray:
        out = np.zeros((len(self), len(self)))
        np.add.at(out, (self.of(coo["i"]), self.of(coo["j"])), coo[value].to_numpy(dtype=float))
        return out

    def vector(self, rows: pd.DataFrame, value: str = "u") -> np.ndarray:
        out = np.zeros(len(self))
        out[self.of(rows["vid"])] = rows[value].to_numpy(dtype=float)
        return out


def symmetric_eigen(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues ascending and vectors of a x = lambda b x, b positive definite; signs fixed by the largest entry."""
    if b is None:
        values, vectors = np.linalg.eigh((a + a.T) / 2)
    else:
        root = np.linalg.cholesky((b + b.T) / 2)
        inner = np.linalg.solve(root, np.linalg.solve(root, (a + a.T) / 2).T).T
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        vectors = np.linalg.solve(root.T, vectors)
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def spectrum(stiffness: DataFrame, mass: DataFrame, n: int = 15) -> DataFrame:
    """(k, value): the n lowest eigenvalues of the generalised problem after the null one; beyond MOST unknowns by rounds of
    solves."""
    if stiffness.select("i").distinct().count() > MOST:
        values, _ = lowest_eigenpairs(stiffness, mass, n, by_solves=True)
        return stiffness.sparkSession.createDataFrame(list(enumerate(values))[1:], "k int, value double")

    def f(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        index = Index(a["i"])
        values, _ = symmetric_eigen(index.matrix(a), index.matrix(b))
        low = values[1 : n + 1]
        return pd.DataFrame({"k": np.arange(1, len(low) + 1, dtype=np.int32), "value": low})

    return gathered({"a": stiffness.select("i", "j", "w"), "b": mass.select("i", "j", "w")}, f, "k int, value double")


#: Unknowns of a part that ``solve`` eliminates in one task.
PART = 1000


def _dense(operator: DataFrame, rhs: DataFrame, names: list[str]) -> DataFrame:
    def f(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        index = Index(np.concatenate([a["i"], a["j"], b["vid"]]))
        m, v = index.matrix(a), np.column_stack([index.vector(b, c) for c in names])
        try:
            x = np.linalg.solve(m, v)
        except np.linalg.LinAlgError:
            x = np.linalg.lstsq(m, v, rcond=None)[0]
        return pd.DataFrame({"vid": index.ids} | {c: x[:, k] for k, c in enumerate(names)})

    schema = "vid long, " + ", ".join(f"{c} double" for c in names)
    return gathered({"a": operator.select("i", "j", "w"), "b": rhs.select("vid", *names)}, f, schema, most_rows=4_000_000)


def _eliminate(names: list[str]) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A part's entries and right sides -> what its elimination adds to the operator (j set, vid null) and to the right
    sides (both null) at the row i of its rim, and its unknowns (vid) by the rim's (i; null for the constant)."""

    def f(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        inner = np.unique(np.concatenate([a["i"][a["own_i"]], a["j"][a["own_j"]], b["vid"]]).astype(np.int64))
        rim = np.unique(np.concatenate([a["i"][~a["own_i"]], a["j"][~a["own_j"]]]).astype(np.int64))
        ids = np.concatenate([inner, rim])
        order = np.argsort(ids)
        at = lambda x: order[np.searchsorted(ids, x, sorter=order)]
        n, m = len(inner), len(rim)
        whole = np.zeros((n + m, n + m))
        np.add.at(whole, (at(a["i"].to_numpy()), at(a["j"].to_numpy())), a["w"].to_numpy())
        right = np.zeros((n, len(names)))
        np.add.at(right, at(b["vid"].to_numpy(dtype=np.int64)), b[names].to_numpy(dtype=float))
        both = np.column_stack([whole[:n, n:], right])
        try:
            x = np.linalg.solve(whole[:n, :n], both)
        except np.linalg.LinAlgError:
            x = np.linalg.lstsq(whole[:n, :n], both, rcond=None)[0]
        less = -whole[n:, :n] @ x
        none = np.full(1, -1, dtype=np.int64)
        frames = [
            (np.repeat(rim, m), np.tile(rim, m), none.repeat(m * m), np.column_stack([less[:, :m].reshape(-1), np.zeros((m * m, len(names) - 1))])),
            (rim, none.repeat(m), none.repeat(m), less[:, m:]),
            (np.tile(rim, n), none.repeat(m * n), np.repeat(inner, m), np.column_stack([-x[:, :m].reshape(-1), np.zeros((m * n, len(names) - 1))])),
            (none.repeat(n), none.repeat(n), inner, x[:, m:]),
        ]
        return pd.concat([pd.DataFrame({"i": i, "j": j, "vid": v} | {c: x[:, k] for k, c in enumerate(names)}) for i, j, v, x in frames])

    return f


def solve(operator: DataFrame, rhs: DataFrame) -> DataFrame:
    """(vid, u..) with operator u = rhs for each column u.. of rhs; in the least-squares sense if singular and small.

    Up to MOST unknowns go to one dense task. More are dealt into parts of PART by their ids' order, and an unknown with an
    entry to a later part is put on the rim; each part is eliminated by one task, which leaves a system of the rims alone.
    That is solved in the same way, and the parts follow from it. This suits operators whose ids lie near those of their
    neighbours, as a grid's do; it raises where over two thirds of the unknowns are on a rim.
    """
    names = [c for c in rhs.columns if c != "vid"]
    operator, rhs = cut(operator.groupBy("i", "j").agg(F.sum("w").alias("w"))), cut(rhs.groupBy("vid").agg(*[F.sum(c).alias(c) for c in names]))
    ids = cut(rhs.select("vid").union(operator.select("i")).union(operator.select("j")).distinct())
    n = ids.count()
    if n <= MOST:
        discard(ids)
        return _dense(operator, rhs, names)
    part = renumber(ids, ["vid"], "_at", start=0).select("vid", F.floor(F.col("_at") / PART).alias("part"))
    met = operator.join(part.select(F.col("vid").alias("i"), F.col("part").alias("part_i")), "i").join(part.select(F.col("vid").alias("j"), F.col("part").alias("part_j")), "j")
    met = cut(met)
    rim = cut(met.where("part_i <> part_j").select(F.when(F.col("part_i") < F.col("part_j"), F.col("i")).otherwise(F.col("j")).alias("vid")).distinct())
    if rim.count() > 2 * n // 3:
        raise ValueError(f"{n} unknowns whose ids do not part them: {rim.count()} on a rim")
    marked = met.join(rim.select(F.col("vid").alias("i"), F.lit(False).alias("own_i")), "i", "left").join(rim.select(F.col("vid").alias("j"), F.lit(False).alias("own_j")), "j", "left").fillna(True, ["own_i", "own_j"])
    marked = cut(marked.withColumn("part", F.when(F.col("own_i"), F.col("part_i")).when(F.col("own_j"), F.col("part_j"))))
    inner = rhs.join(rim, "vid", "left_anti").join(part, "vid")
    schema = "i long, j long, vid long, " + ", ".join(f"{c} double" for c in names)
    done = cut(marked.where("part is not null").select("part", "i", "j", "w", "own_i", "own_j").groupBy("part").cogroup(inner.groupBy("part")).applyInPandas(_eliminate(names), schema))
    left = marked.where("part is null").select("i", "j", "w").unionByName(done.where("vid = -1 and j <> -1").select("i", "j", F.col(names[0]).alias("w")))
    right = rhs.join(rim, "vid", "left_semi").unionByName(done.where("vid = -1 and j = -1").select(F.col("i").alias("vid"), *names))
    rest = solve(left, right)
    known = cut(rest)
    discard(rest, operator, rhs, ids, met, rim, marked)
    of = done.where("vid <> -1 and i <> -1").select("vid", "i", F.col(names[0]).alias("w")).join(known.withColumnRenamed("vid", "i"), "i").select("vid", *[(F.col("w") * F.col(c)).alias(c) for c in names])
    whole = of.unionByName(done.where("vid <> -1 and i = -1").select("vid", *names)).groupBy("vid").agg(*[F.sum(c).alias(c) for c in names])
    return whole.unionByName(known)


def conjugate_gradient(operator: DataFrame, rhs: DataFrame, tolerance: float = 1e-10, most_steps: int = 500) -> DataFrame:
    """(vid, u) with operator u = rhs for a symmetric positive definite operator, of any size.

    The operator's diagonal is put before the residuals, so that steps do not grow with how unequal its entries are (a mass
    matrix of any mesh takes a few dozen). It ends when the residual itself is below ``tolerance`` times the right side. A
    step is a join and two aggregations; the inner products are taken from the table that it writes.
    """
    operator = placed(operator.select("i", "j", "w").repartition("j"))
    diagonal = operator.where("i = j").groupBy(F.col("i").alias("vid")).agg(F.sum("w").alias("_d"))
    scale = F.when(F.col("_d") > 0, F.col("_d")).otherwise(1.0).alias("d")
    state = cut(rhs.join(diagonal, "vid", "left").select("vid", scale, F.lit(0.0).alias("x"), F.col("u").alias("r"), (F.col("u") / scale).alias("p")))
    sums = [F.sum(F.col("r") * F.col("r")).alias("size"), F.sum(F.col("r") * F.col("r") / F.col("d")).alias("along")]
    size, along = (x or 0.0 for x in state.agg(*sums).first())
    goal = tolerance * tolerance * size
    for _ in range(most_steps):
        if size <= goal or size == 0:
            break
        image = fem.apply(operator, state.select("vid", F.col("p").alias("u"))).withColumnRenamed("u", "q")
        met = cut(state.join(image, "vid", "left").fillna(0.0, ["q"]))
        curve = met.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        step = along / curve
        moved = met.select("vid", "d", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        size, fresh = moved.agg(*sums).first()
        state = moved.select("vid", "d", "x", "r", (F.col("r") / F.col("d") + (fresh / along) * F.col("p")).alias("p"))
        along = fresh
    return state.select("vid", F.col("x").alias("u"))


def _columns(name: str, m: int) -> list[str]:
    return [f"{name}{k}" for k in range(m)]


def _matrix(batch: pa.RecordBatch, name: str, m: int) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _columns(name, m)])


#: Blocks of columns of a row in ``lowest_eigenpairs``: iterate, residual and direction, and what both operators make of them.
BLOCKS = tuple(a + b for a in ("x", "w", "p") for b in ("", "k", "m"))
#: Share of the mass, at the scale of the stiffness, that makes the operator of ``by_solves`` definite.
SHIFT = 1e-7
#: A residual below this share of the scale is that of a null value, of which there may be many.
NULL = 1e-12
#: A direction whose share in the Gram matrix is less than this is a combination of the others.
DEPENDENT = 1e-12


def _grams(rows: DataFrame, m: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S'KS, S'MS of S = [x w p], and the squared residual of each column under the lumped mass: sums of a size by m alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(18 * m * m + m)
        for batch in batches:
            s, k, n = (np.column_stack([_matrix(batch, a + b, m) for a in "xwp"]) for b in ("", "k", "m"))
            left = k[:, :m] - n[:, :m] * values
            mass = batch.column("dm").to_numpy(zero_copy_only=False)
            total += np.concatenate([(s.T @ k).ravel(), (s.T @ n).ravel(), (left * left / mass[:, None]).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    flat = np.zeros(18 * m * m + m)
    for row in rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[row["at"]] = row["value"]
    k, n = flat[: 18 * m * m].reshape(2, 3 * m, 3 * m)
    return (k + k.T) / 2, (n + n.T) / 2, flat[18 * m * m :]


def _ritz(k: np.ndarray, n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m lowest values of the small problem and their coefficients, dependent directions left out."""
    size = np.sqrt(np.maximum(np.diag(n), 0))
    scale = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0)
    share, basis = np.linalg.eigh(n * scale * scale[:, None])
    kept = share > DEPENDENT * max(share[-1], 0)
    basis = scale[:, None] * basis[:, kept] / np.sqrt(share[kept])
    small = basis.T @ k @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[:m], basis @ vectors[:, :m]


def lowest_eigenpairs(
    stiffness: DataFrame, mass: DataFrame, n: int = 15, tolerance: float = 1e-3, most_rounds: int = 1000, by_solves: bool = False, parts: DataFrame | None = None
) -> tuple[list[float], DataFrame]:
    """(values, (vid, u0 .. un)): the n + 1 lowest eigenvalues of stiffness u = value mass u and their vectors, of any size.

    Both operators (i, j, w) are symmetric, stiffness semidefinite and mass definite; the null one comes first. Locally
    optimal blocks with the stiffness's diagonal before them: a round joins the operators with the residuals, sums by row
    and gathers Gram matrices whose size follows from n alone. Vectors have mass norm one, their largest entry's sign is
    not fixed. It ends when each residual is below ``tolerance`` times its value, which leaves an error of its square in
    the value, and raises after ``most_rounds``; rounds grow with the root of the condition. Ids are those of the mass;
    an empty table gives no values, and with fewer unknowns than n + 1 there are as many values. With ``by_solves`` the
    residuals are solved for instead (``solve``, so ids must lie near those of their neighbours), and a few rounds do. With
    ``parts`` (vid, part), the task that moves a part solves for its residuals by the operator's entries within it: a
    half to a fifth of the diagonal's rounds, however ids are numbered.
    """
    both = stiffness.select("i", "j", F.col("w").alias("k"), F.lit(0.0).alias("m")).unionByName(mass.select("i", "j", F.lit(0.0).alias("k"), F.col("w").alias("m")))
    both = placed(both.groupBy("i", "j").agg(F.sum("k").alias("k"), F.sum("m").alias("m")).repartition("j"))
    own = both.groupBy(F.col("i").alias("vid")).agg(F.sum("m").alias("dm"), F.sum(F.when(F.col("i") == F.col("j"), F.col("k"))).alias("dk")).where("dm > 0")
    unknowns = own.count()
    n = min(n, unknowns - 1)
    if n < 0:
        return [], own.select("vid")
    m = min(n + 1 + max(3, n // 3), unknowns)  # more than asked for, so that the last ones asked for stand apart
    zero = np.zeros(m)
    solved_for = by_solves or parts is not None
    sums = own.agg(F.sum("dk").alias("k"), F.sum("dm").alias("m")).first()
    scale = sums.k / sums.m if sums.k and sums.k > 0 else 1.0
    shifted = both.select("i", "j", (F.col("k") + SHIFT * scale * F.col("m")).alias("w"))  # only makes the operator definite
    if by_solves:
        shifted = cut(shifted)
    if parts is not None:
        at = [parts.select(F.col("vid").alias(v), F.col("part").alias(name)) for v, name in (("i", "part"), ("j", "other"))]
        inner = placed(shifted.join(at[0], "i").join(at[1], "j").where("part = other").select("part", "i", "j", "w").repartition("part"))
        own = own.join(parts.select("vid", "part"), "vid", "left").fillna(-1, ["part"])

    def image(rows: DataFrame, name: str) -> DataFrame:
        """(vid, what both operators make of the block's columns)."""
        met = both.join(rows.select(F.col("vid").alias("j"), *_columns(name, m)), "j")
        sums = [F.sum(F.col(o) * F.col(f"{name}{c}")).alias(f"{name}{o}{c}") for o in "km" for c in range(m)]
        return met.groupBy(F.col("i").alias("vid")).agg(*sums)

    noise = [(F.xxhash64("vid", F.lit(c)) / float(1 << 63)).alias(f"x{c}") for c in range(1, m)]
    blank = [F.lit(0.0).alias(c) for b in BLOCKS if b[0] != "x" for c in _columns(b, m)]
    fixed = ["vid", "dm", "dk"] if parts is None else ["vid", "dm", "dk", "part"]
    first = cut(own.select(*fixed, F.lit(1.0).alias("x0"), *noise))
    rows = cut(first.join(image(first, "x"), "vid").select("*", *blank))
    discard(first)
    values = zero
    names = [c for b in BLOCKS for c in _columns(b, m)]
    kept = [*fixed, *[c for b in BLOCKS if b not in ("wk", "wm") for c in _columns(b, m)]]

    for _ in range(most_rounds):
        k, mm, left = _grams(rows.select("dm", *names), m, values)
        wanted = np.maximum(values[: n + 1], values[: n + 1].mean() / (n + 1))
        if values.any() and (left[: n + 1] <= np.maximum(tolerance * wanted, NULL * scale) ** 2).all():
            break
        values, c = _ritz(k, mm, m)
        if len(values) < m:
            raise ValueError(f"{len(values)} independent directions of {m}; is the mass definite?")
        toward = np.vstack([np.zeros((m, m)), c[m:]])
        size = np.sqrt(np.maximum(np.einsum("ic,ij,jc->c", toward, mm, toward), 0))
        toward = toward / np.where(size > 0, size, 1)

        def step(batches: Iterator[pa.RecordBatch], c: np.ndarray = c, toward: np.ndarray = toward, values: np.ndarray = values) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = {b: np.column_stack([_matrix(batch, a + b, m) for a in "xwp"]) for b in ("", "k", "m")}
                out = {"x" + b: v @ c for b, v in s.items()} | {"p" + b: v @ toward for b, v in s.items()}
                diagonal = batch.column("dk").to_numpy(zero_copy_only=False)
                out["w"] = out["xk"] - out["xm"] * values
                out["w"] /= 1 if solved_for else np.where(diagonal > 0, diagonal, 1)[:, None]
                flat = [pa.array(np.ascontiguousarray(out[b][:, j])) for b in BLOCKS if b in out for j in range(m)]
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in fixed], *flat], names=kept)

        def step_and_solve(key: tuple, held: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
            moved = next(step(iter([pa.RecordBatch.from_pandas(held, preserve_index=False)]))).to_pandas().sort_values("vid", ignore_index=True)  # noqa: B023  sent off in this round
            ids, w = moved["vid"].to_numpy(), moved[_columns("w", m)].to_numpy()
            block = np.zeros((len(ids), len(ids)))
            np.add.at(block, (np.searchsorted(ids, entries["i"]), np.searchsorted(ids, entries["j"])), entries["w"].to_numpy())
            np.fill_diagonal(block, np.where(np.diag(block) > 0, np.diag(block), 1.0))
            try:
                moved[_columns("w", m)] = np.linalg.solve(block, w)
            except np.linalg.LinAlgError:
                moved[_columns("w", m)] = w / np.diag(block)[:, None]
            return moved

        types = ", ".join(["vid long", "dm double", "dk double", *(["part long"] if parts is not None else []), *[f"{x} double" for x in kept[len(fixed) :]]])
        if parts is not None:
            moved = cut(rows.select(*fixed, *names).groupBy("part").cogroup(inner.groupBy("part")).applyInPandas(step_and_solve, types))
        else:
            moved = cut(rows.select("vid", "dm", "dk", *names).mapInArrow(step, types))
        if by_solves:
            solved = solve(shifted, moved.select("vid", *_columns("w", m)))
            fresh = cut(moved.drop(*_columns("w", m)).join(solved, "vid"))
            discard(moved, solved)
            moved = fresh
        last, rows = rows, cut(moved.join(image(moved, "w"), "vid"))
        discard(last, moved)
    else:
        raise RuntimeError(f"no {n + 1} eigenpairs within {tolerance} after {most_rounds} rounds; squared residuals {left[: n + 1]}")
    return [float(v) for v in values[: n + 1]], rows.select("vid", *[F.col(f"x{c}").alias(f"u{c}") for c in range(n + 1)])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most_steps: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Nonlinear conjugate gradients (Polak-Ribiere, restarted) with a backtracking line search; f gives value and gradient."""
    value, slope = f(x)
    direction, step = -slope, 1.0
    for _ in range(most_steps):
        along = float(slope @ direction)
        if along >= 0:
            direction, along = -slope, -float(slope @ slope)
        if along > -tolerance:
            break
        step *= 2
        while step > 1e-14:
            new_value, new_slope = f(x + step * direction)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * step * along:
                break
            step /= 2
        else:
            break
        x = x + step * direction
        beta = max(0.0, float(new_slope @ (new_slope - slope)) / max(float(slope @ slope), 1e-300))
        direction, value, slope = -new_slope + beta * direction, new_value, new_slope
    return x


def numeric_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, step: float) -> np.ndarray:
    """f(x) - f(x + step) along each axis: the negated forward difference, not divided by the step."""
    value = f(x)
    return np.array([value - f(x + step * axis) for axis in np.eye(len(x))])
