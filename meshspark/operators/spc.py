"""Sequential control charts: observations(sim_id, t, feature_id, value), t counting parts from 1, the first m0 in control.

At time t > m0 a chart sees the window of the last win = min(t - m0, longest) parts, weighted by (1 - lam) ** age.
Times a chart does not reach have no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import renumber

LAMBDA, ALPHA, WINDOW = 0.01, 0.005, 10
#: Accepted permutations of a limit, as many as the reference draws.
PERMUTATIONS = 25_000
KEYS = ["sim_id", "feature_id"]


def _window(t: Column, m0: int, longest: int) -> Column:
    return F.least(t - m0, F.lit(longest))


def times(obs: DataFrame, m0: int, kmax: int) -> DataFrame:
    """(sim_id, t): the monitored times."""
    return obs.where((F.col("t") > m0) & (F.col("t") <= m0 + kmax)).select("sim_id", "t").distinct()


def expanding_ranks(obs: DataFrame, m0: int, kmax: int, longest: int = WINDOW) -> DataFrame:
    """(sim_id, feature_id, t, s, rank): ordinal rank among parts 1..t of every part s in t's window; ties by order.

    Every monitored time ranks its own prefix, so rows are those of the prefixes of one simulation and feature.
    """
    now = times(obs, m0, kmax).select(F.col("sim_id").alias("_sim"), F.col("t").alias("now"))
    seen = obs.join(now, (F.col("sim_id") == F.col("_sim")) & (F.col("t") <= F.col("now")))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("sim_id", "feature_id", "now").orderBy("value", "t")))
    return ranked.where(F.col("t") > F.col("now") - _window(F.col("now"), m0, longest)).select("sim_id", "feature_id", F.col("now").alias("t"), F.col("t").alias("s"), "rank")


def rank_moments(n: Column, win: Column, lam: float = LAMBDA) -> tuple[Column, Column]:
    """Mean and sd of sum(weight * rank) when the window's ranks are drawn from 1..n without replacement."""
    q = 1 - lam
    first = (1 - F.pow(F.lit(q), win)) / (1 - q)
    second = (1 - F.pow(F.lit(q * q), win)) / (1 - q * q)
    return first * (n + 1) / 2, F.sqrt(second * (n * n - 1) / 12 - (first * first - second) * (n + 1) / 12)


def rank_chart(obs: DataFrame, m0: int, kmax: int, lam: float = LAMBDA, longest: int = WINDOW, use_mean: bool = False) -> DataFrame:
    """(sim_id, t, t_stat): over features the largest (or mean) squared standardised weighted sum of ranks."""
    ewma = expanding_ranks(obs, m0, kmax, longest).groupBy("sim_id", "feature_id", "t").agg(F.sum(F.col("rank") * F.pow(F.lit(1 - lam), F.col("t") - F.col("s"))).alias("e"))
    mean, sd = rank_moments(F.col("t").cast("double"), _window(F.col("t"), m0, longest), lam)
    score = F.pow((F.col("e") - mean) / sd, 2)
    return ewma.groupBy("sim_id", "t").agg((F.avg if use_mean else F.max)(score).alias("t_stat"))


def ewma(obs: DataFrame, m0: int, kmax: int, lam: float = LAMBDA, longest: int = WINDOW) -> DataFrame:
    """(sim_id, feature_id, t, ewma): the plain weighted sum of the window's values."""
    over = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(1 - longest, 0)
    held = obs.withColumn("_w", F.collect_list(F.struct("t", "value")).over(over)).where((F.col("t") > m0) & (F.col("t") <= m0 + kmax))
    inside = F.filter("_w", lambda s: s.t > F.col("t") - _window(F.col("t"), m0, longest))
    return held.select(*KEYS, "t", F.aggregate(inside, F.lit(0.0), lambda a, s: a + s.value * F.pow(F.lit(1 - lam), F.col("t") - s.t)).alias("ewma"))


def standardised_ewma(obs: DataFrame, m0: int, kmax: int, lam: float = LAMBDA, longest: int = WINDOW) -> DataFrame:
    """(sim_id, feature_id, t, n, mean, sd, z): baseline of the parts before the window, population sd, and the window's
    weighted sum of standardised values; z is null where the baseline does not vary. The baseline is summed around the
    first value, which keeps the variance clear of cancellation."""
    upto = Window.partitionBy(*KEYS).orderBy("t")
    shifted = obs.withColumn("_0", F.first("value").over(upto)).withColumn("_v", F.col("value") - F.col("_0"))
    total = upto.rowsBetween(Window.unboundedPreceding, 0)
    last = upto.rowsBetween(1 - longest, 0)
    held = shifted.select("*", F.sum("_v").over(total).alias("_s1"), F.sum(F.col("_v") * F.col("_v")).over(total).alias("_s2"), F.collect_list(F.struct("t", "_v")).over(last).alias("_w"))
    held = held.where((F.col("t") > m0) & (F.col("t") <= m0 + kmax)).withColumn("_in", F.filter("_w", lambda s: s.t > F.col("t") - _window(F.col("t"), m0, longest)))
    n = F.col("t") - _window(F.col("t"), m0, longest)
    sums = held.select("*", n.alias("n"), F.aggregate("_in", F.lit(0.0), lambda a, s: a + s._v).alias("_i1"), F.aggregate("_in", F.lit(0.0), lambda a, s: a + s._v * s._v).alias("_i2"))
    sums = sums.withColumn("_m", (F.col("_s1") - F.col("_i1")) / F.col("n"))
    sums = sums.withColumn("sd", F.sqrt(F.greatest((F.col("_s2") - F.col("_i2")) / F.col("n") - F.col("_m") * F.col("_m"), F.lit(0.0))))
    z = F.aggregate("_in", F.lit(0.0), lambda a, s: a + (s._v - F.col("_m")) * F.pow(F.lit(1 - lam), F.col("t") - s.t))
    return sums.select(*KEYS, "t", "n", (F.col("_m") + F.col("_0")).alias("mean"), "sd", F.when(F.col("sd") > 0, z / F.col("sd")).alias("z"))


def feature_moments(z: DataFrame, prefix: int = 0) -> DataFrame:
    """(sim_id, t, stat, t_stat): over features mean (1), population variance (2), skewness (3) and raw kurtosis (4)."""
    m = [F.avg(F.pow("z", F.lit(k))) for k in range(1, 5)]
    raw = z.groupBy("sim_id", "t").agg(*[c.alias(f"m{k}") for k, c in enumerate(m, 1)])
    var = F.col("m2") - F.col("m1") * F.col("m1")
    third = F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.pow("m1", F.lit(3))
    fourth = F.col("m4") - 4 * F.col("m1") * F.col("m3") + 6 * F.pow("m1", F.lit(2)) * F.col("m2") - 3 * F.pow("m1", F.lit(4))
    stats = F.array(F.col("m1"), var, F.when(var > 0, third / F.pow(var, F.lit(1.5))), F.when(var > 0, fourth / (var * var)))
    return raw.select("sim_id", "t", F.posexplode(stats).alias("k", "t_stat")).select("sim_id", "t", (F.col("k") + 1 + prefix).alias("stat"), "t_stat")


def moment_chart(obs: DataFrame, m0: int, kmax: int, lam: float = LAMBDA, longest: int = WINDOW) -> DataFrame:
    """(sim_id, t, stat, t_stat): the four moments of metric ``value`` as 1..4 and of ``value2`` as 5..8."""
    second = obs.select("sim_id", "t", "feature_id", F.col("value2").alias("value"))
    one = feature_moments(standardised_ewma(obs.select("sim_id", "t", "feature_id", "value"), m0, kmax, lam, longest))
    return one.unionByName(feature_moments(standardised_ewma(second, m0, kmax, lam, longest), 4))


def order_statistic_limit(values: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """The element of 0-based place ceil(n (1 - alpha)) of each group's sorted values, plus 1e-12; the last if beyond."""
    # all rows are numbered by ranges of (group, value), so one large group is no single task's
    ranked = renumber(values.select(*by, "value"), [*by, "value"], "_r", start=0)
    groups = ranked.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    place = F.least(F.ceil(F.col("_n") * (1 - alpha)), F.col("_n") - 1)
    return ranked.join(groups, same).where(F.col("_r") - F.col("_first") == place).select(*by, (F.col("value") + 1e-12).alias("limit"))


def alarms(chart: DataFrame) -> DataFrame:
    """chart(sim_id, t, stat, t_stat, lo, hi) -> with alarm, up to and including the first time at which any stat alarms."""
    out = F.coalesce((F.col("t_stat") < F.col("lo")) | (F.col("t_stat") > F.col("hi")), F.lit(False))
    marked = chart.withColumn("alarm", out)
    first = marked.where("alarm").groupBy("sim_id").agg(F.min("t").alias("first"))
    return marked.join(first, "sim_id", "left").where(F.col("first").isNull() | (F.col("t") <= F.col("first"))).drop("first")


def run_lengths(chart: DataFrame, m0: int, kmax: int) -> DataFrame:
    """(sim_id, run_length, censored): the last time reached, counted from m0; one more if no stat alarms there."""
    last = chart.groupBy("sim_id").agg(F.max(F.struct("t", "alarm")).alias("l"), F.max("t").alias("t"))
    at_end = chart.join(last.select("sim_id", F.col("t")), ["sim_id", "t"], "left_semi").groupBy("sim_id", "t").agg(F.bool_or("alarm").alias("alarm"))
    return at_end.select("sim_id", (F.col("t") - m0 + F.when(F.col("alarm"), 0).otherwise(1)).cast("int").alias("run_length"), (~F.col("alarm")).alias("censored"))


def run_length_summary(lengths: DataFrame, kmax: int) -> DataFrame:
    """Mean, sd, share beyond kmax and the five-number summary."""
    five = F.percentile("run_length", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    row = lengths.agg(F.avg("run_length").alias("mean"), F.stddev_samp("run_length").alias("sd"), F.avg((F.col("run_length") > kmax).cast("double")).alias("beyond"), five.alias("five"))
    return row.select("mean", "sd", "beyond", *[F.col("five")[k].alias(n) for k, n in enumerate(("least", "q1", "median", "q3", "largest"))])


def _ranks(values: np.ndarray) -> np.ndarray:
    """Ordinal ranks 1.. of each column, ties by row."""
    out = np.empty(values.shape, dtype=np.int64)
    order = np.argsort(values, axis=0, kind="stable")
    np.put_along_axis(out, order, np.arange(1, len(values) + 1)[:, None] + np.zeros(values.shape, dtype=np.int64), axis=0)
    return out


def _rank_statistic(window: np.ndarray, n: int, lam: float, use_mean: bool) -> np.ndarray:
    """Statistics of windows (permutations, win, features) of ranks out of n, the newest part last."""
    win = window.shape[1]
    q = 1 - lam
    weight = q ** np.arange(win - 1, -1, -1)
    first, second = weight.sum(), (weight * weight).sum()
    mean, sd = first * (n + 1) / 2, math.sqrt(second * (n * n - 1) / 12 - (first * first - second) * (n + 1) / 12)
    score = ((np.einsum("pwf,w->pf", window, weight) - mean) / sd) ** 2
    return score.mean(axis=1) if use_mean else score.max(axis=1)


def permutation_limits_rank(obs: DataFrame, m0: int, kmax: int, permutations: int = PERMUTATIONS, alpha: float = ALPHA, lam: float = LAMBDA, longest: int = WINDOW, use_mean: bool = False, most_draws: int = 50, seed: int = 1) -> DataFrame:
    """(sim_id, t, stat, t_stat, lo, hi, acceptance): the rank chart with its conditional permutation limits.

    At each time permutations of all parts so far are drawn; those that would have alarmed at an earlier time whose window
    still overlaps are refused. The limit is the order statistic of the accepted ones. Drawing stops after ``most_draws``
    times the wanted number, and ``acceptance`` tells which share was accepted. The chart ends at its first alarm.
    Limits depend on earlier ones, so a simulation is one group; simulations run side by side.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        sim = frame["sim_id"].iloc[0]
        matrix = frame.pivot(index="t", columns="feature_id", values="value").sort_index().to_numpy()
        rng = np.random.default_rng([seed, int(sim)])
        limits: list[float] = []
        rows = []
        for i in range(min(kmax, len(matrix) - m0)):
            n = m0 + 1 + i
            ranks = _ranks(matrix[:n])
            win = min(i + 1, longest)
            stat = float(_rank_statistic(ranks[None, n - win :], n, lam, use_mean)[0])
            kept, drawn = [], 0
            back = min(i, longest - 1)
            reach = min(n, 2 * longest)
            while sum(map(len, kept)) < permutations and drawn < most_draws * permutations:
                size = min(permutations, 500)
                order = np.argsort(rng.random((size, n)), axis=1)[:, n - reach :]
                window = ranks[order]  # ranks among all n parts of the last ones in permuted order
                ok = np.ones(size, dtype=bool)
                earlier = window.copy()
                for step in range(1, back + 1):
                    gone = earlier[:, reach - step]  # the part that had not been seen yet
                    earlier = earlier - (earlier > gone[:, None])
                    past = i - step
                    span = min(past + 1, longest)
                    some = earlier[:, max(0, reach - step - span) : reach - step]
                    if some.shape[1] == span:
                        ok &= _rank_statistic(some, n - step, lam, use_mean) <= limits[past]
                kept.append(_rank_statistic(window[ok][:, reach - win :], n, lam, use_mean))
                drawn += size
            accepted = np.sort(np.concatenate(kept)[:permutations])
            place = min(math.ceil(len(accepted) * (1 - alpha)), len(accepted) - 1)
            limit = float(accepted[place]) + 1e-12 if len(accepted) else math.inf
            limits.append(limit)
            rows.append((sim, n, 1, stat, None, limit, sum(map(len, kept)) / drawn))
            if stat > limit:
                break
        return pd.DataFrame(rows, columns=["sim_id", "t", "stat", "t_stat", "lo", "hi", "acceptance"]).astype({"lo": "float64"})

    return obs.select("sim_id", "t", "feature_id", "value").groupBy("sim_id").applyInPandas(one, "sim_id int, t int, stat int, t_stat double, lo double, hi double, acceptance double")


def joint_limits(stats: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of statistics (permutations, stats) at the greatest common depth whose joint coverage exceeds 1 - alpha.

    The depth of a permutation is its least distance from either end over all statistics, in ranks; limits at depth d
    hold exactly those of depth d or more, so counting depths replaces shrinking the limits step by step.
    """
    n = len(stats)
    ranks = _ranks(stats)
    depth = np.sort(np.minimum(ranks, n + 1 - ranks).min(axis=1))
    cut = 1
    while cut < n // 2 and (n - np.searchsorted(depth, cut + 1)) / n > 1 - alpha:
        cut += 1
    ordered = np.sort(stats, axis=0)
    return ordered[cut - 1] - 1e-12, ordered[n - cut] + 1e-12


def permutation_limits_joint(obs: DataFrame, m0: int, kmax: int, permutations: int = PERMUTATIONS, alpha: float = ALPHA, lam: float = LAMBDA, longest: int = WINDOW, most_draws: int = 50, seed: int = 1) -> DataFrame:
    """(sim_id, t, stat, t_stat, lo, hi, acceptance): the moment chart's eight statistics with joint two-sided limits.

    As for the rank chart, permutations that would have left the limits at an earlier overlapping time are refused.
    """

    def statistics(values: np.ndarray, i: int) -> np.ndarray:
        """(permutations, 8) for parts in the order of axis 1, both metrics on the last axis."""
        n = m0 + 1 + i
        win = min(i + 1, longest)
        base, recent = values[:, : n - win], values[:, n - win : n]
        mean, sd = base.mean(axis=1), base.std(axis=1)
        weight = (1 - lam) ** np.arange(win - 1, -1, -1)
        z = np.einsum("pwfm,w->pfm", recent - mean[:, None], weight) / np.where(sd > 0, sd, 1)
        out = []
        for m in range(2):
            x = z[..., m]
            centre = x.mean(axis=1)
            dev = x - centre[:, None]
            var = (dev**2).mean(axis=1)
            safe = np.where(var > 0, var, 1)
            out += [centre, var, (dev**3).mean(axis=1) / safe**1.5, (dev**4).mean(axis=1) / safe**2]
        return np.stack(out, axis=1)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        sim = frame["sim_id"].iloc[0]
        cube = np.stack([frame.pivot(index="t", columns="feature_id", values=c).sort_index().to_numpy() for c in ("value", "value2")], axis=-1)
        rng = np.random.default_rng([seed, int(sim)])
        limits, rows = [], []
        for i in range(min(kmax, len(cube) - m0)):
            n = m0 + 1 + i
            own = statistics(cube[None, :n], i)[0]
            kept, drawn = [], 0
            while sum(map(len, kept)) < permutations and drawn < most_draws * permutations:
                size = min(permutations, 250)
                values = cube[np.argsort(rng.random((size, n)), axis=1)]
                ok = np.ones(size, dtype=bool)
                for step in range(1, min(i, longest - 1) + 1):
                    lo, hi = limits[i - step]
                    past = statistics(values, i - step)
                    ok &= ((past >= lo) & (past <= hi)).all(axis=1)
                kept.append(statistics(values[ok], i) if ok.any() else np.zeros((0, 8)))
                drawn += size
            accepted = np.concatenate(kept)[:permutations]
            lo, hi = joint_limits(accepted, alpha) if len(accepted) > 1 else (np.full(8, -np.inf), np.full(8, np.inf))
            limits.append((lo, hi))
            rows += [(sim, n, s + 1, own[s], lo[s], hi[s], sum(map(len, kept)) / drawn) for s in range(8)]
            if ((own < lo) | (own > hi)).any():
                break
        return pd.DataFrame(rows, columns=["sim_id", "t", "stat", "t_stat", "lo", "hi", "acceptance"])

    return obs.select("sim_id", "t", "feature_id", "value", "value2").groupBy("sim_id").applyInPandas(one, "sim_id int, t int, stat int, t_stat double, lo double, hi double, acceptance double")


def simulate(vertices: DataFrame, normal: Callable[[Column, int], Column], sims: int = 5, parts: int = 30, in_control: int = 20, sd: float = 0.05, shift: float = 0.1) -> DataFrame:
    """(sim_id, t, vid, x, y, z, d): scanned parts of a nominal mesh, ``sims`` simulations of ``parts`` each.

    Every vertex (vid, a whole number from 0; x, y, z) of every part is moved by Gaussian noise of ``sd``, and after
    ``in_control`` parts by ``shift`` along z, the defect; d is how far it lies from its nominal place. ``normal`` maps an
    integer key and a stream to a standard normal column, so a run can be replayed. Rows are made where the vertices lie,
    without a shuffle; null coordinates stay null.
    """
    every = vertices.select("vid", *[F.col(c).alias("n" + c) for c in "xyz"], F.explode(F.sequence(F.lit(0), F.lit(sims * parts - 1))).alias("k"))
    t = F.col("k") % parts + 1
    key = F.col("vid") * (sims * parts) + F.col("k")
    defect = F.when(t > in_control, F.lit(shift)).otherwise(0.0)
    moves = [(sd * normal(key, 2 * n) + (defect if c == "z" else F.lit(0.0))).alias("m" + c) for n, c in enumerate("xyz")]
    held = every.select("vid", F.floor(F.col("k") / parts).cast("int").alias("sim_id"), t.cast("int").alias("t"), "nx", "ny", "nz", *moves)
    d = F.sqrt(sum((F.col("m" + c) * F.col("m" + c) for c in "yz"), F.col("mx") * F.col("mx")))
    return held.select("sim_id", "t", "vid", *[(F.col("n" + c) + F.col("m" + c)).alias(c) for c in "xyz"], d.alias("d"))
