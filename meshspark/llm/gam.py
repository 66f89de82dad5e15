"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins and has a lookup table; boosting goes round the features, each time fitting a shallow
tree on the feature's bins to the log-loss gradient and adding it to the table. Then the pairs whose residual
gain on a coarse grid is largest get two-dimensional tables, boosted the same way with one cut in each direction. A score is
the logistic of the intercept and the table entries of a row's bins, added up a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, unwrapped, whole_number_crc, wrapped
from .quality_rules import MEASURES, base_measures

FEATURES = (*MEASURES, "stops_per_word", "words_per_line", "log_words")
#: Labelled rows the model is fitted on at most: those of the smallest hashes of their ids.
TRAIN_ROWS = 100_000
BINS = 48
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.15
#: Added to the second derivatives of a leaf.
RIDGE = 2.0
#: A row is accepted from this score on.
CUTOFF = 0.3


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``, one column per feature."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (a, b), table in self.pairs.items():
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Distinct edges at quantiles of the distinct values, so that rare extremes get bins of their own."""
    distinct = np.unique(values)
    both = np.concatenate([np.quantile(values, np.linspace(0, 1, bins // 2 + 1)[1:-1]), np.quantile(distinct, np.linspace(0, 1, bins // 2 + 1)[1:-1])]) if len(values) else values
    return np.unique(both)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a run of bins; place 0 where none helps."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return (float(gains[at]), at + 1) if gains[at] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree of the given depth over ordered bins."""
    _, at = _best_cut(g, h) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and leaf values of the best pair of cuts of a grid, one in each direction."""
    sum_g, sum_h = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    row_g, row_h, col_g, col_h = sum_g[:, -1:], sum_h[:, -1:], sum_g[-1:], sum_h[-1:]
    parts = [(sum_g, sum_h), (row_g - sum_g, row_h - sum_h), (col_g - sum_g, col_h - sum_h), (sum_g[-1, -1] - row_g - col_g + sum_g, sum_h[-1, -1] - row_h - col_h + sum_h)]
    gains = sum(_gain(a, b) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = [a[i, j] / (b[i, j] + RIDGE) for a, b in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gains[i, j] - _gain(g.sum(), h.sum())), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on rows ``x`` with labels ``y`` of 0 and 1. Without rows of both labels the score is a smoothed share."""
    model = Model()
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    n_features = x.shape[1]
    model.edges = [cuts(x[:, f], BINS) for f in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [cuts(x[:, f], PAIR_BINS) for f in range(n_features)]
    if not 0 < y.sum() < len(y):
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * shallow_tree(np.bincount(bins[f], y - p, len(table)), np.bincount(bins[f], p * (1 - p), len(table)))
            table += step
            total += step[bins[f]]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((quadrants(*grids(a, b)[1:])[0], a, b) for a, b in combinations(range(n_features), 2)), reverse=True)
    model.pairs = {(a, b): np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for _, a, b in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            cell, g, h = grids(a, b)
            step = RATE * quadrants(g, h)[1]
            table += step
            total += step.reshape(-1)[cell]
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the FEATURES): from the text alone."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base_measures(plain).select("doc_id", *FEATURES)


def held_out() -> Column:
    return whole_number_crc(F.col("doc_id")) % 5 == 0


def train(measured: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0; at most ``rows`` of them, of the smallest id hashes."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id"), F.col("quality").cast("int"))
    sample = measured.where(~held_out()).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES, "quality").limit(rows).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(dtype=np.float64).reshape(-1, len(FEATURES)), sample["quality"].to_numpy(dtype=np.float64))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The features of a batch whose first column is something else."""
    return np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))]).astype(np.float64).reshape(-1, len(FEATURES))


def apply(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch)), pa.float64())], names=["doc_id", "score"])

    return measured.select(F.col("doc_id").cast("long"), *FEATURES).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels, language, source and id are no inputs of a score. Null texts count as empty and are scored like any other;
    a null id counts as the empty text for held_out, and its row has no label. Repeated rows get a row each. Labels other
    than 0 and 1 are left out; without labels of both kinds every score is the smoothed share. An empty table gives none.
    """
    measured = store(features(docs, id_col, text_col), "features")
    scored = apply(measured, train(measured, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the cutoff, all columns unchanged; no row leaves its partition.

    Features are worked out once and stored beside the rows.
    """
    rows = wrapped(docs, F.col("doc").getField(text_col).cast("string").alias("text"), F.col("doc").getField(id_col).cast("long").alias("doc_id"))
    measured = store(base_measures(rows).select("doc", "doc_id", *FEATURES), "features")
    model = train(measured.select("doc_id", *FEATURES), labels)
    measured = measured.select("doc", *FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = pa.array(model.score(_matrix(batch)) >= CUTOFF)
            yield pa.RecordBatch.from_arrays([batch.column(0)], schema=pa.schema([batch.schema.field(0)])).filter(stay)

    return unwrapped(measured.mapInArrow(run, measured.select("doc").schema), docs.columns)
