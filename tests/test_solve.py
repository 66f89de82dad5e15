"""Solves by elimination of parts against the dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.operators import linalg


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(linalg, "MOST", 30)
    monkeypatch.setattr(linalg, "PART", 20)


def banded(spark, n, reach, seed=3):
    r = np.random.default_rng(seed)
    m = np.zeros((n, n))
    for d in range(1, reach + 1):
        m += np.diag(r.uniform(-1, 0.2, n - d), d)
    m = m + m.T
    m += np.diag(np.abs(m).sum(axis=1) + 0.1)
    rows = [(int(i) * 7 + 3, int(j) * 7 + 3, float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    return m, spark.createDataFrame(rows, "i long, j long, w double")


def test_parts_agree_with_the_dense_solve(spark, small):
    m, operator = banded(spark, 160, 2)
    b = np.random.default_rng(4).normal(size=(160, 2))
    rhs = spark.createDataFrame([(k * 7 + 3, float(b[k, 0]), float(b[k, 1])) for k in range(160)], "vid long, u double, v double")
    got = linalg.solve(operator, rhs).orderBy("vid").collect()
    assert [r.vid for r in got] == [k * 7 + 3 for k in range(160)]
    assert np.array([(r.u, r.v) for r in got]) == pytest.approx(np.linalg.solve(m, b), abs=1e-9)


def test_ids_that_do_not_part_raise(spark, small, monkeypatch):
    monkeypatch.setattr(linalg, "PART", 10)
    _, operator = banded(spark, 60, 59)
    with pytest.raises(ValueError, match="do not part"):
        linalg.solve(operator, operator.select(F.col("i").alias("vid"), F.lit(1.0).alias("u")).distinct())


def test_conjugate_gradient_steps_do_not_grow_with_the_diagonal(spark):
    m, operator = banded(spark, 40, 2)
    scale = 10.0 ** np.linspace(-3, 3, 40)
    at = lambda c: F.pow(F.lit(10.0), -3 + 6 * (F.col(c) - 3) / 7 / 39)
    scaled = operator.select("i", "j", (F.col("w") * at("i") * at("j")).alias("w"))
    rhs = spark.createDataFrame([(k * 7 + 3, float(scale[k])) for k in range(40)], "vid long, u double")
    got = np.array([r.u for r in linalg.conjugate_gradient(scaled, rhs, 1e-9, most_steps=25).orderBy("vid").collect()])
    assert got * scale == pytest.approx(np.linalg.solve(m, np.ones(40)), rel=1e-3)
