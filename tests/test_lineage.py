"""What a cut leaves of a plan."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.operators import linalg
from meshspark.operators.lineage import _folder, cut


def test_cut_forgets_the_estimated_size(spark):
    now = cut(spark.range(50).select(F.col("id").alias("vid"), ((F.col("id") + 1) % 50).alias("next")))
    for _ in range(6):  # each vertex learns the one twice as far on, as in boundary_loops and components
        far = now.select(F.col("vid").alias("next"), F.col("next").alias("next2"))
        now = cut(now.join(far, "next").select("vid", F.col("next2").alias("next")))
    assert [(r.vid, r.next) for r in now.orderBy("vid").collect()] == [(v, (v + 64) % 50) for v in range(50)]
    assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000


def test_cut_of_an_empty_table(spark):
    none = cut(spark.range(0).select("id", F.lit(None).cast("long").alias("pred")))
    assert none.columns == ["id", "pred"] and none.isEmpty()


def test_rounds_leave_no_tables_behind(spark):
    at = lambda: {f.name for f in Path(_folder(spark.range(1)).removeprefix("file:")).glob("cut-*")}
    path = spark.range(40).select(F.col("id").alias("i"), ((F.col("id") + 1) % 40).alias("j"))
    k = path.select("i", F.col("i").alias("j"), F.lit(2.0).alias("w")).unionByName(path.select("i", "j", F.lit(-1.0).alias("w"))).unionByName(path.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(-1.0).alias("w")))
    ones = path.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    before = at()
    values, vectors = linalg.lowest_eigenpairs(k, ones, 2)
    assert values[1] == pytest.approx(2 - 2 * np.cos(2 * np.pi / 40), rel=1e-4)
    assert len(at() - before) == 1 and vectors.count() == 40  # the vectors' own


def test_cut_leaves_no_shuffle_behind(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    before = set(root.rglob("shuffle_*.data"))
    out = cut(spark.range(200_000).groupBy((F.col("id") % 90_000).alias("g")).count())
    for _ in range(50):
        if not (left := set(root.rglob("shuffle_*.data")) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 90_000
    assert spark.conf.get(key, None) is None
