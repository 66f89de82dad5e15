"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and the session runs in one process. A
    cluster without the setting is an error, for its executors share no local folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        context.setCheckpointDir(root)
    return context._jsc.sc().getCheckpointDir().get()


#: Spark's setting by which a query's shuffle files go with its end; else they stay until the driver collects garbage.
CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and reread.

    A checkpointed frame keeps the size that was estimated for its plan, where a join counts as the product of its sides.
    Over the rounds of a loop that number's digits double each time, until planning alone fills the driver. A reread table
    has the size of its files. What was shuffled for it is deleted as soon as it is written.
    """
    path = f"{_folder(df)}/cut-{uuid.uuid4().hex}"
    settings = df.sparkSession.conf
    before = settings.get(CLEARED, None)
    settings.set(CLEARED, "true")
    try:
        df.write.parquet(path)
    finally:
        settings.set(CLEARED, before) if before is not None else settings.unset(CLEARED)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the tables of ``cut`` that the frames read; call only when nothing else is to read them."""
    for df in frames:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path
        own = at(_folder(df)).toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = at(folder)
            if path.getName().startswith("cut-") and path.getParent().toUri().getPath() == own:
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def placed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, for a table made once: it keeps its partitioning, and its estimated size with it."""
    _folder(df)
    return df.checkpoint()


def over_cores(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, for small tables whose rows each bring much work: read alone, they are one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
