"""Shared helpers: table access, stored intermediate tables, text kernels."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"

_stored: list[str] = []
#: Rows that Python workers get at a time while a table is stored; texts are long, so the default takes much memory.
ARROW_ROWS, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; a temporary one only where that is unset and
    the session runs in one process. A cluster without the setting is an error, for its executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread: cuts lineage and survives lost executors.

    Files stay until ``release`` or the end of the driver, because the returned frame reads them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(rows), TEXTS)))
    try:
        df.write.option("compression", "snappy").parquet(path)  # zstd keeps native buffers beyond the heap for each column
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    _stored.append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = _file_system(spark, path)
    files.delete(at, True)


def stored() -> list[str]:
    """The places of all stored tables."""
    return list(_stored)


def remember(path: str) -> None:
    """Have a folder deleted with the stored tables, at the end of the driver."""
    _stored.append(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables by their places, and let the JVM forget the shuffles of frames that are gone."""
    for path in paths:
        if path in _stored:
            _stored.remove(path)
            delete(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``store`` returned; call only when it and what reads it are done with."""
    path = df._stored_at
    if path in _stored:
        _stored.remove(path)
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every stored table; call only when no frame over them is still to be read."""
    while _stored:
        delete(spark, _stored.pop())


@atexit.register
def _at_exit() -> None:
    session = SparkSession.getActiveSession() if _stored else None
    if session is not None:
        try:
            release(session)
        except Exception:  # the JVM may already be gone; the folder is then the cluster's to clear
            _stored.clear()


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as one struct column ``doc``, so that none of its names can clash, and more columns, which see its fields."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("doc")).select("doc", *more)


def unwrapped(rows: DataFrame, columns: list[str], replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns of the struct ``doc`` again, some replaced."""
    new = replaced or {}
    return rows.select(*[(new[c] if c in new else F.col("doc").getField(c)).alias(c) for c in columns])


#: Most keys of a join that are taken to be hot.
HOT_KEYS = 10_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each key once and in ``rows`` how many rows of ``left`` hold it.

    Keys that hold more than 1/HOT_KEYS of ``total``, the rows of ``left``, are at most HOT_KEYS; they are joined by a
    broadcast of that size, so that no task gets all rows of one key. The others meet by a shuffle.
    """
    least = max(1000, total // HOT_KEYS)
    hot = right.where(F.col(rows) > least)
    marked = left.join(F.broadcast(hot.select(F.col(key).alias("_hot_key"))), F.col(key) == F.col("_hot_key"), "left")
    some = marked.where(F.col("_hot_key").isNotNull()).drop("_hot_key").join(F.broadcast(hot), key)
    rest = marked.where(F.col("_hot_key").isNull()).drop("_hot_key").join(right.where(F.coalesce(F.col(rows), F.lit(0)) <= least), key, how)
    return some.unionByName(rest)


def whole_number_crc(col: Column) -> Column:
    """crc32 of the number written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


def slices(texts: pa.Array, most_bytes: int = 6 << 20, most_texts: int = 8192) -> Iterator[tuple[int, pa.Array]]:
    """(texts before, texts as binary without nulls) for stretches of a string array; a long text is a stretch by itself."""
    texts = pc.fill_null(texts, "").cast(pa.binary())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        before = sizes[low - 1] if low else 0
        high = min(low + most_texts, max(low + 1, int(np.searchsorted(sizes, before + most_bytes, side="right"))))
        yield low, texts.slice(low, high - low)
        low = high


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a binary array."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words ``[^\\x20\\x09-\\x0D]+`` of a binary array, how many each text has)."""
    data, bounds = buffer_of(texts)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(texts), dtype=np.int64)
    space = _IS_SPACE[data]
    first = np.ones(len(data) + 1, dtype=bool)
    first[1:-1] = space[:-1]
    first[bounds] = True
    begins = np.flatnonzero(first[:-1] & ~space)
    place = np.concatenate([[0], np.cumsum(~space)])
    cuts = np.append(place[begins], place[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(data[~space])])
    return words, np.diff(np.searchsorted(begins, bounds, side="left"))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
