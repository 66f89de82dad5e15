"""The corpus pipeline: classifier, near-duplicates, personal data, mixing, packing, each stage over all its predecessor kept.

A stage's rows are written as Parquet in the shared folder and reread as the next one's documents, so a lost executor
costs at most the tasks of one stage. A run given a folder leaves its stages there, with a mark of the input's files; a
later run with the same folder and input begins after the last stage that was written whole, and one whose input has
changed begins anew. Without a folder the stages are deleted as soon as the next one is written, the last with the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.llm import gam, mixing, packing, pii, simhash
from meshspark.llm.common import delete, drop, exists, remember, shared_root, stored, table
from meshspark.llm.queries import vocabulary


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []  # tables of the stage before, which are read until its rows are written


def staged(stage: Stage) -> Stage:
    """A stage that first deletes the tables of the stage before it, whose rows have been written and reread by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _left)
        before = set(stored())
        out = stage(spark, docs, sf_dir)
        _left[:] = [path for path in stored() if path not in before]
        return out

    return run


@staged
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return gam.accepted(docs, table(spark, sf_dir, "labels"))


@staged
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


@staged
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data generalised."""
    return pii.sanitise(docs)


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and of a source's last one as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality classifier", classify), ("simhash near-dedup", deduplicate), ("pii", sanitise), ("mixing", mix), ("packing", pack)]

#: Fingerprints by XXH64, tokenizers and boosting have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def mark(spark: SparkSession, sf_dir: str) -> str:
    """What tells a state of the input from others: names, sizes and times of its files, and the stages' names."""
    seen = []
    for name in ("documents", "labels"):
        files = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet").select("path", "length", "modificationTime")  # not the content
        row = files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
        seen.append("/".join(map(str, row)))
    return "|".join([*seen, *[name for name, _ in STAGES]])


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``, in ``folder`` of a store that all executors share."""
    docs = table(spark, sf_dir, "documents")
    place = folder or f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    if folder is not None:
        now, at = mark(spark, sf_dir), f"{place}/input"
        if not exists(spark, f"{at}/_SUCCESS") or [r.value for r in spark.read.text(at).collect()] != [now]:
            for k in range(len(STAGES)):
                delete(spark, f"{place}/{k}")
            spark.createDataFrame([(now,)], "value string").write.mode("overwrite").text(at)
    for k, (_, stage) in enumerate(STAGES):
        out = f"{place}/{k}"
        if not exists(spark, f"{out}/_SUCCESS"):
            others = set(stored())
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
            drop(spark, [path for path in stored() if path not in others])  # the stage's own tables; what it returned has been written
            if k and folder is None:
                delete(spark, f"{place}/{k - 1}")
        docs = spark.read.parquet(out)
    if folder is None:
        remember(place)
    return docs
