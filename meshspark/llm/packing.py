"""Mixture-controlled packing: deficit round-robin over source queues, laid into sequences of a fixed length.

Each source has a queue of packets, its documents in shuffled order, long ones cut. Every round (a window of WINDOW
tokens) adds to a source's credit its target proportion of the window, among the sources whose queues still hold packets;
a packet at the head of the queue goes out in the first round whose credit covers it, and what is left is carried on. A
source of weight w has credit for w * v tokens once the stream is T(v) = sum over sources of min(size, w * v) tokens long,
so the round of a packet follows from its end in its queue and the few points where a queue runs out. Every task finds it
by itself, and the deficits carry across windows, partitions and the ends of queues. Rounds are laid end to end and cut
into sequences. The last, short sequence is cut into power-of-two ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .mixing import offsets, shuffled
from .tokens import encode_documents, unpack_ids

LENGTH = 2048
#: Tokens of a round over all sources.
WINDOW = 16 * LENGTH
#: Rounds whose offsets are summed together.
SPAN = 1024


def tail_sequences(total: int, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(sequence_id, first, last exclusive) of the positions after the whole sequences, at falling powers of two."""
    first, out = total // length * length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total - total // length * length) >> bit & 1:
            out.append((total // length + len(out), first, first + (1 << bit)))
            first += 1 << bit
    return out


def _phases(queues: DataFrame) -> list[tuple[float, float, float]]:
    """(v, T(v), weight of the queues that last beyond v) where queues run out, from 0 on; at most one for each weight
    that was given and one for all other sources, whose queues end together."""
    ends = queues.groupBy("v_end").agg(F.sum("weight").alias("weight")).orderBy("v_end").collect()
    left, v, done, out = sum(r.weight for r in ends), 0.0, 0.0, []
    for r in ends:
        out.append((v, done, left))
        done += (r.v_end - v) * left
        v, left = r.v_end, left - r.weight
    return out


def rounds(sized: DataFrame, length: int = LENGTH, window: int = WINDOW, weights: Mapping[str | None, float] | None = None) -> tuple[DataFrame, int]:
    """(rid, doc_id, source, size) -> packets with ``round`` and ``position`` in the laid-out stream, and the stream's size.

    ``weights`` are the target proportions of sources, as parts of one; a source without weighs its part of all tokens.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("queue_size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    # v runs to 1 for a source that weighs its own part
    weight = F.col("queue_size").cast("double") / float(total or 1)
    v_end = F.lit(1.0)
    for name, given in (weights or {}).items():
        if not given > 0:
            raise ValueError("weights must be above 0")
        here = F.col("source").eqNullSafe(F.lit(name).cast("string"))
        v_end = F.when(here, weight / float(given)).otherwise(v_end)
        weight = F.when(here, F.lit(float(given))).otherwise(weight)
    sums = store(sums.select("source", "queue_size", weight.alias("weight"), v_end.alias("v_end")), "queues")
    phases = _phases(sums)
    packet = F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(length).cast("long")))
    packets = sized.withColumnRenamed("size", "doc_tokens").select("*", packet.alias("first"))
    packets = packets.select("*", F.least(F.lit(length).cast("long"), F.col("doc_tokens") - F.col("first")).alias("size"), shuffled(F.col("doc_id"), F.col("rid")).alias("_mix"))
    queued = offsets(packets, ["_mix", "doc_id", "rid", "first"], sized.count())
    right = sums.select(F.col("source").alias("_source"), "queue_size", "v_end")
    queued = queued.join(right, queued.source.eqNullSafe(right._source))
    v = F.col("v_end") * ((F.col("start") + F.col("size")) / F.col("queue_size"))
    credit_due = F.lit(0.0)
    for begin, done, left in phases:
        credit_due = F.when(v > begin, F.lit(done) + (v - F.lit(begin)) * F.lit(left)).otherwise(credit_due)
    served = queued.withColumn("round", F.greatest(F.ceil(F.round(credit_due * float(total or 1) / window, 9)).cast("long") - 1, F.lit(0)))
    served = served.withColumn("span", F.floor(F.col("round") / SPAN)).select("rid", "doc_id", "source", "doc_tokens", "first", "size", "start", "round", "span")
    served = store(served, "served")
    spans = served.groupBy("span").agg(F.sum("size").alias("_sum"))
    before = spans.select(F.col("span").alias("_span"), (F.sum("_sum").over(Window.orderBy("span")) - F.col("_sum")).alias("_before"))
    order = Window.partitionBy("span").orderBy("round", F.col("source").asc_nulls_last(), "start").rowsBetween(Window.unboundedPreceding, -1)
    laid = served.withColumn("_own", F.coalesce(F.sum("size").over(order), F.lit(0)))
    laid = laid.join(before, laid.span == before._span)
    return laid.select("rid", "doc_id", "source", "doc_tokens", "first", "size", "round", (F.col("_own") + F.col("_before")).alias("position")), int(total)


def cut(packets: DataFrame, total: int, length: int = LENGTH) -> DataFrame:
    """Packets in the stream -> pieces (rid, start, length, sequence_id, offset)."""
    last = F.col("position") + F.col("size")
    parts = packets.select("*", F.explode(F.sequence(F.floor(F.col("position") / length).cast("long"), F.floor((last - 1) / length).cast("long"))).alias("seq"))
    whole = F.array(F.struct(F.col("seq").cast("long").alias("id"), (F.col("seq") * length).cast("long").alias("low"), ((F.col("seq") + 1) * length).cast("long").alias("high")))
    tail = tail_sequences(total, length)
    bounds = whole
    if tail:
        ends = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("id", "low", "high"), t, strict=True)]) for t in tail])
        bounds = F.when(F.col("seq") < total // length, whole).otherwise(ends)
    parts = parts.select("*", F.explode(bounds).alias("s")).where((F.col("s.low") < last) & (F.col("s.high") > F.col("position")))
    low, high = F.greatest("position", "s.low"), F.least(last, F.col("s.high"))
    return parts.select("rid", (F.col("first") + low - F.col("position")).alias("start"), (high - low).alias("length"), F.col("s.id").alias("sequence_id"), (low - F.col("s.low")).alias("offset"))


def _with_ids(digest: bool):
    """(doc_id, n_tokens, ids, pieces) -> a row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces")
            places = lists.offsets.to_numpy()
            fields = [lists.values.field(f).slice(int(places[0]), int(places[-1] - places[0])) for f in ("start", "length", "sequence_id", "offset")]
            starts, lengths = fields[0].to_numpy(), fields[1].to_numpy()
            per_row = np.diff(places)
            last: list = []
            at = 0
            for packed, n in zip(batch.column("ids"), per_row.tolist(), strict=True):
                ids = unpack_ids(packed.as_py()).astype("<u4")
                for a, k in zip(starts[at : at + n].tolist(), lengths[at : at + n].tolist(), strict=True):
                    last.append(zlib.crc32(ids[a : a + k]) if digest else ids[a : a + k].astype(np.int32))
                at += n
            row = pa.array(np.repeat(np.arange(batch.num_rows), per_row))
            columns = {
                "doc_id": batch.column("doc_id").take(row), "start": fields[0], "length": fields[1], "doc_tokens": batch.column("n_tokens").take(row),
                "sequence_id": fields[2], "offset": fields[3], "ids": pa.array(last, pa.int64() if digest else pa.list_(pa.int32())),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, window: int = WINDOW, end_id: int = 1, digest: bool = False, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (the piece's ids; with digest their crc32).

    A null text counts as empty and is the end id alone; a null source is a queue of its own. Null or repeated doc_ids
    are packed row by row, each row being a document. Every id lies in one piece and no sequence needs padding: all have
    ``length`` ids but the last few, which have powers of two. ``weights`` give sources target proportions; without, every
    window has the proportions of the whole. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).withColumn("rid", F.monotonically_increasing_id())
    coded = store(encode_documents(rows.select("doc_id", "source", "rid", "text"), tokenizer, end_id), "ids")
    packets, total = rounds(coded.select("rid", "doc_id", "source", F.col("n_tokens").alias("size")), length, window, weights)
    pieces = cut(packets, total, length)
    lists = pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    kind = "long" if digest else "array<int>"
    return coded.select("rid", "doc_id", "n_tokens", "ids").join(lists, "rid").drop("rid").mapInArrow(_with_ids(digest), f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids {kind}")


def sequences(pieces: DataFrame) -> DataFrame:
    """Pieces with ids -> (sequence_id, ids): the sequences themselves."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p.ids)).alias("ids"))
