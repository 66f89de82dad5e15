"""Binary token output: canonical length-limited Huffman codes, independent blocks with bit-offset checkpoints.

Code lengths come from the counts of all ids (package-merge, LIMIT bits at most) and are stored once as the codebook;
the codes follow from them. A block holds whole documents, about BLOCK ids, and can be decoded alone: its header
has the documents' ids and lengths and the bit offset of every STEP-th id, from where all stretches are decoded side by
side through one table of 2**LIMIT entries. Blocks are rows of Parquet files, which any store can hold.

Block, little-endian: b"HUF1", u32 documents, u64 ids, u32 step; per document i64 doc_id, u8 null flag, u32 ids;
u64 bit offsets; the bits, most significant first, padded with four zero bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .tokens import encode_documents, unpack_ids

LIMIT = 18
BLOCK = 1 << 17
STEP = 128
MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64 if counts.sum() >= 1 << 62 else np.int64)
    packages, levels = coins[:0], []
    for _ in range(limit):
        merged = np.concatenate([coins, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(coins))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    found = np.zeros(len(used), dtype=np.uint8)
    for leaves in reversed(levels):
        own = int(leaves[:take].sum())
        found[:own] += 1
        take = 2 * (take - own)
    lengths[used] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    steps = np.cumsum(np.concatenate([[0], 1 << (64 - 1 - lengths[order].astype(np.int64))]).astype(np.uint64))[:-1]
    codes[order] = steps >> (np.uint64(63) - lengths[order].astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every pattern of ``limit`` bits the id it begins with and its length, as id << 5 | length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    entries = (order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32)
    table = np.repeat(entries, 1 << (limit - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << limit) - len(table), dtype=np.uint32)])


def write_block(doc_ids: list[int | None], docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros((int(ends[-1]) if len(ids) else 0) // 64 + 2, dtype=np.uint64)
    if len(ids):
        word, room = at >> 6, 64 - (at & 63) - size
        code = codes[ids]
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    bits = words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0] + b"\0" * 4
    head = MAGIC + struct.pack("<IQI", len(docs), len(ids), step)
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    return head + known + np.array([len(d) for d in docs], dtype="<u4").tobytes() + at[::step].astype("<u8").tobytes() + bits


def read_block(block: bytes, table: np.ndarray, limit: int = LIMIT) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids) of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, n, step = struct.unpack_from("<IQI", block, 4)
    at = 20
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    null = np.frombuffer(block, np.uint8, n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(block, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    starts = -(-n // step)
    place = np.frombuffer(block, "<u8", starts, at).astype(np.int64)
    raw = np.frombuffer(block, np.uint8, offset=at + 8 * starts).astype(np.uint32)
    windows = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    out = np.zeros((starts, step), dtype=np.uint32)
    mask, spare = np.uint32((1 << limit) - 1), 32 - limit
    for k in range(step):
        if k == n - (starts - 1) * step:  # the last stretch has ended
            place = place[:-1]
        if not len(place):
            break
        entry = table[(windows[place >> 3] >> (spare - (place & 7)).astype(np.uint32)) & mask]
        out[: len(place), k] = entry >> np.uint32(5)
        place = place + (entry & np.uint32(31)).astype(np.int64)
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], sizes, out.reshape(-1)[:n]


def sorted_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """(doc_id, n_tokens, ids, part, at) in ascending (part, at): ascending doc_id, null first, repeated ids by text."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return store(encode_documents(dealt, tokenizer, end_id).withColumn("part", F.spark_partition_id()), "sorted-ids")


def id_counts(coded: DataFrame) -> np.ndarray:
    """How often each id occurs; as long as the largest id, so bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                one = np.bincount(np.concatenate([unpack_ids(p) for p in batch.column(0).slice(low, 512).to_pylist()]))
                if len(one) > len(total):
                    total = np.concatenate([total, np.zeros(len(one) - len(total), dtype=np.int64)])
                total[: len(one)] += one
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, dtype=np.int64)
    counts[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def write(coded: DataFrame, counts: np.ndarray, block: int = BLOCK, step: int = STEP, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Store the ids in the file format: (blocks (part, at, n_tokens, block), codebook (id, length)), both reread."""
    spark = coded.sparkSession
    lengths = code_lengths(counts, limit)
    codes = canonical_codes(lengths)
    shared = spark.sparkContext.broadcast((lengths, codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        own_ids: list = []
        own: list = []
        where, size = None, 0

        def full() -> pa.RecordBatch:
            data = write_block(own_ids, own, lengths, codes, step)
            return pa.RecordBatch.from_arrays([pa.array([where[0]], pa.int32()), pa.array([where[1]], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "at", "n_tokens", "block"])

        for batch in batches:
            for doc_id, packed, part, at in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if own and (size >= block or part != where[0] or at != where[1] + len(own)):
                    yield full()
                    own_ids, own, size = [], [], 0
                if not own:
                    where = (part, at)
                own_ids.append(doc_id)
                own.append(unpack_ids(packed))
                size += len(own[-1])
        if own:
            yield full()

    blocks = store(coded.select("doc_id", "ids", "part", "at").mapInArrow(run, "part int, at long, n_tokens long, block binary"), "blocks")
    used = np.flatnonzero(lengths)
    rows = spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id long, length int")
    return blocks, store(rows, "codebook")


def read(blocks: DataFrame, codebook: DataFrame, limit: int = LIMIT, digest: bool = False) -> DataFrame:
    """The documents of the files: (doc_id, start, n_tokens, ids); with digest ids_crc32 in place of ids."""
    spark = blocks.sparkSession
    book = codebook.toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, dtype=np.uint8)
    lengths[book["id"].to_numpy(dtype=np.int64)] = book["length"].to_numpy(dtype=np.uint8)
    shared = spark.sparkContext.broadcast(decode_table(lengths, limit))
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.select(F.col("part").alias("_part"), (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("part", "at", F.coalesce(own, F.lit(0)).alias("_own")).join(before, F.col("part") == F.col("_part")).select(F.col("part").alias("_p"), F.col("at").alias("_a"), (F.col("_own") + F.col("_before")).alias("first"))
    placed = blocks.join(starts, (F.col("part") == F.col("_p")) & (F.col("at") == F.col("_a"))).select("first", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for first, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, sizes, ids = read_block(block.as_py(), table, limit)
                ends = np.cumsum(sizes, dtype=np.int64)
                cuts = zip((ends - sizes).tolist(), ends.tolist(), strict=True)
                four = ids.astype("<u4")
                last = pa.array([zlib.crc32(four[a:b].tobytes()) for a, b in cuts], pa.int64()) if digest else pa.array([four[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids {'long' if digest else 'array<int>'}")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Encode, write, read back: (doc_id, start, n_tokens, ids_crc32), one row per input row.

    Documents stand in ascending doc_id, null ids first, repeated ids ordered by text. A null text counts as empty: the
    end id alone. An empty table gives no rows.
    """
    coded = sorted_ids(docs, tokenizer, id_col, text_col, end_id)
    blocks, codebook = write(coded, id_counts(coded))
    return read(blocks, codebook, digest=True).withColumnRenamed("ids", "ids_crc32")
