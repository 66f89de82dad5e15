"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

Texts are coded once: blocks of documents hold their distinct words and the documents as places in that list. Words of
all blocks meet once to be counted, and the counts return to the blocks, so no task holds the vocabulary and no token is
shuffled. Exchange clustering begins with units on the driver: the words of at least 1/HEADS of the training tokens (so
at most HEADS of them), and for the other words FORMS groups by ending and length. Then every other word that occurs
LEAST times or more is exchanged by its own counts, in rounds: blocks send the classes before and after each of their
words, these meet by word, and the word moves to where the class bigrams' likelihood is highest. Words of a round move
at once; a round that lowers the likelihood is undone. Only unseen words and those seen less stay with their group.

P(text) is the product over its tokens of P(class | class before) * P(word | class), with the end of a text before its
first word. Transitions are smoothed with the classes' shares, emissions as in the base score, within the class.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, store, whole_number_crc

HEADS = 512
FORMS = 1024
#: Least number of classes; it grows as the cube root of the number of words that are exchanged.
CLASSES = 48
SWEEPS = 8
#: Training tokens from which a word is exchanged by its own counts.
LEAST = 2
#: Most rounds of exchange; they end sooner when one gains less than GAIN of what the rounds before it gained.
ROUNDS = 8
GAIN = 0.2
#: Deletes a query's shuffle files when it has ended, and not when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tokens of a block.
BLOCK = 4_000_000
#: Added to every count of the base score and the emissions.
ADDED = 0.1
#: Weight of the classes' shares in the transitions, in counts.
SHARE = 8.0
#: The end of a text; no word holds white space.
END = b"\n"


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _spread(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, doc_id, held_out, text) -> blocks."""
    made = 0
    words: defaultdict = defaultdict()
    words.default_factory = words.__len__
    parts: list[np.ndarray] = []
    ids: list = []
    held: list[bool] = []

    def full(task: int) -> pa.RecordBatch:
        nonlocal made
        lengths = np.array([len(p) for p in parts], dtype=np.uint32)
        stream = np.concatenate(parts)
        training = np.repeat(~np.array(held), lengths)
        counts = np.bincount(stream[training], minlength=len(words))
        block = (task << 32) + made
        made += 1
        columns = {
            "block": pa.array([block], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "lengths": pa.array([_squeeze(lengths)], pa.binary()),
            "stream": pa.array([_squeeze(stream)], pa.binary()), "n_train": pa.array([int(counts.sum())], pa.int64()), "words": pa.array([list(words)], pa.list_(pa.binary())), "counts": pa.array([counts], pa.list_(pa.int64())),
        }
        parts.clear(), ids.clear(), held.clear(), words.clear()
        return pa.RecordBatch.from_pydict(columns)

    size, task = 0, 0
    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        for task, doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
            tokens = (text.as_py() or b"").lower().split()
            tokens.append(END)
            parts.append(np.fromiter(map(words.__getitem__, tokens), dtype=np.uint32, count=len(tokens)))
            ids.append(doc_id)
            held.append(out)
            size += len(tokens)
            if size >= BLOCK:
                yield full(task)
                size = 0
    if parts:
        yield full(task)


CODED = "block long, ids array<long>, held array<boolean>, lengths binary, stream binary, n_train long, words array<binary>, counts array<long>"


def code(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.select(F.spark_partition_id().cast("long").alias("task"), "doc_id", (whole_number_crc(F.col("doc_id")) % fold == 0).alias("held"), "text")
    return store(dealt.mapInArrow(_code, CODED), "coded")


JOINED = "block long, ids array<long>, held array<boolean>, lengths binary, stream binary, counts binary, forms binary, keys binary, first binary, head_places array<int>, head_words array<binary>, head_counts array<long>, head_first array<boolean>, n_first long, n_exchanged long"


def _join_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block and its words' counts over all blocks, in one row."""
    place = right.column("place").to_numpy()
    counts, forms = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int16)
    keys, firsts = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=bool)
    counts[place] = right.column("c").to_numpy()
    forms[place] = right.column("form").to_numpy()
    keys[place] = right.column("key").to_numpy()
    first = right.column("first").to_numpy(zero_copy_only=False) & (right.column("c").to_numpy() > 0)
    firsts[place] = first
    heads = right.filter(pa.compute.is_valid(right.column("head")))
    kept = left.select(["block", "ids", "held", "lengths", "stream"])
    more = {
        "counts": pa.array([_squeeze(counts)], pa.binary()), "forms": pa.array([_squeeze(forms)], pa.binary()), "keys": pa.array([_squeeze(keys)], pa.binary()), "first": pa.array([_squeeze(firsts)], pa.binary()),
        "head_places": pa.array([heads.column("place").to_pylist()], pa.list_(pa.int32())), "head_words": pa.array([heads.column("head").to_pylist()], pa.list_(pa.binary())),
        "head_counts": pa.array([heads.column("c").to_pylist()], pa.list_(pa.int64())), "head_first": pa.array([heads.column("first").to_pylist()], pa.list_(pa.bool_())), "n_first": pa.array([int(first.sum())], pa.int64()),
        "n_exchanged": pa.array([int((firsts & (keys != 0)).sum())], pa.int64()),
    }
    for name, column in more.items():
        kept = kept.append_column(name, column)
    return kept


def count(coded: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with their words' counts in all training texts, and the number of training tokens."""
    total = int(coded.agg(F.sum("n_train")).first()[0] or 0)
    words = coded.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "place", "w.words", "w.counts")
    one = Window.partitionBy("words")
    met = words.select("block", "place", "words", F.sum("counts").over(one).alias("c"), (F.row_number().over(one.orderBy("block")) == 1).alias("first"))
    ending = F.xxhash64(F.substring("words", F.greatest(F.length("words") - 1, F.lit(1)), F.lit(2)), F.floor(F.least(F.length("words"), F.lit(12)) / 3))
    is_head = F.col("c") * HEADS >= max(1, total)
    key = F.when(~is_head & (F.col("c") >= LEAST), F.xxhash64("words")).otherwise(F.lit(0)).alias("key")  # words of one key share a class
    looked = met.select("block", "place", "c", "first", F.pmod(ending, F.lit(FORMS)).cast("short").alias("form"), key, F.when(is_head, F.col("words")).alias("head"))
    left = coded.select("block", "ids", "held", "lengths", "stream")
    return store(left.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(_join_block, JOINED), "joined"), total


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of units by exchange clustering: each unit in turn moves to where the class bigrams' likelihood is highest."""
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n) % classes
    table = np.zeros((classes, classes))
    np.add.at(table, (place[:, None], place[None, :]), bigrams)
    own = np.diagonal(bigrams).copy()
    for _ in range(sweeps):
        moved = 0
        for u in order[weight[order] > 0]:
            here = place[u]
            after = np.bincount(place, bigrams[u], classes)
            before = np.bincount(place, bigrams[:, u], classes)
            after[here] -= own[u]
            before[here] -= own[u]
            table[here] -= after
            table[:, here] -= before
            table[here, here] -= own[u]
            base = _xlogx(table)
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            out, into = after.sum() + own[u], before.sum() + own[u]
            gain = (_xlogx(table + after) - base).sum(axis=1) + (_xlogx(table + before[:, None]) - base).sum(axis=0)
            at = np.diagonal(table)
            gain += _xlogx(at + after + before + own[u]) + _xlogx(at) - _xlogx(at + after) - _xlogx(at + before)
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
            best = int(np.argmax(gain))
            best = best if gain[best] > gain[here] + 1e-9 else here
            table[best] += after
            table[:, best] += before
            table[best, best] += own[u]
            moved += best != here
            place[u] = best
        if not moved:
            break
    return place


def _units(batch: pa.RecordBatch, row: int, heads: dict[bytes, int]) -> np.ndarray:
    """The unit of each word of a block: its place among the heads, or after them its form."""
    units = _spread(batch.column("forms")[row].as_py(), np.int16).astype(np.int64) + len(heads)
    for place, word in zip(batch.column("head_places")[row].as_py(), batch.column("head_words")[row].as_py(), strict=True):
        units[place] = heads[word]
    return units


def _documents(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, lengths, held) of a block."""
    held = np.array(batch.column("held")[row].as_py(), dtype=bool)
    return _spread(batch.column("stream")[row].as_py(), np.uint32), _spread(batch.column("lengths")[row].as_py(), np.uint32).astype(np.int64), held


def bigram_counts(joined: DataFrame, heads: dict[bytes, int]) -> np.ndarray:
    """Unit bigrams of all training texts, each with the end before its first word."""
    n = len(heads) + FORMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                units = _units(batch, row, heads)
                stream, lengths, held = _documents(batch, row)
                now = units[stream]
                before = np.concatenate([now[-1:], now[:-1]])  # the token before a text's first is the end of one
                training = np.repeat(~held, lengths)
                total += np.bincount(before[training] * n + now[training], minlength=n * n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["pair", "n"])

    pairs = joined.select("forms", "head_places", "head_words", "stream", "lengths", "held").mapInArrow(run, "pair long, n long")
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n * n)
    out[found["pair"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return out.reshape(n, n)


STATE = "block long, ids array<long>, held array<boolean>, lengths binary, stream binary, counts binary, keys binary, first binary, classes binary"
_KEPT = ["block", "ids", "held", "lengths", "stream", "counts", "keys", "first"]


def _with_classes(batch: pa.RecordBatch, classes: list[np.ndarray]) -> pa.RecordBatch:
    own = [batch.column(c) for c in _KEPT]
    return pa.RecordBatch.from_arrays([*own, pa.array([_squeeze(c.astype(np.uint16)) for c in classes], pa.binary())], names=[*_KEPT, "classes"])


def placed(joined: DataFrame, heads: dict[bytes, int], place: np.ndarray) -> DataFrame:
    """Blocks with the class of each of their words, as the units have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with_classes(batch, [place[_units(batch, row, heads)] for row in range(batch.num_rows)])

    return joined.mapInArrow(run, STATE)


def _coded(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, the token before each, whether it is of a training text); before a text's first is the end of one."""
    stream, lengths, held = _documents(batch, row)
    return stream, np.concatenate([stream[-1:], stream[:-1]]), np.repeat(~held, lengths)


def neighbour_classes(state: DataFrame, classes: int) -> DataFrame:
    """(key, here, block, place, context, n): the classes before a block's exchanged words, and after them + ``classes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = _spread(batch.column("classes")[row].as_py(), np.uint16).astype(np.int64)
                keys = _spread(batch.column("keys")[row].as_py(), np.int64)
                stream, before, training = _coded(batch, row)
                pairs = []
                for word, other, shift in ((stream, before, 0), (before, stream, classes)):
                    use = training & (keys[word] != 0)
                    pairs.append(word[use].astype(np.int64) * (2 * classes) + of[other[use]] + shift)
                pair, n = np.unique(np.concatenate(pairs), return_counts=True)
                word, start = np.unique(pair // (2 * classes), return_index=True)
                ends = np.append(start, len(pair)).astype(np.int32)
                context = (pair % (2 * classes)).astype(np.int32)
                for low in range(0, len(word), 10_000):
                    cut = slice(low, low + 10_000)
                    at = ends[low : low + len(word[cut]) + 1]
                    lists = [pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(v[at[0] : at[-1]].astype(np.int32), pa.int32())) for v in (context, n)]
                    own = [pa.array(keys[word[cut]]), pa.array(of[word[cut]].astype(np.int32)), pa.array(np.full(len(word[cut]), batch.column("block")[row].as_py())), pa.array(word[cut].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*own, *lists], names=["key", "here", "block", "place", "context", "n"])

    return state.select("block", "held", "lengths", "stream", "keys", "classes").mapInArrow(run, "key long, here int, block long, place int, context array<int>, n array<int>")


class Exchange:
    """The best class of words by their neighbours' classes, against the class bigrams ``table``, each cell by itself."""

    FEW, ENTRIES = 4, 16_384

    def __init__(self, table: np.ndarray):
        self.k = len(table)
        self.by = np.concatenate([table, table.T])  # by context, then the word's class
        self.rows, self.columns = table.sum(axis=1), table.sum(axis=0)
        self.empty = np.flatnonzero(self.rows + self.columns == 0)
        self.gains = np.stack([_xlogx(self.by + n) - _xlogx(self.by) for n in range(1, self.FEW + 1)])

    def best(self, start: np.ndarray, context: np.ndarray, n: np.ndarray, here: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Per word, whose entries begin at ``start``: its class, unless another makes the likelihood higher.

        Empty classes are all as good, so the words' keys deal them out; or words that move at once would stay together.
        """
        out = here.copy()
        ends = np.append(start, len(context))
        low = 0
        while low < len(start):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + self.ENTRIES, side="right")) - 1)
            cut = slice(ends[low], ends[high])
            c, m, own = context[cut], n[cut].astype(float), here[low:high]
            of = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
            step = self.gains[np.minimum(n[cut], self.FEW) - 1, c]
            many = np.flatnonzero(n[cut] > self.FEW)
            step[many] = _xlogx(self.by[c[many]] + m[many, None]) - _xlogx(self.by[c[many]])
            stay = self.by[c, own[of]]
            step[np.arange(len(c)), own[of]] = _xlogx(stay) - _xlogx(np.maximum(stay - m, 0))
            gain = np.add.reduceat(step, ends[low:high] - ends[low], axis=0)
            for totals, side in ((self.columns, c < self.k), (self.rows, c >= self.k)):
                size = np.bincount(of, m * side, high - low)
                loss = _xlogx(totals + size[:, None]) - _xlogx(totals)
                loss[np.arange(high - low), own] = _xlogx(totals[own]) - _xlogx(np.maximum(totals[own] - size, 0))
                gain -= loss
            top = gain.argmax(axis=1)
            if len(self.empty):
                top = np.where(np.isin(top, self.empty), self.empty[keys[low:high] % len(self.empty)], top)
            better = gain[np.arange(high - low), top] > gain[np.arange(high - low), own] + 1e-9
            out[low:high] = np.where(better, top, own)
            low = high
        return out


def moves(state: DataFrame, table: np.ndarray) -> DataFrame:
    """(block, place, class) of the words that another class suits better."""

    def choose(rows: pa.Table, by: Exchange) -> pa.RecordBatch:
        keys = rows.column("key").to_numpy()
        begins = np.append(True, keys[1:] != keys[:-1])
        word = np.cumsum(begins) - 1
        lists = rows.column("context").combine_chunks()
        entry = np.repeat(word, pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        pair, back = np.unique(entry * (2 * by.k) + lists.flatten().to_numpy(), return_inverse=True)
        n = np.bincount(back, rows.column("n").combine_chunks().flatten().to_numpy()).astype(np.int64)
        start = np.searchsorted(pair // (2 * by.k), np.arange(word[-1] + 1))
        here = rows.column("here").to_numpy().astype(np.int64)
        to = by.best(start, pair % (2 * by.k), n, here[begins], keys[begins])[word]
        left = np.flatnonzero(to != here)
        return pa.RecordBatch.from_arrays([pa.array(rows.column("block").to_numpy()[left]), pa.array(rows.column("place").to_numpy()[left]), pa.array(to[left].astype(np.int32))], names=["block", "place", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, rest = Exchange(table), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            keys = rows.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last word may go on in the next batch
            rest = rows.slice(whole)
            if whole:
                yield choose(rows.slice(0, whole), by)
        if rest is not None:
            yield choose(rest, by)

    return neighbour_classes(state, len(table)).repartition("key").sortWithinPartitions("key").mapInArrow(run, "block long, place int, class int")


def _move(left: pa.Table, right: pa.Table) -> pa.Table:
    batch = left.combine_chunks().to_batches()[0]
    classes = _spread(batch.column("classes")[0].as_py(), np.uint16).copy()
    classes[right.column("place").to_numpy()] = right.column("class").to_numpy()
    return pa.Table.from_batches([_with_classes(batch, [classes])])


def class_counts(state: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class bigrams of all training texts, distinct training words of each class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + 1) * classes, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                of = _spread(batch.column("classes")[row].as_py(), np.uint16).astype(np.int64)
                stream, before, training = _coded(batch, row)
                total[: classes * classes] += np.bincount(of[before[training]] * classes + of[stream[training]], minlength=classes * classes)
                total[classes * classes :] += np.bincount(of[_spread(batch.column("first")[row].as_py(), bool)], minlength=classes)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["pair", "n"])

    found = state.select("held", "lengths", "stream", "first", "classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((classes + 1) * classes)
    out[found["pair"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return out[: classes * classes].reshape(classes, classes), out[classes * classes :]


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def exchanged(joined: DataFrame, heads: dict[bytes, int], place: np.ndarray, classes: int, words: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(blocks with their words' classes after all rounds, class bigrams, distinct words of each class)."""
    state = store(placed(joined, heads, place), "classes")
    discard(joined)
    table, kinds = class_counts(state, classes)
    begun = likelihood(table)
    for _ in range(ROUNDS if words else 0):
        moved = store(moves(state, table), "moves")  # by itself, so that the words' shuffle files are gone before the blocks'
        new = store(state.groupBy("block").cogroup(moved.groupBy("block")).applyInArrow(_move, STATE), "classes")
        discard(moved)
        after, after_kinds = class_counts(new, classes)
        gain, gained = likelihood(after) - likelihood(table), likelihood(table) - begun
        if gain <= 0:
            discard(new)
            break
        discard(state)
        state, table, kinds = new, after, after_kinds
        if gain < GAIN * gained:
            break
    return state, table, kinds


def trained(docs: DataFrame, id_col: str, text_col: str, classes: int | None, fold: int) -> tuple[DataFrame, np.ndarray, np.ndarray, int, int]:
    """(blocks with their words' classes, class bigrams, distinct words of each class, training tokens, distinct words)."""
    coded = code(docs, id_col, text_col, fold)
    joined, total = count(coded)
    discard(coded)
    distinct, words = (int(x or 0) for x in joined.agg(F.sum("n_first"), F.sum("n_exchanged")).first())
    classes = classes or max(CLASSES, int(np.ceil(words ** (1 / 3))))
    named = joined.select(F.explode(F.arrays_zip("head_words", "head_counts", "head_first")).alias("h")).where("h.head_first").select("h.head_words", "h.head_counts").toPandas()
    named = sorted(zip(named["head_counts"], map(bytes, named["head_words"]), strict=True), key=lambda x: (-x[0], x[1]))
    heads = {word: k for k, (_, word) in enumerate(named)}
    place = exchange(bigram_counts(joined, heads), classes)
    return *exchanged(joined, heads, place, classes, words), total, distinct


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int | None = None, fold: int = 10) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Texts whose crc32(doc_id as text) mod ``fold`` is 0 are held out of training. A null or empty text is its end alone; a
    null id counts as the empty text. Repeated rows are texts of their own. Without training texts every count is 0. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    cleanup = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        state, table, kinds, total, distinct = trained(docs, id_col, text_col, classes, fold)
    finally:
        spark.conf.set(CLEANUP, cleanup)
    tokens = table.sum(axis=0)
    classes = len(table)
    shares = (tokens + 1) / (tokens.sum() + classes)
    steps = np.log10((table + SHARE * shares) / (table.sum(axis=1, keepdims=True) + SHARE))
    emitted = np.log10(tokens + ADDED * (kinds + 1))
    base = np.log10(total + ADDED * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                classes_of = _spread(batch.column("classes")[row].as_py(), np.uint16).astype(np.int64)
                counts = _spread(batch.column("counts")[row].as_py(), np.int64)
                stream, lengths, held = _documents(batch, row)
                ends = np.cumsum(lengths)
                log_count = np.log10(counts + ADDED)
                now = classes_of[stream]
                before = np.concatenate([now[-1:], now[:-1]])  # the token before a text's first is the end of one
                own = (log_count - emitted[classes_of])[stream] + steps[before, now]
                starts = ends - lengths
                sums = [np.add.reduceat(x, starts) for x in ((counts > 0)[stream].astype(np.int64), (log_count - base)[stream], own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, pa.array(held), pa.array(lengths), pa.array(sums[0]), pa.array(np.full(len(lengths), total)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10.0 ** (-sums[2] / lengths))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return state.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
