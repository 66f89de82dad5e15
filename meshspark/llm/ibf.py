"""Document fingerprints as invertible Bloom lookup tables of a text's paragraphs, DataFrame functions only.

A paragraph is a stretch of words of one line that ends where a sentence does, but has LEAST words or more where the line
has, and at most LEAST + MORE. Its digest of 60 bits is
put into one cell of each of three tables; a cell holds how many digests it got, their xor and the xor of their check
values. Cells of two texts subtract; what is left holds only digests that one of the two lacks, and peeling gives them
back: a cell with a single digest names it, it is taken out of its other cells, and so on.

A fingerprint has SIDE cells a table and can tell some twenty digests. Where that leaves something, the digests are dealt
into pages by their value and each page is told by tables of its own, doubled until all of it is peeled, so the work grows
with the text and no page with the text's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, store

#: Words of a paragraph before it ends with a sentence, and most words after these.
LEAST, MORE = 6, 16
WORD = r"[^\x20\x09-\x0D]"
PARAGRAPH = rf"(?:{WORD}+[\x20\x09]+){{0,{LEAST - 1}}}(?:{WORD}*[^\x20\x09-\x0D.!?][\x20\x09]+){{0,{MORE}}}{WORD}+"
TABLES = 3
#: Cells of one table of a fingerprint, and of a page's at first; digests of both texts that a page gets on average; pages of a book.
SIDE, PAGE_SIDE, PAGE, BOOK = 12, 20, 24, 64
#: Doublings of a page's tables; the chance that so few digests share so many cells is far below one in the digests of any corpus.
TRIES = 24
#: Digests are below 2**60; places and check values come from their halves, without overflow.
HALF = 1 << 30
PRIME = 2147483647
CHECK, PAGES, PLACES = (48271, 69621), (25214, 9301), ((16807, 39373), (40692, 52774), (30845, 62089))
CELL = "struct<count: int, key: bigint, check: bigint>"
ARRAY = f"array<{CELL}>"

Lambda = Callable[[Column], Column]


def _with(value: Column, f: Lambda) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _mixed(key: Column, by: tuple[int, int]) -> Column:
    """A number below PRIME from a digest; the xor of several digests gives another than the xor of theirs."""
    return (F.shiftright(key, 30) * by[0] + key.bitwiseAND(F.lit(HALF - 1)) * by[1] + 12345) % PRIME


def check_of(key: Column) -> Column:
    return _mixed(key, CHECK)


def place(key: Column, table: int, side: Column) -> Column:
    """The digest's cell of a table of ``side`` cells."""
    return _mixed(key, PLACES[table]) % side


def _entry(key: Column, side: Column, *more: Column) -> Column:
    return F.struct(key.alias("key"), check_of(key).alias("check"), *[place(key, t, side).alias(f"p{t}") for t in range(TABLES)], *more)


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, in order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("long")))


def sketch(keys: Column, side: Column) -> Column:
    """The cells of a set of digests, table after table."""
    none = F.struct(F.lit(0).alias("count"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))
    put = lambda a, e: F.struct((a["count"] + 1).alias("count"), a.key.bitwiseXOR(e.key).alias("key"), a.check.bitwiseXOR(e.check).alias("check"))

    def filled(entries: Column) -> Column:
        cell = lambda t: lambda c: F.aggregate(F.filter(entries, lambda e: e[f"p{t}"] == c), none, put)
        return F.concat(*[F.transform(F.sequence(F.lit(0).cast("long"), side - 1), cell(t)) for t in range(TABLES)])

    return _with(F.transform(keys, lambda k: _entry(k, side)), filled)


def minus(a: Column, b: Column) -> Column:
    """The cells of the digests that only one of two sets has: counted down where it is the second."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["count"] - y["count"]).alias("count"), x.key.bitwiseXOR(y.key).alias("key"), x.check.bitwiseXOR(y.check).alias("check")))


def peeled(cells: Column, side: Column) -> Column:
    """struct(only_first, only_second, whole) of subtracted cells: the digests on either side, and whether nothing was left.

    Only cells that hold something are kept, with their places, so that rounds get shorter. A told digest is a number of
    twice its value, and one more if the second set has it.
    """

    def left(t: int, entries: Column) -> Lambda:
        take = lambda a, e: F.struct(a.table.alias("table"), a.at.alias("at"), (a["count"] - e.sign).alias("count"), a.key.bitwiseXOR(e.key).alias("key"), a.check.bitwiseXOR(e.check).alias("check"))
        return lambda c: F.aggregate(F.filter(entries, lambda e: e[f"p{t}"] == c.at), c, take)

    def without(state: Column, new: Column) -> Column:
        rest = F.transform(state.cells, lambda c: F.when(c.table == 0, left(0, new.entries)(c)).when(c.table == 1, left(1, new.entries)(c)).otherwise(left(2, new.entries)(c)))
        return F.struct(F.filter(rest, held).alias("cells"), F.concat(state.told, new.told).alias("told"), F.lit(False).alias("done"))

    def again(state: Column) -> Column:
        """Another round: what single cells name leaves all its cells."""
        single = lambda c: (F.abs(c["count"]) == 1) & (c.check == check_of(c.key))
        named = F.array_distinct(F.transform(F.filter(state.cells, single), lambda c: c.key * 2 + F.when(c["count"] < 0, 1).otherwise(0)))
        entries = lambda v: F.transform(v, lambda k: _entry(F.shiftright(k, 1), side, (1 - 2 * k.bitwiseAND(F.lit(1))).cast("int").alias("sign")))
        stop = F.struct(state.cells.alias("cells"), state.told.alias("told"), F.lit(True).alias("done"))
        go = lambda v: _with(F.struct(v.alias("told"), entries(v).alias("entries")), lambda new: without(state, new))
        return F.when(state.done, state).otherwise(_with(named, lambda v: F.when(F.size(v) == 0, stop).otherwise(go(v))))

    held = lambda c: (c["count"] != 0) | (c.key != 0) | (c.check != 0)
    sited = F.transform(cells, lambda c, i: F.struct(F.floor(i / side).cast("int").alias("table"), (i % side).alias("at"), c["count"].alias("count"), c.key.alias("key"), c.check.alias("check")))
    start = F.struct(F.filter(sited, held).alias("cells"), F.array().cast("array<bigint>").alias("told"), F.lit(False).alias("done"))
    side_of = lambda s, k: F.transform(F.filter(s.told, lambda v: v.bitwiseAND(F.lit(1)) == k), lambda v: F.shiftright(v, 1))
    end = lambda s: F.struct(side_of(s, 0).alias("only_first"), side_of(s, 1).alias("only_second"), (F.size(s.cells) == 0).alias("whole"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), TABLES * side), start, lambda s, _: again(s), end)


def _page(a: Column, b: Column) -> Column:
    """struct(only_first, only_second) of one page's digests, by tables that double until all is told."""
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("only_first"), none.alias("only_second"), F.lit(False).alias("whole"), F.lit(PAGE_SIDE).cast("long").alias("side"))

    def attempt(s: Column) -> Column:
        found = peeled(minus(sketch(a, s.side), sketch(b, s.side)), s.side)
        return _with(found, lambda p: F.struct(p.only_first.alias("only_first"), p.only_second.alias("only_second"), p.whole.alias("whole"), (s.side * 2).alias("side")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), start, lambda s, _: F.when(s.whole, s).otherwise(attempt(s)))


def retried(a: Column, b: Column) -> Column:
    """struct(lost, gained): how many digests only ``a`` has and only ``b``, page by page of book by book."""
    both = F.size(a) + F.size(b)
    books = F.greatest(F.ceil(both / (PAGE * BOOK)), F.lit(1)).cast("long")
    start = F.struct(F.lit(0).alias("lost"), F.lit(0).alias("gained"))

    def told(t: Column) -> Column:
        """The sum over books; ``t`` has both sets' digests with the book and page of each."""
        of_book = lambda rows, k: F.filter(rows, lambda e: e.book == k)
        of_page = lambda rows, p: F.transform(F.filter(rows, lambda e: e.page == p), lambda e: e.key)

        def page(s: Column, p: Column, x: Column) -> Column:
            found = _page(of_page(x.a, p), of_page(x.b, p))
            return _with(found, lambda d: F.struct((s.lost + F.size(d.only_first)).alias("lost"), (s.gained + F.size(d.only_second)).alias("gained")))

        def book(s: Column, k: Column) -> Column:
            taken = F.struct(of_book(t.a, k).alias("a"), of_book(t.b, k).alias("b"))
            return _with(taken, lambda x: F.aggregate(F.sequence(F.lit(0).cast("long"), t.pages - 1), s, lambda u, p: page(u, p, x)))

        return F.aggregate(F.sequence(F.lit(0).cast("long"), t.books - 1), start, book)

    def dealt(n: Column) -> Column:
        mark = lambda k: F.struct(k.alias("key"), (_mixed(k, PAGES) % n.books).alias("book"), (F.floor(_mixed(k, PAGES) / n.books) % n.pages).alias("page"))
        return F.struct(F.transform(a, mark).alias("a"), F.transform(b, mark).alias("b"), n.books.alias("books"), n.pages.alias("pages"))

    size = F.struct(books.alias("books"), F.greatest(F.ceil(both / (PAGE * books)), F.lit(1)).cast("long").alias("pages"))
    return _with(size, lambda n: _with(dealt(n), told))


def likeness(a: Column, a_cells: Column, b: Column, b_cells: Column) -> Column:
    """Shared digests over all digests of two sets, by their fingerprints' difference, or by larger tables where that
    leaves something; 1 where neither has any."""
    side = F.lit(SIDE).cast("long")

    def share(d: Column) -> Column:
        union = F.size(a) + d.gained
        return F.when(union == 0, F.lit(1.0)).otherwise((F.size(a) - d.lost) / union)

    first = lambda p: F.when(p.whole, F.struct(F.size(p.only_first).alias("lost"), F.size(p.only_second).alias("gained"))).otherwise(retried(a, b))
    return _with(peeled(minus(a_cells, b_cells), side), lambda p: _with(first(p), share))


def written(cells: Column) -> Column:
    """A fingerprint as text: of every cell the count, the xor of digests and that of check values, in hex."""
    digits = lambda v, n: F.lpad(F.lower(F.hex(v)), n, "0")
    return F.array_join(F.transform(cells, lambda c: F.concat(digits(c["count"], 4), digits(c.key, 15), digits(c.check, 8))), "")


def ranges(keys: DataFrame) -> DataFrame:
    """(one row) ``low``: the least key of each range that Spark's range partitioning makes of (doc_id, hash), ascending.

    Four for each shuffle partition, whatever the size of the keys, for it is texts that are dealt by them.
    """
    n = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(n, "doc_id", "hash").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "hash")).alias("low"))
    return dealt.agg(F.sort_array(F.collect_list("low")).alias("low"))


def neighboured(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own, own_cells, next_text, next, next_cells): each row with its digests and their cells, and those of
    the row that follows it by doc_id and hash; the last has the first after it.

    Rows are dealt into ranges once, by a search in the ranges' least keys; the first rows of a range are also dealt to
    the range before it, as guests that stand behind all others there.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    bounds = store(ranges(keyed.select("doc_id", "hash")), "ibf-ranges")
    with_bounds = keyed.crossJoin(F.broadcast(bounds))  # one row, a key for each partition
    key, n = F.struct("doc_id", "hash"), F.size("low")
    half = lambda s: F.floor((s.low + s.high + 1) / 2).cast("int")
    search = lambda s, _: F.when(s.low >= s.high, s).when(F.get(F.col("low"), half(s)) <= key, F.struct(half(s).alias("low"), s.high.alias("high"))).otherwise(F.struct(s.low.alias("low"), (half(s) - 1).alias("high")))
    place = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int")), F.struct(F.lit(0).alias("low"), (n - 1).cast("int").alias("high")), search, lambda s: s.low)
    found = with_bounds.select("doc_id", "text", "hash", place.alias("range"), (F.get("low", place) == key).alias("opens"), n.alias("n"))
    own, guest = F.struct("range", F.lit(False).alias("guest")), F.struct(F.pmod(F.col("range") - 1, F.col("n")).alias("range"), F.lit(True).alias("guest"))
    dealt = found.select("doc_id", "text", "hash", F.explode(F.when(F.col("opens"), F.array(own, guest)).otherwise(F.array(own))).alias("r")).select("doc_id", "text", "hash", "r.range", "r.guest")
    own = paragraphs(F.col("text"))
    told = dealt.repartition("range").select("doc_id", "text", "hash", "range", "guest", own.alias("own"))
    told = told.select("*", sketch(F.col("own"), F.lit(SIDE).cast("long")).alias("own_cells"))
    follows = F.lead(F.struct(F.col("text").alias("next_text"), F.col("own").alias("next"), F.col("own_cells").alias("next_cells"))).over(Window.partitionBy("range").orderBy("guest", "doc_id", "hash"))
    return told.select("doc_id", "text", "own", "own_cells", "guest", follows.alias("_next")).where("not guest").select("doc_id", "text", "own", "own_cells", "_next.*")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty; an empty text has an empty fingerprint, like 1 to another such and 0 to any other. The next
    document of the last is the first; rows of equal id stand by their text's hash, and rows that repeat whole follow each
    other in one range. An only document follows itself. An empty table gives no rows.
    """
    plain = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    pairs = neighboured(plain)
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    told = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "own_cells", "next", "next_cells", edited.alias("edited"))
    told = told.select("*", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("edited")).alias("changed"))
    told = told.select("*", sketch(F.col("changed"), F.lit(SIDE).cast("long")).alias("changed_cells"))
    near = lambda b: likeness(F.col("own"), F.col("own_cells"), F.col(b), F.col(f"{b}_cells"))
    return told.select("doc_id", "n_chars", "edited_sha256", written(F.col("own_cells")).alias("fingerprint"), written(F.col("changed_cells")).alias("edited_fingerprint"), near("changed").alias("near_edited"), near("next").alias("near_next"))
