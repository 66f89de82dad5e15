"""Quality rules with adaptive cutoffs: mergeable quantile sketches per language and source, then a joined filter.

A sketch holds, for one measure, the number of rows in each bucket ceil(log_g(value)), so any quantile is known to a
relative error of RELATIVE_ERROR. Sketches merge by adding counts: a row's bucket is added up map-side, the sketch of a
language is the sum of its sources' sketches, and the result does not depend on the order of merging.

A group's quartiles are drawn towards its language's, and those towards all rows', as if PRIOR rows more had been seen
there, so groups of any size are judged alike. A row is kept if each measure lies within REACH quartile distances of the
group's quartiles, give or take what chance alone does to a text of the row's own length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, store, words_of

RELATIVE_ERROR = 0.01
GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
#: Values up to this are counted as zero.
TINY = 1e-6
ZERO_BUCKET = -2_000_000
#: Rows that a group's parent counts for when quartiles are drawn together.
PRIOR = 100
#: Quartile distances beyond a quartile at which a measure is out of its group's range.
REACH = 4.0
#: Least quartile distance, for groups whose quartiles are equal.
LEAST = 0.01
#: Measure: (whether its low side is judged too, what chance may add: this over that column, or over its root).
MEASURES = {
    "symbols_per_word": (False, 4.0, "n_words"),
    "exclaims_per_word": (False, 4.0, "n_words"),
    "dup_line_share": (False, 2.0, "n_lines"),
    "repeat_share": (False, 32.0, "n_words"),
    "upper_share": (False, 6.0, "word_chars"),
    "mean_word_chars": (True, 3.0, "root"),
    "short_word_share": (True, 0.6, "root"),
    "distinct_word_share": (True, 0.6, "root"),
}


def _stripped_length(text: str, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` columns plus the counts of the base rules and the measures that are judged, JVM-side.

    Windows of eight words are compared by 64-bit hashes chained from the words' hashes.
    """

    def paired(col: str, step: int, n: Column) -> Column:
        m = F.greatest(n - step, F.lit(0))
        return F.zip_with(F.slice(col, 1, m), F.slice(col, 1 + step, m), lambda a, b: F.xxhash64(a, b))

    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select("*", text.alias("_text"))
    step = step.select("*", words_of(F.col("_text")).alias("_w"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    step = step.select("*", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"))
    step = step.select("*", paired("_h1", 1, F.size("_h1")).alias("_h2"))
    step = step.select("*", paired("_h2", 2, F.size("_h2")).alias("_h4"))
    step = step.select("*", paired("_h4", 4, F.size("_h4")).alias("_h8"))
    step = step.select("*", F.when(F.size("_h8") > F.size(F.array_distinct("_h8")), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    m = F.size("_s") - 1
    step = step.select("*", F.when(F.col("_s").isNotNull(), F.zip_with(F.slice("_s", 1, m), F.slice("_s", 2, m), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.expr("array()").cast("array<int>")))).alias("_p"))
    step = step.select("*", F.sort_array(F.array_distinct(F.flatten("_p"))).alias("_at"))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate("_at", start, lambda a, p: F.struct((a.total + p + 8 - F.greatest(p, a.end)).alias("total"), (p + 8).alias("end")), lambda a: a.total)
    counts = step.select(
        *docs.columns, "n_words", "word_chars",
        _stripped_length("_text", "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"), _stripped_length("_text", "!").alias("_exclaims"), _stripped_length("_text", "A-Z").alias("_upper"),
        F.size(F.filter("_w", lambda w: F.length(w) <= 3)).alias("_short"), F.size(F.array_distinct("_w")).alias("_distinct"), _stripped_length("_text", ".").alias("_stops"),
    )
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    measures = {
        "symbols_per_word": F.col("n_symbols") / words, "exclaims_per_word": F.col("_exclaims") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)), "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("_upper") / chars, "mean_word_chars": F.col("word_chars") / words, "short_word_share": F.col("_short") / words,
        "distinct_word_share": F.col("_distinct") / words,
        "stops_per_word": F.col("_stops") / words, "words_per_line": F.col("n_words") / F.greatest("_n_lines", F.lit(1)), "log_words": F.log1p("n_words"),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.select(*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("_n_lines").alias("n_lines"), failed.alias("base_failed"), *[v.alias(k) for k, v in measures.items()])


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n) over rows that pass the base rules; level 0 group, 1 language, 2 all."""
    bucket = lambda v: F.when(v > TINY, F.ceil(F.log(v) / math.log(GAMMA))).otherwise(ZERO_BUCKET).cast("int")
    cells = measured.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.col(k)).alias("bucket")) for k in MEASURES])).alias("c"))
    fine = cells.groupBy("lang", "source", "c.measure", "c.bucket").agg(F.count("*").alias("n"))
    fine = store(fine, "sketch")
    none = F.lit(None).cast("string")
    mid = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    top = fine.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    return (
        fine.select(F.lit(0).alias("level"), "lang", "source", "measure", "bucket", "n")
        .unionByName(mid.select(F.lit(1).alias("level"), "lang", none.alias("source"), "measure", "bucket", "n"))
        .unionByName(top.select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "measure", "bucket", "n"))
    )


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, measure, rows, q1, q3) of each sketch."""
    group = ["level", "lang", "source", "measure"]
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))
    rows = F.sum("n").over(Window.partitionBy(*group))
    value = F.when(F.col("bucket") == ZERO_BUCKET, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    ranked = sketch.select(*group, value.alias("value"), upto.alias("upto"), rows.alias("rows"))
    first_at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("value")))
    return ranked.groupBy(*group).agg(F.first("rows").alias("rows"), first_at(0.25).alias("q1"), first_at(0.75).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>) of every group."""
    found = store(quartiles(sketch), "quartiles")
    names = ("rows", "q1", "q3")
    level = lambda k, prefix, *keys: found.where(F.col("level") == k).select(*[F.col(c).alias(prefix + c) for c in (*keys, "measure", *names)])
    own, up, top = level(0, "g_", "lang", "source"), level(1, "l_", "lang"), level(2, "a_")
    met = own.join(up, F.col("g_lang").eqNullSafe(F.col("l_lang")) & (F.col("g_measure") == F.col("l_measure"))).join(top, F.col("g_measure") == F.col("a_measure"))
    for q in ("q1", "q3"):
        met = met.withColumn(q, (F.col("l_rows") * F.col(f"l_{q}") + PRIOR * F.col(f"a_{q}")) / (F.col("l_rows") + PRIOR))
        met = met.withColumn(q, (F.col("g_rows") * F.col(f"g_{q}") + PRIOR * F.col(q)) / (F.col("g_rows") + PRIOR))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST))
    cells = []
    for k, (two_sided, *_) in MEASURES.items():
        here = F.col("g_measure") == k
        cells.append(F.max(F.when(here, F.col("q3") + reach)).alias(f"high_{k}"))
        cells.append(F.max(F.when(here, F.col("q1") - reach if two_sided else F.lit(float("-inf")))).alias(f"low_{k}"))
    return met.groupBy("g_lang", "g_source").agg(*cells)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false for rows that fail the base rules and for rows with a measure outside the range of their language and
    source. Null languages and sources are groups of their own; where no row of a group passes the base rules, none is
    kept. Null texts have no words. Ties and repeated rows count like any others; an empty table gives no rows.
    """
    plain = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"), quoted(lang_col).cast("string").alias("lang"), quoted(source_col).cast("string").alias("source"))
    measured = store(base_measures(plain).drop("text"), "measures")
    limits = store(thresholds(sketches(measured)), "limits")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for k, (_, chance, per) in MEASURES.items():
        room = chance / (F.sqrt(F.greatest("n_words", F.lit(1))) if per == "root" else F.greatest(per, F.lit(1)))
        inside = inside & (F.col(k) >= F.col(f"low_{k}") - room) & (F.col(k) <= F.col(f"high_{k}") + room)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
