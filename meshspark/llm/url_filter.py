"""URL filters: allow and block rules, and a character language-model ratio for the rest, JVM-side throughout.

Rules are matched by looking up every suffix of the host in a map of the rules. URLs that a rule judges train two
variable-order Markov models, of accepted and of rejected URLs: counts of every character after contexts of up to ORDER
characters, smoothed by interpolation with the next shorter context. An n-gram or context stays in the model if it makes
up at least 1/NODES of its order's counts in either class, so an order keeps at most 2 * NODES of them however large the
input; each position is judged by the longest n-gram that stayed and the back-off weights of the longer contexts that
did. With ``nodes=None`` all stay and the models are joined by shuffles. The mean over positions of the log-likelihood
difference is compared with the cutoff that best separates the two classes among judged URLs held out of training.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, store

#: Longest n-gram: a character and ORDER characters before it.
ORDER = 4
#: Reciprocal of the least share of an order's counts that an n-gram needs to stay.
NODES = 1 << 14
#: Weight of the shorter context's estimate, in counts.
WEIGHT = 4.0
#: Characters are smoothed against this many equally likely ones.
ALPHABET = 1 << 8
#: Cells of the calibration histogram, per nat.
CELLS = 100
#: Characters before and after a URL.
BEGIN, END = "\x02", "\x03"

Rule = tuple[str, str, str]  # verdict, host, path


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path. Null or no ``://``: both empty."""
    rest = F.when(F.locate("://", F.col("_url")) > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")
    held = pages.withColumn("_url", F.coalesce(F.col(url_col).cast("string"), F.lit(""))).withColumn("_rest", rest)
    host = F.translate(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return held.withColumn("host", host).withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))


def match_rules(split: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``split`` with rule (host and path of the longest rule that fits, else null) and rule_verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of equal length the one
    listed first wins.
    """
    if not rules:
        return split.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    by_host: dict[str, list[Column]] = {}
    for place, (verdict, host, path) in enumerate(rules):
        entry = F.struct(F.lit(len(host + path)).alias("size"), F.lit(-place).alias("place"), F.lit(host + path).alias("rule"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict"))
        by_host.setdefault(host, []).append(entry)
    known = F.create_map(*[x for host, entries in by_host.items() for x in (F.lit(host), F.array(*entries))])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull()))
    found = F.array_max(F.filter(fitting, lambda r: F.startswith(F.col("path"), r.path)))
    return split.withColumn("_found", found).withColumn("rule", F.col("_found.rule")).withColumn("rule_verdict", F.col("_found.verdict")).drop("_found")


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns plus gram, for each position of each URL the ORDER characters before it and its own."""
    text = F.concat(F.lit(BEGIN * ORDER), F.col("model_text"), F.lit(END))
    held = urls.select(*keep, text.alias("_t"))
    places = held.select(*keep, "_t", F.explode(F.sequence(F.lit(1), F.length("_t") - ORDER)).alias("_at"))
    return places.select(*keep, F.substring("_t", F.col("_at"), F.lit(ORDER + 1)).alias("gram"))


def train(judged: DataFrame, nodes: int | None = NODES) -> tuple[list[DataFrame], list[DataFrame], float]:
    """(models, contexts, start): for n = 1..ORDER+1 a table (gram, ratio), log accepted minus log rejected probability of
    its last character; for m = 1..ORDER a table (context, back), what the ratio gains where a context is known and the
    character after it is not; and the same for the empty context.

    ``judged`` has model_text and accepted (boolean).
    """
    counts = grams(judged, "accepted").groupBy("gram").agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    full = store(counts, "grams")
    totals = full.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    least_a, least_r = (max(2.0, t / nodes) if nodes else 1.0 for t in totals)
    tables, contexts, shorter = [], [], None
    for n in range(1, ORDER + 2):
        own = full.groupBy(F.substring("gram", -n, n).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.expr(f"substring(gram, 1, {n - 1})")
        before = full.groupBy(F.expr(f"substring(gram, {ORDER + 2 - n}, {n - 1})").alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        kept = own.where((F.col("a") >= least_a) | (F.col("r") >= least_r)).withColumn("context", context).join(before, "context")
        if shorter is None:
            joined = kept.withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pr", F.lit(1.0 / ALPHABET))
        else:
            down = shorter.select(F.col("gram").alias("tail"), "pa", "pr")
            joined = kept.withColumn("tail", F.expr("substring(gram, 2)")).join(down, "tail")
            known = before.where((F.col("ca") >= least_a) | (F.col("cr") >= least_r))
            contexts.append(store(known.select("context", F.log((F.col("cr") + WEIGHT) / (F.col("ca") + WEIGHT)).alias("back")), f"contexts{n - 1}"))
        estimate = lambda c, total, p: (F.col(c) + WEIGHT * F.col(p)) / (F.col(total) + WEIGHT)
        shorter = store(joined.select("gram", estimate("a", "ca", "pa").alias("pa"), estimate("r", "cr", "pr").alias("pr")), f"model{n}")
        tables.append(shorter.select("gram", (F.log("pa") - F.log("pr")).alias("ratio")))
    return tables, contexts, math.log((totals[1] + WEIGHT) / (totals[0] + WEIGHT))


def score(urls: DataFrame, model: tuple[list[DataFrame], list[DataFrame], float], key: str, bounded: bool = True) -> DataFrame:
    """(key, ratio): the mean over positions of the log-likelihood difference.

    Tables that are ``bounded`` have at most 2 * NODES rows each by construction, so they are broadcast.
    """
    tables, contexts, start = model
    places = grams(urls, key)
    hint = F.broadcast if bounded else lambda df: df
    for n in range(len(tables), 0, -1):
        right = tables[n - 1].select(F.col("gram").alias(f"_g{n}"), F.col("ratio").alias(f"_r{n}"))
        places = places.join(hint(right), F.substring("gram", -n, n) == F.col(f"_g{n}"), "left")
    for m in range(1, len(tables)):
        right = contexts[m - 1].select(F.col("context").alias(f"_c{m}"), F.col("back").alias(f"_b{m}"))
        places = places.join(hint(right), F.expr(f"substring(gram, {len(tables) - m}, {m})") == F.col(f"_c{m}"), "left")

    def longer(n: int) -> Column:
        total = F.col(f"_r{n}") if n else F.lit(start)
        for m in range(max(n, 1), len(tables)):
            total = total + F.coalesce(F.col(f"_b{m}"), F.lit(0.0))
        return total

    best = F.coalesce(*[longer(n) for n in range(len(tables), -1, -1)])
    return places.groupBy(key).agg(F.avg(best).alias("ratio"))


def held_out(text: Column) -> Column:
    """Whether a judged URL is left to the calibration: 3 of 16 by the text's hash, all copies alike."""
    return F.substring(F.md5(text.cast("binary")), 1, 1).isin("0", "1", "2")


def calibrate(scored: DataFrame) -> float:
    """The cutoff with the least sum of the two classes' error rates; of equal ones the lowest. 0 where a class is empty.

    ``scored`` has ratio and accepted; only a histogram of fixed size reaches the driver.
    """
    cell = F.least(F.greatest(F.floor(F.col("ratio") * CELLS), F.lit(-20 * CELLS)), F.lit(20 * CELLS)).cast("int")
    cells = scored.groupBy(cell.alias("cell")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")).orderBy("cell").collect()
    accepted, rejected = sum(c.a for c in cells), sum(c.r for c in cells)
    if not accepted or not rejected:
        return 0.0
    lost, passed, best, cutoff = 0, rejected, rejected / rejected, cells[0].cell
    for c in cells:
        lost, passed = lost + c.a, passed - c.r
        if lost / accepted + passed / rejected < best - 1e-12:
            best, cutoff = lost / accepted + passed / rejected, c.cell + 1
    return cutoff / CELLS


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", nodes: int | None = NODES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, ratio.

    A null URL or one without ``://`` has empty host and path and is modelled as the empty text; ratio is null only where
    a rule decides. Without held-out URLs of both kinds the cutoff is 0, without judged URLs every ratio is 0 and the
    verdict is allow. Repeated rows and ids each get a row, null ids too. An empty table gives no rows.
    """
    split = split_url(pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url")), "url")
    parts = match_rules(split, rules).withColumn("model_text", F.concat("host", F.expr("substring(_rest, length(host) + 1)")))
    known = store(parts.select("page_id", "host", "path", "rule", "rule_verdict", "model_text").withColumn("_row", F.monotonically_increasing_id()), "urls")
    judged = known.where(F.col("rule").isNotNull()).withColumn("accepted", F.col("rule_verdict") == "allow")
    held = held_out(F.col("model_text"))
    model = train(judged.where(~held), nodes)
    scored = store(score(known, model, "_row", nodes is not None), "ratios")
    cutoff = calibrate(judged.where(held).select("_row", "accepted").join(scored, "_row"))
    both = known.join(scored, "_row")
    verdict = F.coalesce("rule_verdict", F.when(F.col("ratio") >= cutoff, "allow").otherwise("block"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("ratio")).alias("ratio"))
