"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Word statistics of each text are column expressions inside one row; nothing is exploded or shuffled. A rule compares a
per-mille value with a cutoff. Labelled good documents are the holdout: for each stratum, rule and candidate cutoff
their rejections are counted, and a cutoff is certified if the exact binomial tail P(Bin(n, share) <= k) is at most
``delta`` divided by the number of all tests (Bonferroni over strata, rules and cutoffs). The strictest certified cutoff
is applied. ``alpha`` is split evenly over the rules, so with probability 1 - delta no stratum loses more than the
share ``alpha`` of its good documents. A stratum without enough labels gets no cutoff and keeps what the base rule keeps.

Defined results: null text has no words and fails the base rule; a null stratum is a stratum of its own; of conflicting
labels of a document the worst counts, null labels count for nothing; rows that repeat are judged alike; an empty table
gives an empty result; without labels only the base rule rejects; further columns are returned unchanged by ``apply``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import WORD, staged, text_key, whole_text

ALPHA, DELTA, WINDOW = 0.02, 0.05, 5
#: Per rule: numerator, denominator, candidate cutoffs of 1000 * numerator / denominator, strictest first.
RULES = {
    "symbols": ("n_symbols", "word_chars", (20, 30, 50, 80, 120, 180, 250, 350)),
    "capitals": ("n_capitals", "word_chars", (60, 90, 130, 180, 250, 350, 500, 700)),
    "dup_lines": ("n_dup_lines", "n_lines", (150, 200, 250, 300, 400, 500, 600, 800)),
    "long_words": ("word_chars", "n_words", (7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000)),
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(pattern: str) -> Column:
    """Characters of the text that the negated class ``pattern`` leaves."""
    return F.length(F.regexp_replace(F.col("_text"), pattern, "")).cast("long")


def word_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and, per row, the counts of STATS with n_lines and n_capitals. Repeats are found on 64-bit hashes of windows."""
    size = lambda name: F.size(name).cast("long")
    n_windows = f"greatest(size(_h) - {WINDOW - 1}, 0)"
    shifted = ", ".join(f"slice(_h, {j + 1}, {n_windows})" for j in range(WINDOW))
    counted = (
        docs.select(*keep, whole_text().alias("_text"))
        .select(
            *keep,
            _count(r"[^#*$%&|<>]+").alias("n_symbols"),
            _count(r"[^A-Z]+").alias("n_capitals"),
            F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
            F.regexp_extract_all("_text", F.lit(WORD), 0).alias("_words"),
        )
        .select(
            *keep, "n_symbols", "n_capitals", "_lines",
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
        )
        .select(
            *keep, "word_chars", "n_symbols", "n_capitals", size("_h").alias("n_words"), size("_lines").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.expr(f"transform(arrays_zip({shifted}), w -> xxhash64(w))").alias("_win"),
        )
    )
    names = [*keep, "word_chars", "n_symbols", "n_capitals", "n_words", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    placed = counted.select(*names, F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_at"))
    twice = F.expr("transform(filter(transform(_at, (x, i) -> if(x.h = get(_at, i - 1).h or x.h = get(_at, i + 1).h, x.i, null)), p -> p is not null), p -> p)")
    found = placed.select(*names, F.sort_array(twice).alias("_p"))
    covered = F.expr(f"aggregate(transform(_p, (p, i) -> least({WINDOW}, coalesce(get(_p, i + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)")
    return found.select(*names, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_value(rule: str) -> Column:
    """1000 * numerator / denominator, rounded down; 0 without a denominator."""
    top, bottom, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.expr(f"1000 * {top} div {bottom}")).otherwise(F.lit(0).cast("long"))


def binomial_tail(n: str, k: str, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms. From k = np on it is about a half or more, and given as 1."""
    n_, odds, none = F.col(n).cast("double"), math.log(p) - math.log1p(-p), F.col(n) * math.log1p(-p)

    def add(total: Column, j: Column) -> Column:
        term = total["term"] + F.log((n_ - j + 1) / j) + odds
        return F.struct(term.alias("term"), (F.greatest(total["sum"], term) + F.log1p(F.exp(-F.abs(total["sum"] - term)))).alias("sum"))

    summed = F.aggregate(F.sequence(F.lit(1), F.col(k).cast("int")), F.struct(none.alias("term"), none.alias("sum")), add, lambda total: F.exp(total["sum"]))
    return F.when(F.col(k) >= n_ * p, F.lit(1.0)).when(F.col(k) == 0, F.exp(none)).otherwise(summed)


def certified_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum one row: stratum and cut_<rule>, the strictest certified cutoff or null."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1 and doc_id is not null").select(F.col("doc_id").alias("_id"))
    held = stats.filter(~base_failed()).join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    cuts = [(r, c) for r, (_, _, grid) in RULES.items() for c in grid]
    over = [F.sum((rule_value(r) > c).cast("long")).alias(f"{r}_{c}") for r, c in cuts]
    counts = held.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *over)
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.col(f"{r}_{c}").alias("k")) for r, c in cuts]
    counted = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))
    each = counted.select(stratum, "n", "strata", F.inline(F.array(*tests)))
    certified = each.filter(binomial_tail("n", "k", alpha / len(RULES)) <= F.lit(delta) / (len(cuts) * F.col("strata")))
    return certified.groupBy(stratum).agg(*[F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", extra: tuple[str, ...] = (), alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the stratum, ``extra``, the statistics, base_failed and kept, one row per row of docs."""
    named = docs.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    stats = staged(word_statistics(named, ["doc_id", "_stratum", *extra]), "word-statistics")
    cuts = staged(certified_cutoffs(stats, labels, "_stratum", alpha, delta), "cutoffs")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(rule_value(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return stats.join(cuts, "_stratum", "left").select(
        "doc_id", *extra, *STATS, base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept")
    )


def apply(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows that pass, all columns as they came."""
    judged = judge(docs.withColumn("_hash", text_key()), labels, stratum, ("_hash",))
    stay = judged.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("_hash").alias("_kept_hash"))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_kept_id"]) & (text_key() == stay["_kept_hash"]), "left_semi")
