"""What each of several filters removes, alone, in every order and on average over the orders.

Filters drop documents; what one removes depends on those before it. The removal game of a part of the corpus gives each
coalition of filters the number of documents that at least one of them drops. All follows from this game: a step of an
order removes the difference of two coalitions, and the Shapley value of a filter is a difference of Hart-Mas-Colell
potentials. The potential is P(S) = (v(S) + sum of P(S without i) over i in S) / |S| with P() = 0; multiplied by |S|! it is a
recursion over integers, one value per coalition, and the Shapley value is P(all) - P(all without i).

A document is reduced to its part, four flags and the digest of its text. Same texts fail alike but for the copy filter,
so documents are counted per (part, flags, label), and so are those that have the smallest doc_id of their text, found by a
minimum that combines before its shuffle and met again on (digest, doc_id), a key that no group of copies makes hot. The rest are
the copies. What is left are 32 counts per part, and every later step is an expression on one row per part.

Defined results: null text counts as empty (it fails the filter on few words and no other, unless an equal text has a smaller
id); null source is the part ''; a null doc_id is larger than all others and has no label; rows that repeat doc_id and text are no
copies of each other; a document is good (toxic) if one of its label rows says so; a part without failures has rows of
zeros; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import SPACE_CLASS, staged, whole_text

#: Filters by bit. The last one looks at other documents.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = r"[#$%&*|]"
ALL = (1 << len(FILTERS)) - 1
COPY = 1 << (len(FILTERS) - 1)


def own_failures() -> Column:
    """Bits of the filters that a document fails by its own text, from columns text, words."""
    n = F.size("words")
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n,
        100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) > CAPITAL_PERCENT * F.length("text"),
        F.col("text").rlike(SYMBOLS),
    ]
    bits = [F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(fails)]
    return sum(bits[1:], bits[0])


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, own (bits of filters A to D), digest of the text."""
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    text = docs.select("doc_id", part, whole_text().alias("text"))
    split = text.select("doc_id", "part", "text", F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != "").alias("words"))
    return split.select("doc_id", "part", own_failures().alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1). Rows without an id, however many, do not take part in the join."""
    says = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(*says)
    named = rows.filter("doc_id is not null").join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return named.unionByName(rows.filter("doc_id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})).fillna(0, ["good", "toxic"])


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of all filters that a document fails), n, good, toxic: documents, those labelled good, those toxic."""
    rows = staged(labelled(profiles(docs), labels), "profiles")
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("f")).select("digest", F.col("f.doc_id").alias("_first"))
    once = rows.groupBy("digest", "doc_id", "part", "own", "good", "toxic").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("digest", "_digest")
    leaders = once.join(first, (F.col("_digest") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    keys = ["part", "own", "good", "toxic"]
    every = rows.groupBy(keys).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("lead"))
    lead = leaders.groupBy(keys).agg(F.lit(0).cast("long").alias("n"), F.sum("n").alias("lead"))
    counted = every.unionByName(lead).groupBy(keys).agg(F.sum("n").alias("n"), F.sum("lead").alias("lead"))
    cases = F.array(F.struct(F.col("own").alias("mask"), F.col("lead").alias("n")), F.struct((F.col("own") + COPY).alias("mask"), (F.col("n") - F.col("lead")).alias("n")))
    each = counted.select("part", "good", "toxic", F.explode(cases).alias("c"))
    sums = [F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic")]
    return each.groupBy("part", F.col("c.mask").alias("mask")).agg(*sums)


def coalition_values(counts: str, game: str) -> Column:
    """From a map of mask to counts: per coalition, by its bits, the documents that at least one of its filters drops."""

    def dropped(coalition: Column) -> Column:
        hit = F.filter(F.map_entries(counts), lambda e: e["key"].bitwiseAND(coalition) != 0)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda total, e: total + e["value"][game])

    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), dropped)


def potentials(values: str) -> Column:
    """From the values of all coalitions: |S|! times the Hart-Mas-Colell potential of each coalition S, by its bits.

    A coalition without one of its members has a smaller number, so one pass in the order of numbers is the recursion.
    """
    weights = F.array(*[F.lit(math.factorial(max(size - 1, 0))).cast("long") for size in range(len(FILTERS) + 1)])

    def extend(known: Column, coalition: Column) -> Column:
        without = [F.when(coalition.bitwiseAND(F.lit(1 << bit)) != 0, F.get(known, coalition.bitwiseXOR(F.lit(1 << bit)))).otherwise(0) for bit in range(len(FILTERS))]
        own = F.get(weights, F.bit_count(coalition)) * F.get(F.col(values), coalition)
        return F.concat(known, F.array(own + sum(without[1:], without[0])))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), extend)


def games(counts: DataFrame) -> DataFrame:
    """One row per part: total, the values of all coalitions for all, good and toxic documents, and the potentials."""
    entries = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # at most 32 entries
    per_part = counts.groupBy("part").agg(entries.alias("m"), F.sum("n").alias("total"))
    games_of = ("n", "good", "toxic")
    valued = per_part.select("part", "total", *[coalition_values("m", name).alias(name) for name in games_of])
    return valued.select("*", potentials("n").alias("potential"))


def steps(rows: DataFrame) -> DataFrame:
    """Each row once per order and step: adds filter_order, step, and the coalitions before and after it."""
    every = F.split(F.lit(" ".join("".join(o) for o in itertools.permutations(FILTERS))), " ")
    ordered = rows.select("*", F.explode(every).alias("filter_order"))
    stepped = ordered.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)

    def coalition(names: Column) -> Column:
        bits = [F.when(names.contains(name), 1 << bit).otherwise(0) for bit, name in enumerate(FILTERS)]
        return sum(bits[1:], bits[0])

    return stepped.withColumns({"before": coalition(earlier), "after": coalition(F.substring("filter_order", F.lit(1), F.col("step")))})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` is the sum over all orders of what the filter of the step removes: the Shapley value times the number of orders.
    """
    rows = steps(games(failure_counts(docs, labels)))

    def value(game: str, coalition: Column) -> Column:
        return F.get(F.col(game), coalition)

    def gain(game: str) -> Column:
        return value(game, F.col("after")) - value(game, F.col("before"))

    alone = F.col("after") - F.col("before")
    others = F.lit(ALL).bitwiseXOR(alone)
    scale = len(FILTERS)  # |all|! / |all without one|!
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - value("n", F.col("after"))).alias("kept"),
        gain("n").alias("removed"),
        (value("n", alone) - gain("n")).alias("redundant"),
        (value("n", F.lit(ALL)) - value("n", others)).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (value("potential", F.lit(ALL)) - scale * value("potential", others)).alias("shapley"),
    )
