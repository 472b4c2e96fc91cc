"""License scan by diagonal voting.

All rolling word k-grams of a text are hashed and joined with the hashed k-grams of the templates, a table of fixed size
that is broadcast. A hit is kept only if its words are the template's words, so hashes decide nothing. Hits are counted
by diagonal, text position minus template position; a diagonal is merged with those up to ``DRIFT`` words above it, as inserted or lost words
make them. So a span is never longer than its template by more than that, and it is verified: going up the template, only k-grams that
lie behind all earlier ones in the text count. A span is a license if these are enough of its template's k-grams. A phrase must lie on
one diagonal whole. The text is split once, and only hits and one marker row per document are shuffled.

Defined results: null text has no words; letters A-Z are lower-cased, other letters never match a template; a document
without hits has empty labels, null places and score 0; rows that repeat are scanned alike, each giving its own row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import whole_text

#: Phrases whose every place counts, and public license sentences, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a k-gram, words by which a span may drift in all, share of a template's k-grams that makes a license.
GRAM, DRIFT, SHARE = 3, 4, 0.8
#: K-grams of templates that are broadcast; a caller's larger set of templates is joined as Spark sees fit.
BROADCAST_GRAMS = 100_000
#: Lower-casing makes this letter a k, which it is not here.
KELVIN, OTHER = "K", "κ"


def _hashes(words: str) -> Column:
    n = f"greatest(size({words}) - {GRAM - 1}, 0)"
    shifted = ", ".join(f"slice({words}, {j + 1}, {n})" for j in range(GRAM))
    return F.expr(f"transform(arrays_zip({shifted}), g -> xxhash64(g))")


def template_grams(spark, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """One row per k-gram of a template: h, gram, template, label, exact, grams (of its template), at; and the marker row."""
    texts = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for t, label in templates.items()]
    rows = [(n, text.split(" "), label, exact) for n, (text, label, exact) in enumerate(texts)]
    named = spark.createDataFrame(rows, "template int, words array<string>, label string, exact boolean").withColumn("hs", _hashes("words"))
    grams = named.select("template", "label", "exact", F.size("hs").alias("grams"), "words", F.posexplode("hs").alias("at", "h"))
    marker = spark.range(1).select(
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("exact"), F.lit(0).alias("grams"),
        F.lit(0).alias("at"), F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("gram"),
    )
    return grams.select("template", "label", "exact", "grams", "at", "h", F.array_join(F.slice("words", F.col("at") + 1, GRAM), " ").alias("gram")).unionByName(marker)


def spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One span per diagonal hit, with those above it: row, doc_id, n_words, template, label, exact, share, start and end word; one marker span per row."""
    lowered = F.lower(F.replace(whole_text(), F.lit(KELVIN), F.lit(OTHER)))
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(lowered, F.lit(WORDS), 0).alias("words"))
    hashed = words.withColumn("hs", F.concat(F.array(F.lit(0).cast("long")), _hashes("words")))
    placed = hashed.select("row", "doc_id", "words", F.posexplode("hs").alias("pos", "h"))
    grams = template_grams(docs.sparkSession, phrases, templates)
    if sum(len(t.split(" ")) for t in [*phrases, *templates]) <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    marker = (F.col("pos") == 0) & (F.col("template") == -1)
    equal = (F.col("pos") > 0) & (F.array_join(F.slice("words", F.greatest("pos", F.lit(1)), GRAM), " ") == F.col("gram"))
    hits = (
        placed.join(grams, "h").filter(marker | equal)
        .select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "template", "label", "exact", "grams", "at", (F.col("pos") - 1 - F.col("at")).alias("diagonal"))
        .repartition("row")
    )
    voted = hits.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "grams", "diagonal").agg(F.collect_set("at").alias("ats"))
    above = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    own = F.transform("ats", lambda a: F.struct(a.alias("at"), (a + F.col("diagonal")).alias("pos")))
    merged = voted.withColumn("own", own).withColumn("hits", F.when(F.col("exact"), F.col("own")).otherwise(F.flatten(F.collect_list("own").over(above))))
    found = merged.withColumn("chain", F.aggregate(F.array_sort("hits"), _no_chain(), _longer))
    return found.select(
        "row", "doc_id", "n_words", "template", "label", "exact", "grams", F.col("chain.covered").alias("covered"),
        F.col("chain.first").cast("long").alias("start"), (F.col("chain.last") + GRAM).cast("long").alias("end"),
        F.when(F.col("template") >= 0, F.col("chain.covered") / F.col("grams")).alias("share"),
    )


def _no_chain() -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in (("at", -1), ("first", None), ("last", -1), ("covered", 0))]).cast("struct<at: int, first: int, last: int, covered: int>")


def _longer(chain: Column, hit: Column) -> Column:
    """One more k-gram in the order of the template, then of the text: it counts if it is new and lies behind all before it."""
    counts = (hit["at"] > chain["at"]) & (hit["pos"] > chain["last"])
    return F.struct(
        hit["at"].alias("at"), F.coalesce(chain["first"], hit["pos"]).alias("first"),
        F.when(counts, hit["pos"]).otherwise(chain["last"]).alias("last"), (chain["covered"] + counts.cast("int")).alias("covered"),
    )


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("exact") & (F.col("covered") == F.col("grams"))
    license_ = base | (~F.col("exact") & (F.col("template") >= 0) & (F.col("share") >= SHARE))

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return spans(docs, phrases, templates).groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(license_).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")
