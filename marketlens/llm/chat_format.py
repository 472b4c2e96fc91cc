"""Chat formatting with a grammar round trip.

A conversation becomes ``<turn>role\\n<text>text\\n</turn>`` per turn, without anything between. A deterministic parser
reads the result back: an unescaped ``</turn>`` ends a turn, and a control string is escaped if a backslash stands before
it. A turn is rendered as it is, parsed and compared; if what comes back is not the turn, its content is escaped, one
backslash more before each control string with the backslashes it has, and parsed again. Escaped content has no
unescaped control string, and a marker follows a line feed or another marker, so the second round is identical; that is
checked for each turn and once more for each whole conversation, and the job fails rather than return a text that reads
back otherwise. The loss mask lists where the text of the trained role lies in the rendered text.

Defined results: null text and null role are empty; turns are ordered by turn (null first), role, text, and rows that
repeat are turns of their own; a null conv_id is one conversation; an empty table gives an empty result; further columns
are ignored. A conversation is one row, since its rendering is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
CONTROL = "(?:</?turn>|<text>)"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n" + TEXT), text, F.lit("\n" + CLOSE))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of what is rendered; a part that breaks the grammar gives nulls."""
    free = rf"(?<!\\){CONTROL}"

    def turn(part: Column) -> Column:
        at = F.locate("\n" + TEXT, part)
        role = F.substring(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(part, at + len(TEXT) + 1, F.length(part) - at - len(TEXT) - 1)
        sound = part.startswith(OPEN) & part.endswith("\n") & (at > 0) & ~role.rlike(free) & ~text.rlike(free)
        return F.struct(F.when(sound, unescape(role)).alias("role"), F.when(sound, unescape(text)).alias("text"))

    parts = F.split(rendered, rf"(?<!\\){CLOSE}")
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def rendered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered: each turn escaped only if it does not read back as it is."""
    source = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    want = F.array(F.struct("role", "text"))
    tried = source.withColumn("plain", render(F.col("role"), F.col("text")))
    again = tried.withColumn("rendered", F.when(parse(F.col("plain")) == want, F.col("plain")).otherwise(render(escape(F.col("role")), escape(F.col("text")))))
    sound = F.when(parse(F.col("rendered")) == want, F.col("rendered")).otherwise(F.raise_error(F.lit("a turn does not read back")))
    return again.select("conv_id", "turn", "role", "text", sound.alias("rendered"))


def format_conversations(rows: DataFrame, trained: str = TRAINED) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (read back), mask: array<struct<start, length>> in code points."""
    turns = rendered_turns(rows)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum(F.length("rendered")).over(order), F.lit(0)))
    end = F.length("rendered") - len(CLOSE) - 1
    text_at = F.locate("\n" + TEXT, F.col("rendered")) + len(TEXT)
    spans = placed.withColumn("span", F.when(F.col("role") == trained, F.struct((F.col("start") + text_at).alias("start"), (end - text_at).alias("length"))))
    grouped = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start", "rendered", "span"))).alias("t"))
    joined = grouped.select(
        "conv_id", F.array_join(F.col("t.rendered"), "").alias("formatted"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("mask"),
    )
    read = joined.withColumn("turns", parse(F.col("formatted")))
    whole = F.when(F.col("turns") == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back")))
    return read.select("conv_id", whole.alias("formatted"), "turns", "mask")


def masked_text(formatted: str = "formatted", mask: str = "mask") -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(F.col(formatted), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
