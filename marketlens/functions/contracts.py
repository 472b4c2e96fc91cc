"""Contract bounds: membership, labels, winners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strike wording of the venue and the shape it means.
STRIKE_SHAPES = {"between": "bucket", "less": "below", "greater": "above"}


def shape_of_strike(strike: Column) -> Column:
    text = F.lower(strike)
    out = text
    for word, shape in STRIKE_SHAPES.items():
        out = F.when(text == word, F.lit(shape)).otherwise(out)
    return out


def strike_of_shape(shape: Column) -> Column:
    text = F.lower(shape)
    out = text
    for word, name in STRIKE_SHAPES.items():
        out = F.when(text == name, F.lit(word)).otherwise(out)
    return out


def contains(
    shape: Column, lower: Column, upper: Column, value: Column, *, inclusive: bool = False, on_bad: str = "null"
) -> Column:
    """Whether a value settles a contract to yes.

    Tails are strict unless ``inclusive``. A shape without its bound gives null, false or an error
    (``on_bad``).
    """
    below = value <= upper if inclusive else value < upper
    above = value >= lower if inclusive else value > lower
    inside = (value >= lower) & (value <= upper)
    name = F.lower(shape)
    if on_bad == "error":
        bad = F.raise_error(F.concat(F.lit("contract without its bounds: "), F.coalesce(shape, F.lit("?")))).cast("boolean")
    else:
        bad = F.lit(None).cast("boolean") if on_bad == "null" else F.lit(False)
    return (
        F.when((name == "below") & upper.isNotNull(), below)
        .when((name == "above") & lower.isNotNull(), above)
        .when((name == "bucket") & lower.isNotNull() & upper.isNotNull(), inside)
        .otherwise(bad)
    )


def boundary_distance(lower: Column, upper: Column, value: Column) -> Column:
    """Least distance to a bound that exists."""
    return F.least(F.abs(value - lower), F.abs(value - upper))


def flips(official: Column, other: Column) -> Column:
    """Three-valued: null where either winner is unknown."""
    return official != other


_NUM = r"(-?\d+(?:\.\d+)?)"
#: The label wordings that name a bucket, a lower and an upper tail.
BUCKET_LABEL = rf"(?i){_NUM}\s*(?:to|–|-)\s*{_NUM}"
BELOW_LABEL = rf"(?i){_NUM}\s*(?:°?F)?\s*or\s*below|(?:less than or equal to|<=)\s*{_NUM}"
ABOVE_LABEL = rf"(?i){_NUM}\s*(?:°?F)?\s*or\s*above|(?:greater than or equal to|>=)\s*{_NUM}"


def parse_label(label: Column) -> Column:
    """Struct (shape, lower, upper) of an outcome label; all null where no wording fits."""

    def group(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(label, pattern, i), F.lit("")).cast("double")

    def one(pattern: str) -> Column:
        return F.coalesce(group(pattern, 1), group(pattern, 2))

    none = F.lit(None).cast("double")
    bucket, below, above = label.rlike(BUCKET_LABEL), label.rlike(BELOW_LABEL), label.rlike(ABOVE_LABEL)
    return F.struct(
        F.when(bucket, "bucket").when(below, "below").when(above, "above").alias("shape"),
        F.when(bucket, group(BUCKET_LABEL, 1)).when(below, none).when(above, one(ABOVE_LABEL)).alias("lower"),
        F.when(bucket, group(BUCKET_LABEL, 2)).when(below, one(BELOW_LABEL)).otherwise(none).alias("upper"),
    )


def display_label(shape: Column, lower: Column, upper: Column) -> Column:
    return (
        F.when(shape == "below", F.concat(F.lit("<"), upper.cast("string")))
        .when(shape == "above", F.concat(F.lit(">"), lower.cast("string")))
        .when(shape == "bucket", F.concat_ws("-", lower.cast("string"), upper.cast("string")))
        .otherwise(shape)
    )


def terminal_outcome(outcomes: Column, prices: Column, closed: Column) -> Column:
    """Name of the single outcome priced at one while all others are at zero, else null."""
    winners = F.filter(F.sequence(F.lit(0), F.size(prices) - 1), lambda i: F.get(prices, i) >= 0.999)
    losers_ok = F.forall(prices, lambda p: (p >= 0.999) | (p <= 0.001))
    sized = closed & (F.size(outcomes) > 0) & (F.size(outcomes) == F.size(prices))
    return F.when(sized & (F.size(winners) == 1) & losers_ok, F.get(outcomes, F.get(winners, F.lit(0))))
