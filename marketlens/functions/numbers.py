"""Money, rounding and cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing number.
MISSING_TOKENS = ("", "M", "MM", "NULL", "NONE", "NAN")

PRICE = "decimal(9,6)"
QUANTITY = "decimal(10,2)"
COEFFICIENT = "decimal(5,4)"


def six(value: Column) -> Column:
    """Six digits at the edge of a result; minus zero becomes zero."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def two(value: Column) -> Column:
    """Two digits, for spans of time whose sixth digit is often an exact tie."""
    return F.round(value.cast("double"), 2) + F.lit(0.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def clean_number(text: Column, type_name: str = "double") -> Column:
    """A number from text; a missing token or an unreadable text is null."""
    trimmed = F.trim(text.cast("string"))
    return F.when(~F.upper(trimmed).isin(*MISSING_TOKENS), trimmed.try_cast(type_name))


def half_up(value: Column, digits: int = 0) -> Column:
    """Decimal rounding, ties away from zero."""
    return F.round(value.cast("decimal(18,6)"), digits)


def reported_celsius(fahrenheit: Column) -> Column:
    """Whole degrees Celsius as reported for a Fahrenheit value."""
    exact = (fahrenheit.cast("decimal(9,3)") - 32) * 5 / F.lit(9).cast("decimal(1,0)")
    return F.round(exact, 0).cast("int")


def whole_fahrenheit_candidates(celsius: Column) -> Column:
    """Whole Fahrenheit degrees whose rounded Celsius equals the report."""
    near = F.floor(celsius * 9 / F.lit(5.0) + 32).cast("int")
    return F.filter(F.sequence(near - 1, near + 2), lambda f: f.between(-120, 160) & (reported_celsius(f) == celsius))


def complement(bid_other_side: Column) -> Column:
    """Ask of one side from the best bid of the other."""
    return F.lit(1) - bid_other_side


def quote_dollars(dollars: Column, cents: Column) -> Column:
    """The dollar field where present, else cents over 100."""
    return F.coalesce(dollars, cents / 100)


def fee_ceil_cent(coefficient: float | Column, contracts: Column, price: Column) -> Column:
    """Quadratic fee rounded up to the cent, on decimals. Zero where there is nothing to charge."""
    rate = coefficient if isinstance(coefficient, Column) else F.lit(coefficient)
    p = F.greatest(F.lit(0).cast(PRICE), F.least(F.lit(1).cast(PRICE), price.cast(PRICE)))
    raw = rate.cast(COEFFICIENT) * contracts.cast(QUANTITY) * p * (F.lit(1).cast("decimal(1,0)") - p)
    return F.when(contracts <= 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.ceil(raw, F.lit(2)).cast("decimal(18,2)"))


def fee_of_fill(coefficient: float, contracts: Column, cost: Column, filled: Column) -> Column:
    """The same fee at the average price of a fill, from its cost and quantity: an average such as 1/14 is never cut to a number of digits.

    Noise of floating point, below a billionth of a cent, does not reach the rounding.
    """
    cents = F.lit(coefficient) * contracts * cost * (filled - cost) / (filled * filled) * 100
    return F.when(contracts <= 0, F.lit(0.0)).otherwise(F.ceil(F.round(cents, 9)) / 100)


def fee_unrounded(rate: Column, contracts: Column, price: Column) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), price))
    return F.when(contracts <= 0, F.lit(0.0)).otherwise(contracts * rate * p * (1 - p))


def terminal_pnl(won: Column, contracts: Column, price: Column, fee: Column) -> Column:
    return F.when(won, contracts).otherwise(F.lit(0)) - contracts * price - fee


def capital_at_risk(contracts: Column, price: Column, fee: Column) -> Column:
    return contracts * price + fee


def roi(pnl: Column, capital: Column) -> Column:
    return F.when(capital > 0, pnl / capital)


def expected_value(probability: Column, price: Column, fee: Column, slippage: Column) -> Column:
    return probability - price - fee - slippage


def celsius_to_fahrenheit(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def kelvin_to_fahrenheit(k: Column) -> Column:
    return (k - 273.15) * 9.0 / 5.0 + 32.0


def kmh_to_mph(v: Column) -> Column:
    return v * 0.621371


def pascal_to_hectopascal(p: Column) -> Column:
    return p / 100.0
