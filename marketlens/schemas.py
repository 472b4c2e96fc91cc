"""Declared schemas of the inputs, and the check that a frame has what a job needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRICE = T.DecimalType(18, 6)
LEVEL = T.StructType([T.StructField("price", PRICE), T.StructField("size", PRICE)])
LEVELS = T.ArrayType(LEVEL)

STRING, DOUBLE, TIME, LONG, BOOL = T.StringType(), T.DoubleType(), T.TimestampType(), T.LongType(), T.BooleanType()
PLAIN_LEVELS = T.ArrayType(T.StructType([T.StructField("price", DOUBLE), T.StructField("size", DOUBLE)]))


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DEPTH_EVENT = struct(
    timestamp_received=TIME, timestamp=TIME, market_ticker=STRING, market_id=STRING, event_type=STRING, yes_bids=LEVELS,
    no_bids=LEVELS, price=PRICE, delta=PRICE, side=STRING,
)
ARCHIVE_EVENT = struct(
    timestamp_received=TIME, timestamp=TIME, market=T.BinaryType(), event_type=STRING, asset_id=STRING, bids=STRING, asks=STRING,
    price=DOUBLE, size=DOUBLE, side=STRING, best_bid=DOUBLE, best_ask=DOUBLE, fee_rate_bps=T.IntegerType(),
)
OBSERVATION = struct(
    station=STRING, valid_time=TIME, temperature_f=DOUBLE, dewpoint_f=DOUBLE, wind_direction_deg=DOUBLE, wind_speed_kt=DOUBLE,
    pressure_mb=DOUBLE, source=STRING,
)
DAILY_CLIMATE = struct(
    station=STRING, valid_date=T.DateType(), high_f=DOUBLE, low_f=DOUBLE, precip_in=DOUBLE, snow_in=DOUBLE, source=STRING,
    raw_json=STRING,
)
MANIFEST = struct(
    condition_id=STRING, question=STRING, outcomes=T.ArrayType(STRING), prices=T.ArrayType(DOUBLE), tokens=T.ArrayType(STRING),
    closed=BOOL, end_date=STRING, resolved_outcome=STRING,
)
STREAM_MESSAGE = struct(
    connection=STRING, type=STRING, sid=T.IntegerType(), seq=LONG, received=TIME, market_ticker=STRING, side=STRING, price=DOUBLE,
    delta=DOUBLE, yes_bids=PLAIN_LEVELS, no_bids=PLAIN_LEVELS,
)


class MissingColumns(ValueError):
    """A source lacks columns a job needs."""


def require_columns(df: DataFrame, names: Iterable[str] | T.StructType) -> DataFrame:
    wanted = names.fieldNames() if isinstance(names, T.StructType) else list(names)
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


class NoData(ValueError):
    """A source that must not be empty has no rows."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.limit(1).isEmpty():
        raise NoData(f"no rows: {what}")
    return df
