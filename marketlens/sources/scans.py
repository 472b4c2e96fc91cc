"""Readers: archives, JSON lines, CSV snapshots, observations, climate values."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.numbers import clean_number
from marketlens.operators.ordered import latest_per_key
from marketlens.schemas import ARCHIVE_EVENT, DEPTH_EVENT, LEVELS, MANIFEST, require_columns

def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) holds anything, on any Hadoop file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm_path)
    return found is not None and len(found) > 0


def _id_filter(df: DataFrame, name: str, ids: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows whose id is wanted: a semi join on keys of the stored type, whatever their number."""
    if ids is None:
        return df
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(name, T.StringType())]))
    return df.join(ids.select(F.col(ids.columns[0]).cast(df.schema[name].dataType).alias(name)), name, "left_semi")


def read_archive(
    spark: SparkSession, paths: Sequence[str], *, markets: Sequence[str] | DataFrame | None = None,
    assets: Sequence[str] | DataFrame | None = None, start: datetime | None = None, end: datetime | None = None,
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Archive rows in ``[start, end)`` of receive time; filters reach the Parquet scan.

    Binary market ids become text and JSON depth becomes (price, size) arrays after the filters.
    """
    df = require_columns(spark.read.parquet(*paths), ARCHIVE_EVENT).select(*ARCHIVE_EVENT.fieldNames())
    if start is not None:
        df = df.where(F.col("timestamp_received") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("timestamp_received") < F.lit(end))
    if kinds:
        df = df.where(F.col("event_type").isin(*kinds))
    df = _id_filter(_id_filter(df, "asset_id", assets), "market", markets)
    df = df.withColumn("market", F.col("market").cast("string"))

    def depth(column: str) -> Column:
        pairs = F.from_json(column, "array<array<string>>")
        return F.transform(pairs, lambda p: F.struct(F.get(p, 0).cast("double").alias("price"), F.get(p, 1).cast("double").alias("size")))

    return df.withColumns({c: depth(c) for c in ("bids", "asks")})


def _levels(df: DataFrame, column: str) -> Column:
    """Levels as (price, size) whether the struct fields are named or numbered; empty levels dropped."""
    fields = df.schema[column].dataType.elementType.fieldNames()
    price, size = ("price", "size") if "price" in fields else ("1", "2")
    pairs = F.transform(F.coalesce(column, F.array().cast(df.schema[column].dataType)), lambda x: F.struct(x[price].alias("price"), x[size].alias("size")))
    kept = F.filter(pairs, lambda x: x["price"].isNotNull() & (x["size"] > 0))
    return kept.cast(LEVELS)


def read_depth_events(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Raw depth events as the fold wants them; a row without ticker or type stops the job.

    Effective time is the exchange time, else the receive time; an empty market id is kept.
    """
    df = require_columns(spark.read.parquet(*paths), DEPTH_EVENT)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checked = F.when(
        blank(F.col("market_ticker")) | blank(F.col("event_type")), F.raise_error(F.lit("depth row without ticker or type"))
    ).otherwise(F.col("market_ticker"))
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index").alias("n"))
    return df.select(
        checked.alias("ticker"), F.coalesce("market_id", F.lit("")).alias("market_id"), "event_type",
        F.coalesce("timestamp", "timestamp_received").alias("ts"), F.col("timestamp_received").alias("received"),
        F.col("timestamp").alias("exchange_time"), _levels(df, "yes_bids").alias("yes_bids"), _levels(df, "no_bids").alias("no_bids"),
        "price", "delta", F.lower(F.trim(F.coalesce("side", F.lit("")))).alias("side"), place.alias("seq"),
        F.col("_metadata.file_path").alias("source_file"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a JSON-lines file; blank, broken and non-object lines are skipped, no file is no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("_r"), F.try_parse_json("value").alias("_ok"))
    return parsed.where(F.col("_ok").isNotNull() & F.col("_r").isNotNull()).select("_r.*")


def read_keyed_json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Last line per key of an append-only cache."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_n"),
    )
    rows = lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("_r"), "_f", "_b", "_n").select(
        "_r.*", "_f", "_b", "_n"
    )
    return latest_per_key(rows.where(F.col(key).isNotNull()), [key], ["_f", "_b", "_n"]).drop("_f", "_b", "_n")


#: Spellings of null and of true in snapshot files.
CSV_NULLS = ("", "NA", "None")
TRUE_WORDS = ("1", "true", "yes", "y")


def read_snapshot_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with null tokens and loose booleans, read as text and cast to the declared schema."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)

    def typed(f: T.StructField) -> Column:
        value = F.when(~F.trim(f.name).isin(*CSV_NULLS), F.trim(f.name))
        if isinstance(f.dataType, T.BooleanType):
            return F.lower(value).isin(*TRUE_WORDS)
        return value.try_cast(f.dataType)

    return raw.select(*[typed(f).alias(f.name) for f in schema.fields])


def station_code(text: Column) -> Column:
    """Three-letter station ids get their leading K."""
    code = F.upper(F.trim(text))
    return F.when(code.rlike("^[A-Z]{3}$"), F.concat(F.lit("K"), code)).otherwise(code)


def parse_time(text: Column) -> Column:
    """Three spellings of a UTC time; a time without a zone is UTC."""
    value = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(form)) for form in forms])


def normalize_observations(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed readings from text columns; ``columns`` maps our names to the source's.

    Wrap the result in ``require_rows`` where an empty answer must stop the job.
    """
    numbers = [c for c in columns if c not in ("station", "valid_time")]
    out = raw.select(
        station_code(F.col(columns["station"])).alias("station"), parse_time(F.col(columns["valid_time"])).alias("valid_time"),
        *[clean_number(F.col(columns[c])).alias(c) for c in numbers],
    )
    return out.where(F.col("valid_time").isNotNull())


#: Date spellings of climate products and the names their columns go by.
CLIMATE_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "MMMdd,yy", "MMMdd,yyyy", "MM/dd/yyyy", "M/d/yyyy")
CLIMATE_ALIASES = {
    "valid_date": ("valid", "date", "valid_date", "day"),
    "high_f": ("high", "high_f", "max_temp", "high_temp"),
    "low_f": ("low", "low_f", "min_temp", "low_temp"),
    "precip_in": ("precip", "precip_in", "precipitation"),
    "snow_in": ("snow", "snow_in", "snowfall"),
}


def normalize_climate(raw: DataFrame, station: Column) -> DataFrame:
    """Daily climate values from loosely named text columns, with the source row kept as JSON.

    A trace counts as zero, missing tokens are null, rows without a date drop out, and the last row
    of a (station, date) wins by ``_order`` where the input has one.
    """
    present = {c.lower(): c for c in raw.columns}

    def first(names: Sequence[str]) -> Column:
        found = [F.col(present[n]).cast("string") for n in names if n in present]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    text = F.trim(first(CLIMATE_ALIASES["valid_date"]))
    day = F.coalesce(*[F.try_to_date(text, form) for form in CLIMATE_DATES], F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))

    def number(name: str) -> Column:
        value = first(CLIMATE_ALIASES[name])
        return F.when(F.upper(F.trim(value)) == "T", F.lit(0.0)).otherwise(clean_number(value))

    kept = [c for c in raw.columns if c != "_order"]
    rows = raw.select(
        F.upper(station).alias("station"), day.alias("valid_date"), *[number(n).alias(n) for n in ("high_f", "low_f", "precip_in", "snow_in")],
        F.lit("CLIMATE_REPORT").alias("source"), F.to_json(F.struct(*kept)).alias("raw_json"),
        (F.col("_order") if "_order" in raw.columns else F.lit(0)).alias("_order"),
    ).where(F.col("valid_date").isNotNull())
    return latest_per_key(rows, ["station", "valid_date"], ["_order"]).drop("_order")


def parquet_query(spark: SparkSession, path: str, columns: Sequence[str], where: str = "true", args: dict | None = None) -> DataFrame:
    """Projection and predicate over Parquet files by SQL; parameters are bound, not pasted."""
    df = spark.read.parquet(path)
    picked = ", ".join(columns) if columns else "*"
    return spark.sql(f"SELECT {picked} FROM {{source}} WHERE {where}", args=args or {}, source=df)


def describe_parquet(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.parquet(path).schema.fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in fields], "name string, type string, nullable boolean")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with a declared schema: arrays stay arrays, absent fields are null or empty."""
    rows = read_json_lines(spark, path, MANIFEST)
    return rows.withColumns({c: F.coalesce(c, F.array().cast(MANIFEST[c].dataType)) for c in ("outcomes", "prices", "tokens")})


def bulletin_blocks(spark: SparkSession, path: str, header: str = r"(?m)^\s*(K[A-Z]{3})\s+NBM\s+V") -> DataFrame:
    """One row per station block of forecast bulletins: issue file, station, first maximum and spread.

    Lines are read one by one and numbered by the headers before them in their file; a block is the lines from one
    header to the next, and only a block is gathered in one row.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"), "value"
    )
    order = Window.partitionBy("file").orderBy("_b", "_n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("_block", F.sum(F.col("value").rlike(header).cast("int")).over(order)).where("_block > 0")
    gathered = numbered.groupBy("file", "_block").agg(F.sort_array(F.collect_list(F.struct("_b", "_n", "value"))).alias("_l"))
    text = F.regexp_replace(F.array_join(F.col("_l.value"), "\n"), header, "$1 ")
    return gathered.select("file", text.alias("block")).transform(parse_blocks)


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """Second value of the TXN row is the first maximum, of the XND row its spread; null when absent."""

    def row(name: str) -> Column:
        line = F.regexp_extract("block", rf"(?m)^\s*{name}\s+(.+)$", 1)
        return F.transform(F.regexp_extract_all(line, F.lit(r"-?\d+"), F.lit(0)), lambda v: v.try_cast("int"))

    others = [c for c in blocks.columns if c != "block"]
    return blocks.select(
        *others, F.substring("block", 1, 4).alias("station"), row("TXN").alias("txn"), row("XND").alias("xnd")
    ).select(*others, "station", F.get("txn", 1).cast("double").alias("max_f"), F.get("xnd", 1).cast("double").alias("max_sd_f"))


def station_maxima(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """All wanted (file, station) pairs; a station without a block stays as an error row."""
    out = wanted.join(blocks, ["file", "station"], "left")
    return out.withColumn("error", F.when(F.col("max_f").isNull(), "station_not_found"))
