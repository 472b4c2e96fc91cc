"""Contract catalogues from payloads: paths, sources, classification, resolution, ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.functions.contracts import parse_label
from marketlens.functions.dimensions import HIGH_SERIES, LOW_SERIES
from marketlens.session import cut_lineage


#: Levels that one pass over nested payloads opens: few at first, as most are shallow; no plan holds more than the last number.
LEVELS = (4, 8, 16)


def _opened(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One level deeper: members of objects and items of arrays with their paths; leaves as they are."""
    kind = F.schema_of_variant("_v")
    prefix = F.when(F.col("path") == "", F.lit("")).otherwise(F.concat("path", F.lit(".")))
    members = F.transform(
        F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>")),
        lambda e: F.struct(F.concat(prefix, e["key"]).alias("path"), e["value"].alias("v")),
    )
    items = F.transform(
        F.try_variant_get("_v", "$", "array<variant>"),
        lambda v, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("v")),
    )
    leaf = F.array(F.struct(F.col("path").alias("path"), F.col("_v").alias("v")))
    entries = F.when(kind.startswith("OBJECT"), members).when(kind.startswith("ARRAY"), items).otherwise(leaf)
    return level.select(*keys, F.explode(entries).alias("_e")).select(*keys, F.col("_e.path").alias("path"), F.col("_e.v").alias("_v"))


def flatten_payload(df: DataFrame, keys: Sequence[str], payload: Column, *, root: str = "") -> DataFrame:
    """``(keys, path, text)`` of every non-null leaf of a JSON payload, however deep.

    A pass opens a fixed number of levels, one explode over typed variants each, and stores what it found; only what is still nested goes on.
    So the size of a plan does not follow the deepest payload, a deep one costs passes over itself alone, and a text that is no
    JSON costs nothing. Texts that look like JSON stay texts.
    """
    level = df.select(*keys, F.lit(root).alias("path"), F.try_parse_json(payload).alias("_v")).where(F.col("_v").isNotNull())
    kind = F.schema_of_variant("_v")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    leaves, turn = None, 0
    while True:
        for _ in range(LEVELS[min(turn, len(LEVELS) - 1)]):
            level = _opened(level, keys)
        stored = cut_lineage(level.withColumn("_nested", nested))
        found = stored.where(~F.col("_nested")).select(*keys, "path", F.try_variant_get("_v", "$", "string").alias("text"))
        leaves = found if leaves is None else leaves.unionByName(found)
        level = stored.where("_nested").drop("_nested")
        turn += 1
        if level.isEmpty():
            return leaves.where(F.col("text").isNotNull())


def relevant_path(path: Column) -> Column:
    return tx.contains_any(F.lower(path), tx.RELEVANT_PATH_WORDS)


def source_marks(path: Column, text: Column) -> tuple[Column, Column]:
    """Whether a settlement text names the climate report, and whether it names the company."""
    low = F.lower(text)
    climate = tx.contains_any(low, tx.CLIMATE_SOURCE_WORDS) | (F.trim(low) == "nws")
    company = tx.contains_any(low, tx.COMPANY_SOURCE_WORDS)
    return relevant_path(path) & climate, relevant_path(path) & company


def payload_rank(path: Column) -> Column:
    """Order of the payloads: market, event, series."""
    return F.when(path.startswith("series."), 2).when(path.startswith("event."), 1).otherwise(0)


def evidence_line(found: Column) -> Column:
    return F.concat(found["path"], F.lit("="), found["text"])


def no_lines() -> Column:
    """Evidence where nothing was found."""
    return F.array().cast("array<string>")


def source_family(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settlement source family per contract from its flattened texts, with its evidence.

    ``evidence``: distinct ``path=text`` lines, the company's first, then market, event, series, by path. They are collected as a
    set, so repeats merge before the shuffle; a row holds the texts of one contract that name a source. Without any the
    family is UNKNOWN and the evidence empty.
    """
    climate, company = source_marks(F.col("path"), F.col("text"))
    seen = pairs.select(*keys, payload_rank(F.col("path")).alias("rank"), "path", "text", climate.alias("climate"), company.alias("company"))
    line = F.struct((~F.col("company")).alias("later"), "rank", "path", "text", "climate", "company")
    facts = seen.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("climate") | F.col("company"), line))).alias("_found"))
    by_climate, by_company = F.exists("_found", lambda f: f["climate"]), F.exists("_found", lambda f: f["company"])
    family = (
        F.when(by_climate & by_company, "MIXED_OR_TRANSITIONAL").when(by_company, "WEATHER_COMPANY").when(by_climate, "NWS_CLI").otherwise("UNKNOWN")
    )
    return facts.select(*keys, family.alias("family"), F.array_distinct(F.transform("_found", evidence_line)).alias("evidence"))


#: Words that make a market about temperature or precipitation.
TEMPERATURE_WORDS = (
    r"(?i)(?:\btemperature\b|\btemp\b|°\s*[FC]\b|\bdegrees?\s+(?:fahrenheit|celsius|[FC])\b|"
    r"\bdaily\s+(?:high|low)\b|\b(?:high|low)\s+temperature\b)"
)
PRECIPITATION_WORDS = r"(?i)\b(?:rainfall|precipitation|snowfall)\b"
#: One of these literals is in every text the two patterns above can match.
TEMPERATURE_STEMS = ("temp", "°", "degree", "daily")
PRECIPITATION_STEMS = ("rainfall", "precipitation", "snowfall")
OFFICIAL_SOURCE = r"(?i)(?:National Weather Service|\bNWS\b|Climatological Report|Daily Climate Report|CLI)"
#: Measurements, and the fields whose text counts as official metadata. Status words, measurement names and
#: the sentences of the reasons below are fixed values too.
MEASURED_IN_DEGREES = ("DAILY_HIGH", "DAILY_LOW", "TEMPERATURE")
META_TEXT = ("ticker", "event_ticker", "title", "subtitle", "yes_sub_title", "rules_primary", "rules_secondary")


def _joined(columns: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def classify_contracts(markets: DataFrame) -> DataFrame:
    """Catalogue status, measurement, station, date, shape and reasons of each market.

    Exact series only; one unique station code; an explicit date; bounds for temperature contracts;
    a climate-report source. Only an ISO date is explicit here. EXACT needs all, PROBABLE a station or a source, REVIEW neither.
    """
    first_part = lambda c: F.upper(F.get(F.split(F.col(c), "-"), 0))
    series = F.coalesce(
        *[F.nullif(x, F.lit("")) for x in (F.upper(F.trim("series_ticker")), first_part("event_ticker"), first_part("ticker"))],
        F.lit(""),
    )
    rules = F.trim(_joined(("rules_primary", "rules_secondary")))
    # Each whole text is joined, lowered and searched once; a plain word test spares most texts the pattern.
    staged = markets.withColumns({"_text": _joined(META_TEXT), "_series": series, "_rules": rules}).withColumn(
        "_low", F.lower("_text")
    ).withColumns({
        "_thermal": tx.contains_any(F.col("_low"), TEMPERATURE_STEMS) & F.col("_text").rlike(TEMPERATURE_WORDS),
        "_wet": tx.contains_any(F.col("_low"), PRECIPITATION_STEMS) & F.col("_text").rlike(PRECIPITATION_WORDS),
    })
    low = F.col("_low")
    in_high, in_low = F.col("_series").isin(*HIGH_SERIES), F.col("_series").isin(*LOW_SERIES)
    thermal = F.col("_thermal")
    weather = in_high | in_low | thermal | F.col("_wet")
    measurement = (
        F.when(in_high | low.contains("daily high") | low.contains("high temperature"), "DAILY_HIGH")
        .when(in_low | low.contains("daily low") | low.contains("low temperature"), "DAILY_LOW")
        .when(low.contains("snowfall"), "SNOW").when(low.contains("rainfall") | low.contains("precipitation"), "RAIN")
        .when(thermal, "TEMPERATURE").otherwise("OTHER")
    )
    codes = F.array_distinct(F.regexp_extract_all(F.upper("_text"), F.lit(r"\bK[A-Z]{3}\b"), F.lit(0)))
    stated = F.try_to_date(F.substring("settlement_date", 1, 10), "yyyy-MM-dd")
    in_rules = F.get(tx.iso_dates_in_text(_joined(("rules_primary", "rules_secondary", "title"))), 0)
    floor, cap = F.col("floor_strike"), F.col("cap_strike")
    shape = (
        F.when(floor.isNotNull() & cap.isNotNull(), "bucket").when(floor.isNotNull(), "above").when(cap.isNotNull(), "below")
    )
    facts = staged.withColumns({
        "measurement": measurement, "_weather": weather, "_codes": codes, "settlement_date": F.coalesce(stated, in_rules),
        "shape": shape, "_official": F.col("_rules").rlike(OFFICIAL_SOURCE),
    }).withColumn("station", F.when(F.size("_codes") == 1, F.get("_codes", 0)))
    degrees = F.col("measurement").isin(*MEASURED_IN_DEGREES)
    no_ticker = F.coalesce(F.col("ticker"), F.lit("")) == ""
    doubts = F.filter(
        F.array(
            F.when(F.col("station").isNull(), "station not explicit/unique in official metadata"),
            F.when(F.col("settlement_date").isNull(), "settlement date not explicit in official metadata"),
            F.when(F.col("shape").isNull() & degrees, "temperature contract bounds unavailable"),
            F.when(~F.col("_official"), "settlement source not explicitly NWS/CLI-like"),
        ),
        lambda r: r.isNotNull(),
    )
    exact = (
        F.col("station").isNotNull() & F.col("settlement_date").isNotNull() & F.col("_official")
        & (~degrees | F.col("shape").isNotNull())
    )
    rejected = no_ticker | ~F.col("_weather") | (F.col("measurement") == "OTHER")
    status = (
        F.when(rejected, "REJECT").when(exact, "EXACT")
        .when(F.col("station").isNotNull() | F.col("_official"), "PROBABLE").otherwise("REVIEW")
    )
    reasons = (
        F.when(no_ticker, F.array(F.lit("missing ticker")))
        .when(~F.col("_weather"), F.array(F.lit("no explicit meteorological evidence")))
        .when(F.col("measurement") == "OTHER", F.array(F.lit("weather-like candidate has no supported measurement")))
        .otherwise(doubts)
    )
    keep = [c for c in markets.columns if c != "settlement_date"]
    return facts.select(
        *keep, status.alias("status"), F.when(rejected, "OTHER").otherwise(F.col("measurement")).alias("measurement"),
        *[F.when(~rejected, F.col(c)).alias(c) for c in ("station", "settlement_date", "shape")], reasons.alias("reasons"),
    )


#: Leaf names that hold a settlement date.
DATE_LEAVES = ("settlement_date", "event_date", "strike_date", "observation_date", "date")
DATE_PATH_WORDS = ("rule", "term", "title", "subtitle")


#: Why a market is not resolved.
NO_STATION = "official rules do not identify one unique settlement station"
NO_DATE = "official market/event text does not identify the event settlement date"
NO_SOURCE = "official rules do not identify an NWS/CLI-like settlement source"
DATE_CONFLICT = "official settlement date conflicts with ticker date"
SERIES_DRIFT = "current recurring-series metadata post-dates event; historical market/event rules must independently prove station/source"
NO_BOUNDS = "temperature contract bounds unavailable"


def resolve_rules(pairs: DataFrame, markets: DataFrame, key: str) -> DataFrame:
    """Station, date and source of each market from its own texts, with the evidence of each; fails closed.

    ``pairs``: key, path (rooted at market, event or series), text. ``markets``: key, event_ticker,
    series_updated. When the series text is newer than the event, market or event text must prove
    station and source on its own.

    ``station_evidence``, ``date_evidence`` and ``source_evidence`` are ``path=text`` lines in the order market, event, series, by path; a
    text that names the station or the date more than once is listed as often. Lines of the series stand only where market and event give none.
    A text is searched once, and only texts that say something are grouped, in one shuffle.
    """
    path = F.lower("path")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    relevant = relevant_path(F.col("path"))
    sourced = relevant & F.col("text").rlike(tx.CLIMATE_SOURCE_PATTERN) & tx.contains_any(path, ("settle", "rule", "source", "term", "product"))
    leaf = F.regexp_replace(F.element_at(F.split(path, r"\."), -1), r"\[\d+\]", "")
    dated = leaf.isin(*DATE_LEAVES) | tx.contains_any(path, DATE_PATH_WORDS)
    searched = pairs.select(
        key, payload_rank(F.col("path")).alias("rank"), "path", "text", F.coalesce(sourced, F.lit(False)).alias("sourced"),
        F.when(relevant, tx.station_mentions(F.col("text"))).otherwise(none("string")).alias("stations"),
        F.when(dated, tx.dates_in_text(F.col("text"))).otherwise(none("date")).alias("dates"),
    ).where(F.col("sourced") | (F.size("stations") > 0) | (F.size("dates") > 0))
    facts = searched.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "path", "text", "sourced", "stations", "dates"))).alias("_found"))

    def lines(found: Column, times) -> Column:
        return F.coalesce(F.flatten(F.transform(found, lambda f: F.array_repeat(evidence_line(f), times(f)))), no_lines())

    def of(values: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("_found", lambda f: f[values])))

    def preferred(found: Column) -> Column:
        own = F.filter(found, lambda f: f["rank"] < 2)
        return F.when(F.size(own) > 0, own).otherwise(found)

    def is_own(found: Column) -> Column:
        return F.coalesce(F.exists(found, lambda f: f["rank"] < 2), F.lit(False))

    table = markets.withColumn("ticker_date", tx.ticker_date(F.col("event_ticker"))).join(facts, key, "left").withColumns({
        "_stations": of("stations"), "_dates": of("dates"),
        "_naming": F.filter("_found", lambda f: F.size(f["stations"]) > 0), "_sourced": F.filter("_found", lambda f: f["sourced"]),
    })
    day = F.when(F.array_contains("_dates", F.col("ticker_date")), F.col("ticker_date")).when(F.size("_dates") == 1, F.get("_dates", 0))
    resolved = table.withColumns({
        "station": F.when(F.size("_stations") == 1, F.get("_stations", 0)), "settlement_date": day,
        "source_evidence": lines(preferred(F.col("_sourced")), lambda f: F.lit(1)),
    }).withColumns({
        "station_evidence": F.when(F.col("station").isNull(), no_lines()).otherwise(lines(preferred(F.col("_naming")), lambda f: F.size(f["stations"]))),
        "date_evidence": F.when(F.col("settlement_date").isNull(), no_lines()).otherwise(
            lines(F.col("_found"), lambda f: F.size(F.filter(f["dates"], lambda d: d == F.col("settlement_date"))))
        ),
        "date_matches": F.col("ticker_date") == F.col("settlement_date"),
        "drift_risk": F.coalesce(F.to_date("series_updated") > F.col("ticker_date"), F.lit(False)),
    }).withColumn(
        "_proved", ~F.col("drift_risk") | (F.col("station").isNotNull() & is_own(F.col("_naming")) & is_own(F.col("_sourced")))
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("station").isNull(), NO_STATION), F.when(F.col("settlement_date").isNull(), NO_DATE),
            F.when(F.size("source_evidence") == 0, NO_SOURCE), F.when(~F.col("date_matches"), DATE_CONFLICT),
            F.when(~F.col("_proved"), SERIES_DRIFT),
        ),
        lambda r: r.isNotNull(),
    )
    return resolved.select(
        *markets.columns, "ticker_date", "station", "settlement_date", "date_matches", "drift_risk", F.get("source_evidence", 0).alias("settlement_source"),
        "station_evidence", "date_evidence", "source_evidence",
        F.when(F.col("_sourced").isNull(), 0).otherwise(F.size("_sourced")).alias("source_texts"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("exact"),
    )


def enrich_catalogue(records: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Records of a catalogue with what the rules resolved: EXACT only where the rules are exact and a temperature contract has bounds.

    ``records``: key, measurement, shape, station, settlement_date and whatever else; a resolved station or date replaces theirs, their status and
    reasons are those of the rules. A record without resolved rules stays as it is.
    """
    own = [c for c in records.columns if c not in ("status", "station", "settlement_date", "reasons")]
    found = resolved.select(key, F.lit(True).alias("_there"), F.struct("station", "settlement_date", "exact", "reasons").alias("_r"))
    bounded = F.col("shape").isNotNull() | ~F.coalesce(F.col("measurement").isin(*MEASURED_IN_DEGREES), F.lit(False))
    status = F.when(F.col("_r.exact") & bounded, "EXACT").otherwise("PROBABLE")
    reasons = F.concat(F.col("_r.reasons"), F.when(bounded, no_lines()).otherwise(F.array(F.lit(NO_BOUNDS))))
    kept = lambda c, new: F.when(F.col("_there"), new).otherwise(F.col(c)).alias(c)
    return records.join(found, key, "left").select(
        *own, kept("status", status), *[F.coalesce(F.col(f"_r.{c}"), F.col(c)).alias(c) for c in ("station", "settlement_date")], kept("reasons", reasons),
    )


#: Settlement stations of the second venue by city wording.
CITY_STATIONS = (
    ("NYC", "KNYC"), ("NEW YORK", "KNYC"), ("CHICAGO", "KMDW"), ("MIAMI", "KMIA"), ("LOS ANGELES", "KLAX"),
    ("SAN FRANCISCO", "KSFO"),
)


def station_of_city(text: Column) -> Column:
    upper = F.upper(text)
    out = F.lit(None).cast("string")
    for city, station in reversed(CITY_STATIONS):
        out = F.when(upper.contains(city), station).otherwise(out)
    return out


def normalize_second_venue(markets: DataFrame, *, slug: str, order: Sequence[str], times: Sequence[str] = ()) -> DataFrame:
    """Temperature markets of known cities with parsed bounds; the last row of a slug wins.

    ``markets``: event_title, market_title, outcome, description, slug and ordering columns. ``times`` are columns with the start and end of
    the event as texts, in order; a date without a year takes the year of the first that can be read.
    """
    label = F.coalesce(F.nullif(F.col("outcome"), F.lit("")), F.col("market_title"), F.lit(""))
    combined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (F.col("event_title"), F.col("market_title"), label, F.col("description"))])
    staged = markets.withColumns({"_text": combined, "_a": parse_label(label), "_b": parse_label(F.col("market_title"))})
    bounds = F.when(F.col("_a.shape").isNotNull(), F.col("_a")).otherwise(F.col("_b"))
    found = staged.where(F.col("_text").rlike(r"(?i)\btemperature\b|\bhigh\b|°")).withColumns(
        {"station": station_of_city(F.col("_text")), "_p": bounds, "settlement_date": tx.venue_date(F.col("_text"), *[F.col(t) for t in times])}
    ).where(F.col("station").isNotNull() & F.col("_p.shape").isNotNull())
    rows = found.select(*markets.columns, "station", "settlement_date", "_p.*")
    return rows.groupBy(slug).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def flatten_markets(events: DataFrame, keys: Sequence[str], markets: str) -> DataFrame:
    """One row per market of each event, quotes as numbers."""
    m = F.col("_m")
    number = lambda c: F.nullif(m[c], F.lit("")).try_cast("double")
    return events.select(*keys, F.explode(markets).alias("_m")).select(
        *keys, m["id"].alias("market_id"), number("best_bid").alias("best_bid"), number("best_ask").alias("best_ask"),
    )


def with_event_members(contracts: DataFrame, event: str, ticker: str) -> DataFrame:
    """Attach to each contract the sorted members of its event, how many they are and an order-free fingerprint.

    A ladder is short, so its list is one array per event; equality of membership needs only count and fingerprint.
    """
    members = contracts.select(event, ticker).distinct().groupBy(event).agg(
        F.count(F.lit(1)).alias("member_count"), F.min(ticker).alias("first_member"), F.max(ticker).alias("last_member"),
        F.sum(F.xxhash64(ticker).cast("decimal(20,0)")).alias("member_fingerprint"), F.array_sort(F.collect_list(ticker)).alias("members"),
    )
    return contracts.join(members, event)


def ladder_check(contracts: DataFrame, event: Sequence[str], *, value: str, won: Column) -> DataFrame:
    """Whether each event has exactly one settlement value and one winner."""
    facts = contracts.groupBy(*event).agg(
        F.count(F.lit(1)).alias("contracts"), F.count_distinct(value).alias("values"), F.count_if(won).alias("winners"),
        F.min(value).alias("settlement_value"),
    )
    return facts.withColumn("valid", (F.col("values") == 1) & (F.col("winners") == 1))


def reason_counts(df: DataFrame, group: Sequence[str], reasons: str, example: str, k: int) -> DataFrame:
    """Rows per reason with the ``k`` least examples; a rank limit keeps the examples small."""
    from pyspark.sql import Window

    spread = df.select(*group, F.explode_outer(reasons).alias("reason"), example)
    counted = spread.groupBy(*group, "reason").agg(F.count(F.lit(1)).alias("rows"))
    rank = F.row_number().over(Window.partitionBy(*group, "reason").orderBy(example))
    shown = spread.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*group, "reason").agg(
        F.array_sort(F.collect_list(example)).alias("examples")
    )
    keys = [counted[c].eqNullSafe(shown[c]) for c in (*group, "reason")]
    return counted.join(shown, keys).select(*[counted[c] for c in (*group, "reason", "rows")], "examples")


def regime_history(families: DataFrame) -> DataFrame:
    """Contracts and distinct dates per source family, first and last date."""
    return families.groupBy("family").agg(
        F.count(F.lit(1)).alias("contracts"), F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def readiness(rows: DataFrame, key: str, day: str, station: str, gates: Sequence[int] = (20, 50, 100)) -> DataFrame:
    """Coverage in one pass: rows, keys, dates, stations, first and last date, date gates."""
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.count_distinct(day).alias("dates"),
        F.count_distinct(station).alias("stations"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
    )
    return facts.withColumns({f"ready_{g}": F.col("dates") >= g for g in gates})
