"""Text expressions: dates, stations, phrases, payload paths and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months as contract tickers and rule texts spell them.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

#: Patterns of dates in tickers and texts.
TICKER_DATE = r"(?i)-(\d{2})(" + "|".join(MONTHS) + r")(\d{1,2})(?:-|$)"
ISO_DATE = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
NATURAL_DATE = (
    r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December|"
    r"Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(20\d{2})\b"
)

#: Any word where a month could stand; the strict pattern decides on the short match.
NATURAL_CANDIDATE = r"(?<![\p{L}\p{N}_])[A-Za-z]{3,9}\.?\s+\d{1,2}(?i:st|nd|rd|th)?,?\s+20\d{2}\b"

#: Fixed value: a second-venue date, whose year may be missing.
VENUE_DATE = (
    r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+"
    r"(\d{1,2})(?:,\s*(20\d{2}))?\b"
)

#: Station codes and the official place names that stand for one.
STATION_CODE = r"(?<![A-Z0-9])K[A-Z]{3}(?![A-Z0-9])"
STATION_ALIASES = {
    "KNYC": ("central park", "new york central park", "issuedby=nyc"),
    "KMDW": ("chicago midway", "midway airport", "midway, il", "issuedby=mdw"),
    "KMIA": ("miami international", "miami intl", "issuedby=mia"),
    "KLAX": ("los angeles international", "los angeles intl", "issuedby=lax"),
    "KDEN": ("denver international", "denver intl", "issuedby=den"),
}

#: Phrases of forecast discussions, by the sign they carry.
COOLER_PHRASES = (
    r"lower(?:ed|ing)?\s+(?:afternoon\s+)?highs?",
    r"cooler\s+than\s+(?:previously\s+)?forecast",
    r"temperatures?\s+(?:will\s+)?struggle",
    r"persistent\s+(?:stratus|clouds?|cloud\s+cover)",
    r"slower\s+(?:burn[- ]?off|clearing)",
)
WARMER_PHRASES = (
    r"raise(?:d|ing)?\s+(?:afternoon\s+)?highs?",
    r"warmer\s+than\s+(?:previously\s+)?forecast",
    r"faster\s+(?:burn[- ]?off|clearing)",
    r"more\s+sun(?:shine)?\s+than\s+expected",
)
CLOUDIER_PHRASES = (r"cloudier\s+than\s+expected", r"persistent\s+stratus", r"delayed\s+clearing")
CLEARER_PHRASES = (r"clear(?:ing|ed)?\s+faster", r"less\s+cloud\s+cover", r"earlier\s+burn[- ]?off")

#: Words that mark a payload path as settlement text, and the two source families.
RELEVANT_PATH_WORDS = ("settle", "rule", "source", "product", "term", "title", "subtitle")
CLIMATE_SOURCE_WORDS = ("national weather service", "climatological report", "daily climate report")
COMPANY_SOURCE_WORDS = ("the weather company", "weather.com/kalshi", "globaltemperature")
CLIMATE_SOURCE_PATTERN = r"(?i)(?:\bCLI\b|Daily Climate Report|Climatological Report|National Weather Service|\bNWS\b)"

#: Explicit station wordings in second-venue rules, strongest first.
SITE_PARAMETER = r"(?i)(?:[?&](?:site|station)=)([A-Z0-9]{4,5})(?:&|$)"
HISTORY_PATH = r"(?i)wunderground\.com/history/daily/[^\s)]+/([A-Z0-9]{4,5})(?:[\s).]|$)"
STATION_WORDING = r"(?i)\b(?:airport|weather|asos)\s+station\s+(?:at\s+)?\(?([A-Z][A-Z0-9]{3})\)?\b"

#: Tenths group of an observation remark.
TENTHS_REMARK = r"\bT([01])(\d{3})[01]\d{3}\b"


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out



def _month_index(name: Column) -> Column:
    short = F.upper(F.substring(name, 1, 3))
    out = F.lit(None).cast("int")
    for i, month in enumerate(MONTHS, 1):
        out = F.when(short == month, F.lit(i)).otherwise(out)
    return out


def _date_of(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def ticker_date(ticker: Column) -> Column:
    """Date inside an event ticker; an impossible date is null."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(ticker, TICKER_DATE, i), F.lit(""))

    return _date_of(F.concat(F.lit("20"), part(1)), _month_index(part(2)), part(3))


def iso_dates_in_text(text: Column) -> Column:
    """All valid dates a text gives in ISO form, in order."""
    dates = F.transform(
        F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(0)),
        lambda m: _date_of(F.regexp_extract(m, ISO_DATE, 1), F.regexp_extract(m, ISO_DATE, 2).try_cast("int"), F.regexp_extract(m, ISO_DATE, 3)),
    )
    return F.filter(dates, lambda d: d.isNotNull())


def dates_in_text(text: Column) -> Column:
    """All valid dates of a text, ISO forms first, then natural ones.

    Each pattern scans the text once; the parts are taken from the short matches.
    """

    def part(match: Column, pattern: str, i: int) -> Column:
        return F.regexp_extract(match, pattern, i)

    natural = F.transform(
        F.filter(F.regexp_extract_all(text, F.lit(NATURAL_CANDIDATE), F.lit(0)), lambda m: m.rlike(NATURAL_DATE)),
        lambda m: _date_of(part(m, NATURAL_DATE, 3), _month_index(part(m, NATURAL_DATE, 1)), part(m, NATURAL_DATE, 2)),
    )
    return F.concat(iso_dates_in_text(text), F.filter(natural, lambda d: d.isNotNull()))


def venue_date(text: Column, *times: Column) -> Column:
    """The first named date of a text. A date without a year takes that of the first readable time; without one it is null."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, VENUE_DATE, i), F.lit(""))

    years = [F.date_format(F.try_to_timestamp(t), "yyyy") for t in times]
    return _date_of(F.coalesce(part(3), *years), _month_index(part(1)), part(2))


def station_mentions(text: Column) -> Column:
    """Stations a text names, once per mention: each code, the URL parameter, and each station with an official place name."""
    codes = F.regexp_extract_all(F.upper(text), F.lit(STATION_CODE), F.lit(0))
    known = F.array(*[F.lit(s) for s in STATION_ALIASES])

    def named(lower: Column) -> Column:
        issued = F.concat(F.lit("K"), F.upper(F.regexp_extract(lower, r"[?&]issuedby=([a-z]{3})(?:&|#|$)", 1)))
        by_url = F.when(lower.contains("http") & F.array_contains(known, issued), issued)
        by_name = [F.when(contains_any(lower, names), F.lit(s)) for s, names in STATION_ALIASES.items()]
        return F.filter(F.array(by_url, *by_name), lambda s: s.isNotNull())

    # The text is lowered once, as the only element of an array the names are looked up in.
    lowered = F.flatten(F.transform(F.array(F.lower(text)), named))
    return F.concat(codes, lowered)


def station_hits(text: Column) -> Column:
    """Distinct stations a text names: by code, by URL parameter or by official place name."""
    return F.array_distinct(station_mentions(text))


def settlement_station(text: Column) -> Column:
    """First explicit station wording of a rule text, else UNKNOWN; never a guess from a city."""
    found = [
        F.nullif(F.upper(F.regexp_extract(text, p, 1)), F.lit(""))
        for p in (SITE_PARAMETER, HISTORY_PATH, STATION_WORDING)
    ]
    return F.coalesce(*found, F.lit("UNKNOWN"))


def phrase_score(text: Column) -> Column:
    """Struct (temperature_bias, cloud_bias, confidence, matched, phrases) of a forecast discussion."""
    lower = F.lower(text)

    def hits(patterns: tuple[str, ...]) -> Column:
        return F.filter(F.array(*[F.when(lower.rlike(p), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())

    found = [hits(p) for p in (COOLER_PHRASES, WARMER_PHRASES, CLOUDIER_PHRASES, CLEARER_PHRASES)]
    cool, warm, cloudy, clear = (F.size(f) for f in found)
    matched = cool + warm + cloudy + clear

    def bias(up: Column, down: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (up - down) * 0.20))

    return F.struct(
        bias(warm, cool).alias("temperature_bias"), bias(clear, cloudy).alias("cloud_bias"),
        F.least(F.lit(1.0), matched / 4.0).alias("confidence"), matched.alias("matched"),
        F.concat(*found).alias("phrases"),
    )


def remark_temperature(raw: Column, body_c: Column) -> Column:
    """Struct (temp_f, source): tenths from the remark where given, else the body temperature."""
    sign = F.regexp_extract(raw, TENTHS_REMARK, 1)
    tenths = F.nullif(F.regexp_extract(raw, TENTHS_REMARK, 2), F.lit("")).cast("double")
    exact = F.when(sign == "1", -tenths).otherwise(tenths) / 10.0
    celsius = F.coalesce(exact, body_c)
    return F.struct(
        (celsius * 9.0 / 5.0 + 32.0).alias("temp_f"),
        F.when(exact.isNotNull(), "REMARK_TENTHS").when(body_c.isNotNull(), "BODY").otherwise("NONE").alias("source"),
    )


def key_id(*parts: Column) -> Column:
    """Deterministic id of a key."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


#: Fixed value: the URL namespace of name-based ids (RFC 9562).
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(text: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12),
    )
