"""Catalogue, text, clock and plan operators on documents, pages, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.registry import query
from marketlens.bindings.views import DAILY, EVENTS, OBS, daily, events, observations, offset_hours, orders, six, table, two
from marketlens.functions import contracts as ct
from marketlens.functions import numbers as nb
from marketlens.functions import text as tx
from marketlens.functions import times as tm
from marketlens.functions.numbers import six as r6
from marketlens.functions.times import naive
from marketlens.operators import catalog as cg
from marketlens.session import cut_lineage
from marketlens.sources import planning, scans


def tidy(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def choose(n, count, options):
    """The option a number picks modulo ``count``; null beyond the list."""
    out = F.lit(None).cast("string")
    for i, option in enumerate(options):
        out = F.when(n % count == i, F.lit(option)).otherwise(out)
    return out


def choose_sql(n, count, options):
    return f"CASE {n} % {count} " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " END"


SERIES = ("KXHIGHNY", "KXHIGHINFLATION", "KXLOWTCHI", "RAINX", "ABC", "KXHIGHCHI")
TITLES = ("Daily high temperature", "Rainfall total", "Price level")
RULES = (
    "Per the National Weather Service report for KNYC on 2024-01-05.", "Climatological Report for KMDW and KNYC, March 3rd, 2024.",
    "Source: The Weather Company, see weather.com/kalshi.", "NWS data at Central Park on Jan. 7, 2024 or 2024-02-31.", "No source.",
)


def markets(spark, d):
    """Documents as market payloads: the whole text is the rule, followed by an official wording."""
    doc = table(spark, d, "documents")
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int"))
    ticker = F.concat(choose(i, 6, SERIES), F.lit("-"), F.upper(F.date_format(day, "yyMMMdd")))
    return doc.select(
        i.alias("doc_id"), ticker.alias("event_ticker"), F.concat(ticker, F.lit("-B"), i.cast("string")).alias("ticker"), F.lit("").alias("series_ticker"),
        choose(i, 3, TITLES).alias("title"), F.lit("").alias("subtitle"), F.lit("").alias("yes_sub_title"),
        F.concat_ws(" ", "text", choose(i, 5, RULES)).alias("rules_primary"), F.lit("").alias("rules_secondary"),
        F.when(i % 4 < 2, F.col("n_chars").cast("double")).alias("floor_strike"), F.when(i % 4 == 1, F.col("n_chars") + 2.0).alias("cap_strike"),
        F.lit(None).cast("string").alias("settlement_date"), day.alias("day"), F.col("source").alias("venue"),
    )


MARKETS = f"""mk AS (SELECT doc_id, {choose_sql('doc_id', 6, SERIES)} || '-' || upper(strftime(day, '%y%b%d')) AS event_ticker, {choose_sql('doc_id', 6, SERIES)} AS series, {choose_sql('doc_id', 3, TITLES)} AS title,
 text || ' ' || {choose_sql('doc_id', 5, RULES)} AS rules, n_chars, day, source AS venue, text FROM (SELECT *, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS day FROM documents)),
mt AS (SELECT *, event_ticker || '-B' || doc_id || ' ' || event_ticker || ' ' || title || '   ' || rules || ' ' AS alltext FROM mk)"""
CODES = r"""list_distinct(regexp_extract_all(regexp_replace(upper(replace({t}, 'ß', 'ss')), '[^\p{{L}}\p{{N}}_]', '  ', 'g'), '(?:^| )(K[A-Z]{{3}})(?: |$)', 1))"""
CODES_ANY = r"""list_distinct(regexp_extract_all(regexp_replace(upper(replace({t}, 'ß', 'ss')), '[^A-Z0-9]', '  ', 'g'), '(?:^| )(K[A-Z]{{3}})(?: |$)', 1))"""


CLASSIFIED_SQL = rf"""WITH {MARKETS}, c AS (SELECT doc_id, series, title, n_chars, {CODES.format(t='alltext')} AS codes, series IN ('KXHIGHNY', 'KXHIGHCHI') OR title = 'Daily high temperature' AS high, series = 'KXLOWTCHI' AS low,
 regexp_matches(rules, '(?i)(?:National Weather Service|\bNWS\b|Climatological Report|Daily Climate Report|CLI)') AS official, regexp_extract(rules, '\b(20\d\d-\d\d?-\d\d?)\b', 1) AS iso FROM mt),
m AS (SELECT *, CASE WHEN high THEN 'DAILY_HIGH' WHEN low THEN 'DAILY_LOW' WHEN title = 'Rainfall total' THEN 'RAIN' ELSE 'OTHER' END AS measure, CASE WHEN len(codes) = 1 THEN codes[1] END AS st,
 CASE doc_id % 5 WHEN 0 THEN DATE '2024-01-05' END AS sd, CASE doc_id % 4 WHEN 0 THEN 'above' WHEN 1 THEN 'bucket' END AS sh FROM c)
SELECT doc_id, measure AS measurement, CASE WHEN measure = 'OTHER' THEN 'REJECT' WHEN st IS NOT NULL AND sd IS NOT NULL AND official AND (measure = 'RAIN' OR sh IS NOT NULL) THEN 'EXACT' WHEN st IS NOT NULL OR official THEN 'PROBABLE' ELSE 'REVIEW' END AS status,
 CASE WHEN measure <> 'OTHER' THEN st END AS station, CASE WHEN measure <> 'OTHER' THEN sd END AS settlement_date, CASE WHEN measure <> 'OTHER' THEN sh END AS shape,
 CASE WHEN measure = 'OTHER' THEN 1 ELSE (st IS NULL)::INT + (sd IS NULL)::INT + (sh IS NULL AND measure <> 'RAIN')::INT + (NOT official)::INT END AS reason_count FROM m"""


@query("classify_contracts", "B36 B47", CLASSIFIED_SQL)
def classify_contracts(spark, d):
    out = cg.classify_contracts(markets(spark, d))
    return out.select("doc_id", "measurement", "status", "station", "settlement_date", "shape", F.size("reasons").alias("reason_count"))


def payload(spark, d):
    m = markets(spark, d)
    body = F.to_json(
        F.struct(
            F.struct(F.col("event_ticker"), F.struct(F.col("rules_primary").alias("primary"), F.array(F.col("title"), F.lit("second")).alias("titles")).alias("rules")).alias("market"),
            F.struct(F.when(F.col("doc_id") % 7 == 0, "Operations of the National Weather Service").alias("settlement_source"), (F.col("doc_id") % 2 == 0).alias("flag")).alias("series"),
        )
    )
    return m.select("doc_id", "event_ticker", body.alias("payload"), F.when(F.col("doc_id") % 3 == 0, F.lit("2024-06-01")).cast("timestamp").alias("series_updated"))


PAIRS = f"""{MARKETS}, pr AS (SELECT doc_id, 'market.event_ticker' AS path, event_ticker AS text FROM mk UNION ALL SELECT doc_id, 'market.rules.primary', rules FROM mk UNION ALL SELECT doc_id, 'market.rules.titles[0]', title FROM mk
 UNION ALL SELECT doc_id, 'market.rules.titles[1]', 'second' FROM mk UNION ALL SELECT doc_id, 'series.settlement_source', 'Operations of the National Weather Service' FROM mk WHERE doc_id % 7 = 0
 UNION ALL SELECT doc_id, 'series.flag', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END FROM mk)"""


def pairs(spark, d):
    return cg.flatten_payload(payload(spark, d), ["doc_id"], F.col("payload"))


RANK = "CASE WHEN path LIKE 'series.%' THEN 2 WHEN path LIKE 'event.%' THEN 1 ELSE 0 END"


@query("json_flatten", "B33", f"WITH {PAIRS} SELECT doc_id, path, md5(text) AS text_hash FROM pr")
def json_flatten(spark, d):
    return pairs(spark, d).select("doc_id", "path", F.md5("text").alias("text_hash"))


@query("source_family", "B35 B33", f"""WITH {PAIRS}, s AS (SELECT doc_id, path, text, contains(lower(text), 'national weather service') OR contains(lower(text), 'climatological report') OR contains(lower(text), 'daily climate report') OR trim(lower(text)) = 'nws' AS a,
 contains(lower(text), 'the weather company') OR contains(lower(text), 'weather.com/kalshi') OR contains(lower(text), 'globaltemperature') AS b FROM pr WHERE path <> 'market.event_ticker' AND path <> 'series.flag')
SELECT doc_id, CASE WHEN bool_or(a) AND bool_or(b) THEN 'MIXED_OR_TRANSITIONAL' WHEN bool_or(b) THEN 'WEATHER_COMPANY' WHEN bool_or(a) THEN 'NWS_CLI' ELSE 'UNKNOWN' END AS family, count(*) FILTER (a OR b) AS evidence,
 coalesce(string_agg(path || '=' || text, ' | ' ORDER BY NOT b, {RANK}, path) FILTER (a OR b), '') AS evidence_texts FROM s GROUP BY doc_id""")
def source_family(spark, d):
    out = cg.source_family(pairs(spark, d), ["doc_id"])
    return out.select("doc_id", "family", F.size("evidence").cast("bigint").alias("evidence"), F.array_join("evidence", " | ").alias("evidence_texts"))


@query("regime_history", "D34", f"""WITH {MARKETS}, f AS (SELECT day, CASE WHEN contains(lower(rules), 'national weather service') OR contains(lower(rules), 'climatological report') THEN CASE WHEN contains(lower(rules), 'the weather company') THEN 'MIXED_OR_TRANSITIONAL' ELSE 'NWS_CLI' END
 WHEN contains(lower(rules), 'the weather company') THEN 'WEATHER_COMPANY' ELSE 'UNKNOWN' END AS family FROM mk) SELECT family, count(*) AS contracts, count(DISTINCT day) AS dates, min(day) AS first_date, max(day) AS last_date FROM f GROUP BY family""")
def regime_history(spark, d):
    m = markets(spark, d)
    texts = m.select("doc_id", F.lit("market.rules").alias("path"), F.col("rules_primary").alias("text"))
    families = cg.source_family(texts, ["doc_id"]).join(m.select("doc_id", F.col("day").alias("date")), "doc_id")
    return cg.regime_history(families)


ALIASES = " UNION ALL ".join(f"SELECT '{s}' AS station, '{n}' AS name" for s, names in tx.STATION_ALIASES.items() for n in names)


@query("station_hits", "B34", rf"""WITH p AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '&issuedby=mdw' WHEN 1 THEN ' at Central Park KDEN' WHEN 2 THEN '?issuedby=xyz' ELSE '' END AS t FROM pages), al AS ({ALIASES}),
h AS (SELECT page_id, unnest({CODES_ANY.format(t='t')}) AS s FROM p UNION SELECT page_id, station FROM p JOIN al ON contains(lower(t), name))
SELECT p.page_id, coalesce(string_agg(h.s, ',' ORDER BY h.s), '') AS stations FROM p LEFT JOIN h USING (page_id) GROUP BY p.page_id""")
def station_hits(spark, d):
    i = F.col("page_id")
    tail = F.when(i % 4 == 0, "&issuedby=mdw").when(i % 4 == 1, " at Central Park KDEN").when(i % 4 == 2, "?issuedby=xyz").otherwise("")
    hits = tx.station_hits(F.concat("url", tail))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(hits), ",").alias("stations"))


@query("settlement_station", "B34", r"""WITH p AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '?site=KMIA&x=1' WHEN 1 THEN ' weather station at (KORD) here' WHEN 2 THEN ' wunderground.com/history/daily/us/il/KMDW ' ELSE '' END AS t FROM pages)
SELECT page_id, coalesce(nullif(upper(regexp_extract(t, '(?i)[?&](?:site|station)=([A-Z0-9]{4,5})(?:&|$)', 1)), ''), nullif(upper(regexp_extract(t, '(?i)wunderground\.com/history/daily/[^\s)]+/([A-Z0-9]{4,5})(?:[\s).]|$)', 1)), ''),
 nullif(upper(regexp_extract(t, '(?i)\b(?:airport|weather|asos)\s+station\s+(?:at\s+)?\(?([A-Z][A-Z0-9]{3})\)?\b', 1)), ''), 'UNKNOWN') AS station FROM p""")
def settlement_station(spark, d):
    i = F.col("page_id")
    tail = (
        F.when(i % 4 == 0, "?site=KMIA&x=1").when(i % 4 == 1, " weather station at (KORD) here")
        .when(i % 4 == 2, " wunderground.com/history/daily/us/il/KMDW ").otherwise("")
    )
    return table(spark, d, "pages").select("page_id", tx.settlement_station(F.concat("url", tail)).alias("station"))


MENTIONS = CODES_ANY.replace("list_distinct(", "(")


RESOLVED_SQL = rf"""WITH {PAIRS}, al AS ({ALIASES}), rel AS (SELECT *, {RANK} AS rk FROM pr WHERE path NOT IN ('market.event_ticker', 'series.flag')),
sh AS (SELECT doc_id, rk, path, text, s, count(*) AS n FROM (SELECT doc_id, rk, path, text, unnest({MENTIONS.format(t='text')}) AS s FROM rel UNION ALL (SELECT DISTINCT doc_id, rk, path, text, station FROM rel JOIN al ON contains(lower(text), name))) GROUP BY ALL),
sf AS (SELECT doc_id, count(DISTINCT s) AS n, min(s) AS s, bool_or(rk < 2) AS own FROM sh GROUP BY 1),
se AS (SELECT doc_id, string_agg(path || '=' || text, ' | ' ORDER BY rk, path) AS lines FROM (SELECT sh.*, unnest(range(sh.n)) AS u FROM sh JOIN sf USING (doc_id) WHERE sf.n = 1 AND (NOT own OR rk < 2)) GROUP BY 1),
sx AS (SELECT *, count(*) FILTER (rk < 2) OVER (PARTITION BY doc_id) AS oc FROM rel WHERE regexp_matches(text, '(?i)(?:\bCLI\b|Daily Climate Report|Climatological Report|National Weather Service|\bNWS\b)')),
so AS (SELECT doc_id, count(*) AS c, any_value(oc) AS oc, string_agg(path || '=' || text, ' | ' ORDER BY rk, path) FILTER (rk < 2 OR oc = 0) AS lines, arg_min(path || '=' || text, struct_pack(r := rk, p := path)) AS source FROM sx GROUP BY 1),
dt AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN DATE '2024-01-05' WHEN 1 THEN DATE '2024-03-03' WHEN 3 THEN DATE '2024-01-07' END AS d, 'market.rules.primary=' || rules AS line FROM mk),
r AS (SELECT mk.doc_id, mk.day AS ticker_date, CASE WHEN sf.n = 1 THEN sf.s END AS station, dt.d AS settlement_date, coalesce(so.c, 0) AS source_texts, coalesce(so.oc, 0) AS oc, coalesce(sf.own, false) AS own,
 coalesce(mk.doc_id % 3 = 0 AND DATE '2024-06-01' > mk.day, false) AS drift, coalesce(se.lines, '') AS station_evidence, CASE WHEN dt.d IS NOT NULL THEN dt.line ELSE '' END AS date_evidence, coalesce(so.lines, '') AS source_evidence, so.source AS settlement_source
 FROM mk LEFT JOIN sf USING (doc_id) LEFT JOIN so USING (doc_id) LEFT JOIN dt USING (doc_id) LEFT JOIN se USING (doc_id)),
e AS (SELECT *, concat_ws(' | ', CASE WHEN station IS NULL THEN '{cg.NO_STATION}' END, CASE WHEN settlement_date IS NULL THEN '{cg.NO_DATE}' END, CASE WHEN source_texts = 0 THEN '{cg.NO_SOURCE}' END,
 CASE WHEN settlement_date <> ticker_date THEN '{cg.DATE_CONFLICT}' END, CASE WHEN drift AND NOT (station IS NOT NULL AND own AND oc > 0) THEN '{cg.SERIES_DRIFT}' END) AS reasons FROM r)
SELECT doc_id, ticker_date, station, settlement_date, source_texts, drift AS drift_risk, settlement_source, station_evidence, date_evidence, source_evidence, reasons, reasons = '' AS exact FROM e"""


@query("resolve_rules", "B37 B34 B32 B33", RESOLVED_SQL)
def resolve_rules(spark, d):
    m = payload(spark, d).select("doc_id", "event_ticker", "series_updated")
    out = cg.resolve_rules(pairs(spark, d), m, "doc_id")
    lines = [F.array_join(c, " | ").alias(c) for c in ("station_evidence", "date_evidence", "source_evidence", "reasons")]
    return out.select("doc_id", "ticker_date", "station", "settlement_date", "source_texts", "drift_risk", "settlement_source", *lines, "exact")


@query("enriched_catalogue", "B37 B36", f"""SELECT c.doc_id, c.measurement, c.shape, coalesce(r.station, c.station) AS station, coalesce(r.settlement_date, c.settlement_date) AS settlement_date,
 CASE WHEN r.exact AND (c.shape IS NOT NULL OR c.measurement NOT IN ('DAILY_HIGH', 'DAILY_LOW', 'TEMPERATURE')) THEN 'EXACT' ELSE 'PROBABLE' END AS status,
 concat_ws(' | ', nullif(r.reasons, ''), CASE WHEN c.shape IS NULL AND c.measurement IN ('DAILY_HIGH', 'DAILY_LOW', 'TEMPERATURE') THEN '{cg.NO_BOUNDS}' END) AS reasons
FROM ({CLASSIFIED_SQL}) c JOIN ({RESOLVED_SQL}) r USING (doc_id)""")
def enriched_catalogue(spark, d):
    records = cg.classify_contracts(markets(spark, d)).select("doc_id", "status", "measurement", "shape", "station", "settlement_date", "reasons")
    resolved = cg.resolve_rules(pairs(spark, d), payload(spark, d).select("doc_id", "event_ticker", "series_updated"), "doc_id")
    return cg.enrich_catalogue(records, resolved, "doc_id").withColumn("reasons", F.array_join("reasons", " | "))


@query("dates_in_text", "B32", f"""WITH {MARKETS} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '2024-03-03' WHEN 3 THEN '2024-01-07' ELSE '' END AS dates, day AS ticker_date FROM mk""")
def dates_in_text(spark, d):
    dates = F.transform(tx.dates_in_text(F.col("rules_primary")), lambda v: v.cast("string"))
    return markets(spark, d).select("doc_id", F.array_join(dates, ",").alias("dates"), tx.ticker_date(F.col("event_ticker")).alias("ticker_date"))


LABELS = """lb AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN p_size || ' to ' || (p_size + 1) || '°F' WHEN 1 THEN p_size || '°F or below' WHEN 2 THEN '>= ' || p_size || '.5' WHEN 3 THEN (p_size - 30) || '–' || p_size
 WHEN 4 THEN 'less than or equal to -' || p_size ELSE p_name END AS label FROM part)"""


def labels(spark, d):
    i, s = F.col("p_partkey"), F.col("p_size").cast("string")
    label = (
        F.when(i % 6 == 0, F.concat(s, F.lit(" to "), (F.col("p_size") + 1).cast("string"), F.lit("°F"))).when(i % 6 == 1, F.concat(s, F.lit("°F or below")))
        .when(i % 6 == 2, F.concat(F.lit(">= "), s, F.lit(".5"))).when(i % 6 == 3, F.concat((F.col("p_size") - 30).cast("string"), F.lit("–"), s))
        .when(i % 6 == 4, F.concat(F.lit("less than or equal to -"), s)).otherwise(F.col("p_name"))
    )
    return table(spark, d, "part").select("p_partkey", "p_size", label.alias("label"), "p_brand", "p_name")


PARSED = """pa AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'bucket' WHEN 3 THEN 'bucket' WHEN 1 THEN 'below' WHEN 4 THEN 'below' WHEN 2 THEN 'above' END AS shape,
 CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 3 THEN p_size - 30 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS lower, CASE p_partkey % 6 WHEN 0 THEN p_size + 1 WHEN 3 THEN p_size WHEN 1 THEN p_size WHEN 4 THEN -p_size END::DOUBLE AS upper FROM part)"""


@query("label_parse", "B31", f"WITH {PARSED} SELECT * FROM pa")
def label_parse(spark, d):
    return labels(spark, d).select("p_partkey", ct.parse_label(F.col("label")).alias("_p")).select("p_partkey", "_p.*")


@query("strike_labels", "B44", f"""WITH {PARSED} SELECT p_partkey, CASE shape WHEN 'bucket' THEN 'between' WHEN 'below' THEN 'less' WHEN 'above' THEN 'greater' END AS strike,
 CASE shape WHEN 'bucket' THEN printf('%.1f-%.1f', lower, upper) WHEN 'below' THEN printf('<%.1f', upper) WHEN 'above' THEN printf('>%.1f', lower) END AS label FROM pa""")
def strike_labels(spark, d):
    p = label_parse(spark, d)
    return p.select("p_partkey", ct.strike_of_shape(F.col("shape")).alias("strike"), ct.display_label(F.col("shape"), F.col("lower"), F.col("upper")).alias("label"))


@query("second_venue", "B38 B32", f"""WITH {PARSED}, v AS (SELECT p_partkey, p_brand AS slug, CASE p_partkey % 3 WHEN 0 THEN 'KMDW' WHEN 1 THEN 'KNYC' END AS station, shape, lower, upper,
 try_cast(CASE WHEN p_partkey % 2 = 0 THEN 2025 WHEN p_partkey % 4 = 1 THEN 2024 WHEN p_partkey % 8 = 3 THEN 2023 END || '-02-' || lpad(CAST(p_partkey % 31 + 1 AS VARCHAR), 2, '0') AS DATE) AS day FROM part JOIN pa USING (p_partkey))
SELECT arg_max(p_partkey, p_partkey) AS p_partkey, slug, arg_max(station, p_partkey) AS station, arg_max(shape, p_partkey) AS shape, max(CASE WHEN p_partkey = m THEN lower END) AS lower, max(CASE WHEN p_partkey = m THEN upper END) AS upper,
 max(CASE WHEN p_partkey = m THEN day END) AS settlement_date
FROM (SELECT *, max(p_partkey) OVER (PARTITION BY slug) AS m FROM v WHERE station IS NOT NULL AND shape IS NOT NULL) GROUP BY slug""")
def second_venue(spark, d):
    i = F.col("p_partkey")
    city = F.when(i % 3 == 0, "Highest temperature in Chicago").when(i % 3 == 1, "Highest temperature in New York").otherwise("High in Boston")
    day = F.concat(F.lit(" on February "), (i % 31 + 1).cast("string"), F.when(i % 2 == 0, ", 2025").otherwise(""))
    rows = labels(spark, d).select(
        "p_partkey", F.col("p_brand").alias("slug"), F.concat(city, day).alias("event_title"),
        F.lit("").alias("market_title"), F.col("label").alias("outcome"), F.lit("daily").alias("description"),
        F.when(i % 4 == 1, "2024-05-01T00:00:00Z").otherwise("soon").alias("starts"), F.when(i % 8 == 3, "2023-12-31T23:00:00Z").alias("ends"),
    )
    out = cg.normalize_second_venue(rows, slug="slug", order=["p_partkey"], times=["starts", "ends"])
    return out.select("p_partkey", "slug", "station", "shape", "lower", "upper", "settlement_date")


@query("terminal_outcome", "B39", f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_type <> 'view' AND k > 60 THEN 'Yes' WHEN event_type <> 'view' AND k < 20 THEN 'No' END AS outcome FROM ev""")
def terminal_outcome(spark, d):
    k = F.col("k")
    prices = F.when(k > 60, F.array(F.lit(0.9995), F.lit(0.0005))).when(k < 20, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.9995), F.lit(0.4)))
    out = ct.terminal_outcome(F.array(F.lit("Yes"), F.lit("No")), prices, F.col("event_type") != "view")
    return events(spark, d).select("event_id", out.alias("outcome"))


PHRASES = ("Lowered afternoon highs and persistent stratus today", "Warmer than previously forecast with more sunshine than expected", "Slower burn-off, cloudier than expected, delayed clearing", "Clearing faster with less cloud cover")


def hits_sql(patterns):
    return " + ".join(f"regexp_matches(t, '{p}')::INT" for p in patterns)


def texts_sql(patterns):
    quoted = [p.replace("'", "''") for p in patterns]
    return ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{p}' END" for p in quoted)


@query("phrase_score", "B40", f"""WITH x AS (SELECT conv_id, turn, lower(text || ' ' || {choose_sql('(conv_id + turn)', 5, PHRASES)}) AS t0, lower(text) AS t1, conv_id + turn AS n FROM conversations),
y AS (SELECT conv_id, turn, coalesce(t0, t1) AS t FROM x), z AS (SELECT *, {hits_sql(tx.COOLER_PHRASES)} AS c, {hits_sql(tx.WARMER_PHRASES)} AS w, {hits_sql(tx.CLOUDIER_PHRASES)} AS cl, {hits_sql(tx.CLEARER_PHRASES)} AS cr FROM y)
SELECT conv_id, turn, {six('greatest(-1, least(1, (w - c) * 0.2::DOUBLE))')} AS temperature_bias, {six('greatest(-1, least(1, (cr - cl) * 0.2::DOUBLE))')} AS cloud_bias, {six('least(1, (c + w + cl + cr) / 4)')} AS confidence, CAST(c + w + cl + cr AS INTEGER) AS matched,
 concat_ws(' | ', {texts_sql(tx.COOLER_PHRASES + tx.WARMER_PHRASES + tx.CLOUDIER_PHRASES + tx.CLEARER_PHRASES)}) AS phrases FROM z""")
def phrase_score(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat_ws(" ", "text", choose(F.col("conv_id") + F.col("turn"), 5, PHRASES))
    out = c.select("conv_id", "turn", tx.phrase_score(text).alias("_s")).select("conv_id", "turn", "_s.*")
    return tidy(out.withColumn("phrases", F.array_join("phrases", " | ")), "temperature_bias", "cloud_bias", "confidence")


@query("bulletin_blocks", "B41", f"""WITH {EVENTS} SELECT event_id, 'KNYC' AS station, CASE WHEN event_type <> 'view' THEN CAST(k AS DOUBLE) END AS max_f, CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(k % 7 AS DOUBLE) END AS max_sd_f FROM ev""")
def bulletin_blocks(spark, d):
    k = F.col("k").cast("string")
    txn = F.when(F.col("event_type") != "view", F.concat(F.lit("  TXN  -3 "), k, F.lit(" 55\n"))).otherwise("")
    xnd = F.when(F.col("event_type") != "click", F.concat(F.lit("  XND  2 "), (F.col("k") % 7).cast("string"), F.lit("\n"))).otherwise("")
    xnd = F.when(F.col("event_type") != "view", xnd).otherwise("")
    return scans.parse_blocks(events(spark, d).select("event_id", F.concat(F.lit("KNYC NBM V4.1\n"), txn, xnd).alias("block")))


@query("remark_temperature", "B42 B30", f"""WITH {EVENTS} SELECT event_id, {six("CASE WHEN k % 3 = 0 THEN (CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END) * k / 10.0::DOUBLE * 9 / 5 + 32 WHEN k % 3 = 1 THEN value * 9 / 5 + 32 END")} AS temp_f,
 CASE WHEN k % 3 = 0 THEN 'REMARK_TENTHS' WHEN k % 3 = 1 THEN 'BODY' ELSE 'NONE' END AS source FROM ev""")
def remark_temperature(spark, d):
    k = F.col("k")
    raw = F.when(k % 3 == 0, F.concat(F.lit("KNYC 011251Z RMK AO2 T"), (k % 2).cast("string"), F.lpad(k.cast("string"), 3, "0"), F.lit("1006 ="))).otherwise("KNYC RMK T12")
    t = tx.remark_temperature(raw, F.when(k % 3 == 1, F.col("value")))
    return tidy(events(spark, d).select("event_id", t.alias("_t")).select("event_id", "_t.*"), "temp_f")


@query("key_ids", "B45", """WITH n AS (SELECT event_id, concat_ws('|', user_id, event_type, event_id) AS n FROM events), h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(n)) AS h FROM n)
SELECT event_id, sha256(n) AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%x', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def key_ids(spark, d):
    name = F.concat_ws("|", "user_id", "event_type", "event_id")
    return events(spark, d).select("event_id", tx.key_id(F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("id"), tx.name_uuid(name).alias("uuid"))


@query("reason_counts", "D23", """WITH r AS (SELECT source, doc_id, unnest(CASE WHEN len(list_filter([CASE WHEN quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN quality IS NULL THEN 'UNLABELLED' END], lambda x: x IS NOT NULL)) = 0 THEN [NULL]
 ELSE list_filter([CASE WHEN quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN quality IS NULL THEN 'UNLABELLED' END], lambda x: x IS NOT NULL) END) AS reason FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, reason, count(*) AS "rows", array_to_string((list_sort(list(doc_id)))[1:3], ',') AS examples FROM r GROUP BY ALL""")
def reason_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    reasons = F.filter(
        F.array(F.when(F.col("quality") == 0, "LOW_QUALITY"), F.when(F.col("toxic") == 1, "TOXIC"), F.when(F.col("quality").isNull(), "UNLABELLED")),
        lambda r: r.isNotNull(),
    )
    out = cg.reason_counts(docs.withColumn("reasons", reasons), ["source"], "reasons", "doc_id", 3)
    return out.withColumn("examples", F.array_join(F.transform("examples", lambda v: v.cast("string")), ","))


@query("readiness", "D24", """SELECT count(*) AS "rows", count(DISTINCT o_custkey) AS keys, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates, count(DISTINCT o_orderpriority) AS stations, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date,
 count(DISTINCT CAST(o_orderdate AS DATE)) >= 20 AS ready_20, count(DISTINCT CAST(o_orderdate AS DATE)) >= 50 AS ready_50, count(DISTINCT CAST(o_orderdate AS DATE)) >= 100 AS ready_100 FROM orders""")
def readiness(spark, d):
    return cg.readiness(orders(spark, d).withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day", "o_orderpriority")


@query("event_members", "A22", """WITH m AS (SELECT p_brand AS event, p_type AS ticker FROM part GROUP BY ALL), a AS (SELECT event, count(*) AS member_count, min(ticker) AS first_member, max(ticker) AS last_member, string_agg(ticker, ',' ORDER BY ticker) AS members FROM m GROUP BY 1)
SELECT p_partkey, p_brand AS event, member_count, first_member, last_member, members FROM part JOIN a ON a.event = p_brand""")
def event_members(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("event"), F.col("p_type").alias("ticker"))
    return cg.with_event_members(p, "event", "ticker").select("p_partkey", "event", "member_count", "first_member", "last_member", F.array_join("members", ",").alias("members"))


@query("flatten_markets", "A21", """SELECT user_id, CAST(ts AS DATE) AS day, 'm' || u AS market_id, CASE WHEN u <> 1 THEN round(value, 2) END AS best_bid, CASE WHEN u = 2 THEN NULL ELSE value + u END AS best_ask FROM events, (SELECT unnest([1, 2]) AS u)""")
def flatten_markets(spark, d):
    v = F.col("value")

    def market(i, bid, ask):
        return F.struct(F.lit(f"m{i}").alias("id"), bid.cast("string").alias("best_bid"), ask.cast("string").alias("best_ask"))

    e = events(spark, d).select("user_id", F.to_date("ts").alias("day"), F.array(market(1, F.lit(""), v + 1), market(2, v, F.lit("n/a"))).alias("markets"))
    return cg.flatten_markets(e, ["user_id", "day"], "markets")


@query("settlement_window", "B1 C16", f"""WITH {OBS} SELECT DISTINCT station, day, CAST(day AS TIMESTAMP) - to_hours(CAST((-(5 + station % 4)) AS BIGINT)) AS start_utc, CAST(day AS TIMESTAMP) - to_hours(CAST((-(5 + station % 4)) AS BIGINT)) + INTERVAL 1 DAY AS end_utc FROM obs""")
def settlement_window(spark, d):
    off = offset_hours(F.col("station"))
    o = observations(spark, d).select("station", "day").distinct()
    return o.select(
        "station", "day", naive(tm.settlement_start(F.col("day"), off)).alias("start_utc"), naive(tm.settlement_end(F.col("day"), off)).alias("end_utc")
    )


@query("civil_window", "B2", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + INTERVAL 7 HOUR AS start_utc, CAST(o_orderdate AS DATE) + INTERVAL 31 HOUR AS end_utc, CAST(o_orderdate AS DATE) + INTERVAL 25 HOUR AS late_start,
 CAST(o_orderdate AS DATE) + INTERVAL 33 HOUR AS late_end FROM orders""")
def civil_window(spark, d):
    days = orders(spark, d).select(F.to_date("o_orderdate").alias("day")).distinct()
    a, b = tm.civil_window(F.col("day"), "America/Phoenix")
    c, e = tm.civil_window(F.col("day"), "America/Phoenix", "18:00", "02:00")
    return days.select("day", naive(a).alias("start_utc"), naive(b).alias("end_utc"), naive(c).alias("late_start"), naive(e).alias("late_end"))


@query("time_floors", "B3", """SELECT event_id, date_trunc('hour', ts) AS hour, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter FROM events""")
def time_floors(spark, d):
    return events(spark, d).select("event_id", naive(tm.floor_hour(F.col("ts"))).alias("hour"), naive(tm.floor_quarter_hour(F.col("ts"))).alias("quarter"))


@query("segments", "B4 J3", f"""WITH {DAILY}, x AS (SELECT station, min(valid_time) AS a, max(valid_time) AS b FROM obs GROUP BY 1), s AS (SELECT station, b, unnest(generate_series(a, b - INTERVAL 1 MICROSECOND, INTERVAL 12 HOUR)) AS t FROM x)
SELECT station, CAST(t AS TIMESTAMP) AS seg_start, least(CAST(t AS TIMESTAMP) + INTERVAL 12 HOUR, b) AS seg_end FROM s""")
def segments(spark, d):
    spans = observations(spark, d).groupBy("station").agg(F.min("valid_time").alias("a"), F.max("valid_time").alias("b"))
    cut = spans.select("station", F.explode(tm.segments(F.col("a"), F.col("b"), 12)).alias("_s"))
    return cut.select("station", naive(F.col("_s.seg_start")).alias("seg_start"), naive(F.col("_s.seg_end")).alias("seg_end"))


@query("rounding", "B5 B6 B7 B8 B30", f"""WITH {EVENTS}, x AS (SELECT event_id, value, k, CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN ' none ' ELSE CAST(value AS VARCHAR) END AS t FROM ev)
SELECT event_id, CAST(round(value::DECIMAL(12,2), 0) AS INTEGER) AS whole, CAST(round(((k - 40)::DECIMAL(9,3) - 32) * 5 / 9, 0) AS INTEGER) AS celsius, CASE WHEN k % 4 > 1 THEN value END AS cleaned, {six('value - k')} AS gap,
 {six('value * 9 / 5 + 32')} AS fahrenheit, {six('(value + 200 - 273.15::DOUBLE) * 9 / 5 + 32')} AS from_kelvin, {two('value * 0.621371::DOUBLE')} AS mph, {six('value / 100')} AS hpa FROM x""")
def rounding(spark, d):
    k, v = F.col("k"), F.col("value")
    token = F.when(k % 4 == 0, "M").when(k % 4 == 1, " none ").otherwise(v.cast("string"))
    return events(spark, d).select(
        "event_id", nb.half_up(v).cast("int").alias("whole"), nb.reported_celsius(k - 40).alias("celsius"), nb.clean_number(token).alias("cleaned"),
        r6(v - k).alias("gap"), r6(nb.celsius_to_fahrenheit(v)).alias("fahrenheit"), r6(nb.kelvin_to_fahrenheit(v + 200)).alias("from_kelvin"),
        nb.two(nb.kmh_to_mph(v)).alias("mph"), r6(nb.pascal_to_hectopascal(v)).alias("hpa"),
    )


@query("whole_degree_candidates", "B6", """WITH c AS (SELECT p_partkey, p_size - 25 AS c FROM part), f AS (SELECT unnest(generate_series(-120, 160)) AS f), m AS (SELECT f, CAST(round((f::DECIMAL(9,3) - 32) * 5 / 9, 0) AS INTEGER) AS c FROM f)
SELECT p_partkey, string_agg(CAST(m.f AS VARCHAR), ',' ORDER BY m.f) AS candidates FROM c JOIN m USING (c) GROUP BY p_partkey""")
def whole_degree_candidates(spark, d):
    found = nb.whole_fahrenheit_candidates(F.col("p_size") - 25)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(found, lambda f: f.cast("string")), ",").alias("candidates"))


PLAN = """ct AS (SELECT DISTINCT o_custkey % 25 AS st, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'),
hr AS (SELECT 'K' || CAST(st AS VARCHAR) AS station, day AS settlement_date, CAST(day AS TIMESTAMP) + to_hours(CAST(24 + 5 + st % 4 AS BIGINT)) - to_hours(h) AS hour_utc FROM ct, (SELECT unnest([1, 2, 3]) AS h))"""


def plan_catalog(spark, d):
    o = orders(spark, d)
    return o.select(
        F.concat(F.lit("K"), (F.col("o_custkey") % 25).cast("string")).alias("station"), F.to_date("o_orderdate").alias("settlement_date"),
        F.when(F.col("o_orderstatus") == "F", "EXACT").otherwise("REVIEW").alias("status"), (F.col("o_custkey") % 25).alias("st"),
    )


@query("archive_hours", "A14 J3", f"""WITH {PLAN} SELECT hour_utc, station, settlement_date FROM hr QUALIFY row_number() OVER (PARTITION BY hour_utc ORDER BY station, settlement_date) = 1""")
def archive_hours(spark, d):
    out = planning.archive_hours(plan_catalog(spark, d), -(F.lit(5) + F.col("st") % 4), final_hours=3)
    return out.select(naive(F.col("hour_utc")).alias("hour_utc"), "station", "settlement_date")


@query("close_time_hours", "A15 F10", """WITH c AS (SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN k = 0 THEN date_trunc('hour', ts) ELSE ts END AS t FROM (SELECT *, event_id % 5 AS k FROM events)),
h AS (SELECT event_id, day, date_trunc('hour', t - INTERVAL 1 MICROSECOND) - to_hours(i) AS hour_utc FROM c, (SELECT unnest([0, 1]) AS i)), p AS (SELECT hour_utc, arg_min(event_id, struct_pack(d := day, e := event_id)) AS contract_id FROM h GROUP BY 1)
SELECT hour_utc, contract_id FROM p ORDER BY hour_utc DESC LIMIT 100""")
def close_time_hours(spark, d):
    e = events(spark, d)
    close = F.when(F.col("event_id") % 5 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts"))
    c = e.select(F.col("event_id").alias("contract_id"), F.to_date("ts").alias("settlement_date"), close.alias("close_time"))
    out = planning.close_time_hours(c, final_hours=2, limit=100)
    return out.select(naive(F.col("hour_utc")).alias("hour_utc"), "contract_id")


@query("coverage", "A16", f"""WITH {PLAN}, f AS (SELECT strftime(ts, 'book_%Y-%m-%dT%H') AS n FROM events WHERE event_type = 'click'), p AS (SELECT DISTINCT date_trunc('hour', ts) AS hour_utc FROM events)
SELECT hour_utc, CASE WHEN n IN (SELECT n FROM f) THEN 'LOCAL' WHEN n IN (SELECT strftime(ts, 'book_%Y-%m-%dT%H') FROM events WHERE event_type = 'view') THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM (SELECT *, strftime(hour_utc, 'book_%Y-%m-%dT%H') AS n FROM p)""")
def coverage(spark, d):
    e = events(spark, d)
    name = F.concat(F.lit("book_"), F.date_format("ts", "yyyy-MM-dd'T'HH"))
    whole = e.where(F.col("event_type") == "click").select(name.alias("file_name"), F.lit(10).alias("bytes"))
    part = e.where(F.col("event_type") == "view").select(F.concat(name, F.lit(".part")).alias("file_name"), F.lit(0).alias("bytes"))
    plan = e.select(F.date_trunc("hour", "ts").alias("hour_utc")).distinct()
    wanted = F.concat(F.lit("book_"), F.date_format("hour_utc", "yyyy-MM-dd'T'HH"))
    return planning.coverage(plan, whole.unionByName(part), wanted).select(naive(F.col("hour_utc")).alias("hour_utc"), "status")


@query("retention_plan", "A19", """WITH f AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, CAST(o_totalprice AS BIGINT) AS bytes, o_orderpriority = '1-URGENT' AND o_orderkey % 9 = 0 AS odd, CASE WHEN o_orderkey % 50 = 0 THEN TIMESTAMP '2001-01-01' ELSE o_orderdate END AS m FROM orders)
SELECT day, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CASE WHEN bool_or(odd) THEN 'BLOCKED_UNEXPECTED_ENTRY' WHEN bool_or(m > TIMESTAMP '2000-11-01') THEN 'BLOCKED_RECENTLY_MODIFIED' ELSE 'ELIGIBLE' END AS state FROM f WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= TIMESTAMP '2000-11-01' GROUP BY day""")
def retention_plan(spark, d):
    o = orders(spark, d)
    odd = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 9 == 0)
    files = o.select(
        F.to_date("o_orderdate").alias("day"),
        F.concat(F.when(odd, "tmp_").otherwise("book_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), F.col("o_orderkey").cast("string")).alias("file_name"),
        F.rint("o_totalprice").cast("bigint").alias("bytes"), F.when(F.col("o_orderkey") % 50 == 0, F.lit("2001-01-01").cast("timestamp")).otherwise(F.col("o_orderdate")).alias("modified"),
        F.lit(False).alias("is_link"),
    )
    return planning.retention_plan(files, now=F.lit("2000-12-01").cast("timestamp"), days=30, pattern=r"^book_(\d{4}-\d{2}-\d{2})_\d+$")


@query("climate_normalise", "A8 A9 B7", f"""WITH {DAILY} SELECT 'K' || CAST(station AS VARCHAR) AS station, day AS valid_date, CASE station % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE high END AS high_f, low AS low_f FROM daily WHERE station % 9 <> 3 OR day IS NULL""")
def climate_normalise(spark, d):
    s = F.col("station")
    form = F.when(s % 9 == 0, F.date_format("day", "yyyy/MM/dd")).when(s % 9 == 1, F.date_format("day", "MM/dd/yyyy")).when(s % 9 == 2, F.date_format("day", "MMMdd,yyyy")).when(
        s % 9 == 3, F.lit("unknown")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    raw = daily(spark, d).select(
        F.concat(F.lit("k"), s.cast("string")).alias("_st"), form.alias("Valid"), F.when(s % 4 == 0, "M").when(s % 4 == 1, "T").otherwise(F.col("high").cast("string")).alias("HIGH"),
        F.col("low").cast("string").alias("low"), F.lit(0).alias("_order"),
    )
    return scans.normalize_climate(raw, F.col("_st")).select("station", "valid_date", "high_f", "low_f")


@query("observation_normalise", "A7 B7", f"""WITH {OBS} SELECT seq, CASE WHEN station % 2 = 0 THEN 'KABC' ELSE 'KXYZ1' END AS station, date_trunc('minute', valid_time) AS valid_time, CASE WHEN k % 5 <> 0 THEN temp END AS temperature_f FROM obs""")
def observation_normalise(spark, d):
    o = observations(spark, d)
    minute = F.date_trunc("minute", "valid_time")
    form = F.when(F.col("k") % 3 == 0, F.date_format(minute, "yyyy-MM-dd HH:mm")).when(F.col("k") % 3 == 1, F.date_format(minute, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(minute, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raw = o.select(
        F.col("seq").cast("string").alias("n"), F.when(F.col("station") % 2 == 0, "abc").otherwise("KXYZ1").alias("id"), form.alias("t"),
        F.when(F.col("k") % 5 == 0, "M").otherwise(F.col("temp").cast("string")).alias("v"),
    )
    out = scans.normalize_observations(raw, {"station": "id", "valid_time": "t", "temperature_f": "v", "seq": "n"})
    return out.select(F.col("seq").cast("bigint").alias("seq"), "station", naive(F.col("valid_time")).alias("valid_time"), "temperature_f")
