"""Hand-computed cases of the rules."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from marketlens.functions import contracts as ct
from marketlens.functions import geo
from marketlens.functions import numbers as nb
from marketlens.functions import probability as pb
from marketlens.functions import text as tx
from marketlens.functions import times as tm
from marketlens.operators import books, ladders, rolling, signals, spatial, surface
from marketlens.operators.evaluate import verdict


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ts(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def test_tails_are_strict_and_labels_inclusive(spark):
    bound = (F.lit("below"), F.lit(None).cast("double"), F.lit(70.0))
    r = one(spark, ct.contains(*bound, F.lit(70.0)).alias("a"), ct.contains(*bound, F.lit(70.0), inclusive=True).alias("b"),
            ct.contains(F.lit("bucket"), F.lit(70.0), F.lit(71.0), F.lit(71.0)).alias("c"),
            ct.contains(F.lit("above"), F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (False, True, True, None)


def test_bad_contract_can_stop_the_job(spark):
    with pytest.raises(Exception, match="contract without its bounds"):
        one(spark, ct.contains(F.lit("below"), F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0), on_bad="error").alias("x"))


def test_fee_rounds_up_to_the_cent(spark):
    r = one(spark, nb.fee_ceil_cent(0.07, F.lit(1), F.lit(0.5)).alias("a"), nb.fee_ceil_cent(0.07, F.lit(100), F.lit(0.5)).alias("b"),
            nb.fee_ceil_cent(0.07, F.lit(0), F.lit(0.5)).alias("c"), nb.fee_ceil_cent(0.07, F.lit(10), F.lit(0.1)).alias("d"))
    assert [float(x) for x in r] == [0.02, 1.75, 0.0, 0.07]


def test_fee_of_a_fill_keeps_its_whole_average(spark):
    # 28 contracts for 2 dollars: 0.07 * 28 * 1/14 * 13/14 is 13 cents to the digit
    r = one(spark, nb.fee_of_fill(0.07, F.lit(28.0), F.lit(2.0), F.lit(28.0)).alias("a"), nb.fee_of_fill(0.07, F.lit(28.0), F.lit(2.01), F.lit(28.0)).alias("b"),
            nb.fee_of_fill(0.07, F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("c"), nb.fee_of_fill(0.07, F.lit(100.0), F.lit(50.0), F.lit(100.0)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (0.13, 0.14, 0.0, 1.75)


def test_depth_vwap(spark):
    levels = spark.createDataFrame([(1, 0.50, 10.0), (1, 0.55, 20.0)], "book long, price double, size double")
    r = {x.depth: x for x in books.depth_vwap(levels, ["book"], "price", "size", F.array(F.lit(20.0), F.lit(40.0))).collect()}
    assert r[20.0].vwap == pytest.approx(0.525) and r[20.0].complete
    assert r[40.0].filled == 30 and not r[40.0].complete
    row = levels.groupBy("book").agg(F.collect_list(F.struct("price", "size")).alias("l"))
    buy = row.select(books.executable_buy(F.col("l"), F.lit(20.0)).alias("b")).first().b
    assert buy.vwap == pytest.approx(0.525) and buy.complete


def test_causal_state_sees_no_future(spark):
    base = ts("2026-07-01T18:00:00")
    readings = [("K", date(2026, 7, 1), base + timedelta(minutes=m), v, m) for m, v in ((0, 80.1), (5, 81.4), (10, 79.9), (20, 90.0))]
    obs = spark.createDataFrame(readings, "station string, day date, valid_time timestamp, temp double, seq long")
    target = spark.createDataFrame([("K", date(2026, 7, 1), base + timedelta(minutes=15))], "station string, day date, at timestamp")
    r = surface.causal_state(obs, target, "at").first()
    assert (r.high, r.latest, r.n) == (81.4, 79.9, 3)
    assert r.minutes_since_high == pytest.approx(10) and r["drop"] == pytest.approx(1.5)
    assert r.slope == pytest.approx((79.9 - 80.1) / 10)


def test_repeated_high_counts_from_its_last_time(spark):
    base = ts("2026-07-01T18:00:00")
    readings = [("K", date(2026, 7, 1), base + timedelta(minutes=m), v, m) for m, v in ((0, 81.0), (30, 81.0), (40, 80.0))]
    obs = spark.createDataFrame(readings, "station string, day date, valid_time timestamp, temp double, seq long")
    target = spark.createDataFrame([("K", date(2026, 7, 1), base + timedelta(minutes=60))], "station string, day date, at timestamp")
    assert surface.causal_state(obs, target, "at").first().minutes_since_high == pytest.approx(30)


def test_settlement_day_never_follows_daylight_saving(spark):
    r = one(
        spark, tm.settlement_start(F.lit("2026-07-01").cast("date"), F.lit(-5)).cast("timestamp_ntz").cast("string").alias("start"),
        tm.settlement_date(F.lit("2026-07-02 04:30:00").cast("timestamp"), F.lit(-5)).alias("late"),
    )
    assert r.start == "2026-07-01 05:00:00" and r.late == date(2026, 7, 1)


def test_quality_reasons(spark):
    base = ts("2026-07-01T12:00:00")
    day = date(2026, 7, 1)
    data = [("flat", day, base + timedelta(minutes=i * 5), 70.0, i) for i in range(60)] + [
        ("gap", day, base, 70.0, 0), ("gap", day, base + timedelta(minutes=31), 71.0, 1), ("future", day, base + timedelta(days=1), 70.0, 0)]
    obs = spark.createDataFrame(data, "station string, day date, valid_time timestamp, temp double, seq long")
    as_of = spark.createDataFrame(
        [("flat", day, base + timedelta(minutes=296)), ("gap", day, base + timedelta(minutes=32)), ("future", day, base)],
        "station string, day date, as_of timestamp")
    r = {x.station: x for x in surface.series_quality(obs, as_of).collect()}
    assert r["flat"].reasons == ["TEMPERATURE_FLATLINE_FAIL"] and r["flat"].status == "FAIL"
    assert r["gap"].reasons == ["OBSERVATION_GAP_FAIL"]
    assert r["future"].reasons == ["NO_VALID_TEMPERATURE"] and r["future"].status == "FAIL"


def test_mid_rank_and_top_decile(spark):
    start = date(2026, 1, 1)
    data = [("c", start + timedelta(days=i), 0.0) for i in range(20)] + [("c", start + timedelta(days=20), 0.0), ("c", start + timedelta(days=21), 10.0)]
    df = spark.createDataFrame(data, "city string, day date, v double")
    r = {x.day: x for x in rolling.rolling_top_decile(df, ["city"], "day", "v", lookback=60, minimum=20).collect()}
    assert r[start + timedelta(days=20)].percentile == 50 and not r[start + timedelta(days=20)].top_decile
    assert r[start + timedelta(days=21)].top_decile
    assert r[start + timedelta(days=5)].percentile is None


@pytest.mark.parametrize("dates,low,want", [(22, 0.1, "provisional"), (50, 0.1, "keep"), (60, -0.1, "provisional"), (10, 0.1, "insufficient_data")])
def test_verdict_thresholds(spark, dates, low, want):
    v = verdict(F.lit(60), F.lit(dates), F.lit(3), F.lit(5.0), F.lit(0.1), F.lit(low), F.lit(0.3))
    assert one(spark, v.alias("v")).v == want


def test_normal_probabilities(spark):
    r = one(
        spark, pb.gaussian_above(F.lit(70.0), F.lit(2.0), F.lit(70.5)).alias("half"),
        pb.strike_probability(F.lit("less"), F.lit(None).cast("double"), F.lit(60.0), F.lit(90.0), F.lit(1.0)).alias("far"),
        pb.strike_probability(F.lit("odd"), F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(1.0), on_bad="zero").alias("zero"),
    )
    assert r.half == pytest.approx(0.5, abs=1e-6) and r.far == pytest.approx(0.0, abs=1e-6) and r.zero == 0.0


@pytest.mark.parametrize("label,want", [
    ("71 to 72°", ("bucket", 71.0, 72.0)), ("72°F or below", ("below", None, 72.0)), (">= 90", ("above", 90.0, None)), ("maybe", (None, None, None))])
def test_labels(spark, label, want):
    assert tuple(one(spark, ct.parse_label(F.lit(label)).alias("p")).p) == want


def test_dates_and_stations_in_text(spark):
    text = F.lit("On March 3rd, 2026 and 2026-02-30, 2026/01/05; see https://x.gov/p?issuedby=MDW at Central Park, KDEN.")
    r = one(spark, tx.dates_in_text(text).alias("d"), F.array_sort(tx.station_hits(text)).alias("s"), tx.ticker_date(F.lit("KXHIGHNY-26JAN05-B1")).alias("t"))
    assert r.d == [date(2026, 1, 5), date(2026, 3, 3)]
    assert r.s == ["KDEN", "KMDW", "KNYC"]
    assert r.t == date(2026, 1, 5)


@pytest.mark.parametrize("text,start,end,want", [
    ("High on March 3, 2025?", "2024-01-01T00:00:00Z", None, date(2025, 3, 3)), ("high on march 3?", "2024-12-31T23:30:00Z", "2026-01-01T00:00:00Z", date(2024, 3, 3)),
    ("March 3", "soon", "2026-01-01T00:00:00Z", date(2026, 3, 3)), ("March 3", None, None, None), ("February 30", "2024-01-01", None, None), ("2025-03-03", None, None, None)])
def test_year_of_a_venue_date_may_come_from_the_event(spark, text, start, end, want):
    assert one(spark, tx.venue_date(F.lit(text), F.lit(start).cast("string"), F.lit(end).cast("string")).alias("d")).d == want


CLIMATE, COMPANY = "the National Weather Service", "The Weather Company"


def test_source_evidence_is_distinct_and_in_order(spark):
    from marketlens.operators import catalog as cg

    rows = [
        (1, "series.rule", COMPANY), (1, "market.rules[0]", CLIMATE), (1, "event.title", f"{CLIMATE}, not {COMPANY}"), (1, "market.rules[0]", CLIMATE), (1, "market.id", CLIMATE),
        (2, "series.source", " NWS "), (2, "event.source", CLIMATE), (3, "market.title", "nothing"),
    ]
    got = {r.k: (r.family, r.evidence) for r in cg.source_family(spark.createDataFrame(rows, "k long, path string, text string"), ["k"]).collect()}
    assert got == {
        1: ("MIXED_OR_TRANSITIONAL", [f"event.title={CLIMATE}, not {COMPANY}", f"series.rule={COMPANY}", f"market.rules[0]={CLIMATE}"]),
        2: ("NWS_CLI", [f"event.source={CLIMATE}", "series.source= NWS "]), 3: ("UNKNOWN", []),
    }


def test_rules_give_their_evidence_and_records_take_it(spark):
    from datetime import datetime

    from marketlens.operators import catalog as cg

    rule = f"{CLIMATE} at Central Park (KNYC), KNYC, on 2026-01-05"
    rows = [
        (1, "series.rule", f"NWS report for KNYC on {rule[-10:]}"), (1, "market.rule", rule), (1, "market.note", "KMDW"), (2, "series.rule", rule),
        (3, "market.rule", "KNYC or KMDW, 2026-01-04 and 2026-01-05"), (3, "event.date", "2026-01-06"),
    ]
    pairs = spark.createDataFrame(rows, "k long, path string, text string")
    late = datetime(2026, 2, 1)
    markets = spark.createDataFrame([(k, "KXHIGHNY-26JAN05", late if k < 3 else None) for k in (1, 2, 3, 4)], "k long, event_ticker string, series_updated timestamp")
    resolved = cg.resolve_rules(pairs, markets, "k")
    got = {r.k: r for r in resolved.collect()}
    assert got[1].exact and got[1].station == "KNYC" and got[1].settlement_source == f"market.rule={rule}"
    assert got[1].station_evidence == [f"market.rule={rule}"] * 3 and got[1].source_evidence == [f"market.rule={rule}"]
    assert got[1].date_evidence == [f"market.rule={rule}", f"series.rule={rows[0][2]}"] and got[1].source_texts == 2
    assert got[2].reasons == [cg.SERIES_DRIFT] and got[2].source_evidence == [f"series.rule={rule}"]
    assert got[3].station is None and got[3].station_evidence == [] and got[3].date_evidence == [f"market.rule={rows[4][2]}"] and got[3].reasons == [cg.NO_STATION, cg.NO_SOURCE]
    assert got[4].reasons == [cg.NO_STATION, cg.NO_DATE, cg.NO_SOURCE] and got[4].source_texts == 0 and got[4].date_evidence == []
    records = spark.createDataFrame(
        [(1, "DAILY_HIGH", None, "KLAX", None, "PROBABLE", []), (1, "RAIN", None, None, None, "PROBABLE", []), (3, "DAILY_HIGH", "above", "KLAX", None, "REVIEW", ["x"]), (9, "RAIN", None, "KLAX", None, "REVIEW", ["x"])],
        "k long, measurement string, shape string, station string, settlement_date date, status string, reasons array<string>")
    out = {(r.k, r.measurement): (r.status, r.station, r.settlement_date, r.reasons) for r in cg.enrich_catalogue(records, resolved, "k").collect()}
    day = date(2026, 1, 5)
    assert out == {
        (1, "DAILY_HIGH"): ("PROBABLE", "KNYC", day, [cg.NO_BOUNDS]), (1, "RAIN"): ("EXACT", "KNYC", day, []),
        (3, "DAILY_HIGH"): ("PROBABLE", "KLAX", day, [cg.NO_STATION, cg.NO_SOURCE]), (9, "RAIN"): ("REVIEW", "KLAX", None, ["x"]),
    }


def test_name_uuid(spark):
    import uuid

    assert one(spark, tx.name_uuid(F.lit("a|b")).alias("u")).u == str(uuid.uuid5(uuid.NAMESPACE_URL, "a|b"))


def test_clipping(spark):
    box = F.struct(F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.lit(1.0).alias("east"), F.lit(1.0).alias("north"))
    args = lambda *v: [F.lit(float(x)) for x in v]
    r = one(
        spark, geo.clipped_segment_km(*args(-1, 0.5, 2, 0.5), box).alias("across"), geo.clipped_segment_km(*args(2, -1, 2, 3), box).alias("outside"),
        geo.haversine_km(*args(0.5, 0, 0.5, 1)).alias("side"), geo.point_to_segment_km(*args(0, 0), *args(-1, 1, 1, 1)).alias("near"),
    )
    assert r.across == pytest.approx(r.side) and r.outside == 0.0
    assert r.near == pytest.approx(111.195, abs=0.01)


def test_nearest_point_matches_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    pts = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180), 40.0) for i in range(60)] + [(100 + i, 10 + i * 1e-4, 20.0, 40.0) for i in range(30)]
    plc = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(25)] + [(99, 10.0, 20.0), (98, 89.9, 179.9)]
    got = spatial.nearest_above(
        spark.createDataFrame(plc, "place long, lat double, lon double"), spark.createDataFrame(pts, "id long, lat double, lon double, dbz double"),
        "place", "dbz", 35.0, tie=["id"])

    def km(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    for r in got.collect():
        best = min(km(r.lat, r.lon, p[1], p[2]) for p in pts)
        assert r.distance_km == pytest.approx(best, abs=1e-6)
    within = spatial.radius_count(
        spark.createDataFrame(plc, "place long, lat double, lon double"), spark.createDataFrame(pts, "id long, lat double, lon double, dbz double"), "place", F.lit(2500.0), cell=10.0)
    have = {r.place: r.n for r in within.collect()}
    for place, lat, lon in plc:
        assert have[place] == sum(km(lat, lon, p[1], p[2]) <= 2500 for p in pts)


def test_points_beyond_a_pole_lie_on_the_far_meridian(spark):
    import math

    plc = [(1, 60.0, 166.0), (2, -85.0, 10.0), (3, 120.0, -14.0), (4, 0.0, 0.0), (5, -250.0, 30.0)]
    pts = [(lat, lon) for lat in (-410.0, -118.0, -95.0, -66.0, 0.0, 66.0, 89.0, 114.0, 181.0, 430.0) for lon in (-190.0, -14.0, -1.9, 0.0, 30.0, 166.0, 178.0, 226.0)]

    def km(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    got = spatial.radius_count(
        spark.createDataFrame(plc, "place long, lat double, lon double"), spark.createDataFrame(pts, "lat double, lon double"), "place", F.lit(1500.0), cell=5.0)
    want = {place: sum(km(lat, lon, *p) <= 1500 for p in pts) for place, lat, lon in plc}
    assert {r.place: r.n for r in got.collect()} == want and min(want.values()) > 0


def ladder(spark, legs, **change):
    rows = [("E", f"T{i}", i, s, lo, hi, True, True, change.get("status", "EXACT"), "rules", "NWS", "KNYC", "2026-01-01", "HIGH", "LST", "F",
             "WHOLE_DEGREE", "INTEGER") for i, (s, lo, hi) in enumerate(legs)]
    names = ("event_id string, ticker string, pos int, shape string, lower double, upper double, lower_inclusive boolean, upper_inclusive boolean, "
             "mapping_status string, evidence string, source string, station string, date string, measurement string, window string, unit string, "
             "rounding string, value_domain string")
    df = spark.createDataFrame(rows, names)
    members = df.select("event_id", "ticker")
    if change.get("extra"):
        members = members.union(spark.createDataFrame([("E", "TX")], "event_id string, ticker string"))
    return ladders.ladder_proof(df, members).first().reason


@pytest.mark.parametrize("legs,change,want", [
    ([("below", None, 60.0), ("bucket", 61.0, 62.0), ("above", 63.0, None)], {}, "EXACT_PARTITION"),
    ([("below", None, 60.0), ("bucket", 62.0, 63.0), ("above", 64.0, None)], {}, "GAP_OR_OVERLAP"),
    ([("below", None, 60.0), ("above", 61.0, None)], {}, "TOO_FEW_LEGS"),
    ([("below", None, 60.0), ("bucket", 61.0, 62.0), ("bucket", 63.0, 64.0)], {}, "MISSING_OR_DUPLICATE_TAIL"),
    ([("below", None, 60.0), ("bucket", 61.5, 62.0), ("above", 63.0, None)], {}, "NONINTEGER_BOUND"),
    ([("below", None, 60.0), ("bucket", 61.0, 62.0), ("above", 63.0, None)], {"status": "PROBABLE"}, "SETTLEMENT_SEMANTICS_UNVERIFIED"),
    ([("below", None, 60.0), ("bucket", 61.0, 62.0), ("above", 63.0, None)], {"extra": True}, "CANONICAL_MEMBERSHIP_INCOMPLETE"),
])
def test_ladder_proof(spark, legs, change, want):
    assert ladder(spark, legs, **change) == want


def test_missing_features_fail_closed(spark):
    m = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(None).cast("double"), F.lit("c"), F.lit(None).cast("double"))
    lacking = signals.missing_features(m, F.array(*[F.lit(x) for x in "abcd"]), F.array(F.lit("c")))
    assert one(spark, lacking.alias("m")).m == ["b", "d"]


def test_python_strategy_abstains_without_features(spark):
    from marketlens.plans.case_replay import evaluate_cases, python_strategy

    cases = spark.createDataFrame([(1, {"p": 0.9}), (2, {})], "case_id long, features map<string,double>")

    def rule(batch):
        p = batch["features"].map(lambda f: dict(f).get("p"))
        return batch.assign(reason="RULE", eligible=p.notna(), side="YES", probability=p.astype(float), edge=p.astype(float) - 0.5)

    schema = "case_id long, features map<string,double>, _missing array<string>, reason string, eligible boolean, side string, probability double, edge double"
    r = {x.case_id: (x.reason, x.eligible, x.side) for x in evaluate_cases(cases, python_strategy(rule, schema), ["p"]).collect()}
    assert r == {1: ("RULE", True, "YES"), 2: ("MISSING_REGISTERED_FEATURES:p", False, None)}


def test_book_restarts_per_file_when_asked(spark):
    level = "array<struct<price:double,size:double>>"
    rows = [("t", "f1", 0, 0, "snapshot", [(0.4, 5.0)], None, None), ("t", "f2", 1, 1, "delta", None, 0.4, 2.0), ("t", "f1", 2, 2, "delta", None, 0.4, 1.0)]
    df = spark.createDataFrame(rows, f"ticker string, source_file string, t long, seq long, event_type string, yes_bids {level}, price double, delta double")
    df = df.withColumns({"ts": F.timestamp_seconds("t"), "received": F.timestamp_seconds("t"), "side": F.lit("yes"), "no_bids": F.lit(None).cast(level)})
    carried = {r.seq: r["size"] for r in books.level_changes(df).collect()}
    restarted = {r.seq: r["size"] for r in books.level_changes(df, keys=("ticker", "source_file")).collect()}
    assert carried == {0: 5.0, 1: 7.0, 2: 8.0} and restarted == {0: 5.0, 2: 6.0}


def test_hot_keys_are_split_by_block(spark):
    from marketlens.operators.asof import asof_forward

    df = spark.createDataFrame([("k", 1, 2)], "key string, t long, v long").withColumn("ts", F.timestamp_seconds("t"))
    right = df.select("key", F.col("ts").alias("rt"), "v")
    plan = asof_forward(df, right, ["key"], "ts", "rt", ["v", "rt"])._jdf.queryExecution().executedPlan().toString()
    # The pass over rows is partitioned by key and block; only block summaries meet per key.
    assert "_block" in plan and "Window" in plan


def test_empty_source_is_an_error(spark):
    from marketlens.schemas import NoData, require_rows

    with pytest.raises(NoData):
        require_rows(spark.range(0), "observations")


def test_activity_panel_meets_its_baseline_once(spark):
    import random
    from statistics import mean, median

    from marketlens.operators.forecasts import activity_panel

    rnd = random.Random(5)
    base = [(k, rnd.choice([None, 1.0, 2.0, 4.0, 9.0]), float(rnd.randrange(50))) for k in range(6) for _ in range(k)] + [(9, None, 1.0)]
    now = [(k, rnd.choice([1.0, 3.0, 9.0]), None if k == 4 else 20.0) for k in range(7)] + [(9, 2.0, 2.0)]
    out = activity_panel(spark.createDataFrame(now, "k long, a double, b double"), spark.createDataFrame(base, "k long, a double, b double"), "k", ["a", "b"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    for r in out.collect():
        for name, at in (("a", 1), ("b", 2)):
            seen, value = [x[at] for x in base if x[0] == r.k and x[at] is not None], r[name]
            mid = median(seen) if seen else None
            assert r[f"{name}_median"] == mid and r[f"{name}_mean"] == (pytest.approx(mean(seen)) if seen else None)
            assert r[f"{name}_pct"] == (pytest.approx(100 * sum(x <= value for x in seen) / len(seen)) if seen and value is not None else None)
            mad = median(abs(x - mid) for x in seen) if seen else None
            assert r[f"{name}_z"] == (pytest.approx(0.67448975 * (value - mid) / mad) if mad and value is not None else None)


def test_best_run_sorts_once_and_spreads_over_its_tasks(spark):
    import random

    rnd = random.Random(6)
    rows = [(e, i, rnd.randrange(9) / 10, rnd.randrange(9) / 10) for e in range(5) for i in range(60)]
    frame = spark.createDataFrame(rows, "event long, i long, fair double, cost double")
    out = ladders.best_run(frame, ["event"], ["i"], F.floor(F.col("i") / 10), chunk=8, tasks=7)
    assert "_runs" not in out._jdf.queryExecution().optimizedPlan().toString()
    best = {}
    for e in range(5):
        legs = [(round(f - c, 9)) for x, _, f, c in rows if x == e]
        runs = [(-round(sum(legs[a : a + n]), 9), a + 1, n) for a in range(60) for n in range(1, 7) if a + n <= 60]
        best[e] = min(runs)
    assert {r.event: (-round(r.edge, 9), r.first_leg, r.run_legs) for r in out.collect()} == best


def test_ladder_proof_counts_tickers_without_another_pass(spark):
    names = ("event_id string, ticker string, pos int, shape string, lower double, upper double, lower_inclusive boolean, upper_inclusive boolean, mapping_status string, evidence string, "
             "source string, station string, date string, measurement string, window string, unit string, rounding string, value_domain string")
    tail = (True, True, "EXACT", "rules", "NWS", "KNYC", "2026-01-01", "HIGH", "LST", "F", "WHOLE_DEGREE", "INTEGER")
    shapes = [("below", None, 60.0), ("bucket", 61.0, 62.0), ("above", 63.0, None)]
    tickers = {"ok": "abc", "twice": "aab", "none": ["a", "b", None], "short": "ab", "unlisted": "abc", "more": "abc"}
    legs = spark.createDataFrame([(e, t, i, *shapes[i], *tail) for e, ts_ in tickers.items() for i, t in enumerate(ts_)], names)
    listed = [(e, t) for e, ts_ in tickers.items() for t in sorted({x or "" for x in ts_}) if e != "unlisted"] + [("more", "d")]
    for tasks in (None, 5):
        out = ladders.ladder_proof(legs, spark.createDataFrame(listed, "event_id string, ticker string"), tasks=tasks)
        assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert {r.event_id: (r.legs, r.reason) for r in out.collect()} == {
            "ok": (3, "EXACT_PARTITION"), "twice": (3, "DUPLICATE_OR_MISSING_CONTRACT"), "none": (3, "DUPLICATE_OR_MISSING_CONTRACT"), "short": (2, "TOO_FEW_LEGS"),
            "unlisted": (3, "CANONICAL_MEMBERSHIP_INCOMPLETE"), "more": (3, "CANONICAL_MEMBERSHIP_INCOMPLETE")}
