"""Readers, writers and streams that arrive in several batches."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from marketlens.schemas import DOUBLE, LONG, STRING, MissingColumns, struct
from marketlens.session import scratch_path
from marketlens.sources import scans, sinks
from marketlens.streaming import flows, state

LEVEL = "array<struct<price:double,size:double>>"


def test_missing_file_is_no_rows(spark, tmp_path):
    assert scans.read_json_lines(spark, str(tmp_path / "none.jsonl"), struct(id=LONG)).count() == 0


def test_tolerant_lines_and_last_per_key(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [json.dumps({"id": 1, "k": "x"}), "", "{broken", "[1]", json.dumps({"id": 2, "k": "x"}), json.dumps({"id": 3, "k": "y"})]
    path.write_text("\n".join(lines))
    schema = struct(id=LONG, k=STRING)
    assert sorted(r.id for r in scans.read_json_lines(spark, str(path), schema).collect()) == [1, 2, 3]
    assert {r.k: r.id for r in scans.read_keyed_json_lines(spark, str(path), schema, "k").collect()} == {"x": 2, "y": 3}


def test_depth_scan_checks_its_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(MissingColumns, match="market_ticker"):
        scans.read_depth_events(spark, [str(tmp_path / "p")])


def test_depth_scan_refuses_a_row_without_ticker(spark, tmp_path):
    level = "array<struct<`1`:decimal(18,6),`2`:decimal(18,6)>>"
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    schema = f"timestamp_received timestamp, timestamp timestamp, market_ticker string, market_id string, event_type string, yes_bids {level}, no_bids {level}, price decimal(18,6), delta decimal(18,6), side string"
    good = [(now, None, "T", None, "orderbook_snapshot", [(1, 2), (2, 0)], None, None, None, None)]
    from decimal import Decimal
    good = [tuple([(Decimal(a), Decimal(b)) for a, b in x] if isinstance(x, list) else x for x in row) for row in good]
    spark.createDataFrame(good, schema).write.parquet(str(tmp_path / "good"))
    r = scans.read_depth_events(spark, [str(tmp_path / "good")]).first()
    assert (r.ticker, r.ts == r.received, len(r.yes_bids), r.no_bids) == ("T", True, 1, [])
    bad = [tuple("" if i == 2 else v for i, v in enumerate(good[0]))]
    spark.createDataFrame(bad, schema).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="without ticker or type"):
        scans.read_depth_events(spark, [str(tmp_path / "bad")]).collect()


def test_compact_refuses_an_empty_result(spark, tmp_path):
    raw = spark.range(5).withColumnRenamed("id", "k")
    with pytest.raises(sinks.EmptyResult):
        sinks.compact_to_keys(raw, raw.where("k > 10"), "k", str(tmp_path / "a"))
    with pytest.raises(sinks.EmptyResult):
        sinks.compact_to_keys(raw, raw.withColumn("k", F.col("k") + 100), "k", str(tmp_path / "b"))
    assert sinks.compact_to_keys(raw, raw.where("k < 2"), "k", str(tmp_path / "c")).count() == 2


def test_bulletins(spark, tmp_path):
    (tmp_path / "b.txt").write_text("HEAD\n KNYC    NBM V4.1 NBS\n  TXN  30  71  55\n  XND   2   3   4\n KMDW   NBM V4.1\n  TXN  20  60\n")
    blocks = scans.bulletin_blocks(spark, str(tmp_path / "b.txt"))
    file = blocks.first().file
    wanted = spark.createDataFrame([(file, s) for s in ("KNYC", "KMDW", "KLAX")], "file string, station string")
    r = {x.station: (x.max_f, x.max_sd_f, x.error) for x in scans.station_maxima(blocks, wanted).collect()}
    assert r == {"KNYC": (71.0, 3.0, None), "KMDW": (60.0, None, None), "KLAX": (None, None, "station_not_found")}


def batches(spark, name, frames):
    """Write frames as files that arrive one per batch."""
    path = scratch_path(spark, name)
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(path)
    return flows.tail_parquet(spark, path, frames[0].schema, files_per_batch=1)


def test_book_state_survives_batches(spark):
    schema = f"ticker long, t long, seq long, event_type string, yes_bids {LEVEL}, no_bids {LEVEL}, price double, delta double, side string"
    first = [(1, 0, 0, "orderbook_delta", None, None, 0.4, 5.0, "yes"), (1, 1, 1, "orderbook_snapshot", [(0.4, 10.0)], [(0.5, 7.0)], None, None, None)]
    second = [(1, 2, 2, "orderbook_delta", None, None, 0.4, -4.0, "yes"), (1, 3, 3, "orderbook_delta", None, None, 0.4, -9.0, "yes")]
    third = [(1, 4, 4, "orderbook_delta", None, None, 0.4, 2.0, "yes")]
    frames = [spark.createDataFrame(x, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t") for x in (first, second, third)]
    out = flows.drain(state.book_stream(batches(spark, "log", frames)), "book")
    assert sorted((r.seq, r.side, r.price, r["size"]) for r in out.collect()) == [
        (1, "no", 0.5, 7.0), (1, "yes", 0.4, 10.0), (2, "yes", 0.4, 6.0), (3, "yes", 0.4, 0.0), (4, "yes", 0.4, 2.0)]


def test_gap_invalidates_the_whole_connection(spark):
    schema = "connection long, sid int, seq long, is_book boolean, t long, pos long"
    frames = [
        [(1, 1, 10, True, 0, 0), (1, 2, 5, True, 1, 1), (1, 1, 10, True, 2, 2)], [(1, 1, 13, True, 3, 3), (1, 2, 6, True, 4, 4)], [(2, 1, 1, True, 5, 5), (1, 2, 7, True, 6, 6)],
    ]
    frames = [spark.createDataFrame(x, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t") for x in frames]
    out = flows.drain(state.gate_stream(batches(spark, "gate", frames)), "gate")
    assert {r.pos: (r.status if not r.missing else (r.status, r.missing)) for r in out.collect()} == {
        0: "APPLIED", 1: "APPLIED", 2: "DUPLICATE", 3: ("GAP", 2), 4: "INVALIDATED", 5: "APPLIED", 6: "INVALIDATED"}


def test_a_number_below_zero_is_remembered(spark):
    schema = f"connection long, sid int, seq long, is_book boolean, t long, pos long, ticker long, event_type string, yes_bids {LEVEL}, no_bids {LEVEL}, price double, delta double, side string"
    rows = [(1, 1, -1, True, 0, 0, 10, "orderbook_snapshot", [(0.4, 5.0)], None, None, None, None), (1, 1, 2, True, 1, 1, 10, "orderbook_delta", None, None, 0.4, 1.0, "yes")]
    frames = [spark.createDataFrame([r], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t") for r in rows]
    gate = flows.drain(state.gate_stream(batches(spark, "below", frames)), "below").collect()
    assert {(r.pos, r.status, r.missing) for r in gate} == {(0, "APPLIED", 0), (1, "GAP", 2)}
    live = flows.drain(state.live_book_stream(batches(spark, "below", frames)), "below").collect()
    assert {(r.pos, r.status, r.missing) for r in live} == {(0, "LEVEL", 0), (0, "BOOK", 0), (1, "GAP", 2)}


def test_keys_share_the_calls_of_a_batch(spark):
    rows = [(k, k % 3, 10_000 * n + k, "ERROR" if (k + n) % 2 else "OK", "R") for n in range(2) for k in range(1500)]
    frames = [spark.createDataFrame(part, "component long, t long, event_id long, status string, reason string") for part in (rows[:1500], rows[1500:])]
    frames = [f.withColumn("ts", F.timestamp_seconds("t")).drop("t") for f in frames]
    path = scratch_path(spark, "health-state")
    flows.append_to(state.health_stream(batches(spark, "health-in", frames)), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{path}/table")
    assert {(r.event_id, r.status) for r in out.collect()} == {(e, s) for k, _, e, s, _ in rows if k % 2 or e >= 10_000}
    held = spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", "signatures").load()
    assert held.count() == 750 and held.select("key").distinct().count() <= state.BUCKETS


def test_pending_fill_waits_for_a_later_batch(spark):
    schema = "contract long, t long, id long, is_quote boolean, horizon long, d long, side string, yes_ask double, no_ask double"
    frames = [
        [(1, 0, 1, False, 10, 10, "YES", None, None), (1, 5, 50, True, 0, 5, None, 0.3, 0.8), (2, 0, 2, False, 10, 10, "NO", None, None), (2, 1, 3, False, 1189, 1190, "NO", None, None), (3, 0, 4, False, 5, 5, "YES", None, None),
         (4, 0, 5, False, 7, 7, "YES", None, None)],
        [(1, 12, 51, True, 0, 12, None, 0.4, 0.7), (1, 13, 52, True, 0, 13, None, 0.5, 0.6), (3, 90, 53, True, 0, 90, None, 0.5, 0.6)],
        [(9, 1000, 54, True, 0, 1000, None, 0.4, 0.7)],
        [(2, 1200, 55, True, 0, 1200, None, 0.4, None)],
    ]
    frames = [
        spark.createDataFrame(x, schema).withColumns({"ts": F.timestamp_seconds("t"), "due": F.timestamp_seconds("d"), "expires": F.timestamp_seconds(F.col("d") + 60)}).drop("t", "d") for x in frames
    ]
    frames = [f.withColumns({c: F.col(c) + F.expr("INTERVAL 10 DAYS") for c in ("ts", "due", "expires")}) for f in frames]
    out = flows.drain(state.fill_stream(batches(spark, "fills", frames)), "fills").collect()
    # 2 and 5 expire by a timer, without any row of their contract; 3 finds a quote without an ask; the quote for 4 is too late
    assert sorted((r.signal_id, r.horizon, r.fill_id, r.price, r.status) for r in out) == [
        (1, 10, 51, 0.4, "FILLED"), (2, 10, None, None, "NO_MARKET_QUOTE"), (3, 1189, 55, None, "NO_EXECUTABLE_ASK"), (4, 5, None, None, "NO_MARKET_QUOTE"), (5, 7, None, None, "NO_MARKET_QUOTE")]


def test_gap_empties_the_books_of_its_connection(spark):
    from marketlens.operators import feeds

    schema = f"connection long, sid int, seq long, is_book boolean, t long, pos long, ticker long, event_type string, yes_bids {LEVEL}, no_bids {LEVEL}, price double, delta double, side string"

    def snap(c, seq, pos, ticker):
        return (c, 1, seq, True, pos, pos, ticker, "orderbook_snapshot", [(0.4, 5.0), (0.3, 0.0)], [(0.5, 7.0 + seq), (0.2, 1.0)], None, None, None)

    def move(c, seq, pos, ticker, change, sid=1):
        return (c, sid, seq, True, pos, pos, ticker, "orderbook_delta", None, None, 0.4, change, "yes")

    frames = [
        [snap(1, 1, 0, 10), snap(1, 2, 1, 11), move(1, 3, 2, 10, 2.0), move(1, 3, 3, 10, 2.0), snap(2, 7, 4, 20), move(1, 4, 5, 12, 1.0)],
        [move(2, 8, 6, 20, -9.0), move(2, 9, 7, 20, 3.0), move(1, 8, 8, 10, 1.0), move(1, 9, 9, 10, 1.0)],
        [snap(3, 1, 10, 10), move(3, 2, 11, 10, 1.0), move(3, 3, 12, 11, 1.0), move(2, None, 13, 20, 1.0), snap(4, 1, 14, 20), snap(4, 2, 15, 20), move(4, 3, 16, 20, -5.0)],
    ]
    frames = [spark.createDataFrame(x, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t") for x in frames]
    for upto, want in (
        (1, {(1, 10, "yes", 7.0), (1, 10, "no", 8.0), (1, 11, "yes", 5.0), (1, 11, "no", 9.0), (2, 20, "yes", 5.0), (2, 20, "no", 14.0)}),
        (2, {(2, 20, "yes", 3.0), (2, 20, "no", 14.0)}),
        (3, {(3, 10, "yes", 6.0), (3, 10, "no", 8.0), (4, 20, "no", 9.0)}),
    ):
        want |= {(c, t, "no", 1.0) for c, t, _, _ in want}
        changes = flows.drain(state.live_book_stream(batches(spark, "live", frames[:upto])), "live")
        live = feeds.live_levels(changes)
        assert {(r.connection, r.ticker, r.side, r["size"]) for r in live.collect()} == want and live.count() == len(want)
    gaps = {(r.connection, r.pos, r.missing) for r in changes.where("status = 'GAP'").collect()}
    assert gaps == {(1, 8, 3), (2, 13, 0)}


def test_results_do_not_pile_up(spark):
    frames = [[(1, 100 * n + i, 100_000 * (n + 1) + i, True) for i in range(50)] + ([(1, 1, 1000, False)] if n == 3 else []) for n in range(4)]
    frames = [spark.createDataFrame(x, "contract long, id long, t long, is_result boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t") for x in frames]
    path = scratch_path(spark, "settle-state")
    flows.append_to(state.settlement_stream(batches(spark, "settle-in", frames)), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    held = spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", "results").load()
    assert held.count() <= 100


def test_tail_follows_growing_and_shrinking_files(spark, tmp_path):
    from pyspark.sql import types as T

    from marketlens.streaming.tail import tail_json

    folder, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    schema = T.StructType([T.StructField("id", T.LongType())])

    def seen(text, mode):
        with open(folder / "a.jsonl", mode) as file:
            file.write(text)
        flows.append_to(tail_json(spark, str(folder), schema), out, checkpoint).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert seen('{"id": 1}\nbroken\n{"id": 2', "w") == [1]
    assert seen('}\n{"id": 3}\n', "a") == [1, 2, 3]
    assert seen('{"id": 9}\n', "w") == [1, 2, 3, 9]


def test_keyed_table_survives_a_restart_and_a_repeated_batch(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k long, v long")
    table = lambda: flows.KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=2, fan=2)
    held = lambda **args: {r.k: r.v for r in table().read(**args).collect()}
    assert table().read() is None
    table().write(rows((1, 1), (2, 1), (None, 1)), 0)
    for _ in range(2):  # the second time is the retry of batch 1
        table().write(rows((3, 2), (1, 2)), 1)
    assert held() == {1: 2, 2: 1, 3: 2, None: 1} and held(before=1) == {1: 1, 2: 1, None: 1}
    table().write(rows((4, 3), (None, 3)), 2)
    assert table().runs() == [(0, 1), (2, 2)] and held()[None] == 3
    table().write(rows((2, 4)), 3)
    table().write(rows((9, 9)).limit(0), 4)
    assert table().runs() == [(0, 3), (4, 4)] and held() == {1: 2, 2: 4, 3: 2, 4: 3, None: 3}
    bucket = table().bucket_of(2)
    assert held(buckets=[bucket])[2] == 4 and {**held(buckets=[0]), **held(buckets=[1])} == held()


def test_keyed_table_writes_what_a_batch_brings(spark, tmp_path):
    table = flows.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["v"], buckets=4, fan=4)
    size = lambda run: sum(f.stat().st_size for f in (tmp_path / "t" / run).rglob("*.parquet"))
    table.write(spark.range(200_000).selectExpr("id AS k", "id AS v"), 0)
    table.write(spark.range(10).selectExpr("id AS k", "id + 1000000 AS v"), 1)
    assert size("run=1-1") * 50 < size("run=0-0") and table.read().count() == 200_000 and table.read().where("v >= 1000000").count() == 10


def test_keyed_table_against_a_fold(spark, tmp_path):
    import random

    rnd = random.Random(3)
    batches = [[(rnd.randrange(6), rnd.randrange(50), 100 * n + i, rnd.choice([None, rnd.randrange(9)])) for i in range(5)] for n in range(7)]
    kept = lambda: flows.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["t", "i"], carried=["c"], buckets=2, fan=3)
    for n, batch in enumerate(batches):
        kept().write(spark.createDataFrame(batch, "k long, t long, i long, c long"), n)
    want = {}
    for k, t, i, c in sorted((r for b in batches for r in b), key=lambda r: r[1:3]):
        want[k] = (t, i, c if c is not None else want.get(k, (0, 0, None))[2])
    assert {r.k: (r.t, r.i, r.c) for r in kept().read().collect()} == want
    assert kept().runs() == [(0, 2), (3, 5), (6, 6)]


def test_a_snapshot_sent_twice_counts_once(spark):
    at = lambda minute: datetime(2024, 1, 1, 0, minute, tzinfo=timezone.utc)
    rows = [  # replayed in four slices of a quarter of an hour, so repeats come in later batches
        (1, 1, at(0), "a", 5), (1, 2, at(16), "a", 5), (1, 3, at(17), "b", 1), (1, 4, at(31), "b", 3), (1, 5, at(32), "c", 9), (1, 6, at(59), "b", 3), (1, 7, at(59), None, 3),
        (2, 8, at(16), "a", None), (2, 9, None, None, 3), (2, 10, at(50), None, 3),
    ]
    frame = spark.createDataFrame(rows, "feed long, id long, ts timestamp, input_key string, events long")
    out = flows.replayed(frame, "ts", lambda s: state.input_stream(s, minimum_events=3, spacing_seconds=300), "snapshots")
    got = {r.id: r.status for r in out.collect()}
    few, twice = "UNIVERSE_COVERAGE_INCOMPLETE", "DUPLICATE_SNAPSHOT"
    assert got == {1: "ACCEPTED", 2: twice, 3: few, 4: "ACCEPTED", 5: "MINIMUM_SPACING", 6: twice, 7: "ACCEPTED", 8: few, 9: "ACCEPTED", 10: twice}


def test_settlement_waits_and_settles_once(spark, tmp_path):
    def at(day):
        return f"2024-01-{day:02d} 00:00:00"

    from pyspark.sql import functions as F

    rows = [(1, 10, at(1), False), (1, 11, at(2), False), (1, 50, at(20), True), (1, 51, at(21), True), (1, 12, at(28), False), (2, 13, at(3), False)]
    frame = spark.createDataFrame(rows, "contract long, id long, ts string, is_result boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    out = flows.replayed(frame, "ts", state.settlement_stream, "settle-test")
    assert sorted((r.fill_id, r.result_id) for r in out.collect()) == [(10, 50), (11, 50)]


def test_only_iso_dates_are_explicit(spark):
    from marketlens.functions.text import dates_in_text, iso_dates_in_text
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("high for KNYC on March 3rd, 2024",)], "t string").select(iso_dates_in_text(F.col("t")).alias("iso"), dates_in_text(F.col("t")).alias("any")).first()
    assert row.iso == [] and len(row.any) == 1


def test_flatten_has_no_depth_limit(spark):
    from marketlens.operators.catalog import flatten_payload
    from pyspark.sql import functions as F

    deep = '{"a":{"b":[{"c":{"d":{"e":{"f":{"g":[["LEAF {[{"]]}}}}}]},"q":"\\\\\\""}'
    rows = flatten_payload(spark.createDataFrame([(1, deep)], "id long, p string"), ["id"], F.col("p")).collect()
    assert {(r.path, r.text) for r in rows} == {("a.b[0].c.d.e.f.g[0][0]", "LEAF {[{"), ("q", '\\"')}
    depth = 60
    texts = ['{"a":' * depth + "7" + "}" * depth, "[" * 300, '{"x": 1, "y": [], "z": {}, "n": null}', None, "", "not json", "5"]
    rows = flatten_payload(spark.createDataFrame(list(enumerate(texts)), "id long, p string"), ["id"], F.col("p")).collect()
    assert {(r.id, r.path, r.text) for r in rows} == {(0, ".".join("a" * depth), "7"), (2, "x", "1"), (6, "", "5")}


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest as pt

    from marketlens.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="yarn"), conf=conf)
    with pt.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(spark)


def test_replay_keeps_rows_without_a_time(spark):
    stamp = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for times in ([stamp, None, datetime(2024, 1, 2, tzinfo=timezone.utc)], [None, None]):
        frame = spark.createDataFrame(list(enumerate(times)), "i int, ts timestamp")
        out = flows.replayed(frame, "ts", lambda stream: stream, "null-times")
        assert sorted((r.i, r.ts is None) for r in out.collect()) == [(i, x is None) for i, x in enumerate(times)]
