"""Two-level scans against plain Python on random data, with blocks from one row to everything."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from marketlens.operators import books, evaluate, priors
from marketlens.operators.asof import asof_backward, asof_forward
from marketlens.operators.ordered import (
    clamped_running_sum, exact_quantiles, max_drawdown, ordinal, previous_row, running, value_block,
)

BLOCKS = [1, 7, 1000]


def rows(seed, n=120):
    rng = random.Random(seed)
    # One key holds more than half of the rows; times repeat.
    return [
        ("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(60), i, rng.choice([None, *range(-5, 6)]))
        for i in range(n)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, "key string, t long, seq long, v long")


def grouped(data):
    out = defaultdict(list)
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out[r[0]].append(r)
    return out


@pytest.mark.parametrize("width", BLOCKS)
def test_running_aggregates(spark, width):
    data = rows(1)
    aggs = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v")), "first": ("first", F.col("v"))}
    got = running(frame(spark, data), ["key"], ["t", "seq"], aggs, value_block("t", width))
    have = {r.seq: (r.s, r.hi, r.lo, r["last"], r["first"]) for r in got.collect()}
    for items in grouped(data).values():
        seen = []
        for r in items:
            if r[3] is not None:
                seen.append(r[3])
            want = (sum(seen), max(seen), min(seen), seen[-1], seen[0]) if seen else (None,) * 5
            assert have[r[2]] == want


@pytest.mark.parametrize("width", BLOCKS)
def test_previous_and_ordinal(spark, width):
    data = rows(2)
    got = previous_row(ordinal(frame(spark, data), ["key"], ["t", "seq"], "n", value_block("t", width)), ["key"], ["t", "seq"], {"p": "seq"}, value_block("t", width))
    have = {r.seq: (r.n, r.p) for r in got.collect()}
    for items in grouped(data).values():
        for i, r in enumerate(items):
            assert have[r[2]] == (i + 1, items[i - 1][2] if i else None)


@pytest.mark.parametrize("width", BLOCKS)
def test_clamped_sum_is_the_fold(spark, width):
    data = [(k, t, i, v or 0) for k, t, i, v in rows(3)]
    got = clamped_running_sum(frame(spark, data), ["key"], ["t", "seq"], "v", "size", value_block("t", width))
    have = {r.seq: r.size for r in got.collect()}
    for items in grouped(data).values():
        size = 0
        for r in items:
            size = max(0, size + r[3])
            assert have[r[2]] == size


@pytest.mark.parametrize("width", BLOCKS)
def test_drawdown(spark, width):
    data = [(k, t, i, v or 0) for k, t, i, v in rows(4)]
    df = frame(spark, data).withColumn("v", F.col("v").cast("double"))
    have = {r.key: r.max_drawdown for r in max_drawdown(df, ["key"], ["t", "seq"], "v", value_block("t", width)).collect()}
    for key, items in grouped(data).items():
        equity = peak = worst = 0
        for r in items:
            equity += r[3]
            peak = max(peak, equity)
            worst = min(worst, equity - peak)
        assert have[key] == worst


@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_quantiles(spark, width):
    data = [r for r in rows(5) if r[3] is not None]
    got = exact_quantiles(frame(spark, data), ["key"], "v", {"m": 0.5, "p90": 0.9, "lo": 0.0, "hi": 1.0}, width)
    for r in got.collect():
        values = sorted(x[3] for x in data if x[0] == r.key)
        for name, p in (("m", 0.5), ("p90", 0.9), ("lo", 0.0), ("hi", 1.0)):
            pos = p * (len(values) - 1)
            low = int(pos)
            want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (pos - low)
            assert abs(r[name] - want) < 1e-9


@pytest.mark.parametrize("seconds", [1, 20, 10_000])
def test_asof_both_ways(spark, seconds):
    data = rows(6)
    left = frame(spark, data[:50]).select("key", "seq", F.timestamp_seconds("t").alias("ts"))
    right = frame(spark, data[50:]).select("key", F.timestamp_seconds("t").alias("rt"), F.col("seq").alias("rid"))
    back = {r.seq: r.rid for r in asof_backward(left, right, ["key"], "ts", "rt", ["rt", "rid"], right_tie=["rid"], block_seconds=seconds).collect()}
    fore = {
        r.seq: r.rid
        for r in asof_forward(
            left, right, ["key"], "ts", "rt", ["rt", "rid"], right_tie=["rid"], latency=F.lit(5), tolerance_seconds=8, block_seconds=seconds
        ).collect()
    }
    for key, t, seq, _ in data[:50]:
        earlier = [(rt, rid) for k, rt, rid, _ in data[50:] if k == key and rt <= t]
        assert back[seq] == (max(earlier)[1] if earlier else None)
        later = [(rt, rid) for k, rt, rid, _ in data[50:] if k == key and rt >= t + 5]
        want = min(later) if later else None
        assert fore[seq] == (want[1] if want and want[0] - t - 5 <= 8 else None)


def test_book_fold_with_random_log(spark):
    rng = random.Random(9)
    level = "array<struct<price:double,size:double>>"
    log = []
    for i in range(200):
        snap = rng.random() < 0.08
        side = rng.choice(["yes", "no"])
        kind = "orderbook_snapshot" if snap else rng.choice(["orderbook_delta", "orderbook_delta", "trade"])
        sized = [(rng.choice([0.1, 0.2]), float(rng.randrange(0, 9)))]
        log.append((rng.choice(["a", "b"]), rng.randrange(100), i, kind, sized if snap else None, [(0.3, 2.0)] if snap else None,
                    None if kind != "orderbook_delta" else rng.choice([0.1, 0.2, 0.3]), None if kind != "orderbook_delta" else float(rng.randrange(-9, 9)), side))
    df = spark.createDataFrame(log, f"ticker string, t long, seq long, event_type string, yes_bids {level}, no_bids {level}, price double, delta double, side string")
    df = df.withColumn("ts", F.timestamp_seconds("t")).withColumn("received", F.col("ts"))
    have = {(r.ticker, r.side, r.price, r.seq): r["size"] for r in books.level_changes(df, block_seconds=10).collect()}
    want, state = {}, {}
    for ticker, t, seq, kind, yes, no, price, delta, side in sorted(log, key=lambda r: (r[1], r[2])):
        if "snapshot" in kind:
            state[ticker] = {("yes", p): s for p, s in yes if s > 0} | {("no", p): s for p, s in no if s > 0}
            want.update({(ticker, s, p, seq): size for (s, p), size in state[ticker].items()})
        elif ticker in state and price is not None:
            size = max(0.0, state[ticker].get((side, price), 0.0) + delta)
            state[ticker][(side, price)] = size
            want[(ticker, side, price, seq)] = size
    assert have == want


def test_blocks_put_larger_ones_last(spark):
    dates = [(f"d{i:02d}", 1.0, 1.0) for i in range(11)]
    df = spark.createDataFrame(dates, "date string, pnl double, capital double").withColumn("cell", F.lit(1))
    sizes = [r.dates for r in evaluate.block_rollup(df, ["cell"], 4).orderBy("block").collect()]
    assert sizes == [11 * (i + 1) // 4 - 11 * i // 4 for i in range(4)]


def test_draws_are_even(spark):
    df = spark.range(1, 2001).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(19))))
    picks = df.select(evaluate.draw_index(F.col("id"), F.col("slot"), 7, F.lit(20)).alias("p")).groupBy("p").count().collect()
    assert len(picks) == 20
    assert all(abs(r["count"] - 2000) < 250 for r in picks)


def test_books_at_any_time_equal_a_fold(spark):
    draw = random.Random(11)
    log, targets = [], []
    for i in range(900):
        ticker = draw.choice([1, 1, 1, 2])
        at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=draw.randrange(4000))
        kind = draw.choices(["orderbook_snapshot", "orderbook_delta", "target"], [1, 20, 6])[0]
        levels = [(p / 10, float(draw.randrange(4))) for p in draw.sample(range(1, 8), 3)]
        if kind == "target":
            targets.append((ticker, at, i))
        elif kind == "orderbook_snapshot":
            log.append((ticker, at, at, i, kind, levels, levels[:1], None, None, None))
        else:
            log.append((ticker, at, at, i, kind, None, None, draw.randrange(1, 8) / 10, float(draw.randrange(-3, 5)), draw.choice(["yes", "no"])))
    want = set()
    for ticker, at, number in targets:
        book = {}
        for row in sorted((r for r in log if r[0] == ticker and r[1] <= at), key=lambda r: (r[1], r[3])):
            if row[4] == "orderbook_snapshot":
                book = {(side, p): s for side, side_levels in (("yes", row[5]), ("no", row[6])) for p, s in side_levels if s > 0}
                seen = True
            elif any(r[4] == "orderbook_snapshot" and (r[1], r[3]) < (row[1], row[3]) for r in log if r[0] == ticker):
                book[row[9], row[7]] = max(0.0, book.get((row[9], row[7]), 0.0) + row[8])
        want |= {(ticker, number, side, p, s) for (side, p), s in book.items() if s > 0}
    level = "array<struct<price:double,size:double>>"
    frame = spark.createDataFrame(log, f"ticker long, ts timestamp, received timestamp, seq long, event_type string, yes_bids {level}, no_bids {level}, price double, delta double, side string")
    epochs = books.with_epoch(frame, F.col("event_type") == "orderbook_snapshot").where("event_type = 'orderbook_snapshot'").select("ticker", "ts", "seq", "epoch")
    asked = spark.createDataFrame(targets, "ticker long, at timestamp, target long")
    for size in (4, 256):
        got = books.book_at(books.level_changes(frame), epochs, asked, ["ticker", "target"], "at", block_changes=size).collect()
        assert {(r.ticker, r.target, r.side, r.price, r["size"]) for r in got} == want and len(got) == len(want)


def test_nearest_prior_equals_brute_force(spark):
    draw = random.Random(4)
    nan = float("nan")
    states = [
        (draw.choice([1, 1, 2]), date(2023, 1, 1) + timedelta(days=d), h, draw.choice([None, nan, *[draw.random() * 20 for _ in range(6)]]), draw.choice([None, 1.0, 2.0, 3.0]), draw.choice([None, *range(-3, 4)]))
        for d in range(0, 900, 7) for h in (10, 11, 14)
    ]
    scales = {"hour": 1.5, "high": 10.0, "drop": 1.0}
    frame = spark.createDataFrame([(p, d, h, x, y, None if r is None else float(r)) for p, d, h, x, y, r in states], "place int, day date, hour int, high double, drop double, residual double")

    def known(x):
        return x is not None and x == x

    def far(a, b):
        gaps = [((x - y) / s) ** 2 for x, y, s in zip(a[2:5], b[2:5], (1.5, 10.0, 1.0), strict=True) if known(x) and known(y)]
        return (sum(gaps) / len(gaps)) ** 0.5 if gaps else float("inf")

    got = {(r.place, r.day, r.hour): r for r in priors.nearest_prior(frame, frame, "place", "day", scales, tie=["day", "hour"], k=5, minimum=3, block_days=20, group_days=300).collect()}
    for row in states:
        past = [b for b in states if b[0] == row[0] and b[1] < row[1] and abs(b[2] - row[2]) <= 2 and b[5] is not None]
        best = sorted(float(b[5]) for b in sorted(past, key=lambda b: (far(row, b), b[1], b[2]))[:5])
        r = got[row[0], row[1], row[2]]
        assert (r.residuals or []) == best and r.neighbours == len(best)
        assert (r.terminal_probability is not None) == (len(best) >= 3)
    assert priors.nearest_prior(frame.limit(0), frame, "place", "day", scales, tie=["day"]).count() == 0


def test_nearest_prior_measures_many_places_in_one_group(spark, monkeypatch):
    import random

    rnd = random.Random(8)
    rows = [(f"p{p}", day, h, rnd.choice([1.0, 2.0, None, 5.0]), float(rnd.randrange(9))) for p in range(60) for day in range(12) for h in (3, 4, 7)]
    rows += [("big", day, h, float(rnd.randrange(40)), float(rnd.randrange(9))) for day in range(200) for h in (3, 4, 7)]
    frame = spark.createDataFrame(rows, "place string, d int, hour int, x double, residual double").withColumn("day", F.date_from_unix_date("d"))
    groups = frame.groupBy("place").count().count()
    monkeypatch.setattr(priors, "GROUP_ROWS", 10_000)
    out = priors.nearest_prior(frame, frame, "place", "day", {"x": 2.0}, tie=["day", "hour"], k=4, minimum=2)
    tasks = out.withColumn("_t", F.spark_partition_id()).where("place <> 'big'").select("_t").distinct().count()
    assert tasks == 1 and groups == 61
    past = {}
    for r in rows:
        past.setdefault(r[0], []).append(r)
    got = {(r.place, r.d, r.hour): (r.neighbours, sorted(r.residuals or [])) for r in out.collect()}
    for place, day, hour, x, _ in rows:
        far = sorted((float("inf") if x is None or b[3] is None else abs(x - b[3]) / 2.0, b[1], b[2], b[4]) for b in past[place] if b[1] < day and abs(b[2] - hour) <= 2)[:4]
        assert got[place, day, hour] == (len(far), sorted(f[3] for f in far))
