"""Streaming flows over the events, replayed in four batches with a restart before each; each has the rows of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings import books as bb
from marketlens.bindings.registry import query
from marketlens.bindings.tables import MSG, messages
from marketlens.bindings.views import EVENTS, six, table
from marketlens.functions.numbers import six as r6
from marketlens.functions.times import naive
from marketlens.operators import feeds
from marketlens.operators.ordered import ordinal, time_block
from marketlens.session import cut_lineage, scratch_path
from marketlens.streaming import flows, state


def event_rows(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


@query("stream_sequence_gate", "I2", f"WITH {MSG} SELECT connection, pos, seq, status, missing FROM sc")
def stream_sequence_gate(spark, d):
    return flows.replayed(cut_lineage(messages(spark, d).drop("value", "event_type")), "ts", state.gate_stream, "gate")


FEED = EVENTS + """, nm AS (SELECT *, user_id * 10 + CAST(day(ts) AS BIGINT) // 8 AS connection, floor(value) AS amount, row_number() OVER (PARTITION BY user_id, CAST(day(ts) AS BIGINT) // 8 ORDER BY ts, event_id) AS n FROM ev),
msg AS (SELECT connection, connection * 10 + k % 2 AS ticker, CASE WHEN k <> 98 THEN 1 END AS sid, CASE WHEN k = 7 THEN n - 2 WHEN k = 50 THEN n + 3 ELSE n END AS seq, event_id AS pos, ts, event_type, amount,
 (k % 9 + 1) / 10.0::DOUBLE AS price, CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END AS side FROM nm),
jd AS (SELECT *, CASE WHEN sid IS NULL THEN CASE WHEN event_type <> 'view' THEN 'GAP' ELSE 'UNSEQUENCED' END WHEN b IS NULL THEN 'APPLIED' WHEN seq <= b THEN 'DUPLICATE' WHEN seq > b + 1 THEN 'GAP' ELSE 'APPLIED' END AS raw
 FROM (SELECT *, max(seq) OVER (PARTITION BY connection, sid ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM msg)),
gap AS (SELECT connection, min(struct_pack(t := ts, p := pos)) AS g FROM jd WHERE raw = 'GAP' GROUP BY 1),
ap AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY connection, ticker ORDER BY ts, pos) AS epoch FROM jd LEFT JOIN gap USING (connection)
 WHERE raw = 'APPLIED' AND event_type <> 'view' AND (g IS NULL OR struct_pack(t := ts, p := pos) < g)),
chg AS (SELECT connection, ticker, epoch, ts, pos, side, price, CASE event_type WHEN 'error' THEN -amount ELSE floor(amount / 2) END AS change FROM ap WHERE event_type <> 'signup' AND epoch > 0
 UNION ALL SELECT connection, ticker, epoch, ts, pos, 'yes', price, amount + 1 FROM ap WHERE event_type = 'signup' UNION ALL SELECT connection, ticker, epoch, ts, pos, 'no', 0.5, amount + 5 FROM ap WHERE event_type = 'signup'),
fold AS (SELECT *, c - least(0, min(c) OVER w) AS size FROM (SELECT *, sum(change) OVER w AS c FROM chg WINDOW w AS (PARTITION BY connection, ticker, epoch, side, price ORDER BY ts, pos ROWS UNBOUNDED PRECEDING))
 WINDOW w AS (PARTITION BY connection, ticker, epoch, side, price ORDER BY ts, pos ROWS UNBOUNDED PRECEDING))"""


def live_book_changes(spark, d):
    """Books behind the gate: a connection a user and week, two tickers each; a gap comes from skipped or missing numbers."""
    e = event_rows(spark, d).withColumn("connection", F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 8))
    k, amount = F.col("k"), F.floor("value").cast("double")
    kind, price = F.col("event_type"), (k % 9 + 1) / 10.0
    n = F.col("_n")
    placed = ordinal(e, ["connection"], ["ts", "event_id"], "_n", time_block("ts"))
    entry = lambda p, size: F.array(F.struct(p.cast("double").alias("price"), size.alias("size")))
    snap = kind == "signup"
    rows = placed.select(
        "connection", F.when(k != 98, F.lit(1)).alias("sid"), F.when(k == 7, n - 2).when(k == 50, n + 3).otherwise(n).alias("seq"),
        (kind != "view").alias("is_book"), "ts", F.col("event_id").alias("pos"), (F.col("connection") * 10 + k % 2).alias("ticker"),
        F.when(snap, "orderbook_snapshot").when(kind == "view", "ticker").otherwise("orderbook_delta").alias("event_type"),
        F.when(snap, entry(price, amount + 1)).alias("yes_bids"), F.when(snap, entry(F.lit(0.5), amount + 5)).alias("no_bids"),
        F.when(~snap, price).alias("price"), F.when(~snap, F.when(kind == "error", -amount).otherwise(F.floor(amount / 2).cast("double"))).alias("delta"),
        F.when(k % 3 == 0, "yes").otherwise("no").alias("side"),
    )
    return flows.replayed(cut_lineage(rows), "ts", state.live_book_stream, "live-book")


@query("stream_live_book", "I1 I2", f"""WITH {FEED} SELECT connection, ticker, side, price, arg_max(size, struct_pack(t := ts, p := pos)) AS size FROM fold
 JOIN (SELECT connection, ticker, max(epoch) AS epoch FROM ap GROUP BY ALL) USING (connection, ticker, epoch) WHERE connection NOT IN (SELECT connection FROM gap) GROUP BY ALL HAVING arg_max(size, struct_pack(t := ts, p := pos)) > 0""")
def stream_live_book(spark, d):
    return feeds.live_levels(live_book_changes(spark, d))


@query("stream_gated_changes", "I1 I2", f"""WITH {FEED} SELECT connection, ticker, CAST(epoch AS BIGINT) AS epoch, side, price, pos, size, 'LEVEL' AS status, 0::BIGINT AS missing FROM fold
 UNION ALL SELECT connection, NULL, NULL, NULL, NULL, pos, NULL, 'GAP', CASE WHEN sid IS NULL THEN 0 ELSE seq - b - 1 END FROM jd JOIN gap USING (connection) WHERE struct_pack(t := ts, p := pos) = g""")
def stream_gated_changes(spark, d):
    return live_book_changes(spark, d).where("status <> 'BOOK'").drop("ts")


@query("stream_book_state", "I1", f"WITH {bb.LOG} SELECT ticker, CAST(epoch AS BIGINT) AS epoch, side, price, seq, size FROM lev")
def stream_book_state(spark, d):
    return flows.replayed(bb.depth_log_of(event_rows(spark, d)).drop("received"), "ts", state.book_stream, "book")


#: Seconds after which a signal that found no quote is given up.
PATIENCE = 43_200


@query("stream_delayed_fill", "I6 I7", f"""WITH {bb.SIG}, mk AS (SELECT s.signal_id, s.contract, s.side, CAST(hz AS BIGINT) AS horizon, min(struct_pack(t := b.ts, e := b.seq)) AS h FROM sig s, (SELECT unnest([300, 3600, 86400]) AS hz)
 JOIN book b ON b.contract = s.contract AND b.ts BETWEEN s.signal_time + to_seconds(hz) AND s.signal_time + to_seconds(hz + {PATIENCE}) GROUP BY ALL)
SELECT mk.contract, mk.signal_id, mk.horizon, mk.side, mk.h.e AS fill_id, mk.h.t AS fill_time, {six("CASE WHEN mk.side = 'YES' THEN b.yes_ask ELSE b.no_ask END")} AS price,
 CASE WHEN (CASE WHEN mk.side = 'YES' THEN b.yes_ask ELSE b.no_ask END) IS NULL THEN 'NO_EXECUTABLE_ASK' ELSE 'FILLED' END AS status FROM mk JOIN book b ON b.seq = mk.h.e
UNION ALL SELECT s.contract, s.signal_id, CAST(hz AS BIGINT), s.side, NULL, NULL, NULL, 'NO_MARKET_QUOTE' FROM sig s, (SELECT unnest([300, 3600, 86400]) AS hz)
 WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.signal_id = s.signal_id AND mk.horizon = hz) AND s.signal_time + to_seconds(hz + {PATIENCE}) < (SELECT max(ts) - INTERVAL 1 MINUTE FROM ev)""")
def stream_delayed_fill(spark, d):
    from marketlens.bindings.views import quotes_of

    q = quotes_of(event_rows(spark, d))
    is_quote = F.col("event_type") != "signup"
    horizons = F.when(is_quote, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(*[F.lit(h).cast("bigint") for h in (300, 3600, 86_400)]))
    rows = q.withColumn("is_quote", is_quote).withColumn("horizon", F.explode(horizons)).select(
        "contract", "ts", F.col("seq").alias("id"), "is_quote", "horizon",
        F.timestamp_micros(F.unix_micros("ts") + F.col("horizon") * 1_000_000).alias("due"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("horizon") + PATIENCE) * 1_000_000).alias("expires"),
        F.when(F.col("k") % 2 == 0, "YES").otherwise("NO").alias("side"), "yes_ask", "no_ask",
    )
    out = flows.replayed(rows, "ts", state.fill_stream, "fills")
    return out.withColumns({"fill_time": naive(F.col("fill_time")), "price": r6(F.col("price"))})


@query("stream_health", "I12", """WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'STALE_HEALTH' WHEN 'purchase' THEN 'INVALID_HEALTH_TTL' ELSE '' END AS sig FROM events),
l AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS old FROM s)
SELECT user_id AS component, event_id, CASE WHEN sig = '' THEN 'OK' ELSE 'ERROR' END AS status, CASE WHEN old = '' THEN 'OK' ELSE 'ERROR' END AS previous_status, old AS previous_reason FROM l WHERE sig <> old""")
def stream_health(spark, d):
    kind = F.col("event_type")
    reason = F.when(kind == "error", "STALE_HEALTH").when(kind == "purchase", "INVALID_HEALTH_TTL").otherwise("CURRENT_HEALTH")
    rows = event_rows(spark, d).select(
        F.col("user_id").alias("component"), "ts", "event_id", reason.alias("reason"),
        F.when(kind.isin("error", "purchase"), "ERROR").otherwise("OK").alias("status"),
    )
    return flows.replayed(rows, "ts", state.health_stream, "health")


@query("stream_once_per_event", "I8 I9", "SELECT user_id || ':' || CAST(ts AS DATE) AS event, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL")
def stream_once_per_event(spark, d):
    named = F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("event")
    signals = event_rows(spark, d).where(F.col("event_type") == "signup").select(named, "event_id", "ts")
    return flows.replayed(signals, "ts", state.claim_stream, "claims").select("event", "event_id")


@query("stream_type_counts", "I5 I15", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY ALL")
def stream_type_counts(spark, d):
    from marketlens.operators.feeds import type_counts

    path = scratch_path(spark, "counts")
    kept = flows.KeyedTable(spark, f"{path}/table", ["window_start", "event_type"], fan=2)

    def run(stream):
        counts = type_counts(stream.withWatermark("ts", "2 hours"), "ts", "event_type")
        flows.keep_updates(counts, kept, f"{path}/checkpoint").awaitTermination()

    flows.replay(event_rows(spark, d), "ts", run, "counts-in")
    return kept.read().withColumns({c: naive(F.col(c)) for c in ("window_start", "last_seen")})


#: Series whose quotes the table shows; others are kept out before they are stored.
QUOTED_SERIES = ("KXHIGHNY", "KXLOWTCHI")


@query("stream_best_quote", "I3 A12", f"""WITH {EVENTS}, t AS (SELECT CASE user_id % 3 WHEN 0 THEN 'KXHIGHNY' WHEN 1 THEN 'kxlowtchi' ELSE 'KXOTHER' END || '-' || user_id AS ticker, *, struct_pack(t := ts, e := event_id) AS o FROM ev WHERE user_id % 3 < 2)
SELECT ticker, arg_max(event_id, o) AS event_id, arg_max(value, o) AS value, arg_max(value, o) FILTER (event_type = 'purchase') AS last_trade, arg_max(k, o) FILTER (event_type = 'purchase') AS last_trade_size FROM t GROUP BY ticker""")
def stream_best_quote(spark, d):
    path = scratch_path(spark, "quotes")
    traded = F.col("event_type") == "purchase"
    series = F.when(F.col("user_id") % 3 == 0, "KXHIGHNY").when(F.col("user_id") % 3 == 1, "kxlowtchi").otherwise("KXOTHER")
    rows = event_rows(spark, d).select(
        F.concat_ws("-", series, "user_id").alias("ticker"), "ts", "event_id", "value", F.when(traded, F.col("value")).alias("last_trade"), F.when(traded, F.col("k")).alias("last_trade_size"),
    )

    def kept():
        # a new table object each time, as after a restart: what is kept is on disk
        return flows.KeyedTable(spark, f"{path}/table", ["ticker"], ["ts", "event_id"], carried=["last_trade", "last_trade_size"], fan=2)

    def run(stream):
        flows.keep_latest(feeds.of_series(stream, "ticker", QUOTED_SERIES), kept(), f"{path}/checkpoint").awaitTermination()

    flows.replay(rows, "ts", run, "quotes-in")
    return kept().read().select("ticker", "event_id", "value", "last_trade", "last_trade_size")


@query("stream_raw_archive", "I4 I13 A10", "SELECT event_id, user_id, CAST(ts AS DATE) AS date, CAST(extract(hour FROM ts) AS INTEGER) AS hour FROM events")
def stream_raw_archive(spark, d):
    path = scratch_path(spark, "archive")

    def run(stream):
        whole = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "k"))
        rows = flows.raw_archive(stream.select(whole.alias("value"), "ts"), "ts").drop("ts")
        flows.append_to(rows, f"{path}/table", f"{path}/checkpoint", partitions=["date", "hour"], fmt="text", compression="gzip").awaitTermination()

    flows.replay(event_rows(spark, d), "ts", run, "archive-in")
    read = spark.read.text(f"{path}/table")
    field = lambda name: F.get_json_object("value", f"$.{name}").cast("bigint").alias(name)
    return read.select(field("event_id"), field("user_id"), "date", "hour")


@query("stream_settlement", "I11", """WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), r AS (SELECT event_id AS result_id, user_id, ts AS result_time FROM events WHERE event_type = 'purchase')
SELECT f.event_id, f.user_id, arg_min(r.result_id, struct_pack(t := r.result_time, e := r.result_id)) AS result_id FROM f JOIN r ON f.user_id = r.user_id AND r.result_time >= f.ts GROUP BY ALL""")
def stream_settlement(spark, d):
    rows = event_rows(spark, d).where(F.col("event_type").isin("view", "purchase")).select(
        F.col("user_id").alias("contract"), F.col("event_id").alias("id"), "ts", (F.col("event_type") == "purchase").alias("is_result")
    )
    out = flows.replayed(rows, "ts", state.settlement_stream, "settled")
    return out.select(F.col("fill_id").alias("event_id"), F.col("contract").alias("user_id"), "result_id")


@query("stream_fan_out", "I14", "SELECT 'cheap' AS strategy, event_id FROM events WHERE value < 20 UNION ALL SELECT 'rich', event_id FROM events WHERE value > 80")
def stream_fan_out(spark, d):
    path = scratch_path(spark, "fanout")

    def broken(_batch):
        raise RuntimeError("strategy fails")

    strategies = {"cheap": lambda b: b.where("value < 20").select("event_id"), "broken": broken, "rich": lambda b: b.where("value > 80").select("event_id")}
    flows.replay(event_rows(spark, d), "ts", lambda stream: flows.fan_out(stream, strategies, path, f"{path}/checkpoint").awaitTermination(), "fanout-in")
    return spark.read.parquet(f"{path}/signals").select(F.col("strategy").cast("string").alias("strategy"), "event_id")


@query("stream_fresh_rows", "I10", f"WITH {EVENTS} SELECT event_id, user_id FROM ev WHERE k BETWEEN 0 AND 60")
def stream_fresh_rows(spark, d):
    now = F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 1_000_000)
    return flows.replayed(event_rows(spark, d), "ts", lambda s: flows.fresh_rows(s, "ts", now, 60), "fresh").select("event_id", "user_id")


#: Events a snapshot must cover, and seconds between two runs of a feed.
LEAST_EVENTS, SPACING = 3, 10_800


@query("stream_input_gate", "I10", f"""WITH RECURSIVE {EVENTS}, x AS (SELECT user_id AS feed, event_id AS id, ts, (k % 4) || '|' || event_type || '|' || CASE WHEN k < 50 THEN CAST(k % 2 AS VARCHAR) ELSE '' END AS key, k % 10 AS events,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
g AS (SELECT feed, 0::BIGINT AS n, NULL::BIGINT AS id, '' AS status, 0::BIGINT AS events, NULL::VARCHAR AS lk, NULL::TIMESTAMP AS lt FROM (SELECT DISTINCT feed FROM x)
 UNION ALL SELECT feed, n, id, status, events, CASE WHEN status = 'ACCEPTED' THEN key ELSE lk END, CASE WHEN status = 'ACCEPTED' THEN ts ELSE lt END FROM (SELECT x.*, g.lk, g.lt, CASE WHEN x.key = g.lk THEN 'DUPLICATE_SNAPSHOT'
  WHEN x.ts < g.lt + to_seconds({SPACING}) THEN 'MINIMUM_SPACING' WHEN x.events < {LEAST_EVENTS} THEN 'UNIVERSE_COVERAGE_INCOMPLETE' ELSE 'ACCEPTED' END AS status FROM g JOIN x ON x.feed = g.feed AND x.n = g.n + 1))
SELECT feed, id, status, CAST(events AS BIGINT) AS events FROM g WHERE n > 0""")
def stream_input_gate(spark, d):
    k = F.col("k")
    key = feeds.snapshot_key(k % 4, F.col("event_type"), F.when(k < 50, k % 2))
    rows = event_rows(spark, d).select(F.col("user_id").alias("feed"), F.col("event_id").alias("id"), "ts", key.alias("input_key"), (k % 10).alias("events"))
    return flows.replayed(rows, "ts", lambda s: state.input_stream(s, minimum_events=LEAST_EVENTS, spacing_seconds=SPACING), "input-gate")


@query("bounded_seen", "I9", "SELECT user_id, event_id FROM (SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id) ORDER BY ts DESC, event_id DESC LIMIT 50")
def bounded_seen(spark, d):
    from marketlens.bindings.views import events
    from marketlens.operators.ordered import latest_per_key

    newest = latest_per_key(events(spark, d), ["user_id"], ["ts", "event_id"])
    return newest.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("user_id", "event_id")
