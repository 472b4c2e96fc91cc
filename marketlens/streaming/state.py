"""Keyed state of the live rules: sequence gate, gated live books, book fold, delayed fills, health changes, settlement.

Keys share a fixed number of buckets by their hash. A processor gets the rows of a bucket, loads the state of its keys once per batch, decides
all of them on whole columns in time order and writes back what changed, so the calls of a batch do not grow with the keys. Rows are ordered
inside a batch; a row that comes in a later batch than its time would ask is taken as it comes. The same rules exist as batch operators; tests
compare the two.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Processors travel to the Python workers by value: executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

GATE_OUTPUT = "connection bigint, pos bigint, seq bigint, status string, missing bigint"
LIVE_OUTPUT = "connection bigint, ticker bigint, epoch bigint, side string, price double, ts timestamp, pos bigint, size double, status string, missing bigint"
BOOK_OUTPUT = "ticker bigint, epoch bigint, side string, price double, seq bigint, size double"
FILL_OUTPUT = "contract bigint, signal_id bigint, horizon bigint, side string, fill_id bigint, fill_time timestamp, price double, status string"
CLAIM_OUTPUT = "event string, event_id bigint, ts timestamp"
SETTLED_OUTPUT = "contract bigint, fill_id bigint, result_id bigint"
INPUT_OUTPUT = "feed bigint, id bigint, status string, events bigint"
HEALTH_OUTPUT = "component bigint, event_id bigint, status string, previous_status string, previous_reason string"


#: Buckets of keys, and so calls of a processor in a batch. A bucket's state and its rows of a batch are in memory together, so many keys ask for
#: more; a running stream keeps the number that its checkpoint began with.
BUCKETS = 256

#: Below every number, where none has been seen.
NONE = np.iinfo("int64").min


def _batch(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def _first_from(codes: np.ndarray, values: np.ndarray, asked: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each asked code and least value the first place in ``codes`` and ``values``, sorted by both, that is not less."""
    distinct = np.unique(values)
    width = len(distinct) + 1
    return np.searchsorted(codes * width + np.searchsorted(distinct, values), asked * width + np.searchsorted(distinct, least))


class Held:
    """Rows of state of all keys of a bucket, read and written once per batch."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str, types: dict[str, str]) -> None:
        self.state = handle.getListState(name, schema)
        self.types = types

    def read(self) -> pd.DataFrame:
        rows = [tuple(r) for r in self.state.get()] if self.state.exists() else []
        return pd.DataFrame(rows, columns=list(self.types)).astype(self.types)

    def write(self, now: pd.DataFrame, before: pd.DataFrame) -> None:
        now = now[list(self.types)]
        if len(now) == len(before) and (now.to_numpy() == before.to_numpy()).all():
            return
        if len(now):
            self.state.put(list(zip(*[now[c].tolist() for c in self.types], strict=True)))
        else:
            self.state.clear()


def _numbers(held: pd.DataFrame, keys: list[str], value: str, asked: pd.DataFrame, missing: int) -> np.ndarray:
    """The held whole number of each asked key."""
    known = pd.Series(held[value].to_numpy(), index=pd.MultiIndex.from_frame(held[keys]), dtype="int64")
    return known.reindex(pd.MultiIndex.from_frame(asked[keys]), fill_value=missing).to_numpy()


def _highest(held: pd.DataFrame, new: pd.DataFrame, keys: list[str], value: str) -> pd.DataFrame:
    return pd.concat([held, new[[*keys, value]]], ignore_index=True).astype("int64").groupby(keys, as_index=False)[value].max()


class SequenceGate(StatefulProcessor):
    """Continuity per connection: last number of each subscription, and whether a gap has occurred.

    The numbers before the first gap decide; from it on everything is invalidated until a new connection, and the numbers are forgotten. Per
    subscription the last applied number is the running maximum, so a batch is decided on whole columns. ``missing`` counts the numbers that
    a gap left out; a gap without numbers counts none.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = Held(handle, "last", "connection bigint, sid bigint, seq bigint", dict.fromkeys(("connection", "sid", "seq"), "int64"))
        self.broken = Held(handle, "broken", "connection bigint, at bigint", dict.fromkeys(("connection", "at"), "int64"))

    def judged(self, batch: pd.DataFrame) -> pd.DataFrame:
        """The rows of a batch, in order, with status and missing; the state moves on."""
        last, broken = self.last.read(), self.broken.read()
        numbered = (batch["sid"].notna() & batch["seq"].notna()).to_numpy()
        key = ["connection", "sid"]
        n = batch.loc[numbered, [*key, "seq"]].astype("int64")
        n["top"] = n.groupby(key)["seq"].cummax()
        previous = np.maximum(_numbers(last, key, "seq", n, NONE), n.groupby(key)["top"].shift(fill_value=NONE).to_numpy())
        seq, seen = n["seq"].to_numpy(), previous != NONE
        gap, duplicate, missing = (~numbered & batch["is_book"].astype(bool).to_numpy(), np.zeros(len(batch), bool), np.zeros(len(batch), "int64"))
        gap[numbered], duplicate[numbered] = seen & (seq > previous + 1), seen & (seq <= previous)
        missing[numbered] = np.where(seen, seq - previous - 1, 0)
        place, connection = np.arange(len(batch)), batch["connection"]
        first = pd.Series(place[gap]).groupby(connection.to_numpy()[gap]).min()
        at = connection.map(first).fillna(len(batch)).mask(connection.isin(broken["connection"]), -1).to_numpy()
        status = np.select([place > at, gap, duplicate, ~numbered], ["INVALIDATED", "GAP", "DUPLICATE", "UNSEQUENCED"], "APPLIED")
        ended = batch[status == "GAP"][["connection", "pos"]].rename(columns={"pos": "at"}).astype("int64")
        now = _highest(last, n[(place < at)[numbered]], key, "seq")
        self.last.write(now[~now["connection"].isin(ended["connection"])], last)
        self.broken.write(pd.concat([broken, ended], ignore_index=True), broken)
        return batch.assign(status=status, missing=np.where(status == "GAP", missing, 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.judged(_batch(rows, ["ts", "pos"]))
        yield pd.DataFrame({
            "connection": found["connection"], "pos": found["pos"].astype("int64"), "seq": found["seq"].astype("Int64"), "status": found["status"], "missing": found["missing"],
        })


class LevelGate(SequenceGate):
    """The gate in front of the books of a connection: applied book messages go on as level rows, a new book and a gap as one row
    without a level.

    A snapshot starts a new epoch of its ticker; deltas before any snapshot of this connection go nowhere. So nothing of an older
    connection, and nothing after a gap, can reach a book.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.epochs = Held(handle, "epochs", "connection bigint, ticker bigint, epoch bigint", dict.fromkeys(("connection", "ticker", "epoch"), "int64"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.judged(_batch(rows, ["ts", "pos"]))
        applied = found[(found["status"] == "APPLIED") & found["is_book"].astype(bool) & found["ticker"].notna()].astype({"ticker": "int64"})
        gaps = found[found["status"] == "GAP"][["connection", "ts", "pos", "missing"]].assign(status="GAP")
        book, before = ["connection", "ticker"], self.epochs.read()
        snapshot = applied["event_type"].str.lower().str.contains("snapshot", na=False).astype(bool)
        count = snapshot.astype("int64").groupby([applied[c] for c in book]).cumsum() + _numbers(before, book, "epoch", applied, 0)
        placed = applied.assign(epoch=count, snapshot=snapshot)
        live = placed[placed["epoch"] > 0]
        now = _highest(before, live, book, "epoch")
        self.epochs.write(now[~now["connection"].isin(gaps["connection"])], before)
        keep = [*book, "epoch", "ts", "pos"]
        delta = live[~live["snapshot"] & single_changes(live)][[*keep, "side", "price", "delta"]]
        parts = [delta, snapshot_levels(live[live["snapshot"]], keep)]
        levels = pd.concat(parts, ignore_index=True).assign(status="LEVEL", missing=0)
        books = live[live["snapshot"]][keep].assign(status="BOOK", missing=0)
        out = pd.concat([levels, books, gaps], ignore_index=True).reindex(columns=["connection", "ticker", "epoch", "side", "price", "ts", "pos", "delta", "status", "missing"])
        # keys without nulls: a null would turn the whole numbers of its batch into floating point, which are no keys
        out = out.fillna({"ticker": -1, "epoch": 0, "side": "", "price": 0.0})
        yield out.astype({"connection": "int64", "ticker": "int64", "epoch": "int64", "pos": "int64", "missing": "int64"})


class HeldLevels:
    """The live levels of each book in its newest epoch, a book being named by ``book``."""

    def __init__(self, handle: StatefulProcessorHandle, book: list[str]) -> None:
        self.book = book
        schema = "".join(f"{c} bigint, " for c in book) + "epoch bigint, side string, price double, size double"
        self.held = Held(handle, "held", schema, {**dict.fromkeys([*book, "epoch"], "int64"), "side": "object", "price": "float64", "size": "float64"})

    def fold(self, changes: pd.DataFrame, newest: pd.DataFrame) -> np.ndarray:
        """Sizes after each change, in order: a running sum per epoch, side and price that restarts from zero when it would go below.

        ``newest`` has the epoch of each book that the batch touches; levels of its older epochs are void.
        """
        held = self.held.read()
        level = [*self.book, "epoch", "side", "price"]
        changes = changes[[*level, "delta"]].astype({**{c: t for c, t in self.held.types.items() if c in level}, "delta": "float64"})
        carried = changes[level].merge(held, on=level, how="left")["size"].fillna(0.0).to_numpy()
        keys = [changes[c] for c in level]
        total = changes["delta"].groupby(keys).cumsum() + carried
        size = total - total.groupby(keys).cummin().clip(upper=0.0)
        now = pd.concat([held, changes.assign(size=size)[[*level, "size"]]], ignore_index=True).drop_duplicates(level, keep="last")
        live = now["epoch"].to_numpy() == np.maximum(now["epoch"].to_numpy(), _numbers(newest, self.book, "epoch", now, NONE))
        self.held.write(now[live & (now["size"] > 0).to_numpy()], held)
        return size.to_numpy()


def snapshot_levels(books: pd.DataFrame, keep: list[str]) -> pd.DataFrame:
    """One row per level of each snapshot, its size as a change, with the ``keep`` columns."""
    parts = []
    for side in ("yes", "no"):
        held = books[[*keep, f"{side}_bids"]].explode(f"{side}_bids", ignore_index=True).dropna(subset=[f"{side}_bids"])
        pairs = [(x["price"], x["size"]) if isinstance(x, dict) else (x[0], x[1]) for x in held[f"{side}_bids"]]
        level = pd.DataFrame(pairs, columns=["price", "delta"], index=held.index, dtype="float64")
        parts.append(held[keep].assign(side=side, price=level["price"], delta=level["delta"])[level["delta"] > 0])
    return pd.concat(parts, ignore_index=True)


def single_changes(rows: pd.DataFrame) -> pd.Series:
    """Which rows change one level."""
    return rows["side"].isin(["yes", "no"]) & rows["price"].notna() & rows["delta"].notna()


class LevelFold(StatefulProcessor):
    """The books of a connection's tickers behind the gate; a new epoch voids what is held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = HeldLevels(handle, ["connection", "ticker"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, ["ts", "pos"]).assign(size=float("nan"))
        level = batch["side"] != ""
        newest = batch[batch["status"] != "GAP"].groupby(self.levels.book, as_index=False)["epoch"].max()
        batch.loc[level, "size"] = self.levels.fold(batch[level], newest)
        yield batch[LIVE_COLUMNS]


LIVE_COLUMNS = ["connection", "ticker", "epoch", "side", "price", "ts", "pos", "size", "status", "missing"]


class BookFold(StatefulProcessor):
    """Levels of each ticker since its last snapshot; a delta before any snapshot is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = HeldLevels(handle, ["ticker"])
        self.epochs = Held(handle, "epochs", "ticker bigint, epoch bigint", dict.fromkeys(("ticker", "epoch"), "int64"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, before = _batch(rows, ["ts", "seq"]), self.epochs.read()
        snapshot = batch["event_type"].str.lower().str.contains("snapshot", na=False).astype(bool)
        batch["epoch"] = snapshot.astype("int64").groupby(batch["ticker"]).cumsum() + _numbers(before, ["ticker"], "epoch", batch, 0)
        batch["place"] = batch.index
        keep = ["ticker", "epoch", "place", "seq"]
        single = batch[~snapshot & (batch["epoch"] > 0) & single_changes(batch)][[*keep, "side", "price", "delta"]]
        changes = pd.concat([single, snapshot_levels(batch[snapshot], keep)], ignore_index=True).sort_values("place", kind="stable", ignore_index=True)
        newest = batch.groupby("ticker", as_index=False)["epoch"].max()
        changes["size"] = self.levels.fold(changes, newest)
        self.epochs.write(_highest(before, newest[newest["epoch"] > 0], ["ticker"], "epoch"), before)
        yield changes.astype({"ticker": "int64", "epoch": "int64", "seq": "int64"})[["ticker", "epoch", "side", "price", "seq", "size"]]


class DelayedFill(StatefulProcessor):
    """Signals wait until the first quote of their contract at or after they are due, or until they expire.

    Waiting and new signals are matched with the quotes of the batch by one search on contract and time. A signal that comes after a
    quote it could have used meets only later quotes, as live ones do. A signal whose last moment passes without a quote is given up: a quote that
    comes later shows it within the batch, or a timer of the bucket at the watermark. Either way it gives a row, and leaves the state.
    """

    TYPES = {"contract": "int64", "id": "int64", "horizon": "int64", "due": "int64", "expires": "int64", "side": "object"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = Held(handle, "pending", "contract bigint, id bigint, horizon bigint, due bigint, expires bigint, side string", self.TYPES)

    def _keep(self, waiting: pd.DataFrame, before: pd.DataFrame) -> None:
        """The whole list in one write; a timer at the earliest expiry."""
        self.pending.write(waiting, before)
        if len(waiting):
            self.handle.registerTimer(int(waiting["expires"].min()) // 1000 + 1)

    @staticmethod
    def _rows(done: pd.DataFrame, used: pd.DataFrame | None) -> pd.DataFrame:
        done = done.reset_index(drop=True)
        row = {"contract": done["contract"].astype("int64"), "signal_id": done["id"].astype("int64"), "horizon": done["horizon"].astype("int64"), "side": done["side"]}
        if used is None:
            return pd.DataFrame({**row, "fill_id": pd.Series(pd.NA, done.index, "Int64"), "fill_time": pd.Series(pd.NaT, done.index, "datetime64[us]"), "price": pd.Series(float("nan"), done.index).where(lambda x: x == x, None).astype("object"), "status": "NO_MARKET_QUOTE"})
        price = used["yes_ask"].where(done["side"] == "YES", used["no_ask"])
        status = pd.Series("FILLED", done.index).mask(price.isna(), "NO_EXECUTABLE_ASK")
        return pd.DataFrame({**row, "fill_id": used["id"].astype("Int64"), "fill_time": used["ts"], "price": price, "status": status})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, ["contract", "ts", "is_quote", "id"])
        batch["place"] = batch.index
        quotes = batch[batch["is_quote"]].reset_index(drop=True)
        new = batch[~batch["is_quote"]]
        new = new.assign(due=_micros(new["due"]), expires=_micros(new["expires"]))[[*self.TYPES, "place"]]
        kept = self.pending.read()
        waiting = pd.concat([kept.assign(place=-1), new], ignore_index=True) if len(kept) else new.reset_index(drop=True)
        # the first quote that is late enough: on time for signals that came before it, else after the signal's place
        contracts, times, asked = quotes["contract"].to_numpy(), _micros(quotes["ts"]).to_numpy(), waiting["contract"].to_numpy()
        names = np.unique(contracts)
        by_time = _first_from(np.searchsorted(names, contracts), times, np.searchsorted(names, asked), waiting["due"].to_numpy())
        index = np.maximum(by_time, quotes["place"].searchsorted(waiting["place"], side="right"))
        found = index < np.searchsorted(contracts, asked, side="right")
        done, used = waiting[found], quotes.iloc[index[found]].reset_index(drop=True)
        late = times[index[found]] > done["expires"].to_numpy()
        self._keep(waiting[~found], kept)
        yield self._rows(done[~late], used[~late].reset_index(drop=True))
        if late.any():
            yield self._rows(done[late], None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self.pending.read()
        gone = waiting["expires"] < timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(waiting[~gone], waiting)
        yield self._rows(waiting[gone], None)


class HealthChange(StatefulProcessor):
    """Last signature of a component; a row comes out only when it changes. No signature is an empty one, and is not held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.signatures = Held(handle, "signatures", "component bigint, reason string", {"component": "int64", "reason": "object"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, before = _batch(rows, ["ts", "event_id"]), self.signatures.read()
        component = batch["component"].astype("int64")
        new = batch["reason"].where(batch["status"] == "ERROR", "")
        held = component.map(before.set_index("component")["reason"]).fillna("")
        old = new.groupby(component).shift().where(component.duplicated(), held)
        now = pd.concat([before, pd.DataFrame({"component": component, "reason": new})], ignore_index=True).drop_duplicates("component", keep="last")
        self.signatures.write(now[now["reason"] != ""].sort_values("component"), before)
        word = lambda s: s.ne("").map({True: "ERROR", False: "OK"})
        yield pd.DataFrame({
            "component": component, "event_id": batch["event_id"].astype("int64"), "status": word(new), "previous_status": word(old), "previous_reason": old,
        })[new != old]


class InputGate(StatefulProcessor):
    """Whether a snapshot of a feed is worth a run: the last accepted key and time are kept.

    A snapshot with the key of the last accepted one is a duplicate, one that follows it by less than ``spacing`` microseconds comes too
    soon, and one that covers fewer than ``minimum`` events is incomplete, in this order. Only an accepted snapshot moves the state.
    A null key is a key of its own; a null time is at the start; a null count covers nothing.
    """

    def __init__(self, minimum: int, spacing: int) -> None:
        self.minimum, self.spacing = minimum, spacing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = Held(handle, "accepted", "feed bigint, input_key string, at bigint", {"feed": "int64", "input_key": "object", "at": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, before = _batch(rows, ["at", "id"]), self.accepted.read()
        accepted = {feed: (input_key, at) for feed, input_key, at in before.itertuples(index=False)}
        statuses = []
        events = batch["events"].fillna(0).astype("int64")
        keys = batch["input_key"].astype("object").where(batch["input_key"].notna(), None)
        for feed, input_key, at, n in zip(batch["feed"], keys, batch["at"], events, strict=True):
            last = accepted.get(feed)
            if last is not None and input_key == last[0]:
                status = "DUPLICATE_SNAPSHOT"
            elif last is not None and at - last[1] < self.spacing:
                status = "MINIMUM_SPACING"
            elif n < self.minimum:
                status = "UNIVERSE_COVERAGE_INCOMPLETE"
            else:
                status, accepted[feed] = "ACCEPTED", (input_key, at)
            statuses.append(status)
        now = [(feed, input_key, at) for feed, (input_key, at) in accepted.items()]
        self.accepted.write(pd.DataFrame(now, columns=list(self.accepted.types), dtype="object"), before)
        yield pd.DataFrame({"feed": batch["feed"].astype("int64"), "id": batch["id"].astype("int64"), "status": statuses, "events": events})


class FirstClaim(StatefulProcessor):
    """The first signal of an event claims it; every later one, in any batch, is dropped. Only events of the batch are looked up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claimed = handle.getMapState("claimed", "event string", "event_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = _batch(rows, ["ts", "event_id"]).drop_duplicates("event")
        first = first[[not self.claimed.containsKey((event,)) for event in first["event"]]]
        for event, event_id in zip(first["event"], first["event_id"], strict=True):
            self.claimed.updateValue((event,), (int(event_id),))
        yield pd.DataFrame({"event": first["event"], "event_id": first["event_id"].astype("int64"), "ts": first["ts"]})


class Settlement(StatefulProcessor):
    """Each fill is settled once, by the first result of its contract at or after it; a fill waits until it has one.

    State is two lists, each written whole once per batch: open fills, and results not older than the watermark. An older result can
    settle nothing any more: no fill before the watermark is still to come, and those that wait came after it. So results do not pile up.
    """

    TYPES = {"contract": "int64", "ts": "int64", "id": "int64"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = Held(handle, "open", "contract bigint, ts bigint, id bigint", self.TYPES)
        self.results = Held(handle, "results", "contract bigint, ts bigint, id bigint", self.TYPES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch["ts"] = _micros(batch["ts"])
        watermark = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000

        def merged(old: pd.DataFrame, flag: bool) -> pd.DataFrame:
            new = batch[batch["is_result"] == flag][list(self.TYPES)].astype("int64")
            return pd.concat([old, new], ignore_index=True).sort_values(list(self.TYPES), kind="stable", ignore_index=True)

        open_, known = self.open.read(), self.results.read()
        fills, results = merged(open_, False), merged(known, True)
        contracts, asked = results["contract"].to_numpy(), fills["contract"].to_numpy()
        names = np.unique(contracts)
        index = _first_from(np.searchsorted(names, contracts), results["ts"].to_numpy(), np.searchsorted(names, asked), fills["ts"].to_numpy())
        found = index < np.searchsorted(contracts, asked, side="right")
        self.open.write(fills[~found], open_)
        self.results.write(results[results["ts"] >= watermark], known)
        yield pd.DataFrame({
            "contract": fills["contract"][found].to_numpy(), "fill_id": fills["id"][found].to_numpy(), "result_id": results["id"].to_numpy()[index[found]],
        })


def _stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    return df.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time
    )


def gate_stream(messages: DataFrame) -> DataFrame:
    """connection, sid, seq, is_book, ts, pos in; one status per message out."""
    return _stateful(messages, ["connection"], SequenceGate(), GATE_OUTPUT)


def live_book_stream(messages: DataFrame) -> DataFrame:
    """connection, sid, seq, is_book, ts, pos, ticker, event_type, yes_bids, no_bids, price, delta, side in; level changes and gaps out.

    Two stateful operators in one query: the gate, keyed by connection, and the books behind it, keyed by connection and ticker. ``feeds.live_levels``
    reads the live books off the changes.
    """
    gated = _stateful(messages, ["connection"], LevelGate(), LIVE_OUTPUT.replace("size double", "delta double"))
    out = _stateful(gated, ["connection", "ticker"], LevelFold(), LIVE_OUTPUT)
    gap, level = F.col("status") == "GAP", F.col("status") == "LEVEL"
    return out.withColumns({**{c: F.when(~gap, F.col(c)) for c in ("ticker", "epoch")}, **{c: F.when(level, F.col(c)) for c in ("side", "price", "size")}})


def book_stream(log: DataFrame) -> DataFrame:
    """ticker, ts, seq, event_type, yes_bids, no_bids, price, delta, side in; level changes out."""
    return _stateful(log, ["ticker"], BookFold(), BOOK_OUTPUT)


def fill_stream(rows: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """contract, ts, id, is_quote, horizon, due, expires, side, yes_ask, no_ask in; one row per signal and horizon out, filled or given up.

    Rows older than the watermark are late and dropped.
    """
    return _stateful(rows.withWatermark("ts", lateness), ["contract"], DelayedFill(), FILL_OUTPUT, "EventTime")


def health_stream(statuses: DataFrame) -> DataFrame:
    """component, ts, event_id, status, reason in; transitions out."""
    return _stateful(statuses, ["component"], HealthChange(), HEALTH_OUTPUT)


def input_stream(snapshots: DataFrame, *, minimum_events: int, spacing_seconds: float = 0.0) -> DataFrame:
    """feed, id, ts, input_key, events (how many events the snapshot covers) in; a status and the count of each snapshot out."""
    rows = snapshots.select("feed", "id", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"), "input_key", "events")
    return _stateful(rows, ["feed"], InputGate(minimum_events, round(spacing_seconds * 1e6)), INPUT_OUTPUT)


def claim_stream(signals: DataFrame) -> DataFrame:
    """event, event_id, ts in; the claiming signal of each event out, once."""
    return _stateful(signals, ["event"], FirstClaim(), CLAIM_OUTPUT)


def settlement_stream(rows: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """contract, id, ts, is_result in; each fill with its result out, once, however late the result is. Rows older than the watermark are late and dropped."""
    return _stateful(rows.withWatermark("ts", lateness), ["contract"], Settlement(), SETTLED_OUTPUT, "EventTime")
