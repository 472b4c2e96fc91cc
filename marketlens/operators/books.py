"""Order books rebuilt from snapshot and delta logs, and the price of walking through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.ordered import BLOCK_SECONDS, clamped_running_sum, running, time_block
from marketlens.session import cut_lineage

SIDES = ("yes", "no")


def with_epoch(
    log: DataFrame, is_snapshot: Column, *, keys: Sequence[str] = ("ticker",), block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """Number of snapshots so far; rows before the first one (epoch 0) belong to no book."""
    marked = log.withColumn("_snap", is_snapshot.cast("bigint"))
    out = running(
        marked, keys, ["ts", "received", "seq"], {"epoch": ("sum", F.col("_snap"))}, time_block("ts", block_seconds)
    )
    return out.where(F.col("epoch") > 0)


def _level_rows(row: DataFrame, keys: Sequence[str], is_reset: Column, single: Column, amount: str, name: str) -> DataFrame:
    """One row per level touched: every level of a reset, the one level of a change; one pass over the log."""

    def levels(side: str) -> Column:
        held = F.coalesce(F.col(f"{side}_bids"), F.array())
        kept = F.filter(held, lambda x: x["size"] > 0)
        return F.transform(kept, lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["size"].alias(name)))

    one = F.array(F.struct(F.col("side").alias("side"), F.col("price").alias("price"), F.col(amount).alias(name)))
    touched = F.when(is_reset, F.concat(*[levels(s) for s in SIDES])).when(single, one)
    return row.select(*keys, "ts", "received", "seq", "epoch", F.explode(touched).alias("_l")).select(
        *keys, "ts", "received", "seq", "epoch", "_l.*"
    )


def level_changes(
    log: DataFrame, *, keys: Sequence[str] = ("ticker",), block_seconds: int = BLOCK_SECONDS, epochs: DataFrame | None = None
) -> DataFrame:
    """Fold a snapshot/delta log into ``(ticker, epoch, side, price, ts, received, seq, size)``.

    Books carry across files; ``keys=("ticker", "source_file")`` makes every file start afresh.
    A snapshot starts a new epoch with both sides; a delta adds to one level and a level at or
    below zero is gone and restarts from zero. Deltas before any snapshot and rows of unknown kind
    are ignored. The key of the fold holds epoch and price, so a hot ticker is spread already, and
    time blocks split what remains. ``epochs`` is the log with its epochs, if it is stored already.
    """
    is_snapshot = F.lower("event_type").contains("snapshot")
    epochs = with_epoch(log, is_snapshot, keys=keys, block_seconds=block_seconds) if epochs is None else epochs
    single = F.col("price").isNotNull() & F.col("delta").isNotNull() & F.col("side").isin(*SIDES)
    touched = _level_rows(epochs, keys, is_snapshot, single, "delta", "change")
    return clamped_running_sum(
        touched, [*keys, "epoch", "side", "price"], ["ts", "received", "seq"], "change", "size", time_block("ts", block_seconds)
    )


def absolute_level_changes(log: DataFrame, *, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """The second archive's form: ``book`` replaces depth, ``price_change`` sets one level's size."""
    is_book = F.col("event_type") == "book"
    epochs = with_epoch(log, is_book, block_seconds=block_seconds)
    single = (F.col("event_type") == "price_change") & F.col("price").isNotNull() & F.col("size").isNotNull()
    rows = _level_rows(epochs, ["ticker"], is_book, single, "size", "size")
    return rows.withColumn("size", F.greatest(F.lit(0.0), "size"))


def numbered_log(
    changes: DataFrame, epochs: DataFrame, targets: DataFrame, at: str, *, block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """Changes and targets on one axis: ``_n`` is the number of changes of the ticker so far, ``_now`` its newest epoch.

    A target comes after everything of its own time.
    """
    entry = F.struct("epoch", "side", "price", "size").alias("_change")
    moved = changes.select("ticker", F.col("ts").alias("_t"), F.lit(0).alias("_rank"), F.col("received").alias("_r"), F.col("seq").alias("_s"),
                           F.struct("side", "price").alias("_l"), entry)
    marked = epochs.select("ticker", F.col("ts").alias("_t"), F.lit(0).alias("_rank"), F.col("epoch").alias("_mark"))
    asked = targets.select("ticker", F.col(at).alias("_t"), F.lit(1).alias("_rank"), F.struct(*targets.columns).alias("_target"))
    axis = moved.unionByName(marked, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    return running(
        axis, ["ticker"], ["_t", "_rank", "_r", "_s", "_l"],
        {"_n": ("sum", F.col("_change").isNotNull().cast("bigint")), "_now": ("max", F.col("_mark"))}, time_block("_t", block_seconds),
    ).select("ticker", "_n", "_now", "_change", "_target")


def opening_books(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """One row ``(ticker, epoch, _block, opening)`` per asked block: the live levels at the end of the blocks before it.

    A level lives from the block of its last change to the block of its next one. Asked blocks are numbered within their epoch, so a level
    is laid out over the asked blocks of its life and over no others.
    """
    key = ["ticker", "epoch"]
    ends = changes.groupBy(*key, "side", "price", "_block").agg(F.max_by("size", "_n").alias("size"))
    blocks = ends.select(*key, "_block", F.lit(0).alias("_a")).unionByName(asked.select(*key, "_block", F.lit(1).alias("_a")))
    in_order = Window.partitionBy(*key).orderBy("_block")
    numbers = blocks.groupBy(*key, "_block").agg(F.max("_a").alias("_a")).select(
        *key, "_block", "_a", F.sum("_a").over(in_order).alias("_i"), F.sum("_a").over(Window.partitionBy(*key)).alias("_all")
    )
    level = Window.partitionBy(*key, "side", "price").orderBy("_block")
    lives = ends.join(numbers.drop("_a"), [*key, "_block"]).select(
        *key, "side", "price", "size", "_i", F.coalesce(F.lead("_i").over(level), "_all").alias("_until")
    ).where((F.col("size") > 0) & (F.col("_until") > F.col("_i")))
    laid = lives.select(*key, F.explode(F.sequence(F.col("_i") + 1, F.col("_until"))).alias("_i"), F.struct("side", "price", F.lit(0).cast("bigint").alias("n"), "size").alias("_l"))
    books = laid.groupBy(*key, "_i").agg(F.collect_list("_l").alias("opening"))
    return numbers.where("_a = 1").select(*key, "_block", "_i").join(books, [*key, "_i"]).drop("_i")


def book_at(
    changes: DataFrame, epochs: DataFrame, targets: DataFrame, target_id: Sequence[str], at: str,
    *, block_seconds: int = BLOCK_SECONDS, block_changes: int = 256,
) -> DataFrame:
    """Live levels ``(target id, side, price, size)`` of the last book at or before each target time.

    ``epochs`` holds ``(ticker, ts, seq, epoch)`` of the snapshots; a level of an older epoch is void. ``changes`` is read twice: pass a stored table. The changes of a ticker are cut into blocks of
    ``block_changes``. A target meets two stored rows, the book its block opened with and the changes of its block, however hot its ticker is,
    and folds them in place.
    """
    placed = cut_lineage(numbered_log(changes, epochs, targets, at, block_seconds=block_seconds))
    block = F.floor(F.col("_n") / block_changes).alias("_block")
    moved = placed.where(F.col("_change").isNotNull()).select("ticker", "_change.*", "_n", block)
    asks = placed.where(F.col("_target").isNotNull() & F.col("_now").isNotNull()).select("ticker", F.col("_now").alias("epoch"), "_n", block, "_target")
    key = ["ticker", "epoch", "_block"]
    asked = asks.select(*key).distinct()
    own = moved.join(asked, key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct("side", "price", F.col("_n").alias("n"), "size")).alias("own"))
    stored = asked.join(opening_books(moved, asked), key, "left").join(own, key, "left")
    none = F.array().cast(own.schema["own"].dataType)
    until = F.col("_n")
    known = F.concat(F.coalesce("opening", none), F.filter(F.coalesce("own", none), lambda c: c["n"] <= until))
    # per level the newest entry first
    sorted_ = F.array_sort(F.transform(known, lambda c: F.struct(c["side"].alias("side"), c["price"].alias("price"), (-c["n"]).alias("n"), c["size"].alias("size"))))
    folded = asks.join(stored, key).select("_target", sorted_.alias("_levels"))

    def live(c: Column, i: Column) -> Column:
        before = F.get("_levels", i - 1)
        newest = (i == 0) | (before["side"] != c["side"]) | (before["price"] != c["price"])
        return newest & (c["size"] > 0)

    levels = folded.select(*[F.col(f"_target.{c}").alias(c) for c in targets.columns], F.explode(F.filter("_levels", live)).alias("_l"))
    return levels.select(*targets.columns, "_l.side", "_l.price", "_l.size")


def top_of_book(levels: DataFrame, target_id: Sequence[str]) -> DataFrame:
    """Best bids, their sizes, complement asks and spreads of each rebuilt book."""

    def side(name: str) -> Column:
        return F.col("side") == name

    out = levels.groupBy(*target_id).agg(
        F.max(F.when(side("yes"), F.col("price"))).alias("yes_bid"),
        F.max(F.when(side("no"), F.col("price"))).alias("no_bid"),
        F.max_by("size", F.when(side("yes"), F.col("price"))).alias("yes_bid_size"),
        F.max_by("size", F.when(side("no"), F.col("price"))).alias("no_bid_size"),
    )
    return out.select(
        "*", (1 - F.col("no_bid")).alias("yes_ask"), (1 - F.col("yes_bid")).alias("no_ask"),
        (1 - F.col("no_bid") - F.col("yes_bid")).alias("spread"),
    )


def top_levels(levels: DataFrame, keys: Sequence[str], price: str, size: str, depth: int = 5) -> DataFrame:
    """The best ``depth`` bid levels per key; a rank limit prunes before the shuffle."""
    ranked = levels.withColumn(
        "level", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(price), F.desc(size)))
    )
    return ranked.where(F.col("level") <= depth)


def merge_levels(levels: DataFrame, keys: Sequence[str], price: str, size: str) -> DataFrame:
    """One row per price: combines map-side and bounds a book by its tick grid."""
    return levels.where(F.col(size) > 0).groupBy(*keys, price).agg(F.sum(size).alias(size))


def depth_vwap(
    levels: DataFrame, keys: Sequence[str], price: str, size: str, depths: Column
) -> DataFrame:
    """Walk asks upward for each wanted depth: ``depth, filled, cost, vwap, complete`` per key.

    ``depths`` is an array of quantities. Levels are merged by price first, so the ordered walk sees
    at most one row per tick.
    """
    return walk_levels(merge_levels(levels, keys, price, size), keys, keys, price, size, depths)


def walk_levels(
    merged: DataFrame, keep: Sequence[str], book: Sequence[str], price: str, size: str, depths: Column
) -> DataFrame:
    """The walk over levels already merged by price; ``keep`` columns depend on ``book`` and ride along.

    A book without levels (null price and size) comes out unfilled.
    """
    ahead = Window.partitionBy(*book).orderBy(price).rowsBetween(Window.unboundedPreceding, -1)
    queued = merged.withColumn("_ahead", F.coalesce(F.sum(size).over(ahead), F.lit(0)))
    wanted = queued.withColumn("depth", F.explode(depths))
    take = F.greatest(F.lit(0), F.least(F.coalesce(size, F.lit(0)), F.col("depth") - F.col("_ahead")))
    walked = wanted.withColumn("_take", take).groupBy(*keep, "depth").agg(
        F.sum("_take").alias("filled"), F.coalesce(F.sum(F.col("_take") * F.col(price)), F.lit(0.0)).alias("cost")
    )
    return walked.select(
        *keep, "depth", "filled", "cost", F.when(F.col("filled") > 0, F.col("cost") / F.col("filled")).alias("vwap"),
        (F.col("filled") >= F.col("depth")).alias("complete"),
    )


def executable_buy(levels: Column, quantity: Column) -> Column:
    """The same walk for an array of (price, size) held in one row: struct (filled, cost, vwap, complete)."""
    usable = F.array_sort(F.filter(levels, lambda x: x["size"] > 0))
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def step(acc: Column, level: Column) -> Column:
        take = F.greatest(F.lit(0.0), F.least(level["size"].cast("double"), quantity - acc["filled"]))
        return F.struct(
            (acc["filled"] + take).alias("filled"), (acc["cost"] + take * level["price"].cast("double")).alias("cost")
        )

    walked = F.aggregate(usable, start, step)
    return F.struct(
        walked["filled"].alias("filled"), walked["cost"].alias("cost"),
        F.when(walked["filled"] > 0, walked["cost"] / walked["filled"]).alias("vwap"),
        (walked["filled"] >= quantity).alias("complete"),
    )
