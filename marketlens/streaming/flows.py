"""Streaming flows: sources, sinks and the operators Structured Streaming has built in."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.session import scratch_path


def tail_parquet(spark: SparkSession, path: str, schema: T.StructType, *, pattern: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def append_to(df: DataFrame, path: str, checkpoint: str, *, partitions: Sequence[str] = (), fmt: str = "parquet", **options: str):
    """Start a writer that appends each batch exactly once."""
    writer = df.writeStream.format(fmt).options(**options).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.partitionBy(*partitions) if partitions else writer).trigger(availableNow=True).start()


def drain(df: DataFrame, name: str, **options) -> DataFrame:
    """Run a flow over what is there now and read its table back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    append_to(df, f"{path}/table", f"{path}/checkpoint", **options).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def replay(frame: DataFrame, time: str, run: Callable[[DataFrame], None], name: str, slices: int = 4) -> None:
    """Feed a frame to a flow as a growing folder, in slices of time; each slice is a batch of a newly started query.

    A row without a time is in the first slice. ``run`` gets the stream of the folder, with the same checkpoint each time, and returns when the flow has caught up.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = frame.agg(F.min(micros), F.max(micros)).first()
    place = F.coalesce(F.least(F.floor((micros - (low or 0)) * slices / ((high or 0) - (low or 0) + 1)), F.lit(slices - 1)), F.lit(0))
    for n in range(slices):
        frame.where(place == n).write.mode("append").parquet(path)
        run(tail_parquet(spark, path, frame.schema))


def replayed(frame: DataFrame, time: str, flow: Callable[[DataFrame], DataFrame], name: str, **options) -> DataFrame:
    """The table that an appending flow has written after ``replay``."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    schemas = []

    def run(stream: DataFrame) -> None:
        out = flow(stream)
        schemas.append(out.schema)
        append_to(out, f"{path}/table", f"{path}/checkpoint", **options).awaitTermination()

    replay(frame, time, run, f"{name}-in")
    return spark.read.schema(schemas[-1]).format(options.get("fmt", "parquet")).load(f"{path}/table")


def raw_archive(messages: DataFrame, received: str) -> DataFrame:
    """Raw messages with their receive date and hour, for a sink ahead of any validation."""
    return messages.withColumns({"date": F.to_date(received), "hour": F.hour(received)})


def fresh_rows(df: DataFrame, stamp: str, now: Column, max_age_seconds: float) -> DataFrame:
    """Rows neither in the future nor too old at ``now``; a test of each row alone, without state."""
    age = (F.unix_micros(now) - F.unix_micros(stamp)) / F.lit(1e6)
    return df.where((age >= 0) & (age <= max_age_seconds))


class KeyedTable:
    """A keyed table kept by change: a batch writes a run of its own rows, and runs merge by powers of ``fan``.

    A run is a folder named by the first and last batch in it, with a file for each key bucket, which a reader of some buckets skips by its statistics, and counts once its writer has marked it
    complete. After every ``fan`` batches their runs merge into one, after ``fan`` of those into a larger one, and so on, so a row is
    rewritten once per power of ``fan`` in the number of batches, whatever the size of the table, and a reader merges at most
    ``fan - 1`` runs of each size. A repeated batch whose rows are in a complete run has nothing to do, and what a lost driver left
    half-written is written again. Runs that a larger one holds stay until the next batch, for readers that have begun.

    The latest row of a key by ``order`` wins; without an order, that of the latest batch does. Each ``carried`` column has the last
    value that is not null, from whichever row; it is merged by its own place in the order, so late rows do no harm. Null keys are keys.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = (), *, carried: Sequence[str] = (), buckets: int = 8, fan: int = 8
    ) -> None:
        if fan < 2 or buckets < 1:
            raise ValueError("a merge takes two runs or more, and a table has a bucket")
        if carried and not order:
            raise ValueError("carried columns need an order")
        self.spark, self.path, self.keys, self.order, self.carried = spark, path, list(keys), list(order), list(carried)
        self.buckets, self.fan = buckets, fan

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self) -> list[tuple[int, int]]:
        """Complete runs, the widest first."""
        root, fs = self._files()
        if not fs.exists(root):
            return []
        marks = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(root, "run=*/_SUCCESS"))
        found = [tuple(int(n) for n in m.getPath().getParent().getName()[4:].split("-")) for m in marks]
        return sorted(found, key=lambda r: (r[0] - r[1], r))

    def runs(self, before: int | None = None) -> list[tuple[int, int]]:
        """The complete runs that make up the table, or the table before a batch; none lies in another."""
        out: list[tuple[int, int]] = []
        for low, high in self._complete():
            if (before is None or high < before) and not any(a <= low and high <= z for a, z in out):
                out.append((low, high))
        return sorted(out)

    def _stored(self, run: tuple[int, int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/run={run[0]}-{run[1]}").withColumn("_batch", F.lit(run[1]))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key, carried columns with their places; combines before the shuffle."""
        plain = [c for c in rows.columns if c not in (*self.keys, *self.carried, *self._places(), "_batch", "_bucket")]
        newest = F.max_by(F.struct(*plain, F.lit(0).alias("_none")), F.struct(*(self.order or ["_batch"])))
        kept = [F.max_by(c, p).alias(c) for c, p in zip(self.carried, self._places(), strict=True)] + [F.max(p).alias(p) for p in self._places()]
        return rows.groupBy(*self.keys).agg(newest.alias("_row"), *kept).select(*self.keys, *[F.col(f"_row.{c}") for c in plain], *self.carried, *self._places())

    def _places(self) -> list[str]:
        return [f"_at_{c}" for c in self.carried]

    def _union(self, runs: Sequence[tuple[int, int]], where: Column | None = None) -> DataFrame:
        parts = [self._stored(r) for r in runs]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows if where is None else rows.where(where)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, *, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or what it was before a batch; only some key buckets, if they are named. None where there is none."""
        runs = self.runs(before)
        if not runs:
            return None
        return self._merged(self._union(runs, None if buckets is None else F.col("_bucket").isin(*buckets))).drop(*self._places())

    def bucket_of(self, *values) -> int:
        """The bucket of a key, for ``read``."""
        schema = self._stored(self.runs()[0]).select(*self.keys).schema
        return self.spark.createDataFrame([values], schema).select(self._bucket()).first()[0]

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        placed = self._merged(rows).withColumn("_bucket", self._bucket()).repartitionById(self.buckets, F.col("_bucket"))
        placed.write.mode("overwrite").parquet(f"{self.path}/run={run[0]}-{run[1]}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch, then merge what is due."""
        complete = self._complete()
        stale = [r for r in complete if any(o != r and o[0] <= r[0] and r[1] <= o[1] and o[1] < batch_id for o in complete)]
        _, fs = self._files()
        for low, high in stale:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={low}-{high}"), True)
        if not any(low <= batch_id <= high for low, high in complete):
            place = F.struct(*self.order) if self.order else F.lit(None)
            at = {p: F.when(F.col(c).isNotNull(), place) for c, p in zip(self.carried, self._places(), strict=True)}
            self._write(df.withColumns({**at, "_batch": F.lit(batch_id)}), (batch_id, batch_id))
        width = self.fan
        while (batch_id + 1) % width == 0:
            wide = (batch_id + 1 - width, batch_id)
            inside = [r for r in self.runs() if wide[0] <= r[0] and r[1] <= wide[1]]
            if wide not in inside:
                self._write(self._union(inside), wide)
            width *= self.fan


def keep_latest(df: DataFrame, table: KeyedTable, checkpoint: str):
    """Upsert each batch into a keyed table: the latest row per key wins."""
    return df.writeStream.foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_updates(df: DataFrame, table: KeyedTable, checkpoint: str):
    """Keep the result of an aggregate in a table without an order: each batch brings the groups that changed, which replace their former rows.

    With a watermark on the aggregate its state is evicted; the table keeps the closed groups.
    """
    return df.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(
    df: DataFrame, strategies: Mapping[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str
):
    """Run every strategy on each batch; one that fails leaves an error row and stops no other.

    A strategy writes below ``strategy=<name>/batch=<id>``, so a repeated batch replaces itself.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, strategy in strategies.items():
                try:
                    strategy(batch).write.mode("overwrite").parquet(f"{path}/signals/strategy={name}/batch={batch_id}")
                except Exception as exc:  # isolate strategies: record and go on
                    row = [(name, batch_id, f"{type(exc).__name__}: {exc}")]
                    batch.sparkSession.createDataFrame(row, "strategy string, batch bigint, error string").write.mode(
                        "overwrite"
                    ).parquet(f"{path}/errors/strategy_name={name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
