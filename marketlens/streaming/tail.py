"""Tail of growing line files: what was appended since the last batch, by an offset per file.

Spark's file source reads a file once. This source keeps, per file, the end of the last complete line it has read, in the
query's checkpoint; a file that has shrunk since is read from its start. Files are reached through Arrow's file systems,
so a folder may lie in any store they know; each new range of a file is one task.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

register_pickle_by_value(sys.modules[__name__])

STEP = 1 << 16


@dataclass
class LineRange(InputPartition):
    path: str
    start: int
    stop: int


class TailReader(DataSourceStreamReader):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        ends = {f.path: self._last_line_end(store, f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_"))}
        return {"files": json.dumps(ends, sort_keys=True)}

    @staticmethod
    def _last_line_end(store, path: str, size: int) -> int:
        with store.open_input_file(path) as file:
            stop = size
            while stop > 0:
                start = max(0, stop - STEP)
                at = file.read_at(stop - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                stop = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        begins = {p: before.get(p, 0) if before.get(p, 0) <= stop else 0 for p, stop in now.items()}
        return [LineRange(p, begins[p], stop) for p, stop in sorted(now.items()) if stop > begins[p]]

    def read(self, partition: LineRange) -> Iterator[tuple[str, int, str]]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as file:
            at, rest = partition.start, b""
            while at < partition.stop:
                data = file.read_at(min(STEP, partition.stop - at), at)
                place, at = at - len(rest), at + len(data)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    yield partition.path, place, line.decode("utf-8", "replace")
                    place += len(line) + 1


class TailLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "file string, offset bigint, value string"

    def streamReader(self, schema: T.StructType) -> TailReader:
        return TailReader(self.options["path"])


def tail_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, value of each complete line below ``path``, also of lines appended to files seen before."""
    spark.dataSource.register(TailLines)
    return spark.readStream.format("tail_lines").load(path if "://" in path else f"file://{path}")


def tail_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of the new lines; lines that hold none are skipped."""
    parsed = tail_lines(spark, path).select(F.from_json("value", schema).alias("_r"), F.try_parse_json("value").alias("_v"))
    return parsed.where(F.col("_v").isNotNull() & F.col("_r").isNotNull()).select("_r.*")
