"""A log of frames as files, laid out by partition and segment, and a stream source over it with an offset a partition.

A segment holds the frames of SEGMENT offsets of one partition, so where reading starts decides which folders are opened: a
restart from snapshots begins past the offsets that these name, and what lies below is neither listed nor read. Each
micro-batch takes the next offsets of every partition, ``rows`` in all; offsets of a partition are distinct, so no batch
has more rows than that. Which offsets a batch ends at is written to the ``plan`` folder first, and marked when the batch begins,
as a reader that starts anew is not told where its query stands.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Offsets that a segment of a partition spans, and that a micro-batch takes of all partitions.
SEGMENT = 1 << 16
ROWS = 4096

SCHEMA = "partition int, offset bigint, value binary"


def files_of(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (a path, or a URI such as file:, hdfs: or s3:) and the path in it."""
    if (local := re.fullmatch(r"(?:file:(?://)?)?(/.*)", address)) is not None:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(address)


def write_log(frames: DataFrame, path: str, partitions: int, segment: int = SEGMENT) -> None:
    """Appends frames (partition, offset, value): each partition's are written by one task, in the order of their offsets."""
    routed = frames.select("partition", "offset", "value", F.floor(F.col("offset") / segment).alias("segment"))
    placed = routed.withColumn("p", F.col("partition")).repartitionById(partitions, F.pmod("p", F.lit(partitions)).cast("int")).drop("p")
    placed.sortWithinPartitions("partition", "segment", "offset").write.mode("append").partitionBy("partition", "segment").parquet(path)


def read_log(spark: SparkSession, path: str, starts: dict[int, int] | None = None, segment: int = SEGMENT) -> DataFrame:
    """The log as a batch, from an offset in each partition on (all of a partition that is not named): older segments are pruned."""
    log = spark.read.schema("offset bigint, value binary, partition int, segment bigint").parquet(path)
    for p, start in (starts or {}).items():
        log = log.where((F.col("partition") != p) | ((F.col("segment") >= start // segment) & (F.col("offset") >= start)))
    return log.select("partition", "offset", "value")


class _Slice(InputPartition):
    def __init__(self, partition: int, start: int, stop: int, paths: list[str]):
        super().__init__((partition, start, stop))
        self.partition, self.start, self.stop, self.paths = partition, start, stop, paths


class TickLogReader(DataSourceStreamReader):
    """Offsets are {partition: next offset}."""

    def __init__(self, options: dict[str, str]):
        self.path, self.plan = options["path"], options["plan"]
        self.partitions_n, self.rows, self.segment = int(options["partitions"]), int(options.get("rows", ROWS)), int(options.get("segment", SEGMENT))
        self.starts = {p: int(s) for p, s in json.loads(options.get("starts", "{}")).items()}
        self.planned, self.taken = self._last_plan()

    def _last_plan(self) -> tuple[dict[str, int] | None, bool]:
        """The last planned offsets, and whether a batch up to them was begun: then the query's own log has them."""
        where, path = files_of(self.plan)
        names = {f.base_name for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True))}
        plans = sorted(n for n in names if n.endswith(".json"))
        if not plans:
            return None, True
        with where.open_input_stream(f"{path}/{plans[-1]}") as f:
            return json.loads(f.read()), plans[-1].replace(".json", ".taken") in names

    def _write(self, name: str, content: dict[str, int]) -> None:
        where, path = files_of(self.plan)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/.writing") as f:
            f.write(json.dumps(content).encode())
        where.move(f"{path}/.writing", f"{path}/{sum(content.values()):020d}.{name}")

    def _segments(self, partition: int) -> dict[int, str]:
        where, path = files_of(self.path)
        found = where.get_file_info(fs.FileSelector(f"{path}/partition={partition}", allow_not_found=True))
        return {int(f.base_name.removeprefix("segment=")): f.path for f in found if f.base_name.startswith("segment=")}

    def _paths(self, folder: str) -> list[str]:
        where, _ = files_of(self.path)
        return [f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_"))]

    def _end(self, segments: dict[int, str]) -> int:
        """Past the last offset of a partition, by the statistics of its last segment's files."""
        where, _ = files_of(self.path)
        last = -1
        for file in self._paths(segments[max(segments)]):
            with where.open_input_file(file) as f:
                footer = pq.read_metadata(f)
            column = footer.schema.names.index("offset")
            last = max([last, *(footer.row_group(i).column(column).statistics.max for i in range(footer.num_row_groups))])
        return last + 1

    def end_of(self, partition: int) -> int:
        segments = self._segments(partition)
        return self._end(segments) if segments else 0

    def initialOffset(self) -> dict:
        return {str(p): self.starts.get(str(p), 0) for p in range(self.partitions_n)}

    def latestOffset(self) -> dict:
        if not self.taken:  # planned, but not begun: given again
            return dict(self.planned)
        at, each = self.planned or self.initialOffset(), max(self.rows // self.partitions_n, 1)
        out = {}
        for p, start in at.items():
            segments = self._segments(int(p))
            ahead = [s for s in segments if (s + 1) * self.segment > start]
            if not ahead:
                out[p] = start
                continue
            begin = max(start, min(ahead) * self.segment)  # offsets of segments that are not there have no rows
            out[p] = max(start, min(begin + each, self._end(segments)))
        if out != at:
            self._write("json", out)
            self.planned, self.taken = out, False
        return dict(out)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Called once a query has logged ``end`` and begins the batch."""
        if end == self.planned and not self.taken:
            self._write("taken", end)
            self.taken = True
        out = []
        for p in end:
            a, z = start.get(p, 0), end[p]
            if a < z:
                segments = self._segments(int(p))
                folders = [segments[s] for s in sorted(segments) if (s + 1) * self.segment > a and s * self.segment < z]
                out.append(_Slice(int(p), a, z, [f for folder in folders for f in self._paths(folder)]))
        return out or [_Slice(0, 0, 0, [])]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        where, _ = files_of(self.path)
        names = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("value", pa.binary())])
        for path in partition.paths:
            rows = pq.read_table(path, columns=["offset", "value"], filesystem=where, partitioning=None, filters=[("offset", ">=", partition.start), ("offset", "<", partition.stop)])
            for batch in rows.to_batches(max_chunksize=10_000):
                yield pa.RecordBatch.from_arrays([pa.array([partition.partition] * batch.num_rows, pa.int32()), batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.binary())], schema=names)

    def commit(self, end: dict) -> None:
        pass


class TickLog(DataSource):
    """``spark.readStream.format("tick_log")`` with path, plan, partitions and, if wanted, rows, segment and starts (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "tick_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> TickLogReader:
        return TickLogReader(self.options)


def stream_log(spark: SparkSession, path: str, plan: str, partitions: int, rows: int = ROWS, starts: dict[int, int] | None = None, segment: int = SEGMENT) -> DataFrame:
    """The log as a stream, from an offset in each partition on."""
    spark.dataSource.register(TickLog)
    reader = spark.readStream.format("tick_log").options(path=path, plan=plan, partitions=partitions, rows=rows, segment=segment)
    return reader.option("starts", json.dumps({str(p): s for p, s in (starts or {}).items()})).load()
