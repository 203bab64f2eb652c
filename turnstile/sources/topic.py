"""A7 without a broker: a topic as files, replayed by offsets.

``write_topic`` appends records to a topic folder: segments (Parquet) under
``partition=P`` and, last, an index that gives every segment its place in its
partition's offsets; a segment without an index line does not exist for
readers.  ``topic_source`` reads it as a stream of the records that
``kafka_source`` gives.  Offsets are kept by each consumer's own checkpoint, so
consumers are independent, can be restarted, and can start at either end.
"""

from __future__ import annotations

import json

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from turnstile.session import committed_folders

PARTITIONS = 6
RECORD = "key string, value string, partition int, offset long"
_INDEX = "partition int, segment string, first long, rows long"


def write_topic(records: DataFrame, path: str, partitions: int = PARTITIONS) -> None:
    """Append (key, value) records; a key always goes to the same partition.

    Segments are written by as many tasks as there are; only their row
    counts are put in order, so a busy partition is no single task.  One writer
    at a time; what a writer that stopped midway left is never seen."""
    spark = records.sparkSession
    done = committed_folders(spark, f"{path}/index/append=*")
    number = int(done[-1].rsplit("=", 1)[1]) + 1 if done else 0
    folder = f"{path}/segments/append={number:010d}"
    records.select(F.col("key").cast("string"), F.col("value").cast("string"),
                   F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(partitions)).cast("int").alias("partition")) \
           .write.mode("overwrite").partitionBy("partition").parquet(folder)
    sizes = spark.read.schema("key string, partition int").parquet(folder) \
        .groupBy("partition", F.col("_metadata.file_path").alias("segment")).agg(F.count(F.lit(1)).alias("rows"))
    if done:
        ends = spark.read.schema(_INDEX).json(done).groupBy("partition").agg(F.max(F.col("first") + F.col("rows")).alias("end"))
    else:
        ends = spark.createDataFrame([], "partition int, end long")
    before = Window.partitionBy("partition").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(ends, "partition", "left") \
        .select("partition", "segment", (F.coalesce("end", F.lit(0)) + F.col("before")).alias("first"), "rows")
    index.coalesce(1).write.mode("overwrite").json(f"{path}/index/append={number:010d}")


def _open(uri: str):
    """(file system, path) of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _index(path: str) -> list[tuple[int, str, int, int]]:
    """(partition, segment, first offset, rows) of all finished appends."""
    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/index", recursive=True, allow_not_found=True))
    done = {f.path.rsplit("/", 1)[0] for f in found if f.base_name == "_SUCCESS"}
    out = []
    for f in found:
        if f.path.rsplit("/", 1)[0] in done and f.base_name.endswith(".json"):
            with files.open_input_stream(f.path) as stream:
                lines = stream.read().decode().splitlines()
            out += [(r["partition"], r["segment"], r["first"], r["rows"]) for r in map(json.loads, lines)]
    return sorted(out)


class Span(InputPartition):
    """Rows lo..hi of one segment, whose first row has offset ``first``."""

    def __init__(self, partition: int, segment: str, first: int, lo: int, hi: int):
        super().__init__(segment)
        self.partition, self.segment, self.first, self.lo, self.hi = partition, segment, first, lo, hi


class TopicReader(DataSourceStreamReader):
    """Offsets are ``{partition: next offset}``; a task reads one span."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.latest = options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "latest"

    def _ends(self) -> dict:
        ends: dict[str, int] = {}
        for partition, _, first, rows in _index(self.path):
            ends[str(partition)] = max(ends.get(str(partition), 0), first + rows)
        return ends

    def initialOffset(self) -> dict:
        return self._ends() if self.latest else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = []
        for partition, segment, first, rows in _index(self.path):
            lo = max(start.get(str(partition), 0) - first, 0)
            hi = min(end.get(str(partition), 0) - first, rows)
            if lo < hi:
                spans.append(Span(partition, segment, first, lo, hi))
        return spans

    def read(self, span: Span):
        files, path = _open(span.segment)
        at = 0
        with files.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["key", "value"]):  # a row group at a time
                lo, hi = max(span.lo - at, 0), min(span.hi - at, batch.num_rows)
                for k, (key, value) in enumerate(zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns))
                                                 if lo < hi else (), at + lo):
                    yield key, value, span.partition, span.first + k
                at += batch.num_rows
                if at >= span.hi:
                    return

    def commit(self, end: dict) -> None:
        pass


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_files"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> TopicReader:
        return TopicReader(dict(self.options))


def topic_source(spark: SparkSession, path: str, starting: str = "earliest", with_offsets: bool = False) -> DataFrame:
    """The topic as a stream of (key, value) strings, like ``kafka_source``;
    ``with_offsets`` adds ``partition`` and ``offset``."""
    spark.dataSource.register(TopicSource)
    s = spark.readStream.format("topic_files").option("path", path).option("startingOffsets", starting).load()
    return s if with_offsets else s.select("key", "value")
