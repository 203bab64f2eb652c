"""A6 with bounded files, and A5 with malformed messages on record.

``land_batches`` writes every micro-batch of a stream into a folder of its own,
clustered by date; ``compact_landed`` folds finished folders into larger parts
per date beside the running sink.  A manifest names the parts that hold each date and the
folders that are folded in, and is written last: readers take the newest manifest
and the folders that it has not folded, so no row is lost or doubled whatever
runs or fails meanwhile.

``land_transactions`` decodes messages once and keeps both sides: good rows,
and the text of malformed ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstile.functions.scalars import parse_utc
from turnstile.session import committed_folders, delete_path, folder_bytes, folders
from turnstile.streaming.jobs import PUSH_INTERVAL, decode_transactions, defaulted_fields
from turnstile.streaming.online import _run_id

TARGET_BYTES = 256 << 20  # of a part's files; a date's parts of that size or more are not rewritten
_MANIFEST = "kind string, name string, version long, bytes long"


# ---------------------------------------------------------------- A6
@dataclass
class Landed:
    """A version: the parts (date, version that wrote it) with their bytes, and
    the micro-batches folded in."""
    version: int = -1
    parts: dict[tuple[str, int], int] = field(default_factory=dict)
    folded: set[str] = field(default_factory=set)


def land_batches(df: DataFrame, root: str, checkpoint: str, ts_col: str = "timestamp",
                 trigger: dict | None = None) -> StreamingQuery:
    """Append a stream, a folder per micro-batch, clustered by the rows' own
    date (``dt``), so a batch writes a date in as few files as its size asks
    for.  A replayed batch overwrites its folder."""
    ts = F.col(ts_col)
    if dict(df.dtypes)[ts_col] == "string":
        ts = parse_utc(ts)
    dated = df.withColumn("dt", F.coalesce(F.to_date(ts), F.current_date()).cast("string"))

    def sink(batch: DataFrame, batch_id: int):
        batch.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt") \
             .parquet(f"{root}/batches/run_id={_run_id(batch)}/batch_id={batch_id}")
    w = dated.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"processingTime": PUSH_INTERVAL})).start()


def manifests(spark: SparkSession, root: str) -> list[str]:
    return committed_folders(spark, f"{root}/manifest/version=*")


def _load(spark: SparkSession, path: str | None) -> Landed:
    if path is None:
        return Landed()
    out = Landed(int(path.rsplit("=", 1)[1]))
    for kind, name, version, size in spark.read.schema(_MANIFEST).json(path).collect():  # a line a part or batch
        if kind == "part":
            out.parts[name, version] = size
        else:
            out.folded.add(name)
    return out


def current(spark: SparkSession, root: str) -> Landed:
    found = manifests(spark, root)
    return _load(spark, found[-1] if found else None)


def _name(folder: str) -> str:
    return "/".join(folder.rstrip("/").split("/")[-2:])


def _batches(spark: SparkSession, root: str, folded: set[str]) -> list[str]:
    return [f for f in committed_folders(spark, f"{root}/batches/run_id=*/batch_id=*") if _name(f) not in folded]


def _part(root: str, date: str, version: int) -> str:
    return f"{root}/parts/version={version:010d}/dt={date}"


def _read(spark: SparkSession, root: str, parts: list[tuple[str, int]], batches: list[str]) -> DataFrame | None:
    frames = []
    if parts:
        frames.append(spark.read.option("basePath", f"{root}/parts").parquet(*[_part(root, *p) for p in sorted(parts)])
                      .drop("version"))
    # A batch without rows has no date folder and no columns to read.
    full = [b for b in batches if folders(spark, f"{b}/dt=*")]
    if full:
        frames.append(spark.read.option("basePath", f"{root}/batches").parquet(*full).drop("run_id", "batch_id"))
    frames = [f.withColumn("dt", F.col("dt").cast("date")) for f in frames]
    return reduce(DataFrame.unionByName, frames) if frames else None


def read_landed(spark: SparkSession, root: str) -> DataFrame:
    """All landed rows, each once, with their date ``dt``."""
    now = current(spark, root)
    rows = _read(spark, root, list(now.parts), _batches(spark, root, now.folded))
    if rows is None:
        raise FileNotFoundError(f"nothing landed under {root}")
    return rows


def write_parts(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> Landed | None:
    """First step of a compaction: new parts for the dates that unfolded batches
    touch, together with those dates' parts below ``target_bytes``.  Returns
    the next version's manifest, not yet committed; none without new batches."""
    now = current(spark, root)
    batches = _batches(spark, root, now.folded)
    if not batches:
        return None
    sizes: dict[str, int] = {}  # bytes by date: a line for each date that the new batches touch
    for b in batches:
        for f in folders(spark, f"{b}/dt=*"):
            date = f.rsplit("=", 1)[1]
            sizes[date] = sizes.get(date, 0) + folder_bytes(spark, f)
    open_parts = [p for p, size in now.parts.items() if p[0] in sizes and size < target_bytes]
    for p in open_parts:
        sizes[p[0]] += now.parts[p]
    version = now.version + 1
    parts = {p: size for p, size in now.parts.items() if p not in open_parts}
    rows = _read(spark, root, open_parts, batches)
    if rows is not None:
        # As many files a date as its bytes ask for, each by one task.
        files = {d: -(-size // target_bytes) for d, size in sizes.items()}
        many = F.create_map(*[F.lit(x) for pair in files.items() for x in pair])
        date = F.col("dt").cast("string")
        piece = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "dt"], F.monotonically_increasing_id()), many[date])
        rows.withColumn("dt", date).withColumn("_piece", piece).repartition(max(1, sum(files.values())), "dt", "_piece") \
            .drop("_piece").write.mode("overwrite").partitionBy("dt").parquet(f"{root}/parts/version={version:010d}")
        parts |= {(d, version): folder_bytes(spark, _part(root, d, version)) for d in sizes}
    still = {_name(f) for f in folders(spark, f"{root}/batches/run_id=*/batch_id=*")}
    return Landed(version, parts, {n for n in now.folded if n in still} | {_name(b) for b in batches})


def commit(spark: SparkSession, root: str, landed: Landed) -> str:
    """Second step: the manifest, whose ``_SUCCESS`` makes the version count."""
    lines = [("part", d, v, size) for (d, v), size in sorted(landed.parts.items())] \
        + [("folded", n, landed.version, 0) for n in sorted(landed.folded)]
    target = f"{root}/manifest/version={landed.version:010d}"
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").json(target)
    return target


def compact_landed(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> str | None:
    """Fold finished micro-batches into parts (one compaction at a time, beside
    a running sink).  Returns the manifest, none if there was nothing to fold."""
    landed = write_parts(spark, root, target_bytes)
    return None if landed is None else commit(spark, root, landed)


def vacuum_landed(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what none of the ``keep`` newest versions needs; manifests last."""
    found = manifests(spark, root)
    kept = [_load(spark, p) for p in found[-keep:]]
    if not kept:
        return []
    named = {p for m in kept for p in m.parts}
    gone = [f for f in folders(spark, f"{root}/batches/run_id=*/batch_id=*") if _name(f) in kept[0].folded]
    for f in folders(spark, f"{root}/parts/version=*/dt=*"):
        version, date = (x.split("=", 1)[1] for x in f.rstrip("/").split("/")[-2:])
        if int(version) <= kept[-1].version and (date, int(version)) not in named:
            gone.append(f)
    gone += found[:-keep]
    for f in gone:
        delete_path(spark, f)
    return gone


# ---------------------------------------------------------------- A5
def land_transactions(messages: DataFrame, root: str, checkpoint: str, value_col: str = "value",
                      trigger: dict | None = None) -> StreamingQuery:
    """Decode messages and keep good and bad ones, in one parse and one write a
    micro-batch (a replayed batch overwrites its folder): ``read_good``,
    ``read_bad``.  Their numbers are taken while rows are written and kept
    beside them: ``read_counts``."""
    keyed = "key" in messages.columns
    decoded = decode_transactions(messages, value_col, [F.col("key")] if keyed else [])

    def sink(batch: DataFrame, batch_id: int):
        place = f"run_id={_run_id(batch)}/batch_id={batch_id}"
        seen = Observation()
        rows = batch.select(*(["key"] if keyed else []), *defaulted_fields(), F.when(~F.col("_ok"), F.col("_value")).alias("malformed"),
                            F.when(F.col("_ok"), "good").otherwise("bad").alias("side"))
        rows.observe(seen, F.count(F.lit(1)).alias("messages"), F.count_if(F.col("side") == "bad").alias("malformed")) \
            .write.mode("overwrite").partitionBy("side").parquet(f"{root}/rows/{place}")
        counts = seen.get
        batch.sparkSession.createDataFrame([(counts.get("messages", 0), counts.get("malformed", 0))],
                                           "messages long, malformed long") \
             .coalesce(1).write.mode("overwrite").json(f"{root}/counts/{place}")
    w = decoded.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"processingTime": PUSH_INTERVAL})).start()


def _side(spark: SparkSession, root: str, side: str) -> DataFrame:
    done = committed_folders(spark, f"{root}/rows/run_id=*/batch_id=*")
    return spark.read.option("basePath", f"{root}/rows").parquet(*done).where(F.col("side") == side) \
                .drop("run_id", "batch_id", "side")


def read_good(spark: SparkSession, root: str) -> DataFrame:
    return _side(spark, root, "good").drop("malformed")


def read_bad(spark: SparkSession, root: str) -> DataFrame:
    """``malformed``: the messages' text (null for a null message), and their key."""
    rows = _side(spark, root, "bad")
    return rows.select(*[c for c in ("key", "malformed") if c in rows.columns])


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, batch_id, messages, malformed`` of every finished micro-batch."""
    done = committed_folders(spark, f"{root}/counts/run_id=*/batch_id=*")
    return spark.read.option("basePath", f"{root}/counts").schema(
        "messages long, malformed long, run_id string, batch_id long").json(done)
