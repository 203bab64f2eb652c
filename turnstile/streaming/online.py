"""The online store as folders — a changelog, a bucketed base, manifests.

``changes/run_id=R/batch_id=B`` holds the changed rows of one micro-batch.
``base/version=N/bucket=K`` holds whole buckets of keys, written by compaction N,
which rewrites only buckets that have changes.  ``manifest/version=N`` names
for each bucket the version that holds it, and the change folders that are
folded in.  A version counts once its manifest is written; until then, and
after a failure at any step, readers use the one before and every change
folder that it has not folded.  Nothing that a kept manifest names is ever
changed or removed, so readers need no lock.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.session import committed_folders, delete_path, folders

# Newest row per key: by time of writing, then by run (one per checkpoint) and
# batch, so a new checkpoint's batch 0 beats an older run's batch 5.
_ORDER = ("event_timestamp", "run_id", "batch_id")
BUCKETS = 256  # of a new store; a batch that touches one rewrites 1 / BUCKETS of the keys
_MANIFEST = "kind string, name string, version long"


@dataclass
class Manifest:
    """What a version consists of: its number of buckets, the version that
    holds each bucket that has rows, and the change folders folded in."""
    version: int = -1
    buckets: int = BUCKETS
    held: dict[int, int] = field(default_factory=dict)
    folded: set[str] = field(default_factory=set)


def _run_id(batch: DataFrame) -> str:
    """Id of the streaming query that delivers ``batch``, kept by its
    checkpoint; rows written outside a stream share one run."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "manual"


def write_online_batch(batch: DataFrame, batch_id: int, root: str, keys=("user_id",),
                       run_id: str | None = None) -> None:
    """Append one micro-batch of changed rows to the changelog.

    Each batch of each run lands in its own folder, overwritten on replay, so
    a retried batch is idempotent and no run touches another's rows.  Only
    changed keys move (update mode), never the whole table."""
    run = run_id or _run_id(batch)
    batch.withColumn("event_timestamp", F.current_timestamp()) \
         .write.mode("overwrite").parquet(f"{root}/changes/run_id={run}/batch_id={batch_id}")


def manifests(spark: SparkSession, root: str) -> list[str]:
    """Folders of the committed manifests, oldest first."""
    return committed_folders(spark, f"{root}/manifest/version=*")


def _load(spark: SparkSession, path: str | None) -> Manifest:
    """A manifest has a line per bucket and folded folder, so it is read whole."""
    if path is None:
        return Manifest()
    out = Manifest(int(path.rsplit("=", 1)[1]))
    for kind, name, version in spark.read.schema(_MANIFEST).json(path).collect():
        if kind == "buckets":
            out.buckets = int(version)
        elif kind == "held":
            out.held[int(name)] = version
        else:
            out.folded.add(name)
    return out


def current(spark: SparkSession, root: str) -> Manifest:
    """The newest committed manifest; an empty one for a new store."""
    found = manifests(spark, root)
    return _load(spark, found[-1] if found else None)


def _name(folder: str) -> str:
    return "/".join(folder.rstrip("/").split("/")[-2:])


def _changes(spark: SparkSession, root: str, folded: set[str]) -> list[str]:
    """Finished change folders that are not folded."""
    return [f for f in committed_folders(spark, f"{root}/changes/run_id=*/batch_id=*") if _name(f) not in folded]


def _rows(spark: SparkSession, root: str, held: dict[int, int], changes: list[str]) -> DataFrame | None:
    """Rows of the named buckets and change folders, and of no others."""
    parts = []
    if held:
        parts.append(spark.read.option("basePath", f"{root}/base").parquet(
            *[f"{root}/base/version={v:010d}/bucket={b}" for b, v in sorted(held.items())]).drop("version", "bucket"))
    if changes:
        parts.append(spark.read.option("basePath", f"{root}/changes").option("mergeSchema", "true").parquet(*changes)
                     .withColumn("run_id", F.col("run_id").cast("string"))
                     .withColumn("batch_id", F.col("batch_id").cast("long")))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else None


def _newest(rows: DataFrame, keys) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*_ORDER)).alias("_r")).select(*keys, "_r.*")


def read_online(spark: SparkSession, root: str, keys=("user_id",)) -> DataFrame:
    """Current snapshot: newest row per key over the base and the change
    folders that it has not folded.  A folder that cannot be read is an error."""
    now = current(spark, root)
    rows = _rows(spark, root, now.held, _changes(spark, root, now.folded))
    if rows is None:
        raise FileNotFoundError(f"no online rows under {root}")
    return _newest(rows, keys).drop("run_id", "batch_id")


def write_base(spark: SparkSession, root: str, keys=("user_id",), buckets: int = BUCKETS) -> Manifest | None:
    """First step of a compaction: the next version's changed buckets.  Returns
    its manifest, not yet committed, or none if nothing has changed.

    Only touched buckets are read and written, whole; an unfinished attempt of
    the same version is replaced."""
    now = current(spark, root)
    if now.version < 0:
        now.buckets = buckets
    changes = _changes(spark, root, now.folded)
    changed = _rows(spark, root, {}, changes)
    if changed is None:
        return None
    bucket = F.pmod(F.xxhash64(*keys), F.lit(now.buckets)).cast("int")
    touched = {r[0] for r in changed.select(bucket.alias("bucket")).distinct().collect()}  # ``buckets`` numbers at most
    rows = _rows(spark, root, {b: v for b, v in now.held.items() if b in touched}, changes)
    version = now.version + 1
    _newest(rows, keys).withColumn("bucket", bucket).repartition("bucket") \
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/base/version={version:010d}")
    still = {_name(f) for f in folders(spark, f"{root}/changes/run_id=*/batch_id=*")}
    return Manifest(version, now.buckets, now.held | {b: version for b in touched},
                    {n for n in now.folded if n in still} | {_name(f) for f in changes})


def commit(spark: SparkSession, root: str, manifest: Manifest) -> str:
    """Second step: the manifest, whose ``_SUCCESS`` makes the version count."""
    lines = [("buckets", "", manifest.buckets)] + [("held", str(b), v) for b, v in sorted(manifest.held.items())] \
        + [("folded", n, manifest.version) for n in sorted(manifest.folded)]
    target = f"{root}/manifest/version={manifest.version:010d}"
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").json(target)
    return target


def compact_online(spark: SparkSession, root: str, keys=("user_id",), buckets: int = BUCKETS) -> str | None:
    """Fold the changelog into the base (run periodically, one at a time).
    Returns the new manifest's folder, none if there was nothing to fold."""
    manifest = write_base(spark, root, keys, buckets)
    return None if manifest is None else commit(spark, root, manifest)


def vacuum_online(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what none of the ``keep`` newest versions needs: change folders
    that the oldest of them has folded, buckets that none of them names, and
    older manifests (last, so that a vacuum that was cut short goes on where it
    stopped).  Buckets of a version that is being written are left alone.
    Returns the removed folders."""
    found = manifests(spark, root)
    kept = [_load(spark, p) for p in found[-keep:]]
    if not kept:
        return []
    named = {(v, b) for m in kept for b, v in m.held.items()}
    gone = [f for f in folders(spark, f"{root}/changes/run_id=*/batch_id=*") if _name(f) in kept[0].folded]
    for f in folders(spark, f"{root}/base/version=*/bucket=*"):
        version, bucket = (int(x.rsplit("=", 1)[1]) for x in f.split("/")[-2:])
        if version <= kept[-1].version and (version, bucket) not in named:
            gone.append(f)
    gone += found[:-keep]
    for f in gone:
        delete_path(spark, f)
    return gone
