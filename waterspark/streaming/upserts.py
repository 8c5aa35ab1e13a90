"""Keyed latest-wins upserts from a stream: a short log on top of a snapshot.

Each micro-batch appends its deduplicated changes to the log under its stream and batch
id, so writing costs the size of the batch, and a batch that runs again overwrites its own
folder, which makes the at-least-once ``foreachBatch`` idempotent. Every ``compact_every``
batches the log is folded into a new snapshot, bucketed by key:

    log/stream=<id>/batch_id=<n>            changes of one batch
    snapshots/version=<v>/rows/bucket=<b>   the table as of this version
    snapshots/version=<v>/through           the last batch of each stream in it

A version counts once its ``through`` is complete, which is written last; readers take the
newest such version and the batches behind it, whose number is bounded. One version back
and its log stay for readers that have begun, what is older is removed.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waterspark.operators.upsert import latest_per_key

COMPACT_EVERY = 20
BUCKETS = 32


def stream_id(checkpoint_path: str) -> str:
    """Name of a stream in the log: batch ids count within one checkpoint folder."""
    return hashlib.sha256(checkpoint_path.encode()).hexdigest()[:16]


def start_upserts(
    changes: DataFrame, key: str, order: list[str], table_path: str, checkpoint_path: str, once: bool = True,
    compact_every: int = COMPACT_EVERY, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Start the stream into ``table_path``; ``once`` stops when the input is used up."""
    stream = stream_id(checkpoint_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest_per_key(batch, key, order).write.mode("overwrite").parquet(f"{table_path}/log/stream={stream}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(spark, table_path, key, order, buckets)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if once else writer).start()


# ---------------------------------------------------------------------- folders
def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _values(spark: SparkSession, path: str, name: str) -> list[str]:
    """Values of the folders ``name=value`` below ``path``."""
    here, files = _folder(spark, path)
    if not files.exists(here):
        return []
    found = (s.getPath().getName() for s in files.listStatus(here))
    return [f.removeprefix(f"{name}=") for f in found if f.startswith(f"{name}=")]


def _complete(spark: SparkSession, path: str) -> bool:
    done, files = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(done)


def _remove(spark: SparkSession, path: str) -> None:
    here, files = _folder(spark, path)
    files.delete(here, True)


def versions(spark: SparkSession, table_path: str) -> list[int]:
    """Complete versions of the snapshot, oldest first."""
    home = f"{table_path}/snapshots"
    return sorted(int(v) for v in _values(spark, home, "version") if _complete(spark, f"{home}/version={v}/through"))


def _through(spark: SparkSession, table_path: str, version: int | None) -> dict[str, int]:
    """Last batch of each stream in a version; one row a stream."""
    if version is None:
        return {}
    rows = spark.read.parquet(f"{table_path}/snapshots/version={version}/through").collect()
    return {r.stream: r.batch_id for r in rows}


def _batches(spark: SparkSession, table_path: str) -> list[tuple[str, int]]:
    """Complete batches of the log."""
    log = f"{table_path}/log"
    found = [(s, int(b)) for s in _values(spark, log, "stream") for b in _values(spark, f"{log}/stream={s}", "batch_id")]
    return sorted((s, b) for s, b in found if _complete(spark, f"{log}/stream={s}/batch_id={b}"))


# ------------------------------------------------------------------------ table
def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def current_table(spark: SparkSession, table_path: str, key: str, order: list[str]) -> DataFrame:
    """Latest row per key: the newest snapshot and the batches behind it."""
    return latest_per_key(_parts(spark, table_path)[0], key, order)


def _parts(spark: SparkSession, table_path: str, wanted: Column | None = None) -> tuple[DataFrame, dict[str, int], int]:
    """Rows to reduce, the batches they reach through, and the version they start from."""
    known = versions(spark, table_path)
    version = known[-1] if known else None
    through = _through(spark, table_path, version)
    new = [(s, b) for s, b in _batches(spark, table_path) if b > through.get(s, -1)]
    parts = []
    if version is not None:
        rows = spark.read.parquet(f"{table_path}/snapshots/version={version}/rows")
        parts.append((rows if wanted is None else rows.where(wanted)).drop("bucket"))
    if new:
        parts.append(spark.read.parquet(*[f"{table_path}/log/stream={s}/batch_id={b}" for s, b in new]))
    if not parts:
        raise FileNotFoundError(f"no batch has been written to {table_path}")
    reached = dict(through)
    for s, b in new:
        reached[s] = max(b, reached.get(s, -1))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), reached, version or 0


def lookup(spark: SparkSession, table_path: str, key: str, order: list[str], keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Current rows of the given keys: only their buckets of the snapshot are read.

    ``buckets`` is the number that the table was written with.
    """
    asked = spark.createDataFrame([(k,) for k in keys], f"{key} string")
    places = sorted({r[0] for r in asked.select(bucket_of(F.col(key), buckets)).collect()})
    rows, _, _ = _parts(spark, table_path, F.col("bucket").isin(places))
    return latest_per_key(rows.where(F.col(key).isin(keys)), key, order)


def compact(spark: SparkSession, table_path: str, key: str, order: list[str], buckets: int = BUCKETS) -> int:
    """Fold the log into the next version and remove what no reader needs; its number.

    Nothing new in the log means no new version, so a repeated call does no harm. One
    writer at a time; an unfinished version is overwritten by the next try.
    """
    rows, reached, version = _parts(spark, table_path)
    if version and reached == _through(spark, table_path, version):
        return version
    home = f"{table_path}/snapshots/version={version + 1}"
    table = latest_per_key(rows, key, order).withColumn("bucket", bucket_of(F.col(key), buckets))
    table.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/rows")
    marks = spark.createDataFrame(sorted(reached.items()), "stream string, batch_id long").coalesce(1)
    marks.write.mode("overwrite").parquet(f"{home}/through")
    _clean(spark, table_path)
    return version + 1


def _clean(spark: SparkSession, table_path: str) -> None:
    known = versions(spark, table_path)
    for old in known[:-2]:
        _remove(spark, f"{table_path}/snapshots/version={old}")
    if len(known) > 1:
        folded = _through(spark, table_path, known[-2])
        for s, b in _batches(spark, table_path):
            if b <= folded.get(s, -1):
                _remove(spark, f"{table_path}/log/stream={s}/batch_id={b}")


def product_events(raw: DataFrame) -> DataFrame:
    """Blank splits are missing values; everything else passes through."""
    return raw.withColumn("split", F.when(F.col("split") != "", F.col("split")))
