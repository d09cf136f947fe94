"""Runs streams: one runner for all reports, idempotent epochs, and reading the final state back.

The state of an output is a snapshot and the epochs after it. ``compact`` folds
closed epochs into a new snapshot: it is written aside, renamed in one step, and
only then are the epochs and the snapshot that it replaces removed. What a crash
leaves behind is ignored by readers and removed by the next compaction.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.history import empty_like
from tidemark.sources import io, versions

SNAPSHOTS = "_snapshots"
VERSIONS = "_versions"
#: State lies in files on each executor's disk, with bounded memory beside the heap, so that neither heap nor its collection grows with the keys; a micro-batch keeps its changes alone.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def run(
    stream: DataFrame,
    outputs: Mapping[str, Callable[[DataFrame], DataFrame]],
    folder: str,
    checkpoint: str,
    mode: str = "update",
    every: str | None = None,
    compacted: Mapping[str, list[str]] | None = None,
    epochs: int = 20,
    past: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Write each output of each micro-batch under ``folder``; errors stop the query.

    ``outputs`` are functions of the micro-batch, which is kept while they are
    written. Without ``every`` all there is to read is processed, then it ends.
    ``compacted`` names outputs by their keys whose closed epochs are folded
    into a snapshot whenever so many have gathered and they hold as much as the
    snapshot before, so that folding moves but a few times what epochs write.
    ``past`` names tables in
    versions by their paths, which outputs take as arguments: each micro-batch
    reads the newest, so that what is published takes effect without a restart,
    and its epoch keeps the numbers, so that a replay reads the same ones.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        with io.cached(batch) as kept:
            # asked of what is kept, since a micro-batch that is worked out again does its state's work again
            if kept.isEmpty():
                return
            used = _pinned(spark, folder, epoch, past) if past else {}
            tables = {name: versions.read(spark, past[name], n) for name, n in used.items()}
            for name, output in outputs.items():
                io.write_epoch(output(kept, **tables), f"{folder}/{name}", epoch)
        for name, keys in (compacted or {}).items():
            if _due(spark, f"{folder}/{name}", epochs):
                compact(spark, f"{folder}/{name}", keys)

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(process)
    # a query keeps the settings that it starts with, and a checkpoint the provider that it was begun with
    with io.settings(stream.sparkSession, ON_DISK):
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _pinned(spark: SparkSession, folder: str, epoch: int, past: Mapping[str, str]) -> dict[str, int]:
    """The version of each table that an epoch reads: those it read before, or else the newest, kept before any output is written."""
    final = f"{folder}/{VERSIONS}/epoch={epoch}"
    fs, p = _folder(spark, final)
    if not fs.exists(p):
        newest = [(name, (versions.numbers(spark, path) or [None])[-1]) for name, path in past.items()]
        if none := [past[name] for name, n in newest if n is None]:
            raise FileNotFoundError(f"{', '.join(none)} has no version")
        aside = f"{folder}/{VERSIONS}/_writing={epoch}"
        spark.createDataFrame(newest, "name string, version long").coalesce(1).write.mode("overwrite").json(aside)
        if not fs.rename(_folder(spark, aside)[1], p):
            raise OSError(f"{final} could not be written")
    return {r["name"]: r["version"] for r in spark.read.schema("name string, version long").json(final).collect()}


def used_versions(spark: SparkSession, folder: str) -> DataFrame:
    """epoch, name and version of each table that an epoch has read."""
    path = f"{folder}/{VERSIONS}"
    schema = "name string, version long, epoch long"
    fs, p = _folder(spark, path)
    return spark.read.schema(schema).json(path) if fs.exists(p) else spark.createDataFrame([], schema)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders name=<number> whose writing ended."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [n for n in names if n.startswith(f"{name}=")]
    return sorted(int(n.partition("=")[2]) for n in found if fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1]))


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest snapshot's last epoch, and the epochs after it."""
    snapshot = max(_numbered(spark, f"{path}/{SNAPSHOTS}", "upto"), default=None)
    return snapshot, [n for n in _numbered(spark, path, "epoch") if snapshot is None or n > snapshot]


def _due(spark: SparkSession, path: str, most: int) -> bool:
    """Whether more than so many epochs have gathered and those to be folded have the snapshot's size at least."""
    snapshot, epochs = _parts(spark, path)
    if len(epochs) <= most:
        return False
    size = lambda p: (lambda fs, q: fs.getContentSummary(q).getLength())(*_folder(spark, f"{path}/{p}"))
    return snapshot is None or sum(size(f"epoch={n}") for n in epochs[:-1]) >= size(f"{SNAPSHOTS}/upto={snapshot}")


def _last(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, snapshot: int | None, epochs: list[int]) -> DataFrame:
    """The last row of each key in a snapshot and some epochs, with its epoch."""
    df = _written(spark, path, schema, snapshot, epochs)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "epoch").alias("_r"))
    return last.select("_r.*")


def _written(spark: SparkSession, path: str, schema: T.StructType, snapshot: int | None, epochs: list[int]) -> DataFrame:
    """All rows of a snapshot and some epochs, with their epoch."""
    full = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    df = None
    if epochs:
        # the epoch is the folder's name
        df = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/epoch={n}" for n in epochs])
    if snapshot is not None:
        old = spark.read.schema(full).parquet(f"{path}/{SNAPSHOTS}/upto={snapshot}")
        df = old if df is None else df.unionByName(old)
    return df


def state(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, epoch: bool = False) -> DataFrame:
    """The last row of each key, from the snapshot and later epochs alone; none where no epoch has written."""
    snapshot, epochs = _parts(spark, path)
    if snapshot is None and not epochs:
        return empty_like(spark, T.StructType([*schema.fields, *([T.StructField("epoch", T.LongType())] if epoch else [])]))
    df = _last(spark, path, keys, schema, snapshot, epochs)
    return df if epoch else df.drop("epoch")


def last_epochs(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The last epoch of each key: what ``current`` asks of a state, without reading or sorting its other columns."""
    full = T.StructType([*(schema[k] for k in keys), T.StructField("epoch", T.LongType())])
    snapshot, epochs = _parts(spark, path)
    if snapshot is None and not epochs:
        return empty_like(spark, full)
    return _written(spark, path, T.StructType(full.fields[:-1]), snapshot, epochs).groupBy(*keys).agg(F.max("epoch").alias("epoch"))


def current(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, of: DataFrame) -> DataFrame:
    """Rows of a second output that hold still: those that the last epoch of their key in ``of`` (a state with epochs, or its ``last_epochs``) wrote."""
    rows = state(spark, path, keys, schema, epoch=True)
    last = of.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "epoch")])
    # a key may be null, as it may in the state
    return rows.join(last, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "epoch")], "left_semi").drop("epoch")


def appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that an output in append mode has written."""
    _, epochs = _parts(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/epoch={n}" for n in epochs]) if epochs else empty_like(spark, schema)


def compact(spark: SparkSession, path: str, keys: list[str]) -> int | None:
    """Fold all epochs but the newest, which may be replayed, into a snapshot; its last epoch, or None if there is nothing to fold."""
    snapshot, epochs = _parts(spark, path)
    done = snapshot
    if len(epochs) > 1:
        done = epochs[-2]
        schema = spark.read.parquet(f"{path}/epoch={done}").schema
        aside, final = (f"{path}/{SNAPSHOTS}/{name}={done}" for name in ("_writing", "upto"))
        _last(spark, path, keys, schema, snapshot, epochs[:-1]).write.mode("overwrite").parquet(aside)
        fs, p = _folder(spark, aside)
        if not fs.rename(p, _folder(spark, final)[1]):
            raise OSError(f"{final} could not be written")
    if done is not None:
        _removed(spark, path, done)
    return done if done != snapshot else None


def _removed(spark: SparkSession, path: str, upto: int) -> None:
    """Remove what a snapshot replaces."""
    fs, _ = _folder(spark, path)
    for folder, name in ((path, "epoch"), (f"{path}/{SNAPSHOTS}", "upto")):
        for n in _numbered(spark, folder, name):
            if n < upto or n == upto and name == "epoch":
                fs.delete(_folder(spark, f"{folder}/{name}={n}")[1], True)


def await_any(spark: SparkSession, seconds: int | None = None) -> None:
    spark.streams.awaitAnyTermination(seconds)
