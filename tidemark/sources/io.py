"""Sources and sinks: files, JDBC, Kafka and their fallbacks by a format argument."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIDEO_COLUMNS = (
    "video_id trending_date title channel_title category_id publish_time tags views likes dislikes comment_count thumbnail_link comments_disabled ratings_disabled video_error_or_removed description".split()
)
RAW_VIDEOS = T.StructType([T.StructField(c, T.StringType()) for c in VIDEO_COLUMNS])
_CORRUPT = "_corrupt_record"


def read_videos(spark: SparkSession, paths: str | list[str], region: str = r"([A-Z]{2})[^/]*$", multi_line: bool = True, quote_escape: str = '"', keep_corrupt: bool = False, of: str = "file_name") -> DataFrame:
    """All regions' listings in one scan, every column a string; the region comes from the file's name (or its 'file_path')."""
    schema = T.StructType([*RAW_VIDEOS.fields, *([T.StructField(_CORRUPT, T.StringType())] if keep_corrupt else [])])
    r = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", quote_escape).option("mode", "PERMISSIVE")
    if keep_corrupt:
        r = r.option("columnNameOfCorruptRecord", _CORRUPT)
    return r.csv(paths).withColumn("region", F.regexp_extract(f"_metadata.{of}", region, 1))


def read_categories(spark: SparkSession, paths: str | list[str], region: str | None = r"([A-Z]{2})[^/]*$", of: str = "file_name") -> DataFrame:
    """category_id, title and assignable of category documents, parsed on the executors."""
    schema = "items array<struct<id string, snippet struct<title string, assignable boolean>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(paths)
    if region:
        docs = docs.withColumn("region", F.regexp_extract(f"_metadata.{of}", region, 1))
    rows = docs.select(F.explode("items").alias("x"), *(["region"] if region else []))
    return rows.select(F.col("x.id").alias("category_id"), F.col("x.snippet.title").alias("title"), F.col("x.snippet.assignable").alias("assignable"), *(["region"] if region else []))


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A table of files; 'avro' needs its package on the cluster."""
    r = spark.read.format(fmt)
    return (r.schema(schema) if schema is not None else r).load(path)


def jdbc_parts(spark: SparkSession, url: str, table: str, column: str, parts: int, properties: dict | None = None, bins: int = 64, rounds: int = 8) -> list[str]:
    """Predicates that cut a table into parts of near equal size by a numeric column, in order; rows without a value go with the last.

    The database counts: rows by equal ranges at first, then again within those
    ranges that hold more than a part's share, however skewed. A value that alone
    has more than that is a part of its own. ``column`` is SQL, quoted as the
    database has it. Each question returns ``bins`` rows at most.
    """

    def ask(low, high) -> list[tuple]:
        width = (float(high) - float(low)) / bins or 1.0
        # monotonous in the column, so that ranges can't overlap however the database rounds
        inner = f"SELECT {column} AS v, FLOOR(({column} - {float(low)!r}) / {width!r}) AS r FROM {table} WHERE {column} >= {low} AND {column} <= {high}"
        got = spark.read.jdbc(url, f"(SELECT MIN(x.v) AS lo, MAX(x.v) AS hi, COUNT(*) AS n FROM ({inner}) x GROUP BY x.r) t", properties=properties or {})
        return sorted(tuple(r) for r in got.collect())

    first = spark.read.jdbc(url, f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi, COUNT({column}) AS n FROM {table}) t", properties=properties or {}).first()
    if not first[2]:
        return ["1 = 1"]
    done, todo, share = [], [tuple(first)], first[2] / parts
    for _ in range(rounds):
        split = [r for low, high, _ in todo for r in ask(low, high)]
        # a tenth of a share is fine enough to deal out evenly
        todo = [r for r in split if r[2] > share / 10 and r[0] < r[1]]
        done += [r for r in split if not (r[2] > share / 10 and r[0] < r[1])]
        if not todo:
            break
    out, held = [], []
    for low, high, n in sorted(done + todo):
        if held and sum(h[2] for h in held) + n / 2 > share:
            out.append(held)
            held = []
        held.append((low, high, n))
    cuts = [f"{column} >= {h[0][0]} AND {column} <= {h[-1][1]}" for h in [*out, held]]
    return [*cuts[:-1], f"({cuts[-1]}) OR {column} IS NULL"]


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None, partition: tuple[str, int, int, int] | None = None, even: tuple[str, int] | None = None) -> DataFrame:
    """A JDBC table, in parallel ranges of (column, lowest, highest, number) if given, or in parts of near equal size of (column, number)."""
    if even:
        return spark.read.jdbc(url, table, predicates=jdbc_parts(spark, url, table, *even, properties), properties=properties or {})
    if partition:
        column, low, high, n = partition
        return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=n, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


def read_stream(spark: SparkSession, fmt: str, options: dict, schema: T.StructType, event_time: str = "envelope") -> DataFrame:
    """Messages {timestamp, source, data} as columns with ``ts``: the envelope's time, or that of processing.

    For Kafka the options are its own (subscribe, startingOffsets,
    maxOffsetsPerTrigger, failOnDataLoss); other formats read files with one
    text column ``value`` and take ``path`` and maxFilesPerTrigger.
    """
    s = spark.readStream.format(fmt).options(**options)
    if fmt not in ("kafka", "text"):
        s = s.schema("value string")
    # a filter on what is parsed would be moved below it with a second parsing; it stops at a generator
    rows = s.load().select(F.explode(F.array(F.from_json(F.col("value").cast("string"), schema))).alias("m")).select("m.*")
    ts = F.timestamp_seconds("timestamp") if event_time == "envelope" else F.current_timestamp()
    return rows.withColumn("ts", ts)


def register(df: DataFrame, name: str) -> None:
    """Give SQL a name for the relation."""
    df.createOrReplaceTempView(name)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), partitions: int | None = None, dynamic: bool = False, options: dict | None = None) -> None:
    """One overwriting write of a whole relation; ``dynamic`` replaces just the partitions that df has."""
    if partitions:
        df = df.repartition(partitions)
    elif partition_by:
        # AQE splits and joins the parts to its target size
        df = df.hint("rebalance", *partition_by)
    w = df.write.format(fmt).options(**(options or {})).mode("overwrite")
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


#: Folders that a task of ``write_parts`` has open at once; with more it sorts its rows.
OPEN_FOLDERS = "16"


def write_parts(df: DataFrame, path: str, fmt: str, partition_by: tuple[str, ...], options: dict | None = None) -> None:
    """Write a new folder for each of few values as the rows come, without a shuffle or sort; files are as many as the tasks' values."""
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": OPEN_FOLDERS}):
        df.write.format(fmt).options(**(options or {})).partitionBy(*partition_by).save(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, truncate: bool = False, batch: int = 10_000) -> None:
    df.write.option("truncate", truncate).option("batchsize", batch).jdbc(url, table, mode="overwrite", properties=properties or {})


def write_epoch(df: DataFrame, path: str, epoch: int, fmt: str = "parquet") -> None:
    """One micro-batch into its own folder: a replayed epoch replaces itself."""
    df.write.format(fmt).mode("overwrite").save(f"{path}/epoch={epoch}")


def to_envelope(df: DataFrame, source: str, timestamp: str | None = None) -> DataFrame:
    """A text column ``value`` with each row as a message {timestamp, source, data}."""
    now = F.unix_timestamp() if timestamp is None else F.col(timestamp)
    data = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != timestamp])
    return df.select(F.to_json(F.struct(now.cast("long").alias("timestamp"), F.lit(source).alias("source"), data.alias("data"))).alias("value"))


@contextmanager
def cached(df: DataFrame, *columns: str, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """The needed columns of a relation kept while the block runs."""
    kept = (df.select(*columns) if columns else df).persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is started in the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
