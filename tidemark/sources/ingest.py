"""One call that takes raw listings and category documents of all regions into the raw zone.

A load writes its regions into folders of its own, all in one job for each kind.
They count from the moment a manifest names them: a table with each region's
load, written aside and renamed in one step. A rerun skips the regions that have
a load or, if asked to, loads them again and replaces their entries; a load that
fails leaves the manifest as it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import io

REGION = r"([A-Z]{2})[^/]*$"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def missing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths, which may hold wildcards, that name no file."""
    return [p for p in paths if not (lambda fs, q: fs.globStatus(q))(*_fs(spark, p))]


def _versions(spark: SparkSession, out: str) -> list[int]:
    fs, p = _fs(spark, f"{out}/_manifest")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def committed(spark: SparkSession, out: str) -> dict[str, str]:
    """The load of each region: a row for each region, whatever the listings' size."""
    versions = _versions(spark, out)
    if not versions:
        return {}
    return {r["region"]: r["load"] for r in spark.read.schema("region string, load string").json(f"{out}/_manifest/v={versions[-1]}").collect()}


def ingest_raw(spark: SparkSession, video_paths: Sequence[str], category_paths: Sequence[str], out: str, fmt: str = "avro", again: bool = False, region: str = REGION, of: str = "file_name") -> DataFrame:
    """Load listings and categories; region and load of all regions that count afterwards.

    The region is the first group of ``region`` in each path. Paths that name no
    file stop the load before anything is written.
    """
    paths = [*video_paths, *category_paths]
    if gone := missing(spark, paths):
        raise FileNotFoundError(", ".join(gone))
    unknown = [p for p in paths if not re.search(region, p)]
    if unknown:
        raise ValueError(f"no region in {', '.join(unknown)}")
    old = committed(spark, out)
    of_path = lambda p: re.search(region, p)[1]
    videos, categories = ([p for p in each if again or of_path(p) not in old] for each in (video_paths, category_paths))
    new = {of_path(p) for p in [*videos, *categories]}
    if new:
        load = f"l{uuid.uuid4().hex}"
        if videos:
            # a listing is of one region and read by one task, which writes it without a shuffle
            io.write_parts(io.read_videos(spark, list(videos), region, of=of), f"{out}/videos/load={load}", fmt, ("region",))
        if categories:
            io.write(io.read_categories(spark, list(categories), region, of=of), f"{out}/categories/load={load}", fmt, ("region",))
        _commit(spark, out, {**old, **dict.fromkeys(new, load)})
    return spark.createDataFrame(sorted(committed(spark, out).items()), "region string, load string")


def _commit(spark: SparkSession, out: str, entries: dict[str, str]) -> None:
    version = (_versions(spark, out) or [0])[-1] + 1
    aside, final = f"{out}/_manifest/_writing-{uuid.uuid4().hex}", f"{out}/_manifest/v={version}"
    spark.createDataFrame(sorted(entries.items()), "region string, load string").coalesce(1).write.json(aside)
    fs, p = _fs(spark, aside)
    to = _fs(spark, final)[1]
    if fs.exists(to) or not fs.rename(p, to):
        raise OSError(f"{final} could not be written: another load may have ended meanwhile")


def read_raw(spark: SparkSession, out: str, kind: str, fmt: str = "avro") -> DataFrame:
    """The 'videos' or 'categories' of the loads that count, with their region."""
    loads = committed(spark, out)
    if not loads:
        raise FileNotFoundError(f"{out} has no load")
    folders = [f for load in sorted(set(loads.values())) if not missing(spark, [f := f"{out}/{kind}/load={load}"])]
    df = spark.read.format(fmt).option("basePath", f"{out}/{kind}").load(folders)
    # partitions that a later load replaced are not read
    named = [(F.col("region") == r) & (F.col("load") == load) for r, load in loads.items()]
    either = named[0]
    for c in named[1:]:
        either = either | c
    return df.filter(either).drop("load")
