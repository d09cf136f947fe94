"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_shipped: set[str] = set()
#: Folders of applications whose session names none.
_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package's source, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    name = Path(tempfile.mkdtemp(prefix="pkg-")) / f"{root.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(name))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder, in one folder for the application.

    Where spark.checkpoint.dir is unset, as in tests, a folder of this machine
    serves, which only a local master can read.
    """
    return f"{_application_dir(spark)}/{uuid.uuid4().hex}"


def _application_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    top = spark.conf.get("spark.checkpoint.dir", None) or _folders.get(app)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _folders[app] = tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/tidemark-{app}"


def release(spark: SparkSession) -> None:
    """Remove all tables that operators have stored for this application; results that weren't written elsewhere go with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut, and lost executors lose none of it."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hex64(c: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]
