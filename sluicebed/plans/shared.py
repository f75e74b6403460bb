"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_folder(spark)}-code/{root.name}.zip")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(fs.makeQualified(path).toString())
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder of spark.checkpoint.dir; only where that is unset (tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sluicebed-")
        atexit.register(shutil.rmtree, _own[app][7:], ignore_errors=True)
    return _own[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sluicebed-{spark.sparkContext.applicationId}"


def place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted by clear()."""
    return f"{_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; DataFrames made from them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: a later loss of an executor recomputes nothing before it.

    Columns keep their names and types, rows their multiplicity; the table stays until clear() or the folder's own cleaning.
    """
    ship(df.sparkSession)
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(big: DataFrame, small: DataFrame, key: str, total: int, most: int = 10_000) -> DataFrame:
    """big joined with small, which has one row a key, such that no key fills a task.

    A key is hot if it holds at least 1/most of total, a number that is not below the rows of big; so at most `most` keys
    are hot, and their rows of small are broadcast. All other keys hold fewer rows each and are shuffled.
    """
    counts = big.groupBy(key).count()
    hot = written(counts.filter(F.col("count") * most >= max(1, total)).filter("count > 1000").select(key))
    if hot.isEmpty():
        return big.join(small, key)
    few = written(small.join(F.broadcast(hot), key))
    return big.join(F.broadcast(few), key).unionByName(big.join(F.broadcast(hot), key, "left_anti").join(small, key))


def broadcast_below(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows; otherwise the planner's join takes it. df should be written."""
    return F.broadcast(df) if df.count() <= most else df


def few_files(df: DataFrame, columns: list[str], most: int = 4) -> DataFrame:
    """columns of at most `most` of df's Parquet files, evenly spaced by name, for fitting on a bounded sample; all of df
    where it isn't read from Parquet files."""
    files = sorted(df.inputFiles())
    if len(files) <= most or not all(f.endswith(".parquet") for f in files):
        return df.select(*columns)
    chosen = [files[i * len(files) // most] for i in range(most)]
    return df.sparkSession.read.parquet(*chosen).select(*columns)
