"""Tables below the cluster's shared folder, and published versions of a directory."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_run = uuid.uuid4().hex
_folders: dict[str, object] = {}
PUBLISHED = "_PUBLISHED"


def folder(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = folder(spark, path)
    return fs.delete(p, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (spark.checkpoint.dir). Where none is set, a local one in local mode, else an error.

    All paths of one driver lie in one folder, which goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gramlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    top = f"{root.rstrip('/')}/gramlake/{_run}"
    if top not in _folders:
        _folders[top] = spark
        if len(_folders) == 1:
            atexit.register(clean)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def clean() -> None:
    for top, spark in _folders.items():
        try:
            delete(spark, top)
        except Exception:  # noqa: BLE001  the JVM is gone: the folder stays for the cluster's own cleaning
            return


def written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """df as a written table: cuts the lineage, is computed once and survives lost executors. file_rows: a file's rows at most, 0: any."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    if path := getattr(df, "_written", None):
        delete(df.sparkSession, path)


# Versions: a reader sees a whole version or none.


def versions(spark: SparkSession, root: str) -> list[str]:
    """The published versions below `root`, oldest first."""
    fs, p = folder(spark, root)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    hadoop = spark._jvm.org.apache.hadoop.fs
    return [f"{root}/{n}" for n in names if n.startswith("v") and fs.exists(hadoop.Path(f"{root}/{n}/{PUBLISHED}"))]


def publish(spark: SparkSession, path: str) -> None:
    """Makes a written version visible: one marker, created in one step."""
    fs, p = folder(spark, f"{path}/{PUBLISHED}")
    fs.create(p, True).close()


def next_version(spark: SparkSession, root: str) -> str:
    """A path above all others', published or not."""
    fs, p = folder(spark, root)
    taken = [int(s.getPath().getName()[1:].split("-")[0]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v")] if fs.exists(p) else []
    return f"{root}/v{max(taken, default=-1) + 1:012d}-{uuid.uuid4().hex[:8]}"


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest published versions; readers of the one before the newest are not disturbed."""
    for old in versions(spark, root)[:-keep]:
        delete(spark, old)
