"""Session helpers: building a session, reading tables, writing scratch tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine assumes; a cluster sets its own."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders this process has made for intermediate tables.
_MADE: list[str] = []


@atexit.register
def drop_scratch(spark: SparkSession | None = None) -> None:
    """Delete the intermediate tables of this process; called by itself at its end for
    folders in a file system, and with a session for those elsewhere. Results that still
    read them must be written before."""
    while _MADE:
        path = _MADE.pop()
        if path.startswith("file:") or "://" not in path:
            shutil.rmtree(re.sub(r"^file:(?://)?", "", path), ignore_errors=True)
        elif spark is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset (single-machine
    runs, tests) a local temporary folder, which is then set as the session's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.leafspan.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="leafspan-")
        _MADE.append(path)
        spark.conf.set("spark.leafspan.scratch", path)
    return path.rstrip("/")


def scratch_table(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, not a
    recomputation, and a table used twice is computed once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plan nodes whose partitions are not those of a scan.
_MOVED = re.compile(r"\b(?:Aggregate|Join|Window|Repartition\w*|Distinct|Sort|Deduplicate)\b")


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """A table that a scan would read in fewer tasks than there are cores (a small file, or
    one file), dealt out to ``tasks`` of them. Large tables are left as they are: their
    scan has tasks enough, and moving the rows would cost a shuffle. So is whatever a
    shuffle or a join has made; asking for its partitions would run it."""
    if df.isStreaming or _MOVED.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def package_root() -> str:
    return os.path.dirname(os.path.abspath(__file__))
