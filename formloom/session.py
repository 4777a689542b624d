"""Session settings and the one way lineage is cut in this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "formloom", master: str | None = None, cpus: int = 8) -> SparkSession:
    """A session with adaptive execution on; only local runs get fixed sizes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.sql.shuffle.partitions", str(cpus))
                .config("spark.driver.memory", "12g")
                .config("spark.ui.enabled", "false")
                .config("spark.ui.showConsoleProgress", "false")
            )
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is empty and everything runs in one process, as in tests, a folder of our own is set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="formloom-"))
        folder = sc.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None, compression: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    The copy outlives lost executors, ends the lineage of loops, keeps columnar pruning, and has a known size, so later
    joins broadcast it only when it is small. ``replaces`` is an earlier result of this function that nothing reads any
    more once the new table is written; its files are deleted. ``compression`` overrides the session's codec for Parquet:
    tables of hashes gain nothing by it, and codecs hold buffers outside the heap.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/formloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if replaces is not None:
        drop_cut(replaces)
    return out


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(sc._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the cluster's file system; none where there is no such folder."""
    target, fs = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut_lineage`` wrote, once nothing reads them any more."""
    path = getattr(df, "cut_path", None)
    if path:
        drop_folder(df.sparkSession, path)
