"""Expressions the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.ranges import let  # noqa: F401
from formloom.session import cut_lineage

#: What separates words: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


#: Texts of a batch that a worker turns into Python objects at once.
SLICE = 512


def by_slices(work: Callable[[list], pa.Array], texts: pa.Array, size: int = SLICE) -> pa.Array:
    """A batch's result, a slice at a time, so that a worker holds what belongs to few texts."""
    out = pa.concat_arrays([work(texts.slice(k, size).to_pylist()) for k in range(0, max(len(texts), 1), size)])
    give_back()
    return out


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Returns memory that a worker has freed to the system: idle workers stay, and keep what they hold."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def cut_plain(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``cut_lineage`` for tables of ids and hashes, without a codec."""
    return cut_lineage(df, replaces, compression="uncompressed")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
