"""Exact duplicates by a stateful stream over the files of a table.

Files run through a stream whose keyed state lies on disk (RocksDB, kept in the checkpoint folder) and never expires. For each
digest of a text it retains how often it came, the largest doc_id, and where that row's content lies (file and row). A digest
that came more than once is a hit: the contents are read again by their locators and compared byte by byte. Where a digest
stands for several texts, the texts themselves decide.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.collocations import Known, known
from formloom.llm.common import cut_plain, drop_folder
from formloom.session import cut_lineage, shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State stores of an executor share this setting's memory instead of taking some each.
BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
#: Whether a state store takes disk space in advance, some MB each; there are as many stores as shuffle partitions.
AHEAD = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
#: Bytes of files that one batch of the stream takes.
BATCH_BYTES = 256 << 30

Digest = Callable[[bytes], bytes]


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _folded(texts: pa.Array) -> pa.Array:
    """Lower-cased from A to Z; null is empty."""
    return pc.ascii_lower(pc.fill_null(texts, ""))


def digest_of(digest: Digest) -> Callable[[Column], Column]:
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([digest(x) for x in _folded(texts).cast(pa.binary()).to_pylist()], pa.binary())

    return run


def marked(digest: Digest, hits: Callable[[], Known]) -> Callable[[Column], Column]:
    """A text's digest, and the folded text where the digest may be a hit."""

    @F.arrow_udf("struct<digest:binary,folded:string>")
    def run(texts: pa.Array) -> pa.Array:
        folded = _folded(texts)
        digests = [digest(x) for x in folded.cast(pa.binary()).to_pylist()]
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in digests), np.uint64, len(digests))
        shown = pc.if_else(pa.array(hits().has(h), pa.bool_()), folded, pa.scalar(None, folded.type))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), shown.cast(pa.string())], ["digest", "folded"])

    return run


def _located(frame: DataFrame, *columns: Column) -> DataFrame:
    """Rows with the place of their content, however the table's own columns are called."""
    place = frame.metadataColumn("_metadata")
    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), place["file_path"].alias("path"), place["row_index"].alias("at"), *columns)


def remember(spark: SparkSession, path: str, checkpoint: str, digest: Digest = sha256, batch_bytes: int = BATCH_BYTES) -> None:
    """Lets all files of ``path`` (a folder or pattern of Parquet files with ``doc_id, text``) that ``checkpoint`` has not seen run through the stream."""
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(path)
    rows = _located(files, digest_of(digest)(F.col("text").cast("string")).alias("digest"))
    state = rows.groupBy("digest").agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "path", "at")).alias("keep"))
    wanted = {PROVIDER: ROCKSDB, BOUNDED: "true", AHEAD: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        stream = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stream.awaitTermination()


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stream's state: ``digest, size, keep_id, keep_path, keep_at``."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        "key.digest", F.col("value.count").alias("size"), F.col("value.max.doc_id").alias("keep_id"),
        F.col("value.max.path").alias("keep_path"), F.col("value.max.at").alias("keep_at"),
    )


def duplicates(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Digest = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept, path, at`` of every row of the files of ``path``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest doc_id
    stays (null is the smallest; of one doc_id the last place), and only that row is ``kept``. ``checkpoint`` names a folder that
    all executors share; the next call with it takes only new files and knows all earlier ones. Files may not be added during a
    call, changed or deleted. Very long texts are compared whole; an empty table gives no rows; other columns are ignored.
    """
    folder = checkpoint or f"{shared_folder(spark)}/formloom-exact-{uuid.uuid4().hex}"
    remember(spark, path, folder, digest, batch_bytes)
    state = cut_plain(remembered(spark, folder))
    if not checkpoint:
        drop_folder(spark, folder)
    repeated = state.where("size > 1")
    hits = spark.sparkContext.broadcast(known(repeated.select(F.xxhash64("digest").alias("h"))))  # of bounded size, see there
    rows = _located(spark.read.parquet(path), marked(digest, lambda: hits.value)(F.col("text").cast("string")).alias("m"))
    rows = cut_lineage(rows.select("doc_id", "path", "at", "m.digest", "m.folded"))

    # Full bytes of each hit against the content that the state's locator leads to.
    again = rows.where("folded IS NOT NULL").select("digest", "path", "at", "folded")
    at_home = (F.col("k_digest") == F.col("digest")) & (F.col("keep_path") == F.col("path")) & (F.col("keep_at") == F.col("at"))
    home = repeated.select(F.col("digest").alias("k_digest"), "keep_path", "keep_at").join(again, at_home).select("k_digest", F.col("folded").alias("kept_text"))
    other = again.join(home, F.col("digest") == F.col("k_digest")).where("folded <> kept_text")
    collided = cut_plain(other.select("digest")).distinct()  # not at once, so that a hot digest's join may be split

    own = (F.col("path") == F.col("keep_path")) & (F.col("at") == F.col("keep_at"))
    columns = ["doc_id", "digest", "keep_id", "size AS group_size", "kept", "path", "at"]
    slim = rows.select("doc_id", "path", "at", "digest")
    if collided.isEmpty():
        return slim.join(state, "digest").withColumn("kept", own).selectExpr(*columns)
    sure = slim.join(collided, "digest", "left_anti").join(state, "digest").withColumn("kept", own).selectExpr(*columns)
    mixed = rows.join(collided, "digest", "left_semi")
    groups = mixed.groupBy("digest", "folded").agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "path", "at")).alias("k"))
    groups = groups.select("digest", "folded", "size", F.col("k.doc_id").alias("keep_id"), F.col("k.path").alias("keep_path"), F.col("k.at").alias("keep_at"))
    return sure.union(mixed.join(groups, ["digest", "folded"]).withColumn("kept", own).selectExpr(*columns))


def unique(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of the files of ``path`` that stay, in their own columns."""
    kept = duplicates(spark, path, **options).where("kept").select(F.col("path").alias("k_path"), F.col("at").alias("k_at"))
    files = spark.read.parquet(path)
    place = files.metadataColumn("_metadata")
    row = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"), place["file_path"].alias("path"), place["row_index"].alias("at"))
    return row.join(kept, (F.col("path") == F.col("k_path")) & (F.col("at") == F.col("k_at")), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As a pattern, the name may be that of a file or of a folder.
    found = duplicates(spark, f"{sf_dir}/{{documents.parquet}}")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY folded)
"""
