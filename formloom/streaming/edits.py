"""The edit log as a stream: latest state per cell and running counts.

The log has no event time, so there is no watermark; ``job_id`` is part of the key because a new first pass starts a new log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.session import drop_folder, names_in
from formloom.sources.readers import parse_edit_log

CELL = ["job_id", "wb_id", "sheet", "target_cell"]


def read_edit_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Lines of log files as they arrive. Each line carries job_id, wb_id and seq next to the edit record."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    v = F.try_parse_json("value")
    d = raw.select(
        F.try_variant_get(v, "$.job_id", "string").alias("job_id"), F.try_variant_get(v, "$.wb_id", "string").alias("wb_id"),
        F.try_variant_get(v, "$.seq", "long").alias("seq"), F.col("value").alias("line"),
    )
    edits = parse_edit_log(d.select(F.to_json(F.struct("job_id", "wb_id")).alias("wb_id"), "seq", "line"))
    key = F.from_json("wb_id", "job_id string, wb_id string")
    return edits.withColumn("_k", key).withColumn("job_id", F.col("_k.job_id")).withColumn("wb_id", F.col("_k.wb_id")).drop("_k")


def stream_edit_state(edits: DataFrame) -> DataFrame:
    """Latest real edit per cell, kept up to date in update mode; late and repeated lines change nothing."""
    last = edits.filter("is_actual_edit").groupBy(*CELL).agg(F.max_by(F.struct("old_value", "new_value", "round_idx", "seq"), "seq").alias("x"))
    return last.select(*CELL, "x.*")


def stream_rollup(edits: DataFrame) -> DataFrame:
    """Running counts per job, round and source."""
    return edits.groupBy("job_id", "round_idx", "source").agg(F.count("*").alias("n_writes"), F.count_if("is_actual_edit").alias("n_edits"))


class StateTable:
    """What a stream in update mode keeps for its keys, as files: a change set for each batch, merged into snapshots now and then.

    A batch that runs again writes the same change set again, so nothing counts twice. A snapshot holds the latest row of each
    key up to its batch; it is used once it is complete, and the change sets before the last but one snapshot go. Work for a
    batch is in proportion to its changes, but for every ``every``-th batch, which reads the table.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], every: int = 32):
        self.spark, self.folder, self.keys, self.every = spark, folder, keys, every

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: rows of ``batch`` have each key at most once."""
        batch.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def _snapshots(self) -> list[int]:
        """Batches of the complete snapshots, in order."""
        found = [n for n in names_in(self.spark, f"{self.folder}/snapshots") if n.startswith("upto=")]
        return sorted(int(n[5:]) for n in found if "_SUCCESS" in names_in(self.spark, f"{self.folder}/snapshots/{n}"))

    def _changes(self) -> list[int]:
        return sorted(int(n[6:]) for n in names_in(self.spark, f"{self.folder}/changes") if n.startswith("batch="))

    def compact(self, upto: int) -> None:
        """Merges all change sets up to a batch. A complete snapshot is not written again."""
        before = self._snapshots()
        if upto in before:
            return
        self.read(upto).write.mode("overwrite").parquet(f"{self.folder}/snapshots/upto={upto}")
        for old in before[:-1]:
            drop_folder(self.spark, f"{self.folder}/snapshots/upto={old}")
        for old in self._changes():
            if before and old <= before[-1]:  # readers may still use the snapshot before this one
                drop_folder(self.spark, f"{self.folder}/changes/batch={old}")

    def read(self, upto: int | None = None) -> DataFrame:
        """The latest row of each key, up to a batch if one is given."""
        base = max((b for b in self._snapshots() if upto is None or b <= upto), default=None)
        sets = [b for b in self._changes() if (base is None or b > base) and (upto is None or b <= upto)]
        parts = [self.spark.read.parquet(f"{self.folder}/changes/batch={b}").withColumn("_batch", F.lit(b)) for b in sets]
        if base is not None:
            parts.append(self.spark.read.parquet(f"{self.folder}/snapshots/upto={base}").withColumn("_batch", F.lit(base)))
        if not parts:
            raise FileNotFoundError(f"no state in {self.folder}")
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        rest = [c for c in every.columns if c not in (*self.keys, "_batch")]
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
        return last.select(*self.keys, "_last.*")


def run_into(result: DataFrame, table: StateTable, checkpoint: str) -> None:
    """Lets a stream take all files that are there, and its results reach the table batch by batch."""
    stream = result.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
