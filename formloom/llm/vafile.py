"""Exact top-k search over vector-approximation files.

Vectors are quantised to a cell number of one byte a dimension. Scanning the cells bounds each inner product from both sides; a
candidate whose upper bound lies below a query's k-th lower bound drops out. The rest read exact vectors in the order of
their bounds until the k-th result beats the next bound. Queries meet the approximations in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import read_table
from formloom.session import cut_lineage, drop_cut

#: Rows of a packed block, of queries and of approximations.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 8192
#: Candidates of a query whose exact vectors are read at first; four times as many in each further round.
FIRST_READ = 32
CELLS = 256


def usable(vectors: DataFrame, column: str, scale: float) -> DataFrame:
    """``vec_id, x``: floored multiples, without null vectors, null or non-finite components, and null ids.

    Rows equal in id and vector count once.
    """
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & finite)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("x")).distinct()


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; missing components of shorter ones count 0."""
    out = np.zeros((len(rows), width), np.float64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v[:width]
    return out


def _pack(width: int, low: np.ndarray, step: np.ndarray):
    """Batches of ``vec_id, x`` to packed blocks of ids and cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), VECTOR_BLOCK):
                part = rows.iloc[at : at + VECTOR_BLOCK]
                cells = np.clip((_matrix(part["x"], width) - low) // step, 0, CELLS - 1).astype(np.uint8)
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "cells": [cells.tobytes()]})

    return run


def _pack_queries(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), QUERY_BLOCK):
                part = rows.iloc[at : at + QUERY_BLOCK]
                yield pd.DataFrame({"q_ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "q": [_matrix(part["x"], width).tobytes()]})

    return run


def _scan(width: int, low: np.ndarray, step: np.ndarray, k: int):
    """Bounds of all pairs of a query block and an approximation block; those that may be among a query's k best leave it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for ids, cells, q_ids, q in rows[["ids", "cells", "q_ids", "q"]].itertuples(index=False):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                q = np.frombuffer(q, np.float64).reshape(len(q_ids), width)
                lowest = np.frombuffer(cells, np.uint8).reshape(len(ids), width) * step + low
                base = q @ lowest.T  # each component lies between its cell's lowest and lowest + step - 1 (whole numbers)
                up = (np.maximum(q, 0) @ (step - 1))[:, None]
                down = (np.minimum(q, 0) @ (step - 1))[:, None]
                slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(low + step * CELLS)))[:, None] * (np.abs(base) > 2**52)
                upper, lower = base + up + slack, base + down - slack
                lower[q_ids[:, None] == ids[None, :]] = -np.inf
                upper[q_ids[:, None] == ids[None, :]] = -np.inf
                kth = np.partition(lower, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(q_ids), -np.inf)
                i, j = np.nonzero((upper >= kth[:, None]) & (upper > -np.inf))
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "upper": upper[i, j], "lower": lower[i, j]})

    return run


def _product(x: Column, y: Column) -> Column:
    """The exact inner product, brought into the range of a long."""
    n = F.least(F.size(x), F.size(y))
    pairs = F.arrays_zip(F.slice(x, 1, n).alias("a"), F.slice(y, 1, n).alias("b"))
    most, least = F.lit(2**63 - 1).cast("decimal(38,0)"), F.lit(-(2**63)).cast("decimal(38,0)")
    exact = F.aggregate(pairs, F.lit(0).cast("decimal(38,0)"), lambda s, p: F.try_add(s, p["a"].cast("decimal(19,0)") * p["b"].cast("decimal(19,0)")).try_cast("decimal(38,0)"))
    rough = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"].cast("double") * p["b"].cast("double"))
    return F.coalesce(F.greatest(F.least(exact, most), least), F.when(rough > 0, most).otherwise(least)).cast("long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each query row, ties to the smaller vec_id.

    ``vectors`` has ``vec_id`` and the vector column; others are ignored. A query is no candidate of its own; with fewer
    candidates all come. Vectors that are null or hold null or non-finite components take no part, nor do null ids.
    Repeated rows count once; vectors of one id that differ are candidates each, and share that id's ranking as queries.
    Vectors of different lengths meet in their common components. Of equal vectors only the k + 1 smallest ids can be among a
    query's k best, so a group of copies, however large, is cut to them before it meets any query. Scores beyond a long
    stay at its limits. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors, column, scale))
    spans = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    spans = spans.orderBy("d").collect()  # a row a dimension
    width = len(spans)
    low = np.array([min(r["lo"], 0) for r in spans], np.float64)
    step = np.array([max(1, -(-(max(r["hi"], 0) - min(r["lo"], 0) + 1) // CELLS)) for r in spans], np.float64)

    number = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    candidates = cut_lineage(rows.withColumn("copy", number).where(F.col("copy") <= k + 1).select("vec_id", "x"))
    queries = cut_lineage(rows.where(is_query))
    packed = candidates.mapInPandas(_pack(width, low, step), "ids binary, cells binary")
    asked = cut_lineage(queries.mapInPandas(_pack_queries(width), "q_ids binary, q binary"))
    # Query blocks are copied once to each of a number of parts, and the approximation blocks are dealt out among those.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    blocks = packed.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    copies = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    bounds = blocks.join(copies, "part").select("ids", "cells", "q_ids", "q").mapInPandas(_scan(width, low, step, k), "query_id bigint, vec_id bigint, upper double, lower double")
    bounds = cut_lineage(bounds)
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    kth = bounds.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy(F.col("query_id").alias("b_query")).agg(F.when(F.count("*") == k, F.min("lower")).alias("kth"))
    left = bounds.join(kth, F.col("query_id") == F.col("b_query")).where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    left = cut_lineage(left.withColumn("place", F.row_number().over(order)).select("query_id", "vec_id", "upper", "place"))
    drop_cut(bounds)

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    x, y = rows.select(F.col("vec_id").alias("query_id"), F.col("x")), rows.select("vec_id", F.col("x").alias("y"))
    read, seen, open_queries, results = FIRST_READ, 0, None, []
    kept: DataFrame | None = None
    while True:
        batch = left.where((F.col("place") > seen) & (F.col("place") <= read))
        if open_queries is not None:
            batch = batch.join(open_queries, "query_id", "left_semi")
        scored = batch.join(y, "vec_id").join(x, "query_id").select("query_id", "vec_id", _product(F.col("x"), F.col("y")).alias("score"))
        if kept is not None:
            scored = scored.union(kept.join(open_queries, "query_id", "left_semi"))
        top = scored.distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        kept = cut_lineage(top.select("query_id", "vec_id", "score"))
        further = left.where(F.col("place") == read + 1).select(F.col("query_id").alias("n_query"), F.col("upper").alias("next"))
        state = kept.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        # Not settled: fewer than k so far, or the next bound still reaches the k-th result.
        unsettled = state.join(further, F.col("query_id") == F.col("n_query")).where((F.col("n") < k) | (F.col("next") >= F.col("least"))).select("query_id")
        unsettled = cut_lineage(unsettled)
        results.append(kept.join(unsettled, "query_id", "left_anti"))
        if unsettled.isEmpty():
            break
        open_queries, seen, read = unsettled, read, read * 4
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
