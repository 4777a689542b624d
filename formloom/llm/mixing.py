"""Mixing sources to target weights.

Documents get hash-random keys. Within each source the keys are split into ranges; the word counts of the ranges are summed
up from the lowest range on, which finds the range in which the source's budget ends, and only that range is sorted to find
the exact document and word. A source whose budget exceeds its words goes through whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import GAP, SPACES, let, words
from formloom.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hexadecimal digits of the key that name a range: 4,096 ranges a source.
RANGE_DIGITS = 3


def mix_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``; one row a source.

    Sources in order of code point (null last) take the weights in turn. Targets share the sum of all sizes by weight; no
    target exceeds ``max_epochs`` times its source's size, and what a source cannot take is shared again by weight. In
    order of size over weight the sources that hit their limit come first, so one running sum finds the common level.
    The table has one row a source, as the weights that a user states; it is the only one that a single task orders.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = (F.col("source_size") * max_epochs).cast("double")
    ranked = sizes.withColumn("w", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", (F.col("total") - (F.sum("limit").over(up_to) - F.col("limit"))) / F.sum("w").over(onward))
        .withColumn("pos", F.row_number().over(order))
        .withColumn("first_open", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("pos", "level"))).over(every)["level"])
    )
    return ranked.select("source", "source_size", F.least(F.col("limit"), F.col("first_open") * F.col("w")).alias("target"))


def cut_points(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, range_digits: int = RANGE_DIGITS
) -> DataFrame:
    """One row a source: its target, the whole epochs, and where the last epoch ends.

    ``sized`` has ``doc_id, source, size, mix_key``. In the last epoch a document before ``(cut_key, cut_doc, cut_size)`` is
    taken whole, that one gives ``cut_words`` words, later ones nothing. A hot source is spread over its ranges, and
    both aggregations combine before their shuffle.
    """
    bucket = F.substring("mix_key", 1, range_digits).alias("bucket")
    ranges = cut_lineage(sized.groupBy("source", bucket).agg(F.sum("size").alias("words")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_epochs)
    targets = cut_lineage(
        targets.withColumn("budget", F.coalesce(budget, F.lit(0)).cast("long"))
        .withColumn("epochs", F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_range = (
        ranges.withColumn("before", F.sum("words").over(in_order) - F.col("words"))
        .join(targets.select(F.col("source").alias("t_source"), "rest"), F.col("source").eqNullSafe(F.col("t_source")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("source").alias("r_source"), F.col("bucket").alias("r_bucket"), "before", "rest")
    )
    same_range = F.col("source").eqNullSafe(F.col("r_source")) & (F.substring("mix_key", 1, range_digits) == F.col("r_bucket"))
    ties = (
        sized.join(open_range, same_range)
        .groupBy("source", "mix_key", "doc_id", "size", "before", "rest")
        .agg(F.count("*").alias("copies"))
    )
    sort = Window.partitionBy("source").orderBy("mix_key", "doc_id", "size")
    start = F.col("before") + F.sum(F.col("size") * F.col("copies")).over(sort) - F.col("size") * F.col("copies")
    cut = (
        ties.withColumn("start", start)
        .where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size") * F.col("copies")))
        .select(
            F.col("source").alias("c_source"),
            F.struct("mix_key", "doc_id", "size").alias("cut"),
            F.expr("(rest - start) div copies").alias("cut_words"),
        )
    )
    return cut_lineage(
        targets.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
            F.col("source").alias("t_source"), "source_size", "target", "epochs", "cut", "cut_words"
        )
    )


def _decided(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """``sized`` (any columns, ``doc_id, source, size, mix_key`` among them) with its source's cut, and the last epoch's words."""
    here = F.struct("mix_key", "doc_id", "size")
    last = F.when(F.col("cut").isNull() | (here > F.col("cut")), 0).when(here < F.col("cut"), F.col("size")).otherwise(F.col("cut_words"))
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("last_words", last.cast("long"))


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id"), F.col("source"), F.size(words(F.col("text"))).cast("long").alias("size"), mix_key(F.col("doc_id"), seed).alias("mix_key"), *more
    )


def mix_plan(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How many words of each document the mix takes: ``doc_id, source, size, source_size, target, epochs, taken``.

    Needs ``doc_id, text, source``; other columns are ignored. A null or blank text has size 0 and takes 0. A null source is
    a source of its own. Rows that are equal in key, doc_id and size share the place of the cut: each gives the same
    number of words, so a source may stay short of its budget by less than one word a copy. Sources without words get
    target 0. An empty table gives an empty plan.
    """
    sized = cut_lineage(_sized(docs, seed))
    return _decided(sized, cut_points(sized, weights, max_epochs)).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs") + F.col("last_words")).alias("taken")
    )


def mix(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixture itself, in the columns of ``docs``: each document once per epoch that takes it.

    The document in which a source's budget ends comes with the words the budget still allows (``n_chars``, where there is
    such a column, follows). Texts stay where they are: the plan is reduced to one cut a source, and each task applies it.
    Documents without words come in every epoch that their key is reached in. Nulls, ties and empty tables: see ``mix_plan``.
    """
    columns = docs.columns
    sized = _sized(docs, seed)
    cuts = cut_points(cut_lineage(sized), weights, max_epochs)
    out = _decided(_sized(docs, seed, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")), cuts)
    here = F.struct("mix_key", "doc_id", "size")
    extra = F.when(F.col("cut").isNotNull() & ((here < F.col("cut")) | ((here == F.col("cut")) & (F.col("cut_words") > 0))), F.col("last_words"))
    whole = F.array_repeat(F.col("size"), F.col("epochs").cast("int"))
    out = out.select("row", "size", F.explode(F.concat(whole, F.when(extra.isNotNull(), F.array(extra)).otherwise(F.array().cast("array<bigint>")))).alias("take"))
    text = F.when(F.col("take") >= F.col("size"), F.col("row.text")).otherwise(first_words(F.col("row.text"), F.col("take")))
    shown = {"text": text}
    if "n_chars" in columns:
        shown["n_chars"] = F.when(F.col("take") >= F.col("size"), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[shown.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word, white space between them as it was."""
    gaps = F.regexp_extract_all(text, F.lit(GAP), F.lit(0))
    lead = F.when(F.ltrim(text, F.lit(SPACES)) == text, 0).otherwise(1)
    parts = let(words(text), lambda w: let(gaps, lambda g: F.transform(w, lambda x, i: F.concat(F.coalesce(F.get(g, i - 1 + lead), F.lit("")), x))))
    return F.array_join(F.slice(parts, 1, F.greatest(count, F.lit(0)).cast("int")), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formloom.llm.common import read_table

    return mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('0:' || doc_id) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (source_size * 3)::DOUBLE AS lim FROM s),
l AS (SELECT *, lim / w AS ratio, row_number() OVER o AS pos,
             ((sum(source_size) OVER ())::DOUBLE - (sum(lim) OVER (o ROWS UNBOUNDED PRECEDING) - lim))
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM w WINDOW o AS (ORDER BY lim / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(lim, w * (SELECT arg_min(lev, pos) FROM l WHERE ratio >= lev)) AS target FROM l),
b AS (SELECT *, least(floor(target + 0.5)::BIGINT, source_size * 3) AS budget FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, coalesce(b.budget // nullif(b.source_size, 0), 0) AS epochs, b.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * epochs + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM p
"""
