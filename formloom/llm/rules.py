"""Quality rules with risk-controlled thresholds.

A rule rejects a document when one of its measures exceeds a cutoff. Cutoffs come from labelled documents: per stratum and
rule, a cutoff counts as safe if the exact binomial bound says that it rejects at most the allowed share of good documents,
and among safe cutoffs the one with the largest net gain is taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import read_table
from formloom.llm.metrics import CAPITALS, SYMBOLS, count_of, dup_lines, word_chars, word_struct
from formloom.session import cut_lineage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Risk:
    """At most ``share`` of a stratum's good documents may be rejected wrongly, with ``confidence`` for all strata together."""

    share: float = 0.05
    confidence: float = 0.95
    #: Cutoffs of each rule from lax to strict; they don't depend on the data, so all labelled rows can serve as holdout.
    cutoffs: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbols_per_word": (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.02),
            "capital_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
            "bangs_per_word": (1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
            "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
            "repeat_share": (0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
        }
    )


def base_metrics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` with the base counts and two more; a null text has none of anything."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "lang",
        word_struct(text).alias("w"),
        word_chars(text).alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        count_of(text, CAPITALS).alias("n_capitals"),
        count_of(text, "!").alias("n_bangs"),
        (count_of(text, "\n") + 1).alias("n_lines"),
    )
    return rows.select("doc_id", "lang", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_capitals", "n_bangs", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def measures() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.col(a) / F.expr(f"nullif({b}, 0)"), F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "capital_share": per("n_capitals", "word_chars"),
        "bangs_per_word": per("n_bangs", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


def most_errors(n: Column, share: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, share) <= k) <= level, -1 if there is none.

    k errors in n rows then show with that level that the true share is below ``share`` (Clopper and Pearson). Terms are
    added up as logarithms, so no count underflows.
    """
    start = F.struct((n * log(1 - share)).alias("term"), (n * log(1 - share)).alias("total"), F.lit(-1).alias("k"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i) / (i + 1)) + log(share / (1 - share))
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"), F.when(a["total"] <= F.log(level), i.cast("int")).otherwise(a["k"]).alias("k"))

    found = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n * share), F.lit(0).cast("long"))), start, step, lambda a: a["k"])
    return F.when(n > 0, found).otherwise(-1)


def safe_cutoffs(labelled: DataFrame, risk: Risk) -> DataFrame:
    """``stratum`` and its map ``limits`` from rule to chosen cutoff. ``labelled`` has stratum, good and the measures.

    The allowed share is divided among the rules, the error level among rules and strata (Bonferroni). Within a rule no
    division is needed: a stricter cutoff rejects all that a laxer one does, so safe cutoffs form a sequence tested from
    lax to strict. Strata with too few labels get no cutoff. A cutoff is taken only if it rejects more bad documents than
    good ones; ties go to the laxer one.
    """
    n_rules = len(risk.cutoffs)

    def place(rule: str, value: Column) -> Column:
        """How many cutoffs of the rule a document exceeds, which are the strictest ones."""
        return F.struct(F.lit(rule).alias("rule"), F.size(F.filter(F.array(*map(F.lit, risk.cutoffs[rule])), lambda c: value > c)).alias("place"))

    passed = F.explode(F.array(*[place(rule, measures()[rule]) for rule in risk.cutoffs]))
    good, bad = F.sum(F.col("good").cast("long")), F.sum((~F.col("good")).cast("long"))
    counts = labelled.select("stratum", "good", passed.alias("x")).groupBy("stratum", "x.rule", "x.place").agg(good.alias("good"), bad.alias("bad"))
    n_strata = F.size(F.collect_set(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit(""))).over(Window.partitionBy()))
    rule = Window.partitionBy("stratum", "rule")
    onward = rule.orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        counts.withColumn("strata", n_strata)
        .withColumn("n", F.sum("good").over(rule))
        .withColumn("lost", F.sum("good").over(onward))
        .withColumn("gain", F.sum("bad").over(onward) - F.col("lost"))
        .where("place > 0 AND gain > 0")
    )
    level = F.lit(1 - risk.confidence) / (n_rules * F.col("strata"))
    rows = rows.withColumn("most", most_errors(F.col("n"), risk.share / n_rules, level)).where("lost <= most")
    best = F.max_by("place", F.struct("gain", "place"))
    chosen = rows.groupBy("stratum", "rule").agg(best.alias("place"))
    cut = F.coalesce(*[F.when(F.col("rule") == r, F.element_at(F.array(*map(F.lit, cuts)), -F.col("place"))) for r, cuts in risk.cutoffs.items()])
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", cut.alias("cutoff")))).alias("limits"))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every row of ``docs``; the stratum is the language.

    A null language is a stratum of its own. Labels that are null count as none; of several labels of a document the lowest
    holds. Without labels only the base rules reject. Repeated rows are judged each; other columns are ignored; an empty table
    gives an empty result.
    """
    risk = risk or Risk()
    rows = cut_lineage(base_metrics(docs).withColumn("base_failed", base_failed()))
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_doc")).agg((F.min("quality") > 0).alias("good"))
    labelled = rows.where("NOT base_failed").join(marks, F.col("doc_id") == F.col("l_doc")).withColumnRenamed("lang", "stratum")
    limits = cut_lineage(safe_cutoffs(labelled, risk))
    broken = F.lit(False)
    for rule, value in measures().items():
        broken = broken | F.coalesce(value > F.col("limits")[rule], F.lit(False))
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~broken).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
