"""A training corpus from documents: quality classifier, near-duplicates, personal data, source mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import bpe, mixing, neardup, pii, pu
from formloom.llm.common import read_table
from formloom.session import cut_lineage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    model = pu.train(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), pu.score(model)(F.col("text")).alias("score"))
    return scored.where("score >= 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), pii.finder(pii.train(docs))(F.col("text")).alias("found"))
    hit = F.size("found.base") + F.size("found.added") > 0
    text = F.when(hit, pii.redacted(F.col("row.text"), F.col("found.base"), F.col("found.added"))).otherwise(F.col("row.text"))
    shown = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    clean = found.select("row", text.alias("clean"), hit.alias("hit"))
    return clean.select(*[shown.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document of the mixture, and the digest of what they decode to."""
    tokens = bpe.tokenize(docs, keep=("doc_id", "lang", "source"))
    return tokens.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
    ("bpe_tokens", bpe_tokens),
]

#: No SQL form: a trained classifier, a trained random field and merges of a vocabulary decide the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    rows = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            rows = cut_lineage(rows)
    return rows
