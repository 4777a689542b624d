"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are enough: the classifier minimises the non-negative unbiased risk
``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))`` with an estimated share p of positives in the web text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from formloom.llm.common import by_slices, read_table

FEATURES = (
    "log_words", "word_length", "short_words", "distinct_words", "distinct_pairs", "symbols", "bars", "bangs", "capital_words", "capitalised",
    "stops", "commas", "digits", "words_a_line", "dup_lines", "longest_word",
)
SYMBOLS = "#*$%&<>"


def text_features(text: str | None) -> list[float]:
    """Shape of a whole text, without language, source or identity. A null or blank text has zeros."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = list(map(len, words))
    lines = text.split("\n")
    short = sum(x <= 3 for x in lengths)
    return [
        float(np.log1p(n)),
        sum(lengths) / n,
        short / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        sum(map(text.count, SYMBOLS)) / n,
        text.count("|") / n,
        text.count("!") / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        text.count(".") / n,
        text.count(",") / n,
        sum(map(text.count, "0123456789")) / n,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(max(lengths))),
    ]


@F.arrow_udf(ArrayType(FloatType()))
def features(texts: pa.Array) -> pa.Array:
    return by_slices(lambda some: pa.array([text_features(t) for t in some], pa.list_(pa.float32())), texts)


@dataclass(frozen=True)
class Model:
    edges: list[np.ndarray]  # bin limits of each feature
    weights: np.ndarray  # a weight a bin
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The place in ``weights`` of each feature's bin."""
        start = np.cumsum([0, *(len(e) + 1 for e in self.edges[:-1])])
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) + start

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[:-1][self.bins(x)].sum(axis=1) + self.weights[-1] if len(x) else np.empty(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(pos: np.ndarray, web: np.ndarray, size: int, prior: float | None, steps: int, decay: float) -> np.ndarray:
    """Weights over bins by Adam. ``prior`` None tells positives from web text; a number minimises the non-negative risk."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)

    def back(bins: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.zeros(size + 1)
        np.add.at(g, bins.ravel(), np.repeat(slope, bins.shape[1]))
        g[-1] = slope.sum()
        return g

    for t in range(1, steps + 1):
        zp, zu = w[pos].sum(axis=1) + w[-1], w[web].sum(axis=1) + w[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        up, down, down_u = (sp - 1) / len(pos), sp / len(pos), su / len(web)  # slopes of the logistic losses
        if prior is None:
            g = back(pos, up) + back(web, down_u)
        elif np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
            g = back(pos, prior * (up - down)) + back(web, down_u)
        else:  # the negative part may not fall below zero: step back from it
            g = -(back(web, down_u) - back(pos, prior * down))
        g += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(scores_pos: np.ndarray, scores_web: np.ndarray) -> float:
    """Share of positives in the web text: where scores are high, web text is nearly all positive.

    The share of web text above a score, over the share of positives above it, bounds the prior from above at every score; the
    least bound counts, over scores that keep a third to nine tenths of the positives.
    """
    cuts = np.quantile(scores_pos, np.linspace(0.1, 0.67, 20))
    bounds = [(scores_web > c).mean() / max((scores_pos > c).mean(), 1e-9) for c in cuts if (scores_pos > c).any()]
    return float(np.clip(min(bounds, default=0.5), 0.05, 0.98))


def fit_model(positives: np.ndarray, web: np.ndarray, n_bins: int = 12, steps: int = 1000, decay: float = 1e-5) -> Model:
    """Trains on feature rows. Without positives or web text the model scores everything 0.5 or above."""
    if not len(positives) or not len(web):
        return Model([np.empty(0) for _ in FEATURES], np.zeros(len(FEATURES) + 1), 0.5)
    both = np.concatenate([positives, web])
    share = np.linspace(0, 1, n_bins + 1)[1:-1]
    edges = [np.unique(np.concatenate([np.quantile(web[:, k], share), np.quantile(positives[:, k], [0.005, 0.02, 0.98, 0.995])])) for k in range(both.shape[1])]
    size = sum(len(e) + 1 for e in edges)
    shape = Model(edges, np.zeros(size + 1), 0.5)
    p, u = shape.bins(positives), shape.bins(web)
    half_p, half_u = np.arange(len(p)) % 2 == 0, np.arange(len(u)) % 2 == 0
    first = Model(edges, _fit(p[half_p], u[half_u], size, None, steps // 2, decay), 0.5)
    prior = estimate_prior(first.logits(positives[~half_p]), first.logits(web[~half_u])) if (~half_p).any() and (~half_u).any() else 0.5
    return Model(edges, _fit(p, u, size, prior, steps, decay), prior)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = 8000, max_web: int = 16000) -> Model:
    """Fits on at most ``max_positives`` documents with quality 1 and ``max_web`` others, both the first in hash order.

    Held-out rows give neither. A repeated doc_id counts once, with its least text. Of several labels of a document the lowest holds; null labels count as none.
    """
    place = F.xxhash64(F.lit("pu"), F.col("doc_id"))
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where(F.col("q") == 1)
    pos = good.where(~held_out()).join(docs.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id") == F.col("d"), "left_semi")
    pos = pos.select("doc_id").orderBy(place, "doc_id").limit(max_positives).select(F.col("doc_id").alias("s_doc"), F.lit(True).alias("positive"))
    web = docs.where(~held_out()).where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(place, "doc_id").limit(max_web)
    picked = pos.union(web.select("doc_id", F.lit(False)))
    # The sample has a fixed bound, so it may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("s_doc"))
    # A repeated id gives one row, its least text, so that no more rows than the sample has reach the driver.
    texts = texts.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    got = texts.select("doc_id", "positive", features(F.col("text")).alias("x")).toArrow().to_pandas().sort_values(["positive", "doc_id"])
    matrix = lambda flag: np.array([*got.loc[got["positive"] == flag, "x"]], np.float64).reshape(-1, len(FEATURES))
    return fit_model(matrix(True), matrix(False))


def score(model: Model) -> Column:
    """From a text to the probability of quality 1."""

    def some(texts: list) -> pa.Array:
        x = np.array([text_features(t) for t in texts], np.float32).astype(np.float64).reshape(-1, len(FEATURES))
        return pa.array(_sigmoid(model.logits(x)), pa.float64())

    @F.arrow_udf(DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(some, texts)

    return run


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``quality_ok`` added; whole texts are scored, null and empty ones too.

    Rows keep their columns, nulls included, but for columns of these two names, which are replaced; repeated rows are scored
    each. Without usable labels every document passes; an empty table gives no rows.
    """
    model = train(docs, labels, **options)
    return docs.withColumn("quality_score", score(model)(F.col("text"))).withColumn("quality_ok", F.col("quality_score") >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_ok").cast("int").alias("predicted"))
