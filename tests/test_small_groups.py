"""Similar keys in groups with few and with many texts, against scoring every pair."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from formloom.functions import text as tx
from formloom.operators import similar as sm


def score(a, b):
    if a == b:
        return 1.0
    ta, tb = set(a.split()), set(b.split())
    inside = (a in b or b in a) and min(len(a), len(b)) >= 4
    return max(len(ta & tb) / len(ta | tb), float(inside), SequenceMatcher(None, a, b).ratio())


def test_pairs_of_small_and_large_groups(spark):
    rnd = random.Random(5)
    words = ["order", "ordre", "qty", "quantity", "ship", "date", "total", "part no", "status"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
    sizes = {"few": sm.FEW // 4, "edge": sm.FEW, "many": 2 * sm.FEW}
    right = [(g, b) for g, n in sizes.items() for b in {f"{text()} {i}" for i in range(n)}]
    left = [(g, a) for g in (*sizes, "alone") for a in {text() for _ in range(15)}]
    d = lambda rows: spark.createDataFrame(rows, "wb_id string, norm string")
    got = sm.similar_pairs(d(left + left[:5]), d(right + right[:5]), ["wb_id"], 0.74)
    want = {(g, a, b): round(score(a, b), 9) for g, a in left for h, b in right if g == h and score(a, b) >= 0.74}
    rows = got.collect()
    assert len(rows) == len(want) and {(x.wb_id, x.a, x.b): round(x.score, 9) for x in rows} == want
    assert len({g for g, _, _ in want}) == 3


def test_ratio_of_missing_text(spark):
    d = spark.createDataFrame([("", "x"), ("abcd", "x"), ("ab", "ba")], "a string, b string")
    got = d.select(tx.soft_key_score(F.col("a"), F.col("b")).alias("s"), tx.seq_ratio(F.nullif("a", F.lit("")), F.col("b")).alias("r")).collect()
    assert [x.s for x in got] == [0.0, 0.0, 0.5] and got[0].r is None
