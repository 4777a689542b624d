"""The composed operators with the match ratio, against the standard library's matcher."""

import difflib
import random
import re

from formloom.functions import text as tx
from formloom.operators import match as m
from formloom.plans.catalog import QUERIES

KEYS = "wb_id string, sheet string"


def norm(s):
    return re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).strip()


def key_score(a, b):
    """Equal 1; contained at least .82; shared tokens; the match ratio."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    best = len(x & y) / len(x | y)
    return max(best, difflib.SequenceMatcher(None, a, b).ratio())


def misspelt(r, s):
    s = list(s)
    for _ in range(r.choice([1, 1, 2])):
        k = r.randrange(len(s))
        s[k : k + 1] = r.choice([[], [r.choice("xyz")], [s[k], s[k]]])
    return "".join(s)


WORDS = ["shipment date", "return flag", "order quantity", "part number", "line status", "supplier name", "customer segment"]


def test_best_label_finds_misspelt_keys(spark):
    r = random.Random(4)
    labels = [("w", "S", k + 2, 1, w.title() + ":") for k, w in enumerate(WORDS)]
    targets = [("w", "S", k, misspelt(r, r.choice(WORDS))) for k in range(60)]
    got = {
        x["target_idx"]: (x["l_text"], round(x["score"], 6))
        for x in m.best_label(
            spark.createDataFrame(targets, KEYS + ", target_idx int, target string"), spark.createDataFrame(labels, KEYS + ", row int, col int, text string"), 0.74
        ).collect()
    }
    hits = 0
    for _, _, k, target in targets:
        scores = [(key_score(norm(target), norm(x[4])), -x[2], x[4]) for x in labels]
        score, _, text = max(scores)
        contained = any(norm(target) in norm(x[4]) or norm(x[4]) in norm(target) for x in labels)
        if contained:  # containment has a score of its own
            assert k in got
        elif score >= 0.74:
            assert got[k] == (text, round(score, 6))
            hits += score < 1
        else:
            assert k not in got
    assert hits > 30


def test_blank_policy_reaches_misspelt_keys(spark):
    policies = [("w", "blank_policy", k, w, "leave_blank", "r") for k, w in enumerate(WORDS)]
    frame = spark.createDataFrame(policies, "wb_id string, kind string, pol_idx int, target string, action string, reason string")
    keys = spark.createDataFrame([("w", "shipmnt dte"), ("w", "suplier nmae"), ("w", "no such thing at all")], "wb_id string, key string")
    full = {x["key"] for x in m.blank_policy_for_key(keys, frame).collect()}
    native = {x["key"] for x in m.blank_policy_for_key(keys, frame, full=False).collect()}
    assert {"shipmnt dte", "suplier nmae"} <= full - native and "no such thing at all" not in full


def test_text_similarity_of_parts(spark):
    rows = QUERIES["d9_text_sim_full"](spark, "/root/testdata/sf0.001").collect()
    parts = {x["p_partkey"]: x for x in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    assert len(rows) == len(parts)
    for x in rows:
        p = parts[x["p_partkey"]]
        a, b = squeeze(f"{p['p_name']}/{p['p_type']}"), squeeze(f"{p['p_type']}-{p['p_brand']}")
        u, v = set(re.sub("[/-]", " ", a).split()), set(re.sub("[/-]", " ", b).split())
        want = 1.0 if a == b else max(len(u & v) / len(u | v), difflib.SequenceMatcher(None, a, b).ratio())
        assert abs(x["sim"] - want) < 1e-6, (a, b)
    assert tx.text_sim is not None
