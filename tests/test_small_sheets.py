"""Sheets with few rows are held as arrays, larger ones go by tiles; both against plain enumeration."""

import random

from pyspark.sql import functions as F

from formloom.operators import audit as au
from formloom.operators import similar as sm
from formloom.operators import spatial as sp

K = ["wb_id", "sheet"]
RECT = "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int"
ITEM = "wb_id string, sheet string, row int, col int, r0 int, c0 int, r1 int, c1 int, base_ok boolean, hard boolean"


def hit(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def rects(r, wb, n):
    out = []
    for _ in range(n):
        y, x = r.randint(1, 60), r.randint(1, 40)
        out.append((wb, "S", y, x, y + r.choice([0, 1, 3, 70]), x + r.choice([0, 2, 9])))
    return out


def refuse(*_, **__):
    raise AssertionError("tiles for a small sheet")


def test_flags_of_small_and_large_sheets(spark, monkeypatch):
    r = random.Random(4)
    left = [x for wb in ("small", "large", "none") for x in rects(r, wb, 40)] + [("small", "S", 1, 1, 1, 1)] * 2
    one, two = rects(r, "small", 5) + rects(r, "large", sp.FEW + 1), rects(r, "small", 3)
    f = lambda rows: spark.createDataFrame(rows, RECT)
    met = lambda a, side: any(a[:2] == b[:2] and hit(a[2:], b[2:]) for b in side)
    got = sp.flag_overlaps(f(left), {"one": f(one), "two": f(two + two)}, K)
    assert sorted(map(tuple, got.collect())) == sorted((*a, met(a, one), met(a, two)) for a in left)
    monkeypatch.setattr(sp, "_sides", refuse)
    few = sp.flag_overlap(f(left), f(two), K, "two")
    assert sorted(map(tuple, few.collect())) == sorted((*a, met(a, two)) for a in left)


def spread(items):
    fine, out = [], set()
    for x in sorted(items, key=lambda x: x[2:4]):
        if x[9]:
            continue
        over = any(hit(f[4:8], x[4:8]) and f[2:4] < x[2:4] for f in fine)
        if over:
            out.add(x[:4])
        if over or x[8]:
            fine.append(x)
    return out


def test_fine_spreads_in_one_go_on_small_sheets(spark, monkeypatch):
    r = random.Random(6)

    def sheet(wb, n):
        spots = r.sample([(y, x) for y in range(1, 40) for x in range(1, 8)], n)
        return [(wb, "S", y, x, y, x, y + r.randint(0, 3), x + r.randint(0, 3), r.random() < 0.1, r.random() < 0.1) for y, x in spots]

    small = [sheet(f"w{i}", r.randint(1, sp.FEW)) for i in range(6)]
    large = sheet("large", 2 * sp.FEW)
    got = au.propagate_forward(spark.createDataFrame(sum(small, large), ITEM)).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == set().union(spread(large), *map(spread, small))
    monkeypatch.setattr(au, "overlap_join", refuse)
    rows = au.propagate_forward(spark.createDataFrame(sum(small, []), ITEM)).collect()
    assert set(map(tuple, rows)) == set().union(*map(spread, small))


def test_only_blocks_are_joined_with_blocks(spark, monkeypatch):
    cells = spark.createDataFrame(
        [("w", "S", y, x, "v", "s") for y in range(1, 9) for x in (1, 4)] + [("w", "S", 1, 7, "alone", "s"), ("w", "S", 3, 7, " ", "s")],
        "wb_id string, sheet string, row int, col int, value string, value_type string",
    )
    blocks = [(2, 1, 3, 2), (8, 4, 8, 9), (3, 2, 4, 3)]
    merges = spark.createDataFrame([("w", "S", *b) for b in blocks], RECT)
    used, box = spark.createDataFrame([("w", "S", 1, 1, 9, 9)], RECT), spark.createDataFrame([("w", "S", 1, 1, 9, 4)], RECT)
    seen, join = [], au.overlap_join
    monkeypatch.setattr(au, "overlap_join", lambda left, *a, **k: [seen.append(left.count()), join(left, *a, **k)][1])
    got = {tuple(x)[2:] for x in au.duplicate_risk_regions(cells, merges, box, used).collect()}
    want = set()
    for y in range(1, 9):
        for x in (1, 4):
            home = [b for b in blocks if hit(b, (y, x, y, x))]
            if home and home[0][:2] != (y, x):
                continue
            own = home[0] if home else (y, x, y, x)
            near = [own] + [b for b in blocks if hit(b, own)]
            want.add((max(1, min(b[0] for b in near) - 1), max(1, min(b[1] for b in near) - 2), min(9, max(b[2] for b in near) + 1), min(9, max(b[3] for b in near) + 2)))
    assert got == want and seen == [2]


def test_right_side_files_no_tiles_above_the_left(spark):
    left = spark.createDataFrame([("w", "S", i, 1, i + 1, 2) for i in range(1, 9)], RECT)
    big = spark.createDataFrame([("w", "S", 1, 1, 500, 40), ("w", "S", 3, 1, 3, 1)], RECT)
    _, b, _, _ = sp._sides(left, big, K, 0, levels=big, left_levels=left)
    assert b.filter("_u.tag = 0").agg(F.max("_u.lv")).first()[0] == 0
    assert sp.overlap_join(left, big, K, levels=big, left_levels=left).count() == 8 + 2
    assert sp.overlap_join(big, left, K, levels=left, left_levels=big).count() == 8 + 2


def test_equal_texts_of_many_sheets_are_scored_once(spark, monkeypatch):
    d = lambda texts: spark.createDataFrame([(f"w{i}", x) for i in range(9) for x in texts], "wb_id string, norm string")
    tables, cut = [], sm.cut_lineage
    monkeypatch.setattr(sm, "cut_lineage", lambda x: [tables.append(cut(x)), tables[-1]][1])
    got = sm.similar_pairs(d(["order qty", "qty"]), d(["order qty", "status"]), ["wb_id"], 0.74)
    assert {(x.wb_id, x.a, x.b, x.score) for x in got.collect()} == {(f"w{i}", "order qty", "order qty", 1.0) for i in range(9)}
    assert [x.count() for x in tables] == [36, 1]


def test_equal_free_texts_of_many_sheets_are_scored_once(spark, monkeypatch):
    from difflib import SequenceMatcher

    words, other = ["ship date", "ship-date", "qty", "n/a"], ["ship date", "line status", "order qty", "-"]
    many = [f"label {i} {w}" for i in range(sm.FEW) for w in ("ship", "qty")]
    d = lambda rows: spark.createDataFrame(rows, "wb_id string, norm string")
    left = [(f"w{i}", x) for i in range(5) for x in words] + [("large", x) for x in words]
    right = [(f"w{i}", x) for i in range(5) for x in other] + [("large", x) for x in many]

    def score(a, b):
        na, nb = (x.replace("/", " ").replace("-", " ").strip() for x in (a, b))
        ta, tb = set(na.split()), set(nb.split())
        return 0.0 if "" in (na, nb) else 1.0 if a == b else max(len(ta & tb) / len(ta | tb), SequenceMatcher(None, a, b).ratio())

    tables, cut = [], sm.cut_lineage
    monkeypatch.setattr(sm, "cut_lineage", lambda x: [tables.append(cut(x)), tables[-1]][1])
    for t in (0.75, 0.34, 1e-6):
        got = {(x.wb_id, x.a, x.b): round(x.score, 9) for x in sm.similar_texts(d(left), d(right), ["wb_id"], t).collect()}
        assert got == {(g, a, b): round(score(a, b), 9) for g, a in left for h, b in right if g == h and score(a, b) >= t}
    assert len(tables) == 6
    assert all(len({(x.a, x.b) for x in s.collect()}) == s.count() for s in tables[1::2])
