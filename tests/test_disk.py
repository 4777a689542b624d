"""Joins that move each cell as seldom as they can, against plain enumeration."""

import random

from pyspark.sql import functions as F

from formloom.operators import grid as g
from formloom.operators import repair as rp
from formloom.operators import spatial as sp

K = ["wb_id", "sheet"]
CELL = "wb_id string, sheet string, row int, col int, value string, value_type string, border_bottom string, style_key string"
RECT = "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int"


def points(spark, n, seed, far):
    r = random.Random(seed)
    spots = [("w", "S", r.choice([r.randint(1, 90), r.randint(1, far)]), r.randint(1, 300)) for _ in range(n)]
    return spots, g.as_rects(spark.createDataFrame(spots, "wb_id string, sheet string, row int, col int"))


def test_points_are_filed_once_where_all_rectangles_are_small(spark):
    _, cells = points(spark, 50, 1, 20_000)
    small = spark.createDataFrame([("w", "S", i, 3, i + 2, 9) for i in range(1, 61)], RECT)
    a, b, _, _ = sp._sides(cells, small, K, 0, True, small)
    assert a.count() == 50 and b.select("o_r0").distinct().count() == 60 and b.agg(F.max("_u.lv")).first()[0] == 0


def test_points_meet_rectangles_of_every_size(spark):
    spots, cells = points(spark, 120, 2, 20_000)
    boxes = [("w", "S", 5, 5, 7, 9), ("w", "S", 60, 10, 70, 200), ("w", "S", 1, 1, 5_000, 300), ("w", "S", 1, 100, 20_000, 310), ("w", "S", 1, 7, 20_000, 7)]
    for some in (boxes, boxes[:2], boxes[:3], []):
        right = spark.createDataFrame(some, RECT)
        for grow in (0, 6):
            got = sorted((r.row, r.col, r.o_r0, r.o_c0, r.o_r1, r.o_c1) for r in sp.overlap_join(cells, right, K, grow, points=True, levels=right).collect())
            inside = lambda p, q: q[2] - grow <= p[2] <= q[4] + grow and q[3] - grow <= p[3] <= q[5] + grow
            assert got == sorted((*p[2:], *q[2:]) for p in spots for q in some if inside(p, q))


def sheets(spark, seed):
    """A template and a filled version with blocks of their own, nine by nine cells."""
    r = random.Random(seed)
    cell = lambda y, x: ("w", "S", y, x, r.choice(["a", "b", None]), "s", r.choice(["thin", None, None]), r.choice(["0", "9"]))
    grid = [(y, x) for y in range(1, 10) for x in range(1, 10)]
    t, f = ([cell(y, x) for y, x in r.sample(grid, 55)] for _ in range(2))
    m, n = [(2, 2, 3, 4), (6, 6, 9, 6)], [(2, 3, 4, 3), (6, 1, 6, 5), (8, 8, 9, 9)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    put = lambda blocks: frame([("w", "S", *b) for b in blocks], RECT)
    return (t, m, f, n), (frame(t, CELL), put(m), frame(f, CELL), put(n))


def cover(blocks, y, x):
    return next((b for b in blocks if b[0] <= y <= b[2] and b[1] <= x <= b[3]), None)


BOXES = [(1, 1, 1, 5, 6), (2, 3, 2, 9, 9), (3, 9, 9, 2_000, 300)]


def region_frame(spark):
    return spark.createDataFrame([("w", "S", *b) for b in BOXES], "wb_id string, sheet string, region_id int, r0 int, c0 int, r1 int, c1 int")


def test_damage_is_found_before_cells_meet_regions(spark):
    for seed in range(3):
        (t, m, f, n), frames = sheets(spark, seed)
        candidates = {tuple(cover(m, c[2], c[3])[:2]) if cover(m, c[2], c[3]) else (c[2], c[3]) for c in t if c[6]} | {b[:2] for b in m}
        now = {(c[2], c[3]): (c[4], c[5], c[7]) for c in f}
        want = []
        for c in t:
            if c[4] is None or (c[2], c[3]) in candidates:
                continue
            block = cover(n, c[2], c[3])
            have = now.get(block[:2] if block else (c[2], c[3]), (None, None, None))
            why = [w for w, hit in (("template_merge_changed", block), ("template_static_style_changed", have[2] != c[7]), ("template_static_value_changed", have[:2] != c[4:6])) if hit]
            want += [(i, c[2], c[3], c[4], have[0], tuple(why)) for i, *b in BOXES if why and b[0] <= c[2] <= b[2] and b[1] <= c[3] <= b[3]]
        d = rp.template_damage(region_frame(spark), *frames)
        got = [(r.region_id, r.row, r.col, r.template_value, r.current_value, tuple(r.reasons)) for r in d.collect()]
        key = lambda rows: sorted(rows, key=repr)
        assert key(got) == key(want)
        assert g.static_template_cells(frames[0], frames[1]).columns == [*g.POS, "value"]


def test_restored_cells_are_looked_up_once(spark):
    for seed in range(3):
        (t, m, f, n), (tf, mf, ff, nf) = sheets(spark, seed)
        old, now = ({(c[2], c[3]): (c[4], c[5], c[7]) for c in x} for x in (t, f))
        stays = [(y, x) for y, x in now if (y + x) % 5 == 0] + [(2, 3)]
        keep = spark.createDataFrame([("w", "S", y, x) for y, x in stays], "wb_id string, sheet string, row int, col int")
        spots = [(y, x, y, x) for y, x in {*old, *now} if not cover(n, y, x)] + n
        want, empty = [], (None, None, None)
        for i, *b in BOXES:
            for s in spots:
                if s[:2] in stays or not (s[0] <= b[2] and b[0] <= s[2] and s[1] <= b[3] and b[1] <= s[3]):
                    continue
                y, x = max(s[0], b[0]), max(s[1], b[1])
                block = cover(m, y, x)
                have, new = now.get(tuple(s[:2]), empty), old.get(tuple(block[:2]) if block else (y, x), empty)
                want.append((i, s[0], s[1], *new, have[:2] != new[:2] or (have[2] or "0") != (new[2] or "0")))
        d = rp.restore_region(region_frame(spark), tf, mf, ff, nf, preserve=keep)
        got = [(r.region_id, r.row, r.col, r.value, r.value_type, r.style_key, r.changed) for r in d.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        text = d._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Join LeftAnti") == 1  # only blocks are compared with preserved cells; single cells are folded by position


def test_requests_travel_to_their_anchor_once(spark, monkeypatch):
    req = spark.createDataFrame([("w", "S", i, "AB"[i % 2] + str(1 + i % 4), "v") for i in range(12)], "wb_id string, sheet string, seq long, cell string, value string")
    cells = spark.createDataFrame([("w", "S", r, c, "v" if c == 1 else None, "s", "thin" if r < 4 else None, "0") for r in range(1, 5) for c in (1, 2)], CELL)
    merges = spark.createDataFrame([("w", "S", 2, 1, 2, 2)], RECT)
    lab, prot = cells.filter("row = 1"), cells.filter("row = 3 AND col = 2")
    focus = spark.createDataFrame([("w", "S", 1, 1, 3, 1)], RECT)
    seen, cut = [], rp.cut_lineage
    monkeypatch.setattr(rp, "cut_lineage", lambda d: [seen.append(d._jdf.queryExecution().executedPlan().toString()), cut(d)][1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.seq: (r.target_cell, r.status) for r in rp.write_guard(req, cells, merges, lab, prot, None, focus, True).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    kind = {0: ("A1", rp.LABEL), 1: ("A2", rp.NOOP), 2: ("A3", rp.NOOP), 3: ("B4", rp.NO_LINE)}
    assert got == {i: kind[i % 4] for i in range(12)}
    # Requests go by sheet, by row and by anchor; one journey each for the focus, the blocks, and the three tables of positions.
    assert len(seen) == 1 and seen[0].count("Exchange hashpartitioning") == 8


def test_hits_of_hints_are_found_once(spark, monkeypatch):
    pairs = [("w", "S", 1, 1, "Order Qty", "b2", False), ("w", "S", 1, 2, "zz", "c3", True), ("w", "S", 1, 3, "nothing", "d9", False), ("w", "S", 1, 4, "7", "b5", False)]
    p = spark.createDataFrame(pairs, "wb_id string, sheet string, region_id int, hint_id int, key string, value_cell string, is_invalid boolean")
    targets = [("w", "S", 1, 1, "order qty", 9, 9, 9, 9, ["label_area", "other"]), ("w", "S", 1, 2, "", 3, 3, 5, 3, ["high_risk_pattern"])]
    t = spark.createDataFrame(targets, "wb_id string, sheet string, region_id int, target_ord int, key string, r0 int, c0 int, r1 int, c1 int, flags array<string>")
    cells = spark.createDataFrame([("w", "S", 2, 2, "5", "n", None, "0")], CELL)
    calls, find = [], rp._soft_hits
    monkeypatch.setattr(rp, "_soft_hits", lambda *a: [calls.append(1), find(*a)][1])
    none = spark.createDataFrame([], RECT)
    got = {r.hint_id: (r.risk_flags, r.rank, r.hint_source) for r in rp.rank_region_hints(p, t, cells, none).collect()}
    assert got == {2: (["high_risk_pattern"], 1, "reflect_invalid_slot"), 1: (["label_area", "other"], 2, "reflect_slot_kv")}
    assert len(calls) == 1


def test_candidates_join_edits_and_values_by_cell(spark, monkeypatch):
    """Written tables in between keep labels from travelling once for each use; texts that only look like a cell do not match."""
    from formloom.operators import audit as au

    cells = [("w", "S", 1, 1, "Quantity:", "s", None, "0"), ("w", "S", 1, 2, "5", "n", "thin", "0"), ("w", "S", 2, 1, "Ship Date", "s", None, "0"),
             ("w", "S", 3, 1, "Status", "s", None, "0"), ("w", "S", 3, 2, "x", "d", "thin", "0")]
    pairs = [("w", "S", 1, "quantity", "b1"), ("w", "S", 2, "Ship Date", "B2:C2")]
    edits = [("w", "S", "B1", "4", "5", 1), ("w", "S", "b2:c2", None, "q", 2), ("w", "S", "A3", "Stat", "Status", 3), ("w", "S", "$A$2", "no", "hit", 4)]
    e = spark.createDataFrame(edits, "wb_id string, sheet string, target_cell string, old_value string, new_value string, seq long").withColumn("is_actual_edit", F.lit(True))
    p = spark.createDataFrame(pairs, "wb_id string, sheet string, pair_idx int, key string, value_cell string")
    box = spark.createDataFrame([("w", "S", 1, 1, 9, 9)], RECT)
    none = spark.createDataFrame([], RECT)
    calls, cut = [], au.cut_lineage
    monkeypatch.setattr(au, "cut_lineage", lambda d: [calls.append(1), cut(d)][1])
    d = au.audit_candidates(spark.createDataFrame(cells, CELL), none, p, e, box)
    got = {r.label_cell: (r.value_cell, r.current_value, r.is_actual_edit, r.edited_label_cell, r.new_value, r.r1, r.c1) for r in d.collect()}
    assert got == {
        "A1": ("B1", "5", True, False, "5", 1, 2), "A2": ("B2:C2", None, True, False, "q", 2, 1), "A3": ("B3", "x", True, True, "Status", 3, 2),
    }
    assert len(calls) == 4
