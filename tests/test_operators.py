"""Operators against brute force and hand-derived tables."""

import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from formloom.functions import lines as ln
from formloom.functions import ranges as rg
from formloom.functions import replies as rp
from formloom.functions import text as tx
from formloom.operators import audit as a
from formloom.operators import grid as g
from formloom.operators import layout as lay
from formloom.operators import tables as tb
from formloom.operators import match as m
from formloom.operators import repair as rep
from formloom.operators import similar as sim
from formloom.operators import spatial as sp
from formloom.operators.select import medians
from formloom.sources import readers as rd

K = ["wb_id", "sheet"]
RECT = "wb_id string, sheet string, id int, r0 int, c0 int, r1 int, c1 int"


def rects(spark, n, seed, spread=40, big=False, wb=lambda i: "w"):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        h = rnd.choice([1, 2, 70, 1500, 40000]) if big else rnd.randint(1, 3)
        w = rnd.choice([1, 20, 300, 5000]) if big else rnd.randint(1, 3)
        r, c = rnd.randint(1, 60000 if big else spread), rnd.randint(1, 6000 if big else spread)
        out.append((wb(i), "S", i, r, c, r + h - 1, c + w - 1))
    return out


def hit(x, y, grow=0):
    return x[3] - grow <= y[5] and y[3] <= x[5] + grow and x[4] - grow <= y[6] and y[4] <= x[6] + grow


def test_a1_round_trip(spark):
    n = spark.range(1, 16385, 37).select(F.col("id").cast("int").alias("c"))
    d = n.select("c", rg.parse_a1(rg.a1_cell(F.lit(7), F.col("c")))["c0"].alias("back"))
    assert d.filter("c <> back").count() == 0


@pytest.mark.parametrize("text,want", [(" C3:A1 ", "A1:C3"), ("b2", "B2:B2"), ("$D$4", None), ("", None), ("1A", None), ("XFD1", "XFD1:XFD1"), ("XFE1", None), ("A0", None)])
def test_normalize_a1(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string").select(rg.normalize_a1(F.col("t")).alias("x"), rg.normalize_a1(F.lit("$D$4"), True).alias("y"))
    assert d.first().x == want and d.first().y == "D4:D4"


@pytest.mark.parametrize("grow", [0, 1])
def test_overlap_join_over_all_tile_levels(spark, grow):
    x, y = rects(spark, 80, 1, big=True), rects(spark, 80, 2, big=True)
    a_df = spark.createDataFrame(x, RECT)
    b_df = spark.createDataFrame(y, RECT).withColumnRenamed("id", "oid")
    got = sorted((r.id, r.oid) for r in sp.overlap_join(a_df, b_df, K, grow).collect())
    assert got == sorted((p[2], q[2]) for p in x for q in y if hit(p, q, grow))


def brute_merge(boxes):
    boxes = {b[3:] for b in boxes}
    while True:
        for p in boxes:
            q = next((q for q in boxes if q != p and p[0] <= q[2] + 1 and q[0] <= p[2] + 1 and p[1] <= q[3] + 1 and q[1] <= p[3] + 1), None)
            if q:
                boxes = (boxes - {p, q}) | {(min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))}
                break
        else:
            return boxes


@pytest.mark.parametrize("seed,n,spread", [(1, 30, 30), (2, 60, 60), (3, 12, 8)])
def test_merge_touching_equals_fold(spark, seed, n, spread):
    x = rects(spark, n, seed, spread)
    got = {(r.r0, r.c0, r.r1, r.c1) for r in a.merge_touching_regions(spark.createDataFrame(x, RECT)).collect()}
    assert got == brute_merge(x)


def test_merge_long_chain_in_one_hot_sheet(spark):
    chain = [("w", "S", i, i * 2 + 1, i * 2 + 1, i * 2 + 2, i * 2 + 2) for i in range(300)]
    got = a.merge_touching_regions(spark.createDataFrame(chain, RECT)).collect()
    assert [(r.r0, r.c0, r.r1, r.c1) for r in got] == [(1, 1, 600, 600)]


def words(seed, n):
    rnd = random.Random(seed)
    base = ["order", "qty", "date", "ship", "flag", "return", "name", "no", "id", "status", "line", "total", "a", "x1"]
    out = set()
    for _ in range(n):
        w = " ".join(rnd.sample(base, rnd.randint(1, 3)))
        if rnd.random() < 0.5:
            i = rnd.randrange(len(w))
            w = w[:i] + rnd.choice("abz") + w[i + 1:]
        out.add(" ".join(w.split()))
    return sorted(out)


def key_score(x, y):
    if x == y:
        return 1.0
    sx, sy = set(x.split()), set(y.split())
    inside = 1.0 if (x in y or y in x) and min(len(x), len(y)) >= 4 else 0.0
    return max(SequenceMatcher(None, x, y).ratio(), len(sx & sy) / len(sx | sy), inside)


@pytest.mark.parametrize("t", [0.74, 0.6])
def test_similar_pairs_miss_nothing(spark, t):
    xs, ys = words(1, 60), words(2, 60)
    df = lambda v: spark.createDataFrame([("k", w) for w in v], "k string, norm string")
    got = {(r.a, r.b) for r in sim.similar_pairs(df(xs), df(ys), ["k"], t, full=True).collect()}
    assert got == {(x, y) for x in xs for y in ys if key_score(x, y) >= t}


def test_similar_pairs_of_long_texts(spark):
    """Repeats beyond 200 characters count as often as they occur. Right texts stay below the matcher's own limit of 200."""
    import random

    r = random.Random(6)
    xs = ["w" + "a" * 205, "w" + "a" * 198] + ["".join(r.choices("abcde ", k=r.randint(150, 320))).strip() for _ in range(5)]
    xs = [" ".join(x.split()) for x in xs]
    ys = ["q" + "a" * 150, "q" + "a" * 199]
    for x in xs[2:]:
        y = list(x[:190])
        for _ in range(25):
            y[r.randrange(len(y))] = r.choice("abcde")
        ys.append(" ".join("".join(y).split())[:199])
    df = lambda v: spark.createDataFrame([("k", w) for w in v], "k string, norm string")
    got = {(p.a, p.b) for p in sim.similar_pairs(df(xs), df(ys), ["k"], 0.74, full=True).collect()}
    assert got == {(x, y) for x in xs for y in ys if key_score(x, y) >= 0.74}
    assert (xs[0], ys[0]) in got


def test_soft_match_misses_nothing(spark):
    xs, ys = words(3, 50), words(4, 50) + ["e", "or"]
    def soft(x, y):
        sx, sy = set(x.split()), set(y.split())
        return x in y or y in x or len(sx & sy) / min(len(sx), len(sy)) >= 0.75
    df = lambda v: spark.createDataFrame([("k", w) for w in v], "k string, norm string")
    got = {(r.a, r.b) for r in sim.soft_match_pairs(df(xs), df(ys), ["k"]).collect()}
    assert got == {(x, y) for x in xs for y in ys if soft(x, y)}


def test_propagation_needs_order_and_stops_at_hard_labels(spark):
    row = lambda i, ok, hard: ("w", "S", i, 1, i, 1, i + 1, 1, ok, hard)
    schema = "wb_id string, sheet string, row int, col int, r0 int, c0 int, r1 int, c1 int, base_ok boolean, hard boolean"
    free = spark.createDataFrame([row(1, True, False), row(2, False, False), row(3, False, False), row(9, False, False)], schema)
    assert sorted(r.row for r in a.propagate_forward(free).collect()) == [2, 3]
    stop = spark.createDataFrame([row(1, True, False), row(2, False, True), row(3, False, False)], schema)
    assert a.propagate_forward(stop).count() == 0
    back = spark.createDataFrame([row(1, False, False), row(2, True, False)], schema)
    assert a.propagate_forward(back).count() == 0


def test_edit_state_ignores_later_noop(spark):
    schema = "wb_id string, sheet string, target_cell string, old_value string, new_value string, is_actual_edit boolean, seq long"
    d = spark.createDataFrame([("w", "S", "b2", None, "1", True, 1), ("w", "S", "B2", "1", "1", False, 2)], schema)
    got = a.latest_effective_edits(d).collect()
    assert [(r.target_cell, r.new_value, r.seq) for r in got] == [("B2", "1", 1)]


def test_chunked_lag_over_chunk_borders(spark):
    d = spark.range(0, 50).select(F.lit("g").alias("g"), (F.col("id") * 3).alias("seq"), F.col("id").cast("string").alias("v"))
    got = {r.seq: r.p.v if r.p else None for r in rep.chunked_lag(d, ["g"], "seq", "v", "p", width=8).collect()}
    assert got == {i * 3: (str(i - 1) if i else None) for i in range(50)}


def test_clusters_do_not_depend_on_chunk_width(spark):
    rnd = random.Random(5)
    d = spark.createDataFrame([(1, round(rnd.uniform(-50, 900), 2)) for _ in range(300)], "k int, v double")
    rows = lambda w: sorted((r.edge_idx, round(r.pos, 6)) for r in lay.cluster_positions(d, ["k"], 3.0, width=w).collect())
    assert rows(7.0) == rows(1e6)


def test_spans_go_around_cells_from_above(spark):
    cells = [(1, 0, "a", 2, 1), (1, 1, "b", 1, 2), (2, 0, "c", 1, 1), (2, 1, "d", 1, 1), (3, 0, "e", 1, 3)]
    d = spark.createDataFrame([("t", *c) for c in cells], "t string, row int, cell_idx int, text string, row_span int, col_span int")
    got = sorted(tb.place_spans(d, ["t"]).collect(), key=lambda r: (r.row, r.cell_idx))
    assert [(r.text, r.row, r.col) for r in got] == [("a", 1, 1), ("b", 1, 2), ("c", 2, 2), ("d", 2, 3), ("e", 3, 1)]


def _read(items):
    """Lines by the running mean of their centres, blanks at gaps."""
    items = sorted(items, key=lambda i: (i[2], i[1], i[0]))
    tol = max(8.0, statistics.median(max(1.0, i[4] - i[2]) for i in items) * 0.6)
    lines = []
    for i in items:
        cy = (i[2] + i[4]) / 2
        if lines and abs(cy - sum((x[2] + x[4]) / 2 for x in lines[-1]) / len(lines[-1])) <= tol:
            lines[-1].append(i)
        else:
            lines.append([i])
    out = []
    for line in lines:
        line = sorted(line, key=lambda i: (i[1], i[2], i[0]))
        text = line[0][5] or ""
        for a, b in zip(line, line[1:]):
            text += (" " if b[1] - a[3] > max(4.0, min(a[4] - a[2], b[4] - b[2]) * 0.35) else "") + (b[5] or "")
        out.append(text.strip())
    return "\n".join(x for x in out if x)


def test_join_texts_by_layout(spark):
    box = lambda k, i, x0, y0, x1, y1, s: (k, i, float(x0), float(y0), float(x1), float(y1), s)
    rows = [box("a", 1, 60, 2, 90, 12, "world"), box("a", 2, 0, 0, 40, 10, "hello"), box("a", 3, 0, 40, 30, 50, "next"), box("a", 4, 31, 41, 60, 51, "line"), box("b", 1, 0, 0, 5, 5, " "), box("c", 1, 0, 0, 5, 5, None)]
    r = random.Random(9)
    for k in ("d", "e", None):
        for i in range(120):
            x, y, h = r.randint(0, 300), r.randint(0, 900 if k == "d" else 120), r.choice([5, 9, 10, 11, 40])
            rows.append(box(k, i, x, y, x + r.randint(1, 60), y + h, r.choice(["w", " v", "", None, "long text"])))
    d = spark.createDataFrame([(k, i, (x0, y0, x1, y1), s) for k, i, x0, y0, x1, y1, s in rows], f"k string, item_id int, bbox {lay.BOX}, text string")
    groups = {}
    for k, i, *rest in rows:
        groups.setdefault(k, []).append((i, *rest))
    for width in (4096.0, 64.0):
        got = {x["k"]: x["text"] for x in lay.join_texts(d, ["k"], width).collect()}
        assert got == {k: _read(v) for k, v in groups.items()}
    assert got["a"] == "hello world\nnextline"


def test_medians_of_large_groups(spark):
    r = random.Random(2)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 50, "hot": [r.choice([0.0, 1.0, 1.5, 7.0, r.random(), r.gauss(0, 1e6)]) for _ in range(3000)], None: [r.random() for _ in range(101)]}
    d = spark.createDataFrame([(k, v) for k, x in groups.items() for v in [*x, None]], "k string, v double")
    for few in (1, 40, 20_000):
        got = {x["k"]: x["median"] for x in medians(d, ["k"], few).collect()}
        assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_text_structures(spark):
    text = "intro\n# Head\nKey: v\n\nItem Title:\n- a\n|x|y|\n|-|-|\n|1||\nlone | pipe? no\n\nz | single"
    r = spark.createDataFrame([(text,)], "t string").select(
        ln.sections(F.col("t")).alias("s"), ln.flat_kv(F.col("t")).alias("kv"), ln.markdown_tables(F.col("t")).alias("mt"), ln.text_records(F.col("t")).alias("r"),
    ).first()
    assert [s.title for s in r.s] == ["root", "# Head", "Item Title"]
    assert [(p.key, p.line_index) for p in r.kv] == [("Key", 3), ("Item Title", 5)]
    assert r.mt == [[["x", "y"], ["1"], ["lone", "pipe? no"]]]
    assert r.r[0] == ["intro", "# Head", "Key: v"]


@pytest.mark.parametrize("raw,want", [('```json\n{"a": 1}\n```', 1), ('x {"a": 2} y', 2), ('{"a": 3,}', 3), ("[1]", None), ("{“a”: 4}", 4)])
def test_reply_repair(spark, raw, want):
    d = spark.createDataFrame([(raw,)], "r string")
    assert d.select(F.try_variant_get(rp.parse_pairs_reply(F.col("r")), "$.a", "int").alias("a")).first().a == want


def test_write_guard_statuses(spark):
    cells = spark.createDataFrame([("w", "S", 1, 1, "Name", "s", None), ("w", "S", 1, 2, None, None, "thin"), ("w", "S", 2, 2, "keep", "s", "thin")],
                                  "wb_id string, sheet string, row int, col int, value string, value_type string, border_bottom string")
    merges = spark.createDataFrame([], "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int")
    req = spark.createDataFrame([("w", "S", i, c, v) for i, (c, v) in enumerate([("B1", "x"), ("B1", "x"), ("A1", "x"), ("B2", "keep"), ("B2", "new"), ("??", "x"), ("B1", "y")])],
                                "wb_id string, sheet string, seq long, cell string, value string")
    out = rep.write_guard(req, cells, merges, label_cells=cells.filter("row = 1 and col = 1"), protected=cells.filter("row = 2"))
    got = {r.seq: (r.status, r.old_value) for r in out.collect()}
    assert got == {0: ("ok", None), 1: ("noop", "x"), 2: ("blocked_label_guard", "Name"), 3: ("noop", "keep"), 4: ("blocked_protected_cell", "keep"), 5: ("invalid_target", None), 6: ("ok", "x")}


def test_restore_leaves_no_damage_and_is_idempotent(spark):
    schema = "wb_id string, sheet string, row int, col int, value string, value_type string, border_top string, border_bottom string, border_left string, border_right string, fill_type string, fill_rgb string, style_key string"
    cell = lambda r, c, v, sk="0": ("w", "S", r, c, v, "s", None, None, None, None, None, None, sk)
    tpl = spark.createDataFrame([cell(1, 1, "Name"), cell(2, 1, "Date")], schema)
    now = spark.createDataFrame([cell(1, 1, "Name Bob"), cell(2, 1, "Date", "9"), cell(3, 1, "stray")], schema)
    merges = spark.createDataFrame([], "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int")
    region = spark.createDataFrame([("w", "S", 1, 1, 1, 5, 5)], "wb_id string, sheet string, region_id int, r0 int, c0 int, r1 int, c1 int")
    assert rep.template_damage(region, tpl, merges, now, merges).count() == 2
    fixed = rep.apply_restore(now, rep.restore_region(region, tpl, merges, now, merges))
    assert rep.template_damage(region, tpl, merges, fixed, merges).count() == 0
    assert rep.restore_region(region, tpl, merges, fixed, merges).filter("changed").count() == 0


def test_every_overwritten_label_reaches_the_check(spark):
    schema = "wb_id string, sheet string, row int, col int, value string, value_type string, border_top string, border_bottom string, border_left string, border_right string, fill_type string, fill_rgb string, style_key string"
    cell = lambda r, c, v: ("w", "S", r, c, v, "s", None, None, None, None, None, None, "0")
    tpl = spark.createDataFrame([cell(r, 1, f"Name {r}:") for r in range(1, 16)], schema)
    now = spark.createDataFrame([cell(r, 1, f"Name {r}: Bob") for r in range(1, 16)], schema)
    merges = spark.createDataFrame([], "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int")
    over = rep.label_overwrites(tpl, merges, now)
    assert sorted(r.row for r in over.collect()) == list(range(1, 16))
    none = F.array().cast("array<string>")
    reply = spark.createDataFrame([("w", "S", False, 0.5)], "wb_id string, sheet string, need_fix boolean, confidence double").select(
        "*", none.alias("bad_ranges"), F.array(F.lit("A15:A15"), F.lit("C1:C1")).alias("correct_ranges"), none.alias("bad_raw"))
    got = rep.reconcile_check(reply, over).first()
    assert got.need_fix and got.bad_ranges == [f"A{r}:A{r}" for r in range(1, 16)] and got.correct_ranges == ["C1:C1"]


def test_every_target_gets_its_context_and_whole_texts(spark):
    pos = "wb_id string, sheet string, row int, col int"
    tg = spark.createDataFrame([("w", "S", i, f"A{10 * i}", "", 1) for i in range(1, 8)], "wb_id string, sheet string, target_idx int, target string, reason string, radius int")
    cells = spark.createDataFrame([("w", "S", 10 * i, 1, "x" * 200 + str(i), "s") for i in range(1, 8)] + [("w", "S", 70 + d, c, "y", "s") for d in (-1, 1) for c in range(1, 4)], pos + ", value string, value_type string")
    rect = "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int"
    box, merges = spark.createDataFrame([("w", "S", 1, 1, 80, 30)], rect), spark.createDataFrame([], rect)
    cand = spark.createDataFrame([], pos + ", kind string")
    items, inside = m.background_context(tg, cells, merges, cand, g.labels(cells, any_value=True), box)
    assert sorted(r.target_idx for r in items.collect()) == list(range(1, 8))
    rows = inside.collect()
    assert sorted(r.text for r in rows if r.text[0] == "x") == ["x" * 200 + str(i) for i in range(1, 8)]
    assert sum(r.target_idx == 7 for r in rows) == 7
    items, inside = m.background_context(tg, cells, merges, cand, g.labels(cells, any_value=True), box, n_items=2, n_cells=1, width=5)
    assert items.count() == 2 and {(r.target_idx, r.text) for r in inside.collect()} == {(1, "xxxxx"), (2, "xxxxx")}


def test_far_candidates_reach_fused_hints(spark):
    pos = "wb_id string, sheet string, row int, col int"
    lab = spark.createDataFrame([("w", "S", 1, 1, "Total")], pos + ", text string")
    cand = spark.createDataFrame([("w", "S", 5000, 2, "boxed"), ("w", "S", 1, 900, "boxed"), ("w", "S", 3, 1, "merged_anchor"), ("w", "S", 4, 1, "merged_anchor")], pos + ", kind string")
    box = spark.createDataFrame([("w", "S", 1, 1, 6000, 1000)], "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int")
    p = spark.createDataFrame([("w", "S", 1, "total", "B1")], "wb_id string, sheet string, pair_id int, key_text string, value_cell string")
    got = m.fused_hints(p, lab, cand, box).orderBy("rank").collect()
    assert [(r.row, r.col) for r in got] == [(1, 900), (5000, 2), (3, 1)]


def test_edit_log_reader(spark, tmp_path):
    (tmp_path / "wb7.jsonl").write_text('{"sheet": "S", "cell": "a1", "old_value": 1, "new_value": "1"}\n\nbad\n{"sheet": "S", "target_cell": "b2"}\n')
    got = rd.read_edit_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.wb_id, r.target_cell, r.is_actual_edit) for r in got] == [("wb7", "A1", True), ("wb7", "B2", False)]


def test_forms_and_display_width(spark, tmp_path):
    (tmp_path / "f1.json").write_bytes(b'\xef\xbb\xbf{"excel": "a.xlsx", "sheet": "S", "pairs": [{"label": "L", "value_cell": "B2", "value": null}]}')
    r = rd.read_forms(spark, str(tmp_path)).first()
    assert (r.case_id, r.key, r.value) == ("f1", "L", None)
    assert spark.range(1).select(tx.display_width(F.lit("ab名\n!")).alias("w")).first().w == 5


def test_labels_need_text_values(spark):
    d = spark.createDataFrame([("w", "S", 1, 1, "7", "n"), ("w", "S", 1, 2, " Name ", "s"), ("w", "S", 1, 3, " ", "s")], "wb_id string, sheet string, row int, col int, value string, value_type string")
    assert [r.text for r in g.labels(d).collect()] == ["Name"]
    assert g.labels(d, any_value=True).count() == 2


def test_trees(spark):
    from formloom.functions import trees as tr

    raw = ['{"b": 0, "a": [false, "x  y", {"evidence": "e", "k": null}], "c": {}}', "[1, [2, [3]]]", '"text"', "oops", None, "7", '{"z": "[not a list]"}']
    d = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")
    c = F.col("raw")
    got = d.select("i", tr.tree_normalize(c).alias("t"), tr.flatten_text(c).alias("f"), tr.tree_depth(c).alias("d"), tr.record_count(c).alias("n"), tr.tree_normalize(c, max_depth=2, max_keys=1, max_items=1).alias("s")).orderBy("i").collect()
    assert got[0]["t"] == '{"b": "0", "a": ["False", "x y", {"evidence": "e", "k": null}], "c": {}}'
    assert (got[0]["f"], got[0]["d"], got[0]["n"]) == ("x  y", 3, 0)
    assert got[0]["s"] == '{"b": "0", "__truncated__": true}'
    assert (got[1]["t"], got[1]["f"], got[1]["d"], got[1]["n"], got[1]["s"]) == ('["1", ["2", ["3"]]]', "1\n2\n3", 3, 2, '["1"]')
    assert (got[2]["t"], got[2]["f"], got[2]["d"]) == ('"text"', "text", 0)
    assert all(got[k][x] is None for k in (3, 4) for x in "tfdn")
    assert (got[5]["t"], got[5]["d"]) == ('"7"', 0)
    assert (got[6]["t"], got[6]["d"]) == ('{"z": "[not a list]"}', 1)


def test_delimited_text_with_quoted_breaks(spark):
    from formloom.sources import readers as rd

    texts = [(1, "x.csv", 'a,"b\nc ""q""",\r\n\n1,2\n'), (2, "x.tsv", 'p\t"q\tr"\ns "t" u\tv'), (3, "x.csv", '"open,1\n2')]
    d = spark.createDataFrame(texts, "doc_id int, path string, text string")
    got = {(r.doc_id, r.row): list(r.cells) for r in rd.parse_delimited(d).collect()}
    assert got == {
        (1, 1): ["a", 'b\nc "q"', ""], (1, 2): [""], (1, 3): ["1", "2"], (2, 1): ["p", "q\tr"], (2, 2): ['s "t" u', "v"], (3, 1): ['"open', "1"], (3, 2): ["2"],
    }


def test_text_decoding(spark):
    from formloom.sources import readers as rd

    rows = [(bytearray("表单 value".encode("gb18030")),), (bytearray("表单".encode()),), (bytearray("café 12".encode("latin-1")),), (bytearray(b"\xef\xbb\xbfx"),)]
    got = spark.createDataFrame(rows, "content binary").select(F.inline(F.array(rd.decode_text(F.col("content"))))).collect()
    assert [(r.text, r.latin1) for r in got] == [("表单 value", False), ("表单", False), ("café 12", True), ("x", False)]



def test_fine_items_spread_over_one_spot(spark):
    """As many fields as a sheet may have rows over one spot: pairs of them would be billions."""
    n = 100_000
    d = spark.range(n).select(
        F.lit("w").alias("wb_id"), F.lit("S").alias("sheet"), (F.col("id") + 1).cast("int").alias("row"), F.lit(1).alias("col"), F.lit(1).alias("r0"), F.lit(1).alias("c0"),
        (F.lit(5) + F.col("id") % 7).cast("int").alias("r1"), F.lit(3).alias("c1"), (F.col("id") == 10).alias("base_ok"), (F.col("id") % 1000 == 999).alias("hard"),
    )
    got = a.propagate_forward(d).agg(F.count("*").alias("n"), F.min("row").alias("first")).first()
    assert (got.n, got.first) == (n - 11 - n // 1000, 12)


def test_fine_items_spread_forward_only(spark):
    r = random.Random(12)
    rows = []
    for k in range(140):
        r0, c0 = r.randint(1, 40), r.randint(1, 12)
        rows.append(("w", "S", k // 4 + 1, k % 4 + 1, r0, c0, r0 + r.randint(0, 3), c0 + r.randint(0, 2), r.random() < 0.06, r.random() < 0.1))
    d = spark.createDataFrame(rows, "wb_id string, sheet string, row int, col int, r0 int, c0 int, r1 int, c1 int, base_ok boolean, hard boolean")
    fine, want = [], set()
    for x in sorted(rows, key=lambda x: x[2:4]):
        hit = not x[9] and any(y[4] <= x[6] and x[4] <= y[6] and y[5] <= x[7] and x[5] <= y[7] for y in fine)
        if hit:
            want.add(x[2:4])
        if not x[9] and (hit or x[8]):
            fine.append(x)
    assert {(x.row, x.col) for x in a.propagate_forward(d).collect()} == want
