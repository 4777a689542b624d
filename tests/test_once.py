"""Work that is done once: texts scored, probes asked, targets read; and tables that are never sent whole."""

from pyspark.sql import functions as F

from formloom.functions import text as tx
from formloom.operators import audit as a
from formloom.operators import match as m
from formloom.operators import repair as r
from formloom.operators import similar as sm
from formloom.session import cut_lineage

KEYS = "wb_id string, sheet string"
CELL = KEYS + ", row int, col int"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def watch(monkeypatch, module, seen):
    cut = module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df, *x, **y: seen.append(df) or cut(df, *x, **y))


def test_write_guard_sends_no_table_whole(spark, monkeypatch):
    """Only merged blocks may be small enough to be sent; cells, labels, protected and approved cells and sheets are not."""
    d = lambda rows, cols: cut_lineage(spark.createDataFrame(rows, cols))  # noqa: E731  (tables of known size)
    req = d([("w", "S", 1, "A1", "x"), ("w", "S", 2, "a1", "y"), ("w", "S", 3, "B1", "z"), ("w", "S", 4, "C1", "z"), ("w", "S", 5, "oops", "z")], KEYS + ", seq long, cell string, value string")
    cells = d([("w", "S", 1, 1, "x", "thin"), ("w", "S", 1, 2, "l", "thin"), ("w", "S", 1, 3, "p", "thin")], CELL + ", value string, border_bottom string")
    seen = []
    watch(monkeypatch, r, seen)
    got = r.write_guard(
        req, cells, d([], KEYS + ", r0 int, c0 int, r1 int, c1 int"), label_cells=d([("w", "S", 1, 2)], CELL), protected=d([("w", "S", 1, 3)], CELL),
        approved=d([("w", "S", 1, k) for k in (1, 2, 3)], CELL), focus=d([("w", "S", 1, 1, 9, 9)], KEYS + ", r0 int, c0 int, r1 int, c1 int"), bottom_border=True,
    )
    want = {1: "noop", 2: "ok", 3: "blocked_label_guard", 4: "blocked_protected_cell", 5: "invalid_target"}
    assert {x.seq: x.status for x in got.collect()} == want
    assert seen[0]._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= 1


def test_equal_texts_are_scored_once(spark, monkeypatch):
    """The ratio lies above the aggregation that leaves each pair of texts once, for keys and for free text."""
    d = lambda text: spark.createDataFrame([(str(k), text) for k in range(9)], "wb_id string, norm string")
    for pairs in (sm.similar_pairs, sm.similar_texts):
        seen = []
        with monkeypatch.context() as mp:
            watch(mp, sm, seen)
            got = pairs(d("quantity"), d("quantitty"), ["wb_id"], 0.74)
            assert got.count() == 9
        scored = plan(seen[-1])
        assert 0 < scored.rindex("ArrowEvalPython") < scored.index("Aggregate")


def test_small_sheets_settle_in_one_pass(spark, monkeypatch):
    """No threshold is tried on sheets with few labels; larger ones still go through them."""
    words = ["ship date", "return flag", "line status", "part number"]
    d = lambda rows, cols: spark.createDataFrame(rows, cols)
    labels = [("w", "S", k + 1, 1, x) for k, x in enumerate(words)] + [("v", "S", k + 1, 1, f"{words[k % 4]} {k}") for k in range(2 * sm.FEW)]
    keys = d([("w", "S", "Ship  Date"), ("w", "S", "number"), ("v", "S", "line status 6"), ("v", "S", "qqq")], KEYS + ", key_text string")
    tried, texts = [], m.similar_texts
    monkeypatch.setattr(m, "similar_texts", lambda left, *x: tried.append({y.wb_id for y in left.collect()}) or texts(left, *x))
    got = {(x.wb_id, x.norm): (x.m.l.row, round(x.m.score, 4)) for x in m._best_text_label(keys, d(labels, CELL + ", text string"), True).collect()}
    assert got == {("w", "ship date"): (1, 1.0), ("w", "number"): (4, 0.7059), ("v", "line status 6"): (7, 1.0)}
    assert tried and all(x == {"v"} for x in tried)


def test_probes_are_worked_out_once(spark):
    d = lambda rows: spark.createDataFrame(rows, CELL)
    lab = d([("w", "S", 1, 1), ("w", "S", 5, 1), ("w", "S", 40, 40)])
    merges = spark.createDataFrame([("w", "S", 1, 2, 1, 3)], KEYS + ", r0 int, c0 int, r1 int, c1 int")
    got = m.guess_value_cell(lab, merges, d([("w", "S", 1, 2), ("w", "S", 6, 3)]), lab)
    assert {(x.row, x.col): (x.v_row, x.v_col) for x in got.collect()} == {(1, 1): (1, 2), (5, 1): (6, 3), (40, 40): (40, 41)}
    assert plan(got).count("array_min(") == 1


def test_targets_are_read_once(spark, monkeypatch):
    """Both kinds of a field come from one look at the assessed fields, and jobs expand a written table."""
    cols = CELL + ", key string, r0 int, c0 int, r1 int, c1 int, flags array<string>, is_correct boolean, is_safe boolean, is_high_risk boolean"
    field = lambda row, flags, ok, risk: ("w", "S", row, 1, f"k{row}", row, 1, row, 2, flags, ok, False, risk)
    fields = spark.createDataFrame([field(1, ["label_area"], False, True), field(2, ["x"], False, True), field(3, [], True, False), field(4, ["label_area"], False, False)], cols)
    bad = spark.createDataFrame([("w", "S", 9, 1, 9, 2)], KEYS + ", r0 int, c0 int, r1 int, c1 int")
    t = a.repair_targets(fields, bad)
    want = {("label_area_edit", 1), ("high_risk_edit", 1), ("high_risk_edit", 2), ("label_area_edit", 4), ("screenshot_bad_range", 9)}
    assert t.count() == 5 and {(x.kind, x.src.row) for x in t.collect()} == want
    assert plan(t).count("LogicalRDD") + plan(t).count("LocalRelation") == 2
    rects, expand = [], a.expand_target
    monkeypatch.setattr(a, "expand_target", lambda d, *x: rects.append(d) or expand(d, *x))
    used = spark.createDataFrame([("w", "S", 1, 1, 20, 6)], KEYS + ", r0 int, c0 int, r1 int, c1 int")
    assert a.patch_jobs(t, bad.limit(0), used).count() == 5
    assert hasattr(rects[0], "cut_path")


def test_labels_and_white_space(spark):
    """The cheaper forms of stripping, keys and probable labels against the patterns they stand for."""
    texts = [None, "", " ", "　Yes ", "n/a", "No\n", "a", "a1", "1a", "$1,200.50", "12%", "--", "_9_", "٠١", "٠x1", "x " + " " * 90 + "y", "ab" * 33, " Ship\t Date:\x85", "\x1fq r"]
    d = spark.createDataFrame([(x,) for x in texts], "s string")
    s = F.col("s")
    old = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(F.coalesce(old, F.lit("")), r"(?U)\s+", " ")
    label = F.length(t).between(1, 64) & (F.length(F.regexp_replace(t, "[^A-Za-z0-9]+", "")) > 1) & ~t.rlike(r"(?U)^[\d\W_]+$")
    label = label & ~t.rlike(r"(?U)^[$€¥]?\d[\d,./:-]*%?$") & ~F.lower(t).isin("yes", "no", "n/a", "na")
    key = F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    same = d.select((tx.strip(s).eqNullSafe(old)).alias("a"), (tx.normalize_key(s) == key).alias("b"), (tx.probable_key(s) == label).alias("c"), label.alias("label"))
    rows = same.collect()
    assert all(x.a and x.b and x.c for x in rows) and {x.label for x in rows} == {True, False}
