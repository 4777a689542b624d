"""Steps whose shuffled data must grow no faster than their input, with the results of brute force."""

from pyspark.sql import functions as F

from formloom.operators import match as m
from formloom.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_form_lines_are_folded_once(spark):
    t = Tables(spark, SF)
    for d in (t.cells_t, t.cells_f, t.merges, t.pairs, t.dims):
        assert not any("lineitem" in f for f in d.inputFiles())
    first = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o")).agg(F.min("l_partkey").alias("low"))
    heads = t.lines().where("head").select("o", "low")
    assert heads.count() == first.count() and heads.exceptAll(first).isEmpty()


def test_ranked_candidates_far_and_near(spark):
    cells = [("w", "S", r, c, ("boxed", "bottom_line", "merged_anchor")[(r + c) % 3]) for r in range(1, 160, 7) for c in range(1, 90, 5)]
    labs = [("w", "S", r, c) for r in (1, 17, 64, 65, 127, 300) for c in (1, 20, 31, 32, 64, 70)]
    cand = spark.createDataFrame(cells, "wb_id string, sheet string, row int, col int, kind string")
    lab = spark.createDataFrame(labs, "wb_id string, sheet string, row int, col int")
    got = m.rank_candidates(lab, cand, lab)
    plan = plan_of(got)
    assert "Window" not in plan  # pairs are neither sorted nor shuffled
    bonus = {"boxed": 0.12, "bottom_line": 0.08, "merged_anchor": 0.05}
    want = set()
    for _, _, lr, lc in labs:
        near = []
        for _, _, r, c, kind in cells:
            dr, dc = abs(r - lr), c - lc
            base = 2.2 / (1.0 + 0.35 * dr + dc) if dc >= 1 else 1.3 / (1.0 + 0.45 * abs(dc) + dr) if r > lr else 0.5 / (1.0 + dr + abs(dc))
            if (r, c) not in {x[2:] for x in labs} and base + bonus[kind] > 0.24:
                near.append((-(base + bonus[kind]), r, c, kind))
        want |= {(lr, lc, r, c, kind, round(-s, 9), k) for k, (s, r, c, kind) in enumerate(sorted(near), 1)}
    rows = [(x.l_row, x.l_col, x.row, x.col, x.kind, round(x.score, 9), x["rank"]) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {x[:4] + x[6:] for x in rows if x[6] <= 2} == {(x.l_row, x.l_col, x.row, x.col, x["rank"]) for x in m.rank_candidates(lab, cand, lab, 2).collect()}


def test_texts_in_cells_are_not_broadcast(spark):
    from formloom.operators import layout as lay
    from formloom.plans import queries_layout as q

    t = Tables(spark, SF)
    for d in (lay.match_text_to_cells(q.elements(t), q.cell_boxes(t)), lay.assign_text_to_cells(q.elements(t), q.cell_boxes(t))):
        assert "Broadcast" not in plan_of(d)
