"""Value cells by blocks: against probing cell by cell, and without a row for each probe."""

import random

from formloom.operators import match as m

POS = "wb_id string, sheet string, row int, col int"


def test_guess_value_cell_by_blocks(spark):
    rnd = random.Random(3)
    spots = {(rnd.randint(1, 40), rnd.randint(1, 24)) for _ in range(220)}
    labels, writable = {x for x in spots if rnd.random() < 0.6}, {x for x in spots if rnd.random() < 0.3}
    merges = [(15, 2, 18, 3), (1, 30, 2000, 9000), (38, 5, 400, 6), (5, 20, 5, 21), (20, 10, 33, 12)]
    writable |= {(1, 30), (5, 20)}
    labels |= {(20, 10), (900, 29), (17, 1), (33, 28)}
    want = {}
    for row, col in labels:
        seen = []
        for i, (dr, dc) in enumerate(m.PROBES):
            r, c = next(((b[0], b[1]) for b in merges if b[0] <= row + dr <= b[2] and b[1] <= col + dc <= b[3]), (row + dr, col + dc))
            if (r, c) != (row, col):
                seen += [(1, i, r, c)] if (r, c) in writable else [(2, i, r, c)] if (r, c) not in labels else []
        if seen:
            want[row, col] = min(seen)[2:]
    at = lambda cells: spark.createDataFrame([("w", "S1", r, c) for r, c in cells], POS)
    rects = spark.createDataFrame([("w", "S1", *b) for b in merges], "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int")
    got = m.guess_value_cell(at(labels), rects, at(writable), at(labels))
    assert {(x.row, x.col): (x.v_row, x.v_col) for x in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Generate" in x and "dr" in x]  # probes are no rows
