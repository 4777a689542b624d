"""Merged blocks of any size, nearest cells, and structured files read for real."""

import json
import random
import time

from pyspark.sql import functions as F

from formloom.operators import grid as g
from formloom.sources import readers as rd

CELL = "wb_id string, sheet string, row int, col int, value string, value_type string, border_top string, border_bottom string, border_left string, border_right string, fill_type string, fill_rgb string"
RECT = "wb_id string, sheet string, r0 int, c0 int, r1 int, c1 int"


def cell(row, col, value=None, bottom=None, box=False, rgb=None, wb="w"):
    side = "thin" if box else None
    return (wb, "S", row, col, value, "s" if value else None, side, "thin" if box else bottom, side, side, "solid" if rgb else None, rgb)


def test_a_block_over_a_whole_sheet_is_not_unfolded(spark):
    cells = spark.createDataFrame([cell(5, 5, "x"), cell(900_000, 16_000, "y", bottom="thin"), cell(7, 7, "z", box=True), cell(1, 1, "own", wb="v")], CELL)
    merges = spark.createDataFrame([("w", "S", 1, 1, 1_048_576, 16_384)], RECT)
    began = time.time()
    at = {(r["wb_id"], r["row"], r["col"]): (r["a_row"], r["a_col"], r["is_merged"]) for r in g.attach_anchor(cells.select(*g.POS), merges).collect()}
    assert at == {("w", 5, 5): (1, 1, True), ("w", 900_000, 16_000): (1, 1, True), ("w", 7, 7): (1, 1, True), ("v", 1, 1): (1, 1, False)}
    assert [tuple(r) for r in g.input_candidates(cells, merges).collect()] == [("w", "S", 1, 1)]
    box = spark.createDataFrame([("w", "S", 3, 3, 9, 9)], RECT)
    assert [tuple(r) for r in g.input_candidates(cells, merges, box).collect()] == [("w", "S", 1, 1)]
    kinds = sorted((r["row"], r["col"], r["kind"]) for r in g.typed_candidates(cells, merges).collect())
    assert kinds == [(1, 1, "merged_anchor"), (7, 7, "boxed"), (900_000, 16_000, "bottom_line")]
    assert g.static_template_cells(cells, merges).count() == 4
    assert g.interesting_cells(cells, merges, box).count() == 49
    points = spark.createDataFrame([("w", "S", 500, 500, 1), ("v", "S", 3, 4, 2), ("v", "S", 30, 40, 3)], "wb_id string, sheet string, row int, col int, ord int")
    snapped = g.snap_to_interesting(points, g.interesting_points(cells), 6, merges)
    assert sorted((r["ord"], r["s_row"], r["s_col"]) for r in snapped.collect()) == [(1, 500, 500), (2, 1, 1), (3, 30, 40)]
    assert time.time() - began < 60


def test_nearest_cells_follow_the_walk(spark):
    r = random.Random(6)
    cells = {(r.randint(1, 60), r.randint(1, 60)) for _ in range(60)}
    blocks = [(10, 10, 14, 40), (50, 1, 58, 3), (30, 55, 30, 60)]
    points = [(r.randint(1, 60), r.randint(1, 60)) for _ in range(200)]
    keys = lambda rows: [("w", "S", *x) for x in rows]
    for radius in (1, 2, 6):
        walk = g.ring_offsets(radius)
        frame = spark.createDataFrame([(*p, i) for p, i in zip(keys(points), range(200))], "wb_id string, sheet string, row int, col int, ord int")
        found = g.snap_to_interesting(
            frame, spark.createDataFrame(keys(cells), "wb_id string, sheet string, row int, col int"), radius, spark.createDataFrame(keys(blocks), RECT)
        )
        live = lambda y, x: (y, x) in cells or any(a <= y <= c and b <= x <= d for a, b, c, d in blocks)
        for x in found.collect():
            y0, x0 = points[x["ord"]]
            want = next(((y0 + dy, x0 + dx) for dy, dx, _ in walk if live(y0 + dy, x0 + dx)), (y0, x0))
            assert (x["s_row"], x["s_col"]) == want


def test_structured_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0' encoding='utf-8'?>\n<a k='1'><b>é</b><b/></a>", encoding="utf-8")
    (tmp_path / "b.json").write_text('{"x": [1, 2]}')
    (tmp_path / "c.xml").write_text("<a><b></a>")
    (tmp_path / "d.json").write_text("{oops")
    (tmp_path / "e.yaml").write_text("k: v")
    got = {r["doc_id"].rsplit("/", 1)[1]: (json.loads(r["tree"]), r["notes"]) for r in rd.read_structured(spark, str(tmp_path)).select("doc_id", F.to_json("tree").alias("tree"), "notes").collect()}
    assert got == {
        "a.xml": ({"@attributes": {"k": "1"}, "b": ["é", ""]}, []), "b.json": ({"x": [1, 2]}, []), "c.xml": ({"raw_text": "<a><b></a>"}, ["parse_failed"]),
        "d.json": ({"raw_text": "{oops"}, ["parse_failed"]), "e.yaml": ({"raw_text": "k: v"}, []),
    }
