"""Layout of pages and slots: text boxes to cells, edge clusters, flow rows, spans, widths, slots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from formloom.functions import text as tx
from formloom.operators import grid as g
from formloom.operators.grid import KEYS
from formloom.operators.select import medians
from formloom.operators.spatial import overlap_join
from formloom.session import cut_lineage

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PAGE = ["doc_id", "page"]
TABLE = [*PAGE, "table_idx"]


def normalize_bbox(v: Column) -> Column:
    """Ordered box of four numbers, or of a polygon's points; else null. ``v`` is array<array<double>> (one inner array = 4 numbers)."""
    flat = F.when((F.size(v) == 1) & (F.size(v[0]) == 4), F.struct(
        F.least(v[0][0], v[0][2]).alias("x0"), F.least(v[0][1], v[0][3]).alias("y0"), F.greatest(v[0][0], v[0][2]).alias("x1"), F.greatest(v[0][1], v[0][3]).alias("y1")))
    xs, ys = F.transform(v, lambda p: F.get(p, F.lit(0))), F.transform(v, lambda p: F.get(p, F.lit(1)))
    poly = F.when((F.size(v) >= 2) & F.forall(v, lambda p: F.size(p) >= 2), F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))
    return F.coalesce(flat, poly)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the area of ``a`` (at least 1)."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h / F.greatest(F.lit(1.0), (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]))


def center_in(a: Column, b: Column) -> Column:
    return ((a["x0"] + a["x1"]) / 2).between(b["x0"], b["x1"]) & ((a["y0"] + a["y1"]) / 2).between(b["y0"], b["y1"])


def _px_rect(df: DataFrame) -> DataFrame:
    """Boxes as rectangles of whole rows and of strips sixteen pixels wide, so that a box falls into few tiles."""
    whole = lambda f, c, per: f(F.col("bbox." + c) / per).cast("int")
    return df.select("*", whole(F.floor, "y0", 1).alias("r0"), whole(F.floor, "x0", 16).alias("c0"), whole(F.ceil, "y1", 1).alias("r1"), whole(F.ceil, "x1", 16).alias("c1"))


def match_text_to_cells(items: DataFrame, cells: DataFrame) -> DataFrame:
    """(TABLE, cell_idx, item_id) where a text box lies in a cell: its centre, or at least half of it. A box may join several cells."""
    a = _px_rect(items.select(*TABLE, "item_id", "bbox"))
    b = _px_rect(cells.select(*TABLE, "cell_idx", "bbox")).withColumnRenamed("bbox", "cell_box")
    j = overlap_join(a, b, TABLE)
    box, cell = F.col("bbox"), F.col("cell_box")
    return j.filter(center_in(box, cell) | (overlap_ratio(box, cell) >= 0.5)).select(*TABLE, "cell_idx", "item_id")


def _line_numbers():
    """Numbers the lines of rows in reading order, a group after the other: a box opens a line when its centre is further than the
    tolerance from the running mean of the line. Columns: group, item, centre, tolerance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, n, line = object(), 0.0, 0, 0
        for batch in batches:
            keys, centres, tolerances = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            lines = []
            for key, cy, tol in zip(keys, centres, tolerances):
                if key != group:
                    group, total, n, line = key, cy, 1, 1
                elif abs(cy - total / n) <= tol:
                    total, n = total + cy, n + 1
                else:
                    total, n, line = cy, 1, line + 1
                lines.append(line)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.int64())], ["_p", "_i", "line"])

    return run


def join_texts(items: DataFrame, by: list[str], width: float = 4096.0) -> DataFrame:
    """``by, text``: the reading-order text of each group of boxes. items: by, item_id (unique in its group), bbox, text.

    Boxes are taken by top and left edge. A box starts a line when its centre is further than the tolerance (0.6 of the median
    height, 8 at least) from the running mean of the line; lines are read from left to right, blanks follow gaps. A line is
    trimmed, empty ones are left out. Where a centre lies beyond all earlier ones by more than the tolerance, a line begins
    whatever the mean is, so groups fall into pieces there, and only a piece is walked through in order. Tables with a row for
    each group grow with the boxes, so they are merged in and never broadcast, however small their files are.
    """
    key = F.struct(*by).alias("_g")
    box = F.col("bbox")
    d = items.select(key, F.col("item_id").alias("_i"), box["x0"].alias("x0"), box["y0"].alias("y0"), box["x1"].alias("x1"), (box["y1"] - box["y0"]).alias("h"),
                     ((box["y0"] + box["y1"]) / 2).alias("cy"), F.coalesce("text", F.lit("")).alias("t"))
    tol = medians(d.select("_g", F.greatest(F.lit(1.0), "h").alias("v")), ["_g"]).select("_g", F.greatest(F.lit(8.0), F.col("median") * 0.6).alias("tol"))
    d = d.join(tol.hint("merge"), "_g").withColumn("_c", F.floor(F.col("y0") / width))
    # The highest centre before each box: within a stretch of the axis by a window, over earlier stretches by one row each.
    inside = W.partitionBy("_g", "_c").orderBy("y0", "x0", "_i")
    ends = d.groupBy("_g", "_c").agg(F.max("cy").alias("top"))
    ends = ends.withColumn("before", F.max("top").over(W.partitionBy("_g").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))).drop("top")
    d = d.withColumn("_top", F.max("cy").over(inside.rowsBetween(W.unboundedPreceding, -1))).join(ends.hint("merge"), ["_g", "_c"])
    opens = (F.col("cy") - F.greatest("_top", "before") > F.col("tol")).cast("long")
    d = d.withColumn("_open", F.coalesce(opens, F.lit(0))).withColumn("_k", F.sum("_open").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sums = d.groupBy("_g", "_c").agg(F.sum("_open").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(W.partitionBy("_g").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    d = d.join(sums.hint("merge"), ["_g", "_c"]).withColumn("_piece", F.col("_k") + F.coalesce("base", F.lit(0)))
    d = cut_lineage(d.select("_g", "_piece", "_i", "x0", "y0", "x1", "h", "cy", "t", "tol"))
    rows = d.select(F.struct("_g", "_piece").alias("_p"), "_i", "cy", "tol", "y0", "x0").repartition("_p").sortWithinPartitions("_p", "y0", "x0", "_i").select("_p", "_i", "cy", "tol")
    kinds = StructType([rows.schema["_p"], rows.schema["_i"], StructField("line", LongType())])
    lines = rows.mapInArrow(_line_numbers(), kinds).select("_p._g", "_p._piece", "_i", "line")
    d = d.join(lines.hint("merge"), ["_g", "_piece", "_i"])
    right = W.partitionBy("_g", "_piece", "line").orderBy("x0", "y0", "_i")
    gap = F.col("x0") - F.lag("x1").over(right) > F.greatest(F.lit(4.0), F.least(F.lag("h").over(right), F.col("h")) * 0.35)
    d = d.withColumn("part", F.concat(F.when(F.coalesce(gap, F.lit(False)), " ").otherwise(""), F.col("t")))
    joined = lambda x, sep: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda s: s["s"]), sep)
    said = d.groupBy("_g", "_piece", "line").agg(tx.strip(joined(F.struct("x0", "y0", "_i", F.col("part").alias("s")), "")).alias("s"))
    out = said.groupBy("_g").agg(joined(F.when(F.col("s") != "", F.struct("_piece", "line", "s")), "\n").alias("text"))
    return out.select("_g.*", "text")


def assign_text_to_cells(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with joined text and best score (1.0 when nothing matched), plus unmatched text boxes as fallback elements."""
    m = match_text_to_cells(items, cells).join(items.select(*TABLE, "item_id", "bbox", "text", "score").hint("merge"), [*TABLE, "item_id"])
    m = cut_lineage(m)
    best = m.groupBy(*TABLE, "cell_idx").agg(F.max("score").alias("score")).hint("merge")
    got = join_texts(m, [*TABLE, "cell_idx"]).join(best, [*TABLE, "cell_idx"])
    full = cells.select(*TABLE, "cell_idx", "bbox").join(got.hint("merge"), [*TABLE, "cell_idx"], "left")
    full = full.select(*TABLE, F.lit("table_cell").alias("kind"), F.col("cell_idx").alias("elem_id"), "bbox", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(1.0)).alias("score"))
    rest = items.join(m.select(*TABLE, "item_id").distinct().hint("merge"), [*TABLE, "item_id"], "left_anti")
    return full.unionByName(rest.select(*TABLE, F.lit("table_text_fallback").alias("kind"), F.col("item_id").alias("elem_id"), "bbox", "text", "score"))


def cluster_positions(values: DataFrame, by: list[str], tol: Column | float, width: float = 4096.0) -> DataFrame:
    """Means of position clusters: a gap above ``tol`` to the previous value opens a new one.

    Equal values are counted first. Gaps inside a chunk of the axis come from a window per chunk, gaps between chunks from
    one row per chunk, so no task holds a whole hot group. ``values``: by, v, and the columns ``tol`` needs.
    """
    tol = F.lit(tol) if isinstance(tol, (int, float)) else tol
    d = values.withColumn("_tol", tol).groupBy(*by, "v").agg(F.count("*").alias("n"), F.max("_tol").alias("_tol"))
    d = d.withColumn("_c", F.floor(F.col("v") / width))
    inside = W.partitionBy(*by, "_c").orderBy("v")
    d = d.withColumn("_open", F.coalesce((F.col("v") - F.lag("v").over(inside) > F.col("_tol")).cast("long"), F.lit(0)))
    d = d.withColumn("_k", F.sum("_open").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    ends = d.groupBy(*by, "_c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("_open").alias("opens"), F.max("_tol").alias("_tol"))
    over = W.partitionBy(*by).orderBy("_c")
    ends = ends.withColumn("_first", F.coalesce((F.col("lo") - F.lag("hi").over(over) > F.col("_tol")).cast("long"), F.lit(0)))
    ends = ends.withColumn("_base", F.sum(F.col("_first") + F.col("opens")).over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("opens"))
    j = d.join(ends.select(*by, "_c", "_base"), [*by, "_c"])
    j = j.groupBy(*by, (F.col("_base") + F.col("_k")).alias("_id")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("pos"))
    return j.select(*by, F.col("_id").cast("int").alias("edge_idx"), "pos")


def grid_edges_from_elements(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges per page and axis: table and layout elements clustered with tolerances from their median size, then merged.

    elements: PAGE, kind, bbox; pages: PAGE, width, height. Tables keep edges tighter (2.0 / 2.5) than plain layout (6.0).
    """
    is_table = F.col("kind").isin("table_cell", "table_text_fallback")
    e = elements.withColumn("cls", F.when(is_table, "table").when(F.col("kind") == "layout_block", "layout")).filter("cls is not null")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.greatest(F.lit(1.0), F.col(f"bbox.{a}1") - F.col(f"bbox.{a}0")).alias("v")) for s, a in (("mw", "x"), ("mh", "y"))])
    size = medians(e.select(*PAGE, "cls", F.inline(sides)), [*PAGE, "cls", "side"]).groupBy(*PAGE, "cls")
    size = size.agg(*[F.max(F.when(F.col("side") == s, F.col("median"))).alias(s) for s in ("mw", "mh")])
    axis = F.array(*[F.struct(F.lit(a).alias("axis"), F.col("bbox." + c).alias("v")) for a, c in (("x", "x0"), ("x", "x1"), ("y", "y0"), ("y", "y1"))])
    v = e.select(*PAGE, "cls", F.inline(axis)).join(size, [*PAGE, "cls"])
    clamp = lambda lo, hi, x: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    tol = F.when(F.col("cls") == "table", F.when(F.col("axis") == "x", clamp(1.5, 6.0, F.col("mw") * 0.04)).otherwise(clamp(1.5, 6.0, F.col("mh") * 0.08))).otherwise(
        F.when(F.col("axis") == "x", clamp(4.0, 24.0, F.col("mw") * 0.1)).otherwise(clamp(4.0, 24.0, F.col("mh") * 0.3)))
    inner = cluster_positions(v, [*PAGE, "cls", "axis"], tol).select(*PAGE, "axis", F.col("pos").alias("v"))
    frame = F.array(F.struct(F.lit("x").alias("axis"), F.lit(0.0).alias("v")), F.struct(F.lit("y").alias("axis"), F.lit(0.0).alias("v")),
                    F.struct(F.lit("x").alias("axis"), F.col("width").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("height").alias("v")))
    outer = pages.select(*PAGE, F.inline(frame)).filter((F.col("v") >= 0))
    has = e.filter("cls = 'table'").select(*PAGE).distinct().withColumn("tab", F.lit(True))
    allv = inner.unionByName(outer).join(has, PAGE, "left")
    final = F.when(F.col("tab"), F.when(F.col("axis") == "x", 2.0).otherwise(2.5)).otherwise(6.0)
    edges = cut_lineage(cluster_positions(allv, [*PAGE, "axis"], final))  # used three times
    lone = edges.groupBy(*PAGE, "axis").agg(F.count("*").alias("k")).filter("k < 2").join(pages, PAGE)
    span = F.greatest(F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height")), F.lit(100.0))
    fixed = lone.select(*PAGE, "axis", F.posexplode(F.array(F.lit(0.0), span)).alias("edge_idx", "pos"))
    return edges.join(lone, [*PAGE, "axis"], "left_anti").unionByName(fixed)


def nearest_edge(points: DataFrame, edges: DataFrame, by: list[str], bucket: float = 256.0) -> DataFrame:
    """Adds the 1-based index of the nearest edge, the lower one on ties. points: by, id, v.

    The space between neighbouring edge midpoints belongs to one edge, so this is a range lookup filed in buckets.
    """
    w = W.partitionBy(*by).orderBy("pos")
    e = edges.withColumn("_lo", (F.lag("pos").over(w) + F.col("pos")) / 2).withColumn("_hi", (F.lead("pos").over(w) + F.col("pos")) / 2)
    ext = points.groupBy(*by).agg(F.min("v").alias("_min"), F.max("v").alias("_max"))
    e = e.join(ext, by).withColumn("_lo", F.coalesce("_lo", F.least("_min", "pos") - 1)).withColumn("_hi", F.coalesce("_hi", F.greatest("_max", "pos") + 1))
    e = e.filter((F.col("_hi") >= F.col("_min")) & (F.col("_lo") <= F.col("_max")))
    e = e.select(*by, "edge_idx", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / bucket), F.floor(F.col("_hi") / bucket))).alias("_b"))
    p = points.withColumn("_b", F.floor(F.col("v") / bucket))
    j = p.join(e, [*by, "_b"]).filter((F.col("v") > F.col("_lo")) & (F.col("v") <= F.col("_hi")))
    return j.select(*points.columns, (F.col("edge_idx") + 1).alias("edge"))


def resolve_range(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """Grid rectangle of each box from its nearest edges. boxes: PAGE, box_id, bbox."""
    corner = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(c).alias("c"), F.col("bbox." + c).alias("v")) for a, c in (("x", "x0"), ("y", "y0"), ("x", "x1"), ("y", "y1"))])
    n = nearest_edge(boxes.select(*PAGE, "box_id", F.inline(corner)), edges, [*PAGE, "axis"])
    w = n.groupBy(*PAGE, "box_id").agg(*[F.max(F.when(F.col("c") == c, F.col("edge"))).alias(c) for c in ("x0", "y0", "x1", "y1")])
    pair = lambda lo, hi: (F.least(lo, hi), F.greatest(lo, hi))
    (r0, r1), (c0, c1) = pair("y0", "y1"), pair("x0", "x1")
    return w.select(*PAGE, "box_id", r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))


def flow_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Start row of each block of a page written top to bottom: text takes two rows, a table its rows and one more.

    blocks: PAGE, block_id, kind (text_block, table_block), bbox, text. tables: PAGE, table_idx, n_rows, n_cols. The i-th table
    block takes the i-th table. A page is one sheet, whose rows the file format bounds.
    """
    order = W.partitionBy(*PAGE).orderBy(F.col("bbox.y0"), F.col("bbox.x0"), "block_id")
    tab = blocks.filter("kind = 'table_block'").withColumn("table_idx", F.row_number().over(order) - 1).select(*PAGE, "block_id", "table_idx")
    b = blocks.join(tab, [*PAGE, "block_id"], "left").join(tables, [*PAGE, "table_idx"], "left")
    height = F.when(F.col("kind") == "table_block", F.coalesce("n_rows", F.lit(0)) + 1).when(tx.squeeze(F.coalesce("text", F.lit(""))) != "", 2).otherwise(0)
    width = b.groupBy(*PAGE).agg(F.greatest(F.lit(4), F.coalesce(F.max("n_cols"), F.lit(0))).alias("total_cols"))
    b = b.withColumn("height", height).withColumn("start_row", F.sum("height").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("height") + 1)
    return b.join(width, PAGE).select(*PAGE, "block_id", "kind", "table_idx", "start_row", "height", "total_cols")


def place_colspans(cells: DataFrame) -> DataFrame:
    """Column of each cell where no cell spans rows: the running sum of spans to its left. cells: TABLE, row, cell_idx, col_span."""
    w = W.partitionBy(*TABLE, "row").orderBy("cell_idx").rowsBetween(W.unboundedPreceding, 0)
    return cells.withColumn("col", (F.sum("col_span").over(w) - F.col("col_span") + 1).cast("int"))


def content_widths(tcells: DataFrame, n_cols: DataFrame) -> DataFrame:
    """Width per column from its texts: at least 8, at most 40. tcells: TABLE, col, col_span, text; n_cols: TABLE, n_cols."""
    longest = F.array_max(F.transform(tx.split_lines(F.col("text")), lambda x: tx.display_width(x)))
    est = F.least(F.lit(40.0), F.greatest(F.lit(6.0), longest / F.col("col_span") + 2.0))
    c = tcells.filter(tx.squeeze(F.col("text")) != "").select(*TABLE, est.alias("est"), F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"))
    got = c.groupBy(*TABLE, "col").agg(F.max("est").alias("est"))
    full = n_cols.select(*TABLE, F.explode(F.sequence(F.lit(1), F.col("n_cols"))).alias("col"))
    return full.join(got, [*TABLE, "col"], "left").select(*TABLE, "col", F.greatest(F.lit(8.0), F.coalesce("est", F.lit(8.0))).alias("content_width"))


def geometry_widths(cell_boxes: DataFrame, n_cols: DataFrame) -> DataFrame:
    """Width per column from clustered box edges; 16 where there are too few edges."""
    v = cell_boxes.select(*TABLE, F.explode(F.array("bbox.x0", "bbox.x1")).alias("v"))
    e = cluster_positions(v, TABLE, 3.0)
    w = W.partitionBy(*TABLE).orderBy("edge_idx")
    e = e.withColumn("span", F.lead("pos").over(w) - F.col("pos")).withColumn("col", F.col("edge_idx") + 1)
    k = e.groupBy(*TABLE).agg(F.count("*").alias("k"))
    full = n_cols.select(*TABLE, "n_cols", F.explode(F.sequence(F.lit(1), F.col("n_cols"))).alias("col"))
    j = full.join(k, TABLE, "left").join(e.select(*TABLE, "col", "span"), [*TABLE, "col"], "left")
    px = F.least(F.lit(40.0), F.greatest(F.lit(6.0), F.greatest(F.lit(12.0), F.col("span")) / 7.0))
    return j.select(*TABLE, "col", F.when(F.col("k") >= F.col("n_cols") + 1, px).otherwise(16.0).alias("geometry_width"))


def column_widths(tcells: DataFrame, cell_boxes: DataFrame, n_cols: DataFrame, mode: str = "combined") -> DataFrame:
    geo = geometry_widths(cell_boxes, n_cols)
    if mode == "geometry":
        return geo.withColumnRenamed("geometry_width", "width")
    j = geo.join(content_widths(tcells, n_cols), [*TABLE, "col"])
    return j.select(*TABLE, "col", F.least(F.lit(45.0), F.greatest("geometry_width", "content_width")).alias("width"))


def placeholder(label: Column) -> Column:
    """Stand-in text of a block that carries none, by what its label contains."""
    n = F.lower(tx.strip(F.coalesce(label, F.lit(""))))
    return (
        F.when(n.contains("image") | n.contains("figure"), "[image]").when(n.contains("chart"), "[chart]")
        .when(n.contains("formula"), "[formula]").when(n.contains("seal"), "[seal]").when(n == "", "[block]").otherwise(F.concat(F.lit("["), n, F.lit("]")))
    )


def style_class(label: Column, kind: Column) -> Column:
    n = F.lower(tx.strip(F.coalesce(label, F.lit(""))))
    return (
        F.when(kind == "table_cell", "table").when(n.contains("doc_title"), "doc_title").when(n.contains("title") | n.contains("header"), "header")
        .when(n.rlike("caption|footer|reference"), "note").when(n.isin("text", "paragraph", "content"), "body").otherwise("plain")
    )


def page_elements(blocks: DataFrame, table_elements: DataFrame) -> DataFrame:
    """Text blocks and table elements of a page in one relation, with placeholder text and a style class per label."""
    text = F.coalesce(F.nullif(tx.squeeze(F.coalesce("text", F.lit(""))), F.lit("")), placeholder(F.col("label")))
    b = blocks.filter("label <> 'table'").select(*PAGE, F.lit("layout_block").alias("kind"), "label", "bbox", text.alias("text"))
    t = table_elements.select(*PAGE, "kind", F.col("kind").alias("label"), "bbox", "text")
    return b.unionByName(t).withColumn("style_class", style_class(F.col("label"), F.col("kind")))


def blocks_report(blocks: DataFrame) -> DataFrame:
    """Blocks of a page in reading order with their box spelled out."""
    order = W.partitionBy(*PAGE).orderBy(F.col("bbox.y0"), F.col("bbox.x0"), "block_id")
    return blocks.select(*PAGE, "block_id", F.row_number().over(order).alias("order"), "label", tx.squeeze(F.coalesce("text", F.lit(""))).alias("text"), F.to_json("bbox").alias("bbox"))


def meta_report(pages: DataFrame, fields: list[str]) -> DataFrame:
    """Document metadata as (field, value) rows."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return pages.select(*PAGE, F.inline(rows))


def filter_slots_by_area(slots: DataFrame, min_px: float = 200.0, share: float = 0.3) -> DataFrame:
    """Slots of at least ``share`` of their sheet's median area and ``min_px`` pixels."""
    mid = medians(slots.select(*KEYS, F.col("area_px").alias("v")), KEYS).withColumnRenamed("median", "_mid")
    return slots.join(mid, KEYS).filter(F.col("area_px") >= F.greatest(F.lit(min_px), F.col("_mid") * share)).drop("_mid")


def number_slots(slots: DataFrame) -> DataFrame:
    """Slot numbers from 0, top to bottom and left to right."""
    return slots.withColumn("slot_id", F.row_number().over(W.partitionBy(*KEYS).orderBy("y0", "x0", "row", "col")) - 1)


def slots_from_mask(runs: DataFrame, edges: DataFrame, min_px: int = 200, min_share: float = 0.1) -> DataFrame:
    """Slots from a pixel mask given as horizontal runs (keys, y, x0, x1 exclusive): grid cells with enough positive pixels."""
    at = g.point_to_index(runs, edges, "row", "y", "row")
    cols = edges.filter("axis = 'col'").select(*KEYS, F.col("idx").alias("col"), F.col("edge0").alias("e0"), F.col("edge1").alias("e1"))
    step = 1024
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / step), F.floor((F.col(hi) - 1e-6) / step)))
    a = at.withColumn("_b", buckets("x0", "x1"))
    b = cols.filter("e1 > e0").withColumn("_b", buckets("e0", "e1"))
    lo, hi = F.greatest("x0", "e0"), F.least("x1", "e1")
    j = a.join(b, [*KEYS, "_b"]).filter((lo < hi) & (F.floor(lo / step) == F.col("_b")))
    n = j.groupBy(*KEYS, "row", "col").agg(F.sum(hi - lo).alias("n_px"))
    r = edges.filter("axis = 'row'").select(*KEYS, F.col("idx").alias("row"), F.col("edge0").alias("y0"), F.col("edge1").alias("y1"))
    n = n.join(r, [*KEYS, "row"]).join(cols.select(*KEYS, "col", F.col("e0").alias("x0"), F.col("e1").alias("x1")), [*KEYS, "col"])
    n = n.withColumn("area_px", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    n = n.filter((F.col("n_px") >= min_px) & (F.col("n_px") >= F.col("area_px") * min_share))
    return number_slots(filter_slots_by_area(n))


def slots_from_components(points: DataFrame, interesting: DataFrame, merges: DataFrame, edges: DataFrame) -> DataFrame:
    """Anchor cell and spanned cells of each component. points: comp_id, keys, ord, x, y."""
    anchor = g.anchor_from_points(points, interesting, merges, edges, "comp_id")
    span = g.point_to_cell(points, edges).groupBy("comp_id", *KEYS).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    return span.join(anchor, ["comp_id", *KEYS])


def chunk_slots(slots: DataFrame, n: int = 8) -> DataFrame:
    """Batches of ``n`` slots in slot order; numbers of a sheet run from 0 without holes, so no window is needed."""
    return slots.withColumn("chunk", F.floor(F.col("slot_id") / n).cast("int"))


def crop_union(slots: DataFrame, sizes: DataFrame, pad: int = 20) -> DataFrame:
    """Padded crop box per batch, at least one pixel of the image. slots: keys, chunk, x0..y1; sizes: keys, width, height."""
    b = slots.groupBy(*KEYS, "chunk").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).join(sizes, KEYS)
    low = lambda c, size: F.greatest(F.lit(0), F.least(F.col(c) - pad, F.col(size) - 1))
    high = lambda c, size, first: F.greatest(first + 1, F.least(F.col(c) + pad, F.col(size)))
    x0, y0 = low("x0", "width"), low("y0", "height")
    return b.select(*KEYS, "chunk", x0.alias("x0"), y0.alias("y0"), high("x1", "width", x0).alias("x1"), high("y1", "height", y0).alias("y1"))


def slots_in_crops(slots: DataFrame, crops: DataFrame) -> DataFrame:
    """Slots with their boxes counted from the corner of their batch's crop; other columns stay."""
    c = crops.select(*KEYS, "chunk", F.col("x0").alias("_cx"), F.col("y0").alias("_cy"))
    moved = {"x0": "_cx", "x1": "_cx", "y0": "_cy", "y1": "_cy"}
    return slots.join(c, [*KEYS, "chunk"]).select(*[(F.col(n) - F.col(moved[n])).alias(n) if n in moved else F.col(n) for n in slots.columns])


def chunk_summary(slots: DataFrame, crops: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per batch: its slots in order, its crop, and how many pairs the replies gave. pairs: keys, chunk, one row a pair."""
    s = slots.groupBy(*KEYS, "chunk").agg(F.count("*").alias("slot_count"), F.array_sort(F.collect_list("slot_id")).alias("slot_ids"))
    n = pairs.groupBy(*KEYS, "chunk").agg(F.count("*").alias("_n"))
    box = crops.select(*KEYS, "chunk", F.array("x0", "y0", "x1", "y1").alias("crop"))
    d = s.join(box, [*KEYS, "chunk"], "left").join(n, [*KEYS, "chunk"], "left")
    return d.select(*KEYS, "chunk", "slot_count", "slot_ids", "crop", F.coalesce("_n", F.lit(0)).alias("pair_count"))
