"""Structure of worksheets held as sparse cell tables.

cells   wb_id, sheet, row, col, value, value_type (s, n, b, d), border_top .. border_right, fill_type, fill_rgb, style_key
merges  wb_id, sheet, r0, c0, r1, c1          dims  wb_id, sheet, axis, idx, size
Every operator groups by (wb_id, sheet); none collects a sheet into one row unless a cap is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.functions.text import strip
from formloom.operators.spatial import RECT, overlap_join

KEYS = ["wb_id", "sheet"]
POS = [*KEYS, "row", "col"]
SIDES = ("top", "bottom", "left", "right")


def has_content() -> Column:
    return F.col("value").isNotNull() & (strip(F.col("value")) != "")


def has_border() -> Column:
    out = F.lit(False)
    for s in SIDES:
        out = out | F.col("border_" + s).isNotNull()
    return out


def border_tags() -> Column:
    """Subset of T, B, L, R of the sides that carry a style."""
    parts = [F.when(F.col("border_" + s).isNotNull(), F.lit(s[0].upper())) for s in SIDES]
    return F.array_compact(F.array(*parts))


def is_boxed() -> Column:
    out = F.lit(True)
    for s in SIDES:
        out = out & F.col("border_" + s).isNotNull()
    return out


def as_rects(points: DataFrame) -> DataFrame:
    """Points as one-cell rectangles."""
    return points.select(
        *points.columns,
        F.col("row").alias("r0"),
        F.col("col").alias("c0"),
        F.col("row").alias("r1"),
        F.col("col").alias("c1"),
    )


#: Blocks of at least so many rows are filed by bands of so many rows, lower ones by row.
BAND = 64


def attach_anchor(points: DataFrame, merges: DataFrame) -> DataFrame:
    """Adds ``a_row, a_col, m_r1, m_c1, is_merged``: where a write to the cell really lands.

    Blocks are not unfolded to cells: low ones are filed by their rows, tall ones by bands of rows, so that a block over a
    whole sheet costs some thousand rows; a row holds few blocks. Most tables of blocks hold no tall one; a look at them first
    saves the points a second journey. Points leave dealt by sheet and row where they came as plain columns.
    """
    m = merges.select(*[F.col(k).alias("_m_" + k) for k in KEYS], *[F.col(c).alias("_m_" + c) for c in RECT])
    tall = F.col("_m_r1") - F.col("_m_r0") >= BAND
    low = m.filter(~tall).withColumn("_m_row", F.explode(F.sequence("_m_r0", "_m_r1")))

    def on(pre: str, row: Column) -> Column:
        cond = F.col(f"_{pre}_row") == row
        for k in KEYS:
            cond = cond & (F.col(k) == F.col(f"_{pre}_{k}"))
        return cond & F.col("row").between(F.col(f"_{pre}_r0"), F.col(f"_{pre}_r1")) & F.col("col").between(F.col(f"_{pre}_c0"), F.col(f"_{pre}_c1"))

    j = points.join(low, on("m", F.col("row")), "left")
    found = [["_m_" + c] for c in RECT]
    if not m.filter(tall).isEmpty():
        high = m.filter(tall).withColumn("_m_row", F.explode(F.sequence(F.floor(F.col("_m_r0") / BAND), F.floor(F.col("_m_r1") / BAND))))
        high = high.select(*[F.col(c).alias(c.replace("_m_", "_h_")) for c in high.columns])
        j = j.join(high, on("h", F.floor(F.col("row") / BAND)), "left")
        found = [["_m_" + c, "_h_" + c] for c in RECT]
    own = ("row", "col", "row", "col")
    return j.select(
        *points.columns,
        *[F.coalesce(*held, at).alias(name) for held, at, name in zip(found, own, ("a_row", "a_col", "m_r1", "m_c1"))],
        F.coalesce(*found[0]).isNotNull().alias("is_merged"),
    )


def anchor_map(merges: DataFrame) -> DataFrame:
    """Every covered cell with its anchor and rectangle."""
    return merges.select(
        *KEYS, *RECT, F.explode(rg.cells_of(F.struct(*RECT))).alias("p")
    ).select(*KEYS, F.col("p.row").alias("row"), F.col("p.col").alias("col"), *RECT)


def used_bbox(cells: DataFrame, merges: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Box around content, borders, fills and merged blocks; ``sheets`` adds empty ones as (1,1,1,1)."""
    live = cells.filter(has_content() | has_border() | F.col("fill_type").isNotNull())
    live = live.select(*KEYS, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("row").alias("r1"), F.col("col").alias("c1"))
    box = live.unionByName(merges.select(*KEYS, *RECT)).groupBy(*KEYS).agg(*rg.bbox_agg())
    if sheets is None:
        return box
    return sheets.select(*KEYS).join(box, KEYS, "left").select(*KEYS, *[F.coalesce(c, F.lit(1)).alias(c) for c in RECT])


def form_bbox(
    pairs: DataFrame, used: DataFrame, left: int = 8, right: int = 2, top: int = 2, bottom: int = 2
) -> DataFrame:
    """Padded box of all value cells inside the used box; sheets without valid value cells keep the used box."""
    rects = pairs.select(*KEYS, F.inline(rg.parse_list(F.col("value_cell"))))
    box = rects.groupBy(*KEYS).agg(*rg.bbox_agg("f_"))
    j = used.join(box, KEYS, "left")
    missing = F.col("f_r0").isNull()
    return j.select(
        *KEYS,
        F.when(missing, F.col("r0")).otherwise(F.greatest("r0", F.col("f_r0") - top)).alias("r0"),
        F.when(missing, F.col("c0")).otherwise(F.greatest("c0", F.col("f_c0") - left)).alias("c0"),
        F.when(missing, F.col("r1")).otherwise(F.least("r1", F.col("f_r1") + bottom)).alias("r1"),
        F.when(missing, F.col("c1")).otherwise(F.least("c1", F.col("f_c1") + right)).alias("c1"),
    )


def within_box(cells: DataFrame, box: DataFrame) -> DataFrame:
    """Cells inside the one box of their sheet."""
    b = box.select(*KEYS, *[F.col(c).alias("x_" + c) for c in RECT])
    inside = F.col("row").between(F.col("x_r0"), F.col("x_r1")) & F.col("col").between(F.col("x_c0"), F.col("x_c1"))
    return cells.join(b, KEYS).filter(inside).drop(*["x_" + c for c in RECT])


def labels(cells: DataFrame, any_value: bool = False) -> DataFrame:
    """Non-blank text cells; with ``any_value`` numbers and dates count too (background context)."""
    keep = has_content() if any_value else has_content() & (F.col("value_type") == "s")
    return cells.filter(keep).select(*POS, strip(F.col("value")).alias("text"))


def input_cells(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """Anchors of all value cells a form names."""
    pts = pairs.select(*KEYS, F.explode(rg.parse_list(F.col("value_cell"))).alias("x")).select(
        *KEYS, F.explode(rg.cells_of(F.col("x"))).alias("p")
    )
    pts = pts.select(*KEYS, "p.row", "p.col").distinct()
    return attach_anchor(pts, merges).select(*KEYS, F.col("a_row").alias("row"), F.col("a_col").alias("col")).distinct()


def input_candidates(cells: DataFrame, merges: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """Cells that look writable, as anchors: boxed, with a bottom line, or merged. ``box`` limits the scanned positions.

    A merged block is a candidate where it meets the box; it is taken as a rectangle.
    """
    lined = cells.filter(F.col("border_bottom").isNotNull()).select(*POS)
    blocks = merges.select(*KEYS, *RECT)
    if box is not None:
        lined = within_box(lined, box)
        b = box.select(*KEYS, *[F.col(c).alias("x_" + c) for c in RECT])
        meets = (F.col("r0") <= F.col("x_r1")) & (F.col("x_r0") <= F.col("r1")) & (F.col("c0") <= F.col("x_c1")) & (F.col("x_c0") <= F.col("c1"))
        blocks = blocks.join(b, KEYS).filter(meets)
    at = attach_anchor(lined, merges).select(*KEYS, F.col("a_row").alias("row"), F.col("a_col").alias("col"))
    return at.unionByName(blocks.select(*KEYS, F.col("r0").alias("row"), F.col("c0").alias("col"))).distinct()


def typed_candidates(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Writable cells with the first matching kind; a merged block counts only at its anchor."""
    drawn = cells.select(*POS, F.when(is_boxed(), "boxed").when(F.col("border_bottom").isNotNull(), "bottom_line").alias("drawn")).filter("drawn is not null")
    anchors = merges.select(*KEYS, F.col("r0").alias("row"), F.col("c0").alias("col")).distinct()
    return drawn.join(anchors, POS, "full").select(*POS, F.coalesce("drawn", F.lit("merged_anchor")).alias("kind"))


def static_template_cells(cells: DataFrame, merges: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Non-empty cells that are no input candidate, with the columns ``extra`` names.

    A line inside a merged block makes its anchor the candidate, which it is anyway. So a cell is one where a block begins, or
    where it has a line of its own and no block covers it; only such cells are asked for blocks.
    """
    lined, shown = F.col("border_bottom").isNotNull(), [*POS, "value", *extra]
    c = cells.filter(has_content())
    at = attach_anchor(c.filter(lined).select(*shown), merges).filter("is_merged").select(*shown).distinct()
    anchors = merges.select(*KEYS, F.col("r0").alias("row"), F.col("c0").alias("col"))
    return c.filter(~lined).select(*shown).unionByName(at).join(anchors, POS, "left_anti")


def static_labels(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Labels outside the typed candidates."""
    return labels(cells).join(typed_candidates(cells, merges), POS, "left_anti")


def scan_structure(cells: DataFrame, merges: DataFrame) -> dict[str, DataFrame]:
    """All structural tables of the sheets; kept as relations so that no sheet is packed into a row."""
    return {
        "bbox": used_bbox(cells, merges),
        "merged_ranges": merges.select(*KEYS, rg.a1_range(*[F.col(c) for c in RECT]).alias("merged_range")),
        "labels": labels(cells),
        "candidates": typed_candidates(cells, merges),
        "boxed": cells.filter(is_boxed()).select(*POS, "style_key"),
    }


def top_rows(df: DataFrame, by: list[str], order: list, n: int | None) -> DataFrame:
    """First ``n`` rows per group; Spark prunes each partition to n before the shuffle."""
    if n is None:
        return df
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def structure_preview(cells: DataFrame, n: int | None = None, width: int | None = None) -> DataFrame:
    """Text cells per sheet; for a prompt the first ``n`` in row-major order, each cut to ``width``."""
    t = labels(cells)
    t = t if width is None else t.withColumn("text", F.substring("text", 1, width))
    return top_rows(t, KEYS, ["row", "col"], n)


def nonempty_cells(cells: DataFrame, box: DataFrame | None = None) -> DataFrame:
    out = cells.filter(has_content()).select(*POS, strip(F.col("value")).alias("text"))
    return within_box(out, box) if box is not None else out


def template_region_summary(regions: DataFrame, template: DataFrame, n: int | None = None) -> DataFrame:
    """Non-empty template cells of each region; for a prompt the first ``n`` in row-major order. regions: keys, region_id, rect."""
    hit = overlap_join(as_rects(nonempty_cells(template)), regions.select(*KEYS, "region_id", *RECT), KEYS, points=True, levels=regions)
    hit = hit.select(*KEYS, "region_id", "row", "col", "text")
    return top_rows(hit, [*KEYS, "region_id"], ["row", "col"], n)


def read_anchor_value(requests: DataFrame, cells: DataFrame, merges: DataFrame, range_col: str = "value_cell") -> DataFrame:
    """Adds the value at the anchor of the first cell of the first range; unparsable ranges give null."""
    p = requests.select("*", F.inline_outer(F.array_compact(F.array(rg.first_rect(F.col(range_col))))))
    p = p.withColumn("row", F.col("r0")).withColumn("col", F.col("c0")).drop(*RECT)
    p = attach_anchor(p, merges).drop("row", "col", "m_r1", "m_c1", "is_merged")
    v = cells.select(
        *KEYS, F.col("row").alias("a_row"), F.col("col").alias("a_col"), F.col("value").alias("current_value"),
        F.col("value_type").alias("current_type"),
    )
    return p.join(v, [*KEYS, "a_row", "a_col"], "left")


def read_range(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Dense positions of each requested rectangle with the values found there (null where nothing is stored)."""
    grid = requests.select("*", F.explode(rg.cells_of(F.struct(*RECT))).alias("p")).drop(*RECT)
    grid = grid.select(*[c for c in grid.columns if c != "p"], "p.row", "p.col")
    return grid.join(cells.select(*POS, "value", "value_type", "style_key"), POS, "left")


# Defaults that carry no style information.
STYLE_DEFAULTS = {"font_name": "Calibri", "font_size": "11", "number_format": "General", "row_height": "15", "col_width": "8.43"}


def style_summary(styles: DataFrame, columns: list[str]) -> DataFrame:
    """Non-default style entries as JSON and a key by which styles are compared."""
    shown = [
        (F.nullif(F.col(c).cast("string"), F.lit(STYLE_DEFAULTS[c])) if c in STYLE_DEFAULTS else F.col(c).cast("string")).alias(c)
        for c in columns
    ]
    out = styles.withColumn("style_json", F.to_json(F.struct(*shown), {"ignoreNullFields": "true"}))
    return out.withColumn("style_key", F.xxhash64("style_json"))


def colour_token(rgb: Column, indexed: Column, theme: Column, tint: Column) -> Column:
    """One text per colour: rgb, else palette index, else theme with tint."""
    return F.coalesce(
        rgb,
        F.when(indexed.isNotNull(), F.concat(F.lit("indexed:"), indexed.cast("string"))),
        F.when(theme.isNotNull(), F.concat(F.lit("theme:"), theme.cast("string"), F.lit(":"), F.coalesce(tint, F.lit(0.0)).cast("string"))),
    )


# Border styles that draw structure, and fills that draw nothing.
STRUCTURAL_BORDERS = ("thin", "medium", "thick", "double", "hair")
PLAIN_FILLS = ("00000000", "FFFFFFFF", "FF000000")


def interesting_points(cells: DataFrame) -> DataFrame:
    """Stored cells with a value, a structural border or a visible fill."""
    line = F.lit(False)
    for s in SIDES:
        line = line | F.coalesce(F.col("border_" + s).isin(*STRUCTURAL_BORDERS), F.lit(False))
    fill = F.coalesce(~F.col("fill_rgb").isin(*PLAIN_FILLS), F.lit(False))
    return cells.filter(F.col("value").isNotNull() | line | fill).select(*POS)


def interesting_cells(cells: DataFrame, merges: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """Positions of interesting cells: ``interesting_points`` and all of each merged block, clipped to the sheet's ``box`` if given."""
    own, blocks = interesting_points(cells), merges.select(*KEYS, *RECT)
    if box is not None:
        own = within_box(own, box)
        b = box.select(*KEYS, *[F.col(c).alias("x_" + c) for c in RECT])
        clipped = blocks.join(b, KEYS).select(*KEYS, *[f("" + c, "x_" + c).alias(c) for f, c in ((F.greatest, "r0"), (F.greatest, "c0"), (F.least, "r1"), (F.least, "c1"))])
        blocks = clipped.filter("r0 <= r1 AND c0 <= c1")
    return own.unionByName(anchor_map(blocks).select(*POS)).distinct()


def px_size(axis: Column, size: Column, dpi: int = 96, truncate: bool = False) -> Column:
    """Pixels of a column width (characters) or row height (points), defaults 8.43 and 15."""
    col = F.coalesce(size, F.lit(8.43)) * 7 + 5
    row = F.coalesce(size, F.lit(15.0)) * dpi / 72
    px = F.when(axis == "col", col).otherwise(row)
    return (F.floor(px) if truncate else F.bround(px)).cast("int")


def grid_edges(dims: DataFrame, scale: float = 1.0, dpi: int = 96, truncate: bool = False) -> DataFrame:
    """Running pixel edges per axis: ``edge0`` before and ``edge1`` after each row or column.

    An axis has at most 2^20 entries by the file format, so one window group is bounded.
    """
    px = px_size(F.col("axis"), F.col("size"), dpi, truncate)
    w = W.partitionBy(*KEYS, "axis").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    d = dims.select(*KEYS, "axis", "idx", px.alias("px"))
    end = F.sum("px").over(w)
    return d.select(*KEYS, "axis", "idx", ((end - F.col("px")) * scale).alias("edge0"), (end * scale).alias("edge1"))


def cell_boxes(cells: DataFrame, merges: DataFrame, edges: DataFrame, box: DataFrame) -> DataFrame:
    """Pixel box of each visible cell inside the sheet's box; a merged block once, clipped, at its visible corner."""
    b = box.select(*KEYS, *[F.col(c).alias("x_" + c) for c in RECT])
    c = attach_anchor(within_box(cells.select(*POS), box), merges).join(b, KEYS)
    c = c.select(
        *KEYS,
        F.greatest("a_row", "x_r0").alias("r0"),
        F.greatest("a_col", "x_c0").alias("c0"),
        F.least("m_r1", "x_r1").alias("r1"),
        F.least("m_c1", "x_c1").alias("c1"),
    ).distinct()
    for axis, lo, hi, p, q in (("row", "r0", "r1", "y0", "y1"), ("col", "c0", "c1", "x0", "x1")):
        e = edges.filter(F.col("axis") == axis)
        c = c.join(e.select(*KEYS, F.col("idx").alias(lo), F.col("edge0").alias(p)), [*KEYS, lo])
        c = c.join(e.select(*KEYS, F.col("idx").alias(hi), F.col("edge1").alias(q)), [*KEYS, hi])
    return c.select(*KEYS, *RECT, "x0", "y0", "x1", "y1")


def point_to_index(points: DataFrame, edges: DataFrame, axis: str, value: str, out: str, bucket: int = 1024) -> DataFrame:
    """Row or column index under a pixel position, outer positions clamped.

    Edge intervals are filed in pixel buckets, so the range join is an equi-join on (keys, bucket).
    """
    e = edges.filter((F.col("axis") == axis) & (F.col("edge1") > F.col("edge0")))
    span = e.groupBy(*KEYS).agg(F.min("edge0").alias("_lo"), F.max("edge1").alias("_hi"))
    p = points.join(span, KEYS).withColumn(
        "_x", F.greatest(F.col("_lo"), F.least(F.col(value).cast("double"), F.col("_hi") - 1e-6))
    )
    p = p.withColumn("_b", F.floor(F.col("_x") / bucket)).alias("p")
    q = e.select(
        *[F.col(k).alias("_k_" + k) for k in KEYS],
        "edge0",
        "edge1",
        F.col("idx").alias(out),
        F.explode(F.sequence(F.floor(F.col("edge0") / bucket), F.floor(F.col("edge1") / bucket))).alias("_eb"),
    )
    on = (F.col("_b") == F.col("_eb")) & (F.col("edge0") <= F.col("_x")) & (F.col("_x") < F.col("edge1"))
    for k in KEYS:
        on = on & (F.col("p." + k) == F.col("_k_" + k))
    return p.join(q, on).select("p.*", out).drop("_lo", "_hi", "_x", "_b")


def point_to_cell(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``row`` and ``col`` of the cell under each point."""
    return point_to_index(point_to_index(points, edges, "row", y, "row"), edges, "col", x, "col")


def ring_offsets(radius: int = 6) -> list[tuple[int, int, int]]:
    """Offsets within a radius in breadth-first visiting order: down, up, right, left, then the diagonals."""
    steps = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))
    order, seen = [(0, 0)], {(0, 0)}
    for r, c in order:
        for dr, dc in steps:
            n = (r + dr, c + dc)
            if n not in seen and max(abs(n[0]), abs(n[1])) <= radius:
                seen.add(n)
                order.append(n)
    return [(r, c, i) for i, (r, c) in enumerate(order)]


def snap_to_interesting(points: DataFrame, interesting: DataFrame, radius: int = 6, merges: DataFrame | None = None) -> DataFrame:
    """Moves each cell to the nearest interesting one in 8-neighbour distance; none within the radius keeps it.

    ``points`` carry ``row, col``; the result adds ``s_row, s_col``. ``interesting`` are positions, ``merges`` rectangles all of
    whose cells are interesting; they are clipped to the surroundings of a point, not unfolded. Positions are filed in
    square blocks as wide as the surroundings, so a point meets its own and the neighbouring blocks. Ties go by the order of a
    breadth-first walk.
    """
    side = 2 * radius + 1
    places = {(r, c): k for r, c, k in ring_offsets(radius)}
    order = F.array(*[F.lit(places[r, c]) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)])
    visit = lambda dr, dc: F.element_at(order, ((dr + radius) * side + dc + radius + 1).cast("int"))
    blk = lambda c: F.floor(c / side)

    own = points.select(*POS).distinct()
    span = lambda c: F.explode(F.sequence(blk(F.col(c) - radius), blk(F.col(c) + radius)))
    near = own.withColumn("_br", span("row")).withColumn("_bc", span("col"))
    cells = interesting.select(*KEYS, F.col("row").alias("s_row"), F.col("col").alias("s_col"), blk(F.col("row")).alias("_br"), blk(F.col("col")).alias("_bc"))
    close = (F.abs(F.col("s_row") - F.col("row")) <= radius) & (F.abs(F.col("s_col") - F.col("col")) <= radius)
    hit = near.join(cells, [*KEYS, "_br", "_bc"]).filter(close)
    hit = hit.select(*POS, visit(F.col("s_row") - F.col("row"), F.col("s_col") - F.col("col")).alias("ord"), "s_row", "s_col")
    if merges is not None:
        meets = overlap_join(as_rects(own), merges.select(*KEYS, *RECT), KEYS, grow=radius, points=True, levels=merges)
        clip = lambda c, lo, hi: F.explode(F.sequence(F.greatest(F.col(lo), F.col(c) - radius), F.least(F.col(hi), F.col(c) + radius)))
        inside = meets.withColumn("s_row", clip("row", "o_r0", "o_r1")).withColumn("s_col", clip("col", "o_c0", "o_c1"))
        hit = hit.unionByName(inside.select(*POS, visit(F.col("s_row") - F.col("row"), F.col("s_col") - F.col("col")).alias("ord"), "s_row", "s_col"))
    best = hit.groupBy(*POS).agg(F.min_by(F.struct("s_row", "s_col"), "ord").alias("_s"))
    return points.join(best, POS, "left").select(*points.columns, F.coalesce("_s.s_row", "row").alias("s_row"), F.coalesce("_s.s_col", "col").alias("s_col"))


def anchor_from_points(points: DataFrame, interesting: DataFrame, merges: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """One anchor cell per point group: the snapped candidate with the least squared pixel distance to all points.

    The sum over points splits into n, sum x, sum x^2 and so on, so candidates meet one summary row per group
    and points are never paired with candidates. Points carry ``id_col, ord, x, y``. ``interesting`` are positions; merged
    blocks are interesting as well.
    """
    placed = snap_to_interesting(point_to_cell(points, edges), interesting, merges=merges)
    cand = placed.select(id_col, *KEYS, "ord", F.col("s_row").alias("row"), F.col("s_col").alias("col"))
    cand = attach_anchor(cand, merges)
    cand = cand.groupBy(id_col, *KEYS, "a_row", "a_col", "m_r1", "m_c1").agg(F.min("ord").alias("ord"))
    sums = points.groupBy(id_col, *KEYS).agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("sq"),
    )
    for axis, lo, hi, name in (("row", "a_row", "m_r1", "cy"), ("col", "a_col", "m_c1", "cx")):
        e = edges.filter(F.col("axis") == axis)
        cand = cand.join(e.select(*KEYS, F.col("idx").alias(lo), F.col("edge0").alias("_e0")), [*KEYS, lo])
        cand = cand.join(e.select(*KEYS, F.col("idx").alias(hi), F.col("edge1").alias("_e1")), [*KEYS, hi])
        cand = cand.withColumn(name, (F.col("_e0") + F.col("_e1")) / 2).drop("_e0", "_e1")
    j = cand.join(sums, [id_col, *KEYS])
    cost = (
        F.col("n") * (F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
        - 2 * (F.col("cx") * F.col("sx") + F.col("cy") * F.col("sy"))
        + F.col("sq")
    )
    return j.groupBy(id_col, *KEYS).agg(
        F.min_by(F.struct(F.col("a_row").alias("row"), F.col("a_col").alias("col")), F.struct(F.round(cost, 6), "ord")).alias("b")
    ).select(id_col, *KEYS, "b.row", "b.col")


def dropdown_constraints(
    validations: DataFrame, cells: DataFrame, names: DataFrame, read: int | None = None, keep: int | None = None
) -> DataFrame:
    """Options of list validations, one row per target range.

    Literal lists are split, references read cell text in row-major order, other words are looked up in
    ``names(wb_id, name, ref_sheet, ref)``. At most ``read`` options are read and ``keep`` kept, as the rule demands.
    """
    v = validations.filter(F.lower(strip(F.col("type"))) == "list").withColumn("_raw", F.regexp_replace(strip(F.col("formula1")), "^=", ""))
    v = v.withColumn("_raw", strip(F.col("_raw"))).withColumn("dv_id", F.struct(*KEYS, "sqref", "formula1"))
    literal = F.col("_raw").rlike('^".*"$')
    shorter = lambda options, n: options if n is None else F.slice(options, 1, n)
    lit_opts = shorter(F.filter(F.transform(F.split(F.regexp_replace("_raw", '^"+|"+$', ""), ","), strip), lambda x: x != ""), read)
    inline = v.filter(literal).select("dv_id", lit_opts.alias("options"))
    bang = F.instr("_raw", "!") > 0
    ref_sheet = F.when(bang, F.regexp_replace(F.split("_raw", "!", 2)[0], "^'+|'+$", "")).otherwise(F.col("sheet"))
    ref = strip(F.regexp_replace(F.when(bang, F.split("_raw", "!", 2)[1]).otherwise(F.col("_raw")), r"\$", ""))
    other = v.filter(~literal).select("dv_id", "wb_id", ref_sheet.alias("ref_sheet"), ref.alias("ref"))
    direct = other.filter(F.col("ref").contains(":"))
    named = other.filter(~F.col("ref").contains(":")).select("dv_id", "wb_id", F.col("ref").alias("name")).join(
        names.select("wb_id", "name", "ref_sheet", F.regexp_replace("ref", r"\$", "").alias("ref")), ["wb_id", "name"]
    )
    src = direct.unionByName(named.select("dv_id", "wb_id", "ref_sheet", "ref"))
    src = src.select("dv_id", "wb_id", F.col("ref_sheet").alias("sheet"), rg.rect_columns(rg.parse_a1(F.col("ref"))))
    text = as_rects(nonempty_cells(cells))
    hits = overlap_join(text, src, KEYS, points=True, levels=src).select("dv_id", "row", "col", "text")
    hits = top_rows(hits, ["dv_id"], ["row", "col"], read)
    looked = hits.groupBy("dv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda s: s["text"]).alias("options")
    )
    opts = inline.unionByName(looked).dropDuplicates(["dv_id"]).filter(F.size("options") > 0)
    targets = v.select(*KEYS, "dv_id", "formula1", F.explode(F.split(strip(F.col("sqref")), r"\s+")).alias("target_range"))
    return targets.join(opts, "dv_id").select(*KEYS, "target_range", shorter(F.col("options"), keep).alias("options"), "formula1")


def dropdown_for_focus(constraints: DataFrame, focus: DataFrame, n: int | None = None) -> DataFrame:
    """Constraints whose target meets the sheet's focus range. focus: keys, region_id, rect."""
    c = constraints.select(*KEYS, "target_range", "options", rg.rect_columns(rg.parse_a1(F.col("target_range"))))
    hit = overlap_join(c, focus.select(*KEYS, "region_id", *RECT), KEYS, levels=focus)
    hit = hit.select(*KEYS, "region_id", "target_range", "options", "r0", "c0")
    return top_rows(hit, [*KEYS, "region_id"], ["r0", "c0", "target_range"], n).drop("r0", "c0")
