"""Worksheet structure over the derived sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.operators import grid as g
from formloom.plans.registry import q_cell, q_hit, query

K = "wb_id, sheet"
CONTENT = "(value IS NOT NULL AND trim(value) <> '')"
Q_ANCHOR = """(SELECT m.wb_id, m.sheet, CAST(r AS INT) AS row, CAST(c AS INT) AS col, m.r0, m.c0, m.r1, m.c1
  FROM <<merges>> m, range(m.r0, m.r1 + 1) AS x(r), range(m.c0, m.c1 + 1) AS y(c))"""
Q_COVER = f"""(SELECT coalesce(a.wb_id, b.wb_id) AS wb_id, coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.row, b.row) AS row,
  coalesce(a.col, b.col) AS col, border_top, border_bottom, border_left, border_right, b.r0 IS NOT NULL AS is_merged,
  coalesce(b.r0, a.row) AS a_row, coalesce(b.c0, a.col) AS a_col
  FROM <<cells_t>> a FULL JOIN {Q_ANCHOR} b ON a.wb_id = b.wb_id AND a.sheet = b.sheet AND a.row = b.row AND a.col = b.col)"""
Q_CAND = f"(SELECT DISTINCT wb_id, sheet, a_row AS row, a_col AS col FROM {Q_COVER} WHERE border_bottom IS NOT NULL OR is_merged)"
Q_TYPED = f"""(SELECT wb_id, sheet, row, col, kind FROM (SELECT *, CASE WHEN border_top IS NOT NULL AND border_bottom IS NOT NULL
  AND border_left IS NOT NULL AND border_right IS NOT NULL THEN 'boxed' WHEN border_bottom IS NOT NULL THEN 'bottom_line'
  WHEN is_merged AND row = a_row AND col = a_col THEN 'merged_anchor' END AS kind FROM {Q_COVER}) WHERE kind IS NOT NULL)"""
Q_LABELS = "(SELECT wb_id, sheet, row, col, trim(value) AS text FROM <<cells_t>> WHERE value_type = 's' AND trim(value) <> '')"
Q_USED = f"""(SELECT wb_id, sheet, min(r0) AS r0, min(c0) AS c0, max(r1) AS r1, max(c1) AS c1 FROM (
  SELECT wb_id, sheet, row AS r0, col AS c0, row AS r1, col AS c1 FROM <<cells_t>> WHERE {CONTENT} OR border_top IS NOT NULL
   OR border_bottom IS NOT NULL OR border_left IS NOT NULL OR border_right IS NOT NULL OR fill_type IS NOT NULL
  UNION ALL SELECT wb_id, sheet, r0, c0, r1, c1 FROM <<merges>>) GROUP BY 1, 2)"""
# Value cells of the fixture are B<r> or B<r>:C<r>.
Q_PAIR_RECTS = """(SELECT *, CAST(regexp_extract(value_cell, '([0-9]+)', 1) AS INT) AS r0, 2 AS c0,
  CAST(regexp_extract(value_cell, '([0-9]+)', 1) AS INT) AS r1, CASE WHEN value_cell LIKE '%:%' THEN 3 ELSE 2 END AS c1 FROM <<pairs>>)"""
Q_FORM = f"""(SELECT u.wb_id, u.sheet, CASE WHEN f.r0 IS NULL THEN u.r0 ELSE greatest(u.r0, f.r0 - 2) END AS r0,
  CASE WHEN f.r0 IS NULL THEN u.c0 ELSE greatest(u.c0, f.c0 - 8) END AS c0,
  CASE WHEN f.r0 IS NULL THEN u.r1 ELSE least(u.r1, f.r1 + 2) END AS r1,
  CASE WHEN f.r0 IS NULL THEN u.c1 ELSE least(u.c1, f.c1 + 2) END AS c1 FROM {Q_USED} u LEFT JOIN
  (SELECT wb_id, sheet, min(r0) AS r0, min(c0) AS c0, max(r1) AS r1, max(c1) AS c1 FROM {Q_PAIR_RECTS} GROUP BY 1, 2) f USING (wb_id, sheet))"""


@query("c1_used_bbox", f"SELECT * FROM {Q_USED}")
def _(t):
    return g.used_bbox(t.cells_t, t.merges)


@query("c2_form_bbox", f"SELECT * FROM {Q_FORM}")
def _(t):
    return g.form_bbox(t.pairs, g.used_bbox(t.cells_t, t.merges))


@query("c3_anchor_map", f"SELECT * FROM {Q_ANCHOR}")
def _(t):
    return g.anchor_map(t.merges)


@query(
    "c4_border_tags",
    """SELECT wb_id, sheet, row, col, (CASE WHEN border_top IS NOT NULL THEN 'T' ELSE '' END || CASE WHEN border_bottom IS NOT NULL THEN 'B' ELSE '' END
     || CASE WHEN border_left IS NOT NULL THEN 'L' ELSE '' END || CASE WHEN border_right IS NOT NULL THEN 'R' ELSE '' END) AS tags FROM <<cells_t>>""",
)
def _(t):
    return t.cells_t.select(*g.POS, F.array_join(g.border_tags(), "").alias("tags"))


@query("c5_input_candidates", f"SELECT * FROM {Q_CAND}")
def _(t):
    return g.input_candidates(t.cells_t, t.merges)


@query("c5_typed_candidates", f"SELECT * FROM {Q_TYPED}")
def _(t):
    return g.typed_candidates(t.cells_t, t.merges)


@query("c6_labels", f"SELECT * FROM {Q_LABELS}")
def _(t):
    return g.labels(t.cells_t)


@query(
    "c7_static_template_cells",
    f"SELECT wb_id, sheet, row, col, value FROM <<cells_t>> a WHERE {CONTENT} AND NOT EXISTS (SELECT 1 FROM {Q_CAND} b"
    " WHERE a.wb_id = b.wb_id AND a.sheet = b.sheet AND a.row = b.row AND a.col = b.col)",
)
def _(t):
    return g.static_template_cells(t.cells_t, t.merges)


@query(
    "c7_static_labels",
    f"SELECT * FROM {Q_LABELS} a WHERE NOT EXISTS (SELECT 1 FROM {Q_TYPED} b WHERE a.wb_id = b.wb_id AND a.sheet = b.sheet AND a.row = b.row AND a.col = b.col)",
)
def _(t):
    return g.static_labels(t.cells_t, t.merges)


@query(
    "c8_scan_structure",
    f"""SELECT wb_id, sheet, r0, c0, r1, c1, coalesce(nm, 0) AS n_merges, coalesce(nl, 0) AS n_labels, coalesce(nc, 0) AS n_candidates, coalesce(nb, 0) AS n_boxed
     FROM {Q_USED} LEFT JOIN (SELECT wb_id, sheet, count(*) AS nm FROM <<merges>> GROUP BY 1, 2) USING (wb_id, sheet)
     LEFT JOIN (SELECT wb_id, sheet, count(*) AS nl FROM {Q_LABELS} GROUP BY 1, 2) USING (wb_id, sheet)
     LEFT JOIN (SELECT wb_id, sheet, count(*) AS nc FROM {Q_TYPED} GROUP BY 1, 2) USING (wb_id, sheet)
     LEFT JOIN (SELECT wb_id, sheet, count(*) AS nb FROM <<cells_t>> WHERE border_top IS NOT NULL AND border_bottom IS NOT NULL AND border_left IS NOT NULL
       AND border_right IS NOT NULL GROUP BY 1, 2) USING (wb_id, sheet)""",
)
def _(t):
    s = g.scan_structure(t.cells_t, t.merges)
    parts = [
        s[n].select(*g.KEYS, *[F.lit(1 if c == out else 0).alias(c) for c in ("n_merges", "n_labels", "n_candidates", "n_boxed")])
        for n, out in (("merged_ranges", "n_merges"), ("labels", "n_labels"), ("candidates", "n_candidates"), ("boxed", "n_boxed"))
    ]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy(*g.KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n_merges", "n_labels", "n_candidates", "n_boxed")]
    )
    return s["bbox"].join(counts, g.KEYS, "left").na.fill(0)


@query(
    "c9_structure_preview",
    f"""SELECT wb_id, sheet, row, col, text FROM (SELECT wb_id, sheet, row, col, substring(text, 1, 6) AS text,
     row_number() OVER (PARTITION BY wb_id, sheet ORDER BY row, col) AS rn FROM {Q_LABELS}) WHERE rn <= 10""",
)
def _(t):
    return g.structure_preview(t.cells_t, n=10, width=6)


@query("c9_structure_preview_all", f"SELECT wb_id, sheet, row, col, text FROM {Q_LABELS}")
def _(t):
    return g.structure_preview(t.cells_t)


@query(
    "c10_nonempty_cells",
    f"""SELECT a.wb_id, a.sheet, a.row, a.col, trim(a.value) AS text FROM <<cells_f>> a JOIN {Q_FORM} b USING (wb_id, sheet)
     WHERE {CONTENT.replace('value', 'a.value')} AND a.row BETWEEN b.r0 AND b.r1 AND a.col BETWEEN b.c0 AND b.c1""",
)
def _(t):
    box = g.form_bbox(t.pairs, g.used_bbox(t.cells_t, t.merges))
    return g.nonempty_cells(t.cells_f, box)


Q_REGIONS = "(SELECT wb_id, sheet, ln AS region_id, 2 + ln % 3 AS r0, 1 AS c0, 4 + ln % 3 AS r1, 5 AS c1 FROM (SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, ln FROM <<li>>))"
REGIONS_SQL = "SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, ln AS region_id, 2 + ln % 3 AS r0, 1 AS c0, 4 + ln % 3 AS r1, 5 AS c1 FROM ({li})"


def regions(t):
    d = t.li
    return d.select(
        F.col("o").cast("string").alias("wb_id"), F.lit("S1").alias("sheet"), F.col("ln").alias("region_id"),
        (2 + F.col("ln") % 3).alias("r0"), F.lit(1).alias("c0"), (4 + F.col("ln") % 3).alias("r1"), F.lit(5).alias("c1"),
    )


@query(
    "c11_template_region_summary",
    f"""SELECT wb_id, sheet, region_id, row, col, text FROM (SELECT a.wb_id, a.sheet, region_id, row, col, trim(value) AS text,
     row_number() OVER (PARTITION BY a.wb_id, a.sheet, region_id ORDER BY row, col) AS rn FROM <<cells_t>> a JOIN {Q_REGIONS} b
     ON a.wb_id = b.wb_id AND a.sheet = b.sheet AND row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 WHERE {CONTENT}) WHERE rn <= 3""",
)
def _(t):
    return g.template_region_summary(regions(t), t.cells_t, 3)


@query(
    "c11_template_region_summary_all",
    f"""SELECT a.wb_id, a.sheet, region_id, row, col, trim(value) AS text FROM <<cells_t>> a JOIN {Q_REGIONS} b
     ON a.wb_id = b.wb_id AND a.sheet = b.sheet AND row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 WHERE {CONTENT}""",
)
def _(t):
    return g.template_region_summary(regions(t), t.cells_t)


Q_CURRENT = f"""(SELECT p.wb_id, p.sheet, p.pair_idx, p.key, p.value_cell, p.r0 AS a_row, 2 AS a_col, v.value AS current_value
  FROM {Q_PAIR_RECTS} p LEFT JOIN <<cells_f>> v ON p.wb_id = v.wb_id AND p.sheet = v.sheet AND v.row = p.r0 AND v.col = 2)"""


@query("c12_read_anchor_value", f"SELECT wb_id, sheet, pair_idx, key, value_cell, current_value FROM {Q_CURRENT}")
def _(t):
    d = g.read_anchor_value(t.pairs, t.cells_f, t.merges)
    return d.select(*g.KEYS, "pair_idx", "key", "value_cell", "current_value")


@query(
    "c13_read_range",
    f"""SELECT b.wb_id, b.sheet, region_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, a.value, a.value_type, a.style_key
     FROM {Q_REGIONS} b, range(b.r0, b.r1 + 1) AS x(r), range(b.c0, b.c1 + 1) AS y(c)
     LEFT JOIN <<cells_f>> a ON a.wb_id = b.wb_id AND a.sheet = b.sheet AND a.row = r AND a.col = c""".replace("FROM (SELECT wb_id", "FROM (SELECT wb_id"),
)
def _(t):
    return g.read_range(regions(t), t.cells_f)


@query(
    "c14_style_summary",
    """SELECT p_partkey, '{' || array_to_string(list_filter([CASE WHEN fn <> 'Calibri' THEN '"font_name":"' || fn || '"' END,
      CASE WHEN fs <> '11' THEN '"font_size":"' || fs || '"' END, CASE WHEN p_partkey % 4 <> 0 THEN '"number_format":"0.00"' END,
      CASE WHEN p_partkey % 7 = 0 THEN '"colour":"theme:' || (p_partkey % 3) || ':0.5"' WHEN p_partkey % 7 = 1 THEN '"colour":"indexed:9"'
      ELSE '"colour":"FF' || p_size || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS style_json
      FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'Calibri' ELSE p_brand END AS fn, CAST(9 + p_size % 4 AS VARCHAR) AS fs FROM part)""",
)
def _(t):
    k = F.col("p_partkey")
    d = t.part.select(
        k,
        F.when(F.col("p_size") % 2 == 0, "Calibri").otherwise(F.col("p_brand")).alias("font_name"),
        (9 + F.col("p_size") % 4).alias("font_size"),
        F.when(k % 4 == 0, "General").otherwise("0.00").alias("number_format"),
        g.colour_token(
            F.when(k % 7 > 1, F.concat(F.lit("FF"), F.col("p_size").cast("string"))),
            F.when(k % 7 == 1, F.lit(9)),
            F.when(k % 7 == 0, k % 3),
            F.lit(0.5),
        ).alias("colour"),
    )
    return g.style_summary(d, ["font_name", "font_size", "number_format", "colour"]).select("p_partkey", "style_json")


Q_INTEREST = f"""(SELECT DISTINCT wb_id, sheet, row, col FROM (SELECT wb_id, sheet, row, col FROM <<cells_t>> WHERE value IS NOT NULL
  OR border_top IN ('thin', 'medium') OR border_bottom IN ('thin', 'medium') OR border_left IN ('thin', 'medium') OR border_right IN ('thin', 'medium')
  OR fill_rgb NOT IN ('00000000', 'FFFFFFFF', 'FF000000') UNION ALL SELECT wb_id, sheet, row, col FROM {Q_ANCHOR}))"""


@query("c15_interesting_cells", f"SELECT * FROM {Q_INTEREST}")
def _(t):
    return g.interesting_cells(t.cells_t, t.merges)


def q_edges(scale: str = "1.0") -> str:
    return f"""(SELECT wb_id, sheet, axis, idx, (e - px) * {scale} AS edge0, e * {scale} AS edge1 FROM (
      SELECT wb_id, sheet, axis, idx, px, sum(px) OVER (PARTITION BY wb_id, sheet, axis ORDER BY idx) AS e FROM (
      SELECT wb_id, sheet, axis, idx, CAST(round_even(CASE WHEN axis = 'col' THEN coalesce(size, 8.43) * 7 + 5 ELSE coalesce(size, 15.0) * 96 / 72 END, 0) AS INT) AS px FROM <<dims>>)))"""


@query("c16_grid_edges", f"SELECT wb_id, sheet, axis, idx, CAST(edge0 AS DOUBLE) AS edge0, CAST(edge1 AS DOUBLE) AS edge1 FROM {q_edges('0.5')}")
def _(t):
    return g.grid_edges(t.dims, scale=0.5)


Q_CLIP = "(SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, 1 AS r0, 1 AS c0, CAST(max(ln) AS INT) AS r1, 3 AS c1 FROM <<li>> GROUP BY o)"


@query(
    "c17_cell_boxes",
    f"""SELECT DISTINCT c.wb_id, c.sheet, c.r0, c.c0, c.r1, c.c1, CAST(e3.edge0 AS DOUBLE) AS x0, CAST(e1.edge0 AS DOUBLE) AS y0, CAST(e4.edge1 AS DOUBLE) AS x1, CAST(e2.edge1 AS DOUBLE) AS y1
     FROM (SELECT DISTINCT a.wb_id, a.sheet, greatest(coalesce(m.r0, a.row), b.r0) AS r0, greatest(coalesce(m.c0, a.col), b.c0) AS c0,
       least(coalesce(m.r1, a.row), b.r1) AS r1, least(coalesce(m.c1, a.col), b.c1) AS c1
       FROM <<cells_t>> a JOIN {Q_CLIP} b ON a.wb_id = b.wb_id AND a.row BETWEEN b.r0 AND b.r1 AND a.col BETWEEN b.c0 AND b.c1
       LEFT JOIN {Q_ANCHOR} m ON a.wb_id = m.wb_id AND a.row = m.row AND a.col = m.col) c
     JOIN {q_edges()} e1 ON e1.wb_id = c.wb_id AND e1.axis = 'row' AND e1.idx = c.r0 JOIN {q_edges()} e2 ON e2.wb_id = c.wb_id AND e2.axis = 'row' AND e2.idx = c.r1
     JOIN {q_edges()} e3 ON e3.wb_id = c.wb_id AND e3.axis = 'col' AND e3.idx = c.c0 JOIN {q_edges()} e4 ON e4.wb_id = c.wb_id AND e4.axis = 'col' AND e4.idx = c.c1""",
)
def _(t):
    box = t.li.groupBy(F.col("o").cast("string").alias("wb_id")).agg(F.max("ln").alias("r1")).select(
        "wb_id", F.lit("S1").alias("sheet"), F.lit(1).alias("r0"), F.lit(1).alias("c0"), "r1", F.lit(3).alias("c1")
    )
    return g.cell_boxes(t.cells_t, t.merges, g.grid_edges(t.dims), box)


def points(t):
    return t.li.select(
        F.col("o").cast("string").alias("wb_id"), F.lit("S1").alias("sheet"), F.col("ln").alias("ord"),
        (F.col("p") % 250 - 5).cast("double").alias("x"), (F.col("s") * 3 % 180 - 4).cast("double").alias("y"),
    )


Q_POINTS = "(SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, ln AS ord, CAST(p % 250 - 5 AS DOUBLE) AS x, CAST(s * 3 % 180 - 4 AS DOUBLE) AS y FROM <<li>>)"


def q_place(axis: str, v: str) -> str:
    return f"""(SELECT wb_id, ord, CASE WHEN min(idx) FILTER ({v} < edge1) IS NULL THEN max(idx) ELSE min(idx) FILTER ({v} < edge1) END AS i
      FROM {Q_POINTS} p JOIN {q_edges()} e USING (wb_id, sheet) WHERE axis = '{axis}' AND edge1 > edge0 GROUP BY 1, 2)"""


Q_PLACED = f"""(SELECT p.*, CAST(a.i AS INT) AS row, CAST(b.i AS INT) AS col FROM {Q_POINTS} p JOIN {q_place('row', 'y')} a USING (wb_id, ord) JOIN {q_place('col', 'x')} b USING (wb_id, ord))"""


@query("c18_point_to_cell", f"SELECT wb_id, sheet, ord, x, y, row, col FROM {Q_PLACED}")
def _(t):
    return g.point_to_cell(points(t), g.grid_edges(t.dims))


Q_RING = ", ".join(f"({r}, {c}, {i})" for r, c, i in g.ring_offsets(2))
Q_SNAP = f"""(SELECT p.*, coalesce(s.sr, p.row) AS s_row, coalesce(s.sc, p.col) AS s_col FROM {Q_PLACED} p LEFT JOIN (
  SELECT wb_id, ord, arg_min(i.row, k) AS sr, arg_min(i.col, k) AS sc FROM {Q_PLACED} q CROSS JOIN (VALUES {Q_RING}) f(dr, dc, k)
  JOIN {Q_INTEREST} i USING (wb_id, sheet) WHERE i.row = q.row + dr AND i.col = q.col + dc GROUP BY 1, 2) s USING (wb_id, ord))"""


@query("c19_snap_to_interesting", f"SELECT wb_id, sheet, ord, row, col, s_row, s_col FROM {Q_SNAP}")
def _(t):
    placed = g.point_to_cell(points(t), g.grid_edges(t.dims))
    return g.snap_to_interesting(placed, g.interesting_points(t.cells_t), 2, t.merges).select(*g.KEYS, "ord", "row", "col", "s_row", "s_col")


Q_SNAP6 = Q_SNAP.replace(Q_RING, ", ".join(f"({r}, {c}, {i})" for r, c, i in g.ring_offsets(6)))


@query(
    "c20_anchor_from_points",
    f"""WITH e AS (SELECT * FROM {q_edges()}), pts AS (SELECT * FROM {Q_POINTS}),
     cand AS (SELECT s.wb_id, coalesce(m.r0, s_row) AS r0, coalesce(m.c0, s_col) AS c0, coalesce(m.r1, s_row) AS r1, coalesce(m.c1, s_col) AS c1, min(ord) AS ord
       FROM {Q_SNAP6} s LEFT JOIN {Q_ANCHOR} m ON m.wb_id = s.wb_id AND m.row = s_row AND m.col = s_col GROUP BY 1, 2, 3, 4, 5),
     mid AS (SELECT c.*, (e1.edge0 + e2.edge1) / 2 AS cy, (e3.edge0 + e4.edge1) / 2 AS cx FROM cand c
       JOIN e e1 ON e1.wb_id = c.wb_id AND e1.axis = 'row' AND e1.idx = c.r0 JOIN e e2 ON e2.wb_id = c.wb_id AND e2.axis = 'row' AND e2.idx = c.r1
       JOIN e e3 ON e3.wb_id = c.wb_id AND e3.axis = 'col' AND e3.idx = c.c0 JOIN e e4 ON e4.wb_id = c.wb_id AND e4.axis = 'col' AND e4.idx = c.c1),
     cost AS (SELECT m.wb_id, m.r0, m.c0, m.ord, round(sum((m.cx - p.x) * (m.cx - p.x) + (m.cy - p.y) * (m.cy - p.y)), 6) AS cost FROM mid m JOIN pts p USING (wb_id) GROUP BY 1, 2, 3, 4)
     SELECT wb_id AS group_id, wb_id, 'S1' AS sheet, r0 AS row, c0 AS col FROM (SELECT *, row_number() OVER (PARTITION BY wb_id ORDER BY cost, ord) AS rn FROM cost) WHERE rn = 1""",
)
def _(t):
    p = points(t).withColumn("group_id", F.col("wb_id"))
    return g.anchor_from_points(p, g.interesting_points(t.cells_t), t.merges, g.grid_edges(t.dims), "group_id")


VALIDATIONS = """SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, 'B' || CAST(ln + 1 AS STRING) || ' E' || CAST(ln + 1 AS STRING) || ':F' || CAST(ln + 2 AS STRING) AS sqref,
 CASE WHEN p % 11 = 0 THEN 'whole' ELSE 'list' END AS type, CASE p % 4 WHEN 0 THEN '"yes, no ,,' || f || '"' WHEN 1 THEN '=$A$1:$A$' || CAST(ln + 2 AS STRING)
 WHEN 2 THEN 'S1!$D$2:$D$5' ELSE 'Notes' END AS formula1 FROM ({li})"""
NAMES = "SELECT DISTINCT CAST(o AS STRING) AS wb_id, 'Notes' AS name, 'S1' AS ref_sheet, '$F$2:$F$4' AS ref FROM ({li})"
Q_OPTIONS = f"""(WITH v AS (SELECT CAST(o AS VARCHAR) AS wb_id, ln, p % 4 AS kind, f, CASE p % 4 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 6 END AS oc,
    CASE p % 4 WHEN 1 THEN 1 ELSE 2 END AS ra, CASE p % 4 WHEN 1 THEN ln + 2 WHEN 2 THEN 5 ELSE 4 END AS rb FROM <<li>> WHERE p % 11 <> 0),
  o AS (SELECT wb_id, ln, 'yes|no|' || f AS options FROM v WHERE kind = 0 UNION ALL
    SELECT v.wb_id, ln, string_agg(trim(c.value), '|' ORDER BY c.row) FROM v JOIN <<cells_t>> c ON c.wb_id = v.wb_id AND c.col = v.oc AND c.row BETWEEN ra AND rb
    WHERE kind > 0 AND trim(c.value) <> '' GROUP BY 1, 2)
  SELECT wb_id, 'S1' AS sheet, unnest(['B' || (ln + 1), 'E' || (ln + 1) || ':F' || (ln + 2)]) AS target_range, ln, options FROM o)"""


def _constraints(t):
    from formloom.plans.fixtures import SQL

    return g.dropdown_constraints(t.sql(VALIDATIONS.replace("{li}", SQL["li"])), t.cells_t, t.sql(NAMES.replace("{li}", SQL["li"])))


@query("c21_dropdown_constraints", f"SELECT wb_id, sheet, target_range, options FROM {Q_OPTIONS}")
def _(t):
    return _constraints(t).select(*g.KEYS, "target_range", F.array_join("options", "|").alias("options"))


@query(
    "c22_dropdown_for_focus",
    f"""SELECT o.wb_id, o.sheet, region_id, target_range, options FROM {Q_OPTIONS} o JOIN {Q_REGIONS} b ON o.wb_id = b.wb_id
     AND b.r0 <= ln + CASE WHEN target_range LIKE 'E%' THEN 2 ELSE 1 END AND ln + 1 <= b.r1 AND (target_range LIKE 'B%' OR b.c1 >= 5)""",
)
def _(t):
    d = g.dropdown_for_focus(_constraints(t), regions(t))
    return d.select(*g.KEYS, "region_id", "target_range", F.array_join("options", "|").alias("options"))
