"""Page geometry and slots derived from events and form lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.operators import grid as g
from formloom.operators import layout as lay
from formloom.operators import tables as tb
from formloom.plans.queries_grid import Q_ANCHOR, Q_PLACED, Q_POINTS, Q_SNAP6, points, q_edges
from formloom.plans.registry import query

ELEM = """SELECT CAST(user_id AS BIGINT) AS doc_id, CAST(event_id % 3 AS INT) AS page, CAST(event_id % 2 AS INT) AS table_idx, CAST(event_id AS BIGINT) AS item_id, event_type AS text, CAST(event_id % 100 AS DOUBLE) / 100 AS score,
 CASE WHEN event_id % 5 < 3 THEN 'table_cell' ELSE 'layout_block' END AS kind, CAST((event_id * 37) % 800 AS DOUBLE) + 0.5 AS x0, CAST((event_id * 53) % 1000 AS DOUBLE) AS y0,
 CAST((event_id * 37) % 800 + 20 + event_id % 60 AS DOUBLE) AS x1, CAST((event_id * 53) % 1000 + 8 + event_id % 20 AS DOUBLE) + 0.25 AS y1 FROM {events}"""
Q_ELEM = "(" + ELEM.format(events="events") + ")"


def elements(t):
    d = t.sql(ELEM)
    return d.select("doc_id", "page", "table_idx", "item_id", "text", "score", "kind", F.struct("x0", "y0", "x1", "y1").alias("bbox"))


@query("g1_normalize_bbox", f"SELECT item_id, x0, y0, x1, y1 FROM {Q_ELEM} WHERE item_id % 3 < 2")
def _(t):
    b = F.col("bbox")
    k = F.col("item_id") % 3
    v = F.when(k == 0, F.array(F.array(b.x1, b.y0, b.x0, b.y1))).when(k == 1, F.array(F.array(b.x0, b.y1), F.array(b.x1, b.y0), F.array(b.x1, b.y1))).otherwise(F.array(F.array(b.x0)))
    d = elements(t).select("item_id", lay.normalize_bbox(v).alias("n")).filter("n is not null")
    return d.select("item_id", "n.*")


CELL_BOX = "(SELECT CAST(user_id AS BIGINT) AS doc_id, CAST(event_id % 3 AS INT) AS page, CAST(event_id % 2 AS INT) AS table_idx, CAST(event_id AS BIGINT) AS cell_idx, CAST((event_id * 29) % 760 AS DOUBLE) AS x0, CAST((event_id * 31) % 950 AS DOUBLE) AS y0, CAST((event_id * 29) % 760 + 150 AS DOUBLE) AS x1, CAST((event_id * 31) % 950 + 60 AS DOUBLE) AS y1 FROM {events})"


def cell_boxes(t):
    d = t.sql("SELECT * FROM " + CELL_BOX)
    return d.select("doc_id", "page", "table_idx", "cell_idx", F.struct("x0", "y0", "x1", "y1").alias("bbox"))


INTER = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0)))"
CENTRE = "((a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1)"
Q_MATCH = f"(SELECT a.doc_id, a.page, a.table_idx, b.cell_idx, a.item_id, a.score FROM {Q_ELEM} a JOIN {CELL_BOX.format(events='events')} b USING (doc_id, page, table_idx) WHERE {CENTRE} OR {INTER} >= 0.5)"


@query("g2_overlap_and_centre", f"SELECT a.item_id, round({INTER}, 6) AS ratio, {CENTRE} AS centre FROM {Q_ELEM} a JOIN {CELL_BOX.format(events='events')} b ON a.item_id = b.cell_idx")
def _(t):
    d = elements(t).join(cell_boxes(t).select(F.col("cell_idx").alias("item_id"), F.col("bbox").alias("cell")), "item_id")
    return d.select("item_id", F.round(lay.overlap_ratio(F.col("bbox"), F.col("cell")), 6).alias("ratio"), lay.center_in(F.col("bbox"), F.col("cell")).alias("centre"))


@query(
    "g3_assign_text_to_cells",
    f"""SELECT c.doc_id, c.page, c.table_idx, 'table_cell' AS kind, c.cell_idx AS elem_id, coalesce(max(m.score), 1.0) AS score FROM {CELL_BOX.format(events='events')} c LEFT JOIN {Q_MATCH} m USING (doc_id, page, table_idx, cell_idx) GROUP BY 1, 2, 3, 5
      UNION ALL SELECT doc_id, page, table_idx, 'table_text_fallback', item_id, score FROM {Q_ELEM} e WHERE NOT EXISTS (SELECT 1 FROM {Q_MATCH} m WHERE m.item_id = e.item_id)""",
)
def _(t):
    return lay.assign_text_to_cells(elements(t), cell_boxes(t)).select(*lay.TABLE, "kind", "elem_id", "score")


def q_texts(src: str, by: str) -> str:
    """Item by item: the sum and number of the line's centres; then lines from left to right. ``src``: by, item_id, text and the box."""
    same = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in by.split(","))
    here = "abs(e.cy - v.total / v.n) <= e.tol"
    return f"""(WITH RECURSIVE e AS (SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 AS h, greatest(8.0, 0.6 * median(greatest(1.0, y1 - y0)) OVER (PARTITION BY {by})) AS tol,
    row_number() OVER (PARTITION BY {by} ORDER BY y0, x0, item_id) AS i FROM {src}),
  v AS (SELECT {by}, i, cy AS total, 1 AS n, 1 AS line FROM e WHERE i = 1
    UNION ALL SELECT {', '.join('e.' + k.strip() for k in by.split(','))}, e.i, CASE WHEN {here} THEN v.total + e.cy ELSE e.cy END, CASE WHEN {here} THEN v.n + 1 ELSE 1 END, CASE WHEN {here} THEN v.line ELSE v.line + 1 END
      FROM v JOIN e ON {same('e', 'v')} AND e.i = v.i + 1),
  l AS (SELECT e.*, v.line FROM e JOIN v USING ({by}, i)),
  g AS (SELECT *, coalesce(x0 - lag(x1) OVER w > greatest(4.0, 0.35 * least(lag(h) OVER w, h)), FALSE) AS gap FROM l WINDOW w AS (PARTITION BY {by}, line ORDER BY x0, y0, item_id)),
  s AS (SELECT {by}, line, trim(string_agg(CASE WHEN gap THEN ' ' ELSE '' END || text, '' ORDER BY x0, y0, item_id)) AS s FROM g GROUP BY ALL)
  SELECT {by}, coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (s <> ''), '') AS text FROM s GROUP BY ALL)"""


Q_CELL_ITEMS = f"(SELECT m.cell_idx, e.* FROM {Q_MATCH} m JOIN {Q_ELEM} e USING (doc_id, page, table_idx, item_id))"


@query(
    "g3_cell_texts",
    f"""SELECT c.doc_id, c.page, c.table_idx, c.cell_idx AS elem_id, coalesce(x.text, '') AS text FROM {CELL_BOX.format(events='events')} c
      LEFT JOIN {q_texts(Q_CELL_ITEMS, 'doc_id, page, table_idx, cell_idx')} x USING (doc_id, page, table_idx, cell_idx)""",
)
def _(t):
    return lay.assign_text_to_cells(elements(t), cell_boxes(t)).where("kind = 'table_cell'").select(*lay.TABLE, "elem_id", "text")


@query("g4_join_texts_by_layout", f"SELECT doc_id, page, table_idx, text FROM {q_texts(Q_ELEM, 'doc_id, page, table_idx')}")
def _(t):
    return lay.join_texts(elements(t), lay.TABLE)


def q_cluster(src: str, by: str, tol: str) -> str:
    return f"""(SELECT {by}, CAST(k AS INT) AS edge_idx, avg(v) AS pos FROM (SELECT *, sum(CASE WHEN gap > {tol} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY v ROWS UNBOUNDED PRECEDING) AS k FROM (
      SELECT *, v - lag(v) OVER (PARTITION BY {by} ORDER BY v) AS gap FROM {src})) GROUP BY ALL)"""


@query("g5_cluster_positions", f"SELECT s_nationkey, edge_idx, round(pos, 6) AS pos FROM {q_cluster('(SELECT s_nationkey, s_acctbal AS v FROM supplier)', 's_nationkey', '900')}")
def _(t):
    d = lay.cluster_positions(t.supplier.select("s_nationkey", F.col("s_acctbal").alias("v")), ["s_nationkey"], 900.0)
    return d.withColumn("pos", F.round("pos", 6))


@query("g5_cluster_one_group", f"SELECT a AS grp, edge_idx, round(pos, 6) AS pos FROM {q_cluster('(SELECT 1 AS a, c_acctbal AS v FROM customer)', 'a', '10')}")
def _(t):
    d = lay.cluster_positions(t.customer.select(F.lit(1).alias("grp"), F.col("c_acctbal").alias("v")), ["grp"], 10.0, width=512.0)
    return d.withColumn("pos", F.round("pos", 6))


Q_GRID = f"""(WITH e AS (SELECT *, CASE WHEN kind = 'table_cell' THEN 'table' ELSE 'layout' END AS cls FROM {Q_ELEM}), m AS (SELECT doc_id, page, cls, median(greatest(1, x1 - x0)) AS mw, median(greatest(1, y1 - y0)) AS mh FROM e GROUP BY 1, 2, 3),
  v AS (SELECT doc_id, page, cls, unnest(['x', 'x', 'y', 'y']) AS axis, unnest([x0, x1, y0, y1]) AS v FROM e),
  t AS (SELECT v.*, CASE WHEN cls = 'table' THEN CASE WHEN axis = 'x' THEN greatest(1.5, least(6, mw * 0.04)) ELSE greatest(1.5, least(6, mh * 0.08)) END ELSE CASE WHEN axis = 'x' THEN greatest(4, least(24, mw * 0.1)) ELSE greatest(4, least(24, mh * 0.3)) END END AS tol FROM v JOIN m USING (doc_id, page, cls)),
  c AS {q_cluster('t', 'doc_id, page, cls, axis', 'tol').replace('SELECT *, v - lag', 'SELECT *, v - lag')},
  a AS (SELECT doc_id, page, axis, pos AS v FROM c UNION ALL SELECT doc_id, page, unnest(['x', 'y', 'x', 'y']), unnest([0.0, 0.0, 900.0, 1100.0]) FROM (SELECT DISTINCT doc_id, page FROM e)),
  h AS (SELECT DISTINCT doc_id, page FROM e WHERE cls = 'table'), b AS (SELECT a.*, CASE WHEN h.page IS NULL THEN 6.0 WHEN axis = 'x' THEN 2.0 ELSE 2.5 END AS tol FROM a LEFT JOIN h USING (doc_id, page))
  SELECT * FROM {q_cluster('b', 'doc_id, page, axis', 'tol')})"""


def page_edges(t):
    pages = elements(t).select("doc_id", "page").distinct().select("*", F.lit(900.0).alias("width"), F.lit(1100.0).alias("height"))
    return lay.grid_edges_from_elements(elements(t), pages)


@query("g6_grid_edges_from_elements", f"SELECT doc_id, page, axis, edge_idx, round(pos, 6) AS pos FROM {Q_GRID}")
def _(t):
    return page_edges(t).withColumn("pos", F.round("pos", 6))


@query(
    "g7_resolve_range",
    f"""WITH g AS (SELECT * FROM {Q_GRID}), p AS (SELECT doc_id, page, item_id, unnest(['x0', 'y0', 'x1', 'y1']) AS c, unnest(['x', 'y', 'x', 'y']) AS axis, unnest([x0, y0, x1, y1]) AS v FROM {Q_ELEM}),
      n AS (SELECT p.doc_id, p.page, p.item_id, c, arg_min(edge_idx, (round(abs(pos - v), 9), edge_idx)) + 1 AS e FROM p JOIN g USING (doc_id, page, axis) GROUP BY 1, 2, 3, 4),
      w AS (SELECT doc_id, page, item_id, max(e) FILTER (c = 'x0') AS a, max(e) FILTER (c = 'y0') AS b, max(e) FILTER (c = 'x1') AS d, max(e) FILTER (c = 'y1') AS f FROM n GROUP BY 1, 2, 3)
      SELECT doc_id, page, item_id AS box_id, least(b, f) AS r0, least(a, d) AS c0, greatest(b, f) AS r1, greatest(a, d) AS c1 FROM w""",
)
def _(t):
    return lay.resolve_range(elements(t).withColumnRenamed("item_id", "box_id"), page_edges(t))


@query(
    "g9_flow_blocks",
    f"""WITH b AS (SELECT *, item_id % 5 < 3 AS tab FROM {Q_ELEM}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, tab ORDER BY y0, x0, item_id) - 1 AS ti FROM b),
      h AS (SELECT *, CASE WHEN tab THEN CASE WHEN ti < 20 THEN ti % 4 + 2 ELSE 1 END ELSE 2 END AS height FROM o)
      SELECT doc_id, page, item_id AS block_id, CAST(sum(height) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, item_id) - height + 1 AS BIGINT) AS start_row FROM h""",
)
def _(t):
    b = elements(t).select(*lay.PAGE, F.col("item_id").alias("block_id"), F.when(F.col("kind") == "table_cell", "table_block").otherwise("text_block").alias("kind"), "bbox", "text")
    tabs = b.select(*lay.PAGE).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("table_idx")).select("*", (F.col("table_idx") % 4 + 1).alias("n_rows"), F.lit(3).alias("n_cols"))
    return lay.flow_blocks(b, tabs).select(*lay.PAGE, "block_id", F.col("start_row").cast("bigint").alias("start_row"))


SPANS = """SELECT CAST(user_id AS BIGINT) AS doc_id, 0 AS page, CAST(event_id % 2 AS INT) AS table_idx, CAST(event_id % 7 AS INT) AS "row", CAST(event_id AS BIGINT) AS cell_idx, CAST(1 + event_id % 3 AS INT) AS col_span, event_type AS text FROM {events}"""
Q_PLACE = f"(SELECT *, CAST(sum(col_span) OVER (PARTITION BY doc_id, table_idx, row ORDER BY cell_idx) - col_span + 1 AS INT) AS col FROM ({SPANS.format(events='events')}))"


def spans(t):
    return lay.place_colspans(t.sql(SPANS.replace('"row"', "row")))


@query("g10_place_colspans", f"SELECT doc_id, table_idx, row, cell_idx, col FROM {Q_PLACE}")
def _(t):
    return spans(t).select("doc_id", "table_idx", "row", "cell_idx", "col")


def span_cells(t):
    e = F.col("event_id")
    return t.events.select("user_id", (1 + e % 7).cast("int").alias("row"), e.alias("cell_idx"), F.col("event_type").alias("text"), (1 + e % 2).cast("int").alias("row_span"), (1 + e % 3).cast("int").alias("col_span"))


# Cell by cell: a list of what is taken, and the first column at or after the running one that no cell above covers.
Q_SPANS = """(WITH RECURSIVE c AS (SELECT user_id, 1 + event_id % 7 AS row, event_id, event_type AS text, 1 + event_id % 2 AS rs, 1 + event_id % 3 AS cs FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row, event_id) AS i FROM c),
  v AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS row, 1::BIGINT AS next, []::STRUCT(a BIGINT, b BIGINT, last BIGINT)[] AS busy, 0::BIGINT AS col FROM c
    UNION ALL SELECT user_id, i, row, k + cs, list_append(busy, {'a': k, 'b': k + cs - 1, 'last': row + rs - 1}), k FROM (
      SELECT *, list_filter(range(start, start + 3 * len(busy) + 1), lambda x: len(list_filter(busy, lambda o: x BETWEEN o.a AND o.b)) = 0)[1] AS k FROM (
        SELECT n.user_id, n.i, n.row, n.rs, n.cs, CASE WHEN v.row = n.row THEN v.next ELSE 1 END AS start, list_filter(v.busy, lambda o: o.last >= n.row) AS busy FROM v JOIN n ON n.user_id = v.user_id AND n.i = v.i + 1)))
  SELECT n.user_id, n.event_id, CAST(n.row AS INT) AS row, CAST(v.col AS INT) AS col, CAST(n.rs AS INT) AS row_span, CAST(n.cs AS INT) AS col_span, n.text FROM v JOIN n USING (user_id, i))"""


@query("g10_place_spans", f"SELECT user_id, row, col, row_span, col_span, text FROM {Q_SPANS}")
def _(t):
    return tb.place_spans(span_cells(t), ["user_id"]).select("user_id", "row", "col", "row_span", "col_span", "text")


@query("g10_table_merges", f"SELECT user_id, row AS r0, col AS c0, row + row_span - 1 AS r1, col + col_span - 1 AS c1 FROM {Q_SPANS} WHERE row_span > 1 OR col_span > 1")
def _(t):
    return tb.table_merges(tb.place_spans(span_cells(t), ["user_id"]), ["user_id"])


@query("g10_table_size", f"SELECT user_id, CAST(max(row + row_span - 1) AS INT) AS n_rows, CAST(max(col + col_span - 1) AS INT) AS n_cols FROM {Q_SPANS} GROUP BY 1")
def _(t):
    return tb.table_size(tb.place_spans(span_cells(t), ["user_id"]), ["user_id"])


@query(
    "g11_content_widths",
    f"""WITH w AS (SELECT doc_id, table_idx, unnest(generate_series(col, col + col_span - 1)) AS col, least(40.0, greatest(6.0, length(text) / col_span + 2.0)) AS est FROM {Q_PLACE}), m AS (SELECT doc_id, table_idx, col, max(est) AS est FROM w GROUP BY 1, 2, 3),
      n AS (SELECT doc_id, table_idx, unnest(generate_series(1, max(col + col_span - 1))) AS col FROM {Q_PLACE} GROUP BY 1, 2) SELECT doc_id, table_idx, CAST(col AS INT) AS col, round(greatest(8.0, coalesce(est, 8.0)), 6) AS content_width FROM n LEFT JOIN m USING (doc_id, table_idx, col)""",
)
def _(t):
    c = spans(t)
    n = c.groupBy(*lay.TABLE).agg(F.max(F.col("col") + F.col("col_span") - 1).alias("n_cols"))
    return lay.content_widths(c, n).select("doc_id", "table_idx", "col", F.round("content_width", 6).alias("content_width"))


@query(
    "g11_column_widths",
    f"""WITH v AS (SELECT doc_id, page, table_idx, unnest([x0, x1]) AS v FROM {CELL_BOX.format(events='events')}), e AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id, page, table_idx ORDER BY edge_idx) - pos AS span, count(*) OVER (PARTITION BY doc_id, page, table_idx) AS k FROM {q_cluster('v', 'doc_id, page, table_idx', '3.0')})
      SELECT doc_id, page, table_idx, edge_idx + 1 AS col, round(CASE WHEN k >= 6 THEN least(40.0, greatest(6.0, greatest(12.0, span) / 7.0)) ELSE 16.0 END, 6) AS width FROM e WHERE edge_idx < 5""",
)
def _(t):
    n = cell_boxes(t).select(*lay.TABLE).distinct().withColumn("n_cols", F.lit(5))
    return lay.column_widths(None, cell_boxes(t), n, mode="geometry").withColumn("width", F.round("width", 6))


Q_CONTENT_WIDTHS = f"""(WITH w AS (SELECT doc_id, table_idx, unnest(generate_series(col, col + col_span - 1)) AS col, least(40.0, greatest(6.0, length(text) / col_span + 2.0)) AS est FROM {Q_PLACE}), m AS (SELECT doc_id, table_idx, col, max(est) AS est FROM w GROUP BY 1, 2, 3),
  n AS (SELECT doc_id, table_idx, unnest(generate_series(1, max(col + col_span - 1))) AS col FROM {Q_PLACE} GROUP BY 1, 2) SELECT doc_id, table_idx, CAST(col AS INT) AS col, greatest(8.0, coalesce(est, 8.0)) AS content_width FROM n LEFT JOIN m USING (doc_id, table_idx, col))"""


@query(
    "g11_combined_widths",
    f"""WITH v AS (SELECT doc_id, table_idx, unnest([x0, x1]) AS v FROM {CELL_BOX.format(events='events')} WHERE page = 0),
      e AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id, table_idx ORDER BY edge_idx) - pos AS span, count(*) OVER (PARTITION BY doc_id, table_idx) AS k FROM {q_cluster('v', 'doc_id, table_idx', '3.0')}),
      c AS (SELECT *, max(col) OVER (PARTITION BY doc_id, table_idx) AS n_cols FROM {Q_CONTENT_WIDTHS})
      SELECT c.doc_id, c.table_idx, c.col, round(least(45.0, greatest(content_width, CASE WHEN e.k >= n_cols + 1 THEN least(40.0, greatest(6.0, greatest(12.0, span) / 7.0)) ELSE 16.0 END)), 6) AS width
      FROM c LEFT JOIN e ON e.doc_id = c.doc_id AND e.table_idx = c.table_idx AND e.edge_idx + 1 = c.col""",
)
def _(t):
    c = spans(t)
    n = c.groupBy(*lay.TABLE).agg(F.max(F.col("col") + F.col("col_span") - 1).alias("n_cols"))
    return lay.column_widths(c, cell_boxes(t), n).select("doc_id", "table_idx", "col", F.round("width", 6).alias("width"))


@query(
    "g12_page_elements",
    f"SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '[image]' WHEN item_id % 4 = 1 THEN text WHEN item_id % 4 = 2 THEN '[block]' ELSE text END AS text, CASE item_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'doc_title' WHEN 2 THEN 'plain' ELSE 'header' END AS style_class FROM {Q_ELEM}",
)
def _(t):
    k = (F.col("item_id") % 4).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Figure_1", "doc_title", "", "page_header")]), k + 1)
    b = elements(t).withColumn("label", label).withColumn("text", F.when(k % 2 == 0, " ").otherwise(F.col("text")))
    none = b.select(*lay.PAGE, "kind", "bbox", "text").limit(0)
    # A block keeps its number as its left edge, so that the relation of all elements can be told apart.
    numbered = b.withColumn("bbox", F.struct(F.col("item_id").cast("double").alias("x0"), F.col("bbox.y0").alias("y0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1")))
    return lay.page_elements(numbered, none).select(F.col("bbox.x0").cast("long").alias("item_id"), "text", "style_class")


@query(
    "g12_table_elements",
    f"""SELECT doc_id, page, kind, CASE WHEN kind = 'table_cell' THEN 'table' ELSE 'plain' END AS style_class, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
      FROM (SELECT doc_id, page, CASE WHEN item_id % 2 = 0 THEN 'table_cell' ELSE 'table_text_fallback' END AS kind, text FROM {Q_ELEM}) GROUP BY 1, 2, 3
      UNION ALL SELECT doc_id, page, 'layout_block', 'body', count(*), CAST(sum(length(text)) AS BIGINT) FROM {Q_ELEM} WHERE item_id % 3 > 0 GROUP BY 1, 2""",
)
def _(t):
    e = elements(t)
    blocks = e.withColumn("label", F.when(F.col("item_id") % 3 == 0, "table").otherwise("Paragraph"))
    cells = e.withColumn("kind", F.when(F.col("item_id") % 2 == 0, "table_cell").otherwise("table_text_fallback"))
    d = lay.page_elements(blocks, cells).groupBy(*lay.PAGE, "kind", "style_class")
    return d.agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    "g13_blocks_report",
    f"""SELECT doc_id, page, item_id AS block_id, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, item_id) AS INT) AS "order", kind AS label, text,
      x0 || '|' || y0 || '|' || x1 || '|' || y1 AS box FROM {Q_ELEM}""",
)
def _(t):
    b = elements(t).withColumnRenamed("item_id", "block_id").withColumn("label", F.col("kind"))
    box = F.from_json("bbox", lay.BOX)
    return lay.blocks_report(b).select(*lay.PAGE, "block_id", "order", "label", "text", F.concat_ws("|", *[box[c].cast("string") for c in ("x0", "y0", "x1", "y1")]).alias("box"))


@query("g13_meta_report", "SELECT page_id AS doc_id, unnest(['url', 'size']) AS field, unnest([url, CAST(length(html) AS VARCHAR)]) AS value FROM pages")
def _(t):
    p = t.pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page"), "url", F.length("html").alias("size"))
    return lay.meta_report(p, ["url", "size"]).drop("page")


@query("g14_filter_slots_by_area", "SELECT wb_id, sheet, slot FROM (SELECT *, median(area) OVER (PARTITION BY wb_id) AS m FROM (SELECT CAST(o AS VARCHAR) AS wb_id, 'S1' AS sheet, ln AS slot, CAST(p % 900 AS DOUBLE) AS area FROM <<li>>)) WHERE area >= greatest(200, 0.3 * m)")
def _(t):
    s = t.li.select(F.col("o").cast("string").alias("wb_id"), F.lit("S1").alias("sheet"), F.col("ln").alias("slot"), (F.col("p") % 900).cast("double").alias("area_px"))
    return lay.filter_slots_by_area(s).drop("area_px")


RUNS = "SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, CAST(ln * 14 + k AS DOUBLE) AS y, CAST(p % 150 AS DOUBLE) AS x0, CAST(p % 150 + 20 + s % 90 AS DOUBLE) AS x1 FROM {li} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(k)"


@query(
    "g15_slots_from_mask",
    f"""WITH r AS ({RUNS.replace('{li}', '<<li>>')}), e AS (SELECT * FROM {q_edges()}), a AS (SELECT r.*, y.idx AS row, y.edge0 AS y0, y.edge1 AS y1 FROM r JOIN e y ON y.wb_id = r.wb_id AND y.axis = 'row' AND y.edge0 <= r.y AND r.y < y.edge1),
      n AS (SELECT a.wb_id, a.row, c.idx AS col, a.y0, a.y1, c.edge0 AS cx0, c.edge1 AS cx1, sum(least(a.x1, c.edge1) - greatest(a.x0, c.edge0)) AS n_px FROM a JOIN e c ON c.wb_id = a.wb_id AND c.axis = 'col' AND greatest(a.x0, c.edge0) < least(a.x1, c.edge1) GROUP BY ALL),
      f AS (SELECT *, (cx1 - cx0) * (y1 - y0) AS area FROM n), k AS (SELECT * FROM f WHERE n_px >= 200 AND n_px >= area * 0.1), m AS (SELECT *, median(area) OVER (PARTITION BY wb_id) AS med FROM k)
      SELECT wb_id, 'S1' AS sheet, row, col, CAST(row_number() OVER (PARTITION BY wb_id ORDER BY y0, cx0, row, col) - 1 AS INT) AS slot_id FROM m WHERE area >= greatest(200, 0.3 * med)""",
)
def _(t):
    from formloom.plans.fixtures import LI

    return lay.slots_from_mask(t.sql(RUNS.replace("{li}", LI)), g.grid_edges(t.dims)).select(*g.KEYS, "row", "col", "slot_id")


Q_COMP = f"(SELECT *, CAST(wb_id AS VARCHAR) || '/' || CAST(ord % 2 AS VARCHAR) AS comp_id FROM {Q_PLACED})"


@query(
    "g16_slots_from_components",
    f"""WITH e AS (SELECT * FROM {q_edges()}), pts AS (SELECT * FROM {Q_COMP}), snap AS (SELECT * FROM {Q_SNAP6}),
     cand AS (SELECT c.comp_id, s.wb_id, coalesce(m.r0, s_row) AS r0, coalesce(m.c0, s_col) AS c0, coalesce(m.r1, s_row) AS r1, coalesce(m.c1, s_col) AS c1, min(s.ord) AS ord
       FROM snap s JOIN pts c USING (wb_id, ord) LEFT JOIN {Q_ANCHOR} m ON m.wb_id = s.wb_id AND m.row = s_row AND m.col = s_col GROUP BY 1, 2, 3, 4, 5, 6),
     mid AS (SELECT c.*, (e1.edge0 + e2.edge1) / 2 AS cy, (e3.edge0 + e4.edge1) / 2 AS cx FROM cand c
       JOIN e e1 ON e1.wb_id = c.wb_id AND e1.axis = 'row' AND e1.idx = c.r0 JOIN e e2 ON e2.wb_id = c.wb_id AND e2.axis = 'row' AND e2.idx = c.r1
       JOIN e e3 ON e3.wb_id = c.wb_id AND e3.axis = 'col' AND e3.idx = c.c0 JOIN e e4 ON e4.wb_id = c.wb_id AND e4.axis = 'col' AND e4.idx = c.c1),
     cost AS (SELECT m.comp_id, m.wb_id, m.r0, m.c0, m.ord, round(sum((m.cx - p.x) * (m.cx - p.x) + (m.cy - p.y) * (m.cy - p.y)), 6) AS cost FROM mid m JOIN pts p USING (comp_id) GROUP BY 1, 2, 3, 4, 5),
     best AS (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY cost, ord) AS rn FROM cost),
     span AS (SELECT comp_id, wb_id, min(row) AS r0, min(col) AS c0, max(row) AS r1, max(col) AS c1 FROM pts GROUP BY 1, 2)
     SELECT s.comp_id, s.wb_id, 'S1' AS sheet, s.r0, s.c0, s.r1, s.c1, b.r0 AS row, b.c0 AS col FROM span s JOIN best b ON b.comp_id = s.comp_id AND rn = 1""",
)
def _(t):
    p = points(t).withColumn("comp_id", F.concat_ws("/", "wb_id", (F.col("ord") % 2).cast("string")))
    return lay.slots_from_components(p, g.interesting_points(t.cells_t), t.merges, g.grid_edges(t.dims))


Q_SLOTS = "(SELECT CAST(o AS VARCHAR) AS wb_id, ln, CAST(ln // 3 AS INT) AS chunk, p % 250 AS x0, s * 3 % 180 AS y0, p % 250 + 30 AS x1, s * 3 % 180 + 10 AS y1, q FROM <<li>>)"
Q_CROPS = f"""(SELECT wb_id, chunk, a AS x0, b AS y0, greatest(a + 1, least(200, x + 20)) AS x1, greatest(b + 1, least(160, y + 20)) AS y1 FROM (
  SELECT wb_id, chunk, greatest(0, least(199, min(x0) - 20)) AS a, greatest(0, least(159, min(y0) - 20)) AS b, max(x1) AS x, max(y1) AS y FROM {Q_SLOTS} GROUP BY 1, 2))"""


def slots(t):
    d = t.li.select(F.col("o").cast("string").alias("wb_id"), F.lit("S1").alias("sheet"), F.col("ln").alias("slot_id"), (F.col("p") % 250).alias("x0"), (F.col("s") * 3 % 180).alias("y0"), "q")
    d = lay.chunk_slots(d.withColumn("x1", F.col("x0") + 30).withColumn("y1", F.col("y0") + 10), 3)
    sizes = d.select(*g.KEYS).distinct().select("*", F.lit(200).alias("width"), F.lit(160).alias("height"))
    return d, lay.crop_union(d, sizes)


@query("g17_chunk_and_crop", f"SELECT wb_id, 'S1' AS sheet, chunk, x0, y0, x1, y1 FROM {Q_CROPS}")
def _(t):
    return slots(t)[1]


@query(
    "g17_slots_in_crops",
    f"SELECT wb_id, 'S1' AS sheet, ln AS slot_id, s.x0 - c.x0 AS x0, s.y0 - c.y0 AS y0, s.x1 - c.x0 AS x1, s.y1 - c.y0 AS y1 FROM {Q_SLOTS} s JOIN {Q_CROPS} c USING (wb_id, chunk)",
)
def _(t):
    return lay.slots_in_crops(*slots(t)).drop("chunk", "q")


@query(
    "h12_chunk_summary",
    f"""SELECT wb_id, 'S1' AS sheet, chunk, count(*) AS slot_count, string_agg(ln, ',' ORDER BY ln) AS slot_ids, max(c.x0 || ',' || c.y0 || ',' || c.x1 || ',' || c.y1) AS crop, count(*) FILTER (q % 2 = 0) AS pair_count
      FROM {Q_SLOTS} s JOIN {Q_CROPS} c USING (wb_id, chunk) GROUP BY 1, 3""",
)
def _(t):
    d, crops = slots(t)
    joined = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n)
    return lay.chunk_summary(d, crops, d.where("q % 2 = 0")).select(*g.KEYS, "chunk", "slot_count", joined("slot_ids"), joined("crop"), "pair_count")
