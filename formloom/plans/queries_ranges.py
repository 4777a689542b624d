"""Range algebra over range texts, rectangles and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.operators import spatial as sp
from formloom.plans.registry import q_cell, q_col, q_hit, q_range, query

KEYS = ["wb_id", "sheet"]

Q_PARSE = f"""
 SELECT *, least(ra, rb) AS r0, least(ca, cb) AS c0, greatest(ra, rb) AS r1, greatest(ca, cb) AS c1 FROM (
  SELECT *, {q_col('p1')} AS ca, TRY_CAST(p2 AS INT) AS ra,
    CASE WHEN p3 = '' THEN {q_col('p1')} ELSE {q_col('p3')} END AS cb,
    CASE WHEN p3 = '' THEN TRY_CAST(p2 AS INT) ELSE TRY_CAST(p4 AS INT) END AS rb FROM (
   SELECT *, regexp_extract(t, pat, 1) AS p1, regexp_extract(t, pat, 2) AS p2,
     regexp_extract(t, pat, 3) AS p3, regexp_extract(t, pat, 4) AS p4 FROM (
    SELECT *, '^([A-Z]{{1,3}})([0-9]{{1,7}})(?::([A-Z]{{1,3}})([0-9]{{1,7}}))?$' AS pat,
      upper(replace(trim(txt), ' ', '')) AS t FROM %s) WHERE regexp_matches(t, pat)))
 WHERE least(ra, rb) >= 1 AND greatest(ca, cb) <= 16384 AND greatest(ra, rb) <= 1048576"""


def q_parse(source: str) -> str:
    return Q_PARSE % source


@query("b1_a1_parse", f"SELECT event_id, r0, c0, r1, c1 FROM ({q_parse('<<range_texts>>')})")
def _(t):
    d = t.range_texts.select("event_id", rg.parse_a1(F.col("txt")).alias("x")).filter("x is not null")
    return d.select("event_id", "x.*")


@query("b2_a1_format", f"SELECT rect_id, {q_range('r0', 'c0 * 391', 'r1', 'c1 * 391')} AS a1 FROM <<rects>>")
def _(t):
    return t.rects.select("rect_id", rg.a1_range(F.col("r0"), F.col("c0") * 391, F.col("r1"), F.col("c1") * 391).alias("a1"))


@query("b3_coord", f"SELECT event_id, r0 AS row, c0 AS col FROM ({q_parse('<<range_texts>>')}) WHERE r0 = r1 AND c0 = c1")
def _(t):
    d = t.range_texts.select("event_id", rg.coord(F.col("txt")).alias("x")).filter("x is not null")
    return d.select("event_id", "x.row", "x.col")


@query(
    "b4_intersects",
    f"SELECT a.wb_id, a.probe_id, b.rect_id FROM <<probes>> a JOIN <<rects>> b ON a.wb_id = b.wb_id AND {q_hit('a', 'b')}",
)
def _(t):
    return sp.overlap_join(t.probes, t.rects, KEYS, levels=t.rects).select("wb_id", "probe_id", "rect_id")


@query(
    "b5_touches",
    f"SELECT a.wb_id, a.probe_id, count(*) AS n FROM <<probes>> a JOIN <<rects>> b ON a.wb_id = b.wb_id AND {q_hit('a', 'b', 1)} GROUP BY 1, 2",
)
def _(t):
    return sp.overlap_join(t.probes, t.rects, KEYS, grow=1, levels=t.rects).groupBy("wb_id", "probe_id").agg(F.count("*").alias("n"))


@query("b6_union_ranges", "SELECT wb_id, min(r0) AS r0, min(c0) AS c0, max(r1) AS r1, max(c1) AS c1 FROM <<rects>> GROUP BY 1")
def _(t):
    return t.rects.groupBy("wb_id").agg(*rg.bbox_agg())


Q_TOKENS = "(SELECT event_id, wb_id, unnest(string_split(txt, ',')) AS txt FROM <<range_lists>>)"
Q_CELLS = f"""SELECT event_id, wb_id, r AS row, c AS col FROM ({q_parse(Q_TOKENS)}),
  range(r0, r1 + 1) AS x(r), range(c0, c1 + 1) AS y(c)"""


def exploded(t):
    d = t.range_lists.select("event_id", "wb_id", F.explode(rg.parse_list(F.col("txt"))).alias("x"))
    return d.select("event_id", "wb_id", F.explode(rg.cells_of(F.col("x"))).alias("p")).select("event_id", "wb_id", "p.row", "p.col")


@query("b7_explode_cells", f"SELECT event_id, wb_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM ({Q_CELLS})")
def _(t):
    return exploded(t)


@query("b8_range_cells_set", f"SELECT DISTINCT wb_id, {q_cell('row', 'col')} AS cell FROM ({Q_CELLS})")
def _(t):
    return exploded(t).select("wb_id", rg.a1_cell(F.col("row"), F.col("col")).alias("cell")).distinct()


@query(
    "b9_expand_focus",
    """SELECT probe_id, CASE WHEN e THEN 10 ELSE n0 END AS r0, CASE WHEN e THEN 5 ELSE n1 END AS c0,
       CASE WHEN e THEN 60 ELSE n2 END AS r1, CASE WHEN e THEN 30 ELSE n3 END AS c1
       FROM (SELECT *, n0 > n2 OR n1 > n3 AS e FROM (SELECT probe_id, greatest(10, r0 - 1) AS n0, greatest(5, c0 - 2) AS n1,
       least(60, r1 + 1) AS n2, least(30, c1 + 2) AS n3 FROM <<probes>>))""",
)
def _(t):
    clip = tuple(F.lit(x) for x in (10, 5, 60, 30))
    rect = tuple(F.col(c) for c in sp.RECT)
    return t.probes.select("probe_id", rg.expand_focus(rect, clip, 2, 1, 2, 1).alias("x")).select("probe_id", "x.*")


MENTIONS = """SELECT conv_id, turn, text || ' see ' || CASE WHEN turn % 2 = 0 THEN 'b' ELSE 'AA' END || CAST(1 + turn AS STRING)
 || ', c' || CAST(4 + conv_id % 9 AS STRING) || ': A2 and B1' AS text FROM {conversations}"""


def q_mentions(src: str) -> str:
    hits = f"""SELECT id, i, regexp_replace(m, '\\s', '', 'g') AS txt FROM (SELECT id, unnest(h) AS m, generate_subscripts(h, 1) AS i
      FROM (SELECT id, regexp_extract_all(text, '([A-Za-z]{{1,4}}[0-9]{{1,7}}\\s*:\\s*[A-Za-z]{{1,4}}[0-9]{{1,7}}|[A-Za-z]{{1,4}}[0-9]{{1,7}})', 1) AS h FROM {src}))"""
    return f"""SELECT id, string_agg(a1, ',' ORDER BY i) AS found FROM (SELECT id, a1, min(i) AS i FROM (
      SELECT id, i, {q_range('r0', 'c0', 'r1', 'c1')} AS a1 FROM ({q_parse('(' + hits + ')')})) GROUP BY 1, 2) GROUP BY 1"""


Q_MENT = "(SELECT conv_id * 1000 + turn AS id, text FROM (" + MENTIONS.format(conversations="conversations") + "))"


@query("b11_extract_ranges", q_mentions(Q_MENT))
def _(t):
    d = t.sql(MENTIONS).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_join(rg.extract_ranges(F.col("text")), ",").alias("found"))
    return d.filter("found <> ''")


FOCUS = """SELECT conv_id * 1000 + turn AS id, CASE turn % 3
 WHEN 0 THEN '{{"bad_ranges": ["b' || CAST(1 + conv_id % 9 AS STRING) || '", "C2:D3"], "range": "B1", "note": "Z9"}}'
 WHEN 1 THEN '{{"note": "A' || CAST(1 + turn AS STRING) || '"}}' ELSE 'fix E5 and e5:e5 in row ' || CAST(conv_id AS STRING) END AS text FROM {conversations}"""


@query(
    "b12_extract_focus_ranges",
    """SELECT conv_id * 1000 + turn AS id, CASE turn % 3
      WHEN 0 THEN 'B' || (1 + conv_id % 9) || ':B' || (1 + conv_id % 9) || ',C2:D3' || CASE WHEN conv_id % 9 = 0 THEN '' ELSE ',B1:B1' END
      WHEN 1 THEN 'A' || (1 + turn) || ':A' || (1 + turn) ELSE 'E5:E5' END AS found FROM conversations""",
)
def _(t):
    return t.sql(FOCUS).select("id", F.array_join(rg.extract_focus_ranges(F.col("text")), ",").alias("found"))


def user_cells(t):
    return t.events.select("user_id", (1 + F.col("event_id") % 20).alias("row"), (1 + F.col("event_id") % 6).alias("col")).distinct()


@query(
    "b13_dedupe_cells",
    """SELECT user_id, cell FROM (SELECT user_id, cell, row_number() OVER (PARTITION BY user_id ORDER BY r, c) AS rn FROM (
       SELECT DISTINCT user_id, chr(CAST(65 + event_id % 6 AS INT)) || CAST(1 + event_id % 20 AS VARCHAR) AS cell,
       1 + event_id % 20 AS r, event_id % 6 AS c FROM events)) WHERE rn <= 12""",
)
def _(t):
    from formloom.operators.grid import top_rows

    return top_rows(user_cells(t), ["user_id"], ["row", "col"], 12).select("user_id", rg.a1_cell(F.col("row"), F.col("col")).alias("cell"))


# Without the limit of twelve cells a user, which is part of the SQL above.
@query("b13_dedupe_cells_all", "SELECT DISTINCT user_id, chr(CAST(65 + event_id % 6 AS INT)) || CAST(1 + event_id % 20 AS VARCHAR) AS cell FROM events")
def _(t):
    return user_cells(t).select("user_id", rg.a1_cell(F.col("row"), F.col("col")).alias("cell"))


@query(
    "b13_cell_list_order",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'A2,B2,Z' || (10 + event_id % 50) || ',?X' ELSE 'C1,B2,C' || (10 + event_id % 50) || ',?X' END AS cells FROM events""",
)
def _(t):
    n = (10 + F.col("event_id") % 50).cast("string")
    even = F.array(F.concat(F.lit("z"), n), F.lit("?x"), F.lit(" b2 "), F.lit("A2"), F.lit("B2"))
    odd = F.array(F.concat(F.lit("c"), n), F.lit("?x"), F.lit("b2"), F.lit(""), F.lit("C1"))
    cells = F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)
    return t.events.select("event_id", F.array_join(rg.dedupe_cells(cells), ",").alias("cells"))


@query("b14_dedup_ranges", f"SELECT DISTINCT wb_id, {q_range('r0', 'c0', 'r1', 'c1')} AS a1 FROM ({q_parse(Q_TOKENS)})")
def _(t):
    d = t.range_lists.select("wb_id", F.explode(rg.parse_list(F.col("txt"))).alias("x"))
    return d.select("wb_id", rg.a1_of(F.col("x")).alias("a1")).distinct()


@query(
    "b15_expand_limited",
    f"""SELECT event_id, count(*) AS n, min({q_cell('row', 'col')}) AS first_cell FROM ({Q_CELLS}) GROUP BY 1 HAVING count(*) <= 12""",
)
def _(t):
    d = t.range_lists.select("event_id", F.explode(rg.expand_limited(F.col("txt"))).alias("p"))
    return d.groupBy("event_id").agg(F.count("*").alias("n"), F.min(rg.a1_cell(F.col("p.row"), F.col("p.col"))).alias("first_cell"))
