"""Repair planning and guarded writes over the derived sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.functions import text as tx
from formloom.operators import grid as g
from formloom.operators import repair as r
from formloom.plans.queries_audit import filled
from formloom.plans.queries_grid import CONTENT, Q_ANCHOR, Q_CAND, Q_LABELS, Q_REGIONS, Q_TYPED, regions
from formloom.plans.queries_match import ALNUM, NO_WORD, q_overlap, q_rank
from formloom.plans.registry import q_cell, q_hit, q_key, q_range, query

REG = "wb_id, sheet, region_id"
# Targets and hints: one of each per form line, filed under three regions per sheet.
TG = """SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, CAST(ln % 3 AS INT) AS region_id, CAST(ln AS INT) AS target_ord,
 CASE p % 4 WHEN 0 THEN 'label_area_edit' WHEN 1 THEN 'high_risk_edit' WHEN 2 THEN 'screenshot_bad_range' ELSE 'high_risk_edit' END AS kind,
 CASE WHEN p % 3 = 0 THEN '' WHEN p % 3 = 1 THEN 'Order Qty:' ELSE 'Status Line' END AS key, CAST(1 + q % 5 AS INT) AS r0, 1 AS c0, CAST(1 + q % 5 AS INT) AS r1, CAST(1 + s % 2 AS INT) AS c1,
 CASE WHEN s % 3 = 0 THEN 'duplicate_pattern,other' WHEN s % 3 = 1 THEN 'label_area' ELSE 'high_risk_pattern,label_area' END AS flag_text FROM ({li})"""
HT = """SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, CAST(ln % 3 AS INT) AS region_id, CAST(ln AS INT) AS hint_id,
 CASE p % 5 WHEN 0 THEN 'order qty' WHEN 1 THEN 'Status' WHEN 2 THEN '12b' WHEN 3 THEN 'Return Flag' ELSE '7' END AS key, 'b' || CAST(1 + q % 7 AS STRING) AS value_cell, (s % 4 = 0) AS is_invalid,
 (q % 2 = 0) AS is_blank, CASE WHEN t % 3 = 0 THEN '' ELSE 'r' || CAST(t AS STRING) END AS reason, CASE WHEN s % 2 = 0 THEN 'slot' ELSE 'form' END AS source FROM ({li})"""


def _li(t, text):
    from formloom.plans.fixtures import SQL

    return t.sql(text.replace("{li}", SQL["li"]))


def tg(t):
    return _li(t, TG).withColumn("flags", F.split("flag_text", ",")).drop("flag_text")


def ht(t):
    return _li(t, HT)


Q_TG, Q_HT = "(" + TG.replace("({li})", "<<li>>") + ")", "(" + HT.replace("({li})", "<<li>>") + ")"
PRIO = "kind IN ('label_area_edit', 'screenshot_bad_range')"


@query(
    "e14_select_patch_targets",
    f"""WITH t AS (SELECT *, bool_or({PRIO}) OVER (PARTITION BY wb_id, region_id) AS has FROM {Q_TG})
      SELECT {REG}, kind, key, r0, c0, r1, c1, CASE WHEN has AND NOT ({PRIO}) THEN 1 ELSE 0 END AS late, min(target_ord) AS target_ord FROM t WHERE has GROUP BY ALL
      UNION ALL SELECT {REG}, kind, key, r0, c0, r1, c1, 0, target_ord FROM t WHERE NOT has""",
)
def _(t):
    return r.select_patch_targets(tg(t).drop("flags"))


HIT_RANGE = "h.wb_id = t.wb_id AND h.region_id = t.region_id AND CAST(substring(h.value_cell, 2) AS INT) BETWEEN t.r0 AND t.r1 AND 2 BETWEEN t.c0 AND t.c1"


@query(
    "e15_select_region_hints",
    f"""SELECT {REG}, hint_id, key, CASE WHEN is_invalid THEN 'negative' ELSE 'positive' END AS side FROM {Q_HT} h WHERE EXISTS (SELECT 1 FROM {Q_TG} t WHERE h.wb_id = t.wb_id AND h.region_id = t.region_id
      AND {q_key('h.key')} = {q_key('t.key')} AND {q_key('h.key')} <> '') OR EXISTS (SELECT 1 FROM {Q_TG} t WHERE {HIT_RANGE})""",
)
def _(t):
    return r.select_region_hints(ht(t), tg(t)).select(*r.REGION, "hint_id", "key", "side")


Q_NOTES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in r.FLAG_NOTES.items())


@query(
    "e16_region_flag_notes",
    f"""SELECT {REG}, CAST(row_number() OVER (PARTITION BY wb_id, region_id ORDER BY o) AS INT) AS pos, flag, CASE flag {Q_NOTES} END AS note FROM (SELECT {REG}, flag, min(target_ord * 10 + i) AS o FROM (
      SELECT {REG}, target_ord, unnest(string_split(flag_text, ',')) AS flag, generate_subscripts(string_split(flag_text, ','), 1) AS i FROM {Q_TG}) WHERE flag <> 'other' GROUP BY 1, 2, 3, 4)""",
)
def _(t):
    return r.region_flag_notes(tg(t))


NOISY = f"(SELECT *, upper(value_cell) AS cell, CAST(substring(value_cell, 2) AS INT) AS cr, (x = '' OR {NO_WORD} OR length({ALNUM}) <= 1 OR regexp_full_match({ALNUM}, '[0-9]+[A-Za-z]?')) AS noise FROM (SELECT *, key AS x FROM {Q_HT}))"


def q_hints(n_cells: str, n_reasons: str) -> str:
    return f"""WITH i AS (SELECT *, {q_key('key')} AS grp FROM {NOISY} WHERE NOT noise),
      cl AS (SELECT {REG}, grp, kind, string_agg(cell, ',' ORDER BY cr) FILTER (rn <= {n_cells}) AS v, least(count(*), {n_cells}) AS n FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, region_id, grp, kind ORDER BY cr) AS rn FROM (
        SELECT DISTINCT {REG}, grp, CASE WHEN is_invalid THEN 'i' ELSE 'c' END AS kind, cell, cr FROM i UNION SELECT DISTINCT {REG}, grp, 'b', cell, cr FROM i WHERE is_blank)) GROUP BY 1, 2, 3, 4, 5),
      rs AS (SELECT {REG}, grp, string_agg(reason, ',' ORDER BY o) FILTER (rn <= {n_reasons}) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, region_id, grp ORDER BY o) AS rn FROM (
        SELECT {REG}, grp, reason, min(hint_id) AS o FROM i WHERE reason <> '' GROUP BY 1, 2, 3, 4, 5)) GROUP BY 1, 2, 3, 4),
      k AS (SELECT {REG}, grp, arg_min(key, hint_id) AS key FROM i GROUP BY 1, 2, 3, 4),
      s AS (SELECT k.*, coalesce(c.v, '') AS candidates, coalesce(x.v, '') AS invalids, coalesce(b.v, '') AS blanks, coalesce(rs.reasons, '') AS reasons, coalesce(c.n, 0) AS nc, coalesce(x.n, 0) AS ni FROM k
        LEFT JOIN cl c ON c.wb_id = k.wb_id AND c.region_id = k.region_id AND c.grp = k.grp AND c.kind = 'c' LEFT JOIN cl x ON x.wb_id = k.wb_id AND x.region_id = k.region_id AND x.grp = k.grp AND x.kind = 'i'
        LEFT JOIN cl b ON b.wb_id = k.wb_id AND b.region_id = k.region_id AND b.grp = k.grp AND b.kind = 'b' LEFT JOIN rs ON rs.wb_id = k.wb_id AND rs.region_id = k.region_id AND rs.grp = k.grp)
      SELECT {REG}, key, side, candidates, invalids, blanks, reasons, CAST(row_number() OVER (PARTITION BY wb_id, region_id, side ORDER BY nc DESC, ni DESC, lower(key)) AS INT) AS pos FROM (SELECT *, CASE WHEN nc > 0 THEN 'candidate' ELSE 'negative' END AS side FROM s)"""


def _hints(t, *limits):
    s, _noise = r.hint_context_summary(ht(t).withColumn("item_ord", F.col("hint_id")), *limits)
    j = lambda c, n: F.array_join(c, ",").alias(n)
    return s.select(*r.REGION, "key", "side", j("candidate_list", "candidates"), j("invalid_list", "invalids"), j("blank_list", "blanks"), j("reason_list", "reasons"), "pos")


@query("e17_hint_context_summary", q_hints("12", "4"))
def _(t):
    return _hints(t, 12, 4, 8, 6, 16)


@query("e17_hint_context_summary_all", q_hints("1000000000", "1000000000"))
def _(t):
    return _hints(t)


@query("e17_noise_cells", f"SELECT {REG}, cell FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, region_id ORDER BY cr) AS rn FROM (SELECT DISTINCT {REG}, cell, cr FROM {NOISY} WHERE noise)) WHERE rn <= 16")
def _(t):
    return r.hint_context_summary(ht(t).withColumn("item_ord", F.col("hint_id")), n_noise=16)[1]


@query("e17_noise_cells_all", f"SELECT DISTINCT {REG}, cell FROM {NOISY} WHERE noise")
def _(t):
    return r.hint_context_summary(ht(t).withColumn("item_ord", F.col("hint_id")))[1]


Q_ANCHOR_F = Q_ANCHOR.replace("<<merges>>", "<<merges_f>>")
Q_STATIC = f"(SELECT a.* FROM <<cells_t>> a WHERE {CONTENT.replace('value', 'a.value')} AND NOT EXISTS (SELECT 1 FROM {Q_CAND} b WHERE a.wb_id = b.wb_id AND a.row = b.row AND a.col = b.col))"
Q_DAMAGE = f"""(SELECT s.wb_id, s.sheet, g.region_id, s.row, s.col, coalesce(x.r0, s.row) AS a_row, coalesce(x.c0, s.col) AS a_col, s.value AS template_value, f.value AS current_value,
   x.r0 IS NOT NULL AS m, s.style_key IS DISTINCT FROM f.style_key AS st, (s.value IS DISTINCT FROM f.value OR s.value_type IS DISTINCT FROM f.value_type) AS v
   FROM {Q_STATIC} s JOIN {Q_REGIONS} g ON g.wb_id = s.wb_id AND s.row BETWEEN g.r0 AND g.r1 AND s.col BETWEEN g.c0 AND g.c1 LEFT JOIN {Q_ANCHOR_F} x ON x.wb_id = s.wb_id AND x.row = s.row AND x.col = s.col
   LEFT JOIN <<cells_f>> f ON f.wb_id = s.wb_id AND f.row = coalesce(x.r0, s.row) AND f.col = coalesce(x.c0, s.col))"""


def wide(t):
    return regions(t).withColumn("c1", F.lit(6))


Q_WIDE = Q_REGIONS.replace("5 AS c1", "6 AS c1")


@query(
    "e18_template_damage",
    f"""SELECT {REG}, row, col, template_value, current_value, array_to_string(list_filter([CASE WHEN m THEN 'template_merge_changed' END, CASE WHEN st THEN 'template_static_style_changed' END, CASE WHEN v THEN 'template_static_value_changed' END], lambda z: z IS NOT NULL), ',') AS reasons
      FROM {Q_DAMAGE.replace(Q_REGIONS, Q_WIDE)} WHERE m OR st OR v""",
)
def _(t):
    d = r.template_damage(wide(t), t.saved("cells_t"), t.merges, t.saved("cells_f"), t.merges_f)
    return d.select(*r.REGION, "row", "col", "template_value", "current_value", F.array_join("reasons", ",").alias("reasons"))


@query("e18_damage_by_region", f"SELECT {REG}, min(row) AS r0, min(col) AS c0, max(row) AS r1, max(col) AS c1, count(*) AS n_changed FROM {Q_DAMAGE.replace(Q_REGIONS, Q_WIDE)} WHERE m OR st OR v GROUP BY 1, 2, 3")
def _(t):
    return r.damage_by_region(r.template_damage(wide(t), t.saved("cells_t"), t.merges, t.saved("cells_f"), t.merges_f)).drop("restore_reasons")


@query(
    "e19_restore_region",
    f"""WITH sp AS (SELECT wb_id, row, col FROM <<cells_t>> UNION SELECT wb_id, row, col FROM <<cells_f>>),
      b AS (SELECT sp.wb_id, sp.row AS r0, sp.col AS c0, sp.row AS r1, sp.col AS c1 FROM sp LEFT JOIN {Q_ANCHOR} x ON x.wb_id = sp.wb_id AND x.row = sp.row AND x.col = sp.col WHERE x.r0 IS NULL UNION ALL SELECT wb_id, r0, c0, r1, c1 FROM <<merges>>),
      d AS (SELECT g.wb_id, g.sheet, g.region_id, b.r0 AS row, b.c0 AS col, greatest(b.r0, g.r0) AS pr, greatest(b.c0, g.c0) AS pc FROM b JOIN {Q_WIDE} g ON g.wb_id = b.wb_id AND {q_hit('b', 'g')} WHERE b.c0 <> 5)
      SELECT d.wb_id, d.sheet, d.region_id, d.row, d.col, t.value, (t.value IS DISTINCT FROM f.value OR t.value_type IS DISTINCT FROM f.value_type OR coalesce(t.style_key, '0') IS DISTINCT FROM coalesce(f.style_key, '0')) AS changed FROM d
      LEFT JOIN {Q_ANCHOR} x ON x.wb_id = d.wb_id AND x.row = d.pr AND x.col = d.pc LEFT JOIN <<cells_t>> t ON t.wb_id = d.wb_id AND t.row = coalesce(x.r0, d.pr) AND t.col = coalesce(x.c0, d.pc) LEFT JOIN <<cells_f>> f ON f.wb_id = d.wb_id AND f.row = d.row AND f.col = d.col""",
)
def _(t):
    keep = t.saved("cells_f").filter("col = 5")
    d = r.restore_region(wide(t), t.saved("cells_t"), t.merges, t.saved("cells_f"), t.merges, preserve=keep)
    return d.select(*r.REGION, "row", "col", "value", "changed")


Q_OVER = f"""(SELECT * FROM (SELECT l.wb_id, l.sheet, l.row, l.col, l.text, trim(f.value) AS now, regexp_replace(substring(trim(f.value), length(l.text) + 1), '^[ :\\-]+|[ :\\-]+$', '', 'g') AS extra FROM {Q_LABELS} l
  JOIN <<cells_f>> f ON f.wb_id = l.wb_id AND f.row = l.row AND f.col = l.col WHERE NOT EXISTS (SELECT 1 FROM {Q_TYPED} z WHERE z.wb_id = l.wb_id AND z.row = l.row AND z.col = l.col)
  AND trim(f.value) <> '' AND lower(trim(f.value)) <> lower(l.text) AND (starts_with(lower(trim(f.value)), lower(l.text)) OR (l.text LIKE '%:' AND starts_with(lower(trim(f.value)), rtrim(lower(l.text), ':'))))) WHERE extra <> '')"""
Q_FIND = f"""(WITH ov AS (SELECT * FROM {Q_OVER}), rk AS {q_rank('ov', 3)},
   pt AS (SELECT rk.wb_id, rk.l_row, rk.l_col, rk.rank, coalesce(x.r0, rk.row) AS row, coalesce(x.c0, rk.col) AS col FROM rk LEFT JOIN {Q_ANCHOR} x ON x.wb_id = rk.wb_id AND x.row = rk.row AND x.col = rk.col),
   ms AS (SELECT pt.*, (f.value IS NULL OR trim(f.value) = '' OR lower(trim(f.value)) = lower(trim(t.value))) AS missing FROM pt LEFT JOIN <<cells_f>> f ON f.wb_id = pt.wb_id AND f.row = pt.row AND f.col = pt.col LEFT JOIN <<cells_t>> t ON t.wb_id = pt.wb_id AND t.row = pt.row AND t.col = pt.col)
   SELECT ov.wb_id, ov.sheet, ov.row, ov.col, ov.text, ov.extra, coalesce(string_agg({q_cell('ms.row', 'ms.col')}, ',' ORDER BY rank), '') AS candidates, coalesce(string_agg({q_cell('ms.row', 'ms.col')}, ',' ORDER BY rank) FILTER (missing), '') AS missing
   FROM ov LEFT JOIN ms ON ms.wb_id = ov.wb_id AND ms.l_row = ov.row AND ms.l_col = ov.col GROUP BY ALL)"""


@query("e20_label_overwrites", f"SELECT * FROM {Q_FIND}")
def _(t):
    d = r.label_overwrites(t.saved("cells_t"), t.merges, t.saved("cells_f"))
    return d.select(*g.POS, "text", "extra", F.array_join("candidate_cells", ",").alias("candidates"), F.array_join("missing_cells", ",").alias("missing"))


@query(
    "e21_reconcile_check",
    f"""WITH h AS (SELECT wb_id, count(*) AS n FROM {Q_OVER} GROUP BY 1), rep AS (SELECT CAST(o AS VARCHAR) AS wb_id, min(p) % 2 = 0 AS nf, min(q) AS q FROM <<li>> GROUP BY o)
      SELECT rep.wb_id, nf OR n IS NOT NULL AS need_fix, CAST(CASE WHEN n IS NOT NULL THEN 0.95 ELSE 0.5 END AS DOUBLE) AS confidence, nf AND q % 3 = 0 AS parse_failed FROM rep LEFT JOIN h USING (wb_id)""",
)
def _(t):
    head = t.li.groupBy(F.col("o").cast("string").alias("wb_id")).agg((F.min("p") % 2 == 0).alias("need_fix"), F.min("q").alias("q"))
    unread = F.col("q") % 3 == 0
    none = F.array().cast("array<string>")
    rep = head.select(
        "wb_id", F.lit("S1").alias("sheet"), "need_fix", F.when(unread, none).otherwise(F.array(F.lit("Z9:Z9"))).alias("bad_ranges"),
        F.array(F.lit("A1:F9")).alias("correct_ranges"), F.array(F.lit("zz")).alias("bad_raw"), F.lit(0.5).alias("confidence"),
    )
    d = r.reconcile_check(rep, r.label_overwrites(t.saved("cells_t"), t.merges, t.saved("cells_f")))
    return d.select("wb_id", "need_fix", "confidence", "parse_failed")


@query(
    "e22_protected_cells",
    f"""WITH lay AS (SELECT wb_id, sheet, row, col, 1 AS layer, 'template/original content: ' || trim(value) AS reason FROM <<cells_t>> WHERE {CONTENT} UNION ALL SELECT wb_id, sheet, row, col, 2, 'current filled content already present before this repair: ' || trim(value) FROM <<cells_f>> WHERE {CONTENT}
      UNION ALL SELECT wb_id, sheet, r, c, 3, 'reflect marked this region as correct/safe_blank' FROM <<correct_ranges>>, range(r0, r1 + 1) AS x(r), range(c0, c1 + 1) AS y(c)),
      ed AS (SELECT wb_id, r AS row, c AS col FROM <<bad_ranges>>, range(r0, r1 + 1) AS x(r), range(c0, c1 + 1) AS y(c))
      SELECT wb_id, sheet, CAST(row AS INT) AS row, CAST(col AS INT) AS col, arg_min(reason, layer) AS reason FROM lay WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.wb_id = lay.wb_id AND ed.row = lay.row AND ed.col = lay.col) GROUP BY 1, 2, 3, 4""",
)
def _(t):
    text = lambda d, n, why: g.nonempty_cells(d).select(*g.POS, F.lit(n).alias("layer"), F.concat(F.lit(why), F.substring("text", 1, 80)).alias("reason"))
    as_text = lambda d: d.select(*g.KEYS, rg.a1_range(*[F.col(c) for c in g.RECT]).alias("range"))
    ok = r.range_layer(as_text(t.correct_ranges), 3, F.lit("reflect marked this region as correct/safe_blank"))
    ed = r.range_layer(as_text(t.bad_ranges), 0, F.lit(""))
    layers = text(t.saved("cells_t"), 1, "template/original content: ").unionByName(text(t.saved("cells_f"), 2, "current filled content already present before this repair: ")).unionByName(ok)
    return r.protected_cells(layers, ed)


@query(
    "e23_guarded_write_candidates",
    f"""WITH src AS (SELECT {REG}, r, c FROM {Q_TG}, range(r0, r1 + 1) AS x(r), range(c0, c1 + 1) AS y(c) UNION SELECT {REG}, CAST(substring(value_cell, 2) AS INT), 2 FROM {Q_HT} WHERE NOT is_invalid),
      av AS (SELECT DISTINCT {REG}, CAST(substring(value_cell, 2) AS INT) AS r, 2 AS c FROM {Q_HT} WHERE is_invalid) SELECT {REG}, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM src WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.wb_id = src.wb_id AND av.region_id = src.region_id AND av.r = src.r AND av.c = src.c)""",
)
def _(t):
    a1 = rg.a1_range(*[F.col(c) for c in g.RECT])
    src = tg(t).select(*r.REGION, a1.alias("range"), F.lit(12).alias("max_span"))
    h = ht(t)
    src = src.unionByName(h.filter("NOT is_invalid").select(*r.REGION, F.col("value_cell").alias("range"), F.lit(12).alias("max_span")))
    return r.guarded_write_candidates(src, h.filter("is_invalid").select(*r.REGION, F.col("value_cell").alias("range")))


@query(
    "e24_mandatory_review_items",
    f"""WITH b AS (SELECT DISTINCT wb_id, r0, c0, r1, c1 FROM <<bad_ranges>>), h AS (SELECT DISTINCT g.wb_id, g.sheet, g.region_id, b.r0, b.c0, b.r1, b.c1 FROM b JOIN {Q_REGIONS} g ON g.wb_id = b.wb_id AND {q_hit('b', 'g')})
      SELECT h.wb_id, h.sheet, h.region_id, {q_range('h.r0', 'h.c0', 'h.r1', 'h.c1')} AS "range", f.value AS previous_value, t.value AS template_value FROM h LEFT JOIN {Q_ANCHOR} x ON x.wb_id = h.wb_id AND x.row = h.r0 AND x.col = h.c0
      LEFT JOIN <<cells_f>> f ON f.wb_id = h.wb_id AND f.row = coalesce(x.r0, h.r0) AND f.col = coalesce(x.c0, h.c0) LEFT JOIN <<cells_t>> t ON t.wb_id = h.wb_id AND t.row = coalesce(x.r0, h.r0) AND t.col = coalesce(x.c0, h.c0)""",
)
def _(t):
    rng = t.bad_ranges.select(*g.KEYS, rg.a1_range(*[F.col(c) for c in g.RECT]).alias("range"))
    return r.mandatory_review_items(regions(t), rng, t.saved("cells_f"), t.saved("cells_t"), t.merges)


@query(
    "e25_latest_feedback",
    f"""WITH st AS (SELECT CAST(o AS VARCHAR) AS wb_id, ln % 2 = 0 AS ver, CAST(t % 3 AS INT) AS rd, ln, q, s FROM <<li>>), la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wb_id ORDER BY rd DESC, ver DESC, ln) AS rn FROM (SELECT wb_id, ver, rd, min(ln) AS ln, min(q) AS q, min(s) AS s FROM st GROUP BY 1, 2, 3)) WHERE rn = 1),
      rr AS (SELECT la.*, g.sheet, g.region_id, (2 + q % 7) BETWEEN g.r0 AND g.r1 AS bad_hit, (2 + s % 7) BETWEEN g.r0 AND g.r1 AS ok_hit FROM la JOIN {Q_REGIONS} g USING (wb_id))
      SELECT wb_id, sheet, region_id, rd AS round_idx, 'bad' AS range_kind, 'A' || (2 + q % 7) || ':B' || (2 + q % 7) AS "range" FROM rr WHERE bad_hit UNION ALL SELECT wb_id, sheet, region_id, rd, 'correct', 'A' || (2 + s % 7) || ':B' || (2 + s % 7) FROM rr WHERE bad_hit AND ok_hit""",
)
def _(t):
    row = lambda c: F.concat(F.lit("A"), (2 + F.col(c) % 7).cast("string"), F.lit(":B"), (2 + F.col(c) % 7).cast("string"))
    st = t.li.groupBy(F.col("o").cast("string").alias("wb_id"), (F.col("ln") % 2 == 0).alias("is_verification"), (F.col("t") % 3).alias("round_idx")).agg(F.min("q").alias("q"), F.min("s").alias("s"))
    st = st.select(
        "wb_id", F.lit("S1").alias("sheet"), F.lit("stage").alias("stage_name"), "is_verification", "round_idx", F.lit(True).alias("need_fix"),
        F.lit(" ").alias("reason"), F.array(row("q")).alias("bad_ranges"), F.array(row("s")).alias("correct_ranges"),
    )
    return r.latest_feedback(st, regions(t)).select(*r.REGION, "round_idx", "range_kind", "range")


REQ = """SELECT CAST(o AS STRING) AS wb_id, 'S1' AS sheet, CAST(ln * 10 + k AS BIGINT) AS seq, CASE WHEN p % 23 = 0 THEN 'bad!' ELSE chr(CAST(65 + (q + k) % 6 AS INT)) || CAST(2 + s % 7 AS STRING) END AS cell,
 'v' || CAST((q + k) % 2 AS STRING) AS value FROM ({li}) x CROSS JOIN (VALUES (0), (1), (2)) v(k)"""
Q_REQ = "(" + REQ.replace("({li}) x", "<<li>>") + ")"


@query(
    "e26_write_guard",
    f"""WITH q0 AS (SELECT *, cell = 'bad!' AS inv, CASE WHEN cell <> 'bad!' THEN ascii(cell) - 64 END AS qc, CASE WHEN cell <> 'bad!' THEN CAST(substring(cell, 2) AS INT) END AS qr FROM {Q_REQ}),
      q1 AS (SELECT q0.*, coalesce(x.r0, qr) AS row, coalesce(x.c0, qc) AS col FROM q0 LEFT JOIN {Q_ANCHOR} x ON x.wb_id = q0.wb_id AND x.row = qr AND x.col = qc),
      q2 AS (SELECT q1.*, c.value AS now, c.border_bottom IS NOT NULL AS lined, l.row IS NOT NULL AS lab, pr.row IS NOT NULL AS prot FROM q1 LEFT JOIN <<cells_f>> c ON c.wb_id = q1.wb_id AND c.row = q1.row AND c.col = q1.col
        LEFT JOIN {Q_LABELS} l ON l.wb_id = q1.wb_id AND l.row = q1.row AND l.col = q1.col LEFT JOIN (SELECT wb_id, row, col FROM <<cells_t>> WHERE col = 5) pr ON pr.wb_id = q1.wb_id AND pr.row = q1.row AND pr.col = q1.col),
      q3 AS (SELECT *, CASE WHEN inv THEN 'invalid_target' WHEN NOT coalesce(lined, FALSE) THEN 'blocked_missing_bottom_border' WHEN lab THEN 'blocked_label_guard' WHEN prot AND value IS DISTINCT FROM now THEN 'blocked_protected_cell'
        WHEN row NOT BETWEEN 1 AND 6 OR col NOT BETWEEN 1 AND 4 THEN 'blocked_outside_focus_range' END AS stop FROM q2),
      q4 AS (SELECT *, CASE WHEN stop IS NULL THEN coalesce(lag(value) OVER (PARTITION BY wb_id, row, col, stop IS NULL ORDER BY seq), now) ELSE now END AS old FROM q3)
      SELECT wb_id, sheet, seq, CASE WHEN inv THEN 'BAD!' ELSE {q_cell('row', 'col')} END AS target_cell, CASE WHEN inv THEN NULL ELSE old END AS old_value, value AS new_value, coalesce(stop, CASE WHEN value IS NOT DISTINCT FROM old THEN 'noop' ELSE 'ok' END) AS status FROM q4""",
)
def _(t):
    focus = t.li.select(F.col("o").cast("string").alias("wb_id"), F.lit("S1").alias("sheet")).distinct()
    focus = focus.select("*", F.lit(1).alias("r0"), F.lit(1).alias("c0"), F.lit(6).alias("r1"), F.lit(4).alias("c1"))
    d = r.write_guard(
        _li(t, REQ), t.saved("cells_f"), t.merges, label_cells=g.labels(t.saved("cells_t")), protected=t.saved("cells_t").filter("col = 5"),
        focus=focus, bottom_border=True,
    )
    return d.select(*g.KEYS, "seq", "target_cell", "old_value", "new_value", "status")


ST = """SELECT event_id AS job_id, (event_id % 19 = 0) AS delivered, (event_id % 7 = 0) AS skip_initial_fill, (event_id % 5 <> 0) AS has_first_pass, (event_id % 4 <> 0) AS has_assessment, (user_id % 3 = 0) AS has_high_risk,
 CAST(user_id % 2 AS INT) AS n_bad_ranges, CASE WHEN event_id % 6 <> 0 THEN 'A1:B2' END AS open_region, (user_id % 5 = 0) AS need_restore, (event_id % 2 = 0) AS restored, CAST(event_id % 3 AS INT) AS noop_count,
 (user_id % 4 = 0) AS has_direct_hints, (user_id % 7 = 0) AS has_negative_hints, (user_id % 11 = 0) AS has_context FROM {events}"""


@query(
    "e27_next_action",
    f"""SELECT job_id, a AS next_action, CASE WHEN a IN ('guided_refill', 'restore_template_region') THEN open_region END AS region, a = 'guided_refill' AND (NOT has_direct_hints OR noop_count > 0) AS force_repair, a = 'guided_refill' AND (has_direct_hints OR has_negative_hints OR has_context) AS use_hints
      FROM (SELECT *, CASE WHEN delivered THEN 'deliver' WHEN NOT skip_initial_fill AND NOT has_first_pass THEN 'free_fill' WHEN NOT has_assessment THEN 'reflect_and_hint' WHEN NOT has_high_risk AND n_bad_ranges = 0 THEN 'verify_and_deliver' WHEN open_region IS NULL THEN 'verify_and_deliver'
      WHEN need_restore AND NOT restored THEN 'restore_template_region' ELSE 'guided_refill' END AS a FROM ({ST.format(events='events')}))""",
)
def _(t):
    return r.next_action(t.sql(ST))


@query(
    "e28_stalled_regions",
    f"""WITH rg AS (SELECT *, region_id % 2 AS noop FROM {Q_REGIONS}), un AS (SELECT DISTINCT wb_id, r0, c0, r1, c1 FROM <<bad_ranges>>) SELECT wb_id, sheet, region_id FROM rg WHERE noop > 0 AND EXISTS (SELECT 1 FROM un WHERE un.wb_id = rg.wb_id AND {q_hit('un', 'rg')})
      UNION ALL SELECT wb_id, sheet, region_id FROM rg WHERE noop > 0 AND NOT EXISTS (SELECT 1 FROM un WHERE un.wb_id = rg.wb_id) AND EXISTS (SELECT 1 FROM <<correct_ranges>> c WHERE c.wb_id = rg.wb_id)""",
)
def _(t):
    a1 = rg.a1_range(*[F.col(c) for c in g.RECT])
    ver = t.bad_ranges.select(*g.KEYS, F.array(a1).alias("bad_ranges"), F.lit(None).cast("array<struct<target_range:string,label_cell:string,value_cell:string>>").alias("risky"))
    return r.stalled_regions(regions(t).withColumn("noop_count", F.col("region_id") % 2), r.unresolved_ranges(ver), t.correct_ranges).select(*r.REGION)


SOFT = f"(h.wb_id = t.wb_id AND h.region_id = t.region_id AND {q_key('h.key')} <> '' AND {q_key('t.key')} <> '' AND (contains({q_key('h.key')}, {q_key('t.key')}) OR contains({q_key('t.key')}, {q_key('h.key')}) OR {q_overlap(q_key('h.key'), q_key('t.key'))} >= 0.75))"
Q_HINTED = f"""(SELECT h.*, v.value AS current_value, (v.value IS NULL OR trim(v.value) = '') AS blank_now FROM {NOISY} h LEFT JOIN {Q_ANCHOR} x ON x.wb_id = h.wb_id AND x.row = h.cr AND x.col = 2 LEFT JOIN <<cells_f>> v ON v.wb_id = h.wb_id AND v.row = coalesce(x.r0, h.cr) AND v.col = coalesce(x.c0, 2))"""
Q_MATCHED = f"(SELECT DISTINCT h.wb_id, h.region_id, h.hint_id, t.target_ord, t.flag_text FROM {Q_HT} h JOIN {Q_TG} t ON {SOFT} OR ({HIT_RANGE}))"


@query(
    "e32_region_hints",
    f"""SELECT {REG}, hint_id, key, current_value, is_invalid AS avoid_cell, CASE WHEN is_invalid THEN 'reflect_invalid_slot' WHEN blank_now THEN 'reflect_blank_slot' ELSE 'reflect_slot_kv' END AS hint_source FROM {Q_HINTED} h WHERE (is_invalid OR NOT (blank_now AND noise))
      AND EXISTS (SELECT 1 FROM {Q_MATCHED} m WHERE m.wb_id = h.wb_id AND m.region_id = h.region_id AND m.hint_id = h.hint_id)""",
)
def _(t):
    p = ht(t).select(*r.REGION, "hint_id", "key", "value_cell", "is_invalid")
    return r.region_hints(p, tg(t), t.saved("cells_f"), t.merges).select(*r.REGION, "hint_id", "key", "current_value", "avoid_cell", "hint_source")


@query(
    "e33_rank_region_hints",
    f"""WITH fl AS (SELECT wb_id, region_id, hint_id, list_sort(list(DISTINCT flag)) AS fs FROM (SELECT wb_id, region_id, hint_id, unnest(string_split(flag_text, ',')) AS flag FROM {Q_MATCHED}) GROUP BY 1, 2, 3)
      SELECT h.wb_id, h.sheet, h.region_id, h.hint_id, array_to_string(fs, ',') AS risk_flags, CAST(row_number() OVER (PARTITION BY h.wb_id, h.region_id ORDER BY NOT is_invalid, NOT blank_now, -len(fs), value_cell, h.hint_id) AS INT) AS rank FROM {Q_HINTED} h JOIN fl ON fl.wb_id = h.wb_id AND fl.region_id = h.region_id AND fl.hint_id = h.hint_id WHERE is_invalid OR NOT (blank_now AND noise)""",
)
def _(t):
    p = ht(t).select(*r.REGION, "hint_id", "key", "value_cell", "is_invalid")
    return r.rank_region_hints(p, tg(t), t.saved("cells_f"), t.merges).select(*r.REGION, "hint_id", F.array_join("risk_flags", ",").alias("risk_flags"), "rank")


@query(
    "e34_round_delta",
    f"""SELECT g.wb_id, g.sheet, g.region_id, count(e.seq) AS n_edits, count(e.seq) = 0 AS reverted FROM {Q_REGIONS} g LEFT JOIN (SELECT wb_id, seq, CAST(substring(target_cell, 2) AS INT) AS er, ascii(target_cell) - 64 AS ec FROM <<form_edits>> WHERE is_actual_edit AND round_idx = 1) e
      ON e.wb_id = g.wb_id AND er BETWEEN g.r0 AND g.r1 AND ec BETWEEN g.c0 AND g.c1 GROUP BY 1, 2, 3""",
)
def _(t):
    return r.round_delta(t.form_edits, regions(t), 1)
