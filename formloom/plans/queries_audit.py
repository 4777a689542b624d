"""Edits, risk assessment and repair regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import text as tx
from formloom.operators import audit as a
from formloom.operators import grid as g
from formloom.plans.queries_grid import Q_ANCHOR, Q_COVER, Q_FORM, Q_LABELS, Q_PAIR_RECTS, Q_USED
from formloom.plans.queries_match import ALNUM, NO_WORD, Q_BLANK, Q_PROBES, q_native
from formloom.session import cut_lineage
from formloom.plans.registry import q_cell, q_hit, q_key, q_range, query

Q_EFFECTIVE = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, sheet, target_cell ORDER BY seq DESC) AS rn FROM {0} WHERE is_actual_edit) WHERE rn = 1)"""


@query("e1_latest_effective_edits", f"SELECT wb_id, sheet, target_cell, old_value, new_value, round_idx, seq FROM {Q_EFFECTIVE.format('<<edits>>')}")
def _(t):
    return a.latest_effective_edits(t.edits).select(*g.KEYS, "target_cell", "old_value", "new_value", "round_idx", "seq")


@query(
    "e2_actual_edits_for_round",
    """WITH c AS (SELECT wb_id, target_cell, min(seq) AS seq FROM <<edits>> WHERE is_actual_edit AND round_idx = 2 GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY wb_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY wb_id) AS n FROM c)
      SELECT wb_id, string_agg(target_cell, ', ' ORDER BY seq) FILTER (rn <= 12) || CASE WHEN max(n) > 12 THEN ', ... +' || (max(n) - 12) || ' more' ELSE '' END AS preview, max(n) AS n_cells FROM r GROUP BY 1""",
)
def _(t):
    return a.edit_preview(a.actual_edits_for_round(t.edits, 2), ["wb_id"], 12)


@query(
    "e2_actual_edits_for_round_all",
    """WITH c AS (SELECT wb_id, target_cell, min(seq) AS seq FROM <<edits>> WHERE is_actual_edit AND round_idx = 2 GROUP BY 1, 2)
      SELECT wb_id, string_agg(target_cell, ', ' ORDER BY seq) AS preview, count(*) AS n_cells FROM c GROUP BY 1""",
)
def _(t):
    return a.edit_preview(a.actual_edits_for_round(t.edits, 2), ["wb_id"])


@query(
    "e3_current_form_values",
    """SELECT p.wb_id, p.sheet, p.key, p.value_cell, v.value AS current_value FROM """
    + Q_PAIR_RECTS
    + """ p LEFT JOIN <<cells_f>> v ON p.wb_id = v.wb_id AND v.row = p.r0 AND v.col = 2""",
)
def _(t):
    return a.current_form_values(t.pairs, t.saved("cells_f"), t.saved("merges")).select(*g.KEYS, "key", "value_cell", "current_value")




def filled(q: str) -> str:
    """The same structural text over the filled cells."""
    from formloom.plans.fixtures import sql_of

    return q.replace("<<cells_t>>", "<<cells_f>>").replace(f"({sql_of('cells_t')})", f"({sql_of('cells_f')})")


X = "regexp_replace(trim(text), '\\s+', ' ', 'g')"
PROBABLE = (
    f"(SELECT *, {q_key('text')} AS norm FROM (SELECT *, {X} AS x FROM lab) WHERE x <> '' AND length(x) <= 64 AND length({ALNUM}) > 1 AND NOT {NO_WORD}"
    " AND NOT regexp_full_match(x, '[$]?[0-9][0-9,./:-]*%?') AND lower(x) NOT IN ('yes', 'no', 'n/a', 'na'))"
)
# Common table expressions of one audit round, in order.
CTES = f"""
 used AS (SELECT * FROM {filled(Q_USED)}), box AS (SELECT * FROM {filled(Q_FORM)}), anch AS (SELECT * FROM {Q_ANCHOR}),
 lab AS (SELECT l.* FROM {filled(Q_LABELS)} l JOIN box b USING (wb_id, sheet) WHERE l.row BETWEEN b.r0 AND b.r1 AND l.col BETWEEN b.c0 AND b.c1),
 wri AS (SELECT c.wb_id, c.sheet, a_row AS row, a_col AS col FROM {filled(Q_COVER)} c JOIN box b USING (wb_id, sheet)
   WHERE (border_bottom IS NOT NULL OR is_merged) AND c.row BETWEEN b.r0 AND b.r1 AND c.col BETWEEN b.c0 AND b.c1 UNION SELECT wb_id, sheet, r0, 2 FROM {Q_PAIR_RECTS}),
 prob AS (SELECT * FROM {PROBABLE}),
 named AS (SELECT wb_id, {q_key('key')} AS norm, arg_min(upper(value_cell), pair_idx) AS explicit FROM <<pairs>> WHERE {q_key('key')} <> '' GROUP BY 1, 2),
 guess AS (SELECT wb_id, row, col, arg_min(v_row, k) AS v_row, arg_min(v_col, k) AS v_col FROM (
   SELECT p.*, CASE WHEN w.row IS NOT NULL THEN i WHEN l.row IS NULL THEN 100 + i END AS k FROM (
    SELECT q.wb_id, q.row, q.col, i, coalesce(x.r0, q.row + dr) AS v_row, coalesce(x.c0, q.col + dc) AS v_col FROM prob q CROSS JOIN (VALUES {Q_PROBES}) f(i, dr, dc)
    LEFT JOIN anch x ON x.wb_id = q.wb_id AND x.row = q.row + dr AND x.col = q.col + dc) p
   LEFT JOIN wri w ON w.wb_id = p.wb_id AND w.row = p.v_row AND w.col = p.v_col LEFT JOIN lab l ON l.wb_id = p.wb_id AND l.row = p.v_row AND l.col = p.v_col
   WHERE p.v_row <> p.row OR p.v_col <> p.col) WHERE k IS NOT NULL GROUP BY 1, 2, 3),
 eff AS (SELECT * FROM {Q_EFFECTIVE.format('<<form_edits>>')}),
 cand0 AS (SELECT p.wb_id, p.sheet, p.row, p.col, {q_cell('p.row', 'p.col')} AS label_cell, p.text AS key, coalesce(n.explicit, {q_cell('u.v_row', 'u.v_col')}, '') AS value_cell,
   CASE WHEN n.explicit LIKE '%:%' THEN NULL WHEN n.explicit IS NOT NULL THEN CAST(substring(n.explicit, 2) AS INT) ELSE u.v_row END AS v_row,
   CASE WHEN n.explicit LIKE '%:%' THEN NULL WHEN n.explicit IS NOT NULL THEN 2 ELSE u.v_col END AS v_col
   FROM prob p LEFT JOIN named n ON n.wb_id = p.wb_id AND n.norm = p.norm LEFT JOIN guess u ON u.wb_id = p.wb_id AND u.row = p.row AND u.col = p.col),
 cand AS (SELECT c.*, h.value AS current_value, e.seq IS NOT NULL OR f.seq IS NOT NULL AS is_actual_edit, e.seq IS NULL AND f.seq IS NOT NULL AS edited_label_cell,
   least(c.row, coalesce(c.v_row, c.row)) AS r0, least(c.col, coalesce(c.v_col, c.col)) AS c0, greatest(c.row, coalesce(c.v_row, c.row)) AS r1, greatest(c.col, coalesce(c.v_col, c.col)) AS c1
   FROM cand0 c LEFT JOIN eff e ON e.wb_id = c.wb_id AND e.target_cell = c.value_cell LEFT JOIN eff f ON f.wb_id = c.wb_id AND f.target_cell = c.label_cell
   LEFT JOIN anch x ON x.wb_id = c.wb_id AND x.row = c.v_row AND x.col = c.v_col
   LEFT JOIN <<cells_f>> h ON h.wb_id = c.wb_id AND h.row = coalesce(x.r0, c.v_row) AND h.col = coalesce(x.c0, c.v_col)),
 held AS (SELECT c.wb_id, c.sheet, c.row AS r0, c.col AS c0, coalesce(x.r1, c.row) AS r1, coalesce(x.c1, c.col) AS c1, CASE WHEN c.value_type = 'n' AND c.value = '0' THEN '' ELSE {q_key('c.value')} END AS norm
   FROM <<cells_f>> c LEFT JOIN anch x ON x.wb_id = c.wb_id AND x.row = c.row AND x.col = c.col WHERE x.r0 IS NULL OR (x.r0 = c.row AND x.c0 = c.col)),
 dup AS (SELECT * EXCLUDE (n) FROM (SELECT h.*, count(*) OVER (PARTITION BY h.wb_id, norm) AS n FROM held h JOIN box b ON h.wb_id = b.wb_id AND {q_hit('h', 'b')} WHERE norm <> '') WHERE n >= 2),
 bad AS (SELECT * FROM <<bad_ranges>>)"""


def q_expand(src: str, cols: str) -> str:
    return f"""(SELECT {cols}, greatest(u.r0, least(d.r0, coalesce(min(x.r0), d.r0)) - 1) AS e_r0, greatest(u.c0, least(d.c0, coalesce(min(x.c0), d.c0)) - 2) AS e_c0,
     least(u.r1, greatest(d.r1, coalesce(max(x.r1), d.r1)) + 1) AS e_r1, least(u.c1, greatest(d.c1, coalesce(max(x.c1), d.c1)) + 2) AS e_c1
     FROM {src} d JOIN used u ON u.wb_id = d.wb_id LEFT JOIN (SELECT DISTINCT wb_id, r0, c0, r1, c1 FROM anch) x ON x.wb_id = d.wb_id AND {q_hit('d', 'x')} GROUP BY {cols}, u.r0, u.c0, u.r1, u.c1)"""


D_COLS = "d.wb_id, d.sheet, d.r0, d.c0, d.r1, d.c1"
CTES_DUP = CTES + f""", dupreg AS (SELECT DISTINCT wb_id, sheet, e_r0 AS r0, e_c0 AS c0, e_r1 AS r1, e_c1 AS c1 FROM {q_expand('dup', D_COLS)})"""
CTES_FLAG = CTES_DUP + f""",
 dhit AS (SELECT DISTINCT c.wb_id, c.row, c.col FROM cand c JOIN dupreg r ON r.wb_id = c.wb_id AND {q_hit('c', 'r')}),
 bhit AS (SELECT DISTINCT c.wb_id, c.row, c.col FROM cand c JOIN bad r ON r.wb_id = c.wb_id AND {q_hit('c', 'r')}),
 flagged AS (SELECT c.*, d.row IS NOT NULL AS f_dup, b.row IS NOT NULL AS f_bad FROM cand c LEFT JOIN dhit d ON d.wb_id = c.wb_id AND d.row = c.row AND d.col = c.col
   LEFT JOIN bhit b ON b.wb_id = c.wb_id AND b.row = c.row AND b.col = c.col)"""
CTES_ASSESS = CTES_FLAG + f""",
 rule AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, key ORDER BY score DESC, pol_idx) AS rn FROM (
   SELECT k.wb_id, k.key, p.target, p.reason AS preason, p.pol_idx, {q_native(q_key('k.key'), q_key('p.target'))} AS score FROM (SELECT DISTINCT wb_id, key FROM cand) k JOIN {Q_BLANK} p USING (wb_id)) WHERE score >= 0.74) WHERE rn = 1),
 chit AS (SELECT DISTINCT c.wb_id, c.row, c.col FROM cand c JOIN <<correct_ranges>> r ON r.wb_id = c.wb_id AND {q_hit('c', 'r')}),
 pre AS (SELECT c.*, r.target, (c.current_value IS NULL OR trim(c.current_value) = '') AS blank, h.row IS NOT NULL AS in_correct, coalesce(mf.is_correct_region, FALSE) AS m_ok, coalesce(mf.is_safe_blank, FALSE) AS m_safe,
   coalesce(mf.template_inconsistency, FALSE) AS f_t, coalesce(mf.high_risk_pattern, FALSE) AS f_h, coalesce(mf.special_char_anomaly, FALSE) AS f_s,
   trim(CASE WHEN r.target IS NOT NULL THEN 'Planner policy says ''' || r.target || ''' should remain blank' || CASE WHEN c.current_value IS NULL OR trim(c.current_value) = '' THEN '.' ELSE ', but the field is filled.' END
     || CASE WHEN r.preason <> '' THEN ' Reason: ' || r.preason || '.' ELSE '' END || CASE WHEN coalesce(mf.reason, '') <> '' THEN ' ' || mf.reason ELSE '' END ELSE coalesce(mf.reason, '') END) AS txt
   FROM flagged c LEFT JOIN rule r ON r.wb_id = c.wb_id AND r.key = c.key LEFT JOIN <<model_flags>> mf ON mf.wb_id = c.wb_id AND mf.label_cell = c.label_cell
   LEFT JOIN chit h ON h.wb_id = c.wb_id AND h.row = c.row AND h.col = c.col),
 b0 AS (SELECT *, edited_label_cell AS hard, regexp_matches(lower(txt), '{"|".join(tx.SAFE_BLANK_PHRASES)}') AS t_safe, regexp_matches(lower(txt), '{"|".join(tx.SAFE_BLANK_PHRASES + tx.CORRECT_PHRASES)}') AS t_ok FROM pre),
 b1 AS (SELECT *, NOT hard AND (m_ok OR in_correct OR (target IS NOT NULL AND blank) OR t_ok) AS base_correct, NOT hard AND (m_safe OR (target IS NOT NULL AND blank) OR t_safe) AS is_safe FROM b0),
 edge AS (SELECT i.wb_id, i.row AS i_row, i.col AS i_col, j.row, j.col FROM b1 i JOIN b1 j ON i.wb_id = j.wb_id AND {q_hit('i', 'j')} AND NOT i.hard AND NOT j.hard AND (i.row < j.row OR (i.row = j.row AND i.col < j.col))),
 spread AS (SELECT wb_id, row, col FROM b1 WHERE base_correct OR is_safe UNION SELECT e.wb_id, e.row, e.col FROM edge e JOIN spread s ON s.wb_id = e.wb_id AND s.row = e.i_row AND s.col = e.i_col),
 hits AS (SELECT DISTINCT e.wb_id, e.row, e.col FROM edge e JOIN spread s ON s.wb_id = e.wb_id AND s.row = e.i_row AND s.col = e.i_col),
 b2 AS (SELECT b.*, b.base_correct OR (h.row IS NOT NULL AND NOT b.hard) AS is_correct FROM b1 b LEFT JOIN hits h ON h.wb_id = b.wb_id AND h.row = b.row AND h.col = b.col),
 fin AS (SELECT *, CASE WHEN is_correct OR is_safe THEN 0 ELSE CAST(f_dup AS INT) + CAST(f_bad AS INT) + CAST(hard AS INT) + CAST(f_t AS INT) + CAST(f_h AS INT) + CAST(f_s AS INT) + CAST(target IS NOT NULL AND NOT blank AS INT) END AS score FROM b2),
 assessed AS (SELECT *, NOT (is_correct OR is_safe) AND (hard OR score >= 1) AS is_high_risk FROM fin)"""
WITH = "WITH RECURSIVE "
# Seven unrolled merge passes; sheets of the fixture hold at most a few dozen boxes.
MERGE = ", ".join(
    f"""m{i + 1} AS (SELECT DISTINCT wb_id, r0, c0, r1, c1 FROM (SELECT a.wb_id, min(b.r0) AS r0, min(b.c0) AS c0, max(b.r1) AS r1, max(b.c1) AS c1
      FROM m{i} a JOIN m{i} b ON a.wb_id = b.wb_id AND {q_hit('a', 'b', 1)} GROUP BY a.wb_id, a.r0, a.c0, a.r1, a.c1))"""
    for i in range(8)
)
CTES_TARGET = CTES_ASSESS + """,
 tgt AS (SELECT wb_id, sheet, 'label_area_edit' AS kind, key, r0, c0, r1, c1 FROM assessed WHERE NOT (is_correct OR is_safe) AND hard
   UNION ALL SELECT wb_id, sheet, 'high_risk_edit', key, r0, c0, r1, c1 FROM assessed WHERE is_high_risk
   UNION ALL SELECT wb_id, sheet, 'screenshot_bad_range', '', r0, c0, r1, c1 FROM bad)"""


def _box(t):
    if "boxes" not in t.kept:
        used = cut_lineage(g.used_bbox(t.saved("cells_f"), t.saved("merges")))
        t.kept["boxes"] = used, cut_lineage(g.form_bbox(t.pairs, used))
    return t.kept["boxes"]


def _cands(t):
    return cut_lineage(a.audit_candidates(t.saved("cells_f"), t.saved("merges"), t.pairs, t.form_edits, _box(t)[1]))


@query("e4_audit_candidates", WITH + CTES + " SELECT wb_id, sheet, label_cell, key, value_cell, current_value, is_actual_edit, edited_label_cell, r0, c0, r1, c1 FROM cand")
def _(t):
    return _cands(t).select(*g.KEYS, "label_cell", "key", "value_cell", "current_value", "is_actual_edit", "edited_label_cell", "r0", "c0", "r1", "c1")


@query("e5_duplicate_values", WITH + CTES + " SELECT wb_id, sheet, r0, c0, r1, c1, norm FROM dup")
def _(t):
    return a.duplicate_values(t.saved("cells_f"), t.saved("merges"), _box(t)[1])


@query("e6_duplicate_risk_regions", WITH + CTES_DUP + " SELECT * FROM dupreg")
def _(t):
    used, box = _box(t)
    return a.duplicate_risk_regions(t.saved("cells_f"), t.saved("merges"), box, used)


@query(
    "b10_expand_target",
    WITH + CTES + f" SELECT DISTINCT wb_id, sheet, r0, c0, r1, c1, e_r0, e_c0, e_r1, e_c1 FROM {q_expand('(SELECT DISTINCT * FROM bad)', D_COLS)}",
)
def _(t):
    return a.expand_target(t.bad_ranges.distinct(), t.merges, _box(t)[0])


FLAG_TEXT = "array_to_string(list_filter([CASE WHEN f_dup THEN 'duplicate_pattern' END, CASE WHEN edited_label_cell THEN 'label_area' END, CASE WHEN f_bad THEN 'screenshot_bad_range_hit' END], lambda x: x IS NOT NULL), ',')"


@query("e7_programmatic_flags", (WITH + CTES_FLAG).replace(" AS (SELECT", " AS MATERIALIZED (SELECT") + f" SELECT wb_id, sheet, label_cell, {FLAG_TEXT} AS flags FROM flagged")
def _(t):
    used, box = _box(t)
    d = a.programmatic_flags(_cands(t), a.duplicate_risk_regions(t.saved("cells_f"), t.saved("merges"), box, used), t.bad_ranges)
    return d.select(*g.KEYS, "label_cell", F.array_join("flags", ",").alias("flags"))


@query(
    "e8_reason_state",
    f"""SELECT wb_id, label_cell, regexp_matches(lower(reason), '{"|".join(tx.SAFE_BLANK_PHRASES + tx.CORRECT_PHRASES)}') AS correct, regexp_matches(lower(reason), '{"|".join(tx.SAFE_BLANK_PHRASES)}') AS safe_blank FROM <<model_flags>>""",
)
def _(t):
    return t.model_flags.select("wb_id", "label_cell", tx.reason_correct(F.col("reason")).alias("correct"), tx.reason_safe_blank(F.col("reason")).alias("safe_blank"))


def _assessed(t):
    used, box = _box(t)
    flagged = a.programmatic_flags(_cands(t), a.duplicate_risk_regions(t.saved("cells_f"), t.saved("merges"), box, used), t.bad_ranges, t.correct_ranges)
    return a.assess(flagged, t.model_flags, t.correct_ranges, t.policies, full=True)


Q_FLAGS = """array_to_string(list_sort(list_filter(CASE WHEN is_correct OR is_safe THEN [] ELSE [CASE WHEN f_dup THEN 'duplicate_pattern' END, CASE WHEN f_bad THEN 'screenshot_bad_range_hit' END, CASE WHEN hard THEN 'label_area' END,
  CASE WHEN f_t THEN 'template_inconsistency' END, CASE WHEN f_h THEN 'high_risk_pattern' END, CASE WHEN f_s THEN 'special_char_anomaly' END, CASE WHEN target IS NOT NULL AND NOT blank THEN 'planner_blank_violation' END] END, lambda x: x IS NOT NULL)), ',')"""
Q_REASON = "CASE WHEN hard AND txt = '' THEN 'A value was written into a detected key/label cell. Treat this as a label-area overwrite that must be repaired.' ELSE txt END"


@query("e9_assess", WITH + CTES_ASSESS + f" SELECT wb_id, sheet, label_cell, score, is_correct, is_safe, is_high_risk, {Q_FLAGS} AS flags, {Q_REASON} AS reason FROM assessed")
def _(t):
    d = _assessed(t).withColumn("flags", F.array_join("flags", ","))
    return d.select(*g.KEYS, "label_cell", "score", "is_correct", "is_safe", "is_high_risk", "flags", "reason")


@query(
    "e10_direct_range_mode",
    WITH + CTES + f" SELECT c.wb_id, c.sheet, c.label_cell, EXISTS (SELECT 1 FROM bad b WHERE b.wb_id = c.wb_id AND {q_hit('c', 'b')}) AS is_high_risk FROM cand c",
)
def _(t):
    return a.direct_range_mode(_cands(t), t.bad_ranges)[0].select(*g.KEYS, "label_cell", "is_high_risk")


@query("e11_repair_targets", WITH + CTES_TARGET + " SELECT wb_id, sheet, kind, key, r0, c0, r1, c1 FROM tgt")
def _(t):
    return a.repair_targets(_assessed(t), t.bad_ranges).select(*g.KEYS, "kind", "key", "r0", "c0", "r1", "c1")


@query(
    "e12_merge_touching_regions",
    f"WITH m0 AS (SELECT DISTINCT wb_id, r0, c0, r1, c1 FROM <<rects>>), {MERGE} SELECT wb_id, 'S1' AS sheet, r0, c0, r1, c1 FROM m8",
)
def _(t):
    return a.merge_touching_regions(t.rects)


JOBS = CTES_TARGET + f""", tx AS (SELECT t.*, e.e_r0, e.e_c0, e.e_r1, e.e_c1 FROM tgt t JOIN {q_expand('(SELECT DISTINCT wb_id, sheet, r0, c0, r1, c1 FROM tgt)', D_COLS)} e ON e.wb_id = t.wb_id AND e.r0 = t.r0 AND e.c0 = t.c0 AND e.r1 = t.r1 AND e.c1 = t.c1),
 m0 AS (SELECT DISTINCT wb_id, e_r0 AS r0, e_c0 AS c0, e_r1 AS r1, e_c1 AS c1 FROM tx), {MERGE},
 jobs AS (SELECT DISTINCT t.wb_id, t.sheet, {q_range('g.r0', 'g.c0', 'g.r1', 'g.c1')} AS region, g.r0 AS g_r0, g.c0 AS g_c0, g.r1 AS g_r1, g.c1 AS g_c1, t.kind, t.key, t.r0, t.c0, t.r1, t.c1
   FROM tx t JOIN m8 g ON g.wb_id = t.wb_id AND g.r0 <= t.e_r1 AND t.e_r0 <= g.r1 AND g.c0 <= t.e_c1 AND t.e_c0 <= g.c1)"""


def jobs_of(t):
    return a.audit_round(t.saved("cells_f"), t.saved("merges"), t.pairs, t.form_edits, t.model_flags, t.bad_ranges, t.correct_ranges, t.policies, full=True)[1]


@query("e13_patch_jobs", WITH + JOBS + " SELECT wb_id, sheet, region, kind, key, r0, c0, r1, c1 FROM jobs")
def _(t):
    return jobs_of(t).select(*g.KEYS, "region", "kind", "key", "r0", "c0", "r1", "c1")


@query(
    "flagship_audit_round",
    WITH + JOBS + " SELECT wb_id, sheet, region, count(*) AS n_targets, count(*) FILTER (kind = 'label_area_edit') AS n_label_area, count(*) FILTER (kind = 'high_risk_edit') AS n_high_risk FROM jobs GROUP BY 1, 2, 3",
)
def _(t):
    n = lambda k: F.count_if(F.col("kind") == k)
    return jobs_of(t).groupBy(*g.KEYS, "region").agg(
        F.count("*").alias("n_targets"), n("label_area_edit").alias("n_label_area"), n("high_risk_edit").alias("n_high_risk")
    )


@query(
    "e31_bad_and_correct_ranges",
    f"""SELECT wb_id, range_kind, a1 AS "range", CAST(row_number() OVER (PARTITION BY wb_id, range_kind ORDER BY a1) AS INT) AS pos FROM (
      SELECT DISTINCT wb_id, 'bad' AS range_kind, {q_range('r0', 'c0', 'r1', 'c1')} AS a1 FROM <<bad_ranges>> UNION SELECT DISTINCT wb_id, 'correct', {q_range('r0', 'c0', 'r1', 'c1')} FROM <<correct_ranges>>)""",
)
def _(t):
    from formloom.functions import ranges as rg

    one = lambda d, k: d.select("wb_id", F.lit(k).alias("range_kind"), rg.a1_range(*[F.col(c) for c in g.RECT]).alias("range"))
    return a.bad_and_correct_ranges(one(t.bad_ranges, "bad").unionByName(one(t.correct_ranges, "correct")), ["wb_id"])
