"""Keys, similarity and label matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.functions import text as tx
from formloom.operators import grid as g
from formloom.operators import match as m
from formloom.operators import similar as sim
from formloom.plans.queries_grid import CONTENT, Q_ANCHOR, Q_CAND, Q_FORM, Q_LABELS, Q_PAIR_RECTS, Q_TYPED, Q_USED
from formloom.plans.registry import q_cell, q_key, query

STRAY = "'  ' || upper(p_name) || '_' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' :' WHEN p_partkey % 3 = 1 THEN ' 名称' ELSE ' (#' || p_size || ')' END"


def stray(t):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, " :").when(k % 3 == 1, " 名称").otherwise(F.concat(F.lit(" (#"), F.col("p_size").cast("string"), F.lit(")")))
    return t.part.select(k, F.concat(F.lit("  "), F.upper("p_name"), F.lit("_"), F.col("p_type"), tail).alias("txt"))


@query("d1_normalize_key", f"SELECT p_partkey, {q_key('txt')} AS norm FROM (SELECT p_partkey, {STRAY} AS txt FROM part)")
def _(t):
    return stray(t).select("p_partkey", tx.normalize_key(F.col("txt")).alias("norm"))


@query("d1_normalize_key_unicode", f"SELECT p_partkey, regexp_replace(lower(trim(txt)), '\\s+', ' ', 'g') AS norm FROM (SELECT p_partkey, {STRAY} AS txt FROM part)")
def _(t):
    return stray(t).select("p_partkey", tx.normalize_key(F.col("txt"), "unicode").alias("norm"))


@query("d2_normalize_compare", "SELECT doc_id, md5(regexp_replace(lower(trim(text, ' ' || chr(10) || chr(9))), '\\s+', ' ', 'g')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.normalize_compare(F.col("text")).cast("binary")).alias("h"))


@query(
    "d3_trim_to",
    "SELECT doc_id, CASE WHEN length(x) > 220 THEN substring(x, 1, 217) || '...' ELSE x END AS cut FROM (SELECT doc_id, regexp_replace(trim(text, ' ' || chr(10) || chr(9)), '\\s+', ' ', 'g') AS x FROM documents)",
)
def _(t):
    return t.documents.select("doc_id", tx.trim_to(F.col("text"), 220).alias("cut"))


@query("d4_blankish", f"SELECT wb_id, sheet, row, col, NOT {CONTENT} AS blank FROM <<cells_f>>")
def _(t):
    return t.cells_f.select(*g.POS, tx.blankish(F.col("value"), F.col("value_type")).alias("blank"))


def q_tok(x: str) -> str:
    return f"list_filter(list_distinct(string_split({x}, ' ')), lambda w: w <> '')"


def q_jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({q_tok(a)}, {q_tok(b)})) / greatest(1, len(list_distinct(list_concat({q_tok(a)}, {q_tok(b)})))))"


def q_overlap(a: str, b: str) -> str:
    return f"(len(list_intersect({q_tok(a)}, {q_tok(b)})) / greatest(1, least(len({q_tok(a)}), len({q_tok(b)}))))"


def q_native(a: str, b: str) -> str:
    contains = f"CASE WHEN (contains({a}, {b}) OR contains({b}, {a})) AND least(length({a}), length({b})) >= 4 THEN 1.0 ELSE 0.0 END"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE greatest({q_jaccard(a, b)}, {contains}) END)"


NAMES = "(SELECT p_partkey, lower(p_name || ' ' || p_type) AS a, lower(p_type || CASE WHEN p_size % 3 = 0 THEN ' item' ELSE '' END) AS b FROM part)"


def names(t):
    return t.part.select(
        "p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("a"),
        F.lower(F.concat("p_type", F.when(F.col("p_size") % 3 == 0, " item").otherwise(""))).alias("b"),
    )


@query("d5_token_similarity", f"SELECT p_partkey, {q_jaccard('a', 'b')} AS jaccard, {q_overlap('a', 'b')} AS overlap_min FROM {NAMES}")
def _(t):
    a, b = F.col("a"), F.col("b")
    return names(t).select("p_partkey", tx.token_jaccard(a, b).alias("jaccard"), tx.token_overlap_min(a, b).alias("overlap_min"))


@query("d6_contains_either", f"SELECT p_partkey, (contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) >= 6 AS hit FROM {NAMES}")
def _(t):
    return names(t).select("p_partkey", tx.contains_either(F.col("a"), F.col("b"), 6).alias("hit"))


def _brand_texts(t):
    d = t.part.select(
        F.col("p_brand").alias("brand"), F.col("p_size"),
        tx.normalize_key(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")))).alias("norm"),
    )
    return d.filter("p_size % 2 = 0").select("brand", "norm").distinct(), d.filter("p_size % 2 = 1").select("brand", "norm").distinct()


Q_BRAND = "(SELECT DISTINCT p_brand AS brand, p_size % 2 AS side, lower(p_name || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_type ELSE '' END) AS norm FROM part)"


@query(
    "d8_soft_key_native",
    f"SELECT brand, a, b, score FROM (SELECT x.brand, x.norm AS a, y.norm AS b, {q_native('x.norm', 'y.norm')} AS score FROM {Q_BRAND} x JOIN {Q_BRAND} y ON x.brand = y.brand AND x.side = 0 AND y.side = 1) WHERE score >= 0.6",
)
def _(t):
    a, b = _brand_texts(t)
    return sim.similar_pairs(a, b, ["brand"], 0.6, full=False)


@query("d8_soft_key_full")
def _(t):
    a, b = _brand_texts(t)
    return sim.similar_pairs(a, b, ["brand"], 0.74, full=True).withColumn("score", F.round("score", 6))


# One differing letter before runs of different length: the ratio is twice the shorter run over all letters. The left texts
# reach past 200 letters; the right ones stay below, where the matcher takes every letter into account.
Q_RUNS = "SELECT DISTINCT p_brand AS brand, 'w' || repeat('a', 100 + 4 * p_size) AS a FROM part WHERE p_partkey % 2 = 0"


@query(
    "d8_soft_key_long",
    f"""WITH l AS ({Q_RUNS}), r AS (SELECT DISTINCT p_brand AS brand, 'q' || repeat('a', 60 + 2 * p_size) AS b FROM part WHERE p_partkey % 2 = 1)
    SELECT brand, a, b, round(2.0::DOUBLE * (least(length(a), length(b)) - 1) / (length(a) + length(b)), 6) AS score FROM l JOIN r USING (brand)
    WHERE 2.0::DOUBLE * (least(length(a), length(b)) - 1) / (length(a) + length(b)) >= 0.74""",
)
def _(t):
    left = t.part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("brand"), F.concat(F.lit("w"), F.repeat(F.lit("a"), 100 + 4 * F.col("p_size"))).alias("norm"))
    right = t.part.where("p_partkey % 2 = 1").select(F.col("p_brand").alias("brand"), F.concat(F.lit("q"), F.repeat(F.lit("a"), 60 + 2 * F.col("p_size"))).alias("norm"))
    return sim.similar_pairs(left.distinct(), right.distinct(), ["brand"], 0.74, full=True).withColumn("score", F.round("score", 6))


@query(
    "d9_text_sim",
    f"SELECT p_partkey, CASE WHEN na = nb THEN 1.0 ELSE {q_jaccard('na', 'nb')} END AS sim FROM (SELECT p_partkey, replace(lower(p_name || '/' || p_type), '/', ' ') AS na, replace(lower(p_type || '-' || p_brand), '-', ' ') AS nb FROM part)",
)
def _(t):
    return t.part.select("p_partkey", tx.text_sim(F.concat_ws("/", "p_name", "p_type"), F.concat_ws("-", "p_type", "p_brand"), full=False).alias("sim"))


@query("d9_text_sim_full")
def _(t):
    sim_of = tx.text_sim(F.concat_ws("/", "p_name", "p_type"), F.concat_ws("-", "p_type", "p_brand"))
    return t.part.select("p_partkey", F.round(sim_of, 6).alias("sim"))


@query(
    "d10_keys_soft_match",
    f"SELECT x.brand, x.norm AS a, y.norm AS b FROM {Q_BRAND} x JOIN {Q_BRAND} y ON x.brand = y.brand AND x.side = 0 AND y.side = 1 WHERE contains(x.norm, y.norm) OR contains(y.norm, x.norm) OR {q_overlap('x.norm', 'y.norm')} >= 0.75",
)
def _(t):
    a, b = _brand_texts(t)
    return sim.soft_match_pairs(a, b, ["brand"])


ODD = """CASE event_id % 9 WHEN 0 THEN ' yes ' WHEN 1 THEN '$1,' || (100 + event_id % 900) || '.50' WHEN 2 THEN 'N/A' WHEN 3 THEN event_type || '  Date:'
 WHEN 4 THEN '12-05/' || (2000 + event_id % 30) WHEN 5 THEN '' WHEN 6 THEN (event_id % 50) || 'b' WHEN 7 THEN '-- ?' ELSE repeat(event_type, 12) END"""


def odd(t):
    return t.spark.sql("SELECT event_id, " + ODD + " AS txt FROM {e}", e=t.events)


Q_ODD = f"(SELECT event_id, regexp_replace(trim(txt), '\\s+', ' ', 'g') AS x FROM (SELECT event_id, {ODD} AS txt FROM events))"
ALNUM = "regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')"
NO_WORD = "regexp_full_match(x, '[0-9\\W_]+')"


@query(
    "d11_probable_key",
    f"SELECT event_id, x <> '' AND length(x) <= 64 AND length({ALNUM}) > 1 AND NOT {NO_WORD} AND NOT regexp_full_match(x, '[$]?[0-9][0-9,./:-]*%?') AND lower(x) NOT IN ('yes', 'no', 'n/a', 'na') AS probable FROM {Q_ODD}",
)
def _(t):
    return odd(t).select("event_id", tx.probable_key(F.col("txt")).alias("probable"))


@query("d12_noisy_key", f"SELECT event_id, x = '' OR {NO_WORD} OR length({ALNUM}) <= 1 OR regexp_full_match({ALNUM}, '[0-9]+[A-Za-z]?') AS noisy FROM {Q_ODD}")
def _(t):
    return odd(t).select("event_id", tx.noisy_key(F.col("txt")).alias("noisy"))


def q_best(targets: str, labels: str, t: float) -> str:
    return f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, target ORDER BY score DESC, l_row, l_col) AS rn FROM (
      SELECT DISTINCT a.wb_id, a.sheet, a.target, b.row AS l_row, b.col AS l_col, b.text AS l_text, {q_native(q_key('a.target'), q_key('b.text'))} AS score
      FROM (SELECT DISTINCT wb_id, sheet, target FROM {targets}) a JOIN {labels} b USING (wb_id, sheet)) WHERE score >= {t}) WHERE rn = 1)"""


Q_TEXT_TARGETS = "(SELECT * FROM <<targets>> WHERE NOT regexp_full_match(target, '[A-Za-z]+[0-9]+(:[A-Za-z]+[0-9]+)?'))"


@query("d13_best_label", f"SELECT wb_id, sheet, target, l_row, l_col, l_text, round(score, 6) AS score FROM {q_best(Q_TEXT_TARGETS, Q_LABELS, 0.74)}")
def _(t):
    tg = t.targets.select(*g.KEYS, "target").distinct().filter("NOT target rlike '^[A-Za-z]+[0-9]+(:[A-Za-z]+[0-9]+)?$'")
    return m.best_label(tg, g.labels(t.cells_t), 0.74, full=True).withColumn("score", F.round("score", 6))


Q_WRITABLE = f"(SELECT wb_id, sheet, row, col FROM {Q_CAND} UNION SELECT wb_id, sheet, r0, 2 FROM {Q_PAIR_RECTS})"
Q_PROBES = ", ".join(f"({i}, {r}, {c})" for i, (r, c) in enumerate(m.PROBES))


def q_guess(labels: str) -> str:
    return f"""(SELECT wb_id, sheet, row, col, arg_min(v_row, k) AS v_row, arg_min(v_col, k) AS v_col FROM (
      SELECT p.*, CASE WHEN w.row IS NOT NULL THEN i WHEN l.row IS NULL THEN 100 + i END AS k FROM (
        SELECT a.wb_id, a.sheet, a.row, a.col, i, coalesce(x.r0, a.row + dr) AS v_row, coalesce(x.c0, a.col + dc) AS v_col FROM {labels} a
        CROSS JOIN (VALUES {Q_PROBES}) f(i, dr, dc) LEFT JOIN {Q_ANCHOR} x ON x.wb_id = a.wb_id AND x.row = a.row + dr AND x.col = a.col + dc) p
      LEFT JOIN {Q_WRITABLE} w ON w.wb_id = p.wb_id AND w.row = p.v_row AND w.col = p.v_col
      LEFT JOIN {Q_LABELS} l ON l.wb_id = p.wb_id AND l.row = p.v_row AND l.col = p.v_col
      WHERE p.v_row <> p.row OR p.v_col <> p.col) WHERE k IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("d14_guess_value_cell", f"SELECT * FROM {q_guess(Q_LABELS)}")
def _(t):
    lab = g.labels(t.cells_t)
    w = g.input_cells(t.pairs, t.merges).unionByName(g.input_candidates(t.cells_t, t.merges)).distinct()
    return m.guess_value_cell(lab, t.merges, w, lab)


def q_rank(labels: str, n: int, label_cells: str = Q_LABELS) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, l_row, l_col ORDER BY score DESC, row, col) AS rank FROM (
      SELECT c.wb_id, c.sheet, l.row AS l_row, l.col AS l_col, c.row, c.col, c.kind,
        CASE WHEN c.col - l.col >= 1 THEN CAST(2.2 AS DOUBLE) / (1.0 + CAST(0.35 AS DOUBLE) * abs(c.row - l.row) + (c.col - l.col))
        WHEN c.row > l.row THEN CAST(1.3 AS DOUBLE) / (1.0 + CAST(0.45 AS DOUBLE) * abs(c.col - l.col) + abs(c.row - l.row))
        ELSE CAST(0.5 AS DOUBLE) / (1.0 + abs(c.row - l.row) + abs(c.col - l.col)) END
        + CAST(CASE c.kind WHEN 'boxed' THEN 0.12 WHEN 'bottom_line' THEN 0.08 ELSE 0.05 END AS DOUBLE) AS score
      FROM {Q_TYPED} c JOIN (SELECT DISTINCT wb_id, sheet, row, col FROM {labels}) l USING (wb_id, sheet)
      WHERE (c.row <> l.row OR c.col <> l.col) AND NOT EXISTS (SELECT 1 FROM {label_cells} z WHERE z.wb_id = c.wb_id AND z.row = c.row AND z.col = c.col)) WHERE score > 0.24) WHERE rank <= {n})"""


@query("d15_rank_candidates", f"SELECT wb_id, sheet, l_row, l_col, row, col, kind, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM {q_rank(Q_LABELS, 3)}")
def _(t):
    lab = g.labels(t.cells_t)
    return m.rank_candidates(lab, g.typed_candidates(t.cells_t, t.merges), lab, 3).withColumn("score", F.round("score", 6))


Q_TEXT = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"
Q_HINTS = f"""WITH p AS (SELECT wb_id, sheet, pair_idx, key_text, value_cell, {Q_TEXT.format('key_text')} AS nk,
   CASE WHEN regexp_full_match(value_cell, 'B[0-9]+') THEN CAST(regexp_extract(value_cell, '([0-9]+)', 1) AS INT) WHEN regexp_full_match(value_cell, 'A[0-9]+') THEN CAST(regexp_extract(value_cell, '([0-9]+)', 1) AS INT) END AS q_row,
   CASE WHEN regexp_full_match(value_cell, 'B[0-9]+') THEN 2 WHEN regexp_full_match(value_cell, 'A[0-9]+') THEN 1 END AS q_col FROM <<slot_pairs>> WHERE trim(key_text) <> ''),
 s AS (SELECT p.*, l.row AS l_row, l.col AS l_col, CASE WHEN nk = {Q_TEXT.format('l.text')} THEN 1.0 ELSE {q_jaccard("replace(replace(nk, '/', ' '), '-', ' ')", "replace(replace(" + Q_TEXT.format('l.text') + ", '/', ' '), '-', ' ')")} END AS sim
   FROM p JOIN {Q_LABELS} l USING (wb_id, sheet)),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, pair_idx ORDER BY sim DESC, l_row, l_col) AS rn FROM s WHERE sim > 0) WHERE rn = 1),
 j AS (SELECT p.wb_id, p.sheet, p.pair_idx, b.l_row, b.l_col, coalesce(round(b.sim, 4), 0) AS label_score, c.row, c.col, c.kind, p.q_row, p.q_col,
   CAST(CASE c.kind WHEN 'boxed' THEN 0.12 WHEN 'bottom_line' THEN 0.08 ELSE 0.05 END AS DOUBLE) AS bonus
   FROM p LEFT JOIN b USING (wb_id, pair_idx) JOIN {Q_TYPED} c ON c.wb_id = p.wb_id),
 f AS (SELECT *, least(1.0, CASE WHEN l_row IS NULL THEN 0.0 ELSE CAST(0.65 AS DOUBLE) * CASE WHEN col - l_col >= 1 THEN 1.0 ELSE 0.5 END + CAST(0.35 AS DOUBLE) / (1.0 + abs(row - l_row) + CAST(0.35 AS DOUBLE) * abs(col - l_col)) END + bonus) AS st,
   coalesce(CAST(1.0 AS DOUBLE) / (1.0 + abs(row - q_row) + abs(col - q_col)), 0.0) AS md FROM j),
 r AS (SELECT *, round_even(CAST(0.7 AS DOUBLE) * st + CAST(0.3 AS DOUBLE) * md, 4) AS final_score FROM f),
 k AS (SELECT *, row_number() OVER (PARTITION BY wb_id, pair_idx ORDER BY final_score DESC, row, col) AS rank FROM r)
 SELECT wb_id, sheet, pair_idx, l_row, l_col, label_score, row, col, kind, final_score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3"""


@query("d16_fused_hints", Q_HINTS)
def _(t):
    p = t.slot_pairs.withColumn("pair_id", F.col("pair_idx"))
    c = t.saved("cells_t")
    d = m.fused_hints(p, g.labels(c), g.typed_candidates(c, t.merges), g.used_bbox(c, t.merges), full=True)
    d = d.filter("row is not null")
    return d.select(*g.KEYS, F.col("pair_id").alias("pair_idx"), "l_row", "l_col", "label_score", "row", "col", "kind", "final_score", "rank")


Q_SLOTS = """(SELECT *, CASE WHEN value_cell LIKE 'a1%' THEN 1 ELSE CAST(regexp_extract(value_cell, '([0-9]+)', 1) AS INT) END AS r0, CASE WHEN value_cell LIKE 'B%' THEN 2 ELSE 1 END AS c0,
  CAST(regexp_extract(value_cell, '([0-9]+)$', 1) AS INT) AS r1, CASE WHEN value_cell LIKE 'A%' THEN 1 ELSE 2 END AS c1 FROM <<slot_pairs>> WHERE value_cell <> '')"""
Q_RESOLVED = f"""(WITH own AS (SELECT DISTINCT s.wb_id, s.pair_idx FROM {Q_SLOTS} s JOIN <<cells_t>> c ON c.wb_id = s.wb_id AND {q_key('c.value')} = {q_key('s.key_text')} AND {q_key('c.value')} <> ''
    LEFT JOIN {Q_ANCHOR} x ON x.wb_id = c.wb_id AND x.row = c.row AND x.col = c.col
    WHERE (x.r0 IS NULL OR (x.r0 = c.row AND x.c0 = c.col)) AND s.r0 <= coalesce(x.r1, c.row) AND c.row <= s.r1 AND s.c0 <= coalesce(x.c1, c.col) AND c.col <= s.c1),
  st AS (SELECT s.*, o.wb_id IS NOT NULL AS self, nullif(CASE WHEN invalidated_reason <> '' THEN invalidated_reason ELSE reason END, '') AS raw FROM {Q_SLOTS} s LEFT JOIN own o USING (wb_id, pair_idx)),
  lab AS (SELECT wb_id, sheet, pair_idx, slot_id, key_text AS key, value_cell, CASE WHEN NOT is_valid_slot OR key_text = '' THEN 'invalid' WHEN self THEN 'self_label' ELSE 'pair' END AS status,
    CASE WHEN NOT is_valid_slot THEN coalesce(raw, 'qwen_marked_invalid_slot') WHEN key_text = '' THEN coalesce(raw, 'missing_key_text') WHEN self THEN 'pipeline_invalid_self_label_value_cell' END AS reason FROM st)
  SELECT * FROM lab WHERE status = 'pair' UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, slot_id, upper(value_cell), {q_key('key')}, reason ORDER BY pair_idx) AS rn FROM lab WHERE status <> 'pair') WHERE rn = 1)"""


@query("d17_resolve_form", f"SELECT wb_id, sheet, pair_idx, slot_id, key, value_cell, status, reason FROM {Q_RESOLVED}")
def _(t):
    return m.resolve_form(t.slot_pairs, t.cells_t, t.merges)


@query(
    "d18_match_edit_key",
    f"""SELECT e.wb_id, e.sheet, e.seq, e.target_cell, coalesce(p.key, '') AS key FROM <<form_edits>> e LEFT JOIN {Q_PAIR_RECTS} p
      ON p.wb_id = e.wb_id AND e.target_cell LIKE 'B%' AND p.r0 = CAST(substring(e.target_cell, 2) AS INT)""",
)
def _(t):
    return m.match_edit_key(t.form_edits, t.pairs).select(*g.KEYS, "seq", "target_cell", "key")


KV = "SELECT CAST(o AS STRING) AS wb_id, ln AS kv_idx, CASE p % 3 WHEN 0 THEN 'order-qty' WHEN 1 THEN ' QUANTITY : ' ELSE 'return_flag' END AS key, 'v' || CAST(q AS STRING) AS value FROM ({li})"
Q_LOG = f"""(SELECT p.wb_id, p.sheet, p.pair_idx, p.key, p.value_cell, k.value, p.r0 AS a_row, 2 AS a_col FROM {Q_PAIR_RECTS} p JOIN (
   SELECT wb_id, norm, arg_min(value, kv_idx) AS value FROM (SELECT CAST(o AS VARCHAR) AS wb_id, ln AS kv_idx, {q_key("CASE p % 3 WHEN 0 THEN 'order-qty' WHEN 1 THEN ' QUANTITY : ' ELSE 'return_flag' END")} AS norm, 'v' || q AS value FROM <<li>>) GROUP BY 1, 2) k
   ON k.wb_id = p.wb_id AND k.norm = {q_key('p.key')})"""


def kv_of(t):
    from formloom.plans.fixtures import SQL

    return t.sql(KV.replace("{li}", SQL["li"]))


@query("d19_fill_log", f"SELECT * FROM {Q_LOG}")
def _(t):
    return m.fill_log(t.pairs, kv_of(t), t.merges)


@query(
    "d19_fill_by_key",
    f"""SELECT c.wb_id, c.sheet, c.row, c.col, CASE WHEN l.value IS NOT NULL THEN l.value ELSE c.value END AS value, CASE WHEN l.value IS NOT NULL THEN 's' ELSE c.value_type END AS value_type
      FROM <<cells_t>> c LEFT JOIN (SELECT wb_id, a_row, a_col, arg_max(value, pair_idx) AS value FROM {Q_LOG} GROUP BY 1, 2, 3) l ON l.wb_id = c.wb_id AND l.a_row = c.row AND l.a_col = c.col""",
)
def _(t):
    return m.fill_by_key(t.cells_t, m.fill_log(t.pairs, kv_of(t), t.merges)).select(*g.POS, "value", "value_type")


@query(
    "d20_parse_kv_text",
    """SELECT doc_id, key, arg_max(value, i) AS value FROM (SELECT doc_id, i, trim(CASE WHEN contains(line, ':') THEN substring(line, 1, instr(line, ':') - 1) ELSE substring(line, 1, instr(line, '=') - 1) END) AS key,
      trim(CASE WHEN contains(line, ':') THEN substring(line, instr(line, ':') + 1) ELSE substring(line, instr(line, '=') + 1) END) AS value FROM (
      SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM <<kv_texts>>)
      WHERE line NOT LIKE '#%' AND (contains(line, ':') OR contains(line, '='))) WHERE key <> '' GROUP BY 1, 2
      UNION ALL SELECT c_custkey + 10000000, 'Name', c_name FROM customer UNION ALL SELECT c_custkey + 10000000, 'bal', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer
      UNION ALL SELECT c_custkey + 20000000, 'Segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey + 20000000, 'n', CAST(c_nationkey AS VARCHAR) FROM customer""",
)
def _(t):
    c = t.customer
    obj = c.select((F.col("c_custkey") + 10000000).alias("doc_id"), F.to_json(F.struct(F.col("c_name").alias("Name"), F.floor("c_acctbal").alias("bal"))).alias("text"))
    lst = c.select((F.col("c_custkey") + 20000000).alias("doc_id"), F.concat(
        F.lit('[{"key": " Segment", "value": "'), F.col("c_mktsegment"), F.lit('"}, {"name": "n", "value": "'), F.col("c_nationkey").cast("string"), F.lit('"}]')).alias("text"))
    docs = t.kv_texts.select("doc_id", "text").unionByName(obj).unionByName(lst)
    return m.parse_kv_text(docs).select("doc_id", "key", "value")


Q_BLANK = """(SELECT wb_id, CASE WHEN kind = 'blank_policy' THEN kind ELSE 'uncertain_blank' END AS kind, pol_idx + CASE WHEN kind = 'blank_policy' THEN 0 ELSE 1048576 END AS pol_idx, target,
  CASE WHEN kind <> 'blank_policy' AND reason = '' THEN lower(trim(action)) ELSE reason END AS reason FROM <<policies>> WHERE kind = 'blank_policy' OR lower(trim(action)) IN ('leave_blank', 'skip'))"""
Q_FOR_KEY = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, key ORDER BY score DESC, pol_idx) AS rn FROM (
  SELECT k.wb_id, k.key, p.kind AS policy_kind, p.target AS policy_target, p.reason AS policy_reason, p.pol_idx, {q_native(q_key('k.key'), q_key('p.target'))} AS score
  FROM (SELECT DISTINCT wb_id, text AS key FROM {Q_LABELS}) k JOIN {Q_BLANK} p USING (wb_id)) WHERE score >= 0.74) WHERE rn = 1)"""


@query(
    "d21_policy_guard_cells",
    f"""WITH b AS {q_best('(SELECT *, ' + "'S1' AS sheet FROM " + Q_BLANK + ')', Q_LABELS, 0.74)}, r AS {q_rank('(SELECT wb_id, sheet, l_row AS row, l_col AS col FROM b)', 2)}
      SELECT wb_id, sheet, row, col, arg_min(why, k) AS protect_reason FROM (SELECT r.wb_id, r.sheet, r.row, r.col, p.pol_idx * 10 + r.rank AS k,
        'planner ' || p.kind || ' target ''' || p.target || ''' should remain blank' || CASE WHEN p.reason <> '' THEN ' (' || p.reason || ')' ELSE '' END AS why
        FROM {Q_BLANK} p JOIN b ON b.wb_id = p.wb_id AND b.target = p.target JOIN r ON r.wb_id = b.wb_id AND r.l_row = b.l_row AND r.l_col = b.l_col) GROUP BY 1, 2, 3, 4""",
)
def _(t):
    c = t.saved("cells_t")
    return m.policy_guard_cells(t.policies, g.labels(c), g.typed_candidates(c, t.merges), n=2)


@query("d22_blank_policy_for_key", f"SELECT wb_id, key, policy_kind, policy_target, policy_reason, round(score, 4) AS match_score FROM {Q_FOR_KEY}")
def _(t):
    keys = g.labels(t.cells_t).select("wb_id", F.col("text").alias("key"))
    return m.blank_policy_for_key(keys, t.policies, full=True)


Q_ANY = f"(SELECT wb_id, sheet, row, col, trim(value) AS text FROM <<cells_f>> WHERE {CONTENT})"
Q_CONTEXT = f"""WITH tg AS (SELECT * FROM (SELECT *, greatest(1, least(4, radius)) AS rad, row_number() OVER (PARTITION BY wb_id ORDER BY target_idx) AS rn FROM <<targets>>) WHERE rn <= 4),
 tt AS (SELECT * FROM tg WHERE NOT regexp_full_match(target, '[A-Za-z]+[0-9]+(:[A-Za-z]+[0-9]+)?')),
 ta AS (SELECT *, CAST(regexp_extract(target, '([0-9]+)', 1) AS INT) AS r, CAST(regexp_extract(target, '([0-9]+)$', 1) AS INT) AS rr FROM tg WHERE regexp_full_match(target, '[A-Za-z]+[0-9]+(:[A-Za-z]+[0-9]+)?')),
 b AS {q_best('tt', Q_ANY, 0.6)}, rk AS {q_rank('(SELECT wb_id, sheet, l_row AS row, l_col AS col FROM b)', 2, Q_ANY)}, fr AS (SELECT wb_id, l_row, l_col, max(col) AS far FROM rk GROUP BY 1, 2, 3),
 u AS (SELECT * FROM {Q_USED}),
 items AS (SELECT tt.wb_id, tt.sheet, target_idx, 'target_text' AS match_kind, greatest(u.r0, b.l_row - rad) AS r0, greatest(u.c0, b.l_col - 2) AS c0, least(u.r1, b.l_row + rad) AS r1,
    least(u.c1, greatest(b.l_col + greatest(4, rad * 2), coalesce(far, 0))) AS c1 FROM tt JOIN b ON b.wb_id = tt.wb_id AND b.target = tt.target LEFT JOIN fr ON fr.wb_id = b.wb_id AND fr.l_row = b.l_row AND fr.l_col = b.l_col JOIN u ON u.wb_id = tt.wb_id
   UNION ALL SELECT wb_id, sheet, target_idx, 'a1_range', CASE WHEN e THEN x0 ELSE n0 END, CASE WHEN e THEN x1 ELSE n1 END, CASE WHEN e THEN x2 ELSE n2 END, CASE WHEN e THEN x3 ELSE n3 END FROM (SELECT *, n0 > n2 OR n1 > n3 AS e FROM (
    SELECT ta.wb_id, ta.sheet, target_idx, u.r0 AS x0, u.c0 AS x1, u.r1 AS x2, u.c1 AS x3, greatest(u.r0, r - rad) AS n0, greatest(u.c0, 2 - greatest(2, rad * 2)) AS n1, least(u.r1, rr + rad) AS n2, least(u.c1, 3 + greatest(2, rad * 2)) AS n3 FROM ta JOIN u ON u.wb_id = ta.wb_id)))
 SELECT i.wb_id, i.sheet, i.target_idx, i.match_kind, i.r0, i.c0, i.r1, i.c1, count(c.row) AS n_cells, coalesce(min(c.text), '') AS first_text FROM items i LEFT JOIN {Q_ANY} c ON c.wb_id = i.wb_id AND c.row BETWEEN i.r0 AND i.r1 AND c.col BETWEEN i.c0 AND i.c1 GROUP BY ALL"""


def background(t, n_items: int | None):
    old, new = t.saved("cells_t"), t.saved("cells_f")
    items, inside = m.background_context(
        t.targets, new, t.merges, g.typed_candidates(old, t.merges), g.labels(new, any_value=True), g.used_bbox(old, t.merges), n_items=n_items, full=True,
    )
    n = inside.groupBy(*g.KEYS, "target_idx").agg(F.count("*").alias("n_cells"), F.min("text").alias("first_text"))
    out = items.join(n, [*g.KEYS, "target_idx"], "left").na.fill({"n_cells": 0, "first_text": ""})
    return out.select(*g.KEYS, "target_idx", "match_kind", "r0", "c0", "r1", "c1", "n_cells", "first_text")


# The limit of four targets a sheet is part of this query's SQL; the next query has none.
@query("d23_background_context", Q_CONTEXT)
def _(t):
    return background(t, 4)


@query("d23_background_context_all", Q_CONTEXT.replace(" WHERE rn <= 4", "", 1))
def _(t):
    return background(t, None)


@query(
    "d24_display_width",
    "SELECT doc_id, length(replace(x, chr(10), '')) + length(regexp_replace(x, '[^\\x{4E00}-\\x{9FFF}\\x{FF01}-\\x{FF60}]', '', 'g')) AS width FROM (SELECT doc_id, text || '名称！' || doc_id AS x FROM documents)",
)
def _(t):
    x = F.concat(F.col("text"), F.lit("名称！"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", tx.display_width(x).cast("bigint").alias("width"))
