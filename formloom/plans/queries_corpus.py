"""Sources, scoring, roll-ups and the edit stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from formloom.operators import markup as mk
from formloom.operators import score as sc
from formloom.plans.queries_audit import CTES_ASSESS, WITH, _assessed
from formloom.plans.registry import query
from formloom.session import shared_folder
from formloom.sources import readers as rd
from formloom.streaming import edits as st


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/formloom-{uuid.uuid4().hex}"


@query("a1_read_forms", "SELECT case_id, wb_id, sheet, pair_idx - 1 AS pair_idx, key, value_cell, value FROM (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY wb_id ORDER BY pair_idx) AS INT) AS pair_idx) FROM <<pairs>>)")
def _(t):
    """Forms written as one JSON object per form, then read back through the reader's schema."""
    p = t.pairs.withColumnRenamed("key", "label")
    forms = p.groupBy("case_id", F.col("wb_id").alias("excel"), "sheet").agg(F.array_sort(F.collect_list(F.struct("pair_idx", "label", "value_cell", "value"))).alias("pairs"))
    path = _folder(t)
    forms.select("case_id", "excel", "sheet", F.transform("pairs", lambda x: x.dropFields("pair_idx")).alias("pairs")).write.json(path)
    d = t.spark.read.schema("case_id string, " + rd.FORM).json(path)
    return d.select("case_id", F.col("excel").alias("wb_id"), "sheet", F.posexplode("pairs").alias("pair_idx", "p")).select(
        "case_id", "wb_id", "sheet", "pair_idx", F.col("p.label").alias("key"), "p.value_cell", "p.value"
    )


@query("a2_read_instructions", "SELECT doc_id, 'k' || lang AS key_text, source AS value_text, md5(trim(text, ' ' || chr(10) || chr(9))) AS narrative FROM documents")
def _(t):
    head = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("k"), F.col("lang")).alias("key_text"), F.col("source").alias("value_text"))).alias("pairs")))
    x = F.concat(F.lit("JSON:\n"), head, F.lit("\n\nNarrative:\n"), F.col("text"))
    d = t.documents.select("doc_id", F.inline(F.array(rd.split_instruction(x))))
    return d.select("doc_id", F.inline("pairs"), F.md5(F.col("narrative").cast("binary")).alias("narrative"))


@query("a3_read_manifests", "SELECT c_custkey, unnest([0, 1]) AS ord, unnest([c_name || '.TXT', 'b.md']) AS path FROM customer")
def _(t):
    k, n = F.col("c_custkey") % 3, F.col("c_name")
    lst = F.concat(F.lit('[" '), n, F.lit('.TXT ", "b.md", "", "'), F.lower(n), F.lit('.txt", "B.MD"]'))
    raw = F.when(k == 0, lst).when(k == 1, F.concat(F.lit('{"x": 1, "paths": '), lst, F.lit("}"))).otherwise(F.concat(n, F.lit(".TXT\n\n b.md\nB.md")))
    return t.customer.select("c_custkey", F.posexplode(rd.manifest_paths(raw)).alias("ord", "path"))


@query("a4_case_files", "SELECT CAST(c_nationkey AS VARCHAR) AS case_id, c_name AS copied_name, c_custkey % 4 = 0 AS missing FROM customer")
def _(t):
    c = t.customer.select(F.col("c_nationkey").cast("string").alias("case_id"), F.struct(F.lit("").alias("source_rel"), F.col("c_name").alias("copied_name"), F.lit("text").alias("bucket"), F.lit("md").alias("ext"), F.col("c_custkey").alias("size")).alias("f"))
    path = _folder(t)
    c.groupBy("case_id").agg(F.collect_list("f").alias("files")).write.json(path)
    have = t.customer.filter("c_custkey % 4 <> 0").select(F.col("c_nationkey").cast("string").alias("case_id"), F.col("c_name").alias("copied_name"))
    d = t.spark.read.schema(rd.MANIFEST).json(path).select("case_id", F.explode("files").alias("f")).select("case_id", "f.copied_name")
    gone = d.join(have, ["case_id", "copied_name"], "left_anti").withColumn("missing", F.lit(True))
    return d.join(gone, ["case_id", "copied_name"], "left").select("case_id", "copied_name", F.coalesce("missing", F.lit(False)).alias("missing"))


LOG = """SELECT CAST(user_id AS STRING) AS wb_id, event_id AS seq, CASE event_id % 6 WHEN 0 THEN '{{"sheet": "S1", "cell": "b' || CAST(1 + event_id % 9 AS STRING) || '", "old_value": 1, "new_value": "1"}}'
 WHEN 1 THEN '{{"sheet": "S1", "target_cell": "c2", "old_value": "x", "new_value": "x", "round_idx": 2, "source": "' || event_type || '"}}' WHEN 2 THEN 'broken {{' WHEN 3 THEN '' WHEN 4 THEN '{{"target_cell": "A1"}}'
 ELSE '{{"sheet": "S1", "target_cell": "D4", "is_actual_edit": true, "new_value": null}}' END AS line FROM {events}"""


@query(
    "a5_read_edit_log",
    "SELECT CAST(user_id AS VARCHAR) AS wb_id, event_id AS seq, 'S1' AS sheet, CASE event_id % 6 WHEN 0 THEN 'B' || (1 + event_id % 9) WHEN 1 THEN 'C2' ELSE 'D4' END AS target_cell, CASE WHEN event_id % 6 = 1 THEN 2 ELSE 0 END AS round_idx, CASE WHEN event_id % 6 = 1 THEN event_type ELSE 'agent_write' END AS source, event_id % 6 <> 1 AS is_actual_edit FROM events WHERE event_id % 6 IN (0, 1, 5)",
)
def _(t):
    return rd.parse_edit_log(t.sql(LOG)).select("wb_id", "seq", "sheet", "target_cell", "round_idx", "source", "is_actual_edit")


EXT = "['txt', 'JSON', 'xls', 'mhtml', 'eml', 'pptx', 'pdf', 'tiff', 'zip'][CAST(page_id % 9 AS INT) + 1]"


def paths(t):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("txt", "JSON", "xls", "mhtml", "eml", "pptx", "pdf", "tiff", "zip")]), (F.col("page_id") % 9 + 1).cast("int"))
    return t.pages.select("page_id", F.concat(F.col("url"), F.lit("/a.b/f."), ext).alias("path"))


@query("a6_format_family", f"SELECT page_id, lower({EXT}) AS file_type, ['text', 'structured', 'table', 'html', 'email', 'office', 'pdf', 'image', 'unknown'][CAST(page_id % 9 AS INT) + 1] AS family FROM pages")
def _(t):
    return paths(t).select("page_id", F.inline(F.array(rd.format_family(F.col("path")))))


@query("a7_input_plan", "SELECT page_id, CASE page_id % 9 WHEN 2 THEN 'excel' WHEN 6 THEN 'pdf' WHEN 7 THEN 'image' ELSE 'unsupported' END AS kind, page_id % 9 IN (2, 6, 7) AS needs_conversion, page_id % 9 IN (2, 6, 7) AS supported FROM pages")
def _(t):
    return paths(t).select("page_id", F.inline(F.array(rd.input_plan(F.col("path"))))).drop("converter")


@query("a8_read_delimited", "SELECT p_partkey AS doc_id, unnest([1, 2, 3]) AS row, unnest([p_name || '|a,\"b' || chr(10) || 'c|', 'x', p_type || '|']) AS cells FROM part")
def _(t):
    sep = F.when(F.col("p_partkey") % 2 == 0, "\t").otherwise(",")
    text = F.concat(F.col("p_name"), sep, F.lit('"a,""b\nc"'), sep, F.lit("\nx\r\n"), F.col("p_type"), sep)
    d = t.part.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 2 == 0, "f.tsv").otherwise("f.csv").alias("path"), text.alias("text"))
    return rd.parse_delimited(d).select("doc_id", "row", F.array_join("cells", "|").alias("cells"))


@query("a9_read_structured", "SELECT event_id AS doc_id, CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') ELSE 'oops' || event_id END AS k, event_id % 3 = 0 AS failed FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise(F.concat(F.lit("oops"), F.col("event_id").cast("string")))
    d = rd.parse_structured(t.events.select(F.col("event_id").alias("doc_id"), raw.alias("text")))
    v = lambda p: F.try_variant_get("tree", p, "string")
    return d.select("doc_id", F.coalesce(v("$.k"), v("$.raw_text")).alias("k"), (F.size("notes") > 0).alias("failed"))


def xml_orders(t):
    """An XML document for each order; every tenth is not well-formed."""
    c = lambda n: F.col(n).cast("string")
    line = F.concat(
        F.lit("\n  <line no='"), c("ln"), F.lit("'><part>P&amp;"), c("p"), F.lit("</part>"),
        F.when(F.col("q") % 2 == 0, F.concat(F.lit('<qty unit="pc">'), c("q"), F.lit("</qty>"))).otherwise(""),
        F.when(F.col("s") % 3 == 0, F.concat(F.lit("<tag>"), c("f"), F.lit("</tag> <tag>"), c("st"), F.lit("</tag>"))).otherwise(""), F.lit("</line>"),
    )
    d = t.li.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("ln", line.alias("x")))).alias("x"))
    text = F.concat(
        F.lit('<?xml version="1.0"?>\n<order id="'), c("o"), F.lit('"><!-- <lines> --><lines n="'), F.size("x").cast("string"), F.lit('"> all '),
        F.array_join(F.transform("x", lambda k: k["x"]), ""), F.when(F.col("o") % 10 == 0, "").otherwise("</lines>"), F.lit("<note/></order>"),
    )
    return d.select(F.col("o").alias("doc_id"), F.lit("order.xml").alias("path"), text.alias("text"))


@query(
    "a9_xml_tree",
    """WITH l AS (SELECT o, ln, '{"@attributes": {"no": "' || ln || '"}, "part": "P&' || p || '"' || CASE WHEN q % 2 = 0 THEN ', "qty": {"@attributes": {"unit": "pc"}, "#text": "' || q || '"}' ELSE '' END
      || CASE WHEN s % 3 = 0 THEN ', "tag": ["' || f || '", "' || st || '"]' ELSE '' END || '}' AS x FROM <<li>>),
      g AS (SELECT o, count(*) AS n, string_agg(x, ', ' ORDER BY ln) AS x FROM l GROUP BY 1)
      SELECT o AS doc_id, CASE WHEN o % 10 > 0 THEN '{"@attributes": {"id": "' || o || '"}, "lines": {"@attributes": {"n": "' || n || '"}, "line": ' || CASE WHEN n > 1 THEN '[' || x || ']' ELSE x END || ', "#text": "all"}, "note": ""}' END AS tree FROM g""",
)
def _(t):
    return mk.xml_trees(xml_orders(t))


@query(
    "a9_xml_structured",
    "SELECT o AS doc_id, CASE WHEN o % 10 > 0 THEN CAST(count(*) AS VARCHAR) END AS n, CASE WHEN o % 10 > 0 THEN '' END AS note, o % 10 = 0 AS failed FROM <<li>> GROUP BY 1",
)
def _(t):
    d = rd.parse_structured(xml_orders(t))
    v = lambda p: F.try_variant_get("tree", p, "string")
    return d.select("doc_id", v("$.lines['@attributes'].n").alias("n"), v("$.note").alias("note"), (F.size("notes") > 0).alias("failed"))


@query("a10_read_text", "SELECT doc_id, md5(text) AS h, FALSE AS latin1 FROM documents UNION ALL SELECT doc_id + 1000000, md5('caf' || chr(233) || doc_id), TRUE FROM documents UNION ALL SELECT doc_id + 2000000, md5('中文表' || doc_id), FALSE FROM documents")
def _(t):
    utf = t.documents.select("doc_id", F.encode(F.concat(F.lit("﻿"), F.col("text")), "UTF-8").alias("content"))
    lat = t.documents.select((F.col("doc_id") + 1000000).alias("doc_id"), F.encode(F.concat(F.lit("café"), F.col("doc_id").cast("string")), "ISO-8859-1").alias("content"))
    chinese = t.documents.select((F.col("doc_id") + 2000000).alias("doc_id"), F.concat(F.unhex(F.lit("D6D0CEC4B1ED")), F.col("doc_id").cast("string").cast("binary")).alias("content"))
    d = utf.unionByName(lat).unionByName(chinese).select("doc_id", F.inline(F.array(rd.decode_text(F.col("content")))))
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "latin1")


@query("a11_write_artifacts", "SELECT CASE WHEN round_idx % 2 = 0 THEN 'assess' ELSE 'verify' END AS stage, round_idx, count(*) AS n FROM <<edits>> GROUP BY 1, 2")
def _(t):
    path = _folder(t)
    d = t.edits.withColumn("stage", F.when(F.col("round_idx") % 2 == 0, "assess").otherwise("verify"))
    rd.write_artifacts(d.select("stage", "round_idx", "wb_id", "target_cell", "new_value"), path)
    back = t.spark.read.schema("wb_id string, target_cell string, new_value string, stage string, round_idx int").json(path)
    return back.groupBy("stage", "round_idx").agg(F.count("*").alias("n"))


@query(
    "a12_densify_tables",
    """WITH c AS (SELECT user_id AS doc_id, CAST(event_id % 2 AS INT) AS table_idx, CAST(1 + event_id % 11 AS INT) AS r, CAST(1 + event_id % 6 AS INT) AS c, min(event_type) AS text FROM events GROUP BY 1, 2, 3, 4), s AS (SELECT doc_id, table_idx, max(r) AS nr, max(c) AS nc FROM c GROUP BY 1, 2)
      SELECT s.doc_id, s.table_idx, CAST(a.i AS INT) AS row, string_agg(coalesce(c.text, ''), '|' ORDER BY b.i) AS cells FROM s, range(1, s.nr + 1) AS a(i), range(1, s.nc + 1) AS b(i) LEFT JOIN c ON c.doc_id = s.doc_id AND c.table_idx = s.table_idx AND c.r = a.i AND c.c = b.i GROUP BY 1, 2, 3""",
)
def _(t):
    e = F.col("event_id")
    d = t.events.groupBy(F.col("user_id").alias("doc_id"), (e % 2).cast("int").alias("table_idx"), (1 + e % 11).cast("int").alias("row"), (1 + e % 6).cast("int").alias("col")).agg(F.min("event_type").alias("text"))
    return rd.densify_tables(d).select("doc_id", "table_idx", "row", F.array_join("cells", "|").alias("cells"))


@query(
    "a14_build_bundle",
    "WITH s AS (SELECT case_id, doc_id, length(text) + length(CAST(doc_id AS VARCHAR)) + 21 + len(string_split(text, chr(10))) - 1 + 1 AS n FROM <<kv_texts>>) SELECT case_id, count(*) AS n_docs, sum(n) - 1 > 3000 AS truncated, CAST(CASE WHEN sum(n) - 1 > 3000 THEN 3000 + 15 ELSE sum(n) - 1 END AS INT) AS n_chars FROM s GROUP BY 1",
)
def _(t):
    d = rd.build_bundle(t.kv_texts, 3000)
    return d.select("case_id", "n_docs", "truncated", F.length("instruction").alias("n_chars"))


@query("i3_file_profile", "SELECT CAST(c_nationkey AS VARCHAR) AS case_id, count(*) AS n_files, count(*) FILTER (c_custkey % 4 = 0) AS n_missing FROM customer GROUP BY 1")
def _(t):
    files = t.customer.select(F.col("c_nationkey").cast("string").alias("case_id"), F.col("c_name").alias("copied_name"), "c_custkey")
    return sc.file_profile(files, files.where("c_custkey % 4 > 0"))


@query(
    "a14_build_bundle_all",
    """SELECT case_id, count(*) AS n_docs, md5(string_agg('{"doc_id":' || doc_id || ',"text":"' || replace(text, chr(10), chr(92) || 'n') || '"}', chr(10) ORDER BY doc_id)) AS h FROM <<kv_texts>> GROUP BY 1""",
)
def _(t):
    return rd.build_bundle(t.kv_texts).select("case_id", "n_docs", F.md5(F.col("instruction").cast("binary")).alias("h"))


@query(
    "e29_stage_rollup",
    WITH + CTES_ASSESS + " SELECT coalesce(rd, -1) AS round_idx, count(*) AS assessed, count(*) FILTER (is_actual_edit) AS edited, count(*) FILTER (is_correct) AS correct, count(*) FILTER (is_safe) AS safe_blank, count(*) FILTER (is_high_risk) AS high_risk, CAST(sum(score) AS BIGINT) AS n_flags FROM (SELECT *, CAST(col AS INT) AS rd FROM assessed) GROUP BY ROLLUP (rd)",
)
def _(t):
    d = sc.stage_rollup(_assessed(t).withColumn("round_idx", F.col("col")), ["round_idx"])
    return d.select(F.coalesce("round_idx", F.lit(-1)).alias("round_idx"), "assessed", "edited", "correct", "safe_blank", "high_risk", "n_flags")


@query(
    "e30_usage_rollup",
    """WITH u AS (SELECT conv_id AS job_id, role AS stage, CAST(length(text) AS INT) AS p, CAST(turn AS INT) AS c FROM conversations) SELECT coalesce(job_id, -1) AS job_id, CASE WHEN grouping(job_id) = 1 THEN 'grand_total' WHEN grouping(stage) = 1 THEN 'job_total' ELSE stage END AS stage,
      CAST(sum(p) AS BIGINT) AS prompt, CAST(sum(c) AS BIGINT) AS completion, CAST(sum(p + c) AS BIGINT) AS total FROM u GROUP BY ROLLUP (job_id, stage)""",
)
def _(t):
    u = t.conversations.select(F.col("conv_id").alias("job_id"), F.col("role").alias("stage"), F.length("text").alias("prompt"), F.col("turn").cast("int").alias("completion"))
    return sc.usage_rollup(u.withColumn("total", F.col("prompt") + F.col("completion")))


def scored(t):
    o = t.orders.select(
        (F.col("o_custkey") % 400).cast("string").alias("case_id"), F.col("o_orderkey").cast("string").alias("cell"), "o_orderkey", "o_orderpriority",
        F.when(F.col("o_custkey") % 2 == 0, "io").otherwise("mf").alias("track"), F.concat(F.lit("t"), (F.col("o_custkey") % 400 % 5).cast("string")).alias("case_type"),
    )
    k = F.col("o_orderkey")
    gold = o.filter(k % 17 != 0).select("case_id", "cell", "track", "case_type", F.when(k % 13 > 0, F.col("o_orderpriority")).alias("value"))
    pred = o.select("case_id", "cell", F.when(k % 7 == 0, "").when(k % 11 == 0, "wrong").otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"))).alias("value"))
    return sc.compare_pairs(pred, gold)


Q_CMP = """(SELECT *, g AND ((gv IS NULL AND pv = '') OR lower(coalesce(gv, '')) = lower(pv)) AS ok, pv <> '' AS fl FROM (SELECT CAST(o_custkey % 400 AS VARCHAR) AS case_id, CASE WHEN o_custkey % 400 % 2 = 0 THEN 'io' ELSE 'mf' END AS track, 't' || (o_custkey % 400 % 5) AS case_type, o_orderkey % 17 <> 0 AS g,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 13 > 0 THEN o_orderpriority END AS gv, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'wrong' ELSE lower(o_orderpriority) END AS pv FROM orders))"""


def q_score(by: str, group: str) -> str:
    return f"""(WITH c AS (SELECT case_id, {', '.join(f'max({b}) AS {b}' for b in by.split(', '))}, count(*) FILTER (g) AS ng, count(*) FILTER (ok) AS nc, count(*) FILTER (g AND gv IS NOT NULL) AS nw, count(*) FILTER (g AND gv IS NOT NULL AND fl) AS nh, count(*) FILTER (fl) AS nf, count(*) FILTER (fl AND g) AS ni, coalesce(bool_and(ok) FILTER (g), FALSE) AS whole FROM {Q_CMP} GROUP BY 1),
      s AS (SELECT {by}, count(*) AS n_cases, sum(ng) AS ng, sum(nc) AS nc, sum(nw) AS nw, sum(nh) AS nh, sum(nf) AS nf, sum(ni) AS ni, count(*) FILTER (whole) AS nz FROM c GROUP BY {group})
      SELECT {', '.join(f"coalesce({b}, 'all') AS {b}" for b in by.split(', '))}, n_cases, CAST(ng AS BIGINT) AS n_gold, round(nc / ng, 6) AS pair_acc, round(nh / nw, 6) AS recall, round(ni / nf, 6) AS precision, round(2 * (nh / nw) * (ni / nf) / ((nh / nw) + (ni / nf)), 6) AS f1, round(nz / n_cases, 6) AS e2e_acc FROM s)"""


@query("i1_score_pairs", f"SELECT * FROM {q_score('track', 'ROLLUP (track)')}")
def _(t):
    return sc.score_pairs(scored(t), ["track"], sets=True).na.fill({"track": "all"})


@query("i2_score_by_case_type", f"SELECT * FROM {q_score('track, case_type', 'ROLLUP (track, case_type)')}")
def _(t):
    return sc.score_pairs(scored(t), ["track", "case_type"], sets=True).na.fill({"track": "all", "case_type": "all"})


@query(
    "i3_corpus_profile",
    "SELECT case_id, CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(nulls) AS BIGINT) AS n_null, CAST(sum(rng) AS BIGINT) AS n_in_range, CAST(sum(multi) AS BIGINT) AS n_multi, CAST(sum(n - 1) AS BIGINT) AS n_repeats FROM (SELECT case_id, key, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (value_cell LIKE '%:%') AS rng, count(*) FILTER (value_cell LIKE '%,%') AS multi FROM <<pairs>> GROUP BY 1, 2) GROUP BY 1",
)
def _(t):
    return sc.corpus_profile(t.pairs)


def _run_stream(t, transform, keys):
    """Feeds the derived log as JSON lines, spread over files without order, through the stream into a table of its state."""
    src = _folder(t)
    lines = t.edits.select("seq", F.to_json(F.struct(F.lit("j1").alias("job_id"), "wb_id", "sheet", "target_cell", "old_value", "new_value", "round_idx", "step_idx", "source", "is_actual_edit", "seq")).alias("value"))
    lines.repartition(6, F.xxhash64("seq")).select("value").write.text(src)
    table = st.StateTable(t.spark, _folder(t), keys, every=2)
    st.run_into(transform(st.read_edit_stream(t.spark, src, max_files=2)), table, _folder(t))
    return table.read()


@query("j1_stream_edit_state", "SELECT wb_id, sheet, target_cell, old_value, new_value, seq FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, sheet, target_cell ORDER BY seq DESC) AS rn FROM <<edits>> WHERE is_actual_edit) WHERE rn = 1")
def _(t):
    return _run_stream(t, st.stream_edit_state, st.CELL).select("wb_id", "sheet", "target_cell", "old_value", "new_value", "seq")


@query("j2_stream_rollup", "SELECT round_idx, source, count(*) AS n_writes, count(*) FILTER (is_actual_edit) AS n_edits FROM <<edits>> GROUP BY 1, 2")
def _(t):
    return _run_stream(t, st.stream_rollup, ["job_id", "round_idx", "source"]).drop("job_id")
