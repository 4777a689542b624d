"""Evidence structuring over documents, pages and derived cards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formloom.functions import lines as ln
from formloom.functions import trees as tr
from formloom.functions import text as tx
from formloom.operators import evidence as ev
from formloom.operators import grid as g
from formloom.operators import markup as mk
from formloom.operators import tables as tb
from formloom.plans.registry import q_lines, query

TRIM = "trim({0}, ' ' || chr(9) || chr(10))"
SQ = "regexp_replace(" + TRIM + ", '\\s+', ' ', 'g')"

# Mixed text: prose of a document, a key line, headings, bullets and a small pipe table.
MIX = """SELECT doc_id, text || chr(10) || chr(10) || 'Source: ' || source || chr(10) || '# Facts' || chr(10) || '- one ' || lang || chr(10) || '- two' || chr(10) || '3. three' || chr(10) || '- four' || chr(10)
 || 'Notes Here:' || chr(10) || 'plain line' || chr(10) || '|a|b |' || chr(10) || '|:-|--|' || chr(10) || '| ' || CAST(doc_id AS STRING) || ' | |' || chr(10) || 'tail' AS text FROM {documents}"""
Q_MIX = "(" + MIX.format(documents="documents") + ")"
Q_LN = f"(SELECT doc_id, unnest({q_lines('text')}) AS line, generate_subscripts({q_lines('text')}, 1) AS i FROM {Q_MIX})"


@query(
    "f1_text_evidence",
    f"SELECT doc_id, CAST(rn AS INT) AS pos, regexp_replace(x, '\\s+', ' ', 'g') AS span FROM (SELECT doc_id, {SQ.format('c')} AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS c, generate_subscripts(regexp_split_to_array(text, '\\n{{2,}}'), 1) AS i FROM {Q_MIX}) WHERE {TRIM.format('c')} <> '')",
)
def _(t):
    d = t.sql(MIX).select("doc_id", F.posexplode(ln.text_evidence(F.col("text"))).alias("pos", "span"))
    return d.withColumn("pos", F.col("pos") + 1)


def part_rows(t):
    """One small table per brand and 200 part numbers, so that every part is in one and no table grows with the data."""
    d = t.part.withColumn("blk", F.expr("p_partkey div 200"))
    row = F.array(F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")), F.col("p_type"), F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("string")).otherwise(""))
    rows = d.groupBy("p_brand", "blk").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("x"))
    head = F.array(F.array(F.lit("Name"), F.lit("Type"), F.lit("")))
    return rows.select("p_brand", "blk", F.concat(head, F.transform("x", lambda s: s["r"])).alias("rows"))


Q_PART = """(SELECT p_brand, p_partkey // 200 AS blk, CAST(row_number() OVER (PARTITION BY p_brand, p_partkey // 200 ORDER BY p_partkey) AS INT) AS rn, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS a, p_type AS b, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS c FROM part)"""


@query("f2_table_evidence", f"SELECT p_brand, blk, rn AS pos, a || '|' || b || '|' || c AS cells FROM {Q_PART} UNION ALL SELECT DISTINCT p_brand, p_partkey // 200, 0, 'Name|Type|' FROM part")
def _(t):
    d = part_rows(t).select("p_brand", "blk", F.posexplode(ln.table_evidence(F.col("rows"))).alias("pos", "r"))
    return d.select("p_brand", "blk", "pos", F.array_join("r", "|").alias("cells"))


@query("f3_tabular_representation", f"SELECT p_brand, blk, rn AS pos, 'Name=' || a || ';Type=' || b || ';col_3=' || c AS rec FROM {Q_PART}")
def _(t):
    d = part_rows(t).select("p_brand", "blk", F.posexplode(ln.tabular(F.col("rows"))["records"]).alias("pos", "r"))
    return d.select("p_brand", "blk", (F.col("pos") + 1).alias("pos"), F.array_join(F.transform("r", lambda f: F.concat(f["key"], F.lit("="), f["value"])), ";").alias("rec"))


Q_PIPE = f"""(WITH l AS (SELECT *, contains(line, '|') AS p FROM {Q_LN}), s AS (SELECT *, CASE WHEN p AND NOT coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY i), FALSE) THEN 1 ELSE 0 END AS st FROM l),
  k AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s), m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS j FROM k WHERE p),
  c AS (SELECT doc_id, run, j, list_transform(string_split(trim(trim(line), '|'), '|'), lambda x: trim(x)) AS cells FROM m WHERE n >= 2),
  r AS (SELECT * FROM c WHERE NOT (j = 2 AND len(list_filter(cells, lambda x: NOT regexp_full_match(x, '[:\\- ]+'))) = 0) AND len(list_filter(cells, lambda x: x <> '')) > 0)
  SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY run) AS INT) AS table_idx, CAST(row_number() OVER (PARTITION BY doc_id, run ORDER BY j) AS INT) AS row, cells FROM r)"""


@query("f4_markdown_tables", f"SELECT doc_id, table_idx, row, array_to_string(cells, '|') AS cells FROM {Q_PIPE}")
def _(t):
    d = t.sql(MIX).select("doc_id", F.posexplode(ln.markdown_tables(F.col("text"))).alias("ti", "tb"))
    d = d.select("doc_id", (F.col("ti") + 1).alias("table_idx"), F.posexplode("tb").alias("ri", "r"))
    return d.select("doc_id", "table_idx", (F.col("ri") + 1).alias("row"), F.array_join("r", "|").alias("cells"))


@query(
    "f5_html_tables",
    "SELECT c_custkey, 1 AS row, 1 AS cell, c_name AS text, CAST(1 + c_nationkey % 2 AS INT) AS row_span, 1 AS col_span FROM customer UNION ALL SELECT c_custkey, 1, 2, 'x & y', 1, 2 FROM customer UNION ALL SELECT c_custkey, 2, 1, c_mktsegment, 1, 1 FROM customer",
)
def _(t):
    c = t.customer
    html = F.concat(
        F.lit("<p>t</p><TABLE class=a><tr><td rowspan=\""), (1 + F.col("c_nationkey") % 2).cast("string"), F.lit('">'), F.col("c_name"),
        F.lit("</td><th colspan=2>x <b>&amp;</b>\n y</th></tr><tr><td> </td></tr><tr><td>"), F.col("c_mktsegment"), F.lit("</td></tr></TABLE>"),
    )
    d = c.select("c_custkey", F.explode(ln.html_tables(html)).alias("tb")).select("c_custkey", F.posexplode("tb").alias("ri", "r"))
    d = d.select("c_custkey", (F.col("ri") + 1).alias("row"), F.posexplode("r").alias("ci", "c"))
    return d.select("c_custkey", "row", (F.col("ci") + 1).alias("cell"), "c.*")


def nested_pages(t):
    """A page for each order: a table with a row a line, tables inside some cells, end tags left out in places, and an empty table."""
    c = lambda n: F.col(n).cast("string")
    inner = F.concat(F.lit("<table border=0><tr><td>"), c("p"), F.lit('<td rowspan="2">'), c("q"), F.lit("</table>"))
    row = F.concat(F.lit("<tr><td>L"), c("ln"), F.lit(" "), F.when(F.col("s") % 2 == 0, inner).otherwise(""), F.when(F.col("ln") % 2 == 0, "</td></tr>\n").otherwise(""))
    d = t.li.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("ln", row.alias("x")))).alias("x"))
    head = F.concat(F.lit("<h1>x</h1></table><TABLE><tr><th>Order "), c("o"), F.lit("</th><td colspan=2>"))
    text = F.concat(head, F.array_join(F.transform("x", lambda k: k["x"]), ""), F.lit("</table><!-- <table><tr><td>no --><table></table>"))
    return d.select(F.col("o").alias("doc_id"), text.alias("text"))


Q_NEST = "(SELECT o, ln, p, q, s % 2 = 0 AS nested, sum(CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY ln) AS k FROM <<li>>)"


@query(
    "f5_nested_tables",
    f"""WITH x AS (SELECT * FROM {Q_NEST}), r AS (SELECT DISTINCT o, 0 AS ln, 0 AS j, 1 AS t, 'Order ' || o || '|' AS cells FROM x
      UNION ALL SELECT o, ln, 1, 1, CASE WHEN nested THEN 'L' || ln || ' ' || p || ' ' || q || '|' || p || '|' || q ELSE 'L' || ln END FROM x
      UNION ALL SELECT o, ln, 2, 1, p || '|' || q FROM x WHERE nested UNION ALL SELECT o, ln, 2, 1 + k, p || '|' || q FROM x WHERE nested)
      SELECT o AS doc_id, CAST(t AS INT) AS table_idx, CAST(row_number() OVER (PARTITION BY o, t ORDER BY ln, j) AS INT) AS row, cells FROM r""",
)
def _(t):
    return mk.table_rows(mk.page_cells(nested_pages(t))).withColumn("cells", F.array_join("cells", "|"))


@query(
    "f5_table_grid",
    f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY ln) + 1 AS r FROM {Q_NEST}),
      c AS (SELECT DISTINCT o, 1 AS t, 1 AS row, 1 AS col, 1 AS rs, 1 AS cs, 'Order ' || o AS text FROM x UNION ALL SELECT DISTINCT o, 1, 1, 2, 1, 2, '' FROM x
      UNION ALL SELECT o, 1, r, 1, 1, 1, CASE WHEN nested THEN 'L' || ln || ' ' || p || ' ' || q ELSE 'L' || ln END FROM x
      UNION ALL SELECT o, 1 + k, 1, 1, 1, 1, CAST(p AS VARCHAR) FROM x WHERE nested UNION ALL SELECT o, 1 + k, 1, 2, 2, 1, CAST(q AS VARCHAR) FROM x WHERE nested)
      SELECT o AS doc_id, CAST(t AS INT) AS table_idx, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CAST(rs AS INT) AS row_span, CAST(cs AS INT) AS col_span, text FROM c""",
)
def _(t):
    placed = tb.place_spans(mk.grid_cells(mk.page_cells(nested_pages(t))), ["doc_id", "table_id"])
    idx = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("table_id"))
    return placed.select("doc_id", idx.alias("table_idx"), "row", "col", "row_span", "col_span", "text")


Q_ENT = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _name, _ch in ln.ENTITIES.items():
    Q_ENT = f"replace({Q_ENT}, '&{_name};', '{_ch if _ch != chr(39) else chr(39) * 2}')"


@query("f6_html_text", f"SELECT page_id, md5({Q_ENT}) AS h, length({Q_ENT}) AS n FROM pages")
def _(t):
    x = ln.html_text(F.col("html"))
    return t.pages.select("page_id", F.md5(x.cast("binary")).alias("h"), F.length(x).cast("bigint").alias("n"))


@query(
    "f7_flat_kv",
    f"SELECT doc_id, key, value, CAST(i AS INT) AS line_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM (SELECT doc_id, i, trim(substring(x, 1, instr(x, ':') - 1)) AS key, trim(substring(x, instr(x, ':') + 1)) AS value FROM (SELECT doc_id, i, trim(line) AS x FROM {Q_LN}) WHERE contains(x, ':')) WHERE length(key) BETWEEN 1 AND 80)",
)
def _(t):
    return t.sql(MIX).select("doc_id", F.inline(ln.flat_kv(F.col("text"))))


Q_HEAD = "regexp_full_match(x, '[A-Z][A-Za-z0-9 /&()-]{1,80}:|#+\\s+.+')"


@query(
    "f8_sections",
    f"""WITH l AS (SELECT doc_id, i, trim(line) AS x FROM {Q_LN} WHERE trim(line) <> ''), h AS (SELECT *, {Q_HEAD} AS hd FROM l), s AS (SELECT *, sum(CAST(hd AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h)
      SELECT doc_id, coalesce(rtrim(max(x) FILTER (hd), ':'), 'root') AS title, count(*) FILTER (NOT hd) AS n_lines, coalesce(md5(string_agg(x, chr(10) ORDER BY i) FILTER (NOT hd)), md5('')) AS h FROM s GROUP BY doc_id, sec""",
)
def _(t):
    d = t.sql(MIX).select("doc_id", F.explode(ln.sections(F.col("text"), None)).alias("s"))
    body = F.array_join(F.transform("s.content", lambda c: c["text"]), "\n")
    return d.select("doc_id", F.col("s.title").alias("title"), F.size("s.content").cast("bigint").alias("n_lines"), F.md5(body.cast("binary")).alias("h"))


@query(
    "f9_text_records",
    """SELECT c_custkey, unnest(['# card|Name: ' || c_name || '|x ' || c_nationkey, 'b1|b2', 'p|q|r', 'b3']) AS items, unnest([1, 2, 3, 4]) AS pos FROM customer""",
)
def _(t):
    c = t.customer
    text = F.concat(F.lit("# card\nName: "), F.col("c_name"), F.lit("\n- x "), F.col("c_nationkey").cast("string"), F.lit("\n* b1\n- b2\n\n\np\nq\n r \n2. b3"))
    d = c.select("c_custkey", F.posexplode(ln.text_records(text)).alias("pos", "r"))
    return d.select("c_custkey", F.array_join("r", "|").alias("items"), (F.col("pos") + 1).alias("pos"))


INDENT = "(SELECT doc_id, i, line, length(line) - length(ltrim(line, ' ')) AS d FROM (SELECT doc_id, i, repeat(' ', CAST((length(line) * 7 + i) % 4 AS INT)) || ltrim(line, ' ') AS line FROM {0}) WHERE trim(line) <> '')"


@query(
    "f10_hierarchy",
    f"SELECT a.doc_id, CAST(a.i AS INT) AS line_index, coalesce(CAST(max(b.i) AS INT), 0) AS parent FROM {INDENT.format(Q_LN)} a LEFT JOIN {INDENT.format(Q_LN)} b ON a.doc_id = b.doc_id AND b.i < a.i AND b.d < a.d GROUP BY 1, 2",
)
def _(t):
    pad = lambda x, i: F.concat(F.repeat(F.lit(" "), ((F.length(x) * 7 + i + 1) % 4).cast("int")), F.ltrim(x))
    d = t.sql(MIX).select("doc_id", F.transform(tx.split_lines(F.col("text")), pad).alias("l"))
    return d.select("doc_id", F.inline(ln.hierarchy(F.col("l")))).na.fill({"parent": 0}).drop("text")


@query(
    "f11_list_of_records",
    f"SELECT doc_id, count(*) AS n_records FROM {Q_PIPE} WHERE row >= 2 GROUP BY 1",
)
def _(t):
    d = t.sql(MIX).select("doc_id", F.size(ev.list_of_records(ln.markdown_tables(F.col("text")))).cast("bigint").alias("n_records"))
    return d.filter("n_records > 0")


@query("f12_hybrid_blocks", f"SELECT doc_id, max(table_idx) AS n_tables FROM {Q_PIPE} GROUP BY 1")
def _(t):
    d = t.sql(MIX).select("doc_id", ev.hybrid_blocks(F.col("text"), ln.markdown_tables(F.col("text"))).alias("h"))
    return d.select("doc_id", F.size("h.tables").alias("n_tables"))


@query(
    "f11_record_fields",
    f"""WITH h AS (SELECT doc_id, table_idx, cells AS head FROM {Q_PIPE} WHERE row = 1), b AS (SELECT doc_id, table_idx, row, cells FROM {Q_PIPE} WHERE row >= 2),
      f AS (SELECT doc_id, table_idx, row, i, CASE WHEN trim(head[i]) <> '' THEN trim(head[i]) ELSE 'col_' || i END AS key, coalesce(cells[i], '') AS value
        FROM (SELECT b.*, h.head, unnest(range(1, len(h.head) + 1)) AS i FROM b JOIN h USING (doc_id, table_idx)))
      SELECT doc_id, string_agg(key || '=' || value, ';' ORDER BY table_idx, row, i) AS fields FROM f GROUP BY 1""",
)
def _(t):
    recs = ev.list_of_records(ln.markdown_tables(F.col("text")))
    d = t.sql(MIX).select("doc_id", F.flatten(recs).alias("f")).where(F.size("f") > 0)
    return d.select("doc_id", F.array_join(F.transform("f", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("fields"))


@query("f12_table_cells", f"SELECT doc_id, string_agg(array_to_string(cells, '|'), chr(10) ORDER BY table_idx, row) AS body FROM {Q_PIPE} GROUP BY 1")
def _(t):
    d = t.sql(MIX).select("doc_id", ev.hybrid_blocks(F.col("text"), ln.markdown_tables(F.col("text"))).alias("h"))
    return d.select("doc_id", F.array_join(F.transform(F.flatten("h.tables"), lambda r: F.array_join(r, "|")), "\n").alias("body")).where("body <> ''")


TREES = """SELECT event_id, '{{"id": ' || CAST(event_id AS STRING) || ', "a": {{"b": [' || CAST(user_id AS STRING) || ', "' || event_type || '"], "evidence": "skip"}}, "z": ' || props || ', "n": null, "zero": 0}}' AS raw FROM {events}"""


@query(
    "f13_tree_normalize",
    """SELECT event_id, '{"id": "' || event_id || '", "a": {"b": ["' || user_id || '", "' || event_type || '"], "evidence": "skip"}, "z": {"k": "' || json_extract_string(props, '$.k') || '"}, "n": null, "zero": "0"}' AS tree FROM events""",
)
def _(t):
    return t.sql(TREES).select("event_id", tr.tree_normalize(F.col("raw")).alias("tree"))


@query("f14_flatten_text", "SELECT event_id, CASE WHEN event_id = 0 THEN '' ELSE event_id || chr(10) END || CASE WHEN user_id = 0 THEN '' ELSE user_id || chr(10) END || event_type || CASE WHEN json_extract_string(props, '$.k') = '0' THEN '' ELSE chr(10) || json_extract_string(props, '$.k') END AS flat FROM events")
def _(t):
    return t.sql(TREES).select("event_id", tr.flatten_text(F.col("raw")).alias("flat"))


NESTED = """SELECT event_id, '[{{"a": "] [" , "b": ' || repeat('[', CAST(event_id % 7 AS INT)) || IF(event_id % 3 = 0, '', '1') || repeat(']', CAST(event_id % 7 AS INT)) || IF(event_id % 7 = 0 AND event_id % 3 = 0, '0', '') || '}}, {{}}]' AS raw FROM {events}"""


NESTED_SHEETS = "SELECT event_id, '{{\"sheets\": [{{\"records_preview\": [1' || repeat(', {{}}', CAST(event_id % 4 AS INT)) || ']}}, {{\"name\": 1}}, {{\"records_preview\": [2, 3]}}]}}' AS raw FROM {events}"


@query("f15_record_count", "SELECT event_id, CAST(3 + event_id % 4 AS INT) AS record_count FROM events")
def _(t):
    return t.sql(NESTED_SHEETS).select("event_id", tr.record_count(F.col("raw")).alias("record_count"))


@query("f15_tree_depth", "SELECT event_id, CAST(2 + event_id % 7 - CASE WHEN event_id % 3 = 0 AND event_id % 7 > 0 THEN 1 ELSE 0 END AS INT) AS depth, 2 AS record_count FROM events")
def _(t):
    return t.sql(NESTED).select("event_id", tr.tree_depth(F.col("raw")).alias("depth"), tr.record_count(F.col("raw")).alias("record_count"))


def feature_docs(t):
    d = t.sql(MIX).union(t.kv_texts.select(F.col("doc_id") + 1000000, "text"))
    d = d.withColumn("tables", ln.markdown_tables(F.col("text")))
    k = F.col("doc_id")
    return d.select(
        k, "text", "tables", F.get("tables", F.lit(0)).alias("rows"), F.size("tables").alias("table_blocks"), (k % 11).cast("int").alias("record_count"),
        (k % 5).cast("int").alias("object_depth"), F.size(ln.text_evidence(F.col("text"))).alias("evidence_count"),
        F.element_at(F.array(*[F.lit(x) for x in ("text", "html", "pdf", "office", "image", "structured")]), (k % 6 + 1).cast("int")).alias("family"),
        F.when(k % 4 == 0, "pptx").otherwise("md").alias("file_type"), F.lit("native").alias("text_layer"), (k % 13 == 0).alias("needs_ocr"),
    )


Q_DOCS = f"(SELECT doc_id, text FROM {Q_MIX} UNION ALL SELECT doc_id + 1000000, text FROM <<kv_texts>>)"
Q_FEAT = f"""(WITH d AS (SELECT * FROM {Q_DOCS}), l AS (SELECT doc_id, trim(line) AS x FROM (SELECT doc_id, unnest({q_lines('text')}) AS line FROM d) WHERE trim(line) <> ''),
  c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (contains(x, ':') AND length(trim(substring(x, 1, instr(x, ':') - 1))) <= 60) AS kv, count(*) FILTER ({Q_HEAD}) AS sec, count(*) FILTER (regexp_matches(x, '^([-*]|[0-9]+\\.)\\s+')) AS bul FROM l GROUP BY 1),
  tb AS (SELECT doc_id, max(table_idx) AS blocks, count(*) FILTER (table_idx = 1) AS trows, max(len(cells)) FILTER (table_idx = 1) AS tcols, sum(len(cells)) FILTER (table_idx = 1) AS total, sum(len(list_filter(cells, lambda z: z <> ''))) FILTER (table_idx = 1) AS fil FROM {Q_PIPE} GROUP BY 1)
  SELECT d.doc_id, length(text) AS chars, n, round_even(kv / n, 4) AS kvr, round_even(sec / n, 4) AS secr, round_even(bul / n, 4) AS bulr, coalesce(blocks, 0) AS blocks, coalesce(trows, 0) AS trows, coalesce(tcols, 0) AS tcols, coalesce(round_even(fil / total, 4), 0) AS dens,
   CASE WHEN length(text) < 600 THEN 'small' WHEN length(text) < 4000 THEN 'medium' ELSE 'large' END AS size, CASE WHEN d.doc_id % 5 >= 4 THEN 'high' WHEN d.doc_id % 5 >= 2 OR sec >= 2 THEN 'medium' ELSE 'low' END AS tier,
   CASE WHEN d.doc_id % 11 >= 8 OR bul >= 5 THEN 'high' WHEN d.doc_id % 11 >= 2 OR bul >= 2 THEN 'medium' ELSE 'low' END AS rep, CASE WHEN blocks >= 1 AND trows >= 4 AND tcols >= 3 THEN 'high' WHEN blocks >= 1 AND tcols >= 2 THEN 'medium' ELSE 'low' END AS grid
  FROM d JOIN c USING (doc_id) LEFT JOIN tb USING (doc_id))"""


@query(
    "f16_routing_features",
    f"SELECT doc_id, CAST(chars AS INT) AS char_count, CAST(n AS INT) AS line_count, kvr AS kv_line_ratio, secr AS section_line_ratio, bulr AS bullet_line_ratio, size AS content_size, tier AS hierarchy_strength, rep AS repetition_strength, grid AS grid_strength, CAST(trows AS INT) AS table_row_count, CAST(tcols AS INT) AS table_col_count, dens AS non_empty_density, CASE WHEN dens > 0 AND dens <= 0.25 THEN 'high' WHEN dens <= 0.6 THEN 'medium' ELSE 'low' END AS sparsity FROM {Q_FEAT}",
)
def _(t):
    return ev.routing_features(feature_docs(t)).select(
        "doc_id", "char_count", "line_count", "kv_line_ratio", "section_line_ratio", "bullet_line_ratio", "content_size", "hierarchy_strength",
        "repetition_strength", "grid_strength", "table_row_count", "table_col_count", "non_empty_density", "sparsity",
    )


def json_documents(t):
    """A normalised document for each order: a table, records, a list, sheets, or a deep object."""
    c = lambda n: F.col(n).cast("string")
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    cells = F.concat(F.lit("["), F.concat_ws(", ", q(c("p")), q(c("q")), q(F.when(F.col("q") % 2 == 0, " ").otherwise(F.col("f")))), F.lit("]"))
    item = F.concat(F.lit('{"k": '), q(c("p")), F.lit("}"))
    d = t.li.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("ln", cells.alias("cells"), item.alias("item")))).alias("x"))
    listed = lambda n: F.concat(F.lit("["), F.array_join(F.transform("x", lambda k: k[n]), ", "), F.lit("]"))
    rows, items, k = listed("cells"), listed("item"), F.col("o") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit('{"rows_preview": '), rows, F.lit(', "note": "Key: v"}')))
        .when(k == 1, F.concat(F.lit('{"records_preview": '), items, F.lit(', "lines": ["- a", "- b"]}'))).when(k == 2, items)
        .when(k == 3, F.concat(F.lit('{"sheets": [{"rows_preview": '), rows, F.lit(', "records_preview": '), items, F.lit('}, {"rows_preview": [["a", ""]]}]}')))
        .otherwise(F.concat(F.lit('{"a": {"b": {"c": {"d": '), c("o"), F.lit("}}}}")))
    )
    return d.select(F.col("o").alias("doc_id"), raw.alias("raw"), F.array(F.lit("e")).alias("evidence"))


@query(
    "f16_document_features",
    """WITH d AS (SELECT o, o % 5 AS k, CAST(count(*) AS INT) AS n, count(*) FILTER (q % 2 = 0) AS empty FROM <<li>> GROUP BY 1)
      SELECT o AS doc_id, CASE WHEN k IN (1, 2, 3) THEN n ELSE 0 END AS record_count, CASE k WHEN 3 THEN 5 WHEN 4 THEN 4 WHEN 2 THEN 2 ELSE 3 END AS object_depth,
        CASE k WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS table_blocks, CASE WHEN k IN (0, 3) THEN n ELSE 0 END AS table_row_count, CASE WHEN k IN (0, 3) THEN 3 ELSE 0 END AS table_col_count,
        CASE WHEN k IN (0, 3) THEN round_even((3.0 * n - empty) / (3 * n), 4) ELSE 0.0 END AS non_empty_density,
        CASE WHEN k IN (3, 4) THEN 'high' ELSE 'medium' END AS hierarchy_strength, CASE WHEN k IN (1, 2, 3) AND n >= 8 THEN 'high' WHEN k = 1 OR (k IN (2, 3) AND n >= 2) THEN 'medium' ELSE 'low' END AS repetition_strength,
        CASE WHEN k IN (0, 3) THEN CASE WHEN n >= 4 THEN 'high' ELSE 'medium' END ELSE 'low' END AS grid_strength FROM d""",
)
def _(t):
    return ev.routing_features(ev.document_parts(json_documents(t))).select(
        "doc_id", "record_count", "object_depth", "table_blocks", "table_row_count", "table_col_count", "non_empty_density", "hierarchy_strength", "repetition_strength", "grid_strength"
    )


Q_ROUTE = f"""(SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN CASE WHEN grid <> 'low' THEN 'table_like_representation' ELSE 'evidence_grounded_spans' END WHEN grid = 'high' THEN CASE WHEN rep = 'high' AND tcols <= 8 THEN 'list_of_records' WHEN tier <> 'low' THEN 'hybrid_sectioned_json_and_table_blocks' ELSE 'table_like_representation' END
  WHEN tier = 'high' THEN 'hierarchical_json' WHEN secr >= 0.12 OR tier = 'medium' THEN 'sectioned_json' WHEN rep = 'high' THEN 'list_of_records' WHEN kvr >= 0.28 AND size <> 'large' THEN 'flat_kv_pairs' WHEN size = 'small' AND kvr >= 0.15 THEN 'flat_kv_pairs' ELSE 'evidence_grounded_spans' END AS representation,
  CASE WHEN doc_id % 13 = 0 THEN CASE WHEN grid <> 'low' THEN 'ocr_plus_layout_parsing' ELSE 'ocr' END ELSE ['direct_text_parsing', 'html_dom_parsing', 'pdf_text_layer_parsing', 'office_document_parsing', 'direct_text_parsing', 'structured_data_parsing'][CAST(doc_id % 6 AS INT) + 1] END AS parse_mode, grid FROM {Q_FEAT})"""


@query(
    "f17_route",
    f"""SELECT doc_id, representation, parse_mode, CASE WHEN doc_id % 13 = 0 THEN 'layout_parsing,visual_understanding' ELSE array_to_string(list_filter([CASE WHEN doc_id % 6 IN (2, 4) AND grid <> 'low' THEN 'layout_parsing' END,
      CASE WHEN doc_id % 6 IN (1, 2, 4) AND representation = 'evidence_grounded_spans' THEN 'visual_understanding' END, CASE WHEN doc_id % 4 = 0 THEN 'manual_conversion' END, CASE WHEN doc_id % 4 = 0 AND NOT (doc_id % 6 IN (2, 4) AND grid <> 'low') THEN 'layout_parsing' END], lambda z: z IS NOT NULL), ',') END AS fallbacks FROM {Q_ROUTE}""",
)
def _(t):
    return ev.route(ev.routing_features(feature_docs(t))).select("doc_id", "representation", "parse_mode", F.array_join("fallback_modes", ",").alias("fallbacks"))


@query(
    "f18_text_semantics",
    f"SELECT doc_id, CASE WHEN kv >= greatest(3, n // 4) THEN 'flat_attributes_or_local_kv' WHEN sec >= 2 THEN 'sectioned_document' WHEN bul >= 3 THEN 'record_collection' ELSE 'free_text_document' END AS semantics FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (contains(x, ':') AND length(trim(substring(x, 1, instr(x, ':') - 1))) <= 60) AS kv, count(*) FILTER ({Q_HEAD}) AS sec, count(*) FILTER (regexp_matches(x, '^([-*]|[0-9]+\\.)\\s+')) AS bul FROM (SELECT doc_id, trim(line) AS x FROM (SELECT doc_id, unnest({q_lines('text')}) AS line FROM {Q_DOCS}) WHERE trim(line) <> '') GROUP BY 1)",
)
def _(t):
    return feature_docs(t).select("doc_id", ev.text_semantics(F.col("text")).alias("semantics"))


@query("f18_object_semantics", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'hierarchical_business_document' WHEN 1 THEN 'record_collection' WHEN 2 THEN 'repeated_items' ELSE 'flat_attributes_or_local_kv' END AS semantics FROM events")
def _(t):
    p = F.col("props")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, p).when(k == 1, F.concat(F.lit("["), p, F.lit("]"))).when(k == 2, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise(F.col("event_id").cast("string"))
    return t.events.select("event_id", ev.object_semantics(F.try_parse_json(raw)).alias("semantics"))


@query("f19_structure_by_route", f"SELECT representation, count(*) AS n FROM {Q_ROUTE} GROUP BY 1")
def _(t):
    d = ev.route(ev.routing_features(feature_docs(t))).withColumn("tables", ln.markdown_tables(F.col("text"))).withColumn("tree", F.to_json(F.struct("text")))
    return ev.structure_by_route(d).filter("structured is not null").groupBy("representation").agg(F.count("*").alias("n"))


@query(
    "f20_sheet_previews",
    "SELECT wb_id, sheet, count(DISTINCT row) AS row_count, max(col) AS column_count FROM <<cells_f>> WHERE value IS NOT NULL AND row <= 80 AND col <= 25 GROUP BY 1, 2",
)
def _(t):
    return ev.sheet_previews(t.cells_f, 10, 80, 25).select(*g.KEYS, F.col("preview.row_count").cast("bigint").alias("row_count"), F.col("preview.column_count").alias("column_count"))


@query(
    "f20_sheet_previews_all",
    """WITH c AS (SELECT * FROM <<cells_f>> WHERE value IS NOT NULL), w AS (SELECT wb_id, sheet, row, unnest(range(1, max(col) + 1)) AS col FROM c GROUP BY 1, 2, 3),
      f AS (SELECT w.*, coalesce(c.value, '') AS value FROM w LEFT JOIN c USING (wb_id, sheet, row, col)),
      l AS (SELECT wb_id, sheet, row, string_agg(value, '|' ORDER BY col) AS line FROM f GROUP BY 1, 2, 3 HAVING bool_or(trim(value) <> ''))
      SELECT wb_id, sheet, string_agg(line, chr(10) ORDER BY row) AS body FROM l GROUP BY 1, 2""",
)
def _(t):
    body = F.array_join(F.transform("preview.rows", lambda r: F.array_join(r, "|")), "\n")
    return ev.sheet_previews(t.cells_f).select(*g.KEYS, body.alias("body"))


@query("f21_email_parts", "SELECT conv_id * 1000 + turn AS id, 'a@' || role || '.example b' AS from_field, md5(trim(text, ' ' || chr(10) || chr(9))) AS body FROM conversations")
def _(t):
    msg = F.concat(F.lit("From: a@"), F.col("role"), F.lit(".example\r\n b\nSubject: x\n\n"), F.col("text"))
    d = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), ln.email_parts(msg).alias("m"))
    one = F.get(F.filter("m.headers", lambda h: h["key"] == "From"), F.lit(0))["value"]
    return d.select("id", one.alias("from_field"), F.md5(F.col("m.body").cast("binary")).alias("body"))


@query(
    "f22_native_text_check",
    "SELECT conv_id AS doc_id, length(regexp_replace(string_agg('[Page ' || turn || ']' || trim(text, ' ' || chr(10) || chr(9)), ''), '\\s+', '', 'g')) >= 400 AS is_native FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' GROUP BY 1",
)
def _(t):
    p = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return ev.native_text_check(p, 400).select("doc_id", "is_native")


@query(
    "f22_native_text",
    """SELECT conv_id AS doc_id, md5(string_agg('[Page ' || turn || ']' || chr(10) || trim(text, ' ' || chr(10) || chr(9)), chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations
      WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' GROUP BY 1""",
)
def _(t):
    p = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return ev.native_text_check(p).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("f23_ocr_page_tables", "SELECT event_id, unnest([0, 1, 2]) AS table_idx, unnest([event_type || '|1', 'a', 'b|' || user_id]) AS first_row FROM events")
def _(t):
    u = F.col("user_id").cast("string")
    raw = F.concat(F.lit('{"rows": [["'), F.col("event_type"), F.lit('", 1]], "tables": [{"rows": [["a"]]}, {"x": 1}], "pages": [{"rows": [["b", "'), u, F.lit('"], ["c"]]}]}'))
    d = t.events.select("event_id", F.posexplode(ev.ocr_page_tables(F.try_parse_json(raw))).alias("table_idx", "tb"))
    return d.select("event_id", "table_idx", F.array_join(F.col("tb")[0], "|").alias("first_row"))


@query(
    "f24_recommend_fields",
    """WITH kv AS (SELECT case_id, trim(substring(x, 1, instr(x, ':') - 1)) AS key, trim(substring(x, instr(x, ':') + 1)) AS value FROM (SELECT case_id, trim(unnest(string_split(text, chr(10)))) AS x FROM <<kv_texts>>) WHERE contains(x, ':')),
      c AS (SELECT case_id, key, value, count(*) AS n FROM kv WHERE key <> '' AND value <> '' GROUP BY 1, 2, 3)
      SELECT case_id, key, arg_min(value, (-n, value)) AS selected_value, count(*) > 1 AS conflict, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_seen FROM c GROUP BY 1, 2""",
)
def _(t):
    return ev.recommend_fields(t.kv_texts)
