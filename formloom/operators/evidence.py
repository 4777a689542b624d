"""Evidence documents: routing features, routes, structured output per route, previews and field proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.functions import lines as ln
from formloom.functions import text as tx
from formloom.functions import trees as tr
from formloom.operators.grid import KEYS, top_rows


def _pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator, so that later uses refer to the value instead of repeating its expression."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _count(arr: Column, cond) -> Column:
    return F.size(F.filter(arr, cond))


def _kv_line(x: Column) -> Column:
    return x.contains(":") & (F.length(tx.strip(F.substring_index(x, ":", 1))) <= 60)


def document_parts(docs: DataFrame) -> DataFrame:
    """What ``routing_features`` needs, from documents alone. docs: doc_id, raw (a normalised document as JSON text), evidence (array).

    The text is the document's scalars; tables are those it previews, the tallest and widest of them count. A density needs rows
    of its own or of its first sheet.
    """
    raw = F.col("raw")
    d = _pinned(docs, _t=tr.table_previews(raw))
    blocks = F.col("_t.blocks")
    tallest = lambda size: F.coalesce(F.array_max(F.transform(blocks, size)), F.lit(0))
    return d.select(
        *docs.columns, F.coalesce(tr.flatten_text(raw), F.lit("")).alias("text"), F.col("_t.first").alias("rows"), F.size(blocks).alias("table_blocks"),
        tallest(lambda r: F.size(r)).alias("table_row_count"), tallest(lambda r: F.coalesce(F.array_max(F.transform(r, lambda c: F.size(c))), F.lit(0))).alias("table_col_count"),
        F.coalesce(tr.record_count(raw), F.lit(0)).alias("record_count"), F.coalesce(tr.tree_depth(raw), F.lit(0)).alias("object_depth"), F.size("evidence").alias("evidence_count"),
    )


def routing_features(docs: DataFrame) -> DataFrame:
    """Features a route is chosen by, row by row.

    docs: doc_id, text, rows (array<array<string>>, first table), table_blocks, record_count, object_depth, evidence_count, and
    table_row_count and table_col_count where they are not those of ``rows``; ``document_parts`` gives all of them.
    Lines are stripped before the indent test, so ``indent_ratio`` is always 0, and no table counts as medium sparsity.
    """
    d = _pinned(docs, _l=ln.clean_lines(F.col("text")))
    n = F.greatest(F.lit(1), F.size("_l"))
    d = _pinned(
        d, _kv=_count(F.col("_l"), _kv_line), _sec=_count(F.col("_l"), lambda x: x.rlike(ln.SECTION)),
        _bul=_count(F.col("_l"), lambda x: x.rlike(ln.BULLET)),
    )
    rows = F.coalesce("rows", F.array().cast("array<array<string>>"))
    total = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(r))
    filled = F.aggregate(rows, F.lit(0), lambda a, r: a + _count(r, lambda c: tx.strip(c) != ""))
    cols = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    ratio = lambda c: F.bround(F.col(c) / n, 4)
    d = d.select(
        *docs.columns, F.length("text").alias("char_count"), F.size("_l").alias("line_count"), ratio("_kv").alias("kv_line_ratio"),
        ratio("_sec").alias("section_line_ratio"), ratio("_bul").alias("bullet_line_ratio"), F.lit(0.0).alias("indent_ratio"),
        *([] if "table_row_count" in docs.columns else [F.size(rows).alias("table_row_count"), cols.alias("table_col_count")]),
        F.when(total > 0, F.bround(filled / total, 4)).otherwise(0.0).alias("non_empty_density"), "_sec", "_bul",
    )
    c = F.col
    three = lambda high, mid: F.when(high, "high").when(mid, "medium").otherwise("low")
    return d.select(
        *[x for x in d.columns if x not in ("_sec", "_bul", "rows", "text")], "text", "rows",
        F.when(c("char_count") < 600, "small").when(c("char_count") < 4000, "medium").otherwise("large").alias("content_size"),
        three(c("object_depth") >= 4, (c("object_depth") >= 2) | (c("_sec") >= 2)).alias("hierarchy_strength"),
        three((c("record_count") >= 8) | (c("_bul") >= 5), (c("record_count") >= 2) | (c("_bul") >= 2)).alias("repetition_strength"),
        three((c("table_blocks") >= 1) & (c("table_row_count") >= 4) & (c("table_col_count") >= 3), (c("table_blocks") >= 1) & (c("table_col_count") >= 2)).alias("grid_strength"),
        three((c("non_empty_density") > 0) & (c("non_empty_density") <= 0.25), c("non_empty_density") <= 0.6).alias("sparsity"),
    )


# Parse mode by format family.
PARSE_MODES = {
    "structured": "structured_data_parsing", "table": "table_extraction", "html": "html_dom_parsing",
    "email": "email_parsing", "office": "office_document_parsing",
}


def route(features: DataFrame) -> DataFrame:
    """Semantic structure, layout, parse mode, representation and fallbacks. Adds to features with family, file_type,
    text_layer, needs_ocr. The first matching rung decides."""
    c = F.col
    grid, tier, rep = c("grid_strength"), c("hierarchy_strength"), c("repetition_strength")
    mode = F.lit("direct_text_parsing")
    mode = F.when((c("family") == "pdf") & (c("text_layer") == "native"), "pdf_text_layer_parsing").otherwise(mode)
    for fam, name in PARSE_MODES.items():
        mode = F.when(c("family") == fam, name).otherwise(mode)
    ladder = (
        F.when(grid == "high", "grid").when(tier == "high", "tree")
        .when((c("section_line_ratio") >= 0.12) | (tier == "medium"), "section").when(rep == "high", "records")
        .when((c("kv_line_ratio") >= 0.28) & c("content_size").isin("small", "medium"), "kv")
        .when((c("content_size") == "small") & (c("kv_line_ratio") >= 0.15), "kv").otherwise("free")
    )
    d = _pinned(features, _r=F.when(c("needs_ocr"), F.when(grid != "low", "ocr_grid").otherwise("ocr_free")).otherwise(ladder))
    r = c("_r")
    pick = lambda table, default: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[r], F.lit(default))
    mixed = (r == "grid") & (tier != "low")
    semantic = pick({
        "grid": "tabular_or_repeated_records", "ocr_grid": "tabular_or_repeated_records", "tree": "hierarchical_business_document",
        "section": "sectioned_document", "records": "record_collection", "kv": "flat_attributes_or_local_kv", "ocr_free": "sparse_or_unreadable",
    }, "free_text_document")
    layout = F.when(mixed | ((r == "free") & (grid != "low")), "mixed_blocks_and_tables").otherwise(pick({
        "grid": "table_layout", "ocr_grid": "table_layout", "tree": "hierarchical_document", "section": "block_document",
        "records": "block_document", "ocr_free": "mixed_or_unknown",
    }, "linear_text"))
    representation = (
        F.when((r == "grid") & (rep == "high") & (c("table_col_count") <= 8), "list_of_records")
        .when(mixed, "hybrid_sectioned_json_and_table_blocks")
        .otherwise(pick({
            "grid": "table_like_representation", "ocr_grid": "table_like_representation", "tree": "hierarchical_json",
            "section": "sectioned_json", "records": "list_of_records", "kv": "flat_kv_pairs",
        }, "evidence_grounded_spans"))
    )
    d = _pinned(d, semantic_structure=semantic, layout_structure=layout, representation=representation)
    d = d.withColumn("parse_mode", F.when(r == "ocr_grid", "ocr_plus_layout_parsing").when(r == "ocr_free", "ocr").otherwise(mode))
    spans = c("representation") == "evidence_grounded_spans"
    fall = F.array_distinct(F.array_compact(F.array(
        F.when(c("family").isin("pdf", "image") & (grid != "low"), "layout_parsing"),
        F.when(c("family").isin("html", "pdf", "image") & spans, "visual_understanding"),
        F.when(c("file_type").isin("doc", "ppt", "pptx"), "manual_conversion"),
        F.when(c("file_type").isin("doc", "ppt", "pptx"), "layout_parsing"),
    )))
    ocr = F.array(F.lit("layout_parsing"), F.lit("visual_understanding"))
    return d.withColumn("fallback_modes", F.when(c("needs_ocr"), ocr).otherwise(fall)).drop("_r")


def text_semantics(text: Column) -> Column:
    """Structure of a text by line counts alone."""
    lines = ln.clean_lines(text)
    kv, sec = _count(lines, _kv_line), _count(lines, lambda x: x.rlike(ln.SECTION))
    bul = _count(lines, lambda x: x.rlike(ln.BULLET))
    return (
        F.when(F.size(lines) == 0, "sparse_or_unreadable")
        .when(kv >= F.greatest(F.lit(3), F.floor(F.size(lines) / 4)), "flat_attributes_or_local_kv")
        .when(sec >= 2, "sectioned_document").when(bul >= 3, "record_collection").otherwise("free_text_document")
    )


def object_semantics(v: Column) -> Column:
    """Structure of a JSON value by its kind."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "hierarchical_business_document").when(s.startswith("ARRAY<OBJECT"), "record_collection")
        .when(s.startswith("ARRAY"), "repeated_items").otherwise("flat_attributes_or_local_kv")
    )


def list_of_records(tables: Column, n: int | None = None, per_table: int | None = None) -> Column:
    """Records of all tables of a document, keyed by each table's first row."""

    def one(t: Column) -> Column:
        head = F.transform(t[0], lambda c, i: F.when(tx.strip(c) != "", tx.strip(c)).otherwise(F.concat(F.lit("col_"), (i + 1).cast("string"))))
        return F.transform(ln.head(F.slice(t, F.lit(2), F.size(t)), per_table), lambda r: F.transform(head, lambda k, i: F.struct(k.alias("key"), F.coalesce(F.get(r, i), F.lit("")).alias("value"))))

    out = F.flatten(F.transform(F.filter(tables, lambda t: F.size(t) > 0), lambda t: one(t)))
    return F.slice(out, 1, n) if n else out


def table_blocks(tables: Column, n: int | None = None) -> Column:
    return ln.head(tables, n)


def hybrid_blocks(text: Column, tables: Column) -> Column:
    return F.struct(ln.sections(text).alias("sections"), table_blocks(tables).alias("tables"))


def structure_by_route(docs: DataFrame) -> DataFrame:
    """Structured JSON per document by its representation. docs: doc_id, text, tables, representation, tree (JSON or null)."""
    c = F.col
    recs = list_of_records(c("tables"))
    as_records = F.when(F.size(recs) > 0, F.to_json(F.struct(recs.alias("records")))).otherwise(F.to_json(F.struct(ln.text_records(c("text")).alias("records"))))
    spans = F.to_json(F.struct(ln.shown(c("text"), None).alias("text_preview"), ln.text_evidence(c("text")).alias("evidence_spans")))
    rep = c("representation")
    built = (
        F.when(rep == "flat_kv_pairs", F.to_json(F.struct(ln.flat_kv(c("text")).alias("pairs"))))
        .when(rep == "sectioned_json", F.to_json(F.struct(ln.sections(c("text")).alias("sections"))))
        .when(rep == "hierarchical_json", c("tree")).when(rep == "list_of_records", as_records)
        .when(rep == "table_like_representation", F.to_json(F.struct(table_blocks(c("tables")).alias("tables"))))
        .when(rep == "hybrid_sectioned_json_and_table_blocks", F.to_json(hybrid_blocks(c("text"), c("tables")))).otherwise(spans)
    )
    return docs.select("doc_id", "representation", built.alias("structured"))


def sheet_previews(cells: DataFrame, sheets: int | None = None, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Sheets as rows of text; limits, for a prompt, keep the top-left corner of the first sheets of a workbook. A sheet is bounded by its format."""
    c = cells.filter(F.col("value").isNotNull())
    c = c if rows is None else c.filter(F.col("row") <= rows)
    c = c if cols is None else c.filter(F.col("col") <= cols)
    first = top_rows(c.select("wb_id", "sheet").distinct(), ["wb_id"], ["sheet"], sheets)
    c = c.join(first, KEYS, "left_semi")
    r = c.groupBy(*KEYS, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("w"))
    line = F.transform(F.sequence(F.lit(1), F.col("w")), lambda i: F.coalesce(F.col("m")[i], F.lit("")))
    r = r.select(*KEYS, "row", line.alias("cells")).filter(ln.any_text(F.col("cells")))
    g = r.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda s: s["cells"]).alias("rows"))
    return g.select(*KEYS, ln.tabular(F.col("rows")).alias("preview"), ln.table_evidence(F.col("rows")).alias("evidence"))


def native_text_check(pages: DataFrame, min_chars: int = 40) -> DataFrame:
    """Does a document carry its own text? Pages joined under ``[Page n]`` marks; counts combine before the shuffle.

    pages: doc_id, page, text. The joined text is the document itself, so it is as bounded as one document.
    """
    p = pages.withColumn("t", tx.strip(F.coalesce("text", F.lit("")))).filter("t <> ''")
    p = p.withColumn("part", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("t")))
    g = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "part"))).alias("ps"))
    full = F.array_join(F.transform("ps", lambda s: s["part"]), "\n\n")
    return g.select("doc_id", full.alias("text")).withColumn(
        "is_native", F.length(F.regexp_replace("text", r"(?U)\s+", "")) >= min_chars
    ).withColumn("needs_ocr", ~F.col("is_native"))


def ocr_page_tables(v: Column, rows: int | None = None, cols: int | None = None) -> Column:
    """``rows`` lists of the tables and pages of a reply, whole unless limits are given."""
    schema = "array<array<string>>"
    none = F.array().cast("array<array<array<string>>>")
    top = F.array(F.try_variant_get(v, "$.rows", schema))
    inner = lambda path: F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$.rows", schema))
    found = F.array_compact(F.concat(top, inner("$.tables"), inner("$.pages")))
    return F.coalesce(F.transform(found, lambda t: F.transform(ln.head(t, rows), lambda r: ln.head(r, cols))), none)


def recommend_fields(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Per case and key: the most frequent value over all files and whether files disagree. docs: case_id, doc_id, text.

    Values are counted per (case, key, value) first, so a large case spreads over its values.
    """
    kv = docs.select("case_id", F.explode(ln.flat_kv(F.col("text"), n)).alias("p")).select("case_id", "p.key", "p.value").filter("value <> ''")
    counts = kv.groupBy("case_id", "key", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("case_id", "key").agg(
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("selected_value"), F.count("*").alias("n_values"), F.sum("n").alias("n_seen")
    )
    return best.select("case_id", "key", "selected_value", (F.col("n_values") > 1).alias("conflict"), "n_values", "n_seen")
