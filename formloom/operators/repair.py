"""Repair planning and guarded writes: targets, hints, template damage, restore, write checks, next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.functions import text as tx
from formloom.operators import grid as g
from formloom.operators import match as m
from formloom.operators.audit import RISK_FLAGS
from formloom.operators.grid import KEYS, POS, top_rows
from formloom.operators.similar import soft_match_pairs
from formloom.operators.spatial import RECT, overlap_join, overlapping, semi_overlap
from formloom.session import cut_lineage

REGION = [*KEYS, "region_id"]
STATE = ("value", "value_type", "style_key")
# Target kinds that come first, and the note shown for each risk flag.
PRIORITY_KINDS = ("region_blank_candidate", "screenshot_bad_range", "label_area_edit")
FLAG_NOTES = {
    "label_area": "Do not treat title/header/label text as the value key for a slot.",
    "duplicate_pattern": "This region may belong to repeated template blocks. Stay inside the current local block.",
    "template_inconsistency": "Prefer the key/value pattern that matches neighboring fields in this same section.",
    "high_risk_pattern": "Be careful about vertical misalignment between a key row and the value row.",
    "special_char_anomaly": "Preserve accented or language-specific characters when matching the key text.",
}


def select_patch_targets(targets: DataFrame) -> DataFrame:
    """Order in which a region's targets are worked on. targets: REGION, target_ord, kind, key, rectangle.

    With a prioritised kind present, those come first and repeats of (kind, key, range) fall away; else all stay as they are.
    """
    prio = F.col("kind").isin(*PRIORITY_KINDS)
    has = targets.filter(prio).select(*REGION).distinct().withColumn("_has", F.lit(True))
    t = targets.join(has, REGION, "left").withColumn("_late", F.when(F.col("_has"), (~prio).cast("int")).otherwise(0))
    sig = F.when(F.col("_has"), F.lit(-1)).otherwise(F.col("target_ord"))
    return t.groupBy(*REGION, "kind", "key", *RECT, "_late", sig.alias("_sig")).agg(F.min("target_ord").alias("target_ord")).drop("_sig").withColumnRenamed("_late", "late")


def _hits_target(hints: DataFrame, targets: DataFrame) -> DataFrame:
    """(REGION, hint_id) of hints whose cell range meets a target range of the same region."""
    cells = hints.select(*REGION, "hint_id", F.inline(rg.parse_list(F.col("value_cell"))))
    return semi_overlap(cells, targets.select(*REGION, *RECT), REGION).select(*REGION, "hint_id").distinct()


def select_region_hints(hints: DataFrame, targets: DataFrame) -> DataFrame:
    """Hints that name a target's key or point into its range, split into positive and negative ones.

    hints: REGION, hint_id, key, value_cell, is_invalid.
    """
    norm = tx.normalize_key(F.col("key"))
    keys = targets.select(*REGION, norm.alias("norm")).filter("norm <> ''").distinct()
    by_key = hints.withColumn("norm", norm).join(keys, [*REGION, "norm"], "left_semi").select(*REGION, "hint_id")
    keep = by_key.unionByName(_hits_target(hints, targets)).distinct()
    return hints.join(keep, [*REGION, "hint_id"], "left_semi").withColumn("side", F.when(F.col("is_invalid"), "negative").otherwise("positive"))


def region_flag_notes(targets: DataFrame) -> DataFrame:
    """Known risk flags of a region in first-seen order, with their notes. targets: REGION, target_ord, flags."""
    f = targets.select(*REGION, "target_ord", F.posexplode("flags").alias("i", "flag")).filter(F.col("flag").isin(*RISK_FLAGS))
    f = f.groupBy(*REGION, "flag").agg(F.min(F.struct("target_ord", "i")).alias("first"))
    notes = F.create_map(*[F.lit(x) for kv in FLAG_NOTES.items() for x in kv])
    pos = F.row_number().over(W.partitionBy(*REGION).orderBy("first"))
    return f.select(*REGION, pos.alias("pos"), "flag", notes[F.col("flag")].alias("note"))


def hint_context_summary(
    items: DataFrame, n_cells: int | None = None, n_reasons: int | None = None, n_groups: int | None = None, n_negative: int | None = None, n_noise: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Hints grouped by key: candidate, invalid and blank cells, sources and reasons; and the noise cells per region.

    items: REGION, item_ord, key, value_cell, is_invalid, is_blank, reason, source. Limits are for
    prompts and off unless given; they cut before lists are collected.
    """
    i = items.withColumn("cell", F.upper(tx.strip(F.col("value_cell")))).filter("cell <> ''").withColumn("noise", tx.noisy_key(F.col("key")))
    noise = i.filter("noise").select(*REGION, "cell").distinct().withColumn("o", rg.cell_sort_key(F.col("cell")))
    noise = top_rows(noise, REGION, ["o"], n_noise).select(*REGION, "cell")
    norm = tx.normalize_key(F.col("key"))
    i = i.filter("NOT noise").withColumn("grp", F.when(norm != "", norm).otherwise(F.lower("key")))
    by = [*REGION, "grp"]
    lists = F.array(
        F.when(~F.col("is_invalid"), F.struct(F.lit("candidate").alias("kind"), F.col("cell").alias("v"))),
        F.when(F.col("is_invalid"), F.struct(F.lit("invalid").alias("kind"), F.col("cell").alias("v"))),
        F.when(F.col("is_blank"), F.struct(F.lit("blank").alias("kind"), F.col("cell").alias("v"))),
        F.when(F.col("source") != "", F.struct(F.lit("source").alias("kind"), F.col("source").alias("v"))),
        F.when(F.col("reason") != "", F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("v"))),
    )
    e = i.select(*by, "item_ord", F.explode(F.array_compact(lists)).alias("x")).groupBy(*by, "x.kind", "x.v").agg(F.min("item_ord").alias("o"))
    is_cell = F.col("kind").isin("candidate", "invalid", "blank")
    e = e.withColumn("k", F.when(is_cell, rg.cell_sort_key(F.col("v"))))
    e = e.withColumn("rn", F.row_number().over(W.partitionBy(*by, "kind").orderBy("k", "o")))
    e = e.filter(F.coalesce(F.col("rn") <= F.when(F.col("kind") == "reason", F.lit(n_reasons)).otherwise(F.lit(n_cells)), F.lit(True)))
    pick = lambda k: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rn", "v")))), lambda s: s["v"]
    ).alias(k + "_list")
    s = e.groupBy(*by).agg(*[pick(k) for k in ("candidate", "invalid", "blank", "source", "reason")])
    first_key = i.groupBy(*by).agg(F.min_by("key", "item_ord").alias("key"))
    s = s.join(first_key, by)
    positive = F.size("candidate_list") > 0
    s = s.withColumn("side", F.when(positive, "candidate").otherwise("negative"))
    order = W.partitionBy(*REGION, "side").orderBy(F.desc(F.size("candidate_list")), F.desc(F.size("invalid_list")), F.lower("key"))
    s = s.withColumn("pos", F.row_number().over(order)).filter(F.coalesce(F.col("pos") <= F.when(F.col("side") == "candidate", F.lit(n_groups)).otherwise(F.lit(n_negative)), F.lit(True)))
    return s, noise


def _in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    return overlap_join(g.as_rects(points), regions.select(*REGION, *RECT), KEYS, points=True, levels=regions).drop(*RECT)


def template_damage(
    regions: DataFrame, template: DataFrame, template_merges: DataFrame, filled: DataFrame, filled_merges: DataFrame, preserve: DataFrame | None = None
) -> DataFrame:
    """Static template cells of a region whose value, style or merge state changed, one row each with the reasons.

    Static cells are never merged in the template, so each stands for itself there. Changes are found on the cells; only
    changed cells meet the regions.
    """
    static = g.static_template_cells(template, template_merges, ["value_type", "style_key"])
    if preserve is not None:
        static = static.join(preserve.select(*POS), POS, "left_anti")
    s = g.attach_anchor(static, filled_merges)
    now = filled.select(*KEYS, F.col("row").alias("a_row"), F.col("col").alias("a_col"), F.col("value").alias("now_value"),
                        F.col("value_type").alias("now_type"), F.col("style_key").alias("now_style"))
    s = s.join(now, [*KEYS, "a_row", "a_col"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("is_merged"), "template_merge_changed"),
        F.when(~F.col("style_key").eqNullSafe(F.col("now_style")), "template_static_style_changed"),
        F.when(~(F.col("value").eqNullSafe(F.col("now_value")) & F.col("value_type").eqNullSafe(F.col("now_type"))), "template_static_value_changed"),
    ))
    changed = s.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    return _in_regions(changed, regions).select(
        *REGION, "row", "col", "a_row", "a_col", F.col("value").alias("template_value"), F.col("now_value").alias("current_value"), "reasons"
    )


def damage_by_region(damage: DataFrame) -> DataFrame:
    """Box to restore and the set of reasons per region."""
    box = damage.groupBy(*REGION).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"), F.count("*").alias("n_changed"))
    why = damage.select(*REGION, F.explode("reasons").alias("r")).distinct().groupBy(*REGION).agg(F.array_join(F.array_sort(F.collect_set("r")), "; ").alias("restore_reasons"))
    return box.join(why, REGION)


def restore_region(
    regions: DataFrame, template: DataFrame, template_merges: DataFrame, filled: DataFrame, filled_merges: DataFrame,
    preserve: DataFrame | None = None, with_style: bool = True,
) -> DataFrame:
    """What each anchor of a region becomes: value and style of the template, except preserved anchors.

    Every filled anchor takes the template cell of its first covered position inside the region. ``changed`` marks rows
    that differ from the present state; apply with ``apply_restore``. A single cell has the same position in every region, so
    both its states are known before it meets the regions: all cells are dealt by row once, where blocks are looked up and
    the states of a position fold into one row. Only merged blocks of either side are looked up position by position.
    """
    seen = lambda p: F.struct(*[F.col(c).alias(p + "_" + c) for c in STATE])
    kept = lambda d: d.select(*KEYS, F.col("row").alias("d_row"), F.col("col").alias("d_col"))
    src = template.select(*KEYS, F.col("row").alias("a_row"), F.col("col").alias("a_col"), seen("t").alias("t"))
    cur = filled.select(*KEYS, F.col("row").alias("d_row"), F.col("col").alias("d_col"), seen("f").alias("f"))
    none = lambda d, p: F.lit(None).cast(d.select(seen(p).alias("x")).schema["x"].dataType)

    cells = template.select(*POS, seen("t").alias("t"), none(filled, "f").alias("f"), F.lit(False).alias("stays"))
    cells = cells.unionByName(filled.select(*POS, none(template, "t").alias("t"), seen("f").alias("f"), F.lit(False).alias("stays")))
    if preserve is not None:
        cells = cells.unionByName(preserve.select(*POS, none(template, "t").alias("t"), none(filled, "f").alias("f"), F.lit(True).alias("stays")))
    cells = g.attach_anchor(cells, filled_merges).filter("NOT is_merged").select(*POS, "t", "f", "stays")
    cells = g.attach_anchor(cells, template_merges).groupBy(*POS).agg(
        F.max("t").alias("t"), F.max("f").alias("f"), F.max("stays").alias("stays"), F.max(F.when(F.col("is_merged"), F.struct("a_row", "a_col"))).alias("at"),
        F.count_if(~F.col("stays")).alias("n"),
    ).filter("NOT stays AND n > 0")
    cells = cut_lineage(cells.select(*POS, "t", "f", "at"))
    inner = cells.filter("at IS NOT NULL").select(*POS, "f", "at.*").join(src, [*KEYS, "a_row", "a_col"], "left")
    single = cells.filter("at IS NULL").select(*POS, "t", "f").unionByName(inner.select(*POS, "t", "f"))
    single = _in_regions(single, regions).select(*REGION, F.col("row").alias("d_row"), F.col("col").alias("d_col"), "t", "f")
    blocks = overlap_join(filled_merges.select(*KEYS, *RECT), regions.select(*REGION, *RECT), KEYS, levels=regions)
    blocks = blocks.select(*REGION, F.col("r0").alias("d_row"), F.col("c0").alias("d_col"), F.greatest("r0", "o_r0").alias("row"), F.greatest("c0", "o_c0").alias("col"))
    if preserve is not None:
        blocks = blocks.join(kept(preserve), [*KEYS, "d_row", "d_col"], "left_anti")
    blocks = g.attach_anchor(blocks, template_merges).join(src, [*KEYS, "a_row", "a_col"], "left").join(cur, [*KEYS, "d_row", "d_col"], "left")
    d = single.unionByName(blocks.select(*single.columns)).select(*REGION, "d_row", "d_col", "t.*", "f.*")
    same = F.col("t_value").eqNullSafe(F.col("f_value")) & F.col("t_value_type").eqNullSafe(F.col("f_value_type"))
    style = F.coalesce("t_style_key", F.lit("0")).eqNullSafe(F.coalesce("f_style_key", F.lit("0")))
    return d.select(
        *REGION, F.col("d_row").alias("row"), F.col("d_col").alias("col"), F.col("t_value").alias("value"), F.col("t_value_type").alias("value_type"),
        (F.col("t_style_key") if with_style else F.col("f_style_key")).alias("style_key"), (~(same & style) if with_style else ~same).alias("changed"),
    )


def apply_restore(filled: DataFrame, restored: DataFrame) -> DataFrame:
    """Filled cells with the changed anchors replaced; an anchor of several regions is restored alike in each."""
    r = restored.filter("changed").groupBy(*POS).agg(F.min_by(F.struct("value", "value_type", "style_key"), "region_id").alias("r"))
    j = filled.join(r, POS, "full")
    new = lambda c: F.when(F.col("r").isNotNull(), F.col("r." + c)).otherwise(F.col(c)).alias(c)
    rest = [c for c in filled.columns if c not in (*POS, "value", "value_type", "style_key")]
    return j.select(*POS, new("value"), new("value_type"), *rest, new("style_key"))


def label_overwrites(template: DataFrame, merges: DataFrame, filled: DataFrame, n: int | None = None) -> DataFrame:
    """Static labels whose filled text is the label plus something: likely a value written into the label cell.

    Adds the three best candidate cells and those still missing a value (blank, or unchanged from the template).
    """
    lab = g.static_labels(template, merges)
    now = filled.filter("value is not null").select(*POS, tx.strip(F.col("value")).alias("now"))
    j = lab.join(now, POS).filter((F.col("now") != "") & (F.col("now") != F.col("text")))
    tn, cn = tx.normalize_compare(F.col("text")), tx.normalize_compare(F.col("now"))
    edge = r"^[ :\-\t]+|[ :\-\t]+$"
    extra = F.regexp_replace(F.substr(F.col("now"), F.length("text") + 1), edge, "")
    starts = cn.startswith(tn) | (tn.endswith(":") & cn.startswith(F.regexp_replace(tn, ":+$", "")))
    j = j.filter((tn != cn) & starts & (extra != "")).withColumn("extra", extra)
    j = cut_lineage(top_rows(j, KEYS, ["row", "col"], n))
    near = m.rank_candidates(j.select(*POS), g.typed_candidates(template, merges), g.labels(template), 3)
    value = lambda d, c: d.select(*POS, F.col("value").alias(c + "_v"), F.col("value_type").alias(c + "_t"))
    at = g.attach_anchor(near, merges).drop("row", "col").withColumnsRenamed({"a_row": "row", "a_col": "col"})
    at = at.join(value(filled, "f"), POS, "left").join(value(template, "t"), POS, "left")
    missing = tx.blankish(F.col("f_v"), F.col("f_t")) | (tx.normalize_compare(F.col("f_v")) == tx.normalize_compare(F.col("t_v")))
    cell = rg.a1_cell(F.col("row"), F.col("col"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", cell.alias("c"))))), lambda s: s["c"])
    lists = at.groupBy(*KEYS, F.col("l_row").alias("row"), F.col("l_col").alias("col")).agg(
        ordered(F.lit(True)).alias("candidate_cells"), ordered(missing).alias("missing_cells")
    )
    none = F.array().cast("array<string>")
    out = j.join(lists, POS, "left").withColumn("missing_cells", F.coalesce("missing_cells", none)).withColumn("candidate_cells", F.coalesce("candidate_cells", none))
    label = F.array(rg.a1_cell(F.col("row"), F.col("col")))
    return out.withColumn("bad_ranges", F.array_distinct(F.concat(label, F.slice("missing_cells", 1, 2))))


def reconcile_check(replies: DataFrame, heuristic: DataFrame) -> DataFrame:
    """Joins a checker's reply with the overwritten-label findings of its sheet.

    replies: keys, need_fix, bad_ranges, correct_ranges (normalised arrays), bad_raw (array), confidence, parsed (boolean).
    heuristic: keys, row, col, bad_ranges per finding; every finding of a sheet counts.
    """
    h = heuristic.select(*KEYS, F.posexplode("bad_ranges").alias("i", "cell"), "row", "col")
    h = h.withColumn("a1", rg.normalize_a1(F.col("cell"))).groupBy(*KEYS, "a1").agg(F.min(F.struct("row", "col", "i")).alias("o"))
    h = h.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "a1"))), lambda s: s["a1"]).alias("h_bad"))
    r = replies.join(h, KEYS, "left")
    has = F.size(F.coalesce("h_bad", F.array().cast("array<string>"))) > 0
    rects = F.transform("h_bad", lambda x: rg.parse_a1(x))
    free = F.filter("correct_ranges", lambda c: ~F.exists(rects, lambda b: rg.intersects(rg.parse_a1(c), b)))
    need = F.col("need_fix") | has
    both = F.when(has, F.array_distinct(F.concat("bad_ranges", "h_bad"))).otherwise(F.col("bad_ranges"))
    failed = F.col("need_fix") & (F.size("bad_raw") > 0) & (F.size("bad_ranges") == 0)
    return r.select(
        *KEYS, need.alias("need_fix"), F.when(need, both).otherwise(F.array().cast("array<string>")).alias("bad_ranges"),
        F.when(has, free).otherwise(F.col("correct_ranges")).alias("correct_ranges"),
        F.when(has, F.greatest("confidence", F.lit(0.95))).otherwise(F.col("confidence")).alias("confidence"), failed.alias("parse_failed"),
    )


def protected_cells(layers: DataFrame, editable: DataFrame) -> DataFrame:
    """Protected cells with the reason of the first layer that names them, minus editable cells. layers: POS, layer, reason."""
    return layers.join(editable.select(*POS).distinct(), POS, "left_anti").groupBy(*POS).agg(F.min_by("reason", "layer").alias("reason"))


def range_layer(ranges: DataFrame, layer: int, reason: Column) -> DataFrame:
    """Cells of ranges as a protection layer. ranges: keys, a range text column ``range``."""
    d = ranges.withColumn("_why", reason).select(*KEYS, "_why", F.inline(rg.parse_list(F.col("range"))))
    d = d.select(*KEYS, "_why", F.explode(rg.cells_of(F.struct(*RECT))).alias("p"))
    return d.select(*KEYS, "p.row", "p.col", F.lit(layer).alias("layer"), F.col("_why").alias("reason"))


def guarded_write_candidates(sources: DataFrame, avoid: DataFrame) -> DataFrame:
    """Cells a repair may write: ranges of at most ``max_span`` cells (larger ones count for nothing) minus avoided cells.

    sources: REGION, range, max_span. avoid: REGION, range.
    """
    cells = sources.select(*REGION, F.explode(rg.expand_limited(F.col("range"), F.col("max_span"))).alias("p"))
    cells = cells.select(*REGION, "p.row", "p.col").distinct()
    bad = avoid.select(*REGION, F.inline(rg.parse_list(F.col("range"))))
    c = g.as_rects(cells)
    hit = overlapping(c, bad, REGION)
    return c.join(hit, [*REGION, *RECT], "left_anti").drop(*RECT)


def mandatory_review_items(regions: DataFrame, ranges: DataFrame, before: DataFrame, template: DataFrame, merges: DataFrame) -> DataFrame:
    """Reported and target ranges that meet a region, with the value before the repair and in the template. ranges: keys, range."""
    r = ranges.select(*KEYS, F.inline(F.array_compact(F.array(rg.parse_a1(F.col("range")))))).distinct()
    hit = overlap_join(r, regions.select(*REGION, *RECT), KEYS, levels=regions).select(*REGION, *RECT).distinct()
    hit = hit.withColumn("value_cell", rg.a1_range(*[F.col(c) for c in RECT])).drop(*RECT)
    p = g.read_anchor_value(hit, before, merges).select(*REGION, "value_cell", F.col("current_value").alias("previous_value"))
    return g.read_anchor_value(p, template, merges).select(*REGION, F.col("value_cell").alias("range"), "previous_value", F.col("current_value").alias("template_value"))


def latest_feedback(stages: DataFrame, regions: DataFrame) -> DataFrame:
    """Ranges of the newest assessment or verification that meet each region; a verification wins a tie of rounds.

    stages: keys, stage_name, is_verification, round_idx, need_fix, reason, bad_ranges, correct_ranges (arrays).
    Regions without a bad range and without a reason give nothing.
    """
    rest = [c for c in stages.columns if c not in KEYS]
    last = stages.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("round_idx", "is_verification")).alias("s")).select(*KEYS, "s.*")
    part = lambda c, kind: last.select(*KEYS, F.lit(kind).alias("range_kind"), F.explode(c).alias("a1"))
    r = part("bad_ranges", "bad").unionByName(part("correct_ranges", "correct"))
    r = r.select(*KEYS, "range_kind", rg.rect_columns(rg.parse_a1(F.col("a1")))).distinct()
    hit = overlap_join(r, regions.select(*REGION, *RECT), KEYS, levels=regions).select(*REGION, "range_kind", rg.a1_range(*[F.col(c) for c in RECT]).alias("range"))
    has_bad = hit.filter("range_kind = 'bad'").select(*REGION).distinct().withColumn("_bad", F.lit(True))
    head = regions.select(*REGION).join(last.select(*KEYS, "stage_name", "round_idx", "need_fix", tx.strip(F.coalesce("reason", F.lit(""))).alias("reason")), KEYS)
    head = head.join(has_bad, REGION, "left").filter(F.col("_bad") | (F.col("reason") != "")).drop("_bad")
    return head.join(hit, REGION, "left")


def chunked_lag(df: DataFrame, by: list[str], order: str, value: str, out: str, width: int = 1 << 20) -> DataFrame:
    """Previous value in order, per group, without one task per group: neighbours inside a chunk of the order column,
    then the last value of the previous non-empty chunk. ``order`` is an integer without repeats in a group."""
    d = df.withColumn("_c", F.shiftright(F.col(order).cast("long"), width.bit_length() - 1))
    inside = W.partitionBy(*by, "_c").orderBy(order)
    d = d.withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    last = d.groupBy(*by, "_c").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    carry = last.select(*by, "_c", F.lag("_last").over(W.partitionBy(*by).orderBy("_c")).alias("_carry"))
    d = d.join(carry, [*by, "_c"])
    return d.withColumn(out, F.coalesce("_prev", "_carry")).drop("_c", "_prev", "_carry")


# Outcome names of a write request.
INVALID, NO_LINE, LABEL, PROTECTED, UNAPPROVED, OUTSIDE, NOOP, OK = (
    "invalid_target", "blocked_missing_bottom_border", "blocked_label_guard", "blocked_protected_cell",
    "blocked_unapproved_candidate", "blocked_outside_focus_range", "noop", "ok",
)


def write_guard(
    requests: DataFrame, cells: DataFrame, merges: DataFrame, label_cells: DataFrame | None = None, protected: DataFrame | None = None,
    approved: DataFrame | None = None, focus: DataFrame | None = None, bottom_border: bool = False,
) -> DataFrame:
    """Outcome of every write request: the first guard that fails, else ``noop`` or ``ok``. requests: keys, seq, cell, value.

    The old value is what the previous accepted write left in the target. A protected target accepts only its present
    value, so its old value never moves and the guards need no replay.
    """
    r = requests.select(*KEYS, "seq", F.upper(tx.strip(F.col("cell"))).alias("requested_cell"), "value", F.inline_outer(F.array_compact(F.array(rg.parse_a1(F.col("cell"))))))
    single = (F.col("r0") == F.col("r1")) & (F.col("c0") == F.col("c1"))
    bad = r.filter(~F.coalesce(single, F.lit(False)))
    p = r.filter(single).withColumn("row", F.col("r0")).withColumn("col", F.col("c0")).drop(*RECT)
    # By sheet first, then by anchor: what is looked up at a position follows in one run, so that requests travel there once.
    # What is looked up is as large as the sheets, but packs into small files: Spark would take it for small and send it whole.
    if focus is not None:
        p = p.join(focus.select(*KEYS, *[F.col(c).alias("f_" + c) for c in RECT]).hint("merge"), KEYS, "left")
    if approved is not None:
        p = p.join(approved.select(*KEYS).distinct().withColumn("_lim", F.lit(True)).hint("merge"), KEYS, "left")
    p = g.attach_anchor(p, merges).drop("row", "col", "m_r1", "m_c1", "is_merged").withColumnsRenamed({"a_row": "row", "a_col": "col"})
    now = cells.select(*POS, F.col("value").alias("now_value"), F.col("border_bottom").isNotNull().alias("lined"))
    p = p.join(now.hint("merge"), POS, "left")
    flag = lambda d, name: d.select(*POS).distinct().withColumn(name, F.lit(True)).hint("merge")
    stop = F.lit(None).cast("string")
    if focus is not None:
        inside = F.col("row").between(F.col("f_r0"), F.col("f_r1")) & F.col("col").between(F.col("f_c0"), F.col("f_c1"))
        stop = F.when(F.col("f_r0").isNotNull() & ~inside, OUTSIDE).otherwise(stop)
    if approved is not None:
        p = p.join(flag(approved, "_app"), POS, "left")
        stop = F.when(F.col("_lim") & F.col("_app").isNull(), UNAPPROVED).otherwise(stop)
    if protected is not None:
        p = p.join(flag(protected, "_prot"), POS, "left")
        stop = F.when(F.col("_prot") & ~F.col("value").eqNullSafe(F.col("now_value")), PROTECTED).otherwise(stop)
    if label_cells is not None:
        p = p.join(flag(label_cells, "_lab"), POS, "left")
        stop = F.when(F.col("_lab"), LABEL).otherwise(stop)
    if bottom_border:
        stop = F.when(~F.coalesce("lined", F.lit(False)), NO_LINE).otherwise(stop)
    p = cut_lineage(p.withColumn("stop", stop))
    taken = chunked_lag(p.filter("stop is null"), POS, "seq", "value", "_old")
    taken = taken.withColumn("old_value", F.when(F.col("_old").isNull(), F.col("now_value")).otherwise(F.col("_old.v")))
    refused = p.filter("stop is not null").withColumn("old_value", F.col("now_value"))
    cols = [*KEYS, "seq", "requested_cell", rg.a1_cell(F.col("row"), F.col("col")).alias("target_cell"), "old_value", F.col("value").alias("new_value")]
    same = F.col("value").eqNullSafe(F.col("old_value"))
    out = taken.select(*cols, F.when(same, NOOP).otherwise(OK).alias("status")).unionByName(refused.select(*cols, F.col("stop").alias("status")))
    none = F.lit(None).cast("string")
    bad = bad.select(*KEYS, "seq", "requested_cell", F.col("requested_cell").alias("target_cell"), none.alias("old_value"), F.col("value").alias("new_value"), F.lit(INVALID).alias("status"))
    return out.unionByName(bad).withColumn("is_actual_edit", F.col("status") == OK)


def next_action(status: DataFrame) -> DataFrame:
    """Next step of each job from its status columns.

    status: job_id, delivered, skip_initial_fill, has_first_pass, has_assessment, has_high_risk, n_bad_ranges, open_region,
    need_restore, restored, noop_count, has_direct_hints, has_negative_hints, has_context.
    """
    c = F.col
    action = (
        F.when(c("delivered"), "deliver")
        .when(~c("skip_initial_fill") & ~c("has_first_pass"), "free_fill")
        .when(~c("has_assessment"), "reflect_and_hint")
        .when(~c("has_high_risk") & (c("n_bad_ranges") == 0), "verify_and_deliver")
        .when(c("open_region").isNull(), "verify_and_deliver")
        .when(c("need_restore") & ~c("restored"), "restore_template_region")
        .otherwise("guided_refill")
    )
    s = status.withColumn("next_action", action)
    refill = c("next_action") == "guided_refill"
    return s.select(
        "job_id", "next_action",
        F.when(c("next_action").isin("guided_refill", "restore_template_region"), c("open_region")).alias("region"),
        (refill & (~c("has_direct_hints") | (c("noop_count") > 0))).alias("force_repair"),
        (refill & (c("has_direct_hints") | c("has_negative_hints") | c("has_context"))).alias("use_hints"),
    )


def unresolved_ranges(verification: DataFrame) -> DataFrame:
    """Distinct ranges a verification still complains about. verification: keys, bad_ranges array, risky array<struct<target_range, label_cell, value_cell>>."""
    named = F.flatten(F.transform(F.coalesce("risky", F.array()), lambda r: F.array(r["target_range"], r["label_cell"], r["value_cell"])))
    return verification.select(*KEYS, F.explode(F.concat("bad_ranges", named)).alias("range")).filter("trim(range) <> ''").distinct()


def stalled_regions(regions: DataFrame, unresolved: DataFrame, still_risky: DataFrame) -> DataFrame:
    """Regions whose repair wrote nothing and which meet an unresolved range; without any such range, all of a sheet that
    is still risky. regions: REGION, rectangle, noop_count; still_risky: keys."""
    r = regions.filter(F.col("noop_count") > 0).drop("noop_count")
    u = unresolved.select(*KEYS, rg.rect_columns(rg.parse_a1(F.col("range"))))
    hit = semi_overlap(r, u, KEYS)
    rest = r.join(unresolved.select(*KEYS).distinct(), KEYS, "left_anti").join(still_risky.select(*KEYS).distinct(), KEYS, "left_semi")
    return hit.unionByName(rest.select(*hit.columns))


def _soft_hits(hints: DataFrame, targets: DataFrame) -> DataFrame:
    """(REGION, hint_id, target_ord) pairs by soft key match or by range."""
    norm = tx.normalize_key(F.col("key"))
    h, t = hints.withColumn("norm", norm), targets.withColumn("norm", norm)
    pairs = soft_match_pairs(h.select(*REGION, "norm"), t.select(*REGION, "norm"), REGION)
    by_key = h.select(*REGION, "hint_id", F.col("norm").alias("a")).join(pairs, [*REGION, "a"]).join(t.select(*REGION, "target_ord", F.col("norm").alias("b")), [*REGION, "b"])
    by_key = by_key.select(*REGION, "hint_id", "target_ord")
    cells = hints.select(*REGION, "hint_id", F.inline(rg.parse_list(F.col("value_cell"))))
    by_range = overlap_join(cells, targets.select(*REGION, "target_ord", *RECT), REGION, levels=targets).select(*REGION, "hint_id", "target_ord")
    return by_key.unionByName(by_range).distinct()


def _with_current(pairs: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    v = g.read_anchor_value(pairs, cells, merges)
    return v.withColumn("is_blank", tx.blankish(F.col("current_value"), F.col("current_type"))).drop("a_row", "a_col", "current_type")


def _hints_and_hits(pairs: DataFrame, targets: DataFrame, cells: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hints of ``region_hints`` and the (REGION, hint_id, target_ord) they match, which are found and written once."""
    p = pairs.filter((F.col("value_cell") != "") & (F.col("is_invalid") | (F.col("key") != "")))
    p = _with_current(p, cells, merges)
    p = cut_lineage(p.filter(F.col("is_invalid") | ~(F.col("is_blank") & tx.noisy_key(F.col("key")))))
    hits = cut_lineage(_soft_hits(p, targets))
    keep = hits.select(*REGION, "hint_id").distinct()
    source = F.when(F.col("is_invalid"), "reflect_invalid_slot").when(F.col("is_blank"), "reflect_blank_slot").otherwise("reflect_slot_kv")
    return p.join(keep, [*REGION, "hint_id"], "left_semi").withColumn("hint_source", source).withColumnRenamed("is_invalid", "avoid_cell"), hits


def region_hints(pairs: DataFrame, targets: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Region pairs as hints with their present value. pairs: REGION, hint_id, key, value_cell, is_invalid.

    Blank slots with a noisy key are dropped, and so is what matches no target softly or by range; invalid slots become
    cells to avoid.
    """
    return _hints_and_hits(pairs, targets, cells, merges)[0]


def rank_region_hints(pairs: DataFrame, targets: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Hints that inherit the risk flags of the targets they match, in working order: invalid, blank, more flags, cell text."""
    h, hits = _hints_and_hits(pairs, targets, cells, merges)
    got = hits.join(targets.select(*REGION, "target_ord", F.explode_outer("flags").alias("flag")), [*REGION, "target_ord"])
    got = got.groupBy(*REGION, "hint_id").agg(F.array_sort(F.collect_set("flag")).alias("risk_flags"))
    h = h.join(got, [*REGION, "hint_id"], "left")
    order = [(~F.col("avoid_cell")).cast("int"), (~F.col("is_blank")).cast("int"), -F.size("risk_flags"), F.col("value_cell"), F.col("hint_id")]
    return h.withColumn("rank", F.row_number().over(W.partitionBy(*REGION).orderBy(*order)))


def round_delta(edits: DataFrame, regions: DataFrame, round_idx: int) -> DataFrame:
    """Real edits of a round per region; a region without any is to be put back."""
    e = edits.filter(F.col("is_actual_edit") & (F.col("round_idx") == round_idx))
    e = e.select(*KEYS, "seq", rg.rect_columns(rg.parse_a1(F.col("target_cell"))))
    n = overlap_join(e, regions.select(*REGION, *RECT), KEYS, levels=regions).groupBy(*REGION).agg(F.count("*").alias("n_edits"))
    out = regions.select(*REGION).join(n, REGION, "left").na.fill({"n_edits": 0})
    return out.withColumn("reverted", F.col("n_edits") == 0)
