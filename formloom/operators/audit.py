"""Change tracking and risk: edits, duplicate values, assessment of fields, and the regions to repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.functions import text as tx
from formloom.operators import grid as g
from formloom.operators import match as m
from formloom.operators.grid import KEYS, POS
from formloom.operators.spatial import RECT, flag_overlap, flag_overlaps, overlap_join, split_small
from formloom.session import cut_lineage, drop_cut

PAD = {"left": 2, "right": 2, "top": 1, "bottom": 1}
RISK_FLAGS = ("label_area", "duplicate_pattern", "template_inconsistency", "high_risk_pattern", "special_char_anomaly")


def latest_effective_edits(edits: DataFrame) -> DataFrame:
    """Last real edit per cell. Writes that change nothing are dropped first, so they hide no earlier edit."""
    rest = [c for c in edits.columns if c not in (*KEYS, "target_cell")]
    e = edits.filter("is_actual_edit").withColumn("target_cell", F.upper(tx.strip(F.col("target_cell"))))
    last = e.groupBy(*KEYS, "target_cell").agg(F.max_by(F.struct(*rest), "seq").alias("x"))
    return last.select(*KEYS, "target_cell", "x.*")


def actual_edits_for_round(edits: DataFrame, round_idx: int) -> DataFrame:
    return edits.filter(F.col("is_actual_edit") & (F.col("round_idx") == round_idx))


def edit_preview(edits: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """Distinct edited cells per group in log order; with ``n`` the first so many, and how many more there are."""
    cells = edits.filter(tx.strip(F.col("target_cell")) != "").groupBy(*by, "target_cell").agg(F.min("seq").alias("seq"))
    total = cells.groupBy(*by).agg(F.count("*").alias("n_cells"))
    head = g.top_rows(cells, by, ["seq"], n).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "target_cell"))), lambda s: s["target_cell"]).alias("cells")
    )
    more = F.lit(None).cast("string") if n is None else F.when(F.col("n_cells") > n, F.concat(F.lit("... +"), (F.col("n_cells") - n).cast("string"), F.lit(" more")))
    return total.join(head, by).select(*by, F.array_join(F.array_compact(F.concat("cells", F.array(more))), ", ").alias("preview"), "n_cells")


def current_form_values(pairs: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    p = pairs.filter((tx.strip(F.coalesce("key", F.lit(""))) != "") & (tx.strip(F.coalesce("value_cell", F.lit(""))) != ""))
    return g.read_anchor_value(p, cells, merges).filter("a_row is not null")


def expand_target(rects: DataFrame, merges: DataFrame, used: DataFrame, pad: dict[str, int] = PAD) -> DataFrame:
    """Adds ``e_r0 .. e_c1``: the rectangle widened to all merged blocks it meets, padded, clipped to the used box."""
    return rects.join(_expanded(rects.select(*KEYS, *RECT).distinct(), merges, used, pad), [*KEYS, *RECT])


def _expanded(d: DataFrame, merges: DataFrame, used: DataFrame, pad: dict[str, int]) -> DataFrame:
    """Distinct rectangles, little more than a table, with their expanded ones."""
    grown = overlap_join(d, merges.select(*KEYS, *RECT), KEYS, levels=merges, left_levels=d).groupBy(*KEYS, *RECT).agg(
        F.min("o_r0").alias("g_r0"), F.min("o_c0").alias("g_c0"), F.max("o_r1").alias("g_r1"), F.max("o_c1").alias("g_c1")
    )
    d = d.join(grown, [*KEYS, *RECT], "left").join(used.select(*KEYS, *[F.col(c).alias("x_" + c) for c in RECT]), KEYS)
    wide = [f("g_" + c, c) for f, c in ((F.least, "r0"), (F.least, "c0"), (F.greatest, "r1"), (F.greatest, "c1"))]
    return d.select(*KEYS, *RECT, *_padded(wide, [F.col("x_" + c) for c in RECT], pad))


def _padded(rect: list[Column], used: list[Column], pad: dict[str, int]) -> list[Column]:
    r0, c0, r1, c1 = rect
    return [
        F.greatest(used[0], r0 - pad["top"]).alias("e_r0"), F.greatest(used[1], c0 - pad["left"]).alias("e_c0"),
        F.least(used[2], r1 + pad["bottom"]).alias("e_r1"), F.least(used[3], c1 + pad["right"]).alias("e_c1"),
    ]


def _as_expanded(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    return df.select(*KEYS, *extra, *[F.col("e_" + c).alias(c) for c in RECT])


def _held_in(cells: DataFrame, merges: DataFrame, box: DataFrame) -> DataFrame:
    """Anchored values inside the scan box as a normalised text, with all other columns of ``box``. Texts are normalised before cells travel."""
    zero = (F.col("value_type") == "n") & F.col("value").isin("0", "0.0")
    norm = F.when(F.coalesce(zero, F.lit(False)), "").otherwise(tx.normalize_key(F.col("value")))
    at = g.attach_anchor(cells.select(*POS, norm.alias("norm")).filter("norm <> ''"), merges).filter("row = a_row AND col = a_col")
    held = at.select(*KEYS, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("m_r1").alias("r1"), F.col("m_c1").alias("c1"), "is_merged", "norm")
    clip = box.withColumnsRenamed({c: "x_" + c for c in RECT})
    held = held.join(clip, KEYS).filter(rg.intersects(tuple(F.col(c) for c in RECT), tuple(F.col("x_" + c) for c in RECT)))
    return held.drop(*["x_" + c for c in RECT])


def _repeated(held: DataFrame) -> DataFrame:
    """Rows whose text occurs at least twice on their sheet. Counts combine before the shuffle."""
    twice = held.groupBy(*KEYS, "norm").agg(F.count("*").alias("n")).filter("n >= 2").select(*KEYS, "norm")
    return held.join(twice, [*KEYS, "norm"], "left_semi")


def duplicate_values(cells: DataFrame, merges: DataFrame, box: DataFrame) -> DataFrame:
    """Anchors in the scan box that share a normalised non-empty value with another one."""
    return _repeated(cut_lineage(_held_in(cells, merges, box).select(*KEYS, *RECT, "norm")))


def duplicate_risk_regions(cells: DataFrame, merges: DataFrame, box: DataFrame, used: DataFrame, pad: dict[str, int] = PAD) -> DataFrame:
    """Distinct expanded rectangles of repeated values.

    A value outside all blocks meets no block, so its cell is expanded where it meets the scan box; only blocks are joined with blocks.
    """
    both = box.join(used.select(*KEYS, *[F.col(c).alias("u_" + c) for c in RECT]), KEYS)
    held = _held_in(cells, merges, both)
    own = _padded([F.col(c) for c in RECT], [F.col("u_" + c) for c in RECT], pad)
    grown = [F.when(F.col("is_merged"), F.col(c)).otherwise(e).alias(c) for c, e in zip(RECT, own)]
    dup = cut_lineage(_repeated(cut_lineage(held.select(*KEYS, *grown, "is_merged", "norm"))).select(*KEYS, *RECT, "is_merged"))
    blocks = _expanded(cut_lineage(dup.filter("is_merged").select(*KEYS, *RECT).distinct()), merges, used, pad)
    return dup.filter("NOT is_merged").select(*KEYS, *RECT).unionByName(_as_expanded(blocks)).distinct()


def audit_candidates(cells: DataFrame, merges: DataFrame, pairs: DataFrame, edits: DataFrame, box: DataFrame) -> DataFrame:
    """One row per field label: its value cell, whether either was edited, and the range that covers both.

    An explicit pair gives the first token of its range as the value cell; a token of several cells stays a text, has no
    value and no edit, and leaves the range at the label, as single-cell lookups do.
    """
    lab = cut_lineage(g.within_box(g.labels(cells), box))
    probable = lab.filter(tx.probable_key(F.col("text"))).withColumn("norm", tx.normalize_key(F.col("text")))
    first = F.upper(tx.strip(F.element_at(F.split("value_cell", ","), 1)))
    named = pairs.withColumn("norm", tx.normalize_key(F.col("key"))).filter((F.col("norm") != "") & (tx.strip(F.coalesce("value_cell", F.lit(""))) != ""))
    named = named.groupBy(*KEYS, "norm").agg(F.min_by(first, "pair_idx").alias("explicit"))
    writable = g.input_cells(pairs, merges).unionByName(g.input_candidates(cells, merges, box)).distinct()
    c = cut_lineage(probable.join(named, [*KEYS, "norm"], "left"))
    open_labels = c.filter("explicit is null")
    c = c.join(m.guess_value_cell(open_labels, merges, writable, lab), POS, "left")
    c = c.withColumn("x", rg.coord(F.col("explicit"))).select(
        *POS, F.col("text").alias("key"), "norm",
        F.coalesce("explicit", rg.a1_cell(F.col("v_row"), F.col("v_col")), F.lit("")).alias("value_cell"),
        F.when(F.col("explicit").isNotNull(), F.col("x.row")).otherwise(F.col("v_row")).alias("v_row"),
        F.when(F.col("explicit").isNotNull(), F.col("x.col")).otherwise(F.col("v_col")).alias("v_col"),
    )
    c = c.withColumn("label_cell", rg.a1_cell(F.col("row"), F.col("col")))
    latest = latest_effective_edits(edits).select(*KEYS, "target_cell", F.struct("old_value", "new_value").alias("e"))
    # Edits of labels meet them by position, where labels already lie after the join before; the texts decide.
    el = latest.select(*KEYS, "target_cell", F.col("e").alias("el"), F.inline(F.array_compact(F.array(rg.coord(F.col("target_cell"))))))
    el = el.withColumnsRenamed({k: "_e_" + k for k in POS})
    on = F.col("label_cell") == F.col("target_cell")
    for k in POS:
        on = on & (F.col(k) == F.col("_e_" + k))
    c = cut_lineage(c.join(el, on, "left").drop("target_cell", *["_e_" + k for k in POS]))
    # A value cell's text fixes its position, so all that is known of it comes in one join.
    vp = c.groupBy(*KEYS, "value_cell").agg(F.max("v_row").alias("row"), F.max("v_col").alias("col"))
    vp = cut_lineage(vp.join(latest.select(*KEYS, F.col("target_cell").alias("value_cell"), F.col("e").alias("ev")), [*KEYS, "value_cell"], "left"))
    held = cells.select(*KEYS, F.col("row").alias("a_row"), F.col("col").alias("a_col"), F.col("value").alias("current_value"), F.col("value_type").alias("current_type"))
    at = g.attach_anchor(vp.filter("row is not null"), merges).join(held, [*KEYS, "a_row", "a_col"], "left")
    facts = at.select(*KEYS, "value_cell", "ev", "current_value", "current_type").unionByName(
        vp.filter("row is null AND ev is not null").select(*KEYS, "value_cell", "ev"), allowMissingColumns=True
    )
    c = c.join(facts, [*KEYS, "value_cell"], "left")
    edit = F.coalesce("ev", "el")
    return c.select(
        *POS, "label_cell", "key", "value_cell", "current_value", "current_type",
        edit.isNotNull().alias("is_actual_edit"), (F.col("ev").isNull() & F.col("el").isNotNull()).alias("edited_label_cell"),
        edit["old_value"].alias("old_value"), edit["new_value"].alias("new_value"),
        F.least("row", "v_row").alias("r0"), F.least("col", "v_col").alias("c0"), F.greatest("row", "v_row").alias("r1"), F.greatest("col", "v_col").alias("c1"),
    )


def programmatic_flags(candidates: DataFrame, duplicate_regions: DataFrame, bad_ranges: DataFrame, correct_ranges: DataFrame | None = None) -> DataFrame:
    """Candidates with sorted ``flags``: edited label, overlap with a duplicate region, overlap with a reported bad range.

    With ``correct_ranges`` the boolean ``in_correct`` comes along, which ``assess`` then need not look up.
    """
    correct = {} if correct_ranges is None else {"in_correct": correct_ranges}
    c = flag_overlaps(candidates, {"_dup": duplicate_regions, "_bad": bad_ranges, **correct}, KEYS)
    flags = F.array(
        F.when(F.col("_dup"), "duplicate_pattern"), F.when(F.col("edited_label_cell"), "label_area"), F.when(F.col("_bad"), "screenshot_bad_range_hit")
    )
    return c.withColumn("flags", F.array_compact(flags)).drop("_dup", "_bad")


def propagate_forward(items: DataFrame) -> DataFrame:
    """Keys and positions of items that are fine because an earlier fine item overlaps them.

    items: POS, rectangle, ``base_ok``, ``hard``. Fine spreads from earlier to later row-major positions and never touches hard
    items. A sheet with few items is gone through once in their order. On larger sheets overlaps are not written as pairs of
    items: equal rectangles are one, and of the newly fine items under a rectangle only the earliest counts, so a pass joins the
    rectangles that still wait with those that have become fine.
    """
    at = (F.col("row").cast("long") * 32768 + F.col("col")).alias("at")
    soft = cut_lineage(items.filter(~F.col("hard")).select(*POS, *RECT, "base_ok", at))
    small, large = split_small(soft, KEYS)
    met = _propagate_in_order(small)
    return met if large is None else met.unionByName(_propagate_by_passes(cut_lineage(soft.join(large, KEYS, "left_semi"))))


def _propagate_in_order(soft: DataFrame) -> DataFrame:
    """Fine items are gathered in their order; a later one that overlaps one of them is met, and fine as well."""
    items = F.array_sort(F.collect_list(F.struct("at", "row", "col", *RECT, "base_ok")))

    def step(acc: Column, x: Column) -> Column:
        over = F.exists(acc["fine"], lambda f: (f["at"] < x["at"]) & rg.intersects(tuple(f[c] for c in RECT), tuple(x[c] for c in RECT)))
        add = lambda name, when: F.when(when, F.concat(acc[name], F.array(x))).otherwise(acc[name]).alias(name)
        return F.struct(add("fine", over | x["base_ok"]), add("met", over))

    none = F.slice("items", 1, 0)
    end = F.aggregate("items", F.struct(none.alias("fine"), none.alias("met")), step, lambda acc: acc["met"])
    d = soft.groupBy(*KEYS).agg(items.alias("items")).filter(F.exists("items", lambda x: x["base_ok"]))
    return d.select(*KEYS, F.explode(end).alias("x")).select(*KEYS, "x.row", "x.col").distinct()


def _propagate_by_passes(soft: DataFrame) -> DataFrame:
    front = soft.filter("base_ok").groupBy(*KEYS, *RECT).agg(F.min("at").alias("first"))
    waiting, hits = soft, None
    while True:
        wanted = waiting.groupBy(*KEYS, *RECT).agg(F.max("at").alias("last"))
        met = overlap_join(wanted, front, KEYS, levels=soft, left_levels=soft).filter(F.col("first") < F.col("last"))
        met = met.groupBy(*KEYS, *RECT).agg(F.min("first").alias("first"))
        step = cut_lineage(waiting.join(met, [*KEYS, *RECT], "left").withColumn("hit", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).drop("first"))
        hits = step.filter("hit").select(*POS) if hits is None else hits.unionByName(step.filter("hit").select(*POS))
        new = step.filter("hit AND NOT base_ok")
        if new.isEmpty():
            return hits.distinct()
        front = new.groupBy(*KEYS, *RECT).agg(F.min("at").alias("first"))
        waiting = step.filter("NOT hit").drop("hit")


def assess(
    candidates: DataFrame, model_flags: DataFrame, correct_ranges: DataFrame, policies: DataFrame, threshold: int = 1, full: bool = True
) -> DataFrame:
    """Risk per flagged candidate. model_flags: keys, label_cell, is_correct_region, is_safe_blank, three risk booleans, reason."""
    known = "in_correct" in candidates.columns
    c = candidates if known else flag_overlap(candidates, correct_ranges, KEYS, "in_correct")
    c = c.join(model_flags, [*KEYS, "label_cell"], "left")
    rule = m.blank_policy_for_key(candidates.select("wb_id", "key"), policies, full)
    c = c.join(rule, ["wb_id", "key"], "left")
    no = lambda name: F.coalesce(F.col(name), F.lit(False))
    has_rule, blank = F.col("policy_target").isNotNull(), tx.blankish(F.col("current_value"), F.col("current_type"))
    said = F.concat(F.lit("Planner policy says '"), F.col("policy_target"), F.lit("' should remain blank"), F.when(blank, ".").otherwise(", but the field is filled."))
    said = F.when(F.col("policy_reason") != "", F.concat(said, F.lit(" Reason: "), F.col("policy_reason"), F.lit("."))).otherwise(said)
    model_reason = F.coalesce(F.col("reason"), F.lit(""))
    hard = F.array_contains("flags", "label_area")
    c = c.withColumn("_text", tx.strip(F.when(has_rule, F.concat_ws(" ", said, F.nullif(model_reason, F.lit("")))).otherwise(model_reason)))
    overwrite = "A value was written into a detected key/label cell. Treat this as a label-area overwrite that must be repaired."
    c = c.withColumn("hard", hard).withColumn("reason_text", F.when(hard & (F.col("_text") == ""), overwrite).otherwise(F.col("_text"))).drop("_text")
    more = F.array(
        F.when(no("template_inconsistency"), "template_inconsistency"), F.when(no("high_risk_pattern"), "high_risk_pattern"),
        F.when(no("special_char_anomaly"), "special_char_anomaly"), F.when(has_rule & ~blank, "planner_blank_violation"),
    )
    c = c.withColumn("flags", F.array_sort(F.array_distinct(F.array_compact(F.concat("flags", more)))))
    correct = no("is_correct_region") | F.col("in_correct") | (has_rule & blank) | tx.reason_correct(F.col("reason_text"))
    safe = no("is_safe_blank") | (has_rule & blank) | tx.reason_safe_blank(F.col("reason_text"))
    c = c.withColumn("base_correct", ~F.col("hard") & correct).withColumn("is_safe", ~F.col("hard") & safe)
    # Only what the rest needs is written, so that earlier joins do not carry more either.
    shown = [*POS, "label_cell", "key", "value_cell", "current_value", "is_actual_edit", "edited_label_cell", *RECT]
    c = cut_lineage(c.select(*shown, "flags", "hard", "reason_text", "base_correct", "is_safe", (F.col("base_correct") | F.col("is_safe")).alias("base_ok")))
    spread = propagate_forward(c).withColumn("_spread", F.lit(True))
    c = c.join(spread, POS, "left")
    is_correct = F.col("base_correct") | (F.coalesce("_spread", F.lit(False)) & ~F.col("hard"))
    c = c.withColumn("is_correct", is_correct)
    fine = F.col("is_correct") | F.col("is_safe")
    c = c.withColumn("flags", F.when(fine, F.array().cast("array<string>")).otherwise(F.col("flags")))
    score = F.size("flags")
    return c.select(
        *shown, "flags", score.alias("score"),
        "is_correct", "is_safe", (~fine & (F.col("hard") | (score >= max(1, threshold)))).alias("is_high_risk"), F.col("reason_text").alias("reason"),
    )


def direct_range_mode(candidates: DataFrame, bad_ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alternative audit: only ranges the model reports count. Gives candidates with ``is_high_risk`` and the targets."""
    c = flag_overlap(candidates, bad_ranges, KEYS, "is_high_risk")
    targets = bad_ranges.select(*KEYS, *RECT).distinct().select(*KEYS, F.lit("model_bad_range").alias("kind"), F.lit("").alias("key"), *RECT)
    return c, targets


def repair_targets(assessed: DataFrame, bad_ranges: DataFrame) -> DataFrame:
    """Targets of a round: overwritten labels, high-risk fields (a field can be both), and reported bad ranges."""
    a = assessed.filter(~(F.col("is_correct") | F.col("is_safe")))
    kinds = F.array_compact(F.array(F.when(F.array_contains("flags", "label_area"), "label_area_edit"), F.when(F.col("is_high_risk"), "high_risk_edit")))
    named = a.select(*KEYS, F.explode(kinds).alias("kind"), "key", *RECT, "flags", F.struct("row", "col").alias("src"))
    shown = bad_ranges.select(
        *KEYS, F.lit("screenshot_bad_range").alias("kind"), F.lit("").alias("key"), *RECT,
        F.array(F.lit("screenshot_need_fix")).alias("flags"), F.struct(F.col("r0").alias("row"), F.col("c0").alias("col")).alias("src"),
    )
    return named.unionByName(shown)


def _fold_corners(d: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes whose corner lies in the same 2x2 block touch, so they fold by aggregation and are never paired."""
    for r, c in (("r0", "c0"), ("r1", "c1")):
        d = d.groupBy(*keys, F.shiftright(r, 1).alias("_p"), F.shiftright(c, 1).alias("_q")).agg(*rg.bbox_agg()).drop("_p", "_q")
    return d


def merge_touching_regions(rects: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Final boxes after replacing touching rectangles by their bounding box until none touch.

    Whatever contains two touching boxes touches both, so every merge is forced and the result does not depend on order.
    Each pass grows the boxes that changed to the box of their neighbours, which doubles the reach: passes follow the
    logarithm of the longest chain. Settled boxes are only looked up; those inside a grown box go. It ends when no box grows.
    """
    active = cut_lineage(_fold_corners(rects.select(*keys, *RECT).distinct(), keys))
    settled = None
    while True:
        others = active if settled is None else active.unionByName(settled)
        near = overlap_join(active, others, keys, grow=1, levels=others, left_levels=active).groupBy(*keys, *RECT).agg(
            F.min("o_r0").alias("n_r0"), F.min("o_c0").alias("n_c0"), F.max("o_r1").alias("n_r1"), F.max("o_c1").alias("n_c1")
        )
        same = F.lit(True)
        for c in RECT:
            same = same & (F.col(c) == F.col("n_" + c))
        near = cut_lineage(near.select(*keys, *[F.col("n_" + c).alias(c) for c in RECT], (~same).alias("_moved")))
        still = near.filter("not _moved").drop("_moved")
        if near.filter("_moved").isEmpty():
            return (still if settled is None else still.unionByName(settled)).distinct()
        grown = cut_lineage(_fold_corners(near.filter("_moved").drop("_moved").distinct(), keys))
        rest = still if settled is None else still.unionByName(settled)
        inside = (F.col("r0") >= F.col("o_r0")) & (F.col("c0") >= F.col("o_c0")) & (F.col("r1") <= F.col("o_r1")) & (F.col("c1") <= F.col("o_c1"))
        eaten = overlap_join(rest.distinct(), grown, keys, levels=grown, left_levels=rest).filter(inside).select(*keys, *RECT).distinct()
        settled, old = cut_lineage(rest.distinct().join(eaten, [*keys, *RECT], "left_anti")), (active, settled, near)
        active = grown
        for table in old:
            if table is not None:
                drop_cut(table)


def patch_jobs(targets: DataFrame, merges: DataFrame, used: DataFrame, pad: dict[str, int] = PAD) -> DataFrame:
    """Targets filed under the merged regions their expanded range meets; one row per (region, kind, key, range)."""
    t = cut_lineage(expand_target(cut_lineage(targets), merges, used, pad))
    areas = cut_lineage(_as_expanded(t).distinct())
    merged = cut_lineage(merge_touching_regions(areas))
    at = overlap_join(areas, merged, KEYS, levels=merged, left_levels=areas).select(*KEYS, *[F.col(c).alias("e_" + c) for c in RECT], *[F.col("o_" + c).alias("g_" + c) for c in RECT])
    j = t.join(at, [*KEYS, *["e_" + c for c in RECT]])
    region = [F.col("g_" + c) for c in RECT]
    j = j.groupBy(*KEYS, *["g_" + c for c in RECT], "kind", "key", *RECT).agg(F.min_by(F.struct("flags", "src"), "src").alias("x"))
    return j.select(*KEYS, rg.a1_range(*region).alias("region"), *["g_" + c for c in RECT], "kind", "key", *RECT, "x.flags", "x.src")


def bad_and_correct_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ranges per group and kind in sorted order, as rows with a position. ranges: by, range_kind, range."""
    from pyspark.sql import Window as W

    d = ranges.filter(tx.strip(F.col("range")) != "").select(*by, "range_kind", "range").distinct()
    return d.withColumn("pos", F.row_number().over(W.partitionBy(*by, "range_kind").orderBy("range")))


def audit_round(
    cells: DataFrame, merges: DataFrame, pairs: DataFrame, edits: DataFrame, model_flags: DataFrame, bad_ranges: DataFrame,
    correct_ranges: DataFrame, policies: DataFrame, threshold: int = 1, full: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """One audit round over all sheets: assessed candidates and the repair jobs."""
    used = cut_lineage(g.used_bbox(cells, merges))
    box = cut_lineage(g.form_bbox(pairs, used))
    cand = cut_lineage(audit_candidates(cells, merges, pairs, edits, box))
    flagged = programmatic_flags(cand, duplicate_risk_regions(cells, merges, box, used), bad_ranges, correct_ranges)
    assessed = assess(flagged, model_flags, correct_ranges, policies, threshold, full)
    return assessed, patch_jobs(repair_targets(assessed, bad_ranges), merges, used)
