"""Matching of keys, labels and value cells across sheets, forms and edit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.functions import text as tx
from formloom.operators.grid import KEYS, POS, as_rects, attach_anchor, nonempty_cells, read_anchor_value, top_rows
from formloom.operators.similar import score_texts, similar_pairs, similar_texts, small_groups
from formloom.operators.spatial import RECT, overlap_join
from formloom.session import cut_lineage

POLICY_THRESHOLD, CONTEXT_THRESHOLD = 0.74, 0.60
# Actions that mean "leave this field blank".
BLANK_ACTIONS = ("leave_blank", "leave blank", "blank", "do_not_fill", "do not fill", "skip")


def best_label(targets: DataFrame, labels: DataFrame, threshold: float, full: bool = True) -> DataFrame:
    """Best-scoring label per target text of a sheet; the first label in row-major order wins ties.

    targets: keys, target. Output adds ``l_row, l_col, l_text, score``; targets below the threshold drop out.
    """
    tgt = targets.withColumn("norm", tx.normalize_key(F.col("target")))
    lab = cut_lineage(labels.withColumn("norm", tx.normalize_key(F.col("text"))))
    pairs = similar_pairs(tgt.select(*KEYS, "norm"), lab.select(*KEYS, "norm"), KEYS, threshold, full)
    first = lab.groupBy(*KEYS, F.col("norm").alias("b")).agg(F.min(F.struct("row", "col", "text")).alias("l"))
    best = pairs.join(first, [*KEYS, "b"]).groupBy(*KEYS, F.col("a").alias("norm")).agg(
        F.max_by(F.struct("l", "score"), F.struct("score", -F.col("l.row"), -F.col("l.col"))).alias("m")
    )
    return tgt.join(best, [*KEYS, "norm"]).select(
        *targets.columns, F.col("m.l.row").alias("l_row"), F.col("m.l.col").alias("l_col"), F.col("m.l.text").alias("l_text"), F.col("m.score").alias("score")
    )


# Probe offsets around a label, in order: six to the right, then two rows of five below.
PROBES = [(0, dc) for dc in range(1, 7)] + [(dr, dc) for dr in (1, 2) for dc in range(5)]


# Rows and columns of a block of cells, as a power of two, and how far probes reach out of it.
PROBE_BLOCK, PROBE_DOWN, PROBE_RIGHT = 4, max(r for r, _ in PROBES), max(c for _, c in PROBES)


def guess_value_cell(labels: DataFrame, merges: DataFrame, writable: DataFrame, label_cells: DataFrame) -> DataFrame:
    """Value cell of each label: the first probe that is writable, else the first that is neither itself nor a label.

    Probes are never rows: cells and merged blocks are filed under the small blocks of cells whose labels can probe them, and a
    label looks its probes up in its block's arrays, of some hundred cells at most. A merged block brings what its anchor is, so
    the anchor may lie anywhere; blocks that cover many blocks of cells meet those with labels by an interval join.
    """
    k, packed = PROBE_BLOCK, lambda r, c: r.cast("long") * 32768 + c
    flags = cut_lineage(writable.select(*POS, F.lit(1).alias("bit")).unionByName(label_cells.select(*POS, F.lit(2).alias("bit"))))
    lab = labels.select(*POS).distinct().withColumn("_bi", F.shiftright("row", k)).withColumn("_bj", F.shiftright("col", k))
    filed = lambda d, r0, c0, r1, c1: d.withColumn("_bi", F.explode(F.sequence(F.shiftright(F.col(r0) - PROBE_DOWN, k), F.shiftright(r1, k)))).withColumn(
        "_bj", F.explode(F.sequence(F.shiftright(F.col(c0) - PROBE_RIGHT, k), F.shiftright(c1, k))))
    at = flags.select(*KEYS, F.col("row").alias("r0"), F.col("col").alias("c0"), "bit")
    m = merges.select(*KEYS, *RECT).join(at, [*KEYS, "r0", "c0"], "left").groupBy(*KEYS, *RECT).agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("bits"))
    few = (F.col("r1") - F.col("r0") < 256) & (F.col("c1") - F.col("c0") < 256)
    block = lambda pre: F.struct(*[F.col(pre + c).alias(c) for c in RECT], "bits").alias("m")
    none = F.lit(None).cast("struct<r0:int,c0:int,r1:int,c1:int,bits:int>").alias("m")
    spot = packed(F.col("row"), F.col("col"))
    facts = filed(flags, "row", "col", "row", "col").select(*KEYS, "_bi", "_bj", F.when(F.col("bit") == 1, spot).alias("w"), F.when(F.col("bit") == 2, spot).alias("l"), none)
    nothing = [F.lit(None).cast("long").alias("w"), F.lit(None).cast("long").alias("l")]
    facts = facts.unionByName(filed(m.filter(few), *RECT).select(*KEYS, "_bi", "_bj", *nothing, block("")))
    if not merges.filter(~few).isEmpty():
        home = [F.shiftleft("_bi", k).alias("r0"), F.shiftleft("_bj", k).alias("c0")]
        home += [(F.shiftleft("_bi", k) + (1 << k) - 1 + PROBE_DOWN).alias("r1"), (F.shiftleft("_bj", k) + (1 << k) - 1 + PROBE_RIGHT).alias("c1")]
        wide = overlap_join(lab.select(*KEYS, "_bi", "_bj").distinct().select(*KEYS, "_bi", "_bj", *home), m.filter(~few), KEYS, levels=merges)
        facts = facts.unionByName(wide.select(*KEYS, "_bi", "_bj", *nothing, block("o_")))
    facts = facts.groupBy(*KEYS, "_bi", "_bj").agg(F.collect_set("w").alias("_w"), F.collect_set("l").alias("_l"), F.collect_list("m").alias("_m"))
    offs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for i, (r, c) in enumerate(PROBES)])
    held = lambda name, x: F.coalesce(F.array_contains(name, x), F.lit(False))

    def landing(o: Column, row: Column, col: Column, w: Column, is_l: Column) -> Column:
        own = (row == F.col("row")) & (col == F.col("col"))
        step = F.when(own, None).when(w, 1).when(~is_l, 2)
        return F.struct(step.alias("step"), o["ord"].alias("ord"), row.alias("row"), col.alias("col"))

    def merged(o: Column) -> Column:
        row, col = F.col("row") + o["dr"], F.col("col") + o["dc"]
        over = F.filter("_near", lambda x: row.between(x["r0"], x["r1"]) & col.between(x["c0"], x["c1"]))
        there = F.transform(over, lambda x: landing(o, x["r0"], x["c0"], x["bits"].bitwiseAND(1) > 0, x["bits"].bitwiseAND(2) > 0))
        free = landing(o, row, col, held("_w", packed(row, col)), held("_l", packed(row, col)))
        return F.when(F.size(there) > 0, there).otherwise(F.array(free))

    # Without a merged block in reach the first probe among the writable cells answers, else the first that is no label.
    # Intersection and difference keep the order of the probes.
    ask = F.array(*[packed(F.col("row") + r, F.col("col") + c) for r, c in PROBES])
    no_cells = F.array().cast("array<bigint>")
    first = F.coalesce(F.get(F.array_intersect(ask, F.coalesce("_w", no_cells)), 0), F.get(F.array_except(ask, F.coalesce("_l", no_cells)), 0))
    plain = F.when(first.isNotNull(), F.struct(
        F.lit(0).alias("step"), F.lit(0).alias("ord"), F.shiftright(first, 15).cast("int").alias("row"), first.bitwiseAND(32767).cast("int").alias("col")))
    best = F.array_min(F.filter(F.flatten(F.transform(offs, merged)), lambda x: x["step"].isNotNull()))
    reach = F.filter("_m", lambda x: (x["r0"] <= F.col("row") + PROBE_DOWN) & (x["r1"] >= F.col("row")) & (x["c0"] <= F.col("col") + PROBE_RIGHT) & (x["c1"] >= F.col("col")))
    j = lab.join(facts, [*KEYS, "_bi", "_bj"], "left").withColumn("_near", reach)
    v = F.when(F.coalesce(F.size("_near"), F.lit(0)) <= 0, plain).otherwise(best)
    # A generator drops labels without an answer; a filter would be moved below and work the probes out again.
    j = j.select(*[F.col(c).alias("_p_" + c) for c in POS], v.alias("_v"))
    j = j.select(*["_p_" + c for c in POS], F.inline(F.array_compact(F.array("_v"))))
    return j.select(*[F.col("_p_" + c).alias(c) for c in POS], F.col("row").alias("v_row"), F.col("col").alias("v_col"))


def kind_bonus(kind: Column) -> Column:
    return F.when(kind == "boxed", 0.12).when(kind == "bottom_line", 0.08).when(kind == "merged_anchor", 0.05).otherwise(0.0)


# How far a candidate may lie from its label before no score can pass the cut of 0.24.
REACH_ROWS, REACH_LEFT, REACH_RIGHT, MIN_SCORE = 46, 19, 17, 0.24
# Rows and columns of a block of labels, as powers of two.
LABEL_BLOCK = (6, 5)


def rank_candidates(labels: DataFrame, candidates: DataFrame, label_cells: DataFrame, n: int | None = None) -> DataFrame:
    """Writable cells near each label by score, best first; ``n`` keeps so many a label.

    The cut bounds the distance, so a candidate is filed under the few blocks of labels it can reach. A block's candidates are
    one array, of some ten thousand at most, from which each label takes its best; pairs are neither shuffled nor sorted in bulk.
    """
    free = candidates.join(label_cells.select(*POS).distinct(), POS, "left_anti")
    h, w = LABEL_BLOCK
    reach = lambda lo, hi, k: F.explode(F.sequence(F.shiftright(F.greatest(F.lit(0), lo), k), F.shiftright(hi, k)))
    filed = free.withColumn("_i", reach(F.col("row") - REACH_ROWS, F.col("row") + REACH_ROWS, h))
    filed = filed.withColumn("_j", reach(F.col("col") - REACH_RIGHT, F.col("col") + REACH_LEFT, w))
    blocks = filed.groupBy(*KEYS, "_i", "_j").agg(F.collect_list(F.struct("row", "col", "kind", kind_bonus(F.col("kind")).alias("bonus"))).alias("_near"))
    lab = labels.select(*POS).distinct().select(
        *KEYS, F.col("row").alias("l_row"), F.col("col").alias("l_col"), F.shiftright("row", h).alias("_i"), F.shiftright("col", w).alias("_j")
    )

    def scored(x: Column) -> Column:
        dr, dc = F.abs(x["row"] - F.col("l_row")), x["col"] - F.col("l_col")
        base = (
            F.when(dc >= 1, F.lit(2.2) / (1.0 + 0.35 * dr + dc))
            .when(x["row"] > F.col("l_row"), F.lit(1.3) / (1.0 + 0.45 * F.abs(dc) + dr))
            .otherwise(F.lit(0.5) / (1.0 + dr + F.abs(dc)))
        )
        return F.struct((-(base + x["bonus"])).alias("cost"), x["row"].alias("row"), x["col"].alias("col"), x["kind"].alias("kind"))

    other = lambda x: (x["cost"] < -MIN_SCORE) & ((x["row"] != F.col("l_row")) | (x["col"] != F.col("l_col")))
    best = F.sort_array(F.filter(F.transform("_near", scored), other))
    best = best if n is None else F.slice(best, 1, n)
    j = lab.join(blocks, [*KEYS, "_i", "_j"]).select(*KEYS, "l_row", "l_col", F.posexplode(best).alias("_at", "_x"))
    return j.select(*KEYS, "l_row", "l_col", "_x.row", "_x.col", "_x.kind", (-F.col("_x.cost")).alias("score"), (F.col("_at") + 1).alias("rank"))


def _best_text_label(keys_df: DataFrame, labels: DataFrame, full: bool) -> DataFrame:
    """Best label per key text with no lower cut. Sheets with few labels pair directly and are settled in one pass; on the
    others thresholds fall until every text is settled or nothing is left to share."""
    left = keys_df.select(*KEYS, tx.normalize_compare(F.col("key_text")).alias("norm")).filter("norm <> ''").distinct()
    lab = cut_lineage(labels.withColumn("norm", tx.normalize_compare(F.col("text"))))
    first = lab.groupBy(*KEYS, F.col("norm").alias("b")).agg(F.min(F.struct("row", "col", "text")).alias("l"))

    def best(pairs: DataFrame) -> DataFrame:
        b = pairs.join(first, [*KEYS, "b"]).groupBy(*KEYS, F.col("a").alias("norm")).agg(
            F.max_by(F.struct("l", "score"), F.struct("score", -F.col("l.row"), -F.col("l.col"))).alias("m")
        )
        return cut_lineage(b)

    few, left, rest = small_groups(left, lab.select(*KEYS, "norm"), KEYS)
    left, out = cut_lineage(left), best(score_texts(few, KEYS, 1e-6, full))
    for t in (0.75, 0.34, 1e-6):
        if left.isEmpty():
            break
        found = best(similar_texts(left, rest, KEYS, t, full))
        out, left = out.unionByName(found), left.join(found, [*KEYS, "norm"], "left_anti")
    return out


def fused_hints(pairs: DataFrame, labels: DataFrame, candidates: DataFrame, box: DataFrame, full: bool = True, n: int = 3) -> DataFrame:
    """Candidates for each slot pair, ranked by label position (0.7) and by nearness to the proposed cell (0.3).

    pairs: keys, pair_id, key_text, value_cell. A candidate outside the window of a pair cannot beat a third place above
    the bound for that distance, so windows grow only for pairs that are not settled yet, up to the whole sheet box.
    """
    lab = _best_text_label(pairs, labels, full)
    p = pairs.withColumn("norm", tx.normalize_compare(F.col("key_text"))).filter("norm <> ''")
    p = p.join(lab, [*KEYS, "norm"], "left").withColumn("q", rg.coord(F.col("value_cell")))
    p = p.select(
        *KEYS, "pair_id", "key_text", "value_cell", F.col("m.l.row").alias("l_row"), F.col("m.l.col").alias("l_col"),
        F.col("m.l.text").alias("l_text"), F.bround(F.coalesce("m.score", F.lit(0.0)), 4).alias("label_score"),
        F.col("q.row").alias("q_row"), F.col("q.col").alias("q_col"),
    )
    p = cut_lineage(p)
    spots = p.select(
        *KEYS, "pair_id", "l_row", "l_col", "q_row", "q_col"
    ).join(box.select(*KEYS, *[F.col(c).alias("x_" + c) for c in RECT]), KEYS)
    spots = cut_lineage(spots)
    cand = as_rects(candidates.select(*POS, "kind"))
    done = None
    for radius in (24, 192, None):
        mids = [F.coalesce("l_" + a, "q_" + a, F.lit(1)) for a in ("row", "col")]
        others = [F.coalesce("q_" + a, "l_" + a, F.lit(1)) for a in ("row", "col")]
        if radius is None:
            win = [F.col("x_" + c).alias(c) for c in RECT]
        else:
            win = [
                (F.least(mids[0], others[0]) - radius).alias("r0"), (F.least(mids[1], others[1]) - radius).alias("c0"),
                (F.greatest(mids[0], others[0]) + radius).alias("r1"), (F.greatest(mids[1], others[1]) + radius).alias("c1"),
            ]
        windows = spots.select(*KEYS, "pair_id", "l_row", "l_col", "q_row", "q_col", *win)
        j = overlap_join(cand, windows, KEYS, points=True, levels=windows)
        dr, dc = F.abs(F.col("row") - F.col("l_row")), F.col("col") - F.col("l_col")
        near = F.lit(1.0) / (1.0 + dr + 0.35 * F.abs(dc))
        place = F.coalesce(0.65 * F.when(dc >= 1, 1.0).otherwise(0.5) + 0.35 * near, F.lit(0.0))
        structural = F.least(F.lit(1.0), F.when(F.col("l_row").isNull(), 0.0).otherwise(place) + kind_bonus(F.col("kind")))
        model = F.coalesce(F.lit(1.0) / (1.0 + F.abs(F.col("row") - F.col("q_row")) + F.abs(F.col("col") - F.col("q_col"))), F.lit(0.0))
        j = j.withColumn("structural_score", F.bround(structural, 4)).withColumn("model_score", F.bround(model, 4))
        j = j.withColumn("final_score", F.bround(0.7 * structural + 0.3 * model, 4))
        top = j.withColumn("rank", F.row_number().over(W.partitionBy(*KEYS, "pair_id").orderBy(F.desc("final_score"), "row", "col")))
        top = cut_lineage(top.filter(F.col("rank") <= n).select(*KEYS, "pair_id", "row", "col", "kind", "structural_score", "model_score", "final_score", "rank"))
        if radius is not None:
            # Outside the window: at least ``radius`` away from both label and proposed cell in some axis.
            bound = 0.7 * (0.77 + 0.35 / (1 + 0.35 * radius)) + 0.3 / (1 + radius)
            bound_free = 0.7 * 0.12 + 0.3 / (1 + radius)
            third = top.groupBy(*KEYS, "pair_id").agg(F.min("final_score").alias("m"), F.count("*").alias("k"))
            settled = spots.join(third, [*KEYS, "pair_id"]).filter(
                (F.col("k") >= n) & (F.col("m") > F.when(F.col("l_row").isNull(), bound_free).otherwise(bound) + 1e-4)
            ).select(*KEYS, "pair_id")
            covers = spots.filter(
                (F.least(mids[0], others[0]) - radius <= F.col("x_r0")) & (F.least(mids[1], others[1]) - radius <= F.col("x_c0"))
                & (F.greatest(mids[0], others[0]) + radius >= F.col("x_r1")) & (F.greatest(mids[1], others[1]) + radius >= F.col("x_c1"))
            ).select(*KEYS, "pair_id")
            settled = cut_lineage(settled.unionByName(covers).distinct())
            top = top.join(settled, [*KEYS, "pair_id"], "left_semi")
            spots = cut_lineage(spots.join(settled, [*KEYS, "pair_id"], "left_anti"))
        done = top if done is None else done.unionByName(top)
        if radius is not None and spots.isEmpty():
            break
    return p.join(done, [*KEYS, "pair_id"], "left")


# Reasons recorded when a slot is refused.
INVALID_MARKED, INVALID_NO_KEY, INVALID_SELF = "qwen_marked_invalid_slot", "missing_key_text", "pipeline_invalid_self_label_value_cell"


def anchored_values(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Stored values with the rectangle they stand for; cells covered by a block but not its anchor are left out."""
    c = attach_anchor(cells.select(*POS, "value", "value_type"), merges)
    c = c.filter((F.col("row") == F.col("a_row")) & (F.col("col") == F.col("a_col")))
    return c.select(*KEYS, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("m_r1").alias("r1"), F.col("m_c1").alias("c1"), "value", "value_type")


def resolve_form(slot_pairs: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Splits slot pairs into ``pair``, ``invalid`` and ``self_label`` (the value cell already holds the key's own text).

    slot_pairs: keys, pair_idx, slot_id, value_cell, is_valid_slot, key_text, reason, invalidated_reason.
    """
    s = slot_pairs.withColumn("key", tx.strip(F.coalesce("key_text", F.lit("")))).withColumn("cell", tx.strip(F.coalesce("value_cell", F.lit(""))))
    s = s.withColumn("norm", tx.normalize_key(F.col("key"))).filter("cell <> ''")
    rects = s.filter("norm <> ''").select(*KEYS, "pair_idx", "norm", F.inline(rg.parse_list(F.col("cell"))))
    held = anchored_values(cells, merges).withColumn("norm", tx.normalize_key(F.col("value"))).filter("norm <> ''")
    held = held.select(*KEYS, "norm", *[F.col(c).alias("o_" + c) for c in RECT])
    own = rects.join(held, [*KEYS, "norm"]).filter(
        rg.intersects(tuple(F.col(c) for c in RECT), tuple(F.col("o_" + c) for c in RECT))
    ).select(*KEYS, "pair_idx").distinct().withColumn("_self", F.lit(True))
    s = s.join(own, [*KEYS, "pair_idx"], "left")
    raw = F.nullif(tx.strip(F.coalesce(F.nullif("invalidated_reason", F.lit("")), "reason", F.lit(""))), F.lit(""))
    status = F.when(~F.col("is_valid_slot") | (F.col("key") == ""), "invalid").when(F.col("_self"), "self_label").otherwise("pair")
    reason = (
        F.when(~F.col("is_valid_slot"), F.coalesce(raw, F.lit(INVALID_MARKED)))
        .when(F.col("key") == "", F.coalesce(raw, F.lit(INVALID_NO_KEY)))
        .when(F.col("_self"), INVALID_SELF)
    )
    s = s.select(*KEYS, "pair_idx", "slot_id", "key", F.col("cell").alias("value_cell"), status.alias("status"), reason.alias("reason"), "norm")
    good = s.filter("status = 'pair'").drop("norm")
    bad = s.filter("status <> 'pair'").groupBy(*KEYS, "slot_id", F.upper("value_cell").alias("_c"), "norm", "reason").agg(
        F.min_by(F.struct("pair_idx", "key", "value_cell", "status"), "pair_idx").alias("x")
    )
    return good.unionByName(bad.select(*KEYS, "slot_id", "reason", "x.*"))


def match_edit_key(edits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edits with their own key, else the key of the first pair whose range covers the edited cell, else ''."""
    e = edits.withColumn("_x", rg.coord(F.col("target_cell"))).withColumn("row", F.col("_x.row")).withColumn("col", F.col("_x.col")).drop("_x")
    spots = as_rects(e.filter(F.coalesce("key", F.lit("")) == "").filter("row is not null").select(*POS).distinct())
    rects = pairs.select(*KEYS, "pair_idx", F.col("key").alias("p_key"), F.inline(rg.parse_list(F.col("value_cell"))))
    found = overlap_join(spots, rects, KEYS, points=True, levels=rects).groupBy(*POS).agg(F.min_by("p_key", "pair_idx").alias("p_key"))
    out = e.join(found, POS, "left")
    return out.withColumn("key", F.coalesce(F.nullif("key", F.lit("")), "p_key", F.lit(""))).drop("p_key", "row", "col")


def fill_log(pairs: DataFrame, kv: DataFrame, merges: DataFrame, mode: str = "ascii") -> DataFrame:
    """Pairs whose key has a value, with the anchor the value goes to. kv: wb_id, kv_idx, key, value; first key wins."""
    norm = tx.normalize_key(F.col("key"), mode)
    first = kv.withColumn("norm", norm).filter("norm <> ''").groupBy("wb_id", "norm").agg(
        F.min_by(F.struct(F.col("value").alias("v")), "kv_idx").alias("f")
    )
    p = pairs.withColumn("norm", norm).filter("norm <> ''").join(first, ["wb_id", "norm"])
    p = p.select(*KEYS, "pair_idx", "key", "value_cell", F.col("f.v").alias("value"), rg.rect_columns(rg.first_rect(F.col("value_cell"))))
    p = p.withColumn("row", F.col("r0")).withColumn("col", F.col("c0")).drop(*RECT)
    return attach_anchor(p, merges).select(*KEYS, "pair_idx", "key", "value_cell", "value", "a_row", "a_col")


def fill_by_key(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Cells after the fill: the last pair that writes to an anchor decides its value."""
    last = log.groupBy(*KEYS, F.col("a_row").alias("row"), F.col("a_col").alias("col")).agg(
        F.max_by(F.struct(F.col("value").alias("v")), "pair_idx").alias("w")
    )
    j = cells.join(last, POS, "full")
    hit = F.col("w").isNotNull()
    rest = [F.col(c) for c in cells.columns if c not in (*POS, "value", "value_type")]
    return j.select(
        *POS, F.when(hit, F.col("w.v")).otherwise(F.col("value")).alias("value"),
        F.when(hit, "s").otherwise(F.col("value_type")).alias("value_type"), *rest,
    )


def parse_kv_text(docs: DataFrame) -> DataFrame:
    """Key/value rows of a text: a JSON object, a JSON list of {key|name, value}, else ``k: v`` or ``k=v`` lines.

    docs: doc_id, text. Comment lines start with #; the last occurrence of a key wins.
    """
    d = docs.select("doc_id", tx.strip(F.col("text")).alias("t"))
    obj = F.from_json("t", "map<string,string>")
    lst = F.from_json("t", "array<map<string,string>>")
    looks_obj = F.col("t").startswith("{") & F.col("t").endswith("}")
    looks_lst = F.col("t").startswith("[") & F.col("t").endswith("]")
    as_obj = F.when(looks_obj, F.transform(F.map_entries(obj), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    as_lst = F.when(
        looks_lst,
        F.filter(
            F.transform(lst, lambda m: F.struct(tx.strip(F.coalesce(m["key"], m["name"])).alias("key"), m["value"].alias("value"))),
            lambda s: s["key"].isNotNull(),
        ),
    )
    lines = F.filter(F.transform(tx.split_lines(F.col("t")), lambda x: tx.strip(x)), lambda x: (x != "") & ~x.startswith("#"))
    as_lines = F.filter(
        F.transform(lines, lambda x: F.when(x.contains(":"), _line_pair(x, ":")).when(x.contains("="), _line_pair(x, "="))),
        lambda s: s.isNotNull() & (s["key"] != ""),
    )
    rows = d.select("doc_id", F.posexplode(F.coalesce(as_obj, as_lst, as_lines)).alias("kv_idx", "e"))
    return rows.groupBy("doc_id", F.col("e.key").alias("key")).agg(
        F.max_by(F.struct(F.col("e.value").alias("v")), "kv_idx").alias("x"), F.min("kv_idx").alias("kv_idx")
    ).select("doc_id", "kv_idx", "key", F.col("x.v").alias("value"))


def _line_pair(line: Column, sep: str) -> Column:
    at = F.instr(line, sep)
    return F.struct(
        tx.strip(line.substr(F.lit(1), at - 1)).alias("key"), tx.strip(line.substr(at + 1, F.length(line))).alias("value")
    )


def blank_targets(policies: DataFrame) -> DataFrame:
    """Fields a plan wants blank: blank policies, and uncertain fields with a blank-like action.

    policies: wb_id, kind (blank_policy | uncertain_field), pol_idx, target, action, reason.
    """
    act = F.lower(tx.strip(F.coalesce("action", F.lit(""))))
    keep = (F.col("kind") == "blank_policy") | ((F.col("kind") == "uncertain_field") & act.isin(*BLANK_ACTIONS))
    p = policies.withColumn("target", tx.strip(F.coalesce("target", F.lit("")))).filter(keep & (F.col("target") != ""))
    reason = tx.strip(F.coalesce("reason", F.lit("")))
    uncertain = F.col("kind") == "uncertain_field"
    return p.select(
        "wb_id", F.when(uncertain, "uncertain_blank").otherwise("blank_policy").alias("kind"),
        (F.col("pol_idx") + F.when(uncertain, 1 << 20).otherwise(0)).alias("pol_idx"), "target",
        F.when(uncertain & (reason == ""), act).otherwise(reason).alias("reason"),
    )


def blank_policy_for_key(keys_df: DataFrame, policies: DataFrame, full: bool = True) -> DataFrame:
    """Best blank-like target per key text at 0.74 or more. keys_df: wb_id, key. First policy wins ties."""
    t = blank_targets(policies).withColumn("norm", tx.normalize_key(F.col("target")))
    k = keys_df.select("wb_id", "key").distinct().withColumn("norm", tx.normalize_key(F.col("key")))
    pairs = similar_pairs(k.select("wb_id", "norm"), t.select("wb_id", "norm"), ["wb_id"], POLICY_THRESHOLD, full)
    first = t.groupBy("wb_id", F.col("norm").alias("b")).agg(F.min(F.struct("pol_idx", "kind", "target", "reason")).alias("p"))
    best = pairs.join(first, ["wb_id", "b"]).groupBy("wb_id", F.col("a").alias("norm")).agg(
        F.max_by(F.struct("p", "score"), F.struct("score", -F.col("p.pol_idx"))).alias("m")
    )
    return k.join(best, ["wb_id", "norm"]).select(
        "wb_id", "key", F.col("m.p.kind").alias("policy_kind"), F.col("m.p.target").alias("policy_target"),
        F.col("m.p.reason").alias("policy_reason"), F.round("m.score", 4).alias("match_score"),
    )


def policy_guard_cells(policies: DataFrame, labels: DataFrame, candidates: DataFrame, full: bool = True, n: int | None = None) -> DataFrame:
    """Candidate cells (the best ``n`` if given) of the label each blank target means, with the first reason that protects them."""
    t = blank_targets(policies).join(labels.select(*KEYS).distinct(), "wb_id")
    best = best_label(t.select(*KEYS, "kind", "pol_idx", "target", "reason"), labels, POLICY_THRESHOLD, full)
    ranked = rank_candidates(best.select(*KEYS, F.col("l_row").alias("row"), F.col("l_col").alias("col")), candidates, labels, n)
    hit = best.join(ranked.select(*KEYS, "l_row", "l_col", "row", "col", "rank"), [*KEYS, "l_row", "l_col"])
    base = F.concat(F.lit("planner "), F.col("kind"), F.lit(" target '"), F.col("target"), F.lit("' should remain blank"))
    why = F.when(F.col("reason") != "", F.concat(base, F.lit(" ("), F.col("reason"), F.lit(")"))).otherwise(base)
    return hit.groupBy(*POS).agg(F.min_by(why, F.struct("pol_idx", "rank")).alias("protect_reason"))


def background_context(
    targets: DataFrame, cells: DataFrame, merges: DataFrame, candidates: DataFrame, labels_any: DataFrame, box: DataFrame,
    focus: DataFrame | None = None, n_items: int | None = None, n_cells: int | None = None, width: int | None = None, full: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Context boxes around planned targets and the non-empty cells inside them.

    targets: keys, target_idx, target, reason, radius. A range target is padded by radius; a text target takes its best
    label (0.60), that label's two best candidates and the box around them. focus: keys and rectangle. Limits for a prompt:
    n_items targets a sheet, n_cells cells a box, width characters a cell; none by default.
    """
    tg = top_rows(targets.filter(tx.strip(F.col("target")) != ""), KEYS, ["target_idx"], n_items)
    tg = tg.withColumn("radius", F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce("radius", F.lit(2)))))
    b = box.select(*KEYS, *[F.col(c).alias("x_" + c) for c in RECT])
    clip = tuple(F.col("x_" + c) for c in RECT)
    is_range = F.col("target").rlike("^[A-Za-z]+[0-9]+(:[A-Za-z]+[0-9]+)?$")
    pad = lambda rect, side, up: _padded(rect, clip, side, up)
    a1 = tg.filter(is_range).select("*", rg.rect_columns(rg.parse_a1(F.col("target")))).join(b, KEYS)
    side = F.greatest(F.lit(2), F.col("radius") * 2)
    a1 = a1.select(*tg.columns, F.lit("a1_range").alias("match_kind"), F.lit(None).cast("string").alias("matched_label"), F.lit(0.0).alias("match_score"),
                   pad(tuple(F.col(c) for c in RECT), side, F.col("radius")).alias("w"))
    txt = best_label(tg.filter(~is_range), labels_any, CONTEXT_THRESHOLD, full)
    near = rank_candidates(txt.select(*KEYS, F.col("l_row").alias("row"), F.col("l_col").alias("col")), candidates, labels_any, 2)
    far = near.groupBy(*KEYS, "l_row", "l_col").agg(F.max("col").alias("far"))
    txt = txt.join(far, [*KEYS, "l_row", "l_col"], "left").join(b, KEYS)
    right = F.greatest(F.col("l_col") + F.greatest(F.lit(4), F.col("radius") * 2), F.coalesce("far", F.lit(0)))
    win = F.struct(
        F.greatest("x_r0", F.col("l_row") - F.col("radius")).alias("r0"), F.greatest("x_c0", F.col("l_col") - 2).alias("c0"),
        F.least("x_r1", F.col("l_row") + F.col("radius")).alias("r1"), F.least(F.col("x_c1"), right).alias("c1"),
    )
    txt = txt.select(*tg.columns, F.lit("target_text").alias("match_kind"), F.col("l_text").alias("matched_label"), F.round("score", 4).alias("match_score"), win.alias("w"))
    items = a1.unionByName(txt).select(*tg.columns, "match_kind", "matched_label", "match_score", "w.*")
    if focus is not None:
        f = focus.select(*KEYS, *[F.col(c).alias("f_" + c) for c in RECT]).join(b, KEYS)
        guard = _padded(tuple(F.col("f_" + c) for c in RECT), clip, F.lit(2), F.lit(1))
        f = f.select(*KEYS, guard.alias("g"))
        items = items.join(f, KEYS, "left").filter(
            F.col("g").isNull() | rg.intersects(tuple(F.col(c) for c in RECT), F.col("g"))
        ).drop("g")
    items = cut_lineage(items)
    inside = overlap_join(as_rects(nonempty_cells(cells)), items.select(*KEYS, "target_idx", *RECT), KEYS, points=True)
    text = F.col("text") if width is None else F.substring("text", 1, width)
    inside = inside.select(*KEYS, "target_idx", "row", "col", text.alias("text"))
    return items, top_rows(inside, [*KEYS, "target_idx"], ["row", "col"], n_cells)


def _padded(rect, clip, side: Column, up: Column) -> Column:
    r0, c0, r1, c1 = rect
    k0, k1, k2, k3 = clip
    n = (F.greatest(k0, r0 - up), F.greatest(k1, c0 - side), F.least(k2, r1 + up), F.least(k3, c1 + side))
    empty = (n[0] > n[2]) | (n[1] > n[3])
    return F.struct(*[F.when(empty, k).otherwise(x).alias(c) for x, k, c in zip(n, clip, RECT)])
