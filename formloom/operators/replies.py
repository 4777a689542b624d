"""Reply tables: assessments, slots, pairs and plans in typed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.functions import replies as rp
from formloom.functions import text as tx
from formloom.operators.grid import KEYS
from formloom.operators.spatial import RECT, semi_overlap


def _flag(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def parse_assessments(replies: DataFrame) -> DataFrame:
    """One row per assessed cell of a reply; the last mention of a cell wins. replies: call_id, raw."""
    d = replies.select("call_id", F.posexplode(rp.items(rp.extract_json_object(F.col("raw")), "$.assessments")).alias("i", "v"))
    d = d.select("call_id", "i", F.upper(rp.text_field(F.col("v"), "$.target_cell")).alias("label_cell"), F.struct(
        *[_flag(F.col("v"), "$." + n).alias(n) for n in ("is_correct_region", "is_safe_blank", "template_inconsistency", "high_risk_pattern", "special_char_anomaly")],
        rp.text_field(F.col("v"), "$.reason").alias("reason"),
    ).alias("x"))
    return d.filter("label_cell <> ''").groupBy("call_id", "label_cell").agg(F.max_by("x", "i").alias("x")).select("call_id", "label_cell", "x.*")


def reply_ranges(replies: DataFrame) -> DataFrame:
    """Bad and correct ranges and missing keys of a reply."""
    v = rp.extract_json_object(F.col("raw"))
    d = replies.select("call_id", F.inline(F.array(F.struct(v.alias("v")))))
    missing = F.filter(F.transform(rp.items(F.col("v"), "$.missing_keys"), lambda x: tx.strip(F.when(F.schema_of_variant(x) == "STRING", x.cast("string")))), lambda s: s.isNotNull() & (s != ""))
    return d.select("call_id", rp.range_list(F.col("v"), "bad_ranges").alias("bad_ranges"), rp.range_list(F.col("v"), "correct_ranges").alias("correct_ranges"), missing.alias("missing_keys"))


def complete_slots(slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every slot once, with its reply or a stand-in. slots: keys, slot_id, value_range. pairs: keys, pair_ord, slot_id (text),
    is_valid_slot, key_text, confidence (text), reason; the last reply per slot counts."""
    p = pairs.withColumn("slot_id", F.col("slot_id").try_cast("int")).filter("slot_id is not null")
    last = p.groupBy(*KEYS, "slot_id").agg(F.max_by(F.struct("is_valid_slot", "key_text", "confidence", "reason"), "pair_ord").alias("x"))
    j = slots.join(last, [*KEYS, "slot_id"], "left")
    got = F.col("x").isNotNull()
    text = lambda c: tx.strip(F.coalesce(F.col("x." + c), F.lit("")))
    return j.select(
        *KEYS, "slot_id", F.col("value_range").alias("value_cell"), (got & F.coalesce("x.is_valid_slot", F.lit(False))).alias("is_valid_slot"),
        text("key_text").alias("key_text"), F.coalesce(F.col("x.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.when(got, text("reason")).otherwise("missing slot_id in model output").alias("reason"),
    )


def normalize_pairs(replies: DataFrame) -> DataFrame:
    """Pairs of a reply in one shape. The key is ``key.text``, ``key_text`` or ``key``; without it a pair is invalid.
    A missing confidence and an explicit 0 both become 1."""
    d = replies.select("call_id", F.posexplode(rp.items(rp.parse_pairs_reply(F.col("raw")), "$.pairs")).alias("pair_ord", "v"))
    v = F.col("v")
    nested = F.try_variant_get(v, "$.key.text", "string")
    plain = F.try_variant_get(v, "$.key", "variant")
    key = tx.strip(F.coalesce(nested, F.try_variant_get(v, "$.key_text", "string"), F.when(F.schema_of_variant(plain) == "STRING", plain.cast("string")), F.lit("")))
    conf = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))
    d = d.select("call_id", "pair_ord", F.try_variant_get(v, "$.slot_id", "int").alias("slot_id"), key.alias("key_text"),
                 F.coalesce(F.try_variant_get(v, "$.is_valid_slot", "boolean"), F.lit(False)).alias("_ok"), F.when(conf == 0, 1.0).otherwise(conf).alias("confidence"),
                 F.try_variant_get(v, "$.number", "int").alias("number"), rp.text_field(v, "$.reason").alias("reason"))
    return d.withColumn("is_valid_slot", F.col("_ok") & (F.col("key_text") != "")).drop("_ok")


def filter_by_focus(rows: DataFrame, id_col: str, range_cols: list[str], focus: DataFrame) -> DataFrame:
    """Rows any of whose ranges meets their sheet's focus range."""
    rects = F.flatten(F.array(*[F.coalesce(rg.parse_list(F.col(c)), F.array().cast(f"array<{rg.RECT}>")) for c in range_cols]))
    cells = rows.select(*KEYS, id_col, F.inline(rects))
    hit = semi_overlap(cells, focus.select(*KEYS, *RECT), KEYS).select(*KEYS, id_col).distinct()
    return rows.join(hit, [*KEYS, id_col], "left_semi")


# Spellings of yes and no, and stages a background read may name.
YES, NO, STAGES = ("1", "true", "yes", "y"), ("0", "false", "no", "n"), ("any", "first_pass", "reflect", "refill")


def as_flag(v: Column, path: str, default: bool) -> Column:
    s = F.lower(tx.strip(F.try_variant_get(v, path, "string")))
    return F.when(s.isin(*YES), True).when(s.isin(*NO), False).when(s.try_cast("double").isNotNull(), s.try_cast("double") != 0).otherwise(default)


def normalize_policy(plans: DataFrame) -> DataFrame:
    """Typed plan with defaults and clamps. plans: plan_id, raw (JSON object)."""
    d = plans.select("plan_id", F.inline(F.array(F.struct(rp.extract_json_object(F.col("raw")).alias("v")))))
    v = F.col("v")
    whole = lambda x, p, dflt: F.coalesce(F.try_variant_get(x, p, "string").try_cast("int"), dflt)
    unit = lambda x, p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get(x, p, "string").try_cast("double"), F.lit(0.0))))
    strings = lambda x, p: F.filter(F.transform(rp.items(x, p), lambda y: tx.strip(F.coalesce(F.try_variant_get(y, "$", "string"), F.lit("")))), lambda s: s != "")
    groups = F.transform(rp.items(v, "$.field_groups"), lambda x, i: F.struct(
        F.greatest(F.lit(1), whole(x, "$.fill_priority", i + 1)).alias("fill_priority"), i.alias("i"),
        F.coalesce(F.nullif(rp.text_field(x, "$.group_name"), F.lit("")), F.lit("group")).alias("group_name"), strings(x, "$.fields").alias("fields"),
        (rp.text_field(x, "$.group_name") != "").alias("named"),
    ))
    groups = F.array_sort(F.filter(groups, lambda x: x["named"] | (F.size(x["fields"]) > 0)))
    has = lambda arr: F.filter(arr, lambda x: x["target"] != "")
    high = has(F.transform(rp.items(v, "$.high_confidence_fields"), lambda x: F.struct(rp.text_field(x, "$.target").alias("target"), unit(x, "$.confidence").alias("confidence"))))
    unsure = has(F.transform(rp.items(v, "$.uncertain_fields"), lambda x: F.struct(
        rp.text_field(x, "$.target").alias("target"), rp.text_field(x, "$.reason").alias("reason"), unit(x, "$.confidence").alias("confidence"),
        F.coalesce(F.nullif(rp.text_field(x, "$.action"), F.lit("")), F.lit("leave_blank")).alias("action"))))
    stage = lambda x: F.lower(rp.text_field(x, "$.stage"))
    reads = has(F.transform(rp.items(v, "$.background_reads"), lambda x: F.struct(
        F.when(stage(x).isin(*STAGES), stage(x)).otherwise("any").alias("stage"), rp.text_field(x, "$.target").alias("target"), rp.text_field(x, "$.reason").alias("reason"),
        F.greatest(F.lit(1), F.least(F.lit(4), whole(x, "$.max_radius", F.lit(2)))).alias("max_radius"))))
    flow = {"read_background_before_first_pass": False, "read_background_before_refill": False, "prefer_hints_when_available": True,
            "run_reflect_after_first_pass": True, "stop_when_no_high_risk_regions": True, "stop_when_two_rounds_no_actual_edits": True}
    rules = ("leave_unspecified_blank", "preserve_existing_content", "avoid_guessing")
    return d.select(
        "plan_id", F.coalesce(F.nullif(rp.text_field(v, "$.form_type"), F.lit("")), F.lit("generic_form")).alias("form_type"),
        F.struct(*[as_flag(v, f"$.global_policies.{n}", True).alias(n) for n in rules]).alias("global_policies"),
        F.struct(*[as_flag(v, f"$.workflow_policy.{n}", dflt).alias(n) for n, dflt in flow.items()]).alias("workflow"),
        groups.alias("field_groups"), F.array().cast("array<string>").alias("blank_policies"), strings(v, "$.do_not_fill_sections").alias("do_not_fill_sections"),
        F.struct(as_flag(v, "$.repeated_block_policy.has_repeated_blocks", False).alias("has_repeated_blocks"), rp.text_field(v, "$.repeated_block_policy.block_key").alias("block_key"),
                 whole(v, "$.repeated_block_policy.expected_count", F.lit(None).cast("int")).alias("expected_count")).alias("repeated"),
        high.alias("high_confidence_fields"), unsure.alias("uncertain_fields"), reads.alias("background_reads"), strings(v, "$.notes").alias("notes"),
    )


def policy_for_stage(policy: DataFrame, stage: str) -> DataFrame:
    """Parts of a typed plan that apply to a stage."""
    reads = F.filter("background_reads", lambda x: x["stage"].isin("any", stage))
    keep = ["plan_id", "form_type", "workflow", "repeated", "notes"] + ([] if stage == "reflect" else ["field_groups", "high_confidence_fields"])
    return policy.select(*keep, reads.alias("background_reads"))


def policy_lines(policy: DataFrame, stage: str, n_groups: int | None = None, n_reads: int | None = None) -> DataFrame:
    """Readable lines of the parts that apply to a stage, in order; limits are for prompts and off unless given."""
    first = lambda c, n: F.col(c) if n is None else F.slice(c, 1, n)
    p = policy_for_stage(policy, stage)
    w, rep = F.col("workflow"), F.col("repeated")
    count = F.coalesce(rep["expected_count"], F.lit(0))
    lines = []
    if stage == "first_pass":
        lines.append(F.when(w["read_background_before_first_pass"], "Before first-pass writing, inspect planner-selected local background context."))
    if stage == "refill":
        lines.append(F.when(w["read_background_before_refill"], "Before refill, inspect planner-selected local background context for this region."))
    lines.append(F.when(~w["prefer_hints_when_available"], "Do not automatically rely on detector or reflect hints."))
    if stage == "first_pass":
        lines.append(F.when(~w["run_reflect_after_first_pass"], "Planner requests skipping reflect after first pass if the result looks acceptable."))
    key = rep["block_key"]
    lines.append(F.when(rep["has_repeated_blocks"], F.when((key != "") & (count != 0), F.concat(F.lit("Repeated block policy: '"), key, F.lit("' appears about "), count.cast("string"), F.lit(" times.")))
                        .when(key != "", F.concat(F.lit("Repeated block policy: repeated block key is '"), key, F.lit("'."))).otherwise("Repeated block policy: the form contains repeated blocks.")))
    if stage != "reflect":
        order = F.transform(first("field_groups", n_groups), lambda x: F.concat(x["fill_priority"].cast("string"), F.lit(":"), x["group_name"]))
        lines.append(F.when(F.size(order) > 0, F.concat(F.lit("Suggested fill order by group: "), F.array_join(order, " -> "), F.lit("."))))
    reads = F.transform(first("background_reads", n_reads), lambda x: F.concat(F.lit("Read local background around '"), x["target"], F.lit("' before writing."), F.when(x["reason"] != "", F.concat(F.lit(" Reason: "), x["reason"], F.lit("."))).otherwise("")))
    return p.select("plan_id", F.concat(F.array_compact(F.array(*lines)), reads).alias("lines"))


def choose_pair_per_slot(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One reply per slot: the first valid one with a key, else the first. pairs: by, slot_id, pair_ord, is_valid_slot, key_text."""
    rest = [c for c in pairs.columns if c not in (*by, "slot_id")]
    order = F.struct((~(F.col("is_valid_slot") & (F.col("key_text") != ""))).cast("int"), F.col("pair_ord"))
    return pairs.groupBy(*by, "slot_id").agg(F.min_by(F.struct(*rest), order).alias("x")).select(*by, "slot_id", "x.*")
