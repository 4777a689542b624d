"""Replies, slots and plans derived from conversations, events and form lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import replies as rp
from formloom.operators import grid as g
from formloom.operators import replies as r
from formloom.plans.queries_grid import Q_PAIR_RECTS
from formloom.plans.registry import query

E = "event_id"
N = "CAST(event_id AS STRING)"
RAW = f"""SELECT event_id, user_id, event_type, CASE event_id % 5 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{{{{"k": ' || {N} || ', "bad_ranges": [" b' || CAST(1 + event_id % 9 AS STRING) || ' ", 7, "??"], "bad_range": "C1 and c2:d3"}}}}' || chr(10) || '``` done'
 WHEN 1 THEN 'text {{{{"k": ' || {N} || ', "bad_range": "none"}}}} tail' WHEN 2 THEN '{{{{"k": ' || {N} || '}}}}' WHEN 3 THEN '{{{{"k": ' || {N} || ', "x": [1, 2,], }}}}' ELSE '[1, 2]' END AS raw FROM {{events}}"""


def raws(t):
    return t.sql(RAW.replace("{{{{", "{{").replace("}}}}", "}}").replace("{{events}}", "{events}"))


@query("h1_extract_json_object", "SELECT event_id, event_id AS k FROM events WHERE event_id % 5 IN (0, 1, 2)")
def _(t):
    return raws(t).select(E, F.try_variant_get(rp.extract_json_object(F.col("raw")), "$.k", "bigint").alias("k")).filter("k is not null")


@query("h10_repair_json_text", "SELECT event_id, event_id AS k FROM events WHERE event_id % 5 < 4")
def _(t):
    return raws(t).select(E, F.try_variant_get(rp.parse_pairs_reply(F.col("raw")), "$.k", "bigint").alias("k")).filter("k is not null")


@query(
    "h8_bad_ranges_from_reply",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'b' || (1 + event_id % 9) || ';??;C1 and c2:d3' WHEN 1 THEN 'none' ELSE '' END AS bad_raw, CASE WHEN event_id % 5 = 0 THEN 'B' || (1 + event_id % 9) || ':B' || (1 + event_id % 9) || ';C1:C1;C2:D3' ELSE '' END AS bad_ranges, event_id % 5 = 1 AS parse_failed FROM events",
)
def _(t):
    d = raws(t).select(E, F.inline(F.array(rp.bad_ranges_from_reply(F.col("raw")))))
    return d.select(E, F.array_join("bad_raw", ";").alias("bad_raw"), F.array_join("bad_ranges", ";").alias("bad_ranges"), "parse_failed")


def assess_replies(t):
    u = F.col("user_id").cast("string")
    raw = F.concat(
        F.lit('{"assessments": [{"target_cell": "a1", "is_correct_region": true}, {"target_cell": "A1", "is_safe_blank": true, "reason": " r'), u,
        F.lit(' "}, 5, {"target_cell": ""}, {"target_cell": "b'), u, F.lit('", "high_risk_pattern": true}], "missing_keys": [" m ", "", 3], "bad_ranges": ["c3:b'), u, F.lit('", "zz"], "correct_ranges": ["d4"]}'),
    )
    return t.events.select(F.col(E).alias("call_id"), raw.alias("raw"))


@query(
    "h2_parse_assessments",
    "SELECT event_id AS call_id, 'A1' AS label_cell, FALSE AS is_correct_region, TRUE AS is_safe_blank, FALSE AS high_risk_pattern, 'r' || user_id AS reason FROM events UNION ALL SELECT event_id, 'B' || user_id, FALSE, FALSE, TRUE, '' FROM events",
)
def _(t):
    return r.parse_assessments(assess_replies(t)).drop("template_inconsistency", "special_char_anomaly")


@query(
    "h2_reply_ranges",
    "SELECT event_id AS call_id, CASE WHEN user_id = 0 THEN '' ELSE 'B' || least(3, user_id) || ':C' || greatest(3, user_id) END AS bad, 'D4:D4' AS ok, 'm' AS missing FROM events",
)
def _(t):
    d = r.reply_ranges(assess_replies(t))
    j = lambda c, n: F.array_join(c, ",").alias(n)
    return d.select("call_id", j("bad_ranges", "bad"), j("correct_ranges", "ok"), j("missing_keys", "missing"))


@query(
    "h3_complete_slots",
    """WITH s AS (SELECT DISTINCT wb_id, sheet, slot_id FROM (SELECT wb_id, sheet, CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS slot_id FROM <<slot_pairs>>)), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, slot_id ORDER BY pair_idx DESC) AS rn FROM <<slot_pairs>> WHERE pair_idx % 5 <> 0) WHERE rn = 1)
      SELECT s.wb_id, s.sheet, s.slot_id, coalesce(p.is_valid_slot, FALSE) AS is_valid_slot, coalesce(trim(p.key_text), '') AS key_text, CASE WHEN p.pair_idx % 2 = 0 THEN 0.5 ELSE 0.0 END AS confidence, CASE WHEN p.wb_id IS NULL THEN 'missing slot_id in model output' ELSE p.reason END AS reason FROM s LEFT JOIN p ON p.wb_id = s.wb_id AND p.slot_id = s.slot_id""",
)
def _(t):
    slots = t.slot_pairs.select(*g.KEYS).distinct().select(*g.KEYS, F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("slot_id"))
    slots = slots.withColumn("value_range", F.concat(F.lit("B"), (F.col("slot_id") + 1).cast("string")))
    p = t.slot_pairs.select(*g.KEYS, F.col("pair_idx").alias("pair_ord"), F.when(F.col("pair_idx") % 5 == 0, "x").otherwise(F.col("slot_id").cast("string")).alias("slot_id"),
                            "is_valid_slot", "key_text", F.when(F.col("pair_idx") % 2 == 0, "0.5").otherwise("n/a").alias("confidence"), "reason")
    return r.complete_slots(slots, p).drop("value_cell")


@query(
    "h4_normalize_pairs",
    "SELECT event_id AS call_id, unnest([0, 1, 2, 3]) AS pair_ord, unnest([event_type, 'two', 'three', '']) AS key_text, unnest([TRUE, TRUE, FALSE, FALSE]) AS is_valid_slot, unnest([CAST(1.0 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE)]) AS confidence, unnest([CAST(user_id AS INT), -1, -1, -1]) AS number FROM events",
)
def _(t):
    raw = F.concat(F.lit('{"pairs": [{"slot_id": 1, "key": {"text": " '), F.col("event_type"), F.lit(' "}, "is_valid_slot": true, "confidence": 0, "number": '), F.col("user_id").cast("string"),
                   F.lit('}, {"slot_id": 2, "key_text": "two", "is_valid_slot": true, "confidence": 0.25}, {"slot_id": 3, "key": "three"}, {"slot_id": 4, "is_valid_slot": true},]}'))
    d = r.normalize_pairs(t.events.select(F.col(E).alias("call_id"), raw.alias("raw")))
    return d.select("call_id", "pair_ord", "key_text", "is_valid_slot", "confidence", F.coalesce("number", F.lit(-1)).alias("number"))


@query("h5_filter_by_focus", f"SELECT p.wb_id, p.sheet, p.pair_idx, p.value_cell FROM {Q_PAIR_RECTS} p WHERE EXISTS (SELECT 1 FROM <<bad_ranges>> b WHERE b.wb_id = p.wb_id AND b.r0 <= p.r1 AND p.r0 <= b.r1 AND b.c0 <= p.c1 AND p.c0 <= b.c1)")
def _(t):
    return r.filter_by_focus(t.pairs, "pair_idx", ["value_cell"], t.bad_ranges).select(*g.KEYS, "pair_idx", "value_cell")


def plans(t):
    u = F.col("user_id").cast("string")
    raw = F.concat(
        F.lit('{"form_type": " ", "workflow_policy": {"prefer_hints_when_available": "'), F.when(F.col("user_id") % 2 == 0, "No").otherwise("maybe"),
        F.lit('", "read_background_before_first_pass": 1}, "field_groups": [{"group_name": "late", "fill_priority": "9"}, {"fields": ["a", ""]}, {"x": 1}], "blank_policies": [{"target": "t"}],'
              ' "repeated_block_policy": {"has_repeated_blocks": true, "block_key": "'), F.when(F.col("user_id") % 3 == 0, "").otherwise("blk"), F.lit('", "expected_count": "'), u,
        F.lit('"}, "uncertain_fields": [{"target": "U", "confidence": 7}, {"target": ""}], "background_reads": [{"target": "R", "stage": "ALL", "max_radius": '), u,
        F.lit('}, {"target": "Q", "stage": "refill", "reason": "why"}]}'),
    )
    return t.events.select(F.col(E).alias("plan_id"), raw.alias("raw"))


@query(
    "h6_normalize_policy",
    "SELECT event_id AS plan_id, 'generic_form' AS form_type, user_id % 2 <> 0 AS prefer_hints, '2:group,9:late' AS groups, 'U:leave_blank:1' AS uncertain, 'any:R:' || greatest(1, least(4, user_id)) || ',refill:Q:2' AS reads, CAST(user_id AS INT) AS expected FROM events",
)
def _(t):
    p = r.normalize_policy(plans(t))
    s = lambda c: c.cast("string")
    return p.select(
        "plan_id", "form_type", F.col("workflow.prefer_hints_when_available").alias("prefer_hints"),
        F.array_join(F.transform("field_groups", lambda x: F.concat_ws(":", s(x["fill_priority"]), x["group_name"])), ",").alias("groups"),
        F.array_join(F.transform("uncertain_fields", lambda x: F.concat_ws(":", x["target"], x["action"], s(x["confidence"].cast("int")))), ",").alias("uncertain"),
        F.array_join(F.transform("background_reads", lambda x: F.concat_ws(":", x["stage"], x["target"], s(x["max_radius"]))), ",").alias("reads"),
        F.col("repeated.expected_count").alias("expected"),
    )


@query(
    "h7_policy_lines",
    """SELECT event_id AS plan_id, 'Before first-pass writing, inspect planner-selected local background context.|' || CASE WHEN user_id % 2 = 0 THEN 'Do not automatically rely on detector or reflect hints.|' ELSE '' END
      || CASE WHEN user_id % 3 = 0 THEN 'Repeated block policy: the form contains repeated blocks.' ELSE 'Repeated block policy: ''blk'' appears about ' || user_id || ' times.' END || '|Suggested fill order by group: 2:group -> 9:late.|Read local background around ''R'' before writing.' AS lines FROM events""",
)
def _(t):
    return r.policy_lines(r.normalize_policy(plans(t)), "first_pass").select("plan_id", F.array_join("lines", "|").alias("lines"))


@query("h9_response_content", "SELECT conv_id * 1000 + turn AS id, CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN 'a' || chr(10) || role WHEN 2 THEN 't ' || role WHEN 3 THEN 'o ' || role ELSE 'plain ' || role END AS content FROM conversations")
def _(t):
    k, role = F.col("turn") % 5, F.col("role")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"choices": [{"message": {"content": "'), role, F.lit('"}}]}')))
        .when(k == 1, F.concat(F.lit('{"choices": [{"message": {"content": [{"text": "a"}, {"type": "x"}, {"text": "'), role, F.lit('"}]}}]}')))
        .when(k == 2, F.concat(F.lit('{"choices": [{"text": "t '), role, F.lit('"}]}'))).when(k == 3, F.concat(F.lit('{"output": "o '), role, F.lit('"}'))).otherwise(F.concat(F.lit(" plain "), role))
    )
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), rp.response_content(raw).alias("content"))


@query("h11_redact_data_urls", "SELECT event_id, '{\"a\": \"<data_url:' || (22 + length(event_type)) || ' chars>\", \"b\": \"<data_url:26 chars>\", \"c\": 1}' AS payload FROM events")
def _(t):
    raw = F.concat(F.lit('{"a": "data:image/png;base64,'), F.col("event_type"), F.lit('", "b": "data:image/jpeg;base64,QQ=", "c": 1}'))
    return t.events.select(E, rp.redact_data_urls(raw).alias("payload"))


@query(
    "h12_choose_pair_per_slot",
    "SELECT wb_id, slot_id, pair_idx AS pair_ord, is_valid_slot, key_text FROM (SELECT *, row_number() OVER (PARTITION BY wb_id, slot_id ORDER BY NOT (is_valid_slot AND key_text <> ''), pair_idx) AS rn FROM <<slot_pairs>>) WHERE rn = 1",
)
def _(t):
    p = t.slot_pairs.select("wb_id", "slot_id", F.col("pair_idx").alias("pair_ord"), "is_valid_slot", "key_text")
    return r.choose_pair_per_slot(p, ["wb_id"])
