"""Model replies as text: finding, repairing and reading the JSON inside, as Column expressions over Variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions import ranges as rg
from formloom.functions import text as tx
from formloom.functions.ranges import let

VARIANTS = "array<variant>"


def _object(text: Column) -> Column:
    return let(F.try_parse_json(text), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _fenced(raw: Column) -> Column:
    inner = tx.strip(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1))
    return F.when(raw.rlike(r"(?is)```.*```"), inner).otherwise(tx.strip(raw))


def extract_json_object(raw: Column) -> Column:
    """Variant of the JSON object in a reply: fenced block or whole text, else from the first brace to the last. Null if none."""
    t = _fenced(F.coalesce(raw, F.lit("")))
    return let(t, lambda x: F.coalesce(_object(x), _object(F.regexp_extract(x, r"(?s)\{.*\}", 0))))


def repair_json_text(raw: Column) -> Column:
    """Text between the outer braces with straight quotes and without trailing commas."""
    t = _fenced(F.coalesce(raw, F.lit("")))
    body = let(t, lambda x: F.when(x.rlike(r"(?s)\{.*\}"), F.regexp_extract(x, r"(?s)\{.*\}", 0)).otherwise(x))
    straight = F.translate(body, "“”‘’", "\"\"''")
    return F.regexp_replace(straight, r",\s*([}\]])", "$1")


def parse_pairs_reply(raw: Column) -> Column:
    """Reply object, taken from the repaired text where the plain one does not parse; null when neither does."""
    return F.coalesce(extract_json_object(raw), _object(repair_json_text(raw)))


def text_field(v: Column, path: str) -> Column:
    return tx.strip(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, VARIANTS), F.array().cast(VARIANTS))


def range_list(v: Column, name: str) -> Column:
    """Normalised ranges of a list field, invalid ones skipped, order kept."""
    texts = F.filter(items(v, f"$.{name}"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.array_distinct(F.array_compact(F.transform(texts, lambda x: rg.normalize_a1(x.cast("string")))))


def bad_ranges_from_reply(raw: Column) -> Column:
    """Struct (bad_raw, bad_ranges, parse_failed): the list and the single field, then ranges mentioned inside each."""

    def read(v: Column) -> Column:
        named = F.concat(items(v, "$.bad_ranges"), F.array_compact(F.array(F.try_variant_get(v, "$.bad_range", "variant"))))
        texts = F.filter(named, lambda x: F.schema_of_variant(x) == "STRING")
        bad = F.array_distinct(F.filter(F.transform(texts, lambda x: tx.strip(x.cast("string"))), lambda s: s != ""))
        return F.when(v.isNotNull(), bad).otherwise(F.array().cast("array<string>"))

    def build(b: Column) -> Column:
        found = F.array_distinct(F.flatten(F.transform(b, lambda s: rg.extract_ranges(s))))
        return F.struct(b.alias("bad_raw"), found.alias("bad_ranges"), ((F.size(b) > 0) & (F.size(found) == 0)).alias("parse_failed"))

    return let(let(extract_json_object(raw), read), build)


def redact_data_urls(payload: Column) -> Column:
    """Inline images of a logged payload replaced by a marker with their length."""
    parts = F.split(payload, r"(?=data:image/)")

    def one(p: Column) -> Column:
        url = F.regexp_extract(p, r"^data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=]*", 0)
        return let(url, lambda u: F.when(u != "", F.concat(F.lit("<data_url:"), F.length(u).cast("string"), F.lit(" chars>"), p.substr(F.length(u) + 1, F.length(p)))).otherwise(p))

    return F.array_join(F.transform(parts, lambda p: one(p)), "")


def response_content(raw: Column) -> Column:
    """Content text of a gateway reply in any of its shapes; plain text stands for itself."""

    def of(v: Column) -> Column:
        content = F.try_variant_get(v, "$.choices[0].message.content", "variant")
        parts = F.filter(F.transform(F.coalesce(F.try_variant_get(content, "$", VARIANTS), F.array().cast(VARIANTS)), lambda p: F.try_variant_get(p, "$.text", "string")), lambda s: s.isNotNull() & (tx.strip(s) != ""))
        kind = F.schema_of_variant(content)
        message = F.when(kind == "STRING", content.cast("string")).when(kind.startswith("ARRAY"), F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.to_json(content))).when(content.isNotNull(), F.to_json(content))
        top = [F.try_variant_get(v, p, "string") for p in ("$.choices[0].text", "$.content", "$.text", "$.output")]
        return F.coalesce(message, *top)

    return let(F.try_parse_json(tx.strip(raw)), lambda v: F.when(v.isNull(), tx.strip(raw)).otherwise(of(v)))
