"""JSON documents as trees, level by level with built-ins.

A node is its JSON text with its kind. Reading a text as a map or list of strings keeps the order of keys and the text of what is
nested; reading it as variants tells the kinds. Levels are nested expressions, so their number is a parameter of each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions import text as tx
from formloom.functions.ranges import let

# Keys whose content is left out of flattened text.
SKIPPED_KEYS = ("evidence", "analysis")
NODES = "array<struct<key:string,raw:string,kind:string>>"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _root(raw: Column) -> Column:
    v = F.try_parse_json(raw)
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.trim(raw))
    return F.struct(F.lit(None).cast("string").alias("key"), text.alias("raw"), F.when(v.isNotNull(), _kind(v)).alias("kind"))


def _is(node: Column, kind: str) -> Column:
    return node["kind"].startswith(kind)


def _kids(node: Column) -> Column:
    """Children of an object or list in document order."""
    raw = node["raw"]
    fields = F.zip_with(
        F.map_entries(F.from_json(raw, "map<string,string>")), F.map_values(F.from_json(raw, "map<string,variant>")),
        lambda e, v: F.struct(e["key"].alias("key"), e["value"].alias("raw"), _kind(v).alias("kind")),
    )
    items = F.zip_with(
        F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>"), lambda x, v: F.struct(F.lit(None).cast("string").alias("key"), x.alias("raw"), _kind(v).alias("kind"))
    )
    return F.when(_is(node, "OBJECT"), fields.cast(NODES)).otherwise(items.cast(NODES))


def _text(node: Column) -> Column:
    """A scalar as text; truth values begin with a capital."""
    return F.when(_is(node, "BOOLEAN"), F.initcap(node["raw"])).otherwise(node["raw"])


def _quoted(s: Column) -> Column:
    inside = F.to_json(F.array(s))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def tree_normalize(raw: Column, max_depth: int = 5, max_keys: int | None = None, max_items: int | None = None, max_chars: int | None = None) -> Column:
    """The tree with scalars as squeezed text; null for text that is no JSON. Containers at ``max_depth`` become text.

    Limits are off unless given; an object that loses keys gets ``__truncated__``.
    """
    short = (lambda s: tx.trim_to(s, max_chars)) if max_chars else (lambda s: tx.squeeze(s))

    def build(node: Column, depth: int) -> Column:
        leaf = _quoted(short(_text(node)))
        if depth >= max_depth:
            return F.when(_is(node, "VOID"), F.lit('"None"')).otherwise(leaf)

        def container(kids: Column) -> Column:
            limit = F.when(_is(node, "OBJECT"), F.lit(max_keys)).otherwise(F.lit(max_items))
            kept = kids if max_keys is None and max_items is None else F.slice(kids, F.lit(1), F.coalesce(limit, F.size(kids)))
            parts = F.transform(kept, lambda k: F.concat(F.when(k["key"].isNotNull(), F.concat(_quoted(k["key"]), F.lit(": "))).otherwise(F.lit("")), build(k, depth + 1)))
            if max_keys is not None:
                more = _is(node, "OBJECT") & (F.size(kids) > max_keys)
                parts = F.when(more, F.concat(parts, F.array(F.lit('"__truncated__": true')))).otherwise(parts)
            joined = F.array_join(parts, ", ")
            return F.when(_is(node, "OBJECT"), F.concat(F.lit("{"), joined, F.lit("}"))).otherwise(F.concat(F.lit("["), joined, F.lit("]")))

        nested = _is(node, "OBJECT") | _is(node, "ARRAY")
        inside = container(_kids(node)) if max_keys is None else let(_kids(node), container)  # with a limit the children are used twice
        return F.when(_is(node, "VOID"), F.lit("null")).when(nested, inside).otherwise(leaf)

    return let(_root(raw), lambda n: F.when(n["kind"].isNotNull(), build(n, 0)))


def flatten_text(raw: Column, max_depth: int = 4, max_items: int | None = None) -> Column:
    """Scalars in document order, one a line. Empty ones, zeros, false and nulls are left out, as is what lies too deep."""
    nothing = F.array().cast("array<string>")

    def build(node: Column, depth: int) -> Column:
        said = tx.strip(_text(node))
        zero = F.coalesce(node["raw"].try_cast("double") == 0, F.lit(False)) & ~_is(node, "STRING")
        falsy = _is(node, "VOID") | zero | (_is(node, "BOOLEAN") & (node["raw"] == "false")) | (said == "")
        leaf = F.when(falsy, nothing).otherwise(F.array(said))
        nested = _is(node, "OBJECT") | _is(node, "ARRAY")
        if depth >= max_depth:
            return F.when(nested, nothing).otherwise(leaf)
        kids = F.filter(_kids(node), lambda k: F.coalesce(~k["key"].isin(*SKIPPED_KEYS), F.lit(True)))
        if max_items is not None:
            kids = F.when(_is(node, "ARRAY"), F.slice(kids, 1, max_items)).otherwise(kids)
        return F.when(nested, F.flatten(F.transform(kids, lambda k: build(k, depth + 1)))).otherwise(leaf)

    return let(_root(raw), lambda n: F.when(n["kind"].isNotNull(), F.array_join(build(n, 0), "\n")))


def tree_depth(raw: Column) -> Column:
    """Nesting of non-empty containers, of any depth: the highest count of open brackets outside strings."""
    bare = F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*+"', "0")
    bare = F.regexp_replace(bare, r"\{\s*\}|\[\s*\]", "0")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["top"], now).alias("top"))

    return F.when(F.try_parse_json(raw).isNotNull(), F.aggregate(marks, start, step, lambda a: a["top"]))


#: Where a document keeps previews of its tables and records.
PREVIEWS = (
    "records_preview array<string>, rows_preview array<array<string>>, tables array<struct<rows:array<array<string>>>>,"
    " sheets array<struct<records_preview:array<string>,rows_preview:array<array<string>>>>"
)


def record_count(raw: Column) -> Column:
    """Elements of a list; of an object those of its record preview, or of its sheets' record previews; else 0. Null for text that is no JSON."""

    def of(p: Column) -> Column:
        sheets = F.aggregate(F.coalesce(p["sheets"], F.array()), F.lit(0), lambda a, s: a + F.coalesce(F.size(s["records_preview"]), F.lit(0)))
        return F.when(p["records_preview"].isNotNull(), F.size(p["records_preview"])).otherwise(F.coalesce(sheets, F.lit(0)))

    counted = lambda n: F.when(_is(n, "ARRAY"), F.size(_kids(n))).when(_is(n, "OBJECT"), let(F.from_json(raw, PREVIEWS), of)).when(n["kind"].isNotNull(), F.lit(0))
    return let(_root(raw), counted)


def table_previews(raw: Column) -> Column:
    """Struct (blocks: all previewed tables of an object, as rows of cells; first: the rows whose cells tell the density)."""

    def of(p: Column) -> Column:
        none = F.array().cast("array<array<array<string>>>")
        own = F.when(p["rows_preview"].isNotNull(), F.array(p["rows_preview"])).otherwise(none)
        rows = lambda items, name: F.coalesce(F.transform(F.filter(items, lambda t: t.isNotNull()), lambda t: F.coalesce(t[name], F.array().cast("array<array<string>>"))), none)
        first = F.coalesce(p["rows_preview"], F.get(p["sheets"], F.lit(0))["rows_preview"])
        return F.struct(F.concat(own, rows(p["tables"], "rows"), rows(p["sheets"], "rows_preview")).alias("blocks"), first.alias("first"))

    return let(F.from_json(F.when(F.startswith(F.ltrim(raw), F.lit("{")), raw), PREVIEWS), of)
