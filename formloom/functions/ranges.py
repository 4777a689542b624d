"""A1 range algebra as Column expressions: everything stays inside code generation.

A rectangle is four int columns ``r0, c0, r1, c1`` (1-based, inclusive) or a struct with those fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions.text import strip

RECT = "struct<r0:int,c0:int,r1:int,c1:int>"
MAX_ROW, MAX_COL = 1_048_576, 16_384
_CELL = "([A-Z]{1,3})([0-9]{1,7})"
_RANGE_RE = f"^{_CELL}(?::{_CELL})?$"
# Fixed pattern: what counts as a range mention inside free text.
RANGE_MENTION = r"([A-Za-z]{1,4}[0-9]{1,7}\s*:\s*[A-Za-z]{1,4}[0-9]{1,7}|[A-Za-z]{1,4}[0-9]{1,7})"


def col_number(letters: Column) -> Column:
    """``'AB'`` -> 28, for one to three letters."""
    p = F.lpad(letters, 3, "@")
    digit = [F.ascii(F.substring(p, i, 1)) - 64 for i in (1, 2, 3)]
    return (digit[0] * 676 + digit[1] * 26 + digit[2]).cast("int")


def col_letters(n: Column) -> Column:
    """28 -> ``'AB'``: bijective base 26 in at most three digits."""
    n = n.cast("int")
    last = F.char(65 + (n - 1) % 26)
    m = F.floor((n - 1) / 26).cast("int")
    mid = F.when(m > 0, F.char(65 + (m - 1) % 26)).otherwise("")
    k = F.floor((m - 1) / 26).cast("int")
    top = F.when(k > 0, F.char(64 + k)).otherwise("")
    return F.concat(top, mid, last)


def a1_cell(row: Column, col: Column) -> Column:
    return F.concat(col_letters(col), row.cast("string"))


def a1_range(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    return F.concat(a1_cell(r0, c0), F.lit(":"), a1_cell(r1, c1))


def a1_of(rect: Column) -> Column:
    return a1_range(rect["r0"], rect["c0"], rect["r1"], rect["c1"])


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``; keeps nested expressions from growing exponentially."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def parse_a1(text: Column, strip_dollar: bool = False) -> Column:
    """Text -> rectangle struct, null when the text is no range. Corners come out ordered."""
    t = F.upper(F.regexp_replace(strip(text), r"[ $]" if strip_dollar else " ", ""))
    parts = F.split(F.regexp_replace(t, _RANGE_RE, "$1,$2,$3,$4"), ",")

    def corners(p: Column) -> Column:
        single = p[2] == ""
        return F.struct(
            col_number(p[0]).alias("ca"),
            p[1].try_cast("int").alias("ra"),
            F.when(single, col_number(p[0])).otherwise(col_number(p[2])).alias("cb"),
            F.when(single, p[1].try_cast("int")).otherwise(p[3].try_cast("int")).alias("rb"),
        )

    def ordered(x: Column) -> Column:
        return F.struct(
            F.least(x["ra"], x["rb"]).alias("r0"),
            F.least(x["ca"], x["cb"]).alias("c0"),
            F.greatest(x["ra"], x["rb"]).alias("r1"),
            F.greatest(x["ca"], x["cb"]).alias("c1"),
        )

    def checked(r: Column) -> Column:
        return F.when((r["r0"] >= 1) & (r["r1"] <= MAX_ROW) & (r["c1"] <= MAX_COL), r)

    # A text that is no range keeps its shape under the replacement, so it has no four parts.
    shaped = lambda p: F.when(F.size(p) == 4, let(let(corners(p), ordered), checked))
    return let(F.when(~t.contains(","), parts), shaped)


def rect_columns(parsed: Column) -> Column:
    """Generator with columns r0, c0, r1, c1; rows without a rectangle drop out.

    A generator is parsed once and keeps later filters on the corners from being pushed into the parsing.
    """
    return F.inline(F.array_compact(F.array(parsed)))


def normalize_a1(text: Column, strip_dollar: bool = False) -> Column:
    """Any accepted spelling -> ``LT:RB`` in upper case, else null."""
    return let(parse_a1(text, strip_dollar), a1_of)


def coord(text: Column) -> Column:
    """(row, col) of a single cell, null when the text is not exactly one cell."""
    def one(rect: Column) -> Column:
        single = (rect["r0"] == rect["r1"]) & (rect["c0"] == rect["c1"])
        return F.when(single, F.struct(rect["r0"].alias("row"), rect["c0"].alias("col")))

    return let(parse_a1(text), one)


def parse_list(text: Column) -> Column:
    """Comma list -> array of rectangles in text order; tokens that are no range are skipped."""
    tokens = F.split(text, ",")
    return F.filter(F.transform(tokens, lambda x: parse_a1(x)), lambda r: r.isNotNull())


def first_rect(text: Column) -> Column:
    """Rectangle of the first token of a comma list."""
    return parse_a1(F.element_at(F.split(text, ","), 1))


def intersects(a, b) -> Column:
    """Inclusive overlap in both axes. ``a`` and ``b`` are structs or 4-tuples of columns."""
    a0, a1, a2, a3 = _edges(a)
    b0, b1, b2, b3 = _edges(b)
    return (a0 <= b2) & (b0 <= a2) & (a1 <= b3) & (b1 <= a3)


def touches(a, b) -> Column:
    """Overlap after growing one of them by a cell: contact over edges and corners counts."""
    a0, a1, a2, a3 = _edges(a)
    b0, b1, b2, b3 = _edges(b)
    return (a0 <= b2 + 1) & (b0 <= a2 + 1) & (a1 <= b3 + 1) & (b1 <= a3 + 1)


def _edges(r):
    return r if isinstance(r, tuple) else (r["r0"], r["c0"], r["r1"], r["c1"])


def area(rect) -> Column:
    r0, c0, r1, c1 = _edges(rect)
    return (r1 - r0 + 1).cast("long") * (c1 - c0 + 1)


def union_rects(rects: Column) -> Column:
    """Bounding box of an array of rectangles; null for an empty array."""
    return F.when(
        F.size(rects) > 0,
        F.struct(
            F.array_min(F.transform(rects, lambda r: r["r0"])).alias("r0"),
            F.array_min(F.transform(rects, lambda r: r["c0"])).alias("c0"),
            F.array_max(F.transform(rects, lambda r: r["r1"])).alias("r1"),
            F.array_max(F.transform(rects, lambda r: r["c1"])).alias("c1"),
        ),
    )


def bbox_agg(prefix: str = "") -> list[Column]:
    """Aggregates for a bounding box over rows that carry r0, c0, r1, c1."""
    return [
        F.min("r0").alias(prefix + "r0"),
        F.min("c0").alias(prefix + "c0"),
        F.max("r1").alias(prefix + "r1"),
        F.max("c1").alias(prefix + "c1"),
    ]


def expand_focus(rect, clip, left: int = 0, top: int = 0, right: int = 0, bottom: int = 0) -> Column:
    """Pad and clip; when nothing is left the whole clip box is returned."""
    r0, c0, r1, c1 = _edges(rect)
    k0, k1, k2, k3 = _edges(clip)
    n0, n1 = F.greatest(k0, r0 - max(0, top)), F.greatest(k1, c0 - max(0, left))
    n2, n3 = F.least(k2, r1 + max(0, bottom)), F.least(k3, c1 + max(0, right))
    empty = (n0 > n2) | (n1 > n3)
    pick = lambda new, old, name: F.when(empty, old).otherwise(new).alias(name)
    return F.struct(pick(n0, k0, "r0"), pick(n1, k1, "c0"), pick(n2, k2, "r1"), pick(n3, k3, "c1"))


def cells_of(rect: Column) -> Column:
    """Row-major array of (row, col) structs of one rectangle."""
    return F.flatten(
        F.transform(
            F.sequence(rect["r0"], rect["r1"]),
            lambda r: F.transform(
                F.sequence(rect["c0"], rect["c1"]), lambda c: F.struct(r.alias("row"), c.alias("col"))
            ),
        )
    )


def expand_limited(text: Column, max_span: int = 12) -> Column:
    """Cells of a comma list, or an empty array when it holds more than ``max_span`` cells."""
    none = F.array().cast("array<struct<row:int,col:int>>")

    def small(rects: Column) -> Column:
        total = F.aggregate(rects, F.lit(0).cast("long"), lambda acc, r: acc + area(r))
        return F.when(total <= max_span, F.flatten(F.transform(rects, lambda r: cells_of(r)))).otherwise(none)

    return let(parse_list(text), small)


def extract_ranges(text: Column) -> Column:
    """All range mentions of a text, normalised, first occurrence kept."""
    hits = F.regexp_extract_all(text, F.lit(RANGE_MENTION), F.lit(1))
    norm = F.transform(hits, lambda h: normalize_a1(F.regexp_replace(h, r"\s", "")))
    return F.array_distinct(F.filter(norm, lambda n: n.isNotNull()))


# Names a reply may use for a list of ranges, then for a single one.
RANGE_LIST_FIELDS = ("bad_ranges", "focus_ranges", "ranges", "error_ranges")
RANGE_FIELDS = ("bad_range", "focus_range", "range", "error_range")


def extract_focus_ranges(text: Column) -> Column:
    """Ranges named by a JSON object's known fields; without any, all mentions of the text."""
    empty = F.array().cast("array<string>")
    schema = "array<variant>"

    def named(v: Column) -> Column:
        items = [F.coalesce(F.try_variant_get(v, f"$.{n}", schema), F.array().cast(schema)) for n in RANGE_LIST_FIELDS]
        items += [F.array(F.try_variant_get(v, f"$.{n}", "variant")) for n in RANGE_FIELDS]
        strings = F.filter(F.concat(*items), lambda x: F.schema_of_variant(x) == "STRING")
        found = F.flatten(F.transform(strings, lambda x: extract_ranges(x.cast("string"))))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array_distinct(found)).otherwise(empty)

    pick = lambda n: F.when(F.size(n) > 0, n).otherwise(F.coalesce(extract_ranges(text), empty))
    return let(F.coalesce(let(F.try_parse_json(text), named), empty), pick)


def cell_sort_key(cell: Column) -> Column:
    """Orders cell texts by row, then column; texts that are no range come last."""
    far = F.lit(10**9)

    def key(rect: Column) -> Column:
        return F.struct(
            F.coalesce(rect["r0"], far).alias("row"),
            F.coalesce(rect["c0"], far).alias("col"),
            F.when(rect.isNotNull(), a1_cell(rect["r0"], rect["c0"])).otherwise(F.upper(strip(cell))).alias("text"),
        )

    return let(parse_a1(cell), key)


def dedupe_cells(cells: Column, limit: int | None = None) -> Column:
    """Distinct upper-cased cells in sheet order, optionally the first ``limit``."""
    clean = F.filter(F.transform(cells, lambda c: F.upper(strip(c))), lambda c: c != "")
    keyed = F.transform(F.array_distinct(clean), lambda c: F.struct(cell_sort_key(c).alias("k"), c.alias("c")))
    out = F.transform(F.array_sort(keyed), lambda s: s["c"])
    return F.slice(out, 1, limit) if limit else out
