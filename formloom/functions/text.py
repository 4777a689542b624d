"""Key normalisation, text predicates and similarity, built-ins except one Arrow UDF for the match ratio."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache
from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Line breaks a line splitter honours besides "\n".
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


# Fixed value: every character of Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    """Trim every kind of white space, not only blanks; without a pattern, because it runs on every cell."""
    return F.btrim(s, F.lit(WHITE_SPACE))


def split_lines(s: Column) -> Column:
    """Lines of a text; a break at the very end opens no further line."""
    lines = F.split(s, LINE_BREAKS)
    last_blank = F.element_at(lines, -1) == ""
    return F.when(last_blank, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def squeeze(s: Column) -> Column:
    return F.regexp_replace(strip(s), r"(?U)\s+", " ")


def normalize_key(s: Column, mode: str = "ascii") -> Column:
    """Comparable form of a key. ``ascii`` keeps a-z and 0-9 only, ``unicode`` keeps every letter."""
    if mode == "unicode":
        return normalize_compare(s)
    # White space at the ends becomes blanks with all else, so it needs no trimming of its own.
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))


def normalize_compare(s: Column) -> Column:
    return F.lower(squeeze(F.coalesce(s, F.lit(""))))


def trim_to(s: Column, limit: int) -> Column:
    """Squeezed text of at most ``limit`` characters, cut ones ending in three dots."""
    t = squeeze(F.coalesce(s, F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, max(0, limit - 3)), F.lit("..."))).otherwise(t)


def blankish(value: Column, value_type: Column | None = None) -> Column:
    """Null or a white-space string; numbers and booleans are never blank."""
    blank = value.isNull() | (strip(value) == "")
    return blank if value_type is None else value.isNull() | ((value_type == "s") & (strip(value) == ""))


def tokens(norm: Column) -> Column:
    return F.filter(F.array_distinct(F.split(norm, " ")), lambda t: t != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two normalised texts."""
    ta, tb = tokens(a), tokens(b)
    return F.size(F.array_intersect(ta, tb)) / F.greatest(F.lit(1), F.size(F.array_union(ta, tb)))


def token_overlap_min(a: Column, b: Column) -> Column:
    """Shared tokens over those of the shorter text."""
    ta, tb = tokens(a), tokens(b)
    return F.size(F.array_intersect(ta, tb)) / F.greatest(F.lit(1), F.least(F.size(ta), F.size(tb)))


def contains_either(a: Column, b: Column, min_len: int = 4) -> Column:
    return (a.contains(b) | b.contains(a)) & (F.least(F.length(a), F.length(b)) >= min_len)


@F.pandas_udf(DoubleType())
def seq_ratio(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-block ratio of two texts; Spark has no built-in with this value. Null where a text is null.

    A task remembers pairs of short texts, which may come again and again.
    """
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    known = lru_cache(maxsize=1 << 16)(ratio)
    one = lambda x, y: None if x is None or y is None else (known if len(x) + len(y) <= 256 else ratio)(x, y)
    for a, b in batches:
        yield pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


# A filter on the ratio would else be moved below the aggregation that leaves each pair of texts once.
seq_ratio = seq_ratio.asNondeterministic()


def native_key_score(a: Column, b: Column) -> Column:
    """The part of the key score that needs no Python: equality, containment, shared tokens. Normalised input."""
    score = F.greatest(token_jaccard(a, b), contains_either(a, b).cast("int").cast("double"))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(score)


def ratio_bound(a: Column, b: Column) -> Column:
    """No match ratio can exceed this."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def soft_key_score(a: Column, b: Column, full: bool = True) -> Column:
    """Score of two normalised keys. Argument order matters in full mode."""
    native = native_key_score(a, b)
    if not full:
        return native
    hopeless = (native >= 1.0) | (a == "") | (b == "") | (ratio_bound(a, b) <= native)
    return F.greatest(native, seq_ratio(F.when(~hopeless, a), F.when(~hopeless, b)))


def text_sim(a: Column, b: Column, full: bool = True) -> Column:
    """Like the key score for free text: separators / and -, no containment."""
    na = F.trim(F.regexp_replace(normalize_compare(a), "[/-]", " "))
    nb = F.trim(F.regexp_replace(normalize_compare(b), "[/-]", " "))
    score = token_jaccard(na, nb)
    if full:
        score = F.greatest(score, seq_ratio(normalize_compare(a), normalize_compare(b)))
    return F.when((na == "") | (nb == ""), 0.0).when(normalize_compare(a) == normalize_compare(b), 1.0).otherwise(score)


def keys_soft_match(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or three quarters of the shorter one's tokens shared. Normalised input."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a) | (token_overlap_min(a, b) >= 0.75))


def probable_key(s: Column) -> Column:
    """Does a text look like a field label?

    At most 64 characters once squeezed, a letter, more than one of A-Z, a-z and 0-9, and no bare yes, no or n/a. A text with
    a letter is no number, and white space counts for none of this but the length, which is squeezed only where it is too long.
    """
    t = F.coalesce(s, F.lit(""))
    short = F.when(F.length(t) <= 64, True).otherwise(F.length(squeeze(t)) <= 64)
    return (
        t.rlike(r"(?U)[^\d\W_]") & t.rlike("[A-Za-z0-9][^A-Za-z0-9]*[A-Za-z0-9]") & short & ~F.lower(strip(t)).isin("yes", "no", "n/a", "na")
    )


def noisy_key(s: Column) -> Column:
    """Empty, without letters, or a bare number with at most one letter."""
    t = squeeze(F.coalesce(s, F.lit("")))
    alnum = F.regexp_replace(t, "[^A-Za-z0-9]+", "")
    return (
        (t == "")
        | t.rlike(r"(?U)^[\d\W_]+$")
        | (F.length(alnum) <= 1)
        | alnum.rlike("^[0-9]+[A-Za-z]?$")
    )


# Ranges of East Asian wide and full-width code points.
WIDE = (
    r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}"
    r"\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE10}-\x{FE19}\x{FE30}-\x{FE6F}\x{FF01}-\x{FF60}"
    r"\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}"
)


def display_width(s: Column) -> Column:
    """Columns a text takes on screen: wide characters count two, line breaks none."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), "\n", "")
    return F.length(t) + F.length(F.regexp_replace(t, f"[^{WIDE}]", ""))


# Phrases by which a checker says that a region is fine.
SAFE_BLANK_PHRASES = ("intentionally blank", "should remain blank", "correctly left blank")
CORRECT_PHRASES = (
    "correctly filled",
    "correctly placed",
    "already correct",
    "form is correctly filled",
    "value correctly filled",
)


def reason_safe_blank(reason: Column) -> Column:
    return F.coalesce(F.lower(reason).rlike("|".join(SAFE_BLANK_PHRASES)), F.lit(False))


def reason_correct(reason: Column) -> Column:
    return F.coalesce(F.lower(reason).rlike("|".join(SAFE_BLANK_PHRASES + CORRECT_PHRASES)), F.lit(False))
