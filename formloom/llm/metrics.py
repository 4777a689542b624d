"""Counts over whole texts, as expressions that need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.llm.common import SPACES, let, words

#: Words in a window when repeats are counted.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def repeat_words(word_list: Column, width: int = WINDOW) -> Column:
    """Words inside ``width``-word windows that the text has twice or more.

    Windows become 64-bit hashes. Where two are equal, hashes are sorted with their places, those with an equal neighbour
    stay, and each adds the words it covers beyond the window before it. Time is n log n in the words of the text.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda e: e["p"]))
        start = F.struct(F.lit(-width).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(width), p - a["at"])).alias("n")), lambda a: a["n"].cast("long"))

    def of_words(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(found)

    return let(word_list, of_words)


def word_struct(text: Column) -> Column:
    """``n_words`` and ``n_repeat_words`` in one struct, so that the words are taken apart once."""
    return let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
