"""Text similarity joins inside a key without comparing everything with everything.

Candidates come from equi-joins on blocking keys that no qualifying pair can miss:
* shared tokens: both sides emit the prefix of their rarest tokens that a score of at least t must hit;
* containment: the inner text emits one gram of its own length class, the outer one all grams of each class;
* match ratio (full mode): a ratio of at least t forces common characters, and on longer texts common bigrams. With
  M >= t*S/2 matched characters in at most S-2M+1 blocks there are at least S*(1.5t-1)-1 common bigrams, S being the
  summed length. Each side emits the prefix of its rarest bigrams or characters accordingly.
Only distinct candidate pairs are scored, built-ins first, the ratio where its length bound can still reach t.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import text as tx
from formloom.functions.ranges import let
from formloom.session import cut_lineage

GRAM_SIZES = (4, 6, 9, 14, 24)
#: Groups with so many texts on the right, or fewer, pair them directly.
FEW = 32
# Fixed value: letters by falling frequency; later ones make rarer blocks.
COMMON_FIRST = " etaoinshrdlucmfwypvbgkqjxz0123456789"


def _rarity(s: Column) -> Column:
    """Static sort text: rarer characters and longer strings come first."""
    rank = F.aggregate(F.split(s, ""), F.lit(0), lambda acc, ch: acc + F.instr(F.lit(COMMON_FIRST), ch))
    return F.struct((-rank).alias("k"), s.alias("s"))


def _prefix(items: Column, n: Column) -> Column:
    ordered = F.array_sort(F.transform(items, lambda x: _rarity(x)))
    return F.transform(F.slice(ordered, 1, F.greatest(F.lit(0), n)), lambda x: x["s"])


def _tagged(tag: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(tag), x))


def _token_keys(norm: Column, t: float) -> Column:
    toks = tx.tokens(norm)
    need = F.greatest(F.lit(1), F.ceil(F.size(toks) * t - 1e-9))
    return _tagged("t:", _prefix(toks, (F.size(toks) - need + 1).cast("int")))


def _grams(norm: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    idx = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(norm) - n + 1))
    return F.when(F.length(norm) >= n, F.array_distinct(F.transform(idx, lambda i: norm.substr(i, F.lit(n))))).otherwise(none)


def _own_gram(norm: Column, tag: str, sizes: tuple[int, ...]) -> Column:
    pick = F.lit(None).cast("string")
    for n in sizes:
        pick = F.when(F.length(norm) >= n, F.concat(F.lit(f"{tag}{n}:"), F.substring(norm, 1, n))).otherwise(pick)
    return F.array_compact(F.array(pick))


def _all_grams(norm: Column, tag: str, sizes: tuple[int, ...]) -> Column:
    return F.concat(*[_tagged(f"{tag}{n}:", _grams(norm, n)) for n in sizes])


def _contain_keys(norm: Column, left: bool, sizes: tuple[int, ...]) -> Column:
    inner, outer = ("i:", "o:") if left else ("o:", "i:")
    return F.concat(_own_gram(norm, inner, sizes), _all_grams(norm, outer, sizes))


def _occurrences(items: Column) -> Column:
    """Numbers repeats (x#1, x#2), so that set intersection counts like multiset intersection.

    Equal items lie together after sorting, so each run is numbered from its first place; the order of items is not kept.
    """

    def runs(ordered: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        numbered = lambda starts: F.transform(
            starts,
            lambda p, j: F.transform(
                F.sequence(F.lit(1), F.coalesce(F.get(starts, j + 1), F.size(ordered)) - p), lambda k: F.concat(F.get(ordered, p), F.lit("#"), k.cast("string"))
            ),
        )
        return F.when(F.size(ordered) == 0, F.array().cast("array<string>")).otherwise(F.flatten(let(places, numbered)))

    return let(F.sort_array(items), runs)


def _ratio_keys(norm: Column, t: float) -> Column:
    n = F.length(norm)
    s_min = n + F.ceil(n * (t / (2 - t)) - 1e-9)
    gain = 1.5 * t - 1
    none = F.array().cast("array<string>")
    chars = F.filter(F.split(norm, ""), lambda c: c != "")
    need_chars = F.ceil(s_min * (t / 2) - 1e-9)
    by_char = _tagged("c:", _prefix(_occurrences(chars), (n - need_chars + 1).cast("int")))
    if gain <= 0:
        return by_char
    # Texts so short that a partner need not share a bigram, and everything such a text can pair with.
    short = max(k for k in range(1, 400) if k + math.ceil(k * t / (2 - t) - 1e-9) < 2 / gain) if gain < 0.9 else 0
    reach = math.floor(short * (2 - t) / t)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: norm.substr(i, F.lit(2)))
    need = F.ceil(s_min * gain - 1 - 1e-9)
    by_gram = F.when(need >= 1, _tagged("b:", _prefix(_occurrences(grams), (n - 1 - need + 1).cast("int")))).otherwise(none)
    return F.concat(by_gram, F.when(n <= reach, by_char).otherwise(none))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], left_blocks: Column, right_blocks: Column) -> DataFrame:
    """Distinct (keys, a, b) that share a blocking key inside a group.

    Blocking keys are built once per distinct text, however many groups hold it, and only those known on both sides
    travel to the group join.
    """
    a, b = _texts(left, keys), _texts(right, keys)
    vocab = lambda d, blocks: d.select("norm").distinct().select("norm", F.explode(F.array_distinct(blocks)).alias("_block"))
    va, vb = vocab(a, left_blocks), vocab(b, right_blocks)
    ka = va.join(vb.select("_block").distinct(), "_block", "left_semi")
    kb = vb.join(va.select("_block").distinct(), "_block", "left_semi")
    fa = a.join(ka, "norm").withColumnRenamed("norm", "a")
    fb = b.join(kb, "norm").withColumnRenamed("norm", "b")
    return fa.join(fb, [*keys, "_block"]).select(*keys, "a", "b").distinct()


def _texts(d: DataFrame, keys: list[str]) -> DataFrame:
    return d.filter("norm <> ''").select(*keys, "norm").distinct()


def small_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All pairs (keys, a, b) of groups with few texts on the right, where blocking keys would outnumber the pairs, and both
    sides of the other groups. A group's right texts are one array of at most ``FEW`` texts; the choice is by group, so each
    pair is in one of the parts."""
    a, b = _texts(left, keys), _texts(right, keys)
    size = b.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = size.filter(F.col("_n") > FEW).select(*keys)
    few = b.groupBy(*keys).agg(F.count("*").alias("_n"), F.collect_list("norm").alias("_b")).filter(F.col("_n") <= FEW)
    pairs = a.join(few.select(*keys, "_b"), keys).select(*keys, F.col("norm").alias("a"), F.explode("_b").alias("b"))
    return pairs, a.join(large, keys, "left_semi"), b.join(large, keys, "left_semi")


def candidate_pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, full: bool, contain: bool = True) -> DataFrame:
    """Distinct (keys, a, b) that may reach the threshold. Both sides hold keys and ``norm``."""

    def blocks(is_left: bool) -> Column:
        norm = F.col("norm")
        parts = [_token_keys(norm, threshold)]
        if contain:
            parts.append(_contain_keys(norm, is_left, GRAM_SIZES))
        if full:
            parts.append(_ratio_keys(norm, threshold))
        return F.concat(*parts)

    return _meet(left, right, keys, blocks(True), blocks(False))


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, full: bool = True) -> DataFrame:
    """Pairs of normalised key texts whose key score reaches the threshold, with the score.

    Many groups hold the same two texts, so distinct texts are scored once: built-ins first, the ratio where its length bound
    can still reach the threshold. Only what passes comes back to the groups.
    """
    pairs, a_rest, b_rest = small_groups(left, right, keys)
    pairs = cut_lineage(pairs.unionByName(candidate_pairs(a_rest, b_rest, keys, threshold, full)))
    a, b = F.col("a"), F.col("b")
    scored = pairs.select("a", "b").distinct().withColumn("score", tx.native_key_score(a, b))
    if full:
        worth = (F.col("score") < 1.0) & (tx.ratio_bound(a, b) > F.greatest(F.col("score"), F.lit(threshold - 1e-9)))
        ratio = tx.seq_ratio(F.when(F.col("worth"), a), F.when(F.col("worth"), b))
        scored = scored.withColumn("worth", worth).withColumn("score", F.greatest("score", ratio)).drop("worth")
    scored = cut_lineage(scored.filter(F.col("score") >= threshold))
    return pairs.join(scored, ["a", "b"]).select(*keys, "a", "b", "score")


def similar_texts(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, full: bool = True) -> DataFrame:
    """Like ``similar_pairs`` for compared free text (no containment); ``norm`` holds squeezed lower-case text."""
    few, left, right = small_groups(left, right, keys)
    pairs = candidate_pairs(_spaced(left), _spaced(right), keys, threshold, False, contain=False)
    back = lambda d, n: d.select(*keys, F.col("norm").alias(n + "_text"), _split_form(F.col("norm")).alias(n)).distinct()
    pairs = pairs.join(back(left, "a"), [*keys, "a"]).join(back(right, "b"), [*keys, "b"])
    pairs = pairs.select(*keys, F.col("a_text").alias("a"), F.col("b_text").alias("b"))
    if full:
        pairs = pairs.unionByName(_ratio_candidates(left, right, keys, threshold)).distinct()
    return score_texts(pairs.unionByName(few), keys, threshold, full)


def score_texts(pairs: DataFrame, keys: list[str], threshold: float, full: bool = True) -> DataFrame:
    """Those of the pairs (keys, a, b) that reach the threshold, with the score. Distinct texts are scored once."""
    pairs = cut_lineage(pairs)
    scored = pairs.select("a", "b").distinct().withColumn("score", tx.text_sim(F.col("a"), F.col("b"), full))
    return pairs.join(cut_lineage(scored.filter(F.col("score") >= threshold)), ["a", "b"]).select(*keys, "a", "b", "score")


def _split_form(norm: Column) -> Column:
    return F.trim(F.regexp_replace(norm, "[/-]", " "))


def _spaced(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", _split_form(F.col("norm")))


def _ratio_candidates(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    blocks = _ratio_keys(F.col("norm"), threshold)
    return _meet(left, right, keys, blocks, blocks)


def soft_match_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of normalised keys that match softly: equal, containment of any length, or three quarters of tokens shared."""
    sizes = (1, 2, 3, *GRAM_SIZES)

    def blocks(is_left: bool) -> Column:
        norm = F.col("norm")
        toks = tx.tokens(norm)
        prefix = _prefix(toks, (F.size(toks) - F.ceil(F.size(toks) * 0.75 - 1e-9) + 1).cast("int"))
        mine, other = ("p:", "q:") if is_left else ("q:", "p:")
        return F.concat(_contain_keys(norm, is_left, sizes), _tagged(mine, prefix), _tagged(other, toks))

    pairs = _meet(left, right, keys, blocks(True), blocks(False))
    return pairs.filter(tx.keys_soft_match(F.col("a"), F.col("b")))
