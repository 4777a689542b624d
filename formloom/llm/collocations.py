"""Phrase collocations from an FM-index per shard over word ids.

A shard is a stretch of one language's texts that a task reads. Its words become ids, its pieces are separated by 0, and a
bidirectional FM-index (Burrows-Wheeler transforms of the ids and of their reverse) extends all intervals of a length at once
by one word on either side; an interval's size is its phrase's count. Counts are summed over shards. Three passes read the
texts: words, pairs, phrases. A pass leaves out what the sums before prove to be too rare, by a bit map of hashes that may let
more through, never less, so the sums of all that can be frequent are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import cut_plain, read_table
from formloom.llm.shingles import FACTOR, mix

#: Words of a phrase at most, occurrences at least, share of a longer phrase that covers a shorter one, phrases a language.
LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2000
#: Bytes of text of a shard, about; a task holds so many.
SHARD = 24 << 20
#: Bits of a bit map: 16 a key, within these bounds (the largest takes 32 MB and is broadcast).
FEWEST_BITS, MOST_BITS = 16, 28

# What separates pieces, and what separates words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_MARK = b"\xff"  # in no UTF-8 text
_FOLD = bytes.maketrans(bytes(range(65, 91)) + BREAKS, bytes(range(97, 123)) + _MARK * len(BREAKS))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of texts as ids from 1, 0 between pieces, and the distinct words (``words[i - 1]`` has id i)."""
    data = (_MARK + _MARK.join(texts)).translate(_FOLD).replace(_MARK, b" \xff ")
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == BLANKS[0]) | (raw == BLANKS[1])
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # the first byte is blank: words start and end in turn
    if len(edges) % 2:
        edges = np.append(edges, len(raw))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~blank])])
    coded = every.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # The mark comes first, so its id is 0 and words have ids from 1.
    return ids, coded.dictionary.slice(1)


class FMIndex:
    """Bidirectional index of ids (0: a boundary) for phrases of up to ``depth`` words.

    Suffixes are ordered by their first ``depth`` ids, which is all that intervals of such phrases need. ``bwt`` and ``step``
    (the row that a row's preceding id leads to) belong to the text, a second pair to its reverse.
    """

    def __init__(self, text: np.ndarray, depth: int):
        pad = np.zeros(depth, np.int64)
        text = np.concatenate([pad, text, pad])
        self.n = len(text)
        self.sides = [self._transform(t, depth) for t in (text, text[::-1])]
        count = np.bincount(text)
        self.first = np.cumsum(count) - count
        self.count = count

    @staticmethod
    def _transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        n, low = len(text), (1 << 32) - 1
        place = np.arange(n)
        order = place
        for k in range(depth - 1, -1, -1):  # stable passes, the last id first; places in the low bits keep sorts stable
            key = text[(order + k) % n] << 32 | place
            key.sort()
            order = order[key & low]
        bwt = text[order - 1]
        key = bwt << 32 | place
        key.sort()
        step = np.empty(n, np.int64)
        step[key & low] = place
        return bwt, step

    def words(self) -> Intervals:
        """The intervals of all words."""
        ids = np.flatnonzero(self.count[1:]) + 1
        return Intervals(ids[:, None], self.first[ids], self.first[ids], self.count[ids])

    def extend(self, of: Intervals, left: bool) -> Intervals:
        """All phrases that are one word longer to the left or to the right, with their counts in the shard."""
        bwt, step = self.sides[0 if left else 1]
        here, there = (of.low, of.mirror) if left else (of.mirror, of.low)
        owner = np.repeat(np.arange(len(here)), of.size)
        rows = np.arange(len(owner)) + np.repeat(here - np.cumsum(of.size) + of.size, of.size)
        ids = bwt[rows]
        bounds = np.bincount(owner[ids == 0], minlength=len(here))
        owner, rows, ids = owner[ids > 0], rows[ids > 0], ids[ids > 0]
        to = step[rows]
        by_row = np.argsort(to, kind="stable")
        to, owner, ids = to[by_row], owner[by_row], ids[by_row]
        # Rows of one phrase and one new word lie side by side.
        new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(ids) != 0)]) if len(to) else np.empty(0, np.int64)
        size = np.diff(np.r_[new, len(to)])
        low, parent, word = to[new], owner[new], ids[new]
        # In the mirror image a phrase's interval is cut by the new words in their order, after the boundaries.
        turn = np.argsort(parent, kind="stable")
        before = np.cumsum(size[turn]) - size[turn]
        head = np.flatnonzero(np.r_[True, np.diff(parent[turn]) != 0]) if len(turn) else np.empty(0, np.int64)
        within = before - np.repeat(before[head], np.diff(np.r_[head, len(turn)]))
        mirror = np.empty(len(new), np.int64)
        mirror[turn] = there[parent[turn]] + bounds[parent[turn]] + within
        kept = of.ids[parent]
        longer = np.concatenate([word[:, None], kept] if left else [kept, word[:, None]], axis=1)
        return Intervals(longer, *((low, mirror) if left else (mirror, low)), size)


class Intervals:
    """Phrases of one length: their ids, where their intervals start in the text's and in the reverse's index, and their sizes."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, mirror: np.ndarray, size: np.ndarray):
        self.ids, self.low, self.mirror, self.size = ids, low, mirror, size


class Known:
    """A bit map of hashes, as large as ``bits`` says: a hash that was put in is always found, few others are."""

    def __init__(self, raw: bytes, bits: int):
        self.map, self.shift = np.frombuffer(raw, np.uint8), np.uint64(64 - bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def known(rows: DataFrame) -> Known:
    """The bit map of the column ``h``. Whatever the table's size, it has at most ``2 ** MOST_BITS`` bits."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (16 * rows.count()).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    part = rows.select(F.shiftright(at, 6).alias("part"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 AS int))").alias("bit"))
    parts = part.groupBy("part").agg(F.bit_or("bit").alias("bits")).toArrow()
    whole = np.zeros(1 << bits - 6, np.int64)
    whole[parts["part"].to_numpy()] = parts["bits"].to_numpy()
    return Known(whole.tobytes(), bits)


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """What Spark's ``xxhash64(lang, word)`` gives; place 0 stands for the boundary."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((0, *(xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist())), np.uint64, len(words) + 1)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * FACTOR + right)


def frequent_only(ids: np.ndarray, hashes: np.ndarray, words: Known) -> np.ndarray:
    """Words that are too rare become boundaries; boundaries side by side become one."""
    out = np.where(words.has(hashes)[ids], ids, 0)
    return out[np.r_[True, (out[1:] > 0) | (out[:-1] > 0)]] if len(out) else out


def cut_pairs(ids: np.ndarray, hashes: np.ndarray, pairs: Known) -> np.ndarray:
    """Puts boundaries between neighbours whose pair is too rare, and leaves out words that no pair is left of."""
    left, right = ids[:-1], ids[1:]
    tied = np.zeros(len(ids) + 1, bool)  # tied[i]: word i - 1 and word i stay together
    both = np.flatnonzero((left > 0) & (right > 0))
    tied[both + 1] = pairs.has(pair_hashes(hashes[left[both]], hashes[right[both]]))
    starts, stays = ~tied[:-1], tied[:-1] | tied[1:]
    out = np.zeros((len(ids), 2), np.int64)
    out[:, 1] = ids
    keep = np.stack([starts & stays, stays], axis=1)
    return out[keep]


Shard = Callable[[str, np.ndarray, pa.Array], Iterator[pa.RecordBatch]]


def by_shards(docs: DataFrame, work: Shard, schema: str, size: int) -> DataFrame:
    """What ``work(lang, ids, words)`` gives for each shard of ``docs`` (``lang, text`` without nulls). Texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        bytes_of: dict[str, int] = defaultdict(int)

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            bytes_of.pop(lang)
            ids, words = words_of(held.pop(lang))
            if len(words):
                yield from work(lang, ids, words)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held[lang].append(text)
                bytes_of[lang] += len(text) + 1
                if bytes_of[lang] >= size or len(held) > 1 and sum(bytes_of.values()) >= 2 * size:
                    yield from flush(max(bytes_of, key=bytes_of.get))
        for lang in list(held):
            yield from flush(lang)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def _batches(columns: dict[str, pa.Array], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_pydict(columns)
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _same(value: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, pa.string()), n)


def count_words(lang: str, ids: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
    count = np.bincount(ids, minlength=len(words) + 1)[1:]
    yield from _batches({"lang": _same(lang, len(words)), "phrase": words.cast(pa.large_string()).cast(pa.string()), "c": pa.array(count, pa.int64())})


def count_pairs(frequent: Callable[[], Known]) -> Shard:
    def work(lang: str, ids: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes(words, lang)
        index = FMIndex(frequent_only(ids, hashes, frequent()), 2)
        found = index.extend(index.words(), left=True)
        h = pair_hashes(hashes[found.ids[:, 0]], hashes[found.ids[:, 1]])
        yield from _batches({"h": pa.array(h.view(np.int64)), "c": pa.array(found.size, pa.int64())})

    return work


def count_phrases(frequent: Callable[[], Known], pairs: Callable[[], Known], longest: int) -> Shard:
    def work(lang: str, ids: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes(words, lang)
        index = FMIndex(cut_pairs(frequent_only(ids, hashes, frequent()), hashes, pairs()), longest)
        found = index.words()
        texts = words.cast(pa.large_string())
        for k in range(2, longest + 1):
            found = index.extend(found, left=k % 2 == 1)
            if not len(found.size):
                return
            phrase = pc.binary_join_element_wise(*[texts.take(pa.array(x - 1)) for x in found.ids.T], pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield from _batches({"lang": _same(lang, len(phrase)), "phrase": phrase, "c": pa.array(found.size, pa.int64())})

    return work


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``lang, n`` (words of each language) and ``lang, phrase, f`` of all phrases of 1 to ``longest`` words found ``least`` times or more.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty); other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("text <> ''")
    phrases = "lang string, phrase string, c bigint"
    share = lambda k: spark.sparkContext.broadcast(k)  # noqa: E731  at most 2 ** MOST_BITS bits
    words = cut_plain(by_shards(texts, count_words, phrases, shard).groupBy("lang", "phrase").agg(F.sum("c").alias("f")))
    often = share(known(words.where(F.col("f") >= least).select(F.xxhash64("lang", "phrase").alias("h"))))
    pairs = by_shards(texts, count_pairs(lambda: often.value), "h bigint, c bigint", shard)
    pairs = cut_plain(pairs.groupBy("h").agg(F.sum("c").alias("f")).where(F.col("f") >= least).select("h"))
    tied = share(known(pairs))
    longer = by_shards(texts, count_phrases(lambda: often.value, lambda: tied.value, longest), phrases, shard)
    longer = longer.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    counts = cut_plain(words.where(F.col("f") >= least).union(longer))
    return words.groupBy("lang").agg(F.sum("f").alias("n")), counts


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(38,0)")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """``lang, rank, phrase, words, a, l, r, n, score, most_left, most_right``: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line breaks; phrases of 2 to ``longest`` words lie within
    a piece. ``a`` counts a phrase, ``l`` and ``r`` the parts before and after the cut with the lowest score
    ``2000000 * a div (l + r)`` (ties to the earliest cut), ``n`` the language's words. ``most_left`` and ``most_right`` are
    the counts of the most frequent phrases one word longer on that side (0: none reaches ``least``). A phrase is left out
    where a longer one that holds it has ``covered`` percent of its count; counts fall with length, so one word more decides.
    Null languages count as ``und``, null and empty texts have no words, repeated rows count each, and an empty table gives
    an empty result. Extra columns are ignored.
    """
    sizes, counts = phrase_counts(docs, longest, least, shard)
    some = counts.withColumn("words", F.size(F.split("phrase", " "))).where("words > 1")
    cuts = some.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = F.expr("array_join(slice(split(phrase, ' '), 1, k), ' ')")
    rest = F.expr("array_join(slice(split(phrase, ' '), k + 1, size(split(phrase, ' '))), ' ')")
    cuts = cuts.select("lang", "phrase", "a", "k", part.alias("head"), rest.alias("tail"))
    heads = counts.select(F.col("lang").alias("h_lang"), F.col("phrase").alias("h_phrase"), F.col("f").alias("l"))
    tails = counts.select(F.col("lang").alias("t_lang"), F.col("phrase").alias("t_phrase"), F.col("f").alias("r"))
    both = cuts.join(heads, (F.col("lang") == F.col("h_lang")) & (F.col("head") == F.col("h_phrase")))
    both = both.join(tails, (F.col("lang") == F.col("t_lang")) & (F.col("tail") == F.col("t_phrase")))
    score = F.expr("(CAST(a AS decimal(19,0)) * 2000000BD) div (CAST(l AS decimal(19,0)) + CAST(r AS decimal(19,0)))")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    side = lambda i, name: F.struct(F.lit(i).alias("side"), F.expr(name).alias("inner"))
    inner = some.where("words > 2").select(
        F.col("lang").alias("i_lang"),
        F.col("f"),
        F.explode(F.array(side(0, "array_join(slice(split(phrase, ' '), 2, words), ' ')"), side(1, "array_join(slice(split(phrase, ' '), 1, words - 1), ' ')"))).alias("x"),
    )
    most = lambda i: F.max(F.when(F.col("x.side") == i, F.col("f")))
    longer = inner.groupBy("i_lang", F.col("x.inner").alias("inner")).agg(most(0).alias("left"), most(1).alias("right"))
    kept = scored.join(longer, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("inner")), "left")
    kept = kept.select("lang", "phrase", "a", "l", "r", "score", F.coalesce("left", F.lit(0)).cast("long").alias("most_left"), F.coalesce("right", F.lit(0)).cast("long").alias("most_right"))
    kept = kept.where(F.greatest(_exact("most_left"), _exact("most_right")) * 100 < _exact("a") * covered)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place).where(F.col("rank") <= top)
    n = sizes.select(F.col("lang").alias("n_lang"), "n")
    out = ranked.join(n, F.col("lang") == F.col("n_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.size(F.split("phrase", " ")).cast("long").alias("words"), "a", "l", "r", "n", "score", "most_left", "most_right")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4)) AS k(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE m > 1 AND f >= 30),
kc AS (SELECT lang, m, phrase, a, k, array_to_string(x[1:k], ' ') AS head, array_to_string(x[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
cuts AS (SELECT kc.lang, kc.m, kc.phrase, kc.a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * kc.a) // (h.f::HUGEINT + t.f))::BIGINT AS score
         FROM kc JOIN f h ON h.lang = kc.lang AND h.phrase = kc.head JOIN f t ON t.lang = kc.lang AND t.phrase = kc.tail),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM cuts),
cover AS (SELECT lang, array_to_string(x[i:i + s - 1], ' ') AS phrase, max(a) AS f FROM c, (VALUES (1), (2), (3)) AS v(i), (VALUES (2), (3)) AS u(s) WHERE s < m AND i + s - 1 <= m GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN cover v USING (lang, phrase) WHERE rn = 1 AND (v.f IS NULL OR 100::HUGEINT * v.f < 80::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
