"""Collocations against counting by hand, and the index against its definition."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from formloom.llm import collocations as co


def phrases(rows, longest):
    """Counts of words and phrases by language, as the contract reads."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    return counts, n


def expected(rows, longest, least, covered, top):
    f, n = phrases(rows, longest)
    some = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    found = []
    for (lang, p), a in some.items():
        longer = [b for (other, q), b in some.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out, rank = [], Counter()
    for lang, score, a, p, left, right, size in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, size, -score))
    return out


@pytest.mark.parametrize("shard", [60, 1 << 20])
def test_collocations_match_counting(spark, shard):
    r = random.Random(3)
    vocab = ["a", "B", "é", "日本", "x\x1fy", "d-d", "Ünder", "e" * 3000]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("en", " . ,\t"), (None, None), ("hot", "w w w w w w w"), ("hot", "w w w w w w w"), ("rare", "one two")]
    docs = spark.createDataFrame([(lang, text, "n", 1, "c") for lang, text in rows], "lang string, text string, phrase string, f int, h string").repartition(3)
    for longest, least, covered, top in ((4, 5, 80, 2000), (3, 2, 60, 7)):
        got = co.collocations(docs, longest, least, covered, top, shard).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert sorted(map(tuple, got)) == expected(rows, longest, least, covered, top)


def test_collocations_of_nothing(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_intervals_are_counts():
    r = random.Random(1)
    for _ in range(20):
        text = np.array([r.choice([0, 1, 1, 2, 3, 4]) for _ in range(r.randint(1, 60))])
        index = co.FMIndex(text, 4)
        for sides in ((True, True, True), (False, False, False), (True, False, True)):
            found = index.words()
            for k, left in enumerate(sides, start=2):
                found = index.extend(found, left)
                want = Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if (text[i : i + k] > 0).all())
                assert {tuple(p): int(s) for p, s in zip(found.ids, found.size)} == dict(want)


def test_bit_map_finds_all_and_hashes_agree_with_spark(spark):
    rows = spark.range(1000).selectExpr("concat('w', id) AS phrase", "'de' AS lang").selectExpr("phrase", "xxhash64(lang, phrase) AS h")
    import pyarrow as pa

    words = [r[0] for r in rows.select("phrase").collect()]
    h = co.word_hashes(pa.array(words, pa.large_string()), "de")
    assert [int(x) for x in h[1:].view(np.int64)] == [r[1] for r in rows.collect()]
    found = co.known(rows)
    assert found.has(h[1:]).all()
    assert found.has(np.random.default_rng(0).integers(0, 2**63, 10000, dtype=np.uint64) * np.uint64(2)).mean() < 0.2
