"""The operators against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from formloom.llm import bpe, chat, components, licenses, mixing, neardup, pii, pu, rules, sharding, vafile
from formloom.llm.shingles import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score string, row string, bucket int, shard string, mix_key int"


def row(doc_id, text, lang="en", source="a"):
    """A document with columns whose names the operators use themselves."""
    return (doc_id, text, lang, source, len(text or ""), -1, "score", "row", -2, "shard", -3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(300)]
    out = []
    for i in range(60):
        out.append(row(i, " ".join(r.choices(vocab, k=r.randint(1, 60))), r.choice(["en", "de", None]), r.choice(["a", "b", "é", None])))
    base = r.choices(vocab, k=80)
    for i in range(60, 100):  # a chain of near copies: neighbours are similar, ends are not
        base = list(base)
        base[r.randrange(80)] = f"new{i}"
        out.append(row(i, " ".join(base).upper() if i % 7 == 0 else " ".join(base), "en", "hot"))
    out += [row(100 + i, " ".join(base), "en", "hot") for i in range(20)]  # exact copies
    out += [row(130, None), row(131, ""), row(132, " \t\n "), row(133, "one"), row(134, "one two  three"), row(135, "One\ttwo three")]
    out += [row(136, "x" * 30000 + " " + "y z " * 3000), row(137, "mail a.b@c.example.org and 10.0.0.1 or 999.1.1.1, +1 (555) 123-4567, 4111 1111 1111 1111")]
    out += [row(138, "a\nb b\na\n\na", None, None), row(138, "a\nb b\na\n\na", None, None), row(None, "no id here", "en", "a"), row(139, "Ünïcode 日本 <|endoftext|> 😀 it's", "en", "é")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def size_of(text):
    return len(WORD.findall(text or ""))


# 1 ------------------------------------------------------------------------------------------------------------------


def expected_mix(rows, seed=0):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, target, open_ones = sum(sizes.values()), {}, set(names)
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_ones)
        full = [s for s in open_ones if left * weight[s] / w > 3 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            open_ones.discard(s)
    return sizes, target | {s: left * weight[s] / w for s in open_ones}


def test_mix_plan(docs, rows):
    sizes, target = expected_mix(rows)
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= 3  # whole words; tied copies may each lose a part
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(docs.repartition(5)).collect()))


def test_mix_rows_follow_the_plan(docs):
    plan = {}
    for r in mixing.mix_plan(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += size_of(r["text"])
        assert r["size"] == -1 and r["row"] == "row"
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in plan.items() if v}


def test_mix_empty(nothing):
    assert mixing.mix_plan(nothing).collect() == [] and mixing.mix(nothing).collect() == []


# 2 ------------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = [(r[0], frozenset(shingle_set(r[1]).tolist())) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates(docs, rows):
    want = brute_components(rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()}) and ids.count(None) == 1


def test_blocks_do_not_change_the_result(docs, rows):
    got = neardup.near_duplicates(docs, block=3).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_near_duplicates_empty(nothing):
    assert neardup.near_duplicates(nothing).collect() == [] and neardup.keep_one(nothing).collect() == []


def test_short_texts_at_the_threshold(spark):
    """Pairs of exactly 0.75: texts of 7 and 8 words, of 10 and 12, that share their first words."""
    r = random.Random(11)
    out = []
    for i in range(3000):
        short, long = (7, 8) if i % 2 else (10, 12)
        words = [f"{r.getrandbits(48):x}" for _ in range(long)]
        out += [(2 * i, " ".join(words[:short])), (2 * i + 1, " ".join(words))]
    got = neardup.near_duplicates(spark.createDataFrame(out, "doc_id bigint, text string")).collect()
    assert [x.doc_id for x in got if x.component_id != x.doc_id // 2 * 2] == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (None, 5)]
    got = dict(components.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.connected(spark.createDataFrame([(1, 1)], "u bigint, v bigint")).collect() == []


# 3 ------------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    r = random.Random(3)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(8)], "x") for i in range(150)]
    vectors += [(200 + i, vectors[50][1], "copy") for i in range(60)]  # a large group of equal vectors
    vectors += [(300, None, ""), (301, [1.0, None], ""), (302, [float("nan")] * 8, ""), (303, [float("inf")] * 8, ""), (304, [], ""), (350, [0.5, 0.25], ""), (None, [1.0] * 8, "")]
    vectors += [vectors[7], (400, [1e12] * 8, "large")]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, score string")
    import math

    ok = {i: [math.floor(256 * x) for x in v] for i, v, _ in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    limit = lambda n: max(-(2**63), min(2**63 - 1, n))
    want = []
    for q in sorted(ok):
        if q % 50 == 0:
            best = sorted(((-limit(sum(a * b for a, b in zip(ok[q], v))), i) for i, v in ok.items() if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = sorted(tuple(x) for x in vafile.top_k(table, F.col("vec_id") % 50 == 0).collect())
    assert got == want
    assert vafile.top_k(table.where("vec_id IN (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1
    assert vafile.top_k(table.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_reads_on_until_certain(spark, monkeypatch):
    """Coarse cells and few vectors at a time need several rounds, with the same result."""
    r = random.Random(4)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    want = sorted(map(tuple, vafile.top_k(table, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(vafile, "FIRST_READ", 5)
    monkeypatch.setattr(vafile, "CELLS", 2)
    assert sorted(map(tuple, vafile.top_k(table, F.col("vec_id") % 50 == 0).collect())) == want


# 4 ------------------------------------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi [INST] \\[\\INST] <s>"), (1, 2, "assistant", "</s><\\/s><<SYS>>[[/INST]"), (1, 3, "user", "tail <"),
    (2, 0, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, None, None, "x\ny"), (None, 0, "assistant", "lost"), (4, 5, "assistant", "日本 😀"), (4, 1, "assistant", "first"),
]


def test_chat_round_trip(spark):
    table = spark.createDataFrame([(*t, "e", 1) for t in TURNS], "conv_id bigint, turn bigint, role string, text string, example string, at int")
    examples = chat.expand(table)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    talks = defaultdict(list)
    for c, t, role, text in sorted(TURNS, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        talks[c].append((role or "", text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in examples.collect():  # one reply at most under each mask, the context is a prefix, and markers inside texts are escaped
        turns = talks[r["conv_id"]]
        assert r["text"].count("<s>") == r["text"].count("</s>") == r["text"].count("[INST]") <= len(turns)
        assert r["loss_end"] <= len(r["text"]) - len("</s>")
    assert chat.digests(chat.expand(table.where("false"))).collect() == []


# 5 ------------------------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + d for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for d in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def labels_table(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id bigint, quality int, toxic int")


def test_rules_base(spark, docs, rows, nothing):
    got = rules.apply_rules(docs, labels_table(spark, [(1, None, 0), (None, 1, 0)])).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in got) == sorted((str(r[0]), *base_counts(r[1])) for r in rows)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # no usable labels: only the base rejects
    assert rules.apply_rules(nothing, labels_table(spark, [])).collect() == []


def test_rules_learn_a_safe_cutoff(spark):
    good = [row(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(700)]
    bad = [row(1000 + i, " ".join(f"v{i}x{k}###" for k in range(20))) for i in range(40)]
    few = [row(2000 + i, " ".join(f"u{i}x{k}###" for k in range(20)), "fr") for i in range(40)]
    marks = labels_table(spark, [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad + few])
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_rules(spark.createDataFrame(good + bad + few, SCHEMA), marks).collect()}
    assert all(kept[r[0]] for r in good) and not any(kept[r[0]] for r in bad)
    assert all(kept[r[0]] for r in few)  # no good labels in that stratum, so nothing is certain enough


def test_binomial_bound(spark):
    from math import comb

    for n in (0, 1, 300, 1000):
        k = spark.range(1).select(rules.most_errors(F.lit(n).cast("long"), 0.01, F.lit(0.01)).alias("k")).first()["k"]
        cdf = lambda m: sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(m + 1))  # noqa: B023, E731
        assert (k < 0 or cdf(k) <= 0.01) and (n == 0 or cdf(k + 1) > 0.01)


# 6 ------------------------------------------------------------------------------------------------------------------


def brute_spans(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_on_random_texts():
    r = random.Random(9)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "a@b.co", "x.y@z", "@", "+49 30 1234567", "+", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "0001.2.3.4", " ", "\n", ".", "-", "12", "abc", "é", "_"]
    for _ in range(4000):
        t = "".join(r.choices(bits, k=r.randint(1, 9)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_personal_data(docs, rows, nothing):
    found = pii.find_personal(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r["pii_base"]] == brute_spans(r["text"] or "")
        for s in r["pii_added"]:
            assert all(s["end"] <= b["start"] or b["end"] <= s["start"] for b in r["pii_base"])
    assert pii.find_personal(nothing).collect() == []


def test_field_learns_types_and_boundaries():
    r = random.Random(2)
    hexes = lambda: "".join(r.choices("0123456789abcdef", k=40))
    train = [f'use token = "{hexes()}" here' for _ in range(60)] + [f"call +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} now" for _ in range(60)]
    train += [f"number {r.randint(10**15, 10**16 - 1)} here" for _ in range(150)] + [f"in {r.randint(1900, 2030)} there" for _ in range(40)]
    field = pii.fit(train)
    secret = hexes()
    assert pii.field_spans(field, f'my token = "{secret}" ok') == [("secret", 12, 52)]
    assert pii.field_spans(field, "call +1 (555) 555-0199 now") == [("phone", 5, 22)]
    assert pii.field_spans(field, "born in 1987, moved in 2001") == []


# 7 ------------------------------------------------------------------------------------------------------------------


def test_licenses(spark, nothing):
    mit = licenses.TEMPLATES["mit-grant"]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k not in (10, 11))
    half = " ".join(mit.split()[:20])
    filler = " ".join(f"f{k}" for k in range(500))
    table = [row(1, f"{filler} {mit} {filler}"), row(2, f"{filler} {cut}"), row(3, half), row(4, "RELEASED under### the MIT\nLicense!"), row(5, None), row(6, ""), row(7, filler)]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.find_licenses(spark.createDataFrame(table, SCHEMA)).collect()}
    assert set(got) == {(1, "mit-grant"), (2, "mit-grant"), (4, "mit")} and got[1, "mit-grant"] == 1.0 and 0.75 <= got[2, "mit-grant"] < 1
    assert licenses.find_licenses(nothing).collect() == []
    assert licenses.find_licenses(nothing, {"none": " "}).collect() == []


# 8 ------------------------------------------------------------------------------------------------------------------


def test_shards(docs, rows, nothing):
    got = sharding.shard_documents(docs, shards=6).collect()
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sizes == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing, shards=6).collect() == []


def test_shards_are_even_in_spite_of_a_hot_group(spark):
    table = [row(i, "same text " * 20, "en", "hot") for i in range(1500)] + [row(5000 + i, f"own {i} " * (5 + i % 40), "de", f"s{i % 3}") for i in range(1500)]
    got = defaultdict(int)
    for r in sharding.shard_documents(spark.createDataFrame(table, SCHEMA), shards=5).collect():
        got[r["shard"]] += r["size"]
    mean = sum(got.values()) / 5
    assert len(got) == 5 and all(abs(b - mean) < 0.01 * mean for b in got.values())


# 9 ------------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    r = random.Random(8)
    prose = lambda: " ".join("".join(r.choices("etaoin", k=r.randint(2, 8))) for _ in range(r.randint(30, 90))).capitalize() + "."
    junk = lambda: " ".join("".join(r.choices("ETAOIN", k=4)) + "!!" for _ in range(r.randint(30, 90)))
    texts = [(i, prose() if i % 5 else junk()) for i in range(1500)] + [(2000, None), (2001, ""), (2001, "")]
    table = spark.createDataFrame([row(i, t) for i, t in texts] + [row(None, prose())], SCHEMA)
    marks = labels_table(spark, [(i, int(i % 5 > 0), 0) for i in range(0, 1500, 2)] + [(0, None, 0), (None, 1, 0)])
    got = pu.classify(table.drop("score"), marks).select("doc_id", "quality_score", "quality_ok", pu.held_out().alias("held_out")).collect()
    assert len(got) == len(texts) + 1 and all(0 <= x["quality_score"] <= 1 for x in got)
    held = [(x["doc_id"] % 5 > 0) == x["quality_ok"] for x in got if x["held_out"] and x["doc_id"] < 1500]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got if x["doc_id"] is not None)
    assert len(held) > 300 and sum(held) / len(held) > 0.97


def test_classifier_without_labels_or_rows(spark, docs, nothing):
    assert all(r["quality_ok"] for r in pu.classify(docs, labels_table(spark, [])).collect())
    assert pu.classify(nothing, labels_table(spark, [(1, 1, 0)])).collect() == []


# 10 -----------------------------------------------------------------------------------------------------------------


def reference_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(docs, rows, nothing):
    t = reference_tokenizer()
    got = bpe.tokenize(docs).collect()
    want = sorted((str(r[0]), t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert sorted(r["decoded"] for r in got) == sorted(r[1] or "" for r in rows)
    assert bpe.tokenize(nothing).collect() == []


def test_bpe_on_random_texts():
    t = reference_tokenizer()
    with open(bpe.default_vocabulary(), "rb") as f:
        v = bpe.Vocabulary(f.read())
    r = random.Random(1)
    kinds = [lambda: r.randrange(0x20, 0x300), lambda: r.randrange(0x3100), lambda: r.randrange(0x1F300, 0x1F700), lambda: 32, lambda: 10, lambda: r.randrange(97, 123)]
    texts = ["".join(chr(r.choice(kinds)()) for _ in range(r.randint(1, 40))) for _ in range(1500)] + ["a" * 3000 + "b" * 1500, "<|endoftext|><|endoftext|> x"]
    import numpy as np
    import pyarrow as pa

    ids = [np.frombuffer(v.encode(x), np.int32).tolist() for x in texts]
    assert ids == [t.encode(x, add_special_tokens=False).ids for x in texts]
    broken = [[x for x in i if r.random() < 0.7] for i in ids]
    assert bpe.decode_batch(v, pa.array(broken, pa.list_(pa.int32()))).to_pylist() == [t.decode(i, skip_special_tokens=False) for i in broken]
    assert bpe.decode_batch(v, pa.array([None, [], [-1, 70000, None, 64]], pa.list_(pa.int32()))).to_pylist() == ["", "", t.decode([64], skip_special_tokens=False)]
