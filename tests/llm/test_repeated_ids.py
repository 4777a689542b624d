"""Repeated doc_ids, and stretches that personal data may start in."""

import random
import time

from formloom.llm import neardup, pii, pu

SCHEMA = "doc_id bigint, text string, n_chars bigint, component string, k_doc int, place int, row string"
A = " ".join(f"alpha{i}" for i in range(30))
B = " ".join(f"beta{i}" for i in range(30))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "c", 1, 2, "r") for i, t in rows], SCHEMA)


def test_texts_of_one_id_are_classes_of_their_own(spark):
    rows = [(1, A), (1, B), (2, A), (3, B), (4, A.upper()), (5, None), (5, ""), (6, "x"), (None, A), (7, B + " more"), (7, B + " more")]
    docs = frame(spark, rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in neardup.near_duplicates(docs).collect())
    want = [(1, 26, 1), (1, 26, 1), (2, 26, 1), (3, 26, 1), (4, 26, 1), (5, 0, 5), (5, 0, 5), (6, 1, 6), (7, 27, 1), (7, 27, 1)]
    assert got == [(False, *x) for x in want] + [(True, 0, 26, 0)]
    first = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(docs).collect())
    assert first == [(0, A), (1, A), (1, B), (5, ""), (6, "x")]
    again = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(docs.repartition(3)).collect())
    assert again == first and neardup.keep_one(docs).columns == docs.columns


def test_samples_count_an_id_once(spark):
    rows = [(1000, "hot text 12345 a@b.org")] * 60 + [(i, f"plain words {i} number {i}123456") for i in range(40)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1000, 1)] * 3, "doc_id bigint, quality int")
    seen = []
    fit, pu.fit_model = pu.fit_model, lambda p, w, **o: seen.append((len(p), len(w))) or fit(p, w, **o)
    try:
        pu.train(docs, labels, max_positives=10, max_web=20)
    finally:
        pu.fit_model = fit
    assert seen == [(10, 20)]
    texts = []
    train, pii.fit = pii.fit, lambda t, **o: texts.append(t) or train(t, **o)
    try:
        pii.train(docs, max_docs=20)
    finally:
        pii.fit = train
    assert len(texts[0]) >= 19


def test_islands_open_at_telling_names():
    for text in ("so password: correcthorsebatterystaple it is", 'api_key = "abcdefghijklmnopqrst"', "TOKEN:abcdefghijklmnopqrst,"):
        (start, end), = pii.islands(text)
        value = max(text.replace('"', " ").replace(":", " ").replace(",", " ").split(), key=len)
        assert start <= text.index(value) and text.index(value) + len(value) <= end
    assert list(pii.islands("a monkey: longwordwithoutanymeaning here")) == []
    both = "key=abcdefghijklmnopqrst " + "far away words " * 5 + "call 12345678 or secret: zyxwvutsrqponmlkjihg"
    spans = list(pii.islands(both))
    assert spans == sorted(spans) and spans[0][0] == 0 and spans[-1][1] == len(both)


def test_islands_take_linear_time():
    def seconds(n):
        text = "word x1 " * n
        began = time.perf_counter()
        sum(1 for _ in pii.islands(text))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 12 * seconds(10_000) + 0.2


def test_stretches_match_a_plain_search():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab1 \t\n@") if r.random() < 0.9 else "z" * r.randint(1, 400) for _ in range(60))
        for at in [k for k, c in enumerate(text) if c in "1@"]:
            start, end = at, at
            while start and text[start - 1] not in pii.SPACE:
                start -= 1
            while end < len(text) and text[end] not in pii.SPACE:
                end += 1
            assert pii._chunk(text, at) == (start, end)
