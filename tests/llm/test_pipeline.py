"""The pipeline against plain Python on a small fixture, and the registered queries' columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from formloom.llm import bpe, mixing, pii, pu
from formloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_llm_operators import WORD, brute_components, expected_mix, reference_tokenizer, size_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = ["".join(r.choices("etaoinshr", k=r.randint(2, 7))) for _ in range(400)]
    prose = lambda: " ".join(r.choices(vocab, k=r.randint(20, 60))).capitalize() + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in r.choices(vocab, k=30))
    rows = []
    for i in range(260):
        text = junk() if i % 6 == 0 else prose()
        if i % 9 == 1:
            text += f" mail me.{i}@site{i % 4}.example.com or 10.1.{i % 250}.7 "
        if i % 13 == 2 and rows:
            text = rows[-1][1] if i % 2 else rows[-1][1] + " extra"
        rows.append((i, text, "en", f"s{i % 4}" if i % 3 else "s0", len(text)))
    rows += [(900, None, "en", "s1", None), (901, "", None, None, 0), (902, " \n ", "de", None, 3)]
    path = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i % 6 > 0), 0) for i in range(0, 260, 2)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def redact(text, spans):
    out, at = "", 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def plain_mix(rows):
    """Documents with the words each epoch takes of them, one entry an epoch."""
    sizes, target = expected_mix([(r[0], r[1], r[2], r[3]) for r in rows])
    out = []
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((hashlib.md5(f"0:{r[0]}".encode()).hexdigest(), r[0], size_of(r[1]), r))
    for s, members in by_source.items():
        budget = min(int(target[s] + 0.5), 3 * sizes[s])
        epochs = budget // sizes[s] if sizes[s] else 0
        rest, start = budget - epochs * sizes[s], 0
        for _, _, n, r in sorted(members, key=lambda m: m[:3]):
            out += [(r, n)] * epochs
            if sizes[s] and (start + n <= rest if n else start <= rest) and start + n <= rest:
                out.append((r, n))
            elif sizes[s] and start < rest:
                out.append((r, rest - start))
            start += n
    return out


def cut(text, n):
    if n >= size_of(text):
        return text
    ends = [m.end() for m in WORD.finditer(text)]
    return text[: ends[n - 1]] if n else ""


def test_pipeline_equals_plain_python(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = pu.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    x = np.array([pu.text_features(r[1]) for r in rows], np.float32).astype(np.float64)
    rows = [r for r, z in zip(rows, model.logits(x)) if z >= 0]
    kept = {i for i, (_, c) in brute_components([(r[0], r[1]) for r in rows]).items() if i == c}
    rows = [r for r in rows if r[0] in kept]
    field = pii.train(spark.createDataFrame(rows, DOCS))
    clean = []
    for r in rows:
        base = pii.base_spans(r[1] or "")
        spans = base + pii.added_spans(field, r[1] or "", base)
        text = redact(r[1], spans) if spans else r[1]
        clean.append((r[0], text, r[2], r[3], len(text) if spans else r[4]))
    assert any("[EMAIL]" in (r[1] or "") for r in clean) and any("[IP]" in (r[1] or "") for r in clean)
    t = reference_tokenizer()
    want = sorted((r[0], t.encode(cut(r[1] or "", n), add_special_tokens=False).ids) for r, n in plain_mix(clean) if size_of(r[1]))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got if r["ids"] and r["doc_id"] < 900) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.where("false"), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), path).count() == 0


def test_registry():
    assert sorted(re.match(r"op(\d+)_", n)[1] for n in QUERIES if n.startswith("op")) == sorted(map(str, range(1, 14)))
    assert set(ORACLES) <= set(QUERIES) and QUERIES["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert mixing.WEIGHTS == (5, 2, 1) and bpe.LONG_WORD > 0
