"""Exact duplicates against plain grouping: several batches, restarts, digests that collide, nulls and repeated rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from formloom.llm import exact

SCHEMA = "doc_id bigint, text string, path string, at string, digest int, size string, keep_id string, _metadata string"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[fold(text)].append(doc_id)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), i == keep and first))
            first = first and i != keep
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    texts = ["", None, "A b", "a B", "É", "é", "x" * 200_000, "X" * 200_000, "x" * 200_001, "c\x00d", " ", "a b ", "日本"]
    out = [(i, r.choice(texts) if i % 2 else f"own {i // 4}") for i in range(200)]
    return out + [(300, "same row"), (300, "same row"), (301, "Same row"), (302, "only once"), (302, "another text"), (None, "no id"), (None, "no id"), (None, "a b")]


def write(spark, rows, folder, files):
    frame = spark.createDataFrame([(*x, "p", "a", 1, "s", "k", "m") for x in rows], SCHEMA)
    frame.repartition(files).write.mode("append").parquet(folder)


def shown(found):
    return sorted((tuple(x) for x in found.select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)


@pytest.mark.parametrize("digest", [exact.sha256, lambda data: bytes([len(data) % 3])])
def test_classes_even_where_digests_collide(spark, rows, tmp_path, digest):
    write(spark, rows, f"{tmp_path}/t", 5)
    got = exact.duplicates(spark, f"{tmp_path}/t", digest=digest, batch_bytes=1)
    assert shown(got) == expected(rows)


def test_state_outlives_the_stream(spark, rows, tmp_path):
    folder, checkpoint = f"{tmp_path}/t", f"{tmp_path}/state"
    write(spark, rows[:120], folder, 2)
    assert shown(exact.duplicates(spark, folder, checkpoint)) == expected(rows[:120])
    write(spark, rows[120:], folder, 3)
    assert shown(exact.duplicates(spark, folder, checkpoint)) == expected(rows)
    assert exact.remembered(spark, checkpoint).agg(F.sum("size")).first()[0] == len(rows)
    assert shown(exact.duplicates(spark, folder, checkpoint)) == expected(rows)  # nothing new: nothing counts twice


def test_unique_keeps_the_table_columns(spark, rows, tmp_path):
    write(spark, rows, f"{tmp_path}/t", 2)
    kept = exact.unique(spark, f"{tmp_path}/t")
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(fold(x["text"]) for x in kept.collect()) == sorted({fold(t) for _, t in rows})


def test_digest_and_empty_table(spark, tmp_path):
    write(spark, [(1, "ABC É")], f"{tmp_path}/t", 1)
    assert bytes(exact.duplicates(spark, f"{tmp_path}/t").first()["digest"]) == hashlib.sha256("abc É".encode()).digest()
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/none")
    assert exact.duplicates(spark, f"{tmp_path}/none").count() == 0
