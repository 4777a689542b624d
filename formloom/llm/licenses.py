"""License scans by MinHash bands over overlapping text windows.

Texts are read in windows of a few sizes that overlap so far that each stretch of a template's length lies whole in one of
them. A window's minima, in bands, retrieve templates; exact containment of the template's shingles in the window decides.
Windows without a single template shingle cannot match and are not hashed.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from formloom.llm.common import by_slices, read_table
from formloom.llm.shingles import Minima, hashes, windows

#: A window that holds 75 % of a template has at least Jaccard 0.29 with it and misses 128 bands of 2 with probability 1e-5.
BANDS, ROWS = 128, 2
CONTAINMENT = 75
#: Windows of a size begin this part of their length apart.
STEPS = 8
DROPPED = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""

# Wordings of public licenses and their notices.
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "apache-2.0-header": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def shingles(text: str | None) -> np.ndarray:
    """Hashes of five-word windows in order; words lose punctuation and the case of A-Z."""
    return windows(hashes((text or "").encode().lower().translate(None, DROPPED).split()))


def window_size(n: int) -> int:
    """The power of two of which seven eighths hold n shingles."""
    return 1 << max(0, (-(-n * STEPS // (STEPS - 1)) - 1).bit_length())


def band_keys(sets: list[np.ndarray], minima: Minima) -> np.ndarray:
    """A row of band hashes for each set."""
    m = np.ascontiguousarray(minima.of(sets).reshape(len(sets), BANDS, ROWS))
    return np.array([[xxhash.xxh3_64_intdigest(x[k].tobytes(), k) for k in range(BANDS)] for x in m], np.uint64).view(np.int64)


WINDOWS = ArrayType(StructType([StructField("size", IntegerType()), StructField("start", IntegerType()), StructField("bands", ArrayType(LongType())), StructField("items", ArrayType(LongType()))]))


def scan(vocabulary: np.ndarray, sizes: list[int]) -> Column:
    """From a text to its windows that hold template shingles: size, first shingle, band hashes, and those shingles in order."""

    minima = Minima(BANDS * ROWS)

    def some(texts: list) -> pa.Array:
        out = []
        for text in texts:
            h, rows, sets = shingles(text), [], []
            known = np.isin(h, vocabulary)
            hits = np.flatnonzero(known)
            for size in sizes if len(hits) else ():
                step = max(1, size // STEPS)
                first = np.maximum(0, (hits - size) // step + 1)
                for k in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, hits // step)])):
                    part = slice(int(k) * step, int(k) * step + size)
                    rows.append((size, part.start, h[part][known[part]].view(np.int64)))
                    sets.append(np.unique(h[part]))
            keys = band_keys(sets, minima) if sets else ()
            out.append([{"size": s, "start": a, "bands": b, "items": i} for (s, a, i), b in zip(rows, keys)])
        return pa.array(out, pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int32()), ("bands", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])))

    @F.arrow_udf(WINDOWS)
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(some, texts)

    return run


def find_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, percent: int = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, first_word, last_word`` for each template of which a window holds ``percent`` or more.

    Templates are a parameter of the caller's size, some thousand at most; their hashes go to every task. Those of fewer than
    five words are one shingle; empty ones are left out. A document's best window counts, ties to the earliest. Null and empty
    texts match nothing; repeated rows of a doc_id give one row a template; other columns are ignored.
    """
    spark = docs.sparkSession
    known = {name: np.unique(s) for name, text in (templates or TEMPLATES).items() if len(s := shingles(text))}
    if not known:
        return spark.createDataFrame([], "doc_id bigint, license string, containment double, first_word int, last_word int")
    keys = band_keys(list(known.values()), Minima(BANDS * ROWS))
    rows = [(name, window_size(len(s)), [int(x) for x in s.view(np.int64)], [int(x) for x in k]) for (name, s), k in zip(known.items(), keys)]
    table = spark.createDataFrame(rows, "license string, t_size int, t_items array<bigint>, t_bands array<bigint>")
    vocabulary = np.unique(np.concatenate(list(known.values())))
    found = docs.select("doc_id", F.explode(scan(vocabulary, sorted({r[1] for r in rows}))(F.col("text"))).alias("w")).select("doc_id", "w.*")
    filed = found.select("doc_id", "size", "start", "items", F.explode("bands").alias("band"))
    retrieved = filed.join(
        F.broadcast(table.select("license", "t_size", F.explode("t_bands").alias("t_band"))), (F.col("band") == F.col("t_band")) & (F.col("size") == F.col("t_size"))
    )
    pairs = retrieved.select("doc_id", "size", "start", "items", "license").distinct()
    both = pairs.join(F.broadcast(table.select(F.col("license").alias("t_license"), "t_items")), F.col("license") == F.col("t_license"))
    common = F.size(F.array_intersect("items", "t_items"))
    sure = both.withColumn("common", common).where(F.col("common") * 100 >= F.size("t_items") * percent)
    share = F.col("common") / F.size("t_items")
    best = F.max_by(F.struct(share.alias("containment"), F.col("start").alias("first_word"), (F.col("start") + F.col("size") + 3).alias("last_word")), F.struct(share, -F.col("start")))
    return sure.groupBy("doc_id", "license").agg(best.alias("b")).select("doc_id", "license", "b.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: how many templates it holds, which, and how much of each."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_licenses(docs)
    shown = F.concat_ws(":", "license", F.format_number("containment", 3), "first_word", "last_word")
    listed = found.groupBy(F.col("doc_id").alias("f_doc")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(shown)), ",").alias("matches"))
    every = docs.select("doc_id")
    return every.join(listed, F.col("doc_id") == F.col("f_doc"), "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_licenses"), F.coalesce("matches", F.lit("")).alias("matches"))
