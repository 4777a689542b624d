"""Parts that SQL cannot express, against enumeration: the random field, license windows, binomial cutoffs, and the risk's gradient."""

import math
import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from formloom.llm import licenses, pii, pu, rules


def segmentations(n, segments):
    """All sets of segments that do not overlap, each as a list of (index, kind)."""

    def grow(at):
        if at >= n:
            yield []
            return
        yield from grow(at + 1)
        for k, (i, j, _) in enumerate(segments):
            if i == at:
                for rest in grow(j):
                    for kind in range(len(pii.KINDS)):
                        yield [(k, kind), *rest]

    yield from grow(0)


def total(chosen, segments, scores, touching):
    ends = [segments[k][:2] for k, _ in chosen]
    return sum(scores[k][kind] for k, kind in chosen) + touching * sum(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def random_lattice(r):
    n = r.randint(1, 5)
    spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)]
    segments = [(i, j, [f"f{k}"]) for k, (i, j) in enumerate(r.sample(spans, min(len(spans), r.randint(1, 4))))]
    weights = {f"f{k}": np.array([r.gauss(0, 1.5) for _ in pii.KINDS]) for k in range(len(segments))}
    return n, segments, pii.Field(weights, r.gauss(0, 1))


def test_best_segments_are_the_best_of_all_segmentations():
    r = random.Random(1)
    for _ in range(150):
        n, segments, field = random_lattice(r)
        scores = [field.score(f) for _, _, f in segments]
        found = pii.best_segments(field, n, [(i, j, s) for (i, j, _), s in zip(segments, scores)])
        best = max(total(c, segments, scores, field.touching) for c in segmentations(n, segments))
        place = {s[:2]: k for k, s in enumerate(segments)}
        chosen = [(place[i, j], kind) for i, j, kind in found]
        assert abs(total(chosen, segments, scores, field.touching) - best) < 1e-9
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_likelihood_steps_follow_the_marginals_of_all_segmentations():
    r = random.Random(2)
    for _ in range(60):
        n, segments, field = random_lattice(r)
        scores, touching = [field.score(f) for _, _, f in segments], field.touching
        every = list(segmentations(n, segments))
        z = np.logaddexp.reduce([total(c, segments, scores, touching) for c in every])
        gold = r.choice(every)
        expected, touch = np.zeros((len(segments), len(pii.KINDS))), 0.0
        joined = lambda c: sum(segments[a[0]][1] == segments[b[0]][0] for a, b in zip(c, c[1:]))
        for c in every:
            p = math.exp(total(c, segments, scores, touching) - z)
            touch += p * joined(c)
            for k, kind in c:
                expected[k, kind] += p
        rate, before = 0.5, {f: w.copy() for f, w in field.weights.items()}
        pii._likelihood_step(field, n, segments, {(*segments[k][:2], kind) for k, kind in gold}, rate)
        for k in range(len(segments)):
            slope = -expected[k]
            slope[[kind for i, kind in gold if i == k]] += 1
            want = before[f"f{k}"] * (1 - rate * 1e-3) + rate * slope if np.abs(slope).max() > 1e-4 else before[f"f{k}"]
            assert np.allclose(field.weights[f"f{k}"], want, atol=1e-9)
        assert abs(field.touching - (touching + rate * (joined(gold) - touch))) < 1e-9


def test_licenses_match_all_windows_of_all_templates(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    templates = {f"t{k}": " ".join(r.choices(vocab, k=n)) for k, n in enumerate((6, 12, 30, 70))} | {"short": "two words"}
    texts = []
    for i in range(60):
        words = r.choices(vocab, k=r.randint(0, 150))
        for _ in range(r.randint(0, 2)):
            t = templates[r.choice(list(templates))].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = t
        texts.append(" ".join(words).upper() if i % 9 == 0 else " ".join(words) + ".")
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id bigint, text string")
    got = {(x["doc_id"], x["license"]): (round(x["containment"], 9), x["first_word"]) for x in licenses.find_licenses(docs, templates).collect()}
    want = {}
    for i, text in enumerate(texts):
        h = licenses.shingles(text)
        for name, template in templates.items():
            known = set(licenses.shingles(template).tolist())
            size = licenses.window_size(len(known))
            step = max(1, size // licenses.STEPS)
            best = max(((len(known & set(h[a : a + size].tolist())) / len(known), -a) for a in range(0, max(len(h), 1), step)), default=(0, 0))
            if best[0] * 100 >= licenses.CONTAINMENT:
                want[i, name] = (round(best[0], 9), -best[1])
    assert got == want and len(want) > 25


def test_cutoffs_follow_direct_binomial_sums(spark):
    rows = [(n, share, level) for n, share, level in product((0, 1, 5, 40, 200), (0.01, 0.05, 0.3), (0.001, 0.05, 0.5))]
    d = spark.createDataFrame(rows, "n bigint, share double, level double")
    for share in (0.01, 0.05, 0.3):
        for x in d.where(F.col("share") == share).select("n", "level", rules.most_errors(F.col("n"), share, F.col("level")).alias("k")).collect():
            sums = np.cumsum([math.comb(x["n"], k) * share**k * (1 - share) ** (x["n"] - k) for k in range(x["n"] + 1)])
            want = max((k for k in range(x["n"] + 1) if sums[k] <= x["level"] and k <= math.ceil(x["n"] * share)), default=-1) if x["n"] else -1
            assert x["k"] == want, (x, share)


def test_the_risk_falls_to_its_minimum():
    """The fitted weights of a small problem have a non-negative risk no random change lowers by much."""
    r = np.random.default_rng(5)
    pos, web = r.integers(0, 4, (300, 1)), np.concatenate([r.integers(0, 4, (240, 1)), r.integers(3, 8, (360, 1))])
    prior = 0.4

    def risk(w):
        zp, zu = w[pos].sum(axis=1) + w[-1], w[web].sum(axis=1) + w[-1]
        loss = lambda z: np.logaddexp(0, z).mean()
        return prior * loss(-zp) + max(0.0, loss(zu) - prior * loss(zp))

    w = pu._fit(pos, web, 8, prior, 1500, 1e-5)
    base = risk(w)
    assert base <= risk(np.zeros(9))
    assert min(risk(w + r.normal(0, 0.05, 9)) for _ in range(300)) > base - 0.01
