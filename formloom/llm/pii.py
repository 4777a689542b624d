"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. The random field scores whole candidate segments (their length, digits, separators, checksums and
surroundings) and dynamic programming over segments of bounded length chooses boundaries and types together. Its weights
maximise the conditional likelihood of a bounded sample of islands, text around digits and at-signs, labelled by the patterns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from formloom.llm.common import by_slices, read_table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# The patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Labels secrets in the training islands: a value given to a telling name.
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_-]{16,})")
DIGIT_RUN = re.compile(r"[0-9][0-9.]*")
TRIGGER = re.compile(r"[0-9@]+")
BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")
#: A long value after a colon or equals sign, and the telling names that may stand before it.
VALUE = re.compile(r"[:=]\s{0,3}[\"']?[A-Za-z0-9+/_-]{16,}")
TELLING = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\b[\"']?\s{0,3}$")
PIECE = re.compile(r"\w+|\s+|[^\w\s]")
SPACE = " \t\n\r\x0b\x0c"
#: Pieces in a segment at most.
LONGEST = 13
#: Characters between triggers of one island at most.
APART = 12

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def _chunk(text: str, at: int) -> tuple[int, int]:
    """The stretch without white space around a place. No more of the text is looked at than a few times the stretch."""
    start, reach = 0, 64
    while not start and reach < 4 * at + 256:
        start = 1 + max(text.rfind(c, max(0, at - reach), at) for c in SPACE)
        reach *= 4
    blank = BLANK.search(text, at)
    return start, blank.start() if blank else len(text)


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start. Patterns only run where a character that they need occurs."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:  # an address has no white space, so each stretch can be searched on its own
        start, end = _chunk(text, at)
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text, start, end)]
        at = text.find("@", end)
    for run in DIGIT_RUN.finditer(text):
        if run[0].count(".") >= 3:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text, run.start(), run.end()) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _opening(text: str) -> Iterator[tuple[int, int]]:
    """Stretches, in order, around digits and at-signs and from telling names to the end of their values."""
    named = ((a.start(), _chunk(text, m.end() - 1)[1]) for m in VALUE.finditer(text) if (a := TELLING.search(text, max(0, m.start() - 24), m.start())))
    named = ((_chunk(text, a)[0], b) for a, b in named)
    value, end = next(named, None), -1
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start, end = _chunk(text, m.start())
        while value and value[0] < start:
            yield value
            value = next(named, None)
        yield start, end
    while value:
        yield value
        value = next(named, None)


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold triggers near each other, widened to white space. Outside them no segment can be personal data."""
    start = end = -1
    for a, b in _opening(text):
        if start >= 0 and a - end > APART:
            yield start, end
            start = a
        start, end = (a if start < 0 else start), max(b, end)
    if start >= 0:
        yield start, end


def pieces(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    return [(m.start(), m.end(), m[0].isspace()) for m in PIECE.finditer(text, start, end)]


def span_features(text: str, a: int, b: int) -> list[str] | None:
    """Whole-span features of a candidate; None where no kind is possible."""
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    dots = s.count(".")
    longest = max((m.end() - m.start() for m in re.finditer(r"\w+", s)), default=0)
    if "@" not in s and len(digits) < 7 and not (dots >= 3 and len(digits) >= 4) and longest < 16:
        return None
    letters = sum(c.isalpha() for c in s)
    if letters and any(c.isspace() for c in s):
        return None
    before, after = text[max(0, a - 14) : a], text[b : b + 1]
    shape = "".join(sorted({c for c in s if not c.isalnum()}))[:6]
    out = ["bias", f"n={min(len(digits), 20)}", f"shape={shape}", f"letters={min(letters, 3)}", f"dots={min(dots, 5)}", f"l={min(int(math.log2(len(s))), 7)}"]
    out.append(f"next={after if after and not after.isalnum() else 'w' * bool(after)}")
    out.append(f"prev={before[-1:] if before and not before[-1].isalnum() else 'w' * bool(before)}")
    if "@" in s:
        left, _, right = s.partition("@")
        out += ["at", f"at_ok={bool(left) and '.' in right and '@' not in right and right.isascii() and left.isascii()}"]
    if not letters:
        out.append("no_letters")
        if 13 <= len(digits) <= 19:
            out += ["card_length", f"luhn={luhn(digits)}"]
        if dots == 3 and len(s) - 3 == len(digits):
            out.append(f"octets={all(p and len(p) < 9 and int(p) <= 255 for p in s.split('.'))}")
    if s[0] == "+":
        out += ["plus", f"plus_digits={9 <= len(digits) <= 15 and not letters}"]
    if longest >= 16 and longest == len(s):
        out += ["one_run", f"run={min(longest // 8, 8)}", f"mixed={bool(digits) and letters > 0}", f"hex={all(c in '0123456789abcdefABCDEF' for c in s)}"]
        out.append(f"named={bool(re.search(r'(?i)(token|secret|passw|key)\W*$', before))}")
    return out


@dataclass
class Field:
    """Weights by feature, a number a kind; ``touching``: a segment right after another."""

    weights: dict[str, np.ndarray]
    touching: float = 0.0

    def score(self, features: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total


Lattice = tuple[int, list[tuple[int, int, list[str]]], list[tuple[int, int, bool]]]


def lattice(text: str, start: int, end: int) -> Lattice:
    """The pieces of an island and its candidate segments (first piece, piece after the last, features)."""
    p = pieces(text, start, end)
    out = []
    for i, (a, _, blank) in enumerate(p):
        first = text[a]
        if blank or not (first.isalnum() or first in "+_"):
            continue
        for j in range(i + 1, min(i + LONGEST, len(p)) + 1):
            _, b, gap = p[j - 1]
            if gap or not (text[b - 1].isalnum() or text[b - 1] == "_"):
                continue
            if (f := span_features(text, a, b)) is not None:
                out.append((i, j, f))
    return len(p), out, p


def best_segments(field: Field, n: int, segments: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Viterbi over segments; state 1: a segment ended here. A piece outside all segments scores 0."""
    ending: list[list] = [[] for _ in range(n + 1)]
    for i, j, s in segments:
        k = int(s.argmax())
        ending[j].append((i, k, float(s[k])))
    best = [(0.0, -math.inf)] + [(0.0, 0.0)] * n
    back: list = [None] * (n + 1)
    for j in range(1, n + 1):
        out, was = max((best[j - 1][0], 0), (best[j - 1][1], 1))
        top, how = -math.inf, None
        for i, k, s in ending[j]:
            free, tied = best[i][0] + s, best[i][1] + s + field.touching
            if max(free, tied) > top:
                top, how = max(free, tied), (i, k, int(tied > free))
        best[j], back[j] = (out, top), (was, how)
    j, state, found = n, int(best[n][1] > best[n][0]), []
    while j > 0:
        was, how = back[j]
        if state:
            i, k, state = how
            found.append((i, j, k))
            j = i
        else:
            j, state = j - 1, was
    return found[::-1]


def _likelihood_step(field: Field, n: int, segments: list, gold: set[tuple[int, int, int]], rate: float) -> None:
    """One gradient step of an island's log likelihood, by the forward and backward sums over all segmentations."""
    scores = [field.score(f) for _, _, f in segments]
    totals = [float(np.logaddexp.reduce(s)) for s in scores]
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(segments):
        by_end[j].append(k)
        by_start[i].append(k)
    low, add = -1e300, lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -1e299 else max(a, b)
    f = [(0.0, low)] + [(low, low)] * n
    for j in range(1, n + 1):
        inside = low
        for k in by_end[j]:
            i = segments[k][0]
            inside = add(inside, totals[k] + add(f[i][0], f[i][1] + field.touching))
        f[j] = (add(*f[j - 1]), inside)
    b = [(low, low)] * n + [(0.0, 0.0)]
    for i in range(n - 1, -1, -1):
        free = b[i + 1][0]
        for_0, for_1 = free, free
        for k in by_start[i]:
            rest = totals[k] + b[segments[k][1]][1]
            for_0, for_1 = add(for_0, rest), add(for_1, rest + field.touching)
        b[i] = (for_0, for_1)
    whole = add(*f[n])
    touch = sum(any(g[0] == h[1] for h in gold) for g in gold)
    expected_touch = 0.0
    for k, (i, j, features) in enumerate(segments):
        inner = totals[k] + b[j][1] - whole
        p = math.exp(min(0.0, inner + add(f[i][0], f[i][1] + field.touching)))
        expected_touch += math.exp(min(0.0, inner + f[i][1] + field.touching))
        slope = -p * np.exp(scores[k] - totals[k])
        for g in gold:
            if g[:2] == (i, j):
                slope[g[2]] += 1
        if np.abs(slope).max() > 1e-4:
            for x in features:
                field.weights[x] = field.weights.get(x, 0.0) * (1 - rate * 1e-3) + rate * slope
    field.touching += rate * (touch - expected_touch)


def silver(text: str) -> list[Span]:
    """Labels for training: base spans and named secrets, without those that overlap earlier ones."""
    out: list[Span] = []
    for span in [*base_spans(text), *(("secret", m.start(1), m.end(1)) for m in SECRET.finditer(text))]:
        if all(span[2] <= s[1] or s[2] <= span[1] for s in out):
            out.append(span)
    return out


def fit(texts: list[str], epochs: int = 6) -> Field:
    """Trains on texts of one or few islands each. Without texts the field finds nothing."""
    field, examples = Field({"bias": np.full(len(KINDS), -2.0)}), []  # what was never seen is no entity
    for text in texts:
        labels = silver(text)
        for start, end in islands(text):
            n, segments, p = lattice(text, start, end)
            starts, ends = {a: k for k, (a, _, _) in enumerate(p)}, {b: k + 1 for k, (_, b, _) in enumerate(p)}
            gold = {(starts[a], ends[b], KINDS.index(kind)) for kind, a, b in labels if a in starts and b in ends}
            known = {(i, j) for i, j, _ in segments}
            if segments:
                examples.append((n, segments, {g for g in gold if g[:2] in known}))
    for epoch in range(epochs):
        for example in examples:
            _likelihood_step(field, *example, rate=0.2 / (1 + epoch))
    return field


def field_spans(field: Field, text: str) -> list[Span]:
    out = []
    for start, end in islands(text):
        n, candidates, p = lattice(text, start, end)
        scored = [(i, j, s) for i, j, f in candidates if (s := field.score(f)).max() > 0]
        out += [(KINDS[k], p[i][0], p[j - 1][1]) for i, j, k in (best_segments(field, n, scored) if scored else [])]
    return out


def added_spans(field: Field, text: str, base: list[Span]) -> list[Span]:
    """What the field finds beside the base spans, without overlap with them."""
    return [s for s in field_spans(field, text) if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def finder(field: Field) -> Column:
    """From a text to ``base`` and ``added``, spans by kind as listed, then start."""

    def some(texts: list) -> pa.Array:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))]
        whole = [t or "" for t in texts]
        base = [base_spans(t) for t in whole]
        added = [added_spans(field, t, b) for t, b in zip(whole, base)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(map(as_rows, x), kind) for x in (base, added)], ["base", "added"])

    @F.arrow_udf(StructType([StructField("base", SPANS), StructField("added", SPANS)]))
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(some, texts)

    return run


@F.arrow_udf(ArrayType(StringType()))
def training_texts(texts: pa.Array) -> pa.Array:
    """Islands of at most 300 characters with what stands before and after them."""
    cut = lambda t: [t[max(0, a - 24) : b + 8] for a, b in islands(t) if b - a <= 300]
    return pa.array([cut(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))


def train(docs: DataFrame, max_docs: int = 20000, max_islands: int = 1500) -> Field:
    """Fits on islands of at most ``max_docs`` documents, the first in hash order, ``max_islands`` of them in all."""
    place = F.xxhash64(F.lit("pii"), F.col("doc_id"))
    picked = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(place, "doc_id").limit(max_docs).withColumnRenamed("doc_id", "s_doc")
    # The sample has a fixed bound, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("s_doc")).where(F.col("text").rlike("[0-9@]"))
    found = rows.select(F.explode(training_texts(F.col("text"))).alias("t")).distinct().orderBy(F.xxhash64("t"), "t").limit(max_islands)
    return fit([r[0] for r in found.collect()])


def find_personal(docs: DataFrame, field: Field | None = None, **options) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_added`` (arrays of kind, start, end in code points, end exclusive).

    Whole texts are searched; null and empty ones have no spans. Base spans of different kinds may overlap; added ones
    overlap nothing. Rows keep their columns, but for columns of these two names, which are replaced; repeated rows are searched
    each. An empty table gives no rows.
    """
    field = field or train(docs, **options)
    own = [c for c in docs.columns if c not in ("pii_base", "pii_added")]
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), finder(field)(F.col("text")).alias("found"))
    return found.select("row.*", F.col("found.base").alias("pii_base"), F.col("found.added").alias("pii_added"))


@F.arrow_udf(StringType())
def redacted(texts: pa.Array, base: pa.Array, added: pa.Array) -> pa.Array:
    """Texts with each span, or group of overlapping spans, replaced by its first kind in brackets."""
    out = []
    for text, *spans in zip(texts.to_pylist(), base.to_pylist(), added.to_pylist()):
        parts, at = [], 0
        for s in sorted((x for y in spans for x in y or []), key=lambda x: (x["start"], -x["end"])):
            if s["start"] >= at:
                parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        out.append(text if not parts else "".join(parts) + text[at:])
    return pa.array(out, pa.string())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = F.array_sort(F.transform(F.concat("pii_base", "pii_added"), lambda s: F.struct(place[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    of_kind = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    secrets = F.size(F.filter("pii_added", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    added = F.size("pii_added").cast("long").alias("n_added")
    return found.select("doc_id", *[of_kind(k) for k in BASE_KINDS], secrets, added, F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(every).alias("spans"))
