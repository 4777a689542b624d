"""Repair of damaged conversations by the cheapest edits.

Rows of a conversation pass by in order. A survivor for each state (nothing yet, after system, after user, after assistant)
is the cheapest edit sequence that ends there, ties to the least edits as text. Survivors are leaves of a tree of back
pointers with reference counts: a node that no survivor needs goes, and as soon as all survivors share an ancestor its edits
are final and leave the tree. What stays in memory is the stretch on which survivors still differ.

Edit sequences of two survivors never are a prefix of one another, because each ends with the edit of the same row. So one
order of the survivors, carried along, is the order of their complete unresolved suffixes, and settles every tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import SPACES, read_table

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing written, a system row, a user row, an assistant row last. A conversation may end in the first or the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a written role leads to from each state.
FOLLOWS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: BEHIND[q][p]: what it costs at most to go on from state q in place of state p.
BEHIND = (
    (0, 0, 2, 0),
    (4, 0, 2, 4),
    (5, 2, 0, 2),
    (3, 0, 2, 0),
)
#: Rows of a result batch.
BATCH = 1024


def _inserted(state: int) -> Iterator[tuple[int, str, int]]:
    """States that inserted rows lead to: state, edits, cost. More than it takes to reach each state never pays."""
    text, cost, seen = "", 0, set()
    while state not in seen:
        seen.add(state)
        yield state, text, cost
        state, text, cost = (ASSISTANT if state == USER else USER), text + "I", cost + INSERT


@lru_cache(maxsize=64)
def moves(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, list[tuple[int, int, str]]]]:
    """For each new state the ways there by a row's edit and inserts before it: old state, cost, edits."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for old in range(4):
        for state, text, cost in _inserted(old):
            ways = [(state, cost + DELETE, text + "D")]
            if not must_go:
                stays = cost + TRUNCATED * truncated
                if state in FOLLOWS.get(initial, ()):
                    ways.append((FOLLOWS[initial][state], stays + KEEP, text + "K"))
                ways.append((ASSISTANT if state == USER else USER, stays + REROLE, text + "R"))
            for new, c, t in ways:
                best[old, new] = min(best.get((old, new), (c, t)), (c, t))
    by_new: list[tuple[int, list[tuple[int, int, str]]]] = []
    for new in range(4):
        ways = [(old, *best[old, new]) for old in range(4) if (old, new) in best]
        if ways:
            by_new.append((new, ways))
    return by_new


#: From each state to an end: cost and edits.
ENDINGS = {state: min((c, t) for s, t, c in _inserted(state) if s in (NOTHING, ASSISTANT)) for state in range(4)}


class Node:
    """A row's edits on some survivor's way. ``kids``: the nodes that refer to it, whose number is its reference count."""

    __slots__ = ("edits", "kids", "parent", "row")

    def __init__(self, parent: Node | None, edits: str, row: tuple):
        self.parent, self.edits, self.row, self.kids = parent, edits, row, []


class Repair:
    """Takes the rows of one conversation one by one and gives out edits as soon as they are final."""

    def __init__(self) -> None:
        self.root = Node(None, "", ())
        #: state -> (cost, place among the survivors' edits as text, leaf)
        self.survivors: dict[int, tuple[int, int, Node]] = {NOTHING: (0, 0, self.root)}
        self.state = NOTHING

    def take(self, role: str, text: str, must_go: bool, truncated: bool) -> list[tuple[str, str, str]]:
        row = (role, text)
        now, found = self.survivors, []
        for new, ways in moves(role[:1] if role[:1] in FOLLOWS else "", must_go, truncated):
            there = [(now[old][0] + cost, now[old][1], edits, new, old) for old, cost, edits in ways if old in now]
            if there:
                found.append(min(there))
        kept = [x for x in found if all(y[0] + BEHIND[y[3]][x[3]] >= x[0] for y in found)]
        kept.sort(key=lambda x: x[1:3])  # by the older edits, then this row's
        after = {}
        for place, (cost, _, edits, new, old) in enumerate(kept):
            parent = now[old][2]
            leaf = Node(parent, edits, row)
            parent.kids.append(leaf)
            after[new] = (cost, place, leaf)
        for _, _, leaf in now.values():
            self._release(leaf)
        self.survivors = after
        return self._settled()

    def _release(self, node: Node) -> None:
        while not node.kids and node is not self.root:
            parent = node.parent
            parent.kids.remove(node)
            node.parent = None
            node = parent

    def _settled(self) -> list[tuple[str, str, str]]:
        out: list[tuple[str, str, str]] = []
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            out += self._written(self.root)
        return out

    def _written(self, node: Node) -> list[tuple[str, str, str]]:
        """Edit, role and text of a node's edits; a deleted row's role and text are its own."""
        out = []
        for edit in node.edits:
            role, text = node.row if edit in "KRD" else ("", "")
            if edit != "D":
                kept = edit == "K"
                self.state = FOLLOWS[role[:1]][self.state] if kept else ASSISTANT if self.state == USER else USER
                role = role if kept else NAMES[self.state]
            out.append((edit, role, text))
        return out

    def end(self) -> tuple[int, list[tuple[str, str, str]]]:
        """The cost in all, and the edits that were open until the end."""
        ways = [(cost + ENDINGS[s][0], place, ENDINGS[s][1], s) for s, (cost, place, _) in self.survivors.items()]
        cost, _, edits, state = min(ways)
        node, path = self.survivors[state][2], []
        while node is not self.root:
            path.append(node)
            node = node.parent
        out = [x for n in reversed(path) for x in self._written(n)]
        return cost, out + self._written(Node(None, edits, ()))


def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, blank, duplicate, truncated, gone`` with a conversation's rows together and in order.

    The one shuffle is by conversation; windows and the last sort use its partitioning. ``gone`` marks rows that only tell that
    the conversation exists.
    """
    end = F.rtrim("text", F.lit(SPACES))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")) > 1
    placed = rows.repartition("conv_id").withColumn("seen", seen).withColumn("last", F.substring(end, -1, 1))
    blank = F.col("last") == ""
    shown = placed.select(
        "conv_id", "turn", "role", "text", blank.alias("blank"), (~blank & F.col("seen")).alias("duplicate"),
        (~blank & ~F.col("seen") & ~F.col("last").isin(".", "!", "?")).alias("truncated"), "gone",
    )
    return shown.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "duplicate")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Whether a row starts a conversation, and the row; rows come in order."""
    last: object = _conversations
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield row[0] != last, row
            last = row[0]


class Summary:
    """Counts of a conversation's faults, its edits and a running digest of what they leave."""

    def __init__(self, conv_id):
        self.conv_id, self.repair, self.digest = conv_id, Repair(), hashlib.sha256()
        self.least = self.most = self.role = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit: list[str] = []
        self.any = False

    def add(self, turn, role, text, blank, duplicate, truncated) -> None:
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.role is not None and self.role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role[:1]
        self.write(self.repair.take(role, text, blank or duplicate, truncated))

    def write(self, edits: list[tuple[str, str, str]]) -> None:
        for edit, role, text in edits:
            self.audit.append(edit)
            if edit != "D":
                self.digest.update(("\n" * self.any + role + ":" + text).encode())
                self.any = True

    def row(self) -> tuple:
        cost, edits = self.repair.end()
        self.write(edits)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


AUDIT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROWS = "conv_id bigint, place bigint, edit string, role string, text string"


def _as_batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield batch()
            held = []
    yield batch()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now: Summary | None = None
    for first, (conv_id, turn, role, text, blank, duplicate, truncated, gone) in _conversations(batches):
        if first:
            if now:
                yield now.row()
            now = Summary(conv_id)
        if not gone:
            now.add(turn, role, text, blank, duplicate, truncated)
    if now:
        yield now.row()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now, conv, place = None, None, 0
    for first, (conv_id, _, role, text, blank, duplicate, truncated, gone) in _conversations(batches):
        if first:
            if now:
                yield from ((conv, place + k, *x) for k, x in enumerate(now.end()[1]))
            now, conv, place = Repair(), conv_id, 0
        if not gone:
            for x in now.take(role, text, blank or duplicate, truncated):
                yield (conv, place, *x)
                place += 1
    if now:
        yield from ((conv, place + k, *x) for k, x in enumerate(now.end()[1]))


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows in the columns that repairs use. A null role or text counts as one space."""
    some = rows if "gone" in rows.columns and rows.schema["gone"].dataType.simpleString() == "boolean" else rows.withColumn("gone", F.lit(False))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return some.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), "gone")


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: every edit of every conversation in order; what is not D(eleted) is the repaired conversation.

    ``rows`` has ``conv_id, turn, role, text``; other columns are ignored. Rows are taken by turn (nulls first), then role and
    text. Blank rows and repeated ones (role and text as in an earlier row) go; the others are kept, get another role or go, and
    rows without text are put in, at the least cost, so that roles alternate and end with the assistant. Roles count by their
    first letter; an empty role is none of these. Rows without conv_id form one conversation. An empty table gives no rows.
    A conversation passes through one task, a row at a time, and is never held whole unless its edits stay open to its end.
    """
    return ordered(_prepared(rows)).mapInArrow(lambda batches: _as_batches(_edited(batches), ROWS), ROWS)


def audit(rows: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cost and text of its edits, and the digest of what they leave; see ``repaired``.

    A boolean column ``gone`` marks rows that count as absent; a conversation of such rows has zeros, no edits, and the digest
    of an empty text.
    """
    return ordered(_prepared(rows)).mapInArrow(lambda batches: _as_batches(_summaries(batches), AUDIT), AUDIT)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with damage by the checksum of ``conv_id:turn``; a null value counts as one space, dropped rows are marked ``gone``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    some = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return some.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damaged(read_table(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda x: 0::UBIGINT)),
       lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kind AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::UBIGINT)),
         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)::INT])), 4294967295::UBIGINT) % 20 AS d FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kind WHERE d <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dam),
flag AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
f AS (SELECT conv_id, turn, role, text, i, before, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND ending NOT IN ('.', '!', '?') AS truncated FROM flag),
ins(old, q, c, t, doc) AS (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'),
      (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')),
ed(initial, e, q, new, c) AS (SELECT NULL::VARCHAR, 'D', q, q, 3 FROM range(4) r(q) UNION ALL SELECT NULL, 'R', q, CASE WHEN q = 2 THEN 3 ELSE 2 END, 2 FROM range(4) r(q)
      UNION ALL VALUES ('s', 'K', 0, 1, 0), ('u', 'K', 0, 2, 0), ('u', 'K', 1, 2, 0), ('u', 'K', 3, 2, 0), ('a', 'K', 2, 3, 0)),
v AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS state, {'c': 0::BIGINT, 'a': '', 'd': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT v.conv_id, v.i + 1, ed.new::BIGINT, min({'c': (v.best.c + ins.c + ed.c + CASE WHEN f.truncated AND ed.e <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'a': v.best.a || ins.t || ed.e,
             'd': v.best.d || ins.doc || CASE ed.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text WHEN 'R' THEN chr(10) || CASE WHEN ed.q = 2 THEN 'assistant' ELSE 'user' END || ':' || f.text END})
      FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1 JOIN ins ON ins.old = v.state JOIN ed ON ed.q = ins.q
      WHERE (ed.initial IS NULL OR ed.initial = f.role[1]) AND (ed.e = 'D' OR NOT (f.blank OR f.duplicate)) GROUP BY 1, 2, 3),
last AS (SELECT conv_id, max(i) AS n FROM v GROUP BY 1),
done AS (SELECT v.conv_id, min({'c': v.best.c + ins.c, 'a': v.best.a || ins.t, 'd': v.best.d || ins.doc}) AS b
         FROM v JOIN last ON last.conv_id IS NOT DISTINCT FROM v.conv_id AND v.i = last.n JOIN ins ON ins.old = v.state AND ins.q IN (0, 3) GROUP BY 1),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
      count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT d.conv_id, coalesce(m.gaps, 0)::BIGINT AS gaps, coalesce(m.blank, 0)::BIGINT AS blank, coalesce(m.duplicate, 0)::BIGINT AS duplicate, coalesce(m.truncated, 0)::BIGINT AS truncated,
       coalesce(m.illegal, 0)::BIGINT AS illegal, d.b.c::BIGINT AS cost, d.b.a AS audit, sha256(d.b.d[2:]) AS repaired_sha256
FROM done d LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM d.conv_id
"""
