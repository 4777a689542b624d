"""Repairs against a search over whole edit sequences, and the damage and counts against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from formloom.llm import turns

SOLID = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, edit string, place int, gone string, last string"


def search(rows):
    """Cheapest cost, then least edits: all states after each row with the least (cost, edits), up to three inserts anywhere."""
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for state, (cost, edits, out) in list(states.items()):
                name = "assistant" if state == "u" else "user"
                new = (cost + 2, edits + "I", (*out, name + ":"))
                if name[0] not in states or new < states[name[0]]:
                    states[name[0]] = new
        return states

    now = {"": (0, "", ())}
    for role, text, must_go, truncated in rows:
        after = {}
        for state, (cost, edits, out) in inserted(now).items():
            ways = [(state, 3, "D", ())]
            if not must_go:
                if role[:1] and role[:1] in grammar[state]:
                    ways.append((role[0], truncated, "K", (f"{role}:{text}",)))
                ways += [(name[0], 2 + truncated, "R", (f"{name}:{text}",)) for name in ("user", "assistant") if name[0] in grammar[state]]
            for new, c, e, o in ways:
                way = (cost + c, edits + e, out + o)
                if new not in after or way < after[new]:
                    after[new] = way
        now = after
    return min(v for k, v in inserted(now).items() if k in ("", "a"))


def expected(rows):
    """Of damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked = set(), []
    blank = duplicate = truncated = 0
    for _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (fault == "b"), duplicate + (fault == "d"), truncated + (fault == "t")
        marked.append((role, text, fault in ("b", "d"), fault == "t"))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, edits, out = search(marked)
    return (gaps, blank, duplicate, truncated, sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]  # also where all rows go
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for conv in range(150):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ultra"])
            out.append((conv, r.choice([turn, turn, turn + 3, None]), role, r.choice(["Yes.", "No", "Why? ", "", " \t", None, "ü.", "a\nb!", "x" * 5000 + "."])))
    out += [(900, t, "user", f"only users {t // 2}.") for t in range(60)] + [(901, t, ("user", "assistant")[t % 2], f"clean {t}.") for t in range(200)]
    return out + [(None, 1, "user", "no id."), (None, 2, "assistant", "none"), (902, None, "user", "a."), (902, None, "assistant", "b.")]


def test_audit_matches_a_search_over_whole_sequences(spark, rows):
    frame = spark.createDataFrame([(*x, "e", 1, "g", "l") for x in rows], SCHEMA).repartition(3)
    got = {x[0]: tuple(x)[1:] for x in turns.audit(turns.damaged(frame)).collect()}
    assert got == {conv: expected(some) for conv, some in damage(rows).items()}
    plain = defaultdict(list)
    for conv, turn, role, text in rows:
        plain[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got = {x[0]: tuple(x)[1:] for x in turns.audit(frame).collect()}
    assert got == {conv: expected(some) for conv, some in plain.items()}


def test_repaired_rows_carry_the_edits_and_texts(spark, rows):
    frame = spark.createDataFrame([(*x, "e", 1, "g", "l") for x in rows], SCHEMA)
    audits = {x["conv_id"]: x for x in turns.audit(frame).collect()}
    found = defaultdict(list)
    for x in turns.repaired(frame).collect():
        found[x["conv_id"]].append((x["place"], x["edit"], x["role"], x["text"]))
    for conv, audit in audits.items():
        edits = sorted(found[conv])
        assert [e[0] for e in edits] == list(range(len(edits)))
        assert "".join(e[1] for e in edits) == audit["audit"]
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, e, r, t in edits if e != "D").encode()).hexdigest() == audit["repaired_sha256"]


def test_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert turns.audit(turns.damaged(nothing)).count() == turns.repaired(nothing).count() == 0


def test_edits_leave_the_tree_once_survivors_agree():
    def open_nodes(repair):
        seen, todo = 0, [repair.root]
        while todo:
            node = todo.pop()
            seen, todo = seen + 1, todo + node.kids
        return seen

    repair, given, most = turns.Repair(), 0, 0
    for t in range(5000):
        given += len(repair.take(("user", "assistant")[t % 2] if t % 50 else "user", f"{t}.", t % 70 == 3, t % 9 == 0))
        most = max(most, open_nodes(repair))
    assert given > 4900 and most < 150


def test_survivors_order_is_that_of_their_complete_suffixes():
    r = random.Random(2)
    for _ in range(200):
        repair = turns.Repair()
        for t in range(r.randint(1, 40)):
            repair.take(r.choice(["system", "user", "user", "assistant", "x"]), f"{t}", r.random() < 0.1, r.random() < 0.3)
            texts = []
            for _, place, leaf in repair.survivors.values():
                suffix = ""
                while leaf is not repair.root:
                    suffix, leaf = leaf.edits + suffix, leaf.parent
                texts.append((suffix, place))
            assert [p for _, p in sorted(texts)] == sorted(p for _, p in texts)
