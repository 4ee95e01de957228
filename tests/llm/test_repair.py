"""Conversation repair against an exhaustive search of edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tsreg.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, tie string, piece int, end string, last string"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """Rows of one conversation after the damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def best_edits(rows, faults):
    """Least (cost, audit) by recursion over the rest of the turns and the role given last."""

    @lru_cache(maxsize=None)
    def best(k, last, inserted):
        # ``last``: initial of the role given last, "" before the first
        options = [(0, "")] if k == len(rows) and last in ("", "a") else []

        def give(price, edit, rest):
            if rest is not None:
                options.append((price + rest[0], edit + rest[1]))

        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if inserted < 3:
            for role in follows.replace("s", ""):
                give(2, "I", best(k, role, inserted + 1))
        if k < len(rows):
            give(3, "D", best(k + 1, last, 0))
            if faults[k] not in ("blank", "duplicate"):
                extra = int(faults[k] == "truncated")
                initial = rows[k][1][:1]
                if initial and initial in follows:
                    give(extra, "K", best(k + 1, initial, 0))
                for role in follows.replace("s", ""):
                    give(extra + 2, "R", best(k + 1, role, 0))
        return min(options) if options else None

    return best(0, "", 0)


def repaired(rows, audit):
    out, k = [], 0
    for edit in audit:
        last = out[-1][0][:1] if out else ""
        role = {"u": "assistant"}.get(last, "user")
        if edit == "I":
            out.append((role, ""))
        else:
            if edit != "D":
                out.append((rows[k][1] if edit == "K" else role, rows[k][2]))
            k += 1
    return out


def expected(conv, rows):
    faults = faults_of(rows)
    cost, audit = best_edits(tuple(rows), tuple(faults))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    fixed = repaired(rows, audit)
    assert SHAPE.match("".join(r[:1] for r, _ in fixed))
    return (
        conv,
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
    )


TEXTS = ["Yes.", "No!", "cut off", "", " \t\n", "Why?  ", "half a", "ünï.", "\x85", "end.\x1f"]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux"]


def conversations(rng, n, longest):
    out = []
    for conv in range(n):
        turn, rows = 0, []
        for _ in range(rng.randrange(1, longest)):
            turn += rng.choice([1, 1, 1, 2, 5])
            rows.append((conv, turn, rng.choice(ROLES), rng.choice([*TEXTS, None, f"text {rng.randrange(50)}."])))
        out.append(rows)
    return out


def result(spark, rows, segment):
    given = [(*row, "t", 1, "e", "l") for row in rows]
    random.Random(1).shuffle(given)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    found = repair.summaries(*repair.solved(repair.damaged(df), segment))
    return {row[0]: tuple(row) for row in found.collect()}


@pytest.mark.parametrize("segment", [512, 3, 1])
def test_cheapest_edits(spark, segment):
    """Whole conversations and such in pieces have the costs, audits and turns of the exhaustive search."""
    cases = conversations(random.Random(segment), 90, 11)
    found = result(spark, [row for rows in cases for row in rows], segment)
    assert len(found) == len(cases)
    for conv, rows in enumerate(cases):
        assert found[conv] == expected(conv, damage(rows))


def test_odd_conversations(spark):
    """Nulls anywhere, repeated rows, all rows dropped, extreme texts and an empty table."""
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [
        (None, 1, "user", "Hello."),
        (None, 2, "assistant", "Hi."),
        (1, None, None, None),
        (1, 3, "user", "A."),
        (1, 3, "user", "A."),
        (2, 5, "user", "long " * 400_000 + "."),
        (dropped, 0, "user", "gone."),
    ]
    found = result(spark, rows, 512)
    assert set(found) == {None, 1, 2, dropped}
    assert found[dropped] == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in (None, 1, 2):
        assert found[conv] == expected(conv, damage([r for r in rows if r[0] == conv]))
    assert result(spark, rows[:0], 512) == {}


def test_hot_conversation(spark):
    """A conversation with most of the rows lies in many pieces and partitions."""
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant", "user", "system"]), f"t{rng.randrange(900)}" + rng.choice([".", ""])) for k in range(2500)]
    rows += [(8, k, "user", "Same.") for k in range(40)]
    found = result(spark, rows, 16)
    for conv in (7, 8):
        mine = damage([r for r in rows if r[0] == conv])
        faults = faults_of(mine)
        given = repair.Turns(
            np.array([0, len(mine)]),
            np.array([repair.INITIAL.get(r[:1], 3) for _, r, _ in mine]),
            np.array([f in ("blank", "duplicate") for f in faults]),
            np.array([f == "truncated" for f in faults]),
            np.array([True]),
        )
        graph = repair.solve(given, np.zeros((1, 4), np.int64))
        nodes, _ = repair.paths(graph, graph.base[:1])
        audit = "".join(repair.LABELS[x] for x in graph.label[nodes[:-1]])
        text = "\n".join(f"{r}:{t}" for r, t in repaired(mine, audit))
        assert found[conv][6:] == (graph.cost[0], audit, hashlib.sha256(text.encode()).hexdigest())


def test_ranks_are_the_order_of_audits():
    """The doubled ranks order all nodes' audits as their strings."""
    rng = np.random.default_rng(4)
    begins = np.array([0, 9, 9, 30])
    given = repair.Turns(begins, rng.integers(0, 4, 30), rng.random(30) < 0.2, rng.random(30) < 0.3, np.ones(3, bool))
    graph = repair.solve(given, np.zeros((3, 4), np.int64))
    reached = np.flatnonzero(graph.cost < repair.FAR)
    nodes, begin = repair.paths(graph, reached)
    audits = ["".join(repair.LABELS[x] for x in graph.label[nodes[a : b - 1]]) for a, b in zip(begin, begin[1:])]
    by_rank = sorted(zip(graph.rank[reached].tolist(), audits))
    assert [a for _, a in by_rank] == sorted(audits)
    assert len(set(graph.rank[reached].tolist())) == len(set(audits))
