"""The conversation trie against one built in memory."""

import hashlib
import random
import zlib

import pytest

from tsreg.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, x string, piece int, last string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def expected(rows):
    paths = rebuilt(rows)
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children.get(prefix, [])
        leaves[prefix] = sum(leaves[p] for p in below) or 1
        weight = (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        saved[prefix] = weight + sum(saved[p] for p in below)
    out = []
    for prefix, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(prefix))
        out.append(
            (
                min(ids),
                len(prefix),
                min(members[prefix[:-1]]) if prefix else None,
                len(ids),
                len(children.get(prefix, [])),
                leaves[prefix],
                saved[prefix],
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def result(spark, rows, **options):
    given = [(*row, 1, "x", 2, "l") for row in rows]
    random.Random(2).shuffle(given)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    found = trie.prefix_trie(df, **options)
    assert found.columns == trie.COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def family(rng, n, longest):
    rows = []
    for c in rng.sample(range(450), n):
        path = random.Random(c % 7)
        for k in range(rng.randrange(1, longest)):
            text = path.choice(["a", "bé", "", None]) if rng.random() < 0.8 else f"own {c}"
            rows.append((c, k if rng.random() < 0.97 else None, path.choice(["user", "assistant", None]), text))
    # equal turns have an order of their own: keep only one null turn a conversation
    seen, kept = set(), []
    for row in rows:
        if row[1] is None and row[0] in seen:
            continue
        seen |= {row[0]} if row[1] is None else set()
        kept.append(row)
    return kept


@pytest.mark.parametrize("options", [{}, {"segment": 2}, {"bits": 10, "segment": 3}])
def test_nodes(spark, options):
    """All nodes, whatever the pieces; a sketch too small to prove anything changes nothing."""
    rows = family(random.Random(len(options)), 160, 12)
    if "bits" in options:
        rows += [(1000 + c, k, "user", f"{c} {k}") for c in range(40) for k in range(30)]
    assert result(spark, rows, **options) == expected(rows)


def test_hot(spark):
    """A long conversation in two copies, a common first turn, many equal conversations, repeated rows."""
    rng = random.Random(8)
    long = [("user", f"t{rng.randrange(50)}") for _ in range(700)]
    rows = [(c, k, *turn) for c in (600, 700) for k, turn in enumerate(long)]
    rows += [(700, 900, "user", "more")]
    rows += [(c, k, "user", "same") for c in range(1000, 1300) for k in range(3)]
    rows += [(c, k, "user", "same" if k == 0 else f"{c}") for c in range(2000, 2100) for k in range(3)]
    rows += [(3000, 1, "user", "twice")] * 2
    assert result(spark, rows, segment=32) == expected(rows)


def test_odd_tables(spark):
    """Turnless conversations, null ids, one very long text, nothing at all."""
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(turnless, 0, "user", "a"), (turnless, 1, "user", "b"), (None, 0, "user", "lost"), (-3, 0, None, None)]
    found = result(spark, rows)
    assert found == expected([*rows[:2], rows[3]])
    assert result(spark, rows[2:3]) == []
    assert result(spark, []) == []
    big = [(500, 0, "user", "x" * 3_000_000), (500, 1, "user", "y"), (590, 0, "user", "x" * 3_000_000)]
    assert result(spark, big) == expected(big)
