"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, the least audit of these.

Edits of a turn: Keep, Rerole (to user or assistant), Delete; between turns: Insert (an empty turn). An audit
is the string of their initials.

1. Cost DP. The roles given so far are one of four states. A node is a place before a turn and a state; its
   cost to the end follows from the nodes behind it, for all segments of a batch at once.
2. Prefix-doubling path ranking. The arcs that keep the cost least make a graph. Nodes are ranked by the first
   1, 2, 4, 8, ... initials of their least audit: a rank of twice the length is the pair of a node's rank and
   that of the node which its doubled pointer names. Ranks choose the arc, doubled pointers list the path.

A conversation longer than a segment is solved in pieces: a piece is a matrix of least costs from state to
state, products of matrices (at doubled distances) give the costs at each border, maps of states, multiplied
in the same way, the state in which the least path enters each piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsreg.llm import turns
from tsreg.llm.common import map_arrow
from tsreg.sources.stage import stage

RETYPE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1  # costs; the last is that of a truncated turn which stays
FAR = 1 << 40
STATES = 4  # nothing yet, after s, after u, after a
CLOSED = np.array([0, FAR, FAR, 0], np.int64)
AFTER = np.array([2, 2, 3, 2])  # state after the user or assistant turn that may come next
LABELS = "DIKR"
D, I, K, R = range(4)
WHITE = " \t\n\x0b\x0c\r"
EVERY = 20  # damage by the remainder of the CRC-32


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``present`` after the damage that the query's contract states.

    By crc32(``conv_id:turn``) % 20: 0 drops the turn (it stays as a row that isn't ``present``), 1 empties
    its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's. Nulls count as one blank, in the key
    too.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))), F.lit(EVERY))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault"))
    code = F.col("fault")
    return rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(code == 4, "user").when(code > 0, F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).when(code > 0, F.col("text")).alias("text"),
        (code > 0).alias("present"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


class Turns(NamedTuple):
    """The turns of several segments, one after the other."""

    begins: np.ndarray  # of each segment, and the end of the last
    initials: np.ndarray  # 0 s, 1 u, 2 a, 3 other
    broken: np.ndarray  # blank or duplicate: to be deleted
    truncated: np.ndarray
    last: np.ndarray  # segments that end their conversation


class Graph(NamedTuple):
    """Nodes of all segments: segment g has (its turns + 1) x 4 of them, from ``base[g]`` on."""

    base: np.ndarray
    cost: np.ndarray
    label: np.ndarray  # of the arc that the least path takes, -1 where it ends
    pointers: list[np.ndarray]  # nodes that 1, 2, 4, ... arcs lead to
    rank: np.ndarray  # of the node's audit among all


def costs(given: Turns, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost to the end from each node, and the nodes' base of each segment.

    ``end`` holds, by segment, the costs behind its last turn; that of a segment which ends its
    conversation is taken as ``CLOSED``.
    """
    lengths = np.diff(given.begins)
    base = np.append(0, np.cumsum(STATES * (lengths + 1)))
    cost = np.full(base[-1], FAR, np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    longest_first = lengths[by_length]
    for left in range(int(lengths.max(initial=0)) + 1):
        # segments that have a place with ``left`` turns behind it
        some = by_length[: np.searchsorted(-longest_first, -left, side="right")]
        place = lengths[some] - left
        if left == 0:
            here = np.where(given.last[some, None], CLOSED, end[some])
            open_ = given.last[some]
        else:
            turn = given.begins[some] + place
            behind = cost[base[some, None] + STATES * (place[:, None] + 1) + np.arange(STATES)]
            here = behind + DELETE
            initial = given.initials[turn]
            extra = np.where(given.broken[turn], FAR, CUT_OFF * given.truncated[turn])
            for state in range(STATES):
                wanted = 2 if state == 2 else 1
                after = behind[:, AFTER[state]] + extra
                here[:, state] = np.minimum(here[:, state], after + np.where(initial == wanted, 0, RETYPE))
            here[:, 0] = np.where(initial == 0, np.minimum(here[:, 0], behind[:, 1] + extra), here[:, 0])
            open_ = np.ones(len(some), bool)
        # turns that are inserted here
        user, both = here[:, 2].copy(), here[:, 3].copy()
        inserted = here.copy()
        inserted[:, 2] = np.minimum(user, both + INSERT)
        inserted[:, 3] = np.minimum(both, user + INSERT)
        inserted[:, :2] = np.minimum(inserted[:, :2], inserted[:, 2:3] + INSERT)
        here = np.where(open_[:, None], inserted, here)
        cost[base[some, None] + STATES * place[:, None] + np.arange(STATES)] = np.minimum(here, FAR)
    return cost, base


def arcs(given: Turns, cost: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Node that each edit leads to without raising the cost, by node and ``LABELS``; -1 for none."""
    lengths = np.diff(given.begins)
    nodes = np.arange(len(cost))
    segment = np.repeat(np.arange(len(lengths)), STATES * (lengths + 1))
    state = nodes % STATES
    place = (nodes - base[segment]) // STATES
    final = place == lengths[segment]
    out = np.full((len(nodes), len(LABELS)), -1, np.int64)
    reached = cost < FAR
    after = nodes - state + AFTER[state]
    ends = final & (~given.last[segment] | (cost == CLOSED[state]))
    gap = reached & ~ends & (cost == cost[after] + INSERT)
    out[gap, I] = after[gap]
    at = nodes[reached & ~final]
    turn = given.begins[segment[at]] + place[at]
    extra = np.where(given.broken[turn], FAR, CUT_OFF * given.truncated[turn])
    initial = given.initials[turn]

    def add(edit: int, target: np.ndarray, price: np.ndarray, allowed: np.ndarray) -> None:
        fits = allowed & (cost[at] == cost[target] + price)
        out[at[fits], edit] = target[fits]

    add(D, at + STATES, np.full(len(at), DELETE), np.ones(len(at), bool))
    follow = after[at] + STATES
    right = initial == np.where(state[at] == 2, 2, 1)
    add(K, follow, extra, right)
    system = (state[at] == 0) & (initial == 0)
    add(K, at + STATES + 1 - state[at], extra, system)
    add(R, follow, extra + RETYPE, ~right)
    return out


def ranked(arc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The arc of each node's least audit, pointers over 1, 2, 4, ... arcs, and the ranks of the audits.

    One initial leads to one node only, so the least initial begins the least audit, and pairs of ranks
    compare all that follows.
    """
    nodes = np.arange(len(arc))
    some = arc >= 0
    label = np.where(some.any(axis=1), some.argmax(axis=1), -1)
    pointers = [np.where(label >= 0, arc[nodes, np.maximum(label, 0)], nodes)]
    rank = label + 1  # an ended audit is less than any that goes on
    while True:
        jump = pointers[-1]
        longer = jump[jump]
        pair = rank * (int(rank.max(initial=0)) + 1) + np.where(jump == nodes, 0, rank[jump])
        rank = np.unique(pair, return_inverse=True)[1]
        if np.array_equal(longer, jump):
            return label, pointers, rank
        pointers.append(longer)


def solve(given: Turns, end: np.ndarray) -> Graph:
    cost, base = costs(given, end)
    label, pointers, rank = ranked(arcs(given, cost, base))
    return Graph(base, cost, label, pointers, rank)


def paths(graph: Graph, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the least paths from ``start``, one path after the other, and where each begins.

    The number of arcs doubles along with the pointers; the place in a path is then its sum of jumps.
    """
    arcs_left = (graph.label >= 0).astype(np.int64)
    for jump in graph.pointers[:-1]:
        arcs_left = arcs_left + arcs_left[jump]
    counts = arcs_left[start] + 1
    begins = np.append(0, np.cumsum(counts))
    place = np.arange(begins[-1]) - np.repeat(begins[:-1], counts)
    node = np.repeat(start, counts)
    for k, jump in enumerate(graph.pointers):
        some = (place >> k & 1).astype(bool)
        node[some] = jump[node[some]]
    return node, begins


class Segments(NamedTuple):
    """A batch of segments as read: the rows that are present."""

    turns: list[list[int | None]]
    roles: list[list[str]]
    texts: list[list[str]]
    given: Turns
    faults: np.ndarray  # by turn: 0 none, 1 blank, 2 duplicate, 3 truncated


INITIAL = {"s": 0, "u": 1, "a": 2}
VISIBLE_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


def digest(role: str, text: str) -> bytes:
    head = role.encode("utf-8", "replace")
    return hashlib.sha256(len(head).to_bytes(8, "little") + head + text.encode("utf-8", "replace")).digest()


def read(batch: pa.RecordBatch) -> Segments:
    """Turns of a batch with their faults; ``seen`` (digests of earlier pieces' turns) is heeded if there."""
    columns = {name: batch.column(name).to_pylist() for name in ("turn", "role", "text", "present", "last")}
    seen = batch.column("seen").to_pylist() if "seen" in batch.schema.names else [None] * batch.num_rows
    numbers, roles, texts, faults, initials, begins = [], [], [], [], [], [0]
    for turn, role, text, present, earlier in zip(
        columns["turn"], columns["role"], columns["text"], columns["present"], seen
    ):
        keep = [k for k, there in enumerate(present) if there]
        numbers.append([turn[k] for k in keep])
        roles.append([role[k] for k in keep])
        texts.append([text[k] for k in keep])
        known: set = set()
        before = set(earlier or ())
        for who, said in zip(roles[-1], texts[-1]):
            stripped = said.rstrip(WHITE)
            pair = (who, said)
            if not stripped:
                faults.append(1)
            elif pair in known or (before and digest(who, said) in before):
                faults.append(2)
            else:
                faults.append(0 if stripped[-1] in ".!?" else 3)
            known.add(pair)
            initials.append(INITIAL.get(who[:1], 3))
        begins.append(len(faults))
    fault = np.array(faults, np.int8)
    given = Turns(
        np.array(begins, np.int64),
        np.array(initials, np.int8),
        (fault == 1) | (fault == 2),
        fault == 3,
        np.array(columns["last"], bool),
    )
    return Segments(numbers, roles, texts, given, fault)


PIECES = (
    "conv_id {kind}, piece bigint, cost bigint, audit string, repaired array<struct<role:string,text:string>>, "
    "turns bigint, distinct_turns bigint, first_turn bigint, last_turn bigint, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, first_role string, last_role string"
)
LEGAL = {"su", "ua", "au"}


def _piece(numbers: list, roles: list[str], faults: np.ndarray) -> tuple:
    """What a piece says of its turns before the repair."""
    real = [n for n in numbers if n is not None]
    initials = [r[:1] for r in roles]
    return (
        len(roles),
        len(set(real)),
        min(real, default=None),
        max(real, default=None),
        int((faults == 1).sum()),
        int((faults == 2).sum()),
        int((faults == 3).sum()),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        initials[0] if initials else None,
        initials[-1] if initials else None,
    )


def _edits(labels: str, states: list[int], roles: list[str], texts: list[str]) -> list[dict]:
    """Turns that a path of edits leaves; ``states`` are those after each edit."""
    out, k = [], 0
    for edit, state in zip(labels, states):
        if edit != "D":
            given = "user" if state == 2 else "assistant"
            out.append({"role": roles[k] if edit == "K" else given, "text": "" if edit == "I" else texts[k]})
        k += edit != "I"
    return out


def _solved(segments: DataFrame) -> DataFrame:
    """Pieces with their repair; ``entry`` and ``end`` hold the borders, if there are any."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = PIECES.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = read(batch)
            cut = "end" in batch.schema.names
            end = _matrix(batch.column("end")) if cut else np.tile(CLOSED, (batch.num_rows, 1))
            entry = batch.column("entry").to_numpy() if cut else np.zeros(batch.num_rows, np.int64)
            graph = solve(got.given, end)
            start = graph.base[:-1] + entry
            nodes, begins = paths(graph, start)
            labels = "".join(LABELS[x] for x in graph.label[nodes])
            states = (nodes % STATES).tolist()
            rows = []
            for g, (low, high) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                a, b = got.given.begins[g], got.given.begins[g + 1]
                audit = labels[low : high - 1]
                rows.append(
                    (int(graph.cost[start[g]]), audit, _edits(audit, states[low + 1 : high], got.roles[g], got.texts[g]))
                    + _piece(got.turns[g], got.roles[g], got.faults[a:b])
                )
            names = [part.split()[0] for part in schema.split(", ")]
            types = [pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            types += 8 * [pa.int64()] + 2 * [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("piece")]
                + [pa.array(values, kind) for values, kind in zip(zip(*rows), types)],
                names=names,
            )

    return map_arrow(segments, run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _mapped(segments: DataFrame, what) -> DataFrame:
    """``conv_id``, ``piece`` and ``value`` (numbers), by ``what`` of a batch."""
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = what(batch)
                offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), batch.column("piece"), lists], names=["conv_id", "piece", "value"]
                )

    return map_arrow(segments, run, f"conv_id {kind}, piece bigint, value array<bigint>")


def _border_costs(batch: pa.RecordBatch) -> np.ndarray:
    """Least cost of each piece from state to state; of a last piece to the end, in all columns."""
    given = read(batch).given
    out = np.empty((batch.num_rows, STATES, STATES), np.int64)
    for state in range(STATES):
        end = np.full((batch.num_rows, STATES), FAR)
        end[:, state] = 0
        cost, base = costs(given, end)
        out[:, :, state] = cost[base[:-1, None] + np.arange(STATES)]
    return out.reshape(batch.num_rows, -1)


def _border_states(batch: pa.RecordBatch) -> np.ndarray:
    """State in which the least path leaves each piece, by the state in which it enters."""
    graph = solve(read(batch).given, _matrix(batch.column("end")))
    start = graph.base[:-1, None] + np.arange(STATES)
    return graph.pointers[-1][start] % STATES


def _min_plus(left: Column, right: Column) -> Column:
    def cell(k: Column) -> Column:
        row, column = F.floor(k / STATES) * STATES, k % STATES
        sums = [
            F.element_at(left, (row + j + 1).cast("int")) + F.element_at(right, (column + STATES * j + 1).cast("int"))
            for j in range(STATES)
        ]
        return F.least(F.lit(FAR), *sums)

    return F.transform(F.sequence(F.lit(0), F.lit(STATES * STATES - 1)), cell)


def _then(first: Column, second: Column) -> Column:
    return F.transform(first, lambda state: F.element_at(second, (state + 1).cast("int")))


def _on(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on (``conv_id``, ``piece``), null ids too."""
    named = right.withColumnsRenamed({"conv_id": "r_conv", "piece": "r_piece"})
    same = left["conv_id"].eqNullSafe(named["r_conv"]) & (left["piece"] == named["r_piece"])
    return left.join(named, same, how).drop("r_conv", "r_piece")


def _with_seen(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``seen``: digests of their turns that an earlier piece has too."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = read(batch)
            rows = [
                (k, d)
                for k, (roles, texts) in enumerate(zip(got.roles, got.texts))
                for d in {digest(*pair) for pair in zip(roles, texts)}
            ]
            place = pa.array([k for k, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(place), batch.column("piece").take(place), pa.array([d for _, d in rows], pa.binary())],
                names=["conv_id", "piece", "digest"],
            )

    each = stage(map_arrow(pieces, run, f"conv_id {kind}, piece bigint, digest binary"), "repair-digests")
    first = each.groupBy("conv_id", "digest").agg(F.min("piece").alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").withColumnsRenamed({"conv_id": "f_conv", "digest": "f_digest"})
    same = each["conv_id"].eqNullSafe(first["f_conv"]) & (each["digest"] == first["f_digest"])
    again = each.join(first, same).filter("piece > first").groupBy("conv_id", "piece")
    # at most as many as a segment has turns
    return _on(pieces, again.agg(F.collect_list("digest").alias("seen")))


def solved(rows: DataFrame, segment: int = turns.SEGMENT) -> tuple[DataFrame, DataFrame | None]:
    """:func:`repair`, conversations of one piece apart from those of several (None if there are none)."""
    ordered = rows.select("conv_id", "turn", "role", "text", "present", turns.tie_order().alias("tie"))
    found = turns.segments(ordered, segment)
    single = (F.col("piece") == 0) & F.col("last")
    whole = _solved(found.filter(single)).withColumn("last", F.lit(True))
    if found.filter(~single).isEmpty():
        return whole, None
    parts = stage(_with_seen(found.filter(~single)), "repair-parts")
    products = turns.doubled(_mapped(parts, _border_costs), "conv_id", _min_plus, "repair-costs", forward=False)
    closed = F.array(*[F.lit(int(c)) for c in CLOSED])
    # the costs behind a piece are those of the next one: any column, as the product reaches the end
    column = F.transform(
        F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.element_at("value", (s * STATES + 1).cast("int"))
    )
    behind = products.select("conv_id", (F.col("piece") - 1).alias("piece"), column.alias("end"))
    parts = stage(_on(parts, behind).withColumn("end", F.coalesce("end", closed)), "repair-ends")
    states = turns.doubled(_mapped(parts, _border_states), "conv_id", _then, "repair-states")
    entered = states.select("conv_id", (F.col("piece") + 1).alias("piece"), F.element_at("value", 1).alias("entry"))
    parts = _on(parts, entered).withColumn("entry", F.coalesce("entry", F.lit(0)).cast("bigint"))
    return whole, _on(_solved(parts), parts.select("conv_id", "piece", "last"))


def repair(rows: DataFrame, segment: int = turns.SEGMENT) -> DataFrame:
    """Repaired conversations in pieces of at most ``segment`` turns: columns ``PIECES``, and ``last``.

    ``rows``: ``conv_id``, ``turn``, ``role``, ``text`` and ``present`` (rows that aren't only keep their
    conversation in the result); others are ignored. ``repaired`` are the turns after the cheapest edits,
    ``audit`` the edits' initials, least in ASCII order among the cheapest; ``cost`` is that from the piece
    on to the end, in piece 0 so that of the conversation. Turns are ordered by ``turn``, nulls first; equal
    turns by a hash of role and text, so that repeated rows are neighbours. A blank text is a fault before a
    duplicate, a duplicate before a truncated end. A null ``conv_id`` is a conversation of its own.
    A conversation without rows that are present has one piece without edits. An empty table gives none.
    """
    whole, parts = solved(rows, segment)
    return whole if parts is None else whole.unionByName(parts)


SUMMARY = (
    "conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def summaries(whole: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """The result of :func:`solved` as one row per conversation with the counts, the audit and the SHA-256 of its repaired ``role:text`` lines.

    ``gaps`` is the last turn's number less the first's plus one less the number of different turns, 0 without
    any; ``illegal`` counts neighbours whose roles' initials aren't su, ua or au. Pieces of a conversation
    are read in order and hashed one by one; none is held with the others.
    """
    kind = whole.schema["conv_id"].dataType.simpleString()
    line = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    width = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns"), F.lit(0))
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    one = whole.select(
        "conv_id", width.alias("gaps"), *names, F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                    first = latest = last_role = None
                    distinct, audit, state, any_line = 0, [], hashlib.sha256(), False
                    cost = row["cost"]
                for name in total:
                    total[name] += row[name]
                if last_role is not None and row["first_role"] is not None:
                    total["illegal"] += last_role + row["first_role"] not in LEGAL
                last_role = row["last_role"] if row["last_role"] is not None else last_role
                if row["first_turn"] is not None:
                    # equal turns may lie on both sides of a border
                    distinct += row["distinct_turns"] - (row["first_turn"] == latest)
                    first = row["first_turn"] if first is None else first
                    latest = row["last_turn"]
                audit.append(row["audit"])
                for turn in row["repaired"]:
                    state.update(f"{chr(10) * any_line}{turn['role']}:{turn['text']}".encode("utf-8", "replace"))
                    any_line = True
                if row["last"]:
                    gaps = 0 if first is None else latest - first + 1 - distinct
                    out.append((row["conv_id"], gaps, *total.values(), cost, "".join(audit), state.hexdigest()))
            types = [batch.schema.field("conv_id").type] + 6 * [pa.int64()] + 2 * [pa.string()]
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=[part.split()[0] for part in SUMMARY.split(", ")],
            )

    if parts is None:
        return one
    many = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return one.unionByName(map_arrow(many, run, SUMMARY.format(kind=kind)))
