"""Near duplicates by SimHash with bit-sliced comparison.

Fingerprints within a small Hamming radius are found in three steps.

* Keys: 64 bits are cut into ``radius + 2`` blocks; two fingerprints within the radius agree on at
  least two whole blocks, so each fingerprint is listed under every pair of its blocks, and only
  fingerprints under one key are compared.
* Comparison: a group's fingerprints are stored as vertical bit planes, 64 rows to a word. One
  exclusive-or per plane updates 64 distances at once; carry-save adders count them in bit-sliced
  counters; a block of rows is left as soon as all its distances exceed the radius.
* Components of the links, over distinct fingerprints only.

A key of any size is dealt out: its rows go into chunks by a hash, and each pair of chunks is a cell
of its own, so a task holds two chunks at most and no link is lost. A cell returns a star over each
of its local components rather than all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsreg.llm.common import drop_rows, lowered, map_arrow, texts_of
from tsreg.llm.components import components, settle
from tsreg.sources.stage import stage

RADIUS = 4
WORDS = 4
CHUNK = 8192
SMALL = 256
SLAB = 512  # words of 64 rows that are compared at a time
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """SimHash of a lower-cased text: majority over the bits of its shingles' XXH64.

    Words are runs of bytes other than blanks and 09-0D; fewer than ``width`` words are one shingle,
    none give zero.
    """
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for low in range(0, len(stops), 32768):  # bounded, however long the text
        hashes = b"".join(
            [
                xxhash.xxh64_digest(joined[a:b], 42)
                for a, b in zip(starts[low : low + 32768], stops[low : low + 32768])
            ]
        )
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (XXH64 of the text) and fingerprint (64 bits as bigint) of every row.

    Null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts_of(batch.column(1))], np.uint64)
            prints = np.array([fingerprint(t) for t in lowered(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys.view(np.int64)), pa.array(prints.view(np.int64))],
                names=["doc_id", "text_key", "fingerprint"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, fingerprint bigint"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 planes of words; bit i % 64 of word i // 64 in plane b is bit b of fingerprint i."""
    padded = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(differences: Iterable[np.ndarray], radius: int, alive: np.ndarray) -> np.ndarray:
    """Mask of the rows in ``alive`` with at most ``radius`` (0 to 7) differing bits.

    ``differences`` gives the 64 planes of differing bits. Four planes at a time go through
    carry-save adders into counters for ones, twos and fours; ``many`` marks counts of eight or more.
    """
    ones, twos, fours, many = (np.zeros_like(alive) for _ in range(4))
    source = iter(differences)
    for step in range(16):
        a, b, c, d = itertools.islice(source, 4)
        x = ones ^ a
        carry1, ones = (ones & a) | (x & b), x ^ b
        x = ones ^ c
        carry2, ones = (ones & c) | (x & d), x ^ d
        x = twos ^ carry1
        carry4, twos = (twos & carry1) | (x & carry2), x ^ carry2
        many |= fours & carry4
        fours = fours ^ carry4
        if step % 2:
            alive = alive & ~_above(ones, twos, fours, many, radius)
            if not alive.any():
                return alive
    return alive


def _above(ones, twos, fours, many, radius: int) -> np.ndarray:
    """Rows whose bit-sliced count exceeds ``radius``."""
    more, equal = np.zeros_like(ones), np.full_like(ones, ALL)
    for counter, bit in ((fours, radius & 4), (twos, radius & 2), (ones, radius & 1)):
        if bit:
            equal &= counter
        else:
            more |= equal & counter
            equal &= ~counter
    return many | more


def _bits_of(mask: np.ndarray) -> np.ndarray:
    return np.unpackbits(mask.view(np.uint8), axis=-1, bitorder="little")


def _words_of(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(flags) // 64) * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _shifted(plane: np.ndarray, low: int, n: int, shift: int) -> np.ndarray:
    """``n`` words of a plane from word ``low`` on, ``shift`` rows further."""
    word, bit = low + shift // 64, np.uint64(shift % 64)
    here = plane[word : word + n]
    if not shift % 64:
        return here
    return (here >> bit) | (plane[word + 1 : word + 1 + n] << (np.uint64(64) - bit))


def small_group_links(groups: np.ndarray, prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links inside many small groups: each row is compared with the row 1, 2, 3 ... further on.

    ``groups`` is sorted. Returns arrays of row numbers, one row of each link in the first.
    """
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(starts, len(groups)))
    size = np.repeat(sizes, sizes)
    rows = np.arange(len(groups))
    lefts, rights = [], []
    for shift in range(1, int(sizes.max(initial=1))):
        if shift & (shift - 1) == 0:  # leave out groups that have no rows so far apart
            rows = rows[size[rows] > shift]
            words = -(-len(rows) // 64)
            planes = np.concatenate(
                [bit_planes(prints[rows]), np.zeros((64, SMALL // 64 + 2), np.uint64)], axis=1
            )
            held = groups[rows]
        together = np.zeros(len(rows), bool)
        if shift < len(rows):
            together[:-shift] = held[shift:] == held[:-shift]
        alive = _words_of(together)
        for low in range(0, words, SLAB):
            part = alive[low : low + SLAB]
            if not part.any():
                continue
            near = within(
                (p[low : low + len(part)] ^ _shifted(p, low, len(part), shift) for p in planes), radius, part
            )
            if near.any():
                found = np.flatnonzero(_bits_of(near)) + 64 * low
                lefts.append(rows[found])
                rights.append(rows[found + shift])
    nothing = np.zeros(0, np.int64)
    return [np.concatenate([nothing, *lefts]), np.concatenate([nothing, *rights])]


def large_group_labels(prints: np.ndarray, radius: int, queries: int = 32) -> np.ndarray:
    """Component labels inside one large group: blocks of queries against all rows after them."""
    n = len(prints)
    planes = bit_planes(prints)
    label = np.arange(n)
    everything = _words_of(np.ones(n, bool))
    for first in range(0, n, queries):
        asked = prints[first : first + queries]
        word = first // 64
        rest = planes[:, word:]
        # bits in the order of bit_planes, as full or empty words
        bits = np.unpackbits(asked.view(np.uint8).reshape(-1, 8), axis=1).T.astype(bool)
        wanted = np.where(bits, ALL, np.uint64(0))
        alive = np.broadcast_to(everything[word:], (len(asked), rest.shape[1]))
        near = within((p[None, :] ^ w[:, None] for p, w in zip(rest, wanted)), radius, alive)
        if not near.any():
            continue
        for k, mask in enumerate(near):
            linked = np.flatnonzero(_bits_of(mask)) + 64 * word
            linked = linked[linked > first + k]
            if not len(linked):
                continue
            met = np.append(label[linked], label[first + k])
            if met.min() != met.max():
                low, met = met.min(), np.unique(met)
                label[np.isin(label, met)] = low
    return label


def cell_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the cells of sorted rows, as stars: fingerprint, fingerprint of its star."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    is_small = np.repeat(sizes <= SMALL, sizes)
    few, label = np.flatnonzero(is_small), np.arange(len(keys))
    if len(few):
        lefts, rights = small_group_links(keys[few], prints[few], radius)
        label[few] = few[settle(len(few), lefts, rights)]
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        label[start : start + size] = start + large_group_labels(prints[start : start + size], radius)
    linked = np.flatnonzero(label != np.arange(len(keys)))
    return prints[linked], prints[label[linked]]


def block_keys(radius: int) -> list:
    """A bigint key for every pair of the ``radius + 2`` blocks of a fingerprint."""
    blocks = radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [
        F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for low, high in itertools.pairwise(edges)
    ]
    keys = []
    for number, (i, j) in enumerate(itertools.combinations(range(blocks), 2)):
        second = edges[j + 1] - edges[j]
        joined = F.shiftleft(parts[i], second).bitwiseOR(parts[j])
        keys.append(joined.bitwiseOR(F.lit(number << 50)))
    return keys


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct fingerprints within ``radius`` bits."""
    if not 0 <= radius <= 7:
        raise ValueError("the radius must be 0 to 7")
    listed = distinct.select("fingerprint", F.explode(F.array(*block_keys(radius))).alias("key"))
    shared = (
        listed.groupBy("key")
        .count()
        .filter("count > 1")
        .select("key", F.ceil(F.col("count") / chunk).alias("chunks"))
    )
    mine = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    cells = (
        listed.join(shared, "key")
        .select("key", "fingerprint", mine.alias("mine"), other.alias("other"))
        .select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fingerprint")
        .repartition("key", "a", "b")
        .sortWithinPartitions("key", "a", "b", "fingerprint")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            held.clear()
            last = rows.shape[1] if final else int(np.argmax((rows[:3] == rows[:3, -1:]).all(axis=0)))
            if not final:
                held.append(rows[:, last:])
            if last:
                keys = rows[:3, :last]
                cell = np.cumsum(np.append(0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
                prints = np.ascontiguousarray(rows[3, :last]).view(np.uint64)
                u, v = cell_links(cell, prints, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"]
                )

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if sum(h.shape[1] for h in held) >= 65536:
                yield from flush(False)
        if held:
            yield from flush(True)

    return map_arrow(cells, run, "u bigint, v bigint")


def classified(docs: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Rows of :func:`fingerprints` with ``label`` (the component's smallest fingerprint), ``component_id`` and ``n_rows``.

    ``n_rows`` is the number of rows of the component.
    """
    found = stage(fingerprints(docs), "simhash")
    distinct = stage(
        found.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")),
        "simhash-distinct",
    )
    linked = components(links(distinct.select("fingerprint"), radius, chunk))
    members = distinct.join(
        linked.select(F.col("node").alias("fingerprint"), F.col("component").alias("label")), "fingerprint"
    )
    smallest = members.groupBy("label").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("n_rows"))
    moved = members.join(smallest, "label").select("fingerprint", "label", "component_id", "n_rows")
    classes = distinct.join(moved, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("label", "fingerprint").alias("label"),
        F.when(F.col("label").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_rows", "n").alias("n_rows"),
    )
    # a join of two plain tables: Spark can split it where very many rows share one fingerprint
    return found.join(stage(classes, "simhash-classes"), "fingerprint")


def near_groups(docs: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Fingerprints within ``radius`` bits are linked; ``component_id`` is the smallest ``doc_id`` that
    links reach, the row's own included. Null and empty texts have fingerprint zero and are linked
    like any other; null ids are left out of the minimum, and a component without ids has a null.
    Repeated rows are returned as often as they come. An empty table gives an empty result.
    """
    return classified(docs, radius, chunk).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near(docs: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, all columns as they are.

    If a component has several texts under that id, one of them stays, and so does one of rows that
    repeat both; a component without ids keeps one row. Null and empty texts are near copies of each
    other; an empty table stays one.
    """
    rows = classified(docs, radius, chunk).filter("n_rows > 1")
    mine = F.col("doc_id").eqNullSafe(F.col("component_id"))
    listed = rows.groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("n"), F.max(mine).alias("mine"))
    listed = stage(listed, "simhash-listed")
    first = listed.filter("mine").groupBy("label").agg(F.min("text_key").alias("stays"))
    one = F.col("mine") & (F.col("text_key") == F.col("stays"))
    drops = listed.join(first, "label").select("doc_id", "text_key", "n", one.alias("one"))
    # an id and text can be in one component only
    drops = stage(drops.filter("n > 1 OR NOT one").drop("n"), "simhash-drops")
    return drop_rows(docs, drops, {"text_key": F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
