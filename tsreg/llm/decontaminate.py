"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. Items are cut into words; every n-gram of ``GRAM`` words gets an exact number.
2. One pass over the documents marks the items' n-grams in each text. It counts in how many documents each
   occurs, and lists the passages in which several n-grams of an item lie in the item's order: on diagonals
   (place in the text less place in the item) at most ``DRIFT`` apart. Nothing else of the text moves.
3. Of these, passages with a rare n-gram are aligned with the item, word by word. n-grams that many
   documents and items have count only in a chain of ``CHAIN``.

Two runs of at least ``GRAM`` equal words further apart than ``DRIFT`` words gain nothing by being aligned
together, so no alignment is lost by the diagonals.

The benchmark is the stated query set. It is split into blocks of at most ``BLOCK_WORDS`` words, whose
index is broadcast, and each block makes its own pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreg.llm.common import drop_rows, map_arrow, texts_of
from tsreg.sources.stage import stage

GRAM = 3
SEEDS = 2
CHAIN = 3  # seeds that are enough though none is rare
RARE = 0.01  # a rare n-gram makes at most this many pairs of document and item for each document
BLOCK_WORDS = 1_000_000
SEGMENT = 1024
SHARED = 256  # words that segments have in common: LONG_MATCH equal words and their edits fit in
GAP = 64  # words kept around the marks of a passage, or as many as the item has
WINDOW = 1 << 16  # words of a text that are looked at together
MATCH, MISMATCH, SKIP = 2, -1, -1
DRIFT = MATCH * GRAM
SIMILARITY = 0.5
LONG_MATCH = 50
SHORT_ITEM = 8

WORD = re.compile(r"\w+")
BITS = 21


def words_of(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


class Index(NamedTuple):
    vocabulary: dict[str, int]  # from 1
    grams: np.ndarray  # sorted n-gram numbers
    edges: np.ndarray  # where the occurrences of each n-gram begin, and the end of the last
    owners: np.ndarray  # items that have the n-gram, by number
    spots: np.ndarray  # and where in them
    keys: np.ndarray  # of the items
    words: list[np.ndarray]  # of the items, by number
    needed: np.ndarray  # distinct n-grams that a passage must hold of each item


def _numbers(words: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    get = vocabulary.get
    return np.array([get(w, 0) for w in words], np.int64)


def gram_numbers(ids: np.ndarray) -> np.ndarray:
    """Number of the n-gram at each place, -1 where it has an unknown word."""
    n = max(0, len(ids) - GRAM + 1)
    number, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(GRAM):
        part = ids[k : k + n]
        number = (number << BITS) | part
        known &= part > 0
    return np.where(known, number, -1)


def build_index(items: list[list[str]], keys: list[int]) -> Index:
    vocabulary: dict[str, int] = {}
    for words in items:
        for word in words:
            vocabulary.setdefault(word, len(vocabulary) + 1)
    if len(vocabulary) >= 1 << BITS:
        raise ValueError("a block of the benchmark has too many different words")
    words = [_numbers(item, vocabulary) for item in items]
    each = [gram_numbers(w) for w in words]
    held = np.array([len(g) for g in each], np.int64)
    distinct = np.array([len(np.unique(g)) for g in each], np.int64)
    every = np.concatenate([np.zeros(0, np.int64), *each])
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    short = np.array([len(w) < SHORT_ITEM for w in words], bool)
    needed = np.where(short, 1, np.minimum(SEEDS, distinct))
    owners = np.repeat(np.arange(len(items)), held)[order]
    spots = np.concatenate([np.zeros(0, np.int64), *map(np.arange, held)])[order]
    return Index(
        vocabulary, grams, np.append(first, len(every)), owners, spots, np.array(keys, np.int64), words, needed
    )


class Run(NamedTuple):
    item: int
    slots: np.ndarray  # distinct n-grams, by place in the index
    low: int  # places in the text of the first and the last
    high: int


def runs(index: Index, places: np.ndarray, slots: np.ndarray) -> list[Run]:
    """Marks of an item on neighbouring diagonals that are enough seeds of it."""
    first = index.edges[slots]
    counts = index.edges[slots + 1] - first
    at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    place, slot, owner = np.repeat(places, counts), np.repeat(slots, counts), index.owners[at]
    diagonal = place - index.spots[at]
    order = np.lexsort((diagonal, owner))
    place, slot, owner, diagonal = place[order], slot[order], owner[order], diagonal[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (np.diff(diagonal) > DRIFT))
    number = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    pairs = np.unique(number * len(index.grams) + slot)
    seeds = np.bincount(pairs // len(index.grams), minlength=len(starts))
    low, high = np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts)
    ends = np.append(0, np.cumsum(seeds))
    return [
        Run(int(owner[starts[r]]), pairs[ends[r] : ends[r + 1]] % len(index.grams), int(low[r]), int(high[r]))
        for r in np.flatnonzero(seeds >= index.needed[owner[starts]])
    ]


def segments(words: list[str]) -> list[list[str]]:
    """Whole item, or pieces of ``SEGMENT`` words, none shorter, that share at least ``SHARED`` words."""
    last = len(words) - SEGMENT
    if last <= 0:
        return [words] if words else []
    return [words[low : low + SEGMENT] for low in [*range(0, last, SEGMENT - SHARED), last]]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``item_key``, ``words``: long items in segments; equal segments share their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                for held in segments(words_of(text)):
                    key = xxhash.xxh64_intdigest(" ".join(held).encode(), 42)
                    rows.append((item_id, key - (1 << 64) if key >> 63 else key, held))
            ids, keys, words = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.column(0).type),
                    pa.array(keys, pa.int64()),
                    pa.array(words, pa.list_(pa.string())),
                ],
                names=["item_id", "item_key", "words"],
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", "text")
    return map_arrow(rows, run, f"item_id {kind}, item_key bigint, words array<string>")


MARKS = (
    "doc_id {kind}, text_key bigint, start bigint, words string, item bigint, slots array<bigint>, "
    "slot bigint, n bigint"
)


def marked(docs: DataFrame, shared) -> DataFrame:
    """Passages with enough seeds of an ``item``; and rows with ``slot`` and ``n``, documents that have it.

    The ``slot`` -1 counts all documents.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        documents = np.zeros(len(index.grams) + 1, np.int64)
        id_type = None

        def rows_of(rows: list[tuple], counted: np.ndarray | None = None) -> pa.RecordBatch:
            slots = [] if counted is None else np.flatnonzero(counted).tolist()
            n = len(slots)
            types = [id_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            arrays = [pa.array([*c, *[None] * n], t) for c, t in zip(columns, types)]
            last = len(documents) - 1
            arrays.append(pa.array([None] * len(rows) + [-1 if s == last else s for s in slots], pa.int64()))
            arrays.append(pa.array([None] * len(rows) + [int(counted[s]) for s in slots], pa.int64()))
            return pa.RecordBatch.from_arrays(arrays, names=[part.split()[0] for part in MARKS.split(", ")])

        for batch in batches:
            id_type = batch.column(0).type
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                documents[-1] += 1
                words = words_of(text)
                numbers = gram_numbers(_numbers(words, index.vocabulary))
                places = np.flatnonzero(numbers >= 0)
                if not len(places) or not len(index.grams):
                    continue
                slots = np.searchsorted(index.grams, numbers[places])
                slots[slots == len(index.grams)] = 0
                real = index.grams[slots] == numbers[places]
                places, slots = places[real], slots[real]
                if not len(places):
                    continue
                documents[np.unique(slots)] += 1
                key = xxhash.xxh64_intdigest(text, 42)
                key = key - (1 << 64) if key >> 63 else key
                # neighbouring seeds lie within a segment's length, so in one window at least
                for begin in range(0, len(words), WINDOW):
                    a, b = np.searchsorted(places, [begin, begin + WINDOW + 2 * SEGMENT])
                    for found in runs(index, places[a:b], slots[a:b]) if a < b else ():
                        around = max(GAP, len(index.words[found.item]))
                        low = max(0, found.low - around)
                        held = " ".join(words[low : found.high + GRAM + around])
                        rows.append((doc_id, key, low, held, found.item, found.slots))
            if rows:
                yield rows_of(rows)
        if id_type is not None:
            yield rows_of([], documents)

    return map_arrow(docs.select("doc_id", "text"), run, MARKS.format(kind=kind.simpleString()))


def is_rare(index: Index, documents: np.ndarray, total: int) -> np.ndarray:
    """n-grams that make few pairs: in how many documents they are, times in how many places of items."""
    return documents * np.diff(index.edges) <= max(1.0, RARE * total)


def enough(index: Index, rare: np.ndarray, item: int, slots: np.ndarray) -> bool:
    """Whether a passage's seeds of an item ask for an alignment."""
    return len(slots) >= CHAIN or bool(rare[slots].any()) or len(index.words[item]) < SHORT_ITEM


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two sequences of numbers: score, equal words, its range in the passage."""
    n, m = len(item), len(passage)
    table = np.zeros((n + 1, m + 1), np.int32)
    places = np.arange(m + 1, dtype=np.int32)
    row = np.zeros(m + 1, np.int32)
    for i in range(1, n + 1):
        above = table[i - 1]
        row[1:] = np.maximum(above[:-1] + np.where(passage == item[i - 1], MATCH, MISMATCH), above[1:] + SKIP)
        np.maximum(row, 0, out=row)
        # words left out of the item's side: a running maximum that falls by one a word
        table[i] = np.maximum.accumulate(row - SKIP * places) + SKIP * places
    i, j = divmod(int(table.argmax()), m + 1)
    score, matched, end = int(table[i, j]), 0, j
    while table[i, j] > 0:
        equal = item[i - 1] == passage[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if equal else MISMATCH):
            matched += bool(equal)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + SKIP:
            i -= 1
        else:
            j -= 1
    return score, matched, j, end


ALIGNED = (
    "doc_id {kind}, text_key bigint, item_key bigint, similarity double, matched bigint, item_words bigint, "
    "word_start bigint, word_end bigint"
)


def aligned(passages: DataFrame, shared, rare) -> DataFrame:
    """Alignment of each passage that asks for one with its item, if it counts as contamination."""
    kind = passages.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            rows = []
            for doc_id, key, start, words, item, slots in zip(*(c.to_pylist() for c in batch.columns)):
                if not enough(index, rare.value, item, np.array(slots, np.int64)):
                    continue
                target = index.words[item]
                passage = _numbers(words.split(" "), index.vocabulary)
                # words that no item has are equal to none
                score, matched, low, high = align(target, np.where(passage > 0, passage, -1))
                similarity = score / (MATCH * len(target))
                good = similarity >= SIMILARITY and matched >= min(SHORT_ITEM, len(target))
                if good or matched >= LONG_MATCH:
                    item_key = int(index.keys[item])
                    rows.append((doc_id, key, item_key, similarity, matched, len(target), start + low, start + high))
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.float64()] + 4 * [pa.int64()]
            columns = zip(*rows) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=[part.split()[0] for part in ALIGNED.split(", ")],
            )

    columns = ["doc_id", "text_key", "start", "words", "item", "slots"]
    return map_arrow(passages.select(*columns), run, ALIGNED.format(kind=kind.simpleString()))


def _block_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    context = docs.sparkSession.sparkContext
    # at most about BLOCK_WORDS words, by the split into blocks
    rows = items.dropDuplicates(["item_key"]).select("item_key", "words").orderBy("item_key").collect()
    index = build_index([row["words"] for row in rows], [row["item_key"] for row in rows])
    shared = context.broadcast(index)
    marks = stage(marked(docs, shared), "decontaminate-marks")
    # a number for each n-gram of the block
    counted = marks.filter("n IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = (counted.column(c).to_numpy() for c in ("slot", "n"))
    documents = np.zeros(len(index.grams), np.int64)
    documents[slot[slot >= 0]] = n[slot >= 0]
    rare = context.broadcast(is_rare(index, documents, int(n[slot < 0].sum())))
    return aligned(marks.filter("n IS NULL"), shared, rare)


def untestable(benchmark: DataFrame) -> DataFrame:
    """Items of fewer than ``GRAM`` words (null ones too), which have no n-gram and so match nothing."""
    return benchmark_items(benchmark).filter(F.size("words") < GRAM).select("item_id").unionByName(
        benchmark.filter(~F.coalesce("text", F.lit("")).rlike(r"(?U)\\w")).select("item_id")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it contains, in whole or in an edited copy.

    ``doc_id``, ``text_key`` (XXH64 of the text, to tell rows that repeat an id apart), ``item_id``,
    ``similarity`` (alignment score over that of a full match), ``matched`` words, ``item_words``, and
    the passage's words ``word_start`` to ``word_end``. A pair counts from a similarity of
    ``SIMILARITY`` with at least ``SHORT_ITEM`` equal words (or the whole of a shorter item), or from
    ``LONG_MATCH`` equal words. Null and empty texts match nothing; items under ``GRAM`` words are too
    short to test (:func:`untestable` lists them). Repeated rows give one row; null ids are kept as ids;
    other columns are ignored. Empty tables give none.
    """
    items = stage(benchmark_items(benchmark), "decontaminate-items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_key"), F.lit(blocks))
    hits = reduce(
        DataFrame.union,
        [_block_hits(docs, items if blocks == 1 else items.filter(block == b)) for b in range(blocks)],
    )
    order = F.struct("similarity", "matched", (-F.col("word_start")).alias("first"))
    values = F.struct("similarity", "matched", "item_words", "word_start", "word_end")
    best = hits.groupBy("doc_id", "text_key", "item_key").agg(F.max_by(values, order).alias("best"))
    ids = items.select("item_id", "item_key").distinct()
    rows = best.join(ids, "item_key").groupBy("doc_id", "text_key", "item_id").agg(
        F.max("best").alias("best")
    )
    return rows.select("doc_id", "text_key", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain an item, all columns as they are.

    Equal rows go together; null ids are ids; a benchmark without items drops nothing; an empty table stays
    one.
    """
    found = contaminated(docs, benchmark).select("doc_id", "text_key").distinct()
    drops = stage(found.withColumn("one", F.lit(False)), "decontaminate-hits")
    return drop_rows(docs, drops, {"text_key": F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
