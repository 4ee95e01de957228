"""Exact and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

import corpus_pipeline
from tests.llm.cases import no_documents, odd_documents, plain, prose
from tsreg.llm import common, exact_dedup, simhash
from tsreg.llm.components import components


def normal(text):
    return (text or "").encode().lower()


def test_filters_round_trip_and_merge():
    rng = np.random.default_rng(1)
    for bits in (1, 6, 20):
        prints = np.unique(rng.integers(0, 1 << 64, 500, dtype=np.uint64))
        blocks = (prints >> np.uint64(64 - bits)).astype(np.int64)
        for block in np.unique(blocks)[:50]:
            mine = prints[blocks == block]
            counts = rng.integers(1, 9, len(mine))
            names = [f.name for f in exact_dedup.FILTERS]
            row = dict(zip(names, exact_dedup.build_filter(int(block), bits, mine, counts)))
            got, n = exact_dedup.read_filter(bits, row)
            assert (got == mine).all() and (n == counts).all()
    a, n = exact_dedup.merged(np.array([3, 9, 3, 1], np.uint64), np.array([1, 2, 4, 1]))
    assert a.tolist() == [1, 3, 9] and n.tolist() == [1, 5, 2]


@pytest.mark.parametrize("most", [2, 300, 1 << 40])
def test_filters_are_small_and_merge_in_any_number(most):
    """A slot takes its remainder's bytes, two bits and its share of the table, larger counts excepted."""
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 58, 1 << 14, dtype=np.uint64))  # block 0 of 64
    total: dict[int, int] = {}
    rows = []
    for _ in range(9):
        mine = prints[rng.random(len(prints)) < 0.5]
        counts = np.where(rng.random(len(mine)) < 0.1, rng.integers(1, most, len(mine)), 1)
        row = exact_dedup.build_filter(0, 6, mine, counts)
        rows.append(dict(zip([f.name for f in exact_dedup.FILTERS], row)))
        held = sum(len(v) for v in row[2:6])
        assert held <= 6.5 * len(mine) and len(row[6]) <= 8 * int((counts > 1).sum())
        for value, n in zip(mine.tolist(), counts.tolist()):
            total[value] = total.get(value, 0) + n
    got, n = exact_dedup.merge_filters(exact_dedup.read_filter(6, row) for row in rows)
    assert dict(zip(got.tolist(), n.tolist())) == total
    assert (got[1:] > got[:-1]).all()


def test_exact_groups(spark):
    docs = odd_documents(spark)
    source = [(r.doc_id, normal(r.text)) for r in docs.collect()]
    groups = {}
    for doc_id, text in source:
        groups.setdefault(text, []).append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((repr(r.doc_id), r.text_sha256) for r in got) == sorted(
        (repr(i), hashlib.sha256(t).hexdigest()) for i, t in source
    )
    by_sha = {hashlib.sha256(t).hexdigest(): t for t in groups}
    for row in got:
        text = by_sha[row.text_sha256]
        assert row.keep_id == keep[text] and row.group_size == len(groups[text])
    kept = [by_sha[r.text_sha256] for r in got if r.kept]
    assert sorted(kept) == sorted(groups)  # one row of each group, ties included
    left = exact_dedup.drop_exact(docs)
    assert left.columns == docs.columns
    assert sorted(normal(r.text) for r in left.collect()) == sorted(groups)


def test_nothing_to_do(spark):
    assert exact_dedup.exact_groups(no_documents(spark)).count() == 0
    assert exact_dedup.drop_exact(no_documents(spark)).count() == 0
    assert simhash.near_groups(no_documents(spark)).count() == 0
    assert simhash.drop_near(no_documents(spark)).count() == 0


def slow_fingerprint(text, width=4):
    words = normal(text).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    """Smallest fingerprint that links reach."""
    prints, found = sorted(set(prints)), {}
    for first in prints:
        if first in found:
            continue
        todo, found[first] = [first], first
        while todo:
            one = todo.pop()
            for other in prints:
                if other not in found and (one ^ other).bit_count() <= radius:
                    found[other] = first
                    todo.append(other)
    return found


def near(rng, n, centres, most):
    """Random fingerprints, many of them a few bits from others."""
    out = [rng.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most))))
    return out


def test_fingerprint():
    rng = random.Random(3)
    for text in ["", "  ", "A", "b c", "one two three four", prose(rng, 50), prose(rng, 400).upper(), "É é x"]:
        assert simhash.fingerprint(normal(text)) == slow_fingerprint(text)
    long = prose(rng, 40_000)  # more shingles than are hashed at a time
    assert simhash.fingerprint(normal(long)) == slow_fingerprint(long)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_within(radius):
    rng = random.Random(radius)
    prints = np.array(near(rng, 700, 40, 9), np.uint64)
    planes = simhash.bit_planes(prints)
    query = int(prints[13])
    words = [simhash.ALL if query.to_bytes(8, "little")[b // 8] >> (7 - b % 8) & 1 else np.uint64(0) for b in range(64)]
    alive = simhash._words_of(np.ones(700, bool))
    mask = simhash.within((p ^ w for p, w in zip(planes, words)), radius, alive)
    got = simhash._bits_of(mask)[:700].astype(bool)
    assert (got == (np.bitwise_count(prints ^ np.uint64(query)) <= radius)).all()


def partition(label):
    groups = {}
    for member, key in label.items():
        groups.setdefault(key, set()).add(member)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("sizes", [[1, 2, 3, 70, 1, 250, 2], [300, 2, 900], [5] * 400])
def test_cells(sizes):
    rng = random.Random(len(sizes))
    prints = []
    for size in sizes:  # no fingerprint in two cells
        mine = set()
        while len(mine) < size:
            mine |= set(near(rng, size - len(mine), 1 + size // 3, 5)) - set(prints)
        prints += sorted(mine)[:size]
    groups = np.repeat(np.arange(len(sizes)), sizes)
    u, v = simhash.cell_links(groups, np.array(prints, np.uint64), 4)
    label = {p: p for p in prints} | {int(a): int(b) for a, b in zip(u, v)}
    want = {}
    for group in range(len(sizes)):
        want |= slow_components([p for p, g in zip(prints, groups) if g == group], 4)
    assert partition(label) == partition(want)


@pytest.mark.parametrize("n", [40, 1500])
def test_links_of_one_cell(n):
    rng = random.Random(n)
    prints = np.array(sorted(set(near(rng, n, n // 4, 6))), np.uint64)
    u, v = simhash.cell_links(np.zeros(len(prints), np.int64), prints, 4)
    label = {int(p): int(p) for p in prints}
    label |= {int(a): int(b) for a, b in zip(u, v)}
    want = slow_components([int(p) for p in prints], 4)
    assert partition(label) == partition(want)


@pytest.mark.parametrize("chunk", [8192, 20])
def test_links(spark, chunk):
    rng = random.Random(chunk)
    prints = set(near(rng, 500, 60, 6))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    found = {r.node: r.component for r in components(simhash.links(distinct, 4, chunk)).collect()}
    got = {}
    for p, s in zip(prints, signed):
        got.setdefault(found.get(s, s), set()).add(p)
    want = {}
    for p, k in slow_components(prints, 4).items():
        want.setdefault(k, set()).add(p)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values()}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_near_groups(spark):
    docs = odd_documents(spark)
    source = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [slow_fingerprint(t) for _, t in source]
    roots = slow_components(prints, 4)
    low = {}
    for (doc_id, _), p in zip(source, prints):
        if doc_id is not None:
            low[roots[p]] = min(doc_id, low.get(roots[p], doc_id))
    want = sorted(((i, f"{p:016x}", low.get(roots[p])) for (i, _), p in zip(source, prints)), key=repr)
    assert plain(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    left = simhash.drop_near(docs)
    assert left.columns == docs.columns
    kept = [roots[slow_fingerprint(r.text)] for r in left.collect()]
    assert sorted(kept) == sorted(set(roots.values()))
    ids = {roots[slow_fingerprint(r.text)]: r.doc_id for r in left.collect()}
    assert ids == {root: low.get(root) for root in set(roots.values())}


def test_pipeline_drops_near_copies(spark):
    """Against brute force: one document of each component of links within 4 bits stays."""
    rng = random.Random(6)
    texts = []
    for n in (100, 300, 1000):
        for _ in range(15):
            words = prose(rng, n).split()
            texts += [" ".join(words), " ".join([*words[:-1], "new"]), " ".join(words).upper()]
    base = prose(rng, 2000).split()
    for k in range(60):
        texts.append(" ".join(f"x{k}" if j == 30 * k else w for j, w in enumerate(base)))
    texts += [" ".join(base), "one two", "one two three four five", "", None]
    prints = [slow_fingerprint(t) for t in texts]
    roots = slow_components(prints, 4)
    want = {}
    for k, p in enumerate(prints):
        want.setdefault(roots[p], k)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    left = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(want.values())


def test_rows_that_are_not_listed_stay(spark):
    """The filter lets all listed ids through; null ids, ties and clashing names are heeded."""
    rows = [(k, f"t{k}", "a", "b", True) for k in range(3000)] + [(None, "n", "a", "b", True)] * 2 + [(5, "other", "a", "b", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, _drop_doc_id string, one boolean")
    listed = [(k, f"t{k}", False) for k in range(0, 3000, 3)] + [(None, "n", True), (5, "none", False)]
    drops = spark.createDataFrame(listed, "doc_id bigint, text string, one boolean")
    left = common.drop_rows(docs, drops, {"text": F.col("text")})
    assert left.columns == docs.columns
    want = [(k, f"t{k}") for k in range(3000) if k % 3] + [(5, "other"), (None, "n")]
    assert plain(left, "doc_id", "text") == sorted(want, key=repr)


def test_clashing_names(spark):
    """Columns named like the operators' own change nothing."""
    docs = odd_documents(spark)
    names = ["_quality_score", "_keep_key", "_keep_id", "_text_key", "_text_sha256", "_drop_one"]
    wide = docs.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for drop in (exact_dedup.drop_exact, simhash.drop_near):
        left = drop(wide)
        assert left.columns == wide.columns and left.count() == drop(docs).count()
