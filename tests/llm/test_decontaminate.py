"""Decontamination against brute force, and the whole pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import no_documents, odd_documents, prose
from tsreg.llm import decontaminate, packing, quality
from tsreg.llm.decontaminate import MATCH, MISMATCH, SKIP, align, words_of


def slow_align(item, passage):
    table = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            equal = MATCH if item[i - 1] == passage[j - 1] else MISMATCH
            table[i, j] = max(0, table[i - 1, j - 1] + equal, table[i - 1, j] + SKIP, table[i, j - 1] + SKIP)
    return int(table.max())


def test_align():
    rng = random.Random(1)
    for _ in range(60):
        item = np.array([rng.randrange(6) for _ in range(rng.randint(1, 20))])
        passage = np.array([rng.randrange(6) for _ in range(rng.randint(1, 40))])
        score, matched, low, high = align(item, passage)
        assert score == slow_align(item, passage)
        assert score == 0 or (0 <= low < high <= len(passage) and matched * MATCH >= score)
        assert score == slow_align(item, passage[low:high])


def marks_of(index, words):
    numbers = decontaminate.gram_numbers(decontaminate._numbers(words, index.vocabulary))
    places = np.flatnonzero(np.isin(numbers, index.grams) & (numbers >= 0))
    return places, np.searchsorted(index.grams, numbers[places])


def test_runs_hold_all_near_pairs_of_seeds():
    """Against brute force: an item with two distinct n-grams on near diagonals is met."""
    rng = random.Random(2)
    items = [[rng.choice("abcdefgh") for _ in range(rng.randint(9, 30))] for _ in range(20)]
    index = decontaminate.build_index(items, list(range(20)))
    for _ in range(20):
        words = [rng.choice("abcdefghxy") for _ in range(rng.randint(10, 300))]
        places, slots = marks_of(index, words)
        want = set()
        for k, item in enumerate(items):
            found = [
                (p - i, tuple(item[i : i + 3]))
                for p in range(len(words) - 2)
                for i in range(len(item) - 2)
                if words[p : p + 3] == item[i : i + 3]
            ]
            if any(abs(d - e) <= decontaminate.DRIFT and g != h for d, g in found for e, h in found):
                want.add(k)
        assert {run.item for run in decontaminate.runs(index, places, slots)} == want


def test_common_prose_makes_few_pairs(spark):
    """Words as frequent as in real prose: long documents are aligned with few items, their leaks are found."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(5000)])
    share = 1 / np.arange(1, 5001)
    share /= share.sum()
    items = [" ".join(rng.choice(words, 40, p=share)) for _ in range(5000)]
    texts = [" ".join(rng.choice(words, 10_000, p=share)) for _ in range(12)]
    texts += [f"{texts[0][:3000]} {items[k]} {texts[1][:3000]}" for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    index = decontaminate.build_index([t.split() for t in items], list(range(len(items))))
    marks = decontaminate.marked(docs, spark.sparkContext.broadcast(index)).collect()
    counts = {r.slot: 0 for r in marks if r.n}
    for row in marks:
        if row.n:
            counts[row.slot] += row.n
    assert counts.pop(-1) == len(texts)
    documents = np.zeros(len(index.grams), np.int64)
    documents[list(counts)] = list(counts.values())
    rare = decontaminate.is_rare(index, documents, len(texts))
    pairs = [(r.doc_id, r.item) for r in marks if r.item is not None and decontaminate.enough(index, rare, r.item, np.array(r.slots))]
    assert {(12 + k, k) for k in range(3)} <= set(pairs)
    most = max(sum(d == k for d, _ in set(pairs)) for k in range(12))
    assert most < 0.01 * len(items)


def test_document_frequencies(spark):
    """The marking pass counts each n-gram once for a document that has it."""
    rng = random.Random(4)
    items = [[rng.choice("abcd") for _ in range(12)] for _ in range(4)]
    texts = [" ".join(rng.choice("abcdx") for _ in range(40)) for _ in range(30)] + ["", None]
    index = decontaminate.build_index(items, list(range(4)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    marks = decontaminate.marked(docs, spark.sparkContext.broadcast(index)).filter("n IS NOT NULL")
    got = {r.slot: r.n for r in marks.groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    want = {-1: len(texts)}
    for text in texts:
        for slot in set(marks_of(index, (text or "").split())[1].tolist()):
            want[slot] = want.get(slot, 0) + 1
    assert got == want


def edited(rng, words, every):
    """Every n-th word replaced, left out or doubled by another."""
    out = []
    for k, word in enumerate(words):
        if k % every == every - 1:
            out += rng.choice([["changed"], [], [word, "added"]])
        else:
            out.append(word)
    return out


def test_contaminated(spark):
    rng = random.Random(3)
    items = [prose(rng, n) for n in (15, 30, 55, 9, 1500)] + ["what is it called", "a b", "", None]
    benchmark = spark.createDataFrame(
        [(k, t, 0) for k, t in enumerate(items)] + [(100, items[0], 0), (None, items[1].upper(), 0)],
        "item_id bigint, text string, words int",
    )

    def around(text):
        return f"{prose(rng, 120)} {text} {prose(rng, 90)}"

    rows = [(k, around(items[k])) for k in range(5)]
    rows += [(10 + k, around(" ".join(edited(rng, items[k].split(), 8)))) for k in (1, 2)]
    rows += [(20, prose(rng, 300)), (21, None), (22, ""), (23, items[2][:60]), (None, around(items[3]))]
    rows += [(30, around("What is it, called?")), (31, around("what it is called")), (32, around(items[0].upper()))]
    rows += [(33, prose(rng, 9000) + " " + items[1] + " " + prose(rng, 9000)), (0, "clean text, same id"), rows[0]]
    rows += [(40 + k, around(items[0])) for k in range(200)]  # a passage that most rows share
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("words", F.lit("x"))
    found = decontaminate.contaminated(docs, benchmark)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert found.count() == len(got)  # repeated rows count once
    want = {(0, 0), (0, 100), (1, 1), (1, None), (2, 2), (3, 3), (4, 4), (11, 1), (11, None), (12, 2), (None, 3)}
    want |= {(30, 5), (32, 0), (32, 100), (33, 1), (33, None)}
    want |= {(40 + k, i) for k in range(200) for i in (0, 100)}
    assert got == want
    exact = next(r for r in found.collect() if (r.doc_id, r.item_id) == (33, 1))
    words = words_of(dict(rows)[33].encode())
    assert words[exact.word_start : exact.word_end] == items[1].split() and exact.similarity == 1
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted(
        t or "" for i, t in rows if i in (20, 21, 22, 23, 31) or t == "clean text, same id"
    )
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(odd_documents(spark), benchmark).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    rng = random.Random(8)
    items = [prose(rng, 40) for _ in range(12)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"{prose(rng, 50)} {t}") for k, t in enumerate(items)], "doc_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(k, k) for k in range(12)}


@pytest.mark.parametrize("copies", [False, True])
def test_every_edited_copy_that_aligns_is_found(spark, copies):
    """One word in 4 to 7 replaced: against brute force, whether or not the item is in the corpus as it is."""
    rng = random.Random(21)
    items = [prose(rng, n) for n in (15, 24, 31, 40, 57)]
    rows, want = [], set()
    for every in range(4, 8):
        for k, item in enumerate(items):
            words = item.split()
            words[every - 1 :: every] = [f"changed{j}" for j in range(len(words) // every)]
            doc_id = 100 * every + k
            rows.append((doc_id, f"{prose(rng, 80)} {' '.join(words)} {prose(rng, 80)}"))
    if copies:
        rows += [(1000 + k, f"{prose(rng, 20)} {t}") for k, t in enumerate(items)]
    for doc_id, text in rows:
        for k, item in enumerate(items):
            number = {w: n for n, w in enumerate(item.split())}
            target = np.array([number[w] for w in item.split()])
            score = slow_align(target, np.array([number.get(w, -1) for w in text.split()]))
            if score >= decontaminate.SIMILARITY * MATCH * len(target):
                want.add((doc_id, k))
    assert len(want) >= len(rows)  # all of them align
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == want


def test_long_items_have_no_short_segment(spark):
    rng = random.Random(9)
    for n in (0, 1, 1024, 1025, 1027, 1792, 1793, 5000):
        words = [str(k) for k in range(n)]
        parts = decontaminate.segments(words)
        assert {w for p in parts for w in p} == set(words) and all(len(p) == min(n, 1024) for p in parts)
        shared = [len(set(a) & set(b)) for a, b in zip(parts, parts[1:])]
        assert all(s >= decontaminate.SHARED for s in shared)
    long = [f"w{k}" for k in range(1024)] + "of the same".split()
    rows = [
        (0, f"{prose(rng, 60)} of the same {prose(rng, 60)}"),
        (2, f"{prose(rng, 60)} {' '.join(long[500:570])}"),
        (3, f"{prose(rng, 60)} {' '.join(long[985:1027])} {prose(rng, 60)}"),  # 42 words are not enough
    ]
    across = [f"v{k}" for k in range(1500)]
    rows.append((4, f"{prose(rng, 60)} {' '.join(across[990:1060])} {prose(rng, 60)}"))  # over word 1024
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = [(0, " ".join(long)), (1, " ".join(across))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(2, 0), (4, 1)}


@pytest.fixture()
def corpus(spark, tmp_path):
    """Documents with planted copies, near copies, leaks and junk, some labelled."""
    rng = random.Random(12)
    items = [prose(rng, 30) for _ in range(5)]
    good = [prose(rng, rng.randint(60, 200)) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(good)]
    labels = [(k, 1, 0) for k in range(120)]
    for k in range(200, 260):
        rows.append((k, "$$$ ".join(prose(rng, 80).split()).upper()))
        labels.append((k, 0, 0))
    rows += [(300 + k, good[k].upper()) for k in range(10)]  # judged by its looks, not an equal text after case
    rows += [(400 + k, good[k].capitalize()) for k in range(10)]
    rows += [(500 + k, f"{good[20 + k]} {items[k]} {good[30 + k]}") for k in range(5)]
    long = prose(rng, 3000).split()
    rows += [(600, " ".join(long)), (601, " ".join([*long[:1500], "other", *long[1501:]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept, columns = {}, docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, corpus)
        assert docs.columns == columns
        docs.write.parquet(f"{corpus}/{name}")
        docs = spark.read.parquet(f"{corpus}/{name}")
        kept[name] = before - {r.doc_id for r in docs.collect()}
    scores = quality.quality_scores(
        spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    )
    assert kept["quality_classifier"] == {r.doc_id for r in scores.collect() if not r.predicted}
    assert kept["quality_classifier"] >= set(range(200, 260)) and not kept["quality_classifier"] & set(range(120))
    lower = kept["exact_dedup"]
    assert lower >= {k for k in range(10)} and not lower & set(range(10, 120))
    assert kept["simhash_near_dedup"] == {601}
    assert kept["benchmark_decontamination"] == {500, 501, 502, 503, 504}
    rows = corpus_pipeline.run(spark, corpus).collect()
    left = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in rows} == left
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for make in (odd_documents, no_documents):
        docs = make(spark)
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= n
        assert packing.pack(docs).count() >= n
