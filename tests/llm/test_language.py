"""The language models against a plain dictionary version, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tests.llm.cases import no_documents, odd_documents
from tsreg.llm import language

SF = "/root/testdata/sf0.01"
TEXTS = {
    "aa": ["Aba cab abba, cabba! " * 3, "bac abac; CABA"],
    "bb": ["xyz zzy yxz xy", "Zyx 12 zyxy abz", "ünï ÿx"],
}


def symbols(text):
    out, blank = [], True
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif not blank:
            out.append(" ")
        blank = not c.isalpha()
    return out


def plain_models(texts):
    """Kneser-Ney by recursion over dictionaries: language -> probability of a symbol after three others."""
    models = {}
    for lang, held in texts.items():
        counts = Counter()
        for text in held:
            s = [" "] * 3 + symbols(text)
            counts.update(tuple(s[k : k + 4]) for k in range(len(s) - 3))
        levels = {4: counts}
        for order in (3, 2, 1):
            levels[order] = Counter(gram[1:] for gram in levels[order + 1])

        def probability(gram, levels):
            if not gram:
                return 2.0**-16
            level = levels[len(gram)]
            once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
            taken = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
            same = [n for g, n in level.items() if g[:-1] == gram[:-1]]
            rest = probability(gram[1:], levels)
            if not same:
                return rest
            return max(level.get(gram, 0) - taken, 0) / sum(same) + taken * len(same) / sum(same) * rest

        models[lang] = lambda gram, f=probability, levels=levels: f(gram, levels)
    return models


def test_probabilities():
    """Sorted hash arrays hold the interpolated probabilities, unseen n-grams back off to the same."""
    counts = {}
    for lang, held in TEXTS.items():
        grams, _ = language.grams_of([t.encode() for t in held])
        counts[lang] = np.unique(grams, return_counts=True)
    models = language.kneser_ney(counts)
    plain = plain_models(TEXTS)
    probes = ["aba cab", "zyx! 7 qqq", "abz xyz ünx", "é", "日本 a", "\U0001f600\U00010400 b"]
    found = language.entropies(models, [p.encode() for p in [*probes, "", " 12 !"]])
    for row, text in zip(found, probes):
        s = [" "] * 3 + ["￿" if ord(c) > 0xFFFF else c for c in symbols(text)]
        for column, lang in enumerate(models.languages):
            bits = [-math.log2(plain[lang](tuple(s[k : k + 4]))) for k in range(len(s) - 3)]
            assert math.isclose(row[column], sum(bits) / len(bits), rel_tol=1e-5)
    assert np.isnan(found[-2:]).all()


def test_sums_to_one():
    grams, _ = language.grams_of([t.encode() for t in TEXTS["aa"]])
    models = language.kneser_ney({"aa": np.unique(grams, return_counts=True)})
    plain = plain_models({"aa": TEXTS["aa"]})["aa"]
    for context in [("a", "b", "a"), (" ", " ", " "), ("q", "q", "q")]:
        known = sum(plain((*context, c)) for c in "abc ")
        other = plain((*context, "?"))
        assert math.isclose(known + other * (2**16 - 4), 1, rel_tol=1e-6)
    assert models.languages == ["aa"]


def test_find_every_key():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    made = language._table(keys, np.arange(len(keys), dtype=float)[:, None])
    at, found = made.find(keys)
    assert found.all() and np.array_equal(made.values[at][:, 0], np.arange(len(keys)))
    assert not made.find(keys + np.uint64(1 << 63))[1].any()


def test_held_out_accuracy(spark):
    """Documents that nothing was learned from: nearly all get their language, with a calibrated score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.languages(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(found) == len(lang)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in held]
    assert sum(right) >= 0.985 * len(right)
    assert abs(sum(r["score"] for r in held) / len(held) - sum(right) / len(right)) < 0.03
    assert sum(r["rejected"] for r in held) < 0.05 * len(held)


def test_labels_of_held_out_rows_dont_matter(spark):
    """Held-out languages, sources and ids never enter a prediction."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    changed = docs.selectExpr(
        "doc_id", "text", "if(pmod(crc32(string(doc_id)), 5) = 0, 'zz', lang) AS lang", "'s' AS source"
    )
    assert sorted(language.languages(docs).collect()) == sorted(language.languages(changed).collect())


def test_other_scripts_are_rejected(spark):
    """A text in none of the languages is far from its nearest one."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["the", "and", "of", "ing", "on"]) for _ in range(60)), "en") for k in range(200)]
    rows += [(1000 + k, "日本語のテキストです" * 5, None) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r for r in language.languages(docs).collect()}
    assert all(found[1000 + k]["rejected"] and found[1000 + k]["lang_pred"] == "en" for k in range(3))
    assert sum(found[k]["rejected"] for k in range(200)) < 10


def test_odd_rows(spark):
    found = language.languages(odd_documents(spark)).collect()
    assert len(found) == 16
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append(r)
    assert [r["lang_pred"] for r in by_id[2] + by_id[3] + by_id[4]] == ["und"] * 3
    assert all(r["score"] == 0 and r["rejected"] for r in by_id[2])
    assert by_id[5][0]["lang_pred"] == "en" and by_id[5][0]["score"] == 1
    assert not any(r["held_out"] for r in by_id[None])
    assert language.languages(no_documents(spark)).collect() == []
    unknown = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert [r["lang_pred"] for r in language.languages(unknown).collect()] == ["und"]


def _made_up(spark, languages):
    """Documents in made-up languages, each with an alphabet of its own order of use."""
    rng = random.Random(5)
    rows = []
    for k in range(languages):
        words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(12)]
        rows += [(k + 1000 * i, " ".join(rng.choices(words, k=40 if k else 80)), f"l{k:03d}") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_every_language_is_learned(spark):
    """No number of languages is too many."""
    docs = _made_up(spark, 140)
    found = {r["doc_id"]: r["lang_pred"] for r in language.languages(docs).collect()}
    assert all(found[k + 1000 * i] == f"l{k:03d}" for k in range(140) for i in range(10))


def test_every_gram_counts(spark):
    """A model that doesn't fit the workers gives the entropies of all n-grams, wherever they are held."""
    docs = odd_documents(spark).select("doc_id", "text", "lang").unionByName(_made_up(spark, 12))
    docs = docs.unionByName(spark.createDataFrame([(9000, "日本語 \U0001f600\U00010400 über", "ja")], docs.schema))
    whole = language.train(docs)
    assert isinstance(whole, language.Models)

    def bits(models):
        rows = language.with_entropies(docs, models).collect()
        return sorted((str(r["doc_id"]), r["lang"] or "", [-1 if math.isnan(b) else b for b in r["bits"]]) for r in rows)

    expected = bits(whole)
    for frequent in (0, 3000, 1 << 22):
        large = language.train(docs, rows=10, frequent=frequent)
        assert isinstance(large, language.Weights) and large.languages == whole.languages
        assert bool(large.frequent.others) == (frequent < 1 << 22)
        for (d, lang, b), row in zip(expected, bits(large), strict=True):
            assert (d, lang) == row[:2] and np.allclose(b, row[2], rtol=1e-5)


def test_predictions_of_a_large_model(spark, monkeypatch):
    """Whole query results don't depend on where the weights are held."""
    docs = _made_up(spark, 6)
    small = {r["doc_id"]: r for r in language.languages(docs).collect()}
    large = language.train(docs, rows=10, frequent=500)
    monkeypatch.setattr(language, "train", lambda docs: large)
    found = {r["doc_id"]: r for r in language.languages(docs).collect()}
    assert found.keys() == small.keys()
    for d, r in found.items():
        assert (r["lang_pred"], r["held_out"], r["rejected"]) == tuple(small[d][c] for c in ("lang_pred", "held_out", "rejected"))
        assert math.isclose(r["score"], small[d]["score"], abs_tol=1e-4)
