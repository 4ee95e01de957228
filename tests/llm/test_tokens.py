"""Token counts and packing against the tokenizer's library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import no_documents, odd_documents, plain, prose
from tsreg.llm import packing, tokens

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.tokenizer_file())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


STRANGE = [
    "", " ", "a", "The the THE the. the, (the) \"the\"", "it's 'tis don't I'LL we've x'd 'S",
    "É é E\u0301 H\u0331 h\u0331 İ ß ẞ Σ ΑΣ ς ﬁ ½ ² µ ª", "中文 日本語テキスト 한국어", "1234 5 6,7.8 ١٢٣",
    "a\x00b \x1f \x85 x\u00a0y\u2003z\u3000w", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|",
    "emoji 👩‍👩‍👧 🇩🇪 ❤️", "!!! ... ?!?! $$$%%%###", "_under_score_ snake_case", "x" * 500, "ab " * 50,
    "Straße ÀÉÎ naïve×÷", "\u0301 \u0301a", "\r\n\t\x0b\x0c mixed\twhite\nspace",
]


def test_encoder_is_exact(library):
    rng = random.Random(2)
    alphabet = "abcXYZéÉßñ0189 \n\t.,!'\"<|>_-\u0301İΣ中\u00a0"
    texts = STRANGE + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)] + [prose(rng, 300)]
    with open(tokens.tokenizer_file(), encoding="utf-8") as file:
        source = file.read()
    for entries in (10, 100_000):  # small caches are emptied again and again
        encoder = tokens.Encoder(source, entries)
        for low in range(0, len(texts), 50):
            part = texts[low : low + 50]
            got = encoder.encode([t.encode() for t in part])
            for text, raw in zip(part, got):
                assert np.frombuffer(raw, "<u4").tolist() == ids_of(library, text), text
    frequent = [b"the", b"the.", "É".encode(), b"<|endoftext|>"]
    for chunks in ([], frequent):
        counter = tokens.Counter(tokens.length_table(source, chunks), tokens.Encoder(source, 10))
        for low in range(0, len(texts), 50):
            part = texts[low : low + 50]
            assert counter.count([t.encode() for t in part]) == [len(ids_of(library, t)) for t in part]


def test_encoder_takes_nulls_and_broken_text(library):
    with open(tokens.tokenizer_file(), encoding="utf-8") as file:
        encoder = tokens.Encoder(file.read())
    raw = [None, b"", b" \n ", b"caf\xc3 caf\xc3\xa9 \xff\xfe", b"x" * 70 + b" the the."]
    got = encoder.encode(pa.array(raw, pa.binary()))
    want = [ids_of(library, (t or b"").decode("utf-8", "replace")) for t in raw]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == want
    assert encoder.encode(pa.array([], pa.string())) == []


def test_token_counts(spark, library):
    docs = odd_documents(spark)
    want = [
        (r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text)), len(ids_of(library, r.text)) > 2048)
        for r in docs.collect()
    ]
    got = tokens.token_counts(docs)
    assert plain(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert tokens.token_counts(no_documents(spark)).count() == 0


@pytest.mark.parametrize("window", [4096, 64])
def test_packing(spark, library, window):
    docs = odd_documents(spark)
    want = defaultdict(int)
    for row in docs.collect():
        ids = ids_of(library, row.text) + [packing.END_ID]
        want[row.doc_id, tuple(ids)] += 1
    rows = packing.pack(docs, window=window, with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append(row)
        pieces[row.doc_id, row.doc_tokens].append(row)
        assert row.length == len(row.ids) > 0
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
    padding = 0
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in held]).tolist()
        assert [r.offset for r in held] == [0, *ends[:-1]]
        total = ends[-1]
        assert total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    assert padding == 0
    for (doc_id, total), count in ((k, v) for k, v in want.items()):
        held = pieces[doc_id, len(total)]
        # every place of the document is in as many pieces as there are such rows
        cover = np.zeros(len(total), int)
        for row in held:
            assert list(total[row.start : row.start + row.length]) == row.ids or len(total) < 50
            cover[row.start : row.start + row.length] += 1
        same = sum(n for (i, t), n in want.items() if i == doc_id and len(t) == len(total))
        assert (cover == same).all() and count
    assert packing.pack(no_documents(spark)).count() == 0


def test_levels_minimise_the_sum_of_squares():
    rng = random.Random(4)
    packer = packing.Packer(40)
    for k in range(400):
        size = rng.randint(1, 39)
        before = packer.counts.copy()

        def after(level):
            counts = before.copy()
            counts[level] -= level > 0
            if level + size < 40:
                counts[level + size] += 1
            return int((counts**2).sum())

        options = [0] + [h for h in range(1, 40 - size + 1) if before[h]]
        chosen = packer.level_for(size)
        assert chosen in options and after(chosen) == min(map(after, options))
        packer.place((k, 0, b"\0" * 4 * size, size))
        assert packer.counts[0] == 0 and packer.counts[40] == 0
        assert all(packer.counts[h] == len(packer.open[h]) for h in range(41))
