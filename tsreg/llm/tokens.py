"""Token ids and token counts of whole texts, exactly as the tokenizer's library gives them.

ASCII white space always separates pre-tokens of the supported tokenizer, so a text is cut there
and each distinct chunk of a batch is encoded once. Chunks of plain letters and punctuation are encoded many
at a time, joined by blanks: every pre-token ends in a token that carries the end-of-word mark.
All other chunks (digits, other scripts, combining marks, special strings) are encoded one by one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreg.llm.common import map_arrow, texts_of, worker_cache

CACHE_ENTRIES = 250_000
LONGEST_CACHED = 64
JOINED = 200
AT_ONCE = 4_000  # chunks whose encodings are held at a time
OWNER = "tokens"
FREQUENT = 20_000
SKETCH_ITEMS = 1 << 16
SKETCH_GROUPS = 32
LIMIT = 2048

# letters that no normalisation to NFC changes and that lower-case one to one, then marks without
# apostrophe and "<"
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)$"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(texts: pa.Array) -> pa.Array:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    found = texts.view(pa.string())
    try:
        found.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
    return found


def sizes_of(raw: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, raw), np.int64, len(raw)) // 4


def gather(pool: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` with these numbers, one after the other, and their bounds from 0 on."""
    starts, lengths = np.cumsum(sizes) - sizes, sizes[numbers]
    ends = np.append(0, np.cumsum(lengths))
    places = np.repeat(starts[numbers] - ends[:-1], lengths)
    places += np.arange(ends[-1])
    return pool[places], ends


def cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, bounds = ids.tobytes(), (4 * ends).tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, through a bounded cache of pre-tokens."""

    def __init__(self, source: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.entries = entries
        self.pretokens: dict[str, bytes] = {}

    def _singly(self, texts: list[str]) -> list[bytes]:
        raw: list[bytes] = []
        for start in range(0, len(texts), AT_ONCE):
            found = self.tokenizer.encode_batch_fast(texts[start : start + AT_ONCE], add_special_tokens=False)
            raw += [np.array(e.ids, "<u4").tobytes() for e in found]
        return raw

    def _encode_pretokens(self, new: list[str]) -> None:
        for start in range(0, len(new), AT_ONCE):
            self._encode_joined(new[start : start + AT_ONCE])

    def _encode_joined(self, new: list[str]) -> None:
        groups = [new[i : i + JOINED] for i in range(0, len(new), JOINED)]
        joined = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, joined):
            ids = np.array(encoding.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_final[ids]) + 1)).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                cut = [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:
                cut = self._singly(group)
            self.pretokens.update(zip(group, cut))

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other, and where each one's end."""
        if len(self.pretokens) > self.entries:
            self.pretokens.clear()
        parts = pc.extract_regex(chunks, PLAIN)
        plain = pc.and_(parts.is_valid(), pc.less_equal(pc.binary_length(chunks), LONGEST_CACHED))
        words = pc.utf8_lower(pc.if_else(plain, pc.struct_field(parts, "word"), "")).dictionary_encode()
        marks = pc.if_else(plain, pc.struct_field(parts, "marks"), "").dictionary_encode()
        known = [words.dictionary.to_pylist(), marks.dictionary.to_pylist()]
        self.pretokens[""] = b""
        self._encode_pretokens([t for t in {*known[0], *known[1]} if t not in self.pretokens])
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        single = chunks.take(pa.array(other)).to_pylist()
        raw = [self.pretokens[t] for part in known for t in part] + (self._singly(single) if single else [])
        pair = np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(known[0])], axis=1)
        pair[other, 0] = np.arange(len(other)) + len(known[0]) + len(known[1])
        ids, ends = gather(np.frombuffer(b"".join(raw), "<u4"), sizes_of(raw), pair.ravel())
        return ids, ends[::2]

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks, which have no ASCII white space and are not empty."""
        ids, ends = self._ids(utf8(pa.array(chunks, pa.binary())))
        return cut(ids, ends)

    def encode(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Ids of whole texts, null as empty.

        Arrow cuts the texts and numbers their distinct chunks; the ids of a text are gathered by
        these numbers.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        split = pc.ascii_split_whitespace(utf8(pc.fill_null(column.cast(pa.binary()), b"")))
        coded = split.flatten().dictionary_encode()
        ids, ends = self._ids(coded.dictionary)
        ids, ends = gather(ids, np.diff(ends), coded.indices.to_numpy())
        return cut(ids, ends[split.offsets.to_numpy()])


def encoder(source: Broadcast, entries: int = CACHE_ENTRIES) -> Encoder:
    """The worker's encoder of a broadcast tokenizer file; its cache outlives a task."""
    text, kept = source.value, worker_cache(OWNER)
    key = hash(text), entries
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(text, entries)
    return kept[key]


def broadcast_tokenizer(df: DataFrame, path: str | None = None) -> Broadcast:
    """The tokenizer's file, a few megabytes whatever the data, for all workers."""
    with open(path or tokenizer_file(), encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def frequent_pretokens(docs: DataFrame, n: int = FREQUENT) -> list[bytes]:
    """The most frequent chunks over all texts, at most ``n``.

    Frequent-item sketches of bounded size are filled where the texts are read, merged in a fixed
    number of groups, then into one. Only sketches are shuffled, never chunks.
    """
    # long chunks are never looked up in the table
    chunks = docs.select(
        F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("group"),
        F.explode(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).alias("chunk"),
    ).filter((F.length("chunk") > 0) & (F.length("chunk") <= LONGEST_CACHED))
    sketches = chunks.groupBy("group").agg(
        F.expr(f"approx_top_k_accumulate(chunk, {SKETCH_ITEMS})").alias("sketch")
    )
    # grouped by a constant, as there may be no chunk and so no sketch at all
    top = sketches.groupBy(F.lit(0).alias("all")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {SKETCH_ITEMS}), {n})").alias("top")
    ).first()
    return [row["item"].encode() for row in top["top"]] if top else []


def length_table(source: str, chunks: list[bytes]) -> tuple[bytes, bytes]:
    """Compact table: chunks joined by line feeds, their numbers of tokens as 16-bit integers."""
    lengths = [len(ids) // 4 for ids in Encoder(source).encode_chunks(chunks)]
    return b"\n".join(chunks), np.array(lengths, "<u2").tobytes()


class Counter:
    """Numbers of tokens by two tiers: the broadcast table, then the worker's bounded cache."""

    def __init__(self, table: tuple[bytes, bytes], encoder: Encoder):
        keys, lengths = table
        self.frequent = dict(zip(keys.split(b"\n") if keys else [], np.frombuffer(lengths, "<u2").tolist()))
        self.lengths = dict(self.frequent)
        self.encoder = encoder

    def count(self, texts: list[bytes]) -> list[int]:
        split = [text.split() for text in texts]
        if len(self.lengths) > len(self.frequent) + self.encoder.entries:
            self.lengths = dict(self.frequent)
        missing = list(set().union(*split).difference(self.lengths))
        for start in range(0, len(missing), 50_000):
            part = missing[start : start + 50_000]
            self.lengths.update(
                (c, len(ids) // 4) for c, ids in zip(part, self.encoder.encode_chunks(part))
            )
        look = self.lengths.__getitem__
        counts = [sum(map(look, chunks)) for chunks in split]
        for chunk in missing:
            if len(chunk) > LONGEST_CACHED:
                del self.lengths[chunk]
        return counts


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row.

    Null text counts as empty: no bytes, no tokens. Special strings inside a text count as the
    library takes them by default. Rows come back once each, repeated ones too; null ids stay null.
    The table of frequent chunks only saves work: any chunk that it lacks is encoded.
    """
    source = broadcast_tokenizer(docs, path)
    frequent = frequent_pretokens(docs.select("text"))
    small = docs.sparkSession.sparkContext.broadcast(length_table(source.value, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(small.value, encoder(source))
        for batch in batches:
            texts = texts_of(batch.column(1))
            counts = np.array(counter.count(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(list(map(len, texts)), pa.int64()),
                    pa.array(counts),
                    pa.array(counts > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"),
        run,
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
        OWNER,
    )
