"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Statistics are computed where a text is read, and only they move. The trees are fitted on a bounded
sample of labelled rows (``MAX_LABELLED``), as histograms over binned statistics, and flattened into
arrays; a batch of documents walks all trees level by level in numpy. Scoring has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsreg.llm.common import map_arrow, texts_of, unused

# rows of the fit at most, about; all labelled rows if there are fewer
MAX_LABELLED = 20_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.2
RIDGE = 1.0
LEAST_WEIGHT = 2.0
THRESHOLD = 0.7

SYMBOLS = b"#$%&*|!<>{}[]=_^~\\/@+"
MARKS = b".,;:?!"

FEATURES = (
    ["log_bytes", "log_words", "log_lines", "mean_word", "std_word", "long_words", "short_words"]
    + ["distinct_words", "top_word", "repeated_lines", "mean_line", "short_lines"]
    + ["upper", "lower", "digit", "space", "newline", "high", "marks", "symbols", "entropy"]
    + ["words_with_symbol", "upper_words", "words_with_digit", "words_with_mark", "symbol_run"]
    + [f"symbol_{chr(c)}" for c in SYMBOLS]
)


def _table(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


IS_SYMBOL, IS_MARK = _table(SYMBOLS), _table(MARKS)
IS_UPPER, IS_LOWER, IS_DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789")
IS_SPACE = _table(b" \t\n\r\x0b\x0c")


def statistics(text: bytes) -> np.ndarray:
    """The numbers that ``FEATURES`` names, of one text in UTF-8; an empty text has zeros."""
    out = np.zeros(len(FEATURES), np.float32)
    if not text:
        return out
    codes = np.frombuffer(text, np.uint8)
    n = len(codes)
    counts = np.bincount(codes, minlength=256)
    share = counts / n
    words, lines = text.split(), text.split(b"\n")
    n_words = max(1, len(words))
    space = IS_SPACE[codes]
    # each byte belongs to the word that began last
    begins = ~space & np.append(True, space[:-1])
    word_of = np.cumsum(begins) - 1
    lengths = np.bincount(word_of[~space], minlength=n_words) if words else np.zeros(1)

    def words_with(flags: np.ndarray) -> float:
        hit = flags[codes]
        return len(np.unique(word_of[hit])) / n_words if hit.any() else 0.0

    uppers = np.bincount(word_of[IS_UPPER[codes]], minlength=n_words) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    symbol = IS_SYMBOL[codes]
    held = share[share > 0]
    out[:26] = (
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        (lengths > 12).mean(),
        (lengths < 3).mean(),
        len(seen) / n_words,
        max(seen.values(), default=0) / n_words,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(len(line) < 30 for line in lines) / len(lines),
        share[IS_UPPER].sum(),
        share[IS_LOWER].sum(),
        share[IS_DIGIT].sum(),
        share[IS_SPACE].sum(),
        share[10],
        share[128:].sum(),
        share[IS_MARK].sum(),
        share[IS_SYMBOL].sum(),
        -(held * np.log2(held)).sum(),
        words_with(IS_SYMBOL),
        ((uppers > 1) & (2 * uppers > lengths)).mean(),
        words_with(IS_DIGIT),
        words_with(IS_MARK),
        (symbol[1:] & symbol[:-1]).mean() if n > 1 else 0.0,
    )
    out[26:] = share[list(SYMBOLS)]
    return out


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, len(FEATURES)), np.float32)


class Trees(NamedTuple):
    """Complete binary trees of one depth, flattened: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # a value above the cut goes to the right
    leaf: np.ndarray  # trees x leaves, in log-odds
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        rows, odds = np.arange(len(x)), np.full(len(x), self.start)
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            odds += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boost ``trees`` trees for 0/1 labels; every split comes from histograms of binned values."""
    n, k = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32)
    leaf = np.zeros((trees, leaves))
    if n == 0:
        return Trees(feature, cut, leaf, start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1)
    slot = binned + bins * np.arange(k)
    odds = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            local = node - (width - 1)
            place = (local[:, None] * (k * bins) + slot).ravel()
            size = width * k * bins
            g = np.bincount(place, np.repeat(gradient, k), size).reshape(width, k, bins)
            w = np.bincount(place, np.repeat(weight, k), size).reshape(width, k, bins)
            gl, wl = g.cumsum(axis=2), w.cumsum(axis=2)
            gt, wt = gl[:, :, -1:], wl[:, :, -1:]
            gr, wr = gt - gl, wt - wl
            gain = gl**2 / (wl + RIDGE) + gr**2 / (wr + RIDGE) - gt**2 / (wt + RIDGE)
            gain[(wl < LEAST_WEIGHT) | (wr < LEAST_WEIGHT)] = -1
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for m in range(width):
                j, b = divmod(int(best[m]), bins)
                if flat[m, best[m]] > 1e-6 and b < len(edges[j]):
                    feature[t, width - 1 + m], cut[t, width - 1 + m] = j, edges[j][b]
            rows = np.arange(n)
            node = 2 * node + 1 + (x[rows, feature[t, node]] > cut[t, node])
        local = node - inner
        g, w = np.bincount(local, gradient, leaves), np.bincount(local, weight, leaves)
        leaf[t] = RATE * g / (w + RIDGE)
        odds += leaf[t][local]
    return Trees(feature, cut, leaf, start)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose label is never used for the fit: a quarter, by the id's CRC-32. Null ids are not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id``, ``quality`` of the labelled rows to learn from: each id once, about ``most`` by hash."""
    usable = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .filter(~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    n = usable.count()
    if n <= most:
        return usable
    slots = 1 << 30
    return usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < int(slots * most / n))


def labelled_statistics(
    docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED
) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded sample of the labelled documents.

    The sample's ids, of proven number, are broadcast, so texts are not shuffled; the driver gets one
    row of statistics per sampled id. Of rows that repeat an id, the one with the smallest statistics
    counts.
    """
    sample = labelled_sample(labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(texts_of(batch.column(1)))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), values.cast(pa.list_(pa.float32()))],
                names=["doc_id", "quality", "x"],
            )

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, x array<float>"
    found = map_arrow(rows, run, schema).groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row"))
    got = found.select("doc_id", "row.x", "row.quality").orderBy("doc_id").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y = got.column("quality").to_numpy().astype(np.float64)
    return x, np.clip(y, 0, 1)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Trees:
    """Fit on :func:`labelled_statistics`. Without any usable label every score is one half."""
    return fit(*labelled_statistics(docs, labels, most))


def with_score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """``docs`` with all its columns and the model's score of each text (null as empty) in ``name``."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(texts_of(batch.column(place)))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name]
            )

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    ``score`` is the probability of quality 1, for null and empty texts too; ``predicted`` is 1 from
    ``threshold`` on. Only ``text`` enters the score. Repeated rows come back as often as they come; null
    ids stay null and are not held out; other columns are ignored; an empty table gives none.
    """
    model = train(docs, labels)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``, all columns as they are.

    Null texts are scored as empty ones; repeated rows and null ids are rows like any other. Without any
    usable label nothing could be told apart, so the call fails, unless ``docs`` is empty.
    """
    x, y = labelled_statistics(docs, labels)
    if not len(y) and not docs.isEmpty():
        raise ValueError("no document has a label to learn from")
    name = unused("_quality_score", docs.columns)
    scored = with_score(docs, fit(x, y), name)
    return scored.filter(F.col(name) >= threshold).select(*docs.columns)
