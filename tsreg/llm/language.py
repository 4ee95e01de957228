"""Language identification by interpolated Kneser-Ney character models, one per language.

1. One pass over the documents to learn from counts the character 4-grams of each language; counts of
   all of them are summed by Spark. All n-grams of all languages make the models.
2. Small models (``ROWS``, ``CELLS``) are computed once and stored as sorted hash arrays: the hashes of the
   n-grams of all languages in order, and beside each the finished (interpolated) log-probability in every
   language, with the weights that an unseen n-gram passes on to its shorter contexts.
3. Larger ones stay a table, which Spark computes order by order. A log-probability is a sum of weights: one
   for each of the n-grams that end at a symbol and one for each of their contexts, where the language has
   them. So the weights of the most frequent n-grams and contexts go to the workers, and what a text has
   besides is joined with the table of all others. Nothing is left out, and both ways give the same sums.
4. A batch of texts looks all its n-grams up at once. The language with the lowest cross-entropy per
   character wins. The score's temperature and the limit from which a text is rejected as none of the
   languages are calibrated on documents that were not counted (``CALIBRATION``).

Letters are lower-cased, everything between two letters counts as one blank. Characters above U+FFFF
are one symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsreg.llm.common import map_arrow, texts_of
from tsreg.sources.stage import stage

ORDER = 4
ROWS = 1_280_000  # n-grams of all languages up to which the models are computed by the driver
CELLS = 16_000_000  # the same, n-grams times languages
FREQUENT = 4_000_000  # weights of a larger model that the workers hold at most
DENSE = 1 << 22  # numbers that a worker adds up at once
FLUSH = 1 << 20  # distinct n-grams that a task holds
SPLIT = 5  # the ids' CRC-32 deals documents into parts
HELD_OUT, CALIBRATION = 0, 1
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
PASSING = 0.999  # share of a language's own texts that its limit accepts
UNKNOWN = "und"

WIDTH = 16
LOW = np.uint64((1 << WIDTH) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that no two keys get one hash
BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of all texts, and how many symbols each text has.

    The first symbols have blanks before them. A text without letters has no symbol.
    """
    pad = ORDER - 1
    parts = [t.decode("utf-8", "replace").lower() for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64) + pad
    joined = "".join("\n" * pad + p for p in parts).encode("utf-32-le", "replace")
    codes = np.frombuffer(joined, "<u4")
    starts = np.cumsum(lengths) - lengths
    letter = _letters()[codes]
    # a blank stays if a letter is before it; those before a text stay as they are
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    padded = np.zeros(len(codes), bool)
    for k in range(pad):
        padded[starts + k] = True
    keep |= padded
    symbols = np.where(letter, np.minimum(codes, 0xFFFF), BLANK)[keep].astype(np.uint64)
    real = ~padded[keep]
    gram = symbols.copy()
    for k in range(1, ORDER):
        gram[k:] |= symbols[:-k] << np.uint64(WIDTH * k)
    per_text = np.add.reduceat(keep, starts) - pad if len(starts) else np.zeros(0, np.int64)
    return gram[real], per_text


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def part_of(doc_id: str = "doc_id") -> Column:
    """Part of a document by its id; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(SPLIT))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from. Null ids are not held out."""
    return F.coalesce(part_of(doc_id) == HELD_OUT, F.lit(False))


def _counted(doc_id: str = "doc_id") -> Column:
    return F.coalesce(~part_of(doc_id).isin(HELD_OUT, CALIBRATION), F.lit(True))


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` over all documents to count, each combined in its task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            # by language, so that the n-grams of each lie side by side
            batch = batch.sort_by("lang")
            langs = batch.column(0).to_pylist()
            grams, lengths = grams_of(texts_of(batch.column(1)))
            ends = np.cumsum(lengths)
            begins = [k for k in range(len(langs)) if not k or langs[k] != langs[k - 1]]
            for first, after in zip(begins, [*begins[1:], len(langs)]):
                lang = langs[first]
                keys, counts = np.unique(grams[ends[first] - lengths[first] : ends[after - 1]], return_counts=True)
                if lang in held:
                    keys, counts = _summed(*(np.concatenate(pair) for pair in zip(held[lang], (keys, counts))))
                held[lang] = keys, counts
            if sum(len(keys) for keys, _ in held.values()) > FLUSH:
                yield from flush()
        yield from flush()

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(_counted()).select("lang", "text")
    parts = map_arrow(rows, run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table(NamedTuple):
    """n-grams of one order: sorted hashes, a row of numbers for each, and where each first bits begin."""

    hashes: np.ndarray
    values: np.ndarray  # n-grams x languages
    begins: np.ndarray
    bits: int
    longest: int  # hashes that share their first bits at most

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key and whether it is there."""
        if not len(self.values):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        wanted = keys * MIX
        at = self.begins[wanted >> np.uint64(64 - self.bits)]
        for _ in range(self.longest - 1):
            at += self.hashes[at] < wanted
        return at, (self.hashes[at] == wanted) & (at < len(self.values))


class Models(NamedTuple):
    languages: list[str]
    probabilities: list[Table]  # by order, from 1: log2 of the interpolated probability
    weights: list[Table]  # by length of the context, from 1: log2 of the weight passed on
    unseen: np.ndarray  # by language: log2 of the probability of an unknown symbol


def _table(keys: np.ndarray, values: np.ndarray) -> Table:
    hashes = keys * MIX
    order = np.argsort(hashes)
    hashes = hashes[order]
    bits = len(keys).bit_length() + 2
    held = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    begins = np.minimum(np.cumsum(held) - held, max(0, len(keys) - 1)).astype(np.int32)
    # no hash is larger than the one more, so a search stays inside
    hashes = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    return Table(hashes, values[order].astype(np.float32), begins, bits, int(held.max(initial=1)))


def discount(counts: np.ndarray) -> float:
    """Absolute discount from the numbers of n-grams that are counted once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models out of each language's 4-grams and their counts.

    The highest order uses counts, the lower ones the number of different symbols before an n-gram;
    each order passes the discounted mass on to the next shorter context, down to a uniform one.
    """
    languages = sorted(counts)
    unseen = np.full(len(languages), -float(WIDTH))
    probabilities, weights = [], []
    lower: np.ndarray | None = None  # keys of the order below, and their probabilities
    below = np.zeros((0, len(languages)))
    for order in range(1, ORDER + 1):
        mask = np.uint64((1 << (WIDTH * order)) - 1)
        levels = []
        for lang in languages:
            keys, n = counts[lang]
            for length in range(ORDER, order, -1):
                # different symbols before what is left of an n-gram
                keys, n = np.unique(keys & np.uint64((1 << (WIDTH * (length - 1))) - 1), return_counts=True)
            levels.append((keys & mask, n))
        union = np.unique(np.concatenate([keys for keys, _ in levels])) if levels else np.zeros(0, np.uint64)
        contexts, context_of = np.unique(union >> np.uint64(WIDTH), return_inverse=True)
        p = np.zeros((len(union), len(languages)))
        passed = np.ones((len(contexts), len(languages)))
        for column, (keys, n) in enumerate(levels):
            taken = discount(n)
            c = np.zeros(len(union))
            c[np.searchsorted(union, keys)] = n
            total = np.bincount(context_of, c, len(contexts))
            distinct = np.bincount(context_of, c > 0, len(contexts))
            seen = total > 0
            passed[seen, column] = taken * distinct[seen] / total[seen]
            own = np.divide(np.maximum(c - taken, 0), total[context_of], out=np.zeros(len(union)), where=seen[context_of])
            if lower is None:
                rest = 2.0**-WIDTH
            else:
                # the shorter n-gram is there, as the union of its order holds the ends of these
                rest = below[np.searchsorted(lower, union & (mask >> np.uint64(WIDTH))), column]
            p[:, column] = own + passed[context_of, column] * rest
        if order == 1:
            unseen = np.log2(passed[0]) - WIDTH if len(contexts) else unseen
        else:
            weights.append(_table(contexts, np.log2(passed)))
        probabilities.append(_table(union, np.log2(np.maximum(p, 1e-300))))
        lower, below = union, p
    return Models(languages, probabilities, weights, unseen)


def log_probabilities(models: Models, grams: np.ndarray) -> np.ndarray:
    """log2 of the probability of each n-gram's last symbol after the others, in each language."""
    whole = models.probabilities[ORDER - 1]
    at, found = whole.find(grams)
    if not len(whole.values):
        return np.broadcast_to(models.unseen, (len(grams), len(models.languages)))
    out = whole.values[np.minimum(at, len(whole.values) - 1)]
    left = np.flatnonzero(~found)
    out[left] = 0
    for order in range(ORDER - 1, 0, -1):
        keys = grams[left] & np.uint64((1 << (WIDTH * (order + 1))) - 1)
        at, found = models.weights[order - 1].find(keys >> np.uint64(WIDTH))
        out[left[found]] += models.weights[order - 1].values[at[found]]
        at, found = models.probabilities[order - 1].find(keys & np.uint64((1 << (WIDTH * order)) - 1))
        out[left[found]] += models.probabilities[order - 1].values[at[found]]
        left = left[~found]
    out[left] += models.unseen
    return out


def entropies(models: Models, texts: list[bytes]) -> np.ndarray:
    """Cross-entropy of each text per symbol, in each language; NaN for a text without letters."""
    grams, lengths = grams_of(texts)
    logs = log_probabilities(models, grams)
    out = np.full((len(texts), len(models.languages)), np.nan)
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some] = -np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / lengths[some, None]
    return out


class Cells(NamedTuple):
    """Weights of n-grams or contexts of one kind: for each found in ``table`` a run of languages and weights."""

    table: Table
    starts: np.ndarray
    places: np.ndarray  # of the languages
    weights: np.ndarray


class Frequent(NamedTuple):
    """What the workers hold of a large model."""

    width: int  # languages
    cells: dict[int, Cells]  # by kind
    others: list[int]  # kinds that also have weights outside
    unseen: np.ndarray  # by language: log2 of the probability of an unknown symbol


class Weights(NamedTuple):
    """Models as sums of weights: some for the workers, the others in a table (``kind, gram, place, weight``)."""

    languages: list[str]
    frequent: Frequent
    rest: DataFrame


def _level(counts: DataFrame, order: int) -> DataFrame:
    """n-grams of ``order`` out of those with one symbol more: ``n`` different symbols are before each."""
    shorter = F.col("gram").bitwiseAND(F.lit((1 << (WIDTH * order)) - 1)).alias("gram")
    return counts.groupBy("place", shorter).agg(F.count("*").alias("n"), F.sum("seen").alias("seen"))


def weight_table(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weights of :func:`kneser_ney`'s models, out of the 4-grams of all languages (``place, gram, n``).

    First ``kind, gram, place, weight, seen``: kinds 1 to 4 are n-grams, kind 4 + k are contexts of k symbols,
    ``seen`` is how often they were counted. Then ``place, unseen``. An n-gram's weight is what its
    log-probability has over the one that its context passes on, a context's is the share that it passes on.
    """
    levels = {ORDER: counts.withColumn("seen", F.col("n"))}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = stage(_level(levels[order + 1], order), "language-level")
    parts, unseen, below = [], None, None
    for order in range(1, ORDER + 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        share = F.least(F.lit(0.9), F.greatest(F.lit(0.1), once / (once + 2 * twice)))
        taken = levels[order].groupBy("place").agg(F.when(once > 0, share).otherwise(0.5).alias("taken"))
        context = F.shiftrightunsigned("gram", WIDTH).alias("context") if order > 1 else F.lit(0).alias("context")
        contexts = (
            levels[order]
            .groupBy("place", context)
            .agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("seen").alias("seen"))
            .join(taken, "place")
            .withColumn("passed", F.col("taken") * F.col("distinct") / F.col("total"))
        )
        contexts = stage(contexts, "language-contexts")
        found = levels[order].select("place", "gram", "n", "seen", context)
        found = found.join(contexts.drop("seen", "distinct"), ["place", "context"])
        if below is None:
            unseen = contexts.select("place", (F.log2("passed") - WIDTH).alias("unseen"))
            found = found.withColumn("below", F.lit(2.0**-WIDTH))
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << (WIDTH * (order - 1))) - 1))
            found = found.withColumn("shorter", shorter).join(below, ["place", "shorter"])
            passed = F.log2("passed").alias("weight")
            kind = F.lit(ORDER + order - 1).alias("kind")
            parts.append(contexts.select(kind, F.col("context").alias("gram"), "place", passed, "seen"))
        own = F.greatest(F.col("n") - F.col("taken"), F.lit(0.0)) / F.col("total")
        rest = F.col("passed") * F.col("below")
        p = F.greatest(own + rest, F.lit(1e-300))
        found = stage(found.withColumns({"p": p, "weight": F.log2(p) - F.log2(rest)}), "language-weights")
        parts.append(found.select(F.lit(order).alias("kind"), "gram", "place", "weight", "seen"))
        below = found.select("place", F.col("gram").alias("shorter"), F.col("p").alias("below"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole, unseen


def _cells(kind: pa.Table) -> Cells:
    grams = kind.column("gram").to_numpy().view(np.uint64)
    order = np.lexsort((kind.column("place").to_numpy(), grams * MIX))
    grams, first = grams[order], np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    starts = np.append(np.flatnonzero(first), len(grams))
    return Cells(
        _table(grams[first], np.zeros((int(first.sum()), 0))),
        starts,
        kind.column("place").to_numpy()[order],
        kind.column("weight").to_numpy()[order],
    )


def _weighted(counts: DataFrame, languages: list[str], frequent: int) -> Weights:
    """Models of any size: the most frequent n-grams and contexts, ``frequent`` weights at most, for the workers."""
    named = counts.sparkSession.createDataFrame(list(enumerate(languages)), "place int, lang string")
    whole, unseen = weight_table(counts.join(named, "lang").select("place", "gram", "n"))
    # how frequent they are, in steps: a step is one of few numbers, and goes to one side as a whole
    seen = F.sum("seen").over(Window.partitionBy("kind", "gram"))
    whole = stage(whole.withColumn("step", F.floor(F.log2(seen) * 16)).drop("seen"), "language-steps")
    least, held, others = None, 0, set()
    sizes = whole.groupBy("step", "kind").count().collect()
    for step in sorted({row["step"] for row in sizes}, reverse=True):
        held += sum(row["count"] for row in sizes if row["step"] == step)
        if held > frequent:
            others = {row["kind"] for row in sizes if row["step"] <= step}
            break
        least = step
    first = F.lit(False) if least is None else F.col("step") >= least
    kept = whole.filter(first).select("kind", "gram", "place", "weight").toArrow()
    kinds = kept.column("kind").to_numpy()
    cells = {k: _cells(kept.filter(pa.array(kinds == k))) for k in range(1, 2 * ORDER)}
    bits = {row["place"]: row["unseen"] for row in unseen.collect()}
    model = Frequent(len(languages), cells, sorted(others), np.array([bits[k] for k in range(len(languages))]))
    return Weights(languages, model, whole.filter(~first).drop("step"))


def _ending(grams: np.ndarray, kind: int) -> np.ndarray:
    """The n-gram, or the context, of a kind that belongs to each 4-gram."""
    if kind == ORDER:
        return grams
    if kind < ORDER:
        return grams & np.uint64((1 << (WIDTH * kind)) - 1)
    return (grams & np.uint64((1 << (WIDTH * (kind - ORDER + 1))) - 1)) >> np.uint64(WIDTH)


def _sums(model: Frequent, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sums of the weights a worker holds (texts x languages), symbols of each text, and what else is in them.

    The last are columns ``row, kind, gram, n``, sorted by row.
    """
    grams, lengths = grams_of(texts)
    of = np.repeat(np.arange(len(texts)), lengths)
    out = np.zeros((len(texts), model.width))
    lacking = []
    most = max(1, DENSE // model.width)
    for start in range(0, len(grams), most):
        # each n-gram of a piece once: few are left
        some, place = np.unique(grams[start : start + most], return_inverse=True)
        rows = of[start : start + most]
        logs = np.tile(model.unseen, (len(some), 1))
        for kind, cells in model.cells.items():
            keys = _ending(some, kind)
            at, found = cells.table.find(keys)
            begin = cells.starts[at[found]]
            n = cells.starts[at[found] + 1] - begin
            cell = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
            which = np.repeat(np.flatnonzero(found), n)
            np.add.at(logs.reshape(-1), which * model.width + cells.places[cell], cells.weights[cell])
            if kind in model.others:
                left = np.flatnonzero(~found[place])
                lacking.append((rows[left], np.full(len(left), kind), keys[place[left]]))
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[begins]] += np.add.reduceat(logs[place], begins, axis=0)
    if not lacking:
        return out, lengths, [np.zeros(0, np.int64)] * 4
    row, kinds, keys = (np.concatenate(parts) for parts in zip(*lacking))
    order = np.lexsort((keys, kinds, row))
    row, kinds, keys = row[order], kinds[order], keys[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1])
    n = np.diff(np.append(np.flatnonzero(new), len(row)))
    return out, lengths, [row[new], kinds[new], keys[new].view(np.int64), n]


def train(docs: DataFrame, rows: int = ROWS, cells: int = CELLS, frequent: int = FREQUENT) -> Models | Weights:
    """Models of all n-grams of the documents to count.

    The driver gets all n-grams if they are ``rows`` or fewer, and ``cells`` or fewer times the number of
    languages, else ``frequent`` weights at most; the languages' names in both cases.
    """
    counts = stage(gram_counts(docs), "language-grams")
    sizes = counts.groupBy("lang").agg(F.count("*").alias("n")).collect()
    known = sorted(row["lang"] for row in sizes)
    total = sum(row["n"] for row in sizes)
    if total > rows or total * len(known) > cells:
        return _weighted(counts, known, frequent)
    found = counts.select("lang", "gram", "n").orderBy("lang").toArrow()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    codes, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
    keys = found.column("gram").to_numpy().view(np.uint64)
    n = found.column("n").to_numpy()
    return kneser_ney({name: (keys[codes == k], n[codes == k]) for k, name in enumerate(names)})


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values)


def _others(docs: DataFrame) -> tuple[list[int], list[str], str]:
    """Places, names and schema of all columns but the text."""
    fields = [(k, f) for k, f in enumerate(docs.schema) if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for _, f in fields)
    return [k for k, _ in fields], [f.name for _, f in fields], schema


def _added(spark: SparkSession, docs: DataFrame, models: Weights) -> DataFrame:
    """:func:`with_entropies` for models of any size: sums in the workers, and a join for the rest of each text."""
    shared = spark.sparkContext.broadcast(models.frequent)
    place = docs.columns.index("text")
    others, names, schema = _others(docs)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Frequent = shared.value
        most = max(1, DENSE // model.width)  # texts
        for whole in batches:
            for start in range(0, len(whole), most):
                batch = whole.slice(start, most)
                out, lengths, (row, kind, gram, n) = _sums(model, texts_of(batch.column(place)))
                rest = pa.StructArray.from_arrays(
                    [pa.array(kind.astype(np.int32)), pa.array(gram), pa.array(n)], names=["kind", "gram", "n"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k) for k in others),
                        _lists(pa.array(out.ravel()), np.full(len(out), model.width)),
                        pa.array(lengths.astype(np.int64)),
                        _lists(rest, np.bincount(row, minlength=len(out))),
                    ],
                    names=[*names, "sums", "symbols", "rest"],
                )

    kinds = "sums array<double>, symbols bigint, rest array<struct<kind:int,gram:bigint,n:bigint>>"
    rows = map_arrow(docs, sums, ", ".join(filter(None, [schema, kinds])))
    if models.frequent.others:
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "language-sums")
        more = (
            rows.select("_row", F.inline("rest"))
            .join(models.rest, ["kind", "gram"])
            .groupBy("_row", "place")
            .agg(F.sum(F.col("n") * F.col("weight")).alias("more"))
            .groupBy("_row")
            .agg(F.collect_list(F.struct("place", "more")).alias("more"))
        )
        rows = rows.drop("rest").join(more, "_row", "left")
    else:
        rows = rows.withColumn("more", F.expr("CAST(NULL AS ARRAY<STRUCT<place: INT, more: DOUBLE>>)"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column("symbols").to_numpy()
            flat = batch.column("sums").flatten().to_numpy().copy()
            width = len(flat) // max(1, len(symbols))
            found = batch.column("more")
            of = np.repeat(np.arange(len(symbols)), found.value_lengths().fill_null(0).to_numpy())
            values = found.flatten()
            np.add.at(flat, of * width + values.field("place").to_numpy(), values.field("more").to_numpy())
            bits = np.full(len(flat), np.nan)
            np.divide(-flat, np.repeat(symbols, width), out=bits, where=np.repeat(symbols > 0, width))
            lists = _lists(pa.array(bits), np.full(len(symbols), width))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "bits"])

    rows = rows.select(*names, "sums", "symbols", "more")
    return map_arrow(rows, finished, ", ".join(filter(None, [schema, "bits array<double>"])))


def with_entropies(docs: DataFrame, models: Models | Weights) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, perhaps ``lang``) with ``bits``, one number per language, for the text."""
    if isinstance(models, Weights):
        return _added(docs.sparkSession, docs, models)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    place = docs.columns.index("text")
    others, names, schema = _others(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Models = shared.value
        for batch in batches:
            bits = entropies(found, texts_of(batch.column(place)))
            lists = _lists(pa.array(bits.ravel()), np.full(len(bits), bits.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), lists], names=[*names, "bits"])

    return map_arrow(docs, run, ", ".join(filter(None, [schema, "bits array<double>"])))


def _best(languages: list[str]) -> tuple[Column, Column, Column]:
    """Language of the least entropy (ties: the first by name), that entropy, and a text's emptiness."""
    names = F.array(*[F.lit(x) for x in languages])
    least = F.array_min("bits")
    place = F.array_position("bits", least)
    empty = F.isnan(F.element_at("bits", 1))
    return F.element_at(names, place.cast("int")), least, empty


def _posterior(temperature: float, bits: Column) -> Column:
    """Probability of the language with the entropy ``bits``, of all languages."""
    least = F.array_min("bits")
    powers = F.transform("bits", lambda b: F.exp(-F.lit(temperature) * (b - least)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.exp(-F.lit(temperature) * (bits - least)) / total


class Calibration(NamedTuple):
    temperature: float
    limits: dict[str, float]  # entropy from which a text of the language is rejected


def calibrate(docs: DataFrame, models: Models) -> Calibration:
    """Temperature of the least log loss, and the entropy limit of each language, over ``CALIBRATION``."""
    rows = docs.filter("lang IS NOT NULL").filter(part_of() == CALIBRATION).select("lang", "text")
    scored = with_entropies(rows, models).filter(F.col("lang").isin(models.languages))
    scored = scored.filter(~F.isnan(F.element_at("bits", 1)))
    names = F.array(*[F.lit(x) for x in models.languages])
    own = F.element_at("bits", F.array_position(names, F.col("lang")).cast("int"))
    losses = [
        F.avg(-F.log(F.greatest(_posterior(t, own), F.lit(1e-12)))).alias(f"loss_{k}")
        for k, t in enumerate(TEMPERATURES)
    ]
    limit = F.percentile_approx(own, PASSING, 10_000).alias("limit")
    found = scored.groupBy("lang").agg(limit, F.count("*").alias("n"), *losses).collect()
    total = sum(row["n"] for row in found)
    if not total:
        return Calibration(1.0, {})
    mean = [sum(row[f"loss_{k}"] * row["n"] for row in found) / total for k in range(len(TEMPERATURES))]
    return Calibration(TEMPERATURES[int(np.argmin(mean))], {row["lang"]: row["limit"] for row in found})


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``bits`` and ``rejected`` of every row of ``docs``.

    ``lang_pred`` is the learned language with the lowest cross-entropy per symbol, and ``und`` for a null
    text, one without letters, or where nothing could be learned. ``score`` is its calibrated probability
    among the languages, 0 for ``und``; ``bits`` its cross-entropy. ``rejected`` is true for ``und`` and
    for a text further from its language than ``PASSING`` of that language's own texts. Only ``text`` enters a
    prediction; nothing is learned from held-out rows. Whole texts count, however long. Repeated rows come
    back as often as they come, null ids stay null and count as learnable, other columns are ignored; an
    empty table gives none.
    """
    models = train(docs)
    rows = docs.select("doc_id", "text")
    held_out = is_held_out().alias("held_out")
    if not models.languages:
        return rows.select(
            "doc_id",
            held_out,
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("bits"),
            F.lit(True).alias("rejected"),
        )
    setting = calibrate(docs, models)
    best, least, empty = _best(models.languages)
    pairs = [F.lit(x) for name in models.languages for x in (name, setting.limits.get(name, float("inf")))]
    limit = F.element_at(F.create_map(*pairs), best)
    return with_entropies(rows, models).select(
        "doc_id",
        held_out,
        F.when(empty, UNKNOWN).otherwise(best).alias("lang_pred"),
        F.when(empty, 0.0).otherwise(_posterior(setting.temperature, least)).alias("score"),
        F.when(~empty, least).alias("bits"),
        (empty | (least > limit)).alias("rejected"),
    )
