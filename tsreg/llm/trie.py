"""Prefix trie of conversations, screened by a count-min sketch.

A turn is a digest of 128 bits and a length; texts don't move. A prefix is the sum of its turns' digests,
each mixed with its depth, in two 64-bit lanes, so that the prefixes of a long conversation's pieces follow
from the sums of the pieces before.

1. Count-min sketch: ``ROWS`` counters for each prefix, counted by Spark, of which only the bits "more than
   one" are broadcast. An estimate of one proves that no other conversation has the prefix, nor any longer
   one of the same conversation.
2. The nodes below such a prefix are written where they are found. Prefixes that may be shared, and the
   first that is not, are shuffled and grouped exactly.
3. Sums over a subtree: a node's weight belongs to its smallest member, and this member's prefixes carry it
   to all ancestors. Nothing goes level by level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsreg.llm import turns
from tsreg.llm.common import map_arrow
from tsreg.sources.stage import stage

FAMILY = 100  # conversations c - c % FAMILY lend their first turns
LENT = 6  # at most one less
ROWS = 3
PER_PREFIX = 4  # counters of a row for each prefix
LEAST_BITS, MOST_BITS = 10, 27  # of a counter's number; 2^27 make 48 MB of bits
CHUNK_BITS = 16
BLOCK = 4096  # depths that are summed together
HOT_PARENTS = 256
IDS_EACH = 1 << 14  # ids of one piece of a node's list

LOW = np.uint64(0xFFFFFFFF)
# fixed odd multipliers
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
KEY = ["depth", "x", "y"]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX_1
    z = (z ^ (z >> np.uint64(27))) * MIX_2
    return z ^ (z >> np.uint64(31))


def turn_items(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``tie``, ``item`` (16 bytes of role and text) and ``size`` (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        turns.tie_order(role, text).alias("tie"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("item"),
        F.length(text).alias("size"),
    )


def rebuilt(pieces: DataFrame) -> DataFrame:
    """Pieces of the rebuilt conversations: ``depth0`` turns come before, ``length`` turns are there in all.

    The first h = crc32(c) % LENT turns of conversation c are those of c - c % FAMILY.
    """
    head = pieces.filter((F.col("conv_id") % FAMILY == 0) & (F.col("start") < LENT - 1))
    head = head.select("conv_id", "start", F.posexplode(F.arrays_zip("item", "size")).alias("k", "v"))
    place = (F.col("start") + F.col("k")).alias("k")
    heads = (
        head.select("conv_id", F.struct(place, "v.item", "v.size").alias("t"))
        .filter(F.col("t.k") < LENT - 1)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list("t")).alias("head"))
    )
    lent = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(LENT)).cast("int")
    whole = (
        pieces.filter("last")
        .select("conv_id", (F.col("start") + F.size("item")).alias("n"), lent.alias("lent"))
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(heads, "base", "left")
        .select("conv_id", "n", "lent", F.slice(F.coalesce("head", F.expr("array()")), 1, F.col("lent")).alias("head"))
    )
    lent, given = F.col("lent"), F.size("head")
    first = F.col("piece") == 0
    skip = F.greatest(lent - F.col("start"), F.lit(0)).cast("int")

    def items(name: str) -> Column:
        own = F.slice(name, skip + 1, F.size(name))
        return F.when(first, F.concat(F.col(f"head.{name}"), own)).otherwise(own).alias(name)

    return pieces.join(whole, "conv_id").select(
        "conv_id",
        "piece",
        "last",
        F.when(first, 0).otherwise(given + F.greatest(F.col("start") - lent, F.lit(0))).cast("bigint").alias("depth0"),
        (given + F.greatest(F.col("n") - lent, F.lit(0))).cast("bigint").alias("length"),
        items("item"),
        items("size"),
    )


def _lanes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed digests (two lanes) of all turns of a batch, their depths, places in their piece, and lengths."""
    column = batch.column("item")
    raw = b"".join(column.flatten().to_pylist())
    pair = np.frombuffer(raw, "<u8").reshape(-1, 2)
    counts = np.diff(column.offsets.to_numpy())
    place = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
    depth = np.repeat(batch.column("depth0").to_numpy(), counts) + place + 1
    salt = depth.astype(np.uint64) * STEP
    return _mixed(pair[:, 0] + salt), _mixed(pair[:, 1] ^ salt), depth, place, counts


def _running(lane: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.cumsum(lane, dtype=np.uint64)
    starts = np.cumsum(counts) - counts
    base = np.append(np.uint64(0), total)[starts]
    return total - np.repeat(base, counts) + np.repeat(before, counts)


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Lanes of all prefixes, their depths, places and the pieces' lengths."""
    x, y, depth, place, counts = _lanes(batch)
    before = [batch.column(c).to_numpy().view(np.uint64) for c in ("before_x", "before_y")]
    return _running(x, counts, before[0]), _running(y, counts, before[1]), depth, place, counts


def with_sums(units: DataFrame) -> DataFrame:
    """``units`` with ``before_x`` and ``before_y``, the sums of the conversation's earlier pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, _, _, counts = _lanes(batch)
            of = np.repeat(np.arange(len(counts)), counts)
            # halves of 32 bits, whose sums need no modulus
            halves = [half for lane in (x, y) for half in (lane >> np.uint64(32), lane & LOW)]
            sums = [np.zeros(len(counts), np.int64) for _ in halves]
            for total, half in zip(sums, halves):
                np.add.at(total, of, half.astype(np.int64))
            offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * 4)
            values = pa.ListArray.from_arrays(offsets, pa.array(np.stack(sums, axis=1).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("piece"), values], names=["conv_id", "piece", "value"]
            )

    zero = F.lit(0).cast("bigint")
    several = units.filter((F.col("piece") > 0) | ~F.col("last"))
    one = units.filter((F.col("piece") == 0) & F.col("last")).withColumns({"before_x": zero, "before_y": zero})
    if several.isEmpty():
        return one
    own = map_arrow(several, run, "conv_id bigint, piece bigint, value array<bigint>")
    sums = turns.doubled(own, "conv_id", lambda a, b: F.zip_with(a, b, lambda p, q: p + q), "trie-sums")

    def lane(high: int) -> Column:
        # modulo 2^64: the high half's sum moves up, the low half's carry joins it
        up = F.element_at("value", high) + F.shiftright(F.element_at("value", high + 1), 32)
        return F.shiftleft(up, 32).bitwiseOR(F.element_at("value", high + 1).bitwiseAND(F.lit(0xFFFFFFFF)))

    before = sums.select(
        "conv_id", (F.col("piece") + 1).alias("piece"), lane(1).alias("before_x"), lane(3).alias("before_y")
    )
    many = several.join(before, ["conv_id", "piece"], "left")
    many = many.withColumns({c: F.coalesce(c, zero) for c in ("before_x", "before_y")})
    return one.unionByName(many.select(*one.columns))


def _cells(x: np.ndarray, y: np.ndarray, bits: int) -> list[np.ndarray]:
    """Numbers of a prefix's counters, one of each row."""
    shift = np.uint64(64 - bits)
    return [
        (_mixed(x + np.uint64(k) * STEP + y * MIX_1) >> shift) | np.uint64(k << bits) for k in range(ROWS)
    ]


def shared_bits(units: DataFrame, bits: int) -> np.ndarray:
    """A bit for each counter of the sketch: whether it counts more than one prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, *_ = _prefixes(batch)
            cells, n = np.unique(np.concatenate(_cells(x, y, bits)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(n)], names=["cell", "n"])

    def pack(cells: pa.Table) -> pa.Table:
        number = cells.column("cell").to_numpy()
        flags = np.zeros(1 << CHUNK_BITS, np.uint8)
        flags[number & ((1 << CHUNK_BITS) - 1)] = 1
        return pa.table({"chunk": [int(number[0]) >> CHUNK_BITS], "bits": [np.packbits(flags).tobytes()]})

    counted = map_arrow(units, count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    several = counted.filter("n > 1").select("cell", F.shiftright("cell", CHUNK_BITS).alias("chunk"))
    # a chunk has at most 2^CHUNK_BITS cells; the driver gets at most ROWS bits for each counter's number
    chunks = several.groupBy("chunk").applyInArrow(pack, "chunk bigint, bits binary").toArrow()
    size = (1 << CHUNK_BITS) // 8
    out = np.zeros(max(size, ROWS << bits >> 3), np.uint8)
    for chunk, raw in zip(chunks.column("chunk").to_pylist(), chunks.column("bits").to_pylist()):
        part = np.frombuffer(raw, np.uint8)
        low = chunk * size
        out[low : low + size] = part[: len(out) - low]
    return out


CANDIDATES = (
    "conv_id bigint, depth bigint, tail_to bigint, x bigint, y bigint, parent_x bigint, parent_y bigint, "
    "size bigint, ends boolean, local_child boolean"
)


def screened(units: DataFrame, flags, bits: int) -> DataFrame:
    """Prefixes that may be shared and the first that isn't (``tail_to`` null); ranges of depths below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = flags.value
        for batch in batches:
            x, y, depth, place, counts = _prefixes(batch)
            if not len(x):
                continue
            maybe = np.ones(len(x), bool)
            for cell in _cells(x, y, bits):
                maybe &= (several[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            units_with = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[units_with]
            # place of the first prefix that is proven to be single, by piece
            none = np.iinfo(np.int64).max
            single = np.minimum.reduceat(np.where(maybe, none, place), starts)
            first = np.zeros(len(counts), np.int64)
            first[units_with] = single
            limit = np.repeat(first, counts)
            keep = place <= limit
            conv = np.repeat(batch.column("conv_id").to_numpy(), counts)
            length = np.repeat(batch.column("length").to_numpy(), counts)
            size = batch.column("size").flatten().to_numpy()
            before = [np.repeat(batch.column(c).to_numpy(), counts) for c in ("before_x", "before_y")]
            parents = [
                np.where(place > 0, np.append(np.int64(0), lane.view(np.int64)[:-1]), start)
                for lane, start in zip((x, y), before)
            ]
            held = np.repeat(counts, counts)
            local = (place == limit) & (place + 1 < held)
            a = np.flatnonzero(keep)
            tops = np.flatnonzero(local)
            last = depth[tops] - place[tops] + held[tops] - 1
            n, m = len(a), len(tops)
            columns = [
                np.concatenate([conv[a], conv[tops]]),
                np.concatenate([depth[a], depth[tops] + 1]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(last, pa.int64())]),
                *(np.concatenate([v[a], np.zeros(m, np.int64)]) for v in (x.view(np.int64), y.view(np.int64), *parents)),
                np.concatenate([size[a].astype(np.int64), np.zeros(m, np.int64)]),
                np.concatenate([depth[a] == length[a], last == length[tops]]),
                np.concatenate([local[a], np.zeros(m, bool)]),
            ]
            names = [part.split()[0] for part in CANDIDATES.split(", ")]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return map_arrow(units, run, CANDIDATES)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``KEY`` and ``ends_sha256`` of the ids that end at each node, sorted and joined by commas.

    Ids are sorted over all tasks and joined where they lie; pieces of one list are hashed one by one.
    """
    key = F.concat_ws(":", *KEY)
    rows = ends.select(key.alias("conv_id"), F.col("conv_id").alias("turn"), F.lit(0).alias("tie"), F.lit(0).alias("size"))
    lists = turns.segments(rows, IDS_EACH).select("conv_id", "piece", "last", F.array_join("turn", ",").alias("ids"))
    single = (F.col("piece") == 0) & F.col("last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    state = hashlib.sha256()
                state.update(("," if row["piece"] else "").encode() + row["ids"].encode())
                if row["last"]:
                    out.append((row["conv_id"], state.hexdigest()))
            keys, hashes = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], names=["conv_id", "sha"])

    one = lists.filter(single).select("conv_id", F.sha2("ids", 256).alias("sha"))
    many = lists.filter(~single).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    found = one.unionByName(map_arrow(many, run, "conv_id string, sha string"))
    parts = F.split("conv_id", ":")
    return found.select(*[parts[k].cast("bigint").alias(name) for k, name in enumerate(KEY)], F.col("sha").alias("ends_sha256"))


def _grouped(candidates: DataFrame, whole: DataFrame) -> DataFrame:
    """Exact nodes of the prefixes that may be shared, and the root; ``whole`` has a row per conversation."""
    nodes = candidates.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("parent_x").alias("parent_x"),
        F.min("parent_y").alias("parent_y"),
        F.min("size").alias("size"),
        F.max("local_child").alias("local_child"),
    )
    long = F.lit(0).cast("bigint")
    root = whole.groupBy(long.alias("depth"), long.alias("x"), long.alias("y")).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first(F.lit(None).cast("bigint")).alias("parent_x"),
        F.first(F.lit(None).cast("bigint")).alias("parent_y"),
        F.first(long).alias("size"),
        F.lit(False).alias("local_child"),
    )
    nodes = stage(nodes.unionByName(root), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_x").alias("x"), F.col("parent_y").alias("y")
    )
    children = children.agg(F.count("*").alias("k"))
    counted = nodes.join(children, KEY, "left")
    total = F.coalesce("k", F.lit(0)) + F.col("local_child").cast("bigint")
    return stage(counted.withColumn("n_children", total).drop("k"), "trie-counted")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``. A parent that isn't among them is the conversation's own prefix.

    Parents of more than a ``HOT_PARENTS``-th of all nodes, which are fewer than that, are broadcast.
    """
    most = nodes.count() // HOT_PARENTS
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("x").alias("parent_x"),
        F.col("y").alias("parent_y"),
        F.col("conv_id").alias("parent_conv_id"),
        "n_children",
    )
    keys = ["depth", "parent_x", "parent_y"]
    hot = parents.filter(F.col("n_children") > most).drop("n_children")
    rest = parents.filter(F.col("n_children") <= most).drop("n_children")
    met = nodes.join(F.broadcast(hot), keys, "left")
    found = met.filter("parent_conv_id IS NOT NULL")
    other = met.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(rest, keys, "left")
    own = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    return found.unionByName(other.select(*found.columns)).withColumn("parent_conv_id", own)


def _subtrees(candidates: DataFrame, tails: DataFrame, nodes: DataFrame) -> DataFrame:
    """``KEY``, ``n_leaves`` and ``saved_tokens`` of the nodes that several conversations share."""
    weights = nodes.filter("depth > 0").select(
        "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("weight")
    )
    leaves = nodes.filter("n_children = 0").select("conv_id", F.lit(1).alias("leaf"))
    leaves = leaves.unionByName(tails.filter("ends").select("conv_id", F.lit(1).alias("leaf")))
    rows = candidates.select("conv_id", *KEY).join(weights, ["conv_id", "depth"], "left")
    rows = rows.withColumns({"weight": F.coalesce("weight", F.lit(0)), "block": F.floor(F.col("depth") / BLOCK)})
    # what a conversation owns from a depth on: within blocks of depths, and of the blocks behind
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    rows = rows.withColumn("owned", F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stage(rows.drop("weight"), "trie-owned")
    blocks = rows.groupBy("conv_id", "block").agg(F.max("owned").alias("sum"))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    behind = blocks.select("conv_id", "block", F.sum("sum").over(behind).alias("behind")).filter("behind > 0")
    rows = rows.join(behind, ["conv_id", "block"], "left").join(leaves, "conv_id", "left")
    sums = rows.groupBy(*KEY).agg(
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("owned") + F.coalesce("behind", F.lit(0))).alias("saved_tokens"),
    )
    return sums


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, segment: int = turns.SEGMENT, bits: int | None = None) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: ``COLUMNS``.

    A node is named by its smallest member and its depth. Turns are ordered by ``turn``, nulls first, equal
    ones by a hash of role and text; null roles and texts are empty, rows that repeat are turns of their
    own. Rows without ``conv_id`` belong to no conversation and are left out; other columns are ignored.
    Texts of any length are one digest. Without any conversation there is no node. ``bits`` sets the size of
    the sketch, which changes no result.
    """
    pieces = turns.segments(turn_items(conversations), segment)
    units = stage(rebuilt(pieces), "trie-units")
    units = with_sums(units)
    whole = units.filter("last").select("conv_id", "length")
    if bits is None:
        prefixes = whole.agg(F.sum("length")).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(PER_PREFIX * prefixes + 1))))
    flags = units.sparkSession.sparkContext.broadcast(shared_bits(units, bits))
    found = stage(screened(units, flags, bits), "trie-prefixes")
    candidates, tails = found.filter("tail_to IS NULL"), found.filter("tail_to IS NOT NULL")
    nodes = _grouped(candidates, whole)
    named = _with_parents(nodes)
    sums = _subtrees(candidates, tails, nodes)
    turnless = whole.filter("length = 0").select("conv_id", *[F.lit(0).cast("bigint").alias(k) for k in KEY])
    ends = candidates.filter("ends").select("conv_id", *KEY).unionByName(turnless)
    joined = named.join(sums, KEY, "left").join(_end_hashes(ends), KEY, "left")
    # the root's sums are those of all nodes
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    leaves, saved = nodes.agg(F.sum(leaf), F.sum((F.col("n_convs") - 1) * F.col("size"))).first()
    leaves = (leaves or 0) + tails.filter("ends").count()
    root = F.col("depth") == 0
    grouped = joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.when(root, F.lit(leaves)).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"),
        F.when(root, F.lit(saved)).otherwise(F.col("saved_tokens")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    end = F.col("ends") & (F.col("depth") == F.col("tail_to"))
    below = tails.select("conv_id", "ends", "tail_to", F.explode(F.sequence("depth", "tail_to")).alias("depth"))
    local = below.select(
        "conv_id",
        "depth",
        F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("bigint").alias("n_convs"),
        F.when(end, 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.sha2(F.when(end, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"),
    )
    return grouped.unionByName(local)
