"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access identifiers, long hex strings) are reported as they are. Weak
parts (key-like strings, named identifiers, endpoints) are reported only together: an interval join
finds which parts lie within one scope, a number of characters, of each other.

Places of matches come from the text's pieces between them: matches and pieces alternate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsreg.sources.stage import stage

ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}={0,2}"
IDENT = (
    r"""(?i:client_?id|user_?name|user|login|account|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
)
ENDPOINT = (
    r"""(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}|(?i:endpoint|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,})"""
)

# order of kinds that start at the same place
KINDS = ("assign", "access", "hex", "key", "ident", "endpoint")
SCOPE = 200
BIN = 512
BLOCK = 256

SPAN = "struct<start:bigint,rank:int,end:bigint>"


def _spans(kind: str, matches: Column, pieces: Column) -> Column:
    """Array of spans of one kind: each match starts after the pieces and matches before it.

    Spans are made block by block and the blocks joined at the end, so that a text with very many matches
    doesn't copy its spans again and again.
    """
    rank = F.lit(KINDS.index(kind))
    nothing = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(matches, i))
        span = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def block(state: Column, first: Column) -> Column:
        numbers = F.sequence(first, F.least(first + (BLOCK - 1), F.size(matches) - 1))
        begin = F.struct(state["at"].alias("at"), nothing.alias("out"))
        return F.aggregate(
            numbers,
            begin,
            step,
            lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out")),
        )

    no_block = F.array().cast(f"array<array<{SPAN}>>")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), no_block.alias("out"))
    firsts = F.sequence(F.lit(0), F.size(matches) - 1, F.lit(BLOCK))
    found = F.aggregate(firsts, begin, block, lambda s: F.flatten(s["out"]))
    return F.when(F.size(matches) > 0, found).otherwise(nothing)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (SHA-256 of texts that have weak parts, else null), ``base`` and ``weak`` spans."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY, "ident": IDENT, "endpoint": ENDPOINT}
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    df = df.withColumns(
        {f"m_{k}": F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in patterns.items()}
    )
    # a text is cut only where a pattern was found
    df = df.withColumns(
        {f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)) for k, p in patterns.items()}
    )
    df = df.withColumns({f"s_{k}": _spans(k, F.col(f"m_{k}"), F.col(f"p_{k}")) for k in patterns})

    def kept(kind: str, test) -> Column:
        """Spans whose match passes ``test``."""
        pairs = F.arrays_zip(F.col(f"s_{kind}").alias("s"), F.col(f"m_{kind}").alias("m"))
        return F.transform(F.filter(pairs, lambda x: test(x["m"])), lambda x: x["s"])

    df = df.withColumns(
        {
            "s_assign": kept("assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
            "s_key": kept("key", lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
        }
    )
    df = df.withColumn("base", F.array_sort(F.concat("s_assign", "s_access", "s_hex")))
    df = df.withColumn("weak", F.concat("s_key", "s_ident", "s_endpoint"))
    # one part alone links to nothing
    linkable = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    return df.select(
        "doc_id",
        F.when(linkable, F.sha2("t", 256)).alias("text_key"),
        "base",
        F.when(linkable, F.col("weak")).alias("weak"),
        *[F.size(f"s_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
    )


def linked_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``text_key`` and its weak spans that have their complement within ``scope`` characters.

    A key needs an identifier, a named identifier needs a secret, an endpoint needs both; what
    overlaps a strong span is part of it already. Intervals
    are listed under the bins of the text they touch, widened by the scope on the asking side; only
    parts of one bin of one text meet. Equal texts are linked once.
    """
    texts = scanned.filter("text_key IS NOT NULL").groupBy("text_key").agg(
        F.first("base").alias("base"), F.first("weak").alias("weak")
    )
    rank = {k: i for i, k in enumerate(KINDS)}
    identifiers, secrets = (rank["access"], rank["ident"]), (rank["assign"], rank["hex"], rank["key"])

    def whole_bins(low: str, high: str) -> Column:
        return F.explode(F.expr(f"sequence(greatest({low}, 0L) div {BIN}, ({high}) div {BIN})"))

    weak = texts.select("text_key", F.explode("weak").alias("w")).select(
        "text_key", "w", whole_bins(f"w.start - {scope}", f"w.end + {scope}").alias("bin")
    )
    parts = texts.select("text_key", F.explode(F.concat("base", "weak")).alias("o")).select(
        "text_key", "o", whole_bins("o.start", "o.end").alias("bin")
    )
    apart = F.greatest(F.col("o.start") - F.col("w.end"), F.col("w.start") - F.col("o.end"))
    met = weak.join(parts, ["text_key", "bin"]).filter((apart <= scope) & (F.col("o") != F.col("w")))
    found = met.groupBy("text_key", "w").agg(
        F.bool_or(F.col("o.rank").isin(*identifiers)).alias("has_identifier"),
        F.bool_or(F.col("o.rank").isin(*secrets)).alias("has_secret"),
        F.bool_or((apart < 0) & (F.col("o.rank") < rank["key"])).alias("covered"),
    )
    complete = ~F.col("covered") & (
        F.when(F.col("w.rank") == rank["key"], F.col("has_identifier"))
        .when(F.col("w.rank") == rank["ident"], F.col("has_secret"))
        .otherwise(F.col("has_identifier") & F.col("has_secret"))
    )
    return found.filter(complete).groupBy("text_key").agg(F.collect_list("w").alias("linked"))


def as_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","
    )


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans`` of every row.

    Both are arrays of (start, rank of the kind in ``KINDS``, end), in characters, end exclusive,
    sorted; ``base`` has the strong patterns, ``spans`` also the linked parts. Null text counts as
    empty and has none. Repeated rows come back as often as they come; null ids stay null; other columns are
    ignored; an empty table gives none.
    """
    scanned = stage(scan(docs), "secret-parts")
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base"]
    alone = scanned.filter("text_key IS NULL").select(*columns, F.col("base").alias("spans"))
    more = scanned.filter("text_key IS NOT NULL").join(linked_parts(scanned, scope), "text_key", "left")
    nothing = F.array().cast(f"array<{SPAN}>")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", nothing)))
    return alone.union(more.select(*columns, spans.alias("spans")))
