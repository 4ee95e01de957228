"""URL verdicts: prefix rules first, then logistic regression on hashed character n-grams.

DataFrame and Spark ML operations only. The regression is fitted on a small labelled table of URLs;
host and path are cut into characters (digits are one), their n-grams are hashed into vectors of their own,
and the path's weigh less. The strength of regularisation is chosen by the loss on a part of the table that is
held out. The same pipeline scores all other URLs in place: no shuffle.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS = (3, 4)
SLOTS = {"host": 1 << 14, "path": 1 << 10}
PATH_WEIGHT = 0.25
STRENGTHS = (0.03, 0.003)
HELD_OUT = 4  # one in so many labelled hosts chooses the strength
THRESHOLD = 0.5

# (rule, verdict): host, then the start of a path
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

# words of which the labelled hosts are made
BLOCK_WORDS = """
casino poker jackpot slots roulette bet betting gambling lottery pills viagra pharmacy meds steroids spam phishing
malware keylogger warez crack keygen torrent pirated porn xxx sex adult escort hookup nude camgirl ads adserver
clickbait popup tracker payday loan cash bitcoin giveaway prize winner replica counterfeit followers backlinks
""".split()
BLOCK_PARTNERS = "win free cheap best bonus hot online fast easy deals ring offers club x track 24 pro buy".split()
ALLOW_WORDS = """
news blog library museum university school garden cooking travel weather science history music theatre archive
journal market forum photo health sports city council village river mountain forest ocean winter window alphabet
better castle casual pillow farmer roads threads address planet people reading writing gallery research physics
chemistry biology medicine hospital clinic teacher student language grammar dictionary atlas map bridge railway
station airport harbour ferry bicycle engine software compiler database network server reference manual guide
recipe kitchen bakery coffee orchard vineyard festival concert orchestra cinema novel poetry author publisher
""".split()
ALLOW_PARTNERS = "home daily world north south green open old new first team works house hub notes today north".split()
SYLLABLES = """
an ber cal den el fi gar hol in jo ka lem mar nor ol per ros sten tion ur ver wil xan yor zel the and ing ous ment
""".split()
PREFIXES = ["", "www.", "m.", "blog.", ""]
DOMAINS = ["example.com", "example.net", "example.org"]
PATHS = ["/en/7", "/de/41.html", "/fr/930/", "/es/5", "/", "/en/page?x=2", "/index.html", ""]
BLOCKED, ALLOWED = 480, 960


def _host(k: int, words: list[str], partners: list[str], alone: bool) -> str:
    """The k-th host's name: a word with another, with a partner on either side, or alone."""
    turn = k // len(words)
    word, partner = words[k % len(words)], partners[(5 * k + turn) % len(partners)]
    other = words[(7 * k + turn + 1) % len(words)]
    dash = "-" * (k % 3 > 0)
    if alone:
        return word
    return [word + dash + other, partner + dash + word, word + dash + partner][k % 3]


def _sound(k: int) -> str:
    """The k-th invented name, of two or three syllables."""
    n, turn = len(SYLLABLES), k // len(SYLLABLES)
    return SYLLABLES[k % n] + SYLLABLES[(7 * k + 2 * turn) % n] + (SYLLABLES[(11 * k + 5 * turn) % n] if k % 2 else "")


def _urls(names: list[str]) -> list[str]:
    return [
        f"https://{PREFIXES[k % 5]}{name}.{DOMAINS[k // 3 % 3]}{PATHS[k // 5 % len(PATHS)]}" for k, name in enumerate(names)
    ]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default table: ``url``, ``label`` (1 blocked, 0 allowed), made of the words above by number."""
    bad = [_host(k, BLOCK_WORDS, BLOCK_PARTNERS, k % 4 == 3) for k in range(BLOCKED)]
    good = [_host(k, ALLOW_WORDS, ALLOW_PARTNERS, k % 4 == 1) if k % 2 else _sound(k // 2) for k in range(ALLOWED)]

    def rows(names: list[str], label: float) -> DataFrame:
        whole = F.split(F.lit("\n".join(_urls(names))), "\n")
        return spark.range(1).select(F.explode(whole).alias("url"), F.lit(label).alias("label"))

    return rows(bad, 1.0).union(rows(good, 0.0))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    whole = F.coalesce(F.col(url), F.lit(""))
    begin = F.instr(whole, "://")
    rest = F.when(begin > 0, F.substring(whole, begin + 3, F.length(whole))).otherwise("")
    pattern = r"(?s)^([^/?#]*)([^?#]*)"
    host = F.translate(
        F.regexp_extract(rest, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, pattern, 2)


def rule_and_verdict(rules=RULES) -> tuple[Column, Column]:
    """Longest rule that fits ``host`` (or a parent of it) and the start of ``path``, and its verdict."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> Column:
        host, slash, path = rule.partition("/")
        at_host = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        return at_host & F.startswith("path", F.lit(slash + path))

    def pick(of) -> Column:
        cases = [F.when(fits(rule[0]), F.lit(of(rule))) for rule in longest_first]
        return F.coalesce(*cases, F.lit(None).cast("string"))

    return pick(lambda r: r[0]), pick(lambda r: r[1])


def _grams(urls: DataFrame) -> DataFrame:
    """``host_grams`` and ``path_grams``, with marks at both ends and one sign for all digits."""
    host, path = host_and_path()
    out = urls.withColumns({"host": host, "path": path})
    for part in ("host", "path"):
        folded = F.translate(F.lower(part), "123456789", "000000000")
        folded = F.regexp_replace(folded, "0+", "0")
        out = out.withColumn(f"{part}_chars", F.split(F.concat(F.lit("^"), folded, F.lit("$")), ""))
        for n in GRAMS:
            out = NGram(n=n, inputCol=f"{part}_chars", outputCol=f"{part}_{n}").transform(out)
        out = out.withColumn(f"{part}_grams", F.concat(*[f"{part}_{n}" for n in GRAMS]))
    return out.drop(*[f"{p}_{x}" for p in ("host", "path") for x in ("chars", *GRAMS)])


def _model(strength: float) -> Pipeline:
    steps = [
        HashingTF(inputCol=f"{part}_grams", outputCol=f"{part}_counts", numFeatures=slots, binary=True)
        for part, slots in SLOTS.items()
    ]
    less = Vectors.dense([PATH_WEIGHT] * SLOTS["path"])
    steps += [
        ElementwiseProduct(scalingVec=less, inputCol="path_counts", outputCol="path_less"),
        VectorAssembler(inputCols=["host_counts", "path_less"], outputCol="features"),
        LogisticRegression(maxIter=20, tol=1e-4, regParam=strength, standardization=False),
    ]
    return Pipeline(stages=steps)


def fit(labelled: DataFrame, strengths=STRENGTHS) -> PipelineModel:
    """Logistic regression over the hashed n-grams of labelled URLs; rows without a label are left out.

    The strength is that of the least loss on held-out hosts; the model returned is fitted on all rows.
    """
    rows = _grams(labelled.select("url", F.col("label").cast("double").alias("label")).dropna(subset=["label"]))
    # a small table: one task an iteration
    rows = rows.select("host", "host_grams", "path_grams", "label").coalesce(1).cache()
    held = F.pmod(F.crc32("host"), F.lit(HELD_OUT)) == 0
    probability = vector_to_array("probability")[F.col("label").cast("int")]
    losses = {}
    for strength in strengths if len(strengths) > 1 else ():
        scored = _model(strength).fit(rows.filter(~held)).transform(rows.filter(held))
        losses[strength] = scored.agg(F.avg(-F.log(probability + 1e-12))).first()[0]
    known = {strength: loss for strength, loss in losses.items() if loss is not None}
    best = min(known, key=known.get) if known else strengths[0]
    model = _model(best).fit(rows)
    rows.unpersist()
    return model


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row of ``pages``.

    The longest fitting rule decides, else the regression: ``block`` from ``threshold`` on. ``score``
    is the regression's probability of a block for every row. A null URL has an empty host and path,
    fits no rule and is scored as such. Columns other than ``page_id`` and ``url`` are ignored; repeated rows
    come back as often as they come; an empty table gives none.
    """
    model = fit(labelled)
    scored = model.transform(_grams(pages.select("page_id", "url")))
    rule, verdict = rule_and_verdict(rules)
    score = vector_to_array("probability")[1]
    return scored.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
