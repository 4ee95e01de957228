"""Odd tables that every operator must take."""

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fingerprint string, "
    "norm string, kept boolean, component_id bigint, words string, start bigint, fold int"
)
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_documents(spark):
    """Null ids and texts, empty and very long texts, repeated rows, ids with two texts, clashing names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 80)
    words = same.split()
    texts = [
        (1, "One small text of a few words."),
        (1, "One small text of a few words."),  # the row again
        (1, "another text under the same id"),
        (None, "text without an id"),
        (None, "text without an id"),
        (None, None),
        (2, None),
        (3, ""),
        (4, "   \n\t "),
        (5, long),
        (6, long.upper()),
        (7, same),
        (8, " ".join([*words[:40], "changed", *words[41:]])),
        (9, "Éa É ÀB ünï   x y \x1f z"),
        (10, same),
        (11, "<|endoftext|> a<|startoftext|>b it's 12345 é 中文 <|ENDOFTEXT|>"),
    ]
    rows = [(i, t, "en", "s", 1, 0.5, "f", "n", True, 7, "w", 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
