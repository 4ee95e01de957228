"""Registered queries of this package: thin applications to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsreg.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    language,
    packing,
    pseudonyms,
    quality,
    repair,
    secrets,
    simhash,
    tokens,
    trie,
    url_filter,
)
from tsreg.llm.common import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


@query()
def op1_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query()
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


@query()
def op3_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


@query()
def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op6_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key="test key of the query, not a secret")


@query()
def op7_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query()
def op8_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query()
def op9_secrets(spark, sf_dir):
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


@query(
    """
WITH rows_ AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM rows_ WINDOW same AS (PARTITION BY norm)"""
)
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op11_conversation_repair(spark, sf_dir):
    return repair.summaries(*repair.solved(repair.damaged(table(spark, sf_dir, "conversations"))))


@query()
def op12_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query()
def op13_language(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))
