"""Registered queries of this package and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import chat, decontaminate, exact_dedup, html_extract, lm_score, packing, quality, simhash, token_store, toxicity
from termloom.llm.common import table

TOKENIZERS = os.environ.get("TERMLOOM_TOKENIZERS", "")


def tokenizer_file(name: str, folder: str = TOKENIZERS) -> str:
    """Where a public tokenizer file is: in ``folder``, or where its package says."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), "words", 1)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("bucket")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.turns_as_calls(table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(messages, chat.ANSWER_SCHEMA)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), "spaced", 2)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1,
    "op2_html_extraction": op2,
    "op3_simhash_near_dedup": op3,
    "op4_token_store": op4,
    "op5_decontamination": op5,
    "op6_exact_dedup": op6,
    "op7_chat_formatting": op7,
    "op8_best_fit_packing": op8,
    "op9_toxicity": op9,
    "op10_lm_scoring": op10,
    "pipeline": pipeline,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS key, least(len(w), 10) AS n
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        runs AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS key
                 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT r.doc_id, r.s, r.n, win.item_id FROM runs r JOIN win ON r.key = win.key AND r.n = win.n),
        spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(spots.n_hit, 0)::BIGINT AS n_hit,
               coalesce(items.n_items, 0)::BIGINT AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
               spots.n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_FOLD} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY body)""",
}
