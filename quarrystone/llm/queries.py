"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import chunk_dedup, decontaminate, fingerprint, html_text, importance, infill, language_id, packing, piece_codec, secrets, simhash_dedup, toxicity, warc
from quarrystone.llm.common import table

#: The vocabulary that the packing query counts with.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The vocabulary that texts are encoded and decoded with.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.train(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.report(table(spark, sf_dir, "documents"), PIECES)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_html_text": op2_html_text,
        "op3_fingerprint": op3_fingerprint,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_chunk_dedup": op6_chunk_dedup,
        "op7_simhash_dedup": op7_simhash_dedup,
        "op8_decontaminate": op8_decontaminate,
        "op9_secrets": op9_secrets,
        "op10_packing": op10_packing,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op8_decontaminate": decontaminate.SQL,
        "op12_fill_in_middle": infill.SQL,
    }
