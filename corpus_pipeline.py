"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
``docs``. Labels, benchmarks and models are looked up anew in each stage; what a stage fits,
it fits on its own input.

* A null or empty text, and one without letters, has no language and goes in the first stage;
  so no later one meets it in ``run``, though each takes it: it is linked like any other text,
  has no windows and no secrets, and packs to its closing id.
* Very long texts are read whole by every stage. Ties: equal sizes go to the language that
  sorts first, the smallest id of linked documents stays, curve neighbours go by doc_id.
* Rows that repeat each other are near copies: one of them stays. Documents without an id are
  kept unless linked to one that has an id.
* An empty table gives no rows. Further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import decontaminate, language_id, packing, secrets, simhash_dedup
from quarrystone.llm.common import table, written
from quarrystone.llm.queries import TOKENIZER


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells by more than a narrow margin."""
    return language_id.accepted(docs, language_id.fit(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, that with the smallest id."""
    return simhash_dedup.keep_one(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secrets.redact(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, neighbours on the curve together."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", one_of_near_copies),
    ("decontaminate", not_contaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Compression, fingerprints and byte-pair ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
