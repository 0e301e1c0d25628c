"""Training-corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token output.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; the result is
written as Parquet and read again as the next stage's input. All stages but the last return the columns
of ``documents``; the last returns a row for each document of the token files.

Documents that a stage rejects go: texts in no known language, all but one of each group of
near-duplicates, documents with benchmark passages, and what the mixture does not draw.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findra.llm import decontaminate, jaccard_join, language_id, mixing, token_output
from findra.llm.common import stored, table, unused

#: Expected share of the tokens that the mixing stage keeps.
MIX_BUDGET = 0.5
#: Token output shares its executors with what earlier stages left in them: less cache and smaller batches than alone.
TOKEN_CACHE_CHUNKS = 200_000
TOKEN_BATCH_CHARS = 3_000_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; ``und`` goes."""
    own = unused(docs, "judged_")
    judged = language_id.predict(docs, language_id.train(docs), lang_name=f"{own}lang", score_name=f"{own}score")
    return judged.where(F.col(f"{own}lang") != language_id.UNKNOWN).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic."""
    return mixing.sample(spark, docs, budget=MIX_BUDGET)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    out = token_output.token_output(spark, docs, public_tokenizers.path("word_bpe_49k.json"), cache=TOKEN_CACHE_CHUNKS, batch_chars=TOKEN_BATCH_CHARS)
    return out.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

#: Language ID and token ids cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
