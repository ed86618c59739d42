"""A training-data pipeline over the ``documents`` table, stage by stage.

Each stage gets what the one before it kept, written as Parquet and read again, and works on all of it. All but the last
return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm import credentials, language, packing, simhash, substrings
from itemlens.llm.common import documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every known language, or without letters, go; the others carry the language found."""
    model = language.fit(docs.where(~language.held_out()))
    found = language.predict(docs.select(*COLUMNS), model)
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Candidates by SimHash and by bands of least hashes are compared; of rows linked by five-word shingles of similarity 0.8 or more the one of
    least id stays. Rows of one id are told apart by their texts."""
    return simhash.without_near_duplicates(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that a 13-word window of an earlier document covers; documents of which nothing is left go too."""
    cut = substrings.remove_repeats(docs.select(*COLUMNS))
    return _as_documents(cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return _as_documents(credentials.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
