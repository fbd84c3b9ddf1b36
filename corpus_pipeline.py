"""Documents to training tokens: language, near copies, benchmark passages, personal data, encoding.

Each stage is written as Parquet in the shared folder and read again as the next one's input, so a lost executor costs one stage at
most; a stage's table goes when the next one is written, the last when the application ends.

Null and empty texts have no letter and go with the first stage, as do texts that no learned language fits. Of each group of near copies
the row of the least doc_id stays (rows without id come last; of rows equal in id and text one stays), whatever its size; a document
that shares too much with a benchmark item goes; personal data is replaced in the text. Ties are broken by hashes of the rows, not by
their order. An empty table, or one without labelled languages, gives an empty result with all columns; very long texts are read
whole; further columns, whatever their names, pass through all stages but the last, which returns doc_id, token ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import decontaminate, jaccard_join, langid, pii, sentencepiece_codec
from knotwork.llm.common import discard, scratch_folder, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.drop_rejected(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.mask_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentencepiece_codec.token_digests(docs, sentencepiece_codec.model_path(), with_ids=True)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("pii", personal_data),
    ("sentencepiece", tokens),
]

#: Language identification, the random field and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark, table(spark, sf_dir, "documents"), sf_dir)


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over the given documents; sf_dir holds the benchmark."""
    last = None
    for name, stage in STAGES:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, last)
        last = path
    return docs
