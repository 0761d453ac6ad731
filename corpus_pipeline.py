"""The corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir) over all rows that the one before it kept; all but the last
return the columns of documents, and other columns aren't read. Rows without a doc_id are kept by the stages that
compare documents. Null and empty texts go in the first stage; the others take them as texts without words.
Rows of one doc_id are each judged by their own text: near_duplicates drops a row only if a like text of a smaller
doc_id stays. Texts of any length are handled whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import lang_cnn, near_dedup, packing, quality_em, suffix_dedup
from tempora.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer learnt from weak labels keeps."""
    verdict = quality_em.classify(docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars"))
    return verdict.where("keep").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells: not `und`, and a mean probability of a half at least."""
    docs = docs.select(*COLUMNS)
    told = lang_cnn.predict(docs, lang_cnn.learn(docs), carry=("text", "lang", "source", "n_chars"))
    return told.where("lang_pred <> 'und' AND score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8 and more), that with the smallest doc_id."""
    return near_dedup.first_of_each(docs.select(*COLUMNS), 80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes and more that a smaller doc_id has; a character that loses a byte goes whole."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), carry=("lang", "source"), characters=True)
    return out.select("doc_id", F.col("kept").cast("string").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: a row for each bin with its tokens, and whose pieces start where."""
    import public_tokenizers

    return packing.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packed)]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
