"""The stages of the corpus pipeline; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, op4, secrets, simhash, toxicity
from quillspark.llm._shared import fat_rows


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, learnt from all labels.

    Null and empty texts have no words and the score of a zero ratio: they stay where
    toxic labels are rare; very long texts are scored whole; repeated rows share their
    fate; an empty table gives no rows; columns of any name pass through.
    """
    name = fresh(docs, "__score")
    scored = toxicity.score(docs, op4.classifier(spark, sf_dir, held=False), docs.columns, name=name)
    return scored.filter(F.col(name) < op4.THRESHOLD).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8 or more) the document of the smallest id.

    Texts without words, null ones too, are one group: the one of the smallest id stays.
    """
    fat_rows(spark)
    return simhash.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with [SECRET] in place of each stretch that the secret scan finds; n_chars follows the text.

    Null and empty texts and texts without a secret stay as they are; very long texts are
    scanned whole; repeated rows are each kept; an empty table gives no rows; columns of
    any name pass through.
    """
    name = fresh(docs, "__spans")
    clean = fresh(docs, "__clean")
    found = secrets.scan(docs, docs.columns, name=name).withColumn(clean, secrets.redacted(F.col("text"), F.col(name)))
    changed = {"text": F.col(clean), "n_chars": F.when(F.size(name) > 0, F.length(clean).cast("bigint")).otherwise(F.col("n_chars"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; documents of no copies go.

    Null and empty texts have no words and go; a null source is a source like any other;
    repeated rows are taken alike; an empty table gives no rows; columns of any name pass
    through.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether the ids decode to the text.

    A null or empty text has no ids; very long texts are encoded whole; repeated rows are
    each encoded; an empty table gives no rows; other columns, of any name, are left out.
    """
    import public_tokenizers

    fat_rows(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "source", "text"]).select(
        "doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact")
    )
