"""Corpus pipeline: five stages over ``documents``, each a table on the shared folder.

Rows without a doc_id can't be named in a group and leave in the first stage. Of
rows that repeat both doc_id and text one stays. Rows that repeat a doc_id with
other texts are one document to the benchmark stage: all leave if one of them is
hit. Null and empty texts are in no language and leave in the first stage. Columns
other than ``COLUMNS`` are dropped; an empty table stays empty. A text is handled
whole, in one task.
"""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lotspark.llm import bpe, decontam, langid, neardup, pii
from lotspark.llm.queries import PII_KEY, VOCABULARY
from lotspark.llm.scratch import Scratch, mark, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Standard deviations of a random vector's cosine beyond which a text is in a language.
SURE = 4.0
#: Texts with fewer letters may be too short to be like any language; they stay if so many of their letters are ones that the languages use.
SHORT_LETTERS, SHORT_SHARE = 60, 0.9


def least_score(languages: int, dims: int = langid.DIMS) -> float:
    """Cosine that the best of so many languages has with a random vector by chance in one case of some ten thousand."""
    return (SURE + math.sqrt(2 * math.log(max(1, languages)))) / math.sqrt(dims)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language that the corpus' labels know: without a letter, or no more like any than chance.

    A text with fewer than ``SHORT_LETTERS`` letters, such as a greeting, is told by
    its letters instead, if its score doesn't say it.
    """
    model = langid.train_prototypes(docs)
    alphabet = langid.train_alphabet(docs)
    named = langid.identify_language(docs.select(*COLUMNS), model)
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    strange = F.length(F.regexp_replace(F.lower(letters), f"[{alphabet}]", "")) if alphabet else F.length(letters)
    short = (F.length(letters) < SHORT_LETTERS) & (strange <= (1 - SHORT_SHARE) * F.length(letters))
    kept = F.when(F.col("score") > least_score(len(model)), True).otherwise(short)
    return named.where((F.col("lang_pred") != "und") & F.col("doc_id").isNotNull() & kept).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, once."""
    kept = neardup.near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select(*COLUMNS).join(kept, "doc_id")
    again = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy("source"))
    return rows.withColumn("again", again).where("n = 1 or again = 1").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    clean = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select("doc_id")
    return docs.join(clean, "doc_id", "left_semi").select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of personal data."""
    out = pii.with_pseudonyms(docs.select(*COLUMNS), PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and the digests of the ids and of the text that they decode to."""
    return bpe.encode_digests(docs.select(*COLUMNS), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("private_data", private_data), ("tokens", tokens)]
#: SQL has no hyperdimensional vectors, Feistel network or BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = mark()
        docs = scratch.save(stage(spark, docs, sf_dir))
        release(before)
    return docs
