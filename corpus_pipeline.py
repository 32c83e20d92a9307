"""A corpus pipeline over ``documents``: language, near and exact repeats, benchmark passages, packing.

Every stage reads what the one before it wrote and, but for the last, returns the columns of
``documents``. Null texts and documents without a letter leave with the first stage. Rows that share
an id are one document and one of them stays; rows without an id pass the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.runs import first_per
from factloom.llm import language
from factloom.llm.common import letters
from factloom.llm.decontaminate import find_items
from factloom.llm.near_duplicates import near_duplicates
from factloom.llm.packing import pack_documents
from factloom.llm.repeats import cut_repeats
from factloom.session import cut_lineage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Ids to take out are broadcast up to this count (some 16 bytes each), and joined by shuffle beyond it.
BROADCAST_IDS = 2_000_000


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of undetermined language: without a text, or without a letter in it.

    Where no language can be learned, the letters alone decide.
    """
    network = language.learn(docs)
    if network is None:
        return docs.filter(letters("text"))
    found = language.identify(docs, network)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity only the one with the smallest id stays."""
    gone = cut_lineage(near_duplicates(docs).filter("NOT kept").select("doc_id").distinct(), "gone")
    kept = docs.join(_small(gone), "doc_id", "left_anti")
    shared = cut_lineage(kept.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id"), "shared")
    if shared.isEmpty():
        return kept
    several = kept.join(_small(shared), "doc_id", "left_semi")
    one = first_per(several, ["doc_id"], [c for c in docs.columns if c != "doc_id"])
    return kept.join(_small(shared), "doc_id", "left_anti").unionByName(one.select(*docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every repeated run of bytes, and the rest of a character that it cuts; the document stays."""
    found = cut_repeats(docs)
    text = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    text = F.when(F.col("n_removed") > 0, whole).otherwise(F.col("text"))
    rows = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = _small(cut_lineage(found.filter("contaminated").select(F.col("doc_id").alias("_id"), "text_hash").distinct(), "gone"))
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("language", keep_known_languages), ("near_duplicates", keep_one_of_each_group), ("repeats", cut_repeated_passages),
    ("decontamination", drop_contaminated), ("packing", pack_sequences),
]
#: Language identification and tokens cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
