"""A training corpus from raw documents: language, near copies, repeated passages, source weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.factors import remove_repeated_passages
from tessera.llm.langid import REJECT_BITS, UND, predict, train
from tessera.llm.mixing import mix_documents
from tessera.llm.packing import pack
from tessera.llm.simhash import without_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in no language: no letter, or more than REJECT_BITS bits a byte in the likeliest one. Where
    no language can be learned, all with letters stay."""
    trees = train(docs.select("doc_id", "text", "lang"))
    if not trees.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    known = predict(docs, trees)
    found = known[known.columns[-1]]
    return known.where((found["pred"] != UND) & (found["bits"] <= REJECT_BITS)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact and near copies."""
    return without_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 20 words or more that start earlier in the corpus."""
    return remove_repeated_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources meet their target weights."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and cut into sequences of power-of-two lengths."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language_id", language), ("near_copies", near_copies), ("passages", passages), ("mixture", mixture), ("packing", packing)]

#: SQL expresses none of the language model, the parsing and the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
