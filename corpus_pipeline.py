"""From raw documents to packed sequences: five stages, each reading what the one before wrote.

``STAGES`` names them in order; each takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of documents.  ``run`` applies them to the documents of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import langid_kn, minhash, mixing, packing, substring_tree
from gleaner.llm.common import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the models reject (no letters, or unlike any language learned)."""
    return langid_kn.keep_identified(docs, langid_kn.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the least id.

    Different texts under one id are different documents; of rows with equal id and text, one stays.
    """
    return minhash.keep_one(docs, Scratch(spark))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of passages that occur again anywhere; texts that are left empty go."""
    return substring_tree.remove_repeats(docs, Scratch(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights."""
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))
    return mixing.emit_mix(mixing.mix_sources(rows, Scratch(spark))).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences."""
    return packing.pack_documents(docs, Scratch(spark))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("pack", pack)]

#: Language models, signatures and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents in ``sf_dir``.  What a stage returned goes once the next one's result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        after = Scratch(spark)
        docs = after.keep(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
