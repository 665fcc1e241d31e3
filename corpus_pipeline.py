"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and
returns documents (the last one packed pieces). run() writes each stage's rows as Parquet in the shared folder
and reads them back, so a lost executor repeats a part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language, minhash, packing, pii
from docloom.llm.common import cut, discard
from docloom.llm.queries import PSEUDONYM_KEY, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the fused language becomes lang where a document declares none.

    Null, empty and unreadable texts go. Ids are not read: rows without one or with another's, and repeated rows, are judged each by itself. Very long
    texts are read whole; of equally likely languages the first by name counts. An empty table stays empty; columns of any name stay.
    """
    model = language.fit(docs, "text", "lang")
    kept = docs.select("text", "lang", "source", F.struct("*").alias("row"))
    found = language.identify(kept, model, F.col("text"), F.col("lang"), F.col("source")).filter("accepted")
    return found.select(*[F.coalesce("lang", "language").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, five-word shingles alike by 0.8 or more: the one with the smallest id.

    Rows are told apart by id and text: another text of the same id stays, and of rows equal in both one stays. Rows without an id come last in
    their class. Null and empty texts are alike, so one of them stays. Very long texts are compared whole. An empty table stays empty; columns of any name stay.
    """
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Each row is judged by its own text, with or without an id, and of repeated rows all stay or go. Null and empty texts stay; very long ones are searched whole.
    An empty benchmark or table changes nothing; columns of any name stay.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text.

    Rows and their order in columns stay, whatever their ids, names or repetitions; a null or empty text stays as it is, a very long one is worked on whole.
    """
    done = pii.pseudonymise(docs, PSEUDONYM_KEY, counts=False)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences; null texts count as empty, rows without or with a repeated id are packed apiece, an empty table gives no rows."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("packing", pack),
]

#: Minima of shingles, masked seeds, keyed permutations and BPE ids have no counterpart in DuckDB's SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
