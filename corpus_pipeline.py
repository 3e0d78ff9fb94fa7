"""A training-corpus pipeline over the documents table, as stages of the operators in regionscore.llm.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. Run alone, every stage's result is written to the shared folder and
read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.llm.bpe import encode_documents
from regionscore.llm.common import documents, fresh, shared_table
from regionscore.llm.line_dedup import dedup_lines
from regionscore.llm.mixing import mixed_documents
from regionscore.llm.quality_model import score
from regionscore.llm.queries import quality_model, tokenizer_path
from regionscore.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below a half go."""
    return score(docs, quality_model(spark, sf_dir), keep_text=True).filter("score >= 0.5").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take globally repeated runs of ten words or more out of the texts; every document stays, and common phrases do."""
    return dedup_lines(docs, min_words=10).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return one_of_each(docs, shingle=3, radius=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources come near their target weights."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document and the digest of what they decode to, with its other columns."""
    out = encode_documents(docs, tokenizer_path("word_bpe_49k.json"))
    new = {"n_tokens": F.floor(F.length("ids") / 4).cast("long"), "ids": F.col("ids"),
           "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}
    return out.select("row.*", *[c.alias(fresh(docs.columns, name)) for name, c in new.items()])


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe),
]

#: The classifier is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, f"stage{k}")
    return docs
