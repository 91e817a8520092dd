"""A corpus pipeline of the training-data operators; each stage is written as Parquet and read again.

Every stage takes any documents table: a row with a null doc_id is left out by the stages that judge by id, an
empty table gives an empty table, further columns pass through under their names (but for the last stage, which gives pieces), and rows that share a
doc_id are rows of one document. Each stage says below what it does with null, empty and repeated texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm import mixing, neardup, packing, passages, toxicity
from bidlens.llm.common import scratch, settled, shared_dir


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in a struct `row`, where no operator's own columns can clash with them."""
    return docs.select(*names, F.struct(*[c for c in docs.columns if c not in names], F.lit(0).alias("")).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.7. The model learns from labelled documents. A null or empty
    text has the bias's score alone; equal texts share their fate; rows with a null doc_id are judged by text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = toxicity.score(_apart(docs, "text"), toxicity.learn(docs, labels)).where("predicted = 0")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest doc_id) of each group of near copies: five-word shingles, Jaccard 0.8. Texts
    without words, null ones too, resemble nothing and stay; so do all rows of a doc_id that stays."""
    found = settled(spark, lambda: neardup.near_duplicates(docs, size=5).where("doc_id = component_id").select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_semi").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with an id, without the passages that a document of smaller doc_id holds; n_chars follows. Null
    texts stay null; rows that share a doc_id lose nothing to one another."""
    cut = passages.remove_passages(_apart(docs, "doc_id", "text"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with an id as often as the mix takes it: not at all, once or twice. A text without words, null ones too, counts
    no words but is taken like others; repeated rows are each drawn for themselves; a null source is a source."""
    taken = mixing.mix(docs, keep=docs.columns).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens. A null or empty text is one
    closing token; repeated rows are packed each. The columns are those of the pieces: no other column of docs passes through."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Fitted models, hashing and tokenizers are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a stage writes on its way are deleted when its own result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
