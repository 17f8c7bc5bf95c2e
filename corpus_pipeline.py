"""Corpus pipeline: the stages that turn ``documents`` into mixed, tokenised training rows.

Each stage takes and returns rows with the columns of ``documents``; the last returns each row's
token ids. Nulls, empty texts, repeated rows, empty tables and further columns are handled as the
operators' docstrings say; what a stage adds to that stands in its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashelf.llm import langid, mixing, parity_join, piece_lattice, suffix_dedup
from mediashelf.llm._common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from their own ``lang``. When
    nothing can be learned, only documents without a letter go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8: the one with the
    smallest id (of equal ids: one of them). Rows without an id, and rows without a word, stay.

    Rows are told apart by a number of their own, so rows that share an id and not their text are
    documents of their own; the numbered rows are staged, because numbers must not change between jobs."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    node = F.when(F.col("doc_id").isNotNull(), F.col(row))
    found = parity_join.jaccard_components(numbered.select(node.alias("node"), "text"), id_col="node")
    linked = found.where("n_shingles > 0").select(F.col("doc_id").alias("node"), F.col("component_id").alias("group"))
    groups = linked.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    ids = numbered.select(F.col(row).alias("node"), "doc_id")
    members = staged(linked.join(groups, "group").join(ids, "node"))
    first = members.groupBy("group").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("first.node")
    drop = staged(members.join(first, "node", "left_anti").select(F.col("node").alias(row)))
    few = drop.count() * parity_join.ROW_BYTES <= parity_join.BROADCAST_BYTES
    return numbered.join(F.broadcast(drop) if few else drop, row, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that an earlier document has; characters go
    whole, ``n_chars`` follows, and a document of which nothing but white space is left goes."""
    cut = suffix_dedup.suffix_dedup(docs, 50, whole_chars=True)
    text = F.col("kept").cast("string")
    columns = {"doc_id": F.col("doc_id"), "text": F.when(F.col("n_bytes") > 0, text).otherwise(""),
               "n_chars": F.length(text).cast("long")}
    gone = (F.col("n_removed") > 0) & (F.regexp_count(text, F.lit(r"\S")) == 0)
    return cut.where(~gone).select(*[columns.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that their sources meet the target weights."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row."""
    return piece_lattice.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: The language model, the similarity components and the suffix classes are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's rows staged as Parquet for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
