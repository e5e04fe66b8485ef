"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Defined cases: null texts count as empty; null ids are rows like others (of equal texts one with an id is
kept before one without). Repeated rows are equal texts, so one stays. Ties: of equal texts the largest
doc_id stays, of near copies the smallest, then the row that comes first by its other columns. Texts of
any length are read as a whole. An empty table gives no sequences. Other columns, whatever their names, go
through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contraspark.llm import exact_dedup, jaccard_join, packing, substring_dedup, toxicity
from contraspark.llm.common import clean_up, free_name, materialise, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the classifier learns from the labels of the rows that are not held out."""
    labels, fold = toxicity.read_labels(spark, sf_dir), ~toxicity.held_out()
    weights = toxicity.train(docs.where(fold), labels.where(fold))
    column = free_name(docs, "_toxicity")
    return toxicity.score(docs, weights, out_col=column).where(F.col(column) < 0.5).drop(column)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a shingle similarity of 0.8 or more the one with the smallest doc_id stays."""
    return jaccard_join.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id holds too are cut; texts without such words stay as they are.

    A document that loses all its words goes on with an empty text. Columns that have the names of the
    operator's results are kept as they were.
    """
    own = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    out = substring_dedup.substring_dedup(own, place["doc_id"], place["text"])
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col(place["text"]))
    made = {"text": text}
    if "n_chars" in place:
        made["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(place["n_chars"]))
    return out.select(*[made.get(c, F.col(p)).alias(c) for c, p in place.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 token ids."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies), ("substring_dedup", cut_repeated_passages), ("packing", pack),
]
#: Learning, components and packing are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written to shared storage and read again by the next.

    Once a stage has been written, the tables that it and the stages before left are deleted.
    """
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        before = written()
        docs = materialise(rows, f"stage-{name}")
        clean_up(spark, others | (written() - before))
    return STAGES[-1][1](spark, docs, sf_dir)
