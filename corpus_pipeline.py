"""A training corpus from raw documents: judged, deduplicated by line and by document, decontaminated, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  ``run`` writes each
stage's rows as Parquet in the shared folder and reads them back for the next one, so a lost executor never
costs more than one stage's work.

All stages but the last return the columns they were given; columns that stages add on the way have names that no column
has.  Every row is a document: rows without an id, and rows that share one, are judged and compared like others.  Null
texts count as empty.  Each stage gives an empty table for one.  Texts may have any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlytics.llm import decontamination, jaccard_join, line_dedup, packing, quality
from netlytics.llm.common import fresh, materialize
from netlytics.llm.queries import tokenizer_path


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without labels of both kinds, all stay or all go (see ``quality``).  Equal texts share their fate."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_labelled=3000)
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    return quality.score(docs, model, score_col=score, predicted_col=predicted).where(F.col(predicted) == 1).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in at least three documents stay in the last of them only; ``n_chars``, if there is one, follows the text.  A null text becomes empty."""
    lines, dropped = fresh(docs, "lines"), fresh(docs, "dropped")
    out = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3, lines_col=lines, dropped_col=dropped)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(dropped) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(*docs.columns)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 on five-word shingles the one with the smallest id stays; empty texts resemble nothing and stay."""
    return jaccard_join.keep_one_of_each(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words is benchmark text go; without a benchmark none does."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens: a row for each piece of a document, repeated rows each with their own."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("quality", judge),
    ("line dedup", drop_common_lines),
    ("near copies", keep_one_near_copy),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The learned classifier cannot be expressed in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
