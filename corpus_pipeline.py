"""A corpus pipeline of five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import decontaminate, lines, minhash, packing, quality
from dialoom.llm.queries import tokenizer_path
from dialoom.llm.scratch import Scratch, cleaned

#: Percent of Jaccard similarity from which documents are near-duplicates here; ``op2_minhash`` has a contract of its own.
SIMILAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the classifier accepts, each judged by itself and in place.

    Null and empty texts are scored as empty ones; repeated rows and repeated ids are
    judged row by row; columns of any name are passed through; an empty table stays so.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents left without any text go, as do null and blank ones.

    ``n_chars``, where there is one, follows the text. Rows equal in id and text keep the same
    lines; rows without an id come last; columns of any name are passed through; an empty table stays so.
    """
    cut = lines.dedup_lines(docs).where(F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n"))) > 0)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, with a Jaccard similarity of five-word shingles from 0.8 on.

    The row of smallest id stays, of rows equal in id and text one; rows without an id take part
    and rank last; texts without words are linked with nothing and stay; columns of any name are
    passed through; an empty table stays so.
    """
    return minhash.dedup(docs, SIMILAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark window, whatever their ids.

    Null and empty texts have no window and stay; repeated rows go or stay together; columns
    of any name are passed through; an empty table stays so, and an empty benchmark removes nothing.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences, as ``op1_pack`` returns it.

    Null and empty texts are the one closing token; repeated rows are packed as often as they occur; other
    columns are ignored; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # a trained classifier decides in the first stage; tests/llm/test_pipeline.py holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written once and read again, its own tables then removed."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with cleaned(spark):
            after = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.only(after)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
