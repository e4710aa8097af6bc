"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, brown, decontaminate, groups, lines, minhash, ogg, packing, passages, periodic, quality, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def aligned_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), cached=600_000)  # alone, it has the room


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(_table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(_table(spark, sf_dir, "documents"), both_sides=True)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity_report(_table(spark, sf_dir, "pages"))


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def planted_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; of one in ten, by the id, the words from some place on repeat the first of them. A row without an id stays as it is."""
    words = text.split()
    if doc_id is None or not words:
        return words
    g, digit = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if digit:
        return words
    a = g % len(words)
    period = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % period] for i in range(len(words) - a)]


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(_table(spark, sf_dir, "documents"), planted_words)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(_table(spark, sf_dir, "documents"), *aligned_paths())


def op13_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.similar_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_minhash, op3_shard, op4_brown, op5_passages, op6_lines, op7_ogg, op8_quality, op9_fixity, op10_winnow, op11_periodic, op12_align, op13_groups)}
SQL: dict[str, str] = {}
