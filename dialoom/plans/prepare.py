"""Preparation from end to end: scanned tables to chat rows, statistics and errors."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import pairing, refs, resolve, stats
from dialoom.sources import readers, sinks

#: Columns of a chat row's line.
LINE = ("system", "conversation", "images")


@dataclass
class Prepared:
    """``judged`` has a row (split, idx, conv_id, outcome, rounds, system, conversation, images) for each input."""

    judged: DataFrame

    @property
    def rows(self) -> DataFrame:
        """The chat rows."""
        return self.judged.where("outcome = 'processed'").select("split", "idx", "conv_id", "system", "conversation", "images")

    @property
    def outcomes(self) -> DataFrame:
        return self.judged.select("conv_id", "split", "idx", "outcome", "rounds")

    def errors(self) -> DataFrame:
        """(split, idx, message) of the rows that failed; rows left out by their source are no errors."""
        failed = self.judged.where(~F.col("outcome").isin("processed", "filtered"))
        return failed.select("split", "idx", F.concat("outcome", F.lit(": "), sample_id()).alias("message"))

    def stats(self) -> DataFrame:
        """(split, stats): seven counters and the first errors."""
        return stats.stats_by_split(self.outcomes, self.errors())

    def write(self, path: str, splits: Sequence[str] = readers.SPLITS, file_bytes: int = sinks.FILE_BYTES) -> dict[str, dict[str, int]]:
        """The judged rows as Parquet by split, from these JSON lines for each split in the inputs' order, and the statistics document; the counters by split.

        The inputs are read once: the counters of ``splits`` are taken from the rows while they are written, in the stage that writes
        them; only if other splits turn up are the counters taken from the written table. Errors and lines are read
        from there too. Each split's lines have a manifest, so that a further run over written rows goes on where the last one ended.
        """
        spark, table = self.judged.sparkSession, f"{path}/judged"
        if readers.exists(spark, f"{path}/stats/_SUCCESS"):
            return _counters(spark, path)
        names = list(dict.fromkeys(splits))
        line = F.when(F.col("outcome") == "processed", F.octet_length(sinks.json_line(*LINE)) + 1)
        watch = Observation()
        self.judged.observe(watch, *stats.observed(names, bytes=line)).write.mode("overwrite").partitionBy("split").parquet(table)
        got, made = watch.get, Prepared(spark.read.schema(self.judged.schema).parquet(table))
        counted = spark.createDataFrame([(s, *[got[f"{i}_{c}"] for c in stats.COUNTERS]) for i, s in enumerate(names)], "split string, " + ", ".join(f"{c} long" for c in stats.COUNTERS))
        counted = counted.where("samples_processed + samples_skipped > 0")
        sizes = {s: got[f"{i}_bytes"] for i, s in enumerate(names) if got[f"{i}_samples_processed"] + got[f"{i}_samples_skipped"]}
        if got["others"]:
            counted = stats.run_stats(made.judged)
            sizes |= {r["split"]: None for r in counted.select("split").collect() if r["split"] not in sizes}  # a row for each split
        for split, size in sorted(sizes.items(), key=lambda s: s[0] or ""):
            own = made.rows.where(F.col("split").eqNullSafe(split))
            sinks.write_ordered(own.select("idx", *LINE), f"{path}/{split}", "idx", file_bytes, size)
        sinks.stats_document(stats.with_errors(counted, made.errors()), pretty=True).coalesce(1).write.mode("overwrite").text(f"{path}/stats")
        return _counters(spark, path)


def _counters(spark: SparkSession, path: str) -> dict[str, dict[str, int]]:
    """The written statistics without their errors; a document of a line for each counter and at most a hundred errors a split."""
    told = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{path}/stats").collect()) or "{}")
    return {split: {c: own[c] for c in stats.COUNTERS} for split, own in told.items()}


def sample_id() -> Column:
    """A row's split and its position there, in six digits or more."""
    return F.format_string("%s_%06d", F.col("split"), F.col("idx"))


def _dialogues(df: DataFrame) -> DataFrame:
    """The table with ``conv_id`` as a key of the dialogue: with the split, if the table has one."""
    if "split" not in df.columns:
        return df
    return df.withColumn("conv_id", F.struct("split", "conv_id")).drop("split")


def prepare(turns: DataFrame, questions: DataFrame, images: DataFrame, found: DataFrame, sources: list[str], prefix: str, system: str) -> Prepared:
    """Chat rows of the inputs that have an image of an allowed source which is found, and a round.

    ``images`` (conv_id, split, image, and idx, by default the conv_id) names the inputs. They are told apart by split and idx, as
    positions and ids begin again in each split; each keeps its own image, also if several share a dialogue. ``turns`` are
    reflective ones (conv_id, turn, role, kind, value), ``questions`` (conv_id, question); with a further column ``split``, in
    both, dialogues of one id in different splits are different ones, without it they are shared. ``found`` (path) is
    what can be resolved, as such or below ``prefix``. A row's outcome is the first of its failures in the order
    of ``stats.OUTCOMES``; a failing row never stops others.
    """
    exchanges = pairing.reflective_exchanges(pairing.reflective_rounds(_dialogues(turns)), _dialogues(questions))
    chats = pairing.chat_rows(exchanges, "round", system).select(F.col("conv_id").alias("dialogue"), "conversation")
    idx = F.col("idx" if "idx" in images.columns else "conv_id").alias("idx")
    own = images.select("conv_id", "split", idx, "image")
    path = F.when(refs.has_image(F.col("image")), F.col("image")).alias("path")
    looked = resolve.lookup_with_fallback(own.select(F.struct("split", "idx").alias("ref_id"), path, "*"), found, prefix)
    dialogue = F.struct("split", "conv_id") if "split" in turns.columns else F.col("conv_id")
    joined = looked.withColumn("dialogue", dialogue).join(chats, "dialogue", "left")
    outcome = stats.outcome(
        F.col("image").isNull(), ~refs.in_sources(F.col("image"), sources), F.col("resolved").isNull(), F.col("conversation").isNull()
    )
    rounds = F.coalesce(F.size("conversation"), F.lit(0)).cast("bigint").alias("rounds")
    listed = F.when(F.col("resolved").isNull(), F.array().cast("array<string>")).otherwise(F.array("resolved")).alias("images")
    return Prepared(joined.select("split", "idx", "conv_id", outcome.alias("outcome"), rounds, F.lit(system).alias("system"), "conversation", listed))
