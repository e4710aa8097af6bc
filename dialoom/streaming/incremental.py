"""Incremental preparation: per-row operators on streams of whole dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators.pairing import ASSISTANT, HUMAN


def paired(conversation: Column) -> Column:
    """Exchanges of an array of (role, text) turns; windows aren't allowed on streams."""
    def step(turn: Column, i: Column) -> Column:
        after = F.get(conversation, i + 1)
        good = turn["role"].isin(*HUMAN) & after["role"].isin(*ASSISTANT) & (turn["text"] != "") & (after["text"] != "")
        return F.when(good, F.struct(turn["text"].alias("human"), after["text"].alias("assistant")))

    return F.filter(F.transform(conversation, step), lambda x: x.isNotNull())


def prepare_stream(dialogues: DataFrame) -> DataFrame:
    """(conv_id, conversation) of a batch or streaming table with an array column ``turns``."""
    own = dialogues.select("conv_id", paired(F.col("turns")).alias("conversation"))
    return own.where(F.size("conversation") > 0)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived and stop."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
