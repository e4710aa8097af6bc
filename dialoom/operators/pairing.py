"""Turns to exchanges: adjacent-turn pairing as windows over one exchange per dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.text import extract_answer, extract_feedback, truthy

# Role names of the two sides.
HUMAN, ASSISTANT = ("human", "user"), ("gpt", "assistant")
#: Earlier rounds that a state shows.
HISTORY = 6


def pair_alternating(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, human, assistant) of adjacent human and assistant turns whose texts aren't empty."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ahead = turns.select("conv_id", "turn", "role", F.col("text").alias("human"), F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("assistant"))
    pairs = ahead.where(F.col("role").isin(*HUMAN) & F.col("next").isin(*ASSISTANT) & truthy(F.col("human")) & truthy(F.col("assistant")))
    return pairs.select("conv_id", "turn", "human", "assistant")


def reflective_rounds(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, answer, feedback): student answers that aren't empty, with the teacher's next turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    told = (F.lead("role").over(w) == "teacher") & (F.lead("kind").over(w) == "feedback")
    ahead = turns.select("*", F.when(told, extract_feedback(F.lead("value").over(w))).alias("feedback"), extract_answer(F.col("value")).alias("answer"))
    kept = ahead.where((F.col("role") == "student") & (F.col("kind") == "response") & truthy(F.col("answer")))
    return kept.select("conv_id", "turn", "answer", "feedback")


def numbered_rounds(rounds: DataFrame) -> DataFrame:
    """Rounds with their number from 0 and the feedback on the round before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return rounds.select("*", (F.row_number().over(w) - 1).alias("round"), F.lag("feedback").over(w).alias("before"))


def reflective_exchanges(rounds: DataFrame, questions: DataFrame) -> DataFrame:
    """(conv_id, round, human, assistant): the question first, then each earlier feedback; others drop out."""
    own = numbered_rounds(rounds).join(questions.where(truthy(F.col("question"))), "conv_id")
    human = F.when(F.col("round") == 0, F.col("question")).otherwise(F.col("before"))
    return own.select("conv_id", "round", human.alias("human"), F.col("answer").alias("assistant")).where(truthy(F.col("human")))


def dropped_rounds(rounds: DataFrame) -> DataFrame:
    """The rounds after the first whose predecessor got no feedback."""
    return numbered_rounds(rounds).where((F.col("round") > 0) & ~truthy(F.col("before"))).select("conv_id", "round", "turn")


def dialogue_reject(turns: Column, question: Column) -> Column:
    """Why a dialogue is left out: it has no turns, which is tested first, or no question; null if it stays."""
    return F.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, "no conversations").when(~truthy(question), "no question")


def chat_rows(exchanges: DataFrame, order: str, system: str, images: DataFrame | None = None) -> DataFrame:
    """One row per dialogue: system, conversation as an array in order, and ``images``, a list of its one path.

    ``images`` has (conv_id, image); dialogues without one, or all if it isn't given, have an empty list.
    """
    turns = F.array_sort(F.collect_list(F.struct(order, "human", "assistant")))
    own = exchanges.groupBy("conv_id").agg(turns.alias("c"))
    own = with_images(own, images)
    return own.select("conv_id", F.lit(system).alias("system"), F.transform("c", lambda s: F.struct(s["human"].alias("human"), s["assistant"].alias("assistant"))).alias("conversation"), "images")


def with_images(rows: DataFrame, images: DataFrame | None) -> DataFrame:
    """The rows with the list ``images`` of their dialogue's path."""
    none = F.array().cast("array<string>")
    if images is None:
        return rows.withColumn("images", none)
    paths = images.where("image is not null").groupBy("conv_id").agg(F.min("image").alias("image"))
    return rows.join(paths, "conv_id", "left").withColumn("images", F.when(F.col("image").isNull(), none).otherwise(F.array("image"))).drop("image")


def state_action(pairs: DataFrame, history: int = HISTORY, images: DataFrame | None = None) -> DataFrame:
    """A row per answer: the state, that is up to ``history`` earlier rounds and the question, and the action.

    ``messages`` holds one user and one assistant message; the user's starts with the image tag. ``images`` is as in ``chat_rows``.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = pairs.select("*", (F.row_number().over(w) - 1).alias("round"), F.collect_list(F.struct("turn", "human", "assistant")).over(w.rowsBetween(-history, -1)).alias("past"))
    told = F.transform("past", lambda s: F.concat(F.lit("User: "), s["human"], F.lit("\nAssistant: "), s["assistant"], F.lit("\n")))
    state = F.concat(F.lit("<image>\n"), F.array_join(told, ""), F.lit("User: "), F.col("human"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("user", state), message("assistant", F.col("assistant"))).alias("messages")
    return with_images(own.select("conv_id", "round", F.size("past").alias("n_history"), messages), images)
