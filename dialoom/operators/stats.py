"""Run statistics: counters over one outcome column, totals, rates and bounded error lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import head

# Outcomes of a row in the order in which they are tested, and the cap of an error list.
OUTCOMES = ("no_image", "filtered", "unresolved", "no_conversations", "processed")
ERRORS = 100


def outcome(no_image: Column, filtered: Column, unresolved: Column, no_conversations: Column) -> Column:
    return F.when(no_image, "no_image").when(filtered, "filtered").when(unresolved, "unresolved").when(no_conversations, "no_conversations").otherwise("processed")


def counters(counted: Column | None = None) -> list[Column]:
    """The seven counters, of the rows that meet ``counted`` if it is given."""
    own = F.col("outcome") if counted is None else F.when(counted, F.col("outcome"))
    return [
        F.count_if(own == "processed").alias("samples_processed"), F.count_if(own != "processed").alias("samples_skipped"),
        F.count_if(own.isin("no_image", "unresolved")).alias("samples_no_image"), F.count_if(own == "no_conversations").alias("samples_no_conversations"),
        F.count_if(own == "filtered").alias("samples_filtered_by_source"),
        F.coalesce(F.sum(F.when(own == "processed", F.col("rounds"))), F.lit(0)).cast("bigint").alias("total_rounds"),
        F.count_if(own.isin("no_conversations", "processed")).alias("images_saved"),
    ]


# Names of the counters, in the order of a statistics document.
COUNTERS = ("samples_processed", "samples_skipped", "samples_no_image", "samples_no_conversations", "samples_filtered_by_source", "total_rounds", "images_saved")


def observed(splits: list[str], **more: Column) -> list[Column]:
    """Metrics for ``DataFrame.observe``: each split's counters, its further sums ``more``, and how many rows are of no such split."""
    out = [F.count_if(~F.coalesce(F.col("split").isin(*splits), F.lit(False))).alias("others")]
    for i, split in enumerate(splits):
        own = F.col("split") == split
        out += [c.alias(f"{i}_{name}") for c, name in zip(counters(own), COUNTERS, strict=True)]
        out += [F.coalesce(F.sum(F.when(own, c)), F.lit(0)).cast("bigint").alias(f"{i}_{name}") for name, c in more.items()]
    return out


def run_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(*counters())


def run_stats_rollup(rows: DataFrame) -> DataFrame:
    own = rows.rollup("split").agg(*counters())
    return own.withColumn("split", F.coalesce("split", F.lit("total")))


def stats_by_split(rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(split, stats): the counters and the first errors of each split as one struct."""
    return with_errors(run_stats(rows), errors)


def with_errors(counted: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(split, stats) of the counters by split and the errors (split, idx, message), the first of each split."""
    names = [c for c in counted.columns if c != "split"]
    if errors is None:
        return counted.select("split", F.struct(*names).alias("stats"))
    listed = first_errors(errors).groupBy("split").agg(F.array_sort(F.collect_list(F.struct("idx", "message"))).alias("e"))  # ERRORS at most
    messages = F.coalesce(F.transform("e", lambda e: e["message"]), F.array().cast("array<string>"))
    return counted.join(listed, "split", "left").select("split", F.struct(*names, messages.alias("errors")).alias("stats"))


def summary_lines(stats: DataFrame) -> DataFrame:
    """(split, line): what a run reports of each split to its reader."""
    mean = F.format_string("%.2f", safe_mean(F.col("total_rounds"), F.col("samples_processed")))
    return stats.select("split", F.concat_ws(
        ", ", F.concat(F.col("split"), F.lit(": "), F.col("samples_processed"), F.lit(" processed")), F.concat("samples_skipped", F.lit(" skipped")),
        F.concat("samples_no_image", F.lit(" without image")), F.concat(mean, F.lit(" rounds on average")),
    ).alias("line"))


def effective_batch(batch: Column, accumulation: Column, ranks: Column) -> Column:
    """Rows that one optimizer step sees."""
    return batch * accumulation * ranks


def safe_mean(total: Column, n: Column) -> Column:
    return total / F.greatest(F.lit(1), n)


def coverage_percent(mapped: Column, total: Column) -> Column:
    """Null without paths."""
    return F.round(F.try_divide(100.0 * mapped, total), 1)


def first_errors(errors: DataFrame, cap: int = ERRORS) -> DataFrame:
    """The first ``cap`` errors of each split in row order; errors: (split, idx, message)."""
    return head(errors, "idx", cap, ["split"])
