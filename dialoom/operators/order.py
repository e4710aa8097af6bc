"""Positions, heads and limits under an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a span that one window numbers, and the most spans.
SPAN_ROWS, SPANS = 1 << 20, 1024
#: Sampled keys for each span.
SAMPLED = 20


def span_bounds(df: DataFrame, keys: list[str]) -> list[tuple]:
    """Keys that part the rows into spans of about ``SPAN_ROWS`` rows in the order of ``keys``; fewer than ``SPANS``.

    They are taken from a sample of the rows, so that they follow the data whatever the keys look like.
    """
    n = df.count()
    spans = min(SPANS, -(-n // SPAN_ROWS))
    if spans < 2:
        return []
    sampled = df.select(*keys).sample(fraction=min(1.0, SAMPLED * spans / n), seed=17).dropna()
    rows = sorted(tuple(r) for r in sampled.collect())  # about SAMPLED * SPANS rows at most
    return sorted({rows[i * len(rows) // spans] for i in range(1, spans)} if rows else set())


def span_of(bounds: list[tuple], keys: list[str]) -> Column:
    """How many bounds are at or below the row's keys, by bisection."""
    if not bounds:
        return F.lit(0)
    known, key, step = F.array(*[F.struct(*map(F.lit, b)) for b in bounds]), F.struct(*keys), 1
    steps = []
    while step <= len(bounds):
        steps.insert(0, F.lit(step))
        step *= 2

    def narrow(at: Column, s: Column) -> Column:
        return at + F.when(F.coalesce(F.get(known, at + s - 1) <= key, F.lit(False)), s).otherwise(0)

    return F.aggregate(F.array(*steps), F.lit(0), narrow)


def with_position(df: DataFrame, key: str, name: str = "idx", by: list[str] | None = None) -> DataFrame:
    """Number the rows from 0 by a unique key, whole number or text, within ``by`` if given.

    Rows are numbered inside spans of the order (by, key), and the spans' counts complete the numbers, so
    that no task orders the whole table or a whole group of it.
    """
    by = by or []
    keys = [*by, key]
    own = df.withColumn("__span", span_of(span_bounds(df, keys), keys))
    counts = own.groupBy(*by, "__span").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span and group
    starts = counts.select(*by, "__span", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    nth = F.row_number().over(Window.partitionBy(*by, "__span").orderBy(key)) - 1
    return own.withColumn("__nth", nth).join(starts, [*by, "__span"]).withColumn(name, F.col("__first") + F.col("__nth")).drop("__span", "__nth", "__first")


def head(df: DataFrame, key: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, of each group if ``by`` is given; all of them if n is 0 or less.

    Each task passes on no more than its own first ``n`` of a group.
    """
    if n <= 0:
        return df
    if not by:
        return df.orderBy(key).limit(n)
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("__nth") <= n).drop("__nth")


def head_after(df: DataFrame, condition: Column, key: str, n: int) -> DataFrame:
    """The first ``n`` rows that meet the condition."""
    return head(df.where(condition), key, n)


def until_found(scan: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """A row of ``scan`` for each needed key that it holds. The whole scan is read: the limit stands above an aggregate."""
    wanted = needed.select(key).distinct()
    return scan.join(wanted, key, "left_semi").dropDuplicates([key]).limit(wanted.count())
