"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a key of three parts: 16 bits of the text's hash, so that equal
texts lie together, 24 of the id's, which take a hot text apart, and 40 of the row's place, which
take repeated rows apart. The driver holds only counters: exact bytes below each candidate boundary, of 65,536
cells in the first round and of 4,096 parts of each cell that contains a shard's end (fewer cells than shards) in
the four that may follow, until the error is below the tolerance. Then each row's shard follows from
comparing its key with the final boundaries, and rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, text_bytes

CELL_BITS = 16
LEVEL_BITS, LEVELS = 12, 4
SUBS = 1024
#: A cell with more than this part of all rows is taken apart for numbering; at most so many cells can be.
HOT_CELLS = 256


def _key_columns() -> dict[str, Column]:
    raw = text_bytes("text")
    return {
        "size": (F.octet_length(raw) + 16).cast("long"),
        "text_crc32": F.crc32(raw),
        "cell": F.shiftrightunsigned(F.xxhash64(raw), 64 - CELL_BITS),
        "spread": F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))), 40), 40).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 24)
        ),
    }


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two parts of the sort key, without the text; to be written once, as a row's place is part of it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in _key_columns().items()))


def _prefix(level: int) -> Column:
    """The first ``level`` groups of ``LEVEL_BITS`` bits of ``spread``, as an unsigned number of at most 48 bits."""
    return F.shiftrightunsigned(F.col("spread"), 64 - LEVEL_BITS * level)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.0005) -> list[tuple[int, int, int]]:
    """Boundaries (cell, level, prefix): a row lies above one if its key is at or past it.

    Each round counts the exact bytes of the cells still open; a boundary is
    settled when its cell holds less than ``tolerance`` of a shard, or one key only.
    """
    first = keys.groupBy("cell").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    cells = sorted((r["cell"], r["b"], r["n"]) for r in first)
    total = sum(b for _, b, _ in cells)
    targets = {i: total * i / shards for i in range(1, shards)}
    limit = tolerance * total / shards
    done: dict[int, tuple[int, int, int]] = {}
    open_: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def settle(i: int, below: float, size: int, rows: int, cell: int, level: int, prefix: int) -> None:
        gap = targets[i] - below
        if size <= limit or rows == 1 or level == LEVELS:
            up = gap > size / 2
            done[i] = (cell, level, prefix + up) if level else (cell + up, 0, 0)
        else:
            open_.setdefault((cell, level, prefix), []).append((i, below))

    def walk(rows: list[tuple[int, int, int]], below: float, which: list[int], cell: int | None, level: int) -> None:
        at = 0
        for i in sorted(which):
            while at < len(rows) - 1 and below + rows[at][1] <= targets[i]:
                below += rows[at][1]
                at += 1
            key, size, n = rows[at]
            settle(i, below, size, n, key if cell is None else cell, level, 0 if cell is None else key)

    if total:
        walk(cells, 0, list(targets), None, 0)
    for level in range(1, LEVELS + 1):
        if not open_:
            break
        asked, open_ = open_, {}
        inside = F.col("cell").isin([c for c, _, _ in asked])
        if level > 1:
            inside = inside & F.concat_ws(":", "cell", _prefix(level - 1)).isin([f"{c}:{p}" for c, _, p in asked])
        parts = keys.where(inside).groupBy("cell", _prefix(level).alias("prefix")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        by: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        for r in parts.collect():
            by.setdefault((r["cell"], level - 1, r["prefix"] >> LEVEL_BITS if level > 1 else 0), []).append((r["prefix"], r["b"], r["n"]))
        for key, waiting in asked.items():
            walk(sorted(by[key]), waiting[0][1], [i for i, _ in waiting], key[0], level)
    return [done[i] for i in sorted(done)]


def _above(splitter: tuple[int, int, int]) -> Column:
    cell, level, prefix = splitter
    if not level:
        return F.col("cell") >= cell
    return (F.col("cell") > cell) | ((F.col("cell") == cell) & (_prefix(level) >= F.lit(prefix)))


def _shard(splitters: list[tuple[int, int, int]], low: int = 0) -> Column:
    """The number of boundaries at or below the row, by bisection."""
    if not splitters:
        return F.lit(low)
    mid = len(splitters) // 2
    return F.when(_above(splitters[mid]), _shard(splitters[mid + 1 :], low + mid + 1)).otherwise(_shard(splitters[:mid], low))


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.0005) -> DataFrame:
    """Give each row a shard of nearly equal bytes and a gapless slot in it.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null text has 16
    bytes; rows equal in id and text, and rows without an id, are told apart by their places, so that a
    boundary may fall among them and each has a slot of its own. An empty table gives an
    empty result. Equal texts are neighbours in the order, so that they
    share a shard unless a boundary has to fall among them.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    keys = scratch.keep(keyed(docs), "keys")
    placed = keys.withColumn("shard", _shard(find_splitters(keys, shards, tolerance)).cast("int"))
    cells = keys.groupBy("cell").agg(F.count("*").alias("n"))
    rows = keys.count()
    hot = [r["cell"] for r in cells.where(F.col("n") > max(1, rows // HOT_CELLS)).select("cell").collect()]  # < HOT_CELLS rows
    sub = F.when(F.col("cell").isin(hot), F.pmod(F.xxhash64("spread"), F.lit(SUBS))).otherwise(0) if hot else F.lit(0)
    placed = placed.withColumn("sub", sub.cast("int"))
    group = ["shard", "cell", "sub"]
    before = Window.partitionBy("shard").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = [F.shiftrightunsigned("spread", 1), "spread", "doc_id", "text_crc32"]
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.join(starts, group).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.0005) -> None:
    """Write whole rows as Parquet below ``path``/shard=N; the rows move once.

    The exchange is by shard and cell, not by shard alone, so that many tasks
    write a shard. A column of the input named ``shard`` is an error.
    """
    if "shard" in docs.columns:
        raise ValueError("the input has a column named shard")
    keys = Scratch(docs.sparkSession, "sharding").keep(keyed(docs), "keys")
    rows = F.struct(*docs.columns).alias("row")
    moved = docs.select(rows, *(c.alias(k) for k, c in _key_columns().items()))
    moved = moved.withColumn("shard", _shard(find_splitters(keys, shards, tolerance)).cast("int"))
    moved.repartition("shard", "cell").select("row.*", "shard").write.partitionBy("shard").parquet(path)
