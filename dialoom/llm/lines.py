"""Repeated runs of lines, in DataFrame operations only.

Documents are sequences of line ids (128-bit digests; blank lines are left out). A line that occurs once
ends every repeated run, so that the suffixes of the other lines are all that is sorted. Prefix doubling
ranks them by their first 2^k lines: a rank stands for the pair of ranks of its halves, numbered in the order of the
pairs, and is an interval of the suffix array whose longest common prefix is 2^k lines at least.
Suffixes of equal first ``d`` lines are an interval too: with 2^k <= d < 2^(k+1) it is named by ``d``, the rank of
the first 2^k lines and that of the last 2^k. The first member of an interval, by document id and place,
is the original and all others are later copies.

A run counts by its characters, whatever its number of lines. So the intervals that are
looked up are those of the shortest block with enough characters that starts, and of the one that ends, at each repeated line.
Equal runs have equal such blocks at the same places, and in a run with
enough characters they cover every line: the block that starts at its first line lies
in the run, and so does the block that ends at any line behind that one. What they cover are the later copies of all
maximal repeated runs. As no line is blank, a block has at most ``min_chars`` lines, which
bounds the rounds of doubling by the logarithm of that.

Joins on a rank never bring a common one to one task: ranks that hold more than a
thousandth of the rows are at most a thousand, and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, let, text_key, with_bit

#: A run of lines counts as a repeat from so many characters on.
MIN_CHARS = 40
#: Names that more than this part of all rows have are broadcast; there can be no more of them than that.
COMMON = 1000
_KEY = ["doc", "digest"]


def _keyed(docs: DataFrame) -> dict:
    return {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "digest": F.xxhash64(F.coalesce("text", F.lit("")))}


def _line_ids(docs: DataFrame) -> DataFrame:
    """(doc, digest, seq, line, id, chars): place, id and length of each line that isn't blank; ``seq`` counts those alone."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("line"), text_key(x).alias("id"), F.length(F.btrim(x)).cast("long").alias("chars")))
    own = docs.select(*(c.alias(k) for k, c in _keyed(docs).items()), F.filter(lines, lambda s: s["chars"] > 0).alias("lines"))
    return own.select(*_KEY, F.posexplode("lines").alias("seq", "x")).select(*_KEY, "seq", "x.*")


def _intervals(blocks: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """The blocks (doc, digest, seq, ...) whose ``key`` occurs more than once, with its rank and whether each is a later copy."""
    place = F.struct("doc", "digest", "seq")
    groups = blocks.groupBy(*key).agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies >= 2")
    ranked = groups.orderBy(*key).withColumn("rank", F.monotonically_increasing_id())
    ranked = scratch.keep(ranked, "ranked")
    most = (ranked.agg(F.sum("copies")).first()[0] or 0) // COMMON
    common = ranked.where(F.col("copies") > most)  # fewer than COMMON rows
    marked = blocks.join(F.broadcast(common), key, "left")
    rest = marked.where("rank is null").select(*blocks.columns).join(ranked.where(F.col("copies") <= most), key)
    found = marked.where("rank is not null").unionByName(rest)
    out = scratch.keep(found.select(*blocks.columns, "rank", (place > F.col("first")).alias("later")), "intervals")
    scratch.drop(ranked)
    return out


def _shortest_blocks(lines: DataFrame, min_chars: int) -> DataFrame:
    """(doc, digest, seq, size): the shortest blocks of ``min_chars`` characters or more that start or end at each line.

    Blocks with a line that isn't in ``lines`` are left out.
    """
    own = Window.partitionBy(*_KEY).orderBy("seq")
    line, most, out = F.struct("seq", "chars"), max(min_chars - 1, 0), []
    for sign, frame in ((1, own.rowsBetween(0, most)), (-1, own.rowsBetween(-most, 0))):
        near = F.collect_list(line).over(frame)

        def add(so_far: Column, x: Column) -> Column:
            ends = (so_far["chars"] >= min_chars) | (x["seq"] != so_far["next"])
            more = F.struct((so_far["chars"] + x["chars"]).alias("chars"), (so_far["next"] + sign).alias("next"))  # noqa: B023  used at once
            return F.when(ends, so_far).otherwise(more)

        placed = lines.select(*_KEY, "seq", (near if sign > 0 else F.reverse(near)).alias("near"))
        start = F.struct(F.lit(0).cast("long").alias("chars"), F.col("seq").alias("next"))
        placed = placed.withColumn("sum", F.aggregate("near", start, add)).where(F.col("sum.chars") >= min_chars)
        n = F.abs(F.col("sum.next") - F.col("seq"))
        first = F.col("seq") if sign > 0 else F.col("seq") - n + 1
        out.append(placed.select(*_KEY, first.alias("seq"), n.alias("size")))
    return out[0].union(out[1]).distinct()


def suffix_ranks(first: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(level, doc, digest, seq, rank): ranks of the repeated blocks of 2^level lines, by prefix doubling up to ``most`` lines.

    ``first`` has (doc, digest, seq, rank) of the repeated lines.
    """
    out = [first.select(F.lit(0).alias("level"), *_KEY, "seq", "rank")]
    level, step = first, 1
    while 2 * step <= most and not level.isEmpty():
        ahead = level.select(*_KEY, (F.col("seq") - step).alias("seq"), F.col("rank").alias("tail"))
        blocks = scratch.keep(level.select(*_KEY, "seq", F.col("rank").alias("head")).join(ahead, [*_KEY, "seq"]), "blocks")
        level = _intervals(blocks, ["head", "tail"], scratch)
        scratch.drop(blocks)
        step *= 2
        out.append(level.select(F.lit(len(out)).alias("level"), *_KEY, "seq", "rank"))
    ranks = out[0]
    for r in out[1:]:
        ranks = ranks.union(r)
    return ranks


def removed_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, digest, removed): the places of the lines that belong to later copies of repeated runs."""
    flat = scratch.keep(_line_ids(docs).dropDuplicates([*_KEY, "seq"]), "line-ids")
    first = _intervals(flat, ["id"], scratch)
    scratch.drop(flat)
    blocks = scratch.keep(_shortest_blocks(first, min_chars), "shortest")
    longest = blocks.agg(F.max("size")).first()[0] or 0
    ranks = suffix_ranks(first, scratch, longest)
    level = F.floor(F.log2("size") + 1e-9).cast("int")
    asked = blocks.withColumn("level", level).withColumn("last", F.col("seq") + F.col("size") - F.expr("shiftleft(1, level)"))
    tails = ranks.select("level", *_KEY, F.col("seq").alias("last"), F.col("rank").alias("tail"))
    named = asked.join(ranks.withColumnRenamed("rank", "head"), ["level", *_KEY, "seq"]).join(tails, ["level", *_KEY, "last"])
    named = scratch.keep(named.select(*_KEY, "seq", "size", "head", "tail"), "named")
    later = _intervals(named, ["size", "head", "tail"], scratch).where("later")
    farthest = later.groupBy(*_KEY, "seq").agg(F.max(F.col("seq") + F.col("size")).alias("reach"))
    so_far = F.max("reach").over(Window.partitionBy(*_KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    covered = first.select(*_KEY, "seq", "line").join(farthest, [*_KEY, "seq"], "left").withColumn("end", so_far).where(F.col("end") > F.col("seq"))
    removed = scratch.keep(covered.groupBy(*_KEY).agg(F.array_sort(F.collect_list("line")).alias("removed")), "removed")
    scratch.only(removed)
    return removed


def _kept_text() -> Column:
    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return let(F.split(F.coalesce("row.text", F.lit("")), "\n", -1), rest)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows and columns of ``docs``, the texts without later copies of repeated line runs.

    A line goes if it lies in a run of lines, with ``min_chars``
    characters or more, that occurs in the same order earlier: in a document of
    smaller id, or before in the same document. Lines compare by
    128-bit digests; blank lines are passed over and stay. Null texts stay null, empty
    ones empty; rows without an id come last; rows equal in id and text are one
    document, so that each keeps what the others keep. Further columns,
    whatever their names, are passed through; a table without rows stays so.
    Texts from which nothing is removed aren't moved but for the few that a bitmap can't tell.
    """
    removed = removed_lines(docs, Scratch(docs.sparkSession, "lines"), min_chars)
    touched = removed.select(F.struct(F.xxhash64(*_KEY).alias("a")).alias("key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *(c.alias(k) for k, c in _keyed(docs).items()))
    rows = with_bit(rows.withColumn("key", F.struct(F.xxhash64(*_KEY).alias("a"))), touched, "maybe").drop("key")
    joined = rows.where("maybe").select("row", *_KEY).join(removed, _KEY, "left").select("row", "removed")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(_kept_text())
    cut = joined.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
    return rows.where("not maybe").select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).union(cut)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, the removed places and size and checksum of what stays, a row for each row of ``docs``.

    Null texts are empty ones, of one blank line; all else is as ``dedup_lines`` says.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    removed = removed_lines(docs, scratch, min_chars)
    touched = removed.select(F.struct(F.xxhash64(*_KEY).alias("a")).alias("key"))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).alias("row"), *(c.alias(k) for k, c in _keyed(docs).items()))
    rows = with_bit(rows.withColumn("key", F.struct(F.xxhash64(*_KEY).alias("a"))), touched, "maybe").drop("key")
    joined = rows.where("maybe").select("row", *_KEY).join(removed, _KEY, "left").select("row", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    kept = F.when(F.size("removed") == 0, F.col("row.text")).otherwise(_kept_text())
    cut = joined.select("row", "removed", kept.alias("kept_text"))
    whole = rows.where("not maybe").select("row", F.array().cast("array<int>").alias("removed"), F.col("row.text").alias("kept_text"))
    raw = F.col("kept_text").cast("binary")
    return whole.union(cut).select(
        F.col("row.doc_id").alias("doc_id"), F.size(F.split("row.text", "\n", -1)).alias("n_lines"), F.size("removed").alias("n_removed"),
        "removed", F.octet_length(raw).cast("long").alias("kept_bytes"), F.crc32(raw).alias("kept_crc32"),
    )
