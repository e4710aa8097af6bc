"""WARC records and their Merkle fixity audit.

Records lie in files in arrival order: each input partition fills files of a fixed number of
records, and a file is a hash tree whose leaves are its records in the order of their
offsets and whose inner nodes cover ordered offset ranges. Two replicas are compared
from the roots down: only children of nodes that differ are read at the next level, so
that an audit costs the roots and the paths to what is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

FANOUT = 8
LEVELS = 3
#: Records of a file; FANOUT ** LEVELS, so that a tree has LEVELS levels above its leaves.
RECORDS = FANOUT**LEVELS
_DATE = "2024-01-01T00:00:00Z"  # records made from a table carry no crawl date of their own


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A resource record: header lines, an empty line, the block and two line ends."""
    block = F.coalesce(html, F.lit("")).cast("binary")
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " ")  # a line end would end the header
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), block, F.lit("\r\n\r\n").cast("binary"))


def place_records(pages: DataFrame, scratch: Scratch, keep_bytes: bool = False) -> DataFrame:
    """(page_id, file, seq, offset, length, sha256[, record]) of each page, written once."""
    at = F.monotonically_increasing_id()  # partition number above bit 33, row number below
    own = pages.select(at.alias("at"), F.col("page_id").cast("long").alias("page_id"), record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    file = F.floor(F.col("at") / RECORDS)
    rows = own.select(
        "page_id", file.alias("file"), (F.col("at") % RECORDS).cast("int").alias("seq"), F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("sha256"), *(["record"] if keep_bytes else []),
    )
    rows = scratch.keep(rows, "records")
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree_level(nodes: DataFrame) -> DataFrame:
    """Parents of nodes (file, node, start, stop, hash): the hash of the children's ranges and hashes in order."""
    children = F.array_sort(F.collect_list(F.struct("node", "start", "stop", "hash")))  # at most FANOUT
    told = F.transform(children, lambda c: F.concat_ws(":", c["start"].cast("string"), c["stop"].cast("string"), c["hash"]))
    grouped = nodes.groupBy("file", F.floor(F.col("node") / FANOUT).alias("node"))
    return grouped.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(F.array_join(told, "\n").cast("binary"), 256).alias("hash"))


def merkle_tree(leaves: DataFrame, scratch: Scratch, levels: int = LEVELS) -> list[DataFrame]:
    """Node tables from the leaves (file, node, start, stop, hash) up to the roots."""
    tree = [leaves]
    for _ in range(levels):
        tree.append(scratch.keep(tree_level(tree[-1]), "nodes"))
    return tree


def leaves_of(records: DataFrame, digest: str = "sha256") -> DataFrame:
    return records.select("file", F.col("seq").cast("long").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), F.col(digest).alias("hash"))


def audit(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """(file, node) of the leaves in which two trees differ, missing ones included, found from the roots down."""
    suspects = None
    for level in range(len(one) - 1, -1, -1):
        a, b = (t[level].select("file", "node", F.struct("start", "stop", "hash").alias(x)) for t, x in ((one, "a"), (two, "b")))
        if suspects is not None:
            parent = F.floor(F.col("node") / FANOUT).alias("parent")
            a, b = (t.withColumn("parent", parent).join(suspects, ["file", "parent"], "left_semi").drop("parent") for t in (a, b))
        differ = a.join(b, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
        suspects = differ.select("file", F.col("node").alias("parent"))
    return suspects.select("file", F.col("parent").alias("node"))


def corrupted(record: Column, damaged: Column) -> Column:
    """A replica's record: its last byte before the record's end turned over where ``damaged``."""
    n = F.octet_length(record)
    broken = F.concat(F.substring(record, F.lit(1), n - 5), F.lit("\0").cast("binary"), F.substring(record, n - 3, F.lit(4)))
    return F.when(damaged & (n > 5), broken).otherwise(record)


def fixity_report(pages: DataFrame, damage: int = 97) -> DataFrame:
    """Audit the pages' WARC records against a replica in which some are damaged.

    Returns page_id, file, seq, offset, length, sha256, replica_sha256, file_root and corrupt, a
    row for each page. The replica turns over a byte of the records
    whose crc32(page_id as text) mod ``damage`` is 0; ``corrupt`` is what the
    descent from the roots finds. Needs page_id, url and html; null ids, urls and
    texts are empty; repeated rows are records of their own; other columns are ignored; an empty
    table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    own = place_records(pages, scratch, keep_bytes=True)
    damaged = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % damage == 0
    records = own.withColumn("replica_sha256", F.sha2(corrupted(F.col("record"), damaged), 256)).drop("record")
    records = scratch.keep(records, "placed")
    one, two = (merkle_tree(leaves_of(records, c), scratch) for c in ("sha256", "replica_sha256"))
    bad = scratch.keep(audit(one, two).select("file", F.col("node").cast("int").alias("seq"), F.lit(True).alias("bad")), "bad")
    roots = one[-1].select("file", F.col("hash").alias("file_root"))
    return records.join(bad, ["file", "seq"], "left").join(roots, "file").select(
        "page_id", "file", "seq", "offset", "length", "sha256", "replica_sha256", "file_root", F.coalesce("bad", F.lit(False)).alias("corrupt")
    )


def write_warc(pages: DataFrame, folder: str) -> None:
    """Write real .warc files, one per file number, into a folder that all executors mount."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = place_records(pages, scratch, keep_bytes=True)

    def write(part) -> None:
        import os

        for row in part:
            with open(os.path.join(folder, f"{row['file']:012d}.warc"), "r+b" if row["offset"] else "wb") as f:
                f.seek(row["offset"])
                f.write(row["record"])

    rows.repartition("file").sortWithinPartitions("file", "offset").foreachPartition(write)
