"""A scan in stages: ordered Parquet splits are read in growing groups of files until every needed key is found."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path

#: Files of the first group; each later group has ``GROWTH`` times as many.
FIRST_FILES, GROWTH = 8, 2
#: Needed keys are sent along with the scan up to this many bytes; more are joined.
SENT_BYTES = 16 << 20

_AT = "split_ord int, file string, row_index long"


@dataclass
class Stop:
    """Where the scan ends: the row that held the last missing key, or null if some key was never found."""

    at: tuple[int, str, int] | None
    files_read: int
    files: int
    missing: int


def _rows(spark: SparkSession, path: str, split_ord: int, schema: str | None) -> DataFrame:
    """The split's rows with their place; files are read in the code-point order of their paths."""
    reader = spark.read.schema(schema) if schema else spark.read
    place = F.struct(F.lit(split_ord).alias("split_ord"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    return reader.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), place.alias("__at"))


def _keys_of(needed: DataFrame, key: str) -> DataFrame:
    return needed.select(key).where(F.col(key).isNotNull()).distinct()


def _size(keys: DataFrame, key: str) -> tuple[int, int]:
    """(count, bytes) of the keys, 16 bytes for each besides its text."""
    got = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string")) + 16), F.lit(0)).alias("size")).first()
    return got["n"], got["size"]


def _first_places(rows: DataFrame, keys: DataFrame, key: str, size: int) -> DataFrame:
    """(key, at): the first row of each of ``keys``. Small sets go to the scan, others meet one row for each key of the scan."""
    own = rows.select(key, "__at")
    if size <= SENT_BYTES:
        own = own.join(F.broadcast(keys), key, "left_semi")
    firsts = own.groupBy(key).agg(F.min("__at").alias("at"))
    return firsts if size <= SENT_BYTES else firsts.join(keys, key, "left_semi")


def find_stop(spark: SparkSession, splits: list[str], needed: DataFrame, key: str, schema: str | None = None, first_files: int = FIRST_FILES) -> Stop:
    """Where a scan of the Parquet ``splits`` in order has seen each key of ``needed``; null keys are none.

    The search reads the key column alone, of ``first_files`` files, then of twice as many and so on; each group is compared
    with the keys that are still missing, and what it finds is written to the shared folder. A later split is
    opened only if keys are missing after those before it. Without needed keys nothing is read.
    """
    path = shared_path(spark, "staged")
    keys = _keys_of(needed, key)
    keys.write.parquet(f"{path}/needed")
    left = keys = spark.read.parquet(f"{path}/needed")
    (n, size), group, stage, read, files, last = _size(left, key), first_files, 0, 0, 0, None
    for i, split in enumerate(splits):
        if not n:
            break
        rows = _rows(spark, split, i, schema)
        names, done = sorted(re.sub("^([^:/]+):///", r"\1:/", f) for f in rows.inputFiles()), 0  # as _metadata.file_path has them
        files += len(names)
        while n and done < len(names):
            upto = min(done + group, len(names))
            part = rows.where(F.col("__file").between(names[done], names[upto - 1]))  # other files are left out when the scan is planned
            _first_places(part, left, key, size).write.parquet(f"{path}/found/stage={stage}")
            seen = spark.read.schema(f"`{key}` {keys.schema[key].dataType.simpleString()}, at struct<{_AT.replace(' ', ':').replace(',:', ',')}>").parquet(f"{path}/found")
            last = seen.agg(F.max("at")).first()[0] or last
            left = keys.join(seen, key, "left_anti")
            (n, size), done, read, stage, group = _size(left, key), upto, read + upto - done, stage + 1, group * GROWTH
    return Stop(tuple(last) if last and not n else None, read, files, n)


def _until(stop: Stop) -> Column:
    if stop.at is None:
        return F.lit(True)
    return F.col("__at") <= F.struct(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(stop.at, _AT.split(", "), strict=True)])


def read_until_found(spark: SparkSession, splits: list[str], needed: DataFrame, key: str, keep: str = "last", schema: str | None = None, first_files: int = FIRST_FILES) -> DataFrame:
    """A row for each key of ``needed`` that the ``splits`` hold: the ``last`` (or ``first``) one up to the row at which none was missing any more.

    Columns are those of the splits and ``split_ord``, the split's place. If a key is never found, all splits are read to their
    ends. Files beyond the stop aren't opened, neither by the search nor by the rows' own scan. Null keys match
    nothing; needed keys may repeat; without any, and for splits without rows, the result is empty.
    """
    stop = find_stop(spark, splits, needed, key, schema, first_files)
    wanted = _keys_of(needed, key)
    n, size = _size(wanted, key)
    wanted = F.broadcast(wanted) if size <= SENT_BYTES else wanted
    out = None
    for i, split in enumerate(splits):
        if out is not None and stop.at is not None and i > stop.at[0]:
            break
        rows = _rows(spark, split, i, schema)
        columns = [c for c in rows.columns if c not in ("__at", "__file")]
        if not n:
            rows = rows.where(F.lit(False))
        elif stop.at is not None and i == stop.at[0]:
            rows = rows.where((F.col("__file") <= stop.at[1]) & _until(stop))
        own = rows.select(key, "__at", F.struct(*columns).alias("row")).join(wanted, key, "left_semi")
        out = own if out is None else out.unionByName(own)
    pick = F.max_by if keep == "last" else F.min_by
    return out.groupBy(key).agg(pick(F.struct("row", F.col("__at.split_ord").alias("split_ord")), "__at").alias("r")).select("r.row.*", "r.split_ord")
