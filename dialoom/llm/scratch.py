"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost
executor then costs a re-read, never a recomputation of earlier stages.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in the largest bitmap of row keys that is broadcast: 2 MB.
BITMAP = 1 << 18
_LOCAL: dict[str, str] = {}
_ROOTS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="dialoom-")
    return _LOCAL[app]


class Scratch:
    """A private folder of one operator run; ``drop`` removes a table once nothing reads it.

    What a result still reads goes when the driver ends, or at the end of a ``cleaned`` block.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n, self._live = 0, {}
        _ROOTS.append(self.root)
        path, fs = _path(spark, self.root)
        fs.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._dialoom_path = path
        self._live[path] = True
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if self._live.pop(df._dialoom_path, None):
                path, fs = _path(self.spark, df._dialoom_path)
                fs.delete(path, True)

    def only(self, *tables: DataFrame) -> None:
        """Remove all tables of this run but those."""
        stay = {df._dialoom_path for df in tables}
        for at in [p for p in self._live if p not in stay]:
            del self._live[at]
            path, fs = _path(self.spark, at)
            fs.delete(path, True)


def _path(spark: SparkSession, at: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The folders of operator runs that begin inside are removed at the end: what they returned must be written by then."""
    before = len(_ROOTS)
    yield
    for root in _ROOTS[before:]:
        path, fs = _path(spark, root)
        fs.delete(path, True)
    del _ROOTS[before:]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that a worker never holds the Python objects of a whole batch.

    Workers stay alive beside the stages that follow; at the end they give back what they have freed.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def text_bytes(text: Column | str) -> Column:
    """The text as UTF-8; a null text is empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit("")).cast("binary")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row.

    An array that a lambda refers to would be computed again for each element, as the
    optimizer merges projections; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(text: Column | str) -> Column:
    """128 bits that stand for a text, as two longs."""
    raw = text_bytes(text)
    return F.struct(F.xxhash64(raw).alias("a"), F.xxhash64(F.lit(1), raw).alias("b"))


def _bits(keys: DataFrame) -> DataFrame:
    """(__word, __mask): a bitmap of the structs ``key``, of ``BITMAP`` words at most whatever their number."""
    bit = F.pmod("key.a", F.lit(64 * BITMAP))
    return keys.select(bit.alias("__bit")).groupBy(F.floor(F.col("__bit") / 64).alias("__word")).agg(F.bit_or(_mask()).alias("__mask"))


def _mask() -> Column:
    return F.expr("shiftleft(1L, cast(__bit % 64 as int))")


def with_bit(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows with a boolean ``name``: false if their ``key`` is surely not among ``keys``. Nothing is shuffled."""
    bit = F.pmod("key.a", F.lit(64 * BITMAP))
    placed = rows.withColumn("__bit", bit).withColumn("__word", F.floor(F.col("__bit") / 64))
    found = placed.join(F.broadcast(_bits(keys)), "__word", "left")
    return found.withColumn(name, F.coalesce(F.col("__mask").bitwiseAND(_mask()) != 0, F.lit(False))).drop("__bit", "__word", "__mask")


def without_rows(docs: DataFrame, key: Column, verdicts: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` whose ``key`` (a struct of longs a and b) isn't marked in ``verdicts`` (key, bad, single).

    ``verdicts`` has a row for each key. Of the rows of a key marked ``single``, one stays. Bitmaps decide in
    place on all rows but the few whose bits both a removed and a kept key share; only those are joined, so
    that neither the kept nor the removed texts move. Columns of any name are passed through.
    """
    some = scratch.keep(verdicts.where("bad or single"), "marked")
    shared = with_bit(verdicts.where("not bad"), some.select("key"), "maybe").where("maybe").select("key")
    shared = scratch.keep(shared, "shared")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    rows = with_bit(with_bit(rows, some.select("key"), "maybe"), shared, "unsure")
    sure = rows.where("not maybe").select("row")
    left = rows.where("maybe and unsure").select("row", "key").join(some.where("bad").select("key"), "key", "left_anti")
    lone = some.where("single and not bad").select(F.col("key"), F.lit(True).alias("lone"))
    left = left.join(lone, "key", "left")
    once = left.where("lone").groupBy("key").agg(F.first("row").alias("row")).select("row")
    out = sure.union(left.where("lone is null").select("row")).union(once)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
