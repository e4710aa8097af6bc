"""Sinks: JSON lines, statistics and mapping documents, idempotent targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of lines in a numbered file, about. Digests are taken of whole files.
FILE_BYTES = 128 << 20
_MANIFEST = "file string, file_no int, rows long, first_line long, bytes long, sha256 string"


def json_line(*columns: str) -> Column:
    """One JSON object with nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, ordinal: str | None = None, single_file: bool = False) -> None:
    """An object per line. Sorted within each file if ``ordinal`` is given; one file only on request."""
    own = df.coalesce(1) if single_file else df
    own = own.sortWithinPartitions(ordinal).drop(ordinal) if ordinal else own
    own.write.option("ignoreNullFields", "false").json(path)


def _done(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_no, bytes, sha256) of the files that are there."""
    name = F.col("_metadata.file_name")
    own = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract(name, r"^part-(\d+)", 1).cast("int")
    return own.select(name.alias("file"), number.alias("file_no"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_no, rows, first_line, bytes, sha256): a row for each file that ``write_ordered`` put below ``path``."""
    return spark.read.schema(_MANIFEST).json(f"{path}.manifest")


def write_ordered(df: DataFrame, path: str, ordinal: str, file_bytes: int = FILE_BYTES, size: int | None = None) -> DataFrame:
    """An object per line, in the order of ``ordinal`` over all files in order of their names; the manifest of them.

    Rows are exchanged by ranges of the ordinal, a numbered file for each, of about ``file_bytes``; ``size``, the bytes of all lines, is
    taken from the rows if it isn't given, so that ``df`` should be a table. Null ordinals come first; rows of equal ordinals lie in
    one file, in the order of their lines. The manifest beside the folder is written last: with it a second run
    writes nothing, without it (an earlier run ended before) the files are written anew. Names order up to 100,000 files, ``file_no`` any number.
    """
    spark = df.sparkSession
    if _done(spark, f"{path}.manifest"):
        return read_manifest(spark, path)
    rest = [c for c in df.columns if c != ordinal]
    if size is None:
        size = df.agg(F.sum(F.octet_length(json_line(*rest)) + 1)).first()[0] or 0
    parted = df.repartitionByRange(max(1, -(-size // file_bytes)), ordinal).sortWithinPartitions(ordinal, json_line(*rest))
    parted.select(*rest).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    counts = spark.read.option("pathGlobFilter", "part-*").text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    files = _digests(spark, path).join(counts, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    told = files.withColumn("first_line", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    told.select(*[c.split()[0] for c in _MANIFEST.split(", ")]).coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return read_manifest(spark, path)


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem): files that are missing, changed or not in the manifest."""
    told, there = read_manifest(spark, path).select("file", "sha256"), _digests(spark, path).select("file", F.col("sha256").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("sha256") != F.col("now"), "changed")
    return told.join(there, "file", "full").select("file", problem.alias("problem")).where("problem is not null")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of what ``write_ordered`` put down, numbered from 0 over all files; a file is taken as a whole."""
    own = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("_metadata.file_name").alias("file"), F.col("content").cast("string").alias("text"))
    placed = own.join(read_manifest(spark, path).where("rows > 0").select("file", "first_line"), "file")
    lines = placed.select("first_line", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("nth", "line"))
    return lines.select((F.col("first_line") + F.col("nth")).alias("line_no"), "line")


def mapping_document(entries: DataFrame, key: str) -> DataFrame:
    """(key, json) rows of a mapping; explicit nulls are kept."""
    rest = [c for c in entries.columns if c != key]
    return entries.select(key, json_line(*rest).alias("json"))


def stats_document(stats: DataFrame, pretty: bool = False) -> DataFrame:
    """One row ``json``: the structs of (split, stats) as a document keyed by split, in order of the names."""
    entries = F.array_sort(F.collect_list(F.struct("split", "stats")))  # a row for each split
    return stats.agg(F.to_json(F.map_from_entries(entries), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def skip_existing(targets: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    return targets.join(existing.select(key).distinct(), key, "left_anti")


def fan_out(rows: DataFrame, *paths: Column) -> DataFrame:
    """A row per target path."""
    return rows.withColumn("target", F.explode(F.array(*paths)))
