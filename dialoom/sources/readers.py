"""Scans: splits, JSON documents and lines, fallbacks, listings and dataset selectors."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators.order import head


#: Splits that may be chosen.
SPLITS = ("train", "test")


def read_split(spark: SparkSession, root: str, split: str, config: str | None = None, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A lazy scan of one named split, ``root``[/``config``]/``split``.``fmt``."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load("/".join(x for x in (root.rstrip("/"), config, f"{split}.{fmt}") if x))


def choose_splits(names: Iterable[str]) -> list[str]:
    """The names, all of which must be among ``SPLITS``; without any, all of those."""
    chosen = list(names) or list(SPLITS)
    if wrong := [n for n in chosen if n not in SPLITS]:
        raise ValueError(f"no such split: {', '.join(wrong)}; choose from {', '.join(SPLITS)}")
    return chosen


def first_split(splits: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first of the listed splits; the others are not read."""
    return splits[0][1]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def local_else(spark: SparkSession, path: str, read: Callable[[str], DataFrame], other: str | None = None) -> DataFrame:
    """``read`` of the path if it is there, else of ``other``; an error that names both if neither is."""
    for at in (path, other):
        if at and exists(spark, at):
            return read(at)
    raise FileNotFoundError(f"neither {path} nor {other} is there")


def json_format(spark: SparkSession, path: str) -> str:
    """jsonl by suffix, or if the first line that isn't blank is a whole object; else json."""
    if path.endswith(".jsonl"):
        return "jsonl"
    line = spark.read.text(path).where(F.trim("value") != "").first()
    try:
        return "jsonl" if line and isinstance(json.loads(line["value"]), dict) else "json"
    except ValueError:
        return "json"


def read_dialogues(spark: SparkSession, path: str, schema: str, fmt: str | None = None) -> DataFrame:
    """A JSON document (a list of rows or one row) or JSON lines, as ``fmt`` or ``json_format`` says; malformed rows fail."""
    fmt = fmt or json_format(spark, path)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", fmt == "json").json(path)


def read_with_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in which a malformed row is kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def first_available(candidates: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The first candidate whose metadata can be read."""
    errors = []
    for make in candidates:
        try:
            return make()
        except AnalysisException as error:
            errors.append(str(error).splitlines()[0])
    raise FileNotFoundError("; ".join(errors) or "no candidates")


def union_splits(splits: list[tuple[str, DataFrame]]) -> DataFrame:
    """All splits in order, with their name and place."""
    out = None
    for i, (name, df) in enumerate(splits):
        own = df.withColumns({"split": F.lit(name), "split_ord": F.lit(i)})
        out = own if out is None else out.unionByName(own)
    return out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a directory, without reading the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def parse_selector(selector: str) -> tuple[str, int]:
    """``id#N`` as the id and the row cap; 0 without one."""
    found = re.fullmatch(r"(.*?)(?:#(\d+))?", selector)
    return found[1], int(found[2] or 0)


def read_selected(spark: SparkSession, root: str, selector: str, key: str) -> DataFrame:
    """The rows of a dataset ``id#N`` below ``root``: the first N by ``key``, or all."""
    name, n = parse_selector(selector)
    return head(read_split(spark, root, name), key, n)
