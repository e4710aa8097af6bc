"""Joins that resolve image references against indexed sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import with_position
from .refs import EXTENSIONS, image_id, prefix_join, whole_id


def last_index_per_id(rows: DataFrame) -> DataFrame:
    """(dataset, split, id, index): the last row of each id that isn't null."""
    own = rows.where("raw_id is not null").select("dataset", "split", F.col("raw_id").cast("string").alias("id"), "row_idx")
    return own.groupBy("dataset", "split", "id").agg(F.max("row_idx").alias("index"))


def typed_path_ids(paths: DataFrame, catalog: DataFrame, number_sources: list[str]) -> DataFrame:
    """Paths of entries with an id field, with their id and its type: text, or a whole number for ``number_sources`` where it is one."""
    own = prefix_join(paths, catalog.where("id_field is not null"))
    number = F.when(F.col("source").isin(*number_sources), whole_id(F.col("path")).cast("string"))
    return own.select("*", F.when(number.isNull(), "text").otherwise("int").alias("kind"), F.coalesce(number, image_id(F.col("path"))).alias("id"))


def typed_row_ids(rows: DataFrame, number_datasets: list[str]) -> DataFrame:
    """Rows whose id isn't null, with ``id`` and ``kind``; texts of ``number_datasets`` are read as whole numbers, or left out if they aren't."""
    text = F.col("raw_id").cast("string")
    to_number = F.col("dataset").isin(*number_datasets) & (F.col("id_kind") == "text")
    number = F.when(F.rlike(text, F.lit("^[+-]?[0-9]+$")), text.try_cast("bigint").cast("string"))
    own = rows.where("raw_id is not null").select("*", F.when(to_number, number).otherwise(text).alias("id"), F.when(to_number, "int").otherwise(F.col("id_kind")).alias("kind"))
    return own.where("id is not null")


def first_match(paths: DataFrame, rows: DataFrame, split_order: Column) -> DataFrame:
    """Each needed path with the first row, over a dataset's splits in order, that has an image and the path's id.

    ``paths`` and ``rows`` are those of ``typed_path_ids`` and ``typed_row_ids``: ids of different types never match. All
    paths of an id get the same row, as the id is used up by its first match.
    """
    key = ["dataset", "kind", "id"]
    needed = paths.select(*key).distinct()
    hits = rows.where("has_image").join(needed, key, "left_semi")
    first = hits.groupBy(*key).agg(F.min(F.struct(split_order.alias("o"), "row_idx", "split")).alias("f"))
    return paths.drop("split").join(first.select(*key, F.col("f.split").alias("split"), F.col("f.row_idx").alias("index")), key)


def id_index_join(paths: DataFrame, catalog: DataFrame, rows: DataFrame, key: Column | None = None) -> DataFrame:
    """Paths of entries with an id field, found by id; the last duplicate wins."""
    own = prefix_join(paths, catalog.where("id_field is not null")).withColumn("id", image_id(F.col("path")) if key is None else key)
    return own.join(last_index_per_id(rows), ["dataset", "split", "id"])


def positional_join(paths: DataFrame, catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Paths of entries without an id field: the k-th path in code-point order is row k."""
    own = prefix_join(paths, catalog.where("id_field is null"))
    own = with_position(own, "path", "index", ["source", "subfolder"])
    sizes = rows.groupBy("dataset", "split").agg(F.count("*").alias("n"))
    return own.join(sizes, ["dataset", "split"]).where(F.col("index") < F.col("n")).drop("n")


def rank_paths(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    own = prefix_join(paths, catalog)
    return with_position(own, "path", "rank", ["source", "subfolder"]).select("source", "subfolder", "path", "rank")


def with_extensions(ids: DataFrame) -> DataFrame:
    """Candidate file names of each id, in the order in which they are tried."""
    tried = F.array(*[F.struct(F.lit(i).alias("priority"), F.concat(F.col("id"), F.lit(e)).alias("filename")) for i, e in enumerate(EXTENSIONS)])
    return ids.select("*", F.explode(tried).alias("x")).select(*ids.columns, "x.priority", "x.filename")


def first_extension(ids: DataFrame, files: DataFrame) -> DataFrame:
    """(id, filename): the first candidate that is asked for."""
    hits = with_extensions(ids.select("id").distinct()).join(files.select("filename").distinct(), "filename")
    return hits.groupBy("id").agg(F.min_by("filename", "priority").alias("filename"))


def lookup_with_fallback(refs: DataFrame, found: DataFrame, prefix: str) -> DataFrame:
    """refs (ref_id, path) with the found path: itself, else the one below ``prefix``; null on a miss.

    Each path of a repeated ``ref_id`` is looked up by itself, and repeated rows stay as many. Further columns stay.
    """
    known = found.select(F.col("path").alias("p")).distinct()
    apart = F.coalesce("path", F.concat(F.lit("\0"), F.to_json(F.struct("ref_id"))))  # rows without a path match nothing, and are spread
    own = refs.withColumn("__key", apart).join(known.withColumnRenamed("p", "__own"), F.col("path").isNotNull() & (F.col("__key") == F.col("__own")), "left")
    own = own.withColumn("__key", F.concat(F.lit(prefix), "__key"))
    below = own.join(known.withColumnRenamed("p", "__below"), F.col("path").isNotNull() & F.col("__own").isNull() & (F.col("__key") == F.col("__below")), "left")
    return below.withColumn("resolved", F.coalesce("__own", "__below")).drop("__key", "__own", "__below")


def keyed_merge(tables: list[DataFrame], key: str) -> DataFrame:
    """Union by key in which a later table overrides an earlier one."""
    out = None
    for i, t in enumerate(tables):
        own = t.select(F.lit(i).alias("o"), F.struct(*t.columns).alias("row"), F.col(key))
        out = own if out is None else out.union(own)
    return out.groupBy(key).agg(F.max_by("row", "o").alias("row")).select("row.*")
