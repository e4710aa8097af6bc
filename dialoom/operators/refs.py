"""Image references: predicates, classes, ids, candidates and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.text import first_segment, last_segment, second_segment, strip_extension, truthy, zero_pad

# Extensions in the order in which they are tried.
EXTENSIONS = (".jpg", ".png", ".jpeg", "")


def has_image(image: Column) -> Column:
    return truthy(image)


def has_image_strict(image: Column) -> Column:
    """Not null; an empty text passes and fails at its lookup."""
    return image.isNotNull()


def in_sources(path: Column, sources: list[str] | None) -> Column:
    return first_segment(path).isin(*sources) if sources else F.lit(True)


def source_class(path: Column, prefixes: dict[str, str], other: str = "unknown") -> Column:
    """The class of the first prefix that the path starts with."""
    out = F.lit(other)
    for prefix, name in reversed(prefixes.items()):
        out = F.when(path.startswith(prefix), name).otherwise(out)
    return out


def image_id(path: Column) -> Column:
    """Last segment without its last extension."""
    return strip_extension(last_segment(path))


def whole_id(path: Column) -> Column:
    """The id of a source whose ids are whole numbers; null where it isn't one."""
    text = image_id(path)
    return F.when(F.rlike(text, F.lit(r"^[+-]?[0-9]+$")), text.try_cast("bigint"))


def path_from_id(number: Column, split: Column) -> Column:
    return F.concat(F.lit("coco/"), split, F.lit("2017/"), zero_pad(number, 12), F.lit(".jpg"))


def extension_for(path: Column) -> Column:
    """Format of a target by its suffix: JPEG for .jpg and .jpeg, else PNG."""
    return F.when(path.endswith(".jpg") | path.endswith(".jpeg"), ".jpg").otherwise(".png")


def extension_for_mode(mode: Column) -> Column:
    """Format of a target by the image's colour mode: JPEG for RGB, else PNG."""
    return F.when(mode == "RGB", ".jpg").otherwise(".png")


def keyed_paths(paths: DataFrame) -> DataFrame:
    """Paths of three segments or more, with source and subfolder as join keys."""
    deep = F.size(F.split("path", "/")) >= 3
    return paths.where(deep).select("path", first_segment(F.col("path")).alias("source"), second_segment(F.col("path")).alias("subfolder"))


def prefix_join(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """Paths below ``source/subfolder/`` of a catalogue entry, as an equi-join on the two segments."""
    return keyed_paths(paths).join(catalog, ["source", "subfolder"])


def unknown_sources(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    own = paths.select(first_segment(F.col("path")).alias("source")).distinct()
    return own.join(catalog.select("source").distinct(), "source", "left_anti")
