"""Payload kinds, base64 and JSON access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def payload_kind(x: Column) -> Column:
    """How an image given as text is encoded."""
    return (
        F.when(x.isNull(), "missing").when(x == "", "empty")
        .when(x.startswith("{"), F.when(json_has(x, "bytes"), "dict_bytes").when(json_has(x, "path"), "dict_path").otherwise("unknown")).when(x.startswith("data:image"), "data_uri")
        .when(x.startswith("http://") | x.startswith("https://"), "url")
        .when(F.contains(x, F.lit("/")) | F.rlike(x, F.lit(r"\.[A-Za-z0-9]{1,5}$")), "path").otherwise("base64")
    )


def payload_bytes(x: Column) -> Column:
    """The bytes that an image given as text carries itself: data URIs, base64 and objects with base64 in ``bytes``; null for paths and URLs."""
    kind = payload_kind(x)
    return F.when(kind.isin("data_uri", "base64"), decode_base64(x)).when(kind == "dict_bytes", decode_base64(json_get(x, "bytes")))


def payload_path(x: Column) -> Column:
    """The path of an image given as one, or as an object with ``path``; a URL is none."""
    kind = payload_kind(x)
    return F.when(kind == "path", x).when(kind == "dict_path", json_get(x, "path"))


def first_present(row: Column, names: list[str]) -> Column:
    """The value, as text, of the first of the keys that a JSON object holds; a null that is there is the text None."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(json_has(row, name), F.coalesce(json_get(row, name), F.lit("None"))).otherwise(out)
    return out


def keyed_else(row: Column, first: str, second: str) -> Column:
    """The value of ``first`` if a JSON object holds that key, be it null, else that of ``second``."""
    return F.when(json_has(row, first), json_get(row, first)).otherwise(json_get(row, second))


def question_text(value: Column) -> Column:
    """A question given as JSON: an object's ``value``, a text, or anything else in its own words; null is the text None."""
    inner = F.when(value.startswith("{"), F.when(json_has(value, "value"), F.coalesce(json_get(value, "value"), F.lit("None"))).otherwise(""))
    plain = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
    return strip(F.when(value.isNull() | (value == "null"), "None").otherwise(F.coalesce(inner, plain, value)))


def decode_base64(x: Column) -> Column:
    """Bytes of base64 text, with or without a data-URI head; null if it isn't base64."""
    body = F.when(x.startswith("data:"), F.split_part(x, F.lit(","), F.lit(2))).otherwise(x)
    return F.try_to_binary(body, F.lit("base64"))


def json_get(x: Column, key: str) -> Column:
    return F.get_json_object(x, f"$.{key}")


def json_has(x: Column, key: str) -> Column:
    """Whether a JSON object holds the key, a null value included."""
    return F.coalesce(F.array_contains(F.json_object_keys(x), key), F.lit(False))
