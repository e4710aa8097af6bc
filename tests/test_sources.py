"""Scans, sinks, positions and streams that no query covers whole."""

import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from dialoom.operators import order
from dialoom.sources import readers, sinks
from dialoom.streaming import incremental

SCHEMA = "id long, text string"


def test_json_formats_are_told_apart(spark, tmp_path):
    cases = {
        "list.json": '[\n {"id": 1, "text": "a"},\n {"id": 2, "text": "b"}\n]',
        "one.json": '{\n "id": 1,\n "text": "a"\n}',
        "lines.json": '\n{"id": 1, "text": "a"}\n{"id": 2, "text": "b"}\n',
        "lines.jsonl": '{"id": 1, "text": "a"}\n{"id": 2, "text": "b"}',
    }
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
        got = [tuple(r) for r in readers.read_dialogues(spark, str(tmp_path / name), SCHEMA).orderBy("id").collect()]
        assert got == ([(1, "a")] if name == "one.json" else [(1, "a"), (2, "b")]), name
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": ')
    with pytest.raises(Py4JJavaError):
        readers.read_dialogues(spark, str(tmp_path / "bad.jsonl"), SCHEMA).collect()
    kept = readers.read_with_rejects(spark, str(tmp_path / "bad.jsonl"), SCHEMA).collect()
    assert [(r["id"], r["_corrupt_record"]) for r in kept] == [(1, None), (None, '{"id": ')]


def test_splits_and_selectors(spark, tmp_path):
    spark.range(30).write.parquet(str(tmp_path / "small" / "train.parquet"))
    own = readers.read_split(spark, str(tmp_path), "train", "small")
    assert own.count() == 30
    assert readers.choose_splits([]) == ["train", "test"]
    with pytest.raises(ValueError):
        readers.choose_splits(["train", "dev"])
    assert readers.parse_selector("a/b#12") == ("a/b", 12) and readers.parse_selector("a") == ("a", 0)
    assert [r["id"] for r in readers.read_selected(spark, str(tmp_path / "small"), "train#4", "id").collect()] == [0, 1, 2, 3]
    read = lambda p: spark.read.parquet(p)
    assert readers.local_else(spark, str(tmp_path / "none"), read, str(tmp_path / "small" / "train.parquet")).count() == 30
    with pytest.raises(FileNotFoundError):
        readers.local_else(spark, str(tmp_path / "none"), read)


def test_listed_files_decide_what_is_missing(spark, tmp_path):
    for name in ("a/1.jpg", "a/b/2.png"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    there = readers.list_files(spark, str(tmp_path)).select(F.substring_index("path", str(tmp_path) + "/", -1).alias("path"))
    needed = spark.createDataFrame([("a/1.jpg",), ("a/b/2.png",), ("a/3.jpg",)], "path string")
    assert sorted(r[0] for r in needed.join(there, "path", "left_semi").collect()) == ["a/1.jpg", "a/b/2.png"]
    assert [r[0] for r in needed.join(there, "path", "left_anti").collect()] == ["a/3.jpg"]


def test_json_lines_in_order_and_with_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(2, "é", None), (1, 'a"b', [1]), (3, None, [])], "n long, s string, x array<int>")
    sinks.write_jsonl(rows, str(tmp_path / "out"), "n", single_file=True)
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".json"]
    assert part.read_text().splitlines() == ['{"s":"a\\"b","x":[1]}', '{"s":"é","x":null}', '{"s":null,"x":[]}']
    stats = spark.createDataFrame([("train", (1, None)), ("test", (2, "e"))], "split string, stats struct<n: int, s: string>")
    pretty = sinks.stats_document(stats, pretty=True).first()["json"]
    assert json.loads(pretty) == {"test": {"n": 2, "s": "e"}, "train": {"n": 1, "s": None}} and pretty.count("\n") > 4


@pytest.mark.parametrize("keys", ["sparse", "text"])
def test_positions_over_many_spans(spark, monkeypatch, keys):
    monkeypatch.setattr(order, "SPAN_ROWS", 50)
    key = F.xxhash64("id") if keys == "sparse" else F.concat(F.lit("é/"), (F.col("id") * 7919 % 1000).cast("string"))
    rows = spark.range(1000).select(key.alias("k"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    assert len(order.span_bounds(rows, ["k"])) > 10
    got = order.with_position(rows, "k").collect()
    assert [r["idx"] for r in sorted(got, key=lambda r: r["k"])] == list(range(1000))
    within = order.with_position(rows, "k", "idx", ["g"]).where("g = 'hot'").collect()
    assert [r["idx"] for r in sorted(within, key=lambda r: r["k"])] == list(range(len(within)))


def test_until_found_has_one_row_a_key(spark):
    scan = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    assert sorted(r[0] for r in order.until_found(scan, scan.where("k < 3"), "k").collect()) == [1, 2]


def test_stream_of_dialogues(spark, tmp_path):
    turns = [("human", "q1"), ("gpt", "a1"), ("human", ""), ("gpt", "a2")]
    rows = spark.createDataFrame([(1, turns), (2, turns[1:3]), (3, None)], "conv_id long, turns array<struct<role: string, text: string>>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.prepare_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    incremental.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    (got,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert got["conv_id"] == 1 and [tuple(x) for x in got["conversation"]] == [("q1", "a1")]
