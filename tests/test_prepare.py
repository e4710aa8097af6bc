"""The whole preparation, written and read again."""

import json

from dialoom.operators import resolve
from dialoom.plans.prepare import prepare


def test_written_rows_and_statistics(spark, tmp_path):
    turns = [
        (c, t, role, kind, value)
        for c in (1, 2, 3, 4)
        for t, role, kind, value in [(1, "student", "response", f"Answer: a{c}"), (2, "teacher", "feedback", "Score: 5.\nFeedback: more"), (3, "student", "response", "b")]
    ]
    questions = [(c, f"q{c}") for c in (1, 2, 3, 4, 5)]
    images = [(1, "train", "x/1.jpg"), (2, "train", "images/2.jpg"), (3, "test", "other/3.jpg"), (4, "train", None), (5, "train", "x/5.jpg")]
    made = prepare(
        spark.createDataFrame(turns, "conv_id long, turn long, role string, kind string, value string"), spark.createDataFrame(questions, "conv_id long, question string"),
        spark.createDataFrame(images, "conv_id long, split string, image string"), spark.createDataFrame([("x/1.jpg",), ("y/images/2.jpg",), ("x/5.jpg",)], "path string"),
        ["x", "images"], "y/", "sys",
    )
    made.write(str(tmp_path))
    rows = [json.loads(x) for p in sorted((tmp_path / "train").glob("*.json")) for x in p.read_text().splitlines()]
    assert sorted(rows, key=lambda r: r["images"]) == [
        {"system": "sys", "conversation": [{"human": f"q{c}", "assistant": f"a{c}"}, {"human": "A score of 5 is given to the answer. more", "assistant": "b"}], "images": [image]}
        for c, image in ((1, "x/1.jpg"), (2, "y/images/2.jpg"))
    ]
    (stats,) = [json.loads("\n".join(p.read_text() for p in (tmp_path / "stats").glob("part-*")))]
    assert stats["train"] == {
        "samples_processed": 2, "samples_skipped": 2, "samples_no_image": 1, "samples_no_conversations": 1, "samples_filtered_by_source": 0,
        "total_rounds": 4, "images_saved": 3, "errors": ["no_image: train_000004", "no_conversations: train_000005"],
    }
    assert stats["test"]["samples_filtered_by_source"] == 1 and stats["test"]["errors"] == []


SCHEMAS = "conv_id long, turn long, role string, kind string, value string", "conv_id long, question string", "conv_id long, split string, image string"


def test_an_id_in_two_splits_keeps_its_images(spark):
    turns = spark.createDataFrame([(1, 1, "student", "response", "Answer: a")], SCHEMAS[0])
    questions = spark.createDataFrame([(1, "q")], SCHEMAS[1])
    found = spark.createDataFrame([("x/1.jpg",), ("x/2.jpg",), ("x/2.jpg",)], "path string")
    images = spark.createDataFrame([(1, "train", "x/1.jpg"), (1, "test", "x/2.jpg")], SCHEMAS[2])
    made = prepare(turns, questions, images, found, ["x"], "y/", "sys")
    assert sorted((r["split"], r["images"]) for r in made.rows.collect()) == [("test", ["x/2.jpg"]), ("train", ["x/1.jpg"])]
    assert sorted((r["split"], r["outcome"], r["rounds"]) for r in made.outcomes.collect()) == [("test", "processed", 1), ("train", "processed", 1)]
    # Several positions of one split may share a dialogue as well.
    rows = [(1, "train", "x/1.jpg", 0), (1, "train", "x/2.jpg", 1), (1, "train", None, 2), (1, "train", "x/1.jpg", 3)]
    made = prepare(turns, questions, spark.createDataFrame(rows, SCHEMAS[2] + ", idx long"), found, ["x"], "y/", "sys")
    assert sorted((r["idx"], r["images"]) for r in made.rows.collect()) == [(0, ["x/1.jpg"]), (1, ["x/2.jpg"]), (3, ["x/1.jpg"])]
    assert [r["message"] for r in made.errors().collect()] == ["no_image: train_000002"]


def test_dialogues_by_split(spark):
    turns = [(1, 1, "student", "response", f"Answer: {s}", s) for s in ("train", "test")]
    questions = spark.createDataFrame([(1, "q", "train"), (1, "p", "test")], SCHEMAS[1] + ", split string")
    images = spark.createDataFrame([(1, "train", "x/1.jpg"), (1, "test", "x/1.jpg")], SCHEMAS[2])
    made = prepare(spark.createDataFrame(turns, SCHEMAS[0] + ", split string"), questions, images, images.select(images.image.alias("path")), ["x"], "y/", "sys")
    told = {r["split"]: [tuple(e) for e in r["conversation"]] for r in made.rows.collect()}
    assert told == {"train": [("q", "train")], "test": [("p", "test")]}


def test_lookup_of_repeated_references(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, None)], "ref_id long, path string")
    got = resolve.lookup_with_fallback(refs, spark.createDataFrame([("a",), ("y/b",)], "path string"), "y/").collect()
    assert sorted((r["ref_id"], r["path"] or "", r["resolved"]) for r in got if r["path"] != "c") == [(1, "a", "a"), (1, "b", "y/b"), (1, "b", "y/b"), (2, "", None)]
    assert len(got) == 5


def _counted(df, seen):
    """The rows as they are, counted when they are read."""

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema)


def test_inputs_are_read_once_and_counted_while_written(spark, tmp_path):
    turns = spark.createDataFrame([(c, 1, "student", "response", "Answer: a") for c in range(40)], SCHEMAS[0])
    questions = spark.createDataFrame([(c, "q") for c in range(40)], SCHEMAS[1])
    rows = [(i % 50, "train" if i % 3 else "test", ["x/1.jpg", None, "x/2.jpg", "z/1.jpg"][i % 4], i) for i in range(300)]
    images = spark.createDataFrame(rows, SCHEMAS[2] + ", idx long").repartition(4)
    found = spark.createDataFrame([("x/1.jpg",)], "path string")
    seen = [spark.sparkContext.accumulator(0) for _ in range(3)]
    made = prepare(*[_counted(df, s) for df, s in zip((turns, questions, images), seen, strict=True)], found, ["x"], "y/", "sys")
    told = made.write(str(tmp_path), file_bytes=500)
    assert [s.value for s in seen] == [40, 40, 300]
    plain = prepare(turns, questions, images, found, ["x"], "y/", "sys")
    expected = {r["split"]: r["stats"].asDict() for r in plain.stats().collect()}
    assert told == {s: {k: v for k, v in own.items() if k != "errors"} for s, own in expected.items()}
    (written,) = [json.loads(p.read_text()) for p in (tmp_path / "stats").glob("part-*")]
    assert written == expected and len(written["train"]["errors"]) == 100
    # Lines in input order over several files, read in order of their names.
    files = sorted((tmp_path / "train").glob("part-*"))
    lines = [json.loads(x) for p in files for x in p.read_text().splitlines()]
    wanted = [r for r in rows if r[1] == "train" and r[2] == "x/1.jpg" and r[0] < 40]
    assert len(files) > 2 and len(lines) == len(wanted) == told["train"]["samples_processed"]
    assert made.write(str(tmp_path)) == told and [s.value for s in seen] == [40, 40, 300]  # a second run reads and writes nothing


def test_other_splits_and_no_rows(spark, tmp_path):
    turns, questions = spark.createDataFrame([(1, 1, "student", "response", "Answer: a")], SCHEMAS[0]), spark.createDataFrame([(1, "q")], SCHEMAS[1])
    found = spark.createDataFrame([("x/1.jpg",)], "path string")
    images = spark.createDataFrame([(1, "train", "x/1.jpg"), (1, "dev", "x/1.jpg"), (2, "dev", None)], SCHEMAS[2])
    told = prepare(turns, questions, images, found, ["x"], "y/", "sys").write(str(tmp_path / "a"))
    assert {s: (own["samples_processed"], own["samples_no_image"]) for s, own in told.items()} == {"train": (1, 0), "dev": (1, 1)}
    assert prepare(turns, questions, images.where("false"), found, ["x"], "y/", "sys").write(str(tmp_path / "b")) == {}
