"""Scans that stop: what they return and what they never open."""

from pathlib import Path

import pytest

from dialoom.sources import staged


def _split(spark, path: Path, files: list[list[tuple]]) -> str:
    """A Parquet folder with a file for each list of rows (key, value), in order of their names."""
    path.mkdir()
    for i, rows in enumerate(files):
        out = path.parent / f"{path.name}-{i}.tmp"
        spark.createDataFrame(rows, "key string, value long").coalesce(1).write.parquet(str(out))
        (part,) = out.glob("part-*.parquet")
        part.rename(path / f"f {i:03d}.parquet")
    return str(path)


def _spoil(path: str, after: int) -> None:
    """Files from number ``after`` on are made unreadable."""
    for part in sorted(Path(path).glob("*.parquet"))[after:]:
        part.write_bytes(b"not parquet")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    return _split(spark, tmp_path_factory.mktemp("many") / "train", [[(f"k{i}", i * 10), ("hot", i), (f"k{i}", i * 10 + 1), (None, 7)] for i in range(12)])


@pytest.fixture
def schema():
    return "key string, value long"


def _got(df):
    return sorted((r["key"], r["value"], r["split_ord"]) for r in df.collect())


@pytest.mark.parametrize("sent", [staged.SENT_BYTES, -1])
def test_files_beyond_the_stop_are_never_opened(spark, many, schema, monkeypatch, sent):
    monkeypatch.setattr(staged, "SENT_BYTES", sent)
    _spoil(many, 7)  # groups of 1, 2 and 4 files
    needed = spark.createDataFrame([("k0",), ("hot",), ("k4",), ("k4",), (None,)], "key string")
    unread = many + "-none"  # a second split that doesn't even exist
    stop = staged.find_stop(spark, [many, unread], needed, "key", schema, 1)
    assert (stop.files_read, stop.files, stop.missing, stop.at[0], stop.at[2]) == (7, 12, 0, 0, 0)
    last = staged.read_until_found(spark, [many, unread], needed, "key", "last", schema, 1)
    assert _got(last) == [("hot", 3, 0), ("k0", 1, 0), ("k4", 40, 0)]  # the stop lies before the rows of file 4 that follow its first
    first = staged.read_until_found(spark, [many, unread], needed, "key", "first", schema, 1)
    assert _got(first) == [("hot", 0, 0), ("k0", 0, 0), ("k4", 40, 0)]


def test_second_split_only_if_incomplete(spark, tmp_path, schema):
    train = _split(spark, tmp_path / "train", [[("a", 1), ("b", 2)], [("a", 3)]])
    val = _split(spark, tmp_path / "val", [[("a", 4), ("c", 5), ("a", 6)], [("c", 7)]])
    needed = spark.createDataFrame([("a",), ("c",)], "key string")
    assert _got(staged.read_until_found(spark, [train, val], needed, "key", "last", schema, 1)) == [("a", 4, 1), ("c", 5, 1)]
    only = spark.createDataFrame([("b",), ("a",)], "key string")
    assert _got(staged.read_until_found(spark, [train, val], only, "key", "last", schema, 1)) == [("a", 1, 0), ("b", 2, 0)]
    # A key that is nowhere: everything is read to its end.
    more = spark.createDataFrame([("a",), ("c",), ("z",)], "key string")
    stop = staged.find_stop(spark, [train, val], more, "key", schema, 1)
    assert (stop.at, stop.files_read, stop.missing) == (None, 4, 1)
    assert _got(staged.read_until_found(spark, [train, val], more, "key", "last", schema, 1)) == [("a", 6, 1), ("c", 7, 1)]


def test_nothing_needed_and_no_rows(spark, tmp_path, schema):
    train = _split(spark, tmp_path / "train", [[("a", 1)]])
    none = spark.createDataFrame([(None,)], "key string")
    assert staged.find_stop(spark, [train], none, "key", schema).files_read == 0
    assert _got(staged.read_until_found(spark, [train], none, "key", schema=schema)) == []
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(empty)
    some = spark.createDataFrame([("a",)], "key string")
    assert _got(staged.read_until_found(spark, [empty, train], some, "key", schema=schema)) == [("a", 1, 1)]
