"""Lines in input order over numbered files, and their manifest."""

import hashlib
import json

import pytest

from dialoom.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 500, 1, 5).selectExpr("(id * 37) % 500 as idx", "concat('é\n', (id * 37) % 500) as text", "cast(null as string) as none")


def _lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_bytes().decode().split("\n") if x]


def test_order_manifest_and_second_run(spark, rows, tmp_path):
    at = tmp_path / "lines"
    manifest = sinks.write_ordered(rows, str(at), "idx", file_bytes=3000).orderBy("file_no").collect()
    assert _lines(at) == [{"text": f"é\n{i}", "none": None} for i in range(500)]
    files = sorted(at.glob("part-*"))
    assert len(files) > 3 and [m["file"] for m in manifest] == [p.name for p in files]
    first = 0
    for m, p in zip(manifest, files, strict=True):
        content = p.read_bytes()
        assert (m["rows"], m["first_line"], m["bytes"], m["sha256"]) == (content.count(b"\n"), first, len(content), hashlib.sha256(content).hexdigest())
        first += m["rows"]
    assert first == 500
    assert [json.loads(r["line"])["text"] for r in sinks.read_ordered(spark, str(at)).orderBy("line_no").collect()] == [f"é\n{i}" for i in range(500)]
    times = {p: p.stat().st_mtime_ns for p in files}
    assert sinks.write_ordered(rows.where("false"), str(at), "idx").count() == len(files)  # with its manifest nothing is written
    assert {p: p.stat().st_mtime_ns for p in at.glob("part-*")} == times


def test_a_run_without_manifest_is_written_anew_and_damage_is_found(spark, rows, tmp_path):
    at = tmp_path / "lines"
    sinks.write_ordered(rows, str(at), "idx", file_bytes=3000)
    assert sinks.damaged_files(spark, str(at)).count() == 0
    files = sorted(at.glob("part-*"))
    for p in files[:2]:
        (at / f".{p.name}.crc").unlink()
    files[0].write_bytes(files[0].read_bytes().replace(b"1", b"2", 1))
    files[1].unlink()
    (at / "part-99999-x.txt").write_bytes(b"{}\n")
    assert sorted(r["problem"] for r in sinks.damaged_files(spark, str(at)).collect()) == ["changed", "missing", "unknown"]
    (tmp_path / "lines.manifest" / "_SUCCESS").unlink()
    sinks.write_ordered(rows, str(at), "idx", file_bytes=3000)
    assert len(_lines(at)) == 500 and sinks.damaged_files(spark, str(at)).count() == 0


def test_empty_tied_and_null_ordinals(spark, rows, tmp_path):
    assert sinks.write_ordered(rows.where("false"), str(tmp_path / "none"), "idx").agg({"rows": "sum"}).first()[0] in (0, None)
    assert sinks.read_ordered(spark, str(tmp_path / "none")).count() == 0
    tied = spark.createDataFrame([(2, "b"), (None, "z"), (2, "a"), (1, "c")], "idx long, text string")
    sinks.write_ordered(tied, str(tmp_path / "tied"), "idx", file_bytes=1)
    assert [x["text"] for x in _lines(tmp_path / "tied")] == ["z", "c", "a", "b"]
