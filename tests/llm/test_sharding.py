"""Shards of repeated rows, against the sizes of all rows."""

from collections import Counter, defaultdict

from dialoom.llm import sharding


def test_repeated_rows_are_balanced(spark):
    rows = [(7, "the same row " * 5)] * 9000 + [(None, None)] * 600 + [(i, f"text {i} " * (1 + i % 9)) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sharding.shard_documents(docs, shards=12).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and len(size) == 12
    assert sum(size.values()) == sum(16 + len(t or "") for _, t in rows)
    assert max(size.values()) <= 1.03 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i % 50, f"t{i % 70}", "x") for i in range(400)], "doc_id long, text string, slot string")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert back.select("shard").distinct().count() == 4
