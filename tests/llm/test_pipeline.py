"""The stages on nulls, empty and repeated rows, ties, long texts, an empty table and clashing columns."""

import random
import zlib

import pytest

import corpus_pipeline
from dialoom.llm import decontaminate, minhash, quality

SCHEMA = "doc_id long, text string, lang string, n_chars long, row string, key long, bad boolean, `a b` int"
RNG = random.Random(5)


def words(n):
    return " ".join(f"w{RNG.randrange(10**9)}" for _ in range(n))


PASSAGE, LONG = words(30), words(30_000)
BASE = words(100)
TEXTS = [
    (1, BASE),
    (1, BASE),  # a repeated row
    (2, BASE),  # an exact copy
    (3, BASE.replace(BASE.split()[50], "other")),  # a near copy
    (3, words(60)),  # another text of the same id
    (None, BASE),
    (None, words(40)),
    (4, None),
    (5, ""),
    (6, " \n\t"),
    (7, LONG),
    (8, LONG + " more"),
    (9, words(50) + " " + PASSAGE + " " + words(50)),
    (None, words(10) + " " + PASSAGE),
    (9, words(50)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", len(t or ""), "r", 7, True, 3) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([("x", PASSAGE)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_dedup_keeps_one_row_of_each_component(spark, docs, sf_dir):
    got = corpus_pipeline.near_dedup_stage(spark, docs, sf_dir)
    assert got.schema == docs.schema
    gone = {1, 2, 3, 5, 11}  # one of the two equal rows, copies of smaller ids, and the longer of the long texts
    assert pairs(got) == sorted((t for k, t in enumerate(TEXTS) if k not in gone), key=repr)


def test_near_dedup_decides_alike_with_a_full_bitmap(spark, docs, sf_dir, monkeypatch):
    monkeypatch.setattr("dialoom.llm.scratch.BITMAP", 1)
    assert len(pairs(corpus_pipeline.near_dedup_stage(spark, docs, sf_dir))) == len(TEXTS) - 5


def test_decontamination_judges_each_text(spark, docs, sf_dir):
    got = corpus_pipeline.decontamination_stage(spark, docs, sf_dir)
    assert got.schema == docs.schema
    assert pairs(got) == sorted((t for k, t in enumerate(TEXTS) if k not in (12, 13)), key=repr)
    none = spark.createDataFrame([], "item_id string, text string")
    assert pairs(decontaminate.remove_contaminated(docs, none)) == sorted(TEXTS, key=repr)


def test_line_stage_drops_what_has_no_text(spark, sf_dir):
    run = "\n".join(["one line of the run", "another line of the run", "third"])
    rows = [(1, "a\n" + run), (2, run + "\nb"), (2, run + "\nb"), (3, run), (None, run + "\nc"), (4, None), (5, " \n")]
    docs = spark.createDataFrame([(i, t, "en", 0, "r", 7, True, 3) for i, t in rows], SCHEMA)
    got = corpus_pipeline.line_stage(spark, docs, sf_dir)
    assert got.schema == docs.schema
    assert pairs(got) == sorted([(1, "a\n" + run), (2, "b"), (2, "b"), (None, "c")], key=repr)
    assert {r["n_chars"] for r in got.where("doc_id = 1").collect()} == {len("a\n" + run)}


def test_quality_stage_judges_each_row(spark, docs, sf_dir):
    got = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert got.schema == docs.schema
    from dialoom.llm import quality

    good = {t or "" for (_, t), r in zip(TEXTS, quality.score_documents(docs.coalesce(1), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()) if r["predicted"] == 1}
    assert pairs(got) == sorted((x for x in TEXTS if (x[1] or "") in good), key=repr)


def test_all_stages_on_an_empty_table_and_on_rows(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
    want = sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect())
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted({(r["doc_id"]) for r in got.where("doc_id is not null").collect()}) == sorted({i for i, _ in want})


def test_row_key_of_the_stage_is_that_of_the_sets(spark, docs):
    """Rows without an id are found again by the key under which they were grouped."""
    assert minhash.dedup(docs.where("doc_id is null")).count() == 3


def test_the_classifier_is_fitted_outside_the_driver(spark, monkeypatch):
    texts = [(i, f"{'good words here' if i % 2 else 'SPAM! 99 $$'} {i} {i % 7}") for i in range(1, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    seen = [(t.encode(), i % 2) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    wanted = quality.fit(seen)

    def never(text):
        raise AssertionError("a text came to the driver")

    monkeypatch.setattr(quality, "features", never)
    model = quality.fitted(docs, labels)
    assert model.bias == wanted.bias and (model.linear == wanted.linear).all() and (model.factors == wanted.factors).all()
    empty = quality.fitted(docs, labels.limit(0))
    assert empty.bias == 0 and not empty.factors.any()
