"""Operators against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dialoom.llm import brown, decontaminate, lines, minhash, ogg, packing, passages, quality, sharding, warc
from dialoom.llm.queries import tokenizer_path

BASE = " ".join(f"w{i * 37 % 101}x" for i in range(120))
NEAR = BASE.replace("w74x", "other", 1)
BENCH = " ".join(f"q{i}" for i in range(14))
TEXTS = [
    (0, BASE), (1, NEAR), (2, BASE), (3, None), (4, ""), (5, "  \n\t"), (6, "one two"), (7, "ONE two"), (8, f"intro {BENCH} outro"), (9, "q1 q2 q3"),
    (10, "x" * 50_000), (11, "ab " * 9_000), (12, "a line that is repeated in another document\nand one more\nown 12"),
    (13, "own 13\na line that is repeated in another document\nand one more\nlast"), (14, "short tail of item"), (15, f"Zu {BASE[:300]} end"), (None, "no id here"), (None, None), (6, "one two"),
]
ITEMS = [(1, BENCH), (2, "tail OF item"), (3, None), (4, ""), (None, "own 12"), (1, BENCH)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", None, k, k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, row int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs, tokenizer_path(), 64, keep_ids=True).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    expected = sorted(repr((i, *(tok.encode(t or "", add_special_tokens=False).ids + [1]))) for i, t in TEXTS)
    by_doc, places = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)]
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], tuple(ids)))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == -(-sum(r["length"] for r in rows) // 64)
    assert len(expected) == len(TEXTS)
    for i, t in TEXTS:
        if i is not None and i != 6:
            assert [x for _, p in sorted(by_doc[i]) for x in p] == tok.encode(t or "", add_special_tokens=False).ids + [1]
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("counts", [{}, {7: 3}, {64: 2, 1: 5}, {40: 10, 24: 4, 12: 6, 6: 12, 30: 3}, {33: 9}])
def test_pack_plan_uses_every_piece(counts):
    used = Counter()
    for pattern, times in packing.pack_plan(counts, 64):
        assert sum(pattern) <= 64 and times > 0
        for x in pattern:
            used[x] += times
    assert used == Counter(counts)


@pytest.mark.parametrize("percent", [85])
def test_near_duplicates(docs, empty, percent):
    rows = minhash.near_duplicates(docs, percent).collect()
    assert len(rows) == len(TEXTS)
    own = [(i, shingles(t)) for i, t in TEXTS if i is not None]
    root = {i: i for i, _ in own}
    for _ in own:
        for i, a in own:
            for j, b in own:
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    for r in rows:
        assert r["component_id"] == root.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies with 1 to 8 changed or dropped words: links on both sides of the threshold, in lists too long for pairs."""
    rng = random.Random(5)
    texts = []
    for i in range(90):
        words = [f"v{k}" for k in range(150)]
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(len(words))
            words[at : at + 1] = [f"e{rng.randrange(40)}"] if rng.random() < 0.5 else []
        texts.append((i, " ".join(words)))
    own = [(i, shingles(t)) for i, t in texts]
    links = [(i, j) for i, a in own for j, b in own if i < j and 100 * len(a & b) >= 85 * len(a | b)]
    root = {i: i for i, _ in own}
    for _ in own:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert 5 < len(set(root.values())) < 85
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, 4).collect()
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 16 for _, t in TEXTS)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_balances_a_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = sharding.shard_documents(docs, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(sizes) == 40 and max(r["b"] for r in sizes) <= 1.03 * min(r["b"] for r in sizes)


def test_brown_counts_and_gain(docs, empty):
    rows = brown.score_documents(docs).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in TEXTS if not held(i) for w in [*words_of(t), b"\n"])
    assert {r["train_tokens"] for r in rows} == {sum(counts.values())}
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"]) for r in rows) == sorted((held(i), len(words_of(t)) + 1, sum(counts[w] > 0 for w in [*words_of(t), b"\n"])) for i, t in TEXTS)
    assert all(r["score"] <= 0 for r in rows)
    assert brown.score_documents(empty).count() == 0


def test_passages(spark, empty):
    run = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a b c {run} d"), (2, f"e {run} f g"), (3, " ".join(f"z{i}" for i in range(200))), (4, None), (5, run.replace("p30", "x")), (6, " ".join(f"p{i}" for i in range(30)))]
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    exact = {(r["doc_id"], r["start"], r["n_words"], r["source_doc_id"], r["source_start"]) for r in found if r["similarity"] == 1}
    assert (2, 1, 60, 1, 3) in exact
    assert {r["doc_id"] for r in found} | {r["source_doc_id"] for r in found} <= {1, 2, 5}
    assert passages.near_passages(empty).count() == 0


def test_lines(docs, empty):
    rows = {r["doc_id"]: r for r in lines.line_report(docs.where("row < 18")).collect()}
    assert rows[13]["removed"] == [1, 2] and rows[12]["removed"] == [] and rows[2]["removed"] == [0] and rows[3]["n_lines"] == 1
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["text"] for r in out.where("doc_id = 13").collect()} == {"own 13\nlast"}
    assert lines.line_report(empty).count() == 0


def test_ogg_round_trip_and_faults(docs, empty):
    rows = ogg.media_columns(docs, keep_media=True).collect()
    assert sorted(r["n_bytes"] for r in rows) == sorted(len((t or "").encode()) for _, t in TEXTS)
    for r in rows:
        assert r["payload_bytes"] % 64 == 0 and "faults=0" in r["feature"]
        assert hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
    media = bytearray(ogg.mux(ogg.pad(b"x" * 200_000), 200_000))
    assert ogg.read_payload(bytes(media))[0] == ogg.pad(b"x" * 200_000)
    media[100_000] ^= 1
    assert any("checksum" in w for w in ogg.demux(bytes(media))[1])
    assert ogg.media_columns(empty).count() == 0


def test_ogg_crc_by_definition():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
                crc &= 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.ogg_crc(data) == slow(data)


def test_quality_held_out(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    right, n = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.9
    assert quality.score_documents(docs, labels.limit(0)).where("score between 0.49 and 0.51").count() == len(TEXTS)
    assert quality.score_documents(empty, labels).count() == 0


def test_factorisation_identity():
    import numpy as np

    rng = np.random.default_rng(1)
    m = quality.Model(0.5, rng.normal(size=6), rng.normal(size=(6, 3)))
    index, value = np.array([0, 2, 5]), np.array([1.0, 0.5, 2.0])
    slow = 0.5 + sum(m.linear[i] * v for i, v in zip(index, value))
    slow += sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(3) for b in range(a + 1, 3))
    assert np.isclose(m.margin(index, value, np.array([0]))[0], slow)


def test_warc_audit(spark, empty):
    pages = spark.createDataFrame([(i if i % 50 else None, f"http://x/{i}" if i % 7 else None, f"<p>{i}</p>" if i % 5 else None) for i in range(2000)], "page_id long, url string, html string").repartition(3)
    rows = warc.fixity_report(pages).collect()
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 97 == 0
    assert len(rows) == 2000 and all(r["corrupt"] == crc(r["page_id"]) == (r["sha256"] != r["replica_sha256"]) for r in rows if r["length"] > 5)
    assert any(r["corrupt"] for r in rows)
    assert warc.fixity_report(pages.limit(0)).count() == 0


@pytest.mark.parametrize("full_bitmap", [False, True])
def test_decontamination(spark, docs, empty, monkeypatch, full_bitmap):
    if full_bitmap:
        monkeypatch.setattr(decontaminate, "BITMAP", 1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in ITEMS:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])] |= {str(i)} if i is not None else set()
    expected = []
    for i, t in TEXTS:
        w, hit, found = split(t), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        expected.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    rows = [(str(r[0]), *r[1:]) for r in decontaminate.contamination(docs, items).collect()]
    assert sorted(rows) == sorted(expected)
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
