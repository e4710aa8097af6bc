"""Cases that operators once did only in part."""

import random

import corpus_pipeline
from dialoom.llm import lines, minhash, packing, passages
from dialoom.llm.queries import tokenizer_path
from dialoom.llm.scratch import Scratch


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(texts, percent):
    """The smallest id of each text's component, by brute force."""
    own, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}
    links = [(i, j) for i in own for j in own if i < j and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j])]
    for _ in own:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_pipeline_links_from_similarity_08_on(spark):
    words = [f"w{i}" for i in range(100)]
    changed = [f"{w}x" if i in (30, 70) else w for i, w in enumerate(words)]
    pair = [(1, " ".join(words)), (2, " ".join(changed))]
    a, b = (shingles(t) for _, t in pair)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame([*pair, (3, " ".join(f"z{i}" for i in range(100)))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {1, 3}


def test_near_duplicates_at_08_of_a_large_group(spark):
    assert (minhash.least_shared(85), minhash.least_shared(80)) == (minhash.SHARED, 13)  # P(Binomial(32, 0.8) < 13) = 1.9e-7
    rng = random.Random(7)
    texts = []
    for i in range(90):
        words = [f"v{k}" for k in range(150)]
        for _ in range(rng.randint(1, 10)):
            at = rng.randrange(len(words))
            words[at : at + 1] = [f"e{rng.randrange(40)}"] if rng.random() < 0.5 else []
        texts.append((i, " ".join(words)))
    root = components(texts, 80)
    assert 5 < len(set(root.values())) < 85
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 80, shared=minhash.least_shared(80)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_lines_of_short_runs(spark):
    """Runs of 40 characters or more, in any number of lines, against all pairs of runs."""
    rng = random.Random(3)
    three = [c * 15 for c in "abc"]
    seven = [f"item {c} 11" for c in "abcdefg"]
    tail = ["L" * 100, "short", "brief"]
    texts = [["x0", *three, "y0"], ["x1", *three, "y1"], ["x2", *seven], [*seven, "y3"], [*tail, "x4"], ["x5", *tail], [*three[1:], "x6", *three, *three]]
    for _ in range(12):
        texts.append([rng.choice(["aa", "b" * 9, "c" * 14, "d" * 20, "e" * 39, "f" * 45, ""]) for _ in range(rng.randint(1, 14))])
    kept = [[(i, t) for i, t in enumerate(x) if t] for x in texts]
    seen, expected = set(), {}
    for d, x in enumerate(kept):
        gone = set()
        runs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if sum(len(t) for _, t in x[i:j]) >= 40]
        for i, j in sorted(runs):
            run = tuple(t for _, t in x[i:j])
            if run in seen:
                gone |= {k for k, _ in x[i:j]}
            seen.add(run)
        expected[d] = sorted(gone)
    assert expected[1] == [1, 2, 3] and expected[3] == list(range(7)) and expected[5] == [1, 2, 3]
    docs = spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: list(r["removed"]) for r in lines.line_report(docs).collect()} == expected


def test_passages_go_on_over_inserted_and_deleted_words():
    words = [f"w{i}" for i in range(70)]
    hashes = lambda w: minhash.shingle_hashes(" ".join(w).encode())
    for other in ([*words[:35], "new", *words[35:]], [*words[:35], *words[36:]]):
        one, two = hashes(["a", "b", *words, "c"]), hashes([*other, "d"])
        found = passages.passages_between(one, two, [2])
        assert [(a, b, m + 4, n + 4) for a, b, m, n, _ in found] == [(2, 0, 70, len(other))]
        assert found[0][4] == len(set(hashes(words)) & set(hashes(other))) / len(set(hashes(words)) | set(hashes(other)))


def test_passages_with_their_middle_word_changed_share_a_seed():
    """A 50-word passage with one changed word, J = 0.80 of aligned shingles, in 2000 trials."""
    rng = random.Random(1)
    hashes = lambda w: minhash.shingle_hashes(" ".join(w).encode())
    for _ in range(2000):
        run, pad = [f"p{rng.random()}" for _ in range(50)], lambda: [f"z{rng.random()}" for _ in range(rng.randint(0, 9))]  # noqa: B023
        changed = [*run[:25], "other", *run[26:]]
        a, b = hashes(pad() + run + pad()), hashes(pad() + changed + pad())
        assert set(passages.seeds(a)[1].tolist()) & set(passages.seeds(b)[1].tolist())


def test_passages_beside_a_head_that_does_not_hold_them(spark):
    """Repeats among the members of a key that its head, the smallest id, doesn't share or is not alone in."""
    rng, rows, wanted = random.Random(2), [], []
    w = lambda n: [f"t{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(30):
        at = 10 * k
        p1, after = w(60), w(30)
        block = (p1 + after)[60 - 44 : 60 + 6]  # 50 words of B, 44 of them in P1
        rows += [(at, w(20) + p1 + w(20)), (at + 1, w(20) + p1 + after + w(20)), (at + 2, w(20) + block + w(20))]
        middle = w(25)  # also held by a dissimilar document of smaller id
        rows += [(at + 6, w(20) + middle + w(40)), (at + 7, middle + ["a"] + (tail := w(24))), (at + 8, middle + ["b"] + tail)]
        wanted += [(at + 1, at + 2), (at + 7, at + 8)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    got = {(r["source_doc_id"], r["doc_id"]) for r in passages.near_passages(docs).collect()}
    assert set(wanted) <= {(min(p), max(p)) for p in got}


def test_chains_by_numbers_are_those_by_arrays(monkeypatch):
    rng = random.Random(11)
    for _ in range(300):
        base = [rng.randrange(40) for _ in range(120)]
        other = list(base)
        for _ in range(rng.randint(1, 12)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 2)] = [rng.randrange(40)] * rng.randint(0, 2)
        one, two = (minhash.shingle_hashes(" ".join(map(str, x)).encode()) for x in (base, other))
        by_numbers = passages.passages_between(one, two, [0])
        monkeypatch.setattr(passages, "FEW", -1)
        assert passages.passages_between(one, two, [0]) == by_numbers
        monkeypatch.setattr(passages, "FEW", 24)


def test_recall_of_changed_passages(spark):
    """Passages of 50 to 120 words with a substituted, inserted or deleted word for each 50, in documents of their own words."""
    rng, rows, wanted = random.Random(4), [], {"swap": [], "insert": [], "delete": []}
    w = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(180):
        kind = ("swap", "insert", "delete")[k % 3]
        passage = w(rng.randint(51, 120))
        changed = list(passage)
        step = len(passage) // (len(passage) // 50 + 1)
        for at in range(step * (len(passage) // 50), 0, -step):
            changed[at : at + (kind != "insert")] = w(1) if kind != "delete" else []
        rows += [(2 * k, " ".join(w(30) + passage + w(30))), (2 * k + 1, " ".join(w(10) + changed + w(50)))]
        wanted[kind].append((2 * k, 2 * k + 1))
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r["source_doc_id"], r["doc_id"]) for r in got}
    for kind, sought in wanted.items():
        assert sum(p in pairs for p in sought) >= 0.9 * len(sought), kind
    assert pairs <= {p for sought in wanted.values() for p in sought}


def test_passages_around_a_common_phrase(spark):
    """Sixty passages, each of two texts, that all lie around one phrase; rounds with one head at a time leave most of them out."""
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    phrase, texts = [f"p{i}" for i in range(42)], []
    for i in range(60):
        passage = [*fresh(4), *phrase, *fresh(4)]
        texts += [(2 * i, " ".join(fresh(30) + passage + fresh(30))), (2 * i + 1, " ".join(fresh(40) + passage + fresh(20)))]
    texts += [(200 + i, " ".join(fresh(50) + phrase + fresh(50))) for i in range(12)]
    got = passages.near_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(1)).collect()
    assert sorted((r["doc_id"], r["source_doc_id"]) for r in got) == [(2 * i + 1, 2 * i) for i in range(60)]
    assert all((r["start"], r["n_words"], r["source_start"]) == (40, 50, 30) for r in got)


def test_passages_over_a_common_phrase_and_a_changed_word(spark):
    """Pairs that differ in a word beside a phrase of 30 words that all texts hold, found without comparing all texts that hold it."""
    rng = random.Random(12)
    fresh = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    phrase, texts = [f"q{i}" for i in range(30)], []
    for i in range(60):
        rest = fresh(22)
        for k, middle in enumerate((fresh(1), fresh(1) if i % 2 else [])):
            passage = [*phrase, *middle, *rest] if i % 3 else [*rest, *middle, *phrase]
            texts.append((2 * i + k, " ".join([*fresh(30 + 10 * k), *passage, *fresh(30)])))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(1)
    scratch = Scratch(spark, "passages")
    windows = passages.window_keys(docs).cache()
    told = windows.where("doc_id is not null").select("row", "doc_id", "text", "n")
    tokens = passages._tokens(docs, told).cache()
    left = windows.where("key is not null").select("key", "row", "c")
    pairs = passages._last_pairs(scratch.keep(passages._surroundings(left, tokens), "near"), left, scratch)
    ids = {r["row"]: r["doc_id"] for r in told.collect()}
    met = {tuple(sorted((ids[r["row_a"]], ids[r["row"]]))) for r in pairs.collect()}
    assert met == {(2 * i, 2 * i + 1) for i in range(60)}
    got = passages.near_passages(docs).collect()
    assert {(r["source_doc_id"], r["doc_id"]) for r in got} == met


def test_every_document_with_a_repeated_passage_has_a_row(spark):
    """Three texts with one passage, of which one has the smallest id, two copies of another text and one of its own words."""
    w = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(k, f"{w(f'x{k}y', 40)} {w('p', 60)} {w(f'z{k}y', 30 + k)}") for k in (1, 2, 3)] + [(4, w("c", 70)), (5, w("c", 70)), (6, w("o", 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["n_words"]) for r in passages.near_passages(docs, both_sides=True).collect()}
    assert got == {(1, 40, 60), (2, 40, 60), (3, 40, 60), (4, 0, 70), (5, 0, 70)}
    assert {r["doc_id"] for r in passages.near_passages(docs).collect()} == {2, 3, 5}


def test_seeds_deep_inside_a_repeating_stretch_are_left_out():
    rng = random.Random(3)
    before, after = ([f"{x}{rng.random()}" for _ in range(40)] for x in "ba")
    for period in (1, 3, 12):
        keys = []
        for length in (120, 900, 4000):
            words = [*before, *[f"s{i % period}" for i in range(length)], *after]
            c, key = passages.seeds(minhash.shingle_hashes(" ".join(words).encode()))
            assert len(c) < 260
            keys.append(set(key.tolist()))
        assert keys[1] == keys[2] or period > 1
        assert all(a & b for a in keys for b in keys)


def test_ids_do_not_depend_on_how_many_words_are_kept(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["Word,", "it's", f"n{rng.randrange(50)}", "<|x|>", "(a)b!"]) for _ in range(200))) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    few, many = (packing.pack_documents(docs, tokenizer_path(), cached=k).collect() for k in (3, 1000))
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in few) == sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in many)
