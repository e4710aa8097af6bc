"""Periodic runs against brute force, over random words and a table with every odd case."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from dialoom.llm import periodic, queries


def brute_runs(w, least=24, times=3):
    found = set()
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p) and not any(w[i : j + p - q] == w[i + q : j + p] for q in range(1, p)):
                found.add((i, j + p - i, p))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, times", [(24, 3), (2, 2), (6, 3)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    for _ in range(80):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.randint(0, 150), rng.choice([1, 2, 3, 5, 30])
            w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert periodic.runs_of(texts, least, times) == [brute_runs(w, least, times) for w in texts]


def test_worst_cases_of_the_refinement():
    fib = [b"a"], [b"a", b"b"]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    texts = [[b"x"] * 500, fib[1], [b"a", b"b"] * 100 + [b"c"] + [b"a", b"b"] * 100, [b"%d" % (i % 60) for i in range(200)]]
    assert periodic.runs_of(texts) == [brute_runs(w) for w in texts]
    assert periodic.runs_of([]) == [] and periodic.runs_of([[], [b"a"]]) == [[], []]


def expected(doc_id, text):
    w = queries.planted_words(doc_id, (text or "").encode())
    runs = brute_runs(w)
    keep = [x for i, x in enumerate(w) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(keep)))


def test_report(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "Ab ab " * 40, "x " * 30 + "y " * 30, "a\x0bb\x0c" * 30, "  " * 25, "z" * 60_000, "long run of it " * 700]
    texts += [" ".join(rng.choice(["a", "b", "c", "é"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, t, i, "k") for i, t in enumerate(texts)] + [(4, texts[4], 0, "k"), (None, texts[4], 0, None), (None, None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, period string").repartition(3)
    for doc_id in (0, 3, 10, 27):  # some of the planted ones
        own = queries.planted_words(doc_id, b"a b c d e f g h i j")
        assert (own != b"a b c d e f g h i j".split()) <= (zlib.crc32(str(doc_id).encode()) % 10 == 0)
    wanted = sorted((expected(i, t) for i, t, *_ in rows), key=repr)
    for together, long in ((1 << 20, 1 << 11), (50, 20)):
        monkeypatch.setattr(periodic, "TOGETHER", together)
        monkeypatch.setattr(periodic, "LONG", long)
        assert sorted(map(tuple, periodic.run_report(docs, queries.planted_words).collect()), key=repr) == wanted
    assert any(w[1] > 0 and w[0] is not None and zlib.crc32(str(w[0]).encode()) % 10 == 0 for w in wanted)
    assert periodic.run_report(docs.limit(0)).count() == 0


def test_texts_without_later_periods(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 10 + "end")], "doc_id long, text string")
    (row,) = periodic.periodic_runs(docs).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 30, 3)] and row["collapsed"] == b"start a b c end" and row["n_words"] == 32
