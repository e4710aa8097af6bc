"""The similarity join by groups against all pairs."""

import random

import numpy as np
import pytest

from dialoom.llm import groups


def token_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def components(texts, percent):
    """(size, smallest id reachable) of each text, by brute force."""
    own, root = {i: token_set(t) for i, t in texts}, {i: i for i, _ in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in own:
        for j in own:
            if i < j and own[i] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(own[i]), top(i)) for i in own}


def copies(rng, words, n, most, first, pool):
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(w))
            w[at : at + 1] = [f"e{rng.randrange(pool)}"] if rng.random() < 0.6 else []
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("percent, common, members", [(90, 1 << 16, 64), (90, 40, 2), (90, 0, 5), (80, 1 << 16, 3)])
def test_components(spark, monkeypatch, percent, common, members):
    monkeypatch.setattr(groups, "COMMON", common)
    monkeypatch.setattr(groups, "MEMBERS", members)
    rng = random.Random(percent + members)
    phrase = [f"p{i}" for i in range(30)]
    texts = copies(rng, [f"v{i}" for i in range(150)], 120, 8, 0, 30) + copies(rng, [f"u{i}" for i in range(90)], 60, 3, 200, 9)
    texts += copies(rng, [f"s{i}" for i in range(12)], 20, 1, 300, 3)  # short ones
    texts += [(400 + i, " ".join(phrase + [f"o{i}x{k}" for k in range(rng.randint(0, 40))])) for i in range(60)]  # one common passage
    texts += [(500 + i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for i in range(60)]  # few words, many ties
    texts += [(600, None), (601, ""), (602, " \t\n"), (603, "one"), (604, "ONE"), (605, "one two"), (606, "two one")]
    long = [f"l{i}" for i in range(12_000)]
    texts += [(700, " ".join(long)), (701, " ".join(long[:-500])), (702, " ".join(long[:-2000]))]
    wanted = components(texts, percent)
    assert 20 < len({r for _, r in wanted.values()}) < len(texts) - 60
    rows = [(i, t, i, "x", [1]) for i, t in texts] + [(0, texts[0][1], 9, "y", None), (None, texts[0][1], 9, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, token string, low array<int>").repartition(5)
    got = groups.similar_documents(docs, percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == wanted
    (unnamed,) = [r for r in got if r["doc_id"] is None]
    assert unnamed["component_id"] is None and unnamed["n_shingles"] == wanted[0][0]


def test_empty_table(spark):
    assert groups.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bounds_never_exclude_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**62, n))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.05], rng.integers(0, 2**62, n // 30)]))
        differ = len(np.setxor1d(x, y))
        bits = sum(int(v).bit_count() for v in (groups.parities(x) ^ groups.parities(y)).view(np.uint64))
        assert bits <= differ
        if 190 * len(np.intersect1d(x, y)) >= 90 * (len(x) + len(y)):
            common = np.sort(rng.choice(x, len(x) // 2, replace=False))
            firsts = [groups.first_tokens(s, len(s), groups.prefix_length(len(s), 90), common)[0] for s in (x, y)]
            assert np.intersect1d(*firsts).size
