"""Every word joins a class by all of its contexts; scores against a plain model."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from dialoom.llm import brown
from dialoom.llm.scratch import Scratch


def test_words_that_are_not_clustered_join_any_class_by_both_sides(spark, monkeypatch):
    monkeypatch.setattr(brown, "CLUSTERED", 40)
    monkeypatch.setattr(brown, "BLOCK_TOKENS", 500)
    rng, texts = random.Random(3), []
    for i in range(120):
        words = []
        for k in range(30):  # frequent words in a fixed order of kinds, rare ones between them and beside each other
            words.append(f"f{k % 10}x{rng.randrange(4)}")
            if rng.random() < 0.3:
                words += [f"r{k % 10}x{rng.randrange(9)}" for _ in range(rng.randint(1, 2))]
        texts.append((i, " ".join(words)))
    texts.append((500, " ".join(["often", "once"] * 400)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    model = brown.train(docs, Scratch(spark, "brown"))
    got = {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in model["vocabulary"].collect()}
    assert len(got) == model["vocabulary"].count()

    counts, around, pair = Counter(), {}, np.full((brown.CLASSES + 1,) * 2, 0.5)
    end = model["end"]
    for i, t in texts:
        if i not in held:
            words = t.split()
            counts.update(words)
            classes = [end, *(got[w][1] if got[w][1] < brown.CLASSES else brown.CLASSES for w in words), end]
            for a, b in zip(classes, classes[1:]):
                pair[a, b] += 1
            for w, a, c in zip(words, classes, classes[2:]):
                around.setdefault(w, Counter()).update([("before", a), ("after", c)])
    assert {w: n for w, (n, _) in got.items()} == counts
    assert {w for w, (_, c) in got.items() if c < brown.CLASSES} == set(sorted(counts, key=lambda w: (-counts[w], w))[:40])
    near = np.log(pair * pair.sum() / (pair.sum(axis=1, keepdims=True) * pair.sum(axis=0, keepdims=True)))
    joined = {w: c - brown.CLASSES for w, (_, c) in got.items() if c >= brown.CLASSES}
    for w, c in joined.items():
        fits = [sum(n * (near[k, b] if side == "before" else near[b, k]) for (side, k), n in around[w].items()) for b in range(brown.CLASSES)]
        assert fits[c] >= max(fits) - 1e-4, w
    assert len(set(joined.values())) > 8

    rows = {r["doc_id"]: r for r in brown.score_documents(docs).collect()}
    tokens = sum(counts.values()) + len(texts) - len(held)
    ends = len(texts) - len(held)
    n_of, v_of = Counter(), Counter()
    for w, (n, c) in got.items():
        n_of[c] += n
        v_of[c] += 1
    n_of[end] += ends
    v_of[end] += 1
    unknown = (sum(n == 1 for n in counts.values()) + 0.5) / (tokens + 0.5)
    class_of = lambda w: got[w][1] if w in got else None
    moves = Counter(m for i, t in texts if i not in held for c in [[end, *map(class_of, t.split()), end]] for m in zip(c, c[1:]))
    weight = lambda c: n_of[c] + 0.5 * v_of[c]
    room = sum(map(weight, n_of))
    for i, t in texts:
        base = score = 0.0
        before = end
        for w in [*t.split(), None]:
            n, c = (ends, end) if w is None else got.get(w, (0, None))
            base += math.log10((n + 0.5) / (tokens + 0.5 * (len(counts) + 2)))
            out = sum(n for (a, _), n in moves.items() if a == before)
            if c is None:
                score += math.log10(unknown)
            else:
                step = (moves[before, c] + brown.BACKOFF * weight(c) / room) / (out + brown.BACKOFF)
                score += math.log10((1 - unknown) * step) + math.log10((n + 0.5) / weight(c))
            before = c
        assert abs(rows[i]["base_score"] - base) < 1e-6 * abs(base) and abs(rows[i]["score"] - score) < 1e-6 * abs(score)
