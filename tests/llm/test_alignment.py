"""Tokens of two tokenizers against a plain model of the alignment."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from dialoom.llm import alignment, queries

ODD = [
    None, "", " ", "\n", "one", "Some words, don't split.\n\n  Two  blanks\tand a tab \r\n", "a▁b", "▁ x", "<|endoftext|> <s> </s> <0x41> <unk>", "naïve café 漢字 \U0001f600‍ x",
    "ﬁ ａ Ⅳ ½", "é x　y z", "z" * 9_000, "nul \x00 and \x1c", "word " * 3_000, "tie tie", "tie tie", "᠎ x  y", ";\r\n}\r\n",
]


def model(texts):
    """What the report says of each text, by loops."""
    a, b = (kind(path) for kind, path in zip((alignment.ByteTokens, alignment.PieceTokens), queries.aligned_paths()))
    docs, held = [], Counter()
    for text in texts:
        raw, sides = b" " + (text or "").encode(), []
        if text:
            sides = [a.own.encode(" " + text, add_special_tokens=False).ids, b.own.encode(text)]
            if any(b"".join(s.entries[i] for i in ids) != raw for s, ids in zip((a, b), sides)):
                sides = []
        groups = []
        if sides:
            ends = []
            for s, ids in zip((a, b), sides):
                at, own = 0, []
                for i in ids:
                    at += len(s.entries[i])
                    own.append(at)
                ends.append(own)
            marks = sorted(set(ends[0]) & set(ends[1]))
            slot = {e: k for k, e in enumerate(marks)}
            parts = [defaultdict(list), defaultdict(list)]
            for part, ids, own in zip(parts, sides, ends):
                k = 0
                for i, e in zip(ids, own):
                    part[k].append(i)
                    k += e in slot
            groups = [(parts[0][k], parts[1][k]) for k in range(len(marks))]
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        held.update(set(links))
        docs.append((sides, groups, links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for sides, groups, links in docs:
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if sides else ""
        best = sum(n for (x, y), n in links.items() if held[x, y] == top[x])
        out.append((*(len(s) for s in sides or ([], [])), len(groups), sum(links.values()), best, sum(n * held[k] for k, n in links.items()), digest))
    return out


def test_report(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join("".join(rng.choice("abcdeftioné \n,") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(k if k != 14 else None, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a int, links string").repartition(3)
    wanted = [(k if k != 14 else None, *m) for k, m in enumerate(model(texts))]
    assert sum(not m[1] for m in wanted) >= 4 and any(m[4] > max(m[1], m[2]) for m in wanted)
    for most in (alignment.COMMON, 40, 0):  # all pairs are broadcast, some, none
        got = alignment.alignment_report(docs, *queries.aligned_paths(), most=most).collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(wanted, key=repr)
    assert alignment.alignment_report(docs.limit(0), *queries.aligned_paths()).count() == 0


def test_groups_give_back_the_tokens(spark):
    docs = spark.createDataFrame([(1, "unbelievable tokenization of words")], "doc_id long, text string")
    (row,) = alignment.align(docs, *queries.aligned_paths()).collect()
    a, b = (kind(path) for kind, path in zip((alignment.ByteTokens, alignment.PieceTokens), queries.aligned_paths()))
    for g in row["groups"]:
        assert b"".join(a.entries[i] for i in g["a"]) == b"".join(b.entries[i] for i in g["b"])
    assert sum(len(g["a"]) for g in row["groups"]) == row["n_a"] and sum(len(g["b"]) for g in row["groups"]) == row["n_b"]


def test_both_byte_tokenizers_agree():
    a = alignment.ByteTokens(queries.aligned_paths()[0])
    for text in filter(None, ODD):
        assert a.fast.encode_ordinary(" " + text[:4000]) == a.own.encode(" " + text[:4000], add_special_tokens=False).ids


def test_groups_of_many_texts_at_once():
    """Texts one after another, some without tokens, cut at once against each cut by loops; no group passes a text's end."""
    rng = random.Random(5)
    sizes = [np.array([rng.randint(1, 4) for _ in range(50)], np.int32) for _ in "ab"]
    told = alignment._written(50, (b",", b"|")), alignment._written(50, (b",", b";", b""))
    for texts in (0, 1, 9):
        sides, wanted = ([], []), []
        for _ in range(texts):
            rows, ends = [[], []], [[], []]
            for _ in range(rng.choice([0, 1, 30])):
                for row, own, size in zip(rows, ends, sizes):
                    row.append(rng.randrange(50))
                    own.append((own[-1] if own else 0) + int(size[row[-1]]))
            while any(rows) and ends[0][-1] != ends[1][-1]:
                k = int(ends[0][-1] > ends[1][-1])
                row, own = rows[k], ends[k]
                row.append(next(i for i in range(50) if sizes[k][i] == 1))
                own.append(own[-1] + 1)
            marks = sorted({*ends[0]} & {*ends[1]})
            parts = [[[i for i, e in zip(row, own) if lo < e <= hi] for lo, hi in zip([0, *marks], marks)] for row, own in zip(rows, ends)]
            for side, row in zip(sides, rows):
                side.append(np.array(row, np.int32))
            links = [(x << 32) + y for p, q in zip(*parts) for x in p for y in q]
            text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in zip(*parts))
            wanted.append((len(marks), links, hashlib.sha256(text.encode()).hexdigest() if marks else ""))
        g = alignment._Groups(*sides, *sizes)
        assert list(zip(g.sizes.tolist(), g.links().to_pylist(), g.digests(*told))) == wanted
