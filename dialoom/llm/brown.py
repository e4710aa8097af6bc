"""Language-model scoring by class-based n-grams.

Training counts every word of every training text. The most frequent words are clustered
by exchange: each word moves to the class that raises the likelihood of the class bigrams
most, until none moves. Every other word, however rare, joins by one exchange step that of all classes
which fits the classes before and after all of its occurrences best; neighbours that aren't
clustered themselves count as a class of their own. Frequent and other words of a class share its contexts, but are
two classes of the model, so that rare words don't thin out the frequent ones. A text's score is the sum over
its tokens of log10 P(class | class before) + log10 P(word | class), with

    P(word | class)  = (n(word) + 1/2) / (n(class) + V(class) / 2)
    P(class)          = (n(class) + V(class) / 2) / (N + V / 2)
    P(class | before) = (1 - U) (n(before, class) + B P(class)) / (n(before) + B)

and probability U for the one class of all unknown words, by the share of words seen once. The texts are
coded once, in blocks of some two million tokens with a word list of their own; a block
asks for its own words' counts and classes, so that no task holds the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, text_bytes

#: Words that are clustered among each other, and their classes, which all other words join.
CLUSTERED, CLASSES = 1024, 32
BACKOFF = 40.0
BLOCK_TOKENS = 2_000_000
END = b""
_UNKNOWN = 2 * CLASSES
_ALL = _UNKNOWN + 1


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


_BLOCK = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, codes binary"


def code_blocks(docs: DataFrame, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of texts as word numbers; a text's end is implied. Words hold no white space, so a blank parts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size = TaskContext.get().partitionId(), 0, 0
        codes, ids, held, arrays = _Codes(), [], [], []

        def block() -> pa.RecordBatch:
            all_ = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            row = [(part << 32) + number, ids, held, [len(a) for a in arrays], b" ".join(codes), zlib.compress(all_.tobytes(), 1)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.lower().split()
                arrays.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1)
                size += len(words)
                if size >= tokens:
                    yield block()
                    number, size, codes, ids, held, arrays = number + 1, 0, _Codes(), [], [], []
        if ids:
            yield block()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    return chosen.mapInArrow(run, _BLOCK)


class _Block:
    """A block as read: its words and the token numbers with -1 at each text's end."""

    def __init__(self, row: dict):
        self.block, self.ids, self.held = row["block"], row["doc_ids"], np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = row["words"].split(b" ") if row["words"] else []
        codes = np.frombuffer(zlib.decompress(row["codes"]), np.int32)
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.starts = self.ends - self.sizes
        self.codes = np.full(len(codes) + len(self.ids), -1, np.int32)
        inside = np.ones(len(self.codes), bool)
        inside[self.ends] = False
        self.codes[inside] = codes
        self.training = np.repeat(~self.held, self.sizes + 1)

    def before(self, values: np.ndarray, end: int) -> np.ndarray:
        """The value of the token before each; a text starts after an end."""
        out = np.roll(values, 1)
        out[self.starts] = end
        return out


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch.slice(i, 1).to_pylist()[0])


def local_words(blocks: DataFrame) -> DataFrame:
    """(block, code, word, n): a block's words and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each_block(batches):
            n = np.bincount(b.codes[b.training & (b.codes >= 0)], minlength=len(b.words))
            if b.words:
                columns = [pa.array(np.full(len(n), b.block)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(b.words, pa.binary()), pa.array(n.astype(np.int64))]
                yield from pa.Table.from_arrays(columns, names=["block", "code", "word", "n"]).to_batches(max_chunksize=50_000)

    return blocks.mapInArrow(run, "block long, code int, word binary, n long")


def _ranks(b: _Block, known: dict[bytes, int], other: int, end: int) -> np.ndarray:
    """Each token's number among the known words; ``other`` for the rest."""
    table = np.fromiter((known.get(w, other) for w in b.words), np.int32, len(b.words))
    return np.append(table, end)[b.codes]


def frequent_bigrams(blocks: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(code, n): training bigrams of the clustered words, the end and all other words; at most (CLUSTERED + 2) ** 2 rows."""
    size = len(known) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each_block(batches):
            rank = _ranks(b, known, size - 1, size - 2).astype(np.int64)
            code, n = np.unique((b.before(rank, size - 2) * size + rank)[b.training], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    return blocks.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _gain(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of words from their bigram counts by the exchange algorithm; rows are words in order of frequency."""
    size = len(bigrams)
    of = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # word -> counts of classes after and before it
    pair = member.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(size):
            a, own = of[w], bigrams[w, w]
            out, into = right[w].copy(), left[w].copy()
            out[a] -= own
            into[a] -= own
            pair[a] -= out
            pair[:, a] -= into
            pair[a, a] -= own
            rows, columns = pair.sum(axis=1), pair.sum(axis=0)
            r, c = out.sum() + own, into.sum() + own
            base = _gain(pair)
            new_rows, new_columns = pair + out[None, :], pair + into[:, None]
            diagonal = np.diag(pair)
            both = (_gain(new_rows) - base).sum(axis=1) + (_gain(new_columns) - base).sum(axis=0)
            both += _gain(diagonal + out + into + own) - _gain(diagonal + out) - _gain(diagonal + into) + np.diag(base)
            both -= _gain(rows + r) - _gain(rows) + _gain(columns + c) - _gain(columns)
            best = int(np.argmax(both + 1e-9 * (np.arange(classes) == a)))
            pair[best] += out
            pair[:, best] += into
            pair[best, best] += own
            if best != a:
                moved += 1
                of[w] = best
                right[:, a] -= bigrams[:, w]
                right[:, best] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, best] += bigrams[w]
        if not moved:
            break
    return of


def contexts(blocks: DataFrame, known: dict[bytes, int], class_: np.ndarray) -> DataFrame:
    """(word, around): for each word that isn't clustered and each block, how often each class stands before and after it.

    ``around`` holds pairs of bytes, a context and its count; contexts are the classes before, then those after, and greater counts take several pairs.
    """
    size = len(known) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each_block(batches):
            rank = _ranks(b, known, size - 1, size - 2)
            own = class_[rank]
            mine = b.training & (rank == size - 1)
            before, after = b.before(own, int(class_[size - 2]))[mine], np.roll(own, -1)[mine] + CLASSES + 1
            word = b.codes[mine].astype(np.int64) * (2 * CLASSES + 2)
            code, n = np.unique(np.concatenate([word + before, word + after]), return_counts=True)
            whole = -(-n // 255)
            last = np.cumsum(whole) - 1
            pairs = np.full((int(whole.sum()), 2), 255, np.uint8)
            pairs[:, 0] = np.repeat(code % (2 * CLASSES + 2), whole)
            pairs[last, 1] = n - 255 * (whole - 1)
            of, first = np.unique(np.repeat(code // (2 * CLASSES + 2), whole), return_index=True)
            if len(of):
                ends = pa.array(np.append(first, len(pairs)).astype(np.int32) * 2).buffers()[1]
                around = pa.Array.from_buffers(pa.binary(), len(of), [None, ends, pa.py_buffer(pairs.tobytes())])
                columns = [pa.array([b.words[i] for i in of.tolist()], pa.binary()), around]
                yield from pa.Table.from_arrays(columns, names=["word", "around"]).to_batches(max_chunksize=50_000)

    return blocks.mapInArrow(run, "word binary, around binary")


def joined_classes(around: DataFrame, weights: np.ndarray) -> DataFrame:
    """(word, n, class): each word of ``contexts`` with its count and the class that fits all its contexts best, the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, fit = None, 0, np.zeros(CLASSES)  # of the last word, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_pylist()
            raw = batch.column(1)
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            pairs = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, 2)
            new = np.flatnonzero([x != y for x, y in zip(rows, [word, *rows])])
            at = np.unique(np.append(0, new))  # where the batch's words begin, the one that goes on included
            start = (ends[at] - ends[0]) // 2
            fits = np.add.reduceat(weights[pairs[:, 0]] * pairs[:, 1:], start)
            sums = np.add.reduceat(np.where(pairs[:, 0] <= CLASSES, pairs[:, 1], 0).astype(np.int64), start)
            names = [rows[i] for i in at.tolist()]
            if names[0] == word:
                fits[0] += fit
                sums[0] += n
            elif word is not None:
                names, sums, fits = [word, *names], np.append(n, sums), np.vstack([fit, fits])
            word, n, fit = names.pop(), sums[-1], fits[-1]
            if names:
                yield found(names, sums[:-1], fits[:-1])
        if word is not None:
            yield found([word], np.array([n], np.int64), fit[None, :])

    def found(names: list[bytes], n: np.ndarray, fits: np.ndarray) -> pa.RecordBatch:
        best = np.argmax(np.round(fits, 6), axis=1) + CLASSES  # rounded, as the order of a word's blocks is any
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n.astype(np.int64)), pa.array(best.astype(np.int32))], names=["word", "n", "class"])

    return around.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, class int")


def context_weights(bigrams: np.ndarray, class_: np.ndarray) -> np.ndarray:
    """For each context, a class before or after, how much likelier it is beside each class than anywhere: logarithms, (2 * CLASSES + 2) x CLASSES."""
    member = np.zeros((len(bigrams), CLASSES + 1))
    member[np.arange(len(bigrams)), class_] = 1
    pair = member.T @ bigrams @ member + 0.5
    near = np.log(pair * pair.sum() / (pair.sum(axis=1, keepdims=True) * pair.sum(axis=0, keepdims=True)))
    return np.concatenate([near[:, :CLASSES], near[:CLASSES].T])


def train(docs: DataFrame, scratch: Scratch) -> dict:
    """Blocks, local words, the vocabulary with counts and classes, and the class totals."""
    blocks = scratch.keep(code_blocks(docs), "blocks")
    local = scratch.keep(local_words(blocks), "local-words")
    counts = local.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts")
    texts = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    top = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(CLUSTERED).collect()]
    known = {w: i for i, (w, _) in enumerate(top)}
    size = len(top) + 2
    matrix = np.zeros((size, size))
    for r in frequent_bigrams(blocks, known).toLocalIterator():
        matrix[r["code"] // size, r["code"] % size] = r["n"]
    of = exchange(matrix[: size - 1, : size - 1], CLASSES)  # the clustered words and the end
    class_ = np.append(of, CLASSES).astype(np.int64)
    joined = joined_classes(contexts(blocks, known, class_), context_weights(matrix, class_))
    rows = [(bytearray(w), n, int(of[i])) for i, (w, n) in enumerate(top)]
    named = docs.sparkSession.createDataFrame(rows, "word binary, n long, class int")  # <= CLUSTERED rows
    vocabulary = scratch.keep(joined.union(named), "vocabulary")
    scratch.drop(counts)
    total, types, once = np.zeros(_ALL), np.zeros(_ALL), 0
    for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).collect():
        total[r["class"]], types[r["class"]] = r["n"], r["v"]
        once += r["once"]
    end = int(of[-1])
    if texts:
        total[end] += texts
        types[end] += 1
    types[_UNKNOWN] = 1
    return {"blocks": blocks, "local": local, "vocabulary": vocabulary, "total": total, "types": types, "end": end, "texts": texts, "once": once}


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text.

    Learns from the texts whose crc32(doc_id as text) mod 5 is not 1. Needs
    ``doc_id`` and ``text``; other columns are ignored. Null texts are empty
    ones, which have one token, the end; null ids count as the empty id for the
    fold; repeated rows get equal scores and count as often as they occur; an empty table gives
    an empty result; without training texts every token is unknown.
    """
    scratch = Scratch(docs.sparkSession, "brown")
    model = train(docs, scratch)
    total, types, end, texts = model["total"], model["types"], model["end"], model["texts"]
    tokens, kinds = int(total.sum()), int(types.sum()) - 1
    room = tokens + 0.5 * (kinds + 1)
    asked = model["local"].select("block", "code", "word").join(model["vocabulary"], "word").select("block", "code", "n", "class")

    def score(own: pa.Table, words: pa.Table) -> pa.Table:
        b = _Block(own.to_pylist()[0])
        count, class_ = np.zeros(len(b.words) + 1, np.int64), np.full(len(b.words) + 1, _UNKNOWN, np.int64)
        at = words.column("code").to_numpy()
        count[at], class_[at] = words.column("n").to_numpy(), words.column("class").to_numpy()
        count[-1], class_[-1] = texts, end if texts else _UNKNOWN
        n, c = count[b.codes], class_[b.codes]
        known = n > 0
        base = np.log10((n + 0.5) / room)
        emit = np.where(known, np.log10((n + 0.5) / (total[c] + 0.5 * types[c])), 0.0)
        sums = [np.add.reduceat(x, b.starts) for x in (known.astype(np.int64), base, emit)]
        classes = c.astype(np.uint8)
        runs = [classes[s : e + 1].tobytes() for s, e in zip(b.starts.tolist(), b.ends.tolist())]
        columns = [pa.array(b.ids, pa.int64()), pa.array(b.held.tolist(), pa.bool_()), pa.array(b.sizes + 1), *map(pa.array, sums), pa.array(runs, pa.binary())]
        return pa.Table.from_arrays(columns, names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "classes"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"
    scored = model["blocks"].groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, schema)
    scored = scratch.keep(scored, "scored")
    moves = np.zeros((_ALL, _ALL))
    for r in _transitions(scored, end if texts else _UNKNOWN).collect():  # at most _ALL ** 2 rows
        moves[r["code"] // _ALL, r["code"] % _ALL] = r["n"]
    unknown = (model["once"] + 0.5) / (tokens + 0.5)  # what words seen once had, a share of the tokens
    share = total + 0.5 * types
    share[_UNKNOWN] = 0
    share /= max(share.sum(), 1.0)
    with np.errstate(divide="ignore"):
        step = np.log10((1 - min(unknown, 1.0)) * (moves + BACKOFF * share[None, :]) / (moves.sum(axis=1, keepdims=True) + BACKOFF))
    step[:, _UNKNOWN] = np.log10(unknown)
    first = end if texts else _UNKNOWN

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for run in batch.column("classes").to_pylist():
                c = np.frombuffer(run, np.uint8)
                moved.append(float(step[np.concatenate([[first], c[:-1]]), c].sum()))
            whole = pa.array(batch.column("emitted").to_numpy() + np.array(moved))
            columns = [*(batch.column(c) for c in names[:4]), pa.array(np.full(batch.num_rows, tokens, np.int64)), batch.column("base_score"), whole]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:4], "train_tokens", "base_score", "score"])

    return scored.mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _transitions(scored: DataFrame, first: int) -> DataFrame:
    """(code, n): class bigrams of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(_ALL * _ALL, np.int64)
            for classes in batch.column(0).to_pylist():
                c = np.frombuffer(classes, np.uint8).astype(np.int64)
                found += np.bincount(np.concatenate([[first], c[:-1]]) * _ALL + c, minlength=_ALL * _ALL)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["code", "n"])

    return scored.where("not held_out").select("classes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
