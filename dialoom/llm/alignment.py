"""Alignment of two tokenizers' tokens over the same bytes.

Where tokens of both sides end at one byte, a text is cut into groups. Ends are sums of the tokens' sizes, and those of a
slice of texts are searched at once, as texts end together on both sides. A group links each of its A tokens with each of
its B tokens. That much is done where a text is tokenised, on arrays of numbers; all that concerns several texts is Spark's.

How many documents hold a pair linked is counted over the corpus. The counts come back to the
documents without moving their links: the commonest ``COMMON`` pairs are broadcast, whatever the corpus, and summed in
place; only links of rarer pairs are joined by their pair, of which none is frequent.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, slices

#: Pairs whose counts are broadcast, at most: 65,536 rows of three numbers.
COMMON = 1 << 16
#: From so many bytes without a blank on, a text goes to the tokenizer that takes long words in its stride.
LONG_WORD = 2_000
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable ones for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """A byte-level BPE file; entries are merged in the order of their ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        letters = byte_letters()
        special = {t.content for t in self.own.get_added_tokens_decoder().values()}
        entries = {bytes(letters[c] for c in s): i for s, i in self.own.get_vocab().items() if s not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=_WORDS, mergeable_ranks=entries, special_tokens={})
        self.entries = [b""] * (max(entries.values()) + 1)
        for raw, i in entries.items():
            self.entries[i] = raw
        self.sizes = np.array([len(e) for e in self.entries], np.int32)
        self._long = re.compile(rf"\S{{{LONG_WORD}}}").search

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.own.encode(t, add_special_tokens=False).ids if self._long(t) else self.fast.encode_ordinary(t) for t in texts]


class PieceTokens:
    """A model of pieces in which U+2581 stands for a space and <0xHH> for a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.entries = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(e) for e in self.entries], np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


_LOADED: dict[tuple, object] = {}


def _loaded(kind: type, path: str):
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids one after another, and where each text's begin, with the end."""
    starts = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), starts


def cut(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last tokens, on either side, of the groups of two rows of tokens that cover the same bytes, by the tokens' sizes.

    The rows may be those of many texts one after another: texts end together on both sides, so that no group passes an end.
    """
    a_ends, b_ends = np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64)
    at = np.searchsorted(b_ends, a_ends)
    a_last = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends) if len(b_ends) else np.zeros(0, np.int64)
    return a_last, at[a_last]


def crossed(a: np.ndarray, a_first: np.ndarray, a_last: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_last: np.ndarray) -> np.ndarray:
    """The pairs, A's id above B's, of each A with each B token of its group, group after group."""
    m, n = a_last - a_first + 1, b_last - b_first + 1
    of_a = np.repeat(n, m)  # partners of each A token
    inner = np.arange(of_a.sum()) - np.repeat(np.cumsum(of_a) - of_a, of_a)
    return (np.repeat(a, of_a).astype(np.int64) << 32) + b[np.repeat(np.repeat(b_first, m), of_a) + inner]


def _firsts(last: np.ndarray) -> np.ndarray:
    return np.append(0, last[:-1] + 1) if len(last) else last


def _encoded(batch: pa.RecordBatch, a: ByteTokens, b: PieceTokens) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both sides' ids of the texts in the batch's second column; none where either side doesn't give back the bytes."""
    none, left, right = np.zeros(0, np.int32), [], []
    texts = [t or "" for t in batch.column(1).to_pylist()]
    for text, x, y in zip(texts, a.encode([" " + t for t in texts]), b.encode(texts)):
        raw = b" " + text.encode()
        good = text and b"".join(map(a.entries.__getitem__, x)) == raw and b"".join(map(b.entries.__getitem__, y)) == raw
        left.append(np.array(x, np.int32) if good else none)
        right.append(np.array(y, np.int32) if good else none)
    return left, right


class _Groups:
    """The groups of a batch: ids of both sides, the groups' last tokens, and each text's first group, with the end."""

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray):
        (self.a, self.a_at), (self.b, self.b_at) = _flat(left), _flat(right)
        self.a_last, self.b_last = cut(a_sizes[self.a], b_sizes[self.b])
        self.a_first, self.b_first = _firsts(self.a_last), _firsts(self.b_last)
        self.at = np.searchsorted(self.a_last, self.a_at)
        self.sizes = np.diff(self.at)

    def links(self) -> pa.Array:
        """The links of each text."""
        each = (self.a_last - self.a_first + 1) * (self.b_last - self.b_first + 1)
        ends = np.append(0, np.cumsum(each))[self.at]
        pairs = crossed(self.a, self.a_first, self.a_last, self.b, self.b_first, self.b_last)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs))

    def digests(self, a_told: np.ndarray, b_told: np.ndarray) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text, '' without tokens; from the ids as written with a comma behind."""
        n, m = len(self.a), len(self.b)
        parts = np.empty(n + m, object)
        # A's tokens of a group stand before B's; those of a group's end carry the mark that follows.
        a_group, b_group = np.searchsorted(self.a_last, np.arange(n)), np.searchsorted(self.b_last, np.arange(m))
        a_mark, b_mark = np.zeros(n, np.int8), np.zeros(m, np.int8)
        a_mark[self.a_last] = b_mark[self.b_last] = 1
        ends = self.at[1:][self.sizes > 0] - 1  # the texts' last groups
        b_mark[self.b_last[ends]] = 2
        a_place = np.arange(n) + self.b_first[a_group]
        b_place = np.arange(m) + self.a_last[b_group] + 1
        parts[a_place], parts[b_place] = a_told[a_mark, self.a], b_told[b_mark, self.b]
        told = parts.tolist()
        return [hashlib.sha256(b"".join(told[i:j])).hexdigest() if j > i else "" for i, j in itertools.pairwise((self.a_at + self.b_at).tolist())]


def _written(ids: int, marks: tuple[bytes, ...]) -> np.ndarray:
    """The decimals of all ids, each with each mark behind it."""
    return np.array([[b"%d%s" % (i, mark) for i in range(ids)] for mark in marks], object)


_TOLD: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _told(byte_path: str, piece_path: str, a: ByteTokens, b: PieceTokens) -> tuple[np.ndarray, np.ndarray]:
    if (byte_path, piece_path) not in _TOLD:
        _TOLD[byte_path, piece_path] = _written(len(a.sizes), (b",", b"|")), _written(len(b.sizes), (b",", b";", b""))
    return _TOLD[byte_path, piece_path]


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b and groups, the tokens of both sides cut where both end, a row for each row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts, and texts that either side
    does not give back byte by byte (U+2581 is one that B reads as a space), have no tokens and no groups. Ids may be
    null or repeated; texts of any length are taken whole; an empty table stays so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(ByteTokens, byte_path), _loaded(PieceTokens, piece_path)
        for batch in slices(batches, 64):
            g = _Groups(*_encoded(batch, a, b), a.sizes, b.sizes)
            sides = [pa.ListArray.from_arrays(pa.array(np.append(0, last + 1), pa.int32()), pa.array(ids)) for last, ids in ((g.a_last, g.a), (g.b_last, g.b))]
            groups = pa.ListArray.from_arrays(pa.array(g.at, pa.int32()), pa.StructArray.from_arrays(sides, names=["a", "b"]))
            sizes = (pa.array(np.diff(x), pa.int32()) for x in (g.a_at, g.b_at))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, groups], names=["doc_id", "n_a", "n_b", "groups"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, n_a int, n_b int, groups array<struct<a: array<int>, b: array<int>>>")


def linked(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, links and groups_sha256 of the groups that ``align`` returns, which themselves aren't moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(ByteTokens, byte_path), _loaded(PieceTokens, piece_path)
        told = _told(byte_path, piece_path, a, b)
        for batch in slices(batches, 64):
            g = _Groups(*_encoded(batch, a, b), a.sizes, b.sizes)
            sizes = (pa.array(x, pa.int32()) for x in (np.diff(g.a_at), np.diff(g.b_at), g.sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, g.links(), pa.array(g.digests(*told), pa.string())], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, n_a int, n_b int, n_groups int, links array<long>, groups_sha256 string")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) over the rows of ``links`` (links): how many rows hold a pair, and whether no pair of its A id is in more."""
    held = links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    same = Window.partitionBy(F.shiftright("pair", 32))  # as many rows as B has ids, at most
    return held.withColumn("best", F.col("n") == F.max("n").over(same))


def _common(counts: DataFrame, most: int) -> DataFrame:
    """The commonest pairs, ``most`` at most: those from a count on that few enough reach."""
    step = F.floor(F.log2("n") * 4)
    above, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):  # some 250 rows
        above += r["m"]
        if above > most:
            break
        least = r["least"]
    return counts.where(F.lit(False) if least is None else F.col("n") >= least)


def with_counts(links: DataFrame, counts: DataFrame, scratch: Scratch, most: int = COMMON) -> DataFrame:
    """(row, n_best, count_sum) over the links of each row of ``links`` (row, links) that has any."""
    common = F.broadcast(_common(counts, most))
    placed = links.select("row", F.explode("links").alias("pair")).join(common, "pair", "left")
    rare = F.when(F.col("n").isNull(), F.col("pair"))
    sums = placed.groupBy("row", rare.alias("rare")).agg(F.count("*").alias("m"), F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    sums = scratch.keep(sums, "sums")
    late = sums.where("rare is not null").select("row", "m", F.col("rare").alias("pair")).join(counts, "pair")
    late = late.select("row", F.when(F.col("best"), F.col("m")).otherwise(0).alias("n_best"), (F.col("m") * F.col("n")).alias("count_sum"))
    return sums.where("rare is null").select("row", "n_best", "count_sum").union(late).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_report(docs: DataFrame, byte_path: str, piece_path: str, most: int = COMMON) -> DataFrame:
    """doc_id, numbers of tokens, groups and links, their corpus-wide counts, and a digest of the groups; see ``align``.

    ``n_best`` counts the links whose pair is in as many documents as any pair of its A id, ties included; ``count_sum`` adds
    over all links how many documents hold their pair. Repeated rows are documents each. Without tokens all are 0 and the digest is ''.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = linked(docs, byte_path, piece_path)
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    counts = scratch.keep(pair_counts(rows), "counts")
    sums = scratch.keep(with_counts(rows.select("row", "links"), counts, scratch, most), "totals")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.withColumn("n_links", F.size("links")).join(sums, "row", "left").select("doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256")
