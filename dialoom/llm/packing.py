"""Best-fit packing of tokenised documents into fixed-length sequences.

Token lengths lie in 1..capacity, so the corpus enters the plan only as a
histogram of at most ``capacity`` counters. The plan is made on the driver from
that histogram: the longest remaining piece opens a sequence, its gap is looked
up among single lengths, sums of two and sums of three (exact complements under
the counts that are left), and only where no exact complement exists the longest
fitting piece goes in and the search is repeated for the smaller gap. Every
step places a whole run of equal sequences at once, so the number of steps
depends on the capacity and not on the corpus.

Pieces find their place by their rank among pieces of equal length. Ranks are
counted inside each input partition while tokenising and completed by the
per-partition counts, so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import array
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, slices, text_bytes

CAPACITY = 4096
END_ID = 1
#: Words kept per Python worker and generation; bounds the cache to some 80 MB.
CACHED_WORDS = 200_000

_PUNCTUATION = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class _WordIds(dict):
    """Word -> its token ids as little-endian 32-bit bytes.

    The tokenizer's pre-tokenizer never joins text across white space and
    splits letters from ASCII punctuation, so ids of a text are the ids of its
    words, and those of ``word,`` are those of ``word`` and of ``,``.
    """

    def __init__(self, tokenizer, most: int = CACHED_WORDS):
        super().__init__()
        self.most = most
        self.old: dict[bytes, bytes] = {}
        self.tokenizer = tokenizer

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(_PUNCTUATION)
            if stem and len(stem) < len(word) and stem[-1] in _LETTERS and b"<|" not in word:
                ids = self[stem] + self[word[len(stem) :]]
            else:
                raw = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
                ids = array.array("I", raw).tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


_CACHES: dict[str, _WordIds] = {}


def _word_ids(path: str, most: int = CACHED_WORDS) -> _WordIds:
    if path not in _CACHES:
        from tokenizers import Tokenizer

        _CACHES[path] = _WordIds(Tokenizer.from_file(path))
    _CACHES[path].most = most
    return _CACHES[path]


def encode_text(text: bytes, ids: _WordIds, end_id: int = END_ID) -> bytes:
    """All ids of a UTF-8 text and the end id, as little-endian 32-bit bytes.

    ASCII capitals are folded beforehand, as the tokenizer does itself, unless
    the text could hold a special token, which is matched before folding.
    """
    if b"<|" not in text:
        text = text.lower()
    return b"".join(map(ids.__getitem__, text.split())) + end_id.to_bytes(4, "little")


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each pattern."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    no_pair: set[int] = set()  # counts only fall, so a sum without a pair stays so

    def pair(total: int, used: Counter) -> list[int] | None:
        if total < 2 or total in no_pair:
            return None
        small = left[1 : total // 2 + 1] > 0
        large = left[total - 1 : total - 1 - len(small) : -1] > 0
        found = np.flatnonzero(small & large) + 1
        if total % 2 == 0 and len(found) and found[-1] == total // 2 and left[total // 2] < 2:
            found = found[:-1]
        if not len(found):
            no_pair.add(total)
            return None
        for a in found.tolist():
            b = total - a
            need = used + Counter((a, b))
            if left[a] >= need[a] and left[b] >= need[b]:
                return [b, a]
        return None

    def complement(gap: int, used: Counter) -> list[int] | None:
        if left[gap] > used[gap]:
            return [gap]
        if two := pair(gap, used):
            return two
        first = -(-gap // 3)
        for a in (np.flatnonzero(left[first : gap - 1] > 0)[::-1] + first).tolist():
            if left[a] > used[a] and (two := pair(gap - a, used + Counter((a,)))):
                return [a, *two]
        return None

    plan: list[tuple[tuple[int, ...], int]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        pattern, gap = [top], capacity - top
        while gap:
            used = Counter(pattern)
            if exact := complement(gap, used):
                pattern += exact
                break
            fits = next((a for a in (np.flatnonzero(left[1 : gap + 1] > 0)[::-1] + 1).tolist() if left[a] > used[a]), 0)
            if not fits:
                break
            pattern.append(fits)
            gap -= fits
        used = Counter(pattern)
        times = int(min(left[a] // n for a, n in used.items()))
        for a, n in used.items():
            left[a] -= times * n
        plan.append((tuple(pattern), times))


def _runs(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences, sorted by (length, rank)."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, cached: int = CACHED_WORDS) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, with their rank among equal lengths of the partition."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = _word_ids(tokenizer_path, cached), Counter(), TaskContext.get().partitionId()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encode_text(text, words))
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc_id, i, at // 4, length, zlib.crc32(own), part, seen[length], *([bytes(own)] if keep_ids else [])))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text")).mapInArrow(pieces, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, cached: int = CACHED_WORDS) -> DataFrame:
    """Place every token of every document into sequences of at most ``capacity`` tokens.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null or empty
    text is one piece that holds the end id alone; null ids stay null; repeated
    rows are packed as often as they occur; an empty table gives an empty
    result. Texts of any length are cut into full pieces and one rest. Ties
    between equal lengths are broken by input partition and position.
    ``keep_ids`` adds the token ids as little-endian 32-bit ``ids``; ``cached`` is how many
    words each worker keeps the ids of, some 400 bytes each, and changes no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(tokenize_pieces(docs, tokenizer_path, capacity, keep_ids, cached), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(
        F.col("part").alias("at_part"), F.col("length").alias("at_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs = spark.sparkContext.broadcast(_runs(pack_plan(histogram, capacity)))
    ranked = pieces.join(starts, (F.col("part") == F.col("at_part")) & (F.col("length") == F.col("at_length"))).withColumn(
        "rank", F.col("first") + F.col("part_rank")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = runs.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(run["key"], (length << 44) + rank, side="right") - 1
            placed = [run["sequence"][at] + rank - run["rank"][at], run["offset"][at]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, placed)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema)
