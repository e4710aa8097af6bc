"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text that begin equal factors of ``length`` words form a class.
Going from one length to the next splits a class by the classes of the
positions that follow its members, and it is enough to look at those that follow into a class which
was itself split off: of the parts of one class all but the largest are put on the work
list (the smaller-half strategy), so that a position is moved no oftener than the
logarithm of the text's length.

Each class is a linked list in text order. Two neighbours of one list at a distance
equal to the length are a square whose root is primitive; as a member's distance to its neighbour only grows, a square is
noted when that distance changes or when the lengths end. Squares of one length at
consecutive places are one run. A run has three periods or more, so lengths up to a
third of a text suffice, and neighbours farther apart than that are cut into classes of their own.

A number of texts is refined at once, with a word of its own after each, so that the number of
array operations depends on the longest and not on how many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import slices, text_bytes

#: Words and periods of a run at least.
LEAST, TIMES = 24, 3
#: Words of the texts that are refined at once, but for a longer single text, and of a text that waits for other long ones.
TOGETHER, LONG = 1 << 20, 1 << 11

_RUNS = "array<struct<start: long, length: long, period: long>>"


class _Partition:
    """The classes of positions with equal factors; see the module's text."""

    def __init__(self, words: np.ndarray, limit: np.ndarray):
        """words: a number for each position; limit: the greatest distance of neighbours, by position."""
        n = len(words)
        self.limit, self.level = limit, 1
        self.cls = np.zeros(n, np.int64)
        self.sizes = np.zeros(2 * n + 2, np.int64)
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.since = np.ones(n, np.int64)
        self.free = 0
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(words, kind="stable")
        self.work = np.sort(self._make(order, words[order]))

    def _starts(self, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether a group begins at each of ``at``, which is in order of key and position."""
        starts = np.ones(len(at), bool)
        starts[1:] = (key[1:] != key[:-1]) | (at[1:] - at[:-1] > self.limit[at[1:]])
        return starts

    def _make(self, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """New classes of the positions ``at``, in order of key and position; those that have a neighbour."""
        starts = self._starts(at, key)
        own = np.cumsum(starts) - 1 + self.free
        count = np.bincount(own - self.free)
        if self.free + len(count) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros(max(len(self.sizes), len(count)), np.int64)])
        self.sizes[self.free : self.free + len(count)] = count
        self.cls[at] = own
        self.free += len(count)
        inner = ~starts[1:]
        after = np.where(np.append(inner, False), np.append(at[1:], -1), -1)
        self._note(at, after)
        self.next[at] = after
        self.prev[at] = np.where(np.append(False, inner), np.append(-1, at[:-1]), -1)
        return at

    def _note(self, at: np.ndarray, after: np.ndarray) -> None:
        """Squares that end as the neighbours of ``at`` become ``after`` at this level."""
        far = self.next[at] - at
        changed = self.next[at] != after
        held = changed & (self.since[at] <= far) & (far < self.level)
        if held.any():
            self.squares.append((at[held], far[held]))
        self.since[at[changed]] = self.level

    def refine(self) -> None:
        """From factors of ``level`` words to those of one more."""
        at = self.work[self.work > 0] - 1
        at = at[self.sizes[self.cls[at]] > 1]
        self.level += 1
        if not len(at):
            self.work = at
            return
        old, into = self.cls[at], self.cls[at + 1]
        order = np.argsort(old * (self.free + 1) + into, kind="stable")
        at, old, into = at[order], old[order], into[order]
        key = np.cumsum(np.append(True, (old[1:] != old[:-1]) | (into[1:] != into[:-1]))) - 1
        first = np.flatnonzero(self._starts(at, key))
        group = np.cumsum(np.bincount(first, minlength=len(at))) - 1
        size = np.diff(np.append(first, len(at)))
        parent = old[first]
        heads = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        family = np.cumsum(np.bincount(heads, minlength=len(first))) - 1
        rest = self.sizes[parent[heads]] - np.add.reduceat(size, heads)
        best = np.lexsort((size, family))[np.append(heads[1:], len(first)) - 1]
        largest = size[best]
        stays = np.zeros(len(first), bool)  # nothing else of its class is left: it keeps the class's number
        stays[best[rest == 0]] = True
        quiet = stays.copy()  # the largest parts, which need no place on the work list
        quiet[best[rest < largest]] = True
        moved = ~stays[group]
        left = self._rest(at, old, family[group], (rest > 0) & (rest < largest))
        gone = at[moved]
        self._unlink(gone)
        np.subtract.at(self.sizes, old[moved], 1)
        self._make(gone, group[moved])
        self.work = np.sort(np.concatenate([at[~quiet[group]], left]))

    def _rest(self, at: np.ndarray, old: np.ndarray, family: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The members that are not among ``at`` of the families ``wanted``, each of which has fewer of them than of the others."""
        own = np.sort(at[wanted[family]])
        if not len(own):
            return own
        listed = np.zeros(len(self.cls), bool) if len(own) * 64 > len(self.cls) else None
        if listed is not None:
            listed[own] = True
            known = lambda x: listed[x]
        else:
            known = lambda x: own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
        found = []
        for links in (self.next, self.prev):  # forward from each, then back from each class's first
            x = links[own]
            x = x[x >= 0]
            while len(x := x[~known(x)]):
                if links is self.prev:
                    x = np.unique(x)
                found.append(x)
                x = links[x]
                x = x[x >= 0]
        return np.unique(np.concatenate(found)) if found else own[:0]

    def _unlink(self, gone: np.ndarray) -> None:
        """Take ``gone`` out of their lists."""
        by_place = np.sort(gone)
        known = lambda x: (x >= 0) & (by_place[np.minimum(np.searchsorted(by_place, x), len(by_place) - 1)] == x)
        ends = gone[~known(self.next[gone])]
        begins = gone[~known(self.prev[gone])]
        # Stretches of neighbours: each begin has its end, in order of class and place.
        begins, ends = (x[np.lexsort((x, self.cls[x]))] for x in (begins, ends))
        before, after = self.prev[begins], self.next[ends]
        has = before >= 0
        self._note(before[has], after[has])
        self.next[before[has]] = after[has]
        has = after >= 0
        self.prev[after[has]] = before[has]

    def all_squares(self, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, half) of the squares with primitive halves of at most ``top`` words."""
        while self.level < top and len(self.work):
            self.refine()
        linked = np.flatnonzero(self.next >= 0)
        far = self.next[linked] - linked
        held = (self.since[linked] <= far) & (far <= self.level)
        self.squares.append((linked[held], far[held]))
        place, half = (np.concatenate(x) for x in zip(*self.squares))
        return place, half


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not any(len(t) >= least for t in texts):
        return out
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in (*t, b" ")), np.int64, n)
    text = np.repeat(np.arange(len(texts)), sizes)
    words = text * (len(numbers) + 1) + words  # the word after each text occurs in it once
    limit = np.repeat((sizes - 1) // times, sizes)
    place, half = _Partition(words, limit).all_squares(int(limit.max()))
    order = np.lexsort((place, half))
    place, half = place[order], half[order]
    first = np.flatnonzero(np.append(True, (half[1:] != half[:-1]) | (place[1:] != place[:-1] + 1))) if len(place) else place
    count = np.diff(np.append(first, len(place)))
    place, half = place[first], half[first]
    length = count + 2 * half - 1
    good = (length >= least) & (length >= times * half)
    place, half, length = place[good], half[good], length[good]
    for i, s, m, p in sorted(zip(text[place].tolist(), (place - starts[text[place]]).tolist(), length.tolist(), half.tolist()), key=lambda r: (r[0], r[1], r[3])):
        out[i].append((s, m, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return [w for w, d in zip(words, drop.tolist()) if not d]


def words_of(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words between ASCII white space."""
    return text.split()


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, words: Callable[[int | None, bytes], list[bytes]] = words_of) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) by start and period, and collapsed, the text without later periods.

    A run is a stretch of words with a smallest period, of at least ``least`` words and ``times`` periods, that
    no neighbour extends. Needs ``doc_id`` and ``text``; other columns are ignored. Null, empty and blank texts have no
    words and no runs, and an empty ``collapsed``; a null id stays null; repeated rows are judged each by itself; an empty
    table gives an empty result. A text is refined whole, however long. ``words`` makes the words of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list] = {False: [], True: []}  # long texts need many more lengths, so they wait for each other
        held = {False: 0, True: 0}
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(doc_id, text)
                long = len(own) >= LONG
                waiting[long].append((doc_id, own))
                held[long] += len(own)
                if held[long] >= TOGETHER:
                    yield from found(waiting[long])
                    waiting[long], held[long] = [], 0
        for rest in waiting.values():
            yield from found(rest)

    def found(texts: list[tuple[int | None, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        every = runs_of([own for _, own in texts], least, times)
        for at in range(0, len(texts), 256):
            rows = [
                (doc_id, len(own), [{"start": s, "length": m, "period": p} for s, m, p in runs], b" ".join(collapsed(own, runs)))
                for (doc_id, own), runs in zip(texts[at : at + 256], every[at : at + 256])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_words", "runs", "collapsed"])

    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.list_(entry), pa.binary()]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed binary")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, the first of equals; null without runs."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(more(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """``start,length,period`` of each run and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def run_report(docs: DataFrame, words: Callable[[int | None, bytes], list[bytes]] = words_of) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent, and digests of the runs and of the collapsed text."""
    own = periodic_runs(docs, words=words).withColumn("best", strongest(F.col("runs")))
    return own.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
