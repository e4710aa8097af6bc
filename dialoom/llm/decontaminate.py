"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's fingerprints are the smallest hash of five words in every run of six
such hashes, so any ten words that two texts share leave a common fingerprint.
Items of fewer than ten words are one window each and are looked up at their own length.
A bitmap of the benchmark's fingerprints, of bounded size, goes into the scan and lets most
fingerprints of the corpus fall there; those left are joined with the benchmark's. Texts with
a common one are candidates, each text once whatever the number of its copies. There each hit
is extended to whole windows, which pass a second such bitmap and are compared word by word.
The plan is the same for any size of benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, let, text_bytes, text_key, with_bit, without_rows

WINDOW = 10
GRAM = 5
#: Words of 64 bits in the largest bitmap that goes along with a plan.
BITMAP = 1 << 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lowered, _GAPS, -1), lambda w: w != "")


def _starts(items: Column, n: int) -> Column:
    """Where runs of ``n`` items start, from 1."""
    return F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words."""
    return let(words, lambda w: F.transform(_starts(w, n), lambda i: F.xxhash64(F.slice(w, i, n))))


def fingerprints(grams: Column, span: int = WINDOW - GRAM + 1) -> Column:
    """The smallest of each ``span`` neighbouring hashes."""
    return let(grams, lambda g: F.transform(_starts(g, span), lambda i: F.array_min(F.slice(g, i, span))))


def _prints_at(words: Column, n: int) -> Column:
    """Fingerprints by which windows of ``n`` words are found."""
    return fingerprints(_grams(words, GRAM)) if n == WINDOW else _grams(words, n)


class _Bitmap:
    """A bitmap of hashes as an expression: 64 bits for each of them and ``BITMAP`` words at most, so that a plan holds it."""

    def __init__(self, hashes: DataFrame, name: str):
        self.words = 1 << min(BITMAP.bit_length() - 1, max(4, hashes.count().bit_length()))
        bit = F.pmod(F.col(name), F.lit(64 * self.words)).alias("bit")
        own = hashes.select(bit).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
        words = [0] * self.words
        for r in own.collect():  # at most self.words rows
            words[r["word"]] = r["mask"]
        self.bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to a constant

    def may_hold(self, x: Column) -> Column:
        bit = F.pmod(x, F.lit(64 * self.words))
        return F.getbit(F.get(self.bits, F.shiftright(bit, 6).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1


def _windows(words: Column, n: int) -> Column:
    return let(words, lambda w: F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " ")))


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, window) of all items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    long_ = items.where(F.size("words") >= WINDOW).select("item_id", F.lit(WINDOW).alias("n"), F.explode(_windows(F.col("words"), WINDOW)).alias("window"))
    short = items.where(F.size("words") < WINDOW).select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("window"))
    return long_.union(short)


def _prints_of_windows(windows: DataFrame) -> DataFrame:
    """(n, print): what a text that holds one of the windows has among its fingerprints of length n."""
    split = windows.select("n", F.split("window", " ").alias("words")).distinct()
    long_ = split.where(F.col("n") == WINDOW).select("n", F.explode(_prints_at(F.col("words"), WINDOW)).alias("print"))
    return long_.union(split.where(F.col("n") < WINDOW).select("n", F.xxhash64("words").alias("print"))).distinct()


def _judged(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, key, n_words) for each document, and (key, hit, items) of the texts with a hit."""
    windows = scratch.keep(_item_windows(benchmark).distinct(), "windows")
    prints = scratch.keep(_prints_of_windows(windows), "prints")
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect())  # at most ten lengths
    known = _Bitmap(prints, "print")

    def scan(words: Column) -> Column:
        found = [F.filter(_prints_at(words, n), known.may_hold) for n in lengths]
        return F.struct(F.size(words).cast("long").alias("n_words"), F.array_distinct(F.concat(*found) if found else F.array().cast("array<bigint>")).alias("prints"))

    key = text_key("text").alias("key")
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, let(words_of(F.col("text")), scan).alias("s"))
    base = scratch.keep(scanned.select("doc_id", "key", "s.*"), "scanned")
    maybe = base.where(F.size("prints") > 0).select("key", F.explode("prints").alias("print")).distinct()
    candidates = scratch.keep(maybe.join(prints.select("print").distinct(), "print", "left_semi").select("key").distinct(), "candidates")
    texts = with_bit(docs.select(key, text_bytes("text").alias("text")), candidates, "likely").where("likely")
    texts = texts.join(candidates, "key", "left_semi").groupBy("key").agg(F.first("text").cast("string").alias("text"))
    texts = scratch.keep(texts.select("key", words_of(F.col("text")).alias("words")), "texts")
    sought = scratch.keep(windows.select("n", "window").distinct().withColumn("hash", F.xxhash64("window")), "sought")
    held = _Bitmap(sought, "hash")
    spots = texts.select("key", F.lit(0).alias("at"), F.lit("").alias("window"), F.lit(0).alias("n")).limit(0)
    for n in lengths:
        placed = F.transform(_windows(F.col("words"), n), lambda w, i: F.struct(i.alias("at"), w.alias("window")))
        spots = spots.union(texts.select("key", F.inline(F.filter(placed, lambda x: held.may_hold(F.xxhash64(x["window"])))), F.lit(n).alias("n")))  # noqa: B023  used at once
    hits = scratch.keep(spots.join(sought, ["n", "window"], "left_semi"), "hits")
    before = F.max(F.col("at") + F.col("n")).over(Window.partitionBy("key").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest(F.coalesce(before, F.lit(0)), F.col("at")))
    marked = hits.withColumn("new", new).groupBy("key").agg(F.sum("new").cast("long").alias("hit"))
    listed = hits.select("key", "n", "window").distinct().join(windows, ["n", "window"]).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = scratch.keep(marked.join(listed, "key", "left"), "found")
    scratch.only(base, found)
    return base.select("doc_id", "key", "n_words"), found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row for each row of ``docs``.

    Needs ``doc_id`` and ``text`` of the documents, ``item_id`` and ``text`` of the
    benchmark; other columns are ignored. Null and empty texts have no
    words; items without words have no window; items without an id mark words
    but are not listed; equal ids are one item. A text's result is that of each row that holds it, so
    repeated rows and null ids keep a result of their own.
    """
    base, found = _judged(docs, benchmark, Scratch(docs.sparkSession, "winnowing"))
    items, hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("hit", F.lit(0)).cast("long")
    return base.join(found, "key", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no hit, with all their columns.

    The text alone decides, whatever the id: rows without one, and each text of a repeated id, are judged for
    themselves. Null and empty texts stay; repeated rows go or stay together; columns of any name are
    passed through; an empty table stays so, and without a benchmark all rows stay.
    """
    scratch = Scratch(docs.sparkSession, "winnowing")
    base, found = _judged(docs, benchmark, scratch)
    bad = found.where("hit > 0").select("key", F.lit(True).alias("bad"))
    verdicts = base.select("key").distinct().join(bad, "key", "left").select("key", F.coalesce("bad", F.lit(False)).alias("bad"), F.lit(False).alias("single"))
    return without_rows(docs, text_key("text"), scratch.keep(verdicts, "verdicts"), scratch)
