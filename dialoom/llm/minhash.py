"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is the hashes of its distinct five-word shingles, and its sketch
the k smallest of them. Inverted lists of the retained values give the
candidates; the sketch of the union estimates their similarity; the full sets
confirm each link.

Two sets of similarity 0.85 share at least ``s`` values of their sketches (for
sketches that hold the whole set, certainly; for longer ones all but about one
pair in two millions), so that they share one of the ``k - s + 1`` values that come
first in any common order. Ordering by how many sketches hold a value
puts common phrases last: lists of frequent phrases are not
searched for the sake of the phrase.

Within a list no pairs are multiplied out at first. The member whose sketch is the
commonest is the pivot and is compared with all others, and so is a second one outside the
pivot's component. Copies of one text are one component after that, whatever their number.

What is left are members of one list in different components. Lists of at most ``FEW``
are compared pair by pair. In longer ones, a large group of near copies on both sides of
the threshold leaves all its pairs open, and neither sketches nor distances to
the pivot tell them apart. Their differences do: with D the symmetric difference of a member and
the pivot p, two members differ by ``|Dx ^ Dy|``, so that a link needs an overlap of at least
``(|Dx| + |Dy| - t) / 2`` with ``t`` the difference that their sizes allow. That is a set
join again, on sets without what the whole group shares: a link's first common value, in order of
frequency, lies in a prefix of both. Partners of a member outside p's component
share about half of their own D with it, so their prefix is short. Before these are joined, the members that
have a value of D in their prefixes are compared with the one of them nearest to the pivot and with the nearest outside
that one's component: near copies of one text join its component so, and only members of different ones are left. Members farther than ``FAR`` from p take
the empty set for p; those about the border are in both groups. No link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, extended_components
from .scratch import Scratch, slices, text_bytes, text_key, with_bit, without_rows

WORDS = 5
SKETCH = 32
#: Least number of shared sketch values of a pair at the threshold; Binomial(32, 0.85) is below it five times in 10^7.
SHARED = 16
#: Longest list whose open pairs are compared one by one; in longer ones the differences from the list's pivot are searched.
FEW = 8
#: Jaccard distance from the pivot up to which differences from it are used, and beyond it the sets themselves.
FAR = 0.5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int = WORDS) -> np.ndarray:
    """63-bit hashes of the shingles in text order; fewer words than ``width`` are one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(b"\0".join(words), 1) >> 1], np.int64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += _scramble(hashed[i : n - width + 1 + i] * _MIX[i % len(_MIX)] + np.uint64(i))
    return (_scramble(total) >> np.uint64(1)).astype(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return blake2b(values.tobytes(), digest_size=16).digest()


def row_key() -> Column:
    """What tells rows apart by id and text: a struct of longs."""
    text = text_key("text")
    return F.struct(F.xxhash64(F.col("doc_id").cast("long"), text["a"]).alias("a"), text["b"].alias("b"))


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """doc_id, the row's key, set size, a digest of the set (null: linked with nothing) and its k smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, n, digest, least = batch.column(0).to_pylist(), [], [], []
            for doc_id, text in zip(ids, batch.column(2).to_pylist()):
                full = np.unique(shingle_hashes(text))
                n.append(len(full))
                digest.append(_digest(full) if len(full) and doc_id is not None else None)
                least.append(full[:k].copy())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(least, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "n", "digest", "sketch"],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text_bytes("text").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, key struct<a: long, b: long>, n long, digest binary, sketch array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, full) of the classes in ``wanted`` (cid, key), from a text of the class; a bitmap spares most other texts the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "full"])

    texts = docs.where("doc_id is not null").select(row_key().alias("key"), text_bytes("text").alias("text"))
    texts = with_bit(texts, wanted, "likely").where("likely").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return texts.join(wanted, "key").select("cid", "text").mapInArrow(run, "cid long, full array<long>")


def _least_shared(size: Column, k: int, percent: int, shared: int) -> Column:
    """How many sketch values a linked pair shares at least, by the size of a sketch."""
    return F.when(size < k, F.floor((size * percent + 99) / 100)).otherwise(shared)


def _compare(docs: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, both, either) of those pairs that may have a similarity of 0.7 or more, on full sets."""
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, F.greatest(F.size("sa"), F.size("sb")))
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    near = pairs.join(one, "a").join(two, "b").where("10 * least(na, nb) >= 7 * greatest(na, nb)")
    near = scratch.keep(near.where(shared * 100 >= 40 * F.size(union)).select("a", "b", "na", "nb"), "near")
    named = near.select(F.col("a").alias("cid")).union(near.select("b")).distinct()
    wanted = scratch.keep(classes.select("cid", "key").join(named, "cid"), "wanted")
    sets = scratch.keep(_full_sets(docs, wanted), "sets")
    left, right = sets.select(F.col("cid").alias("a"), F.col("full").alias("fa")), sets.select(F.col("cid").alias("b"), F.col("full").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb")).cast("long")
    sized = near.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.col("na") + F.col("nb")).alias("n"))
    found = scratch.keep(sized.select("a", "b", "both", (F.col("n") - F.col("both")).alias("either")).distinct(), "compared")
    scratch.drop(near, wanted, sets)
    return found


def near_components(docs: DataFrame, classes: DataFrame, scratch: Scratch, k: int, percent: int, shared: int) -> DataFrame:
    """(node, root) of the classes that have links; see the module's text."""
    postings = classes.select("cid", F.size("sketch").cast("byte").alias("size"), F.explode("sketch").alias("value"))
    common = postings.groupBy("value").agg(F.count("*").alias("df")).where("df >= 2")
    by_class = Window.partitionBy("cid")
    place = F.col("size") - F.count("*").over(by_class) + F.row_number().over(by_class.orderBy("df", "value"))
    prefix = F.col("size") - _least_shared(F.col("size"), k, percent, shared) + 1
    lists = postings.join(common, "value").withColumn("place", place).withColumn("weight", F.sum("df").over(by_class))
    lists = scratch.keep(lists.where(F.col("place") <= prefix).select("value", "cid", "weight"), "lists")
    is_link = F.col("both") * 100 >= F.col("either") * percent
    compared = []

    def settle(pairs: DataFrame, joined: DataFrame | None = None) -> DataFrame:
        """The components ``joined``, if any, with the links among ``pairs``."""
        for old in compared:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        found = _compare(docs, classes, pairs, scratch)
        compared.append(found)
        links = found.where(is_link).select("a", "b")
        after = extended_components(joined, links, scratch) if joined is not None else connected_components(links, scratch)
        return scratch.keep(after, "joined")

    def mixed(joined: DataFrame) -> DataFrame:
        """The lists whose members are in several components, with the roots and the list's length."""
        heads = joined.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
        rooted = stars.join(joined.withColumnRenamed("node", "cid"), "cid", "left").join(heads, "head", "left")
        rooted = rooted.select("value", "cid", "weight", F.coalesce("root", "cid").alias("root"), "head", F.coalesce("head_root", "head").alias("head_root"))
        kinds = rooted.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
        return scratch.keep(rooted.join(kinds.select("value", "m"), "value"), "open")

    def pivot() -> Column:
        return F.max(F.struct("weight", (-F.col("cid")).alias("minus"))).alias("top")

    heads = lists.groupBy("value").agg(pivot(), F.count("*").alias("m")).where("m >= 2").select("value", (-F.col("top.minus")).alias("head"))
    stars = scratch.keep(lists.join(heads, "value"), "stars")
    joined = settle(_ordered(stars, "cid", "head"))
    others = mixed(joined).where("root <> head_root and m > 2")
    seconds = others.groupBy("value").agg(pivot()).select("value", (-F.col("top.minus")).alias("second"))
    joined = settle(_ordered(others.join(seconds, "value"), "cid", "second"), joined)
    open_ = mixed(joined)
    one, two = (open_.where(F.col("m") <= FEW).select("value", *(F.col(c).alias(f"{c}_{x}") for c in ("cid", "root"))) for x in "ab")
    few = one.join(two, "value").where("cid_a < cid_b and root_a <> root_b").select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
    groups = open_.where(F.col("m") > FEW).select("head", "cid", "root", (F.col("root") == F.col("head_root")).alias("settled")).distinct()
    ranked = _ranked_differences(docs, classes, scratch.keep(groups, "groups"), scratch, percent)
    joined = settle(scratch.keep(_nearest_pairs(ranked), "nearest"), joined)
    ranked = _rooted(ranked, joined, scratch)
    many = scratch.keep(_ordered(_meeting(ranked.where("short"), ranked.where("not near or not settled"), percent), "cid", "other"), "many")
    return settle(scratch.keep(few.union(many).distinct(), "last"), joined)


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _ranked_differences(docs: DataFrame, classes: DataFrame, groups: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The prefixes of the members' differences from their ``head``, as rows of one token.

    ``groups`` (head, cid, root, settled) names the members; each was compared with its head, and is
    settled if it is in the head's component. The prefixes are those of exact set joins,
    on differences from the head; see the module's text.
    """
    named = groups.select("cid").union(groups.select("head")).distinct()
    wanted = scratch.keep(classes.select("cid", "key").join(named, "cid"), "wanted")
    sets = scratch.keep(_full_sets(docs, wanted), "sets")
    mine, base = sets.select("cid", F.col("full").alias("x")), sets.select(F.col("cid").alias("head"), F.col("full").alias("p"))
    both = groups.join(mine, "cid").join(base, "head").withColumn("diff", F.array_union(F.array_except("x", "p"), F.array_except("p", "x")))
    away = 2 * F.size("diff") / (F.size("x") + F.size("p") + F.size("diff"))  # the Jaccard distance: diff / union
    span = 1 - percent / 100
    column = ("head", "cid", "root", "settled", F.size("x").alias("n"), F.size("p").alias("n_head"))
    cases = F.array(
        F.when(away <= FAR + 1e-9, F.struct(F.lit(True).alias("near"), F.col("diff"))),
        F.when(away >= FAR - span - 1e-9, F.struct(F.lit(False).alias("near"), F.col("x").alias("diff"))),
    )
    cases = both.select(*column, F.explode(F.filter(cases, F.isnotnull)).alias("case")).select(*column[:4], "n", "n_head", "case.*")
    cases = scratch.keep(cases.withColumn("d", F.size("diff")).where("d > 0"), "differences")
    tokens = cases.select("head", "near", "cid", "d", "n", "n_head", "root", "settled", F.explode("diff").alias("token"))
    common = tokens.groupBy("head", "near", "token").agg(F.count("*").alias("df")).where("df >= 2")
    own = Window.partitionBy("head", "near", "cid")
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token"))
    ratio = (100 - percent) / (100 + percent)
    # Least overlaps of the differences: with any partner, and with one that isn't linked to the head.
    least = F.greatest(F.lit(1), F.col("d") - F.floor((F.col("n") + F.col("n") * 100 / percent) * ratio + 1e-9))
    apart = F.when(F.col("near"), F.ceil((F.col("d") + ratio * (F.col("n_head") - F.col("n"))) / 2 - 1e-9)).otherwise(1)
    ranked = tokens.join(common, ["head", "near", "token"]).withColumn("place", place)
    ranked = ranked.withColumn("short", F.col("place") <= F.col("d") - F.greatest(least, apart) + 1)
    ranked = ranked.where(F.col("place") <= F.col("d") - least + 1)
    return scratch.keep(ranked.select("head", "near", "token", "cid", "root", "settled", "d", "n", "place", "short"), "ranked")


def _nearest_pairs(ranked: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with those two of its token that are nearest to the head: the first, and the first outside that one's component."""
    key = ["head", "near", "token"]
    nearest = F.min(F.struct("d", "cid", "root"))
    first = ranked.groupBy(*key).agg(nearest.alias("first"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*key, "first")
    others = ranked.join(first, key).where(F.col("root") != F.col("first.root"))
    second = others.groupBy(*key).agg(nearest.alias("second"))
    ones = others.select("cid", F.col("first.cid").alias("other"))
    twos = others.join(second, key).where(F.col("root") != F.col("second.root")).select("cid", F.col("second.cid").alias("other"))
    return _ordered(ones.union(twos), "cid", "other")


def _rooted(ranked: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """``ranked`` with the components of now; members that have joined their head's component are settled."""
    roots = joined.select(F.col("node").alias("cid"), F.col("root").alias("new"))
    heads = joined.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    now = ranked.join(roots, "cid", "left").join(heads, "head", "left").withColumn("root", F.coalesce("new", "cid"))
    now = now.withColumn("settled", F.col("root") == F.coalesce("head_root", "head"))
    return scratch.keep(now.select(*ranked.columns), "ranked")


def _meeting(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(cid, other) with different roots that meet at a token in the prefixes that their sizes ask for."""
    ratio = (100 - percent) / (100 + percent)
    left, right = left.alias("l"), right.alias("r")
    within = F.floor((F.col("l.n") + F.col("r.n")) * ratio + 1e-9)
    overlap = F.greatest(F.lit(1), F.ceil((F.col("l.d") + F.col("r.d") - within) / 2))
    may = F.col("l.root") != F.col("r.root")
    for key in ("head", "near", "token"):
        may &= F.col(f"l.{key}") == F.col(f"r.{key}")
    for side in "lr":
        may &= F.col(f"{side}.place") <= F.col(f"{side}.d") - overlap + 1
    return left.join(right, may).select(F.col("l.cid").alias("cid"), F.col("r.cid").alias("other"))


def least_shared(percent: int, k: int = SKETCH, risk: float = 1e-6) -> int:
    """The most sketch values that a pair at the threshold shares but for ``risk``: Binomial(k, percent / 100) is below it no oftener."""
    p, below, s = percent / 100, 0.0, 0
    while s < k and (below := below + comb(k, s) * p**s * (1 - p) ** (k - s)) <= risk:
        s += 1
    return s


def _grouped(docs: DataFrame, percent: int, k: int, shared: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The sketches, and for each set's digest its component's smallest id and the key of that id's row."""
    base = scratch.keep(sketches(docs, k), "sketches")
    first = F.min(F.struct("doc_id", "key")).alias("first")
    grouped = base.where("digest is not null").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    grouped = grouped.select(F.monotonically_increasing_id().alias("cid"), "digest", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("key"), "n", "sketch")
    classes = scratch.keep(grouped, "classes")
    roots = near_components(docs, classes, scratch, k, percent, shared)
    linked = roots.join(classes.select(F.col("cid").alias("node"), "digest", F.struct("first_id", "key").alias("first")), "node")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = scratch.keep(linked.join(smallest, "root").select("digest", "least"), "linked")
    named = classes.select("digest", F.struct("first_id", "key").alias("first")).join(linked, "digest", "left")
    named = scratch.keep(named.select("digest", F.coalesce("least", "first").alias("least")).select("digest", "least.*"), "named")
    scratch.only(base, named)
    return base, named


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SKETCH, shared: int = SHARED) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of ``docs``.

    Links need ``100 * both >= percent * either`` on the full sets. Needs
    ``doc_id`` and ``text``; other columns are ignored. Null, empty and blank texts have
    no shingles and rows without an id are linked with nothing (their
    component is their own id); all of them are kept. Repeated rows and equal
    sets are one class. A text of any length is one set.
    """
    base, named = _grouped(docs, percent, k, shared, Scratch(docs.sparkSession, "minhash"))
    own = F.coalesce("first_id", "doc_id")
    return base.select("doc_id", "n", "digest").join(named.select("digest", "first_id"), "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")
    )


def dedup(docs: DataFrame, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """One row of each component of near-duplicates, with all columns of ``docs``: that of smallest id.

    Rows are told apart by id and text, so that a repeated id loses only those of its texts that others hold. Of rows
    equal in both one stays. Rows without an id take part; they rank behind all others and are
    told apart by their texts (ids are taken to be below 2^62). Null, empty and blank texts have no shingles and all stay. Further
    columns, whatever their names, are passed through; an empty table stays so.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    unnamed = F.lit(2**62) + F.pmod(F.xxhash64(text_bytes("text")), F.lit(2**61))
    named_rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("doc_id"), "text")
    base, named = _grouped(named_rows, percent, k, least_shared(percent, k), scratch)
    rows = base.where("digest is not null").select("digest", "key").join(named.select("digest", F.col("key").alias("first")), "digest")
    verdicts = rows.groupBy("key").agg(F.first(F.col("key") != F.col("first")).alias("bad"), (F.count("*") > 1).alias("single"))
    verdicts = scratch.keep(verdicts, "verdicts")
    text = text_key("text")
    key = F.struct(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), unnamed), text["a"]).alias("a"), text["b"].alias("b"))
    return without_rows(docs, key, verdicts, scratch)
