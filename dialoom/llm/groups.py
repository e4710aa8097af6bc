"""Similarity join of documents by a matrix of tokens and groups.

A document's tokens are the hashes of its distinct three-word shingles; equal sets are one class. All tokens have
one order: first the rare ones by their hashes, then the ``COMMON`` commonest by theirs. Two sets with
``100 * both >= percent * either`` share a token among the first ``n - ceil(percent * n / 100) + 1`` of each, and at
the first that they share neither place lies so deep that too few tokens are left. Nothing else is joined.

Similar classes form groups. The member of a token's list that has most common tokens leads it; members that are
linked with a leader are one component, so that pairs among them need no look. Each component, and the classes that
come nearest to the same leader without a link, are parted into groups of about ``MEMBERS`` classes. A row of the matrix
is a token's group. A class asks for the groups at its own first tokens, but not for those that lie in its component as
a whole. Each group stores the union of its members' tokens up to a hash that all members' stored tokens reach: tokens of
the query below it that the union lacks are in no member, which bounds the overlap with each of them. Groups that
the bound can't exclude are opened: their members of other components are compared with the query.

Comparisons reject by two more lower bounds of the difference, the parities of hashed tokens and the tokens of lowest
hash, and then count on whole sets. No step loses a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, extended_components
from .minhash import _digest, row_key, shingle_hashes
from .scratch import Scratch, slices, text_bytes, with_bit

WORDS = 3
#: Tokens that come last in the order, at most: half a megabyte on each executor.
COMMON = 1 << 16
#: Classes that have a token among their lowest before it counts as common.
OFTEN = 8
#: Classes and tokens of a group, about.
MEMBERS, TOKENS = 64, 1 << 16
_TOP = (1 << 63) - 1


def prefix_length(n: int, percent: int) -> int:
    """How many first tokens of a set of ``n`` hold one of any partner's, in any order that all sets share."""
    return n - -(-percent * n // 100) + 1


def first_tokens(tokens: np.ndarray, n: int, length: int, common: np.ndarray) -> tuple[np.ndarray, int] | None:
    """The first ``length`` of a set of ``n`` and how many of them are rare, from its lowest ``tokens``; None if these don't tell."""
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    known = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
    rare = tokens[~known][:length]
    if len(rare) < length and len(tokens) < n:
        return None
    return np.concatenate([rare, tokens[known][: length - len(rare)]]), len(rare)


def parities(tokens: np.ndarray) -> np.ndarray:
    """256 bits: whether an odd number of tokens falls on each. Sets differ by no fewer tokens than their bits."""
    odd = np.bincount((tokens & 255).astype(np.int64), minlength=256).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def token_sets(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, the row's key, set size, digest (null: linked with nothing), lowest tokens and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, low, odd = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                full = np.unique(shingle_hashes(text, WORDS))
                n.append(len(full))
                digest.append(_digest(full) if len(full) and doc_id is not None else None)
                low.append(full[: max(2 * prefix_length(len(full), percent), 16)].copy())
                odd.append(parities(full))
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, longs), pa.array(odd, longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "digest", "low", "odd"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text_bytes("text").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, key struct<a: long, b: long>, n long, digest binary, low array<long>, odd array<long>")


def _whole_sets(docs: DataFrame, wanted: DataFrame, kind: str, value: Callable[[np.ndarray], list | np.ndarray]) -> DataFrame:
    """(cid, value) with ``value`` of the whole set of each class in ``wanted`` (cid, key), from a text of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [value(np.unique(shingle_hashes(text, WORDS))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cid", kind])

    texts = docs.where("doc_id is not null").select(row_key().alias("key"), text_bytes("text").alias("text"))
    texts = with_bit(texts, wanted, "likely").where("likely").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return texts.join(wanted, "key").select("cid", "text").mapInArrow(run, f"cid long, {kind} array<long>")


def _common_tokens(classes: DataFrame) -> np.ndarray:
    """The tokens that most classes have among their lowest, ``COMMON`` at most; their number doesn't grow with the corpus."""
    counted = classes.select(F.explode("low").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= OFTEN)
    return np.array(sorted(r["token"] for r in counted.orderBy(F.desc("df"), "token").limit(COMMON).select("token").collect()), np.int64)


def _postings(docs: DataFrame, classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(token, cid, n, place, weight): the first tokens of each class that another class has too; the weight counts common ones."""
    common = docs.sparkSession.sparkContext.broadcast(_common_tokens(classes))

    def told(tokens: np.ndarray, n: int) -> list | np.ndarray:
        first = first_tokens(tokens, n, prefix_length(n, percent), common.value)
        return np.zeros(0, np.int64) if first is None else np.append(first[0], first[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            first = [told(np.array(low, np.int64), n) for low, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(first, pa.list_(pa.int64()))], names=["cid", "n", "first"])

    told_low = scratch.keep(classes.select("cid", "low", "n").mapInArrow(run, "cid long, n long, first array<long>"), "first")
    open_ = scratch.keep(classes.select("cid", "key").join(told_low.where("size(first) = 0"), "cid").select("cid", "key", "n"), "unsure")
    whole = scratch.keep(_whole_sets(docs, open_.select("cid", "key"), "first", lambda full: told(full, len(full))), "first")
    first = told_low.where("size(first) > 0").union(whole.join(open_, "cid").select("cid", "n", "first"))
    length = F.size("first") - 1
    rows = first.select("cid", "n", (length - F.element_at("first", -1)).alias("weight"), F.posexplode(F.slice("first", 1, length)).alias("place", "token"))
    rows = scratch.keep(rows.withColumn("place", F.col("place") + 1), "postings")
    shared = rows.groupBy("token").agg(F.count("*").alias("m")).where("m >= 2").select("token")
    out = scratch.keep(rows.join(shared, "token"), "postings")
    scratch.drop(told_low, open_, whole, rows)
    return out


def _may_meet(percent: int, n: str, place: str, other_n: str, other_place: str) -> Column:
    """Whether sets of these sizes may be linked if the first token that they share has these places."""
    left = 1 + F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place))
    return (100 + percent) * left >= percent * (F.col(n) + F.col(other_n))


def _of(classes: DataFrame, named: DataFrame, *columns: str) -> DataFrame:
    """The classes that ``named`` (cid) may name, by a bitmap, so that the columns of most others aren't shuffled."""
    key = F.struct(F.xxhash64("cid").alias("a")).alias("key")
    return with_bit(classes.select("cid", *columns, key), named.select(key), "likely").where("likely").select("cid", *columns)


def _few_differ(percent: int, differ: Column) -> Column:
    return (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))


def _compare(docs: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b, both, linked) of those pairs whose differences the bounds don't exclude, on whole sets."""

    def side(x: str, own: DataFrame, *columns: str) -> DataFrame:
        return own.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}{x}") for c in columns])

    bits = sum((F.bit_count(F.get("odda", F.lit(i)).bitwiseXOR(F.get("oddb", F.lit(i)))) for i in range(4)), F.lit(0))
    near = pairs.join(side("a", classes, "n", "odd"), "a").join(side("b", classes, "n", "odd"), "b").where(_few_differ(percent, bits))
    near = scratch.keep(near.select("a", "b", "na", "nb"), "alike")
    alike = [_of(classes, near.select(F.col(x).alias("cid")), "low") for x in "ab"]
    lows = near.join(side("a", alike[0], "low"), "a").join(side("b", alike[1], "low"), "b")
    reach = F.least(*[F.when(F.size(f"low{x}") < F.col(f"n{x}"), F.element_at(f"low{x}", -1)).otherwise(_TOP) for x in "ab"])
    lacks = lambda x, y: F.size(F.filter(F.array_except(f"low{x}", f"low{y}"), lambda t: t <= F.col("reach")))
    lows = lows.withColumn("reach", reach).where(_few_differ(percent, lacks("a", "b") + lacks("b", "a")))
    likely = scratch.keep(lows.select("a", "b", "na", "nb"), "likely")
    named = likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct()
    wanted = scratch.keep(classes.select("cid", "key").join(named, "cid"), "wanted")
    sets = scratch.keep(_whole_sets(docs, wanted, "full", lambda full: full), "sets")
    sided = likely
    for x in "ab":
        sided = sided.join(sets.select(F.col("cid").alias(x), F.col("full").alias(f"f{x}")), x)
    both = F.size(F.array_intersect("fa", "fb")).cast("long")
    found = sided.select("a", "b", both.alias("both"), (F.col("na") + F.col("nb")).alias("n"))
    found = found.select("a", "b", "both", (F.col("both") * (100 + percent) >= percent * F.col("n")).alias("linked"))
    found = scratch.keep(found, "compared")
    scratch.drop(near, likely, wanted, sets)
    return found


def _leader_pairs(postings: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(cid, head): the members of each token's list with the one that has most common tokens."""
    top = F.max(F.struct("weight", (-F.col("cid")).alias("minus"), "n", "place")).alias("top")
    heads = postings.groupBy("token").agg(top)
    heads = heads.select("token", (-F.col("top.minus")).alias("head"), F.col("top.n").alias("head_n"), F.col("top.place").alias("head_place"))
    met = postings.join(heads, "token").where(F.col("cid") != F.col("head")).where(_may_meet(percent, "n", "place", "head_n", "head_place"))
    return scratch.keep(met.select("cid", "head").distinct(), "leaders")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _partition(classes: DataFrame, compared: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, grp, root): each class's group and component."""
    ends = compared.select(F.col("a").alias("cid"), F.col("b").alias("head"), "both").union(compared.select("b", "a", "both"))
    nearest = ends.groupBy("cid").agg(F.max(F.struct("both", (-F.col("head")).alias("minus"))).alias("top")).select("cid", (-F.col("top.minus")).alias("head"))
    rooted = classes.select("cid", "n").join(joined.withColumnRenamed("node", "cid"), "cid", "left").join(nearest, "cid", "left")
    band = F.floor(F.log(F.col("n").cast("double")) * 8)
    home = F.struct(F.coalesce("root", "head", "cid").alias("home"), F.col("root").isNotNull().alias("linked"), band.alias("band"))
    placed = rooted.select("cid", "n", F.coalesce("root", "cid").alias("root"), home.alias("home"))
    parts = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / TOKENS))
    placed = placed.join(placed.groupBy("home").agg(parts.alias("parts")), "home")
    part = F.pmod(F.xxhash64("cid"), F.col("parts"))
    return scratch.keep(placed.select("cid", F.xxhash64("home", part).alias("grp"), "root"), "groups")


def _open_groups(classes: DataFrame, postings: DataFrame, groups: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(q, cid): each class with the members of other components in those groups whose bound doesn't exclude them."""
    rooted = postings.join(groups, "cid")
    mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    rooted = scratch.keep(rooted.join(mixed, "token").select("token", "cid", "n", "place", "grp", "root"), "open")
    # A row of the matrix: a group that has a token first in members of some sizes; the best place of any member counts.
    row = (F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("place").alias("best"))
    matrix = rooted.groupBy("token", "grp").agg(*row)
    asking = rooted.select("token", F.col("cid").alias("q"), F.col("n").alias("nq"), F.col("place").alias("pq"), F.col("root").alias("rq"))
    met = asking.join(matrix, "token").where("(lo <> rq or hi <> rq) and nq <= n_hi").where(percent * F.col("n_lo") <= 100 * F.col("nq"))
    least = F.greatest("nq", "n_lo")
    left = 1 + F.least(F.col("nq") - F.col("pq"), F.col("n_hi") - F.col("best"))
    met = met.where((100 + percent) * left >= percent * (F.col("nq") + least)).select("q", "nq", "grp").distinct()
    met = scratch.keep(met, "met")
    members = scratch.keep(groups.join(met.select("grp").distinct(), "grp", "left_semi"), "members")
    members = members.join(_of(classes, members, "n", "low"), "cid")
    reach = F.min(F.when(F.size("low") < F.col("n"), F.element_at("low", -1)).otherwise(_TOP)).alias("reach")
    sizes = members.groupBy("grp").agg(reach, F.min("n").alias("least_n"))
    union = members.select("grp", F.explode("low").alias("token")).groupBy("grp").agg(F.collect_set("token").alias("tokens"))
    stored = scratch.keep(sizes.join(union, "grp"), "unions")
    own = _of(classes, met.select(F.col("q").alias("cid")), "n", "low").select(F.col("cid").alias("q"), "low", F.when(F.size("low") < F.col("n"), F.element_at("low", -1)).otherwise(_TOP).alias("own"))
    asked = met.join(own, "q").join(stored, "grp")
    lacking = F.size(F.filter(F.array_except("low", "tokens"), lambda t: t <= F.least("reach", "own")))
    may = (100 + percent) * (F.col("nq") - lacking) >= percent * (F.col("nq") + F.greatest("nq", "least_n"))
    chosen = scratch.keep(asked.where(may).select("q", "nq", "grp"), "chosen")
    inside = groups.join(classes.select("cid", "n"), "cid")
    roots = groups.select(F.col("cid").alias("q"), F.col("root").alias("rq"))
    pairs = chosen.join(roots, "q").join(inside, "grp").where("root <> rq and (n > nq or n = nq and cid > q)").where(percent * F.col("n") <= 100 * F.col("nq"))
    out = scratch.keep(pairs.select("q", "cid"), "pairs")
    scratch.drop(rooted, met, stored, chosen)
    return out


def class_components(docs: DataFrame, classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(node, root) of the classes that have links; see the module's text."""
    postings = _postings(docs, classes, scratch, percent)
    compared = _compare(docs, classes, _ordered(_leader_pairs(postings, scratch, percent), "cid", "head"), scratch, percent)
    joined = scratch.keep(connected_components(compared.where("linked").select("a", "b"), scratch), "joined")
    groups = _partition(classes, compared, joined, scratch)
    pairs = _ordered(_open_groups(classes, postings, groups, scratch, percent), "q", "cid")
    pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
    found = _compare(docs, classes, pairs, scratch, percent)
    return scratch.keep(extended_components(joined, found.where("linked").select("a", "b"), scratch), "joined")


def similar_documents(docs: DataFrame, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id, a row for each row of ``docs``.

    Links need ``100 * both >= percent * either`` on the whole sets of distinct three-word shingles. Needs ``doc_id`` and
    ``text``; other columns, whatever their names, are ignored. Null, empty and blank texts have no shingles and are
    linked with nothing, as are rows without an id: their component is their own id. Repeated rows and equal sets
    are one class. A text of any length is one set; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    base = scratch.keep(token_sets(docs, percent), "sets")
    first = F.min(F.struct("doc_id", "key")).alias("first")
    grouped = base.where("digest is not null").groupBy("digest").agg(first, *[F.first(c).alias(c) for c in ("n", "low", "odd")])
    column = ("digest", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("key"), "n", "low", "odd")
    classes = scratch.keep(grouped.select(F.monotonically_increasing_id().alias("cid"), *column), "classes")
    roots = class_components(docs, classes, scratch, percent)
    linked = classes.select(F.col("cid").alias("node"), "digest", "first_id").join(roots, "node", "left")
    linked = linked.withColumn("root", F.coalesce("root", "node"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("least"))
    named = scratch.keep(linked.join(least, "root").select("digest", "least"), "named")
    scratch.only(base, named)
    out = base.select("doc_id", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
