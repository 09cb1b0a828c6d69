"""Exact Jaccard join of documents' word n-gram sets, size-aware: small sets enumerate fixed-size subsets, large sets scan inverted lists.

Two sets of a and b elements with a Jaccard similarity of num/den or more share at least o(a, b) = ceil(num (a + b) / (num + den))
elements. So they share a subset of exactly that size, and, in any one order of all elements, enough of their first elements.
Small sets emit all subsets of the sizes that some partner asks for; large sets post their first elements in an order that puts
frequent elements last, the most frequent at the very end. Where enumeration stops is chosen by the cost that a sample of the corpus shows. Either way a key is
shared by every pair that links; what shares a key is then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import connected_components, forget, mix64, prepare, slices, stored, utf8

#: One document in so many is looked at to find frequent n-grams and the boundary; neither changes the result, only the work.
SAMPLE_EVERY = 50
#: Most n-grams that are held to be frequent, which bounds what is broadcast (8 bytes each).
FREQUENT = 200_000
#: Sizes up to which enumeration is considered.
LARGEST_SMALL = 28
#: Bytes of text whose words are hashed at a time.
TEXT_BYTES = 1 << 20
#: Documents of a list that are compared as one block; a longer list is cut into blocks, each pair of which is a key of its own.
LIST_BLOCK = 2048
#: Rounds that connect near copies before all remaining pairs are compared.
ROUNDS = 3
#: A set asks for one more shared list entry for so many elements, and posts as many more.
EXTRA_EVERY = 40

_rng = np.random.RandomState(20240131)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 18)
        _POWERS, _INVERSES = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS, _INVERSES


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span."""
    powers, inverses = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[: len(data)])])
    return mix64((total[end] - total[begin]) * inverses[begin] + (end - begin).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (a run of bytes other than ASCII white space) and the number of words of each text."""
    n = len(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.concatenate([[True], blank])[:n] if n else np.zeros(0, bool)
    after = np.concatenate([blank[1:], [True]]) if n else np.zeros(0, bool)
    begin = np.flatnonzero(~blank & (before | cut[:n]))
    end = np.flatnonzero(~blank & (after | cut[1:])) + 1
    return hash_spans(data, begin, end), np.diff(np.searchsorted(begin, at))


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = 3) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; of a text with fewer words, the whole sequence as one."""
    h, count = words(data, at)
    tags = [mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(n + 1)]
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        rolled += h[k : k + len(rolled)] * tags[k]
    rolled = mix64(rolled + tags[n])
    out, i = [], 0
    for c in count.tolist():
        if c >= n:
            s = np.sort(rolled[i : i + c - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            v = sum((int(h[i + k]) * int(tags[k]) for k in range(c)), c * 0xD1B54A32D192ED03) & (2**64 - 1)
            out.append(mix64(np.array([v], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        i += c
    return out


def overlap(a: int, b: int, num: int, den: int) -> int:
    """Elements that sets of a and b elements share at least if they link."""
    return -(-num * (a + b) // (num + den))


def subset_sizes(s: int, num: int, den: int, largest: int) -> list[int]:
    """Sizes of the subsets that a set of s elements enumerates: what its partners of at most `largest` elements ask for."""
    return sorted({overlap(s, b, num, den) for b in range(-(-num * s // den), min(largest, den * s // num) + 1) if b} & set(range(1, s + 1)))


def n_subsets(s: int, num: int, den: int) -> int:
    from math import comb

    return sum(comb(s, c) for c in subset_sizes(s, num, den, den * s // num))


def listed(s: int, num: int, den: int) -> int:
    """List entries of a set of s elements."""
    return min(s, s - -(-num * s // den) + 1 + s // EXTRA_EVERY)


def asked(n: Column | str) -> Column:
    """Keys that a set of n elements shares at least with each set of n or more that it links with."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n <= LARGEST_SMALL, F.lit(1)).otherwise(1 + F.floor(n / EXTRA_EVERY))


class Keys:
    """The keys of a set, given the boundary and the frequent elements."""

    def __init__(self, boundary: int, frequent: np.ndarray, num: int, den: int) -> None:
        order = np.argsort(frequent)
        # the place of each frequent element from the least frequent one, as `frequent` begins with the most frequent
        self.x, self.frequent, self.place, self.num, self.den = boundary, frequent[order], -order, num, den

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n, out = len(s), []
        if n and -(-self.num * n // self.den) <= self.x:
            each = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            whole = int(each.sum(dtype=np.uint64))
            for c in subset_sizes(n, self.num, self.den, self.x if n > self.x else 10**9):
                sums = [whole - sum(map(int, gone)) + c for gone in combinations(each, n - c)]
                out.append(mix64(np.array([v & (2**64 - 1) for v in sums], np.uint64)))
        if n and self.den * n // self.num > self.x:
            p = listed(n, self.num, self.den)
            if len(self.frequent):
                i = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
                often = self.frequent[i] == s
                s = np.concatenate([s[~often], s[often][np.argsort(self.place[i[often]], kind="stable")]])
            out.append(s[:p])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """512 bits of each set as eight longs: for each of 512 hash values, whether an odd number of elements has it.

    Two sketches never differ in more bits than the sets have elements that aren't common.
    """
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (mix64(np.concatenate(sets)) & np.uint64(511)).astype(np.int64) if sets else np.zeros(0, np.int64)
    odd = np.bincount(doc * 512 + at, minlength=512 * len(sets)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing(a: str, b: str) -> Column:
    """Bits in which two sketch columns differ."""
    out = F.lit(0)
    for i in range(8):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, whatever the order of its elements."""
    d1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return d1, np.array([mix64(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def _sets(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, n, d1, d2, s): every row's set with its size and digest."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES):
                sets = shingle_sets(*utf8(pc.ascii_lower(part.column("t"))), n)
                size = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(size), *map(pa.array, digests(sets)), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), flat)], [key, "n", "d1", "d2", "s"])

    return rows.mapInArrow(run, f"`{key}` {kind}, n bigint, d1 bigint, d2 bigint, s array<bigint>")


def _info(rows: DataFrame, key: str, n: int, keys: Keys) -> DataFrame:
    """(key, n, d1, d2, keys, sketch): size and 128-bit digest of every row's set, its keys, and its parity sketch."""
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES):
                sets = shingle_sets(*utf8(pc.ascii_lower(part.column("t"))), n)
                own = [shared.value(s) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, digests(sets)), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(np.arange(0, 8 * len(sets) + 1, 8, dtype=np.int32), sketches(sets))], [key, "n", "d1", "d2", "keys", "sketch"])

    return rows.mapInArrow(run, f"`{key}` {kind}, n bigint, d1 bigint, d2 bigint, keys array<bigint>, sketch array<bigint>")


def plan_keys(rows: DataFrame, key: str, n: int, num: int, den: int) -> Keys:
    """Frequent elements and the boundary, from one document in SAMPLE_EVERY.

    An element that several sampled sets hold counts as frequent (the FREQUENT most frequent at most). A set of s elements
    costs as many rows as it has subsets if it enumerates, and as many as it has list entries, each times one plus the mean
    length of the lists of elements that aren't frequent, if it scans; small are all sizes up to the first at which
    enumeration costs more.
    """
    sets = _sets(rows.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE_EVERY)) == 0), key, n).where("n > 0")
    counts = sets.dropDuplicates(["s"]).select(F.explode("s").alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    counts = stored(counts.where("c > 1").unionByName(counts.where("c = 1").groupBy().agg(F.lit(0).cast("long").alias("v"), F.sum("c").alias("c")).where("c > 0")), "counts")
    frequent = [r.v for r in counts.where("c >= 3 and v <> 0").orderBy(F.desc("c"), "v").limit(FREQUENT).select("v").collect()]
    pairs, single = counts.agg(F.count_if(F.expr("c = 2 and v <> 0")), F.sum(F.when(F.col("v") == 0, F.col("c")))).first()
    forget(counts)
    mean = 2 * (pairs or 0) * SAMPLE_EVERY / max(1, (single or 0) + 2 * (pairs or 0))
    small = 0
    while small < LARGEST_SMALL and n_subsets(small + 1, num, den) <= listed(small + 1, num, den) * (1 + mean):
        small += 1
    return Keys(small, np.array(frequent, np.int64).view(np.uint64), num, den)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 8, den: int = 10, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of documents whose sets of n-word shingles have a Jaccard similarity of num/den or more.

    A distinct set is known by an id, so that rows of one key with different texts are what they are. Returns (members, links,
    components): members (key, n_shingles, set) with the id of the row's set, null for empty ones; links (a, b), a < b, between
    ids, enough of them to connect all that link or, with `every`, all of them, for which no pair is passed over because its sets
    are connected already; components (set, component) of every id: the smallest key of all rows whose sets it reaches. Texts that are null or
    hold no word have an empty set and no links; rows with equal texts are equal sets; repeated rows are each a member.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("t"))
    info = stored(_info(rows, key, n, plan_keys(rows, key, n, num, den)), "sets")
    classes = info.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(key).alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = info.select(key, "n", "d1", "d2").hint("merge").join(classes.select("d1", "d2", "n", "id").hint("merge"), ["d1", "d2", "n"], "left").select(key, F.col("n").alias("n_shingles"), F.col("id").alias("set"))
    members = stored(members, "members")
    forget(info)
    posted = classes.select(F.col("id").alias("doc"), "n", F.explode("keys").alias("k"))
    live = posted.groupBy("k").count().where("count > 1").select("k")  # a document posts a key once
    live = stored(posted.hint("merge").join(live.hint("merge"), "k", "left_semi"), "lists")
    # what links shares as many keys as its size asks for; whatever has fewer live keys goes, and its keys may die with it
    for _ in range(2):
        enough = live.groupBy("doc").agg(F.count("*").alias("m"), F.first("n").alias("n")).where(F.col("m") >= asked("n")).select("doc")
        kept = live.hint("merge").join(enough.hint("merge"), "doc", "left_semi")
        shared = kept.groupBy("k").count().where("count > 1")
        old, live = live, stored(kept.hint("merge").join(shared.hint("merge"), "k").select("doc", "n", "k"), "lists")
        forget(old)

    # the sets of all that are left, once: of the rows that have a wanted set's smallest key those whose set it is
    wanted = live.select("doc").distinct()
    named = classes.select("id", "rep", "d1", "d2", "n").hint("merge").join(wanted.hint("merge"), F.col("id") == F.col("doc"), "left_semi")
    named = stored(named, "wanted")
    some = rows.hint("merge").join(named.select(F.col("rep").alias("_rep")).distinct().hint("merge"), F.col(key).eqNullSafe(F.col("_rep")), "left_semi")
    sets = _sets(some, key, n).hint("merge").join(named.select("id", "d1", "d2", "n", "rep").hint("merge"), ["d1", "d2", "n"]).where(F.col(key).eqNullSafe(F.col("rep")))
    sets = stored(sets.select(F.col("id").alias("doc"), "n", "s").dropDuplicates(["doc"]), "live-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        return pairs.hint("merge").join(a.hint("merge"), "a").hint("merge").join(b.hint("merge"), "b").withColumn("i", common).where(den * F.col("i") >= num * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")

    def sized(x: str, y: str) -> Column:
        """The sizes' ratio that every link has."""
        nx, ny = F.col(f"n{x}"), F.col(f"n{y}")
        return (den * nx >= num * ny) & (den * ny >= num * nx)

    def may_link(x: str, y: str) -> Column:
        """No more differing elements, of which sketches show some, than every link has at these sizes."""
        return sized(x, y) & (differing(f"s{x}", f"s{y}") * (num + den) <= (den - num) * (F.col(f"n{x}") + F.col(f"n{y}")))

    lists = live.select("k", "doc", "n")
    sketch = stored(classes.select(F.col("id").alias("doc"), "sketch").hint("merge").join(wanted.hint("merge"), "doc", "left_semi"), "sketches")
    labels = lists.select("doc", F.col("doc").alias("c")).distinct()
    side = lambda df, x: df.select("k", F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"))
    drawn = lambda x: sketch.select(F.col("doc").alias(x), F.col("sketch").alias(f"s{x}")).hint("merge")

    def unconnected() -> DataFrame:
        """The lists whose documents aren't all connected yet."""
        own = lists.hint("merge").join(labels.hint("merge"), "doc")
        mixed = own.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks")).where("lo <> hi").select("k", "blocks")
        return stored(own.hint("merge").join(mixed.hint("merge"), "k"), "apart")

    # unless all links are wanted, a few rounds in which each component takes the likeliest of its lists' chosen members that lie outside it; this
    # connects groups of near copies with one comparison for each document and round, not one for each pair
    links, found = None, []
    for turn in range(0 if every else ROUNDS):
        own = unconnected()
        chosen = own.groupBy("k").agg(F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "n", "c")).alias("x")).select("k", "x.doc", "x.n", "x.c")
        # a document meets the same member in many of its lists, so sketches are looked up after these are one
        near = side(own, "a").hint("merge").join(side(chosen, "b").hint("merge"), "k").where((F.col("ca") != F.col("cb")) & sized("a", "b")).drop("k", "cb").distinct()
        near = near.hint("merge").join(drawn("a"), "a").hint("merge").join(drawn("b"), "b").where(may_link("a", "b"))
        best = near.groupBy("ca").agg(F.min(F.struct(differing("sa", "sb").alias("d"), "b", "a")).alias("x")).select(F.least("x.a", "x.b").alias("a"), F.greatest("x.a", "x.b").alias("b")).distinct()
        new = stored(verified(best), "links")
        forget(own)
        links, found = links.unionByName(new) if links is not None else new, [*found, new]
        if new.isEmpty():
            break
        joined = connected_components(links)
        old, labels = labels, stored(labels.select("doc").hint("merge").join(joined.hint("merge"), F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("c")), "labels")
        forget(old, joined)

    # then all pairs of a list that aren't connected (without the rounds, none is) and share as many keys as their sizes ask for
    apart = unconnected()
    own = apart.hint("merge").join(sketch.hint("merge"), "doc").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    full = lambda x, first, last: own.select("k", F.explode(F.sequence(first, last)).alias("other"), "block", F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("sketch").alias(f"s{x}"))
    # of two blocks the lower one is the left side
    left = full("a", F.col("block"), F.col("blocks") - 1).withColumnsRenamed({"block": "p", "other": "q"})
    right = full("b", F.lit(0), F.col("block")).withColumnsRenamed({"block": "q", "other": "p"})
    pairs = left.hint("merge").join(right.hint("merge"), ["k", "p", "q"]).where(((F.col("p") < F.col("q")) | (F.col("a") < F.col("b"))) & (F.col("ca") != F.col("cb")) & may_link("a", "b"))
    turned = F.col("a") > F.col("b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    rest = verified(pairs.where(F.col("shared") >= asked(F.least("na", "nb"))).select("a", "b"))
    links = stored(rest if links is None else links.unionByName(rest), "links")
    # an id's component is named by the smallest key of all its ids
    joined = connected_components(links)
    least = classes.select("id", "rep").hint("merge").join(joined.hint("merge"), F.col("id") == F.col("node"), "left").select("id", "rep", F.coalesce("component", "id").alias("_c"))
    least = stored(least, "least")
    name = least.groupBy("_c").agg(F.min("rep").alias("component"))
    components = stored(least.hint("merge").join(name.hint("merge"), "_c").select(F.col("id").alias("set"), "component"), "components")
    forget(live, named, sets, sketch, labels, apart, classes, joined, least, *found)
    return members, links, components


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key that its text reaches by links, its own included.

    A row whose key is repeated by other texts is its own text: what links with one of these does not link with the others.
    """
    members, _, components = similar(docs, key, text, n, num, den)
    found = members.hint("merge").join(components.hint("merge"), "set", "left")
    return found.select(key, "n_shingles", F.coalesce("component", key).alias("component_id"))
