"""Benchmark decontamination by SimHash windows, DataFrame and SQL functions only.

Windows of exactly a benchmark item's number of shingles are cut from the documents, for every size that an item has. Windows and
items get 63-bit SimHash fingerprints of their five-word shingles, weighted as in the similarity. A fingerprint is cut into BLOCKS
blocks: two that differ in at most RADIUS bits differ in at most RADIUS // BLOCKS bits of some block, so looking up every window's
blocks among all values so near to an item's finds all pairs within the radius. These pairs are then verified by the exact weighted
Jaccard similarity of their shingles; what the fingerprints don't bring together is not compared.

Windows that can't reach the threshold whatever the item is are left out, which loses nothing: a shingle that no item holds weighs
as much as any, so the similarity is at most the share of the window's shingles that some item holds; and moving a window on from a
first shingle that no item holds never lowers it. A table of fixed size, which a false hit only makes less strict, tells inside the row
whether some item holds a shingle, and about how much it weighs.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import forget, stored

WORDS = 5
THRESHOLD = 0.8
#: Words from which an item is looked for inside documents.
SHORTEST = 3
#: Bits by which a window's fingerprint may differ from an item's, bits of a fingerprint, and blocks that it is cut into.
RADIUS, BITS, BLOCKS = 15, 63, 4
#: Longs of the table of benchmark shingles (a power of two), each with 32 slots of two bits: 512 KB for any benchmark. A slot is 0 or a weight up to LEVELS.
TABLE, LEVELS = 1 << 16, 3
#: Rows up to which a table made of the benchmark is broadcast (about 50 bytes each); beyond that it is shuffled.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value computed once; an expression that is used twice would be computed at every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_hashes(text: Column | str) -> Column:
    """64-bit hashes of a text's words in their order: runs of characters other than ASCII white space, A-Z in lower case."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _whole(h: Column) -> Column:
    return F.xxhash64(F.array_join(h.cast("array<string>"), " "))


def shingles(text: Column | str, n: int = WORDS) -> Column:
    """64-bit hashes of the n-word shingles of a text, in their order; a text with fewer words has its whole sequence as one."""
    return bound(
        word_hashes(text),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < n, F.array(_whole(h)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(n)]))),
    )


def _place(v: Column) -> tuple[Column, Column]:
    """(long, bit) of a shingle's slot in the table: its top bits name the long, its lowest five the slot."""
    return F.shiftrightunsigned(v, 65 - TABLE.bit_length()).cast("int"), F.shiftleft(v.bitwiseAND(F.lit(31)), 1).cast("int")


def level(table: Column, v: Column) -> Column:
    """0 if no item holds the shingle, else its weight in 1 to LEVELS."""
    at, bit = _place(v)
    return F.call_function("shiftrightunsigned", F.get(table, at), bit).bitwiseAND(F.lit(3))


def weighted(values: Column, levels: Column, start: Column, end: Column) -> Column:
    """(v, w) of the shingles from start up to end, with their levels; what no item holds weighs most. slice() would copy the whole array for every window."""
    weight = lambda w: F.when(w == 0, F.lit(LEVELS).cast("bigint")).otherwise(w)
    return F.transform(F.sequence(start, end - 1), lambda i: F.struct(F.get(values, i).alias("v"), weight(F.get(levels, i)).alias("w")))


def levels(values: Column, table: Column) -> Column:
    return F.transform(values, lambda v: level(table, v))


def fingerprint(pairs: Column, lane: int) -> Column:
    """SimHash of (v, w) in BITS bits: a bit is set where the values that have it weigh more than half of all.

    A long sums the weights of BITS / lane bits in lanes (of 9, 21 or 63 bits); the sum of all weights must be below 2 ** lane.
    """
    ones = F.lit(sum(1 << k for k in range(0, BITS, lane))).cast("bigint")
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x["w"])
    # with this a lane's top bit becomes set where its sum is above half of the total
    lift = (F.lit((1 << (lane - 1)) - 1) - F.shiftrightunsigned(total, 1)) * ones
    sums = lambda j: F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x["w"] * F.shiftrightunsigned(x["v"], j).bitwiseAND(ones))
    out = F.lit(0).cast("bigint")
    for j in range(lane):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(sums(j) + lift, lane - 1).bitwiseAND(ones), j))
    return out


def _cuts(blocks: int) -> list[tuple[int, int]]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def blocks(mark: Column, n: int = BLOCKS) -> Column:
    """(block, value) of the blocks of a fingerprint."""
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(mark, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(_cuts(n))])


def near_blocks(mark: Column, radius: int = RADIUS, n: int = BLOCKS) -> Column:
    """(block, value) of all values that differ from a fingerprint's blocks in at most radius // n bits."""
    own = blocks(mark, n)
    flips = [[sum(1 << i for i in c) for r in range(radius // n + 1) for c in combinations(range(b - a), r)] for a, b in _cuts(n)]
    about = lambda k: F.transform(F.lit(flips[k]).cast("array<bigint>"), lambda f: F.struct(F.lit(k).alias("block"), own[k]["value"].bitwiseXOR(f).alias("value")))
    return F.flatten(F.array(*map(about, range(n))))


def short_matches(docs: DataFrame, items: DataFrame, sizes: list[int], shortest: int, few: bool) -> DataFrame:
    """(doc, item, start, m) of the first place of each item (item, words, v) of one of these sizes in each document (doc, t).

    An item under WORDS words is one shingle of its own length, so only equal words are similar to it. One of fewer than `shortest` words
    must be the whole document. Which of a document's runs of words are an item's is told inside the row where items are few.
    """
    runs = lambda h, k: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(1), F.size(h) - k + 1), lambda i: F.struct(_whole(F.slice(h, i, k)).alias("v"), (i - 1).cast("bigint").alias("start"), F.lit(k).alias("words")))).otherwise(F.array().cast("array<struct<v:bigint,start:bigint,words:int>>"))
    whole = lambda h, k: F.when(F.size(h) == k, runs(h, k)).otherwise(F.array().cast("array<struct<v:bigint,start:bigint,words:int>>"))
    found = docs.select("doc", F.inline(bound(word_hashes("t"), lambda h: F.flatten(F.array(*[(runs if k >= shortest else whole)(h, k) for k in sizes])))))
    near = found.join(F.broadcast(items), ["v", "words"]) if few else found.hint("merge").join(items.hint("merge"), ["v", "words"])
    return near.groupBy("doc", "item").agg(F.min("start").alias("start"), F.first("words").alias("n_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, shortest: int = SHORTEST) -> DataFrame:
    """(key, item, start, n_words, distance, similarity): for each document and benchmark item that match, the best window.

    start counts words from 0. similarity is sum(min) / sum(max) over the shingles of window and item, each shingle counted as
    often as it occurs and weighted with ln(1 + items / items that hold it), one not in the benchmark with the most, so that
    what many items share counts less; rounded to nine places, as the order of a sum varies. Of equally similar windows the first
    that begins with a benchmark shingle is taken. Null and empty texts, and items without words, match nothing; documents shorter than
    an item match it by their whole text. An item under five words is a shingle of its own length, found wherever a document has
    its words in a row; one under `shortest` words, which ordinary text holds by chance, only as a whole document. Rows that repeat a key are one document, each text of which is searched; rows without a key
    are not, as no result could name them. What is similar but lies more than `radius` bits apart is missed.
    """
    every = benchmark.select(F.col(item).alias("item"), shingles(text).alias("sh"), F.size(word_hashes(text)).alias("words")).where("item is not null and words > 0").dropDuplicates(["item"])
    every = stored(every, "items")
    total, longest, short = every.agg(F.count("*"), F.max(F.when(F.col("words") >= WORDS, F.size("sh"))), F.sort_array(F.collect_set(F.when(F.col("words") < WORDS, F.col("words"))))).first()
    items = every.where(F.col("words") >= WORDS).drop("words")
    columns = [F.col("doc").alias(key), F.col("item").alias(item), "start", F.col("n_words").cast("long").alias("n_words"), "distance", "similarity"]
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).where("doc is not null")
    if short:
        given = every.where(F.col("words") < WORDS).select("item", "words", F.col("sh")[0].alias("v"))
        brief = short_matches(texts, given, list(short), shortest, total <= BROADCAST_ROWS)
        brief = stored(brief.withColumns({"distance": F.lit(0).cast("long"), "similarity": F.lit(1.0)}), "short").select(*columns)
        if not longest:
            return brief
    if not longest:
        return docs.select(F.col(key).alias(key), F.lit(None).cast(benchmark.schema[item].dataType).alias(item), *[F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("n_words", "long"), ("distance", "long"), ("similarity", "double"))]).where("false")
    lane = next((b for b in (9, 21) if LEVELS * longest < 1 << b), 63)
    most = math.log1p(total)
    posted = items.select("item", F.explode("sh").alias("v"))
    weights = stored(posted.groupBy("v").agg(F.log(1 + total / F.countDistinct("item")).alias("w")), "weights")
    few = weights.count() <= BROADCAST_ROWS
    beside = (lambda df: F.broadcast(df)) if few else (lambda df: df.hint("merge"))

    at, bit = _place(F.col("v"))
    slots = weights.groupBy(at.alias("i"), bit.alias("b")).agg(F.max(F.least(F.ceil(LEVELS * F.col("w") / most), F.lit(LEVELS))).cast("bigint").alias("l"))
    longs = slots.groupBy("i").agg(F.bit_or(F.call_function("shiftleft", F.col("l"), F.col("b"))).alias("bits"))
    slots_of = docs.sparkSession.range(TABLE).select(F.col("id").cast("int").alias("i")).hint("merge").join(longs.hint("merge"), "i", "left")
    dense = slots_of.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda x: x["bits"]).alias("table"))
    dense = stored(dense, "table")
    table = dense.scalar()
    sizes = items.agg(F.sort_array(F.collect_set(F.size("sh"))).alias("sizes"))  # no more of them than the longest item has shingles
    lengths = stored(sizes, "sizes")
    sizes = lengths.scalar()
    needed = lambda m: F.ceil(threshold * m - 1e-9).cast("int")
    least = items.agg(F.min(F.size("sh"))).first()[0]

    # a generator between scan and filter, as a filter on the hits would be pushed below them and compute all shingles twice; the table
    # goes into the same projection as the shingles, as input of the generator it would be copied for every row
    placed = lambda sh, ls: F.struct(sh.alias("sh"), ls.alias("ls"), F.filter(F.transform(ls, lambda w, i: F.when(w > 0, i)), lambda i: i.isNotNull()).alias("hits"))
    enough = lambda x: (F.size(x["hits"]) > 0) & (F.size(x["hits"]) >= F.least(F.lit(math.ceil(threshold * least - 1e-9)), needed(F.size(x["sh"]))))
    read = bound(F.col("table"), lambda b: bound(shingles("t"), lambda sh: bound(levels(sh, b), lambda ls: placed(sh, ls))))
    read = texts.withColumn("table", table).select("doc", read.alias("x"))
    hits = read.select("doc", F.inline(F.filter(F.array("x"), enough))).withColumn("h", F.xxhash64("sh"))
    hits = stored(hits, "hits")

    # windows of each size: those that begin with a hit and hold enough of them, the last of the text, or the whole of a shorter text
    each = hits.withColumn("sizes", sizes).select("doc", "h", "sh", "ls", "hits", F.explode(F.filter("sizes", lambda m: F.size("hits") >= needed(F.least(m, F.size("sh"))))).alias("m"))
    k, n, last = needed(F.col("m")), F.size("sh"), F.greatest(F.size("sh") - F.col("m"), F.lit(0))
    inside = F.transform(F.filter(F.transform("hits", lambda p, i: F.struct(p.alias("p"), F.get("hits", i + k - 1).alias("q"))), lambda x: (x["q"] - x["p"] < F.col("m")) & (x["p"] <= last)), lambda x: x["p"])
    at_end = F.when(F.size(F.filter("hits", lambda p: p >= last)) >= needed(F.least(F.col("m"), n)), F.array(last)).otherwise(F.array().cast("array<int>"))
    starts = F.when(n <= F.col("m"), at_end).otherwise(F.array_union(inside, at_end))
    marked = F.transform(starts, lambda s: F.struct(s.alias("start"), bound(weighted(F.col("sh"), F.col("ls"), s, F.least(s + F.col("m"), n)), lambda x: fingerprint(x, lane)).alias("mark")))
    windows = each.select("doc", "h", "m", F.inline(marked))

    # multi-index: a window's blocks among all values near to an item's, then the radius
    goal = bound(bound(levels(F.col("sh"), F.col("table")), lambda ls: weighted(F.col("sh"), ls, F.lit(0), F.size("sh"))), lambda x: fingerprint(x, lane))
    goals = items.withColumn("table", table).select("item", F.size("sh").alias("m"), goal.alias("goal"))
    index = stored(goals.select("item", "m", "goal", F.inline(near_blocks(F.col("goal"), radius))), "index")
    probe = windows.select("doc", "h", "m", "start", "mark", F.inline(blocks(F.col("mark"))))
    near = probe.join(F.broadcast(index), ["block", "value", "m"]) if index.count() <= BROADCAST_ROWS else probe.hint("merge").join(index.hint("merge"), ["block", "value", "m"])
    near = near.withColumn("distance", F.bit_count(F.col("mark").bitwiseXOR(F.col("goal")))).where(F.col("distance") <= radius)
    near = stored(near.select("doc", "h", "m", "start", "item", "distance").distinct(), "near")
    forget(index, dense, lengths)

    # exact verification
    pair = ["doc", "h", "m", "start", "item", "distance"]
    text_of = hits.select("doc", "h", "sh").dropDuplicates(["doc", "h"])
    here = near.hint("merge").join(text_of.hint("merge"), ["doc", "h"]).select(*pair, F.explode(F.slice("sh", F.col("start") + 1, F.col("m"))).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    there = near.hint("merge").join(items.hint("merge"), "item").select(*pair, F.explode("sh").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = here.unionByName(there).groupBy(*pair, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    weighed = counts.join(beside(weights), "v", "left").withColumn("w", F.coalesce("w", F.lit(most)))
    scored = weighed.groupBy(*pair).agg(F.round(F.sum(F.col("w") * F.least("a", "b")) / F.sum(F.col("w") * F.greatest("a", "b")), 9).alias("similarity")).where(F.col("similarity") >= threshold)
    best = stored(scored.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "distance", "m")).alias("x")), "leaks")
    forget(every, weights, hits, near)
    out = best.select("doc", "item", (-F.col("x.s")).cast("long").alias("start"), (F.col("x.m") + (WORDS - 1)).alias("n_words"), F.col("x.distance").cast("long").alias("distance"), F.col("x.similarity").alias("similarity")).select(*columns)
    return out.unionByName(brief) if short else out
