"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine verification, components.

Equal vectors are one vector with a multiplicity. In each table a vector's bucket is the signs of its products with
random directions. A bucket is cut into blocks of at most BLOCK vectors, and every pair of its blocks is worked on twice. First its
vectors are there as ids with a sketch of SKETCH further signs, whatever their length: of those whose sketch is near to no
other in the block pair none can link there. Only the others come as vectors, for the cosines in double precision, so vectors
cross the network for block pairs in which they have a neighbour, and not for every table. A pair that meets in several
tables counts in the first of them only, so link counts need no list of pairs, and a block pair returns sums and a spanning
forest of its links: never more rows than vectors, whatever the size of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import connected_components, forget, prepare, stored

#: Probability with which a pair exactly at the threshold is found; pairs above it are found with a higher one.
RECALL = 0.998
#: Vectors that a bucket holds on average, and at most in one block of a bucket; seed of the directions.
MEAN, BLOCK, SEED = 1024, 2048, 7
#: Signs of a sketch (a multiple of 64), and the probability with which a sketch may hide a pair exactly at the threshold.
SKETCH, HIDDEN = 256, 1e-9


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(tables, bits): bits for buckets of MEAN vectors, and as many tables as the recall takes.

    Two vectors at an angle a agree in a random sign with probability 1 - a / pi.
    """
    bits = max(4, round(math.log2(max(1, n) / MEAN)))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))) if agree < 1 else 1, bits


def directions(dim: int, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.RandomState(seed).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    """The bucket of each vector in each table."""
    signs = (x @ directions(x.shape[1], tables, bits, seed) >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits))


def sketches(x: np.ndarray, seed: int = SEED + 1) -> np.ndarray:
    """SKETCH signs of each vector as unsigned longs."""
    return np.packbits(x @ directions(x.shape[1], 1, SKETCH, seed) >= 0, axis=1).view(np.uint64)


def reach(threshold: float, signs: int = SKETCH, hidden: float = HIDDEN) -> int:
    """The most signs in which sketches of a pair at the threshold differ, but for a share `hidden` of such pairs (exact binomial tail)."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    tail, most = 0.0, signs
    while most > 0:
        tail += math.comb(signs, most) * p**most * (1 - p) ** (signs - most)
        if tail > hidden:
            break
        most -= 1
    return most


def least_reached(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the smallest one that the links (i, j) reach."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix in double precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, tables: int | None = None, bits: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, found, reps): members (key, id, copies), found (id, links, other) and reps (id, rep) of distinct vectors.

    A distinct vector has an id; rep is the smallest key that has it. Summing `links` by id gives the vectors other than its own
    copies that link with it; (id, other) connect what links. Buckets, and the vectors with a neighbour in them, are found on ids,
    signatures and sketches alone; vectors cross the network for those only, in the type they came in.
    """
    prepare(vectors.sparkSession)
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast(f"array<{kind}>").alias("x"))
    valid = F.expr("x is not null and size(x) > 0 and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists(x, e -> e <> 0)")
    rows = rows.withColumn("x", F.when(F.coalesce(valid, F.lit(False)), F.expr(f"transform(x, e -> cast(e + 0 as {kind}))")))  # -0 becomes 0
    members = rows.withColumns({"h1": F.when(F.col("x").isNotNull(), F.xxhash64("x")), "h2": F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(1), "x"))})
    reps = members.where("h1 is not null").groupBy("h1", "h2").agg(F.min("k").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x"))
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()), "vectors")
    planned = plan(reps.count(), threshold)
    tables, bits = tables or planned[0], bits or planned[1]
    members = members.select(F.col("k").alias(key), "h1", "h2").hint("merge").join(reps.select("h1", "h2", "id", "copies").hint("merge"), ["h1", "h2"], "left").select(key, "id", "copies")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                x = matrix(part.column("x"))
                x /= np.abs(x).max(1)[:, None]
                sig = signatures(x, tables, bits).astype(np.int64)
                sig = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, tables, dtype=np.int32), sig.ravel())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("d"), sig, pa.array([s.tobytes() for s in sketches(x)], pa.binary())], ["id", "d", "sig", "sketch"])

    signed = stored(reps.select("id", F.size("x").alias("d"), "x").mapInArrow(sign, "id bigint, d int, sig array<bigint>, sketch binary"), "signed")
    placed = signed.select("id", "d", "sketch", F.posexplode("sig").alias("t", "bucket"))
    # blocks of buckets that hold more than one vector; most buckets have a single one
    size = placed.groupBy("t", "d", "bucket").agg(F.count("*").alias("m")).where("m > 1").select("t", "d", "bucket", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    live = placed.hint("merge").join(size.hint("merge"), ["t", "d", "bucket"])
    dealt = live.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "d", "bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "sketch")
    differ = reach(threshold)

    def meet(pairs: pa.Table) -> pa.Table:
        p, q = (pairs.column(c)[0].as_py() for c in "pq")
        own = pairs.column("own").to_numpy()
        mark = np.frombuffer(b"".join(pairs.column("sketch").to_pylist()), np.uint64).reshape(len(own), -1)
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        met = np.zeros(len(own), bool)
        for b in range(0, len(left), 128):
            rows = left[b : b + 128]
            apart = np.zeros((len(rows), len(right)), np.uint16)
            for word in range(mark.shape[1]):
                apart += np.bitwise_count(mark[rows, word][:, None] ^ mark[right, word][None, :])
            near = apart <= differ
            if p == q:
                near &= rows[:, None] != right[None, :]
            met[rows] |= near.any(1)
            met[right] |= near.any(0)
        return pairs.filter(pa.array(met)).drop_columns(["sketch"])

    close = dealt.groupBy("t", "d", "bucket", "p", "q").applyInArrow(meet, "t int, d int, bucket bigint, p int, q int, own int, id bigint")
    close = stored(close, "close")
    dealt = close.hint("merge").join(reps.select("id", "copies", "x").hint("merge"), "id")

    def compare(pairs: pa.Table) -> pa.Table:
        t, p, q = (pairs.column(c)[0].as_py() for c in "tpq")
        ids = pairs.column("id").to_numpy()
        order = np.argsort(ids)
        x, ids, own, copies, n = matrix(pairs.column("x"))[order], ids[order], pairs.column("own").to_numpy()[order], pairs.column("copies").to_numpy()[order], len(ids)
        x /= np.abs(x).max(1)[:, None]
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        left, right = (np.arange(n), np.arange(n)) if p == q else (np.flatnonzero(own == p), np.flatnonzero(own == q))
        count, ii, jj = np.zeros(n, np.int64), [], []
        sig = None
        for b in range(0, len(left), 512):
            rows = left[b : b + 512]
            near = unit[rows] @ unit[right].T >= threshold
            if p == q:
                near &= rows[:, None] < right[None, :]
            i, j = np.nonzero(near)
            i, j = rows[i], right[j]
            if t and len(i):  # a pair counts in the first table in which it meets
                sig = signatures(x, tables, bits)[:, :t] if sig is None else sig
                new = np.concatenate([~(sig[i[a : a + 65536]] == sig[j[a : a + 65536]]).any(1) for a in range(0, len(i), 65536)])
                i, j = i[new], j[new]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            # of the links of these rows a spanning forest is enough to connect what they connect
            low = least_reached(i, j, n)
            ii.append(np.flatnonzero(low != np.arange(n)))
            jj.append(low[ii[-1]])
        i, j = (np.concatenate(k) if k else np.zeros(0, int) for k in (ii, jj))
        low, some = least_reached(i, j, n), count > 0
        return pa.table({"id": ids[some], "links": count[some], "other": ids[low][some]})

    found = dealt.groupBy("t", "d", "bucket", "p", "q").applyInArrow(compare, "id bigint, links bigint, other bigint")
    found = stored(found.groupBy("id", "other").agg(F.sum("links").alias("links")), "found")
    forget(signed, close)
    return members, found, reps.select("id", "rep")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, **how: int) -> DataFrame:
    """(key, n_links, component_id, kept) of every row, by cosine >= threshold in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, don't link.
    Equal vectors link with each other; component_id is the smallest key of all that links, a row's own key if it has no links. Keys
    may be of any type that has an order. Rows that repeat a key are each answered; one without a key links, but is never kept.
    """
    members, found, reps = links(vectors, key, vector, threshold, **how)
    component = connected_components(found.select("id", "other"), "id", "other")
    named = component.hint("merge").join(reps.hint("merge"), component.node == reps.id)
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    label = named.hint("merge").join(least.hint("merge"), "component").select("id", "least")
    alone = reps.hint("merge").join(label.hint("merge"), "id", "left").select("id", F.coalesce("least", "rep").alias("root"))
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    out = members.hint("merge").join(count.hint("merge"), "id", "left").hint("merge").join(alone.hint("merge"), "id", "left")
    root = F.coalesce("root", key)
    return out.select(key, (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), root.alias("component_id"), F.coalesce(F.col(key) == root, F.lit(False)).alias("kept"))
