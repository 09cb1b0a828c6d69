"""Hard-negative mining by exact search in a multiway hyperplane tree with distance ranges between siblings.

Vectors are whole numbers and the score is their inner product. One more coordinate, which completes every vector to the largest
norm (and is 0 for an anchor), makes the order by score the order by distance. A node has several split points; a vector belongs to
the nearest one, and for every split point the node knows the smallest and largest distance to the vectors of every sibling's
subtree. A search looks for scores in a window, that is for vectors in a ring around the anchor; a sibling whose range at some split
point doesn't meet what the ring allows there is left out with its subtree. What is left are leaves, and those are compared exactly.

Split points come from a bounded sample; all vectors are indexed, and the ranges are of all of them. Leaves are cut into blocks of
vectors and their visitors into blocks of anchors, so a task holds one block of each, whatever a leaf's or an anchor's share.
Equal vectors of one label are one item with the few smallest keys that can be among the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prognos.llm.common import forget, integer_vectors, prepare, stored
from prognos.llm.neardup import matrix

#: Vectors of the sample that split points are drawn from, at most (about); split points of a node; vectors of a leaf, on average.
SAMPLE, FANOUT, LEAF = 32_768, 16, 2048
#: Vectors and visitors that one task compares at a time; seed of the choice of split points.
BLOCK, SEED = 8192, 5
#: Part of the largest norm by which distances may be wrong in floating point; ranges are taken wider by it.
SLACK = 1e-6
LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Tree:
    """nodes: (split points with their last coordinate, children); a child is a node's number, or -1 - leaf. An empty tree is one leaf."""

    def __init__(self, top: float) -> None:
        self.top, self.nodes, self.leaves, self.ranges = top, [], 0, {}

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The coordinate that completes each vector to the largest norm."""
        return np.sqrt(np.maximum(0.0, self.top**2 - (x * x).sum(1)))

    def distances(self, x: np.ndarray, last: np.ndarray, node: int) -> np.ndarray:
        points, lifted = self.nodes[node][0]
        square = (x * x).sum(1)[:, None] + last[:, None] ** 2 + self.top**2 - 2 * (x @ points.T + last[:, None] * lifted[None, :])
        return np.sqrt(np.maximum(0.0, square))

    def grow(self, sample: np.ndarray, times: float, leaf: int, fanout: int, rng: np.random.RandomState) -> int:
        """A subtree for the sample's vectors, each of which stands for so many; returns its number."""
        many = min(fanout, math.ceil(len(sample) * times / leaf))
        if many < 2 or len(sample) < 2 * many:
            self.leaves += 1
            return -self.leaves
        some = sample[rng.permutation(len(sample))[: 3 * many]]
        # points far from one another, begun with the one farthest from the middle
        far = ((some - some.mean(0)) ** 2).sum(1)
        chosen = [int(far.argmax())]
        near = np.full(len(some), np.inf)
        while len(chosen) < many:
            near = np.minimum(near, ((some - some[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(near.argmax()))
        points = some[chosen]
        node = len(self.nodes)
        self.nodes.append(((points, self.lift(points)), []))
        at = self.distances(sample, self.lift(sample), node).argmin(1)
        for c in range(many):
            self.nodes[node][1].append(self.grow(sample[at == c], times, leaf, fanout, rng))
        return node

    def route(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The leaf of each vector, and for each node the smallest and largest distance of every split point to every child's vectors."""
        leaf, ranges = np.zeros(len(x), np.int64), {}
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            d = self.distances(x[rows], last[rows], node)
            at, many = d.argmin(1), d.shape[1]
            low, high = np.full((many, many), np.inf), np.full((many, many), -np.inf)
            for c in np.unique(at):
                mine = at == c
                low[:, c], high[:, c] = d[mine].min(0), d[mine].max(0)
                child = self.nodes[node][1][c]
                if child < 0:
                    leaf[rows[mine]] = -1 - child
                else:
                    todo.append((child, rows[mine]))
            ranges[node] = (low, high)
        return leaf, ranges

    def visits(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) of every leaf that may hold a vector at a distance in the anchor's ring."""
        if not self.nodes:
            return np.arange(len(q)), np.zeros(len(q), np.int64)
        slack, zero, found = SLACK * max(1.0, self.top), np.zeros(len(q)), []
        todo = [(0, np.flatnonzero(inner <= outer))]
        while todo:
            node, rows = todo.pop()
            if node not in self.ranges:
                continue
            low, high = self.ranges[node]
            d = self.distances(q[rows], zero[rows], node)
            farthest = d + outer[rows, None] + slack
            nearest = np.maximum(np.maximum(d - outer[rows, None], inner[rows, None] - d), 0) - slack
            alive = ((low[None] <= farthest[:, :, None]) & (high[None] >= nearest[:, :, None])).all(1)
            for c, child in enumerate(self.nodes[node][1]):
                mine = rows[alive[:, c]]
                if len(mine) and child < 0:
                    found.append((mine, np.full(len(mine), -1 - child)))
                elif len(mine):
                    todo.append((child, mine))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def items(vectors: DataFrame, key: str, label: str, keep: int) -> DataFrame:
    """(id, label, x, keys): distinct (vector, label) with their `keep` smallest keys, each once for every row that has it."""
    hashed = vectors.select(F.col(key).cast("long").alias("key"), F.xxhash64(label).alias("label"), "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    first = F.row_number().over(Window.partitionBy("h1", "h2", "label").orderBy("key"))
    few = hashed.withColumn("r", first).where(F.col("r") <= keep)  # no more than `keep` of a group leave a task
    one = few.groupBy("h1", "h2", "label").agg(F.first("x").alias("x"), F.array_sort(F.collect_list("key")).alias("keys"))
    return one.select(F.monotonically_increasing_id().alias("id"), "label", "x", "keys", "h1", "h2")


def index(rows: DataFrame, sample: int = SAMPLE, fanout: int = FANOUT, leaf: int = LEAF, seed: int = SEED) -> tuple[Tree, DataFrame]:
    """(tree, rows with their leaf): the split points from about `sample` rows drawn by a hash, the ranges of all rows.

    The driver gets the sample and one number for each pair of split points of a node; both are bounded by `sample`.
    """
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v))).first()
    tree = Tree(math.sqrt(top or 0))
    share = min(1.0, sample / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("h1", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").toArrow() if n > leaf else None
    got = matrix(drawn.column("x")) if drawn is not None and drawn.num_rows else np.zeros((0, 1))
    got = got[np.lexsort(got.T)]  # the same tree whatever the order of rows
    tree.grow(got, n / max(1, len(got)), leaf, fanout, np.random.RandomState(seed))
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x")) if batch.num_rows else np.zeros((0, 1))
            yield batch.append_column("leaf", pa.array(shared.value.route(x, shared.value.lift(x))[0], pa.int64()))

    placed = rows.select("id", "label", "x", "keys")
    placed = stored(placed.mapInArrow(place, "id bigint, label bigint, x array<bigint>, keys array<bigint>, leaf bigint"), "placed")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            x = matrix(batch.column("x")) if batch.num_rows else np.zeros((0, 1))
            for node, (low, high) in shared.value.route(x, shared.value.lift(x))[1].items():
                old = known.get(node)
                known[node] = (low, high) if old is None else (np.minimum(low, old[0]), np.maximum(high, old[1]))
        for node, (low, high) in known.items():
            i, c = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), node)), pa.array(i), pa.array(c), pa.array(low[i, c]), pa.array(high[i, c])], ["node", "i", "c", "low", "high"])

    if tree.nodes:
        ranges = placed.select("x").mapInArrow(measure, "node bigint, i bigint, c bigint, low double, high double")
        for r in ranges.groupBy("node", "i", "c").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            many = len(tree.nodes[r.node][1])
            low, high = tree.ranges.setdefault(r.node, (np.full((many, many), np.inf), np.full((many, many), -np.inf)))
            low[r.i, r.c], high[r.i, r.c] = r.low, r.high
    return tree, placed


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point where no sum can leave 2^53, else as integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most >= 2**62:
        raise OverflowError("inner products of these vectors don't fit a long")
    return q.astype(np.float64) @ x.T.astype(np.float64) if most < 2**53 else q @ x.T


def _whole(lists: pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _compare(same: bool, k: int):  # noqa: ANN202
    def run(visitors: pa.Table, members: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "w": pa.array([], pa.int32()), "item": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not visitors.num_rows or not members.num_rows:
            return empty
        x, q = _whole(members.column("x")), _whole(visitors.column("x"))
        label, mine = members.column("label").to_numpy(), visitors.column("label").to_numpy()
        item, asked = members.column("id").to_numpy(), visitors.column("id").to_numpy()
        keys = members.column("keys").combine_chunks()
        begin, flat = keys.offsets.to_numpy() - keys.offsets[0].as_py(), keys.flatten().to_numpy()
        low, high = visitors.column("low").to_pylist(), visitors.column("high").to_pylist()
        order = np.lexsort((asked,))
        out: list[tuple[np.ndarray, ...]] = []
        step = max(1, (1 << 21) // len(x))
        for a in range(0, len(q), step):
            rows = order[a : a + step]
            score = _products(q[rows], x)
            fits = (label[None, :] == mine[rows][:, None]) if same else (label[None, :] != mine[rows][:, None])
            for w in range(max(len(low[r]) for r in rows)):
                lo, hi = (np.array([s[r][w] if w < len(s[r]) else none for r in rows]) for s, none in ((low, HIGHEST), (high, LOWEST)))
                inside = fits & (score >= lo[:, None]) & (score <= hi[:, None])
                ranked = np.where(inside, score, -np.inf)
                if len(x) > k:
                    inside &= ranked >= np.partition(ranked, len(x) - k, axis=1)[:, len(x) - k][:, None]
                r, c = np.nonzero(inside)
                if len(r):
                    n = (begin[1:] - begin[:-1])[c]
                    at = np.repeat(begin[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    r, c, key = np.repeat(r, n), np.repeat(c, n), flat[at]
                    best = np.lexsort((item[c], key, -score[r, c], r))
                    r, c, key = r[best], c[best], key[best]
                    first = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c, key = r[first], c[first], key[first]
                    out.append((asked[rows[r]], np.full(len(r), w, np.int32), item[c], key, score[r, c].astype(np.int64)))
        return pa.table(dict(zip(empty.column_names, (np.concatenate(p) for p in zip(*out, strict=True)), strict=True)), schema=empty.schema) if out else empty

    return run


def search(tree: Tree, placed: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """(id, w, item, key, score): for each window w of each row of `asked` (id, label, x, low, high) the first k rows of the index by (score, key).

    low and high are arrays of the windows' ends, which belong to them; `same` looks for rows of the same label, else of any other one.
    """
    shared = asked.sparkSession.sparkContext.broadcast(tree)
    fields = "id bigint, label bigint, x array<bigint>, low array<bigint>, high array<bigint>"
    names = [f.split()[0] for f in fields.split(", ")]

    def go(home: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                t, q = shared.value, matrix(batch.column("x"))
                own = t.route(q, np.zeros(len(q)))[0]
                if home:
                    rows, leaf = np.arange(len(q)), own
                else:
                    length = (q * q).sum(1) + t.top**2
                    ring = lambda s: np.sqrt(np.maximum(0.0, length - 2 * np.array(s, float)))
                    low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
                    # one ring holds all windows that can still have a row
                    live = [[(a, b) for a, b in zip(x, y, strict=True) if a <= b] for x, y in zip(low, high, strict=True)]
                    inner, outer = ring([max((b for _, b in s), default=LOWEST) for s in live]), ring([min((a for a, _ in s), default=HIGHEST) for s in live])
                    inner = np.where([bool(s) for s in live], inner, np.inf)
                    rows, leaf = t.visits(q, inner, outer)
                    away = leaf != own[rows]
                    rows, leaf = rows[away], leaf[away]
                yield batch.take(pa.array(rows)).append_column("leaf", pa.array(leaf, pa.int64()))

        return run

    # one row for each leaf on either side, and there are no more leaves than sample rows
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def compared(visits: DataFrame) -> DataFrame:
        crowd = visits.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("crowds"))
        part = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        left = visits.join(F.broadcast(sizes), "leaf").join(F.broadcast(crowd), "leaf").select(*names, "leaf", part("crowds").alias("c"), every("blocks").alias("b"))
        right = placed.join(F.broadcast(crowd), "leaf").join(F.broadcast(sizes), "leaf").select("id", "label", "x", "keys", "leaf", part("blocks").alias("b"), every("crowds").alias("c"))
        keys = ["leaf", "b", "c"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(same, k), "id bigint, w int, item bigint, key bigint, score bigint")

    def first(found: DataFrame) -> DataFrame:
        r = F.row_number().over(Window.partitionBy("id", "w").orderBy(F.desc("score"), "key", "item"))
        return found.withColumn("r", r).where(F.col("r") <= k).drop("r")

    asked = asked.select(*names)
    begun = stored(first(compared(stored(asked.mapInArrow(go(True), f"{fields}, leaf bigint"), "home"))), "begun")
    # k rows at home raise the window's lower end to the last one's score; equal scores may still have a smaller key
    full = begun.groupBy("id", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    full = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("bound"))
    raised = asked.hint("merge").join(full.hint("merge"), "id", "left").withColumn("low", F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("bound", i.cast("int")), v))))
    away = stored(raised.select(*names).mapInArrow(go(False), f"{fields}, leaf bigint"), "away")
    out = stored(first(begun.unionByName(compared(away))), "found")
    forget(begun, away)
    return out


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, **how: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row for which `anchors` holds.

    An anchor's positives are its first other rows of the same label by (higher score, smaller key); a positive's negatives are the
    first rows of other labels with low * positive_score <= 100 * score <= high * positive_score. Entries become the whole
    numbers floor(scale * entry), the score is their inner product; shorter vectors count as filled with zeros. Keys are whole
    numbers. Rows without key or label, without vector, or with a null or non-finite entry take no part. A row that repeats another
    one whole is another row; each anchor row is answered. A positive without negatives, and an anchor without positives, has no rows.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = integer_vectors(rows.where("key is not null and label is not null"), "x", scale)
    rows = stored(rows, "integers")
    (dim,) = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    dim = max(1, dim)
    rows = rows.withColumn("x", F.when(F.size("x") < dim, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))).otherwise(F.col("x")))
    each = stored(items(rows, "key", "label", max(positives + 1, negatives)), "items")
    tree, placed = index(each, **how)
    named = rows.where("anchor").select("key", F.xxhash64("label").alias("label"), F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    named = stored(named.hint("merge").join(each.select("id", "label", "h1", "h2", "x").hint("merge"), ["label", "h1", "h2"]).select("key", "id", "label", "x"), "anchors")

    # equal anchors of one label ask once, for one row more than wanted, and each takes itself out of the answer
    asked = named.select("id", "label", "x").dropDuplicates(["id"])
    open_ = lambda v: F.array(F.lit(v).cast("long"))
    near = search(tree, placed, asked.select("*", open_(LOWEST).alias("low"), open_(HIGHEST).alias("high")), positives + 1, True)
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "item"))).alias("top"))
    own = named.select("key", "id").hint("merge").join(lists.hint("merge"), "id")
    at = F.expr("filter(sequence(1, size(top)), i -> top[i - 1].key = key and top[i - 1].item = id)")
    at = F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(positives + 1))
    own = own.withColumn("at", at).where("size(top) > 1 or at > 1")
    rest = F.concat(F.slice("top", F.lit(1), F.col("at") - 1), F.slice("top", F.col("at") + 1, F.lit(positives + 1)))
    pairs = own.select(F.col("key").alias("anchor_id"), "id", F.explode(rest).alias("p")).select("anchor_id", "id", F.col("p.key").alias("positive_id"), (-F.col("p.s")).alias("positive_score"))
    pairs = stored(pairs, "positives")

    # an anchor's windows, one for each score that a positive of it has
    windows = pairs.where("positive_score >= 0").groupBy("id").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    asked = asked.hint("merge").join(windows.hint("merge"), "id")
    asked = asked.select("id", "label", "x", F.expr(f"transform(scores, s -> s div 100 * {low} + (s % 100 * {low} + 99) div 100)").alias("low"), F.expr(f"transform(scores, s -> s div 100 * {high} + s % 100 * {high} div 100)").alias("high"), "scores")
    asked = stored(asked, "windows")
    far = search(tree, placed, asked, negatives, False)
    answers = far.groupBy("id", "w").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "key"))).alias("best"))
    answers = answers.hint("merge").join(asked.select("id", "scores").hint("merge"), "id").select("id", F.expr("scores[w]").alias("positive_score"), "best")
    out = pairs.hint("merge").join(answers.hint("merge"), ["id", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("i", "n"))
    return out.select("anchor_id", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("n.key").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))
