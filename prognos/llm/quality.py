"""Text quality: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader steps, scored as sparse dot products.

Words are runs of letters and digits, or of other visible characters. The n-grams are of the words themselves (1 and 2), of their
shapes (1 to 3: case, digits, length, which sign) and of which of three words in a row are the same. A feature's value is its
share of the text's n-grams of its kind, so a text's length does not matter. Learners see one shard each of a bounded sample of
labelled texts, and their weights are averaged; whole texts are scored side by side with the weights broadcast (SIZE numbers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import hash01, mix64, prepare, slices, utf8
from prognos.llm.jaccard import hash_spans

#: Hashed features, and so weights broadcast.
SIZE = 1 << 18
#: Labelled rows that are learned from at most (about), and bytes of the longest of them; rows of one learner (about); passes over them.
TRAIN_ROWS, LONGEST, LEARNER_ROWS, PASSES = 16_384, 16_384, 2048, 6
#: Step size and its offset, weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
#: Bytes of text looked at in one step.
TEXT_BYTES = 1 << 20
#: Score from which a text is predicted to be good.
CUT = 0.7

_KIND = np.full(256, 4, np.uint8)  # 0 blank, 1 lower case, 2 upper case, 3 digit, 4 other sign, 5 part of a character outside ASCII
_KIND[:33], _KIND[127], _KIND[128:] = 0, 0, 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3


def ngrams(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram (feature, text) of every one of them in all texts, in the order of the texts."""
    kind = _KIND[data]
    run = np.where(kind == 0, 0, np.where(kind == 4, 2, 1))
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = run[1:] != run[:-1]
    first[at] = True
    begin = np.flatnonzero(first)
    end, begin = begin[1:], begin[:-1]
    visible = run[begin] > 0
    begin, end = begin[visible], end[visible]
    text = np.searchsorted(at, begin, side="right") - 1
    if not len(begin):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 6
    lowered = np.where(kind == 2, data + 32, data).astype(np.uint8)
    word = hash_spans(lowered, begin, end)
    count = lambda k: np.add.reduceat(np.append(kind == k, False).astype(np.int64), np.stack([begin, end], 1).ravel())[::2]
    upper, long = count(2), np.searchsorted([3, 8, 16], end - begin)
    sign = run[begin] == 2
    shape = (kind[begin] == 2) + 2 * (count(1) > 0) + 4 * (upper > 1) + 8 * (count(3) > 0) + 16 * long
    shape = np.where(sign, 64 + 4 * data[begin].astype(np.int64) + np.minimum(end - begin, 4) - 1, shape).astype(np.uint64) + np.uint64(1)
    two, three = text[1:] == text[:-1], text[2:] == text[:-2]
    m = lambda k: np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1))
    same = (word[2:] == word[1:-1]) + 2 * (word[1:-1] == word[:-2]) + 4 * (word[2:] == word[:-2])
    kinds = [
        (word, text),
        ((word[:-1] * m(1) + word[1:])[two], text[1:][two]),
        (shape, text),
        ((shape[:-1] * m(1) + shape[1:])[two], text[1:][two]),
        ((shape[:-2] * m(2) + shape[1:-1] * m(1) + shape[2:])[three], text[2:][three]),
        (same.astype(np.uint64)[three], text[2:][three]),
    ]
    return [((mix64(v + m(10 + k)) & np.uint64(SIZE - 1)).astype(np.int64), t) for k, (v, t) in enumerate(kinds)]


class Quality:
    """Bias and weights."""

    def __init__(self, bias: float, weights: np.ndarray) -> None:
        self.bias, self.weights = bias, weights

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability that each text is good."""
        total = np.full(len(at) - 1, self.bias)
        for feature, text in ngrams(data, at):
            n = np.bincount(text, minlength=len(total))
            total += np.bincount(text, weights=self.weights[feature], minlength=len(total)) / np.maximum(1, n)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def sparse(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text; the bias is feature SIZE."""
    data, at = utf8(texts)
    n, parts = len(at) - 1, []
    for feature, text in ngrams(data, at):
        each, times = np.unique(text * (SIZE + 1) + feature, return_counts=True)
        owner = each // (SIZE + 1)
        parts.append((owner, each % (SIZE + 1), times / np.maximum(1, np.bincount(text, minlength=n))[owner]))
    owner, feature, value = (np.concatenate([p[i] for p in parts] + [x]) for i, x in enumerate((np.arange(n), np.full(n, SIZE), np.ones(n))))
    each, where = np.unique(owner * (SIZE + 1) + feature, return_inverse=True)
    value = np.bincount(where, weights=value)
    cut = np.searchsorted(each // (SIZE + 1), np.arange(n + 1))
    return [(each[a:b] % (SIZE + 1), value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], passes: int = PASSES) -> np.ndarray:
    """Weights after so many passes over the rows, one step a row; the last weight is the bias."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    l1 = np.append(np.full(SIZE, L1), 0.0)  # the bias has no absolute penalty
    leader = lambda z, n, l1: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    for _ in range(passes):
        for (at, x), y in zip(rows, labels, strict=True):
            w, seen = leader(z[at], n[at], l1[at]), n[at]
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - y) * x
            z[at] += g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / ALPHA * w
            n[at] += g * g
    return leader(z, n, l1)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, longest: int = LONGEST, learner_rows: int = LEARNER_ROWS) -> Quality:
    """Weights from about `rows` labelled rows (label 1 is good, any other bad), drawn by a hash of the key, of whole texts of at most `longest` bytes.

    Rows without key, text or label don't count. The sample's size bounds what a learner holds; the driver gets one number for each feature.
    """
    prepare(labelled.sparkSession)
    known = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(label) == 1).cast("int").alias("y")).where("k is not null and y is not null")
    known = known.where(F.octet_length("t") <= longest)
    n = known.count()
    share, shards = rows / max(1, n), max(1, round(min(n, rows) / learner_rows))
    sample = known.where(hash01("k") < share).withColumns({"h": F.xxhash64("k", "t"), "shard": F.pmod(F.xxhash64("k", F.lit(1)), F.lit(shards)).cast("int")})

    def learn(part: pa.Table) -> pa.Table:
        part = part.sort_by([("h", "ascending"), ("y", "ascending")])
        vectors = [v for b in part.select(["t"]).to_batches(512) for v in sparse(b.column(0))]
        w = follow_the_leader(vectors, part.column("y").to_pylist())
        some = np.flatnonzero(w)
        return pa.table({"i": some, "w": w[some]})

    learned = sample.groupBy("shard").applyInArrow(learn, "i bigint, w double")
    n = sample.select("shard").distinct().count()
    weights = np.zeros(SIZE + 1)
    for r in learned.groupBy("i").agg(F.sum("w").alias("w")).collect():  # at most SIZE + 1 rows
        weights[r.i] = r.w / n
    return Quality(weights[-1], weights[:-1])


def judge(docs: DataFrame, model: Quality, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(key, score, predicted) of every row, from its whole text: predicted is 1 from a score of `cut` on.

    A null or empty text, or one of blanks only, has the score that the bias alone gives; repeated rows, and rows without a key, are each answered.
    """
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("t"))
    kind, shared = docs.schema[key].dataType.simpleString(), prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES):
                score = shared.value.score(*utf8(part.column("t")))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(score), pc.cast(pa.array(score >= cut), pa.int32())], [key, "score", "predicted"])

    return rows.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
