"""Hard negatives against brute force, whitening against a plain eigendecomposition, quality on held-out labels, all on awkward tables."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prognos.llm import negatives, quality, whiten
from prognos.llm.common import table
from prognos.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


# ---- hard negatives --------------------------------------------------------------------------------------------------------


def brute_negatives(rows, is_anchor, positives=5, negatives_=5, low=80, high=100):
    rows = [(k, lab, [math.floor(256 * c) for c in x]) for k, lab, x in rows if k is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    dim = max((len(x) for *_, x in rows), default=0)
    rows = [(k, lab, np.array(x + [0] * (dim - len(x)), dtype=object)) for k, lab, x in rows]
    out = []
    for i, (k, lab, x) in enumerate(rows):
        if not is_anchor(k):
            continue
        scored = [(-int(sum(x * y)), j, m) for n, (j, m, y) in enumerate(rows) if n != i]
        for s, p, _ in sorted(r for r in scored if r[2] == lab)[:positives]:
            near = sorted(r for r in scored if r[2] != lab and low * -s <= 100 * -r[0] <= high * -s)[:negatives_]
            out += [(k, p, rank, j, -s, -t) for rank, (t, j, _) in enumerate(near, 1)]
    return sorted(out)


def clustered(seed, n=900, dim=6, groups=12):
    rng = np.random.RandomState(seed)
    centres = rng.standard_normal((groups, dim)) * 2
    at = rng.randint(0, groups, n)
    x = centres[at] + rng.standard_normal((n, dim)) * 0.02
    return [(i, int(rng.randint(0, 3)), [float(c) for c in v]) for i, v in enumerate(x)]


def mined(spark, rows, every=10, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **how).collect())


def test_negatives_equal_brute_force_in_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 50)
    rows = clustered(1)
    assert mined(spark, rows, leaf=20, fanout=4) == brute_negatives(rows, lambda k: k % 10 == 0)


def test_negatives_of_copies_ties_and_repeated_rows(spark):
    rng = np.random.RandomState(3)
    rows = [(int(i), int(rng.randint(0, 3)), [float(c) / 4 for c in rng.randint(-3, 4, 3)]) for i in range(200)]  # many equal vectors and scores
    rows += [(1000 + i, 1, [0.5, 0.5, 0.5]) for i in range(60)] + rows[:25] + rows[:7]  # a hot vector, and rows that repeat
    assert mined(spark, rows, leaf=20) == brute_negatives(rows, lambda k: k % 10 == 0)


def test_negatives_of_awkward_rows(spark):
    rows = [(0, 1, [0.5, 0.5]), (10, None, [0.5, 0.5]), (20, 1, None), (30, 1, [float("nan"), 1.0]), (40, 1, [float("inf"), 1.0]), (50, 1, [None, 1.0]), (None, 1, [0.5, 0.5])]
    rows += [(1, 1, [0.5]), (2, 2, [0.5, 0.25, 0.125]), (3, 2, []), (4, 2, [0.45, 0.5]), (5, 3, [-1.0, -1.0]), (60, 3, [0.0, 0.0]), (61, 3, [0.0])]
    want = brute_negatives(rows, lambda k: k is not None and k % 10 == 0)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for c in ("key", "x", "keys", "id", "leaf", "h1", "score"):
        df = df.withColumn(c, F.lit("extra"))
    df = df.withColumn("label", F.concat(F.lit("l"), F.col("label")))  # labels may be texts
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0).collect()) == want != []
    assert mined(spark, []) == [] and mined(spark, [(10, 1, [1.0]), (11, 2, [1.0])]) == []


def test_scores_beyond_floating_point_are_exact(spark):
    rows = [(i, i % 2, [float(2**20 + i * 7 % 13), float(2**20 - i * 5 % 11), 2.0**19]) for i in range(40)]
    assert mined(spark, rows) == brute_negatives(rows, lambda k: k % 10 == 0)
    with pytest.raises(Exception, match="fit|OVERFLOW"):
        mined(spark, [(i, i % 2, [1e10 + i]) for i in range(20)])


def test_ranges_leave_out_subtrees_but_no_row_of_a_ring(spark):
    """In clustered vectors most leaves are left out; whatever lies in a ring is in a leaf that is not."""
    rows = clustered(2, n=3000, groups=40)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    x = F.transform("embedding", lambda e: F.floor(256 * e))
    each = negatives.items(df.withColumn("x", x), "vec_id", "label", 6).persist()
    tree, placed = negatives.index(each, leaf=40)
    got = placed.toArrow()
    vectors, leaf = np.array(got.column("x").to_pylist(), float), got.column("leaf").to_numpy()
    assert sorted(got.column("id").to_pylist()) == sorted(r.id for r in each.select("id").collect()) and tree.leaves > 20
    q = vectors[:60]
    d = np.sqrt(((q[:, None] - vectors[None]) ** 2).sum(2) + tree.lift(vectors)[None] ** 2)
    for inner, outer in ((d.min(1), np.sort(d, 1)[:, 30]), (np.sort(d, 1)[:, 50], np.sort(d, 1)[:, 90]), (d.min(1) + 5, d.min(1) - 5)):
        a, b = tree.visits(q, inner, outer)
        seen = set(zip(a.tolist(), b.tolist(), strict=True))
        need = {(i, int(leaf[j])) for i, j in zip(*np.nonzero((d >= inner[:, None]) & (d <= outer[:, None])), strict=True)}
        assert need <= seen and len(seen) < 0.5 * len(q) * tree.leaves


# ---- whitening ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("m", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["random", "graded", "tied", "zero", "rank1", "diagonal"])
def test_components_are_eigenvectors(m, kind):
    rng = np.random.RandomState(m)
    q, _ = np.linalg.qr(rng.standard_normal((m, m)))
    e = {"random": rng.rand(m), "graded": 10.0 ** rng.uniform(-12, 3, m), "tied": 1.0 + np.arange(m) % 2, "zero": np.zeros(m), "rank1": np.eye(m)[0], "diagonal": rng.permutation(m) + 1.0}[kind]
    q = np.eye(m) if kind == "diagonal" else q
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    w, v = whiten.components(a, m)
    size = max(1.0, np.abs(e).max())
    assert np.abs(w - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * size and np.abs(v.T @ v - np.eye(m)).max() < 1e-12 and np.abs(a @ v - v * w).max() < 1e-11 * size
    some, _ = whiten.components(a, min(3, m))
    assert np.abs(some - w[: len(some)]).max() < 1e-12 * size


def test_polar_factor_is_orthogonal_even_where_badly_conditioned():
    rng = np.random.RandomState(8)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    a = (q * np.where(np.arange(20) % 2, 1, -1) * 10.0 ** np.linspace(-10, 0, 20)) @ q.T
    u = whiten.polar((a + a.T) / 2)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-12 and np.abs(u @ a - a @ u).max() < 1e-9


def plain_whitening(rows, k):
    x = {i: np.floor(256 * np.array(v, float)) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, {i: int(((n * w.astype(object) - s.astype(object)) ** 2).sum()) for i, w in x.items()}, {i: (w - s / n) @ v / np.sqrt(e) for i, w in x.items()}, e / np.trace(cov)


def check_whitened(got, rows, k):
    n, deviation, white, explained = plain_whitening(rows, k)
    by = collections.defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert set(by) == set(white) and all(sorted(c) == list(range(1, k + 1)) for c in by.values())
    for c in range(k):
        a, b = np.array([by[i][c + 1].whitened for i in white]), np.array([white[i][c] for i in white])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8  # one sign for all rows


def test_whitened_table_equals_a_plain_eigendecomposition(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").collect()]
    check_whitened(QUERIES["op13_whitened_embeddings"](spark, DATA).collect(), rows, 4)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.RandomState(5)
    good = [(i, [float(c) for c in rng.standard_normal(5)]) for i in range(30)]
    rows = good + [(100 + i, good[0][1]) for i in range(50)] + [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("-inf")] * 5)]
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("extra") for c in ("x", "y", "i", "n", "component")})
    check_whitened(whiten.whiten(make(rows), k=3).collect(), [r for r in rows if r[0] < 200], 3)
    short = [(1, [1.0, 2.0]), (2, [3.0]), (3, [])]
    check_whitened(whiten.whiten(make(short), k=1).collect(), [(1, [1.0, 2.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0])], 1)
    one = whiten.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()  # nothing varies
    assert sorted((r.vec_id or 0, r.component) for r in one) == [(i, c) for i in (0, 1, 2) for c in (1, 2)]
    assert all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    flat = whiten.whiten(make([(i, [float(i), 1.0]) for i in range(5)])).collect()  # the second component has no variance
    assert all((r.whitened is None) == (r.component == 2) and r.explained in (1.0, 0.0) and r.identity_error < 1e-12 for r in flat) and len(flat) == 10
    for empty in ([], [(1, None)], [(1, [])]):
        assert whiten.whiten(make(empty)).collect() == [] and whiten.whiten(make(empty)).columns == whiten.whiten(make(good)).columns


def test_deviations_beyond_a_long_are_exact(spark):
    rows = [(i, [float(2**20 * i), 1.0]) for i in range(4)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    assert {r.vec_id: int(r.deviation) for r in got} == plain_whitening(rows, 1)[1]


# ---- quality ----------------------------------------------------------------------------------------------------------------


def test_ngrams_stay_inside_their_text_and_shares_add_up():
    texts = ["One two two!!", "", "one TWO  two !!\n", "x"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    got = quality.ngrams(np.frombuffer(b"".join(raw), np.uint8), at)
    assert [np.bincount(t, minlength=4).tolist() for _, t in got] == [[4, 0, 4, 1], [3, 0, 3, 0], [4, 0, 4, 1], [3, 0, 3, 0], [2, 0, 2, 0], [2, 0, 2, 0]]
    of = lambda k, t: got[k][0][got[k][1] == t].tolist()
    assert of(0, 0) == of(0, 2) and of(1, 0) == of(1, 2) and of(5, 0) == of(5, 2) and of(2, 0) != of(2, 2)
    alone = [quality.ngrams(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in raw]
    assert all(of(k, i) == alone[i][k][0].tolist() for k in range(6) for i in range(4))


def test_sparse_rows_and_scores_agree():
    import pyarrow as pa

    rng = np.random.RandomState(2)
    model = quality.Quality(0.3, rng.standard_normal(quality.SIZE))
    texts = ["A b!! c | d", "", None, "wörter wörter WÖRTER 12 ...", "a " * 500]
    from prognos.llm.common import utf8

    arr = pa.array(texts, pa.string())
    weights = np.append(model.weights, model.bias)
    want = [1 / (1 + math.exp(-float(weights[i] @ x))) for i, x in quality.sparse(arr)]
    assert np.allclose(model.score(*utf8(arr)), want, atol=1e-12)
    assert math.isclose(want[1], 1 / (1 + math.exp(-0.3))) and want[1] == want[2]


def test_steps_are_those_of_the_plain_rule():
    """Against the rule written out feature by feature."""
    rows, labels = [(np.array([1, 5, quality.SIZE]), np.array([0.5, 1.0, 1.0])), (np.array([5, quality.SIZE]), np.array([0.25, 1.0]))] * 3, [1, 0] * 3
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == quality.SIZE else quality.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for (at, x), y in zip(rows, labels, strict=True):
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, v, c in zip(at, x, w, strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * c
                n[i] += g * g
    got = quality.follow_the_leader(rows, labels, passes=2)
    assert all(math.isclose(got[i], weight(i), abs_tol=1e-12) for i in (1, 5, quality.SIZE)) and np.count_nonzero(got) <= 3


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op12_text_quality"](spark, d)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == table(spark, d, "documents").count()
    rows = got.where("held_out").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").collect()
    assert len(rows) > 60 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    bad, good = ([r.score for r in rows if r.quality == q] for q in (0, 1))
    assert sum(b < g for b in bad for g in good) >= 0.99 * len(bad) * len(good)


def test_quality_of_awkward_texts(spark):
    rows = [(1, None, 1), (2, "", 0), (3, " \n\t ", 1), (4, "one", None), (5, "word " * 30_000, 0), (6, "a b c", 1), (6, "a b c", 1), (None, "a b", 1), (7, "ÀÉ ñ 日本語 😀", 0), (8, "x" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumns({c: F.lit("extra") for c in ("t", "k", "y", "h", "score", "shard")})
    got = quality.judge(df, quality.fit(df)).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in quality.judge(df, quality.fit(df.where("false"))).collect()] == [0.5] * len(rows)
    assert quality.judge(df.where("false"), quality.fit(df)).count() == 0
    one = [r.score for r in quality.judge(df, quality.fit(df.where("quality = 1"))).collect()]  # one class only
    assert min(one) > 0.5


def test_oracle_is_given_for_negatives_only():
    assert "op11_hard_negatives" in ORACLES and "op12_text_quality" not in ORACLES
