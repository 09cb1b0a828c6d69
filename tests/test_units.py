"""Hand-computed values and properties."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prognos.functions import scalar as X
from prognos.operators import drift as D
from prognos.operators import evaluate as E
from prognos.operators import models as M
from prognos.operators import monitor as O
from prognos.operators import quality as V
from prognos.operators import registry as G
from prognos.operators import telemetry as T
from prognos.plans.q_models import g10_final_evaluation, m8_ridge, o1_o2_o4_scoring, o2_anomaly_scoring, t2_rolling_windows, t4_stream_counters, t6_scheduled_drift
from prognos.plans.views import events_telemetry, lineitem_telemetry, table
from prognos.streaming import stream as ST

DATA = "/root/testdata/sf0.001"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_regression_hand_values(spark):
    df = spark.createDataFrame([(0.0, 3.0), (0.0, 4.0), (0.0, 0.0), (0.0, 0.0)], "y double, p double")
    r = E.regression_report(df, "y", "p", []).first()
    assert r.rmse == pytest.approx(2.5) and r.r2 is None
    df = spark.createDataFrame([(13.0, 0.0), (0.0, 10.0)], "y double, p double")
    assert E.regression_report(df, "y", "p", []).first().nasa_score == pytest.approx(2 * (math.e - 1))


def test_rates_hand_values(spark):
    r = E.rates(spark.createDataFrame([(3, 1, 2, 4)], "tp long, fp long, fn long, tn long")).first()
    assert (r.precision, r.recall) == (pytest.approx(0.75), pytest.approx(0.6))
    r = E.rates(spark.createDataFrame([(0, 0, 0, 4)], "tp long, fp long, fn long, tn long")).first()
    assert (r.precision, r.recall, r.f1) == (0, 0, 0)


def test_psi_all_mass_in_one_of_four_bins(spark):
    terms = [(0.25, 1.0), (0.25, 0.0), (0.25, 0.0), (0.25, 0.0)]
    df = spark.createDataFrame(terms, "q double, p double")
    assert df.agg(F.sum(X.psi_term(F.col("q"), F.col("p"))).alias("x")).first().x == pytest.approx(6.90540806517888)


def test_window_of_one_to_five(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 6)], "unit long, cycle long, s double")
    r = T.window_features(df, ["s"], 5).first()
    assert (r.s_mean, r.s_std, r.s_min, r.s_max, r.s_slope) == (3, pytest.approx(2**0.5), 1, 5, pytest.approx(1))


def test_padding_and_unit_borders(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 4)] + [(2, i, 0.0) for i in range(1, 9)], "unit long, cycle long, s double")
    rows = T.sliding_windows(df, ["s"], 5, pad=True).collect()
    assert [[x.s for x in r.win] for r in rows if r.unit == 1] == [[1, 1, 1, 2, 3]]
    assert sum(r.unit == 2 for r in rows) == 4
    assert T.sliding_windows(df, ["s"], 5).where("unit = 1").count() == 0


def test_truncated_unit(spark):
    df = spark.createDataFrame([(1, i, 20) for i in range(1, 6)], "unit long, cycle long, true_rul long")
    assert [r.rul for r in T.add_rul_truncated(df).orderBy("cycle").collect()] == [24, 23, 22, 21, 20]
    with pytest.raises(ValueError):
        T.add_rul_truncated(df.drop("true_rul"))


@pytest.mark.parametrize("x,want", [(100, "none"), (30, "warning"), (20, "warning"), (15, "critical"), (1, "critical")])
def test_severity(spark, x, want):
    assert one(spark, X.severity(F.lit(x), 30)) == want


def test_erf_and_ks_tail(spark):
    for x in (-3.0, -0.5, 0.0, 0.3, 2.0):
        assert one(spark, X.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=2e-7)
    p = one(spark, X.kolmogorov_p(F.lit(1.36 / math.sqrt(50)), F.lit(100.0), F.lit(100.0)))
    assert p == pytest.approx(0.0495, abs=3e-4)


def test_gate(spark):
    rows = [("m", 1, "test_rmse", 0.78, 0.80, True), ("m", 2, "test_f1", 0.816, 0.80, True), ("m", 3, "test_f1", 0.81, 0.80, True), ("m", 4, "test_f1", 0.5, None, False), ("m", 5, "test_f1", 0.5, None, True), ("m", 6, "test_f1", None, 0.5, True)]
    df = spark.createDataFrame(rows, "model string, version long, metric string, candidate double, incumbent double, has_incumbent boolean")
    got = {r.version: (r.passes, r.reason) for r in G.gate(df).collect()}
    assert got == {1: (True, "improved"), 2: (True, "improved"), 3: (False, "not_enough"), 4: (True, "no_incumbent"), 5: (False, "incumbent_metric_missing"), 6: (False, "candidate_metric_missing")}


def test_quality_finds_planted_faults(spark):
    df = spark.createDataFrame([(1, 1, "L"), (1, 3, "X"), (2, 1, "M")], "unit long, cycle long, type string")
    found = V.violations("runs", V.contiguous(df), V.domain(df, "type", ["L", "M", "H"], "unit"), V.positive(df, "cycle", "unit"))
    assert sorted((r.check, r.key) for r in found.collect()) == [("contiguous", "1"), ("domain", "1")]
    with pytest.raises(ValueError, match="contiguous"):
        V.require_clean(found)


def test_running_totals_match_one_window(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 10007).alias("s"), F.lit(1).alias("n")).dropDuplicates(["g", "s"])
    got = {(r.g, r.s): r.cum_n for r in E.running_totals(df, ["g"], "s", ["n"]).collect()}
    rows = df.collect()
    for g in (0, 1, 2):
        for k, s in enumerate(sorted((r.s for r in rows if r.g == g), reverse=True), 1):
            assert got[g, s] == k


def test_bucket_quantile_open_bucket(spark):
    h = O.cumulative_histogram(spark.createDataFrame([("a", 1.0), ("a", 100.0), ("a", 200.0)], "k string, v double"), "v", [5.0, 10.0], ["k"])
    assert O.bucket_quantile(h, 0.9, ["k"]).first()["quantile"] == 10.0
    assert O.bucket_quantile(h, 0.2, ["k"]).first()["quantile"] == pytest.approx(3.0)


def test_drift_low_on_same_high_on_shifted(spark):
    t = table(spark, DATA, "lineitem").select(F.lit("q").alias("feature"), F.col("l_extendedprice").alias("value"), "l_orderkey")
    a, b = (t.where(f"l_orderkey % 2 = {k}").drop("l_orderkey") for k in (0, 1))
    frozen = D.freeze(a)
    assert D.psi(frozen, b).first().psi < 0.1 < 0.25 < D.psi(frozen, b.withColumn("value", F.col("value") * 3)).first().psi


def test_split_is_by_unit_and_repeatable(spark):
    t = T.split_by_unit(events_telemetry(spark, DATA))
    assert t.groupBy("unit").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert sorted(map(tuple, t.select("unit", "split").distinct().collect())) == sorted(map(tuple, T.split_by_unit(events_telemetry(spark, DATA)).select("unit", "split").distinct().collect()))


def test_stream_equals_batch(spark):
    batch = T.sliding_windows(events_telemetry(spark, DATA), ["sensor"], 30)
    want = sorted((r.unit, r.end_cycle, round(r.m, 6)) for r in batch.select("unit", "end_cycle", (F.aggregate("win", F.lit(0.0), lambda s, x: s + x["sensor"]) / 30).alias("m")).collect())
    got = sorted((r.user_id, r.seq, round(r["mean"], 6)) for r in t2_rolling_windows(spark, DATA).collect())
    assert got == want


def test_isolation_trees_take_rows_of_their_own(spark):
    # half of the rows make a tree; one that gets the only different row has a split
    rows = spark.range(64).select("id", F.array((F.col("id") == 5).cast("double")).alias("v"))
    forest = M.fit_isolation_forest(rows, ["id"], "v", trees=12, sample=32).collect()
    assert {json.loads(r.nodes)[0][0] for r in forest} == {-1, 0}


def test_model_queries_run_over_the_whole_sweeps(spark, monkeypatch):
    from prognos.plans import q_models as Q

    seen = []
    monkeypatch.setattr(Q, "grid", lambda spark, cells, job: seen.append(cells))
    for q, key, want in ((Q.g1_rul_baselines, "model", 4), (Q.g2_failure_baselines, "model", 3), (Q.g3_record_baselines, "model", 2), (Q.g4_window_sizes, "w", 4), (Q.g5_cap_ablation, "cap", 2), (Q.g6_class_weights, "weighted", 2), (Q.g7_compression_sweep, "k", 5), (Q.g12_stability, "model", 1)):
        q(spark, DATA)
        cells = seen.pop()
        assert len({c[key] for c in cells}) == want and {c["seed"] for c in cells} == {0, 1, 2, 3, 4} and len(cells) == want * 5
    events = events_telemetry(spark, DATA).groupBy("unit").count()
    assert Q.windows(spark, DATA).count() == events.select(F.sum(F.greatest(F.lit(0), F.col("count") - 29))).first()[0]


def test_scoring_requests_cover_every_row(spark):
    units = lineitem_telemetry(spark, DATA).groupBy("unit").count().where("count >= 10")
    assert o1_o2_o4_scoring(spark, DATA).count() == units.select(F.sum(F.col("count") - 9)).first()[0]


def test_stream_counts_every_window(spark):
    e = table(spark, DATA, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = {(str(r.since), r.event_type): r.requests for r in O.counters(e, "ts", ["event_type"]).collect()}
    streamed = [((r.since, r.event_type), r.requests) for r in t4_stream_counters(spark, DATA).collect()]
    assert dict(streamed) == counted and len(streamed) == len(counted)


def test_last_update_of_a_key_wins(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 5, 2), ("a", 3, 1), ("b", 7, 0)], "k string, requests long, batch int")
    assert {tuple(r) for r in ST.latest(df, ["k"], "batch").collect()} == {("a", 5), ("b", 7)}


def test_quantiles_match_a_sort(spark):
    rows = [(g, None if i % 7 == 0 else float((i * 37) % 91)) for g in ("a", "b") for i in range(200)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.q) for r in E.quantiles(df, "v", [0.0, 0.013, 0.5, 0.99, 1.0], ["g"]).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, [0.0, 0.013, 0.5, 0.99, 1.0]))).alias("q")).where("q is not null").collect()}
    assert set(got) == {"a", "b", "c"} and all(got[g][1] == pytest.approx(want[g]) for g in want) and got["c"] == (1, [5.0] * 5)
    assert E.quantiles(df, "v", [0.5], []).first().q == pytest.approx([df.agg(F.percentile("v", F.lit(0.5))).first()[0]])
    assert E.quantiles(df.where("false"), "v", [0.5], []).count() == 0


def test_drift_on_bad_data(spark):
    ref = spark.createDataFrame([("a", None), ("a", 1.0), ("b", 1.0), ("b", 2.0)], "feature string, value double")
    frozen = {r.feature: r for r in D.freeze(ref).collect()}
    assert frozen["a"].n == 1 and sum(frozen["a"].counts) == 1 and sum(frozen["b"].counts) == 2
    for empty in (ref.where("false"), ref.where("feature = 'b'"), ref.withColumn("value", F.lit(None).cast("double"))):
        for check in (lambda p: D.psi(D.freeze(ref), p), lambda p: D.input_drift(D.freeze(ref), ref, p)):
            with pytest.raises(Exception, match="no production values of a"):
                check(empty).collect()
    side = spark.createDataFrame([("x", v) for v in (-50.0, 0.0, 9.9, 10.0, 70.0)], "side string, value double")
    assert {r.bin: round(r.density * 5, 6) for r in D.density(side, 0.0, 10.0, 10).collect()} == {0: 1, 9: 2}


def test_scores_without_a_value_make_no_threshold(spark):
    df = spark.createDataFrame([(1, None), (1, 0.9), (0, 0.1), (0, None), (None, 0.5)], "y int, s double")
    assert tuple(E.max_f1(df, "y", "s", []).first()) == (0.9, 1.0)
    assert E.percentile_threshold(df.where("y = 1"), "s", 99, []).first().threshold == 0.9


def test_noise_is_gaussian(spark):
    df = T.perturb(spark.range(20_000).select("id", F.lit(5.0).alias("v")), ["v"], ["id"], 2.0, 0.25)
    n, mean, std, wide = df.agg(F.count("*"), F.avg("v"), F.stddev("v"), F.avg((F.abs(F.col("v") - 5) > 4).cast("double"))).first()
    assert abs(n / 20_000 - 0.75) < 0.02 and abs(mean - 5) < 0.06 and abs(std - 2) < 0.06 and abs(wide - 0.0455) < 0.01


def test_window_samples_count_a_row_once_for_each_window(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 8)], "unit long, cycle long, s double")
    got = D.window_samples(df.unionByName(df.where("cycle < 3").withColumn("unit", F.lit(2).cast("long"))), ["s"], 3).select("value", "times").orderBy("value").collect()
    assert [tuple(r) for r in got] == [(1.0, 1), (2.0, 2), (3.0, 3), (4.0, 3), (5.0, 3), (6.0, 2), (7.0, 1)]


def test_the_test_split_is_scored_once(spark):
    runs, done = spark.createDataFrame([(1,), (2,)], "run_id long"), spark.createDataFrame([(1, "val"), (2, "test"), (2, "test")], "run_id long, split string")
    assert [r.run_id for r in G.untested(runs, done).collect()] == [1]
    G.require_untested(runs.where("run_id = 1"), done)
    with pytest.raises(ValueError, match="2"):
        G.require_untested(runs, done)


def test_units_are_in_one_of_three_splits(spark):
    t = T.split_three(events_telemetry(spark, DATA))
    units = t.groupBy("unit").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s"))
    assert units.where("n > 1").count() == 0 and {r.s: r["count"] for r in units.groupBy("s").count().collect()} == {"train": 9, "val": 3, "test": 3}


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    x = rng.standard_normal((300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * rng.standard_normal(300)
    df = M.with_vector(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double"), ["a", "b", "c"])
    model = M.ridge(df, "y", alpha=5.0).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(3), xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6) and model.intercept == pytest.approx(y.mean() - x.mean(0) @ want, rel=1e-6)


def test_reconstruction_is_the_closed_form(spark):
    import numpy as np

    x = np.random.RandomState(1).standard_normal((80, 6)) * [5, 4, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.score for r in M.Reconstruction(df, "v", 2).score(df, "v").collect()}
    mean = x.mean(0)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2][:2].T
    # the axes are those of the centred rows, the projection as the detector's
    want = ((x - ((x - mean) @ axes @ axes.T + mean)) ** 2).mean(1)
    assert [got[i] for i in range(80)] == pytest.approx(want.tolist())


def test_models_beat_the_constant_predictor(spark):
    """With the event values replaced by a fading signal, ridge on window features must explain most of the remaining life."""
    rows = [(u, c, 100.0 - c + (u * c) % 3) for u in range(20) for c in range(1, 60)]
    t = T.split_three(T.add_rul(spark.createDataFrame(rows, "unit long, cycle long, sensor double")))
    from prognos.plans import q_models as Q

    w = T.window_features(t.withColumn("rul", F.col("rul").cast("double")).withColumn("will_fail", (F.col("rul") <= 15).cast("long")), ["sensor"], 10)
    got = {r.split: r for r in Q.regression(w, lambda train: M.ridge(train, "rul")).collect()}
    assert set(got) == {"val", "test"} and all(r.r2 > 0.9 for r in got.values())
    held = {r.split: r for r in Q.classification(w, lambda train: M.logistic(train, "will_fail")).collect()}
    assert held["val"].threshold == held["test"].threshold and all(r.pr_auc > 0.9 and r.f1 > 0.85 for r in held.values())


def test_reports_of_the_given_tables(spark):
    assert {r.split for r in m8_ridge(spark, DATA).collect()} == {"val", "test"}
    final = g10_final_evaluation(spark, DATA).collect()
    assert {(r.model, r.style) for r in final} == {(m, s) for m in ("isolation", "reconstruction", "fused") for s in ("max_f1", "at_precision", "percentile")}


def test_anomaly_model_on_the_scoring_path(spark):
    rows = o2_anomaly_scoring(spark, DATA).collect()
    flagged = [r.is_anomaly for r in rows if r.healthy]
    assert all(r.note is None and r.anomaly_score == pytest.approx(sum(r.sensors.values()) / 2) for r in rows) and 0.002 < sum(flagged) / len(flagged) <= 0.02
    from prognos.operators import scoring as S

    df = spark.createDataFrame([(1, 0.5)], "id long, s double")
    none = S.score_anomaly(df, None, None).first()
    assert (none.anomaly_score, none.is_anomaly, none.sensors, none.note) == (None, None, None, "no anomaly model")
    assert S.score_anomaly(df, F.col("s"), None).first().note == "no threshold"


def test_stream_drift_keeps_its_cooldown(spark):
    rows = t6_scheduled_drift(spark, DATA).orderBy("batch").collect()
    assert len(rows) == 4 and rows[0].triggered
    last = None
    for r in rows:  # a week apart at least
        assert r.triggered == (last is None or (r["at"] - last).total_seconds() >= 7 * 86400) and r.reason == ("triggered" if r.triggered else "cooldown")
        last = r["at"] if r.triggered else last


def test_series_split_before_the_first_anomaly(spark):
    rows = [("a", i, i in (4, 5)) for i in range(8)] + [("b", i, False) for i in range(3)] + [("c", 0, True), ("c", 1, False)]
    df = spark.createDataFrame(rows, "series string, at long, bad boolean")
    part = lambda overlap: {(r.series, r["at"]): (r.in_train, r.in_test) for r in T.healthy_prefix(df, "series", "at", "bad", overlap).collect()}
    assert part(False) == {("a", i): (i < 4, i > 3) for i in range(8)}
    assert part(True)["a", 3] == (True, True)


def test_windows_refuse_gaps_where_asked(spark):
    df = spark.createDataFrame([(1, c, 0.0) for c in (1, 2, 3)] + [(7, c, 0.0) for c in (1, 2, 4, 5)], "unit long, cycle long, s double")
    assert T.sliding_windows(df, ["s"], 2).count() == 5 and T.sliding_windows(df.where("unit = 1"), ["s"], 2, require_contiguous=True).count() == 2
    with pytest.raises(Exception, match="gap in unit 7"):
        T.sliding_windows(df, ["s"], 2, require_contiguous=True).collect()


def test_choices_at_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1), (1, 0.5), (2, 0.5)], "p int, f1 double")
    assert tuple(E.arg_max(df, "p", "f1").first()) == (1, 0.5)
    assert [r.p for r in E.top_scores(df, "f1", "p", 2).collect()] == [1, 1]
    runs = spark.createDataFrame([("m", 1, 2.0), ("m", 2, 4.0), ("a", 3, 3.0)], "model string, run int, rmse double")
    assert [tuple(r) for r in E.leaderboard(runs, "model", "run", "rmse").orderBy("rank").collect()] == [("a", "3.000 ± 0.000", "3", 1), ("m", "3.000 ± 1.000", "1,2", 2)]
    assert {tuple(r) for r in M.majority_class(spark.createDataFrame([("x",), ("y",)], "l string"), "l").collect()} == {("x", 0), ("y", 1)}
    assert M.assign_condition(spark.createDataFrame([(5.0,)], "q double"), [(0.0,), (10.0,)], ["q"], [1.0]).first().condition == 0


def test_reporting_only_leaves_the_state_alone(spark):
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    scores, state = spark.createDataFrame([("a", 0.3), ("b", 0.1), ("c", 0.3)], "target string, score double"), spark.createDataFrame([("c", "2024-01-02 11:00:00")], "target string, t string").select("target", F.col("t").cast("timestamp").alias("last_trigger"))
    decisions = D.decide(scores, state, 0.25, 7200, now)
    assert {r.target: r.reason for r in decisions.collect()} == {"a": "triggered", "b": "below_threshold", "c": "cooldown"}
    assert [r.target for r in D.state_rows(decisions, now).collect()] == ["a"] and D.state_rows(decisions, now, report_only=True).count() == 0


def test_one_fit_serves_the_whole_compression_sweep(spark, monkeypatch):
    from prognos.plans import q_models as Q

    fits, real = [], M.Reconstruction.__init__
    monkeypatch.setattr(M.Reconstruction, "__init__", lambda self, *a: (fits.append(a[-1]), real(self, *a))[1])
    got = Q.g7_compression_sweep(spark, DATA).collect()
    assert fits == [32] and len(got) == 15 and all(r.seeds == 5 and r.std == 0 for r in got)
    # a fit with its own k gives the same rates
    v = Q.kept(Q.vectors(spark, DATA), "vectors")
    own = dict(Q.values(Q.anomaly_rates(Q.detector(v, 4).score(v, "v"))))
    assert {r.metric: r["mean"] for r in got if '"k":"4"' in r.model} == pytest.approx(own)


def test_all_trees_at_once_are_the_trees_one_by_one(spark):
    rng = np.random.RandomState(5)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.standard_normal((700, 5)))], "id long, v array<double>")
    forest = M.fit_isolation_forest(rows, ["id"], "v", trees=9, sample=64)
    trees = [json.loads(r.nodes) for r in forest.collect()]

    def depth(nodes, x):
        at = 0
        while nodes[at][0] >= 0:
            f, cut, left, right, _ = nodes[at]
            at = left if x[f] < cut else right
        return nodes[at][4]

    for r in rows.select("v", M.isolation_score(forest, "v", 64).alias("score")).collect():
        assert r.score == pytest.approx(2 ** (-sum(depth(t, r.v) for t in trees) / 9 / M._path(64)))


def test_trees_of_a_large_table_draw_from_a_pool_of_its_rows(spark):
    rows = spark.range(0, 40_000, 1, 4).select("id", F.array(F.col("id").cast("double")).alias("v"))
    forest = M.fit_isolation_forest(rows, ["id"], "v", trees=4, sample=16)
    assert "pool" in forest._jdf.queryExecution().toString()
    trees = [json.loads(r.nodes) for r in forest.collect()]
    cuts = [c for t in trees for f, c, *_ in t if f >= 0]
    assert len(trees) == 4 and len({json.dumps(t) for t in trees}) == 4 and min(cuts) < 10_000 and max(cuts) > 30_000


def test_vectors_of_lags_are_the_windows(spark):
    df = spark.createDataFrame([(u, c, float(u * c % 7), None if c == 4 else float(c)) for u in (1, 2) for c in range(1, 9)] + [(3, 1, 0.0, 0.0)], "unit long, cycle long, a double, b double")
    flat = {(r.unit, r.end_cycle): r.v for r in T.flat_windows(df, ["a", "b"], 3).collect()}
    assert flat == {(r.unit, r.end_cycle): [x for s in r.win for x in (s.a, s.b)] for r in T.sliding_windows(df, ["a", "b"], 3).collect()} and len(flat) == 12
    assert flat == {(r.unit, r.end_cycle): r.v for r in T.flat_windows(df, ["a", "b"], 3, block=3).collect()}


def test_errors_alone_are_those_of_the_rebuilt_vector(spark):
    x = np.random.RandomState(1).standard_normal((60, 6)) * [5, 4, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    fit = M.Reconstruction(df, "v", 2)
    for r in fit.score(df, "v").withColumns({"e": fit.error("v"), "by": fit.sensor_errors("v", 2)}).collect():
        square = (np.array(r.v) - r.xhat) ** 2
        assert r.e == pytest.approx(r.score) and r.by == pytest.approx([square[0::2].mean(), square[1::2].mean()])


def test_cells_without_a_random_part_run_once(spark):
    ran = []
    job = M.seedless(lambda c: (ran.append((c["model"], c["seed"])), [("m", float(c["seed"] * (c["model"] == "forest")))])[1], lambda c: c["model"] != "forest")
    got = M.run_grid([{"model": m, "seed": s} for m in ("ridge", "forest") for s in range(5)], job, spark).collect()
    assert sorted(ran) == [("forest", s) for s in range(5)] + [("ridge", 0)]
    assert sorted((json.loads(r.cell)["model"], json.loads(r.cell)["seed"], r.value) for r in got) == [("forest", s, float(s)) for s in range(5)] + [("ridge", s, 0.0) for s in range(5)]


def test_clusters_of_distinct_points_are_those_of_the_rows(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    t = lineitem_telemetry(spark, DATA)
    points = M.points(t, ["quantity", "discount"])
    assert points.count() <= 550 < t.count() == points.agg(F.sum("weight")).first()[0]
    rows = M.with_vector(t, ["quantity", "discount"]).select("features").persist()
    plain = min((KMeans(k=3, seed=s).fit(rows) for s in range(10)), key=lambda m: m.summary.trainingCost)
    model = M.conditions(t, ["quantity", "discount"], 3)
    assert model.summary.trainingCost == pytest.approx(plain.summary.trainingCost, rel=1e-3)
    got = {r.k: r.silhouette for r in M.choose_k(t, ["quantity", "discount"], [2, 3]).collect()}
    want = {k: ClusteringEvaluator().evaluate(KMeans(k=k, seed=1).fit(rows).transform(rows)) for k in (2, 3)}
    assert got == pytest.approx(want, abs=2e-3)


def test_scored_requests_know_their_health_without_a_join(spark):
    df = o2_anomaly_scoring(spark, DATA)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    t = T.sliding_windows(T.add_rul(lineitem_telemetry(spark, DATA)), ["quantity"], 10).where("unit % 9 <> 0")
    want = {f"{r.unit}-{r.end_cycle}": True if r.rul >= 125 else None for r in t.select("unit", "end_cycle", "rul").collect()}
    assert {r.id: r.healthy for r in df.collect()} == want


def test_windows_of_sizes_are_those_of_each_size(spark):
    """Also where values are missing, or all of a window's are equal or missing."""
    value = lambda u, c: None if (u * c) % 7 == 3 or (u == 2 and c < 25) else 5.0 if u == 3 else math.sin(u * c) * 100 + c
    df = spark.createDataFrame([(u, c, value(u, c)) for u in range(1, 6) for c in range(1, 41)], "unit long, cycle long, x double")
    wide = T.window_features_of_sizes(df, ["x"], [4, 6, 10, 20])
    names = [f"x_{n}" for n in ("mean", "std", "min", "max", "slope")]
    for w in (4, 6, 10, 20):
        got = {(r.unit, r.end_cycle): r for r in wide.where(f"place >= {w}").collect()}
        want = T.window_features(df, ["x"], w).collect()
        assert len(got) == len(want) == 5 * (41 - w)
        for r in want:
            found = [got[r.unit, r.end_cycle][f"{n}_{w}"] for n in names]
            assert [x is None for x in found] == [r[n] is None for n in names]
            assert [x or 0.0 for x in found] == pytest.approx([r[n] or 0.0 for n in names], rel=1e-9, abs=1e-9), (w, r)
    shared = wide._jdf.queryExecution().executedPlan().toString()
    assert shared.count("Exchange hashpartitioning") == 1


def test_boosting_on_cells_is_boosting_on_their_rows(spark):
    from pyspark.ml.regression import GBTRegressor

    rows = spark.createDataFrame([(float(i % 37), float(i * i % 11), float(i % 5 == 0), math.sin(i % 37) * 9 + (i * i) % 11 + i % 3) for i in range(4000)], "a double, b double, c double, y double")
    boosted = M.boosted_regressor(["a", "b", "c"], "y", 1, rounds=5)
    to_bins, to_vector = boosted.binned(rows)
    cells = boosted.cells(rows, to_bins)
    assert cells.count() <= 32 * 11 * 2 and cells.agg(F.sum("weight")).first()[0] == 4000
    binned = to_vector.transform(to_bins.transform(rows))
    plain = GBTRegressor(featuresCol="_bins", labelCol="y", maxIter=5, seed=1).fit(binned).transform(binned)
    want = sorted((r.a, r.b, r.c, r.y, round(r.prediction, 6)) for r in plain.collect())
    got = boosted.fit(rows).transform(rows)
    assert sorted((r.a, r.b, r.c, r.y, round(r.prediction, 6)) for r in got.collect()) == want
    few = M.boosted_regressor(["b", "c"], "y", 1, rounds=5)  # of few values, each is a bin, as in Spark's own trees
    direct = M.with_vector(rows, ["b", "c"])
    direct = GBTRegressor(labelCol="y", maxIter=5, seed=1).fit(direct).transform(direct)
    assert sorted((r.b, r.c, r.y, round(r.prediction, 6)) for r in few.fit(rows).transform(rows).collect()) == sorted((r.b, r.c, r.y, round(r.prediction, 6)) for r in direct.collect())
    with pytest.raises(Exception, match="(?i)nan|null"):
        boosted.fit(rows.withColumn("y", F.when(F.col("a") > 3, F.col("y"))))
    with pytest.raises(ValueError, match="null"):
        boosted.fit(rows.withColumn("b", F.when(F.col("a") > 3, F.col("b"))))


def test_a_stratified_split_cuts_at_the_quantile_of_each_class_without_ordering_it(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") == 7, "one").when(F.col("id") != 9, "often").alias("y"))
    hashed = df.withColumn("_h", T.md5_01("id", seed=42))
    cut = E.quantiles(hashed, "_h", [0.3], ["y"]).select("y", F.col("q")[0].alias("cut"))
    want = {(r.id, r.split) for r in hashed.join(cut, "y").select("id", F.when(F.expr("_h < cut"), "val").otherwise("train").alias("split")).collect()}
    for buckets in (4, 65_536):
        monkeypatch.setattr(T, "BUCKETS", buckets)
        with monkeypatch.context() as m:
            m.setattr("prognos.operators.ordered.dealt", lambda *a: pytest.fail("all rows are ordered"))
            got = T.split_stratified(df, "y", ["id"], 0.3)
        assert {(r.id, r.split) for r in got.collect()} == want and len(want) == 2999 and got.columns == ["y", "id", "split"]
        assert all("/hashed-" in f or "/cut-" in f for f in got.inputFiles())


def test_windows_are_made_of_batches_and_not_summed_anew_at_every_row(spark):
    """A window may begin some batches before its last row's; values may be missing or not a number."""
    from prognos.plans import q_models as Q

    plan = Q.windows(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "-29" not in plan
    value = lambda u, c: None if (u * c) % 7 == 3 else math.nan if (u, c) == (4, 20) else math.sin(u * c) * 100 + c
    df = spark.createDataFrame([(u, c, value(u, c)) for u in range(1, 6) for c in range(1, 41)], "unit long, cycle long, x double")
    want = {(r.unit, r.end_cycle): r for r in T.window_features(df, ["x"], 10).collect()}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for batch in (1, 4, 60):
            spark.conf.set(size, batch)
            got = T.window_features_of_sizes(df.repartition(2, "unit"), ["x"], [10]).collect()
            assert {(r.unit, r.end_cycle) for r in got} == set(want) and len(got) == len(want) == 5 * 31
            for r in got:
                for n in ("mean", "std", "min", "max", "slope"):
                    assert r[f"x_{n}_10"] == pytest.approx(want[r.unit, r.end_cycle][f"x_{n}"], rel=1e-9, abs=1e-9, nan_ok=True), (batch, n, r)
    finally:
        spark.conf.set(size, before)


def test_five_fits_run_at_once_on_evenly_dealt_cells(spark):
    from threading import Barrier

    gate = Barrier(5, timeout=20)
    assert M.run_grid([{"seed": s} for s in range(5)], lambda c: [("waited", float(gate.wait() >= 0))], spark).count() == 5
    rows = spark.range(0, 1000, numPartitions=1)
    for least, most, want in ((50_000, 500_000, 1), (300, 500_000, 4), (1, 500_000, 4), (1, 100, 10)):
        sizes = M.dealt(rows, least, most).groupBy(F.spark_partition_id()).count().select("count").collect()
        assert len(sizes) == want and max(r[0] for r in sizes) <= 1000 / want + 2


def test_weighted_metrics_are_those_of_repeated_rows(spark):
    from prognos.plans import q_models as Q

    cells = spark.createDataFrame([(("val", "test")[i % 2], i * i % 3 % 2, i * 7 % 10 / 10, i % 4 + 1) for i in range(40)], "split string, y long, score double, n long")
    rows = cells.withColumn("_", F.explode(F.sequence(F.lit(1), "n")))
    plain = lambda df: sorted((r.split, *[round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert plain(Q.held_out_report(cells, [], "n")) == plain(Q.held_out_report(rows, []))
    assert plain(Q.at_target_precision(cells, 0.4, "n")) == plain(Q.at_target_precision(rows, 0.4))
    assert plain(E.regression_report(cells, "y", "score", ["split"], "n")) == plain(E.regression_report(rows, "y", "score", ["split"]))
    assert E.regression_report(cells.withColumn("y", F.lit(0.1)), "y", "score", [], "n").first().r2 is None
    assert E.average_precision(cells, "y", "score", [], "n").first()[0] == pytest.approx(E.average_precision(rows, "y", "score", []).first()[0])


def forest_rows(spark):
    rng = np.random.RandomState(3)
    a, b, c = rng.standard_normal(3000).round(2), rng.randint(0, 11, 3000), rng.rand(3000) < 0.3
    y = np.floor(10 * np.sin(a) + 2 * b + 5 * c + 3 * rng.standard_normal(3000))
    z = y + 4 * rng.standard_normal(3000) > 12
    rows = [(("train", "train", "val", "test")[i % 4], float(a[i]), float(b[i]), float(c[i]), float(y[i]), int(z[i])) for i in range(3000)]
    return spark.createDataFrame(rows, "split string, a double, b double, c double, y double, z long")


def test_a_forest_on_cells_is_a_forest_on_their_rows(spark):
    """Without bags and with all columns at every node a tree is Spark's own, to every row."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    rows = forest_rows(spark)
    rows = rows.unionByName(rows.where("split <> 'val'"))  # cells of several rows
    vectors = M.with_vector(rows, ["a", "b", "c"])
    one = {"numTrees": 1, "maxDepth": 6, "bootstrap": False, "featureSubsetStrategy": "all", "seed": 1}
    counts = lambda df, label, n: {(r.split, r[label], r.s): r.n for r in df.groupBy("split", label, F.round("score", 9).alias("s")).agg(n.alias("n")).collect()}
    for label, balanced in (("y", False), ("z", True)):
        forest = M.CellForest(["a", "b", "c"], label, 1, balanced, trees=1, depth=6)
        forest.tries, forest.bag = 3, False
        train, rest = vectors.where("split = 'train'"), vectors.where("split <> 'train'")
        if balanced:
            plain = M.positive_probability(RandomForestClassifier(labelCol="z", weightCol="weight", **one).fit(M.weighted(train, "z")).transform(rest))
        else:
            plain = RandomForestRegressor(labelCol="y", **one).fit(train).transform(rest).withColumn("score", F.col("prediction"))
        got = counts(forest.scores(rows), label, F.sum("n"))
        assert got == counts(plain, label, F.count("*")) and sum(got.values()) == rest.count()


def test_bags_and_columns_of_a_forest_on_cells(spark):
    rows = forest_rows(spark)
    forest = M.CellForest(["a", "b", "c"], "y", 1, trees=40, depth=8)
    one, again = ({(tuple(r.values())) for r in (x.asDict() for x in forest.scores(df).collect())} for df in (rows, rows.repartition(7).sortWithinPartitions("b")))
    assert one == again  # of the seed alone
    plain = M.forest_regressor("y", 1, 40, 8).fit(M.with_vector(rows.where("split = 'train'"), ["a", "b", "c"]))
    want = {r.split: r for r in E.regression_report(plain.transform(M.with_vector(rows.where("split <> 'train'"), ["a", "b", "c"])), "y", "prediction", ["split"]).collect()}
    for r in E.regression_report(forest.scores(rows), "y", "score", ["split"], "n").collect():
        assert r.rmse == pytest.approx(want[r.split].rmse, rel=0.05)
    # a bag holds each of a cell's rows by itself: the share of two cells of 100 rows varies as that of 200 rows, not of two
    x, y, n = np.zeros((2, 1), np.uint8), np.array([0.0, 1.0]), np.array([100, 100])
    roots = [M.grow_tree(x, y, n, None, np.random.default_rng([1, t]), 3, 32, 1, True, True)[-1][0] for t in range(500)]
    assert np.mean(roots) == pytest.approx(0.5, abs=0.01) and np.std(roots) == pytest.approx(0.5 / math.sqrt(200), rel=0.15)


def test_more_cells_than_a_task_takes_go_to_sparks_own_forest(spark):
    rows = forest_rows(spark)
    for label, balanced in (("y", False), ("z", True)):
        got = M.CellForest(["a", "b", "c"], label, 1, balanced, trees=3, depth=4, most=10).scores(rows)
        assert got.columns == ["split", label, "score", "n"] and got.agg(F.sum("n")).first()[0] == got.count() == rows.where("split <> 'train'").count()
    with pytest.raises(Exception, match="(?i)nan|null|float"):
        M.CellForest(["a", "b", "c"], "y", 1).scores(rows.withColumn("b", F.when(F.col("a") > 0, F.col("b")))).collect()


def test_records_forests_are_fitted_on_cells(spark, monkeypatch):
    from prognos.plans import q_models as Q

    monkeypatch.setattr(M, "forest_classifier", lambda *a, **k: pytest.fail("the forest reads rows"))
    monkeypatch.setattr(Q, "grid", lambda spark, cells, job: [job(c) for c in cells if c["model"] == "forest" and c["seed"] < 2])
    got = Q.g3_record_baselines(spark, DATA)
    assert [[m for m, _ in g] for g in got] == [["pr_auc"]] * 2 and all(0 < g[0][1] < 1 for g in got)


def test_failure_forests_are_fitted_on_cells(spark, monkeypatch):
    from prognos.plans import q_models as Q

    monkeypatch.setattr(M, "forest_classifier", lambda *a, **k: pytest.fail("the forest reads rows"))
    monkeypatch.setattr(Q, "grid", lambda spark, cells, job: [job(c) for c in cells if c["model"] == "forest" and c["seed"] < 1])
    names = [m for m, _ in Q.g2_failure_baselines(spark, "/root/testdata/sf0.01")[0]]
    want = ["pr_auc", "roc_auc", "threshold", "precision", "recall", "f1", "reached"]
    assert {f"{split}_{m}" for split in ("val", "test") for m in want} <= set(names)


def test_rows_of_leaves_are_left_out_by_place_and_blocks_change_nothing(spark):
    rng = np.random.RandomState(5)
    x, n = rng.randint(0, 32, (5000, 4)).astype(np.uint8), rng.randint(1, 9, 5000)
    y = (x[:, 0] + x[:, 1] > 40 + rng.randint(-8, 8, 5000)).astype(float)
    whole, parts = (M.grow_tree(x, y, n, np.array([0.5, 2.0])[y.astype(int)], np.random.default_rng(1), 9, 32, 2, True, True, block) for block in (1 << 16, 100))
    assert all((a == b).all() for a, b in zip(whole[:3], parts[:3], strict=True)) and whole[3] == pytest.approx(parts[3], abs=1e-12) and len(whole[0]) > 50


def test_life_forests_are_fitted_on_cells(spark, monkeypatch):
    from prognos.plans import q_models as Q

    monkeypatch.setattr(M, "forest_regressor", lambda *a, **k: pytest.fail("the forest reads rows"))
    monkeypatch.setattr(Q, "grid", lambda spark, cells, job: [dict(job(c)) for c in cells if c["model"] == "forest" and c["seed"] < 1])
    got = Q.g1_rul_baselines(spark, "/root/testdata/sf0.01")[0]
    assert {f"{split}_{m}" for split in ("val", "test") for m in ("rmse", "mae", "r2", "nasa_score")} == set(got)
