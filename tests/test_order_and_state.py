"""Order in two passes, checks while writing, stored references, state that streams carry, and commits, against plain versions."""

import datetime
import functools
import hashlib
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prognos.operators import drift as D
from prognos.operators import evaluate as E
from prognos.operators import monitor as O
from prognos.operators import ordered
from prognos.operators import quality as V
from prognos.operators import registry as G
from prognos.operators import telemetry as T
from prognos.plans import q_drift, q_models, views
from prognos.plans.views import events_telemetry, table
from prognos.sources import readers as S
from prognos.storage import exists, scratch, stored
from prognos.streaming import stream as ST

DATA = "/root/testdata/sf0.001"
DAY = 86_400


def relations(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture(scope="module")
def series(spark):
    """Three series, one of them with most rows, in an order that is not that of the instants."""
    rng = random.Random(1)
    rows = [("hot" if i % 10 else rng.choice(["a", "b"]), rng.randint(0, 5000), i, float(rng.randint(0, 50))) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, at long, id long, v double")


# ---- order -------------------------------------------------------------------------------------------------------------------


def test_positions_are_those_of_a_sort(spark, series):
    got = {r.id: r.pos for r in ordered.positions(series, ["at", "id"], ["k"], ranges=16).collect()}
    rows = sorted(series.collect(), key=lambda r: (r.k, r["at"], r.id))
    count = {}
    for r in rows:
        count[r.k] = count.get(r.k, 0) + 1
        assert got[r.id] == count[r.k]
    whole = {r.id: r.pos for r in ordered.positions(series, ["at", "id"], ranges=16).collect()}
    assert [whole[r.id] for r in sorted(rows, key=lambda r: (r["at"], r.id))] == list(range(1, 3001))
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("x", 1), ("x", None)], "k string, at int")
    assert sorted((r.k or "", r["at"] or 0, r.pos) for r in ordered.positions(nulls, ["at"], ["k"]).collect()) == [("", 1, 1), ("", 2, 2), ("x", 0, 1), ("x", 1, 2)]
    assert ordered.positions(nulls.where("false"), ["at"]).count() == 0


def test_hash_ranks_are_those_of_a_sort(spark):
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r.h), 1)}
    assert {r.id: r.r for r in ordered.hash_ranks(df, "h", ["id"], "r").collect()} == want


def test_no_task_orders_all_units(spark):
    plan = T.split_three(events_telemetry(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert windows and all("_bucket" in line or "user_id" in line for line in windows)


@pytest.mark.parametrize("block", [7, 250])
def test_blocks_of_a_series_give_the_windows_of_the_whole(spark, series, block):
    s = ordered.positions(series, ["at", "id"], ["k"], "cycle")
    key = lambda df, c: sorted((r.k, r.end_cycle, round(r[c], 9) if isinstance(r[c], float) else tuple(x.v for x in r[c])) for r in df.collect())
    whole = lambda **how: T.window_features(s, ["v"], 6, 2, unit="k", cycle="cycle", **how)
    assert key(whole(), "v_mean") == key(whole(block=block), "v_mean") and key(whole(), "v_max") == key(whole(block=block), "v_max")
    wins = lambda **how: T.sliding_windows(s, ["v"], 6, 5, unit="k", cycle="cycle", **how)
    assert key(wins(), "win") == key(wins(block=block), "win")
    blocks = ordered.with_border(s, "cycle", 5, block).where("k = 'hot'")
    assert blocks.select("_block").distinct().count() >= 8 and blocks.where("_own").count() == s.where("k = 'hot'").count()
    with pytest.raises(ValueError, match="pad"):
        T.sliding_windows(s, ["v"], 6, pad=True, block=9)


def test_blocks_find_every_step_back(spark, series):
    e = series.withColumn("ts", F.timestamp_seconds("at"))
    want = {str(r.id) for r in e.withColumn("b", F.lag("ts").over(Window.partitionBy("k").orderBy("id"))).where("b > ts").collect()}
    got = {r.key for r in V.monotonic(e, "k", "id", "ts", block=11).collect()}
    assert got == want and len(want) > 1000


def test_increase_over_blocks_of_time(spark, series):
    e = series.withColumn("ts", F.timestamp_seconds("at"))
    w = Window.partitionBy("k").orderBy("at").rangeBetween(-20, 0)
    want = {r.id: r.n for r in series.withColumn("n", F.count("*").over(w)).collect()}
    assert {r.id: r.recent for r in O.increase(e, "ts", 20, ["k"]).collect()} == want  # 320 seconds a block, so 16 blocks
    lost = e.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))
    assert O.increase(lost, "ts", 20, ["k"]).first().recent is None


# ---- stored tallies and sketches ---------------------------------------------------------------------------------------------


def test_statistics_read_the_source_once(spark):
    ref, prod = map(D.tallied, q_drift.sides(spark, DATA))
    base = q_drift.frozen(ref)
    report = D.input_drift(base, ref, prod)
    assert "lineitem" not in report._jdf.queryExecution().optimizedPlan().toString() and "l_quantity" not in D.freeze(ref)._jdf.queryExecution().optimizedPlan().toString()


def test_ks_of_an_empty_side_is_null(spark):
    ref = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0)], "feature string, value double")
    for _ in range(3):
        rows = {r.feature: r for r in D.ks(ref, ref.where("feature = 'b'")).collect()}
        assert rows["a"].statistic is None and rows["a"].p_value is None and rows["b"].statistic == 0 and rows["b"].p_value == 1
    assert D.ks(ref.where("false"), ref.where("false")).count() == 0


def test_weighted_statistics_are_those_of_repeated_rows(spark):
    t = events_telemetry(spark, DATA).select("unit", "cycle", "sensor")
    weighed = D.window_samples(t, ["sensor"], 10)
    repeated = T.sliding_windows(t, ["sensor"], 10).select("unit", F.explode("win").alias("x")).select("unit", F.lit("sensor").alias("feature"), F.col("x.sensor").alias("value"))
    side = lambda df, k: df.where(f"unit % 2 = {k}")
    a, b = (D.tallied(side(weighed, k), "times") for k in (0, 1))
    c, e = (D.tallied(side(repeated, k).drop("unit")) for k in (0, 1))
    rows = [D.input_drift(D.freeze(x), x, y).select("psi", "statistic", "p_value", "mean_shift", "std_ratio").first() for x, y in ((a, b), (c, e))]
    assert tuple(rows[0]) == pytest.approx(tuple(rows[1]), rel=1e-9)
    assert tuple(D.freeze(a).select("n", "q01", "q50", "q99").first()) == pytest.approx(tuple(D.freeze(c).select("n", "q01", "q50", "q99").first()))
    assert "posexplode" not in weighed._jdf.queryExecution().optimizedPlan().toString()


def test_merged_sketches_are_near_the_exact_quantiles(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("day"), F.lit("x").alias("feature"), F.pow(F.col("id") * 7919 % 40_009, F.lit(1.5)).alias("value"))
    daily = stored(D.sketched(df.where("day < 6"), ["day"]), "sketches")
    more = D.sketched(df.where("day = 6"), ["day"])
    got = D.freeze_sketches(daily.unionByName(more)).first()
    x = np.sort(np.array([r.value for r in df.collect()]))
    ranks = [np.searchsorted(x, q, side="right") / len(x) for q in (got.q01, got.q50, got.q99, *got.edges)]
    assert got.n == 40_000 and max(abs(a - b) for a, b in zip(ranks, (0.01, 0.5, 0.99, *[k / 10 for k in range(1, 10)]), strict=True)) < 0.01
    assert D.freeze_sketches(daily.where("false")).count() == 0


def test_areas_of_one_curve(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), rng.randint(0, 40) / 40) for _ in range(400)]
    got = E.areas(spark.createDataFrame(rows, "y int, s double"), "y", "s", []).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert got.roc_auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    want, last = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, k = sum(s >= t for s in pos), sum(s >= t for _, s in rows)
        want, last = want + (tp - last) / len(pos) * tp / k, tp
    assert got.pr_auc == pytest.approx(want)


# ---- checks ------------------------------------------------------------------------------------------------------------------


def test_all_failures_come_from_one_scan(spark):
    t, order = V.in_runs(table(spark, DATA, "events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("cycle"), "value"))
    found = V.failures(t, [V.typed("value", "double", "unit"), V.above_zero("value", "unit"), order])
    assert relations(found) == 1
    df = spark.createDataFrame([(1, 1, "L"), (1, 3, "X"), (2, 1, None), (2, 2, "M"), (3, 1, "L"), (3, 1, "L")], "unit long, cycle long, type string")
    placed, order = V.in_runs(df)
    got = sorted((r.check, r.key, r.value or "") for r in V.failures(placed, [V.typed("type", "string", "unit"), V.within("type", ["L", "M"], "unit"), order]).collect())
    plain = sorted((r.check, r.key, r.value or "") for d in (V.contiguous(df), V.domain(df, "type", ["L", "M"], "unit")) for r in d.collect())
    assert got == sorted([*plain, ("type_or_null", "2", "")]) and ("contiguous", "3", "2") in got and ("contiguous", "1", "2") in got


def test_a_checked_write_tells_rows_apart_and_leaves_nothing_that_fails(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b"), (3, -1.0, "b")], "id long, v double, part string").withColumn("_mark", F.lit(1))
    rules = [V.above_zero("v", "id"), V.typed("v", "double", "id")]
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    V.write_checked(df.where("v > 0"), good, ["part"], "set", rules)
    assert sorted(map(tuple, spark.read.parquet(good).select("id", "v", "part").collect())) == [(1, 2.0, "a"), (2, 3.0, "b")]
    none = scratch(spark, "none")
    V.write_checked(df.where("false"), none, [], "set", rules)
    assert spark.read.parquet(none).columns == ["id", "v", "part"]
    with pytest.raises(ValueError, match="set: positive v 3=-1.0"):
        V.write_checked(df, bad, ["part"], "set", rules)
    assert not exists(spark, bad)
    report = V.verify_stored(spark, [("good", good, rules), ("strict", good, [V.within("part", ["a"], "id")]), ("bad", bad, rules)])
    assert sorted(map(tuple, report.collect())) == [("bad", "missing", 0, 0), ("good", "ok", 2, 0), ("strict", "invalid", 2, 1)]


def test_labels_of_a_file_in_many_splits(spark, tmp_path):
    values = [random.Random(2).randint(0, 10**6) for _ in range(5000)]
    text = "".join(f"{v}" + ("\n" if i % 7 == 0 else "  " if i % 5 else " \n\n ") for i, v in enumerate(values))
    (tmp_path / "labels.txt").write_text("\n  " + text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = S.read_labels(spark, str(tmp_path / "labels.txt"))
        assert got.rdd.getNumPartitions() >= 1 and [r.value for r in got.orderBy("pos").collect()] == values
        assert spark.read.text(str(tmp_path / "labels.txt")).rdd.getNumPartitions() > 8
        assert [r.pos for r in got.orderBy("pos").collect()] == list(range(1, 5001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "empty.txt").write_text(" \n")
    assert S.read_labels(spark, str(tmp_path / "empty.txt")).count() == 0


def test_digests_of_files_that_fit_no_row(spark, tmp_path):
    folder = tmp_path / "files"
    os.makedirs(folder)
    lines = [os.urandom(40).replace(b"\n", b"\0") for _ in range(3000)]
    (folder / "small.bin").write_bytes(b"tiny")
    (folder / "large.bin").write_bytes(b"\n".join(lines))
    read = lambda: {r.name: (r.digest, r.bytes) for r in S.manifest(spark, str(folder), whole=1000, lines=100).collect()}
    first = read()
    assert first["small.bin"] == (hashlib.sha256(b"tiny").hexdigest(), 4) and first["large.bin"][1] == len(b"\n".join(lines))
    pieces = [hashlib.sha256("".join(hashlib.sha256(x).hexdigest() for x in lines[i : i + 100]).encode()).hexdigest() for i in range(0, 3000, 100)]
    assert first["large.bin"][0] == hashlib.sha256((str(first["large.bin"][1]) + "".join(pieces)).encode()).hexdigest()
    before = stored(S.piece_digests(spark, str(folder), 1000, 100), "pieces")
    lines[1234] = b"x" * len(lines[1234])
    (folder / "large.bin").write_bytes(b"\n".join(lines))
    assert [r.piece for r in S.changed_pieces(S.piece_digests(spark, str(folder), 1000, 100), before).collect()] == [12]
    again = read()
    assert again["small.bin"] == first["small.bin"] and again["large.bin"] != first["large.bin"]


# ---- rules, versions ----------------------------------------------------------------------------------------------------------


def test_alert_states(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [("m", at(h), v) for h, v in enumerate([9.0, 1.0, 9.0, 9.0, 9.0])] + [("gap", at(h), 9.0) for h in (0, 1, 3, 4)] + [("calm", at(4), 1.0), ("old", at(0), 9.0), ("none", at(4), None)]
    df = spark.createDataFrame(rows, "metric string, at timestamp, value double")
    rules = [("hold", "m", 5.0, 7200, {"a": "b"}), ("long", "m", 5.0, 7201, {}), ("broken", "gap", 5.0, 7200, {}), ("calm", "calm", 5.0, 0, {}), ("stale", "old", 5.0, 0, {}), ("null", "none", 5.0, 0, {}), ("absent", "x", 5.0, 0, {})]
    got = {r.rule: (r.state, r.since, r.labels) for r in O.alerts(df, rules, 3600).collect()}
    assert got == {"hold": ("firing", at(2), {"a": "b"}), "long": ("pending", at(2), {}), "broken": ("pending", at(3), {}), "calm": ("ok", None, {}), "stale": ("unknown", None, {}), "null": ("unknown", None, {}), "absent": ("unknown", None, {})}


def test_two_promotions_leave_one_production_version(spark):
    v = G.VersionTable(spark, scratch(spark, "versions"))
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [("m", 1, 1, "production", t(0)), ("m", 2, 2, "staging", t(1)), ("m", 3, 3, "staging", t(2))]
    assert v.append(spark.createDataFrame(rows, G.VERSION_ROWS), 0) and not v.append(spark.createDataFrame(rows, G.VERSION_ROWS), 0)
    score = {1: 100.0, 2: 50.0, 3: 40.0}
    # each writer sees another candidate pass, as its metrics lack the other's
    metrics = {k: spark.createDataFrame([(r, "test_rmse", s) for r, s in score.items() if r in (1, k)], "run_id long, metric string, value double") for k in (2, 3)}
    gate, real = threading.Barrier(2), G.promote
    first = {2: True, 3: True}
    done = {}

    def promote(known, m, *a, **kw):
        out = real(known, m, *a, **kw)
        me = threading.current_thread().name
        if first.pop(int(me), False):
            gate.wait(60)  # both have read the same table
        return out

    G.promote = promote
    try:
        threads = [threading.Thread(name=str(k), target=lambda k=k: done.update({k: G.promote_committed(v, metrics[k], "test_rmse", f"2024-01-0{5 - k} 00:00:00")})) for k in (2, 3)]
        [x.start() for x in threads]
        [x.join() for x in threads]
    finally:
        G.promote = real
    seen, known = v.read(G.VERSION_ROWS)
    stages = {r.version: r.stage for r in G.current_stages(known).collect()}
    assert sorted(stages.values()).count("production") == 1 and seen == len(v.commits()) and set(done) == {2, 3}
    assert sum(x is not None for x in done.values()) == seen - 1  # every promotion that was told to have happened is a commit


def test_gate_tolerance_is_relative(spark):
    df = spark.createDataFrame([("m", 1, "rmse", 9800.0 * (1 + 1e-12), 10_000.0, True), ("m", 2, "rmse", 9801.0, 10_000.0, True)], "model string, version long, metric string, candidate double, incumbent double, has_incumbent boolean")
    assert {r.version: r.passes for r in G.gate(df).collect()} == {1: True, 2: False}


# ---- streams ------------------------------------------------------------------------------------------------------------------


def feed(spark, files, schema):
    """A stream of files, one a micro-batch, in this order."""
    path = scratch(spark, "feed")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path, ST.source(spark, path, spark.read.parquet(path).schema, 1)


def hour(h):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


def test_an_alert_fires_though_no_window_follows_and_silent_state_goes(spark):
    rows = [[("a", hour(0), True), ("b", hour(0), True)], [("b", hour(2), False), ("c", hour(1), True), ("c", hour(3), False)], [("d", hour(200), False)], [("d", hour(201), False)]]
    _, df = feed(spark, rows, "k string, at timestamp, bad boolean")
    out = scratch(spark, "out")
    alerts = ST.held_alerts(df, "k", "at", "bad", 7200, "1 hour", silence=10 * 3600)
    with ST.keyed_state(spark):
        q = alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    # b ended exactly when its hold did, c before
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", hour(0), hour(2)), ("c", hour(1), hour(3))][:1]
    run = [p.stateOperators[0].customMetrics for p in q.recentProgress if p.stateOperators]
    assert run and q.recentProgress[-1].stateOperators[0].numRowsTotal <= 12  # nothing of a, b and c: only d's last window and timers


def test_rows_out_of_order_are_released_in_order(spark):
    rng = random.Random(4)
    rows = [(u, hour(i), i, float(rng.randint(0, 99))) for u in (1, 2) for i in range(40)]
    files = [[] for _ in range(6)]
    for r in rows:
        files[min(5, (r[2] + rng.randint(0, 9)) // 8)].append(r)
    for f in files:
        rng.shuffle(f)
    files.append([(9, hour(400), 0, 0.0)])
    _, df = feed(spark, files, "u long, at timestamp, id long, v double")
    out = scratch(spark, "out")
    with ST.keyed_state(spark):
        ST.run_available(ST.rolling_windows(df, "u", "at", "v", 5, "20 hours", ["id"]), out, scratch(spark, "ck"))
    got = sorted((r.u, r.seq, list(r.win)) for r in spark.read.parquet(out).collect())
    values = {u: [v for x, _, _, v in sorted(rows, key=lambda r: (r[0], r[2])) if x == u] for u in (1, 2)}
    assert got == [(u, i + 5, values[u][i : i + 5]) for u in (1, 2) for i in range(36)]


def test_rolling_state_is_kept_by_bucket_and_not_by_unit(spark):
    rows = [[(u, hour(k * 4 + i), i, float(u * 100 + k * 4 + i)) for u in range(1, 121) for i in range(4)] for k in range(2)] + [[(-1, hour(400), 0, 0.0)]]
    _, df = feed(spark, rows, "u long, at timestamp, id long, v double")
    out = scratch(spark, "out")
    with ST.keyed_state(spark):
        q = ST.rolling_windows(df, "u", "at", "v", 3, "1 hour", ["id"], buckets=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.u, r.seq, r.at, list(r.win)) for r in spark.read.parquet(out).collect())
    assert got == [(u, i + 1, hour(i), [float(u * 100 + j) for j in (i - 2, i - 1, i)]) for u in range(1, 121) for i in range(2, 8)]
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 24


def test_a_batch_that_fails_between_sinks_is_in_all_of_them_once(spark, monkeypatch):
    rows = [[(u, hour(i), i, float(u + i)) for u in range(1, 13) for i in range(k * 10, k * 10 + 10)] for k in range(4)] + [[(-1, hour(900), 0, 0.0)]]
    path, df = feed(spark, rows, "user_id long, ts timestamp, event_id long, value double")
    monkeypatch.setattr(q_models, "score_batch", lambda rows, real=q_models.score_batch: {k: v for k, v in real(rows).items()})

    def windows(source):
        w = ST.rolling_windows(source, "user_id", "ts", "value", 30, "1 hour", ["event_id"])
        return w

    out, ck = scratch(spark, "out"), scratch(spark, "ck")
    real, broken = ST.commit, []

    def commit(to, batch, sinks):
        if len(broken) < 2 and batch >= 3 and not sinks["predictions"].isEmpty():
            sinks["predictions"].write.mode("overwrite").parquet(f"{to}/predictions/batch={batch}")  # killed after the first sink
            broken.append(batch)
            raise RuntimeError("killed")
        real(to, batch, sinks)

    monkeypatch.setattr(ST, "commit", commit)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            q_models.score_stream(spark, windows(df), out, ck)
        visible = [r.batch for r in spark.read.option("recursiveFileLookup", True).parquet(f"{out}/committed").collect()]
        assert broken[-1] not in visible
    q_models.score_stream(spark, windows(df), out, ck)
    # against one run over all that the batch version sees
    batch = T.sliding_windows(spark.read.parquet(path).where("user_id > 0").withColumn("cycle", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("long")), ["value"], 30, unit="user_id")
    plain = q_models.score_batch(batch.select("user_id", F.col("end_cycle").alias("seq"), F.transform("win", lambda x: x["value"]).alias("win")))
    assert broken[0] == broken[1]
    for name, want in plain.items():
        columns = want.columns
        assert sorted(map(str, ST.committed(spark, out, name).select(columns).collect())) == sorted(map(str, want.collect())) != []


def test_late_rows_are_counted_or_told(spark):
    d = "/root/testdata/sf0.01"
    got = q_models.t4_sliding_rates(spark, d).agg(F.sum("requests").alias("a"), F.sum("dropped").alias("b")).first()
    assert got.b > 0 and got.a + got.b == 3 * table(spark, d, "events").count()  # every row is in three windows


def test_an_alert_at_the_horizon_does_not_hang_on_the_order_of_the_sum(spark):
    rng = random.Random(49)
    values = [rng.randint(0, 9000) / 100 for _ in range(29)]
    values.append(round(1350 - sum(values), 2))  # their mean is 45
    orders = [rng.sample(values, 30) for _ in range(40)]
    left_to_right = lambda o: functools.reduce(float.__add__, o, 0.0) / 30 <= 45.0
    assert {left_to_right(o) for o in orders} == {True, False}
    df = spark.createDataFrame([(i * 9 + 1, 30, o) for i, o in enumerate(orders)], "user_id long, seq long, win array<double>")
    assert {(r.prediction, r.alert) for r in q_models.score_batch(df)["predictions"].collect()} == {(45.0, True)}


def test_tasks_grow_in_number_and_not_in_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 50)
    at = "/root/testdata/sf0.001"
    for name, view in (("events", views.events_telemetry), ("lineitem", views.lineitem_telemetry)):
        rows, n = view(spark, at), views.table(spark, at, name).count()
        assert rows.rdd.getNumPartitions() == -(-n // 50) > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert rows.count() == n
    assert views.spread(spark.range(1000).repartition(1), "id").rdd.getNumPartitions() == 20


@pytest.mark.parametrize("name", ["m9_forest_regressor", "m11_logistic", "m12_forest_classifier"])
def test_a_fit_reads_stored_windows(spark, monkeypatch, name):
    for report in ("regression", "classification"):
        monkeypatch.setattr(q_models, report, lambda df, estimator: df)  # a fit reads its rows several times
    files = getattr(q_models, name)(spark, DATA).inputFiles()
    assert files and all("/windows-" in f for f in files)
