"""Operators against brute force, and the rules that hold for any input."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sentrymill.operators import daily, decide, metrics, models, sequences
from sentrymill.sources import readers, sinks

UTC = dt.timezone.utc
EVENTS = "event_id long, entity long, counterparty string, time timestamp, amount double, failed boolean, refund boolean, category string, foreign boolean, absent boolean, device string, day int"


def stream(spark, seed=1, n=300, days=25):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(seconds=r.randrange(days * 86400))
        rows.append((i, r.randrange(5), str(r.randrange(4)), at, round(r.lognormvariate(4, 1), 2), r.random() < 0.1, r.random() < 0.1, "view", False, False, None if i % 4 == 0 else str(i % 6), (at - start).days))
    return spark.createDataFrame(rows, EVENTS)


def test_as_of_sees_no_future_and_needs_utc(spark):
    ev = stream(spark)
    as_of = dt.datetime(2024, 1, 10, 12, tzinfo=UTC)
    got = readers.events_as_of(ev, "time", as_of)
    assert got.agg(F.max("time")).first()[0] <= as_of.replace(tzinfo=None)
    assert got.count() == ev.filter("time <= timestamp '2024-01-10 12:00:00'").count()
    with pytest.raises(ValueError):
        readers.require_utc(dt.datetime(2024, 1, 1))


def test_features_ignore_what_comes_later(spark):
    """The truncation test: a day's features are the same whether or not the future is there."""
    ev = stream(spark).cache()
    whole = daily.add_features(daily.grid(daily.day_roll(ev)), 7).filter("day <= 15").orderBy("entity", "day").collect()
    cut = daily.add_features(daily.grid(daily.day_roll(ev.filter("day <= 15")), 15), 7).orderBy("entity", "day").collect()
    assert len(whole) == len(cut)
    for a, b in zip(whole, cut):
        for c in ("v_txn_count_z", "v_gmv_z", "v_fano_trailing", "t_new_max_event", "h_weekend_share_z"):
            assert a[c] == pytest.approx(b[c], abs=1e-9)


def test_empty_days_count_as_zero(spark):
    ev = stream(spark, n=12)
    g = daily.grid(daily.day_roll(ev))
    by = {(r["entity"], r["day"]): r["n"] for r in g.collect()}
    for r in daily.add_features(g, 7).collect():
        counts = [by.get((r["entity"], d), 0) for d in range(r["day"] - 27, r["day"] + 1)]
        mean = sum(counts) / 28
        assert r["v_fano_trailing"] == pytest.approx((sum(c * c for c in counts) / 28 - mean * mean) / mean if mean else 0.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10])
def test_leave_one_out_median(spark, n):
    r = random.Random(n)
    values = [float(r.randrange(4)) for _ in range(n)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, v double")
    for row in sequences.leave_one_out_median(df, ["g"], "v", "i").collect():
        rest = values[: row["i"]] + values[row["i"] + 1 :]
        assert row["loo"] == (statistics.median(rest) if rest else None)


def test_cusum_and_runs(spark):
    x = [0.0, 1.0, 1.0, 0.0, 0.1, 30.0, 5.0]
    df = spark.createDataFrame([(1, d, v) for d, v in enumerate(x)], "k int, day int, x double")
    c, want = 0.0, []
    for v in x:
        c = min(20.0, max(0.0, c + v - 0.25))
        want.append(c)
    got = [r["cusum"] for r in sequences.page_cusum(df, ["k"], "day", "x").orderBy("day").collect()]
    assert got == pytest.approx(want)
    runs = [r["run"] for r in sequences.run_length(df, ["k"], "day", "x").orderBy("day").collect()]
    assert runs == [0, 1, 2, 0, 1, 2, 3]


def test_capacity_is_a_ceiling(spark):
    rows = [(i, 0, 0.9 if i < 4 else 0.0, 10_000.0) for i in range(10)]
    got = decide.select_actions(spark.createDataFrame(rows, "id int, day int, p double, exposure double"), capacity=6)
    assert {r["id"]: r["action"] for r in got.collect()} == {i: "REVIEW" if i < 4 else "PASS" for i in range(10)}


def test_undefined_metrics_are_null(spark):
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert metrics.pr_auc(one).first()[0] is None
    assert metrics.roc_auc(one).first()[0] is None


def test_knapsack_by_enumeration(spark):
    rows = [(0, w, v) for w, v in [(1, 5.0), (4, 9.0), (3, 8.0), (5, 3.0), (2, 4.0)]]
    best = max(sum(v for k, (_, w, v) in enumerate(rows) if m >> k & 1) for m in range(32) if sum(w for k, (_, w, _) in enumerate(rows) if m >> k & 1) <= 6)
    assert decide.knapsack(spark.createDataFrame(rows, "day int, weight int, value double"), 6).first()["best"] == best


def test_hmm_probabilities(spark):
    df = spark.createDataFrame([(1, d, 0.0 if d < 5 else 6.0) for d in range(10)], "k int, d int, x double")
    got = [r["p_bad"] for r in models.hmm_filter(df, "k", "d", "x", [0.0, 6.0], [1.0, 1.0]).orderBy("d").collect()]
    assert all(0 <= p <= 1 for p in got) and got[0] < 0.1 and got[-1] > 0.9


def test_empty_tables(spark):
    ev = spark.createDataFrame([], EVENTS)
    assert daily.add_features(daily.grid(daily.day_roll(ev)), 7).count() == 0
    assert metrics.pr_auc(spark.createDataFrame([], "score double, label int")).first()[0] is None


def test_labels_have_one_door(spark):
    at = dt.datetime(2024, 1, 5)
    rows = [(1, at, False), (0, None, False), (1, dt.datetime(2024, 2, 1), False), (None, at, True)]
    df = spark.createDataFrame(rows, "label int, label_available_at timestamp, is_censored boolean")
    as_of = dt.datetime(2024, 1, 10, tzinfo=UTC)
    assert readers.available_labels(df, as_of).count() == 1
    assert readers.available_labels(df, as_of, include_censored=True).count() == 2
    assert readers.label_coverage(df, as_of).first()["pending"] == 2


def test_artifacts_and_hashes(spark, tmp_path):
    data, census = sinks.canonical_json({"b": float("nan"), "a": [1, float("inf")]})
    assert census == 2 and data.index(b'"a"') < data.index(b'"b"')
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sinks.content_hash(df).first() == sinks.content_hash(df.orderBy(F.desc("id"))).first()
    sinks.write_table(df, str(tmp_path / "t"), max_records=4)
    sinks.write_missing(df.union(spark.range(10, 12).withColumn("x", F.col("id"))), str(tmp_path / "t"), "id", spark.read.parquet(str(tmp_path / "t")))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 12


def test_readers_by_extension(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.csv", "a,b\n1,x\n2,y\n")
    (tmp_path / "d.csv").write_text("a,b\n1,x\n")
    assert readers.read_table(spark, str(tmp_path / "d.zip"), ["b"]).count() == 2
    assert readers.read_table(spark, str(tmp_path / "d.csv"), schema="a int, b string").first()["a"] == 1


def test_hawkes_fits_bursts(spark):
    r, queue, t = random.Random(6), [], []
    mu, alpha, beta, days = 8.0, 0.6, 300.0, 60.0
    at = r.expovariate(mu)
    while at < days:
        queue.append(at)
        at += r.expovariate(mu)
    while queue:
        x = queue.pop()
        t.append(x)
        child, total = 0, r.expovariate(1.0)
        while total < alpha:
            child, total = child + 1, total + r.expovariate(1.0)
        queue += [y for y in (x + r.expovariate(beta) for _ in range(child)) if y < days]
    t = models.np.array(sorted(t))
    got = models.hawkes_fit(t, days, models.np.ones(24))
    assert got[0] == pytest.approx(mu, rel=0.15) and got[1] == pytest.approx(alpha, abs=0.1) and got[2] == pytest.approx(beta, rel=0.25)
    df = spark.createDataFrame([(1, float(x) * 86_400) for x in t] + [(2, 5.0), (2, 9.0)], "k int, at double")
    d = {x["k"]: (x["n"], x["d"]) for x in models.hawkes_residual_ks(df, "k", "at").collect()}
    assert d[1][0] == len(t) - 1 and d[1][1] < 1.36 / len(t) ** 0.5 and d[2][0] == 1 and d[2][1] is None


def test_best_takes_ties_by_id_and_skips_nulls(spark):
    from sentrymill.operators.metrics import best

    rows = [(i, None if i == 3 else float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double")
    want = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    for k in (1, 7, 10, 11, 39, 100):
        assert sorted(tuple(r) for r in best(df, "x", k, "id").collect()) == sorted(want[:k])


def test_pools_neither_overflow_nor_lose_certainty(spark):
    from sentrymill.operators.models import pool

    df = spark.createDataFrame([("a", 1.0), ("a", 0.2), ("b", 0.9), ("b", 0.1)], "k string, p double")
    got = {r["k"]: r for r in pool(df, ["k"], "p", tau=800.0).collect()}
    assert got["a"]["noisy_or"] == 1.0 and abs(got["b"]["noisy_or"] - 0.91) < 1e-12
    assert all(0.8 < got[k]["lse"] <= 1.0 for k in "ab")


def test_costs_take_scores_as_probabilities(spark):
    from sentrymill.operators.decide import Costs, expected_costs

    df = spark.createDataFrame([(1.5, 100.0), (-0.5, 100.0), (0.5, 100.0)], "p double, e double")
    got = df.select(expected_costs(df["p"], df["e"], Costs(loss_multiplier=2.0))["PASS"].alias("c")).collect()
    assert [r["c"] for r in got] == [200.0, 0.0, 100.0]


def test_permutation_null_is_the_null_of_shuffled_labels(spark):
    """Each choice of two of five entities, ties included, comes as often as it should, however the scores are dealt to blocks."""
    from collections import Counter
    from itertools import combinations

    from sentrymill.operators import evaluate

    scores, labels = [0.1, 0.4, 0.4, 0.7, 0.9], [1, 0, 0, 1, 0]

    def auc(chosen):
        rest = [s for i, s in enumerate(scores) if i not in chosen]
        return sum((scores[i] > s) + (scores[i] == s) / 2 for i in chosen for s in rest) / (len(chosen) * len(rest))

    truth = Counter(round(auc(c), 6) for c in combinations(range(5), 2))
    schema = "score double, label int"
    rows = spark.createDataFrame([*zip(scores, labels), (None, 1), (0.5, None)], schema)
    for block in (100, 1):
        got = {r["draw"]: round(r["auc"], 6) for r in evaluate.permutation_null(rows, 3000, 5, block).collect()}
        assert sorted(got) == list(range(3000))
        seen = Counter(got.values())
        assert set(seen) == set(truth)
        assert all(abs(seen[x] / 3000 - n / 10) < 0.04 for x, n in truth.items())
    again = spark.createDataFrame(list(zip(scores, labels))[::-1], schema)
    assert {r["draw"]: round(r["auc"], 6) for r in evaluate.permutation_null(again, 3000, 5, 1).collect()} == got
    for one in (spark.createDataFrame([(0.1, 1), (0.2, 1)], schema), spark.createDataFrame([], schema)):
        assert [(r["draw"], r["auc"]) for r in evaluate.permutation_null(one, 3, 5).orderBy("draw").collect()] == [(0, None), (1, None), (2, None)]


def test_capsules_leave_unknown_devices_alone(spark):
    from collections import defaultdict

    from sentrymill.operators import payers

    rows = [r for r in stream(spark, n=400, days=6).collect() if not r["refund"]]
    users, seen, last = defaultdict(set), defaultdict(list), defaultdict(list)
    for r in rows:
        key = (r["entity"], r["day"], r["counterparty"])
        last[key].append(r["time"])
        if r["device"] is not None:
            users[r["entity"], r["device"]].add(r["counterparty"])
            seen[key].append(r["device"])
    want = {k: (max(t), max([len(users[k[0], d]) for d in seen[k]], default=1)) for k, t in last.items()}
    got = payers.capsules(stream(spark, n=400, days=6), ("view", "other")).collect()
    assert {(r["entity"], r["day"], r["counterparty"]): (r["last_event_time"], r["device_shared_payers"]) for r in got} == want
    assert all(r["view_share"] == 1 and r["other_share"] == 0 for r in got)
    alone = stream(spark, n=40).withColumn("device", F.lit(None).cast("string"))
    assert {r["device_shared_payers"] for r in payers.capsules(alone).collect()} == {1}
    assert payers.capsules(stream(spark).limit(0)).count() == 0


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    """Parts that arrive between two runs give what one batch gives; rows of a batch are written once."""
    from sentrymill.streaming import online

    whole = stream(spark, n=200, days=6)
    (tmp_path / "in").mkdir()
    batch = whole.groupBy("entity", F.to_timestamp(F.to_date("time")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    seen = []
    for days in ("day < 3", "day >= 3"):
        whole.filter(days).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
        got = online.to_files(online.daily_counts(source, "30 days"), str(tmp_path / "out"), ["entity", "start"], "update")
        seen.append({(r["entity"], r["start"]): r["n"] for r in got.collect()})
    want = {(r["entity"], r["start"]): r["n"] for r in batch.collect()}
    assert seen[1] == want and set(seen[0]) < set(want)


def test_reports_are_not_cut(spark):
    from sentrymill.sources import sinks

    assert sinks.markdown(spark.range(3), limit=3).count("\n") == 5
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(4), limit=3)


def test_artifacts_tell_what_became_null(tmp_path):
    digest, census = sinks.write_artifact(str(tmp_path), "a", {"x": float("nan"), "y": [1.0, float("inf")]})
    assert census == 2 and len(digest) == 64 and (tmp_path / "a.json").read_bytes().count(b"null") == 2


def test_dispersion_where_variance_equals_mean(spark, tmp_path):
    """Against fractions; entities whose daily counts have a variance of exactly their mean have -1, whatever the order of rows."""
    from fractions import Fraction
    from itertools import combinations_with_replacement

    from sentrymill.plans import registry

    r, counts = random.Random(3), [[2], [1, 9], [3, 1, 8]]
    for k in range(2, 7):
        counts += [r.sample(c, k) for c in combinations_with_replacement(range(1, 11), k) if statistics.variance(map(Fraction, c)) == statistics.mean(map(Fraction, c))]
    rows = [(e, day, at) for e, c in enumerate(counts) for day, n in enumerate(c) for at in range(n)]
    events = spark.createDataFrame(rows, "user_id long, day int, at int").select(F.expr("monotonically_increasing_id()").alias("event_id"), F.expr("timestamp_seconds(1704067200 + day * 86400 + at)").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {x["entity"]: x["r"] for x in registry.queries()["agg_nb_dispersion"](spark, str(tmp_path)).collect()}

    def want(c):
        if len(c) < 2:
            return None
        mean, f = statistics.mean(map(Fraction, c)), statistics.variance(map(Fraction, c)) / statistics.mean(map(Fraction, c))
        return -1.0 if f <= 1 else pytest.approx(float(mean / (f - 1)), abs=1e-6)

    assert len(counts) > 20 and [got[e] for e in range(len(counts))] == [want(c) for c in counts]
