import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortgauge.operators import calibration as C
from cohortgauge.operators import metrics as M
from cohortgauge.operators.calibration import POOLED, CalibrationError
from cohortgauge.operators.ordering import BUCKETS, score_bucket, score_curve

KEYS = ["site", "fold", "label"]


def draw(n, sharpness, seed, view="AP", label="A", fold=0):
    rng = np.random.default_rng(seed)
    honest = rng.uniform(0.02, 0.98, n)
    truth = (rng.uniform(size=n) < honest).astype(float)
    z = np.log(honest / (1 - honest)) * sharpness
    return [("s", fold, label, f"{view}{i}", view, float(s), float(t)) for i, (s, t) in enumerate(zip(1 / (1 + np.exp(-z)), truth))]


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "site string, fold int, label string, patient_id string, view string, score double, truth double"
    )


def nll_at(rows, t):
    s, y = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    z = np.log(np.clip(s, 1e-6, 1 - 1e-6) / (1 - np.clip(s, 1e-6, 1 - 1e-6))) / t
    return np.mean(np.logaddexp(0, z) - y * z)


def test_temperature_is_the_minimum_and_near_the_planted_sharpness(spark):
    rows = draw(4000, 2.5, 1)
    got = C.fit_temperatures(frame(spark, rows)).where(f"view = '{POOLED}'").first()
    t = got["temperature"]
    assert got["status"] == "fitted" and abs(t - 2.5) < 0.25
    assert nll_at(rows, t) <= min(nll_at(rows, t * (1 + e)) for e in (-1e-4, 1e-4))


def test_views_fit_apart_and_thin_views_fall_back(spark):
    rows = draw(3000, 2.5, 2) + draw(3000, 1.2, 3, "PA") + draw(30, 1.0, 4, "XX")
    fits = C.fit_temperatures(frame(spark, rows))
    table = {r["view"]: r for r in C.view_temperatures(fits).collect()}
    assert table["AP"]["temperature"] > 2 > 1.5 > table["PA"]["temperature"]
    assert table["XX"]["pooled_fallback"] and table["XX"]["temperature"] == table[POOLED]["temperature"]


def test_unfittable_groups_are_named_not_guessed(spark):
    one_class = [("s", 0, "B", f"p{i}", "AP", 0.2 + i / 100, 1.0) for i in range(40)]
    inverted = [("s", 0, "C", f"p{i}", "AP", 0.9 if i % 2 else 0.1, float(i % 2 == 0)) for i in range(40)]
    fits = C.fit_temperatures(frame(spark, one_class + inverted))
    status = {r["label"]: r for r in fits.where(f"view = '{POOLED}'").collect()}
    assert status["B"]["status"] == "single-class" and status["B"]["temperature"] is None
    assert status["C"]["status"] == "bound" and status["C"]["temperature"] is None
    with pytest.raises(CalibrationError, match="no temperature"):
        C.require_fitted(fits)
    with pytest.raises(CalibrationError):
        C.calibrate(frame(spark, one_class))
    temperatures, thresholds = C.calibrate(frame(spark, one_class + draw(500, 1.5, 5)), strict=False)
    assert {r["label"]: r["threshold"] for r in thresholds.collect()}["B"] is None
    kept = C.decide(frame(spark, one_class), temperatures, thresholds).collect()
    assert len(kept) == 40 and all(r["predicted"] is None for r in kept)


def test_scale_keeps_order_and_refuses_bad_temperatures(spark):
    df = frame(spark, draw(200, 1.0, 6))
    out = df.select("score", C.scale_score(df["score"], 2.0).alias("c")).orderBy("score").collect()
    assert [r["c"] for r in out] == sorted(r["c"] for r in out)
    with pytest.raises(CalibrationError, match="positive"):
        C.scale_score(df["score"], 0.0)
    with pytest.raises(CalibrationError, match="arm"):
        C.calibrate(df, arm="other")


def test_threshold_by_hand(spark):
    rows = [("s", 0, "A", f"p{i}", "AP", s, 1.0) for i, s in enumerate([0.11, 0.22, 0.33, 0.44, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])]
    got = C.select_threshold(frame(spark, rows), KEYS, target=0.90).first()
    assert got["threshold"] == 0.22 and got["achieved_sensitivity"] == 0.9
    with pytest.raises(CalibrationError, match="unknown"):
        C.select_threshold(frame(spark, rows), KEYS, rule="x")
    with pytest.raises(CalibrationError, match="target"):
        C.select_threshold(frame(spark, rows), KEYS, target=0.0)


def test_thresholds_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(8)
    s = np.round(rng.uniform(size=600), 2)
    y = (rng.uniform(size=600) < s * 0.6).astype(float)
    df = frame(spark, [("s", 0, "A", str(i), "AP", float(a), float(b)) for i, (a, b) in enumerate(zip(s, y))])
    candidates = np.unique(s)
    sens = np.array([(s[y == 1] >= c).mean() for c in candidates])
    best = candidates[sens >= 0.9].max()
    assert C.select_threshold(df, KEYS).first()["threshold"] == best
    gain = np.array([(s[y == 1] >= c).mean() - (s[y == 0] >= c).mean() for c in candidates])
    youden = candidates[gain >= gain.max() - 1e-12].max()
    assert C.select_threshold(df, KEYS, rule="youden").first()["threshold"] == youden
    pairs = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert abs(M.auroc(df, KEYS).first()["auroc"] - pairs) < 1e-12


def test_useless_scores_flag_nobody_under_youden(spark):
    rows = [("s", 0, "A", str(i), "AP", 0.9 if i % 2 else 0.1, float(i % 2 == 0)) for i in range(20)]
    got = C.select_threshold(frame(spark, rows), KEYS, rule="youden").first()
    assert got["threshold"] == float("inf") and got["achieved_sensitivity"] == 0.0


def test_bins_match_edge_comparisons(spark):
    edges = np.linspace(0, 1, 11)
    values = sorted({0.0, 1.0, *edges, *(np.nextafter(edges, 2)[:-1]), *(np.nextafter(edges, -1)[1:]), *np.random.default_rng(0).uniform(size=300)})
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for row in df.select("v", M.score_bin(df["v"]).alias("b")).collect():
        want = next(i for i in range(10) if ((row["v"] > edges[i]) or i == 0) and row["v"] <= edges[i + 1])
        assert row["b"] == want, row


def test_missing_truth_or_score_drops_out(spark):
    rows = [("s", 0, "A", "1", "AP", 0.8, 1.0), ("s", 0, "A", "2", "AP", 0.2, 0.0), ("s", 0, "A", "3", "AP", None, 1.0),
            ("s", 0, "A", "4", "AP", 0.5, None)]
    got = M.proper_scores(frame(spark, rows), KEYS).first()
    assert got["n"] == 2 and abs(got["brier"] - 0.04) < 1e-12 and abs(got["nll"] + np.log(0.8)) < 1e-12
    table = M.reliability_table(frame(spark, rows), KEYS).collect()
    assert len(table) == 10 and sum(r["n"] for r in table) == 2


def test_slope_recovers_sharpness_and_report_agrees(spark):
    df = frame(spark, draw(4000, 2.0, 9))
    slope = C.calibration_slope(df, KEYS).first()
    assert abs(slope["slope"] - 0.5) < 0.05 and abs(slope["intercept"]) < 0.1
    temperatures, thresholds = C.calibrate(df)
    report = C.calibration_report(C.decide(df, temperatures, thresholds), KEYS, ["AP"]).first()
    assert report["ece_calibrated"] < report["ece_raw"] and report["nll_calibrated"] < report["nll_raw"]
    assert abs(report["slope_calibrated"] - 1) < 0.05
    plain = M.expected_calibration_error(df, KEYS).first()["ece"]
    assert abs(report["ece_raw"] - plain) < 1e-12


def test_unknown_view_takes_the_pooled_temperature(spark):
    rows = draw(2000, 2.0, 10) + draw(2000, 1.0, 11, "PA")
    temperatures, thresholds = C.calibrate(frame(spark, rows), arm="view")
    table = {r["view"]: r["temperature"] for r in temperatures.collect()}
    odd = frame(spark, [("s", 0, "A", "x", None, 0.7, 1.0), ("s", 0, "A", "y", "ZZ", 0.7, 1.0)])
    got = C.decide(odd, temperatures, thresholds, "view").collect()
    want = 1 / (1 + np.exp(-np.log(0.7 / 0.3) / table[POOLED]))
    assert all(abs(r["calibrated"] - want) < 1e-12 for r in got)
    params = C.fold_parameters(temperatures, thresholds, ["AP", "PA"], "view")
    assert set(params.columns) >= {"T_AP", "T_PA", "threshold", "achieved_sensitivity"}


def test_score_curve_counts_as_a_plain_sort_does_for_any_scores(spark):
    rng = np.random.default_rng(4)
    scores = np.concatenate([rng.uniform(size=300), rng.uniform(size=100) * 1e-9, 1 - rng.uniform(size=100) * 1e-9, rng.normal(size=200) * 50, [0.0, 1.0, 0.5] * 20])
    truth = rng.integers(0, 2, len(scores))
    df = spark.createDataFrame([("g", float(s), float(t)) for s, t in zip(scores, truth, strict=True)], "k string, score double, truth double")
    buckets = [r["b"] for r in df.select("score", score_bucket(F.col("score")).alias("b")).orderBy("score").collect()]
    assert buckets == sorted(buckets) and 0 <= buckets[0] and buckets[-1] <= BUCKETS and len(set(buckets)) > 100
    for r in score_curve(df, ["k"]).collect():
        assert r["cum_pos"] == int(((scores >= r["score"]) & (truth == 1)).sum()) and r["all_neg"] == int((truth == 0).sum())
        assert r["cum_neg"] == int(((scores >= r["score"]) & (truth == 0)).sum()) and r["n_pos"] == int(((scores == r["score"]) & (truth == 1)).sum())


def test_decisions_shuffle_no_rows_for_their_parameters(spark):
    rows = frame(spark, draw(400, 1.5, 6))
    for arm in ("global", "view"):
        temperatures, thresholds = C.calibrate(rows, arm=arm)
        plan = C.decide(rows, temperatures, thresholds, arm)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_last_newton_steps_shuffle_no_rows(spark):
    rows = frame(spark, draw(400, 1.5, 7))
    plan = C.fit_temperatures(rows)._jdf.queryExecution().sparkPlan().toString()
    # The one merge left is of the parameters themselves.
    assert plan.count("BroadcastHashJoin") == 4 and plan.count("SortMergeJoin") == 1
    plan = C.calibration_slope(rows, KEYS)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan
