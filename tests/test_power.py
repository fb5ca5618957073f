import math
import statistics

import pytest

from cohortgauge.functions.maths import normal_cdf, two_sided_p
from cohortgauge.operators import cells, power
from cohortgauge.operators.power import PowerError

NORMAL = statistics.NormalDist()


def test_normal_tail_expressions(spark):
    zs = [-38.0, -8.0, -4.3, -1.0, 0.0, 0.3, 1.96, 4.2, 4.3, 6.0, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal_cdf("z").alias("c"), two_sided_p("z").alias("p")).collect():
        assert abs(r["c"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-14
        want = math.erfc(abs(r["z"]) / math.sqrt(2))
        assert abs(r["p"] - want) <= 1e-10 * want + 1e-300 or abs(r["p"] - want) < 1e-15


def test_closed_form_by_hand(spark):
    df = spark.createDataFrame([(100, 120), (0, 5), (5000, 5000)], "n_a long, n_b long")
    got = [r[0] for r in df.select(power.closed_form_power(df["n_a"], df["n_b"], 0.3, 0.45)).collect()]
    se = math.sqrt(0.21 / 100 + 0.2475 / 120)
    z = NORMAL.inv_cdf(0.975)
    assert abs(got[0] - (NORMAL.cdf(0.15 / se - z) + NORMAL.cdf(-0.15 / se - z))) < 1e-12
    assert got[1] == 0.0 and got[2] > 0.999
    same = [r[0] for r in df.select(power.closed_form_power(df["n_a"], df["n_b"], 0.3, 0.3)).collect()]
    assert abs(same[0] - 0.05) < 1e-9
    edge = [r[0] for r in df.select(power.closed_form_power(df["n_a"], df["n_b"], 0.0, 1.0)).collect()]
    assert edge[0] == 1.0


def mde(spark, rows, **how):
    df = spark.createDataFrame(rows, "n_a long, n_b long")
    return [r[0] for r in df.select(power.detectable_effect(df["n_a"], df["n_b"], how.pop("baseline", 0.3), **how)).collect()]


@pytest.mark.parametrize("baseline", [0.1, 0.3, 0.5, 0.8])
def test_detectable_effect_reaches_the_target_power(spark, baseline):
    sizes = [(100, 100), (400, 250), (2500, 90), (5000, 5000)]
    for (n_a, n_b), d in zip(sizes, mde(spark, sizes, baseline=baseline), strict=True):
        moved = baseline + d if baseline <= 0.5 else baseline - d
        se = math.sqrt(baseline * (1 - baseline) / n_a + moved * (1 - moved) / n_b)
        assert abs(NORMAL.cdf(d / se - NORMAL.inv_cdf(0.975)) - 0.8) < 1e-9


def test_detectable_effect_shrinks_with_size_and_has_limits(spark):
    got = mde(spark, [(100, 100), (400, 400), (2500, 2500), (1, 50), (2, 2), (0, 0)])
    assert got[0] > got[1] > got[2] > 0 and got[3:] == [None, None, None]
    with pytest.raises(PowerError):
        mde(spark, [(5, 5)], baseline=0.0)
    with pytest.raises(PowerError):
        mde(spark, [(5, 5)], target_power=1.0)


@pytest.fixture()
def counts(spark):
    rows = [("a", "Rich", v, "sex", "Female", "Male", 3000, 3000) for v in ("AP", "PA")]
    rows += [("a", "Poor", v, "sex", "Female", "Male", 12, 12) for v in ("AP", "PA")]
    rows += [("a", "Mixed", "AP", "sex", "Female", "Male", 3000, 3000), ("a", "Mixed", "PA", "sex", "Female", "Male", 12, 12)]
    rows += [("b", "Rich", "AP", "sex", "Female", "Male", 5, 5)]
    return spark.createDataFrame(
        rows, "site string, label string, view string, stratum string, level_a string, level_b string, n_a long, n_b long"
    )


def test_evaluate_is_reproducible_however_it_is_partitioned(counts):
    first = power.evaluate_cells(counts).orderBy("site", "label", "view").collect()
    again = power.evaluate_cells(counts.repartition(3)).orderBy("site", "label", "view").collect()
    assert first == again
    by = {(r["site"], r["label"], r["view"]): r for r in first}
    assert by["a", "Rich", "AP"]["powered"] and not by["a", "Poor", "AP"]["powered"]


def test_tiers_and_ladder(counts):
    table = power.evaluate_cells(counts).cache()
    labels = ["Rich", "Poor", "Mixed", "Absent"]
    tiers = {r["label"]: r for r in power.assign_tiers(table, labels, inferential_sites=["a"]).collect()}
    assert {k: r["tier"] for k, r in tiers.items()} == {
        "Rich": "primary", "Poor": "descriptive", "Mixed": "exploratory", "Absent": "descriptive"
    }
    assert tiers["Absent"]["reason"] == "no cells" and tiers["Rich"]["n_cells"] == 3 and tiers["Rich"]["n_gating_cells"] == 2
    everywhere = {r["label"]: r["tier"] for r in power.assign_tiers(table, labels).collect()}
    assert everywhere["Rich"] == "exploratory"
    barred = {r["label"]: r for r in power.assign_tiers(table, labels, secondary_lane=["Rich"], inferential_sites=["a"]).collect()}
    assert barred["Rich"]["tier"] == "exploratory" and "secondary lane" in barred["Rich"]["reason"]
    order = [r["label"] for r in power.assign_tiers(table, labels, inferential_sites=["a"]).collect()]
    assert order == ["Rich", "Mixed", "Absent", "Poor"]
    ladder = [power.DEMOTE, power.DESCRIBE]
    rungs = {r["label"]: r["rung"] for r in power.coarsening_ladder(table, labels, ladder, ["a"]).collect()}
    assert rungs == {"Rich": "none", "Poor": power.DEMOTE, "Mixed": power.DEMOTE, "Absent": "none"}
    only = {r["label"]: r["rung"] for r in power.coarsening_ladder(table, labels, [power.DESCRIBE], ["a"]).collect()}
    assert only["Poor"] == power.DESCRIBE
    with pytest.raises(PowerError, match="unknown coarsening"):
        power.coarsening_ladder(table, labels, ["pool_ages"])
    with pytest.raises(PowerError, match="no cells"):
        power.require_gating_cells(table, ["z"])


def test_majority_of_sites_may_suffice(spark):
    rows = [(s, "L", "AP", s != "c", 0.1) for s in "abc"]
    table = spark.createDataFrame(rows, "site string, label string, view string, powered boolean, mde double")
    assert power.assign_tiers(table, ["L"]).first()["tier"] == "exploratory"
    row = power.assign_tiers(table, ["L"], require_all_sites=False).first()
    assert row["tier"] == "primary" and row["reason"] == "powered at 2/3 sites"


def test_zero_cells_are_counted(spark):
    rows = [("a", "AP", "Female", "<65", 1.0), ("a", "PA", "Male", "<65", 0.0), ("a", None, "Male", "<65", 1.0)]
    df = spark.createDataFrame(rows, "site string, view string, sex string, age_group string, L double")
    got = {(r["view"], r["stratum"]): (r["n_a"], r["n_b"]) for r in cells.contrast_counts(
        df, ["L"], {"sex": ("Female", "Male"), "age_group": ("<65", ">=65")}).collect()}
    assert got == {("AP", "sex"): (1, 0), ("PA", "sex"): (0, 0), ("AP", "age_group"): (1, 0), ("PA", "age_group"): (0, 0)}
