import itertools

import numpy as np
import pytest

from cohortgauge.operators import bootstrap as B
from cohortgauge.operators import discrimination as D
from cohortgauge.operators import fairness as Fa
from cohortgauge.operators import interaction as I
from cohortgauge.operators import multiplicity
from cohortgauge.operators.regression import acquisition_coupling, fit_logistic, newton_logistic

CONTRASTS = {"sex": ("Female", "Male"), "age_group": ("<65", ">=65")}
SCHEMA = "site string, label string, view string, sex string, age_group string, truth double, predicted double"


def cohort_rows(counts, site="s", label="L"):
    """``counts[(view, sex, age_group)] = (missed, caught)`` among positives."""
    rows = []
    for (view, sex, age), (missed, caught) in counts.items():
        rows += [(site, label, view, sex, age, 1.0, 0.0)] * missed + [(site, label, view, sex, age, 1.0, 1.0)] * caught
        rows += [(site, label, view, sex, age, 0.0, 0.0)] * 3
    return rows


def planted(share_young, share_old, fnr, n=1200):
    """Age groups with their own AP share; ``fnr[(age, view)]`` misses."""
    counts = {}
    for age, share in (("<65", share_young), (">=65", share_old)):
        for view, part in (("AP", share), ("PA", 1 - share)):
            size = round(n * part / 2)
            missed = round(size * fnr[age, view])
            for sex in ("Female", "Male"):
                counts[view, sex, age] = (missed, size - missed)
    return cohort_rows(counts)


def cells_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return Fa.contrast_cells(Fa.outcome_cube(df, ["sex", "age_group"]), CONTRASTS)


def age(table):
    return table.where("stratum = 'age_group'").first()


def test_gaps_by_hand(spark):
    rows = cohort_rows({("AP", "Female", "<65"): (3, 7), ("AP", "Male", "<65"): (6, 4), ("PA", "Male", ">=65"): (1, 9)})
    cells = cells_of(spark, rows)
    row = Fa.group_gap(cells).where("stratum = 'sex'").first()
    assert (row["n_a"], row["n_b"]) == (10, 20) and abs(row["gap"] - (7 / 20 - 0.3)) < 1e-12
    views = {r["view"]: r for r in Fa.within_view_gaps(cells).where("stratum = 'sex'").collect()}
    assert abs(views["AP"]["gap"] - 0.3) < 1e-12 and views["PA"]["gap"] is None and views["PA"]["n_a"] == 0
    assert Fa.standardised_gap(cells).where("stratum = 'sex'").first()["gap_standardised"] is None


def test_missing_prediction_is_not_a_miss_and_negatives_do_not_count(spark):
    rows = [("s", "L", "AP", "Male", "<65", 1.0, None), ("s", "L", "AP", "Male", "<65", 1.0, 0.0),
            ("s", "L", "AP", "Male", "<65", 0.0, 0.0), ("s", "L", "AP", "Male", "<65", None, 0.0)]
    cube = Fa.outcome_cube(spark.createDataFrame(rows, SCHEMA), ["sex", "age_group"])
    row = Fa.overall_rates(cube).first()
    assert row["positives"] == 2 and row["fnr"] == 0.5
    none = Fa.overall_rates(cube.withColumn("n_positive", cube["n_positive"] * 0).withColumn("n_missed", cube["n_missed"] * 0))
    assert none.first()["fnr"] is None


@pytest.mark.parametrize(
    ("young", "old", "fnr", "verdict"),
    [
        (0.2, 0.8, {("<65", "AP"): 0.5, (">=65", "AP"): 0.5, ("<65", "PA"): 0.1, (">=65", "PA"): 0.1}, "attenuation"),
        (0.8, 0.2, {("<65", "AP"): 0.5, (">=65", "AP"): 0.7, ("<65", "PA"): 0.1, (">=65", "PA"): 0.3}, "masking"),
        (0.5, 0.5, {("<65", "AP"): 0.4, (">=65", "AP"): 0.6, ("<65", "PA"): 0.4, (">=65", "PA"): 0.6}, "independence"),
    ],
)
def test_planted_effects_get_their_verdict(spark, young, old, fnr, verdict):
    cells = cells_of(spark, planted(young, old, fnr))
    row = age(B.delta_gaps(cells, B.bootstrap(cells, replicates=400), replicates=400))
    assert row["verdict"] == verdict, row
    assert row["attempted_replicates"] == 400 and row["usable_replicates"] == 400
    assert row["delta_ci_low"] <= row["delta"] <= row["delta_ci_high"]


def test_bootstrap_agrees_with_resampling_patients(spark):
    """Cell draws against a row bootstrap: same spread of both gaps."""
    rows = planted(0.3, 0.7, {("<65", "AP"): 0.4, (">=65", "AP"): 0.5, ("<65", "PA"): 0.2, (">=65", "PA"): 0.3}, 300)
    cells = cells_of(spark, rows)
    got = age(B.delta_gaps(cells, B.bootstrap(cells, replicates=4000), replicates=4000))
    sick = [r for r in rows if r[5] == 1.0]
    view, old, missed = (np.array([r[i] == v for r in sick]) for i, v in ((2, "AP"), (4, ">=65"), (6, 0.0)))
    rng, draws = np.random.default_rng(0), []
    for _ in range(4000):
        take = rng.integers(0, len(sick), len(sick))
        v, o, m = view[take], old[take], missed[take]
        raw = m[o].mean() - m[~o].mean()
        std = sum(0.5 * (m[o & w].mean() - m[~o & w].mean()) for w in (v, ~v))
        draws.append((raw, std, raw - std))
    low, high = np.percentile(draws, 2.5, axis=0), np.percentile(draws, 97.5, axis=0)
    names = [("raw_ci_low", "raw_ci_high"), ("std_ci_low", "std_ci_high"), ("delta_ci_low", "delta_ci_high")]
    for i, (a, b) in enumerate(names):
        assert abs(got[a] - low[i]) < 0.012 and abs(got[b] - high[i]) < 0.012, (a, got[a], low[i])


def test_bootstrap_is_keyed_and_counts_lost_replicates(spark):
    rows = planted(0.5, 0.5, {k: 0.4 for k in itertools.product(("<65", ">=65"), ("AP", "PA"))}, 200)
    rows += cohort_rows({("AP", "Female", "<65"): (1, 0), ("PA", "Male", ">=65"): (0, 1)}, label="Rare")
    df = spark.createDataFrame(rows, SCHEMA)
    first = B.bootstrap(Fa.contrast_cells(Fa.outcome_cube(df, ["sex", "age_group"]), CONTRASTS), replicates=200)
    again = B.bootstrap(Fa.contrast_cells(Fa.outcome_cube(df.repartition(9), ["sex", "age_group"]), CONTRASTS), replicates=200)
    order = ["label", "stratum", "scope"]
    assert first.orderBy(*order).collect() == again.orderBy(*order).collect()
    rare = first.where("label = 'Rare' AND scope = 'both' AND stratum = 'sex'").first()
    assert rare["usable"] < 200 and rare["usable_replicates"] == 0 and rare["delta_ci_low"] is None


def test_discrimination_gaps_against_pairs_of_patients(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        sex, truth = ("Female", "Male")[i % 2], float(rng.random() < 0.3)
        score = float(np.round(rng.normal(truth * (1.0 if sex == "Male" else 0.4)), 1))
        rows.append(("s", "L", sex, "<65", score, truth if i % 50 else None))
    rows += [("one", "L", "Male", "<65", 0.5, 1.0), ("one", "L", "Female", "<65", 0.5, 1.0), ("one", "L", "Female", "<65", 0.1, 0.0)]
    df = spark.createDataFrame(rows, "site string, label string, sex string, age_group string, score double, truth double")
    got = {r["site"]: r for r in D.auroc_gap(df, {"sex": ("Female", "Male")}).collect()}
    ap = {r["site"]: r for r in D.auprc_gap(df, {"sex": ("Female", "Male")}).collect()}
    for side, sex in (("a", "Female"), ("b", "Male")):
        kept = [(r[4], r[5]) for r in rows if r[0] == "s" and r[2] == sex and r[5] is not None]
        pos, neg = (np.array([s for s, t in kept if t == k]) for k in (1.0, 0.0))
        won = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
        assert abs(got["s"][f"auroc_{side}"] - won.mean()) < 1e-12
        steps = [((pos >= s).sum() / ((pos >= s).sum() + (neg >= s).sum())) for s in pos]
        assert abs(ap["s"][f"auprc_{side}"] - np.mean(steps)) < 1e-12
        part = won.mean(1).var(ddof=1) / len(pos) + won.mean(0).var(ddof=1) / len(neg)
        variance = part if side == "a" else variance + part
    assert abs(got["s"]["std_error"] - variance**0.5) < 1e-12 and got["s"]["ci_low"] < got["s"]["gap"] < got["s"]["ci_high"]
    lone = got["one"]
    assert lone["auroc_a"] == 1.0 and lone["auroc_b"] is None and lone["gap"] is None and lone["std_error"] is None and ap["one"]["gap"] is None
    assert ap["one"]["prevalence_b"] == 1.0


def test_positivity_names_sparse_and_distant_cells(spark):
    rows = cohort_rows({("AP", "Female", "<65"): (3, 6), ("PA", "Female", "<65"): (50, 50), ("AP", "Male", "<65"): (50, 50),
                        ("PA", "Male", "<65"): (50, 50)})
    detail = Fa.positivity_detail(cells_of(spark, rows)).where("stratum = 'sex'")
    row = Fa.positivity_report(detail).first()
    assert not row["positivity_ok"]
    assert row["positivity_note"] == "Female/AP: 9 positives; Female/PA: observed 0.92 reweighted to 0.50"
    fine = Fa.positivity_report(Fa.positivity_detail(cells_of(spark, rows), None, 5, 0.5)).where("stratum = 'sex'").first()
    assert fine["positivity_ok"] and fine["positivity_note"] == ""


def test_verdict_boundaries(spark):
    rows = [(None, None, "not estimated"), (0.001, 0.1, "attenuation"), (-0.1, -0.001, "masking"), (-0.02, 0.02, "independence"),
            (-0.021, 0.01, "inconclusive"), (0.03, 0.05, "attenuation")]
    df = spark.createDataFrame(rows, "low double, high double, want string")
    for r in df.withColumn("got", Fa.verdict(df["low"], df["high"], 0.02)).collect():
        assert r["got"] == r["want"], r
    flags = df.select(Fa.significant(df["low"], df["high"]).alias("s")).collect()
    assert [r["s"] for r in flags] == [False, True, True, False, False, True]


def test_replication_and_margins(spark):
    rows = [("a", "L", "sex", 0.1, 0.05, 0.2, "attenuation"), ("b", "L", "sex", 0.2, 0.01, 0.3, "attenuation"),
            ("a", "M", "sex", 0.1, -0.015, 0.015, "independence"), ("b", "M", "sex", -0.1, -0.2, -0.1, "masking")]
    df = spark.createDataFrame(
        rows, "site string, label string, stratum string, delta double, delta_ci_low double, delta_ci_high double, verdict string"
    )
    got = {r["label"]: r for r in Fa.replication(df).collect()}
    assert got["L"]["same_verdict"] and got["L"]["same_direction"]
    assert not got["M"]["same_verdict"] and got["M"]["verdicts"] == "independence, masking"
    margins = {(r["site"], r["label"]): r["stable"] for r in Fa.verdict_sensitivity(df, [0.01, 0.02]).collect()}
    assert margins == {("a", "L"): True, ("b", "L"): True, ("a", "M"): False, ("b", "M"): True}
    assert "a_delta" in Fa.replication_pivot(df, ["a", "b"]).columns


# ---- models


def expand(x, n, y):
    return np.repeat(x, 2, axis=0), np.concatenate([[a, b] for a, b in zip(y, n - y)]), np.tile([1.0, 0.0], len(n))


def test_interaction_guards(spark):
    def note(counts):
        cube = Fa.outcome_cube(spark.createDataFrame(cohort_rows(counts), SCHEMA), ["sex", "age_group"])
        return I.guard_notes(cube, "sex").first()["note"]

    base = {(v, s, "<65"): (15, 15) for v in ("AP", "PA") for s in ("Female", "Male")}
    assert note(base) is None
    assert "too few" in note({k: (3, 3) for k in base})
    assert "no errors, or only errors" in note({k: (0, 30) for k in base})
    assert note({**base, ("AP", "Male", "<65"): (0, 30)}) == "separation in 1 of 4 cells"
    assert "fewer than 10" in note({**base, ("AP", "Male", "<65"): (5, 30)})


def test_closed_form_equals_the_model_and_detects_a_planted_interaction(spark):
    counts = {("AP", "Female", "<65"): (60, 140), ("AP", "Male", "<65"): (60, 140), ("PA", "Female", "<65"): (40, 160),
              ("PA", "Male", "<65"): (110, 90)}
    cube = Fa.outcome_cube(spark.createDataFrame(cohort_rows(counts), SCHEMA), ["sex", "age_group"])
    closed = I.interaction_closed(cube, {"sex": CONTRASTS["sex"]}).first()
    model = I.interaction_model(cube, "sex").where("is_interaction").first()
    assert model["term"] == "C(sex)[T.Male]:C(view)[T.PA]"
    for c in ("coefficient", "odds_ratio", "ci_low", "ci_high", "p_value"):
        assert abs(closed[c] - model[c]) < 1e-8 * max(1, abs(closed[c]))
    assert closed["p_value"] < 1e-4 and closed["odds_ratio"] > 3


def test_adjusted_model_matches_a_fit_on_patients(spark):
    rng = np.random.default_rng(3)
    counts = {k: (int(rng.integers(20, 60)), int(rng.integers(40, 90))) for k in
              itertools.product(("AP", "PA"), ("Female", "Male"), ("<65", ">=65"))}
    cube = Fa.outcome_cube(spark.createDataFrame(cohort_rows(counts), SCHEMA), ["sex", "age_group"])
    got = {r["term"]: r["coefficient"] for r in I.interaction_model(cube, "sex", ["age_group"]).collect()}
    x, y = [], []
    for (view, sex, old), (missed, caught) in counts.items():
        m, p, o = sex == "Male", view == "PA", old == ">=65"
        x += [[1, m, p, o, m * p]] * (missed + caught)
        y += [1] * missed + [0] * caught
    x, y = np.array(x, float), np.array(y, float)
    b = np.zeros(5)
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (y - q))
    want = dict(zip(["Intercept", "C(sex)[T.Male]", "C(view)[T.PA]", "C(age_group)[T.>=65]", "C(sex)[T.Male]:C(view)[T.PA]"], b))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in got)


def test_levels_hold_for_all_sites_and_failed_fits_leave_a_note(spark):
    rng = np.random.default_rng(5)
    full = {k: (int(rng.integers(20, 60)), int(rng.integers(40, 90))) for k in
            itertools.product(("AP", "PA"), ("Female", "Male"), ("<65", ">=65"))}
    young = {k: v for k, v in full.items() if k[2] == "<65"}
    apart = {k: ((0, 60) if k[2] == ">=65" else v) for k, v in full.items()}
    rows = [("one", *r[1:]) for r in cohort_rows(full)] + [("two", *r[1:]) for r in cohort_rows(young)] + [("three", *r[1:]) for r in cohort_rows(apart)]
    cube = Fa.outcome_cube(spark.createDataFrame(rows, SCHEMA), ["sex", "age_group"])
    fits = I.fit_interactions(cube, "sex", ["age_group"])
    assert {r["site"] for r in I.fitted_terms(fits).collect()} == {"one"}
    notes = {r["site"]: r["note"] for r in I.fit_notes(fits).collect()}
    assert notes["two"] == "no positives at age_group=>=65" and set(notes) == {"two", "three"}
    assert "did not converge" in notes["three"] or "separation" in notes["three"]
    with pytest.raises(Fa.FairnessError, match="not listed"):
        I.interaction_model(cube, "sex", ["age_group"], levels={"age_group": ["<65"]})


def test_coupling_matches_a_fit_on_patients_with_fractional_ages(spark):
    rng = np.random.default_rng(5)
    n = 3000
    ages, male = rng.uniform(18, 95, n), rng.uniform(size=n) < 0.5
    ap = rng.uniform(size=n) < 1 / (1 + np.exp(-(-2 + 0.3 * ages / 10 + 0.2 * male)))
    rows = [("s", float(a), "Male" if m else "Female", "AP" if v else "PA") for a, m, v in zip(ages, male, ap)]
    df = spark.createDataFrame(rows, "site string, age double, sex string, view string")
    got = {r["term"]: r for r in acquisition_coupling(df).collect()}
    x, y = np.column_stack([np.ones(n), ages / 10, male]), ap.astype(float)
    beta, cov, ok = newton_logistic(x, np.ones(n), y)
    assert ok and abs(np.log(got["age_decade"]["odds_ratio"]) - beta[1]) < 1e-9
    assert abs(np.log(got["C(sex)[T.Male]"]["odds_ratio"]) - beta[2]) < 1e-9
    width = (np.log(got["age_decade"]["ci_high"]) - np.log(got["age_decade"]["ci_low"])) / (2 * 1.959963984540054)
    assert abs(width - np.sqrt(cov[1, 1])) < 1e-6


def test_single_class_logit_is_null(spark):
    df = spark.createDataFrame([("s", float(i), 1.0) for i in range(20)], "site string, x double, y double")
    assert all(r["coefficient"] is None for r in fit_logistic(df, ["site"], {"x": df["x"]}, df["y"]).collect())


@pytest.mark.parametrize("p", [[0.01, 0.04, 0.03, 0.005], [0.2, 0.9, 0.5], [0.05]])
def test_corrections_against_their_definitions(spark, p):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "fam string, i int, p_value double")
    order, m = np.argsort(p), len(p)
    holm = np.empty(m)
    holm[order] = np.minimum(1, np.maximum.accumulate([(m - r) * p[i] for r, i in enumerate(order)]))
    bh = np.empty(m)
    bh[order] = np.minimum(1, np.minimum.accumulate([m / (r + 1) * p[i] for r, i in enumerate(order)][::-1])[::-1])
    got = {r["i"]: r for r in multiplicity.holm(df, ["fam"], ties=["i"]).collect()}
    assert all(abs(got[i]["p_adjusted"] - holm[i]) < 1e-12 and got[i]["reject"] == (holm[i] < 0.05) for i in range(m))
    got = {r["i"]: r["p_adjusted"] for r in multiplicity.benjamini_hochberg(df, ties=["i"]).collect()}
    assert all(abs(got[i] - bh[i]) < 1e-12 for i in range(m))


def test_all_levels_share_one_curve_and_measure_as_alone(spark):
    rng = np.random.default_rng(8)
    rows = [
        (g, "L", ("Female", "Male", None)[i % 3], ("<65", ">=65")[i % 2] if g == "s" else None, float(np.round(rng.random(), 2)), float(rng.random() < 0.4))
        for g in "st" for i in range(120)
    ] + [("u", "L", "Male", "<65", 0.5, 1.0), ("v", "L", None, None, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "site string, label string, sex string, age_group string, score double, truth double")
    gaps = D.auroc_gap(df, CONTRASTS)
    plan = gaps._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Window"), "rows are copied for every contrast before the curve"
    got = {(r["site"], r["stratum"]): r for r in gaps.collect()}
    assert set(got) == {("s", "sex"), ("s", "age_group"), ("t", "sex"), ("u", "sex"), ("u", "age_group")}
    for (site, stratum), row in got.items():
        for side, level in zip("ab", CONTRASTS[stratum], strict=True):
            alone = D.curve_measures(df.where((df["site"] == site) & (df[stratum] == level)), ["site"]).first()
            for name in ("n_positive", "n_negative", "auroc"):
                want = alone[name] if alone else None
                assert row[f"{name}_{side}"] == (pytest.approx(want, abs=1e-12) if want is not None else None)
