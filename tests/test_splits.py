import hashlib

import pytest
from pyspark.sql import functions as F

from cohortgauge.operators import splits
from cohortgauge.operators.ordering import hash_rank, ordered_rank
from cohortgauge.operators.splits import SplitError


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(3000).selectExpr(
        "concat('p', id) AS patient_id", "CASE WHEN id % 5 = 4 THEN 'OUT' ELSE 'IN' END AS site",
        "CASE WHEN id % 7 < 3 THEN 'AP' ELSE 'PA' END AS view", "CASE WHEN id % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 8 = 0 THEN 1D ELSE 0D END AS Cardiomegaly",
    )


def folds_of(df, **options):
    settings = {"training_sites": ["IN"], "stratify_by": ["view", "sex", "Cardiomegaly"], **options}
    return splits.assign_folds(df, **settings)


def test_folds_even_within_every_stratum(people):
    counts = folds_of(people).where("site = 'IN'").groupBy("view", "sex", "Cardiomegaly").pivot("fold", list(range(5))).count()
    for row in counts.collect():
        sizes = [row[str(k)] or 0 for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert {r[0] for r in folds_of(people).where("site = 'OUT'").select("fold").distinct().collect()} == {-1}


def test_folds_do_not_depend_on_order_or_partitioning(people):
    first = {r["patient_id"]: r["fold"] for r in folds_of(people).collect()}
    again = folds_of(people.repartition(13).orderBy(F.rand(3)))
    assert first == {r["patient_id"]: r["fold"] for r in again.collect()}
    other = {r["patient_id"]: r["fold"] for r in folds_of(people, seed=7).collect()}
    assert first != other


def test_hash_rank_equals_a_plain_sort(spark):
    df = spark.range(2000).selectExpr("cast(id as string) AS id", "id % 2 = 0 AS g")
    got = {r["id"]: r["rank"] for r in hash_rank(df, ["g"], F.md5("id"), "id").collect()}
    for even in (True, False):
        names = [str(i) for i in range(2000) if (i % 2 == 0) == even]
        ranked = sorted(names, key=lambda n: (hashlib.md5(n.encode()).hexdigest(), n))
        assert [got[n] for n in ranked] == list(range(1, len(names) + 1))


def test_ordered_rank_equals_a_plain_sort(spark):
    df = spark.range(1000).selectExpr("concat('k', (id * 37) % 1000) AS k")
    got = {r["k"]: r["rank"] for r in ordered_rank(df, ["k"]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1000))


def deal(strata, fraction, minimum):
    """The allocation played out patient by patient."""
    total = round(sum(n for _, n in strata) * fraction)
    plan = {s: int(n * fraction) if n >= minimum else 0 for s, n in strata}
    ok = [(s, n) for s, n in strata if n >= minimum]
    short = total - sum(plan.values())
    for s, _ in sorted(ok, key=lambda x: (-(x[1] * fraction - int(x[1] * fraction)), x[0]))[: max(short, 0)]:
        plan[s] += 1
    while sum(plan.values()) < total:
        moved = False
        for s, n in sorted(ok, key=lambda x: (-x[1], x[0])):
            if sum(plan.values()) < total and plan[s] < n:
                plan[s] += 1
                moved = True
        if not moved:
            break
    return plan


@pytest.mark.parametrize(
    ("sizes", "fraction", "minimum"),
    [
        ([100, 50, 30], 0.15, 7), ([40, 3, 3, 3, 3, 3, 3], 0.3, 7), ([9, 8, 7, 200, 6, 6, 6], 0.15, 7),
        ([8, 9, 10] + [6] * 20, 0.2, 7), ([30, 8, 8] + [6] * 15, 0.33, 7), ([10, 10, 11], 0.95, 2), ([7] * 5, 0.5, 7),
        ([12, 7, 25] + [5] * 30, 0.2, 7),
    ],
)
def test_allocation_matches_dealing_one_by_one(spark, sizes, fraction, minimum):
    strata = [(f"s{i:02d}", n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([("x", 0, s, n) for s, n in strata], "site string, outer_fold int, stratum string, n_patients long")
    got = {r["stratum"]: r["n_val"] for r in splits.plan_allocation(df, val_fraction=fraction, min_stratum=minimum).collect()}
    assert got == deal(strata, fraction, minimum)


def test_allocation_refuses_what_it_cannot_supply(spark):
    df = spark.createDataFrame([("x", 0, f"s{i}", 5) for i in range(10)], "site string, outer_fold int, stratum string, n_patients long")
    with pytest.raises(SplitError, match="are required"):
        splits.check_allocation(splits.plan_allocation(df, val_fraction=0.2, min_stratum=7))


def test_roles_are_exclusive_and_totals_exact(people):
    folded = folds_of(people)
    roles = splits.fold_roles(folded, val_stratify_by=["view", "sex"]).cache()
    n = folded.where("fold >= 0").count()
    assert roles.count() == 5 * n
    assert splits.leakage(roles).where("n_leaking > 0").isEmpty()
    tested = roles.where("role = 'test'").groupBy("patient_id").count().where("count <> 1")
    assert tested.isEmpty() and roles.where("role = 'test' AND fold <> outer_fold").isEmpty()
    for row in roles.groupBy("outer_fold").pivot("role", ["val", "train", "test"]).count().collect():
        assert row["val"] == round((row["val"] + row["train"]) * 0.15)


def test_guards(people):
    with pytest.raises(SplitError, match="no 'fold'"):
        splits.fold_roles(people, val_stratify_by=["view"])
    with pytest.raises(SplitError, match="val_fraction"):
        splits.fold_roles(folds_of(people), val_stratify_by=["view"], val_fraction=1.5)
    with pytest.raises(SplitError, match="cannot hold"):
        splits.check_fold_request(people, ["view"], 1)
    with pytest.raises(SplitError, match="no column to stratify"):
        splits.check_fold_request(people, [], 5)
    with pytest.raises(SplitError, match="to stratify by"):
        splits.check_fold_request(people, ["nope"], 5)
    with pytest.raises(SplitError, match="without patients"):
        splits.check_fold_request(people.limit(0), ["view"], 5)
    with pytest.raises(SplitError, match="several rows"):
        splits.check_fold_request(people.unionByName(people.limit(3)), ["view"], 5)


def test_out_of_fold_checks(people):
    folded = folds_of(people).cache()
    right = folded.where("fold >= 0").select("site", "patient_id", "fold")
    assert splits.assemble_out_of_fold(right, folded).count() == right.count()
    by_fold = {k: right.where(F.col("fold") == k).drop("fold") for k in range(5)}
    assert splits.assemble_out_of_fold(by_fold, folded).count() == right.count()
    with pytest.raises(SplitError, match=r"no predictions for fold\(s\) \[2\]"):
        splits.assemble_out_of_fold({k: v for k, v in by_fold.items() if k != 2}, folded)
    with pytest.raises(SplitError, match="predicted_twice"):
        splits.assemble_out_of_fold(right.unionByName(right.limit(2)), folded)
    with pytest.raises(SplitError, match="no_prediction"):
        splits.assemble_out_of_fold(right.where("patient_id <> 'p0'"), folded)
    with pytest.raises(SplitError, match="wrong_fold"):
        splits.assemble_out_of_fold(right.withColumn("fold", (F.col("fold") + 1) % 5), folded)


def test_validate_folds_sees_a_split_patient(people):
    folded = folds_of(people)
    table = splits.validate_folds(folded, training_sites=["IN"])
    assert table.where("not ok").isEmpty()
    broken = folded.unionByName(folded.where("fold = 0").limit(1).withColumn("fold", F.lit(1)))
    bad = splits.validate_folds(broken, training_sites=["IN"]).where("not ok").collect()
    assert [r["check"] for r in bad] == ["one_fold_per_patient"]
    with pytest.raises(SplitError, match="more than one fold"):
        splits.require_one_fold(broken)


def test_decisions_need_every_scored_patient_in_the_cohort(spark):
    people = spark.createDataFrame(
        [("a", "1", "AP", "Male", 50.0, 1.0, None), ("a", "2", "PA", "Male", 60.0, 0.0, 1.0)],
        "site string, patient_id string, view string, sex string, age double, Edema double, Hernia double",
    )
    scores = spark.createDataFrame([("a", "1", "Edema", 0.7), ("a", "1", "Hernia", 0.1)], "site string, patient_id string, label string, score double")
    got = {r["label"]: (r["score"], r["truth"], r["view"]) for r in splits.assemble_decisions(scores, people, ["Edema", "Hernia"]).collect()}
    assert got == {"Edema": (0.7, 1.0, "AP"), "Hernia": (0.1, None, "AP")}
    with pytest.raises(SplitError, match=r"1 scored patient\(s\) .*\['2'\]"):
        splits.assemble_decisions(scores.withColumn("patient_id", F.lit("2")), people.where("patient_id = '1'"), ["Edema"])
