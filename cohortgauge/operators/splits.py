"""Keyed stratified folds, nested validation draws, and out-of-fold checks.

Every draw is keyed by the seed and the patient's own identifier. Row order,
partitioning and retries cannot change who lands where.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortgauge.functions.keys import hash_hex, hex_to_long, stratum_key
from cohortgauge.functions.maths import ratio
from cohortgauge.operators.ordering import hash_rank, hash_select
from cohortgauge.session import materialise
from cohortgauge.sources.tables import counted

EXTERNAL_FOLD = -1


class SplitError(ValueError):
    """Folds cannot be assigned, or break an invariant."""


def check_fold_request(cohort: DataFrame, stratify_by: list[str], n_folds: int) -> None:
    """Eager guards, one aggregate over the cohort."""
    if "patient_id" not in cohort.columns:
        raise SplitError("folds need a patient_id column")
    if n_folds < 2:
        raise SplitError(f"{n_folds} fold(s) cannot hold anything out")
    if not stratify_by:
        raise SplitError("no column to stratify by")
    absent = [c for c in stratify_by if c not in cohort.columns]
    if absent:
        raise SplitError(f"no column {absent} to stratify by")
    keys = [c for c in ("site",) if c in cohort.columns]
    per_patient = cohort.groupBy(*keys, "patient_id").count()
    row = per_patient.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("count") > 1).alias("dup")).first()
    if not row["n"]:
        raise SplitError("a cohort without patients has no folds")
    if row["dup"]:
        raise SplitError("several rows of one patient; folds are dealt to patients")


def assign_folds(cohort: DataFrame, *, training_sites: list[str], stratify_by: list[str],
                 n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: strata dealt round-robin from a keyed starting fold.

    Sites that are not trained on get ``EXTERNAL_FOLD``. The start differs between
    strata so their remainders do not pile up on the low folds.
    """
    staged = cohort.withColumn("_stratum", F.concat_ws("|", F.col("site"), stratum_key(*[f"`{c}`" for c in stratify_by])))
    trained = staged.where(F.col("site").isin(training_sites))
    ranked = hash_rank(trained, ["_stratum"], hash_hex(seed, "patient_id"), "patient_id", "_rank")
    start = hex_to_long(F.substring(hash_hex(seed, "_stratum"), 1, 8))
    fold = F.pmod(F.col("_rank") - 1 + start, F.lit(n_folds)).cast("int")
    inside = ranked.withColumn("fold", fold).drop("_rank", "_stratum")
    outside = (
        staged.where(~F.col("site").isin(training_sites)).drop("_stratum")
        .withColumn("fold", F.lit(EXTERNAL_FOLD))
    )
    return inside.unionByName(outside)


def _development_strata(cohort: DataFrame, stratify_by: list[str], n_folds: int) -> DataFrame:
    """Development size of each stratum under each outer fold, from one fold cube."""
    cube = (
        cohort.where(F.col("fold") != EXTERNAL_FOLD)
        .groupBy("site", stratum_key(*[f"`{c}`" for c in stratify_by]).alias("stratum"), "fold").count()
    )
    outer = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("outer_fold")
    return (
        cube.select("site", "stratum", "fold", "count", outer)
        .where("fold <> outer_fold")
        .groupBy("site", "outer_fold", "stratum").agg(F.sum("count").alias("n_patients"))
    )


def plan_allocation(strata: DataFrame, *, val_fraction: float, min_stratum: int = 7,
                    keys: list[str] | None = None) -> DataFrame:
    """Validation patients per stratum; the total is ``round(fraction * n)`` exactly.

    Eligible strata get the floor of their share, then one each by largest remainder.
    What is still missing is dealt in rounds over strata by size. The rounds are not
    played out: the number of whole rounds follows from the sorted capacities, so the
    plan costs a few windows over the strata whatever the patient count.
    """
    keys = keys or ["site", "outer_fold"]
    everything = W.partitionBy(*keys)
    exact = F.col("n_patients") * F.lit(float(val_fraction))
    base = strata.select(
        *keys, "stratum", "n_patients", exact.alias("exact"), (F.col("n_patients") >= min_stratum).alias("eligible")
    ).withColumns(
        {
            "_target": F.bround(F.sum("n_patients").over(everything) * F.lit(float(val_fraction)), 0).cast("bigint"),
            "_floor": F.when(F.col("eligible"), F.floor("exact")).otherwise(0).cast("bigint"),
        }
    )
    remainder = F.when(F.col("eligible"), F.col("exact") - F.floor("exact")).otherwise(F.lit(-1.0))
    by_remainder = W.partitionBy(*keys).orderBy(F.desc("_rem"), "stratum")
    first = (
        base.withColumn("_rem", remainder)
        .withColumn("_rn", F.row_number().over(by_remainder))
        .withColumn("_short", F.col("_target") - F.sum("_floor").over(everything))
        .withColumn(
            "_n1", F.col("_floor") + F.when(F.col("eligible") & (F.col("_rn") <= F.col("_short")), 1).otherwise(0)
        )
        .withColumn("_left", F.greatest(F.col("_target") - F.sum("_n1").over(everything), F.lit(0)))
        .withColumn("_room", F.when(F.col("eligible"), F.col("n_patients") - F.col("_n1")).otherwise(0))
    )
    # Strata in order of room: after r whole rounds, those with less room are full.
    by_room = W.partitionBy(*keys).orderBy("_room", "stratum")
    filled = (
        first.withColumn("_below", F.coalesce(
            F.sum("_room").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_above", F.count(F.lit(1)).over(everything) - F.row_number().over(by_room) + 1)
        # Rounds that fit if exactly the strata before this one run full. Each such
        # count is at most the true one and the right stratum attains it.
        .withColumn("_try", F.floor((F.col("_left") - F.col("_below")) / F.col("_above")))
        .withColumn("_rounds", F.greatest(F.max("_try").over(everything), F.lit(0)))
        .withColumn("_n2", F.least("_rounds", "_room"))
        .withColumn("_rest", F.col("_left") - F.sum("_n2").over(everything))
    )
    open_after = F.col("_room") > F.col("_rounds")
    by_size = W.partitionBy(*keys, "_open").orderBy(F.desc("n_patients"), "stratum")
    return (
        filled.withColumn("_open", open_after)
        .withColumn("_turn", F.row_number().over(by_size))
        .select(
            *keys, "stratum", "n_patients", "exact", "eligible",
            (
                F.col("_n1") + F.col("_n2")
                + F.when(F.col("_open") & (F.col("_turn") <= F.col("_rest")), 1).otherwise(0)
            ).cast("bigint").alias("n_val"),
            (~F.col("eligible")).alias("skipped"),
            F.col("_target").alias("target"),
        )
    )


def check_allocation(plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raise where the eligible strata cannot supply the target."""
    keys = keys or ["site", "outer_fold"]
    short = (
        plan.groupBy(*keys).agg(F.sum("n_val").alias("n_val"), F.first("target").alias("target"))
        .where("n_val <> target").limit(1).collect()
    )
    if short:
        row = short[0]
        raise SplitError(
            f"eligible strata supply {row['n_val']:,} validation patients but {row['target']:,} are required; "
            "coarsen stratify_by or lower min_val_stratum deliberately"
        )
    return plan


def validation_plan(cohort: DataFrame, *, stratify_by: list[str], n_folds: int = 5, val_fraction: float = 0.15,
                    min_stratum: int = 7) -> DataFrame:
    """The allocation for every site and outer fold at once."""
    strata = _development_strata(cohort, stratify_by, n_folds)
    return plan_allocation(strata, val_fraction=val_fraction, min_stratum=min_stratum)


def fold_roles(cohort: DataFrame, *, val_stratify_by: list[str], n_folds: int = 5, val_fraction: float = 0.15,
               min_stratum: int = 7, seed: int = 42) -> DataFrame:
    """``train``, ``val`` or ``test`` for every patient under every outer fold."""
    if not 0 < val_fraction < 1:
        raise SplitError(f"val_fraction must lie in (0, 1), got {val_fraction}")
    if "fold" not in cohort.columns:
        raise SplitError("cohort has no 'fold' column; call assign_folds first")
    plan = materialise(
        validation_plan(
            cohort, stratify_by=val_stratify_by, n_folds=n_folds, val_fraction=val_fraction, min_stratum=min_stratum
        )
    )
    # Read three times below, and as narrow as it gets: stored once.
    slim = materialise(
        cohort.where(F.col("fold") != EXTERNAL_FOLD).select(
            "site", "patient_id", "fold", stratum_key(*[f"`{c}`" for c in val_stratify_by]).alias("stratum")
        )
    )
    outer = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("outer_fold")
    spread = slim.select("*", outer)
    order = hash_hex(F.lit(seed) + F.col("outer_fold"), "patient_id")
    drawn = hash_select(
        spread.where("fold <> outer_fold"), ["site", "outer_fold", "stratum"], order, "patient_id", plan, "n_val", "_chosen"
    )
    keep = ["site", "patient_id", "fold", "outer_fold"]
    tests = spread.where("fold = outer_fold").select(*keep, F.lit("test").alias("role"))
    return drawn.select(*keep, F.when(F.col("_chosen"), "val").otherwise("train").alias("role")).unionByName(tests)


def validate_folds(folds: DataFrame, *, training_sites: list[str], n_folds: int = 5) -> DataFrame:
    """Invariants per site as ``site, check, value, ok, note``.

    A patient with two folds shows as ``one_fold_per_patient = false``;
    :func:`require_one_fold` raises on it.
    """
    # Smallest and largest fold decide uniqueness; no distinct set is built.
    per_patient = folds.groupBy("site", "patient_id").agg(
        F.min("fold").alias("_low"), F.max("fold").alias("_high"), F.count(F.lit(1)).alias("_rows")
    )
    patients = per_patient.groupBy("site").agg(
        F.count_if(F.col("_low") < F.col("_high")).alias("multi"), F.sum("_rows").alias("n")
    )
    sizes = folds.groupBy("site", "fold").count()
    spread = sizes.groupBy("site").agg(
        ratio(F.max("count") - F.min("count"), F.avg("count")).alias("spread"),
        F.array_sort(F.collect_list("fold")).alias("present"),
    )
    trained = F.col("site").isin(training_sites)
    expected = F.when(trained, F.sequence(F.lit(0), F.lit(n_folds - 1))).otherwise(F.array(F.lit(EXTERNAL_FOLD)))
    even = F.col("spread") < 0.05
    member = F.col("present") == expected
    unique = F.col("multi") == 0
    listed = F.concat(F.lit("["), F.array_join(F.col("present").cast("array<string>"), ", "), F.lit("]"))
    packed = F.array(
        F.struct(
            F.lit("fold_sizes_even").alias("check"),
            F.concat(F.format_string("%.1f", F.round(F.col("spread") * 100, 1)), F.lit("% spread")).alias("value"),
            even.alias("ok"), F.when(even, "").otherwise("folds differ in size by >5%").alias("note"),
        ),
        F.struct(
            F.lit("fold_membership").alias("check"), listed.alias("value"), member.alias("ok"),
            F.when(member, "").when(trained, "folds expected from 0 to the last")
            .otherwise("non-training site must be wholly external").alias("note"),
        ),
        F.struct(
            F.lit("one_fold_per_patient").alias("check"),
            F.concat(F.col("n").cast("string"), F.lit(" patients")).alias("value"), unique.alias("ok"),
            F.when(unique, "").otherwise("patients carry more than one fold").alias("note"),
        ),
    )
    return spread.join(patients, "site").select("site", F.inline(packed)).where(
        (F.col("check") != "fold_sizes_even") | trained
    )


def require_one_fold(folds: DataFrame) -> None:
    broken = (
        folds.groupBy("site", "patient_id").agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
        .where("a <> b").limit(3).collect()
    )
    if broken:
        raise SplitError(f"patients carry more than one fold (e.g. {[r['patient_id'] for r in broken]})")


# ---------------------------------------------------------------- out of fold


def oof_problems(predictions: DataFrame, cohort: DataFrame, *, n_folds: int = 5) -> DataFrame:
    """Every way a pooled table can fail to be out-of-fold, counted per site.

    One full join on the patient answers duplicates, gaps and provenance together.
    """
    pooled = predictions.groupBy("site", "patient_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("fold").alias("_low"), F.max("fold").alias("_high")
    )
    assigned = cohort.select("site", "patient_id", F.col("fold").alias("_fold"), F.lit(True).alias("_known"))
    joined = pooled.join(assigned, ["site", "patient_id"], "full")
    wrong = F.col("_n").isNotNull() & (
        F.coalesce(F.col("_low") != F.col("_fold"), F.lit(True)) | (F.col("_high") != F.col("_fold"))
    )
    counts = joined.groupBy("site").agg(
        F.count_if(F.col("_n") > 1).alias("predicted_twice"),
        F.count_if(F.col("_n").isNull() & (F.col("_fold") != EXTERNAL_FOLD)).alias("no_prediction"),
        F.count_if(wrong).alias("wrong_fold"),
        F.count_if(F.col("_n").isNotNull()).alias("_patients"),
    )
    supplied = predictions.groupBy("site").agg(
        F.count_distinct(F.when(F.col("fold").between(0, n_folds - 1), F.col("fold"))).alias("_supplied")
    )
    packed = F.array(
        F.struct(F.lit("missing_folds").alias("check"),
                 (F.lit(n_folds) - F.coalesce("_supplied", F.lit(0))).cast("bigint").alias("n_affected")),
        *[
            F.struct(F.lit(c).alias("check"), F.col(c).alias("n_affected"))
            for c in ("predicted_twice", "no_prediction", "wrong_fold")
        ],
    )
    return (
        counts.join(supplied, "site", "left").where(F.col("_patients") > 0)
        .select("site", F.inline(packed)).withColumn("ok", F.col("n_affected") == 0)
    )


def oof_missing(predictions: DataFrame, cohort: DataFrame) -> DataFrame:
    """Patients that should have a prediction and do not."""
    expected = cohort.where(F.col("fold") != EXTERNAL_FOLD).select("site", "patient_id")
    return expected.join(predictions.select("site", "patient_id"), ["site", "patient_id"], "left_anti")


def oof_wrong_fold(predictions: DataFrame, cohort: DataFrame) -> DataFrame:
    """Predictions made by a model that trained on the patient."""
    assigned = cohort.select("site", "patient_id", F.col("fold").alias("assigned_fold"))
    return (
        predictions.select("site", "patient_id", "fold").join(assigned, ["site", "patient_id"])
        .where("fold <> assigned_fold")
    )


def assemble_out_of_fold(predictions, cohort: DataFrame, *, n_folds: int = 5) -> DataFrame:
    """Pool per-fold predictions after checking coverage, uniqueness and provenance.

    ``predictions`` is one frame with ``fold``, or a mapping from fold to frame.
    """
    if isinstance(predictions, dict):
        absent = sorted(set(range(n_folds)) - set(predictions))
        if absent:
            raise SplitError(f"no predictions for fold(s) {absent}")
        frames = [df.withColumn("fold", F.lit(k)) for k, df in predictions.items()]
        pooled = frames[0]
        for frame in frames[1:]:
            pooled = pooled.unionByName(frame)
    else:
        pooled = predictions
    if "patient_id" not in pooled.columns:
        raise SplitError("predictions have no 'patient_id' column")
    bad = oof_problems(pooled, cohort, n_folds=n_folds).where(~F.col("ok")).collect()
    if bad:
        found = "; ".join(f"{r['site']}: {r['n_affected']} {r['check']}" for r in bad)
        raise SplitError(f"the pooled table is not out-of-fold: {found}")
    return pooled


def assemble_decisions(scores: DataFrame, cohort: DataFrame, labels: list[str], columns: tuple[str, ...] = ("view", "sex", "age")) -> DataFrame:
    """Long scores beside what the cohort says of the patient and the label's truth.

    A scored patient whom the cohort does not hold raises: such a row would drop out of every
    rate unseen. Patients without a score stay out; ``assemble_out_of_fold`` looks for them.
    """
    held = cohort.select("site", "patient_id").distinct()
    strangers = scores.select("site", "patient_id").distinct().join(held, ["site", "patient_id"], "left_anti")
    n, some = counted(strangers, "patient_id")
    if n:
        raise SplitError(f"{n} scored patient(s) are not in the cohort, among them {some}")
    pairs = ", ".join(f"named_struct('label', '{name}', 'truth', cast(`{name}` AS double))" for name in labels)
    truths = cohort.selectExpr("site", "patient_id", *columns, f"inline(array({pairs}))")
    return scores.join(truths, ["site", "patient_id", "label"])


def require_disjoint(roles: DataFrame) -> None:
    """Raise where a patient holds two roles under one outer fold, or none under some."""
    folds = roles.select("outer_fold").distinct().count()
    listed = roles.groupBy("site", "patient_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("outer_fold").alias("folds"))
    n, some = counted(listed.where((F.col("n") != F.col("folds")) | (F.col("folds") != folds)), "patient_id")
    if n:
        raise SplitError(f"{n} patient(s) do not hold exactly one role under each of {folds} folds, among them {some}")


def leakage(roles: DataFrame) -> DataFrame:
    """Per site and outer fold: patients, and those listed under more than one role."""
    per_patient = roles.groupBy("site", "outer_fold", "patient_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_patient.groupBy("site", "outer_fold").agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.count_if(F.col("_n") > 1).alias("n_leaking"),
    )
