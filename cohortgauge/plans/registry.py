"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.keys import canonical_image_key, hash_hex, hex_to_long
from cohortgauge.functions.maths import logit
from cohortgauge.operators import (
    bootstrap,
    calibration,
    cells,
    cohort,
    contracts,
    discrimination,
    fairness,
    interaction,
    metrics,
    multiplicity,
    power,
    regression,
    scorer,
    splits,
    transport,
)
from cohortgauge.operators.fingerprint import fingerprint
from cohortgauge.operators.ordering import union_all
from cohortgauge.plans import population as pop
from cohortgauge.plans.analysis import analyse
from cohortgauge.session import materialise, shared_folder
from cohortgauge.sources import imagecache, sites, tables

QUERIES = {}

KEY_PATTERN = r"patient(\d+)[/_]study(\d+)[/_](view\d+_[a-zA-Z]+)"
# Fixed values used by the registered queries.
DRIFT_SCHEMA = [n for n in pop.PREVALENCE if n not in ("Fracture", "Lung Opacity")]
NUDGE = "1e-9"
GRID = [round(0.5 + 0.1 * i, 1) for i in range(26)]
VIEW_TEMPERATURES = {"AP": 1.8, calibration.POOLED: 1.5}
QUERY_SHARD = 1000
MEANINGFUL = 0.16
BASELINES = [0.1, 0.2, 0.3, 0.4]
MARGINS = [0.01, 0.02, 0.05]


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round the doubles that depend on summation order, moved off exact halves first."""
    return df.withColumns({c: F.expr(f"round(`{c}` + {NUDGE}D, {digits})") for c in columns})


# ------------------------------------------------------------- scans and loaders


@query
def scan_union(spark, sf):
    orders = pop.table(spark, sf, "orders")
    full = orders.where("NOT o_orderstatus <=> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice")
    extra = orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")
    return tables.scan_union(full, extra)


@query
def manifest_lines(spark, sf):
    return cohort.manifest_lines(pop.manifest(spark, sf), "value", ["site"])


@query
def canonical_key(spark, sf):
    lines = pop.manifest(spark, sf).selectExpr("trim(value) AS name").where("name <> ''").distinct()
    return lines.select(
        "name", canonical_image_key("name").alias("file_key"), canonical_image_key("name", 3).alias("path_key"),
        canonical_image_key("name", 1, KEY_PATTERN).alias("pattern_key"),
    )


@query
def load_site_tokens(spark, sf):
    return sites.shape_tokens(pop.token_records(spark, sf), list(pop.PREVALENCE), F.col("site"))


@query
def load_site_paths(spark, sf):
    raw, labels = pop.path_records(spark, sf)
    probed = sites.join_path_labels(raw, labels, "path_to_image")
    return sites.shape_paths(probed, list(pop.PREVALENCE), F.col("site")).where("has_labels").drop("has_labels")


def _anchored(spark, sf):
    return sites.shape_anchored(sites.join_anchored(*pop.anchored_records(spark, sf)), list(pop.PREVALENCE), F.col("site"))


@query
def load_site_anchor(spark, sf):
    return _anchored(spark, sf).where("has_labels and has_demographics").drop("has_labels", "has_demographics")


@query
def join_labels_attrition(spark, sf):
    return _anchored(spark, sf).groupBy("site").agg(
        F.expr("count(1) AS n_images"), F.expr("count_if(has_labels) AS n_labelled"),
        F.expr("count_if(has_labels AND has_demographics) AS n_known"),
        F.expr("count_if(NOT has_labels) AS n_unlabelled"),
    )


@query
def join_attrition_by_view(spark, sf):
    return sites.attrition_by(_anchored(spark, sf), "view_raw", keys=["site"]).withColumnRenamed("count", "n_images")


@query
def token_drift(spark, sf):
    return cohort.token_drift(pop.token_records(spark, sf), "Finding Labels", DRIFT_SCHEMA, ["site"])


# --------------------------------------------------------- predicates and cohort


@query
def manifest_semi(spark, sf):
    names = cohort.manifest_lines(pop.manifest(spark, sf), "value", ["site"])
    held = cohort.hold_manifest(pop.images(spark, sf), names, 3, None, ["site"])
    return held.select("site", "patient_id", "image_id", "view_raw")


@query
def verify_manifest(spark, sf):
    names = cohort.manifest_lines(pop.manifest(spark, sf), "value", ["site"])
    return cohort.verify_manifest(pop.images(spark, sf), names, 3, None, ["site"])


@query
def uncertain_nan(spark, sf):
    done = cohort.resolve_uncertain(pop.images(spark, sf), pop.OBSERVED, "nan")
    return done.select("patient_id", *[F.col(f"`{n}`") for n in pop.PREVALENCE])


@query
def uncertain_uzeros(spark, sf):
    done = cohort.resolve_uncertain(pop.images(spark, sf), pop.OBSERVED, "u_zeros")
    return done.select("patient_id", *[F.col(f"`{n}`") for n in pop.PREVALENCE])


@query
def no_finding(spark, sf):
    return cohort.derive_no_finding(pop.images(spark, sf), pop.OBSERVED).select("patient_id", "`No Finding`")


@query
def classify_outcome(spark, sf):
    return pop.classified(spark, sf).select("patient_id", "site", "outcome")


@query
def age_bin(spark, sf):
    return pop.images(spark, sf).select("patient_id", "age", cohort.age_bin_column(pop.study()).alias("age_bin"))


@query
def age_group(spark, sf):
    source = pop.token_records(spark, sf).selectExpr("`Patient ID` AS patient_id", "try_cast(`Patient Age` AS double) AS age")
    return source.select("patient_id", "age", cohort.age_group_column(65).alias("age_group"))


@query
def build_cohort(spark, sf):
    names = cohort.manifest_lines(pop.manifest(spark, sf), "value", ["site"])
    held = cohort.hold_manifest(pop.images(spark, sf), names, 3, None, ["site"])
    return cohort.retained_cohort(cohort.label_and_classify(held, pop.study(), pop.OBSERVED, "nan"), pop.study(), pop.OBSERVED)


@query
def cohort_flow(spark, sf):
    return cohort.cohort_flow(pop.flagged_images(spark, sf))


@query
def exclusion_summary(spark, sf):
    return cohort.exclusion_summary(cohort.audit_frame(pop.classified(spark, sf)))


@query
def exclusion_pivot(spark, sf):
    return cohort.exclusion_pivot(cohort.audit_frame(pop.classified(spark, sf)), pop.SITES)


# ------------------------------------------------------------------ cell tables


@query
def cohort_summary(spark, sf):
    return rounded(cells.cohort_summary(pop.cohort(spark, sf)), "share_ap", "share_female", "share_no_finding")


@query
def view_share_age(spark, sf):
    bands = pop.study().age_bin_labels
    return rounded(cells.view_share(pop.cohort(spark, sf), "age_bin", bands), *bands)


@query
def view_share_sex(spark, sf):
    return rounded(cells.view_share(pop.cohort(spark, sf), "sex", ["Female", "Male"]), "Female", "Male")


@query
def positives_by_view(spark, sf):
    return cells.positives_by_view(pop.cohort(spark, sf), pop.study().analysis_labels)


@query
def integrity_stats(spark, sf):
    return cells.integrity_stats(pop.cohort(spark, sf), pop.study().analysis_labels, ["site"])


@query
def inferential_cells(spark, sf):
    return cells.inferential_cells(pop.cohort(spark, sf), pop.study().analysis_labels, pop.study().strata)


def _counts(spark, sf):
    cfg = pop.study()
    return cells.contrast_counts(pop.grouped(spark, sf), cfg.analysis_labels, cfg.contrasts)


@query
def cell_positive_counts(spark, sf):
    return _counts(spark, sf)


@query
def thinnest_cells(spark, sf):
    return cells.thinnest_cells(_counts(spark, sf))


@query
def positive_weights(spark, sf):
    weights = metrics.positive_weights(pop.cohort(spark, sf), pop.study().analysis_labels, ["site"])
    return rounded(weights, "weight")


# -------------------------------------------------------------------- contracts

SHOWN = ["check", "subject", "n_affected", "examples"]


def _rules(build, *args):
    def run(spark, sf):
        df = pop.untidy(spark, sf)
        return contracts.broken_rules(df, build(df, *args)).select(*SHOWN)

    return run


QUERIES["contract_nulls"] = _rules(contracts.null_rules)
QUERIES["contract_blank"] = _rules(contracts.blank_rules)
QUERIES["contract_view"] = _rules(contracts.view_rules)
QUERIES["contract_demo"] = _rules(contracts.demographic_rules)
QUERIES["contract_labels"] = _rules(contracts.label_rules, ["Cardiomegaly", "Edema", "No Finding"])


def _no_finding_check(check):
    def run(spark, sf):
        df = pop.untidy(spark, sf)
        rules = [r for r in contracts.no_finding_rules(df, ["Cardiomegaly", "Edema", "No Finding"]) if r.check == check]
        return contracts.broken_rules(df, rules).select(*SHOWN)

    return run


QUERIES["contract_nf"] = _no_finding_check("labels.no_finding_contradiction")
QUERIES["contract_nf_derive"] = _no_finding_check("labels.no_finding_derivation")


@query
def contract_dup_ids(spark, sf):
    df = pop.untidy(spark, sf)
    return union_all(
        [contracts.duplicate_identifiers(df, c).select(*SHOWN) for c in ("patient_id", "study_id", "image_id")]
    )


@query
def contract_study_span(spark, sf):
    return contracts.study_spans(pop.untidy(spark, sf)).select(*SHOWN)


@query
def contract_provenance(spark, sf):
    return contracts.provenance(pop.untidy(spark, sf), "AMERICA", pop.study().cohort_hash).select(*SHOWN)


@query
def contract_thin(spark, sf):
    df = pop.untidy(spark, sf)
    return contracts.thin_cells(df, ["Cardiomegaly", "Edema"], 120).select("site", *SHOWN)


@query
def contract_all(spark, sf):
    return contracts.violations(pop.untidy(spark, sf), ["Cardiomegaly", "Edema", "No Finding"]).select(*SHOWN)


# ------------------------------------------------------------------------ splits


@query
def assign_folds(spark, sf):
    return pop.folded(spark, sf).select("site", "patient_id", "fold")


@query
def fold_roles(spark, sf):
    return pop.roles(spark, sf)


@query
def val_allocation(spark, sf):
    plan = splits.validation_plan(
        pop.folded(spark, sf), stratify_by=["view", "sex", "age_bin", "Cardiomegaly"], val_fraction=0.15, min_stratum=40
    )
    return rounded(plan, "exact")


@query
def fold_balance(spark, sf):
    cfg = pop.study()
    return cells.fold_balance(pop.folded(spark, sf), cfg.analysis_labels, cfg.age_bin_labels, cfg.stratify_by)


@query
def cell_balance(spark, sf):
    cfg = pop.study()
    people = pop.folded(spark, sf).where(F.col("site").isin(cfg.training_sites))
    return cells.cell_balance(people, cfg.analysis_labels, cfg.n_folds, cfg.strata)


@query
def validate_folds(spark, sf):
    cfg = pop.study()
    return splits.validate_folds(pop.folded(spark, sf), training_sites=cfg.training_sites, n_folds=cfg.n_folds)


@query
def join_folds(spark, sf):
    people = pop.cohort(spark, sf)
    folds = pop.folded(spark, sf).select("site", "patient_id", "fold")
    return people.join(folds, ["site", "patient_id"], "left").groupBy("site").agg(
        F.expr("count(1) AS n_patients"), F.expr("count_if(fold IS NULL) AS n_without_fold")
    )


@query
def leakage_check(spark, sf):
    return splits.leakage(pop.roles(spark, sf))


def _predictions(spark, sf, people):
    """Pooled test predictions with gaps, repeats and wrong folds planted."""
    key = F.col("patient_id").cast("bigint")
    base = people.where("fold >= 0").where(key % 50 != 0).select(
        "site", "patient_id", F.when(key % 60 == 1, (F.col("fold") + 1) % 5).otherwise(F.col("fold")).alias("fold")
    )
    return base.unionByName(base.where(F.col("patient_id").cast("bigint") % 70 == 3))


@query
def oof_union(spark, sf):
    """Per-fold predictions pooled after the checks for coverage, repeats and provenance."""
    people, folds = pop.folded(spark, sf), pop.study().n_folds
    parts = {k: people.where(F.col("fold") == k).select("site", "patient_id") for k in range(folds)}
    return splits.assemble_out_of_fold(parts, people, n_folds=folds).select("site", "patient_id", "fold")


@query
def oof_checks(spark, sf):
    people = pop.folded(spark, sf)
    return splits.oof_problems(_predictions(spark, sf, people), people)


@query
def oof_missing(spark, sf):
    people = pop.folded(spark, sf)
    return splits.oof_missing(_predictions(spark, sf, people), people)


@query
def oof_wrong_fold(spark, sf):
    people = pop.folded(spark, sf)
    return splits.oof_wrong_fold(_predictions(spark, sf, people), people)


# ----------------------------------------------------------------------- metrics

BY_LABEL = ["site", "label"]


@query
def auroc_by_label(spark, sf):
    return rounded(metrics.auroc(pop.scores(spark, sf), BY_LABEL), "auroc")


@query
def auroc_macro(spark, sf):
    per_label = metrics.auroc(pop.scores(spark, sf), BY_LABEL)
    return rounded(metrics.macro_auroc(per_label, ["site"]), "macro_auroc")


@query
def brier(spark, sf):
    return rounded(metrics.proper_scores(pop.scores(spark, sf), BY_LABEL).select(*BY_LABEL, "n", "brier"), "brier")


@query
def nll(spark, sf):
    return rounded(metrics.proper_scores(pop.scores(spark, sf), BY_LABEL).select(*BY_LABEL, "n", "nll"), "nll")


@query
def ece(spark, sf):
    return rounded(metrics.expected_calibration_error(pop.scores(spark, sf), BY_LABEL), "ece")


@query
def reliability_table(spark, sf):
    table = metrics.reliability_table(pop.scores(spark, sf), BY_LABEL)
    return rounded(table, "mean_predicted", "observed_rate")


@query
def masked_bce(spark, sf):
    rows = pop.scores(spark, sf).withColumn("logit", logit("score"))
    return rounded(metrics.masked_bce(rows, BY_LABEL), "loss")


@query
def threshold_fixed_sens(spark, sf):
    return rounded(calibration.select_threshold(pop.scores(spark, sf), BY_LABEL), "achieved_sensitivity")


@query
def threshold_youden(spark, sf):
    return rounded(
        calibration.select_threshold(pop.scores(spark, sf), BY_LABEL, rule="youden"), "achieved_sensitivity"
    )


# ------------------------------------------------------------------- calibration


@query
def temperature_grid(spark, sf):
    return rounded(calibration.temperature_grid(pop.scores(spark, sf), BY_LABEL, GRID), "nll")


@query
def apply_temperature(spark, sf):
    scaled = pop.scores(spark, sf).withColumn("calibrated", calibration.scale_score(F.col("score"), 1.7))
    return rounded(scaled.select(*BY_LABEL, "patient_id", "calibrated"), "calibrated")


@query
def apply_temperature_view(spark, sf):
    """PA has no temperature of its own here and takes the pooled one."""
    rows = pop.scores(spark, sf)
    packed = ", ".join(f"named_struct('view', '{v}', 'temperature', {t}D)" for v, t in VIEW_TEMPERATURES.items())
    groups = rows.select("site", "label").distinct().selectExpr("*", f"inline(array({packed}))")
    scaled = calibration.apply_temperatures(rows, materialise(groups), BY_LABEL, "view")
    return rounded(scaled.select(*BY_LABEL, "patient_id", "view", "calibrated"), "calibrated")


@query
def fit_temperature(spark, sf):
    fits = calibration.fit_temperatures(pop.scores(spark, sf), BY_LABEL).where(F.col("view") == calibration.POOLED)
    return rounded(fits.select(*BY_LABEL, "temperature", "status", "n_positive", "n_negative"), "temperature")


@query
def view_temperatures(spark, sf):
    fits = calibration.fit_temperatures(pop.scores(spark, sf), BY_LABEL)
    table = calibration.view_temperatures(fits, BY_LABEL, 60, 25)
    return rounded(table.select(*BY_LABEL, "view", "temperature", "pooled_fallback", "n_positive"), "temperature")


@query
def calibrate(spark, sf):
    validation, _ = pop.fold_scores(spark, sf)
    temperatures, thresholds = calibration.calibrate(validation, arm="view", strict=False)
    table = calibration.fold_parameters(temperatures, thresholds, ["AP", "PA"], "view")
    return rounded(table, "threshold", "achieved_sensitivity", "T_AP", "T_PA")


def _decisions(spark, sf, arm="global"):
    validation, test = pop.fold_scores(spark, sf)
    temperatures, thresholds = calibration.calibrate(validation, arm=arm, strict=False)
    return calibration.decide(test, temperatures, thresholds, arm)


@query
def decisions(spark, sf):
    made = _decisions(spark, sf)
    return rounded(made.select("site", "fold", "label", "patient_id", "calibrated", "predicted"), "calibrated")


@query
def transport_rates(spark, sf):
    """Frozen models and thresholds of the training sites at every other site."""
    validation, _ = pop.fold_scores(spark, sf)
    temperatures, thresholds = calibration.calibrate(validation, strict=False)
    table = transport.transport_rates(transport.decide_elsewhere(pop.foreign_scores(spark, sf), temperatures, thresholds))
    return rounded(table, "fnr", "fpr", "fnr_low", "fnr_high")


@query
def assemble_decisions(spark, sf):
    cfg = pop.study()
    scored = pop.scores(spark, sf, cfg.training_sites).select("site", "patient_id", "label", "score")
    return splits.assemble_decisions(scored, pop.grouped(spark, sf), cfg.analysis_labels)


@query
def temperature_summary(spark, sf):
    validation, _ = pop.fold_scores(spark, sf)
    temperatures, thresholds = calibration.calibrate(validation, arm="view", strict=False)
    table = calibration.fold_parameters(temperatures, thresholds, ["AP", "PA"], "view")
    return rounded(calibration.temperature_summary(table), "mean_gap", "sd_gap", "min_gap", "max_gap")


@query
def calibration_slope(spark, sf):
    return rounded(calibration.calibration_slope(pop.scores(spark, sf), BY_LABEL), "slope", "intercept")


@query
def calibration_report(spark, sf):
    rows = pop.scores(spark, sf).withColumn("calibrated", calibration.scale_score(F.col("score"), 1.7))
    report = calibration.calibration_report(rows, BY_LABEL, ["AP", "PA"])
    return rounded(report, *[c for c in report.columns if c not in BY_LABEL])


# ---------------------------------------------------------------------- fairness


def _cube(spark, sf):
    return fairness.outcome_cube(pop.quick_decisions(spark, sf), ["sex", "age_group"])


def _cells(spark, sf):
    return fairness.contrast_cells(_cube(spark, sf), pop.study().contrasts)


@query
def fnr_overall(spark, sf):
    return rounded(fairness.overall_rates(_cube(spark, sf)).select("site", "label", "positives", "fnr"), "fnr")


@query
def flagged_rate(spark, sf):
    return rounded(fairness.overall_rates(_cube(spark, sf)).select("site", "label", "flagged"), "flagged")


@query
def group_gap(spark, sf):
    return rounded(fairness.group_gap(_cells(spark, sf)), "rate_a", "rate_b", "gap")


@query
def within_view_gaps(spark, sf):
    return rounded(fairness.within_view_gaps(_cells(spark, sf)), "rate_a", "rate_b", "gap")


@query
def standardised_rate(spark, sf):
    return rounded(fairness.standardise_rate(_cells(spark, sf), {"AP": 0.4, "PA": 0.6}), "std_rate_a", "std_rate_b")


@query
def standardised_gap(spark, sf):
    gap = fairness.standardised_gap(_cells(spark, sf)).drop("std_rate_a", "std_rate_b")
    return rounded(gap, "gap_standardised")


@query
def positivity_report(spark, sf):
    detail = fairness.positivity_detail(_cells(spark, sf), {"AP": 0.8, "PA": 0.2}, 45, 0.30)
    return detail.drop("pos")


@query
def positivity_verdict(spark, sf):
    detail = fairness.positivity_detail(_cells(spark, sf), {"AP": 0.8, "PA": 0.2}, 45, 0.30)
    return fairness.positivity_report(detail)


@query
def bootstrap_gap(spark, sf):
    wanted = _cells(spark, sf)
    return rounded(bootstrap.bootstrap_gaps(wanted, bootstrap.bootstrap(wanted)), "rate_a", "rate_b", "gap", "ci_low", "ci_high")


DELTAS = ["gap_raw", "gap_standardised", "delta", *(f"{n}_ci_{e}" for n in ("raw", "std", "delta") for e in ("low", "high"))]


def _deltas(spark, sf):
    """Gap differences with the intervals of their replicates."""
    wanted, mix = _cells(spark, sf), pop.study().reference_mix
    return bootstrap.delta_gaps(wanted, bootstrap.bootstrap(wanted, reference=mix), reference=mix)


@query
def delta_gap(spark, sf):
    return rounded(_deltas(spark, sf), *DELTAS)


@query
def analyse_label(spark, sf):
    return rounded(analyse(pop.quick_decisions(spark, sf), pop.study()).standardised, *DELTAS)


@query
def analysis_notes(spark, sf):
    return analyse(pop.quick_decisions(spark, sf), pop.study()).notes


@query
def verdict(spark, sf):
    return rounded(_deltas(spark, sf).select("site", "label", "stratum", "delta", "verdict"), "delta")


@query
def verdict_sensitivity(spark, sf):
    return fairness.verdict_sensitivity(_deltas(spark, sf), MARGINS)


@query
def replication(spark, sf):
    return fairness.replication(_deltas(spark, sf).where(F.col("site").isin(pop.study().training_sites)))


@query
def auroc_gap(spark, sf):
    table = discrimination.auroc_gap(pop.scores(spark, sf), pop.study().contrasts)
    return rounded(table, "auroc_a", "auroc_b", "gap", "std_error", "ci_low", "ci_high", "p_value")


@query
def auprc_gap(spark, sf):
    table = discrimination.auprc_gap(pop.scores(spark, sf), pop.study().contrasts)
    return rounded(table, "auprc_a", "auprc_b", "gap", "prevalence_a", "prevalence_b")


# ------------------------------------------------------------- models and families


@query
def interaction_cells(spark, sf):
    cube = _cube(spark, sf)
    return union_all([interaction.interaction_cells(cube, s) for s in pop.study().contrasts])


@query
def interaction_closed(spark, sf):
    table = interaction.interaction_closed(_cube(spark, sf), pop.study().contrasts)
    return rounded(table, "coefficient", "odds_ratio", "ci_low", "ci_high", "p_value")


@query
def interaction_glm(spark, sf):
    cube = _cube(spark, sf)
    models = [interaction.interaction_model(cube, "sex", ["age_group"]), interaction.interaction_model(cube, "age_group", ["sex"])]
    return rounded(union_all(models), "coefficient", "odds_ratio", "ci_low", "ci_high", "p_value")


@query
def interaction_notes(spark, sf):
    cube = _cube(spark, sf)
    return union_all([interaction.guard_notes(cube, s) for s in pop.study().contrasts])


@query
def holm(spark, sf):
    tests = interaction.interaction_closed(_cube(spark, sf), pop.study().contrasts)
    table = multiplicity.holm(tests.select("site", "label", "stratum", "p_value"), ["site"], ties=["label", "stratum"])
    return rounded(table, "p_value", "p_adjusted")


@query
def benjamini_hochberg(spark, sf):
    tests = interaction.interaction_closed(_cube(spark, sf), pop.study().contrasts)
    table = multiplicity.benjamini_hochberg(
        tests.select("site", "label", "stratum", "p_value"), ["site"], ties=["label", "stratum"]
    )
    return rounded(table, "p_value", "p_adjusted")


@query
def coupling_logit(spark, sf):
    return rounded(
        regression.acquisition_coupling(pop.cohort(spark, sf)), "odds_ratio", "ci_low", "ci_high", "p_value"
    )


# ------------------------------------------------------------------------- power


@query
def closed_form_power(spark, sf):
    table = _counts(spark, sf)
    value = power.closed_form_power(F.col("n_a"), F.col("n_b"), 0.30, 0.42)
    return rounded(table.withColumn("power", value), "power")


def _evaluated(spark, sf, baseline=0.30, meaningful=MEANINGFUL):
    return power.evaluate_cells(_counts(spark, sf), baseline=baseline, meaningful_effect=meaningful)


@query
def evaluate_cells(spark, sf):
    return rounded(_evaluated(spark, sf, meaningful=0.12), "mde")


def _tiers(table):
    cfg = pop.study()
    return power.assign_tiers(
        table, cfg.analysis_labels, secondary_lane=["No Finding", "Pleural Effusion"],
        inferential_sites=cfg.inferential_sites,
    )


@query
def powered_summary(spark, sf):
    return power.powered_summary(_evaluated(spark, sf), ["site", "stratum"])


@query
def coarsening_ladder(spark, sf):
    cfg = pop.study()
    ladder = cfg.analysis["power"]["coarsening_ladder"]
    return power.coarsening_ladder(_evaluated(spark, sf), cfg.analysis_labels, ladder, cfg.inferential_sites)


@query
def assign_tiers(spark, sf):
    return rounded(_tiers(_evaluated(spark, sf)), "worst_mde", "median_mde")


@query
def tier_sensitivity(spark, sf):
    return power.tier_sensitivity({b: _tiers(_evaluated(spark, sf, b)) for b in BASELINES})


@query
def study_tiers(spark, sf):
    """The gate with the study's own limits and secondary lane."""
    cfg = pop.study()
    gate = cfg.analysis["power"]
    evaluated = power.evaluate_cells(
        _counts(spark, sf), baseline=gate["assumed_baseline_fnr"], alpha=gate["alpha"],
        target_power=gate["target_power"], meaningful_effect=gate["meaningful_effect"],
    )
    tiers = power.assign_tiers(
        evaluated, cfg.analysis_labels, secondary_lane=cfg.secondary_lane, inferential_sites=cfg.inferential_sites
    )
    return rounded(tiers, "worst_mde", "median_mde")


# ------------------------------------------------------------------- image index


@query
def cohort_fingerprint(spark, sf):
    return fingerprint(pop.cohort(spark, sf), "image_id", ["site"])


@query
def cache_layout(spark, sf):
    return imagecache.cache_layout(pop.cohort(spark, sf), depth=3, shard_size=QUERY_SHARD)


@query
def cache_lookup(spark, sf):
    index = imagecache.cache_layout(pop.cohort(spark, sf), depth=3, shard_size=QUERY_SHARD)
    wanted = pop.images(spark, sf).selectExpr("cast(patient_id as bigint) AS pos", "image_id")
    return imagecache.locate(wanted, index)


@query
def broken_records(spark, sf):
    report = tables.record_report(pop.event_lines(spark, sf), ["event_type"])
    return report.withColumn("examples", F.array_join("examples", " | "))


@query
def record_fields(spark, sf):
    return tables.field_report(pop.event_lines(spark, sf), ["event_type"])


@query
def random_read(spark, sf):
    """Every hundredth page out of a shard-partitioned store of all pages."""
    pages = pop.table(spark, sf, "pages").selectExpr("page_id", "concat('page', page_id) AS image_id", "encode(html, 'UTF-8') AS pixels")
    layout = imagecache.cache_layout(pages, shard_size=QUERY_SHARD)
    store = imagecache.store_images(layout.join(pages.select("image_id", "pixels"), "image_id"), shared_folder(spark, "random-read"))
    asked = pages.where("page_id % 100 = 0").selectExpr("page_id AS pos", "image_id")
    return imagecache.fetch_images(store, asked).select("pos", "image_id", F.md5("pixels").alias("digest"))


@query
def cache_verify(spark, sf):
    index = imagecache.cache_layout(pop.cohort(spark, sf), depth=3, shard_size=QUERY_SHARD)
    names = cohort.manifest_lines(pop.manifest(spark, sf), "value", ["site"])
    held = cohort.hold_manifest(pop.images(spark, sf), names, 3, None, ["site"])
    return imagecache.index_checks(index, held)


@query
def key_collisions(spark, sf):
    images = pop.images(spark, sf)
    return union_all(
        [imagecache.key_collisions(images, "image_id", depth=k).withColumn("depth", F.lit(k)) for k in (1, 2, 3)]
    )


# ----------------------------------------------------------------------- scoring


@query
def train_predict(spark, sf):
    """Every embedding vector scored by the models of the fold it was held out of."""
    vectors = pop.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("patient_id"), F.col("vec_id").cast("string").alias("image_id"),
        array_to_vector("embedding").alias("features"), (F.col("label") % 2).cast("double").alias("odd"),
        (F.col("label") < 3).cast("double").alias("low"),
    )
    cfg = pop.study()
    fold = F.pmod(hex_to_long(F.substring(hash_hex(cfg.seed, "patient_id"), 1, 8)), F.lit(cfg.n_folds)).cast("int")
    scores, _ = scorer.cross_predict(
        vectors.withColumn("fold", fold), scorer.scorer_settings(cfg, ["odd", "low"]), n_folds=cfg.n_folds
    )
    return scores
