"""The analysis plan as a markdown document, from the configuration and the gate's tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame

from cohortgauge.config import StudyConfig
from cohortgauge.sources.tables import markdown_table


class PlanError(ValueError):
    """The tables supplied cannot state a plan."""


def _names(values) -> str:
    return ", ".join(map(str, values)) or "(none)"


def render_analysis_plan(cfg: StudyConfig, tiers: DataFrame, coupling: DataFrame, cohort_summary: DataFrame, *,
                         sensitivity: DataFrame | None = None, frozen_config: str | None = None) -> str:
    """Render the plan. All tables are result tables with a handful of rows."""
    if not {"label", "tier"} <= set(tiers.columns):
        raise PlanError("tiers table must contain ['label', 'tier']")
    lanes: dict[str, list[str]] = {"primary": [], "exploratory": [], "descriptive": []}
    for row in tiers.select("label", "tier").collect():
        lanes[row["tier"]].append(row["label"])
    if not lanes["primary"]:
        raise PlanError("no label reached the primary tier; resolve the gate before freezing the plan")

    a, gate = cfg.analysis, cfg.analysis["power"]
    rule, mix, boot = a["threshold_rule"], a["standardization"], a["bootstrap"]
    family = a["multiple_comparisons"]
    parts = [
        "# Analysis plan",
        f"Study: {cfg.meta['title']}",
        f"Rendered {datetime.now(timezone.utc):%Y-%m-%d %H:%M} UTC from configuration `{cfg.config_hash}`. "
        f"Stage hashes: cohort `{cfg.cohort_hash}`, folds `{cfg.split_hash}`, model `{cfg.model_hash}`, "
        f"analysis `{cfg.analysis_hash}`.",
    ]
    if frozen_config:
        parts.append(f"Frozen configuration: `{frozen_config}`")
    parts += [
        "## Cohorts", markdown_table(cohort_summary, stored_as="cohort_summary"),
        f"Sites with their own model: {_names(cfg.training_sites)}. "
        f"Sites described only: {_names(a.get('descriptive_sites') or [])}.",
        "## Acquisition coupling",
        markdown_table(coupling, ["site", "term", "odds_ratio", "ci_low", "ci_high", "p_value"], stored_as="acquisition_coupling"),
        "## Label tiers",
        markdown_table(tiers, ["label", "tier", "n_powered", "n_gating_cells", "worst_mde", "reason"], stored_as="label_tiers"),
        f"- Primary ({len(lanes['primary'])}), {family['primary_family']} correction: {_names(lanes['primary'])}\n"
        f"- Exploratory ({len(lanes['exploratory'])}), {family['exploratory_family']} correction: "
        f"{_names(lanes['exploratory'])}\n"
        f"- Descriptive ({len(lanes['descriptive'])}), no inference: {_names(lanes['descriptive'])}",
        f"A cell counts as powered when a gap of {gate['meaningful_effect']:.0%} is detected with "
        f"{gate['target_power']:.0%} power at alpha {gate['alpha']} by the normal approximation, with an assumed "
        f"baseline rate of {gate['assumed_baseline_fnr']:.0%}. "
        f"Ladder for the rest: {' -> '.join(gate['coarsening_ladder'])}.",
        "Contrasts: " + "; ".join(f"{k}: {x} against {y}" for k, (x, y) in cfg.contrasts.items()) + ".",
    ]
    if sensitivity is not None:
        stable = sensitivity.where("not stable").isEmpty()
        parts += [
            "### Tiers under other baselines", markdown_table(sensitivity, stored_as="tier_sensitivity"),
            f"Every label keeps its tier across the grid: {stable}.",
        ]
    parts += [
        "## Model and folds",
        f"- Logistic models; the strength is chosen by `{cfg.model['early_stopping']['monitor']}`.\n"
        f"- {cfg.n_folds} folds by patient, seed {cfg.seed}, stratified on {_names(cfg.stratify_by)}.\n"
        f"- {cfg.val_fraction:.0%} of each development set validates, stratified on {_names(cfg.val_stratify_by)}; "
        f"strata under {cfg.min_val_stratum} patients give none, and the total is met exactly.\n"
        "- Every estimate uses pooled out-of-fold predictions: one per patient, from the model that never saw them.",
        "## Endpoints",
        f"- Primary: {a['primary_endpoint']}. Secondary: {_names(a['secondary_endpoints'])}.\n"
        f"- Threshold: {rule['primary']} at {rule['fixed_sensitivity_target']:.0%} on validation data, then frozen; "
        f"{rule['sensitivity_rule']} as a sensitivity analysis.\n"
        f"- Standardised to {mix['reference_mix']}, for {_names(mix['applies_to'])}.\n"
        f"- {boot['replicates']:,} {boot['method']} replicates, {boot['ci']:.0%} intervals.",
        "## Reading the results",
        "Standardisation reweights observed rates and makes no causal claim. Outcomes are named attenuation, masking, "
        "independence or inconclusive; independence needs the whole interval inside "
        f"±{a['outcomes']['independence_margin']}.",
    ]
    policy = cfg.labels.get("uncertain_policy") or {}
    margins = a["outcomes"].get("independence_margin_sensitivity") or []
    planned = [
        f"Cohorts rebuilt with uncertain labels as `{policy['sensitivity']}`, in place of `{policy.get('primary')}`." if policy.get("sensitivity") else None,
        f"Thresholds by `{rule['sensitivity_rule']}`.",
        "Temperatures per view in place of one for all views.",
        f"Outcomes under margins of {_names(f'±{m}' for m in margins)}." if margins else None,
        f"Tiers under baseline rates of {_names(f'{b:.0%}' for b in gate['baseline_sensitivity_grid'])}.",
        "Agreement of outcomes between sites, label by label.",
    ]
    parts += [
        "## Planned sensitivity analyses", "\n".join(f"- {line}" for line in planned if line),
        "## What the freeze covers",
        "The hashes above cover the values of the configuration: cohort rules, folds, model settings, endpoints and limits. "
        "They do not cover the source files, the program or the libraries it runs on; the cohort fingerprint covers "
        "which patients were kept. Tiers come from counts alone, and no score of any model was read before this document. "
        "What is not listed here is exploratory, whatever its result.",
    ]
    return "\n\n".join(parts) + "\n"
