"""The analysis of every site, label and contrast in one set of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgauge.config import StudyConfig
from cohortgauge.operators.bootstrap import bootstrap, bootstrap_gaps, delta_gaps
from cohortgauge.operators.fairness import contrast_cells, outcome_cube, replication, verdict_sensitivity
from cohortgauge.operators.interaction import fit_interactions, fit_notes, fitted_terms, guard_notes
from cohortgauge.operators.multiplicity import benjamini_hochberg, holm
from cohortgauge.operators.ordering import union_all
from cohortgauge.session import materialise


@dataclass
class Analysis:
    """Result tables with site, label and contrast as columns."""

    gaps: DataFrame
    standardised: DataFrame
    interactions: DataFrame
    notes: DataFrame
    cube: DataFrame

    def sensitivity(self, margins: list[float]) -> DataFrame:
        return verdict_sensitivity(self.standardised, margins)

    def replication(self) -> DataFrame:
        return replication(self.standardised)


def analyse(decisions: DataFrame, cfg: StudyConfig, *, replicates: int | None = None) -> Analysis:
    """Gaps, standardised gaps and interaction models from one scan of the decisions.

    The scan's result, the outcome cube, is stored: every table below reads those few
    rows. A model a guard rejects becomes a note and costs nothing else; so does a fit that fails.
    """
    contrasts = cfg.contrasts
    settings = cfg.analysis
    draws_wanted = replicates or int(settings["bootstrap"]["replicates"])
    cube = materialise(outcome_cube(decisions, list(contrasts)))
    cells = contrast_cells(cube, contrasts)
    draws = materialise(
        bootstrap(
            cells, reference=cfg.reference_mix, replicates=draws_wanted, ci=float(settings["bootstrap"]["ci"]),
            seed=cfg.seed,
        )
    )
    positivity = settings.get("positivity") or {}
    standardised = delta_gaps(
        cells, draws, reference=cfg.reference_mix, replicates=draws_wanted,
        margin=float((settings.get("outcomes") or {}).get("independence_margin", 0.02)),
        min_positives=int(positivity.get("min_positives_per_cell", 10)),
        max_distance=float(positivity.get("max_reweight_distance", 0.30)),
    )
    min_events = int((settings.get("interaction") or {}).get("min_events_per_cell", 10))
    fits = materialise(union_all([fit_interactions(cube, s, [c for c in contrasts if c != s], min_events) for s in contrasts]))
    refused = union_all([guard_notes(cube, s, min_events) for s in contrasts]).where("note is not null")
    notes = union_all(
        [
            refused.withColumn("note", F.concat(F.lit("interaction model not fitted: "), "note")),
            fit_notes(fits).withColumn("note", F.concat(F.lit("interaction model not reported: "), "note")),
            standardised.where(~F.col("positivity_ok")).select(
                "site", "label", "stratum", F.concat(F.lit("positivity: "), "positivity_note").alias("note")
            ),
        ]
    )
    return Analysis(bootstrap_gaps(cells, draws), standardised, fitted_terms(fits), notes, cube)


def corrected_interactions(models: DataFrame, tiers: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Holm within each site over primary labels, Benjamini-Hochberg over exploratory ones."""
    terms = models.where("is_interaction").join(tiers.select("label", "tier"), "label")
    ties = ["site", "label", "stratum", "term"]
    primary = holm(terms.where("tier = 'primary'"), ["site"], ties=ties, alpha=alpha)
    exploratory = benjamini_hochberg(terms.where("tier = 'exploratory'"), ["tier"], ties=ties, alpha=alpha)
    return primary.unionByName(exploratory)
