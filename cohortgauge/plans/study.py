"""The stages of a study in order, each writing the artifacts the next one reads."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgauge.config import StudyConfig, freeze_config
from cohortgauge.operators import calibration, cells, cohort, contracts, metrics, power, regression, scorer, splits, transport
from cohortgauge.operators.ordering import union_all
from cohortgauge.plans.analysis import Analysis, analyse, corrected_interactions
from cohortgauge.plans.report import render_analysis_plan
from cohortgauge.session import materialise
from cohortgauge.sources.catalogue import Catalogue
from cohortgauge.sources.sites import load_site_metadata
from cohortgauge.sources.tables import read_manifest


@dataclass
class Scores:
    """Stored score tables with the cohort's columns and truths beside each score."""

    validation: DataFrame
    test: DataFrame
    elsewhere: DataFrame
    searches: DataFrame


class Study:
    """Paths and stage functions of one configuration.

    ``root`` is a folder or URI every executor can reach. Artifacts are published in a
    :class:`Catalogue` under the hash of the configuration they depend on. A stage that finished
    under the same hash is read, not run: ``build_cohorts``, ``power_gate`` and ``assign_folds``
    always, ``train`` and ``decide`` where the caller names their data with ``inputs``.
    ``reuse=False`` runs everything again and publishes new versions.
    """

    def __init__(self, spark: SparkSession, cfg: StudyConfig, root: str | None = None, reuse: bool = True):
        self.spark, self.cfg, self.reuse = spark, cfg, reuse
        self.root = (root or cfg.paths["drive_root"]).rstrip("/")
        self.catalogue = Catalogue(spark, self.root)

    def place(self, section: str, artifact: str, kind: str = "parquet", scope: str | None = None, **facets) -> str:
        stamp = self.cfg.stage_hash(scope) if scope else self.cfg.hash_for(artifact)
        return self.catalogue.place(self.cfg.paths[section], artifact, stamp, kind, **facets)

    def put(self, df: DataFrame, section: str, artifact: str, kind: str = "parquet", partition_by: list[str] | None = None, **where) -> DataFrame:
        return self.catalogue.put(df, self.place(section, artifact, kind, **where), partition_by)

    def get(self, section: str, artifact: str, kind: str = "parquet", **where) -> DataFrame:
        return self.catalogue.read(self.place(section, artifact, kind, **where))

    def _done(self, stage: str, scope: str, *facets: str) -> bool:
        return self.reuse and self.catalogue.finished("-".join([stage, *facets]), self.cfg.stage_hash(scope))

    def _finish(self, stage: str, scope: str, *facets: str) -> None:
        self.catalogue.finish("-".join([stage, *facets]), self.cfg.stage_hash(scope))

    # ---- 1. cohorts
    def manifest(self, site: str) -> DataFrame:
        return read_manifest(self.spark, f"{self.root}/{self.cfg.paths['manifests']}/{site}_manifest.txt")

    def metadata(self, site: str) -> str:
        return f"{self.root}/{self.cfg.paths['metadata']}/{site}"

    def verify_manifests(self) -> DataFrame:
        """Reconcile every site's held names with its metadata; raises on a failed check."""
        frames = []
        for site in self.cfg.site_names:
            spec = self.cfg.sites[site]
            table = cohort.verify_manifest(
                load_site_metadata(site, self.cfg, self.metadata(site), self.spark), self.manifest(site),
                int(spec.get("image_key_depth", 1)), spec.get("image_key_pattern"), None,
                float(self.cfg.cohort.get("min_manifest_match_rate", 0.95)),
            )
            frames.append(table.withColumn("site", F.lit(site)))
        report = materialise(union_all(frames))
        failed = report.where("not ok").collect()
        if failed:
            raise cohort.CohortBuildError(f"manifest checks failed: {[(r['site'], r['check'], r['note']) for r in failed]}")
        return report

    def build_cohorts(self, check: bool = True, uncertain_policy: str | None = None) -> dict[str, contracts.ContractReport]:
        """Build, store and validate every configured site.

        A policy for uncertain labels other than the configured one belongs to a sensitivity
        run: give that run a root of its own.
        """
        cfg, reports = self.cfg, {}
        for site in cfg.site_names:
            # The configured policy alone is covered by the hash.
            if uncertain_policy is None and self._done("cohort", "cohort", site):
                reports[site] = self._stored_report(site, check)
                continue
            built = cohort.build_cohort(
                site, cfg, self.metadata(site), self.spark, image_manifest=self.manifest(site), uncertain_policy=uncertain_policy
            )
            people = self.put(built.cohort, "cohorts", "cohort", site=site)
            self.put(built.audit, "cohorts", "audit", site=site)
            self.put(built.flow, "cohorts", "flow", "csv", site=site)
            report = contracts.validate_primary_cohort(
                people, cfg.analysis_labels,
                observed=cfg.observed_labels(site), artifact=f"cohort_{site}", expected_site=site,
                expected_hash=cfg.cohort_hash, min_positives=cfg.min_positives_warning, strata=cfg.strata, strict=False,
            )
            text = json.dumps({"n_rows": report.n_rows, "violations": report.violations})
            self.catalogue.put_text(text, self.place("cohorts", "contract", "json", scope="cohort", site=site))
            if uncertain_policy is None:
                self._finish("cohort", "cohort", site)
            reports[site] = report.raise_if_failed() if check else report
        return reports

    def _stored_report(self, site: str, check: bool) -> contracts.ContractReport:
        kept = json.loads(self.catalogue.get_text(self.place("cohorts", "contract", "json", scope="cohort", site=site)))
        report = contracts.ContractReport(f"cohort_{site}", kept["n_rows"], kept["violations"])
        return report.raise_if_failed() if check else report

    def cohorts(self) -> DataFrame:
        """All stored cohorts; labels one site lacks are missing there."""
        frames = [self.get("cohorts", "cohort", site=s) for s in self.cfg.site_names]
        return union_all(frames).withColumn("age_group", cohort.age_group_column(self.cfg.primary_age_threshold))

    # ---- 2. power gate
    def power_gate(self, frozen_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Evaluated cells and label tiers, stored with coupling, tier sensitivity, cohort summary and the plan.

        A study without a primary label has no plan to freeze; the tables say why.
        """
        cfg, gate = self.cfg, self.cfg.analysis["power"]
        if self._done("power", "analysis"):
            return self.get("analysis", "cell_power"), self.get("analysis", "label_tiers")
        people = self.cohorts()
        counts = materialise(cells.contrast_counts(people, cfg.analysis_labels, cfg.contrasts))

        def evaluate(baseline: float) -> DataFrame:
            return power.evaluate_cells(
                counts, baseline=baseline, alpha=gate["alpha"], target_power=gate["target_power"],
                meaningful_effect=gate["meaningful_effect"],
            )

        def tiers_of(table: DataFrame) -> DataFrame:
            return power.assign_tiers(
                table, cfg.analysis_labels, secondary_lane=cfg.secondary_lane, inferential_sites=cfg.inferential_sites
            )

        table = evaluate(gate["assumed_baseline_fnr"])
        power.require_gating_cells(table, cfg.inferential_sites)
        table = self.put(table, "analysis", "cell_power")
        tiers = self.put(tiers_of(table), "analysis", "label_tiers")
        sensitivity = power.tier_sensitivity({b: tiers_of(evaluate(b)) for b in gate["baseline_sensitivity_grid"]})
        ladder = power.coarsening_ladder(table, cfg.analysis_labels, gate["coarsening_ladder"], cfg.inferential_sites)
        self.put(ladder, "analysis", "coarsening_ladder", "csv")
        self.put(table, "analysis", "cell_power", "csv")
        self.put(tiers, "analysis", "label_tiers", "csv")
        self.put(sensitivity, "analysis", "tier_sensitivity", "csv")
        coupling = materialise(regression.acquisition_coupling(people))
        self.put(coupling, "analysis", "acquisition_coupling", "csv")
        summary = materialise(cells.cohort_summary(people))
        self.put(summary, "analysis", "cohort_summary", "csv")
        frozen = freeze_config(cfg, frozen_dir).name if (cfg.path and frozen_dir) else None
        text = render_analysis_plan(
            cfg, tiers, coupling, summary, sensitivity=sensitivity, frozen_config=frozen
        ) if not tiers.where("tier = 'primary'").isEmpty() else None
        if text:
            self.catalogue.put_text(text, self.place("analysis", "analysis_plan", "md"))
        self._finish("power", "analysis")
        return table, tiers

    # ---- 3. folds
    def assign_folds(self) -> DataFrame:
        cfg = self.cfg
        people = self.cohorts()
        if self._done("folds", "split"):
            return people.join(self.get("splits", "folds"), ["site", "patient_id"], "left")
        splits.check_fold_request(people, cfg.stratify_by, cfg.n_folds)
        folded = splits.assign_folds(
            people, training_sites=cfg.training_sites, stratify_by=cfg.stratify_by, n_folds=cfg.n_folds, seed=cfg.seed
        )
        kept = self.put(folded.select("patient_id", "site", "fold"), "splits", "folds")
        stored = people.join(kept, ["site", "patient_id"], "left")
        if not stored.where("fold IS NULL").isEmpty():
            raise splits.SplitError("some patients have no fold")
        splits.require_one_fold(stored)
        splits.check_allocation(
            splits.validation_plan(
                stored, stratify_by=cfg.val_stratify_by, n_folds=cfg.n_folds, val_fraction=cfg.val_fraction,
                min_stratum=cfg.min_val_stratum,
            )
        )
        trained = stored.where(F.col("site").isin(cfg.training_sites))
        balance = cells.fold_balance(trained, cfg.analysis_labels, cfg.age_bin_labels, cfg.stratify_by)
        self.put(balance, "splits", "fold_balance", "csv", scope="split")
        self.put(cells.cell_balance(trained, cfg.analysis_labels, cfg.n_folds, cfg.strata), "splits", "cell_balance", "csv", scope="split")
        self._store_roles(trained)
        self._finish("folds", "split")
        return stored

    def _store_roles(self, trained: DataFrame) -> None:
        """Roles of every patient under every outer fold; no patient holds two under one."""
        cfg = self.cfg
        roles = splits.fold_roles(
            trained, val_stratify_by=cfg.val_stratify_by, n_folds=cfg.n_folds, val_fraction=cfg.val_fraction,
            min_stratum=cfg.min_val_stratum, seed=cfg.seed,
        )
        kept = self.put(roles, "splits", "roles", scope="split")
        splits.require_disjoint(kept)
        sizes = kept.groupBy("site", "outer_fold", "role").agg(F.count(F.lit(1)).alias("patients"))
        self.put(sizes, "splits", "role_sizes", "csv", scope="split")

    def roles(self) -> DataFrame:
        return self.get("splits", "roles", scope="split")

    # ---- 3b. training, one model per training site, fold and label
    def train(self, features: DataFrame, column: str = "features", inputs: str | None = None) -> Scores:
        """Train, choose, predict and pool; every table is stored.

        ``features`` holds ``patient_id, image_id`` and a vector for every image of the cohorts. The
        models of all sites and folds are fitted together. Rows of other sites are scored in the
        same pass (``elsewhere``, with ``source_site``), and the pooled test scores are checked
        to be out-of-fold before the stage counts as finished. ``inputs`` names the vectors (a
        release, a digest): scores of the same name and configuration are read again.
        """
        cfg, sites, folds = self.cfg, self.cfg.training_sites, self.cfg.n_folds
        if inputs and self._done("train", "model", inputs):
            return self._scores(inputs)
        people = self.cohorts()
        code = F.when(F.col("role") == "train", scorer.TRAIN).when(F.col("role") == "val", scorer.CHOOSE).otherwise(scorer.SCORE)
        listed = self.roles().groupBy("site", "patient_id").agg(F.map_from_entries(F.collect_list(F.struct("outer_fold", code))).alias("_role"))
        own = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: F.try_element_at("_role", k))
        # One set per training site and fold; to the sets of other sites a row is a stranger.
        roles = F.flatten(F.array(*[
            F.when(F.col("site") == s, own).otherwise(F.array_repeat(F.lit(scorer.FOREIGN), folds)) for s in sites
        ]))
        vectors = features.select("patient_id", "image_id", F.col(f"`{column}`").alias("_features"))
        frame = people.join(listed, ["site", "patient_id"], "left").join(vectors, ["patient_id", "image_id"], "left")
        scored, searches = scorer.score_sets(
            frame, roles, scorer.scorer_settings(cfg), n_sets=len(sites) * folds, features="_features",
            carry=("site", "patient_id", "image_id", "view", "sex", "age", "age_group"),
        )
        named = scored.withColumns({
            "source_site": F.element_at(F.array(*[F.lit(s) for s in sites]), (F.floor(F.col("fold") / folds) + 1).cast("int")),
            "fold": (F.col("fold") % folds).cast("int"),
        })
        stored = self.put(named, "scores", "scores", partition_by=["role"], inputs=inputs)
        assigned = self.get("splits", "folds").where(F.col("site").isin(sites))
        first = stored.where((F.col("role") == scorer.SCORE) & (F.col("label") == cfg.analysis_labels[0])).drop("role")
        splits.assemble_out_of_fold(first, assigned, n_folds=folds)
        rounds = [
            (sites[s.fold // folds], s.fold % folds, r["strength"], r["loss"], r["macro_auroc"], k == s.kept, ", ".join(r["not_converged"]))
            for s in searches for k, r in enumerate(s.rounds)
        ]
        schema = "site string, fold int, strength double, loss double, macro_auroc double, kept boolean, not_converged string"
        table = self.put(self.spark.createDataFrame(rounds, schema), "scores", "searches", scope="model", inputs=inputs)
        self.put(table, "scores", "searches", "csv", scope="model", inputs=inputs)
        if inputs:
            self._finish("train", "model", inputs)
        return self._scores(inputs)

    def _scores(self, inputs: str | None) -> Scores:
        stored = self.get("scores", "scores", inputs=inputs)
        part = lambda role: stored.where(F.col("role") == role).drop("role")
        searches = self.get("scores", "searches", scope="model", inputs=inputs)
        return Scores(part(scorer.CHOOSE).drop("source_site"), part(scorer.SCORE).drop("source_site"), part(scorer.FOREIGN), searches)

    # ---- 4. decisions from stored scores
    def decide(self, validation: DataFrame, test: DataFrame, arm: str = "global", inputs: str | None = None) -> DataFrame:
        """Calibrate on validation scores, apply to test scores, store both results.

        ``inputs`` names the scores, as in ``train``: decisions of the same name are read again.
        """
        if inputs and self._done("decide", "analysis", arm, inputs):
            return self.get("scores", "decisions", scope="analysis", arm=arm, inputs=inputs)
        rule, limits = self.cfg.analysis["threshold_rule"], self.cfg.analysis["calibration"]
        temperatures, thresholds = calibration.calibrate(
            validation, arm=arm, target=float(rule["fixed_sensitivity_target"]), rule=rule["primary"],
            min_positives=int(limits["min_positives_per_view"]), min_negatives=int(limits["min_negatives_per_view"]),
        )
        views = sorted(self.cfg.cohort["allowed_views"])
        params = calibration.fold_parameters(temperatures, thresholds, views, arm)
        self.put(params, "calibration", "calibration", "csv", scope="analysis", arm=arm)
        self.put(calibration.parameter_means(params), "calibration", "calibration_means", "csv", scope="analysis", arm=arm)
        made = calibration.decide(test, temperatures, thresholds, arm)
        made = self.put(made, "scores", "decisions", partition_by=["site"], scope="analysis", arm=arm, inputs=inputs)
        self.put(temperatures, "calibration", "temperatures", scope="analysis", arm=arm)
        self.put(thresholds, "calibration", "thresholds", scope="analysis", arm=arm)
        if inputs:
            self._finish("decide", "analysis", arm, inputs)
        return made

    def performance(self, decisions: DataFrame, arm: str = "global") -> dict[str, DataFrame]:
        """Ordering and calibration of stored decisions: areas, report and reliability tables."""
        keys = ["site", "label"]
        areas = materialise(metrics.auroc(decisions, keys))
        made = {
            "auroc": areas,
            "auroc_macro": metrics.macro_auroc(areas, ["site"]),
            "calibration_report": calibration.calibration_report(decisions, keys, sorted(self.cfg.cohort["allowed_views"])),
            "reliability_raw": metrics.reliability_table(decisions, keys),
            "reliability_calibrated": metrics.reliability_table(decisions, keys, score="calibrated"),
        }
        for name, table in made.items():
            made[name] = materialise(table)
            self.put(made[name], "analysis", name, "csv", arm=arm)
        return made

    def transport(self, elsewhere: DataFrame, arm: str = "global") -> DataFrame:
        """Rates of every source site's frozen models and thresholds at the other sites."""
        temperatures, thresholds = [self.get("calibration", name, scope="analysis", arm=arm) for name in ("temperatures", "thresholds")]
        rates = materialise(transport.transport_rates(transport.decide_elsewhere(elsewhere, temperatures, thresholds, arm)))
        self.put(rates, "analysis", "transport", "csv", arm=arm)
        return rates

    # ---- 5. analysis
    def analyse(self, decisions: DataFrame, tiers: DataFrame, replicates: int | None = None) -> Analysis:
        result = analyse(decisions, self.cfg, replicates=replicates)
        alpha = 1 - float(self.cfg.analysis["bootstrap"]["ci"])
        self.put(result.gaps, "analysis", "gaps", "csv")
        self.put(result.standardised, "analysis", "standardised", "csv")
        self.put(result.interactions, "analysis", "interactions", "csv")
        self.put(corrected_interactions(result.interactions, tiers, alpha), "analysis", "corrected", "csv")
        self.put(result.notes, "analysis", "notes", "csv")
        outcomes = self.cfg.analysis["outcomes"]
        margins = outcomes.get("independence_margin_sensitivity") or [outcomes["independence_margin"]]
        self.put(result.sensitivity([float(m) for m in margins]), "analysis", "verdict_sensitivity", "csv")
        self.put(result.replication(), "analysis", "replication", "csv")
        return result
