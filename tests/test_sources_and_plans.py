import hashlib
import io
import sys
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortgauge.config import from_mapping
from cohortgauge.operators import cells, scorer
from cohortgauge.operators.fingerprint import fingerprint
from cohortgauge.operators.ordering import hash_select
from cohortgauge.operators.scorer import ScorerSettings, TrainError
from cohortgauge.operators.splits import SplitError, require_disjoint
from cohortgauge.operators.transport import transport_rates
from cohortgauge.plans import population
from cohortgauge.plans.report import PlanError, render_analysis_plan
from cohortgauge.plans.study import Study
from cohortgauge.sources import imagecache as ic
from cohortgauge.sources.imagecache import CacheError
from cohortgauge.sources.tables import SourceError, field_report, markdown_table, read_label_jsonl, record_report, scan_union
from site_files import write_anchored, write_paths, write_tokens

SIZE = 8
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def raw_decode(data):
    return np.load(io.BytesIO(data))


def archive(path, names, shape=(SIZE, SIZE)):
    with zipfile.ZipFile(path, "w") as z:
        for i, name in enumerate(names):
            buffer = io.BytesIO()
            np.save(buffer, np.full(shape, i % 251, dtype=np.uint8))
            z.writestr(name, buffer.getvalue())


def wanted(spark, names):
    return spark.createDataFrame([(n,) for n in names], "image_id string")


def build(spark, tmp_path, ids, **options):
    settings = {"image_size": SIZE, "shard_size": 3, "decode": raw_decode, **options}
    return ic.build_cache(spark, str(tmp_path / "a.zip"), wanted(spark, ids), str(tmp_path / "cache"), **settings)


def test_cache_round_trip(spark, tmp_path):
    archive(tmp_path / "a.zip", [f"held/I{i}.png" for i in range(9)])
    ids = [f"i{i}" for i in (7, 2, 5, 0, 1, 3, 4)]
    cache = build(spark, tmp_path, ids, site="S", config_hash="abc")
    assert cache.manifest["n_images"] == 7 and cache.manifest["n_shards"] == 3
    layout = [(r["image_id"], r["shard"], r["row"]) for r in cache.index.orderBy("shard", "row").collect()]
    assert layout == [(n, k // 3, k % 3) for k, n in enumerate(sorted(ids))]
    requests = spark.createDataFrame([(0, "i7"), (1, "i0"), (2, "i7")], "pos long, image_id string")
    got = [r["pixels"] for r in ic.read_images(cache, requests).collect()]
    assert [g[0] for g in got] == [7, 0, 7] and len(got[0]) == SIZE * SIZE
    with pytest.raises(CacheError, match="not in the cache"):
        ic.read_images(cache, spark.createDataFrame([(0, "i8")], "pos long, image_id string"))
    table = ic.verify_cache(cache, cohort=wanted(spark, ids))
    assert table.where("not ok").isEmpty() and table.count() == 8
    less = {r["check"] for r in ic.verify_cache(cache, cohort=wanted(spark, ids[:-1])).where("not ok").collect()}
    assert less == {"cohort_fingerprint", "no_extra_images"}
    damaged = ic.ImageCache(cache.directory, cache.manifest, cache.images.withColumn("checksum", F.lit("0")))
    assert "pixels_match_checksums" in {r["check"] for r in ic.verify_cache(damaged).where("not ok").collect()}
    ic.load_cache(spark, cache.directory, cohort=wanted(spark, ids), config_hash="abc")
    with pytest.raises(CacheError, match="configuration .* is needed"):
        ic.load_cache(spark, cache.directory, config_hash="zzz")
    with pytest.raises(CacheError, match="cohort .* is needed"):
        ic.load_cache(spark, cache.directory, cohort=wanted(spark, ids[:2]))


def test_cache_refusals_leave_nothing_behind(spark, tmp_path):
    with pytest.raises(CacheError, match="nothing at"):
        build(spark, tmp_path, ["x"])
    archive(tmp_path / "a.zip", ["p/x.png", "q/x.png", "p/y.png"])
    for ids, message in (
        ([], "empty list"), (["y", "y"], "asked for twice"), (["a/y.png", "b/y.png"], "no key of their own"),
        (["z"], "the archive lacks"), (["x"], "several entries"),
    ):
        with pytest.raises(CacheError, match=message):
            build(spark, tmp_path, ids)
    with pytest.raises(Exception, match="nothing is resized"):
        build(spark, tmp_path, ["y"], image_size=4)
    assert {p.name for p in tmp_path.iterdir()} == {"a.zip"}
    with pytest.raises(CacheError, match="complete cache"):
        ic.load_cache(spark, str(tmp_path / "cache"))


def test_fingerprint_ignores_order_and_sees_every_change(spark):
    def mark(names):
        return fingerprint(wanted(spark, names), "image_id").first()["fingerprint"]

    assert mark(["a", "b", "c"]) == mark(["c", "a", "b"])
    assert len({mark(["a", "b"]), mark(["a", "c"]), mark(["a"]), mark(["a", "b", "b"]), mark(["ab"])}) == 5


def test_key_collisions_show_a_shallow_key(spark):
    names = wanted(spark, ["p1/s1/v.jpg", "p2/s1/v.jpg"])
    assert ic.key_collisions(names, "image_id", depth=1).first()["n_names"] == 2
    assert ic.key_collisions(names, "image_id", depth=3).isEmpty()


def test_union_fills_absent_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert sorted((r["x"], r["y"]) for r in scan_union(a, b).collect()) == [(1, 2), (3, None)]


def test_broken_label_lines_are_counted_and_shown(spark, tmp_path):
    file = tmp_path / "labels.json"
    file.write_text('{"path_to_image": "a", "Edema": 1}\n\n{"path_to_image": "b", "Edema": nul}\n[1]\nx\n{"path_to_image": "c"\n')
    with pytest.raises(SourceError, match="4 of 6 lines of labels.json hold no record, such as"):
        read_label_jsonl(spark, file, ["Edema"], site="s")
    file.write_text('{"path_to_image": "a", "Edema": 1}\n\n{"path_to_image": "b"}\n')
    got = read_label_jsonl(spark, file, ["Edema"], site="s")
    assert {(r["path_to_image"], r["Edema"]) for r in got.where("path_to_image IS NOT NULL").collect()} == {("a", 1.0), ("b", None)}
    with pytest.raises(SourceError, match="no values for the labels .'Fracture'."):
        read_label_jsonl(spark, file, ["Edema", "Fracture"], site="s")
    with pytest.raises(SourceError, match="has no 'other' key"):
        read_label_jsonl(spark, file, ["Edema"], key="other", site="s")
    lines = spark.read.text(str(file))
    assert {(r["field"], r["n_lines"]) for r in field_report(lines, []).collect()} == {("path_to_image", 2), ("Edema", 1)}
    empty = record_report(lines.limit(0), []).first()
    assert (empty["n_lines"], empty["n_broken"], empty["examples"]) == (0, 0, [])


def stored_images(spark, tmp_path, n=300):
    rows = [(f"i{k}", k // 50, k % 50, bytes([k % 256]) * 20) for k in range(n)]
    df = spark.createDataFrame(rows, "image_id string, shard int, row int, pixels binary")
    return ic.store_images(df, str(tmp_path / "images"))


def test_random_read_opens_the_named_shards_and_moves_no_pixels(spark, tmp_path):
    images = stored_images(spark, tmp_path)
    asked = spark.createDataFrame([(0, "i260"), (1, "i3"), (2, "i260"), (3, "i4")], "pos long, image_id string")
    got = ic.fetch_images(images, asked)
    assert {r["pos"]: (r["image_id"], bytes(r["pixels"])[0]) for r in got.collect()} == {0: ("i260", 4), 1: ("i3", 3), 2: ("i260", 4), 3: ("i4", 4)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    files = {r["f"] for r in got.select("pos").withColumn("f", F.input_file_name()).collect()}
    assert len(files) <= 2
    assert ic.fetch_images(images, asked.limit(0)).count() == 0
    with pytest.raises(CacheError, match="1, 'i999' for one"):
        ic.fetch_images(images, spark.createDataFrame([(0, "i999"), (1, "i1")], "pos long, image_id string"))


def test_random_read_beyond_the_broadcast_bound_is_the_same(spark, tmp_path, monkeypatch):
    images = stored_images(spark, tmp_path)
    asked = spark.createDataFrame([(k, f"i{7 * k % 300}") for k in range(80)], "pos long, image_id string")
    near = sorted((r["pos"], bytes(r["pixels"])) for r in ic.fetch_images(images, asked).collect())
    monkeypatch.setattr(ic, "REQUESTS", 10)
    assert near == sorted((r["pos"], bytes(r["pixels"])) for r in ic.fetch_images(images, asked).collect())


# ---- scorer


def vectors(spark, n=600):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    rows = [(f"p{i}", f"i{i}", [float(v) for v in x[i]], float(y[i]), None if i % 7 else 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "patient_id string, image_id string, v array<double>, Hit double, Sparse double")
    return df.withColumn("features", array_to_vector("v"))


def test_training_tries_every_configured_strength_and_keeps_the_best(spark):
    df = vectors(spark)
    settings = ScorerSettings(labels=("Hit",), strengths=(1e-5, 1e-3, 1e-1, 1e4, 1e5))
    models, search = scorer.train_fold(df.limit(400), df.subtract(df.limit(400)), settings)
    assert [r["strength"] for r in search.rounds] == list(settings.strengths)
    assert search.best > 0.8 and search.best == max(r["macro_auroc"] for r in search.rounds)
    assert all(r["not_converged"] == [] for r in search.rounds)
    scored = scorer.predict(models, df)
    assert scored.count() == 600 and scored.where("score < 0 OR score > 1").isEmpty()
    weight = float(np.clip(1 / df.limit(400).agg(F.avg("Hit")).first()[0] - 1, 1, 20))
    rows = df.limit(400).withColumn("w", F.when(F.col("Hit") == 1, weight).otherwise(1.0))
    library = LogisticRegression(labelCol="Hit", weightCol="w", regParam=settings.strengths[search.kept], maxIter=500, tol=1e-13)
    own = library.fit(rows).transform(df).select("patient_id", vector_to_array("probability")[1].alias("p"))
    assert scored.join(own, "patient_id").where("abs(score - p) > 1e-6").isEmpty()


def test_patience_and_iteration_bound_are_seen(spark):
    df = vectors(spark)
    settings = ScorerSettings(labels=("Hit",), strengths=(1e-5, 1e6, 1e7, 1e8), patience=1, max_iterations=1)
    _, search = scorer.train_fold(df.limit(400), df.subtract(df.limit(400)), settings)
    assert len(search.rounds) < 4 and search.rounds[0]["not_converged"] == ["Hit"]


def test_cross_prediction_never_scores_training_rows(spark):
    df = vectors(spark, 300).withColumn("fold", F.expr("cast(substr(patient_id, 2) AS int) % 3"))
    scores, searches = scorer.cross_predict(df, ScorerSettings(labels=("Hit",), strengths=(1e-3,)), n_folds=3)
    assert scores.count() == 300 and len(searches) == 3
    assert scores.join(df.select("patient_id", F.col("fold").alias("own")), "patient_id").where("fold <> own").isEmpty()


def test_all_folds_labels_and_strengths_equal_separate_fits(spark):
    """Correlated, shifted and constant features, missing truths, a one-sided label; against one MLlib fit each."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    x[:, 1], x[:, 2], x[:, 3] = 1000 + x[:, 0] * 0.9 + x[:, 1] * 0.1, x[:, 2] * 50, 7.0
    hit = (rng.uniform(size=400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    rare = (rng.uniform(size=400) < 1 / (1 + np.exp(4 - x[:, 2] / 50))).astype(float)
    rows = [
        (f"p{i}", f"i{i}", [float(v) for v in x[i]], float(hit[i]), None if i % 5 == 0 else float(rare[i]), 1.0, i % 4 if i % 10 else -1)
        for i in range(400)
    ]
    df = spark.createDataFrame(
        rows, "patient_id string, image_id string, v array<double>, Hit double, Rare double, Always double, fold int"
    ).withColumn("features", array_to_vector("v"))
    settings = ScorerSettings(labels=("Hit", "Rare", "Always"), strengths=(1e-3, 1e-1))
    scores, searches = scorer.cross_predict(df, settings, n_folds=4)
    assert scores.count() == 3 * df.where("fold >= 0").count() and all(not r["not_converged"] for s in searches for r in s.rounds)
    assert scores.where("label = 'Always' AND score <> 1").isEmpty()
    for held in (0, 3):
        kept = settings.strengths[searches[held].kept]
        train = df.where(~F.col("fold").isin(held, (held + 1) % 4, -1))
        for label in ("Hit", "Rare"):
            seen = train.where(f"{label} IS NOT NULL")
            share = seen.agg(F.avg(label)).first()[0]
            weighted = seen.withColumn("w", F.when(F.col(label) == 1, float(np.clip(1 / share - 1, 1, 20))).otherwise(1.0))
            fit = LogisticRegression(labelCol=label, weightCol="w", regParam=kept, maxIter=1000, tol=1e-14).fit(weighted)
            own = fit.transform(df.where(F.col("fold") == held)).select("patient_id", vector_to_array("probability")[1].alias("p"))
            both = scores.where(F.col("label") == label).join(own, "patient_id")
            assert both.count() > 50 and both.agg(F.max(F.abs(F.col("score") - F.col("p")))).first()[0] < 1e-6


def test_training_takes_one_scan_an_iteration(spark, monkeypatch):
    scans = []
    whole = scorer._objective
    monkeypatch.setattr(scorer, "_objective", lambda *a: scans.append(len(a[3])) or whole(*a))
    df = vectors(spark, 300).withColumn("fold", F.expr("cast(substr(patient_id, 2) AS int) % 3"))
    settings = ScorerSettings(labels=("Hit",), strengths=(1e-5, 1e-3, 1e-1))
    scorer.cross_predict(df, settings, n_folds=3)
    assert scans[0] == 9 and len(scans) < 25


def test_training_refuses_rows_it_cannot_use(spark):
    df = vectors(spark, 60).withColumn("fold", F.expr("cast(substr(patient_id, 2) AS int) % 3"))
    settings = ScorerSettings(labels=("Hit",))
    with pytest.raises(TrainError, match="no feature vector"):
        scorer.cross_predict(df.withColumn("features", F.when(F.col("fold") > 0, F.col("features"))), settings, n_folds=3)
    mixed = F.when(F.col("fold") > 0, F.col("v")).otherwise(F.array(F.lit(1.0)))
    with pytest.raises(TrainError, match="differ in length"):
        scorer.cross_predict(df.withColumn("features", array_to_vector(mixed)), settings, n_folds=3)
    with pytest.raises(TrainError, match="no training row has a truth"):
        scorer.cross_predict(df.withColumn("Hit", F.lit(None).cast("double")), settings, n_folds=3)


def test_training_refuses_overlap_and_idle_settings(spark, cfg):
    df = vectors(spark, 60)
    with pytest.raises(TrainError, match="share 5 patient"):
        scorer.train_fold(df, df.limit(5), ScorerSettings(labels=("Hit",)))
    with pytest.raises(TrainError, match="a label to learn"):
        ScorerSettings(labels=())
    made = scorer.scorer_settings(cfg)
    assert made.patience == 5 and list(made.labels) == cfg.analysis_labels and len(made.strengths) == 3
    cfg.model["lr"] = 0.1
    with pytest.raises(TrainError, match="without effect"):
        scorer.scorer_settings(cfg)


# ---- plan document and study stages


def plan_tables(spark, tier="primary"):
    tiers = spark.createDataFrame([("Edema", tier, 0.05)], "label string, tier string, worst_mde double")
    coupling = spark.createDataFrame([("s", "age_decade", 1.25)], "site string, term string, odds_ratio double")
    summary = spark.createDataFrame([("s", 10)], "site string, patients long")
    return tiers, coupling, summary


def test_plan_states_the_configuration(spark, cfg):
    sens = spark.createDataFrame([("Edema", "primary", True)], "label string, `FNR=10%` string, stable boolean")
    text = render_analysis_plan(cfg, *plan_tables(spark), sensitivity=sens, frozen_config="f.yaml")
    for part in (cfg.config_hash, cfg.split_hash, "Edema", "age_decade", "f.yaml", "normal approximation", "holm", "FNR=10%", "u_zeros", "youden", "±0.05", "do not cover"):
        assert part in text
    with pytest.raises(PlanError, match="no label reached"):
        render_analysis_plan(cfg, *plan_tables(spark, "descriptive"))
    with pytest.raises(PlanError, match="must contain"):
        render_analysis_plan(cfg, plan_tables(spark)[2], *plan_tables(spark)[1:])
    assert markdown_table(plan_tables(spark)[2].limit(0)) == "_(none)_"


def test_study_builds_and_stores_every_site(spark, site_config, tmp_path):
    write_tokens(tmp_path / "metadata" / "nih")
    write_paths(tmp_path / "metadata" / "chexpert")
    write_anchored(tmp_path / "metadata" / "mimic-cxr")
    (tmp_path / "manifests").mkdir()
    held = {"nih": ["1.png", "2.png"], "chexpert": ["patient1_study1_view1_frontal.png", "patient2_study1_view1_frontal.png"],
            "mimic-cxr": ["d1", "d3"]}
    for site, names in held.items():
        (tmp_path / "manifests" / f"{site}_manifest.txt").write_text("\n".join(names))
    study = Study(spark, site_config, str(tmp_path))
    with pytest.warns(UserWarning, match="Mystery"):
        reports = study.build_cohorts()
        checked = study.verify_manifests()
    assert checked.where("check = 'held_matched' AND value = '100.0%'").count() == 3
    assert all(r.ok for r in reports.values())
    people = study.cohorts()
    assert people.count() == 6 and people.where("`Pleural Effusion` = 1").count() == 1
    assert set(r["age_group"] for r in people.collect()) == {"<65", ">=65"}


def test_study_runs_from_cohorts_to_corrected_results(spark, raw_config, tmp_path):
    """Every later stage over a population read from the order tables."""
    gate = raw_config["analysis"]["power"]
    gate.update(simulation_replicates=500, meaningful_effect=0.9)
    cfg = from_mapping(raw_config)
    study = Study(spark, cfg, str(tmp_path))
    people = population.cohort(spark, "/root/testdata/sf0.01").withColumn("config_hash", F.lit(cfg.cohort_hash))
    for site in cfg.site_names:
        study.put(people.where(F.col("site") == site), "cohorts", "cohort", site=site)
    table, tiers = study.power_gate()
    assert table.count() == 160 and tiers.where("tier = 'primary'").count() == 7
    plan = study.catalogue.get_text(study.place("analysis", "analysis_plan", "md"))
    assert cfg.config_hash in plan and "| age_decade |" in plan
    folded = study.assign_folds()
    assert folded.where("fold IS NULL").isEmpty() and folded.count() == people.count()
    validation, test = population.fold_scores(spark, "/root/testdata/sf0.01")
    made = study.decide(validation, test)
    assert made.count() == test.count() and made.where("predicted IS NULL").isEmpty()
    sensitivity = made.where("truth = 1").agg(F.avg("predicted")).first()[0]
    assert 0.86 < sensitivity < 0.94
    result = study.analyse(made, tiers, replicates=200)
    assert result.gaps.count() == 2 * 8 * 2 * 3 and result.standardised.count() == 2 * 8 * 2
    corrected = study.get("analysis", "corrected", "csv")
    assert corrected.where("p_adjusted < p_value").isEmpty()
    assert result.replication().count() == 16 and result.sensitivity([0.01, 0.05]).count() == 32


def test_power_gate_stores_the_summary_that_the_plan_names(spark, raw_config, tmp_path):
    raw_config["analysis"]["power"].update(simulation_replicates=500, meaningful_effect=0.9)
    cfg = from_mapping(raw_config)
    study = Study(spark, cfg, str(tmp_path))
    people = population.cohort(spark, "/root/testdata/sf0.01").withColumn("config_hash", F.lit(cfg.cohort_hash))
    for site in cfg.site_names:
        study.put(people.where(F.col("site") == site), "cohorts", "cohort", site=site)
    study.power_gate()
    stored = study.get("analysis", "cohort_summary", "csv")
    assert stored.count() == cells.cohort_summary(study.cohorts()).count() > 0


def test_study_goes_from_vectors_to_stored_results(spark, raw_config, tmp_path):
    """Nested roles, one model per training site and fold, decisions, performance, transport, analysis."""
    raw_config["model"]["strengths"] = [1e-3, 1e-1]
    cfg = from_mapping(raw_config)
    study = Study(spark, cfg, str(tmp_path))
    people = population.cohort(spark, "/root/testdata/sf0.01").withColumn("config_hash", F.lit(cfg.cohort_hash))
    for site in cfg.site_names:
        study.put(people.where(F.col("site") == site), "cohorts", "cohort", site=site)
    study.assign_folds()
    roles = study.roles()
    assert {r["role"] for r in roles.select("role").distinct().collect()} == {"train", "val", "test"}
    assert roles.groupBy("site", "patient_id").count().where(f"count <> {cfg.n_folds}").isEmpty()
    # Vectors that say something of every label, with noise.
    noise = lambda k: F.pmod(F.xxhash64("patient_id", F.lit(k)), F.lit(1000)) / 500.0
    values = [F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) + noise(k) for k, n in enumerate(cfg.analysis_labels)]
    vectors = people.select("patient_id", "image_id", array_to_vector(F.array(*values)).alias("features"))
    scores = study.train(vectors)
    trained = people.where(F.col("site").isin(cfg.training_sites)).count()
    assert scores.test.count() == trained * len(cfg.analysis_labels)
    assert scores.elsewhere.where("source_site = site").isEmpty()
    per_source = [people.where(F.col("site") != s).count() for s in cfg.training_sites]
    assert scores.elsewhere.count() == sum(per_source) * cfg.n_folds * len(cfg.analysis_labels)
    held = scores.validation.join(roles.where("role = 'val'").select("site", "patient_id", F.col("outer_fold").alias("fold")), ["site", "patient_id", "fold"])
    assert held.count() == scores.validation.count() > 0
    assert scores.searches.count() >= 2 * cfg.n_folds and scores.searches.where("kept").count() == 2 * cfg.n_folds
    made = study.decide(scores.validation, scores.test)
    shown = study.performance(made)
    assert shown["auroc_macro"].where("macro_auroc < 0.7").isEmpty() and shown["auroc"].count() == 2 * len(cfg.analysis_labels)
    assert shown["reliability_calibrated"].groupBy("site", "label").agg(F.sum("n").alias("n")).where("n = 0").isEmpty()
    moved = study.transport(scores.elsewhere)
    assert moved.where("view = 'all'").count() == 2 * 4 * len(cfg.analysis_labels) and moved.where("fnr_low > fnr OR fnr > fnr_high").isEmpty()
    tiers = spark.createDataFrame([(n, "primary") for n in cfg.analysis_labels], "label string, tier string")
    study.analyse(made, tiers, replicates=200)
    for name, facets in (("verdict_sensitivity", {}), ("replication", {}), ("transport", {"arm": "global"}), ("auroc", {"arm": "global"}), ("calibration_report", {"arm": "global"})):
        assert study.get("analysis", name, "csv", **facets).count() > 0


def test_patients_with_two_roles_or_none_are_refused(spark):
    kinds = "site string, patient_id string, fold int, outer_fold int, role string"
    good = [("s", "a", 0, 0, "test"), ("s", "a", 0, 1, "train"), ("s", "b", 1, 0, "val"), ("s", "b", 1, 1, "test")]
    require_disjoint(spark.createDataFrame(good, kinds))
    for bad in ([*good, ("s", "b", 1, 0, "train")], good[:3]):
        with pytest.raises(SplitError, match=r"1 patient\(s\) do not hold exactly one role.*'b'"):
            require_disjoint(spark.createDataFrame(bad, kinds))


def test_selection_by_hash_takes_exactly_what_it_is_asked(spark):
    rows = [(g, f"{g}{i}") for g, n in (("a", 5000), ("b", 7), ("c", 3), ("d", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k string")
    take = spark.createDataFrame([("a", 777), ("b", 0), ("c", 3), ("e", 1)], "g string, n int")
    order = F.md5("k")
    got = hash_select(df, ["g"], order, "k", take, "n", "hit").where("hit").groupBy("g").agg(F.sort_array(F.collect_list("k")).alias("ks")).collect()
    want = {"a": sorted(sorted((k for g, k in rows if g == "a"), key=lambda k: hashlib.md5(k.encode()).hexdigest())[:777]), "c": ["c0", "c1", "c2"]}
    assert {r["g"]: r["ks"] for r in got} == want
    assert hash_select(df.limit(0), ["g"], order, "k", take, "n", "hit").count() == 0


def test_transport_counts_by_hand(spark):
    rows = [
        ("S", "T", 0, "L", "AP", 1.0, 1.0), ("S", "T", 0, "L", "AP", 1.0, 0.0), ("S", "T", 1, "L", "PA", 1.0, 1.0),
        ("S", "T", 1, "L", None, 0.0, 1.0), ("S", "T", 1, "L", "PA", 1.0, None), ("S", "T", 1, "L", "PA", None, 1.0),
    ]
    df = spark.createDataFrame(rows, "source_site string, target_site string, fold int, label string, view string, truth double, predicted double")
    got = {r["view"]: (r["n_positive"], r["n_negative"], r["fnr"], r["fpr"], r["fnr_low"], r["fnr_high"]) for r in transport_rates(df).collect()}
    assert got == {"all": (3, 1, 1 / 3, 1.0, 0.0, 0.5), "AP": (2, 0, 0.5, None, 0.5, 0.5), "PA": (1, 0, 0.0, None, 0.0, 0.0)}
    assert transport_rates(df.limit(0)).count() == 0
