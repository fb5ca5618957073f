import uuid

import pytest
from pyspark.sql import functions as F

from cohortgauge.config import from_mapping
from cohortgauge.plans import population
from cohortgauge.plans.study import Study
from cohortgauge.sources.catalogue import Catalogue
from cohortgauge.sources.tables import SourceError, write_parquet
from site_files import write_anchored, write_paths, write_tokens


def jobs_of(spark, work):
    """What ``work`` returns, and how many Spark jobs it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        made = work()
        return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def catalogue(spark, tmp_path):
    return Catalogue(spark, str(tmp_path))


def test_names_tell_variants_apart(catalogue, tmp_path):
    place = catalogue.place("scores", "decisions", "abc", arm="view", site=None, inputs="r1")
    assert place == f"{tmp_path}/scores/decisions-arm=view-inputs=r1-abc.parquet"
    assert catalogue.place("scores", "decisions", "abc", "csv") == f"{tmp_path}/scores/decisions-abc.csv"


def test_tables_come_back_typed_without_a_job(spark, catalogue):
    df = spark.range(5).select("id", (F.col("id") / 2).alias("half"), F.lit("x").alias("part"), F.lit(None).cast("date").alias("day"))
    place = catalogue.place("t", "numbers", "h")
    catalogue.put(df, place, partition_by=["part"])
    read, jobs = jobs_of(spark, lambda: catalogue.read(place))
    assert jobs == 0 and dict(read.dtypes) == dict(df.dtypes) and read.count() == 5
    empty = catalogue.put(df.limit(0), catalogue.place("t", "none", "h"))
    assert empty.count() == 0 and empty.columns == df.columns


def test_a_write_that_dies_leaves_the_version_before(spark, catalogue):
    place = catalogue.place("t", "numbers", "h")
    with pytest.raises(SourceError, match="nothing is published"):
        catalogue.read(place)

    def dies(path):
        write_parquet(spark.range(99), path)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        catalogue.publish(place, dies)
    assert catalogue.current(place) is None
    with pytest.raises(SourceError):
        catalogue.read(place)
    catalogue.put(spark.range(3), place)
    with pytest.raises(RuntimeError):
        catalogue.publish(place, dies)
    assert catalogue.read(place).count() == 3
    # A task that fails while the data are written.
    with pytest.raises(Exception, match="broken row"):
        catalogue.put(spark.range(9).select(F.expr("if(id = 7, raise_error('broken row'), id)").cast("long").alias("id")), place)
    assert catalogue.read(place).count() == 3 and len(catalogue.versions(place)) == 1


def test_a_reader_keeps_its_version_while_another_is_published(spark, catalogue):
    place = catalogue.place("t", "numbers", "h")
    first = catalogue.put(spark.range(3), place)
    second = catalogue.put(spark.range(4), place)
    assert (first.count(), second.count(), catalogue.read(place).count()) == (3, 4, 4)


def test_a_second_run_reads_finished_cohorts(spark, site_config, tmp_path):
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
        first = study.build_cohorts()
    again, jobs = jobs_of(spark, Study(spark, site_config, str(tmp_path)).build_cohorts)
    assert jobs == 0
    assert {s: (r.n_rows, r.violations) for s, r in again.items()} == {s: (r.n_rows, r.violations) for s, r in first.items()}
    with pytest.warns(UserWarning, match="Mystery"):
        Study(spark, site_config, str(tmp_path), reuse=False).build_cohorts()
    assert all(len(study.catalogue.versions(study.place("cohorts", "cohort", site=s))) == 2 for s in held)


def test_a_second_run_reads_finished_stages_and_a_new_setting_runs_them(spark, raw_config, tmp_path):
    raw_config["analysis"]["power"].update(meaningful_effect=0.9)
    cfg = from_mapping(raw_config)
    study = Study(spark, cfg, str(tmp_path))
    people = population.cohort(spark, "/root/testdata/sf0.01").withColumn("config_hash", F.lit(cfg.cohort_hash))
    for site in cfg.site_names:
        study.put(people.where(F.col("site") == site), "cohorts", "cohort", site=site)
    table, tiers = study.power_gate()
    folded = study.assign_folds()
    validation, test = population.fold_scores(spark, "/root/testdata/sf0.01")
    made = study.decide(validation, test, inputs="r1")

    def run(s):
        return [*s.power_gate(), s.assign_folds(), s.decide(validation, test, inputs="r1")]

    again, jobs = jobs_of(spark, lambda: run(Study(spark, cfg, str(tmp_path))))
    assert jobs == 0
    for one, two in zip((table, tiers, folded, made), again, strict=True):
        assert dict(one.dtypes) == dict(two.dtypes)
        assert one.select(sorted(one.columns)).exceptAll(two.select(sorted(one.columns))).isEmpty() and one.count() == two.count()
    # Another threshold target: the split stays finished, decisions do not.
    raw_config["analysis"]["threshold_rule"]["fixed_sensitivity_target"] = 0.8
    other = Study(spark, from_mapping(raw_config), str(tmp_path))
    assert other._done("folds", "split") and not other._done("decide", "analysis", "global", "r1") and not other._done("power", "analysis")
    # Scores of another name are decided anew, and a stage without a name always runs.
    assert not study._done("decide", "analysis", "global", "r2")
    assert jobs_of(spark, lambda: study.decide(validation, test))[1] > 0
