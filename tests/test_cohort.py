import pytest

from cohortgauge.functions.keys import canonical_image_key
from cohortgauge.operators import cohort
from cohortgauge.operators.cohort import CohortBuildError
from cohortgauge.sources.sites import load_site_metadata
from cohortgauge.sources.tables import SourceError, read_manifest
from site_files import write_anchored, write_paths, write_tokens


def keys(spark, names, *args):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return [r[0] for r in df.select(canonical_image_key("name", *args)).collect()]


def test_canonical_key_depth_and_extension(spark):
    assert keys(spark, ["a/b/c.jpg", "d.PNG", "plain", "x\\y.png"]) == ["c", "d", "plain", "y"]
    assert keys(spark, ["root/patient1/study1/view1.jpg", "short"], 3) == ["patient1/study1/view1", "short"]


def test_canonical_key_pattern(spark):
    pattern = r"patient(\d+)[/_]study(\d+)[/_](view\d+_[a-zA-Z]+)"
    got = keys(spark, ["train_patient1_study2_view1_frontal.jpg", "v/train/patient1/study2/view1_frontal.jpg", "no"], 1, pattern)
    assert got == ["1_2_view1_frontal", "1_2_view1_frontal", None]
    with pytest.raises(ValueError, match="capture groups"):
        canonical_image_key("name", 1, "abc")
    with pytest.raises(ValueError, match="at least 1"):
        canonical_image_key("name", 0)


def test_uncertain_policies(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,), (0.0,), (None,)], "Edema double")
    assert [r[0] for r in cohort.resolve_uncertain(df, ["Edema", "Absent"], "nan").collect()] == [None, 1.0, 0.0, None]
    assert [r[0] for r in cohort.resolve_uncertain(df, ["Edema"], "u_zeros").collect()] == [0.0, 1.0, 0.0, None]
    with pytest.raises(CohortBuildError):
        cohort.resolve_uncertain(df, ["Edema"], "ones")


def test_harmonise_is_one_to_one(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "Effusion double, Other double")
    assert cohort.harmonise(df, {"Effusion": "Pleural Effusion"}).columns == ["Pleural Effusion", "Other"]
    with pytest.raises(CohortBuildError, match="several source labels"):
        cohort.harmonise(df, {"Effusion": "X", "Other": "X"})
    with pytest.raises(CohortBuildError, match="overwrite"):
        cohort.harmonise(df, {"Effusion": "Other"})


def test_no_finding_ignores_equipment_and_missing(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (None, None, 1.0), (None, None, None)],
        "Edema double, `Support Devices` double, `Lung Opacity` double",
    )
    got = cohort.derive_no_finding(df, ["Edema", "Support Devices", "Lung Opacity", "No Finding"])
    assert [r["No Finding"] for r in got.collect()] == [0.0, 1.0, 0.0, 1.0]


def test_outcomes_take_the_first_reason(spark, cfg):
    rows = [
        (False, None, None, None, "lateral"), (True, None, "Male", 50.0, "view_missing"),
        (None, "AP AXIAL", "Male", 50.0, "view_nonstandard"), (True, "AP", None, 50.0, "demographics_missing"),
        (True, "PA", "Female", 17.0, "demographics_missing"), (True, "PA", "Female", 411.0, "demographics_missing"),
        (True, "PA", "Other", 40.0, "demographics_missing"), (None, "PA", "Female", 18.0, "retained"),
        (True, "AP", "Male", 120.0, "retained"),
    ]
    df = spark.createDataFrame(rows, "is_frontal boolean, view_raw string, sex string, age double, want string")
    for row in df.withColumn("got", cohort.outcome_column(cfg)).collect():
        assert row["got"] == row["want"], row


def test_age_bands_and_groups(spark, cfg):
    df = spark.createDataFrame([(a,) for a in (17.0, 18.0, 39.9, 40.0, 80.0, 120.0, None)], "age double")
    got = df.select(cohort.age_bin_column(cfg).alias("b"), cohort.age_group_column(65).alias("g")).collect()
    assert [r["b"] for r in got] == [None, "18-39", "18-39", "40-59", "80+", "80+", None]
    assert got[-1]["g"] == ">=65" and got[0]["g"] == "<65"


# ---- loaders over real files ---------------------------------------------------


def test_token_site(spark, site_config, tmp_path):
    write_tokens(tmp_path)
    with pytest.warns(UserWarning, match="Mystery"):
        rows = {r["image_id"]: r for r in load_site_metadata("nih", site_config, tmp_path, spark).collect()}
    assert rows["1.png"]["Cardiomegaly"] == 1.0 and rows["1.png"]["Effusion"] == 1.0 and rows["1.png"]["Hernia"] == 0.0
    assert rows["2.png"]["view_raw"] == "AP" and rows["2.png"]["sex"] == "Female"
    assert rows["5.png"]["age"] is None and rows["5.png"]["No Finding"] == 0.0


def test_path_site_keeps_null_labels_and_drops_unlabelled(spark, site_config, tmp_path):
    write_paths(tmp_path)
    rows = {r["patient_id"]: r for r in load_site_metadata("chexpert", site_config, tmp_path, spark).collect()}
    assert set(rows) == {"patient1", "patient2", "patient3"}
    assert rows["patient1"]["study_id"] == "patient1/study1" and rows["patient1"]["source_partition"] == "train"
    assert rows["patient1"]["Edema"] is None and rows["patient3"]["Cardiomegaly"] == -1.0
    assert rows["patient3"]["is_frontal"] is False


def test_anchored_site(spark, site_config, tmp_path):
    write_anchored(tmp_path)
    rows = {r["image_id"]: r for r in load_site_metadata("mimic-cxr", site_config, tmp_path, spark).collect()}
    assert set(rows) == {"d1", "d2", "d3", "d5"}
    assert rows["d3"]["age"] == 45.0 and rows["d5"]["age"] is None and rows["d2"]["is_frontal"] is False
    write_anchored(tmp_path / "undated", dated=False)
    with pytest.warns(UserWarning, match="anchor age"):
        got = load_site_metadata("mimic-cxr", site_config, tmp_path / "undated", spark)
    assert {r["age"] for r in got.collect()} == {40.0}


def test_missing_file_column_label_and_duplicates(spark, site_config, tmp_path):
    with pytest.raises(SourceError, match="there is no file"):
        load_site_metadata("nih", site_config, tmp_path / "none", spark)
    with pytest.raises(CohortBuildError, match="no loader"):
        load_site_metadata("elsewhere", site_config, tmp_path, spark)
    write_paths(tmp_path)
    labels = tmp_path / "labels.json"
    text = labels.read_text()
    labels.write_text(text + text.splitlines()[0] + "\n")
    with pytest.raises(SourceError, match="more than once"):
        load_site_metadata("chexpert", site_config, tmp_path, spark)
    labels.write_text('{"path_to_image": "a", "Cardiomegaly": 1}\n')
    with pytest.raises(SourceError, match="no values for the labels"):
        load_site_metadata("chexpert", site_config, tmp_path, spark)
    (tmp_path / "frames.csv").write_text("path_to_image,sex\na,b\n")
    with pytest.raises(SourceError, match="has no column"):
        load_site_metadata("chexpert", site_config, tmp_path, spark)


def test_build_end_to_end(spark, site_config, tmp_path):
    write_anchored(tmp_path)
    (tmp_path / "manifest.txt").write_text("D1.dcm\n\n d2.dcm \nd3.dcm\nd5.dcm\nd5.dcm\n")
    names = read_manifest(spark, tmp_path / "manifest.txt")
    built = cohort.build_cohort("mimic-cxr", site_config, tmp_path, spark, image_manifest=names)
    rows = {r["image_id"]: r for r in built.cohort.collect()}
    assert set(rows) == {"d1", "d3"}
    assert built.cohort.columns[:8] == ["patient_id", "study_id", "image_id", "site", "view", "sex", "age", "age_bin"]
    assert built.cohort.columns[-1] == "config_hash" and rows["d1"]["config_hash"] == site_config.cohort_hash
    assert rows["d1"]["No Finding"] == 0.0
    assert {r["outcome"]: r["n_images"] for r in built.exclusion_summary().collect()} == {
        "retained": 2, "lateral": 1, "demographics_missing": 1
    }
    flow = {r["step"]: r for r in built.flow.collect()}
    assert flow["metadata_rows"]["n_images"] == 5 and flow["labels_joined"]["n_dropped"] == 1
    assert flow["labels_joined"]["note"] == "1 image rows without a study-level label, of projections such as ['AP']"
    assert flow["excluded_lateral"]["n_dropped"] is None and flow["final"]["n_images"] == 2


def test_build_refuses_a_poor_match_and_duplicates(spark, site_config, tmp_path):
    write_anchored(tmp_path)
    few = spark.createDataFrame([("d1",), ("zz",)], "name string")
    with pytest.raises(CohortBuildError, match="50.0% of 2 held"):
        cohort.build_cohort("mimic-cxr", site_config, tmp_path, spark, image_manifest=few)
    records = tmp_path / "records.csv"
    records.write_text(records.read_text() + "d9,10,100,PA,21500101\n")
    with pytest.raises(CohortBuildError, match="keep several images"):
        cohort.build_cohort("mimic-cxr", site_config, tmp_path, spark)


def test_pattern_mismatch_and_empty_manifest(spark, site_config, tmp_path):
    write_paths(tmp_path)
    odd = spark.createDataFrame([("train_patient1_study1_view1_frontal.jpg",), ("odd.jpg",)], "name string")
    with pytest.raises(CohortBuildError, match="cannot read 1 of 2"):
        cohort.build_cohort("chexpert", site_config, tmp_path, spark, image_manifest=odd)
    empty = spark.createDataFrame([("  ",)], "name string")
    with pytest.raises(CohortBuildError, match="has no names"):
        cohort.build_cohort("chexpert", site_config, tmp_path, spark, image_manifest=empty)


def test_verify_manifest_without_keys(spark):
    meta = spark.createDataFrame([("a/x.png",), ("a/y.png",)], "image_id string")
    names = spark.createDataFrame([("x.jpg",), ("q.jpg",)], "name string")
    got = {r["check"]: r for r in cohort.verify_manifest(meta, names, 1).collect()}
    assert got["held_matched"]["value"] == "50.0%" and not got["held_matched"]["ok"]
    assert got["held_matched"]["note"] == "unmatched e.g. q" and got["metadata_covered"]["ok"]
