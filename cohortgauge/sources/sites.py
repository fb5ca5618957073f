"""Three source layouts brought to one image schema.

Every loader yields ``patient_id, study_id, image_id, view_raw, is_frontal, sex, age``
and one double per observation label, plus counts of what each join lost.
"""

from __future__ import annotations

import warnings as pywarnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgauge.config import StudyConfig
from cohortgauge.operators.cohort import LATERAL_CODES, CohortBuildError, flow_table, token_drift
from cohortgauge.sources.tables import (
    SourceError,
    counted,
    read_csv,
    read_label_jsonl,
    require_columns,
    require_labels,
    require_unique,
)

SEX_CODES = {"M": "Male", "F": "Female"}


@dataclass
class SiteRows:
    """Loaded images, the loader's part of the flow, and its warnings."""

    rows: DataFrame
    counts: DataFrame | None = None
    flow: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


# ---- expressions shared with frames that are already in memory -----------------


def sex_from_code(code: Column) -> Column:
    return F.when(code == "M", SEX_CODES["M"]).when(code == "F", SEX_CODES["F"])


def view_code(raw: Column) -> Column:
    return F.upper(F.trim(raw))


def token_labels(findings: str, schema: list[str]) -> list[Column]:
    """One 0/1 column per schema label from a ``|``-separated SQL expression."""
    tokens = f"split(coalesce({findings}, ''), '[|]')"
    return [F.expr(f"cast(array_contains({tokens}, '{name}') as double) AS `{name}`") for name in schema]


PATH_IDS = r"(patient\d+)/(study\d+)/"


def path_identifiers(path: Column) -> tuple[Column, Column]:
    """Patient and ``patient/study`` from an image path; NULL where it does not fit."""
    fits = path.rlike(PATH_IDS)
    patient = F.regexp_extract(path, PATH_IDS, 1)
    study = F.concat_ws("/", patient, F.regexp_extract(path, PATH_IDS, 2))
    return F.when(fits, patient), F.when(fits, study)


def partition_from_path(path: Column) -> Column:
    pattern = r"(?:^|/)(train|valid|test)/"
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1))


def study_age(anchor_age: Column, anchor_year: Column, study_date: Column) -> Column:
    """Age at the study from an anchor pair; an unreadable date gives NULL."""
    year = F.year(F.try_to_timestamp(study_date.cast("string"), F.lit("yyyyMMdd")))
    return anchor_age.try_cast("double") + (year - anchor_year.try_cast("int"))


# ---- shapes: a raw frame of one layout to the common schema ---------------------


def shape_tokens(raw: DataFrame, schema: list[str], site: Column) -> DataFrame:
    """Findings in one ``|``-separated field; frontal films only."""
    return raw.select(
        F.col("Patient ID").cast("string").alias("patient_id"),
        F.col("Image Index").alias("study_id"), F.col("Image Index").alias("image_id"), site.alias("site"),
        view_code(F.col("View Position")).alias("view_raw"), F.lit(True).alias("is_frontal"),
        sex_from_code(F.col("Patient Gender")).alias("sex"),
        F.col("Patient Age").try_cast("double").alias("age"),
        *token_labels("`Finding Labels`", schema),
    )


# The path layout's columns unless ``columns:`` names others.
PATH_COLUMNS = {
    "image": "path_to_image", "frontal_lateral": "frontal_lateral", "view": "ap_pa", "sex": "sex", "age": "age",
    "partition": "split",
}


def join_path_labels(raw: DataFrame, labels: DataFrame, image: str) -> DataFrame:
    """Labels beside their image; ``has_labels`` tells matched rows from unmatched ones."""
    keyed = labels.withColumnRenamed("path_to_image", "_key").withColumn("has_labels", F.lit(True))
    joined = raw.join(keyed, F.col(f"`{image}`") == F.col("_key"), "left").drop("_key")
    return joined.withColumn("has_labels", F.coalesce("has_labels", F.lit(False)))


def shape_paths(probed: DataFrame, schema: list[str], site: Column, names: dict[str, str] | None = None) -> DataFrame:
    """Identifiers come out of the image path."""
    c = {role: F.col(f"`{name}`") for role, name in {**PATH_COLUMNS, **(names or {})}.items()}
    patient, study = path_identifiers(c["image"])
    recorded = ({**PATH_COLUMNS, **(names or {})})["partition"] in probed.columns
    partition = c["partition"] if recorded else partition_from_path(c["image"])
    return probed.select(
        patient.alias("patient_id"), study.alias("study_id"), c["image"].alias("image_id"), site.alias("site"),
        view_code(c["view"]).alias("view_raw"),
        F.coalesce(F.lower(F.trim(c["frontal_lateral"])) == "frontal", F.lit(False)).alias("is_frontal"),
        F.trim(c["sex"]).alias("sex"), c["age"].try_cast("double").alias("age"),
        partition.alias("source_partition"), *[F.col(f"`{n}`") for n in schema], "has_labels",
    )


def join_anchored(records: DataFrame, labels: DataFrame, patients: DataFrame) -> DataFrame:
    """Study labels and patient demographics beside each image, with match flags."""
    known = labels.withColumn("has_labels", F.lit(True))
    people = patients.select("subject_id", "gender", "anchor_age", "anchor_year", F.lit(True).alias("has_demographics"))
    joined = records.join(known, ["subject_id", "study_id"], "left").join(people, "subject_id", "left")
    return joined.withColumns(
        {f: F.coalesce(f, F.lit(False)) for f in ("has_labels", "has_demographics")}
    )


def shape_anchored(probed: DataFrame, schema: list[str], site: Column) -> DataFrame:
    """Age at the study from an anchor age and year, or the anchor age without a date."""
    view = view_code(F.col("ViewPosition"))
    if "StudyDate" in probed.columns:
        age = study_age(F.col("anchor_age"), F.col("anchor_year"), F.col("StudyDate"))
    else:
        age = F.col("anchor_age").try_cast("double")
    return probed.select(
        F.col("subject_id").cast("string").alias("patient_id"),
        F.concat_ws("/", F.col("subject_id").cast("string"), F.col("study_id").cast("string")).alias("study_id"),
        F.col("dicom_id").cast("string").alias("image_id"), site.alias("site"), view.alias("view_raw"),
        (~F.coalesce(view.isin(LATERAL_CODES), F.lit(False))).alias("is_frontal"),
        sex_from_code(F.col("gender")).alias("sex"), age.alias("age"),
        *[F.col(f"`{n}`") for n in schema], "has_labels", "has_demographics",
    )


# ---- loaders: files to shapes ----------------------------------------------------


def under(folder: str, name: str) -> str:
    """Join without touching a URI scheme such as ``hdfs://``."""
    return f"{folder.rstrip('/')}/{name}"


def _load_tokens(cfg: StudyConfig, folder: str, spark: SparkSession, site: str) -> SiteRows:
    name = cfg.sites[site]["metadata_files"]["records"]
    raw = read_csv(spark, under(folder, name))
    needed = ["Image Index", "Finding Labels", "Patient ID", "Patient Age", "Patient Gender", "View Position"]
    require_columns(raw.columns, needed, site, "records file")
    schema = cfg.observation_schema(site)
    notes = []
    unknown, named = counted(token_drift(raw, "Finding Labels", schema), "token")
    if unknown:
        notes.append(f"{site}: {unknown} finding token(s) outside its observation schema, among them {named}")
    rows = shape_tokens(raw, schema, F.lit(site))
    counts = flow_table(rows, [("metadata_rows", "population", F.lit(True))]).drop("n_dropped")
    return SiteRows(rows, counts, [("metadata_rows", name)], notes)


def _load_paths(cfg: StudyConfig, folder: str, spark: SparkSession, site: str) -> SiteRows:
    spec = cfg.sites[site]
    files, names = spec["metadata_files"], {**PATH_COLUMNS, **(spec.get("columns") or {})}
    records = [n for n in (files["records"], files.get("records_extra")) if n]
    raw = read_csv(spark, *[under(folder, n) for n in records], multiline=bool(spec.get("multiline")))
    needed = [names[r] for r in ("image", "frontal_lateral", "view", "sex", "age")]
    require_columns(raw.columns, needed, site, "records file")
    schema = cfg.observation_schema(site)
    labels = read_label_jsonl(spark, under(folder, files["labels"]), schema, site=site)
    require_unique(labels, ["path_to_image"], site, "label file")
    # Only the columns used travel through the join.
    used = [c for c in dict.fromkeys(names.values()) if c in raw.columns]
    probed = join_path_labels(raw.select(*[F.col(f"`{c}`") for c in used]), labels, names["image"])
    shaped = shape_paths(probed, schema, F.lit(site), names)
    counts = flow_table(
        shaped, [("metadata_rows", "population", F.lit(True)), ("labels_joined", "population", F.col("has_labels"))]
    ).drop("n_dropped")
    rows = shaped.where("has_labels").drop("has_labels")
    unreadable = rows.where("patient_id is null").count()
    if unreadable:
        raise CohortBuildError(
            f"{site}: {unreadable} image paths do not match the expected 'patientNNNNN/studyN/' structure"
        )
    flow = [
        ("metadata_rows", " + ".join(records)),
        ("labels_joined", f"image rows with an entry in {Path(files['labels']).name}"),
    ]
    return SiteRows(rows, counts, flow)


def _load_anchored(cfg: StudyConfig, folder: str, spark: SparkSession, site: str) -> SiteRows:
    files = cfg.sites[site]["metadata_files"]
    records, labels = read_csv(spark, under(folder, files["records"])), read_csv(spark, under(folder, files["labels"]))
    require_columns(records.columns, ["dicom_id", "subject_id", "study_id", "ViewPosition"], site, "records file")
    require_columns(labels.columns, ["subject_id", "study_id"], site, "label file")
    schema = cfg.observation_schema(site)
    require_labels(labels.columns, schema, site)
    if not files.get("patients"):
        raise SourceError(f"{site} requires a patients file for age and sex; set metadata_files.patients")
    patients = read_csv(spark, under(folder, files["patients"]))
    require_columns(patients.columns, ["subject_id", "gender", "anchor_age", "anchor_year"], site, "patients file")
    labels = labels.select(
        "subject_id", "study_id", *[F.col(f"`{n}`").try_cast("double").alias(n) for n in schema]
    )
    require_unique(labels, ["subject_id", "study_id"], site, "label file")
    require_unique(patients, ["subject_id"], site, "patients file")
    notes = []
    dated = "StudyDate" in records.columns
    if not dated:
        notes.append(f"{site}: StudyDate absent, so age is the anchor age rather than age at the study")
    slim = records.select("dicom_id", "subject_id", "study_id", "ViewPosition", *(["StudyDate"] if dated else []))
    shaped = shape_anchored(join_anchored(slim, labels, patients), schema, F.lit(site))
    both = F.col("has_labels") & F.col("has_demographics")
    counts = flow_table(
        shaped,
        [
            ("metadata_rows", "population", F.lit(True)),
            ("labels_joined", "population", F.col("has_labels")),
            ("demographics_joined", "population", both),
        ],
    ).drop("n_dropped")
    unmatched = shaped.where(~F.col("has_labels"))
    lost, views = counted(unmatched, "view_raw")
    note = f"{lost} image rows without a study-level label"
    if views:
        note += f", of projections such as {views}"
    flow = [
        ("metadata_rows", files["records"]),
        ("labels_joined", note),
        ("demographics_joined", "image rows with a demographic record"),
    ]
    return SiteRows(shaped.where(both).drop("has_labels", "has_demographics"), counts, flow, notes)


def attrition_by(probed: DataFrame, column: str, flag: str = "has_labels", keys: list[str] | None = None) -> DataFrame:
    """Rows a left join did not match, counted by projection (or any column)."""
    return probed.where(~F.col(flag)).groupBy(*(keys or []), column).count()


# Which layout each known site uses. A site may name another with
# ``layout:`` in its configuration.
LAYOUTS = {"tokens": _load_tokens, "paths": _load_paths, "anchored": _load_anchored}
SITE_LAYOUT = {"nih": "tokens", "chexpert": "paths", "mimic-cxr": "anchored"}


def load_site(site: str, cfg: StudyConfig, metadata_dir, spark: SparkSession) -> SiteRows:
    layout = (cfg.sites.get(site) or {}).get("layout") or SITE_LAYOUT.get(site)
    if layout not in LAYOUTS:
        raise CohortBuildError(f"no loader for site {site!r}; known: {sorted(SITE_LAYOUT)}")
    loaded = LAYOUTS[layout](cfg, str(metadata_dir), spark, site)
    for note in loaded.warnings:
        pywarnings.warn(note, stacklevel=2)
    return loaded


def load_site_metadata(site: str, cfg: StudyConfig, metadata_dir, spark: SparkSession) -> DataFrame:
    """One site's images in the common schema."""
    return load_site(site, cfg, metadata_dir, spark).rows
