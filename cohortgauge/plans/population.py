"""A study population derived from the order tables.

Each order is a patient with one image. Site, sex, age and view come from the order
and its customer; labels and scores are made up: keyed hashes of the order, with effects of view
and age planted in them. The rows are those of ``orders``, so the work grows with them;
the measured values say nothing about the orders.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgauge.config import StudyConfig, load_config
from cohortgauge.functions.keys import hash_unit_sql
from cohortgauge.operators.cohort import age_group_column, label_and_classify, retained_cohort
from cohortgauge.operators.splits import assign_folds, fold_roles
from cohortgauge.session import materialise

# Share of positives per label before the effects of view and age.
PREVALENCE = {
    "Atelectasis": 0.30, "Cardiomegaly": 0.25, "Consolidation": 0.08, "Edema": 0.20, "Pneumonia": 0.05,
    "Pneumothorax": 0.10, "Pleural Effusion": 0.35, "Lung Opacity": 0.15, "Fracture": 0.04, "Support Devices": 0.20,
}
OBSERVED = [*PREVALENCE, "No Finding"]
UNCERTAIN, UNMENTIONED = 0.05, 0.10
SITES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@cache
def study() -> StudyConfig:
    return load_config(Path(__file__).resolve().parents[1] / "data" / "study.yaml")


# Schemas of the tables read, so no scan starts by reading footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a table's files for one task, some 60,000 to 110,000 orders or line items.
DEALT_BYTES = 1 << 20


def _dealt(spark: SparkSession, sf_dir: str, name: str, columns: list[str], key: str) -> DataFrame:
    """The narrow columns the population is hashed from, over all cores and over as many tasks as the table's bytes ask for.

    The made-up labels cost some thirty digests a row; a file with one row group would be
    hashed by one task. This is the fixture's own cost and stays out of the operators. What a task
    folds before the next shuffle stays in its memory, so larger tables get more tasks, not larger ones.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // DEALT_BYTES))
    return table(spark, sf_dir, name).select(*columns).repartition(tasks, key)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their region.

    Left-deep on purpose: every right side is a base table whose file size Catalyst
    knows, so the orders stay the streamed side and small dimensions are broadcast.
    """
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = _dealt(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderkey")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


VIEW = """CASE o_orderstatus WHEN 'F' THEN 'AP' WHEN 'O' THEN 'PA'
          ELSE CASE o_orderkey % 3 WHEN 0 THEN 'LATERAL' WHEN 2 THEN 'AP AXIAL' END END"""
SEX = """CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Male'
         WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Female' END"""


def _label(name: str) -> str:
    u = hash_unit_sql(f"'{name}'", "o_orderkey")
    cut = (
        f"({PREVALENCE[name]}D + CASE WHEN o_orderstatus = 'F' THEN 0.06D ELSE 0D END"
        " + CASE WHEN age >= 65 THEN 0.04D ELSE 0D END)"
    )
    return f"""CASE WHEN {u} < {cut} THEN 1D WHEN {u} < {cut} + {UNCERTAIN}D THEN -1D
               WHEN {u} < {cut} + {UNCERTAIN + UNMENTIONED}D THEN cast(null as double) ELSE 0D END AS `{name}`"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image before any policy: uncertain marks, laterals and missing sexes included."""
    return _base(spark, sf_dir).selectExpr("*", "cast(10 + o_orderkey % 100 as double) AS age").selectExpr(
        "cast(o_orderkey as string) AS patient_id",
        "concat(o_custkey, '/', o_orderkey) AS study_id",
        "concat('train/patient', o_orderkey, '/study', o_orderkey % 3 + 1, '/view1_frontal.jpg') AS image_id",
        "r_name AS site", f"{VIEW} AS view_raw", f"NOT coalesce({VIEW} = 'LATERAL', false) AS is_frontal",
        f"{SEX} AS sex", "age", *[_label(name) for name in PREVALENCE], "cast(null as double) AS `No Finding`",
    )


def classified(spark: SparkSession, sf_dir: str, policy: str = "nan") -> DataFrame:
    return label_and_classify(images(spark, sf_dir), study(), OBSERVED, policy)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained_cohort(classified(spark, sf_dir), study(), OBSERVED)


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort with the binary age contrast."""
    return cohort(spark, sf_dir).withColumn("age_group", age_group_column(study().primary_age_threshold))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = study()
    return assign_folds(
        cohort(spark, sf_dir), training_sites=cfg.training_sites, stratify_by=cfg.stratify_by, n_folds=cfg.n_folds,
        seed=cfg.seed,
    )


def roles(spark: SparkSession, sf_dir: str, with_folds: DataFrame | None = None) -> DataFrame:
    cfg = study()
    return fold_roles(
        with_folds if with_folds is not None else folded(spark, sf_dir), val_stratify_by=cfg.val_stratify_by,
        n_folds=cfg.n_folds, val_fraction=cfg.val_fraction, min_stratum=cfg.min_val_stratum, seed=cfg.seed,
    )


def label_score(model: str) -> str:
    """A score planted to miss older patients and AP films more, too confident on AP.

    ``model`` (SQL) names the fold whose model scored the patient, so the same patient
    gets different scores from different models.
    """
    u = hash_unit_sql("'score'", "label", "patient_id", model)
    z = f"""(CASE WHEN truth = 1 THEN 1.6D ELSE -1.4D END + ln(({u} + 0.001D) / (1.001D - {u}))
             - CASE WHEN truth = 1 AND view = 'AP' THEN 0.5D ELSE 0D END
             - CASE WHEN truth = 1 AND age >= 65 THEN 0.4D ELSE 0D END)"""
    score = f"round(1D / (1D + exp(-({z} * CASE WHEN view = 'AP' THEN 1.8D ELSE 1.2D END))), 6)"
    # Never missing; saying so lets Catalyst drop null checks that would evaluate it twice.
    return f"coalesce({score}, 0D) AS score"


def _long(df: DataFrame, keep: list[str], labels: list[str]) -> DataFrame:
    """One row per label. ``inline`` keeps the generated code of the following scores compilable."""
    pairs = ", ".join(f"named_struct('label', '{n}', 'truth', `{n}`)" for n in labels)
    return df.selectExpr(*keep, f"inline(array({pairs}))")


def scores(spark: SparkSession, sf_dir: str, sites: list[str] | None = None) -> DataFrame:
    """One out-of-sample score per patient and label, for all sites."""
    source = grouped(spark, sf_dir)
    if sites:
        source = source.where(F.col("site").isin(sites))
    keep = ["site", "patient_id", "image_id", "view", "sex", "age", "age_group"]
    long = _long(source, keep, study().analysis_labels)
    return long.selectExpr("*", label_score("0"))


def fold_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Validation and test scores per outer fold, for the training sites."""
    cfg = study()
    people = grouped(spark, sf_dir).where(F.col("site").isin(cfg.training_sites))
    # Roles are an artifact of the study: stored once, read for validation and test.
    role = materialise(
        roles(spark, sf_dir).where("role <> 'train'").select(
            "site", "patient_id", F.col("outer_fold").alias("fold"), "role"
        )
    )
    keep = ["site", "patient_id", "view", "sex", "age", "age_group", "fold", "role"]
    long = _long(people.join(role, ["site", "patient_id"]), keep, cfg.analysis_labels)
    scored = long.selectExpr("*", label_score("fold"))
    return scored.where("role = 'val'").drop("role"), scored.where("role = 'test'").drop("role")


def foreign_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every training site's fold models on the patients of all other sites."""
    cfg = study()
    sources = ", ".join(f"'{s}'" for s in cfg.training_sites)
    keep = ["site", "patient_id", "view", "sex", "age", "age_group"]
    models = f"inline(transform(sequence(0, {len(cfg.training_sites) * cfg.n_folds - 1}), i -> named_struct(" \
        f"'source_site', array({sources})[i div {cfg.n_folds}], 'fold', cast(i % {cfg.n_folds} as int))))"
    long = _long(grouped(spark, sf_dir).selectExpr("*", models).where("source_site <> site"), [*keep, "source_site", "fold"], cfg.analysis_labels)
    return long.selectExpr("*", label_score("concat(source_site, fold)"))


def quick_decisions(spark: SparkSession, sf_dir: str, cut: float = 0.35) -> DataFrame:
    """Decisions at one fixed cut for all sites; the input of the gap operators."""
    return scores(spark, sf_dir).withColumn("predicted", (F.col("score") >= cut).cast("double"))


# ------------------------------------------------- frames the ingest operators start from


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the images held: orders with a line item, and a few that no order matches.

    They are written differently from the metadata (other prefix and extension), and
    repeat once per line item, as a listing with duplicates would.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey")
    place = _base(spark, sf_dir).select("o_orderkey", "r_name")
    held = line.join(place, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "r_name AS site",
        "concat(' held\\\\patient', o_orderkey, '\\\\study', o_orderkey % 3 + 1, '\\\\view1_frontal.PNG') AS value",
    )
    strays = place.where("o_orderkey % 60 = 3").selectExpr(
        "r_name AS site", "concat('held/patient', o_orderkey, '/study9/view1_frontal.png ') AS value"
    )
    blanks = place.where("o_orderkey % 1000 = 0").selectExpr("r_name AS site", "'   ' AS value")
    return held.unionByName(strays).unionByName(blanks)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property records of the events, some cut short, some blank, some with a second key."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type", """CASE WHEN event_id % 50 = 7 THEN substr(props, 1, length(props) - 1) WHEN event_id % 70 = 3 THEN '  '
            WHEN event_id % 9 = 1 THEN concat('{"id": ', event_id, ', ', substr(props, 2)) ELSE props END AS value""",
    )


def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The population as a one-file site writes it."""
    tokens = ", ".join(f"CASE WHEN `{n}` = 1 THEN '{n}' END" for n in PREVALENCE)
    return images(spark, sf_dir).selectExpr(
        "site", "image_id AS `Image Index`", "patient_id AS `Patient ID`",
        "CASE WHEN cast(patient_id as bigint) % 97 = 0 THEN 'n/a' ELSE cast(age as string) END AS `Patient Age`",
        "substr(sex, 1, 1) AS `Patient Gender`", "lower(concat(' ', view_raw, ' ')) AS `View Position`",
        f"concat_ws('|', {tokens}) AS `Finding Labels`",
    )


LABELLED = "{u} >= 0.1D"


def path_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metadata rows and a label table that covers nine tenths of them."""
    source = images(spark, sf_dir)
    raw = source.selectExpr(
        "site", "image_id AS path_to_image",
        "CASE WHEN is_frontal THEN ' Frontal' ELSE 'Lateral' END AS frontal_lateral", "lower(view_raw) AS ap_pa",
        "concat(sex, ' ') AS sex", "cast(age as string) AS age",
    )
    u = hash_unit_sql("'labelled'", "patient_id")
    labels = source.where(LABELLED.format(u=u)).selectExpr(
        "image_id AS path_to_image", *[f"`{n}`" for n in PREVALENCE]
    )
    return raw, labels


def anchored_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image records, study labels and patient demographics; customers are the patients."""
    base = images(spark, sf_dir)
    dates = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) AS _key", "o_custkey", "o_orderkey", "date_format(o_orderdate, 'yyyyMMdd') AS _day"
    )
    joined = base.join(dates, F.col("patient_id") == F.col("_key"))
    records = joined.selectExpr(
        "site", "concat('d', o_orderkey) AS dicom_id", "o_custkey AS subject_id", "o_orderkey AS study_id",
        "view_raw AS ViewPosition",
        "CASE WHEN o_orderkey % 89 = 0 THEN 'unknown' ELSE _day END AS StudyDate",
    )
    u = hash_unit_sql("'labelled'", "patient_id")
    labels = joined.where(LABELLED.format(u=u)).selectExpr(
        "o_custkey AS subject_id", "o_orderkey AS study_id", *[f"`{n}`" for n in PREVALENCE]
    )
    patients = table(spark, sf_dir, "customer").where("c_custkey % 20 <> 0").selectExpr(
        "c_custkey AS subject_id", f"substr({SEX}, 1, 1) AS gender", "20 + c_custkey % 60 AS anchor_age",
        "1995 AS anchor_year",
    )
    return records, labels, patients


def flagged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified images with the marks the flow counts: labels, demographics, held."""
    held = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as string) AS patient_id").distinct()
    u = hash_unit_sql("'labelled'", "patient_id")
    return classified(spark, sf_dir).join(held.withColumn("_held", F.lit(True)), "patient_id", "left").selectExpr(
        "*", f"{LABELLED.format(u=u)} AS has_labels",
        "cast(split(study_id, '/')[0] as bigint) % 20 <> 0 AS has_demographics", "coalesce(_held, false) AS held",
    )


def untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as a badly assembled cohort: every contract finds something."""
    used = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"]
    return _dealt(spark, sf_dir, "lineitem", used, "l_partkey").selectExpr(
        """CASE WHEN l_quantity = 50 THEN cast(null as string) WHEN l_orderkey % 100 = 7 THEN '  '
           ELSE cast(l_orderkey as string) END AS patient_id""",
        """CASE WHEN l_linenumber = 1 THEN concat('S', l_suppkey)
           ELSE concat(l_orderkey, '/', l_linenumber) END AS study_id""",
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS image_id",
        "CASE WHEN l_returnflag = 'R' THEN 'EUROPE' ELSE 'AMERICA' END AS site",
        """CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'LATERAL' WHEN l_linestatus = 'F' THEN 'AP'
           ELSE 'PA' END AS view""",
        """CASE l_suppkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female'
           ELSE CASE WHEN l_linenumber = 5 THEN 'Unknown' ELSE 'Male' END END AS sex""",
        "l_quantity + 10D AS age", "CASE WHEN l_quantity < 30 THEN '18-39' ELSE '40-59' END AS age_bin",
        f"CASE WHEN l_tax = 0 THEN 'NOT-A-HASH' ELSE '{study().cohort_hash}' END AS config_hash",
        """CASE WHEN (l_orderkey * 31 + l_partkey * 17) % 1000 < 20 THEN 1D
           WHEN (l_orderkey * 31 + l_partkey * 17) % 1000 < 50 THEN -1D ELSE 0D END AS Cardiomegaly""",
        """CASE WHEN (l_orderkey * 13 + l_suppkey * 7) % 10 < 3 THEN 1D
           WHEN (l_orderkey * 13 + l_suppkey * 7) % 10 = 3 THEN cast(null as double) ELSE 0D END AS Edema""",
        "CASE WHEN (l_partkey + l_linenumber) % 5 = 0 THEN 1D ELSE 0D END AS `No Finding`",
    )
