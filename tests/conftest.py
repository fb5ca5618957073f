import copy
import sys
from pathlib import Path

import pytest
import yaml

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from pyspark import cloudpickle  # noqa: E402

import cohortgauge  # noqa: E402
from cohortgauge.config import from_mapping  # noqa: E402
from cohortgauge.session import build_session  # noqa: E402
from site_files import CHEX, NIH  # noqa: E402

cloudpickle.register_pickle_by_value(cohortgauge)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def raw_config():
    return yaml.safe_load((ROOT / "cohortgauge" / "data" / "study.yaml").read_text())


@pytest.fixture()
def cfg(raw_config):
    return from_mapping(copy.deepcopy(raw_config))


@pytest.fixture()
def site_config(raw_config):
    """A configuration of three file layouts with small schemas."""
    data = copy.deepcopy(raw_config)
    data["sites"] = {
        "nih": {"metadata_files": {"records": "entry.csv"}, "label_schema": "tokens", "image_key_depth": 1},
        "chexpert": {
            "metadata_files": {"records": "frames.csv", "records_extra": None, "labels": "labels.json"},
            "columns": {"view": "ap_pa", "partition": "split"}, "label_schema": "observed", "image_key_depth": 3,
            "image_key_pattern": r"patient(\d+)[/_]study(\d+)[/_](view\d+_[a-zA-Z]+)",
        },
        "mimic-cxr": {
            "metadata_files": {"records": "records.csv", "labels": "labels.csv", "patients": "patients.csv"},
            "label_schema": "observed", "image_key_depth": 1,
        },
    }
    data["labels"].update(
        analysis=["Cardiomegaly", "Edema", "Pleural Effusion", "No Finding"],
        observation_schema={"observed": CHEX, "tokens": NIH},
        harmonisation={"observed": {}, "tokens": {"Effusion": "Pleural Effusion"}},
    )
    data["model"].update(training_sites=["mimic-cxr", "chexpert"], primary_source="mimic-cxr")
    data["analysis"]["inferential_sites"] = ["mimic-cxr", "chexpert"]
    return from_mapping(data)
