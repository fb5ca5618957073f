import copy

import pytest

from cohortgauge.config import ConfigError, config_hash, freeze_config, from_mapping, load_config, scoped_hash


def test_hash_ignores_key_order_and_sees_values():
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1})
    assert config_hash({"a": 1}) != config_hash({"a": 2})


def test_stage_hash_moves_only_with_what_the_stage_reads(raw_config):
    changed = copy.deepcopy(raw_config)
    changed["model"]["patience"] = 9
    before, after = from_mapping(raw_config), from_mapping(changed)
    assert before.cohort_hash == after.cohort_hash
    assert before.split_hash == after.split_hash
    assert before.model_hash != after.model_hash
    assert before.analysis_hash != after.analysis_hash
    with pytest.raises(ConfigError, match="is no stage"):
        scoped_hash(raw_config, "nothing")


def test_artifacts_carry_the_hash_of_their_stage(cfg):
    assert [cfg.hash_for(a) for a in ("cohort", "folds", "scores", "gaps")] == [cfg.cohort_hash, cfg.split_hash, cfg.model_hash, cfg.analysis_hash]
    with pytest.raises(ConfigError):
        cfg.drive_path("nowhere")


@pytest.mark.parametrize(
    ("path", "value", "message"),
    [
        (("labels", "analysis"), [], "names no label"),
        (("labels", "analysis"), ["Edema", "Edema"], "names a label twice"),
        (("labels", "analysis"), ["Unknown"], r"sites.AMERICA: \['Unknown'\]"),
        (("labels", "secondary_lane"), ["Stray"], "labels.secondary_lane"),
        (("demographics", "age_bins", "edges"), [18, 40], "1 bins have 4 labels"),
        (("demographics", "age_bins", "edges"), [18, 60, 40, 80, 121], "do not rise"),
        (("demographics", "age_bins", "edges"), [20, 40, 60, 80, 121], "begins at 20"),
        (("demographics", "age_bins", "edges"), [18, 40, 60, 80, 100], "stops at 100"),
        (("demographics", "primary_age_threshold"), 18, "one side of the contrast"),
        (("demographics", "strata"), ["race"], "demographics.strata"),
        (("splits", "n_folds"), 1, "two folds or more"),
        (("splits", "val_fraction"), 1.0, "splits.val_fraction"),
        (("splits", "stratify_by"), [], "names no column"),
        (("model", "training_sites"), [], "names no site"),
        (("model", "training_sites"), ["AMERICA", "EUROPE", "MARS"], r"\['MARS'\]"),
        (("analysis", "inferential_sites"), ["ASIA"], "among model.training_sites"),
        (("analysis", "standardization", "reference_mix"), {"AP": 0.5, "PA": 0.4}, "add up to 1"),
        (("analysis", "threshold_rule", "fixed_sensitivity_target"), 1.0, "fixed_sensitivity_target"),
        (("model", "primary_source"), "MARS", "model.primary_source"),
        (("model", "early_stopping", "monitor"), "train_loss", "validation rows"),
    ],
)
def test_rules(raw_config, path, value, message):
    node = raw_config
    for key in path[:-1]:
        node = node[key]
    node[path[-1]] = value
    with pytest.raises(ConfigError, match=message):
        from_mapping(raw_config)


def test_all_findings_are_reported_together(raw_config):
    raw_config["splits"]["n_folds"] = 1
    raw_config["labels"]["secondary_lane"] = ["Stray"]
    with pytest.raises(ConfigError, match=r"secondary_lane.*n_folds"):
        from_mapping(raw_config)


def test_missing_section_and_shape(raw_config, tmp_path):
    del raw_config["splits"]
    with pytest.raises(ConfigError, match="splits"):
        from_mapping(raw_config)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    (tmp_path / "list.yaml").write_text("- 1")
    with pytest.raises(ConfigError, match="mapping"):
        load_config(tmp_path / "list.yaml")


def test_defaults_and_freeze(raw_config, tmp_path):
    del raw_config["splits"]["val_stratify_by"]
    assert from_mapping(raw_config).val_stratify_by == ["view", "sex"]
    import yaml

    source = tmp_path / "study.yaml"
    source.write_text(yaml.safe_dump(raw_config))
    cfg = load_config(source)
    copy_path = freeze_config(cfg, tmp_path / "frozen")
    assert cfg.config_hash in copy_path.name
    assert load_config(copy_path).config_hash == cfg.config_hash
    assert freeze_config(cfg, tmp_path / "frozen") == copy_path
    copy_path.write_text(copy_path.read_text().replace("n_folds", "n_fold"))
    with pytest.raises(ConfigError, match="no longer holds"):
        freeze_config(cfg, tmp_path / "frozen")


def test_contrast_levels_follow_the_threshold(raw_config):
    raw_config["demographics"]["primary_age_threshold"] = 70
    assert from_mapping(raw_config).contrasts["age_group"] == ("<70", ">=70")
