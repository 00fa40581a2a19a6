"""What rules refuse, and text logs in the alert pipeline."""

import json
import os

import pytest

from vigilspark.config import AlertRules, BOOT_KEYWORDS, Threshold
from vigilspark.operators.alerts import alert_pipeline
from vigilspark.sources import store
from vigilspark.sources.journal import read_journal


@pytest.mark.parametrize("wrong", [
    {"watched": []}, {"watched": [" "]}, {"noisy": {"x": (1,)}}, {"noisy": {"x": (0, 5)}}, {"noisy": {"x": ("2", 5)}},
    {"aggregate": {"x": 0}}, {"aggregate": {"x": 1.5}}, {"thresholds": {"TRIAGE": Threshold(0, 1, 0)}},
    {"thresholds": {"TRIAGE": Threshold(1, 1, -1)}}, {"retention_days": -1}])
def test_rules_refuse(wrong):
    with pytest.raises(ValueError):
        AlertRules(**wrong)


def test_loaded_rules_need_both_lists():
    with pytest.raises(ValueError):
        AlertRules.loaded(["error"], [])
    assert AlertRules.loaded([" Error ", "error", ""], ["X"]).active_keywords == ["error", *BOOT_KEYWORDS]
    assert Threshold.of(3, 60) == Threshold(3, 3, 60)


def test_power_mode_adds_user_keywords_last():
    rules = AlertRules(watched=["b", "a"], user_keywords=["A", "z"], power_mode=True)
    assert rules.active_keywords == ["b", "a", *BOOT_KEYWORDS, "z"]


def test_text_logs_and_journal_in_one_pipeline(spark, tmpdir_path):
    logs, journal = os.path.join(tmpdir_path, "auth.log"), os.path.join(tmpdir_path, "j.json")
    with open(logs, "w") as f:
        f.write("error one\nerror one\nerror one\nerror one\nnothing\n")
    with open(journal, "w") as f:
        for s in (0, 1, 2, 2):
            f.write(json.dumps({"__REALTIME_TIMESTAMP": str((1_704_067_200 + s) * 1_000_000), "MESSAGE": "error", "_BOOT_ID": "b"}) + "\n")
    rules = AlertRules(watched=["error"], critical=[])
    both = store.union_sources(read_journal(spark, journal), store.text_log(spark, logs))
    assert both.columns == store.ENTRY_CONTRACT and both.where("boot_id = 'b'").count() == 4
    got = sorted((r.source, r.raw, r.hit_count) for r in alert_pipeline(both, rules).collect())
    assert got == [("auth.log", "error one", 3), ("journalctl", "unknown: error", 3)]


def test_flags_without_their_entry_are_malformed(spark, tmpdir_path):
    whole = {"entry": {"timestamp_ns": 1, "source": "s", "raw": "r", "priority": None}, "level": "TRIAGE", "flagged_at": 1,
             "pattern_key": "s:k", "hit_count": 1, "note": None}
    with open(os.path.join(tmpdir_path, "flags.jsonl"), "w") as f:
        for flag in (whole, {**whole, "entry": {}}, {**whole, "entry": {"timestamp_ns": 1, "source": "s"}}):
            f.write(json.dumps(flag) + "\n")
    good, counts = store.read_flags_jsonl(spark, tmpdir_path)
    assert good.count() == 1 and {r.outcome: r.n for r in counts.collect()} == {"loaded": 1, "malformed": 2}
