"""Whole runs: export tables, reports, dashboard panels and the laboratories."""

import datetime
import json

import numpy as np
import pytest

from modalflow.functions import generators
from modalflow.functions import kernels as k
from modalflow.operators import regulatory as rg
from modalflow.plans import recipes
from modalflow.sources import scans, sinks


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.createDataFrame(df.collect(), df.schema).coalesce(1) for name, df in recipes.physics_lab(spark).items()}


def test_export_tables_of_the_physics_lab(tables, tmp_path):
    assert list(tables) == ["summary", "resonance_map", "rooting_edges", "state_space_diagnostics"]
    found = {r["dimension"]: r for r in tables["resonance_map"].collect()}
    assert found[0]["dominant_frequency"] == pytest.approx(12.5, abs=0.8) and found[0]["detected_frequency_count"] == len(json.loads(found[0]["detected_frequencies"]))
    edges = {(r["source"], r["target"]): r for r in tables["rooting_edges"].collect()}
    assert edges["0", "1"]["lag"] == 2 and edges["0", "1"]["p_value"] <= 0.05
    value = {r["metric"]: r["value"] for r in tables["summary"].collect()}
    assert value["dimensions"] == 3 and value["edges"] == len(edges) and 0 < value["mean_depth"] <= value["max_depth"] <= 1
    paths = sinks.write_csv(tables, str(tmp_path), "lab", {"window": 256, "tags": ["a"]})
    head = next((tmp_path / "lab_summary").glob("*.csv")).read_text().splitlines()[0]
    assert len(paths) == 4 and head == "series,metric,value,meta_tags,meta_window"


def test_reports_of_every_audience(tables, tmp_path):
    for audience in ("general", "physics", "policy", "supervision"):
        data, text = recipes.report(tables, audience, "oscillator")
        assert "## Resonance map" in text and ("## Validation readiness" in text) == (audience == "supervision")
        assert data["summary"]["rooted"] and data["summary"]["stable"] is not None
        sinks.write_report(str(tmp_path / audience), data, text)
        assert json.loads((tmp_path / f"{audience}.json").read_text())["summary"]["edges"] == data["summary"]["edges"]
    with pytest.raises((KeyError, ValueError)):
        recipes.report(tables, "nobody", "oscillator")


def test_plain_values():
    e, z = np.eye(2), np.zeros(2)
    m = k.System(0.5 * e, e, z, e, z, e, e)
    f = k.kalman(m, np.zeros((3, 2)))
    got = sinks.plain({"f": f, "set": {2, 1}, "day": datetime.date(2020, 1, 2), "bad": float("nan"), "n": np.int64(3), "deep": [(1, np.array([1.5]))]})
    assert "cov" not in got["f"] and len(got["f"]["state"]) == 3 and got["set"] == [1, 2]
    assert (got["day"], got["bad"], got["n"], got["deep"]) == ("2020-01-02", None, 3, [[1, [1.5]]])


def test_config_round_trip(spark, tmp_path):
    sinks.write_config(str(tmp_path / "a" / "c.json"), {"system": "rossler", "data": {"n": 20, "seed": 1}})
    assert scans.from_config(spark, json.loads((tmp_path / "a" / "c.json").read_text())).count() == 60


def test_dashboard_panels(spark):
    panel = generators.schedule_panel(spark)
    banks = sorted(r["rssd_id"] for r in rg.first_banks(panel, 2).collect())
    depths = spark.createDataFrame([(banks[0], 0.9)], "rssd_id string, depth double")
    edges = spark.createDataFrame([("a", "b", 0.7, 1, 0.04)], "src string, dst string, weight double, lag int, p double")
    out = recipes.dashboard(panel, depths, edges, [100.0, 200.0])
    assert set(out) == {"dial", "graph", "map", "over_time", "modes", "figures"}
    figures = {r["figure"]: r["value"] for r in out["figures"].collect()}
    assert figures["max_depth"] == 0.9 and figures["banks_above_threshold"] == 1
    assert out["dial"].first()["value"] == 0.9 and out["modes"].count() == 2 * panel.select("rssd_id").distinct().count()
    assert sum(r["banks"] for r in out["map"].collect()) == panel.select("rssd_id", "hub_country").distinct().count()


def test_state_space_lab():
    got = recipes.state_space_lab(n=120, draws=60, particles=500)
    assert got["is_stable"] == 1 and got["likelihood_gap"] < 1e-3 and got["band_cover"] > 0.95
    assert np.isfinite(got["particle_log_likelihood"]) and got["particle_min_ess"] > 1
