"""Relational operators against kernels, recorded values and hand-made cases."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modalflow.functions import generators
from modalflow.functions import kernels as k
from modalflow.operators import backtest, depth, prep, rooting, spectral
from modalflow.operators import regulatory as rg
from modalflow.plans import engine, governance
from modalflow.sources import scans


def signal(spark, x, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(x)], "series string, t int, v double")


def test_relational_spectra_equal_kernels(spark):
    x = generators.coupled_oscillator()[:, 0]
    got = spectral.fft_spectrum(signal(spark, x), 200.0).orderBy("bin").toPandas()
    assert np.allclose(got["value"], k.fft_spectrum(x, 200.0)[1], atol=1e-9)
    psd = spectral.welch(spectral.segments(signal(spark, x)), ["series"], 200.0).orderBy("bin").toPandas()
    assert np.allclose(psd["value"], k.welch(x, 200.0)[1], atol=1e-12)


def test_relational_depth_equals_the_recorded_one(spark):
    x = generators.coupled_oscillator()[:, 0]
    got = depth.depth(signal(spark, x), 256, 200.0).first()
    want = k.depth(x, 256, 200.0)
    assert got["depth"] == pytest.approx(0.9042969836929234, abs=1e-9)
    assert all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)


def test_short_series_has_no_depth(spark):
    assert depth.depth(signal(spark, [1.0, 2.0]), 8).first()["depth"] == 0.0


def test_recorded_edges(spark):
    x = generators.coupled_oscillator()
    long = spark.createDataFrame([(f"dim_{d}", t, float(x[t, d])) for t in range(800) for d in range(3)], "series string, t int, v double")
    dims = ["dim_0", "dim_1", "dim_2"]
    s = rooting.lagged_correlation(rooting.widen(long, dims), dims, 4)
    e = {(r["src"], r["dst"]): r for r in rooting.edges(rooting.surrogate_p(s, long, dims, 4, 25, 42)).collect()}
    assert set(e) == {("dim_0", "dim_1"), ("dim_1", "dim_0")}
    assert e["dim_0", "dim_1"]["weight"] == pytest.approx(0.9975467078733149, abs=1e-9) and e["dim_0", "dim_1"]["lag"] == 2
    assert e["dim_1", "dim_0"]["weight"] == pytest.approx(0.6697535963489816, abs=1e-9) and e["dim_1", "dim_0"]["lag"] == 4
    assert e["dim_0", "dim_1"]["p"] == pytest.approx(1 / 26)


def test_core_analysis_gives_the_edges_of_every_series(spark):
    """The recorded edges, next to a series of noise that has the loose edges and one of one dimension that is embedded."""
    x = generators.coupled_oscillator()
    noise = np.random.default_rng(3).standard_normal((800, 3))
    rows = [(name, d, t, float(m[t, d])) for name, m in (("osc", x), ("noise", noise)) for t in range(800) for d in range(3)]
    rows += [("flat", 0, t, float(np.sin(t / 3))) for t in range(120)]
    signal = spark.createDataFrame(rows, "series string, dim int, t int, v double")
    c = engine.Config(fs=200.0, ratio=0.2, window=256, surrogates=25, seed=42, max_lag=4, method="welch")
    out = engine.analyse(signal, c)
    assert set(out) == {"resonances", "depths", "beliefs", "scores", "edges", "states"}
    scores = {(r["series"], r["src"], r["dst"]): r for r in out["scores"].collect()}
    assert sum(k_[0] == "osc" for k_ in scores) == 9 and all(r["p"] == 1 for k_, r in scores.items() if k_[1] == k_[2])
    edges = {(r["series"], r["src"], r["dst"]): r for r in out["edges"].collect()}
    osc = {k_[1:]: r for k_, r in edges.items() if k_[0] == "osc"}
    assert set(osc) == {("0", "1"), ("1", "0")}
    assert osc["0", "1"]["weight"] == pytest.approx(0.9975467078733149, abs=1e-9) and osc["0", "1"]["lag"] == 2 and osc["0", "1"]["p"] == pytest.approx(1 / 26)
    assert all(r["p"] is None or r["p"] <= 0.05 for r in edges.values()) and any(k_[0] == "flat" for k_ in edges)
    plain = engine.analyse(signal, engine.Config(fs=200.0, window=256, surrogates=0, state_space=False))["scores"].collect()
    assert {r["p"] for r in plain} <= {0.0, 1.0}
    with pytest.raises(ValueError):
        engine.Config(max_lag=0)


def test_merge_keeps_repeated_rows_and_the_short_way_refuses_them(spark):
    cols = "rssd_id string, report_date date, "
    day = datetime.date(2020, 3, 31)
    liq = spark.createDataFrame([("1", day, 1.0, 2.0), ("2", day, 3.0, None)], cols + "ral_overnight_repo double, ral_term_repo double")
    sec = spark.createDataFrame([("1", day, 5.0, 6.0), ("3", day, 7.0, 8.0)], cols + "hc_b_afs_securities double, hc_b_htm_securities double")
    cap = spark.createDataFrame([("1", day, 9.0), ("1", day, 10.0)], cols + "hc_r_cet1 double")
    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    every = rg.merge(liq, sec, cap)
    assert every.count() == 4 and sorted(r["hc_r_cet1"] for r in every.where("rssd_id = '1'").collect()) == [9.0, 10.0]
    assert key(rg.merge_unique(liq, sec, cap.limit(1))) == key(rg.merge(liq, sec, cap.limit(1)))
    with pytest.raises(Exception, match="more than once"):
        rg.merge_unique(liq, sec, cap).collect()
    none = spark.createDataFrame([(None, day, 1.0)], cols + "hc_r_cet1 double")
    with pytest.raises(Exception, match="null"):
        rg.merge_unique(liq, sec, none).collect()


def test_constant_columns_score_nothing(spark):
    long = spark.createDataFrame([(d, t, 1.0 if d == "b" else float(t % 5)) for t in range(30) for d in "ab"], "series string, t int, v double")
    s = rooting.lagged_correlation(rooting.widen(long, ["a", "b"]), ["a", "b"], 2)
    assert {r["score"] for r in s.collect()} == {0.0}


def test_backtest_golden(spark):
    score = [0.1, 0.9, 0.2, 0.8, 0.3, 0.0, 0.85, 0.1, 0.0, 0.0]
    df = spark.createDataFrame([("x", i, s, i in (4, 8)) for i, s in enumerate(score)], "id string, t int, score double, event boolean")
    r = backtest.summary(backtest.matched(df, ["id"], "t", "score", "event", 0.75, 2), ["id"], "event").first()
    assert (r["alerts"], r["true_positives"], r["false_positives"], r["detected"], r["missed"]) == (3, 2, 1, 2, 0)
    assert (r["precision"], r["recall"], r["mean_lead"]) == (pytest.approx(2 / 3), 1.0, 1.5)


def test_prep_rules(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, "2"), ("a", 2, "x"), ("a", 3, "8"), ("b", 0, "5"), ("b", 1, "5"), ("b", 2, "5")], "id string, t int, v string")
    filled = prep.clean(df, ["id"], "t", ["v"], z=False).orderBy("id", "t").toPandas()
    assert filled["v"].tolist() == [2.0, 2.0, 5.0, 8.0, 5.0, 5.0, 5.0]
    z = prep.clean(df, ["id"], "t", ["v"]).where("id = 'b'").toPandas()
    assert z["v"].tolist() == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        prep.clean(df, ["id"], "t", ["v"], "cube")
    with pytest.raises(ValueError):
        prep.require(df, ["nope"])


def test_log_diff_needs_positive_values(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, -1.0), ("a", 2, 1.0)], "id string, t int, v double")
    with pytest.raises(Exception, match="positive"):
        prep.transform(df, ["id"], "t", ["v"], "log_diff").collect()


def test_merge_keeps_rows_of_any_schedule(spark):
    key = "rssd_id string, report_date date"
    d = pd.Timestamp("2020-03-31").date()
    liq = spark.createDataFrame([("1", d, "A", "GB", 1.0, 2.0, 3.0)], key + ", legal_name string, hub_country string, ral_overnight_repo double, ral_eurusd_borr double, ral_term_repo double")
    sec = spark.createDataFrame([("2", d, 1.0, 1.0, 5.0, 5.0)], key + ", hc_b_afs_securities double, hc_b_htm_securities double, hc_b_afs_duration double, hc_b_htm_duration double")
    cap = spark.createDataFrame([("1", d, 6.5, 0.0, 0.1), ("3", d, 6.5, 100.0, 0.1)], key + ", hc_r_cet1 double, hc_r_rwa double, hc_r_aoci double")
    one, two = (f(liq, sec, cap) for f in (rg.merge_unique, rg.merge))
    assert sorted(map(str, one.select(*two.columns).collect())) == sorted(map(str, two.collect()))
    assert one.count() == 3 and rg.unique_on_key(cap)
    shock = rg.rate_shock(one, [200.0]).where("aoci_mode = 'opt_out'").collect()
    assert {r["rssd_id"]: (r["shocked_ratio"], r["breach"]) for r in shock} == {"1": (None, False), "2": (None, False), "3": (0.065, False)}


def test_sources(spark, tmp_path):
    rows = "\n".join(f"2020-0{q}-01,{b},g,{q + i}.5" for q in range(1, 7) for i, b in enumerate("ab"))
    (tmp_path / "p.csv").write_text("date,bank,grp,x\n" + rows)
    ds = scans.from_csv(spark, str(tmp_path / "p.csv"), "date", entity="bank", peer_group="grp", how="diff")
    assert ds.values == ("x",) and ds.frame.count() == 12 and ds.institution("a").frame.count() == 6
    assert ds.peers("g").frame.count() == 6 and ds.tidy().columns[-2:] == ["metric", "value"] and ds.signal().count() == 12
    spark.read.csv(str(tmp_path / "p.csv"), header=True).createOrReplaceTempView("panel")
    assert scans.schedule(spark, "SELECT * FROM panel WHERE date BETWEEN :start_date AND :end_date", "2020-01-01", "2020-02-01").count() == 4
    with pytest.raises(ValueError):
        ds.institution("zz")
    assert scans.from_config(spark, {"system": "rossler", "data": {"n": 20}}).count() == 60


def test_sensor_windows(spark, tmp_path):
    d = tmp_path / "train" / "Inertial Signals"
    d.mkdir(parents=True)
    (tmp_path / "train" / "y_train.txt").write_text("1\n5\n")
    (tmp_path / "train" / "subject_train.txt").write_text("7\n8\n")
    for i, s in enumerate(scans.SIGNALS):
        (d / f"{s}_train.txt").write_text("\n".join(" ".join(str((w + 1) * (i + 1) + j % 7) for j in range(128)) for w in range(2)) + "\n")
    got = scans.sensor_windows(spark, str(tmp_path))
    assert got.count() == 256 and scans.sensor_windows(spark, str(tmp_path), max_samples=128).count() == 128
    r = got.where("window_id = 1 and sample = 3").first()
    assert (r["timestamp"], r["activity_name"], r["body_acc_x"]) == (131, "STANDING", 5.0)
    f = scans.sensor_features(got)
    assert f.agg(F.avg("body_acc_x")).first()[0] == pytest.approx(0, abs=1e-9) and "acc_gyro_product" in f.columns


def test_governance():
    with pytest.raises(ValueError):
        governance.shadow_record("a", "odd")
    with pytest.raises(ValueError):
        governance.alignment("g_sib", ["weather"])
    text = governance.markdown("supervision", [{"dim": 0, "depth": 0.5, "f0": None}], [], {"spectral_radius": 0.5})
    assert "n/a" in text and "No significant directed edges." in text and "0.5000" in text
    e = governance.explanation([{"dim": 1, "depth": 0.2}, {"dim": 0, "depth": 0.9}], [{"src": "0", "dst": "1"}], ["a", "b"])
    assert [m["name"] for m in e["modes"]] == ["a", "b"] and e["edges"][0]["dst"] == "b"


def test_leads_over_chunks_equal_one_window(spark):
    """A keyless series with gaps in t, cut to chunks of 4 rows, gives the rows of one window over all."""
    rows = [(t, float(t * t % 17), None if t % 5 == 0 else float(t)) for t in range(-9, 60) if t % 7 != 3]
    wide = spark.createDataFrame(rows, "t int, d0 double, d1 double")
    want = []
    for i, r in enumerate(rows):
        later = [[rows[i + k][c] if i + k < len(rows) else None for k in (1, 2, 3)] for c in (1, 2)]
        want.append((*r[1:], *later[0], *later[1]))
    got = [tuple(r) for r in rooting._leads(wide, ["d0", "d1"], 3, (), size=4).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rooting._leads(wide.limit(0), ["d0"], 3, ()).count() == 0
