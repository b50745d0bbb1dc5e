"""Synthetic systems: each row of a parameter table becomes one series, made in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _euler(f, start, dt: float, n: int) -> np.ndarray:
    out = np.empty((n, len(start)))
    out[0] = start
    for t in range(1, n):
        out[t] = out[t - 1] + dt * np.array(f(*out[t - 1]))
    return out


def lorenz(n: int, dt: float = 0.01, seed: int = 0) -> np.ndarray:
    return _euler(lambda x, y, z: (10 * (y - x), x * (28 - z) - y, x * y - 8 / 3 * z), (1.0, 1.0, 1.0), dt, n)


def rossler(n: int, dt: float = 0.01, seed: int = 0) -> np.ndarray:
    return _euler(lambda x, y, z: (-y - z, x + 0.2 * y, 0.2 + z * (x - 5.7)), (1.0, 1.0, 1.0), dt, n)


def fitzhugh_nagumo(n: int, dt: float = 0.01, seed: int = 0, current: float = 0.5) -> np.ndarray:
    return _euler(lambda v, w: (v - v**3 / 3 - w + current, 0.08 * (v + 0.7 - 0.8 * w)), (0.0, 0.0), dt, n)


def heston(n: int, dt: float = 0.01, seed: int = 0) -> np.ndarray:
    """Price and variance; the variance does not go under 0."""
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, 2))
    z[:, 1] = -0.7 * z[:, 0] + np.sqrt(1 - 0.49) * z[:, 1]
    out = np.empty((n, 2))
    s, v = 100.0, 0.04
    for t in range(n):
        out[t] = s, v
        s *= np.exp((0.05 - v / 2) * dt + np.sqrt(v * dt) * z[t, 0])
        v = max(0.0, v + 2 * (0.04 - v) * dt + 0.2 * np.sqrt(v * dt) * z[t, 1])
    return out


def coupled_oscillator(n: int = 800, fs: float = 200.0, f: float = 12.5, lag: int = 2, noise: float = 0.05, seed: int = 42) -> np.ndarray:
    """A source with its second harmonic, a target that follows it by `lag` samples, and a distractor."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) / fs
    source = np.sin(2 * np.pi * f * t) + 0.2 * np.sin(4 * np.pi * f * t) + noise * rng.normal(size=n)
    target = np.roll(source, lag) + noise * rng.normal(size=n)
    target[:lag] = noise * rng.normal(size=lag)
    return np.column_stack([source, target, rng.normal(scale=0.4, size=n)])


def damped_rotation(n: int = 400, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    m = 0.97 * np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    out = np.zeros((n, 2))
    for t in range(1, n):
        out[t] = m @ out[t - 1] + 0.1 * rng.standard_normal(2)
    return out + 0.05 * rng.standard_normal((n, 2))


def physiological(n: int = 1000, fs: float = 50.0, seed: int = 0) -> np.ndarray:
    """A fast and a slow rhythm whose rate changes half way."""
    rng = np.random.default_rng(seed)
    rate = np.where(np.arange(n) < n // 2, 1.2, 1.8)
    beat = np.sin(2 * np.pi * np.cumsum(rate) / fs)
    breath = np.sin(2 * np.pi * 0.25 * np.arange(n) / fs)
    return np.column_stack([beat + 0.05 * rng.normal(size=n), breath + 0.05 * rng.normal(size=n)])


SYSTEMS = {"lorenz": lorenz, "rossler": rossler, "fitzhugh_nagumo": fitzhugh_nagumo, "heston": heston, "coupled_oscillator": coupled_oscillator, "damped_rotation": damped_rotation, "physiological": physiological}


def generate(params: DataFrame) -> DataFrame:
    """params(series, system, n, seed) to (series, dim, t, v)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        if r["system"] not in SYSTEMS:
            raise ValueError(f"unknown system {r['system']}; expected one of {', '.join(SYSTEMS)}")
        x = SYSTEMS[r["system"]](int(r["n"]), seed=int(r["seed"]))
        t, d = np.indices(x.shape)
        return pd.DataFrame({"series": r["series"], "dim": d.ravel(), "t": t.ravel(), "v": x.ravel()})

    return params.groupBy("series").applyInPandas(run, "series string, dim int, t int, v double")


def two_tones(spark: SparkSession, n: int, fs: float) -> DataFrame:
    """t, v: a tone of 1.2 Hz and half of one of 0.25 Hz, without Python."""
    s = F.col("id") / fs
    return spark.range(n).select(F.col("id").cast("int").alias("t"), (F.sin(2 * np.pi * 1.2 * s) + 0.5 * F.sin(2 * np.pi * 0.25 * s)).alias("v"))


def supervisory_panel(spark: SparkSession, institutions: int = 4, quarters: int = 96, seed: int = 407) -> DataFrame:
    """institution_id, peer_group, date and five ratios that share a cycle; made per institution, without a driver loop."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["id"].iloc[0])
        rng = np.random.default_rng([seed, k])
        q = np.arange(quarters)
        cycle = np.sin(2 * np.pi * q / 16 + k)
        return pd.DataFrame({
            "institution_id": f"BANK_{k}", "peer_group": "large" if k % 2 else "regional", "q": q,
            "liquidity_ratio": 1.1 + 0.1 * cycle + 0.02 * rng.normal(size=quarters), "capital_ratio": 0.12 + 0.01 * np.roll(cycle, 2) + 0.002 * rng.normal(size=quarters),
            "funding_spread": 0.8 - 0.2 * cycle + 0.05 * rng.normal(size=quarters), "asset_growth": 0.03 + 0.01 * np.roll(cycle, 4) + 0.004 * rng.normal(size=quarters),
            "controls_risk_proxy": 0.4 + 0.05 * rng.normal(size=quarters),
        })

    ratios = "liquidity_ratio double, capital_ratio double, funding_spread double, asset_growth double, controls_risk_proxy double"
    made = spark.range(institutions).groupBy("id").applyInPandas(run, f"institution_id string, peer_group string, q int, {ratios}")
    return made.withColumn("date", F.add_months(F.lit("2000-01-01").cast("date"), 3 * F.col("q"))).drop("q")


def policy_frame(spark: SparkSession, quarters: int = 120, seed: int = 99) -> DataFrame:
    """date, inflation, output_gap, policy_rate: a rate that follows the other two; the sixth inflation is missing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        q = np.arange(quarters)
        gap = np.sin(2 * np.pi * q / 24) + 0.1 * rng.normal(size=quarters)
        inflation = 2 + 0.5 * np.roll(gap, 2) + 0.1 * rng.normal(size=quarters)
        rate = 1 + 1.5 * np.roll(inflation, 1) + 0.5 * gap
        inflation[min(5, quarters - 1)] = np.nan
        return pd.DataFrame({"q": q, "inflation": inflation, "output_gap": gap, "policy_rate": rate})

    made = spark.range(1).groupBy("id").applyInPandas(run, "q int, inflation double, output_gap double, policy_rate double")
    return made.withColumn("date", F.add_months(F.lit("2000-01-01").cast("date"), 3 * F.col("q"))).drop("q")


def schedule_panel(spark: SparkSession, banks: int = 5, quarters: int = 40) -> DataFrame:
    """rssd_id, report_date and the merged schedules' measures, without Python: levels that grow by bank and year."""
    q = spark.range(banks).select(F.col("id").alias("b")).crossJoin(spark.range(quarters).select(F.col("id").alias("q")))
    date = F.last_day(F.add_months(F.lit("2012-01-01").cast("date"), (3 * F.col("q") + 2).cast("int")))
    level = 100.0 * (F.col("b") + 1) * (1 + 0.02 * (F.year("report_date") - 2012))
    named = q.select((F.col("b") + 1000).cast("string").alias("rssd_id"), date.alias("report_date"), "b", "q")
    return named.select(
        "rssd_id", "report_date", F.element_at(F.array(*map(F.lit, ("GB", "DE", "FR", "JP", "CH", "CA"))), (F.col("b") % 6 + 1).cast("int")).alias("hub_country"),
        *((level * f).alias(c) for c, f in (("ral_overnight_repo", 0.4), ("ral_eurusd_borr", 0.2), ("ral_term_repo", 0.1), ("hc_b_afs_securities", 1.5), ("hc_b_htm_securities", 1.0), ("hc_r_cet1", 0.9), ("hc_r_rwa", 9.0))),
        F.lit(4.5).alias("hc_b_afs_duration"), F.lit(6.0).alias("hc_b_htm_duration"), F.sin(F.col("q") / 4.0).alias("hc_r_aoci"),
    )
