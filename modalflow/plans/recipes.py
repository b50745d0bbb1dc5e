"""Whole runs: result tables for export, summaries, dashboard panels and the laboratory recipes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalflow.functions import generators
from modalflow.functions import kernels as k
from modalflow.operators import regulatory as rg
from modalflow.plans import engine, governance
from modalflow.sources import scans, sinks

#: The state-space measures that a report lists.
DIAGNOSTICS = (
    "spectral_radius", "is_stable", "log_likelihood", "mean_log_likelihood", "innovation_rmse", "mean_filtered_trace", "mean_shock_energy", "confidence",
)


def result_tables(out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four export tables of `engine.analyse`, of every series at once: summary, resonance_map, rooting_edges, state_space_diagnostics."""
    found = out["resonances"].groupBy("series", "dim").agg(
        F.max_by("freq", -F.col("rank")).alias("dominant_frequency"), F.count(F.lit(1)).alias("detected_frequency_count"),
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "freq"))), lambda x: x["freq"])).alias("detected_frequencies"),
    )
    depths = out["depths"].groupBy("series").agg(F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"), F.count(F.lit(1)).cast("double").alias("dimensions"))
    edges = out.get("edges")
    if edges is not None:
        counts = edges.groupBy("series").agg(F.count(F.lit(1)).cast("double").alias("edges"))
        depths = depths.join(counts, "series", "left").withColumn("edges", F.coalesce("edges", F.lit(0.0)))
    measures = [c for c in depths.columns if c != "series"]
    tables = {
        "summary": depths.unpivot(["series"], measures, "metric", "value"),
        "resonance_map": out["depths"].select("series", "dim", "depth").join(found, ["series", "dim"], "left").select(
            "series", F.col("dim").alias("dimension"), "depth", F.coalesce("dominant_frequency", F.lit(0.0)).alias("dominant_frequency"),
            F.coalesce("detected_frequency_count", F.lit(0)).alias("detected_frequency_count"), F.coalesce("detected_frequencies", F.lit("[]")).alias("detected_frequencies"),
        ),
    }
    if edges is not None:
        tables["rooting_edges"] = edges.select("series", F.col("src").alias("source"), F.col("dst").alias("target"), "weight", "lag", F.col("p").alias("p_value"))
    if "states" in out:
        tables["state_space_diagnostics"] = out["states"].where("kind = 'diag'").select("series", F.col("name").alias("diagnostic"), "value")
    return tables


def summary(tables: dict[str, DataFrame], audience: str, series: str) -> dict:
    """Headline, figures, next step and caveat of one series, from its rows of the export tables."""
    of = {name: df.where(F.col("series") == series).collect() for name, df in tables.items()}
    value = {r["metric"]: r["value"] for r in of["summary"]}
    diagnostics = {r["diagnostic"]: r["value"] for r in of.get("state_space_diagnostics", [])}
    stable = diagnostics.get("is_stable")
    edges = int(value.get("edges", 0))
    depth = value.get("max_depth", 0.0)
    headline = f"{series}: largest depth {governance.four(depth)}, {edges} directed edge{'s' * (edges != 1)}"
    step = "Check the window and sampling rate, then repeat with surrogates." if not edges else "Test the leading edges on a later sample."
    return governance.drop_empty({
        "headline": headline, "mean_depth": value.get("mean_depth"), "max_depth": depth, "rooted": edges > 0, "edges": edges,
        "stable": None if stable is None else bool(stable), "next_step": step, "caveat": governance.CAVEATS[audience],
    })


def report(tables: dict[str, DataFrame], audience: str, series: str, card: dict | None = None) -> tuple[dict, str]:
    """(report as plain values, Markdown) of one series; supervisors also get the alignment and the readiness packet."""
    rows = {name: [r.asDict() for r in df.where(F.col("series") == series).drop("series").collect()] for name, df in tables.items()}
    modes = [{"dim": r["dimension"], "f0": r["dominant_frequency"], "depth": r["depth"]} for r in sorted(rows["resonance_map"], key=lambda r: r["dimension"])]
    edges = [{"src": r["source"], "dst": r["target"], "lag": r["lag"], "weight": r["weight"]} for r in sorted(rows.get("rooting_edges", []), key=lambda r: -r["weight"])]
    diagnostics = {r["diagnostic"]: r["value"] for r in rows.get("state_space_diagnostics", []) if r["diagnostic"] in DIAGNOSTICS}
    head = summary(tables, audience, series)
    text = governance.markdown(audience, modes, edges, diagnostics)
    if audience == "supervision":
        packet = governance.readiness(card or governance.model_card(series, "early warning"), head)
        text += "\n".join(["## Validation readiness", "", f"- status: {packet['status']}", *(f"- {c.replace('_', ' ')}" for c in packet["checklist"]), ""])
    return {"summary": head, "tables": rows}, text


def dashboard(panel: DataFrame, depths: DataFrame, edges: DataFrame, bps: list[float]) -> dict[str, DataFrame]:
    """One table per panel of a supervisor's dashboard: dial, graph, map by country, series over time, modes side by side, figures."""
    shocked = rg.with_depth(rg.rate_shock(panel, bps), depths)
    top = shocked.agg(F.max("depth").alias("value"))
    kpis = shocked.agg(
        F.max("depth").alias("max_depth"), F.countDistinct(F.when(F.col("depth") > rg.RED, F.col("rssd_id"))).cast("double").alias("banks_above_threshold"),
        F.sum(F.col("breach").cast("double")).alias("breaches"), F.avg("shocked_ratio").alias("mean_shocked_ratio"),
    )
    return {
        "dial": top.withColumns({"amber": F.lit(rg.AMBER), "red": F.lit(rg.RED), "status": rg.status(F.col("value"))}),
        "graph": edges.select("src", "dst", "weight", "lag", "p"),
        "map": shocked.groupBy("hub_country").agg(F.max("depth").alias("depth"), F.avg("shocked_ratio").alias("mean_ratio"), F.sum(F.col("breach").cast("int")).alias("breaches"), F.countDistinct("rssd_id").alias("banks")),
        "over_time": shocked.groupBy("report_date").agg(F.avg("depth").alias("depth"), F.avg("shocked_ratio").alias("ratio")),
        "modes": shocked.groupBy("rssd_id", "shock_bps").pivot("aoci_mode", list(rg.MODES)).agg(F.avg("shocked_ratio")),
        "figures": kpis.unpivot([], kpis.columns, "figure", "value"),
    }


def physics_lab(spark: SparkSession, seed: int = 2026) -> dict[str, DataFrame]:
    """Five seconds of a coupled oscillator with noise 0.04, through the core analysis to its export tables."""
    x = generators.coupled_oscillator(n=1000, noise=0.04, seed=seed)
    pdf = pd.DataFrame({"series": "oscillator", "dim": np.tile(np.arange(3, dtype=np.int32), len(x)), "t": np.repeat(np.arange(len(x), dtype=np.int32), 3), "v": x.ravel()})
    signal = spark.createDataFrame(pdf, "series string, dim int, t int, v double")
    c = engine.Config(embedding=3, tau=2, fs=200.0, method="welch", ratio=0.2, window=256, seed=42, horizon=16)
    return result_tables(engine.analyse(signal, c))


def state_space_lab(n: int = 400, draws: int = 500, particles: int = 2000, seed: int = 0) -> dict[str, float]:
    """Fit, filter, smoother, posterior band, both likelihoods from the stationary start, and a particle filter that sees the energy only."""
    y = generators.damped_rotation(n, seed)
    m = k.fit_var(y)
    f = k.kalman(m, y)
    s, p = k.koopman(m, y, f)
    rng = np.random.default_rng(seed)
    low, high = np.quantile([k.durbin_koopman(m, y, rng) for _ in range(draws)], [0.05, 0.95], axis=0)
    mean, cov = k.stationary(m)
    full = k.kalman(m, y, mean, cov).loglik.sum()
    energy = (y**2).sum(1, keepdims=True)
    linear = k.linear_as_nonlinear(m)
    seen = k.Nonlinear(linear.move, lambda x: (x**2).sum(1, keepdims=True), m.Q, np.array([[max(1e-6, 0.01 * float(energy.var()))]]))
    run = k.particle_filter(seen, energy, mean, particles, seed, p0=cov)
    return m.diagnostics() | k.smoother_summary(m, s, p) | {f"particle_{c}": v for c, v in k.particle_summary(run).items()} | {
        "log_likelihood": float(f.loglik.sum()), "band_width": float((high - low).mean()), "band_cover": float(((s >= low) & (s <= high)).mean()),
        "likelihood_gap": float(abs(k.chandrasekhar(m, y).sum() - full)),
    }


def sensor_summary(samples: DataFrame) -> DataFrame:
    """activity_name, rows, duration (seconds), subjects: what a sensor file holds."""
    return samples.groupBy("activity_name").agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) / scans.SENSOR_HZ).alias("duration"), F.countDistinct("subject_id").alias("subjects")
    )


def sensor_pipeline(spark: SparkSession, folder: str, target: str, split: str = "train", max_samples: int | None = None) -> list[str]:
    """Windows to features to CSV, with a summary by activity beside them; the paths that were written."""
    samples = scans.sensor_windows(spark, folder, split, max_samples)
    return sinks.write_csv({"processed": scans.sensor_features(samples), "summary": sensor_summary(samples)}, target, f"sensor_{split}", {"split": split})
