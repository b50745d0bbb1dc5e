"""Resonance depth: four components of the last `window` samples of each series, all relational."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalflow.functions import kernels
from modalflow.functions.columns import EPS, clip
from modalflow.operators.spectral import dft, segments, welch, with_length

WEIGHTS = {"sc": 0.35, "tp": 0.25, "pc": 0.25, "amp": 0.15}


def finite(signal: DataFrame) -> DataFrame:
    """Rows with finite values, numbered anew from 0."""
    ok = signal.where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    return ok.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("t")) - 1)


def trailing(signal: DataFrame, window: int) -> DataFrame:
    """The last `window` samples of each series that has so many, numbered from 0."""
    n = with_length(signal, "series").drop("mean")
    return n.where(F.col("n") >= window).where(F.col("t") >= F.col("n") - window).withColumn("t", (F.col("t") - F.col("n") + window).cast("int")).drop("n")


def _argmax(psd: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f: the frequency above 0 of the largest density, the first of equal ones."""
    return psd.where("freq > 0").groupBy(*keys).agg(F.max_by("freq", F.struct("value", -F.col("bin"))).alias("f"))


def concentration(psd: DataFrame, target: DataFrame) -> DataFrame:
    """series, sc: share of the density in the three bins around the target."""
    near = psd.join(target, "series")
    mid = near.groupBy("series").agg(F.min_by("bin", F.struct(F.abs(F.col("freq") - F.col("f0")), "bin")).alias("mid"))
    band = near.join(mid, "series").groupBy("series").agg(
        F.sum(F.when(F.abs(F.col("bin") - F.col("mid")) <= 1, F.col("value"))).alias("band"), F.sum(F.when(F.col("freq") > 0, F.col("value"))).alias("total"),
        F.max(F.when(F.col("freq") > 0, F.col("value"))).alias("top"), F.first("f0").alias("f0"),
    )
    part = F.when(F.col("f0") <= 0, F.col("top")).otherwise(F.col("band"))
    return band.select("series", F.when(F.col("total") <= EPS, F.lit(0.0)).otherwise(clip(part / F.col("total"), 0.0, 1.0)).alias("sc"))


def persistence(signal: DataFrame, target: DataFrame, window: int, fs: float) -> DataFrame:
    """series, tp: how near each segment's strongest frequency is to the target, over the whole series."""
    n = with_length(signal, "series").withColumnRenamed("n", "total").drop("mean")
    size = F.least(F.lit(window), F.greatest(F.lit(32), F.floor(F.col("total") / 4))).cast("long")
    part = (
        n.withColumn("size", size).withColumn("part", F.floor(F.col("t") / F.col("size"))).where((F.col("part") + 1) * F.col("size") <= F.col("total"))
        .select(F.col("series"), F.col("part"), (F.col("t") - F.col("part") * F.col("size")).alias("t"), "v", "size")
    )
    as_series = part.withColumn("series", F.struct("series", "part")).select("series", "t", "v", "size")
    psd = welch(segments(as_series.select("series", "t", "v")), ["series"], fs)
    strongest = _argmax(psd, ["series"]).select("series.series", "f")
    width = as_series.groupBy("series.series").agg(F.max("size").alias("size"))
    score = F.exp(-(((F.col("f") - F.col("f0")) / F.greatest(F.lit(fs) / F.col("size"), F.lit(0.5))) ** 2))
    return strongest.join(width, "series").join(target, "series").groupBy("series").agg(clip(F.avg(score), 0.0, 1.0).alias("tp"))


def envelope(window_rows: DataFrame) -> DataFrame:
    """series, n, t, re, im: the analytic signal of the centred window, by a transform and its one-sided inverse."""
    x = with_length(window_rows, "series").withColumn("x", F.col("v") - F.col("mean"))
    spectrum = dft(x, ["series"])
    once = (F.col("bin") == 0) | (F.col("bin") * 2 == F.col("n"))
    m = F.when(once, 1.0).otherwise(2.0) / F.col("n")
    a = F.lit(2 * math.pi) * (F.pmod(F.col("bin") * F.col("t"), F.col("n")) / F.col("n"))
    return (
        spectrum.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .groupBy("series", "n", "t").agg(F.sum(m * (F.col("re") * F.cos(a) - F.col("im") * F.sin(a))).alias("re"), F.sum(m * (F.col("re") * F.sin(a) + F.col("im") * F.cos(a))).alias("im"))
    )


def phase_and_amplitude(window_rows: DataFrame, target: DataFrame, fs: float) -> DataFrame:
    """series, pc (phase coherence), amp (amplitude stability)."""
    z = envelope(window_rows).join(target, "series").withColumn("r", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))
    turn = F.atan2("im", "re") - F.lit(2 * math.pi) * F.col("f0") * F.col("t") / fs
    g = z.groupBy("series").agg(
        F.avg(F.cos(turn)).alias("c"), F.avg(F.sin(turn)).alias("s"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.first("f0").alias("f0")
    )
    return g.select(
        "series", F.when(F.col("f0") <= 0, 0.0).otherwise(clip(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2), 0.0, 1.0)).alias("pc"),
        F.when(F.col("mean") <= EPS, 0.0).otherwise(clip(1 - F.col("sd") / F.col("mean"), 0.0, 1.0)).alias("amp"),
    )


def depth(signal: DataFrame, window: int, fs: float = 1.0, frequencies: DataFrame | None = None) -> DataFrame:
    """series, depth, sc, tp, pc, amp, ci_lo, ci_hi, f0, legacy_std; zeros where a series is shorter than the window.

    `frequencies` (series, f0) names targets; without it the target is the window's strongest frequency.
    """
    if window <= 0 or fs <= 0:
        raise ValueError("window and sampling rate must be positive")
    clean = finite(signal)
    last = trailing(clean, window)
    psd = welch(segments(last), ["series"], fs)
    target = _argmax(psd, ["series"]).withColumnRenamed("f", "f0") if frequencies is None else frequencies.where("f0 > 0")
    parts = (
        target.join(concentration(psd, target), "series").join(persistence(clean, target, window, fs), "series", "left")
        .join(phase_and_amplitude(last, target, fs), "series").join(last.groupBy("series").agg(F.stddev_samp("v").alias("legacy_std")), "series")
        .withColumn("tp", F.coalesce("tp", F.lit(0.0)))
    )
    d = clip(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 0.0, 1.0)
    half = clip(1.96 * F.sqrt(F.greatest(F.col("depth") * (1 - F.col("depth")), F.lit(0.0)) / max(4, window // 32)), 0.02, 0.25)
    scored = parts.withColumn("depth", d).withColumn("ci_lo", clip(F.col("depth") - half, 0.0, 1.0)).withColumn("ci_hi", clip(F.col("depth") + half, 0.0, 1.0))
    names = ["depth", "sc", "tp", "pc", "amp", "ci_lo", "ci_hi", "f0", "legacy_std"]
    return signal.select("series").distinct().join(scored, "series", "left").select("series", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


def depth_by_kernel(signal: DataFrame, keys: list[str], window: int, fs: float = 1.0, frequencies: DataFrame | None = None) -> DataFrame:
    """As `depth`, one task per series with fast transforms: one shuffle, and the way for many or long series."""
    if window <= 0 or fs <= 0:
        raise ValueError("window and sampling rate must be positive")
    rows = signal.select(*keys, "t", "v")
    rows = rows.withColumn("f0", F.lit(None).cast("double")) if frequencies is None else rows.join(frequencies.select(*keys, "f0"), keys, "left")
    kinds = ", ".join(f"{k} {signal.schema[k].dataType.simpleString()}" for k in keys)
    names = ("depth", "sc", "tp", "pc", "amp", "ci_lo", "ci_hi", "f0", "legacy_std")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f0 = pdf["f0"].iloc[0]
        d = kernels.depth(pdf.sort_values("t")["v"].to_numpy(float), window, fs, None if pd.isna(f0) else float(f0))
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), **d}])

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in names))


def belief(depths: DataFrame, keys: list[str], order: str, value: str = "depth", prior: float = 0.5, rate: float = 0.1) -> DataFrame:
    """keys, belief, is_rooted: the prior moved by each depth in turn."""
    start = min(0.99, max(0.01, prior))
    steps = F.array_sort(F.collect_list(F.struct(order, value)))
    slope = 2 * math.log(9)

    def move(b, x):
        likelihood = 1 / (1 + F.exp(-slope * (x[value] - 0.5)))
        return F.greatest(F.lit(0.01), F.least(F.lit(0.99), b + rate * (likelihood - b)))

    rows = depths if keys else depths.withColumn("_all", F.lit(1))
    out = rows.groupBy(*(keys or ["_all"])).agg(F.aggregate(steps, F.lit(start), move).alias("belief"))
    return out.withColumn("is_rooted", F.col("belief") > 0.65).drop("_all")
