"""Spectra and peaks of long-format signals (series, t, v) with t = 0, 1, ... in each series.

Spectra are sums of v cos and v sin per frequency bin, so they are one aggregation
with map-side combine; each series' rows may lie in any number of partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalflow.functions.columns import EPS, angle, clip, hann


def with_length(signal: DataFrame, *keys: str) -> DataFrame:
    """signal with n and mean of its series: the totals are combined before the shuffle and joined back."""
    totals = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    return signal.join(totals, list(keys))


def dft(signal: DataFrame, keys: list[str], n: str = "n", x: str = "x", t: str = "t") -> DataFrame:
    """keys, n, bin, re, im for bins 0 to n / 2 of the column `x`."""
    a = angle(F.col("bin"), F.col(t), F.col(n))
    return (
        signal.select(*keys, n, t, x, F.explode(F.sequence(F.lit(0), F.floor(F.col(n) / 2).cast("int"))).alias("bin"))
        .groupBy(*keys, n, "bin").agg(F.sum(F.col(x) * F.cos(a)).alias("re"), F.sum(-F.col(x) * F.sin(a)).alias("im"))
    )


def fft_spectrum(signal: DataFrame, fs: float) -> DataFrame:
    """series, bin, freq, value: magnitudes of the centred signal's transform."""
    x = with_length(signal, "series").withColumn("x", F.col("v") - F.col("mean"))
    return dft(x, ["series"]).select("series", "bin", (F.col("bin") * fs / F.col("n")).alias("freq"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("value"))


def segments(signal: DataFrame, size: int = 256) -> DataFrame:
    """Half-overlapping segments: each row goes to the one or two that hold it. Adds n (segment length), seg, p (place)."""
    total = with_length(signal, "series").withColumnRenamed("n", "total").drop("mean")
    n = F.least(F.lit(size).cast("long"), F.col("total"))
    step = F.col("n") - F.floor(F.col("n") / 2)
    last = F.floor((F.col("total") - F.col("n")) / step)
    return (
        total.withColumn("n", n)
        .withColumn("seg", F.explode(F.array(F.floor(F.col("t") / step), F.floor(F.col("t") / step) - 1)))
        .withColumn("p", F.col("t") - F.col("seg") * step)
        .where((F.col("seg") >= 0) & (F.col("seg") <= last) & (F.col("p") < F.col("n")))
        .drop("total")
    )


def welch(parts: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """keys, bin, freq, value: mean density over parts(keys, seg, p, n, v), each detrended by its mean and Hann-windowed."""
    whole = [*keys, "seg"]
    means = parts.groupBy(*whole).agg(F.avg("v").alias("m"))
    w = hann(F.col("p"), F.col("n"))
    x = parts.join(means, whole).withColumn("x", (F.col("v") - F.col("m")) * w)
    # The squares of a periodic Hann window of n > 2 places sum to 3 n / 8.
    density = (F.col("re") ** 2 + F.col("im") ** 2) / (F.lit(fs) * F.col("n") * 0.375)
    once = (F.col("bin") == 0) | (F.col("bin") * 2 == F.col("n"))
    return (
        dft(x, whole, t="p").select(*keys, "n", "bin", F.when(once, density).otherwise(2 * density).alias("d"))
        .groupBy(*keys, "n", "bin").agg(F.avg("d").alias("value"))
        .select(*keys, "bin", (F.col("bin") * fs / F.col("n")).alias("freq"), "value")
    )


def peaks(spectrum: DataFrame, ratio: float = 0.1, positive: bool = False) -> DataFrame:
    """series, bin, freq, value, rank, confidence, noise_floor, prominence: strict interior maxima.

    A plateau counts at its middle bin. Kept are values of at least `ratio` times the largest.
    """
    by = Window.partitionBy("series").orderBy("bin")
    run = spectrum.withColumn("new", F.coalesce((F.col("value") != F.lag("value").over(by)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by))
    mins = run.withColumn("left", F.min("value").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "right", F.min("value").over(by.rowsBetween(0, Window.unboundedFollowing))
    )
    flat = mins.groupBy("series", "run").agg(
        F.first("value").alias("value"), F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.min("freq").alias("f_lo"), F.max("freq").alias("f_hi"),
        F.max("left").alias("left"), F.max("right").alias("right"),
    )
    stats = spectrum.groupBy("series").agg(F.max("value").alias("top"), F.median(F.when(F.col("freq") > 0, F.col("value"))).alias("noise_floor"))
    runs = Window.partitionBy("series").orderBy("run")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    freq = F.when(F.col("hi") == F.col("lo"), F.col("f_lo")).otherwise(F.col("f_lo") + (F.col("f_hi") - F.col("f_lo")) * (middle - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo")))
    found = (
        flat.withColumn("before", F.lag("value").over(runs)).withColumn("after", F.lead("value").over(runs))
        .where("value > before and value > after").join(stats, "series").where(F.col("value") >= ratio * F.col("top"))
        .select("series", middle.alias("bin"), freq.alias("freq"), "value", "noise_floor", (F.col("value") - F.greatest("left", "right")).alias("prominence"))
    )
    if positive:
        found = found.where("freq > 0")
    ranked = Window.partitionBy("series").orderBy(F.desc("value"), F.desc("bin"))
    best = F.max("value").over(Window.partitionBy("series"))
    return found.withColumn("rank", F.row_number().over(ranked)).withColumn(
        "confidence", clip((F.col("value") - F.col("noise_floor")) / F.greatest(best - F.col("noise_floor"), F.lit(EPS)), 0.0, 1.0)
    )


def refine_log(spectrum: DataFrame, found: DataFrame) -> DataFrame:
    """found with `refined`: a parabola through a peak and its neighbours on a geometric grid, moved by half a step at most."""
    by = Window.partitionBy("series").orderBy("bin")
    near = spectrum.where("freq > 0").select(
        "series", "bin", F.lag("value").over(by).alias("l"), F.lead("value").over(by).alias("r"),
        (F.log(F.nth_value("freq", 2).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) - F.log(F.first("freq").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).alias("step"),
    )
    bend = F.col("l") - 2 * F.col("value") + F.col("r")
    move = clip(0.5 * (F.col("l") - F.col("r")) / bend, -0.5, 0.5)
    return found.join(near, ["series", "bin"]).withColumn("refined", F.when(F.abs(bend) > EPS, F.exp(F.log("freq") + move * F.col("step"))).otherwise(F.col("freq"))).drop("l", "r", "step")


def embed(signal: DataFrame, m: int, tau: int) -> DataFrame:
    """Takens embedding: series, t, x (array of m delayed values); incomplete rows go."""
    by = Window.partitionBy("series").orderBy("t")
    parts = [F.lead("v", i * tau).over(by) if i else F.col("v") for i in range(m)]
    full = F.count(F.lit(1)).over(Window.partitionBy("series")) - F.row_number().over(by) >= (m - 1) * tau
    return signal.withColumn("full", full).select("series", "t", F.array(*parts).alias("x"), "full").where("full").drop("full")
