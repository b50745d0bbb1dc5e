"""The core query: one plan over all series for modes, depth, belief, influence and state space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalflow.operators import depth as dp
from modalflow.operators import rooting, spectral
from modalflow.operators import statespace as ss

METHODS = ("fft", "welch", "wavelet")


@dataclass(frozen=True)
class Config:
    embedding: int = 3
    tau: int = 1
    fs: float = 100.0
    method: str = "fft"
    ratio: float = 0.1
    window: int = 100
    surrogates: int = 25
    seed: int = 0
    alpha: float = 0.05
    threshold: float = 0.8
    max_lag: int = 4
    multivariate: bool = True
    state_space: bool = True
    horizon: int = 12

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method}; expected one of {', '.join(METHODS)}")
        if min(self.embedding, self.tau, self.window) < 1 or self.fs <= 0 or not 0 < self.ratio <= 1 or self.surrogates < 0 or self.max_lag < 1 or not 0 < self.alpha < 1:
            raise ValueError("a parameter is out of range")


def resonances(signal: DataFrame, c: Config) -> DataFrame:
    """series, freq, magnitude, confidence, rank of signal(series, t, v): a transform per series, at every length."""
    return ss.detected(signal, c.method, c.fs, c.ratio).select("series", "freq", "magnitude", "confidence", "rank")


def analyse(signal: DataFrame, c: Config = Config()) -> dict[str, DataFrame]:
    """signal(series, dim, t, v) to result tables: resonances, depths, beliefs and, as asked
    for, scores, edges and states.

    A series of one dimension is embedded first. `scores` holds the lagged correlation of
    each pair of a series' dimensions with its p over `surrogates` permutations; `edges` is
    the influence graph: pairs that are significant at `alpha`, or, of a series that has
    none, those above the threshold without p and lag. All tables are lazy; each is one plan
    over all series.
    """
    shape = signal.groupBy("series").agg(F.countDistinct("dim").alias("dims"))
    n = shape.agg(F.max("dims")).first()[0] or 0
    one = shape.where("dims = 1").select("series")
    flat = signal.select("series", "t", "v").join(one, "series", "left_semi")
    embedded = spectral.embed(flat, c.embedding, c.tau).select("series", F.posexplode("x").alias("dim", "v"), "t").select("series", "dim", "t", "v")
    wide = signal.join(one, "series", "left_anti").unionByName(embedded)
    # The parts of a key travel as one text, as spectra know a single key.
    keyed = wide.select(F.concat_ws("\0", F.col("dim").cast("string"), "series").alias("series"), "t", "v")
    parts = F.split("series", "\0", 2)
    split = lambda df: df.select(parts[1].alias("series"), parts[0].cast("int").alias("dim"), *(x for x in df.columns if x != "series"))
    found = split(resonances(keyed, c))
    target = found.where("rank = 1 and freq > 0").select("series", "dim", F.col("freq").alias("f0"))
    depths = dp.depth_by_kernel(wide.withColumn("dim", F.col("dim").cast("int")), ["series", "dim"], c.window, c.fs, target)
    out = {"resonances": found, "depths": depths.withColumn("is_anomaly", F.col("depth") > c.threshold)}
    out["beliefs"] = dp.belief(out["depths"], ["series"], "dim")
    n = max(n, c.embedding if one.limit(1).count() else 0)
    if c.multivariate and n > 1:
        out |= influence(wide, n, c)
    if c.state_space:
        out["states"] = ss.bundle(wide.withColumn("dim", F.col("dim").cast("int")), c.horizon)
    return out


def influence(wide: DataFrame, n: int, c: Config) -> dict[str, DataFrame]:
    """scores (series, src, dst, score, lag, p) and edges (series, src, dst, weight, lag, p) of wide(series, dim, t, v) with dimensions 0 to n - 1."""
    dims, by = [str(d) for d in range(n)], ("entity",)
    rows = wide.select(F.col("series").alias("entity"), F.col("dim").cast("string").alias("series"), "t", "v")
    own = rows.select("entity", "series").distinct()
    scores = rooting.lagged_correlation(rooting.widen(rows, dims, by), dims, c.max_lag, by)
    # A series of fewer dimensions than the widest one has no pairs of those that it lacks.
    for side in ("src", "dst"):
        scores = scores.join(own.withColumnRenamed("series", side), ["entity", side], "left_semi")
    scores = rooting.surrogate_p(scores, rows, dims, c.max_lag, c.surrogates, c.seed, by) if c.surrogates else rooting.plain_p(scores, by)
    graph = rooting.influence_graph(scores, c.alpha, by)
    return {"scores": scores.withColumnRenamed("entity", "series"), "edges": graph.withColumnRenamed("entity", "series")}


def sweep(signal: DataFrame, ms: list[int], taus: list[int], window: int) -> DataFrame:
    """series, m, tau, depth: the mean depth of each embedding of a one-dimensional signal(series, t, v), all in one plan."""
    parts = []
    for m in ms:
        for tau in taus:
            e = spectral.embed(signal, m, tau).select("series", F.posexplode("x").alias("dim", "v"), "t")
            parts.append(e.withColumns({"m": F.lit(m), "tau": F.lit(tau)}))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    d = dp.depth_by_kernel(every, ["series", "m", "tau", "dim"], window)
    return d.groupBy("series", "m", "tau").agg(F.avg("depth").alias("depth"))
