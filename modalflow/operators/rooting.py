"""Directed lead-lag structure: lagged correlation, transfer entropy, permutation tests and edges.

Signals become one wide row per step (dimensions are few, steps are many), so that all
pairs and lags are one sort and one aggregation with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalflow.functions.columns import EPS


def widen(signal: DataFrame, dims: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, t and one column d0, d1, ... per dimension."""
    wide = signal.groupBy(*keys, "t").pivot("series", dims).agg(F.first("v"))
    return wide.select(*keys, "t", *(F.col(f"`{d}`").alias(f"d{i}") for i, d in enumerate(dims)))


def lagged_correlation(wide: DataFrame, dims: list[str], max_lag: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, src, dst, score, lag: the largest |Pearson| of src before dst over lags 1 to max_lag.

    The least lag wins a tie; a constant side scores 0; the diagonal is 0 at lag 0.
    """
    n = len(dims)
    lead = _leads(wide, [f"d{i}" for i in range(n)], max_lag, keys)
    cells = [
        F.struct(F.lit(dims[i]).alias("src"), F.lit(dims[j]).alias("dst"), F.lit(k).alias("lag"), F.col(f"d{i}").alias("x"), F.col(f"d{j}_{k}").alias("y"))
        for i in range(n) for j in range(n) if i != j for k in range(1, max_lag + 1)
    ]
    # Each wide row becomes its pairs in place; sums are combined before the shuffle, which moves one row per pair and task.
    rows = lead.select(*keys, F.inline(F.array(*cells)))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    sums = rows.groupBy(*keys, "src", "dst", "lag").agg(
        F.covar_pop("x", "y").alias("c"), F.stddev_pop(F.when(both, F.col("x"))).alias("sx"), F.stddev_pop(F.when(both, F.col("y"))).alias("sy"), F.count(F.when(both, 1)).alias("n")
    )
    r = F.when((F.col("n") >= 2) & (F.col("sx") > EPS) & (F.col("sy") > EPS), F.abs(F.try_divide("c", F.col("sx") * F.col("sy")))).otherwise(0.0)
    flat = sums.withColumn("r", r)
    best = flat.groupBy(*keys, "src", "dst").agg(F.max_by(F.struct("r", "lag"), F.struct("r", -F.col("lag"))).alias("b"))
    pairs = best.select(*keys, "src", "dst", F.col("b.r").alias("score"), F.when(F.col("b.r") > 0, F.col("b.lag")).otherwise(1).alias("lag"))
    diagonal = F.explode(F.array(*(F.lit(d) for d in dims))).alias("src")
    own = (wide.select(*keys).distinct() if keys else wide.limit(1)).select(*keys, diagonal)
    return pairs.unionByName(own.select(*keys, "src", F.col("src").alias("dst"), F.lit(0.0).alias("score"), F.lit(0).alias("lag")))


def correlation(wide: DataFrame, dims: list[str]) -> DataFrame:
    """x, y, r: Pearson of every pair of dimensions over the steps that have both; null where a side is constant.

    A wide row becomes its pairs in place, so the shuffle moves one row of sums per pair and task.
    """
    cells = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"d{i}").alias("a"), F.col(f"d{j}").alias("b")) for i, x in enumerate(dims) for j, y in enumerate(dims)]
    both = wide.select(F.inline(F.array(*cells))).where("a is not null and b is not null")
    sums = both.groupBy("x", "y").agg(F.covar_pop("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return sums.select("x", "y", F.try_divide("c", F.col("sa") * F.col("sb")).alias("r"))


def _leads(wide: DataFrame, columns: list[str], most: int, keys: tuple[str, ...], size: int = 1 << 16) -> DataFrame:
    """keys, `columns`, and c_1 to c_most of each column: its values so many rows later by t.

    Rows without keys are one long series. They are numbered by spans of t (a row of counts for each span gives the
    numbers their start), and cut to chunks of `size` rows that also hold the first `most` rows of the next one, so no task
    sorts the whole series.
    """
    if keys:
        by, rows, own = Window.partitionBy(*keys).orderBy("t"), wide, F.lit(True)
    else:
        span = wide.withColumn("_span", F.floor(F.col("t") / size))
        counts = span.groupBy("_span").agg(F.count(F.lit(1)).alias("n"))
        starts = counts.select("_span", (F.sum("n").over(Window.orderBy("_span")) - F.col("n")).alias("_start"))
        number = F.row_number().over(Window.partitionBy("_span").orderBy("t")) - 1
        place = span.withColumn("_in", number).join(starts, "_span").withColumn("_place", F.col("_start") + F.col("_in"))
        chunk = F.floor(F.col("_place") / size)
        early = (F.col("_place") % size < most) & (chunk > 0)
        rows = place.withColumn("_chunk", F.explode(F.when(early, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))))
        by, own = Window.partitionBy("_chunk").orderBy("_place"), F.col("_chunk") == chunk
    later = [F.lead(c, k).over(by).alias(f"{c}_{k}") for c in columns for k in range(1, most + 1)]
    return rows.select(*keys, *columns, *later, own.alias("_own")).where("_own").drop("_own")


def permuted(signal: DataFrame, surrogates: int, seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, surrogate, series, t, v: each series' values in the order of a hash of (seed, surrogate, series, t, keys)."""
    keyed = signal.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(surrogates))).alias("surrogate"), "series", "t", "v")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("surrogate").cast("string"), F.col("series"), F.col("t").cast("string"), *(F.col(c).cast("string") for c in keys)))
    by = Window.partitionBy(*keys, "surrogate", "series").orderBy(h, "t")
    return keyed.withColumn("p", F.row_number().over(by) - 1).select(*keys, "surrogate", "series", F.col("p").alias("t"), "v")


def surrogate_p(
    scores: DataFrame, signal: DataFrame, dims: list[str], max_lag: int, surrogates: int, seed: int, keys: tuple[str, ...] = ()
) -> DataFrame:
    """scores with p = (1 + surrogates that score as much) / (1 + surrogates); 1 on the diagonal."""
    pair, trial = [*keys, "src", "dst"], (*keys, "surrogate")
    null = lagged_correlation(widen(permuted(signal, surrogates, seed, keys), dims, trial), dims, max_lag, trial)
    both = null.select(*pair, F.col("score").alias("s")).join(scores, pair)
    p = (F.sum((F.col("s") >= F.col("score")).cast("int")) + 1) / (surrogates + 1)
    found = both.groupBy(*scores.columns).agg(p.alias("p"))
    return found.withColumn("p", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.col("p")))


def _with_totals(df: DataFrame, totals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each row with the totals of its entity; without keys they are one row, which is broadcast."""
    return df.join(totals, list(keys)) if keys else df.crossJoin(F.broadcast(totals))


def _totals(df: DataFrame, keys: tuple[str, ...], *aggregates) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def plain_p(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Without surrogates: p = 0 above mean + deviation of the off-diagonal scores, else 1."""
    off = _totals(scores.where("src <> dst"), keys, (F.avg("score") + F.stddev_pop("score")).alias("bar"))
    high = (F.col("src") != F.col("dst")) & (F.col("score") > F.col("bar")) & (F.col("score") > 0)
    return _with_totals(scores, off, keys).withColumn("p", F.when(high, 0.0).otherwise(1.0)).drop("bar")


def _above(scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Off-diagonal pairs above mean + deviation of their entity's matrix, which a window holds: scores are made once."""
    by = Window.partitionBy(*keys)
    bar = F.avg("score").over(by) + F.stddev_pop("score").over(by)
    return scores.withColumn("_bar", bar).where((F.col("src") != F.col("dst")) & (F.col("score") > F.col("_bar"))).drop("_bar")


def edges(scores: DataFrame, alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, src, dst, weight, lag, p of pairs above mean + deviation of the whole matrix."""
    return _above(scores, keys).where(F.col("p") <= alpha).select(*keys, "src", "dst", F.col("score").alias("weight"), "lag", "p")


def directions(scores: DataFrame, confidence: float, least: float) -> DataFrame:
    """src, dst, is_root, direction of pairs that score over `least`: p is at most 1 - confidence; the stronger side leads."""
    back = scores.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("score").alias("back"))
    pairs = scores.where((F.col("src") != F.col("dst")) & (F.col("score") > least)).join(back, ["src", "dst"])
    leads = lambda a, b: F.concat(a, F.lit(" leads "), b)
    label = F.when(F.col("score") > F.col("back"), leads(F.col("src"), F.col("dst"))).when(F.col("score") < F.col("back"), leads(F.col("dst"), F.col("src"))).otherwise("no direction")
    return pairs.select("src", "dst", (F.col("p") <= F.lit(round(1 - confidence, 12))).alias("is_root"), label.alias("direction"))


def influence_graph(scores: DataFrame, alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """Significant edges; of an entity that has none, the pairs above the threshold, without p and lag."""
    good = F.col("p") <= alpha
    marked = _above(scores, keys).withColumn("_good", good).withColumn("_some", F.max("_good").over(Window.partitionBy(*keys)))
    return marked.where("_good or not _some").select(
        *keys, "src", "dst", F.col("score").alias("weight"), F.when(F.col("_good"), F.col("lag")).alias("lag"), F.when(F.col("_good"), F.col("p")).alias("p")
    )


def binned(signal: DataFrame, bins: int = 10) -> DataFrame:
    """series, t, b: equal-width bins per series, closed on the left; a constant series has one bin."""
    span = signal.groupBy("series").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return signal.join(span, "series").select("series", "t", F.when(F.col("hi") <= F.col("lo"), bins // 2).otherwise(F.least(at, F.lit(bins - 1))).cast("int").alias("b"))


def transfer_entropy(signal: DataFrame, max_lag: int, bins: int = 10) -> DataFrame:
    """src, dst, te, lag: bits that src's bin adds to dst's next bin given dst's own; the least lag wins a tie.

    One equi-join on t makes the triples of all pairs; a pair's cells are counted with map-side combine.
    """
    b = binned(signal, bins)
    by = Window.partitionBy("series").orderBy("t")
    target = b.select(F.col("series").alias("dst"), "t", F.col("b").alias("y"), F.lead("b").over(by).alias("z")).where("z is not null")
    source = b.select(F.col("series").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "t", F.col("b").alias("s")).withColumn("t", F.col("t") + F.col("lag"))
    pair = ["src", "dst", "lag"]
    cells = source.join(target, "t").where("src <> dst").groupBy(*pair, "s", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    total, sy, yz, y = (F.sum("n").over(Window.partitionBy(*pair, *k)) for k in ((), ("s", "y"), ("y", "z"), ("y",)))
    bits = cells.withColumn("bits", F.col("n") / total * F.log2((F.col("n") / sy) / (yz / y)))
    te = bits.groupBy(*pair).agg(F.sum("bits").alias("te"))
    return te.groupBy("src", "dst").agg(F.max("te").alias("te"), F.max_by("lag", F.struct("te", -F.col("lag"))).alias("lag")).select("src", "dst", F.greatest("te", F.lit(0.0)).alias("te"), "lag")


def transitions(events: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """from_state, to_state, n, p: counts of consecutive states in each key, normalised by row."""
    nxt = F.lead(state).over(Window.partitionBy(*keys).orderBy(*order))
    counts = events.select(F.col(state).alias("from_state"), nxt.alias("to_state")).where("to_state is not null").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))
