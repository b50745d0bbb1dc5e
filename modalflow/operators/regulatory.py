"""Regulatory schedules, rate shocks and dashboard measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
PCA_RATIO, CONFIDENCE, SHOCK_BPS = 0.065, 0.65, 200.0
AMBER, RED = 0.5, 0.8
TIERS = ((0.09, "Well capitalized"), (PCA_RATIO, "Adequately capitalized"), (0.05, "Undercapitalized"))
MODES = ("full_aoci", "opt_out")
KEY = ["rssd_id", "report_date"]


def merge(liquidity: DataFrame, securities: DataFrame, capital: DataFrame) -> DataFrame:
    """Full outer join of three schedules on (rssd_id, report_date) with the derived sums.

    A key that a schedule holds several times repeats rows, and a null key meets nothing, as
    joins have it. All three are dealt by the same key, so each is shuffled once.
    """
    out = liquidity.join(securities, KEY, "full").join(capital, KEY, "full")
    return _with_sums(out)


def merge_unique(liquidity: DataFrame, securities: DataFrame, capital: DataFrame) -> DataFrame:
    """`merge` in one shuffle, a union and a grouping, for schedules that hold each key once.

    A schedule that holds a key twice, or a null in it, ends the query with an error.
    """
    parts = [liquidity, securities, capital]
    both = None
    for k, p in enumerate(parts):
        marked = p.withColumn(f"__rows{k}", F.lit(1))
        both = marked if both is None else both.unionByName(marked, allowMissingColumns=True)
    values = [c for c in both.columns if c not in KEY and not c.startswith("__rows")]
    most = F.greatest(*(F.coalesce(F.sum(f"__rows{k}"), F.lit(0)) for k in range(len(parts))))
    out = both.groupBy(*KEY).agg(*(F.first(c, ignorenulls=True).alias(c) for c in values), most.alias("__most"))
    bad = (F.col("__most") > 1) | F.col(KEY[0]).isNull() | F.col(KEY[1]).isNull()
    message = F.lit("a schedule holds a key of (rssd_id, report_date) more than once, or a null in it; use merge")
    return _with_sums(out.where(F.when(bad, F.raise_error(message).isNull()).otherwise(F.lit(True))).drop("__most"))


def unique_on_key(df: DataFrame) -> bool:
    """Whether `merge_unique` takes the schedule."""
    return not df.groupBy(*KEY).count().where("count > 1 or rssd_id is null or report_date is null").limit(1).count()


def _with_sums(merged: DataFrame) -> DataFrame:
    return merged.withColumns({
        "total_repo_dependency": F.col("ral_overnight_repo") + F.col("ral_term_repo"),
        "securities_total": F.col("hc_b_afs_securities") + F.col("hc_b_htm_securities"),
    })


def with_depth(panel: DataFrame, depths: DataFrame) -> DataFrame:
    """`panel` with each bank's `depth` of depths(rssd_id, depth), 0 where it has none."""
    return panel.join(depths.select("rssd_id", "depth"), "rssd_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0.0)))


def first_banks(panel: DataFrame, n: int = 20) -> DataFrame:
    """rssd_id of the first banks in order: the list that a run is limited to."""
    return panel.select("rssd_id").where("rssd_id is not null").distinct().orderBy("rssd_id").limit(n)


def bank_matrix(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Time by variables for every bank: missing measures are 0."""
    return panel.select(*KEY, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))


def rate_shock(panel: DataFrame, bps: list[float]) -> DataFrame:
    """One row per panel row, shock and mode: losses, shocked capital and ratio, and the breach flag.

    Scenarios are a literal array that each row explodes, so no join is needed.
    """
    scenarios = F.array(*(F.struct(F.lit(float(b)).alias("shock_bps"), F.lit(m).alias("aoci_mode")) for b in bps for m in MODES))
    x = panel.select("*", F.explode(scenarios).alias("s")).select("*", "s.*").drop("s")
    loss = lambda kind: F.col(f"hc_b_{kind}_duration") * F.col("shock_bps") / 1e4 * F.col(f"hc_b_{kind}_securities")
    x = x.withColumns({"afs_loss": loss("afs"), "htm_loss": loss("htm")}).withColumn("total_loss", F.col("afs_loss") + F.col("htm_loss"))
    x = x.withColumn("shocked_cet1", F.when(F.col("aoci_mode") == "full_aoci", F.col("hc_r_cet1") - F.col("total_loss")).otherwise(F.col("hc_r_cet1")))
    x = x.withColumn("shocked_ratio", F.try_divide("shocked_cet1", "hc_r_rwa"))
    return x.withColumn("breach", F.coalesce(F.col("shocked_ratio") < PCA_RATIO, F.lit(False)))


def aoci_impact(shocked: DataFrame) -> DataFrame:
    """The ratio under full recognition less that under the opt-out."""
    wide = shocked.groupBy(*KEY, "shock_bps").pivot("aoci_mode", list(MODES)).agg(F.first("shocked_ratio"))
    return wide.withColumn("aoci_impact", F.col("full_aoci") - F.col("opt_out"))


def status(depth: Column) -> Column:
    return F.when(depth >= RED, "Red").when(depth >= AMBER, "Amber").otherwise("Green")


def tier(ratio: Column) -> Column:
    out = F.when(ratio.isNull(), F.lit(None).cast("string"))
    for least, name in TIERS:
        out = out.when(ratio >= least, name)
    return out.otherwise("Critically undercapitalized")


def stress_index(df: DataFrame) -> Column:
    return F.try_divide(F.col("ral_overnight_repo") + F.col("ral_eurusd_borr"), F.col("hc_r_cet1"))


def duration_beta() -> Column:
    """Value-weighted duration, as an aggregate."""
    weighted = F.sum(F.col("hc_b_afs_duration") * F.col("hc_b_afs_securities") + F.col("hc_b_htm_duration") * F.col("hc_b_htm_securities"))
    return F.try_divide(weighted, F.sum(F.col("hc_b_afs_securities") + F.col("hc_b_htm_securities")))


def changes(df: DataFrame, value: str) -> DataFrame:
    """df with qoq and yoy: the change from one and from four rows before, per bank."""
    by = Window.partitionBy("rssd_id").orderBy("report_date")
    return df.withColumns({"qoq": F.col(value) - F.lag(value).over(by), "yoy": F.col(value) - F.lag(value, 4).over(by)})


def dense_rank(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("rank", F.dense_rank().over(Window.partitionBy("report_date").orderBy(F.desc(value))))


def by_country(df: DataFrame) -> DataFrame:
    """Maximum stress, mean ratio, breaches and the share of banks at risk, and stress weighted by assets."""
    return df.where("hub_country is not null").groupBy("hub_country").agg(
        F.max("stress").alias("max_stress"), F.avg("ratio").alias("avg_ratio"), F.sum(F.coalesce((F.col("ratio") < PCA_RATIO).cast("int"), F.lit(0))).alias("breaches"),
        F.try_divide(F.countDistinct(F.when(F.col("stress") >= 1, F.col("rssd_id"))), F.countDistinct("rssd_id")).alias("share_at_risk"),
        F.try_divide(F.sum(F.col("stress") * F.col("hc_r_rwa")), F.sum("hc_r_rwa")).alias("weighted_stress"),
    )
