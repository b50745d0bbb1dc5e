"""Event backtest of alert scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matched(df: DataFrame, keys: list[str], order: str, score: str, event: str, threshold: float, lead: int) -> DataFrame:
    """Alerts with `hit`, the row of the nearest event 0 to `lead` rows ahead (null if none), and `ahead`, its distance.

    Rows without a numeric score go first, so leads count the rows that are left; a null event is an event.
    """
    rows = df.withColumn(score, F.col(score).try_cast("double")).where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn(event, F.coalesce(F.col(event).cast("boolean"), F.lit(True)))
    by = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("row", F.row_number().over(by))
    hit = F.first(F.when(F.col(event), F.col("row")), ignorenulls=True).over(by.rowsBetween(0, lead))
    return rows.withColumn("hit", F.when(F.col(score) >= threshold, hit)).withColumn("alert", F.col(score) >= threshold).withColumn("ahead", F.col("hit") - F.col("row"))


def summary(m: DataFrame, keys: list[str], event: str) -> DataFrame:
    """alerts, true_positives, false_positives, events, detected, missed, precision, recall, mean_lead."""
    g = m.groupBy(*keys).agg(
        F.sum(F.col("alert").cast("int")).alias("alerts"), F.count("hit").alias("true_positives"), F.sum(F.col(event).cast("int")).alias("events"),
        F.countDistinct("hit").alias("detected"), F.avg("ahead").alias("mean_lead"),
    )
    return g.withColumns({
        "false_positives": F.col("alerts") - F.col("true_positives"), "missed": F.col("events") - F.col("detected"),
        "precision": F.coalesce(F.try_divide("true_positives", "alerts"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("detected", "events"), F.lit(0.0)),
    })
