"""Panel preparation: all windows are partitioned by the entity, so entities never wait for one another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSFORMS = ("level", "diff", "pct_change", "log_diff")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, t in df.dtypes if c not in exclude and t.split("(")[0] in kinds]


def _by(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def transform(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], how: str) -> DataFrame:
    """level, diff, pct_change (in percent, after the last known value fills gaps) or log_diff (raises on values <= 0)."""
    if how not in TRANSFORMS:
        raise ValueError(f"unknown transform {how}; expected one of {', '.join(TRANSFORMS)}")
    by = _by(keys, order)

    def one(c: str) -> Column:
        v = F.col(c)
        if how == "diff":
            return v - F.lag(v).over(by)
        if how == "pct_change":
            known = F.last(v, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
            before = F.last(v, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
            return 100 * (F.try_divide(known, before) - 1)
        if how == "log_diff":
            positive = F.when(v <= 0, F.raise_error(F.lit(f"log_diff needs positive values in {c}")).cast("double")).otherwise(F.log(v))
            return positive - F.lag(positive).over(by)
        return v

    if how == "level":
        return df
    return df.withColumns({c: one(c) for c in columns})


def interpolate(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Linear by row position, in both directions; leading and trailing gaps take the nearest value."""
    by = _by(keys, order)
    pos = F.row_number().over(by)
    with_pos = df.withColumn("_pos", pos)
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)

    def one(c: str) -> Column:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).alias("v")))
        a, b = F.last(point, ignorenulls=True).over(back), F.first(point, ignorenulls=True).over(ahead)
        line = a["v"] + (b["v"] - a["v"]) * (F.col("_pos") - a["p"]) / (b["p"] - a["p"])
        return F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)

    return with_pos.withColumns({c: one(c) for c in columns}).drop("_pos")


def standardize(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """z-scores with the population deviation per entity; a deviation of 0 counts as 1."""
    by = Window.partitionBy(*keys)

    def one(c: str) -> Column:
        sd = F.stddev_pop(c).over(by)
        return (F.col(c) - F.avg(c).over(by)) / F.when(sd == 0, 1.0).otherwise(sd)

    return df.withColumns({c: one(c) for c in columns})


def clean(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], how: str = "level", fill: bool = True, z: bool = True
) -> DataFrame:
    """Coerce, transform, interpolate, drop incomplete rows, standardize: in this order, per entity."""
    require(df, [*keys, order, *columns])
    out = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    out = transform(out, keys, order, columns, how)
    if fill:
        out = interpolate(out, keys, order, columns)
    out = out.dropna("any", subset=list(columns))
    return standardize(out, keys, columns) if z else out


def check_rows(df: DataFrame, least: int = 3) -> DataFrame:
    if df.limit(least).count() < least:
        raise ValueError(f"at least {least} complete rows are required")
    return df


def institution(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.where(F.col(column).cast("string") == str(name))


def peer_mean(df: DataFrame, group: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Mean over a peer group's institutions by date; null groups are left out."""
    return df.where(F.col(group).isNotNull()).groupBy(group, order).agg(*(F.avg(c).alias(c) for c in columns))


def first_seen(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Distinct values, ranked by where they first appear."""
    first = df.groupBy(F.col(column).cast("string").alias(column)).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("position", F.row_number().over(Window.orderBy("_first", column))).drop("_first")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "metric", "value")


def provenance(raw: DataFrame, cleaned: DataFrame, entity: str, how: str, source: str) -> DataFrame:
    """rows_before, rows_after, institution_count, transform, source."""
    before = raw.agg(F.count(F.lit(1)).alias("rows_before"), F.countDistinct(entity).alias("institution_count"))
    after = cleaned.agg(F.count(F.lit(1)).alias("rows_after"))
    return before.crossJoin(after).withColumns({"transform": F.lit(how), "source": F.lit(source)})


def alert_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with `score`: the mean size of the z-scores."""
    return df.withColumn("score", sum((F.abs(c) for c in map(F.col, columns)), F.lit(0.0)) / len(columns))
