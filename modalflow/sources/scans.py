"""Scans: policy and panel tables from CSV, SQL or a DataFrame, sensor windows, and runs from a config file."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalflow.functions import generators
from modalflow.operators import prep

#: Sensor files in their order, and activity names.
SIGNALS = tuple(f"{kind}_{axis}" for kind in ("body_acc", "body_gyro", "total_acc") for axis in "xyz")
ACTIVITIES = {1: "WALKING", 2: "WALKING_UPSTAIRS", 3: "WALKING_DOWNSTAIRS", 4: "SITTING", 5: "STANDING", 6: "LAYING"}
SAMPLES, SENSOR_HZ = 128, 50


@dataclass(frozen=True)
class Dataset:
    """A cleaned frame with the roles of its columns and where it came from."""

    frame: DataFrame
    date: str
    values: tuple[str, ...]
    entity: str | None = None
    peer_group: str | None = None
    sampling_rate: float = 1.0
    meta: dict[str, str] = field(default_factory=dict)

    def with_sampling_rate(self, fs: float) -> Dataset:
        if fs <= 0:
            raise ValueError("the sampling rate must be positive")
        return replace(self, sampling_rate=fs)

    def institution(self, name: str) -> Dataset:
        got = prep.institution(self.frame, self.entity, name)
        if not got.limit(1).count():
            raise ValueError(f"no rows for {name}")
        return replace(self, frame=got)

    def peers(self, name: str) -> Dataset:
        got = prep.peer_mean(self.frame.where(F.col(self.peer_group).cast("string") == name), self.peer_group, self.date, self.values)
        return replace(self, frame=got, entity=None)

    def tidy(self) -> DataFrame:
        return prep.melt(self.frame, [c for c in (self.entity, self.peer_group, self.date) if c], self.values)

    def signal(self) -> DataFrame:
        """series, dim, t, v in date order."""
        from pyspark.sql import Window

        key = F.col(self.entity).cast("string") if self.entity else F.lit("all")
        long = prep.melt(self.frame.withColumn("series", key), ["series", self.date], self.values)
        dim = F.array_position(F.array(*(F.lit(v) for v in self.values)), F.col("metric")) - 1
        t = F.row_number().over(Window.partitionBy("series", "metric").orderBy(self.date)) - 1
        return long.select("series", dim.cast("int").alias("dim"), t.alias("t"), F.col("value").alias("v"))


def from_frame(
    df: DataFrame, date: str, values: Sequence[str] | None = None, entity: str | None = None, peer_group: str | None = None,
    how: str = "level", interpolate: bool = True, standardize: bool = True, sampling_rate: float = 1.0, source: str = "frame",
) -> Dataset:
    """Parse dates (junk raises), pick numeric columns if none are named, clean per entity; fewer than three rows raise."""
    roles = [c for c in (date, entity, peer_group) if c]
    values = tuple(values or prep.numeric_columns(df, roles))
    if not values:
        raise ValueError("no numeric columns")
    prep.require(df, [*roles, *values])
    parsed = df.select(*(c for c in (entity, peer_group) if c), F.to_timestamp(F.col(date).cast("string")).alias(date), *values)
    frame = prep.clean(parsed, [entity] if entity else [], date, values, how, interpolate, standardize)
    prep.check_rows(frame)
    return Dataset(frame, date, values, entity, peer_group, sampling_rate, {"transform": how, "source": source})


def from_csv(spark: SparkSession, path: str, date: str, **roles) -> Dataset:
    return from_frame(spark.read.csv(path, header=True, inferSchema=True), date, source=path, **roles)


def from_sql(spark: SparkSession, sql: str, date: str, args: dict | None = None, **roles) -> Dataset:
    """A query over the session's views with named parameters."""
    return from_frame(spark.sql(sql, args=args) if args else spark.sql(sql), date, source="sql_query", **roles)


def from_jdbc(spark: SparkSession, url: str, sql: str, date: str, **roles) -> Dataset:
    return from_frame(spark.read.format("jdbc").option("url", url).option("query", sql).load(), date, source="jdbc_query", **roles)


def schedule(spark: SparkSession, sql: str, start: str, end: str) -> DataFrame:
    """A regulatory schedule between two dates: the parameters are bound, not pasted."""
    return spark.sql(sql, args={"start_date": start, "end_date": end})


def sensor_windows(spark: SparkSession, folder: str, split: str = "train", max_samples: int | None = None) -> DataFrame:
    """window_id, sample, timestamp, time_seconds, activity, subject and the nine signals, one row per sample.

    Each file has a window of 128 numbers per line; lines keep their order by the number of
    their file offset, so files join on a window id.
    """

    def lines(path: str) -> DataFrame:
        # One small file is one partition read in order; larger ones are split, and offsets order the parts.
        rdd = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("window_id", "line"))
        return rdd.select("window_id", F.trim("line").alias("line"))

    out = lines(f"{folder}/{split}/y_{split}.txt").select("window_id", F.col("line").cast("int").alias("activity_id"))
    out = out.join(lines(f"{folder}/{split}/subject_{split}.txt").select("window_id", F.col("line").cast("int").alias("subject_id")), "window_id")
    for s in SIGNALS:
        values = F.transform(F.split("line", "\\s+"), lambda x: x.cast("double"))
        out = out.join(lines(f"{folder}/{split}/Inertial Signals/{s}_{split}.txt").select("window_id", values.alias(s)), "window_id")
    if max_samples is not None:
        out = out.where(F.col("window_id") < max_samples // SAMPLES)
    names = F.create_map(*(F.lit(x) for kv in ACTIVITIES.items() for x in kv))
    flat = out.select("window_id", "subject_id", "activity_id", names[F.col("activity_id")].alias("activity_name"), F.posexplode(F.arrays_zip(*SIGNALS)).alias("sample", "z"))
    t = F.col("window_id") * SAMPLES + F.col("sample")
    return flat.select("window_id", "sample", t.alias("timestamp"), (t / SENSOR_HZ).alias("time_seconds"), "subject_id", "activity_id", "activity_name", "z.*")


def sensor_features(samples: DataFrame) -> DataFrame:
    """z-scored signals (sample deviation), magnitudes, and the product of the two body magnitudes."""
    clean = samples.dropna("any", subset=list(SIGNALS))
    stats = clean.agg(*(F.avg(s).alias(f"m_{s}") for s in SIGNALS), *(F.stddev_samp(s).alias(f"d_{s}") for s in SIGNALS))
    z = clean.crossJoin(F.broadcast(stats)).withColumns({s: F.try_divide(F.col(s) - F.col(f"m_{s}"), F.col(f"d_{s}")) for s in SIGNALS})
    mag = {f"{kind}_magnitude": F.sqrt(sum((F.col(f"{kind}_{a}") ** 2 for a in "xyz"), F.lit(0.0))) for kind in ("body_acc", "body_gyro", "total_acc")}
    return z.drop(*stats.columns).withColumns(mag).withColumn("acc_gyro_product", F.col("body_acc_magnitude") * F.col("body_gyro_magnitude"))


def from_config(spark: SparkSession, config: dict) -> DataFrame:
    """series, dim, t, v for the `data` and `system` parts of a config: generated, or from a CSV file."""
    data = config.get("data", {})
    if data.get("source", "generate") == "file":
        ds = from_csv(spark, data["path"], data["date_column"], values=data.get("columns"), standardize=False)
        return ds.signal()
    row = (config.get("system", "lorenz"), config.get("system", "lorenz"), int(data.get("n", 1000)), int(data.get("seed", 0)))
    return generators.generate(spark.createDataFrame([row], "series string, system string, n int, seed int"))
