"""Queries whose recursions have no SQL: checked by identities in the tests, and by row counts here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modalflow import views
from modalflow.functions import generators
from modalflow.functions.columns import rounded
from modalflow.operators import depth, prep
from modalflow.operators import regulatory as rg
from modalflow.operators import statespace as ss
from modalflow.plans import engine, recipes
from modalflow.queries.panels import ORDERS_SQL
from modalflow.queries.signals import depth_sql, detect_sql, lag_sql, show
from modalflow.sources import scans
from modalflow.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardized monthly order totals as one-dimensional series."""
    c = prep.clean(views.monthly_orders(spark, sf_dir), ["series"], "t", ["v"])
    return c.select("series", F.lit(0).alias("dim"), "t", "v")


@query
def state_space_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.bundle(_orders(spark, sf_dir))


@query
def rts_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.bundle(_orders(spark, sf_dir), smoother="rts").where("kind = 'smooth'")


@query
def chandrasekhar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.chandrasekhar(_orders(spark, sf_dir))


@query
def posterior_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.bands(ss.draws(_orders(spark, sf_dir), 40, seed=7))


@query
def carter_kohn_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.bands(ss.draws(_orders(spark, sf_dir), 40, seed=7, method="carter_kohn"))


@query
def particle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.particles(_orders(spark, sf_dir), 500, seed=7)


@query
def wavelet_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.wavelet(views.hourly(spark, sf_dir), 1.0)


@query
def scalogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.scalogram(views.hourly(spark, sf_dir), 1.0)


@query
def markov_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.persistence(views.hourly(spark, sf_dir))


@query
def synthetic_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, name, 200, 42) for name in generators.SYSTEMS]
    return generators.generate(spark.createDataFrame(rows, "series string, system string, n int, seed int"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.daily(spark, sf_dir)
    return e.select("series", F.timestamp_seconds(F.lit(1704067200) + F.col("t") * 86400).alias("ts"), F.col("t").cast("long").alias("seq"), F.array("v").alias("x"))


@query
def live_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(live.batch(points(spark, sf_dir), live.Live(window=10, stride=3)), "series", "n", "dim", "is_anomaly", "error", f0=4, depth=4)


ORACLES["live_batch"] = (
    views.with_views("ed")
    + """, lv AS (
  SELECT e.series || chr(2) || (k * 3 + 10) AS series, e.t - k * 3 AS t, e.v
  FROM ed e JOIN (SELECT unnest(range(0, (max(t) + 1 - 10) // 3 + 1)) AS k FROM ed) ON e.t >= k * 3 AND e.t < k * 3 + 10),"""
    + detect_sql("lv", 100.0) + "," + depth_sql("lv", 10)
    + """ SELECT string_split(dp.series, chr(2))[1] AS series, CAST(string_split(dp.series, chr(2))[2] AS BIGINT) AS n, CAST(0 AS INT) AS dim,
  round(coalesce(ft.f0, 0), 4) AS f0, round(depth, 4) AS depth, depth > 0.8 AS is_anomaly, CAST(NULL AS VARCHAR) AS error
FROM dp LEFT JOIN ft ON ft.series = dp.series"""
)


@query
def engine_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = engine.analyse(_orders(spark, sf_dir), engine.Config(fs=12.0, window=48, state_space=False, multivariate=False))["depths"]
    return show(d, "series", "dim", "is_anomaly", **dict.fromkeys(PARTS, 4))


PARTS = ("depth", "sc", "tp", "pc", "amp", "ci_lo", "ci_hi", "f0", "legacy_std")


def _embedded_sql(ms: list[int], taus: list[int]) -> str:
    """`em`: a series for each dimension of each embedding of the cleaned monthly orders, named series, m, tau and dimension."""
    return f""",
o0 AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS t, count(*) OVER (PARTITION BY series) AS n, v FROM zs),
em AS (
  SELECT o0.series || chr(2) || m || chr(2) || tau || chr(2) || dim AS series, t - dim * tau AS t, v
  FROM o0, (SELECT unnest({ms}) AS m), (SELECT unnest({taus}) AS tau), (SELECT unnest(range(0, {max(ms)})) AS dim)
  WHERE dim < m AND t >= dim * tau AND t < n - (m - 1 - dim) * tau),"""


ORACLES["engine_depths"] = (
    ORDERS_SQL + _embedded_sql([3], [1]) + detect_sql("em", 12.0) + "," + depth_sql("em", 48, 12.0, "ft")
    + """, al AS (SELECT e.series, coalesce(depth, 0) AS depth, coalesce(sc, 0) AS sc, coalesce(tp, 0) AS tp, coalesce(pc, 0) AS pc, coalesce(amp, 0) AS amp,
  coalesce(greatest(0, depth - h), 0) AS ci_lo, coalesce(least(1, depth + h), 0) AS ci_hi, coalesce(f0, 0) AS f0, coalesce(legacy_std, 0) AS legacy_std
  FROM (SELECT DISTINCT series FROM em) e LEFT JOIN hw ON hw.series = e.series)
SELECT string_split(series, chr(2))[1] AS series, CAST(string_split(series, chr(2))[4] AS INT) AS dim, depth > 0.8 AS is_anomaly, """
    + ", ".join(f"round({c}, 4) AS {c}" for c in PARTS) + " FROM al"
)


@query
def engine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The influence graph of the event types, taken as the dimensions of one system per half of the month."""
    e = views.hourly(spark, sf_dir)
    dims = e.select("series").distinct().withColumn("dim", F.dense_rank().over(Window.orderBy("series")) - 1)
    signal = e.join(F.broadcast(dims), "series").select(F.when(F.col("t") < 360, "early").otherwise("late").alias("series"), F.col("dim").cast("int").alias("dim"), "t", "v")
    return engine.analyse(signal, engine.Config(fs=1.0, state_space=False, surrogates=19, max_lag=3))["edges"].transform(show, "series", "src", "dst", "lag", weight=6, p=6)


ORACLES["engine_edges"] = (
    views.with_views("eh")
    + ", en AS (SELECT CASE WHEN t < 360 THEN 'early' ELSE 'late' END AS entity, CAST(dense_rank() OVER (ORDER BY series) - 1 AS VARCHAR) AS series, t, v FROM eh),"
    + lag_sql("en", "entity", tag="0")
    + """, pm AS (
  SELECT entity || '/' || surrogate AS trial, series, v,
    row_number() OVER (PARTITION BY entity, surrogate, series ORDER BY md5('0:' || surrogate || ':' || series || ':' || t || ':' || entity), t) - 1 AS t
  FROM en, (SELECT unnest(range(1, 20)) AS surrogate)),"""
    + lag_sql("pm", "trial")
    + """, pv AS (
  SELECT r.entity, r.src, r.dst, r.score, r.lag, CASE WHEN r.src = r.dst THEN 1 ELSE (sum(CASE WHEN n.score >= r.score THEN 1 ELSE 0 END) + 1) / 20.0 END AS p
  FROM sm0 r JOIN sm n ON n.src = r.src AND n.dst = r.dst AND string_split(n.trial, '/')[1] = r.entity GROUP BY r.entity, r.src, r.dst, r.score, r.lag),
a AS (SELECT entity, avg(score) + stddev_pop(score) AS bar FROM pv GROUP BY 1),
h AS (SELECT pv.* FROM pv JOIN a ON a.entity = pv.entity WHERE src <> dst AND score > bar),
g AS (SELECT * FROM h WHERE p <= 0.05)
SELECT entity AS series, src, dst, round(score, 6) AS weight, CAST(lag AS INT) AS lag, round(p, 6) AS p FROM g
UNION ALL SELECT entity, src, dst, round(score, 6), NULL, NULL FROM h WHERE entity NOT IN (SELECT entity FROM g)"""
)


@query
def physics_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.physics_lab(spark)["resonance_map"]


@query
def state_space_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state-space laboratory at an eighth of its size; metric, value."""
    found = recipes.state_space_lab(n=100, draws=40, particles=400)
    return spark.createDataFrame(sorted(found.items()), "metric string, value double")


@query
def depth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest depth and the number of edges of every series of monthly orders."""
    out = engine.analyse(_orders(spark, sf_dir), engine.Config(fs=12.0, window=48, state_space=False, surrogates=9))
    return recipes.result_tables(out)["summary"]


@query
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(engine.sweep(_orders(spark, sf_dir).drop("dim"), [2, 3], [1, 2], 48), "series", "m", "tau", depth=4)


ORACLES["parameter_sweep"] = (
    ORDERS_SQL + _embedded_sql([2, 3], [1, 2]).rstrip(",") + "," + depth_sql("em", 48)
    + """ SELECT string_split(e.series, chr(2))[1] AS series, CAST(string_split(e.series, chr(2))[2] AS INT) AS m, CAST(string_split(e.series, chr(2))[3] AS INT) AS tau,
  round(avg(coalesce(depth, 0)), 4) AS depth FROM (SELECT DISTINCT series FROM em) e LEFT JOIN dp ON dp.series = e.series GROUP BY 1, 2, 3"""
)


@query
def supervisory_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of every institution of a generated panel, keyed and without a loop: cleaned differences, window of 48 quarters."""
    panel = generators.supervisory_panel(spark)
    ds = scans.from_frame(panel, "date", entity="institution_id", peer_group="peer_group", how="diff", sampling_rate=4.0)
    return engine.analyse(ds.signal(), engine.Config(tau=2, fs=4.0, window=48, horizon=8, state_space=False, multivariate=False))["depths"]


@query
def policy_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = scans.from_frame(generators.policy_frame(spark), "date", how="diff", sampling_rate=4.0)
    return ss.bundle(ds.signal())


@query
def cockpit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated schedules of all banks through the shocks of both modes, in one plan."""
    return rg.rate_shock(generators.schedule_panel(spark), [100.0, 200.0])


@query
def reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded experiment: metric, value of the coupled oscillator's depth."""
    x = generators.generate(spark.createDataFrame([("sample", "coupled_oscillator", 800, 42)], "series string, system string, n int, seed int")).where("dim = 0")
    d = depth.depth_by_kernel(x, ["series"], 256, 200.0)
    return d.unpivot(["series"], ["depth", "sc", "tp", "pc", "amp", "ci_lo", "ci_hi", "f0"], "metric", "value").drop("series")


@query
def two_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.two_tones(spark, 2000, 50.0).select("t", rounded("v", 6).alias("v"))


ORACLES["two_tones"] = "SELECT CAST(i AS INT) AS t, round(sin(2 * pi() * 1.2 * i / 50) + 0.5 * sin(2 * pi() * 0.25 * i / 50), 6) AS v FROM range(0, 2000) r(i)"
