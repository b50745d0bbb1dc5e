"""Spectral, depth and rooting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalflow import views
from modalflow.functions.columns import rounded
from modalflow.operators import depth, rooting, spectral

DIMS = ["click", "error", "login", "purchase", "view"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def show(df: DataFrame, *keep: str, **digits: int) -> DataFrame:
    """The named columns, and measures rounded to so many digits."""
    return df.select(*keep, *(rounded(c, n).alias(c) for c, n in digits.items()))


_FFT = """
x AS (SELECT series, t, v - avg(v) OVER (PARTITION BY series) AS x, count(*) OVER (PARTITION BY series) AS n FROM eh),
d AS (
  SELECT series, k AS bin, n, sum(x * cos(2 * pi() * ((k * t) % n) / n)) AS re, sum(-x * sin(2 * pi() * ((k * t) % n) / n)) AS im
  FROM x, (SELECT unnest(range(0, max(n) // 2 + 1)) AS k FROM x) WHERE k <= n // 2 GROUP BY 1, 2, 3),
sp AS (SELECT series, bin, bin * 1.0 / n AS freq, sqrt(re * re + im * im) AS value FROM d)"""
_PEAKS = """
nb AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS ml, min(value) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mr FROM sp WINDOW w AS (PARTITION BY series ORDER BY bin)),
st AS (SELECT series, max(value) AS top, median(value) FILTER (freq > 0) AS noise_floor FROM sp GROUP BY 1),
pk AS (
  SELECT nb.series, bin, freq, value, noise_floor, value - greatest(ml, mr) AS prominence, l, r,
    row_number() OVER (PARTITION BY nb.series ORDER BY value DESC, bin DESC) AS rank, max(value) OVER (PARTITION BY nb.series) AS best
  FROM nb JOIN st USING (series) WHERE value > l AND value > r AND value >= 0.1 * top AND freq > 0)"""
_CONF = "greatest(0, least(1, (value - noise_floor) / greatest(best - noise_floor, 2.220446049250313e-16)))"


@query(views.with_views("eh") + "," + _FFT + " SELECT series, bin, round(freq, 6) AS freq, round(value, 3) AS value FROM sp")
def fft_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(spectral.fft_spectrum(views.hourly(spark, sf_dir), 1.0), "series", "bin", freq=6, value=3)


@query(
    views.with_views("eh") + "," + _FFT + "," + _PEAKS
    + f" SELECT series, bin, CAST(rank AS INT) AS rank, round(freq, 6) AS freq, round(value, 3) AS value, round({_CONF}, 4) AS confidence, round(noise_floor, 3) AS noise_floor FROM pk WHERE rank <= 5"
)
def fft_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.peaks(spectral.fft_spectrum(views.hourly(spark, sf_dir), 1.0), 0.1, positive=True).where("rank <= 5")
    return show(found, "series", F.col("bin").cast("long").alias("bin"), "rank", freq=6, value=3, confidence=4, noise_floor=3)


@query(views.with_views("eh") + "," + _FFT + "," + _PEAKS + " SELECT series, bin, round(prominence, 3) AS prominence FROM pk")
def peak_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.peaks(spectral.fft_spectrum(views.hourly(spark, sf_dir), 1.0), 0.1, positive=True)
    return show(found, "series", F.col("bin").cast("long").alias("bin"), prominence=3)


@query(
    views.with_views("eh") + "," + _FFT + "," + _PEAKS
    + " SELECT series, bin, round(exp(ln(freq) + greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * value + r))) * ln(2)), 6) AS refined FROM pk WHERE bin > 1"
)
def wavelet_peak_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = spectral.fft_spectrum(views.hourly(spark, sf_dir), 1.0)
    found = spectral.refine_log(sp, spectral.peaks(sp, 0.1, positive=True).where("bin > 1"))
    return show(found, "series", F.col("bin").cast("long").alias("bin"), refined=6)


def _welch_sql(source: str, n: int, step: int, tag: str) -> str:
    """Density of (series, t, v) rows over segments of n rows every `step`."""
    return f"""
{tag}s AS (SELECT e.series, s.seg, e.t - s.seg * {step} AS p, e.v FROM {source} e JOIN (SELECT unnest(range(0, 1000)) AS seg) s ON e.t >= s.seg * {step} AND e.t < s.seg * {step} + {n}),
{tag}f AS (SELECT series, seg FROM {tag}s GROUP BY ALL HAVING count(*) = {n}),
{tag}x AS (SELECT series, seg, p, (v - avg(v) OVER (PARTITION BY series, seg)) * (0.5 - 0.5 * cos(2 * pi() * p / {n})) AS x FROM {tag}s SEMI JOIN {tag}f USING (series, seg)),
{tag}d AS (
  SELECT series, seg, k AS bin, sum(x * cos(2 * pi() * ((k * p) % {n}) / {n})) AS re, sum(-x * sin(2 * pi() * ((k * p) % {n}) / {n})) AS im
  FROM {tag}x, (SELECT unnest(range(0, {n // 2 + 1})) AS k) GROUP BY ALL),
{tag}w AS (SELECT series, bin, bin * 1.0 / {n} AS freq, avg((re * re + im * im) / ({n} * 0.375) * CASE WHEN bin = 0 OR bin * 2 = {n} THEN 1 ELSE 2 END) AS value FROM {tag}d GROUP BY 1, 2)"""


_WELCH = _welch_sql("eh", 256, 128, "w")


@query(views.with_views("eh") + "," + _WELCH + " SELECT series, bin, round(freq, 6) AS freq, round(value, 3) AS value FROM ww")
def welch_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    psd = spectral.welch(spectral.segments(views.hourly(spark, sf_dir)), ["series"], 1.0)
    return show(psd, "series", "bin", freq=6, value=3)


@query(
    views.with_views("eh") + "," + _WELCH + ", sp AS (SELECT * FROM ww)," + _PEAKS
    + f" SELECT series, bin, CAST(rank AS INT) AS rank, round(freq, 6) AS freq, round({_CONF}, 4) AS confidence FROM pk"
)
def welch_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    psd = spectral.welch(spectral.segments(views.hourly(spark, sf_dir)), ["series"], 1.0)
    return show(spectral.peaks(psd, 0.1, positive=True), "series", F.col("bin").cast("long").alias("bin"), "rank", freq=6, confidence=4)


@query(
    views.with_views("ed")
    + " SELECT series, CAST(t AS INT) AS t, round(v, 4) AS x0, round(x1, 4) AS x1, round(x2, 4) AS x2 FROM (SELECT *, lead(v, 2) OVER w AS x1, lead(v, 4) OVER w AS x2 FROM ed WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE x2 IS NOT NULL"
)
def takens_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spectral.embed(views.daily(spark, sf_dir), 3, 2)
    return e.select("series", "t", *(rounded(F.col("x")[i]).alias(f"x{i}") for i in range(3)))


def _density_sql(tag: str, source: str, fs: float) -> str:
    """`{tag}w`: density, up to a factor, of each series of (series, t from 0, v) as one segment of at most 256 rows."""
    return f"""
{tag}x AS (
  SELECT series, t, n, (v - mean) * (0.5 - 0.5 * cos(2 * pi() * t / n)) AS x
  FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n, avg(v) OVER (PARTITION BY series) AS mean FROM {source})),
{tag}d AS (
  SELECT series, k AS bin, n, sum(x * cos(2 * pi() * ((k * t) % n) / n)) AS re, sum(-x * sin(2 * pi() * ((k * t) % n) / n)) AS im
  FROM {tag}x, (SELECT unnest(range(0, 129)) AS k) WHERE k <= n // 2 GROUP BY 1, 2, 3),
{tag}w AS (SELECT series, bin, bin * {fs:.1f} / n AS freq, (re * re + im * im) * CASE WHEN bin = 0 OR bin * 2 = n THEN 1 ELSE 2 END AS value FROM {tag}d),
{tag}t AS (SELECT series, arg_max(freq, struct_pack(value := value, b := -bin)) AS f FROM {tag}w WHERE freq > 0 GROUP BY 1)"""


def depth_sql(source: str, window: int, fs: float = 1.0, target: str | None = None) -> str:
    """`dp` (depth and its parts) and `hw` (with half widths) of (series, t from 0, v) rows, for windows of at most 256.

    `target` names (series, f0) of the frequencies to take where there are any.
    """
    given = f"SELECT jt.series, coalesce(g.f0, jt.f) AS f0 FROM jt LEFT JOIN {target} g ON g.series = jt.series" if target else "SELECT series, f AS f0 FROM jt"
    return (
        f"""
nn AS (SELECT series, t, v, count(*) OVER (PARTITION BY series) AS n FROM {source}),
lw AS (SELECT series, t - n + {window} AS t, v FROM nn WHERE n >= {window} AND t >= n - {window}),"""
        + _density_sql("j", "lw", fs)
        + f""",
tg AS ({given}),
md AS (SELECT jw.series, arg_min(bin, struct_pack(d := abs(freq - f0), b := bin)) AS mid FROM jw JOIN tg ON tg.series = jw.series GROUP BY 1),
sc AS (
  SELECT jw.series, CASE WHEN sum(value) FILTER (freq > 0) > 0 THEN least(1, sum(value) FILTER (abs(bin - mid) <= 1) / sum(value) FILTER (freq > 0)) ELSE 0 END AS sc
  FROM jw JOIN md ON md.series = jw.series GROUP BY 1),
sz AS (SELECT series, t, v, n, least({window}, greatest(32, n // 4)) AS size FROM nn WHERE n >= {window}),
sg AS (SELECT series || chr(1) || (t // size) AS series, t % size AS t, v FROM sz WHERE (t // size + 1) * size <= n),"""
        + _density_sql("g", "sg", fs)
        + f""",
sw AS (SELECT series, greatest({fs:.1f} / min(size), 0.5) AS width FROM sz GROUP BY 1),
tp AS (
  SELECT tg.series, avg(exp(-(((f - f0) / width) ** 2))) AS tp
  FROM gt JOIN tg ON tg.series = string_split(gt.series, chr(1))[1] JOIN sw ON sw.series = tg.series GROUP BY 1),
zx AS (SELECT series, t, v - avg(v) OVER (PARTITION BY series) AS x FROM lw),
zd AS (SELECT series, k, sum(x * cos(2 * pi() * ((k * t) % {window}) / {window})) AS re, sum(-x * sin(2 * pi() * ((k * t) % {window}) / {window})) AS im FROM zx, (SELECT unnest(range(0, {window // 2 + 1})) AS k) GROUP BY 1, 2),
za AS (
  SELECT series, t, sum(m * (re * cos(a) - im * sin(a))) AS re, sum(m * (re * sin(a) + im * cos(a))) AS im
  FROM (SELECT series, t, re, im, CASE WHEN k = 0 OR k * 2 = {window} THEN 1.0 ELSE 2.0 END / {window} AS m, 2 * pi() * ((k * t) % {window}) / {window} AS a FROM zd, (SELECT unnest(range(0, {window})) AS t)) GROUP BY 1, 2),
zp AS (
  SELECT series, least(1, sqrt(avg(cos(u)) ** 2 + avg(sin(u)) ** 2)) AS pc, CASE WHEN avg(r) > 2.220446049250313e-16 THEN greatest(0, least(1, 1 - stddev_pop(r) / avg(r))) ELSE 0 END AS amp
  FROM (SELECT za.series, atan2(im, re) - 2 * pi() * f0 * t / {fs:.1f} AS u, sqrt(re * re + im * im) AS r FROM za JOIN tg ON tg.series = za.series) GROUP BY 1),
dp AS (
  SELECT series, greatest(0, least(1, 0.35 * sc + 0.25 * tp + 0.25 * pc + 0.15 * amp)) AS depth, sc, tp, pc, amp, f0, legacy_std
  FROM tg JOIN sc USING (series) JOIN tp USING (series) JOIN zp USING (series) JOIN (SELECT series, stddev_samp(v) AS legacy_std FROM lw GROUP BY 1) USING (series)),
hw AS (SELECT *, greatest(0.02, least(0.25, 1.96 * sqrt(greatest(depth * (1 - depth), 0) / {max(4, window // 32)}))) AS h FROM dp)"""
    )


def detect_sql(source: str, fs: float) -> str:
    """`pk`: peaks of the transform of (series, t from 0, v) rows, ranked; `ft`: series and the strongest one's frequency f0."""
    return _FFT.replace("FROM eh", f"FROM {source}").replace("bin * 1.0 / n", f"bin * {fs:.1f} / n") + "," + _PEAKS + ",\nft AS (SELECT series, freq AS f0 FROM pk WHERE rank = 1)"


_DEPTH = depth_sql("eh", 256)
_DEPTH_SELECT = " SELECT series, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("depth", "sc", "tp", "pc", "amp", "f0", "legacy_std")) + ", round(greatest(0, depth - h), 4) AS ci_lo, round(least(1, depth + h), 4) AS ci_hi FROM hw"


@query(views.with_views("eh") + "," + _DEPTH + _DEPTH_SELECT)
def depth_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depth.depth_by_kernel(views.hourly(spark, sf_dir), ["series"], 256)
    return show(d, "series", depth=4, sc=4, tp=4, pc=4, amp=4, f0=4, legacy_std=4, ci_lo=4, ci_hi=4)


@query(
    views.with_views("eh") + "," + _DEPTH
    + """, o AS (SELECT row_number() OVER (ORDER BY series) AS i, depth FROM dp),
b AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0.5 AS DOUBLE) AS b UNION ALL
  SELECT b.i + 1, greatest(0.01, least(0.99, b.b + 0.1 * (1 / (1 + exp(-2 * ln(9) * (o.depth - 0.5))) - b.b))) FROM b JOIN o ON o.i = b.i + 1)
SELECT round(b, 6) AS belief, b > 0.65 AS is_rooted FROM b WHERE i = (SELECT max(i) FROM o)"""
)
def belief_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = depth.belief(depth.depth_by_kernel(views.hourly(spark, sf_dir), ["series"], 256), [], "series")
    return b.select(rounded("belief", 6).alias("belief"), "is_rooted")


@query(views.with_views("eh") + "," + _DEPTH + " SELECT series, round(depth, 4) AS depth, depth > 0.4 AS is_anomaly FROM dp")
def anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depth.depth_by_kernel(views.hourly(spark, sf_dir), ["series"], 256)
    return d.select("series", rounded("depth").alias("depth"), (F.col("depth") > 0.4).alias("is_anomaly"))


def lag_sql(source: str, keys: str = "", lags: int = 3, tag: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = f" AND a.{keys} = b.{keys}" if keys else ""
    ak = f"a.{keys}, " if keys else ""
    return f"""
lc{tag} AS (
  SELECT {ak}a.series AS src, b.series AS dst, l.lag AS lag, CASE WHEN count(*) >= 2 AND stddev_pop(a.v) > 2.3e-16 AND stddev_pop(b.v) > 2.3e-16 THEN abs(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v))) ELSE 0 END AS r
  FROM {source} a CROSS JOIN (SELECT unnest(range(1, {lags + 1})) AS lag) l JOIN {source} b ON b.t = a.t + l.lag AND a.series <> b.series{on} GROUP BY ALL),
sm{tag} AS (
  SELECT {k}src, dst, max(r) AS score, arg_max(lag, struct_pack(r := r, l := -lag)) AS lag FROM lc{tag} GROUP BY ALL
  UNION ALL SELECT DISTINCT {k}series, series, 0, 0 FROM {source})"""


@query(views.with_views("ed") + "," + lag_sql("ed") + " SELECT src, dst, round(score, 6) AS score, CAST(lag AS INT) AS lag FROM sm")
def lagcorr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(_scores(spark, sf_dir), "src", "dst", "lag", score=6)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooting.lagged_correlation(rooting.widen(views.daily(spark, sf_dir), dims(spark, sf_dir)), dims(spark, sf_dir), 3)


def dims(spark: SparkSession, sf_dir: str) -> list[str]:
    """The dimensions of the event signals, sorted; a panel has few."""
    return sorted(r[0] for r in views.table(spark, sf_dir, "events").select("event_type").distinct().collect())


@query(
    views.with_views("ed") + "," + lag_sql("ed")
    + """, o AS (SELECT avg(score) + stddev_pop(score) AS bar FROM sm WHERE src <> dst), a AS (SELECT avg(score) + stddev_pop(score) AS bar FROM sm)
SELECT src, dst, round(score, 6) AS weight, CAST(lag AS INT) AS lag, CAST(0 AS DOUBLE) AS p FROM sm, o, a WHERE src <> dst AND score > o.bar AND score > 0 AND score > a.bar"""
)
def root_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(rooting.edges(rooting.plain_p(_scores(spark, sf_dir))), "src", "dst", "lag", "p", weight=6)


_PERM = """
pm AS (
  SELECT surrogate, series, row_number() OVER (PARTITION BY surrogate, series ORDER BY md5('7:' || surrogate || ':' || series || ':' || t), t) - 1 AS t, v
  FROM ed, (SELECT unnest(range(1, 20)) AS surrogate)),"""
_P = (
    views.with_views("ed") + "," + lag_sql("ed", tag="0")
    + "," + _PERM + lag_sql("pm", "surrogate")
    + """, pv AS (
  SELECT r.src, r.dst, r.score, r.lag, CASE WHEN r.src = r.dst THEN 1 ELSE (sum(CASE WHEN n.score >= r.score THEN 1 ELSE 0 END) + 1) / 20.0 END AS p
  FROM sm0 r JOIN sm n ON n.src = r.src AND n.dst = r.dst GROUP BY r.src, r.dst, r.score, r.lag)"""
)


@query(_P + " SELECT src, dst, round(score, 6) AS score, CAST(lag AS INT) AS lag, round(p, 6) AS p FROM pv")
def surrogate_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.daily(spark, sf_dir)
    return show(rooting.surrogate_p(_scores(spark, sf_dir), d, dims(spark, sf_dir), 3, 19, 7), "src", "dst", "lag", score=6, p=6)


@query(
    _P + """, a AS (SELECT avg(score) + stddev_pop(score) AS bar FROM pv),
g AS (SELECT src, dst, score, lag, p FROM pv, a WHERE src <> dst AND score > bar AND p <= 0.05)
SELECT src, dst, round(score, 6) AS weight, CAST(lag AS INT) AS lag, round(p, 6) AS p FROM g
UNION ALL SELECT src, dst, round(score, 6), NULL, NULL FROM pv, a WHERE src <> dst AND score > bar AND NOT EXISTS (SELECT 1 FROM g)"""
)
def influence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.daily(spark, sf_dir)
    p = rooting.surrogate_p(_scores(spark, sf_dir), d, dims(spark, sf_dir), 3, 19, 7)
    return show(rooting.influence_graph(p), "src", "dst", "lag", weight=6, p=6)


@query(
    _P + """ SELECT a.src, a.dst, a.p <= 0.35 AS is_root,
  CASE WHEN a.score > b.score THEN a.src || ' leads ' || a.dst WHEN a.score < b.score THEN a.dst || ' leads ' || a.src ELSE 'no direction' END AS direction
FROM pv a JOIN pv b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst AND a.score > 0.1"""
)
def root_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots at the dashboard's confidence, and the stronger direction of each pair; weights of at most 0.1 are left out."""
    p = rooting.surrogate_p(_scores(spark, sf_dir), views.daily(spark, sf_dir), dims(spark, sf_dir), 3, 19, 7)
    return rooting.directions(p, 0.65, 0.1)


@query(
    views.with_views("eh") + "," + _WELCH + ", sp AS (SELECT * FROM ww)," + _PEAKS
    + " SELECT series, count(*) AS peaks, round(avg(value) / min(mean), 4) AS depth FROM pk JOIN (SELECT series, avg(value) AS mean FROM sp GROUP BY 1) USING (series) GROUP BY 1"
)
def peak_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean density at the peaks over the mean density of all bins."""
    psd = spectral.welch(spectral.segments(views.hourly(spark, sf_dir)), ["series"], 1.0)
    mean = psd.groupBy("series").agg(F.avg("value").alias("mean"))
    found = spectral.peaks(psd, 0.1, positive=True).join(mean, "series").groupBy("series")
    return show(found.agg(F.count(F.lit(1)).alias("peaks"), (F.avg("value") / F.min("mean")).alias("depth")), "series", "peaks", depth=4)


@query(
    views.with_views("eh") + " SELECT series, CAST(t AS INT) AS t, round(v, 4) AS v FROM eh WHERE t % 8 = 0"
)
def plot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot data of long signals: every 8th step."""
    return show(views.hourly(spark, sf_dir).where("pmod(t, 8) = 0"), "series", "t", v=4)


@query(
    views.with_views("eh")
    + """, sp AS (SELECT series, min(v) AS lo, max(v) AS hi FROM eh GROUP BY 1),
b AS (SELECT eh.series, t, CASE WHEN hi <= lo THEN 5 ELSE CAST(least(floor((v - lo) / (hi - lo) * 10), 9) AS INT) END AS b FROM eh JOIN sp ON sp.series = eh.series),
tr AS (SELECT a.series AS src, y.series AS dst, l.lag, a.b AS s, y.b AS y, z.b AS z FROM b a CROSS JOIN (SELECT unnest([1, 2]) AS lag) l JOIN b y ON y.t = a.t + l.lag AND y.series <> a.series JOIN b z ON z.series = y.series AND z.t = y.t + 1),
c AS (SELECT src, dst, lag, s, y, z, count(*) AS n FROM tr GROUP BY ALL),
e AS (SELECT src, dst, lag, n / sum(n) OVER (PARTITION BY src, dst, lag) * log2((n / sum(n) OVER (PARTITION BY src, dst, lag, s, y)) / (sum(n) OVER (PARTITION BY src, dst, lag, y, z) / sum(n) OVER (PARTITION BY src, dst, lag, y))) AS bits FROM c),
f AS (SELECT src, dst, lag, sum(bits) AS te FROM e GROUP BY ALL)
SELECT src, dst, round(greatest(max(te), 0), 6) AS te, CAST(arg_max(lag, struct_pack(te := te, l := -lag)) AS INT) AS lag FROM f GROUP BY 1, 2"""
)
def transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(rooting.transfer_entropy(views.hourly(spark, sf_dir), 2), "src", "dst", "lag", te=6)


@query(
    """WITH n AS (SELECT event_type AS from_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_state FROM events),
c AS (SELECT from_state, to_state, count(*) AS n FROM n WHERE to_state IS NOT NULL GROUP BY ALL)
SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS p FROM c"""
)
def markov_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(rooting.transitions(views.table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"]), "from_state", "to_state", "n", p=6)


@query(
    views.with_views("eh")
    + """, w AS (SELECT series, k AS win, avg(v) AS mean, stddev_samp(v) AS sd FROM eh JOIN (SELECT unnest(range(0, greatest(0, (max(t) + 1 - 168 + 23) // 24))) AS k FROM eh) ON t >= k * 24 AND t < k * 24 + 168 GROUP BY 1, 2)
SELECT series, win, round(mean, 6) AS mean, round(sd, 4) AS sd FROM w"""
)
def sliding_window_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 168 hours every 24; each row goes to the at most seven windows that hold it.

    Values have two decimals, so a mean of 168 can be a tie at four decimals and never at six.
    """
    e = views.hourly(spark, sf_dir)
    size = e.agg((F.max("t") + 1).alias("steps"))
    rows = e.crossJoin(F.broadcast(size)).withColumn("win", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("t") - 167) / 24)), F.floor(F.col("t") / 24)))).where(F.col("win") * 24 < F.col("steps") - 168)
    return show(rows.groupBy("series", "win").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")), "series", "win", mean=6, sd=4)


@query(
    views.with_views("ed")
    + """, p AS (SELECT a.series AS x, b.series AS y, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN corr(a.v, b.v) END AS r FROM ed a JOIN ed b ON a.t = b.t GROUP BY 1, 2)
SELECT x, y, round(r, 6) AS r FROM p"""
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = dims(spark, sf_dir)
    r = rooting.correlation(rooting.widen(views.daily(spark, sf_dir), names), names)
    return r.select("x", "y", rounded("r", 6).alias("r"))


@query(
    views.with_views("eh") + "," + _FFT + "," + _PEAKS
    + ", q AS (SELECT * FROM pk WHERE rank <= 10) SELECT series, count(*) AS n, string_agg(printf('%.4f', freq), ';' ORDER BY rank) AS detected FROM q GROUP BY 1"
)
def resonance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.peaks(spectral.fft_spectrum(views.hourly(spark, sf_dir), 1.0), 0.1, positive=True).where("rank <= 10")
    text = F.transform(F.array_sort(F.collect_list(F.struct("rank", "freq"))), lambda x: F.format_string("%.4f", x["freq"]))
    return found.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.array_join(text, ";").alias("detected"))


@query(
    """SELECT event_type, time_bucket(INTERVAL '6 hours', ts) - TIMESTAMP '2024-01-01' AS off, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""".replace(
        "time_bucket(INTERVAL '6 hours', ts) - TIMESTAMP '2024-01-01' AS off", "date_diff('hour', TIMESTAMP '2024-01-01', ts) // 6 AS win"
    )
)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    hours = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    return show(e.groupBy("event_type", F.floor(hours / 6).alias("win")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "event_type", "win", "n", total=3)


@query(
    """WITH g AS (SELECT user_id, event_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('second', lag(ts) OVER w, ts) >= 86400 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY 1, 2"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    e = views.table(spark, sf_dir, "events").withColumn("sec", sec)
    fresh = F.coalesce((F.col("sec") - F.lag("sec").over(by) >= 86400).cast("int"), F.lit(1))
    s = e.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(by))
    return show(s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "user_id", "session", "n", total=3)
