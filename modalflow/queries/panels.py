"""Panel preparation, regulatory, dashboard and backtest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalflow import views
from modalflow.functions.columns import rounded
from modalflow.operators import backtest, prep
from modalflow.operators import regulatory as rg

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
METRICS = ["order_total", "order_count", "mean_price", "mean_discount"]
IDS = ["institution", "peer_group", "date"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def show(df: DataFrame, *keep: str, **digits: int) -> DataFrame:
    return df.select(*keep, *(rounded(c, n).alias(c) for c, n in digits.items()))


def _prep_sql(how: str, fill: bool = True, z: bool = True, source: str = "om") -> str:
    """transform, interpolate by position, drop nulls, z-score of (series, t, v)."""
    step = {
        "level": "v", "diff": "v - lag(v) OVER w", "pct_change": "100 * (last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) / last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1)",
        "log_diff": "ln(v) - lag(ln(v)) OVER w",
    }[how]
    sql = f"""
tr AS (SELECT series, t, {step} AS v, row_number() OVER w AS p FROM {source} WINDOW w AS (PARTITION BY series ORDER BY t)),
nv AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN struct_pack(p := p, v := v) END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN v IS NOT NULL THEN struct_pack(p := p, v := v) END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM tr WINDOW w AS (PARTITION BY series ORDER BY t)),
fl AS (SELECT series, t, {"CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL THEN b.v WHEN b IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (p - a.p) / (b.p - a.p) END" if fill else "v"} AS v FROM nv)"""
    out = "(v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END" if z else "v"
    return sql + f", zs AS (SELECT series, t, {out} AS v FROM fl WHERE v IS NOT NULL WINDOW w AS (PARTITION BY series))"


#: `zs`: the monthly orders, interpolated and standardized.
ORDERS_SQL = views.with_views("om") + "," + _prep_sql("level", True, True)


def _prep(name: str, how: str, fill: bool = True, z: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = prep.clean(views.monthly_orders(spark, sf_dir), ["series"], "t", ["v"], how, fill, z)
        return show(c, "series", "t", v=4)

    run.__name__ = name
    query(views.with_views("om") + "," + _prep_sql(how, fill, z) + " SELECT series, CAST(t AS INT) AS t, round(v, 4) AS v FROM zs")(run)


for _name, _args in {
    "prep_level_drop": ("level", False, False), "prep_interpolate": ("level", True, False), "prep_zscore": ("level", True, True), "prep_diff": ("diff", True, False),
    "prep_diff_drop": ("diff", False, False), "prep_pct_change": ("pct_change", True, False), "prep_log_diff": ("log_diff", True, True),
}.items():
    _prep(_name, *_args)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.clean(views.nation_panel(spark, sf_dir), ["institution"], "date", METRICS)


_LONG = "ml AS (" + " UNION ALL ".join(f"SELECT institution, peer_group, date, '{m}' AS metric, {m} AS value FROM nq" for m in METRICS) + ")"
_PANEL = ", " + _LONG + ", om AS (SELECT institution || '/' || peer_group || '/' || metric AS series, date AS t, value AS v FROM ml)," + _prep_sql("level") + """,
pn AS (SELECT split_part(series, '/', 1) AS institution, split_part(series, '/', 2) AS peer_group, split_part(series, '/', 3) AS metric, t AS date, v AS value FROM zs)"""


@query(views.with_views("nq") + _PANEL + " SELECT institution, peer_group, date, metric, round(value, 4) AS value FROM pn")
def panel_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(prep.melt(_panel(spark, sf_dir), IDS, METRICS), *IDS, "metric", value=4)


@query(views.with_views("nq") + ", " + _LONG + " SELECT institution, date, metric, round(ln(1 + value), 6) AS log_value FROM ml")
def panel_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms, as plain sums of cents have exact ties that two engines round apart."""
    m = prep.melt(views.nation_panel(spark, sf_dir), IDS, METRICS)
    return show(m.withColumn("log_value", F.log(1 + F.col("value"))), "institution", "date", "metric", log_value=6)


@query(views.with_views("nq") + _PANEL + " SELECT peer_group, date, metric, round(avg(value), 4) AS value FROM pn GROUP BY 1, 2, 3")
def peer_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(prep.melt(prep.peer_mean(_panel(spark, sf_dir), "peer_group", "date", METRICS), ["peer_group", "date"], METRICS), "peer_group", "date", "metric", value=4)


@query(views.with_views("nq") + _PANEL + " SELECT date, metric, round(value, 4) AS value FROM pn WHERE institution = (SELECT min(n_name) FROM nation)")
def institution_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = views.table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return show(prep.melt(prep.institution(_panel(spark, sf_dir), "institution", name), ["date"], METRICS), "date", "metric", value=4)


@query(
    views.with_views("nq") + ", f AS (SELECT institution, min((date, institution)) AS f FROM nq GROUP BY 1) SELECT institution, CAST(row_number() OVER (ORDER BY f, institution) AS INT) AS position FROM f"
)
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.first_seen(views.nation_panel(spark, sf_dir), "institution", ["date", "institution"])


@query(
    views.with_views("nq") + """ SELECT count(*) AS rows_before, count(DISTINCT institution) AS institution_count, count(*) FILTER (institution IN (SELECT institution FROM nq GROUP BY 1 HAVING count(order_total) > 0 AND count(mean_price) > 0 AND count(mean_discount) > 0)) AS rows_after, 'level' AS transform, 'sql_query' AS source FROM nq"""
)
def panel_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.provenance(views.nation_panel(spark, sf_dir), _panel(spark, sf_dir), "institution", "level", "sql_query")


_SCORE = views.with_views("nq") + _PANEL + ", sc AS (SELECT institution, date, avg(abs(value)) AS score FROM pn GROUP BY 1, 2)"


@query(_SCORE + ", q AS (SELECT quantile_cont(score, 0.75) AS bar FROM sc) SELECT institution, date, round(score, 4) AS score, score >= bar AS alert FROM sc, q")
def alert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prep.alert_score(_panel(spark, sf_dir), METRICS)
    bar = s.agg(F.percentile("score", F.lit(0.75)).alias("bar"))
    return s.crossJoin(F.broadcast(bar)).select("institution", "date", rounded("score").alias("score"), (F.col("score") >= F.col("bar")).alias("alert"))


_EVENTS = """
ev AS (SELECT institution, date, score, abs(score) >= 1.4 AS event, row_number() OVER w AS row FROM sc WINDOW w AS (PARTITION BY institution ORDER BY date)),
mt AS (SELECT *, score >= 1.1 AS alert, CASE WHEN score >= 1.1 THEN first_value(CASE WHEN event THEN row END IGNORE NULLS) OVER (PARTITION BY institution ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS hit FROM ev)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prep.alert_score(_panel(spark, sf_dir), METRICS).withColumn("event", F.col("score") >= 1.4)
    return backtest.matched(s, ["institution"], "date", "score", "event", 1.1, 2)


@query(_SCORE + "," + _EVENTS + """ SELECT institution, CAST(sum(CAST(alert AS INT)) AS BIGINT) AS alerts, count(hit) AS true_positives, CAST(sum(CAST(alert AS INT)) - count(hit) AS BIGINT) AS false_positives,
  CAST(sum(CAST(event AS INT)) AS BIGINT) AS events, count(DISTINCT hit) AS detected, CAST(sum(CAST(event AS INT)) - count(DISTINCT hit) AS BIGINT) AS missed, round(coalesce(count(hit) / nullif(sum(CAST(alert AS INT)), 0), 0), 4) AS precision,
  round(coalesce(count(DISTINCT hit) / nullif(sum(CAST(event AS INT)), 0), 0), 4) AS recall, round(avg(hit - row), 4) AS mean_lead FROM mt GROUP BY 1""")
def event_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = backtest.summary(_matched(spark, sf_dir), ["institution"], "event")
    return show(s, "institution", "alerts", "true_positives", "false_positives", "events", "detected", "missed", precision=4, recall=4, mean_lead=4)


@query(_SCORE + "," + _EVENTS + " SELECT institution, date, hit - row AS ahead FROM mt WHERE alert AND hit IS NOT NULL")
def forward_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).where("alert and hit is not null").select("institution", "date", F.col("ahead").cast("long").alias("ahead"))


def _reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views' schedules are groups by the key, so they meet in one shuffle."""
    return rg.merge_unique(*views.schedules(spark, sf_dir))


_REG_VALUES = [
    "ral_overnight_repo", "ral_eurusd_borr", "ral_term_repo", "hc_b_afs_securities", "hc_b_htm_securities", "hc_b_afs_duration", "hc_b_htm_duration",
    "hc_r_cet1", "hc_r_rwa", "hc_r_aoci", "total_repo_dependency", "securities_total",
]
_REG = views.with_views("reg")


def _rounds(*names: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in names)


@query(_REG + " SELECT rssd_id, report_date, legal_name, hub_country, " + _rounds(*_REG_VALUES) + " FROM reg")
def reg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(_reg(spark, sf_dir), "rssd_id", "report_date", "legal_name", "hub_country", **dict.fromkeys(_REG_VALUES, 4))


@query(_REG + " SELECT rssd_id, report_date, legal_name, hub_country, " + _rounds(*_REG_VALUES) + " FROM reg")
def reg_full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by two chained full joins, the way for schedules that repeat a key."""
    r = rg.merge(*views.schedules(spark, sf_dir))
    return show(r, "rssd_id", "report_date", "legal_name", "hub_country", **dict.fromkeys(_REG_VALUES, 4))


@query(
    _REG + """ SELECT rssd_id, report_date, round(coalesce(d.depth, 0), 4) AS depth FROM reg
LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS rssd_id, 0.1 * n_regionkey + 0.05 AS depth FROM nation WHERE n_regionkey <> 1) d USING (rssd_id)"""
)
def bank_depth_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bank's depth beside its rows; banks that have none get 0."""
    nation = views.table(spark, sf_dir, "nation").where("n_regionkey <> 1")
    depths = nation.select(F.col("n_nationkey").cast("string").alias("rssd_id"), (F.lit(0.1) * F.col("n_regionkey") + 0.05).alias("depth"))
    return show(rg.with_depth(_reg(spark, sf_dir), depths), "rssd_id", "report_date", depth=4)


@query(_REG + " SELECT DISTINCT rssd_id FROM reg ORDER BY rssd_id LIMIT 20")
def first_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.first_banks(_reg(spark, sf_dir))


for _i, _kind in enumerate(("liq", "sec", "cap")):

    def _schedule(spark: SparkSession, sf_dir: str, i: int = _i) -> DataFrame:
        s = views.schedules(spark, sf_dir)[i]
        text = [c for c, t in s.dtypes if t != "double"]
        return show(s, *text, **{c: 4 for c, t in s.dtypes if t == "double"})

    _cols = {"liq": _REG_VALUES[:3], "sec": _REG_VALUES[3:7], "cap": _REG_VALUES[7:10]}[_kind]
    _text = "rssd_id, report_date" + (", legal_name, hub_country" if _kind == "liq" else "")
    _schedule.__name__ = {"liq": "scan_liquidity", "sec": "scan_securities", "cap": "scan_capital"}[_kind]
    query(views.with_views(_kind) + f" SELECT {_text}, {_rounds(*_cols)} FROM {_kind}")(_schedule)


@query(_REG + " SELECT rssd_id, report_date, " + ", ".join(f"round(coalesce({c}, 0), 4) AS {c}" for c in _REG_VALUES) + " FROM reg")
def bank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(rg.bank_matrix(_reg(spark, sf_dir), _REG_VALUES), "rssd_id", "report_date", **dict.fromkeys(_REG_VALUES, 4))


_SHOCK = _REG + """, sh AS (
  SELECT reg.*, b AS shock_bps, m AS aoci_mode, hc_b_afs_duration * b / 1e4 * hc_b_afs_securities AS afs_loss, hc_b_htm_duration * b / 1e4 * hc_b_htm_securities AS htm_loss
  FROM reg, (SELECT unnest([100.0, 200.0]) AS b), (SELECT unnest(['full_aoci', 'opt_out']) AS m)),
sk AS (SELECT *, afs_loss + htm_loss AS total_loss, (CASE WHEN aoci_mode = 'full_aoci' THEN hc_r_cet1 - (afs_loss + htm_loss) ELSE hc_r_cet1 END) / nullif(hc_r_rwa, 0) AS shocked_ratio FROM sh)"""


def _shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.rate_shock(_reg(spark, sf_dir), [100.0, 200.0])


@query(_SHOCK + " SELECT rssd_id, report_date, CAST(shock_bps AS DOUBLE) AS shock_bps, aoci_mode, round(total_loss, 4) AS total_loss, round(shocked_ratio, 6) AS shocked_ratio, coalesce(shocked_ratio < 0.065, false) AS breach FROM sk")
def rate_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(_shock(spark, sf_dir), "rssd_id", "report_date", "shock_bps", "aoci_mode", "breach", total_loss=4, shocked_ratio=6)


@query(_SHOCK + """ SELECT rssd_id, report_date, CAST(shock_bps AS DOUBLE) AS shock_bps, round(max(shocked_ratio) FILTER (aoci_mode = 'full_aoci') - max(shocked_ratio) FILTER (aoci_mode = 'opt_out'), 6) AS aoci_impact FROM sk GROUP BY 1, 2, 3""")
def aoci_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(rg.aoci_impact(_shock(spark, sf_dir)), "rssd_id", "report_date", "shock_bps", aoci_impact=6)


@query(_SHOCK + """ SELECT rssd_id, report_date, round((hc_r_cet1 / nullif(hc_r_rwa, 0) - shocked_ratio) / (shock_bps / 100), 6) AS sensitivity FROM sk WHERE aoci_mode = 'full_aoci' AND shock_bps = 200""")
def bi_shock_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shock(spark, sf_dir).where("aoci_mode = 'full_aoci' and shock_bps = 200")
    return show(s.withColumn("sensitivity", (F.try_divide("hc_r_cet1", "hc_r_rwa") - F.col("shocked_ratio")) / (F.col("shock_bps") / 100)), "rssd_id", "report_date", sensitivity=6)


_BI = _REG + """, bi AS (SELECT *, (ral_overnight_repo + ral_eurusd_borr) / nullif(hc_r_cet1, 0) AS stress, hc_r_cet1 / nullif(hc_r_rwa, 0) AS ratio FROM reg)"""


def _bi(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reg(spark, sf_dir)
    return r.withColumns({"stress": rg.stress_index(r), "ratio": F.try_divide("hc_r_cet1", "hc_r_rwa")})


@query(_BI + """ SELECT rssd_id, report_date, round(stress, 4) AS stress, CASE WHEN stress >= 0.8 THEN 'Red' WHEN stress >= 0.5 THEN 'Amber' ELSE 'Green' END AS status,
  CASE WHEN ratio IS NULL THEN NULL WHEN ratio >= 0.09 THEN 'Well capitalized' WHEN ratio >= 0.065 THEN 'Adequately capitalized' WHEN ratio >= 0.05 THEN 'Undercapitalized' ELSE 'Critically undercapitalized' END AS tier,
  coalesce(ratio < 0.065, false) AS breach, round(stress * ratio * 100, 4) AS risk_score FROM bi""")
def bi_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bi(spark, sf_dir)
    x = b.withColumns({"status": rg.status(F.col("stress")), "tier": rg.tier(F.col("ratio")), "breach": F.coalesce(F.col("ratio") < rg.PCA_RATIO, F.lit(False)), "risk_score": F.col("stress") * F.col("ratio") * 100})
    return show(x, "rssd_id", "report_date", "status", "tier", "breach", stress=4, risk_score=4)


@query(_BI + " SELECT rssd_id, round(sum(hc_b_afs_duration * hc_b_afs_securities + hc_b_htm_duration * hc_b_htm_securities) / sum(hc_b_afs_securities + hc_b_htm_securities), 4) AS beta, round(sum(hc_r_cet1) / sum(hc_r_rwa), 6) AS ratio, round(2 * sum(hc_b_afs_duration * hc_b_afs_securities + hc_b_htm_duration * hc_b_htm_securities) / sum(hc_b_afs_securities + hc_b_htm_securities) * 100, 3) AS impact FROM bi GROUP BY 1")
def bi_duration_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _bi(spark, sf_dir).groupBy("rssd_id").agg(rg.duration_beta().alias("beta"), F.try_divide(F.sum("hc_r_cet1"), F.sum("hc_r_rwa")).alias("ratio"))
    return show(g.withColumn("impact", 2 * F.col("beta") * 100), "rssd_id", beta=4, ratio=6, impact=3)


@query(_BI + " SELECT rssd_id, report_date, round(stress - lag(stress) OVER w, 4) AS qoq, round(stress - lag(stress, 4) OVER w, 4) AS yoy FROM bi WINDOW w AS (PARTITION BY rssd_id ORDER BY report_date)")
def bi_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(rg.changes(_bi(spark, sf_dir), "stress"), "rssd_id", "report_date", qoq=4, yoy=4)


@query(_BI + " SELECT rssd_id, report_date, CAST(dense_rank() OVER (PARTITION BY report_date ORDER BY stress DESC NULLS LAST) AS INT) AS rank FROM bi")
def bi_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.dense_rank(_bi(spark, sf_dir), "stress").select("rssd_id", "report_date", "rank")


@query(_BI + """ SELECT hub_country, round(max(stress), 4) AS max_stress, round(avg(ratio), 6) AS avg_ratio, CAST(sum(CASE WHEN ratio < 0.065 THEN 1 ELSE 0 END) AS BIGINT) AS breaches,
  round(count(DISTINCT CASE WHEN stress >= 1 THEN rssd_id END) / count(DISTINCT rssd_id), 4) AS share_at_risk, round(sum(stress * hc_r_rwa) / sum(hc_r_rwa), 4) AS weighted_stress FROM bi WHERE hub_country IS NOT NULL GROUP BY 1""")
def bi_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(rg.by_country(_bi(spark, sf_dir)), "hub_country", "breaches", max_stress=4, avg_ratio=6, share_at_risk=4, weighted_stress=4)


@query(_BI + " SELECT rssd_id, report_date, round(max(stress) OVER (PARTITION BY rssd_id), 4) AS bank_max, max(stress) OVER (PARTITION BY rssd_id) >= 1 AS stressed FROM bi")
def bi_lod_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    top = F.max("stress").over(Window.partitionBy("rssd_id"))
    return _bi(spark, sf_dir).select("rssd_id", "report_date", rounded(top).alias("bank_max"), (top >= 1).alias("stressed"))


@query(_BI + " SELECT round(max(stress), 4) AS max_stress, count(DISTINCT rssd_id) FILTER (ratio < 0.105) AS banks_low, round(sum(hc_r_cet1), 3) AS cet1, round(avg(ratio), 6) AS avg_ratio FROM bi")
def bi_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _bi(spark, sf_dir).agg(
        F.max("stress").alias("max_stress"), F.countDistinct(F.when(F.col("ratio") < 0.105, F.col("rssd_id"))).alias("banks_low"), F.sum("hc_r_cet1").alias("cet1"), F.avg("ratio").alias("avg_ratio")
    )
    return show(g, "banks_low", max_stress=4, cet1=3, avg_ratio=6)


_VAR = views.with_views("om") + "," + _prep_sql("level", True, False) + """,
pr AS (SELECT series, t, v AS x, lead(v) OVER (PARTITION BY series ORDER BY t) AS y FROM zs),
vf AS (SELECT series, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM pr WHERE y IS NOT NULL GROUP BY 1)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = prep.clean(views.monthly_orders(spark, sf_dir), ["series"], "t", ["v"], "level", True, False)
    return c.select("series", "t", F.col("v").alias("x"), F.lead("v").over(Window.partitionBy("series").orderBy("t")).alias("y")).where("y is not null")


@query(_VAR + """, rs AS (SELECT series, y - phi * x - c AS e FROM pr JOIN vf USING (series) WHERE y IS NOT NULL)
SELECT series, round(phi, 5) AS phi, round(c, 5) AS c, round(q, 5) AS q FROM vf JOIN (SELECT series, var_samp(e) AS q FROM rs GROUP BY 1) USING (series)""")
def var1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    f = p.groupBy("series").agg(F.regr_slope("y", "x").alias("phi"), F.regr_intercept("y", "x").alias("c"))
    q = p.join(f, "series").groupBy("series").agg(F.var_samp(F.col("y") - F.col("phi") * F.col("x") - F.col("c")).alias("q"))
    return show(f.join(q, "series"), "series", phi=5, c=5, q=5)


@query(_VAR + " SELECT series, CAST(h AS INT) AS h, round(phi ** h, 6) AS response FROM vf, (SELECT unnest(range(0, 13)) AS h)")
def impulse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _pairs(spark, sf_dir).groupBy("series").agg(F.regr_slope("y", "x").alias("phi"))
    return show(f.select("series", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("h"), "phi").withColumn("response", F.pow("phi", "h")), "series", "h", response=6)


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1, 2""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.round(F.max("o_totalprice"), 2).alias("top"))


@query("""SELECT n_name, c_custkey, round(c_acctbal, 2) AS c_acctbal, CAST(rank AS INT) AS rank FROM (
  SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 5""")
def top_k_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rank = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return c.withColumn("rank", rank).where("rank <= 5").select("n_name", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "rank")
