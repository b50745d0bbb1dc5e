"""Base views over the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(events: DataFrame, per_day: int) -> DataFrame:
    """series, t, v for every series and every step of the days that the events span: spectra need a sample for each step."""
    days = events.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    # One row, so the calendar and the steps take it as a broadcast.
    hour = F.hour("ts") if per_day == 24 else F.lit(0)
    t = F.datediff(F.to_date("ts"), F.col("first")) * per_day + hour
    spanned = events.where("ts is not null").crossJoin(F.broadcast(days))
    sums = spanned.select(F.col("event_type").alias("series"), t.alias("t"), "value").groupBy("series", "t").agg(F.sum("value").alias("v"))
    steps = F.sequence(F.lit(0), (F.datediff("last", "first") + 1) * per_day - 1)
    calendar = events.select(F.col("event_type").alias("series")).distinct().crossJoin(F.broadcast(days)).select("series", F.explode(steps).alias("t"))
    return calendar.join(sums, ["series", "t"], "left").select("series", F.col("t").cast("int"), F.coalesce("v", F.lit(0.0)).alias("v"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t (hours since the first day's midnight), v: summed event values, zero where none, to the end of the last day."""
    return _filled(table(spark, sf_dir, "events"), 24)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t (days since the first), v: summed event values, zero where none."""
    return _filled(table(spark, sf_dir, "events"), 1)


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (order priority), t (months since 1995-01), v (order total in millions); every 11th month is null."""
    o = table(spark, sf_dir, "orders")
    t = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return (
        o.groupBy(F.col("o_orderpriority").alias("series"), t.alias("t")).agg((F.sum("o_totalprice") / 1e6).alias("v"))
        .select("series", F.col("t").cast("int"), F.when(F.col("t") % 11 != 0, F.col("v")).alias("v"))
    )


def _nation_quarter(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders with their customer's nation and the first day of their quarter."""
    return orders.join(customer.select("c_custkey", "c_nationkey"), orders.o_custkey == F.col("c_custkey")).withColumn("date", F.trunc("o_orderdate", "quarter"))


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """institution, peer_group, date, order_total, order_count, mean_price, mean_discount; every 7th nation's first-quarter totals are null.

    Line items are summed per order before they meet the orders, so the wide table is shuffled once.
    """
    o = _nation_quarter(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("price"), F.sum("l_discount").alias("discount"), F.count(F.lit(1)).alias("n"))
    cells = (
        o.join(lines, o.o_orderkey == lines.l_orderkey, "left").groupBy("c_nationkey", "date")
        .agg(
            (F.sum("o_totalprice") / 1e6).alias("order_total"), F.count(F.lit(1)).cast("double").alias("order_count"),
            (F.try_divide(F.sum("price"), F.sum("n")) / 1e3).alias("mean_price"), F.try_divide(F.sum("discount"), F.sum("n")).alias("mean_discount"),
        )
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    gap = (F.col("c_nationkey") % 7 == 0) & (F.quarter("date") == 1)
    return (
        cells.join(nation, cells.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("n_name").alias("institution"), F.col("r_name").alias("peer_group"), "date",
            F.when(~gap, F.col("order_total")).alias("order_total"), "order_count", "mean_price", "mean_discount",
        )
    )


def schedules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three regulatory schedules keyed by (rssd_id, report_date), each with gaps of its own."""
    o = _nation_quarter(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    key = [F.col("c_nationkey").cast("string").alias("rssd_id"), F.col("date").alias("report_date")]
    liquidity = (
        o.groupBy(*key).agg(
            F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")) / 1e6).alias("ral_overnight_repo"),
            F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")) / 1e6).alias("ral_eurusd_borr"),
            F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")) / 1e6).alias("ral_term_repo"),
        )
        .join(nation, F.col("rssd_id") == F.col("n_nationkey").cast("string"))
        .where((F.col("n_regionkey") <= 2) & F.col("report_date").between("1995-04-01", "2000-12-31"))
        .select("rssd_id", "report_date", F.col("n_name").alias("legal_name"), F.col("n_regionkey").cast("string").alias("hub_country"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ral_overnight_repo", "ral_eurusd_borr", "ral_term_repo")))
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice"))).alias("afs"), F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))).alias("htm"),
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"),
    )
    securities = (
        o.join(lines, o.o_orderkey == lines.l_orderkey).groupBy(*key)
        .agg(
            F.coalesce(F.sum(F.col("afs") / 1e6), F.lit(0.0)).alias("hc_b_afs_securities"), F.coalesce(F.sum(F.col("htm") / 1e6), F.lit(0.0)).alias("hc_b_htm_securities"),
            (F.sum("q") / F.sum("n") / 5).alias("hc_b_afs_duration"), (F.sum("q") / F.sum("n") / 4).alias("hc_b_htm_duration"),
        )
        .where("report_date >= date'1995-07-01'")
    )
    capital = (
        o.where("o_orderpriority <> '5-LOW'").groupBy(*key)
        .agg((F.sum("o_totalprice") / 2e6).alias("hc_r_cet1"), (F.sum("o_totalprice") / 2e5 + F.count(F.lit(1))).alias("hc_r_rwa"), (F.avg("o_totalprice") / 1e6).alias("hc_r_aoci"))
        .where("report_date <= date'2001-03-31'")
    )
    return liquidity, securities, capital


def _filled_sql(step: str, per_day: int) -> str:
    return f"""SELECT y.series, h.t, coalesce(s.v, 0) AS v
  FROM (SELECT DISTINCT event_type AS series FROM events) y
  CROSS JOIN (SELECT unnest(range(0, (date_diff('day', min(ts), max(ts)) + 1) * {per_day})) AS t FROM events) h
  LEFT JOIN (
    SELECT event_type AS series, date_diff('{step}', o.first, ts) AS t, sum(value) AS v
    FROM events, (SELECT date_trunc('day', min(ts)) AS first FROM events) o GROUP BY 1, 2) s ON s.series = y.series AND s.t = h.t"""


SQL = {
    "eh": _filled_sql("hour", 24),
    "ed": _filled_sql("day", 1),
    "om": """SELECT series, t, CASE WHEN t % 11 <> 0 THEN v END AS v FROM (
    SELECT o_orderpriority AS series, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, sum(o_totalprice) / 1e6 AS v FROM orders GROUP BY 1, 2)""",
    "nq": """SELECT n_name AS institution, r_name AS peer_group, c.date, CASE WHEN NOT (c.k % 7 = 0 AND quarter(c.date) = 1) THEN c.order_total END AS order_total,
    CAST(c.order_count AS DOUBLE) AS order_count, c.mean_price, c.mean_discount
  FROM (
    SELECT c_nationkey AS k, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, sum(o_totalprice) / 1e6 AS order_total, count(*) AS order_count,
      sum(l.price) / sum(l.n) / 1e3 AS mean_price, sum(l.discount) / sum(l.n) AS mean_discount
    FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS price, sum(l_discount) AS discount, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
    GROUP BY 1, 2) c JOIN nation ON c.k = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "oq": "SELECT orders.*, CAST(c_nationkey AS VARCHAR) AS rssd_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date FROM orders JOIN customer ON o_custkey = c_custkey",
    "liq": """SELECT rssd_id, report_date, n_name AS legal_name, CAST(n_regionkey AS VARCHAR) AS hub_country, coalesce(a, 0) AS ral_overnight_repo, coalesce(b, 0) AS ral_eurusd_borr, coalesce(c, 0) AS ral_term_repo
  FROM (SELECT rssd_id, report_date, sum(o_totalprice / 1e6) FILTER (o_orderstatus = 'O') AS a, sum(o_totalprice / 1e6) FILTER (o_orderstatus = 'F') AS b, sum(o_totalprice / 1e6) FILTER (o_orderstatus = 'P') AS c FROM oq GROUP BY 1, 2)
  JOIN nation ON rssd_id = CAST(n_nationkey AS VARCHAR) WHERE n_regionkey <= 2 AND report_date BETWEEN DATE '1995-04-01' AND DATE '2000-12-31'""",
    "sec": """SELECT rssd_id, report_date, coalesce(sum(afs / 1e6), 0) AS hc_b_afs_securities, coalesce(sum(htm / 1e6), 0) AS hc_b_htm_securities, sum(q) / sum(n) / 5 AS hc_b_afs_duration, sum(q) / sum(n) / 4 AS hc_b_htm_duration
  FROM oq JOIN (SELECT l_orderkey, sum(l_extendedprice) FILTER (l_returnflag = 'N') AS afs, sum(l_extendedprice) FILTER (l_returnflag <> 'N') AS htm, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
  WHERE report_date >= DATE '1995-07-01' GROUP BY 1, 2""",
    "cap": """SELECT rssd_id, report_date, sum(o_totalprice) / 2e6 AS hc_r_cet1, sum(o_totalprice) / 2e5 + count(*) AS hc_r_rwa, avg(o_totalprice) / 1e6 AS hc_r_aoci
  FROM oq WHERE o_orderpriority <> '5-LOW' AND report_date <= DATE '2001-03-31' GROUP BY 1, 2""",
    "reg": """SELECT coalesce(coalesce(l.rssd_id, s.rssd_id), c.rssd_id) AS rssd_id, coalesce(coalesce(l.report_date, s.report_date), c.report_date) AS report_date, legal_name, hub_country,
    ral_overnight_repo, ral_eurusd_borr, ral_term_repo, hc_b_afs_securities, hc_b_htm_securities, hc_b_afs_duration, hc_b_htm_duration, hc_r_cet1, hc_r_rwa, hc_r_aoci,
    ral_overnight_repo + ral_term_repo AS total_repo_dependency, hc_b_afs_securities + hc_b_htm_securities AS securities_total
  FROM liq l FULL JOIN sec s ON l.rssd_id = s.rssd_id AND l.report_date = s.report_date
  FULL JOIN cap c ON coalesce(l.rssd_id, s.rssd_id) = c.rssd_id AND coalesce(l.report_date, s.report_date) = c.report_date""",
}
_NEEDS = {"liq": ("oq",), "sec": ("oq",), "cap": ("oq",), "reg": ("liq", "sec", "cap")}


def with_views(*names: str) -> str:
    """`WITH RECURSIVE ...` of the named views and what they need."""
    got: dict[str, str] = {}

    def add(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            add(m)
        got[n] = SQL[n]

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in got.items())
