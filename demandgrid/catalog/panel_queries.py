"""Panel, joins, cleaning and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.catalog.base import SIGNALS, day, query, rnd, sql, tidy
from demandgrid.catalog.inputs import DAYS, merged
from demandgrid.functions.errors import decode_target, encode_target, finite
from demandgrid.operators.joins import calendar_spine, holiday_distance, oil_by_date
from demandgrid.operators.metrics import distinct_counts
from demandgrid.operators.prep import (
    future_exogenous,
    sale_flags,
    since,
    split_by_origin,
    subsample_stores,
    to_long,
    to_wide,
    trim_context,
    trim_pre_activation_zeros,
    trim_stats,
    union_with_origin,
)
from demandgrid.operators.splits import (
    calendar_split,
    timeseries_split,
    walk_forward_roles,
)
from demandgrid.plans.panel import holidays, long_panel, oil, retail_tables, sales_panel, stored_panel
from demandgrid.sources.tables import holiday_dates


@query("panel_densify", sql(f"SELECT store_nbr, family, {day('date')}, sales, onpromotion FROM panel"))
def _(spark, folder):
    return tidy(sales_panel(spark, folder))


@query(
    "panel_nation_grain",
    """WITH o AS (SELECT CAST(n_nationkey AS BIGINT) AS store_nbr, o_orderpriority AS family,
        CAST(o_orderdate AS DATE) AS d, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS sales
      FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
    SELECT store_nbr, family, count(*) AS n_sold, sum(sales) AS total,
      (SELECT date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)))
         FROM orders) + 1 AS n_days FROM o GROUP BY 1, 2""",
)
def _(spark, folder):
    panel = sales_panel(spark, folder, "nation")
    return tidy(
        panel.groupBy("store_nbr", "family").agg(
            F.count_if(F.col("sales") > 0).alias("n_sold"),
            F.sum("sales").alias("total"),
            F.count(F.lit(1)).alias("n_days"),
        )
    )


@query(
    "union_split_roundtrip",
    sql(f"""SELECT id, {day('date')}, store_nbr, family, onpromotion,
      CASE WHEN date < (SELECT c FROM cut) THEN sales END AS sales,
      CASE WHEN date < (SELECT c FROM cut) THEN 'train' ELSE 'test' END AS origin FROM panel"""),
)
def _(spark, folder):
    t = retail_tables(spark, folder)
    train, test = split_by_origin(union_with_origin(t["train"], t["test"]))
    back = train.withColumn("origin", F.lit("train")).unionByName(
        test.withColumn("origin", F.lit("test")), allowMissingColumns=True
    )
    return tidy(back)


@query(
    "scalar_functions",
    sql(f"""SELECT uid AS unique_id, {day('date')}, {rnd('ln(1 + sales)', 'log_sales', 8)},
      {rnd('exp(ln(1 + sales)) - 1', 'back', 4)}, {rnd('sqrt(sales)', 'root', 6)},
      {rnd('greatest(sales - 200000, 0)', 'clipped')}, lower(split_part(uid, '_', 2)) AS family_key,
      CAST(split_part(uid, '_', 1) AS BIGINT) AS store_key,
      replace(family, '-', ' ') AS family_label, contains(family, 'LOW') AS is_low,
      CAST(regexp_extract('sales_lag_' || store_nbr, '(.+)_lag_([0-9]+)$', 2) AS BIGINT) AS lag_no,
      {day('date - 7', 'week_before')}, {day('date + 7', 'week_after')},
      CAST(date_diff('day', (SELECT lo FROM rng), date) AS BIGINT) AS days_in,
      TRY_CAST(CASE WHEN onpromotion > 0 THEN 'x' ELSE '0' END AS INTEGER) IS NULL AS bad_number,
      CASE WHEN sales > 0 THEN true ELSE false END AS has_finite_log FROM panel"""),
)
def _(spark, folder):
    p = sales_panel(spark, folder)
    uid = F.concat_ws("_", "store_nbr", "family")
    part = F.split(uid, "_", 2)
    lag_name = F.concat(F.lit("sales_lag_"), F.col("store_nbr").cast("string"))
    flag = F.when(F.col("onpromotion") > 0, "x").otherwise("0")
    first = p.agg(F.min("date").alias("d")).scalar()
    out = p.select(
        uid.alias("unique_id"),
        "date",
        F.log1p("sales").alias("log_sales"),
        F.expm1(F.log1p("sales")).alias("back"),
        F.sqrt("sales").alias("root"),
        F.greatest(F.col("sales") - 200000, F.lit(0.0)).alias("clipped"),
        F.lower(part[1]).alias("family_key"),
        part[0].cast("bigint").alias("store_key"),
        F.replace("family", F.lit("-"), F.lit(" ")).alias("family_label"),
        F.contains("family", F.lit("LOW")).alias("is_low"),
        F.regexp_extract(lag_name, r"(.+)_lag_(\d+)$", 2).cast("bigint").alias("lag_no"),
        F.date_sub("date", 7).alias("week_before"),
        F.date_add("date", 7).alias("week_after"),
        F.date_diff("date", first).alias("days_in"),
        flag.try_cast("int").isNull().alias("bad_number"),
        finite(F.log("sales")).alias("has_finite_log"),
    )
    return tidy(out, 6, log_sales=8, back=4)


@query(
    "distinct_counts",
    sql("""SELECT count(*) AS n_rows, count(DISTINCT uid) AS n_series,
      count(DISTINCT date) AS n_dates, count(DISTINCT store_nbr) AS n_stores,
      count(DISTINCT family) AS n_families FROM panel"""),
)
def _(spark, folder):
    return tidy(distinct_counts(stored_panel(spark, folder)))


@query(
    "merge_dimensions",
    sql(
        f"""SELECT id, {day('date')}, store_nbr, family, onpromotion, city, state, type, cluster,
        dcoilwtico, CAST(is_holiday AS BIGINT) AS is_holiday, transactions,
        CASE WHEN date < (SELECT c FROM cut) THEN sales END AS sales FROM merged""",
        SIGNALS,
    ),
)
def _(spark, folder):
    train, test = merged(spark, folder)
    return tidy(train.unionByName(test, allowMissingColumns=True))


@query(
    "oil_asof_fill",
    sql(
        f"""SELECT {day('f.date', 'date')}, f.price AS filled, b.price AS backfilled
        FROM oilf f JOIN oilb b USING (date)""",
        SIGNALS,
    ),
)
def _(spark, folder):
    spine = calendar_spine(sales_panel(spark, folder))
    px = oil(spark, folder)
    ahead = oil_by_date(spine, px).withColumnRenamed("dcoilwtico", "filled")
    both = oil_by_date(spine, px, backfill=True).withColumnRenamed("dcoilwtico", "backfilled")
    return tidy(ahead.join(both, "date"))


HOLIDAY_SQL = """
hd AS (SELECT s.date,
  coalesce((SELECT max(h.date) FROM hol h WHERE h.date <= s.date),
           (SELECT min(date) FROM hol)) AS prev,
  coalesce((SELECT min(h.date) FROM hol h WHERE h.date > s.date),
           (SELECT max(date) FROM hol)) AS next FROM spine s)"""


@query(
    "holiday_distance",
    sql(
        f"""SELECT {day('date')}, date_diff('day', prev, date) AS days_since_holiday,
        date_diff('day', date, next) AS days_until_holiday FROM hd""",
        SIGNALS,
        HOLIDAY_SQL,
    ),
)
def _(spark, folder):
    spine = calendar_spine(sales_panel(spark, folder))
    dates = holiday_dates({"holidays": holidays(spark, folder)})
    return tidy(holiday_distance(spine, dates))


FIRST_SALE = """
fs AS (SELECT store_nbr, family, min(CASE WHEN sales > 0 THEN date END) AS f
       FROM panel GROUP BY 1, 2)"""


@query(
    "trim_pre_activation",
    sql(
        f"""SELECT p.store_nbr, p.family, {day('p.date', 'date')}, p.sales FROM panel p
        JOIN fs USING (store_nbr, family) WHERE f IS NULL OR p.date >= f""",
        FIRST_SALE,
    ),
)
def _(spark, folder):
    out = trim_pre_activation_zeros(sales_panel(spark, folder))
    return tidy(out.select("store_nbr", "family", "date", "sales"))


@query(
    "trim_stats",
    sql(
        """SELECT CAST(sum(CASE WHEN date < f THEN 1 ELSE 0 END) AS BIGINT) AS rows_dropped,
        count(DISTINCT CASE WHEN date < f THEN uid END) AS series_trimmed,
        round(sum(CASE WHEN date < f THEN 1 ELSE 0 END) * 100.0 / count(*), 2) + 0.0 AS pct_dropped
        FROM panel JOIN fs USING (store_nbr, family)""",
        FIRST_SALE,
    ),
)
def _(spark, folder):
    return tidy(trim_stats(sales_panel(spark, folder)))


@query(
    "sale_flags",
    sql(
        f"""SELECT p.store_nbr, p.family, {day('p.date', 'date')}, bool_or(sales > 0) OVER
          (PARTITION BY store_nbr, family) AS ever_sold, bool_or(sales > 0) OVER
          (PARTITION BY store_nbr, family ORDER BY date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS has_sold FROM panel p"""
    ),
)
def _(spark, folder):
    out = sale_flags(sales_panel(spark, folder))
    return tidy(out.select("store_nbr", "family", "date", "ever_sold", "has_sold"))


@query(
    "split_holdout",
    sql(f"""SELECT id, {day('date')}, CASE WHEN date < (SELECT c FROM cut) THEN 'train'
      ELSE 'val' END AS split FROM panel"""),
)
def _(spark, folder):
    p = long_panel(spark, folder).withColumnRenamed("ds", "date")
    train, val = timeseries_split(p, DAYS)
    both = train.withColumn("split", F.lit("train")).unionByName(
        val.withColumn("split", F.lit("val"))
    )
    return tidy(both.select("id", "date", "split"))


@query(
    "split_calendar",
    sql("""SELECT CASE WHEN date < (SELECT c FROM cut) THEN 'train' ELSE 'val' END AS split,
      count(*) AS n, sum(sales) AS total FROM panel GROUP BY 1"""),
)
def _(spark, folder):
    train, val = calendar_split(sales_panel(spark, folder), DAYS)
    both = train.withColumn("split", F.lit("train")).unionByName(
        val.withColumn("split", F.lit("val"))
    )
    return tidy(
        both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("total"))
    )


@query(
    "split_walk_forward",
    sql("""SELECT label, CASE WHEN date < hi - n + 1 THEN 'train' ELSE 'val' END AS role,
      count(*) AS n, sum(sales) AS total, strftime(min(date), '%Y-%m-%d') AS first_date
      FROM panel, cut, (VALUES (16, 'val_16d'), (30, 'val_30d'), (60, 'val_60d'),
        (90, 'val_90d')) w(n, label) GROUP BY 1, 2"""),
)
def _(spark, folder):
    roles = walk_forward_roles(sales_panel(spark, folder), [16, 30, 60, 90])
    return tidy(
        roles.groupBy("label", "role").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("sales").alias("total"),
            F.min("date").alias("first_date"),
        )
    )


@query(
    "subsample_stores",
    sql(f"""SELECT id, {day('date')}, store_nbr, family, sales, 'train' AS origin FROM panel
      WHERE date < (SELECT c FROM cut) AND date >= DATE '1998-01-01'
        AND store_nbr IN (SELECT store_nbr FROM k GROUP BY 1 ORDER BY 1 LIMIT 3)
      UNION ALL SELECT id, {day('date')}, store_nbr, family, NULL, 'test' FROM panel
      WHERE date >= (SELECT c FROM cut)
        AND store_nbr IN (SELECT store_nbr FROM k GROUP BY 1 ORDER BY 1 LIMIT 3)"""),
)
def _(spark, folder):
    t = retail_tables(spark, folder)
    train, test = subsample_stores(t["train"], t["test"], 3)
    train = since(train, "1998-01-01").withColumn("origin", F.lit("train"))
    both = train.unionByName(test.withColumn("origin", F.lit("test")), allowMissingColumns=True)
    return tidy(both.select("id", "date", "store_nbr", "family", "sales", "origin"))


@query(
    "log_target_roundtrip",
    sql(f"""SELECT id, {rnd('ln(1 + sales)', 'log_sales')}, {rnd('sales', 'decoded', 3)},
      {rnd('greatest(sales - 150000, 0)', 'clamped')} FROM panel"""),
)
def _(spark, folder):
    p = long_panel(spark, folder)
    enc = encode_target(F.col("y"), "log1p")
    return tidy(
        p.select(
            "id",
            enc.alias("log_sales"),
            decode_target(enc, "log1p").alias("decoded"),
            decode_target(F.col("y") - 150000, "raw").alias("clamped"),
        ),
        6,
        decoded=3,
    )


@query(
    "to_long",
    sql(
        f"""SELECT uid AS unique_id, {day('date', 'ds')}, store_nbr, family, onpromotion,
        dcoilwtico, CAST(is_holiday AS BIGINT) AS is_holiday, transactions,
        CASE WHEN date < (SELECT c FROM cut) THEN sales END AS y,
        CASE WHEN date < (SELECT c FROM cut) THEN -1 ELSE id END AS id FROM merged""",
        SIGNALS,
    ),
)
def _(spark, folder):
    train, test = merged(spark, folder)
    both = to_long(train).unionByName(to_long(test), allowMissingColumns=True)
    return tidy(both.withColumn("id", F.coalesce("id", F.lit(-1))))


@query(
    "future_exogenous",
    sql(
        f"""SELECT uid AS unique_id, {day('date', 'ds')}, onpromotion, dcoilwtico,
        CAST(is_holiday AS BIGINT) AS is_holiday, transactions FROM merged
        WHERE date >= (SELECT c FROM cut)""",
        SIGNALS,
    ),
)
def _(spark, folder):
    _, test = merged(spark, folder)
    return tidy(future_exogenous(to_long(test)))


@query(
    "to_wide",
    sql(f"""SELECT {day('date', 'ds')},
      sum(CASE WHEN uid = '0_1-URGENT' THEN sales END) AS "0_1-URGENT",
      sum(CASE WHEN uid = '2_3-MEDIUM' THEN sales END) AS "2_3-MEDIUM",
      sum(CASE WHEN uid = '4_5-LOW' THEN sales END) AS "4_5-LOW" FROM panel GROUP BY date"""),
)
def _(spark, folder):
    long = long_panel(spark, folder)
    return tidy(to_wide(long, ["0_1-URGENT", "2_3-MEDIUM", "4_5-LOW"]))


@query(
    "context_trim",
    sql("""SELECT uid AS unique_id, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first_date,
      strftime(max(date), '%Y-%m-%d') AS last_date, sum(sales) AS total FROM panel
      WHERE date > (SELECT hi FROM rng) - 768 GROUP BY 1"""),
)
def _(spark, folder):
    kept = trim_context(long_panel(spark, folder), 790, "ds")
    return tidy(
        kept.groupBy("unique_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ds").alias("first_date"),
            F.max("ds").alias("last_date"),
            F.sum("y").alias("total"),
        )
    )
