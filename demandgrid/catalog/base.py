"""Registry of named queries, their SQL counterparts and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame with its SQL counterpart."""

    def add(fn):
        CATALOG[name] = Query(fn, sql)
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Plain output types: ISO text for dates, bigint for integers, rounded doubles.

    Adding zero turns a rounded negative zero into zero.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def day(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d') AS {name or col.split('.')[-1]}"


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


PANEL = """
o AS MATERIALIZED (SELECT CAST(n_regionkey AS BIGINT) AS store_nbr, o_orderpriority AS family,
        CAST(o_orderdate AS DATE) AS d, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS sales,
        CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS onpromotion,
        count(*) AS n_orders
      FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT store_nbr, family FROM o),
rng AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi
        FROM orders),
spine AS (SELECT CAST(lo + CAST(i AS INTEGER) AS DATE) AS date
          FROM rng, LATERAL (SELECT unnest(range(0, date_diff('day', lo, hi) + 1)) AS i)),
panel AS MATERIALIZED (SELECT k.store_nbr, k.family, s.date, coalesce(o.sales, 0.0) AS sales,
            coalesce(o.onpromotion, 0) AS onpromotion,
            CAST(date_diff('day', DATE '1990-01-01', s.date) AS BIGINT) * 100000000000
              + k.store_nbr * 10 + CAST(substr(k.family, 1, 1) AS BIGINT) AS id,
            CAST(k.store_nbr AS VARCHAR) || '_' || k.family AS uid
          FROM k CROSS JOIN spine s LEFT JOIN o
            ON o.store_nbr = k.store_nbr AND o.family = k.family AND o.d = s.date),
cut AS (SELECT CAST(hi - 15 AS DATE) AS c, hi FROM rng),
train AS MATERIALIZED (SELECT * FROM panel WHERE date < (SELECT c FROM cut)),
val AS MATERIALIZED (SELECT * FROM panel WHERE date >= (SELECT c FROM cut))"""

SIGNALS = """
stores AS (SELECT CAST(r_regionkey AS BIGINT) AS store_nbr, min(n_name) AS city,
             min(r_name) AS state,
             CASE WHEN r_regionkey % 2 = 0 THEN 'A' ELSE 'B' END AS type,
             CAST(r_regionkey % 3 AS BIGINT) AS cluster
           FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey),
oil AS (SELECT CAST(o_orderdate AS DATE) AS date,
          floor(sum(floor(o_totalprice)) / count(*)) AS px
        FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) <= 5 GROUP BY 1),
hol AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
        WHERE day(o_orderdate) = 1 OR (month(o_orderdate) = 12 AND day(o_orderdate) = 25)),
txn AS (SELECT d AS date, store_nbr, CAST(sum(n_orders) AS BIGINT) AS transactions
        FROM o GROUP BY 1, 2),
oilf AS (SELECT s.date, last_value(px IGNORE NULLS) OVER (ORDER BY s.date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
         FROM spine s LEFT JOIN oil USING (date)),
oilb AS (SELECT date, coalesce(price, first_value(price IGNORE NULLS) OVER (ORDER BY date
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM oilf),
merged AS MATERIALIZED (SELECT p.*, s.city, s.state, s.type, s.cluster, f.price AS dcoilwtico,
             CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS is_holiday,
             coalesce(t.transactions, -1) AS transactions
           FROM panel p LEFT JOIN stores s USING (store_nbr) LEFT JOIN oilf f USING (date)
             LEFT JOIN hol h USING (date) LEFT JOIN txn t USING (date, store_nbr))"""

PREDS = """
step AS MATERIALIZED (SELECT v.*, date_diff('day', (SELECT c FROM cut), v.date) AS s FROM val v),
preds AS MATERIALIZED (SELECT v.date, v.store_nbr, v.family, v.id, v.uid, v.sales AS actual,
            n.sales AS naive, sn.sales AS predicted
          FROM step v
          JOIN train n ON n.uid = v.uid AND n.date = (SELECT c FROM cut) - 1
          JOIN train sn ON sn.uid = v.uid
            AND sn.date = (SELECT c FROM cut) - 7 + CAST(v.s % 7 AS INTEGER))"""

ERRORS = """
ln AS (SELECT date, store_nbr, family, actual, predicted,
         ln(1 + actual) - ln(1 + greatest(predicted, 0)) AS r FROM preds)"""

VELOCITY = """
vm AS (SELECT store_nbr, family, avg(sales) AS velocity_mean FROM train GROUP BY 1, 2),
ve AS (SELECT quantile_cont(velocity_mean, 0.0) AS e0, quantile_cont(velocity_mean, 1.0/3) AS e1,
         quantile_cont(velocity_mean, 2.0/3) AS e2, quantile_cont(velocity_mean, 1.0) AS e3
       FROM vm),
velocity AS (SELECT vm.*, CASE WHEN NOT (e0 < e1 AND e1 < e2 AND e2 < e3) THEN 'mid'
               WHEN velocity_mean <= e1 THEN 'slow' WHEN velocity_mean <= e2 THEN 'mid'
               ELSE 'fast' END AS velocity_tier FROM vm, ve)"""

ENRICHED = """
enriched AS (SELECT p.date, p.store_nbr, p.family, p.actual, p.predicted, m.type, m.cluster,
               m.city, m.state, m.onpromotion, m.is_holiday, m.dcoilwtico,
               v.velocity_mean, v.velocity_tier, isodow(p.date) - 1 AS dayofweek,
               pow(ln(1 + p.actual) - ln(1 + greatest(p.predicted, 0)), 2) AS sle,
               ln(1 + p.actual) - ln(1 + greatest(p.predicted, 0)) AS log_resid,
               abs(ln(1 + p.actual) - ln(1 + greatest(p.predicted, 0))) AS abs_log_err
             FROM preds p JOIN merged m USING (date, store_nbr, family)
               JOIN velocity v USING (store_nbr, family))"""


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    """SELECT text with the panel and the given fragments in front."""
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} " + ",".join([PANEL, *parts]) + "\n" + body
