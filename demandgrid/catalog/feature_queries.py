"""History, calendar and encoding features."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.catalog.base import SIGNALS, day, query, rnd, sql, tidy
from demandgrid.catalog.inputs import merged
from demandgrid.functions.calendar import calendar_columns, fourier_columns
from demandgrid.operators.encode import OneHot, Ordinal, standardized
from demandgrid.operators.joins import calendar_spine
from demandgrid.operators.prep import union_with_origin
from demandgrid.operators.windows import history_features, lag_roll_features
from demandgrid.plans.features import combined_features
from demandgrid.plans.panel import holidays, retail_tables, row_id, sales_panel
from demandgrid.settings import FeatureSettings, Roll

KEYS = ["store_nbr", "family", "date"]
LAGS = FeatureSettings(lags={"sales": (1, 7, 14, 28)})
ROLLS = FeatureSettings(
    rolls=(
        Roll("sales", (7, 28), ("mean", "std", "min", "max")),
        Roll("sales", (14,), ("median",)),
    )
)
KEY_SQL = f"store_nbr, family, {day('date')}"
ORDER = "OVER (PARTITION BY store_nbr, family ORDER BY date"


def frame(w: int) -> str:
    return f"{ORDER} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


LAG_SQL = ", ".join(f"lag(sales, {k}) {ORDER}) AS sales_lag_{k}" for k in (1, 7, 14, 28))


@query("lag_features", sql(f"SELECT {KEY_SQL}, {LAG_SQL} FROM panel"))
def _(spark, folder):
    out = lag_roll_features(sales_panel(spark, folder), LAGS, "series")
    return tidy(out.select(*KEYS, *LAGS.history_names()))


ROLL_SQL = ", ".join(
    [
        piece
        for w in (7, 28)
        for piece in (
            rnd(f"avg(sales) {frame(w)}", f"sales_roll_{w}_mean"),
            rnd(f"stddev_samp(sales) {frame(w)}", f"sales_roll_{w}_std", 3),
            f"min(sales) {frame(w)} AS sales_roll_{w}_min",
            f"max(sales) {frame(w)} AS sales_roll_{w}_max",
        )
    ]
    + [rnd(f"median(sales) {frame(14)}", "sales_roll_14_median")]
)
STD = {"sales_roll_7_std": 3, "sales_roll_28_std": 3}


@query("rolling_features", sql(f"SELECT {KEY_SQL}, {ROLL_SQL} FROM panel"))
def _(spark, folder):
    out = lag_roll_features(sales_panel(spark, folder), ROLLS, "series")
    return tidy(out.select(*KEYS, *ROLLS.history_names()), 6, **STD)


@query("rolling_features_blocked", sql(f"SELECT {KEY_SQL}, {ROLL_SQL} FROM panel"))
def _(spark, folder):
    out = lag_roll_features(sales_panel(spark, folder), ROLLS, "blocked", block_rows=512)
    return tidy(out.select(*KEYS, *ROLLS.history_names()), 6, **STD)


HISTORY = FeatureSettings(
    lags={"sales": (1, 7)}, rolls=(Roll("sales", (7,), ("mean",)),)
)
HISTORY_SQL = f"""
u AS (SELECT store_nbr, family, date, date < (SELECT c FROM cut) AS is_train,
        CASE WHEN date < (SELECT c FROM cut) THEN sales END AS sales FROM panel),
lr AS (SELECT *, lag(sales, 1) {ORDER}) AS l1, lag(sales, 7) {ORDER}) AS l7,
         avg(sales) {frame(7)} AS m7 FROM u),
kept AS (SELECT * FROM lr WHERE NOT is_train OR coalesce(l1, l7, m7) IS NOT NULL),
filled AS (SELECT store_nbr, family, date, is_train, sales,
  coalesce(last_value(l1 IGNORE NULLS) {ORDER}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sales_lag_1,
  coalesce(last_value(l7 IGNORE NULLS) {ORDER}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sales_lag_7,
  coalesce(last_value(m7 IGNORE NULLS) {ORDER}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sales_roll_7_mean FROM kept)"""
HISTORY_OUT = f"""SELECT {KEY_SQL}, is_train, sales_lag_1, sales_lag_7,
  {rnd('sales_roll_7_mean', 'sales_roll_7_mean')} FROM filled"""


def _history(spark, folder, strategy):
    t = retail_tables(spark, folder)
    out = history_features(union_with_origin(t["train"], t["test"]), HISTORY, strategy)
    return tidy(out.select(*KEYS, "is_train", *HISTORY.history_names()))


@query("lag_ffill_drop", sql(HISTORY_OUT, HISTORY_SQL))
def _(spark, folder):
    return _history(spark, folder, "series")


@query("lag_ffill_drop_blocked", sql(HISTORY_OUT, HISTORY_SQL))
def _(spark, folder):
    return _history(spark, folder, "blocked")


CALENDAR_SQL = """CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,
  CAST(isodow(date) - 1 AS BIGINT) AS dayofweek, CAST(day(date) AS BIGINT) AS dayofmonth,
  CAST(quarter(date) AS BIGINT) AS quarter, CAST(week(date) AS BIGINT) AS weekofyear,
  CAST(dayofyear(date) AS BIGINT) AS dayofyear,
  CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CAST(date_diff('day', (SELECT lo FROM rng), date) AS BIGINT) AS time_step"""
CALENDAR = (
    "year", "month", "dayofweek", "dayofmonth", "quarter", "weekofyear", "dayofyear",
    "is_weekend", "time_step",
)


@query("calendar_features", sql(f"SELECT {day('date')}, {CALENDAR_SQL} FROM spine"))
def _(spark, folder):
    panel = sales_panel(spark, folder)
    first = panel.agg(F.min("date").alias("d")).scalar()
    spine = calendar_spine(panel)
    return tidy(spine.withColumns(calendar_columns(F.col("date"), CALENDAR, first)))


FOURIER = {"dayofyear": (1, 2, 3), "dayofweek": (1, 2), "month": (1,), "unknown": (1,)}
FOURIER_BASE = {
    "dayofyear": ("dayofyear(date)", 365.25),
    "dayofweek": ("(isodow(date) - 1)", 7.0),
    "month": ("month(date)", 12.0),
}
FOURIER_SQL = ", ".join(
    rnd(f"{fn}({expr} * {2.0 * h} * pi() / {period})", f"fourier_{base}_{fn}_{h}", 9)
    for base, (expr, period) in FOURIER_BASE.items()
    for h in FOURIER[base]
    for fn in ("sin", "cos")
)


@query("fourier_features", sql(f"SELECT {day('date')}, {FOURIER_SQL} FROM spine"))
def _(spark, folder):
    spine = calendar_spine(sales_panel(spark, folder))
    return tidy(spine.withColumns(fourier_columns(F.col("date"), FOURIER)), 9)


PLAN = FeatureSettings(
    date_features=("year", "month", "dayofweek", "time_step"),
    lags={"sales": (1, 7)},
    rolls=(Roll("sales", (7,), ("mean",)),),
    fourier={"dayofweek": (1,)},
    trim_pre_activation=True,
)
PLAN_SQL = f"""
fs AS (SELECT store_nbr, family, min(CASE WHEN sales > 0 THEN date END) AS f
       FROM train GROUP BY 1, 2),
u AS (SELECT m.store_nbr, m.family, m.date, m.date < (SELECT c FROM cut) AS is_train,
        CASE WHEN m.date < (SELECT c FROM cut) THEN m.sales END AS sales,
        onpromotion, is_holiday, dcoilwtico, type, cluster FROM merged m
      JOIN fs USING (store_nbr, family)
      WHERE m.date >= (SELECT c FROM cut) OR f IS NULL OR m.date >= f),
lr AS (SELECT *, lag(sales, 1) {ORDER}) AS l1, lag(sales, 7) {ORDER}) AS l7,
         avg(sales) {frame(7)} AS m7 FROM u),
kept AS (SELECT * FROM lr WHERE NOT is_train OR coalesce(l1, l7, m7) IS NOT NULL),
hd AS (SELECT s.date,
  coalesce((SELECT max(h.date) FROM hol h WHERE h.date <= s.date),
           (SELECT min(date) FROM hol)) AS prev,
  coalesce((SELECT min(h.date) FROM hol h WHERE h.date > s.date),
           (SELECT max(date) FROM hol)) AS next FROM spine s)"""


def _last(col: str) -> str:
    return (
        f"coalesce(last_value({col} IGNORE NULLS) {ORDER} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
    )


@query(
    "feature_plan",
    sql(
        f"""SELECT store_nbr, family, {day('date')}, is_train, sales, onpromotion,
        CAST(is_holiday AS BIGINT) AS is_holiday, dcoilwtico, type, cluster,
        {_last('l1')} AS sales_lag_1, {_last('l7')} AS sales_lag_7,
        {rnd(_last('m7'), 'sales_roll_7_mean')},
        CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,
        CAST(isodow(date) - 1 AS BIGINT) AS dayofweek,
        CAST(date_diff('day', (SELECT min(date) FROM u), date) AS BIGINT) AS time_step,
        {rnd('sin((isodow(date) - 1) * 2.0 * pi() / 7.0)', 'fourier_dayofweek_sin_1')},
        {rnd('cos((isodow(date) - 1) * 2.0 * pi() / 7.0)', 'fourier_dayofweek_cos_1')},
        date_diff('day', prev, date) AS days_since_holiday,
        date_diff('day', date, next) AS days_until_holiday
        FROM kept JOIN hd USING (date)""",
        SIGNALS,
        PLAN_SQL,
    ),
)
def _(spark, folder):
    train, test = merged(spark, folder)
    out = combined_features(train, test, PLAN, holidays(spark, folder), "series")
    return tidy(out.drop("id", "city", "state", "transactions"))


@query(
    "onehot_encode",
    sql(
        f"""SELECT id, onpromotion * 1.0 AS onpromotion,
        CASE WHEN store_nbr = 1 THEN 1.0 ELSE 0.0 END AS store_nbr_1,
        CASE WHEN store_nbr = 2 THEN 1.0 ELSE 0.0 END AS store_nbr_2,
        CASE WHEN family = '2-HIGH' THEN 1.0 ELSE 0.0 END AS family_2_high,
        CASE WHEN family = '3-MEDIUM' THEN 1.0 ELSE 0.0 END AS family_3_medium,
        CASE WHEN family = '4-NOT SPECIFIED' THEN 1.0 ELSE 0.0 END AS family_4_not,
        CASE WHEN family = '5-LOW' THEN 1.0 ELSE 0.0 END AS family_5_low,
        {rnd('coalesce(dcoilwtico, 0)', 'dcoilwtico')} FROM merged""",
        SIGNALS,
    ),
)
def _(spark, folder):
    """Fitted on stores 0 to 2 only: the other stores are unseen and get zeros."""
    train, test = merged(spark, folder)
    rows = train.unionByName(test, allowMissingColumns=True)
    enc = OneHot.fit(
        rows.filter(F.col("store_nbr") < 3), ["store_nbr", "family"], ["onpromotion", "dcoilwtico"]
    )
    out = enc.transform(rows, keep=["id"])
    names = {
        "family_2-HIGH": "family_2_high",
        "family_3-MEDIUM": "family_3_medium",
        "family_4-NOT SPECIFIED": "family_4_not",
        "family_5-LOW": "family_5_low",
    }
    return tidy(out.withColumnsRenamed(names))


@query(
    "ordinal_encode",
    sql(
        """SELECT id, CASE WHEN type = 'A' THEN 0.0 ELSE 1.0 END AS type_code,
        CASE WHEN family = '5-LOW' THEN -1.0 ELSE CAST(substr(family, 1, 1) AS DOUBLE) - 1.0 END
          AS family_code, coalesce(dcoilwtico, 0) AS oil_value FROM merged""",
        SIGNALS,
    ),
)
def _(spark, folder):
    """Fitted without family 5-LOW, which is then unknown."""
    train, test = merged(spark, folder)
    rows = train.unionByName(test, allowMissingColumns=True)
    enc = Ordinal.fit(rows.filter("family <> '5-LOW'"), ["type", "family", "dcoilwtico"])
    cols = enc.columns()
    return tidy(
        rows.select(
            "id",
            cols["type"].alias("type_code"),
            cols["family"].alias("family_code"),
            cols["dcoilwtico"].alias("oil_value"),
        )
    )


@query(
    "standardize",
    sql(
        f"""SELECT id, {rnd('(sales - avg(sales) OVER ()) / stddev_pop(sales) OVER ()', 'sales_z')},
        {rnd('(onpromotion - avg(onpromotion) OVER ()) / stddev_pop(onpromotion) OVER ()',
             'onpromotion_z')} FROM panel"""
    ),
)
def _(spark, folder):
    panel = sales_panel(spark, folder).withColumn("id", row_id())
    out = standardized(panel, ["sales", "onpromotion"], "_z")
    return tidy(out.select("id", "sales_z", "onpromotion_z"))
