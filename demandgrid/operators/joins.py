"""Joining dimensions and external signals onto the fact table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A DATE column has under 3.7 million values, so a table with one row per calendar
# day is a few tens of MB at most and may always be broadcast.


def calendar_spine(*frames: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates of all frames, one row per day that occurs."""
    dates = frames[0].select(date)
    for f in frames[1:]:
        dates = dates.unionByName(f.select(date))
    return dates.distinct()


def oil_by_date(spine: DataFrame, oil: DataFrame, backfill: bool = False) -> DataFrame:
    """Price per day of the spine: exact match, else the last price seen before.

    With ``backfill`` the days before the first price take that first price.
    """
    w = Window.orderBy("date")  # one row per calendar day
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    price = F.last("_px", ignorenulls=True).over(seen)
    if backfill:
        price = F.coalesce(price, F.first("_px", ignorenulls=True).over(ahead))
    px = oil.groupBy("date").agg(F.first("dcoilwtico", ignorenulls=True).alias("_px"))
    return (
        spine.join(px, "date", "left")
        .withColumn("dcoilwtico", price)
        .select("date", "dcoilwtico")
    )


def holiday_flags(holidays: DataFrame) -> DataFrame:
    """One row per holiday date, whatever its locale or type."""
    return holidays.select("date").dropna().distinct().withColumn("is_holiday", F.lit(1))


def holiday_distance(spine: DataFrame, holidays: DataFrame) -> DataFrame:
    """Days since the last holiday (today counts) and until the next one (today not).

    Before the first or after the last holiday the distance is taken to that holiday
    and is then negative.
    """
    days = holidays.select("date").dropna().distinct()
    marked = (
        spine.select("date", F.lit(1).alias("_in_spine"), F.lit(0).alias("_hol"))
        .unionByName(days.select("date", F.lit(0).alias("_in_spine"), F.lit(1).alias("_hol")))
        .groupBy("date")
        .agg(F.max("_in_spine").alias("_in_spine"), F.max("_hol").alias("_hol"))
    )
    w = Window.orderBy("date")  # one row per calendar day
    hol = F.when(F.col("_hol") == 1, F.col("date"))
    prev = F.last(hol, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(hol, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    first = F.min(hol).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.max(hol).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        marked.withColumn("_prev", F.coalesce(prev, first))
        .withColumn("_next", F.coalesce(nxt, last))
        .filter("_in_spine = 1")
        .select(
            "date",
            F.date_diff("date", "_prev").alias("days_since_holiday"),
            F.date_diff("_next", "date").alias("days_until_holiday"),
        )
    )


def merge_dimensions(
    tables: Mapping[str, DataFrame], backfill_oil: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Attach store, oil, holiday and traffic columns to train and test.

    Oil is filled along the dates of train and test together; all per-day signals are
    one small table, so the fact table meets a single calendar join. Missing tables
    leave their columns out.
    """
    train, test = tables["train"], tables["test"]
    have = {n: n in tables and bool(tables[n].columns) for n in ("oil", "holidays")}
    daily = calendar_spine(train, test)
    signals = []
    if have["oil"]:
        daily = oil_by_date(daily, tables["oil"], backfill_oil)
        signals.append("dcoilwtico")
    if have["holidays"]:
        daily = daily.join(F.broadcast(holiday_flags(tables["holidays"])), "date", "left")
        daily = daily.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))
        signals.append("is_holiday")

    def attach(df: DataFrame) -> DataFrame:
        if "stores" in tables:
            df = df.join(tables["stores"], "store_nbr", "left")
        if signals:
            df = df.join(F.broadcast(daily), "date", "left")
        if "transactions" in tables:
            df = df.join(tables["transactions"], ["date", "store_nbr"], "left").withColumn(
                "transactions", F.coalesce("transactions", F.lit(-1))
            )
        return df

    return attach(train), attach(test)
