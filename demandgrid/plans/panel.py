"""Retail tables derived from the order tables: store x family x day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandgrid.session import materialize

HORIZON = 16


# fixed values: columns of the order tables that are used
COLUMNS = {
    "orders": "o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Scan with a given schema, so no job is needed to look at file footers."""
    return spark.read.schema(COLUMNS[table]).parquet(f"{folder}/{table}.parquet")


def sales_facts(spark: SparkSession, folder: str, grain: str = "region") -> DataFrame:
    """Sales and promotions per store, family and day with at least one order.

    ``grain`` sets what a store is: ``region``, ``nation`` or ``customer``. Amounts are
    floored to whole units, so sums do not depend on their order. Orders are combined
    map-side before the shuffle, however many of them one key holds.
    """
    store = {"region": "n_regionkey", "nation": "n_nationkey", "customer": "c_custkey"}[grain]
    customers = (
        read(spark, folder, "customer")
        .join(read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col(store).cast("bigint").alias("store_nbr"))
    )
    orders = read(spark, folder, "orders").select(
        "o_custkey",
        F.col("o_orderpriority").alias("family"),
        F.to_date("o_orderdate").alias("date"),
        F.floor("o_totalprice").cast("double").alias("amount"),
        (F.col("o_orderstatus") == "P").cast("bigint").alias("promo"),
    )
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("store_nbr", "family", "date")
        .agg(
            F.sum("amount").alias("sales"),
            F.sum("promo").alias("onpromotion"),
            F.count(F.lit(1)).alias("n_orders"),
        )
    )


def densify(facts: DataFrame, first, last) -> DataFrame:
    """A row per calendar day and series; days without a fact are zero.

    Each fact row is stretched to the day before the next one, so there is no grid to
    join against, and the exchange on the series also serves later series windows.
    """
    w = Window.partitionBy("store_nbr", "family").orderBy("date")
    begin = F.when(F.col("_prev").isNull(), F.col("_first")).otherwise(F.col("date"))
    end = F.coalesce(F.date_sub("_next", 1), "_last")
    return (
        facts.withColumns({"_prev": F.lag("date").over(w), "_next": F.lead("date").over(w)})
        .withColumns({"_first": first, "_last": last})
        .withColumn("_day", F.explode(F.sequence(begin, end, F.expr("interval 1 day"))))
        .select(
            "store_nbr",
            "family",
            F.col("_day").alias("date"),
            F.when(F.col("_day") == F.col("date"), F.col("sales")).otherwise(0.0).alias("sales"),
            F.when(F.col("_day") == F.col("date"), F.col("onpromotion"))
            .otherwise(0)
            .alias("onpromotion"),
            *[
                F.when(F.col("_day") == F.col("date"), F.col(c)).otherwise(0).alias(c)
                for c in ("n_orders",)
                if c in facts.columns
            ],
        )
    )


def order_days(spark: SparkSession, folder: str) -> tuple:
    """First and last order date: one scalar subquery over one narrow column."""
    days = read(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d"))
    ends = days.agg(F.struct(F.min("d").alias("a"), F.max("d").alias("z")).alias("e")).scalar()
    return ends["a"], ends["z"]


def sales_panel(spark: SparkSession, folder: str, grain: str = "region") -> DataFrame:
    first, last = order_days(spark, folder)
    return densify(sales_facts(spark, folder, grain), first, last).drop("n_orders")


def row_id():
    """Stable row id from the key of a panel row; ten digits are for the store."""
    days = F.date_diff(F.col("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    return days * 100_000_000_000 + F.col("store_nbr") * 10 + F.substring("family", 1, 1).cast("bigint")


def stores(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "nation")
        .join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_regionkey").cast("bigint").alias("store_nbr"))
        .agg(
            F.min("n_name").alias("city"),
            F.min("r_name").alias("state"),
            F.when(F.min("r_regionkey") % 2 == 0, "A").otherwise("B").alias("type"),
            F.min((F.col("r_regionkey") % 3).cast("bigint")).alias("cluster"),
        )
    )


def oil(spark: SparkSession, folder: str) -> DataFrame:
    """Average order value per weekday date in whole units; no rows on weekends."""
    return (
        read(spark, folder, "orders")
        .select(F.to_date("o_orderdate").alias("date"), F.floor("o_totalprice").alias("p"))
        .filter(F.weekday("date") < 5)
        .groupBy("date")
        .agg(F.floor(F.sum("p") / F.count("p")).cast("double").alias("dcoilwtico"))
    )


def holidays(spark: SparkSession, folder: str) -> DataFrame:
    """First days of a month and 25 December, the latter listed for two locales."""
    days = (
        read(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    )
    xmas = (F.month("date") == 12) & (F.dayofmonth("date") == 25)
    national = days.filter(xmas | (F.dayofmonth("date") == 1)).withColumn("locale", F.lit("N"))
    return national.unionByName(days.filter(xmas).withColumn("locale", F.lit("L")))


def transactions(panel: DataFrame) -> DataFrame:
    """Orders per day and store; days without any have no row."""
    counts = panel.filter(F.col("n_orders") > 0).groupBy("date", "store_nbr")
    return counts.agg(F.sum("n_orders").alias("transactions"))


def retail_tables(
    spark: SparkSession,
    folder: str,
    grain: str = "region",
    horizon: int = HORIZON,
    panel: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The table bundle: the last ``horizon`` days are the test rows without target.

    The panel is written once; its many readers then scan only the columns they need.
    """
    panel = stored_panel(spark, folder, grain) if panel is None else panel
    cut = F.date_sub(panel.agg(F.max("date").alias("d")).scalar(), horizon - 1)
    facts = panel.drop("n_orders")
    return {
        "train": facts.filter(F.col("date") < cut),
        "test": facts.filter(F.col("date") >= cut).drop("sales"),
        "stores": stores(spark, folder),
        "oil": oil(spark, folder),
        "holidays": holidays(spark, folder),
        "transactions": transactions(panel),
    }


def stored_panel(spark: SparkSession, folder: str, grain: str = "region") -> DataFrame:
    """The panel with row ids as a written table, for plans that read it several times."""
    first, last = order_days(spark, folder)
    panel = densify(sales_facts(spark, folder, grain), first, last)
    return materialize(panel.withColumn("id", row_id()), "panel")


def as_long(panel: DataFrame) -> DataFrame:
    """``unique_id, ds, y`` with the keys and the row id."""
    return panel.select(
        F.concat_ws("_", "store_nbr", "family").alias("unique_id"),
        F.col("date").alias("ds"),
        F.col("sales").alias("y"),
        "store_nbr",
        "family",
        row_id().alias("id"),
    )


def long_panel(
    spark: SparkSession, folder: str, grain: str = "region", stored: bool = False
) -> DataFrame:
    make = stored_panel if stored else sales_panel
    return as_long(make(spark, folder, grain))
