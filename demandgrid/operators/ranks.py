"""Dense numbering of rows without sending them all to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_hash(*cols: Column | str) -> Column:
    """Stable text digest of a key; the same in every SQL engine."""
    return F.md5(F.concat_ws("-", *[F.col(c) if isinstance(c, str) else c for c in cols]))


def hashed_rank(df: DataFrame, key: Column, ties: Sequence[str], name: str) -> DataFrame:
    """Number rows 0..n-1 in the order of ``md5(key), ties``.

    Rows are ranked inside 4096 digest prefixes, which spread evenly whatever the
    key distribution is; only the 4096 prefix counts are summed up in one place.
    """
    digest = df.withColumn("_digest", F.md5(key)).withColumn("_slot", F.substring("_digest", 1, 3))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        digest.groupBy("_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_slot").orderBy("_digest", *ties)
    return (
        digest.withColumn("_local", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_slot")  # at most 4096 rows
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_digest", "_slot", "_local", "_start")
    )


def digest_bound(df: DataFrame, digest: str, k: int) -> str:
    """A text that the ``k`` smallest hexadecimal digests of one length lie below, and no other.

    Found three digits at a time: each step counts the digests that share the digits known so
    far by the next three, at most 4096 rows, so no row is ranked or sorted. Rows of equal
    digests stay together.
    """
    prefix, taken, whole = "", 0, df.select(F.max(F.length(digest))).head()[0] or 0
    while True:
        cells = (
            df.filter(F.col(digest).startswith(prefix))
            .groupBy(F.substring(digest, len(prefix) + 1, 3).alias("next"))
            .count().orderBy("next").collect()
        )
        for cell in cells:
            if taken + cell["count"] >= k:
                break
            taken += cell["count"]
        else:
            return "g"  # above every digit: all rows
        prefix += cell["next"]
        if taken + cell["count"] == k or len(prefix) >= whole:
            return prefix + "g"


def series_position(
    df: DataFrame, keys: Sequence[str], date: str, name: str, chunk_days: int = 512
) -> DataFrame:
    """0-based row number inside each series, computed per calendar chunk.

    A task holds one chunk of one series at a time; the offsets come from the chunk
    counts. Use it when a series can outgrow a task.
    """
    chunk = F.floor(F.date_diff(F.col(date), F.lit("1970-01-01").cast("date")) / chunk_days)
    rows = df.withColumn("_chunk", chunk)
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(date)
    return (
        rows.withColumn("_local", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_chunk"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_chunk", "_local", "_start")
    )
