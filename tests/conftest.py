import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from demandgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("demandgrid-tests", cores=4)


@pytest.fixture
def panel_of(spark):
    """Panel rows from {(store, family): [sales, ...]} with consecutive days."""

    def build(series, start=dt.date(2017, 1, 1)):
        rows = [
            (i, start + dt.timedelta(days=i), s, f, float(v), 0)
            for (s, f), values in series.items()
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(
            rows,
            "id bigint, date date, store_nbr bigint, family string, sales double,"
            " onpromotion bigint",
        )

    return build


@pytest.fixture
def audit_history(spark):
    """3 x 3 series over 30 days with rising scale and store metadata."""
    rows = []
    for d in range(30):
        for s in range(1, 4):
            for j in range(3):
                rows.append(
                    (
                        dt.date(2017, 1, 1) + dt.timedelta(days=d), s, f"F{j}",
                        float(10 * s * (j + 1) + d % 7), "A" if s == 1 else "B", s,
                        int(d % 5 == 0), int(d % 11 == 0), 40 + 0.1 * d,
                    )
                )
    return spark.createDataFrame(
        rows,
        "date date, store_nbr bigint, family string, sales double, type string, cluster bigint,"
        " onpromotion int, is_holiday int, dcoilwtico double",
    )


@pytest.fixture
def audit_preds(audit_history):
    """Last five days; slow series 30 % too high, fast series 30 % too low."""
    from pyspark.sql import functions as F

    from demandgrid.operators.metrics import velocity_tiers

    tiers = velocity_tiers(audit_history)
    factor = (
        F.when(F.col("velocity_tier") == "slow", 1.3)
        .when(F.col("velocity_tier") == "fast", 0.7)
        .otherwise(1.0)
    )
    return (
        audit_history.join(tiers, ["store_nbr", "family"])
        .filter(F.col("date") >= F.lit("2017-01-26").cast("date"))
        .select(
            "date", "store_nbr", "family", F.col("sales").alias("actual"),
            (F.col("sales") * factor).alias("predicted"), F.lit("val").alias("split"),
        )
    )
