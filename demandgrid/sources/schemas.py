"""Explicit schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """Schema from ``name type, ...``; needs no running session."""
    parts = [p.strip().split(" ") for p in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in parts])


TRAIN = _schema(
    "id bigint, date date, store_nbr bigint, family string, sales double, onpromotion bigint"
)
TEST = _schema("id bigint, date date, store_nbr bigint, family string, onpromotion bigint")
STORES = _schema("store_nbr bigint, city string, state string, type string, cluster bigint")
OIL = _schema("date date, dcoilwtico double")
HOLIDAYS = _schema(
    "date date, type string, locale string, locale_name string, description string, "
    "transferred boolean"
)
TRANSACTIONS = _schema("date date, store_nbr bigint, transactions bigint")
SUBMISSION = _schema("id bigint, sales double")

# fixed values: table name -> (default file name, schema)
TABLES = {
    "train": ("train.csv", TRAIN),
    "test": ("test.csv", TEST),
    "stores": ("stores.csv", STORES),
    "oil": ("oil.csv", OIL),
    "holidays": ("holidays_events.csv", HOLIDAYS),
    "transactions": ("transactions.csv", TRANSACTIONS),
    "sample_submission": ("sample_submission.csv", SUBMISSION),
}

PREDICTIONS = _schema(
    "date date, store_nbr bigint, family string, actual double, predicted double, split string"
)
RUN_RECORD = _schema(
    "metrics map<string,double>, params map<string,string>, elapsed_seconds double"
)
