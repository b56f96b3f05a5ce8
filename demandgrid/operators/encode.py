"""Categorical and numeric encodings as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a closed-form linear fit handles at most 4096 columns, so a longer list is an error
MAX_CATEGORIES = 4096


def categorical_columns(df: DataFrame, always: Sequence[str] = ("store_nbr", "family")) -> list:
    """Keys and every text column."""
    return [
        f.name
        for f in df.schema.fields
        if f.name in always or isinstance(f.dataType, T.StringType)
    ]


def sorted_categories(df: DataFrame, col: str) -> list:
    """Distinct non-null values in their natural order (numbers sort as numbers)."""
    rows = df.select(col).dropna().distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{col} has more than {MAX_CATEGORIES} categories")
    return sorted(r[0] for r in rows)


def _level(col: str, value) -> str:
    return f"{col}_{value}"


@dataclass
class OneHot:
    """Indicator columns with the first category as base level."""

    categories: Mapping[str, Sequence] = field(default_factory=dict)
    numeric: Sequence[str] = ()

    @classmethod
    def fit(cls, df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> OneHot:
        return cls({c: sorted_categories(df, c) for c in categorical}, list(numeric))

    @property
    def names(self) -> list[str]:
        dummies = [_level(c, v) for c, vs in self.categories.items() for v in vs[1:]]
        return [*self.numeric, *dummies]

    def columns(self, available: Sequence[str]) -> dict[str, Column]:
        """Same columns in the same order for any frame.

        Absent columns, missing numbers and unseen categories all give zero.
        """
        zero = F.lit(0.0)
        out: dict[str, Column] = {}
        for c in self.numeric:
            out[c] = F.coalesce(F.col(c).cast("double"), zero) if c in available else zero
        for c, values in self.categories.items():
            for v in values[1:]:
                hit = F.col(c) == F.lit(v)
                out[_level(c, v)] = F.when(hit, 1.0).otherwise(0.0) if c in available else zero
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        cols = self.columns(df.columns)
        return df.select(*keep, *[e.alias(n) for n, e in cols.items()])

    def vectors(self, df: DataFrame, out: str, keep: Sequence[str] = ()) -> DataFrame:
        """The same columns as one sparse vector, for fitting with many levels.

        The base level is listed last for the encoder, which drops the last one; unseen
        and missing values are read as the base level.
        """
        used = {c: vs for c, vs in self.categories.items() if len(vs) > 1}
        rows = df.withColumns(
            {
                **{f"_n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                   for c in self.numeric},
                **{
                    f"_t_{c}": F.coalesce(
                        F.when(F.col(c).isin(list(vs)), F.col(c).cast("string")),
                        F.lit(str(vs[0])),
                    )
                    for c, vs in used.items()
                },
            }
        )
        inputs = [f"_n_{c}" for c in self.numeric]
        if used:
            for c, vs in used.items():
                rows = StringIndexerModel.from_labels(
                    [str(v) for v in [*vs[1:], vs[0]]], f"_t_{c}", f"_i_{c}"
                ).transform(rows)
            codes = OneHotEncoder(
                inputCols=[f"_i_{c}" for c in used], outputCols=[f"_v_{c}" for c in used]
            )
            rows = codes.fit(rows).transform(rows)
            inputs += [f"_v_{c}" for c in used]
        return VectorAssembler(inputCols=inputs, outputCol=out).transform(rows).select(out, *keep)


@dataclass
class Ordinal:
    """Sorted text codes 0, 1, ...; unknown text is -1, missing text its own category."""

    codes: Mapping[str, Sequence[str]] = field(default_factory=dict)
    numeric: Sequence[str] = ()

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> Ordinal:
        text = [
            f.name
            for f in df.schema.fields
            if f.name in cols and isinstance(f.dataType, T.StringType)
        ]
        filled = df.select(*[F.coalesce(c, F.lit("missing")).alias(c) for c in text])
        codes = {c: sorted_categories(filled, c) for c in text}
        return cls(codes, [c for c in cols if c in df.columns and c not in text])

    @property
    def names(self) -> list[str]:
        return [*self.codes, *self.numeric]

    def columns(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c, values in self.codes.items():
            known = F.array(*[F.lit(v) for v in values])
            place = F.array_position(known, F.coalesce(F.col(c), F.lit("missing")))
            out[c] = (place - 1).cast("double")
        for c in self.numeric:
            out[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return out


def standardized(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes zero.

    The moments are one aggregate read as a scalar subquery.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
        ).alias("st")
    ).scalar()
    base = df.withColumn("_st", stats)

    def scaled(c: str) -> Column:
        mean, std = F.col(f"_st.m_{c}"), F.col(f"_st.s_{c}")
        return (F.col(c) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return base.withColumns({f"{c}{suffix}": scaled(c) for c in cols}).drop("_st")
