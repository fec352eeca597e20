"""The table contract as queries: keys, references and widths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def duplicate_keys_of(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The same for several tables: table name, key values as text, number of rows."""
    found = [
        duplicate_keys(df, key).select(
            F.lit(name).alias("table_name"),
            F.concat_ws(" ", *(F.col(k).cast("string") for k in key)).alias("key"),
            "copies",
        )
        for name, (df, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, found)


def orphan_rows(df: DataFrame, hospital: DataFrame) -> DataFrame:
    """Rows that point to no hospital."""
    return df.join(hospital.select("hospital_pk"), "hospital_pk", "left_anti")


def width_overflow(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Per fixed-width column, how many values are too long (trailing blanks are free)."""
    counts = df.agg(
        *(F.count_if(F.length(F.rtrim(F.col(c))) > n).alias(c) for c, n in widths.items())
    )
    return counts.unpivot([], list(widths), "column_name", "overflow_rows")


def orphan_rows_of(tables: dict[str, DataFrame], hospital: DataFrame) -> DataFrame:
    """Per table and missing hospital, how many rows point to it."""
    found = [
        orphan_rows(df, hospital)
        .groupBy("hospital_pk")
        .agg(F.count("*").alias("rows"))
        .select(F.lit(name).alias("table_name"), "hospital_pk", "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, found)


def width_overflow_of(tables: dict[str, tuple[DataFrame, dict[str, int]]]) -> DataFrame:
    """The widths of several tables, with the table's name."""
    found = [
        width_overflow(df, widths).select(F.lit(name).alias("table_name"), "column_name", "overflow_rows")
        for name, (df, widths) in tables.items()
    ]
    return reduce(DataFrame.unionByName, found)
