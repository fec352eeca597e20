"""Cleaning and roll-up of bed frames (one row per state or hospital)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedledger.functions.exact import exact_or_plain_sum
from bedledger.functions.guards import clip, finite_or_null, number_from_text
from bedledger.functions.rates import percent_or_zero
from bedledger.functions.regions import named_region, regions_frame
from bedledger.schema import BED_COLUMNS


def _with_numbers(df: DataFrame) -> DataFrame:
    """The bed counts as doubles, each text read once.

    The filters on counts read from texts would be pushed below a plain projection, and read the texts again in each; they
    stay above the output of a generator. Filters on counts that are numbers already go down to the scan.
    """
    texts = [c for c in BED_COLUMNS if isinstance(df.schema[c].dataType, T.StringType)]
    numbers = df.withColumns({c: F.col(c).cast("double") for c in BED_COLUMNS if c not in texts})
    if not texts:
        return numbers
    read = F.struct(*(number_from_text(c).alias(c) for c in texts))
    numbers = numbers.select("*", F.explode(F.array(read)).alias("_numbers"))
    return numbers.withColumns({c: F.col(f"_numbers.{c}") for c in texts}).drop("_numbers")


def validate_and_clean_bed_data(df: DataFrame) -> DataFrame:
    """Keep rows whose five bed counts are numbers of at least 0, and make them consistent.

    Occupied beds are limited to total beds, COVID beds to all occupied beds; the limit
    stays in the result as `total_occupied`.
    """
    numbers = _with_numbers(df)
    valid = numbers.na.drop(subset=BED_COLUMNS)
    for c in BED_COLUMNS:
        valid = valid.filter(F.col(c) >= 0)
    return (
        valid.withColumns(
            {
                "occupied_adult_beds": F.least("occupied_adult_beds", "total_adult_beds"),
                "occupied_pediatric_beds": F.least(
                    "occupied_pediatric_beds", "total_pediatric_beds"
                ),
            }
        )
        .withColumn("total_occupied", F.col("occupied_adult_beds") + F.col("occupied_pediatric_beds"))
        .withColumn("covid_beds", F.least("covid_beds", "total_occupied"))
    )


def calculate_occupancy_stats(df: DataFrame) -> DataFrame:
    """Clean the frame, then add total and occupied beds and both rates (not rounded)."""
    return (
        validate_and_clean_bed_data(df)
        .withColumn("total_beds", F.col("total_adult_beds") + F.col("total_pediatric_beds"))
        .withColumn("occupied_beds", F.col("total_occupied"))
        .withColumn("occupancy_rate", clip(percent_or_zero("occupied_beds", "total_beds"), 0.0, 100.0))
        .withColumn("covid_percentage", clip(percent_or_zero("covid_beds", "occupied_beds"), 0.0, 100.0))
    )


def _numeric_columns(df: DataFrame) -> list[str]:
    kinds = (T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _per_region(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """One row for each of the four regions with these aggregates, 0 where a region has nothing to add up."""
    totals = (
        df.withColumn("region", named_region("state"))
        .filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(*(c.alias(name) for name, c in sums.items()))
    )
    return (
        # four rows each side
        regions_frame(df.sparkSession)
        .join(totals, "region", "left")
        .orderBy("position")
        .select(*(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums), "region")
    )


def get_region_stats(df: DataFrame) -> DataFrame:
    """Every numeric column added up per region, rates included; missing values are skipped.

    A decimal column stays decimal. Text and boolean columns are left out, and so are states outside the map. Adding up
    rates says little about a region: `region_rates` works them out anew.
    """
    decimals = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return _per_region(
        df,
        {c: F.sum(c) if c in decimals else exact_or_plain_sum(finite_or_null(c)) for c in _numeric_columns(df)},
    )


def region_rates(df: DataFrame) -> DataFrame:
    """Regional beds with rates taken from the regional sums."""
    names = ["total_beds", "occupied_beds", "covid_beds"]
    totals = _per_region(df, {c: exact_or_plain_sum(finite_or_null(c)) for c in names})
    return totals.withColumn(
        "occupancy_rate", percent_or_zero("occupied_beds", "total_beds")
    ).withColumn("covid_percentage", percent_or_zero("covid_beds", "occupied_beds"))


def region_rollup(df: DataFrame) -> DataFrame:
    """Clean, derive and add up per region, from the raw bed frame."""
    return df.transform(calculate_occupancy_stats).transform(get_region_stats)
