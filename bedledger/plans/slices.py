"""Shared building blocks of the questions.

Everything here is a narrow projection or filter, so date predicates reach the scan as
partition or row-group filters and only the columns a question needs are read.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedledger.functions.exact import exact_plus, exact_sum
from bedledger.functions.guards import nonneg
from bedledger.functions.rates import rate
from bedledger.schema import WEEK
from bedledger.sources.tables import Tables, with_week

ADULT = "all_adult_hospital_beds_7_day_avg"
PEDIATRIC = "all_pediatric_inpatient_beds_7_day_avg"
ADULT_OCCUPIED = "all_adult_hospital_inpatient_bed_occupied_7_day_avg"
PEDIATRIC_OCCUPIED = "all_pediatric_inpatient_bed_occupied_7_day_avg"
COVID = "inpatient_beds_used_covid_7_day_avg"


def day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def on_day(tables: Tables, selected_date: date | str, days_back: int = 0) -> DataFrame:
    """Reports whose calendar day is `days_back` days before the date."""
    reports = with_week(tables.weekly_hospital_stats)
    return reports.filter(F.col(WEEK) == F.date_sub(day(selected_date), days_back))


def between_days(tables: Tables, selected_date: date | str, days_back: int) -> DataFrame:
    """Reports of the date and the `days_back` days before it, both ends included."""
    last = day(selected_date)
    reports = with_week(tables.weekly_hospital_stats)
    return reports.filter(F.col(WEEK).between(F.date_sub(last, days_back), last))


def amounts() -> list[Column]:
    """Guarded bed counts of one report; the guard comes before any sum."""
    return [
        exact_plus(nonneg(ADULT), nonneg(PEDIATRIC)).alias("total_beds"),
        exact_plus(nonneg(ADULT_OCCUPIED), nonneg(PEDIATRIC_OCCUPIED)).alias("occupied_beds"),
        nonneg(COVID).alias("covid_beds"),
    ]


def sums(*names: str) -> list[Column]:
    return [exact_sum(name).alias(name) for name in names]


def with_rates(totals: DataFrame) -> DataFrame:
    """Clamp occupied to total and COVID to the clamped occupied, then add both rates."""
    occupied = F.least("occupied_beds", "total_beds")
    return (
        totals.withColumn("occupied_beds", occupied)
        .withColumn("covid_beds", F.least("covid_beds", "occupied_beds"))
        .withColumn("occupancy_rate", rate("occupied_beds", "total_beds"))
        .withColumn("covid_percentage", rate("covid_beds", "occupied_beds"))
    )


def in_states(hospital: DataFrame, states: list[str] | DataFrame) -> DataFrame:
    """Hospitals of the given states (a list, or a frame with a `state` column)."""
    if isinstance(states, DataFrame):
        return hospital.join(states.select("state"), "state", "left_semi")
    return hospital.filter(F.col("state").isin(list(states)))
