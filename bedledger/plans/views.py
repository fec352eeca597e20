"""Tables behind the dashboard: totals, chart series and display text.

All take the small result of a question, so they add projections only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.functions.exact import exact_plus
from bedledger.functions.rates import percent_or_zero
from bedledger.functions.regions import get_states_for_selection
from bedledger.functions.text import (
    count_text,
    percent_text,
    percent_text_or_na,
    signed_count_text,
    signed_percent_text,
)
from bedledger.plans.questions import get_metrics, get_trend_data
from bedledger.plans.slices import sums
from bedledger.schema import WEEK
from bedledger.sources.tables import Tables


def kpi_totals(metrics: DataFrame) -> DataFrame:
    """Totals over the states of `get_metrics`, with rates; no row if there are no states."""
    totals = metrics.agg(
        F.sum("reporting_hospitals").alias("reporting_hospitals"),
        *sums("total_beds", "occupied_beds", "covid_beds"),
    ).filter(F.col("reporting_hospitals").isNotNull())
    return totals.withColumn(
        "occupancy_rate", F.least(percent_or_zero("occupied_beds", "total_beds"), F.lit(100.0))
    ).withColumn(
        "covid_percentage", F.least(percent_or_zero("covid_beds", "occupied_beds"), F.lit(100.0))
    )


def kpi_tiles(totals: DataFrame) -> DataFrame:
    """The three headline figures as text."""
    return totals.select(
        count_text("reporting_hospitals").alias("total_reporting_hospitals"),
        percent_text("occupancy_rate").alias("overall_bed_occupancy"),
        percent_text("covid_percentage").alias("covid_share_of_occupied_beds"),
    )


def comparison_chart(metrics: DataFrame) -> DataFrame:
    """Both rates per state, one row per bar."""
    return metrics.unpivot(
        ["state"], ["occupancy_rate", "covid_percentage"], "variable", "value"
    )


def bed_trend_chart(availability: DataFrame) -> DataFrame:
    """Occupied and COVID beds per week, one row per point."""
    occupied = exact_plus("occupied_adult_beds", "occupied_pediatric_beds")
    return availability.select(
        WEEK, occupied.alias("Total Occupied Beds"), F.col("covid_beds").alias("COVID Beds")
    ).unpivot([WEEK], ["Total Occupied Beds", "COVID Beds"], "series", "beds")


def weekly_reporting_chart(comparison: DataFrame) -> DataFrame:
    """Reporting hospitals per week."""
    return comparison.select(WEEK, "hospital_count")


def quality_chart(by_rating: DataFrame) -> DataFrame:
    """Occupancy rate per quality rating."""
    return by_rating.select("overall_quality_rating", "occupancy_rate")


def occupancy_trend_chart(trend: DataFrame) -> DataFrame:
    """Occupancy rate per week and state."""
    return trend.select(WEEK, "state", "occupancy_rate")


def reporting_tile(comparison: DataFrame) -> DataFrame:
    """Newest week of the week-over-week comparison as text."""
    return (
        comparison.orderBy(F.desc(WEEK))
        .limit(1)
        .select(
            count_text("hospital_count").alias("hospital_count"),
            percent_text_or_na("percent_change").alias("percent_change"),
        )
    )


def display_beds(availability: DataFrame) -> DataFrame:
    """Bed availability with every count as text."""
    return availability.select(
        WEEK, *(count_text(c).alias(c) for c in availability.columns if c != WEEK)
    )


def display_quality(by_rating: DataFrame) -> DataFrame:
    """Quality analysis with display headings (fixed values)."""
    return by_rating.withColumn("occupancy_rate", percent_text("occupancy_rate")).withColumnsRenamed(
        {
            "overall_quality_rating": "Quality Rating",
            "total_beds": "Total Beds",
            "occupied_beds": "Occupied Beds",
            "occupancy_rate": "Occupancy Rate",
        }
    )


def display_changes(changes: DataFrame) -> DataFrame:
    """Significant changes with counts and percentages as text."""
    return changes.withColumns(
        {
            "current_cases": count_text("current_cases"),
            "previous_cases": count_text("previous_cases"),
            "absolute_change": signed_count_text("absolute_change"),
            "percent_change": signed_percent_text("percent_change"),
        }
    )


def display_non_reporting(hospitals: DataFrame) -> DataFrame:
    """Non-reporting hospitals with the age of the last report as text."""
    days = F.concat(F.col("days_since_report").cast("string"), F.lit(" days"))
    return hospitals.withColumn(
        "days_since_report", F.coalesce(days, F.lit("Never reported"))
    )


def selection_metrics(tables: Tables, selected_date: date | str, areas: list[str]) -> DataFrame:
    """`get_metrics` for a mixed selection of states and regions."""
    return get_metrics(tables, selected_date, get_states_for_selection(areas))


def selection_trend(tables: Tables, areas: list[str]) -> DataFrame:
    """`get_trend_data` for a mixed selection of states and regions."""
    return get_trend_data(tables, get_states_for_selection(areas))
