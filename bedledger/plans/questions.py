"""The twelve named questions over the tables, each a lazy DataFrame.

Joins are plain equi-joins without a broadcast hint: how large the hospital and quality
tables are is not known here, so Catalyst and AQE choose by their measured size, and a
shuffled join splits skewed keys at run time.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bedledger.functions.exact import exact_minus, exact_sum
from bedledger.functions.guards import nonneg, nonneg_keep_nan
from bedledger.functions.rates import percent, rate
from bedledger.functions.text import count_text
from bedledger.plans.slices import (
    ADULT,
    ADULT_OCCUPIED,
    COVID,
    PEDIATRIC,
    PEDIATRIC_OCCUPIED,
    amounts,
    between_days,
    day,
    in_states,
    on_day,
    sums,
    with_rates,
)
from bedledger.schema import NO_RATING, REGION_STATES, WEEK
from bedledger.sources.tables import Tables, with_week

Day = date | str

# How many days before the selected date a question looks back.
REPORTING_DAYS = 35
BED_DAYS = 28
CHANGE_DAYS = 7
LONGEST_LOOK_BACK = max(REPORTING_DAYS, BED_DAYS, CHANGE_DAYS)
# A hospital is silent when its last report is older.
SILENT_DAYS = 14


def get_available_dates(tables: Tables) -> DataFrame:
    """Days with reports, newest first."""
    return with_week(tables.weekly_hospital_stats).select(WEEK).distinct().orderBy(F.desc(WEEK))


def get_available_states_and_regions(tables: Tables) -> DataFrame:
    """Names to choose from: the four regions in display order (`position`), and the states that occur."""
    states = (
        tables.hospital.filter(F.col("state").isNotNull())
        .select(F.lit("State").alias("kind"), F.col("state").alias("name"))
        .distinct()
    )
    names = ", ".join(f"('Region', '{region}', {i})" for i, region in enumerate(REGION_STATES))
    regions = tables.hospital.sparkSession.sql(f"SELECT * FROM VALUES {names} AS r(kind, name, position)")
    return regions.union(states.withColumn("position", F.lit(0))).orderBy("kind", "position", "name")


def get_metrics(tables: Tables, selected_date: Day, states: list[str] | DataFrame) -> DataFrame:
    """Beds, COVID beds, reporting hospitals and rates per state on one day.

    Reports are added up per hospital first, so the join sees no key twice, and the rows
    stay partitioned by hospital: counting distinct hospitals needs no shuffle of its own.
    """
    per_hospital = (
        on_day(tables, selected_date)
        .select("hospital_pk", *amounts())
        .groupBy("hospital_pk")
        .agg(*sums("total_beds", "occupied_beds", "covid_beds"))
    )
    hospitals = in_states(tables.hospital, states).select("hospital_pk", "state")
    return (
        per_hospital.join(hospitals, "hospital_pk")
        .groupBy("state")
        .agg(
            *sums("total_beds", "occupied_beds", "covid_beds"),
            F.count_distinct("hospital_pk").alias("reporting_hospitals"),
        )
        .transform(with_rates)
    )


def get_state_metrics_for_map(tables: Tables, selected_date: Day) -> DataFrame:
    """Occupancy rate and COVID cases (not clamped to occupied beds) per state."""
    hospitals = tables.hospital.filter(F.col("state").isNotNull()).select("hospital_pk", "state")
    totals = (
        on_day(tables, selected_date)
        .select("hospital_pk", *amounts())
        .join(hospitals, "hospital_pk")
        .groupBy("state")
        .agg(*sums("total_beds", "occupied_beds", "covid_beds"))
    )
    occupied = F.least("occupied_beds", "total_beds")
    return totals.select(
        "state",
        F.col("covid_beds").alias("covid_cases"),
        rate(occupied, "total_beds").alias("occupancy_rate"),
    ).orderBy("state")


def _weekly_counts(tables: Tables, selected_date: Day) -> DataFrame:
    # The upper bound compares the timestamp itself with midnight of the date.
    return (
        between_days(tables, selected_date, REPORTING_DAYS)
        .filter(F.col("collection_week") <= day(selected_date).cast("timestamp_ntz"))
        .groupBy(WEEK)
        .agg(F.count_distinct("hospital_pk").alias("hospital_count"))
        .orderBy(F.desc(WEEK))
        .limit(5)
    )


def _with_change(counts: DataFrame, order) -> DataFrame:
    # At most five rows remain, so a window without partitions is fine.
    previous = F.lag("hospital_count").over(Window.orderBy(order))
    change = F.col("hospital_count") - F.col("prev_week_count")
    return counts.withColumn("prev_week_count", previous).withColumn(
        "percent_change", percent(change, "prev_week_count")
    )


def get_week_over_week_comparison(tables: Tables, selected_date: Day) -> DataFrame:
    """Reporting hospitals in the last five weeks, each against the row above it.

    Weeks run newest first, so `prev_week_count` is the count of the following week and
    the newest week has none. Use `compare_with_week_before` for the calendar sense.
    """
    return _with_change(_weekly_counts(tables, selected_date), F.desc(WEEK))


def compare_with_week_before(tables: Tables, selected_date: Day) -> DataFrame:
    """Reporting hospitals in the last five weeks, each against the week before it."""
    return _with_change(_weekly_counts(tables, selected_date), F.asc(WEEK))


def get_bed_availability_comparison(tables: Tables, selected_date: Day) -> DataFrame:
    """Total, occupied and free beds per week, for the date and four weeks back."""
    weekly = (
        between_days(tables, selected_date, BED_DAYS)
        .groupBy(WEEK)
        .agg(
            exact_sum(nonneg(ADULT)).alias("total_adult_beds"),
            exact_sum(nonneg(ADULT_OCCUPIED)).alias("occupied_adult_beds"),
            exact_sum(nonneg(PEDIATRIC)).alias("total_pediatric_beds"),
            exact_sum(nonneg(PEDIATRIC_OCCUPIED)).alias("occupied_pediatric_beds"),
            exact_sum(nonneg(COVID)).alias("covid_beds"),
        )
        .orderBy(F.desc(WEEK))
        .limit(5)
    )
    free = {
        kind: exact_minus(f"total_{kind}_beds", f"occupied_{kind}_beds")
        for kind in ("adult", "pediatric")
    }
    return weekly.select(
        WEEK,
        "total_adult_beds",
        "occupied_adult_beds",
        free["adult"].alias("available_adult_beds"),
        "total_pediatric_beds",
        "occupied_pediatric_beds",
        free["pediatric"].alias("available_pediatric_beds"),
        "covid_beds",
    )


def _by_rating(tables: Tables, selected_date: Day, ratings: DataFrame) -> DataFrame:
    rated = ratings.filter(
        F.col("overall_quality_rating").isNotNull()
        & (F.rtrim("overall_quality_rating") != NO_RATING)
    ).select("hospital_pk", "overall_quality_rating")
    occupied = F.least("occupied_beds", "total_beds")
    return (
        on_day(tables, selected_date)
        .select("hospital_pk", *amounts())
        # a report without a hospital does not count
        .join(tables.hospital.select("hospital_pk"), "hospital_pk")
        .join(rated, "hospital_pk")
        .groupBy("overall_quality_rating")
        .agg(*sums("total_beds", "occupied_beds"))
        .withColumn("occupied_beds", occupied)
        .withColumn("occupancy_rate", rate("occupied_beds", "total_beds"))
        .orderBy(F.col("overall_quality_rating").cast("int"))
    )


def get_quality_rating_analysis(tables: Tables, selected_date: Day) -> DataFrame:
    """Occupancy per quality rating; a hospital counts once for each year it was rated."""
    return _by_rating(tables, selected_date, tables.hospital_quality)


def occupancy_by_latest_rating(tables: Tables, selected_date: Day) -> DataFrame:
    """Occupancy per quality rating, by each hospital's latest rating up to the date."""
    latest = (
        tables.hospital_quality.filter(F.col("rating_year") <= F.year(day(selected_date)))
        .groupBy("hospital_pk")
        .agg(F.max_by("overall_quality_rating", "rating_year").alias("overall_quality_rating"))
    )
    return _by_rating(tables, selected_date, latest)


def _covid_by(tables: Tables, selected_date: Day, *keys: str) -> DataFrame:
    hospitals = tables.hospital.filter(F.col("state").isNotNull()).select(
        "hospital_pk", "state", F.substring("fips_code", 1, 2).alias("state_fips")
    )
    return (
        on_day(tables, selected_date)
        .select("hospital_pk", nonneg_keep_nan(COVID).alias("covid_cases"))
        .join(hospitals, "hospital_pk")
        .groupBy(*keys)
        .agg(*sums("covid_cases"))
    )


def get_state_covid_map_data(tables: Tables, selected_date: Day) -> DataFrame:
    """COVID cases per state with their rank; ties share a rank."""
    # One row per state is left, so a window without partitions is fine.
    rank = F.rank().over(Window.orderBy(F.desc("covid_cases")))
    return (
        _covid_by(tables, selected_date, "state_fips", "state")
        .withColumn("rank", rank)
        .orderBy(F.desc("covid_cases"), "state_fips", "state")
    )


def get_hospitals_with_significant_changes(tables: Tables, selected_date: Day) -> DataFrame:
    """The ten largest changes of at least 5 COVID cases against exactly one week before.

    Hospitals are looked up last, for the few changes that pass the threshold. A report of
    the day meets each report of the day a week before; weekly reports make that one pair.
    """

    def cases(days_back: int, name: str) -> DataFrame:
        reports = on_day(tables, selected_date, days_back)
        return reports.select("hospital_pk", nonneg_keep_nan(COVID).alias(name))

    # A hospital without an earlier report has no change and cannot pass the threshold.
    changes = (
        cases(0, "current_cases")
        .join(cases(CHANGE_DAYS, "previous_cases"), "hospital_pk")
        .withColumn("absolute_change", exact_minus("current_cases", "previous_cases"))
        .filter(F.abs("absolute_change") >= 5)
    )
    hospitals = tables.hospital.select("hospital_pk", "hospital_name", "city", "state")
    return (
        changes.join(hospitals, "hospital_pk")
        .orderBy(F.desc(F.abs("absolute_change")), "hospital_pk")
        .limit(10)
        .select(
            "hospital_name",
            "city",
            "state",
            "current_cases",
            "previous_cases",
            "absolute_change",
            F.when(
                F.col("previous_cases") > 0, percent("absolute_change", "previous_cases")
            ).alias("percent_change"),
        )
    )


def get_non_reporting_hospitals(tables: Tables, selected_date: Day) -> DataFrame:
    """Ten hospitals whose last report is more than two weeks old, or that never reported.

    The last report is taken over all reports, later ones than the date included. Hospitals with a report
    since the limit are left out first, which reads only those partitions; the older reports are
    looked at for the others alone.
    """
    if tables.last_report is not None:
        return _silent_by_last_report(tables, selected_date)
    reports = with_week(tables.weekly_hospital_stats)
    limit = F.date_sub(day(selected_date), SILENT_DAYS)
    active = reports.filter(F.col(WEEK) >= limit).select("hospital_pk").distinct()
    silent = tables.hospital.select("hospital_pk", "hospital_name", "city", "state").join(
        active, "hospital_pk", "left_anti"
    )
    last_reports = (
        reports.filter(F.col(WEEK) < limit)
        .join(silent.select("hospital_pk"), "hospital_pk", "left_semi")
        .groupBy("hospital_pk")
        .agg(F.max(WEEK).alias("last_report_date"))
    )
    return _longest_silent(silent.join(last_reports, "hospital_pk", "left"), selected_date)


def _silent_by_last_report(tables: Tables, selected_date: Day) -> DataFrame:
    """The same from the stored last report of each hospital, without a look at the reports."""
    last = tables.last_report.select("hospital_pk", "last_report_date")
    hospitals = tables.hospital.select("hospital_pk", "hospital_name", "city", "state").join(last, "hospital_pk", "left")
    reported = F.col("last_report_date")
    silent = hospitals.filter(reported.isNull() | (reported < F.date_sub(day(selected_date), SILENT_DAYS)))
    return _longest_silent(silent, selected_date)


def _longest_silent(hospitals: DataFrame, selected_date: Day) -> DataFrame:
    last = F.col("last_report_date")
    return (
        hospitals.orderBy(F.desc_nulls_last("last_report_date"), "hospital_pk")
        .limit(10)
        .select(
            "hospital_name",
            "city",
            "state",
            "last_report_date",
            F.datediff(day(selected_date), last).alias("days_since_report"),
        )
    )


def get_trend_data(tables: Tables, states: list[str] | DataFrame) -> DataFrame:
    """Beds, COVID beds and rates per week and state, over all weeks; from the stored sums where there are some."""
    if tables.state_trend is not None:
        return (
            in_states(tables.state_trend, states)
            .select(WEEK, "state", "total_beds", "occupied_beds", "covid_beds")
            .transform(with_rates)
            .withColumn(WEEK, F.col(WEEK).cast("timestamp_ntz"))
        )
    hospitals = in_states(tables.hospital, states).select("hospital_pk", "state")
    return (
        with_week(tables.weekly_hospital_stats)
        .select("hospital_pk", WEEK, *amounts())
        .join(hospitals, "hospital_pk")
        .groupBy(WEEK, "state")
        .agg(*sums("total_beds", "occupied_beds", "covid_beds"))
        .transform(with_rates)
        .withColumn(WEEK, F.col(WEEK).cast("timestamp_ntz"))
    )


def get_top_states_by_covid(tables: Tables, selected_date: Day) -> DataFrame:
    """The five states with most COVID cases, as display text."""
    return (
        _covid_by(tables, selected_date, "state")
        .filter(F.col("covid_cases") > 0)
        .orderBy(F.desc("covid_cases"), "state")
        .limit(5)
        .withColumn("covid_cases", count_text(F.round("covid_cases", 0)))
    )
