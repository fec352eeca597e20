"""Every operator and question as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedledger.functions.guards import nonneg, nonneg_keep_nan
from bedledger.functions.regions import expand_selection, get_region_for_state
from bedledger.operators import beds, checks, cleaning, loads, upsert
from bedledger.plans import questions, views
from bedledger.plans.slices import COVID
from bedledger.schema import (
    ARRIVAL,
    BROKEN_LINE,
    HOSPITAL_COLUMNS,
    HOSPITAL_KEY,
    HOSPITAL_WIDTHS,
    QUALITY_KEY,
    QUALITY_WIDTHS,
    WEEKLY_KEY,
    WEEKLY_METRICS,
)
from bedledger.sources.feeds import read_hhs_csv, read_quality_csv
from bedledger.session import scratch_folder
from bedledger.sources.tables import read_sql_query, read_table, write_table
from testbed import derive

Query = Callable[[SparkSession, str], DataFrame]

# Selected date (a Monday), and the selections.
DAY = "2001-06-04"
LAST_DAYS = "2001-11-12"  # shortly after the data ends, so some hospitals have gone quiet
NORTHEAST = ["ME", "NY", "PA", "MA", "NJ"]
TREND_STATES = ["CA", "OR", "TX", "NY"]
AREAS = ["Northeast", "West", "TX", "PR"]

STATE_BEDS_SQL = """
SELECT h.state, SUM(w.total_icu_beds_7_day_avg) AS icu_beds, COUNT(*) AS reports
FROM weekly_hospital_stats w JOIN hospital h ON w.hospital_pk = h.hospital_pk
WHERE CAST(w.collection_week AS DATE) = :selected_date AND array_contains(:states, h.state)
GROUP BY h.state
"""


def on_the_day(question: Callable, days_back: int = 0) -> Query:
    """A question about DAY that looks so many days back."""
    back_to = str(date.fromisoformat(DAY) - timedelta(days=days_back))
    return lambda spark, sf: question(derive.tables(spark, sf, back_to, DAY), DAY)


def shown(view: Callable, question: Query) -> Query:
    return lambda spark, sf: view(question(spark, sf))


# ---- Feeds and cleaning ---------------------------------------------------


def src_hhs(spark, sf):
    path = derive.written_as_csv(derive.hhs_feed(spark, sf), "hhs")
    return read_hhs_csv(spark, path).drop(ARRIVAL)


def src_quality(spark, sf):
    path = derive.written_as_csv(derive.quality_feed(spark, sf), "quality")
    return read_quality_csv(spark, path).drop(ARRIVAL)


def clean_hhs(spark, sf):
    return cleaning.transform_hhs_data(derive.hhs_feed(spark, sf))


def clean_quality(spark, sf):
    return cleaning.transform_quality_data(derive.quality_feed(spark, sf), 2001)


def valid_key(spark, sf):
    feed = cleaning.project_rename_quality(derive.quality_feed(spark, sf))
    return cleaning.valid_key(feed).select("hospital_pk", "facility_name")


def sentinel_null(spark, sf):
    return cleaning.sentinel_to_null(derive.weekly(spark, sf), [COVID]).select(
        "hospital_pk", "week", F.col(COVID).alias("covid")
    )


def parse_week(spark, sf):
    feed = derive.hhs_feed(spark, sf).withColumn("week_text", F.col("collection_week"))
    return cleaning.parse_week(feed).select("hospital_pk", "address", "week_text", "collection_week")


def yes_no_bool(spark, sf):
    feed = derive.quality_feed(spark, sf)
    services = "Emergency Services"
    return feed.select(
        F.col("Facility Name").alias("facility_name"),
        cleaning.yes_to_true(F.col(services)).alias("emergency_services"),
    )


def existing_keys(spark, sf):
    return upsert.get_existing_hospitals(derive.hospital(spark, sf))


def quality_known(spark, sf):
    return upsert.known_hospitals_only(clean_quality(spark, sf), derive.hospital(spark, sf))


def reject_report(spark, sf):
    explained = cleaning.explain_hhs_rows(derive.hhs_feed(spark, sf))
    return cleaning.reject_report(explained).select(
        "hospital_pk", "hospital_name", "state", "collection_week", "reject_reason"
    )


def load_summary(spark, sf):
    return loads.hhs_load_summary(cleaning.explain_hhs_rows(derive.hhs_feed(spark, sf)))


def quality_load_summary(spark, sf):
    explained = cleaning.explain_quality_rows(derive.quality_feed(spark, sf))
    known = derive.hospital(spark, sf).select("hospital_pk", F.lit(True).alias("known")).distinct()
    marked = explained.join(known, "hospital_pk", "left").fillna(False, ["known"])
    return loads.quality_load_summary(marked.withColumn(BROKEN_LINE, F.lit(False)))


def _root(spark):
    return f"{scratch_folder(spark)}/stored-{uuid.uuid4().hex}"


def _loaded_hhs(spark, sf, times=1):
    root = _root(spark)
    path = derive.written_as_csv(derive.hhs_feed(spark, sf), "hhs")
    for _ in range(times):
        loads.load_hhs_data(spark, path, root, on_reject="set_aside")
    return root


def stored_hospital(spark, sf):
    """The weekly feed loaded, published and read back."""
    return read_table(spark, _loaded_hhs(spark, sf), "hospital")


def stored_weekly(spark, sf):
    """Loaded twice: the second load replaces every row by itself."""
    root = _loaded_hhs(spark, sf, times=2)
    return read_table(spark, root, "weekly_hospital_stats").drop("collection_week")


def stored_quality(spark, sf):
    root = _root(spark)
    write_table(derive.hospital(spark, sf), root, "hospital")
    path = derive.written_as_csv(derive.quality_feed(spark, sf), "quality")
    loads.load_quality_data(spark, path, 2001, root, on_reject="set_aside")
    return read_table(spark, root, "hospital_quality")


# ---- Upserts and checks ---------------------------------------------------


def distinct_rows(spark, sf):
    rows = derive.hospital_batch(spark, sf).select(*HOSPITAL_COLUMNS, "seq")
    return upsert.first_of_each_row(rows, "seq")


def upsert_hospital(spark, sf):
    batch = derive.hospital_batch(spark, sf)
    return upsert.upsert_hospital(derive.hospital(spark, sf), batch, "seq")


def upsert_weekly(spark, sf):
    existing, batch = derive.weekly_split(spark, sf, DAY)
    return _dated(upsert.upsert_weekly(existing, batch, "seq"))


def _dated(rows):
    return rows.withColumn("week", F.to_date("collection_week")).drop("collection_week")


def upsert_quality(spark, sf):
    hospital = derive.hospital(spark, sf)
    existing = derive.quality(spark, sf)
    ratings = clean_quality(spark, sf)
    batch = derive.quality_versions(upsert.known_hospitals_only(ratings, hospital))
    return upsert.upsert_quality(existing, batch, "seq")


def dq_pk(spark, sf):
    """Keys of all three tables: stored hospitals and batch, all reports and batch, ratings of both years twice."""
    hospitals = derive.hospital(spark, sf).unionByName(derive.hospital_batch(spark, sf).drop("seq"))
    stored, batch = derive.weekly_split(spark, sf, DAY)
    reports = stored.unionByName(batch.drop("seq"))
    ratings = derive.quality(spark, sf).unionByName(clean_quality(spark, sf))
    return checks.duplicate_keys_of(
        {
            "hospital": (hospitals, HOSPITAL_KEY),
            "weekly_hospital_stats": (reports, WEEKLY_KEY),
            "hospital_quality": (ratings, QUALITY_KEY),
        }
    )


def dq_fk(spark, sf):
    """Rows of both referring tables without a hospital."""
    hospital = derive.hospital(spark, sf).filter("hospital_pk NOT LIKE '%7'")
    return checks.orphan_rows_of(
        {"weekly_hospital_stats": derive.weekly(spark, sf), "hospital_quality": clean_quality(spark, sf)}, hospital
    )


def dq_width(spark, sf):
    """Both feeds against the widths of their tables."""
    ratings = cleaning.project_rename_quality(derive.quality_feed(spark, sf))
    return checks.width_overflow_of(
        {"hospital": (derive.hhs_feed(spark, sf), HOSPITAL_WIDTHS), "hospital_quality": (ratings, QUALITY_WIDTHS)}
    )


# ---- Expressions ----------------------------------------------------------


def nonneg_guard(spark, sf):
    adult, covid = WEEKLY_METRICS[0], COVID
    lax = nonneg_keep_nan(adult)
    return derive.weekly(spark, sf).select(
        "hospital_pk",
        "week",
        nonneg(adult).alias("adult"),
        nonneg(covid).alias("covid"),
        F.isnan(lax).alias("lax_adult_is_nan"),
        nonneg_keep_nan(covid).alias("lax_covid"),
    )


def state_region(spark, sf):
    return derive.hospital(spark, sf).select(
        "hospital_pk", "state", get_region_for_state("state").alias("region")
    )


def selected_areas(spark, sf):
    """What a user might pick: each hospital's state or, for even fips codes, its region."""
    by_region = F.col("fips_code").cast("int") % 2 == 0
    name = F.when(by_region, get_region_for_state("state")).otherwise(F.col("state"))
    return derive.hospital(spark, sf).filter("state IS NOT NULL").select(name.alias("selection"))


def expanded_selection(spark, sf):
    return expand_selection(selected_areas(spark, sf))


# ---- Questions ------------------------------------------------------------

state_metrics = on_the_day(lambda t, d: questions.get_metrics(t, d, NORTHEAST))
state_map = on_the_day(questions.get_state_metrics_for_map)
week_over_week = on_the_day(questions.get_week_over_week_comparison, questions.REPORTING_DAYS)
week_over_week_prev = on_the_day(questions.compare_with_week_before, questions.REPORTING_DAYS)
bed_availability = on_the_day(questions.get_bed_availability_comparison, questions.BED_DAYS)
quality_rating = on_the_day(questions.get_quality_rating_analysis)
quality_rating_latest = on_the_day(questions.occupancy_by_latest_rating)
covid_rank = on_the_day(questions.get_state_covid_map_data)
significant_changes = on_the_day(
    questions.get_hospitals_with_significant_changes, questions.CHANGE_DAYS
)
top_states = on_the_day(questions.get_top_states_by_covid)


def available_dates(spark, sf):
    return questions.get_available_dates(derive.tables(spark, sf))


def available_areas(spark, sf):
    return questions.get_available_states_and_regions(derive.tables(spark, sf))


def non_reporting(spark, sf):
    return questions.get_non_reporting_hospitals(derive.tables(spark, sf), LAST_DAYS)


def trend(spark, sf):
    return questions.get_trend_data(derive.tables(spark, sf), TREND_STATES)


def sql_query(spark, sf):
    params = {"selected_date": DAY, "states": F.array(*map(F.lit, NORTHEAST))}
    return read_sql_query(STATE_BEDS_SQL, derive.tables(spark, sf, DAY, DAY), params)


# ---- Bed frames and dashboard ---------------------------------------------


def bed_rows(spark, sf):
    return derive.bed_rows(spark, sf)


selection_metrics = on_the_day(lambda t, d: views.selection_metrics(t, d, AREAS))


def selection_trend(spark, sf):
    return views.selection_trend(derive.tables(spark, sf), AREAS)


QUERIES: dict[str, Query] = {
    "src_hhs": src_hhs,
    "src_quality": src_quality,
    "clean_hhs": clean_hhs,
    "clean_quality": clean_quality,
    "valid_key": valid_key,
    "sentinel_null": sentinel_null,
    "parse_week": parse_week,
    "yes_no_bool": yes_no_bool,
    "existing_keys": existing_keys,
    "quality_known": quality_known,
    "reject_report": reject_report,
    "load_summary": load_summary,
    "quality_load_summary": quality_load_summary,
    "stored_hospital": stored_hospital,
    "stored_weekly": stored_weekly,
    "stored_quality": stored_quality,
    "distinct_rows": distinct_rows,
    "upsert_hospital": upsert_hospital,
    "upsert_weekly": upsert_weekly,
    "upsert_quality": upsert_quality,
    "dq_pk": dq_pk,
    "dq_fk": dq_fk,
    "dq_width": dq_width,
    "nonneg_guard": nonneg_guard,
    "state_region": state_region,
    "expand_selection": expanded_selection,
    "available_dates": available_dates,
    "available_areas": available_areas,
    "state_metrics": state_metrics,
    "state_map": state_map,
    "week_over_week": week_over_week,
    "week_over_week_prev": week_over_week_prev,
    "bed_availability": bed_availability,
    "quality_rating": quality_rating,
    "quality_rating_latest": quality_rating_latest,
    "covid_rank": covid_rank,
    "significant_changes": significant_changes,
    "non_reporting": non_reporting,
    "trend": trend,
    "top_states": top_states,
    "sql_query": sql_query,
    "bed_clean": shown(beds.validate_and_clean_bed_data, bed_rows),
    "occupancy_stats": shown(beds.calculate_occupancy_stats, bed_rows),
    "region_stats": shown(beds.get_region_stats, bed_rows),
    "region_rollup": shown(beds.region_rollup, bed_rows),
    "region_pipeline": shown(beds.region_rollup, bed_rows),
    "region_stats_weighted": shown(
        lambda rows: beds.region_rates(beds.calculate_occupancy_stats(rows)), bed_rows
    ),
    "kpi_totals": shown(views.kpi_totals, state_metrics),
    "kpi_tiles": shown(lambda m: views.kpi_tiles(views.kpi_totals(m)), state_metrics),
    "chart_comparison": shown(views.comparison_chart, state_metrics),
    "chart_bed_trend": shown(views.bed_trend_chart, bed_availability),
    "chart_weekly_reporting": shown(views.weekly_reporting_chart, week_over_week),
    "chart_quality": shown(views.quality_chart, quality_rating),
    "chart_trend": shown(views.occupancy_trend_chart, trend),
    "tile_reporting": shown(views.reporting_tile, week_over_week),
    "display_beds": shown(views.display_beds, bed_availability),
    "display_quality": shown(views.display_quality, quality_rating),
    "display_changes": shown(views.display_changes, significant_changes),
    "display_non_reporting": shown(views.display_non_reporting, non_reporting),
    "selection_metrics": selection_metrics,
    "selection_trend": selection_trend,
}
