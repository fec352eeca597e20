"""All frames of one dashboard page."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame

from bedledger.plans import questions, views
from bedledger.plans.slices import between_days
from bedledger.sources.tables import Tables


def dashboard(tables: Tables, selected_date: date | str, areas: list[str]) -> dict[str, DataFrame]:
    """Lazy frames by section. Ten of them need only the last weeks before the date.

    Those share one slice of the weekly table, under `recent_reports`. A caller who shows
    the whole page may persist it first; persisted or not, the results are the same.
    """
    recent = replace(
        tables, weekly_hospital_stats=between_days(tables, selected_date, questions.LONGEST_LOOK_BACK)
    )
    metrics = views.selection_metrics(recent, selected_date, areas)
    totals = views.kpi_totals(metrics)
    counts = questions.get_week_over_week_comparison(recent, selected_date)
    beds = questions.get_bed_availability_comparison(recent, selected_date)
    by_rating = questions.get_quality_rating_analysis(recent, selected_date)
    changes = questions.get_hospitals_with_significant_changes(recent, selected_date)
    # these two look at all weeks
    trend = views.selection_trend(tables, areas)
    silent = questions.get_non_reporting_hospitals(tables, selected_date)
    return {
        "recent_reports": recent.weekly_hospital_stats,
        "available_dates": questions.get_available_dates(tables),
        "available_areas": questions.get_available_states_and_regions(tables),
        "metrics": metrics,
        "kpi_totals": totals,
        "kpi_tiles": views.kpi_tiles(totals),
        "comparison_chart": views.comparison_chart(metrics),
        "state_map": questions.get_state_metrics_for_map(recent, selected_date),
        "reporting_tile": views.reporting_tile(counts),
        "weekly_reporting_chart": views.weekly_reporting_chart(counts),
        "bed_table": views.display_beds(beds),
        "bed_trend_chart": views.bed_trend_chart(beds),
        "quality_chart": views.quality_chart(by_rating),
        "quality_table": views.display_quality(by_rating),
        "occupancy_trend_chart": views.occupancy_trend_chart(trend),
        "covid_map": questions.get_state_covid_map_data(recent, selected_date),
        "top_states": questions.get_top_states_by_covid(recent, selected_date),
        "changes_table": views.display_changes(changes),
        "non_reporting_table": views.display_non_reporting(silent),
    }
