from datetime import date, datetime

import pytest

from bedledger.plans import questions, views
from bedledger.plans.dashboard import dashboard
from bedledger.sources.tables import read_sql_query
from frames import NAN, PED, PED_OCC, hospital, rating, report, tables

D = "2021-03-12"


def rows(df):
    return [tuple(r) for r in df.collect()]


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_metrics_guard_before_sum_and_clamp_after(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY"), hospital("A00002", "NY"), hospital("A00003", "CA")],
        [
            report("A00001", D, total=NAN, occupied=30.0, covid=50.0, **{PED: 20.0}),
            report("A00002", D, total=-999999.0, occupied=None, covid=-999999.0, **{PED: None}),
            report("A00003", D, total=10.0),
        ],
    )
    (row,) = dicts(questions.get_metrics(t, D, ["NY"]))
    assert row == {
        "state": "NY", "total_beds": 20.0, "occupied_beds": 20.0, "covid_beds": 20.0,
        "reporting_hospitals": 2, "occupancy_rate": 100.0, "covid_percentage": 100.0,
    }


def test_metrics_without_beds_are_zero(spark):
    t = tables(spark, [hospital("A00001", "NY")], [report("A00001", D, occupied=4.0, covid=2.0)])
    (row,) = dicts(questions.get_metrics(t, D, ["NY"]))
    assert (row["occupied_beds"], row["covid_beds"]) == (0, 0)
    assert (row["occupancy_rate"], row["covid_percentage"]) == (0, 0)


def test_metrics_count_a_hospital_once_for_two_timestamps_of_a_day(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY")],
        [report("A00001", D, total=1.0), report("A00001", f"{D}T12:00:00", total=2.0)],
    )
    (row,) = dicts(questions.get_metrics(t, D, ["NY"]))
    assert (row["total_beds"], row["reporting_hospitals"]) == (3.0, 1)


def test_null_state_matches_no_selection(spark):
    t = tables(spark, [hospital("A00001", None)], [report("A00001", D, total=1.0)])
    assert rows(questions.get_metrics(t, D, ["NY"])) == []
    assert rows(questions.get_state_metrics_for_map(t, D)) == []


def test_states_may_come_as_frame(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY"), hospital("A00002", "CA")],
        [report("A00001", D, total=1.0), report("A00002", D, total=1.0)],
    )
    states = spark.createDataFrame([("NY",), ("TX",)], "state string")
    assert rows(questions.get_metrics(t, D, states)) == rows(questions.get_metrics(t, D, ["NY", "TX"]))


def test_map_leaves_covid_unclamped(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY"), hospital("A00002", "CA")],
        [report("A00001", D, total=400.0, occupied=49.0, covid=70.0), report("A00002", D)],
    )
    assert rows(questions.get_state_metrics_for_map(t, D)) == [("CA", 0.0, 0.0), ("NY", 70.0, 12.3)]


def week_reports(counts):
    return [
        report(f"A{n:05}", day) for day, count in counts.items() for n in range(count)
    ]


def test_week_over_week_looks_at_the_newer_week(spark):
    t = tables(spark, [], week_reports({"2021-03-12": 10, "2021-03-05": 8}))
    assert rows(questions.get_week_over_week_comparison(t, D)) == [
        (date(2021, 3, 12), 10, None, None),
        (date(2021, 3, 5), 8, 10, -20.0),
    ]
    assert rows(questions.compare_with_week_before(t, D)) == [
        (date(2021, 3, 5), 8, None, None),
        (date(2021, 3, 12), 10, 8, 25.0),
    ]
    assert rows(views.reporting_tile(questions.get_week_over_week_comparison(t, D))) == [("10", "N/A")]


def test_windows_are_inclusive_and_cut_to_five(spark):
    days = ["2021-03-12", "2021-03-05", "2021-02-26", "2021-02-19", "2021-02-12", "2021-02-05", "2021-01-29"]
    t = tables(spark, [], week_reports(dict.fromkeys(days, 1)))
    newest = [date.fromisoformat(d) for d in days[:5]]
    assert [r.week for r in questions.get_week_over_week_comparison(t, D).collect()] == newest
    assert [r.week for r in questions.get_bed_availability_comparison(t, D).collect()] == newest
    # six weeks are candidates for the first, five for the second
    fewer = [d for d in days if d not in ("2021-03-05", "2021-02-26")]
    t = tables(spark, [], week_reports(dict.fromkeys(fewer, 1)))
    assert questions.get_week_over_week_comparison(t, D).count() == 4
    assert questions.get_bed_availability_comparison(t, D).count() == 3


def test_noon_of_the_date(spark):
    t = tables(spark, [], [report("A00001", D), report("A00002", f"{D}T12:00:00", total=3.0)])
    assert rows(questions.get_week_over_week_comparison(t, D))[0][1] == 1
    assert questions.get_bed_availability_comparison(t, D).first().total_adult_beds == 3.0


def test_free_beds_may_be_negative(spark):
    t = tables(spark, [], [report("A00001", D, total=3.0, occupied=5.0, covid=1.0, **{PED: 4.0, PED_OCC: 1.0})])
    assert rows(questions.get_bed_availability_comparison(t, D)) == [
        (date(2021, 3, 12), 3.0, 5.0, -2.0, 4.0, 1.0, 3.0, 1.0)
    ]


def test_quality_counts_each_rating_year(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY"), hospital("A00002", "NY")],
        [report("A00001", D, total=10.0, occupied=20.0), report("A00002", D, total=7.0)],
        [
            rating("A00001", "3", 2020), rating("A00001", "4", 2021), rating("A00001", "5", 2022),
            rating("A00002", "Not Available", 2021), rating("A00002", None, 2020),
        ],
    )
    assert rows(questions.get_quality_rating_analysis(t, D)) == [
        ("3", 10.0, 10.0, 100.0), ("4", 10.0, 10.0, 100.0), ("5", 10.0, 10.0, 100.0)]
    assert rows(questions.occupancy_by_latest_rating(t, D)) == [("4", 10.0, 10.0, 100.0)]


def test_quality_ignores_padding_but_not_text(spark):
    t = tables(spark, [hospital("A00001", "NY")], [report("A00001", D)],
               [rating("A00001", "Not Available  ", 2020), rating("A00001", "2  ", 2021)])
    assert [r[0] for r in rows(questions.get_quality_rating_analysis(t, D))] == ["2  "]
    t = tables(spark, [hospital("A00001", "NY")], [report("A00001", D)],
               [rating("A00001", "good", 2020), rating("A00001", "2", 2021)])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        questions.get_quality_rating_analysis(t, D).collect()


def test_one_nan_report_tops_the_ranking(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY", "36001"), hospital("A00002", "CA", "06001"),
         hospital("A00003", "TX", "48001"), hospital("A00004", "FL", "12001")],
        [report("A00001", D, covid=NAN), report("A00002", D, covid=9.0),
         report("A00003", D, covid=9.0), report("A00004", D, covid=1.0)],
    )
    ranks = [(r.state_fips, r.state, r["rank"]) for r in questions.get_state_covid_map_data(t, D).collect()]
    assert ranks == [("36", "NY", 1), ("06", "CA", 2), ("48", "TX", 2), ("12", "FL", 4)]
    assert rows(questions.get_top_states_by_covid(t, D))[0] == ("NY", "nan")


def test_top_states_round_after_ordering_and_need_cases(spark):
    amounts = {"AL": 0.0, "AK": 1.4, "AZ": 2.5, "AR": 2.6, "CA": 1234.5, "CO": 2.5, "CT": 0.2}
    t = tables(
        spark,
        [hospital(f"A{s}001"[:6].ljust(6, "0"), s) for s in amounts],
        [report(f"A{s}001"[:6].ljust(6, "0"), D, covid=v) for s, v in amounts.items()],
    )
    assert rows(questions.get_top_states_by_covid(t, D)) == [
        ("CA", "1,235"), ("AR", "3"), ("AZ", "3"), ("CO", "3"), ("AK", "1")]


def test_significant_changes(spark):
    pks = [f"A{n:05}" for n in range(1, 7)]
    t = tables(
        spark,
        [hospital(pk, "NY") for pk in pks[:5]],
        [
            report(pks[0], D, covid=30.0), report(pks[0], "2021-03-05", covid=20.0),  # +10
            report(pks[1], D, covid=15.0), report(pks[1], "2021-03-05", covid=20.0),  # -5
            report(pks[2], D, covid=24.0), report(pks[2], "2021-03-05", covid=20.0),  # too small
            report(pks[3], D, covid=99.0),  # no earlier report
            report(pks[4], D, covid=7.0), report(pks[4], "2021-03-05", covid=-999999.0),  # from 0
            report(pks[5], D, covid=500.0), report(pks[5], "2021-03-05", covid=1.0),  # unknown hospital
        ],
    )
    got = questions.get_hospitals_with_significant_changes(t, D)
    assert rows(got) == [
        ("Hospital A00001", "City", "NY", 30.0, 20.0, 10.0, 50.0),
        ("Hospital A00005", "City", "NY", 7.0, 0.0, 7.0, None),
        ("Hospital A00002", "City", "NY", 15.0, 20.0, -5.0, -25.0),
    ]
    assert [r[3:] for r in rows(views.display_changes(got))] == [
        ("30", "20", "+10", "+50.0%"), ("7", "0", "+7", "N/A"), ("15", "20", "-5", "-25.0%")]


def test_changes_keep_the_ten_largest(spark):
    pks = [f"A{n:05}" for n in range(20)]
    t = tables(
        spark,
        [hospital(pk, "NY") for pk in pks],
        [report(pk, D, covid=10.0 + n // 2) for n, pk in enumerate(pks)]
        + [report(pk, "2021-03-05") for pk in pks],
    )
    names = [r[0][-6:] for r in rows(questions.get_hospitals_with_significant_changes(t, D))]
    assert names == ["A00018", "A00019", "A00016", "A00017", "A00014", "A00015", "A00012", "A00013",
                     "A00010", "A00011"]


def test_non_reporting_boundaries(spark):
    last = {"A00001": "2021-02-26", "A00002": "2021-02-25", "A00004": "2021-03-19"}
    t = tables(
        spark,
        [hospital(f"A0000{n}", "NY") for n in range(1, 5)],
        [report(pk, day) for pk, day in last.items()] + [report("A00002", "2021-01-01")],
    )
    got = questions.get_non_reporting_hospitals(t, D)
    assert rows(got) == [
        ("Hospital A00002", "City", "NY", date(2021, 2, 25), 15),
        ("Hospital A00003", "City", "NY", None, None),
    ]
    assert [r[4] for r in rows(views.display_non_reporting(got))] == ["15 days", "Never reported"]


def test_non_reporting_puts_never_last(spark):
    t = tables(
        spark,
        [hospital(f"A{n:05}", "NY") for n in range(14)],
        [report(f"A{n:05}", f"2021-01-{n:02}") for n in range(2, 10)],
    )
    got = [(r.hospital_name[-2:], r.days_since_report) for r in questions.get_non_reporting_hospitals(t, D).collect()]
    assert [n for n, _ in got] == ["09", "08", "07", "06", "05", "04", "03", "02", "00", "01"]


def test_trend_covers_all_weeks(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY"), hospital("A00002", "CA")],
        [report("A00001", "2021-03-05", total=8.0, occupied=4.0, covid=1.0),
         report("A00001", "2020-01-03", total=8.0), report("A00002", "2021-03-05", total=1.0)],
    )
    got = sorted(rows(questions.get_trend_data(t, ["NY"])))
    assert got == [
        (datetime(2020, 1, 3), "NY", 8.0, 0.0, 0.0, 0.0, 0.0),
        (datetime(2021, 3, 5), "NY", 8.0, 4.0, 1.0, 50.0, 25.0),
    ]
    assert questions.get_trend_data(t, ["NY"]).columns == [
        "week", "state", "total_beds", "occupied_beds", "covid_beds", "occupancy_rate", "covid_percentage"]


def test_choices(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY"), hospital("A00002", None), hospital("A00003", "AL")],
        [report("A00001", "2021-03-05"), report("A00001", "2021-03-12T08:00:00"), report("A00003", "2021-03-05")],
    )
    assert rows(questions.get_available_dates(t)) == [(date(2021, 3, 12),), (date(2021, 3, 5),)]
    assert rows(questions.get_available_states_and_regions(t)) == [
        ("Region", "Northeast", 0), ("Region", "Midwest", 1), ("Region", "South", 2), ("Region", "West", 3),
        ("State", "AL", 0), ("State", "NY", 0)]


def test_kpi_totals(spark):
    t = tables(
        spark,
        [hospital("A00001", "NY"), hospital("A00002", "CA")],
        [report("A00001", D, total=8.0, occupied=4.0, covid=2.0), report("A00002", D, total=2.0)],
    )
    totals = views.kpi_totals(questions.get_metrics(t, D, ["NY", "CA"]))
    assert rows(totals) == [(2, 10.0, 4.0, 2.0, 40.0, 50.0)]
    assert rows(views.kpi_tiles(totals)) == [("2", "40.0%", "50.0%")]
    assert rows(views.kpi_totals(questions.get_metrics(t, D, ["TX"]))) == []


def test_sql_text_with_parameters(spark):
    t = tables(spark, [hospital("A00001", "NY"), hospital("A00002", "CA")], [])
    got = read_sql_query("SELECT hospital_pk FROM hospital WHERE state = :state", t, {"state": "CA"})
    assert rows(got) == [("A00002",)]


def test_dashboard_slice_gives_the_same_answers(spark):
    days = ["2021-03-12", "2021-03-05", "2021-02-26", "2021-02-05", "2021-01-29", "2020-06-05"]
    t = tables(
        spark,
        [hospital(f"A{n:05}", s) for n, s in enumerate(["NY", "CA", "TX", "PR"])],
        [report(f"A{n:05}", d, total=20.0 + n, occupied=9.0 * n, covid=float(n * i * 3))
         for n in range(4) for i, d in enumerate(days) if (n + i) % 5],
        [rating(f"A{n:05}", str(n + 1), 2020) for n in range(4)],
    )
    page = dashboard(t, D, ["Northeast", "CA"])
    page["recent_reports"].persist()
    direct = {
        "metrics": views.selection_metrics(t, D, ["Northeast", "CA"]),
        "state_map": questions.get_state_metrics_for_map(t, D),
        "bed_table": views.display_beds(questions.get_bed_availability_comparison(t, D)),
        "weekly_reporting_chart": views.weekly_reporting_chart(questions.get_week_over_week_comparison(t, D)),
        "covid_map": questions.get_state_covid_map_data(t, D),
        "changes_table": views.display_changes(questions.get_hospitals_with_significant_changes(t, D)),
        "quality_table": views.display_quality(questions.get_quality_rating_analysis(t, D)),
    }
    for section, frame in direct.items():
        assert sorted(rows(page[section])) == sorted(rows(frame)), section
    for frame in page.values():
        frame.collect()
    page["recent_reports"].unpersist()


@pytest.mark.parametrize(
    "sql",
    [
        "-- the hospitals\nWITH a AS (SELECT hospital_pk FROM hospital) SELECT * FROM a WHERE hospital_pk > :least",
        "/* one */ SELECT hospital_pk FROM `hospital` WHERE hospital_pk > :least -- end",
        "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 3) "
        "SELECT DISTINCT hospital_pk FROM hospital CROSS JOIN n WHERE hospital_pk > :least",
        "WITH hospital AS (SELECT * FROM hospital WHERE hospital_pk > :least), b AS (WITH c AS (SELECT * FROM hospital) SELECT * FROM c) "
        "SELECT hospital_pk FROM b",
    ],
)
def test_any_query_text_runs(spark, sql):
    t = tables(spark, [hospital(f"00000{n}", "NY") for n in (1, 2, 3)], [])
    spark.range(1).createOrReplaceTempView("hospital")  # the caller's own view of that name
    try:
        got = read_sql_query(sql, t, {"least": "000001"})
        assert sorted(r.hospital_pk for r in got.collect()) == ["000002", "000003"]
        assert spark.table("hospital").columns == ["id"]
    finally:
        spark.catalog.dropTempView("hospital")
