"""Random frames against plain row-by-row arithmetic."""

import math
import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from bedledger.operators import beds
from bedledger.plans import questions
from bedledger.schema import BED_COLUMNS, REGION_STATES, WEEKLY_METRICS
from frames import ADULT, ADULT_OCC, COVID, NAN, PED, PED_OCC, hospital, rating, report, tables

STATES = ["NY", "CA", "TX", "OH", "PR", None]
D = date(2021, 3, 12)


def missing(x):
    return x is None or math.isnan(x)


def tenth(part, whole):
    exact = Decimal(part) * 100 / Decimal(whole)
    return float(exact.quantize(Decimal("0.1"), ROUND_HALF_UP))


def test_beds_and_regions(spark):
    rng = random.Random(3)
    odd = [None, NAN, -1.0, -999999.0, 0.0]
    rows = [
        (*(rng.choice(odd) if rng.random() < 0.05 else float(rng.randrange(200)) for _ in BED_COLUMNS),
         rng.choice(STATES))
        for _ in range(500)
    ]
    kinds = ", ".join(f"{c} double" for c in BED_COLUMNS)
    frame = spark.createDataFrame(rows, f"{kinds}, state string")

    expected = []
    for ta, oa, tp, op, cv, state in rows:
        if any(missing(x) or x < 0 for x in (ta, oa, tp, op, cv)):
            continue
        oa, op = min(oa, ta), min(op, tp)
        cv, total, occupied = min(cv, oa + op), ta + tp, oa + op
        share = occupied / total * 100 if total else 0.0
        covid = cv / occupied * 100 if occupied else 0.0
        expected.append((ta, oa, tp, op, cv, state, occupied, total, occupied, share, covid))
    stats = beds.calculate_occupancy_stats(frame)
    assert sorted(map(tuple, stats.collect()), key=repr) == sorted(expected, key=repr)

    sums = {region: [0.0] * 10 for region in REGION_STATES}
    region_of = {s: region for region, states in REGION_STATES.items() for s in states}
    for row in expected:
        if row[5] in region_of:
            numbers = [*row[:5], *row[6:]]
            sums[region_of[row[5]]] = [a + b for a, b in zip(sums[region_of[row[5]]], numbers)]
    for row in beds.region_rollup(frame).collect():
        *got, region = row
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, sums[region], strict=True)), row


def make_tables(spark, rng):
    pks = [f"A{n:05}" for n in range(60)]
    hospitals = [hospital(pk, rng.choice(STATES), f"{rng.randrange(3):02}001") for pk in pks]
    reports = []

    def amount():
        return rng.choice([None, NAN, -999999.0, 0.0]) if rng.random() < 0.1 else float(rng.randrange(60))

    for pk in pks[:50]:
        for back in range(9):
            if rng.random() < (0.25 if back < 3 and pk > "A00040" else 0.8):
                when = (D + timedelta(days=7 - 7 * back)).isoformat()
                reports.append(report(pk, when, amount(), amount(), amount(), **{PED: amount(), PED_OCC: amount()}))
    ratings = [rating(pk, rng.choice(["1", "2", "5", "Not Available", None]), year)
               for pk in pks for year in (2019, 2020, 2022) if rng.random() < 0.8]
    return hospitals, reports, ratings, tables(spark, hospitals, reports, ratings)


def test_questions(spark):
    rng = random.Random(4)
    hospitals, reports, ratings, t = make_tables(spark, rng)
    state_of = {h[0]: h[4] for h in hospitals}
    names = ("hospital_pk", "collection_week", *WEEKLY_METRICS)
    rows = [dict(zip(names, r)) for r in reports]
    for r in rows:
        r["day"] = r["collection_week"].date()

    def n(x):
        return 0.0 if missing(x) else max(x, 0.0)

    def lax(x):
        return 0.0 if x is None else (x if math.isnan(x) else max(x, 0.0))

    def beds_of(r):
        return n(r[ADULT]) + n(r[PED]), n(r[ADULT_OCC]) + n(r[PED_OCC]), n(r[COVID])

    def totals(chosen, key):
        out = defaultdict(lambda: [0.0, 0.0, 0.0, set()])
        for r in chosen:
            acc = out[key(r)]
            for i, x in enumerate(beds_of(r)):
                acc[i] += x
            acc[3].add(r["hospital_pk"])
        return out

    def rates(total, occupied, covid):
        occupied = min(occupied, total)
        covid = min(covid, occupied)
        return (total, occupied, covid), (
            tenth(occupied, total) if total else 0.0, tenth(covid, occupied) if occupied else 0.0)

    chosen = ["NY", "CA", "PR"]
    today = [r for r in rows if r["day"] == D]
    expected = []
    for state, (a, o, c, pks) in totals([r for r in today if state_of[r["hospital_pk"]] in chosen],
                                        lambda r: state_of[r["hospital_pk"]]).items():
        amounts, shares = rates(a, o, c)
        expected.append((state, *amounts, len(pks), *shares))
    assert sorted(map(tuple, questions.get_metrics(t, D, chosen).collect())) == sorted(expected)

    expected = []
    for (day, state), (a, o, c, _) in totals([r for r in rows if state_of[r["hospital_pk"]] in chosen],
                                             lambda r: (r["day"], state_of[r["hospital_pk"]])).items():
        amounts, shares = rates(a, o, c)
        expected.append((datetime.combine(day, datetime.min.time()), state, *amounts, *shares))
    assert sorted(map(tuple, questions.get_trend_data(t, chosen).collect())) == sorted(expected)

    expected = sorted(
        (state, c, rates(a, o, c)[1][0])
        for state, (a, o, c, _) in totals([r for r in today if state_of[r["hospital_pk"]]],
                                          lambda r: state_of[r["hospital_pk"]]).items())
    assert list(map(tuple, questions.get_state_metrics_for_map(t, D).collect())) == expected

    expected = []
    years = defaultdict(list)
    for pk, _, _, _, _, stars, year in ratings:
        years[pk].append((year, stars))
    by_stars = defaultdict(lambda: [0.0, 0.0])
    latest = defaultdict(lambda: [0.0, 0.0])
    for r in today:
        a, o, _ = beds_of(r)
        for _, stars in years[r["hospital_pk"]]:
            by_stars[stars] = [by_stars[stars][0] + a, by_stars[stars][1] + o]
        past = [x for x in years[r["hospital_pk"]] if x[0] <= D.year]
        if past:
            stars = max(past, key=lambda x: x[0])[1]
            latest[stars] = [latest[stars][0] + a, latest[stars][1] + o]
    for question, sums in ((questions.get_quality_rating_analysis, by_stars),
                           (questions.occupancy_by_latest_rating, latest)):
        expected = [(s, a, min(o, a), tenth(min(o, a), a) if a else 0.0)
                    for s, (a, o) in sorted((k, v) for k, v in sums.items() if k not in (None, "Not Available"))]
        assert list(map(tuple, question(t, D).collect())) == expected

    cases = {pk: lax(r[COVID]) for r in today for pk in [r["hospital_pk"]]}
    before = {r["hospital_pk"]: lax(r[COVID]) for r in rows if r["day"] == D - timedelta(days=7)}
    changes = [(pk, c, before[pk]) for pk, c in cases.items() if pk in before]
    changes = [(pk, c, p) for pk, c, p in changes if math.isnan(c - p) or abs(c - p) >= 5]
    changes.sort(key=lambda x: (-math.inf if math.isnan(x[1] - x[2]) else -abs(x[1] - x[2]), x[0]))
    expected = [(f"Hospital {pk}", c, p) for pk, c, p in changes[:10]]
    got = questions.get_hospitals_with_significant_changes(t, D).collect()
    assert repr([(r.hospital_name, r.current_cases, r.previous_cases) for r in got]) == repr(expected)

    last = {pk: max((r["day"] for r in rows if r["hospital_pk"] == pk), default=None) for pk in state_of}
    quiet = [(pk, d) for pk, d in last.items() if d is None or d < D - timedelta(days=14)]
    quiet.sort(key=lambda x: (-x[1].toordinal() if x[1] else math.inf, x[0]))
    expected = [(f"Hospital {pk}", d, (D - d).days if d else None) for pk, d in quiet[:10]]
    got = questions.get_non_reporting_hospitals(t, D).collect()
    assert [(r.hospital_name, r.last_report_date, r.days_since_report) for r in got] == expected

    counts = {d: len({r["hospital_pk"] for r in rows if r["day"] == d})
              for d in sorted({r["day"] for r in rows if D - timedelta(days=35) <= r["day"] <= D})[-5:]}
    got = {r.week: r.hospital_count for r in questions.get_week_over_week_comparison(t, D).collect()}
    assert got == counts
