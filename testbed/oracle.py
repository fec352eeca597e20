"""The registered queries once more, as DuckDB SQL over the raw test tables."""

from __future__ import annotations

from bedledger.schema import (
    HHS_COLUMNS,
    HOSPITAL_COLUMNS,
    HOSPITAL_WIDTHS,
    QUALITY_COLUMNS,
    QUALITY_RENAMES,
    QUALITY_WIDTHS,
    REGION_STATES,
    WEEKLY_METRICS,
)
from testbed.derive import STATE_CODES
from testbed.registry import AREAS, DAY, LAST_DAYS, NORTHEAST, STATE_BEDS_SQL, TREND_STATES

ADULT, PED, ADULT_OCC, PED_OCC, ICU, ICU_USED, COVID, ICU_COVID = WEEKLY_METRICS


def texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


D = f"DATE '{DAY}'"
NAN = "'NaN'::DOUBLE"
STAMP = "CAST(collection_week AS DATE)"
REGION_ROWS = ", ".join(
    f"('{region}', '{state}')" for region, states in REGION_STATES.items() for state in states
)
HOSPITAL_FIELDS = """
    'Street ' || CAST(number AS VARCHAR) AS address,
    'CITY_' || CAST(nation AS VARCHAR) AS city,
    nullif(substr('{codes}', 2 * nation + 1, 2), '..') AS state,
    lpad(CAST(number % 100000 AS VARCHAR), 5, '0') AS zip,
    lpad(CAST(nation + 1 AS VARCHAR), 2, '0') || lpad(CAST(number % 1000 AS VARCHAR), 3, '0')
        AS fips_code
""".format(codes=STATE_CODES)


def rating(number: str) -> str:
    return (
        f"CASE WHEN ({number}) % 13 = 0 THEN NULL WHEN ({number}) % 6 = 0 THEN 'Not Available' "
        f"ELSE CAST(({number}) % 6 AS VARCHAR) END"
    )


# Views by name; each may use the ones above it.
VIEWS = {
    "suppliers": """
        SELECT to_base(s_suppkey + 1, 36, 6) AS hospital_pk, s_suppkey AS number,
               s_nationkey AS nation, s_name AS name
        FROM supplier""",
    "facilities": """
        SELECT * FROM suppliers
        UNION ALL
        SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0'), CAST(n_nationkey AS BIGINT),
               n_nationkey, 'Office ' || n_name
        FROM nation""",
    "hospital": f"""
        SELECT hospital_pk, name AS hospital_name, {HOSPITAL_FIELDS} FROM facilities""",
    "reports": """
        SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
               count(*) AS items, sum(l_quantity) AS adult, sum(l_linenumber) AS pediatric,
               sum(floor(l_quantity * (l_linenumber % 5) / 3)) AS adult_occupied,
               sum(l_partkey % 6) AS pediatric_occupied,
               sum(l_linenumber % 3) AS icu, sum(l_linenumber % 2) AS icu_used,
               sum(floor(l_quantity * (l_orderkey % 4) / 6)) AS covid,
               sum(l_partkey % 2) AS icu_covid,
               l_suppkey * 7 + count(*) + CAST(sum(l_quantity) AS BIGINT) AS mix
        FROM lineitem GROUP BY 1, 2""",
    "weekly_hospital_stats": f"""
        SELECT to_base(l_suppkey + 1, 36, 6) AS hospital_pk,
               CAST(week AS TIMESTAMP) + CASE WHEN mix % 19 = 0 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END
                   AS collection_week,
               CASE WHEN mix % 31 = 0 THEN {NAN} ELSE CAST(adult AS DOUBLE) / 10 END AS {ADULT},
               CAST(pediatric AS DOUBLE) / 10 AS {PED},
               CAST(adult_occupied AS DOUBLE) / 10 AS {ADULT_OCC},
               CASE WHEN mix % 29 <> 0 THEN CAST(pediatric_occupied AS DOUBLE) / 10 END AS {PED_OCC},
               CAST(icu AS DOUBLE) / 10 AS {ICU},
               CAST(icu_used AS DOUBLE) / 10 AS {ICU_USED},
               CASE WHEN mix % 23 = 0 THEN -999999.0 WHEN mix % 397 = 0 THEN {NAN}
                    WHEN mix % 3 = 0 THEN CAST(covid AS DOUBLE) ELSE CAST(covid AS DOUBLE) / 10 END AS {COVID},
               CAST(icu_covid AS DOUBLE) / 10 AS {ICU_COVID},
               week
        FROM reports""",
    "hospital_quality": f"""
        SELECT hospital_pk, name AS facility_name,
               'Type ' || CAST(number % 3 AS VARCHAR) AS type_of_hospital,
               'Owner ' || CAST(number % 4 AS VARCHAR) AS type_of_ownership,
               number % 2 = 0 AS emergency_services,
               {rating("number + rating_year")} AS overall_quality_rating,
               rating_year
        FROM facilities, (VALUES (2000), (2001)) AS years(rating_year)""",
    "region_states": f"SELECT * FROM (VALUES {REGION_ROWS}) AS r(region, state)",
    "regions": "SELECT DISTINCT region FROM region_states",
    "hhs_feed": f"""
        SELECT CASE WHEN m % 37 = 0 THEN substr(hospital_pk, 2) ELSE hospital_pk END AS hospital_pk,
               hospital_name, address, city,
               CASE WHEN m % 43 = 0 THEN state || 'X' ELSE state END AS state,
               zip, fips_code,
               CASE WHEN m % 41 = 0 THEN 'junk'
                    WHEN m % 4 = 1 THEN strftime(week, '%Y/%m/%d')
                    WHEN m % 4 = 2 THEN strftime(week, '%Y-%m-%d') || ' 00:00:00'
                    WHEN m % 8 = 3 THEN strftime(week, '%m/%d/%Y') || ' 00:00'
                    ELSE strftime(week, '%Y-%m-%d') END AS collection_week,
               {", ".join(
                   f"CASE WHEN m % 47 = 0 THEN 'many' ELSE CAST({c} AS VARCHAR) END AS {c}"
                   if c == PED
                   else f"CAST(nullif({c}, {NAN}) AS VARCHAR) AS {c}"
                   for c in WEEKLY_METRICS)}
        FROM (SELECT *, date_diff('day', DATE '1970-01-01', week) + CAST(floor({PED}) AS BIGINT) AS m
              FROM weekly_hospital_stats JOIN hospital USING (hospital_pk))""",
    "quality_feed": f"""
        SELECT CASE WHEN number % 11 = 0 THEN substr(hospital_pk, 2) ELSE hospital_pk END
                   AS "Facility ID",
               name AS "Facility Name",
               'Type ' || CAST(number % 3 AS VARCHAR) AS "Hospital Type",
               'Owner ' || CAST(number % 4 AS VARCHAR) AS "Hospital Ownership",
               CASE number % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' yes' || chr(9) WHEN 2 THEN 'No' END
                   AS "Emergency Services",
               {rating("number + 2001")} AS "Hospital overall rating"
        FROM (SELECT hospital_pk, number, name FROM facilities
              UNION ALL
              SELECT 'C' || right(to_base(c_custkey, 36, 12), 5), c_custkey, c_name FROM customer)""",
    "clean_quality": """
        SELECT "Facility ID" AS hospital_pk, "Facility Name" AS facility_name,
               "Hospital Type" AS type_of_hospital, "Hospital Ownership" AS type_of_ownership,
               coalesce("Emergency Services" IN ('Yes', ' yes' || chr(9)), false)
                   AS emergency_services,
               "Hospital overall rating" AS overall_quality_rating, 2001 AS rating_year
        FROM quality_feed WHERE length("Facility ID") = 6""",
}


def with_views(sql: str) -> str:
    """Put the views in front of a statement that may start with a WITH list of its own."""
    views = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items())
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


# ---- Fragments ------------------------------------------------------------


def guard(c: str) -> str:
    return f"greatest(coalesce(nullif({c}, {NAN}), 0), 0)"


def lax_guard(c: str) -> str:
    return f"greatest(coalesce({c}, 0), 0)"


def decimal(c: str) -> str:
    return f"TRY_CAST({c} AS DECIMAL(28, 12))"


def exact_sum(*terms: str) -> str:
    """Decimal sum as a double; NaN or infinity where one occurs."""
    value = " + ".join(f"({t})" for t in terms)
    exact = " + ".join(decimal(t) for t in terms)
    return (
        f"coalesce(max({value}) FILTER (WHERE NOT isfinite({value})), "
        f"CAST(sum({exact}) FILTER (WHERE isfinite({value})) AS DOUBLE))"
    )


def exact_minus(a: str, b: str) -> str:
    return (
        f"(CASE WHEN isfinite({a}) AND isfinite({b}) THEN CAST({decimal(a)} - {decimal(b)} AS DOUBLE) "
        f"ELSE {a} - {b} END)"
    )


TOTAL = exact_sum(guard(ADULT), guard(PED))
OCCUPIED = exact_sum(guard(ADULT_OCC), guard(PED_OCC))
COVID_SUM = exact_sum(guard(COVID))
JOINED = "weekly_hospital_stats w JOIN hospital h ON w.hospital_pk = h.hospital_pk"


def rate(part: str, whole: str) -> str:
    exact = f"CAST({part} / nullif({whole}, 0) * 100 AS DECIMAL(18, 13))"
    return (
        f"CASE WHEN {whole} > 0 THEN least(CAST(round({exact}, 1) AS DOUBLE), 100.0) "
        "ELSE CAST(0 AS DOUBLE) END"
    )


def metrics(keys: str, condition: str, extra: str = "") -> str:
    """Clamped totals and both rates per key."""
    return f"""
        SELECT {keys}, total_beds, occupied_beds, covid_beds, {extra}
               {rate("occupied_beds", "total_beds")} AS occupancy_rate,
               {rate("covid_beds", "occupied_beds")} AS covid_percentage
        FROM (SELECT * REPLACE (least(covid_beds, occupied_beds) AS covid_beds) FROM (
              SELECT * REPLACE (least(occupied_beds, total_beds) AS occupied_beds) FROM (
              SELECT {keys}, {TOTAL} AS total_beds, {OCCUPIED} AS occupied_beds,
                     {COVID_SUM} AS covid_beds, count(DISTINCT w.hospital_pk) AS reporting_hospitals
              FROM {JOINED} WHERE {condition} GROUP BY {keys})))"""


def by_rating(ratings: str) -> str:
    return f"""
        SELECT overall_quality_rating, total_beds, occupied_beds,
               {rate("occupied_beds", "total_beds")} AS occupancy_rate
        FROM (SELECT overall_quality_rating, total_beds,
                     least(occupied_beds, total_beds) AS occupied_beds
              FROM (SELECT q.overall_quality_rating, {TOTAL} AS total_beds,
                           {OCCUPIED} AS occupied_beds
                    FROM {JOINED} JOIN {ratings} q ON q.hospital_pk = h.hospital_pk
                    WHERE {STAMP} = {D} AND q.overall_quality_rating <> 'Not Available'
                    GROUP BY 1))"""


def covid_by(keys: str) -> str:
    return f"""
        SELECT {keys}, {exact_sum(lax_guard(COVID))} AS covid_cases
        FROM (SELECT *, substr(fips_code, 1, 2) AS state_fips FROM {JOINED})
        WHERE {STAMP} = {D} AND state IS NOT NULL GROUP BY {keys}"""


def week_over_week(order: str) -> str:
    return f"""
        WITH counts AS (
            SELECT week, count(DISTINCT hospital_pk) AS hospital_count
            FROM weekly_hospital_stats
            WHERE collection_week <= {D} AND collection_week >= {D} - INTERVAL 5 WEEK
            GROUP BY week ORDER BY week DESC LIMIT 5),
        lagged AS (
            SELECT *, lag(hospital_count) OVER (ORDER BY week {order}) AS prev_week_count
            FROM counts)
        SELECT week, hospital_count, prev_week_count,
               CAST(hospital_count - prev_week_count AS DOUBLE) / nullif(prev_week_count, 0) * 100
                   AS percent_change
        FROM lagged"""


BED_AVAILABILITY = f"""
    SELECT week, total_adult_beds, occupied_adult_beds,
           {exact_minus("total_adult_beds", "occupied_adult_beds")} AS available_adult_beds,
           total_pediatric_beds, occupied_pediatric_beds,
           {exact_minus("total_pediatric_beds", "occupied_pediatric_beds")}
               AS available_pediatric_beds, covid_beds
    FROM (SELECT week, {exact_sum(guard(ADULT))} AS total_adult_beds,
                 {exact_sum(guard(ADULT_OCC))} AS occupied_adult_beds,
                 {exact_sum(guard(PED))} AS total_pediatric_beds,
                 {exact_sum(guard(PED_OCC))} AS occupied_pediatric_beds,
                 {COVID_SUM} AS covid_beds
          FROM weekly_hospital_stats
          WHERE week <= {D} AND week >= {D} - INTERVAL 4 WEEK
          GROUP BY week ORDER BY week DESC LIMIT 5)"""

CHANGE = exact_minus("current_cases", "previous_cases")
CHANGES = f"""
    SELECT hospital_name, city, state, current_cases, previous_cases,
           {CHANGE} AS absolute_change,
           CASE WHEN previous_cases > 0
                THEN {CHANGE} / previous_cases * 100 END AS percent_change
    FROM (SELECT hospital_pk, {lax_guard(COVID)} AS current_cases
          FROM weekly_hospital_stats WHERE week = {D})
    JOIN hospital USING (hospital_pk)
    LEFT JOIN (SELECT hospital_pk, {lax_guard(COVID)} AS previous_cases
               FROM weekly_hospital_stats WHERE week = {D} - INTERVAL 1 WEEK) USING (hospital_pk)
    WHERE abs({CHANGE}) >= 5
    ORDER BY abs({CHANGE}) DESC, hospital_pk LIMIT 10"""

NON_REPORTING = f"""
    SELECT hospital_name, city, state, last_report_date,
           CAST(date_diff('day', last_report_date, DATE '{LAST_DAYS}') AS INTEGER)
               AS days_since_report
    FROM (SELECT h.hospital_pk, hospital_name, city, state, max(w.week) AS last_report_date
          FROM hospital h LEFT JOIN weekly_hospital_stats w ON h.hospital_pk = w.hospital_pk
          GROUP BY ALL)
    WHERE last_report_date < DATE '{LAST_DAYS}' - INTERVAL 2 WEEK OR last_report_date IS NULL
    ORDER BY last_report_date DESC NULLS LAST, hospital_pk LIMIT 10"""

STATE_METRICS = metrics(
    "state", f"{STAMP} = {D} AND state IN ({texts(NORTHEAST)})", "reporting_hospitals,"
)
TREND = f"SELECT * REPLACE (CAST(week AS TIMESTAMP) AS week) FROM ({metrics('week, state', f'state IN ({texts(TREND_STATES)})')})"
AREA_STATES = f"""state IN (SELECT coalesce(r.state, a.area)
    FROM (SELECT unnest([{texts(AREAS)}]) AS area) a LEFT JOIN region_states r ON r.region = a.area)"""
KPI = f"""
    SELECT CAST(sum(reporting_hospitals) AS BIGINT) AS reporting_hospitals,
           sum(total_beds) AS total_beds,
           sum(occupied_beds) AS occupied_beds, sum(covid_beds) AS covid_beds,
           CASE WHEN sum(total_beds) > 0
                THEN least(sum(occupied_beds) / sum(total_beds) * 100, 100) ELSE 0 END
               AS occupancy_rate,
           CASE WHEN sum(occupied_beds) > 0
                THEN least(sum(covid_beds) / sum(occupied_beds) * 100, 100) ELSE 0 END
               AS covid_percentage
    FROM ({STATE_METRICS}) HAVING count(*) > 0"""

BED_ROWS = f"""
    SELECT hospital_pk, week, state,
           CASE WHEN hospital_pk LIKE '%5' THEN 'n/a' ELSE CAST({ADULT} AS VARCHAR) END
               AS total_adult_beds,
           {ADULT_OCC} AS occupied_adult_beds,
           CASE WHEN hospital_pk LIKE '%6' THEN -1.0 ELSE {PED} END AS total_pediatric_beds,
           {PED_OCC} AS occupied_pediatric_beds,
           CASE WHEN hospital_pk LIKE '%8' THEN 'Infinity'::DOUBLE ELSE {COVID} END AS covid_beds
    FROM weekly_hospital_stats JOIN hospital USING (hospital_pk)"""
BED_CLEAN = f"""
    SELECT hospital_pk, week, state, total_adult_beds, occupied_adult_beds, total_pediatric_beds,
           occupied_pediatric_beds,
           least(covid_beds, occupied_adult_beds + occupied_pediatric_beds) AS covid_beds,
           occupied_adult_beds + occupied_pediatric_beds AS total_occupied
    FROM (SELECT * REPLACE (least(occupied_adult_beds, total_adult_beds) AS occupied_adult_beds,
                            least(occupied_pediatric_beds, total_pediatric_beds)
                                AS occupied_pediatric_beds)
          FROM (SELECT * REPLACE (nullif(TRY_CAST(total_adult_beds AS DOUBLE), {NAN})
                                      AS total_adult_beds) FROM ({BED_ROWS}))
          WHERE total_adult_beds >= 0 AND occupied_adult_beds >= 0 AND total_pediatric_beds >= 0
            AND occupied_pediatric_beds >= 0 AND covid_beds >= 0
            -- a NaN is missing, like NULL
            AND NOT isnan(covid_beds))"""
OCCUPANCY = f"""
    SELECT *, CASE WHEN total_beds > 0 THEN occupied_beds / total_beds * 100 ELSE 0 END
                  AS occupancy_rate,
              CASE WHEN occupied_beds > 0 THEN covid_beds / occupied_beds * 100 ELSE 0 END
                  AS covid_percentage
    FROM (SELECT *, total_adult_beds + total_pediatric_beds AS total_beds,
                 total_occupied AS occupied_beds FROM ({BED_CLEAN}))"""


def per_region(source: str, columns: list[str], extra: str = "") -> str:
    sums = ", ".join(
        f"coalesce(CAST(sum({decimal(c)}) FILTER (WHERE isfinite({c})) AS DOUBLE), 0) AS {c}" for c in columns
    )
    return f"""
        SELECT *{extra} FROM (
            SELECT region, {sums}
            FROM regions LEFT JOIN (SELECT * FROM ({source}) JOIN region_states USING (state))
                USING (region)
            GROUP BY region)"""


REGIONAL_RATES = """,
    CASE WHEN total_beds > 0 THEN occupied_beds / total_beds * 100 ELSE 0 END AS occupancy_rate,
    CASE WHEN occupied_beds > 0 THEN covid_beds / occupied_beds * 100 ELSE 0 END
        AS covid_percentage"""
BED_SUMS = ["occupied_adult_beds", "total_pediatric_beds", "occupied_pediatric_beds", "covid_beds"]
ROLLUP_SUMS = ["total_adult_beds", *BED_SUMS, "total_occupied", "total_beds", "occupied_beds",
               "occupancy_rate", "covid_percentage"]


# ---- Loader fragments -----------------------------------------------------

WEEK_VALUE = """coalesce(try_strptime(collection_week, '%m/%d/%Y %H:%M'),
    TRY_CAST(replace(collection_week, '/', '-') AS TIMESTAMP))"""
CLEAN_HHS = f"""
    SELECT {", ".join(HOSPITAL_COLUMNS)}, {WEEK_VALUE} AS collection_week,
           {", ".join(
               f"nullif(CASE WHEN {c} IS NULL THEN 0 ELSE TRY_CAST({c} AS DOUBLE) END, -999999) AS {c}" for c in WEEKLY_METRICS)}
    FROM hhs_feed WHERE length(hospital_pk) = 6"""
REASONS = f"""
    SELECT *, length(hospital_pk) <> 6 AS bad_key,
           nullif(concat_ws('; ',
               CASE WHEN {WEEK_VALUE} IS NULL THEN 'collection_week is not a date' END,
               CASE WHEN length(state) > 2 THEN 'state is longer than 2' END,
               CASE WHEN length(fips_code) > 5 THEN 'fips_code is longer than 5' END,
               CASE WHEN {PED} = 'many' THEN '{PED} is not a number' END), '') AS reason
    FROM hhs_feed"""
HOSPITAL_BATCH = f"""
    SELECT hospital_pk,
           hospital_name || ' ' || substr(['ABA', 'AAB', 'ABC'][CAST(zip AS INTEGER) % 3 + 1], seq + 1, 1)
               AS hospital_name, address, city, state, zip, fips_code, seq
    FROM (SELECT hospital_pk, name AS hospital_name, {HOSPITAL_FIELDS} FROM suppliers),
         (VALUES (0), (1), (2)) AS v(seq)"""
FIRST_ROWS = f"""
    SELECT {", ".join(HOSPITAL_COLUMNS)}, min(seq) AS seq FROM ({HOSPITAL_BATCH}) GROUP BY ALL"""
WEEKLY_FIELDS = f"hospital_pk, week, {', '.join(WEEKLY_METRICS)}"
WEEKLY_BATCH = f"""
    SELECT {WEEKLY_FIELDS}, 0 AS seq FROM weekly_hospital_stats WHERE week >= {D} - INTERVAL 28 DAY
    UNION ALL
    SELECT * REPLACE ({COVID} + 1 AS {COVID}) FROM (
        SELECT {WEEKLY_FIELDS}, 1 AS seq FROM weekly_hospital_stats
        WHERE week >= {D} - INTERVAL 28 DAY AND {COVID} > 2)"""
QUALITY_FIELDS = ", ".join(QUALITY_COLUMNS)


def latest(source: str, fields: str, key: str) -> str:
    return f"""
        SELECT {fields} FROM ({source})
        QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) = 1"""


def upserted(existing: str, batch: str, fields: str, key: str) -> str:
    return f"""
        WITH winners AS ({latest(batch, fields, key)})
        SELECT {fields} FROM ({existing}) e
        WHERE NOT EXISTS (SELECT 1 FROM winners w
                          WHERE {" AND ".join(f"w.{k} = e.{k}" for k in key.split(", "))})
        UNION ALL
        SELECT {fields} FROM winners"""


QUALITY_KNOWN = "SELECT * FROM clean_quality WHERE hospital_pk IN (SELECT hospital_pk FROM hospital)"
QUALITY_BATCH = f"""
    SELECT * EXCLUDE (seq), min(seq) AS seq FROM (
        SELECT * REPLACE (CASE WHEN seq = 1 THEN facility_name || ' B' ELSE facility_name END
                              AS facility_name)
        FROM ({QUALITY_KNOWN}), (VALUES (0), (1), (2)) AS v(seq))
    GROUP BY ALL"""


def count_text(c: str) -> str:
    return f"format('{{:,.0f}}', CAST({c} AS DOUBLE))"


def percent_text(c: str) -> str:
    return f"format('{{:.1f}}', CAST({c} AS DOUBLE)) || '%'"


def signed(text: str, c: str) -> str:
    return f"CASE WHEN {c} >= 0 THEN '+' ELSE '' END || {text}"


ORACLE = {
    "src_hhs": f"SELECT {', '.join(HHS_COLUMNS)} FROM hhs_feed",
    "src_quality": "SELECT * FROM quality_feed",
    "clean_hhs": CLEAN_HHS,
    "clean_quality": "SELECT * FROM clean_quality",
    "valid_key": "SELECT hospital_pk, facility_name FROM clean_quality",
    "sentinel_null": f"""
        SELECT hospital_pk, week, nullif({COVID}, -999999) AS covid FROM weekly_hospital_stats""",
    "parse_week": f"""
        SELECT hospital_pk, address, collection_week AS week_text, {WEEK_VALUE} AS collection_week
        FROM hhs_feed""",
    "yes_no_bool": """
        SELECT "Facility Name" AS facility_name,
               coalesce(trim("Emergency Services", ' ' || chr(9)) ILIKE 'yes', false)
                   AS emergency_services
        FROM quality_feed""",
    "existing_keys": "SELECT DISTINCT hospital_pk FROM hospital",
    "quality_known": QUALITY_KNOWN,
    "reject_report": f"""
        SELECT hospital_pk, hospital_name, state, collection_week,
               CASE WHEN bad_key THEN 'hospital_pk does not have 6 characters' ELSE reason END
                   AS reject_reason
        FROM ({REASONS}) WHERE bad_key OR reason IS NOT NULL""",
    "load_summary": f"""
        SELECT count(*) AS rows_read, count(*) FILTER (WHERE bad_key) AS rows_dropped,
               count(*) FILTER (WHERE NOT bad_key AND reason IS NOT NULL) AS rows_rejected,
               (SELECT count(*) FROM (
                   SELECT DISTINCT {", ".join(HOSPITAL_COLUMNS)} FROM ({REASONS})
                   WHERE NOT bad_key AND reason IS NULL)) AS hospital_records,
               count(*) FILTER (WHERE NOT bad_key AND reason IS NULL) AS weekly_records
        FROM ({REASONS})""",
    "quality_load_summary": f"""
        SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT stored) AS rows_dropped,
               0::BIGINT AS rows_rejected,
               (SELECT count(*) FROM (SELECT DISTINCT * FROM ({QUALITY_KNOWN}))) AS quality_records
        FROM (SELECT length("Facility ID") = 6
                     AND "Facility ID" IN (SELECT hospital_pk FROM hospital) AS stored FROM quality_feed)""",
    "stored_hospital": f"""
        SELECT DISTINCT {", ".join(HOSPITAL_COLUMNS)} FROM ({REASONS}) WHERE NOT bad_key AND reason IS NULL""",
    "stored_weekly": f"""
        SELECT DISTINCT hospital_pk, CAST({WEEK_VALUE} AS DATE) AS week,
               {", ".join(f"nullif(coalesce(TRY_CAST({c} AS DOUBLE), 0), -999999) AS {c}" for c in WEEKLY_METRICS)}
        FROM ({REASONS}) WHERE NOT bad_key AND reason IS NULL""",
    "stored_quality": f"SELECT DISTINCT * FROM ({QUALITY_KNOWN})",
    "distinct_rows": FIRST_ROWS,
    "upsert_hospital": upserted(
        "SELECT * FROM hospital", FIRST_ROWS, ", ".join(HOSPITAL_COLUMNS), "hospital_pk"
    ),
    "upsert_weekly": upserted(
        f"SELECT * FROM weekly_hospital_stats WHERE week < {D}",
        WEEKLY_BATCH,
        WEEKLY_FIELDS,
        "hospital_pk, week",
    ),
    "upsert_quality": upserted(
        "SELECT * FROM hospital_quality",
        QUALITY_BATCH,
        QUALITY_FIELDS,
        "hospital_pk, rating_year",
    ),
    "dq_pk": f"""
        SELECT 'hospital' AS table_name, hospital_pk AS key, count(*) AS copies
        FROM (SELECT hospital_pk FROM hospital UNION ALL SELECT hospital_pk FROM ({HOSPITAL_BATCH}))
        GROUP BY hospital_pk HAVING count(*) > 1
        UNION ALL
        SELECT 'weekly_hospital_stats', hospital_pk || ' ' || strftime(stamp, '%Y-%m-%d %H:%M:%S'), count(*)
        FROM (SELECT hospital_pk, week, any_value(collection_week) AS stamp FROM weekly_hospital_stats GROUP BY 1, 2)
        JOIN (SELECT hospital_pk, week FROM weekly_hospital_stats WHERE week < {D} - INTERVAL 6 DAY
              UNION ALL SELECT hospital_pk, week FROM ({WEEKLY_BATCH})) USING (hospital_pk, week)
        GROUP BY hospital_pk, stamp HAVING count(*) > 1
        UNION ALL
        SELECT 'hospital_quality', hospital_pk || ' ' || CAST(rating_year AS VARCHAR), count(*)
        FROM (SELECT hospital_pk, rating_year FROM hospital_quality
              UNION ALL SELECT hospital_pk, rating_year FROM clean_quality)
        GROUP BY hospital_pk, rating_year HAVING count(*) > 1""",
    "dq_fk": """
        SELECT table_name, hospital_pk, count(*) AS rows
        FROM (SELECT 'weekly_hospital_stats' AS table_name, hospital_pk FROM weekly_hospital_stats
              UNION ALL SELECT 'hospital_quality', hospital_pk FROM clean_quality) c
        WHERE NOT EXISTS (SELECT 1 FROM hospital h
                          WHERE h.hospital_pk = c.hospital_pk AND h.hospital_pk NOT LIKE '%7')
        GROUP BY ALL""",
    "dq_width": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, "
        f'count(*) FILTER (WHERE length(rtrim("{source}")) > {n}) AS overflow_rows FROM {feed}'
        for table, feed, widths, sources in (
            ("hospital", "hhs_feed", HOSPITAL_WIDTHS, {}),
            ("hospital_quality", "quality_feed", QUALITY_WIDTHS, {v: k for k, v in QUALITY_RENAMES.items()}),
        )
        for c, n in widths.items()
        for source in [sources.get(c, c)]
    ),
    "nonneg_guard": f"""
        SELECT hospital_pk, week, {guard(ADULT)} AS adult, {guard(COVID)} AS covid,
               isnan({lax_guard(ADULT)}) AS lax_adult_is_nan, {lax_guard(COVID)} AS lax_covid
        FROM weekly_hospital_stats""",
    "state_region": """
        SELECT hospital_pk, state, coalesce(region, 'Other') AS region
        FROM hospital LEFT JOIN region_states USING (state)""",
    "expand_selection": """
        WITH picked AS (
            SELECT CASE WHEN CAST(fips_code AS INTEGER) % 2 = 0 THEN coalesce(region, 'Other')
                        ELSE h.state END AS selection
            FROM hospital h LEFT JOIN region_states r ON h.state = r.state
            WHERE h.state IS NOT NULL)
        SELECT DISTINCT coalesce(r.state, p.selection) AS state
        FROM picked p LEFT JOIN region_states r ON r.region = p.selection""",
    "available_dates": f"SELECT DISTINCT {STAMP} AS week FROM weekly_hospital_stats",
    "available_areas": """
        SELECT DISTINCT 'State' AS kind, state AS name, 0 AS position FROM hospital WHERE state IS NOT NULL
        UNION ALL SELECT 'Region', region,
                         CASE region WHEN 'Northeast' THEN 0 WHEN 'Midwest' THEN 1 WHEN 'South' THEN 2 ELSE 3 END
        FROM regions""",
    "state_metrics": STATE_METRICS,
    "state_map": f"""
        SELECT state, covid_cases, {rate("least(occupied, total)", "total")} AS occupancy_rate
        FROM (SELECT state, {TOTAL} AS total, {OCCUPIED} AS occupied, {COVID_SUM} AS covid_cases
              FROM {JOINED} WHERE {STAMP} = {D} AND state IS NOT NULL GROUP BY state)""",
    "week_over_week": week_over_week("DESC"),
    "week_over_week_prev": week_over_week("ASC"),
    "bed_availability": BED_AVAILABILITY,
    "quality_rating": by_rating("hospital_quality"),
    "quality_rating_latest": by_rating(
        f"""(SELECT * FROM hospital_quality WHERE rating_year <= year({D})
             QUALIFY row_number() OVER (PARTITION BY hospital_pk ORDER BY rating_year DESC) = 1)"""
    ),
    "covid_rank": f"""
        SELECT *, CAST(rank() OVER (ORDER BY covid_cases DESC) AS INTEGER) AS rank
        FROM ({covid_by("state_fips, state")})""",
    "significant_changes": CHANGES,
    "non_reporting": NON_REPORTING,
    "trend": TREND,
    "top_states": f"""
        SELECT state, {count_text("round(covid_cases)")} AS covid_cases
        FROM (SELECT * FROM ({covid_by("state")}) WHERE covid_cases > 0
              ORDER BY covid_cases DESC, state LIMIT 5)""",
    "sql_query": STATE_BEDS_SQL.replace(":selected_date", D).replace(
        "array_contains(:states, h.state)", f"h.state IN ({texts(NORTHEAST)})"
    ),
    "bed_clean": BED_CLEAN,
    "occupancy_stats": OCCUPANCY,
    "region_stats": per_region(BED_ROWS, BED_SUMS),
    "region_rollup": per_region(OCCUPANCY, ROLLUP_SUMS),
    "region_pipeline": per_region(OCCUPANCY, ROLLUP_SUMS),
    "region_stats_weighted": per_region(
        OCCUPANCY, ["total_beds", "occupied_beds", "covid_beds"], REGIONAL_RATES
    ),
    "kpi_totals": KPI,
    "kpi_tiles": f"""
        SELECT {count_text("reporting_hospitals")} AS total_reporting_hospitals,
               {percent_text("occupancy_rate")} AS overall_bed_occupancy,
               {percent_text("covid_percentage")} AS covid_share_of_occupied_beds
        FROM ({KPI})""",
    "chart_comparison": f"""
        SELECT state, variable, value FROM ({STATE_METRICS})
        UNPIVOT (value FOR variable IN (occupancy_rate, covid_percentage))""",
    "chart_bed_trend": f"""
        SELECT week, 'Total Occupied Beds' AS series,
               CAST({decimal("occupied_adult_beds")} + {decimal("occupied_pediatric_beds")} AS DOUBLE) AS beds FROM ({BED_AVAILABILITY})
        UNION ALL SELECT week, 'COVID Beds', covid_beds FROM ({BED_AVAILABILITY})""",
    "chart_weekly_reporting": f"""
        SELECT week, count(DISTINCT hospital_pk) AS hospital_count FROM weekly_hospital_stats
        WHERE collection_week BETWEEN {D} - INTERVAL 5 WEEK AND {D}
        GROUP BY week ORDER BY week DESC LIMIT 5""",
    "chart_quality": f"""
        SELECT overall_quality_rating, occupancy_rate FROM ({by_rating("hospital_quality")})""",
    "chart_trend": f"SELECT week, state, occupancy_rate FROM ({TREND})",
    "tile_reporting": f"""
        SELECT {count_text("count(DISTINCT hospital_pk)")} AS hospital_count,
               'N/A' AS percent_change
        FROM weekly_hospital_stats WHERE week = {D} AND collection_week <= {D}""",
    "display_beds": f"""
        SELECT week, {", ".join(f"{count_text(c)} AS {c}" for c in (
            "total_adult_beds", "occupied_adult_beds", "available_adult_beds",
            "total_pediatric_beds", "occupied_pediatric_beds", "available_pediatric_beds",
            "covid_beds"))}
        FROM ({BED_AVAILABILITY})""",
    "display_quality": f"""
        SELECT overall_quality_rating AS "Quality Rating", total_beds AS "Total Beds",
               occupied_beds AS "Occupied Beds", {percent_text("occupancy_rate")} AS "Occupancy Rate"
        FROM ({by_rating("hospital_quality")})""",
    "display_changes": f"""
        SELECT hospital_name, city, state, {count_text("current_cases")} AS current_cases,
               {count_text("previous_cases")} AS previous_cases,
               {signed(count_text("absolute_change"), "absolute_change")} AS absolute_change,
               -- a NaN percentage is shown as a missing one
               coalesce({signed(percent_text(f"nullif(percent_change, {NAN})"), f"nullif(percent_change, {NAN})")}, 'N/A')
                   AS percent_change
        FROM ({CHANGES})""",
    "display_non_reporting": f"""
        SELECT hospital_name, city, state, last_report_date,
               coalesce(CAST(days_since_report AS VARCHAR) || ' days', 'Never reported')
                   AS days_since_report
        FROM ({NON_REPORTING})""",
    "selection_metrics": metrics("state", f"{STAMP} = {D} AND {AREA_STATES}", "reporting_hospitals,"),
    "selection_trend": f"""
        SELECT * REPLACE (CAST(week AS TIMESTAMP) AS week)
        FROM ({metrics("week, state", AREA_STATES)})""",
}

ORACLE_SQL = {name: with_views(sql) for name, sql in ORACLE.items()}
