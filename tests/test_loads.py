import threading
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bedledger.operators import loads
from bedledger.operators.loads import (
    LoadRejected,
    load_hhs_data,
    load_quality_data,
    publish,
)
from bedledger.schema import HHS_COLUMNS, HOSPITAL_COLUMNS, QUALITY_RENAMES, WEEKLY_METRICS
from bedledger.session import scratch_folder
from bedledger.sources.feeds import read_hhs_csv, read_quality_csv
from bedledger.sources import manifest, tables
from bedledger.sources.tables import MissingTables, expire, read_table, read_tables, write_table
from bedledger.streaming.feed_folder import load_new_hhs_files

COVID = WEEKLY_METRICS[6]
HEADER = ["extra", *reversed(HHS_COLUMNS)]


def line(columns, values):
    def field(v):
        v = "" if v is None else str(v)
        return '"' + v.replace('"', '""') + '"' if any(ch in v for ch in ',"\n') else v

    return ",".join(field(values.get(c)) for c in columns)


def hhs_row(pk, week="2021/12/31", covid="1", **other):
    base = dict(hospital_name="St. Mary, \"North\"", address="1 Main", city="C", state="AL", zip="01234",
                fips_code="01069", extra="9")
    return {"hospital_pk": pk, "collection_week": week, **base,
            **dict.fromkeys(WEEKLY_METRICS, "2.5"), COVID: covid, **other}


def write_csv(path, columns, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(columns), *(line(columns, r) for r in rows)]) + "\n")
    return str(path)


def write_hhs(path, *rows):
    return write_csv(path, HEADER, rows)


def write_quality(path, *rows):
    names = list(QUALITY_RENAMES)
    return write_csv(path, names, [dict(zip(names, r)) for r in rows])


def stored(spark, root, name, *columns):
    return sorted(map(tuple, read_table(spark, root, name).select(*columns).collect()))


def test_reader_goes_by_header_and_keeps_text(spark, tmp_path):
    path = write_hhs(tmp_path / "a.csv", hhs_row("010001", covid="NA", zip="00501"))
    (row,) = read_hhs_csv(spark, path).collect()
    assert (row.hospital_pk, row.zip, row[COVID]) == ("010001", "00501", None)
    assert row.hospital_name == 'St. Mary, "North"'


def test_line_breaks_in_quoted_fields(spark, tmp_path):
    path = write_hhs(tmp_path / "a.csv", hhs_row("010001", address="1 Main\nSuite 2"), hhs_row("010002"))
    root = str(tmp_path / "db")
    load_hhs_data(spark, path, root, staging=str(tmp_path / "s"), multi_line=True)
    assert stored(spark, root, "hospital", "hospital_pk", "address") == [
        ("010001", "1 Main\nSuite 2"), ("010002", "1 Main")]
    with pytest.raises(LoadRejected, match="fields of the header"):
        load_hhs_data(spark, path, root, staging=str(tmp_path / "s"))


def test_broken_lines_fail_or_are_set_aside(spark, tmp_path):
    path = Path(write_hhs(tmp_path / "a.csv", hhs_row("010001"), hhs_row("010002"), hhs_row("010003")))
    lines = path.read_text().splitlines()
    path.write_text("\n".join([*lines[:2], lines[2] + ",more", lines[3].rsplit(",", 1)[0]]) + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_hhs_csv(spark, str(path)).collect()
    result = load_hhs_data(spark, str(path), str(tmp_path / "db"), "set_aside", str(tmp_path / "s"))
    assert (result.summary["rows_rejected"], result.summary["rows_dropped"]) == (2, 0)
    assert stored(spark, str(tmp_path / "db"), "hospital", "hospital_pk") == [("010001",)]
    with pytest.raises(ValueError):
        read_hhs_csv(spark, str(path), broken_lines="skip")
    quality = Path(write_quality(tmp_path / "q.csv", ("010001", "A", "Acute", "Gov", "Yes", "4")))
    quality.write_text(quality.read_text() + "010001,B\n")
    with pytest.raises(LoadRejected, match="fields of the header"):
        load_quality_data(spark, str(quality), 2021, str(tmp_path / "db"), staging=str(tmp_path / "s"))


def test_reader_numbers_rows_in_file_order(spark, tmp_path):
    rows = [hhs_row(f"{n:06}") for n in range(3000)]
    path = write_hhs(tmp_path / "a.csv", *rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    try:
        frame = read_hhs_csv(spark, path)
        assert frame.rdd.getNumPartitions() > 5
        keys = [r.hospital_pk for r in frame.orderBy("arrival").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert keys == [r["hospital_pk"] for r in rows]


def test_reader_checks_headers_of_every_file(spark, tmp_path):
    names = list(QUALITY_RENAMES)
    write_csv(tmp_path / "q" / "a.csv", names, [])
    write_csv(tmp_path / "q" / "b.csv", names[::-1], [dict.fromkeys(names, "x")])
    with pytest.raises(Exception, match="header"):
        read_quality_csv(spark, str(tmp_path / "q")).collect()


def test_first_and_second_load(spark, tmp_path):
    root = str(tmp_path / "db")
    first = write_hhs(
        tmp_path / "1.csv",
        hhs_row("010001", covid="1"),
        hhs_row("010001", covid="2", state="GA"),
        hhs_row("010002", covid="-999999"),
        hhs_row("10002"),
        hhs_row("010002", "2022-01-07"),
    )
    result = load_hhs_data(spark, first, root, staging=str(tmp_path / "s"))
    assert result.summary == {"rows_read": 5, "rows_dropped": 1, "rows_rejected": 0,
                              "hospital_records": 3, "weekly_records": 4}
    assert stored(spark, root, "hospital", "hospital_pk", "state") == [("010001", "GA"), ("010002", "AL")]
    old, new = date(2021, 12, 31), date(2022, 1, 7)
    assert sorted(map(repr, stored(spark, root, "weekly_hospital_stats", "hospital_pk", "week", COVID))) == sorted(
        map(repr, [("010001", old, 2.0), ("010002", old, None), ("010002", new, 1.0)]))

    untouched = sorted(Path(root, "weekly_hospital_stats").glob("version=*/week=2021-12-31/*.parquet"))
    second = write_hhs(tmp_path / "2.csv", hhs_row("010002", "2022/01/07", "7"), hhs_row("010003", "2022/01/07"))
    load_hhs_data(spark, second, root, staging=str(tmp_path / "s"))
    assert [h for h, in stored(spark, root, "hospital", "hospital_pk")] == ["010001", "010002", "010003"]
    assert len(stored(spark, root, "weekly_hospital_stats", "hospital_pk")) == 4
    assert ("010002", new, 7.0) in [
        tuple(r) for r in read_table(spark, root, "weekly_hospital_stats")
        .select("hospital_pk", "week", COVID).filter(f"{COVID} IS NOT NULL").collect()]
    assert sorted(Path(root, "weekly_hospital_stats").glob("version=*/week=2021-12-31/*.parquet")) == untouched


def test_a_bad_row_stops_the_load(spark, tmp_path):
    root = str(tmp_path / "db")
    good = write_hhs(tmp_path / "1.csv", hhs_row("010001"))
    load_hhs_data(spark, good, root, staging=str(tmp_path / "s"))
    before = {n: sorted(map(repr, f.collect())) for n, f in vars(read_tables(spark, root)).items()}
    bad = write_hhs(tmp_path / "2.csv", hhs_row("010002"), hhs_row("010003", "junk"))
    with pytest.raises(LoadRejected, match="010003: collection_week is not a date"):
        load_hhs_data(spark, bad, root, staging=str(tmp_path / "s"))
    after = {n: sorted(map(repr, f.collect())) for n, f in vars(read_tables(spark, root)).items()}
    assert after == before

    result = load_hhs_data(spark, bad, root, on_reject="set_aside", staging=str(tmp_path / "s"))
    assert result.summary["rows_rejected"] == 1
    assert [h for h, in stored(spark, root, "hospital", "hospital_pk")] == ["010001", "010002"]
    (reject,) = spark.read.parquet(f"{result.staging}/rejects").collect()
    assert (reject.hospital_pk, reject.collection_week) == ("010003", "junk")
    with pytest.raises(ValueError):
        load_hhs_data(spark, bad, root, on_reject="ignore")


def test_an_old_stage_cannot_undo_a_later_load(spark, tmp_path):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    old = load_hhs_data(spark, write_hhs(tmp_path / "1.csv", hhs_row("010001", covid="1")), root, staging=stage)
    load_hhs_data(spark, write_hhs(tmp_path / "2.csv", hhs_row("010001", covid="2")), root, staging=stage)
    publish(spark, old.staging, root)
    assert stored(spark, root, "weekly_hospital_stats", COVID) == [(2.0,)]


def test_a_feed_without_rows(spark, tmp_path):
    root = str(tmp_path / "db")
    result = load_hhs_data(spark, write_hhs(tmp_path / "1.csv"), root, staging=str(tmp_path / "s"))
    assert set(result.summary.values()) == {0}
    assert [f.count() for f in vars(read_tables(spark, root)).values()] == [0, 0, 0]


def test_a_cut_publish_changes_nothing(spark, tmp_path, monkeypatch):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    load_hhs_data(spark, write_hhs(tmp_path / "1.csv", hhs_row("010001")), root, staging=stage)
    real = tables.write_version

    def cut(df, to, name, version):
        if name == "weekly_hospital_stats":
            raise OSError("lost")
        return real(df, to, name, version)

    monkeypatch.setattr(tables, "write_version", cut)
    second = write_hhs(tmp_path / "2.csv", hhs_row("010002"))
    with pytest.raises(OSError):
        load_hhs_data(spark, second, root, staging=stage)
    monkeypatch.undo()
    for name in ("hospital", "weekly_hospital_stats"):
        assert stored(spark, root, name, "hospital_pk") == [("010001",)]
    (left,) = [p for p in Path(stage).iterdir() if (p / "new").exists()]
    publish(spark, str(left), root)
    for name in ("hospital", "weekly_hospital_stats"):
        assert stored(spark, root, name, "hospital_pk") == [("010001",), ("010002",)]
    load_hhs_data(spark, second, root, staging=stage)
    assert len(stored(spark, root, "hospital", "hospital_pk")) == 2


def test_readers_see_the_old_or_the_new_rows_only(spark, tmp_path):
    root = str(tmp_path / "db")
    sizes = {1000, 40000}
    write_table(hospitals(spark, 1000), root, "hospital")
    seen, failed = set(), []

    def poll():
        while not done.is_set():
            try:
                seen.add(read_table(spark, root, "hospital").count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    done = threading.Event()
    reader = threading.Thread(target=poll)
    reader.start()
    for n in (40000, 1000, 40000):
        write_table(hospitals(spark, n), root, "hospital")
    done.set()
    reader.join()
    assert not failed and seen <= sizes


def hospitals(spark, n):
    text = [F.lit("x").alias(c) for c in HOSPITAL_COLUMNS[1:]]
    return spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("hospital_pk"), *text)


def test_stages_are_cleaned_and_old_versions_expire(spark, tmp_path):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    for n in (1, 2, 3):
        path = write_hhs(tmp_path / f"{n}.csv", hhs_row("010001", covid=str(n)))
        result = load_hhs_data(spark, path, root, staging=stage)
        assert not Path(result.staging, "new").exists() and not Path(result.staging, "feed").exists()
    assert expire(spark, root) == 4
    assert stored(spark, root, "weekly_hospital_stats", COVID) == [(3.0,)]
    assert len(list(Path(root, "publish_log").glob("*.parquet"))) == 1
    load_hhs_data(spark, write_hhs(tmp_path / "4.csv", hhs_row("010002")), root, staging=stage)
    assert len(stored(spark, root, "hospital", "hospital_pk")) == 2


def test_quality_load(spark, tmp_path):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    load_hhs_data(spark, write_hhs(tmp_path / "1.csv", hhs_row("010001"), hhs_row("010002")), root, staging=stage)
    path = write_quality(
        tmp_path / "q.csv",
        ("010001", "A", "Acute", "Gov", "Yes", "4"),
        ("010001", "A", "Acute", "Gov", "Yes", "3"),
        ("010001", "A", "Acute", "Gov", "Yes", "4"),
        ("010002", "B", "Acute", "Gov", "", "Not Available"),
        ("990001", "C", "X" * 40, "Gov", "No", "1"),
        ("1", "D", "Acute", "Gov", "No", "1"),
    )
    result = load_quality_data(spark, path, 2021, root, staging=stage)
    assert result.summary == {"rows_read": 6, "rows_dropped": 2, "rows_rejected": 0, "quality_records": 3}
    columns = ("hospital_pk", "rating_year", "overall_quality_rating", "emergency_services")
    of_2021 = [("010001", 2021, "3", True), ("010002", 2021, "Not Available", False)]
    assert stored(spark, root, "hospital_quality", *columns) == of_2021

    older = write_quality(tmp_path / "o.csv", ("010001", "A", "Acute", "Gov", "No", "1"))
    load_quality_data(spark, older, 2020, root, staging=stage)
    assert stored(spark, root, "hospital_quality", *columns) == [("010001", 2020, "1", False), *of_2021]
    wide = write_quality(tmp_path / "w.csv", ("010001", "A", "X" * 37, "Gov", "No", "1"))
    with pytest.raises(LoadRejected, match="type_of_hospital is longer than 36"):
        load_quality_data(spark, wide, 2022, root, staging=stage)
    with pytest.raises(ValueError):
        load_quality_data(spark, older, "2021-07-01", root)


def test_a_mistyped_root_is_an_error(spark, tmp_path):
    with pytest.raises(MissingTables):
        read_tables(spark, str(tmp_path / "nothing"))


def test_folder_loads_each_file_once(spark, tmp_path):
    root, inbox, done = str(tmp_path / "db"), tmp_path / "in", str(tmp_path / "done")
    write_hhs(inbox / "1.csv", hhs_row("010001", covid="1"))
    load_new_hhs_files(spark, str(inbox), root, done).awaitTermination(120)
    assert stored(spark, root, "weekly_hospital_stats", "hospital_pk", COVID) == [("010001", 1.0)]
    write_hhs(inbox / "2.csv", hhs_row("010001", covid="5"), hhs_row("010002"))
    load_new_hhs_files(spark, str(inbox), root, done).awaitTermination(120)
    assert stored(spark, root, "weekly_hospital_stats", "hospital_pk", COVID) == [("010001", 5.0), ("010002", 1.0)]
    query = load_new_hhs_files(spark, str(inbox), root, done)
    query.awaitTermination(120)
    assert query.lastProgress is None or query.lastProgress["numInputRows"] == 0


def test_scratch_folder_is_the_one_the_cluster_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_folder(spark) == named
    else:
        assert spark.sparkContext.applicationId in scratch_folder(spark)
