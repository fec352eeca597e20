"""The publish log: commits of several writers, row-level upserts, folding and compaction."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bedledger.operators import loads
from bedledger.operators.loads import load_hhs_data, load_quality_data, publish
from bedledger.schema import WEEKLY_COLUMNS, WEEKLY_METRICS
from bedledger.sources import manifest, tables
from bedledger.sources.manifest import read_state
from bedledger.sources.tables import compact, expire, read_table, write_table
from test_loads import COVID, hhs_row, stored, write_hhs, write_quality

WEEKLY = "weekly_hospital_stats"


def interleave(monkeypatch, inner):
    """Run `inner` once, between the first load's reading of the state and its commit."""
    real, ran = loads.commit, []

    def late(*args):
        if not ran:
            ran.append(True)
            inner()
        return real(*args)

    monkeypatch.setattr(loads, "commit", late)


def counted(monkeypatch):
    merged, names = loads.merged, []

    def noted(root, name, *args):
        names.append(name)
        return merged(root, name, *args)

    monkeypatch.setattr(loads, "merged", noted)
    return names


def test_loads_of_other_weeks_both_stay(spark, tmp_path, monkeypatch):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    load_hhs_data(spark, write_hhs(tmp_path / "0.csv", hhs_row("010001", "2021/12/24")), root, staging=stage)
    first = write_hhs(tmp_path / "1.csv", hhs_row("010001", "2021/12/31", "1"), hhs_row("010002", "2021/12/31", "2"))
    second = write_hhs(tmp_path / "2.csv", hhs_row("010003", "2022/01/07", "3", state="GA"))
    names = counted(monkeypatch)
    interleave(monkeypatch, lambda: load_hhs_data(spark, second, root, staging=stage))
    load_hhs_data(spark, first, root, staging=stage)
    # the reports of the load that lost were not written again
    assert names.count(WEEKLY) == 2 and names.count("hospital") == 3
    assert [r[0] for r in stored(spark, root, "hospital", "hospital_pk")] == ["010001", "010002", "010003"]
    assert len(stored(spark, root, WEEKLY, "hospital_pk")) == 4
    assert read_state(spark, root).seq == 3


def test_loads_of_one_week_give_a_serial_result(spark, tmp_path, monkeypatch):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    load_hhs_data(spark, write_hhs(tmp_path / "0.csv", hhs_row("010001", covid="0"), hhs_row("010009", covid="9")), root, staging=stage)
    first = write_hhs(tmp_path / "1.csv", hhs_row("010001", covid="1"), hhs_row("010002", covid="1"))
    second = write_hhs(tmp_path / "2.csv", hhs_row("010001", covid="2", state="GA"), hhs_row("010003", covid="2"))
    names = counted(monkeypatch)
    interleave(monkeypatch, lambda: load_hhs_data(spark, second, root, staging=stage))
    load_hhs_data(spark, first, root, staging=stage)
    assert names.count(WEEKLY) == 3
    # as if the second file had been loaded before the first
    assert stored(spark, root, WEEKLY, "hospital_pk", COVID) == [("010001", 1.0), ("010002", 1.0), ("010003", 2.0), ("010009", 9.0)]
    assert stored(spark, root, "hospital", "hospital_pk", "state")[0] == ("010001", "AL")


def test_a_load_and_a_quality_load_do_not_disturb_each_other(spark, tmp_path, monkeypatch):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    load_hhs_data(spark, write_hhs(tmp_path / "0.csv", hhs_row("010001")), root, staging=stage)
    ratings = write_quality(tmp_path / "q.csv", ("010001", "A", "Acute", "Gov", "Yes", "4"))
    names = counted(monkeypatch)
    interleave(monkeypatch, lambda: load_quality_data(spark, ratings, 2021, root, staging=stage))
    load_hhs_data(spark, write_hhs(tmp_path / "1.csv", hhs_row("010002")), root, staging=stage)
    assert sorted(names) == ["hospital", "hospital_quality", WEEKLY]
    assert len(stored(spark, root, "hospital_quality", "hospital_pk")) == 1


def test_of_two_writers_of_one_publish_one_is_counted(spark, tmp_path, monkeypatch):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    path = write_hhs(tmp_path / "1.csv", hhs_row("010001"))
    monkeypatch.setattr(loads, "remove_folder", lambda *a: None)
    done = load_hhs_data(spark, path, root, staging=stage)
    other = str(tmp_path / "other")
    interleave(monkeypatch, lambda: publish(spark, done.staging, other))
    publish(spark, done.staging, other)
    assert read_state(spark, other).seq == 1 and len(stored(spark, other, WEEKLY, "hospital_pk")) == 1


def reports(spark, n, week="2021-12-31", value=1.0):
    metrics = [F.lit(value).alias(c) for c in WEEKLY_METRICS]
    moment = F.lit(week).cast("timestamp_ntz").alias("collection_week")
    rows = spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("hospital_pk"), moment, *metrics)
    return tables.with_week(rows.select(*WEEKLY_COLUMNS))


def test_an_upsert_rewrites_only_files_with_its_keys(spark, tmp_path):
    root = str(tmp_path / "db")
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # hospitals in order, so that the files' key ranges differ
        write_table(reports(spark, 40_000).repartitionByRange(8, "hospital_pk"), root, WEEKLY)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    state = read_state(spark, root)
    files = state.of(WEEKLY)
    assert len(files) > 1 and sum(f.rows for f in files) == 40_000
    one = reports(spark, 1, value=7.0)
    change = tables.merged(root, WEEKLY, one, loads.KEYS[WEEKLY], state, "v1")
    assert len(change.removed) == 1
    assert sum(f.rows for f in change.added) == next(f.rows for f in files if f.path in change.removed)
    manifest.commit(spark, root, "p1", [change], state)
    rows = read_table(spark, root, WEEKLY)
    assert rows.count() == 40_000 and rows.filter(F.col(COVID) == 7).count() == 1
    # new keys take nothing out
    more = reports(spark, 3).withColumn("hospital_pk", F.concat(F.lit("x"), F.substring("hospital_pk", 2, 5)))
    state = read_state(spark, root)
    change = tables.merged(root, WEEKLY, more, loads.KEYS[WEEKLY], state, "v2")
    assert not change.removed and sum(f.rows for f in change.added) == 3


def test_small_files_are_put_together(spark, tmp_path, monkeypatch):
    root, stage = str(tmp_path / "db"), str(tmp_path / "s")
    for n in range(4):
        load_hhs_data(spark, write_hhs(tmp_path / f"{n}.csv", hhs_row(f"01000{n}", covid=str(n))), root, staging=stage)
    rows = stored(spark, root, WEEKLY, "hospital_pk", COVID)
    assert len(rows) == len(read_state(spark, root).of(WEEKLY)) == 4
    assert compact(spark, root, WEEKLY) == 0
    assert compact(spark, root, WEEKLY, many_files=3) == 4
    assert len(read_state(spark, root).of(WEEKLY)) == 1 and stored(spark, root, WEEKLY, "hospital_pk", COVID) == rows
    # a part that a load changes meanwhile is left alone
    for n in range(4, 7):
        load_hhs_data(spark, write_hhs(tmp_path / f"{n}.csv", hhs_row(f"01000{n}", covid=str(n))), root, staging=stage)
    real, ran = tables.commit, []

    def late(*args):
        if not ran:
            ran.append(True)
            load_hhs_data(spark, write_hhs(tmp_path / "8.csv", hhs_row("010008", covid="8")), root, staging=stage)
        return real(*args)

    monkeypatch.setattr(tables, "commit", late)
    assert compact(spark, root, WEEKLY, many_files=3) == 0
    assert len(stored(spark, root, WEEKLY, "hospital_pk")) == 8


def test_the_log_is_folded(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "db")
    monkeypatch.setattr(manifest, "FOLD", 3)
    for n in range(7):
        write_table(reports(spark, 5, value=float(n)), root, WEEKLY)
    names = sorted(p.name for p in Path(root, "publish_log").glob("*.parquet"))
    assert [n for n in names if "sum" in n] == ["000000000003.sum.parquet", "000000000006.sum.parquet"]
    state = read_state(spark, root)
    assert state.seq == 7 and len(state.publishes - {""}) == 7 and len(state.files) == len({f.path for f in state.of(WEEKLY)})
    assert stored(spark, root, WEEKLY, COVID) == [(6.0,)] * 5
    old = manifest.State(4)
    expire(spark, root)
    assert len(read_state(spark, root).publishes - {""}) == 7
    # a writer that slept through all of this cannot take a number that was folded away
    assert not manifest.commit(spark, root, "late", [], old)
    assert read_state(spark, root).seq == 7 and stored(spark, root, WEEKLY, COVID) == [(6.0,)] * 5


@pytest.mark.parametrize("name", ["name_once", "rename_once"])
def test_a_name_is_given_once(spark, tmp_path, name):
    for n in (1, 2):
        (tmp_path / f"new{n}").write_text(str(n))
    give = getattr(manifest, name)
    target = str(tmp_path / "entry")
    assert give(spark, f"file:{tmp_path}/new1", target)
    assert not give(spark, f"file:{tmp_path}/new2", target)
    assert Path(target).read_text() == "1"


def read_back(monkeypatch):
    """The files that merges read whole rows of."""
    real, files = tables.replace_rows, []

    def noted(existing, winners, key):
        files.extend(existing.inputFiles())
        return real(existing, winners, key)

    monkeypatch.setattr(tables, "replace_rows", noted)
    return files


def test_files_without_other_rows_are_not_read_back(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "db")
    write_table(reports(spark, 5).unionByName(reports(spark, 4, week="2022-01-07")), root, WEEKLY)
    state, files = read_state(spark, root), read_back(monkeypatch)
    # all of one week, a part of the other, and a week that is new
    rows = [reports(spark, 6, value=2.0), reports(spark, 2, "2022-01-07", 2.0), reports(spark, 1, "2022-01-14", 2.0)]
    change = tables.merged(root, WEEKLY, rows[0].unionByName(rows[1]).unionByName(rows[2]), loads.KEYS[WEEKLY], state, "v1")
    assert files and all("week=2022-01-07" in f for f in files)
    assert change.removed == frozenset(f.path for f in state.of(WEEKLY))
    manifest.commit(spark, root, "p1", [change], state)
    assert stored(spark, root, WEEKLY, COVID) == [(1.0,)] * 2 + [(2.0,)] * 9


def test_stored_rows_of_one_key_and_rows_without_key_are_counted(spark, tmp_path):
    root = str(tmp_path / "db")
    # two rows of one key, and one without: the file holds more than its keys
    pks = spark.createDataFrame([("000000",), ("000000",), (None,)], "pk string")
    write_table(reports(spark, 1).crossJoin(pks).withColumn("hospital_pk", F.col("pk")).drop("pk").coalesce(1), root, WEEKLY)
    state = read_state(spark, root)
    change = tables.merged(root, WEEKLY, reports(spark, 1, value=2.0), loads.KEYS[WEEKLY], state, "v1")
    manifest.commit(spark, root, "p1", [change], state)
    got = read_table(spark, root, WEEKLY).select("hospital_pk", COVID).collect()
    assert sorted(map(tuple, got), key=str) == [("000000", 2.0), (None, 1.0)]


def test_reports_that_come_twice_and_reports_that_come_once(spark, tmp_path, monkeypatch):
    shuffled = []
    real = loads.weekly_winners
    monkeypatch.setattr(loads, "weekly_winners", lambda *a: shuffled.append("all") or real(*a))
    rows = [hhs_row(f"01000{n}", covid=str(n)) for n in range(5)]
    for case, few in (("once", 9), ("few", 9), ("many", 0)):
        again = [] if case == "once" else [hhs_row("010001", covid="7"), hhs_row("010001", covid="8"), hhs_row("010003", covid="")]
        monkeypatch.setattr(loads, "FEW_KEYS", few)
        root = str(tmp_path / case)
        load_hhs_data(spark, write_hhs(tmp_path / f"{case}.csv", *rows, *again), root, staging=str(tmp_path / "s"))
        want = dict(zip(range(5), map(float, range(5)))) | ({1: 8.0, 3: 0.0} if again else {})
        assert stored(spark, root, WEEKLY, "hospital_pk", COVID) == [(f"01000{n}", v) for n, v in want.items()]
    assert shuffled == ["all"]
