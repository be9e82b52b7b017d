"""Versioned days: whatever a writer dies of, readers see the old day or the new one."""

import datetime as dt
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from headwise.operators.silver import ingest, stored_silver_days
from headwise.schemas import SILVER_PARTITIONS
from headwise.sources import lake, versions

COLUMNS = "event_id string, event_dt date, tipo_mensagem string, id_empresa int"
FIRST, SECOND, THIRD = (dt.date(2024, 1, d) for d in (1, 2, 3))
ODD = ["AVL_EVT", "A:B", "x y/z", "A=B", "100%", "%41", None, "não", "a\\b", "{c}*?[d]", "tab\there", "__HIVE_DEFAULT_PARTITION_"]


def rows(spark, *data):
    return spark.createDataFrame(list(data), COLUMNS)


def live(spark, path, **bounds):
    return sorted((r.event_id, r.event_dt, r.tipo_mensagem, r.id_empresa) for r in versions.read_days(spark, path, **bounds).collect())


def odd_rows():
    return [(f"e{i}", [FIRST, SECOND, None][i % 3], kind, None if i % 4 == 1 else i) for i, kind in enumerate(ODD)]


def test_any_partition_value_survives(spark, tmp_path):
    path = str(tmp_path / "t")
    commit = versions.write_days(rows(spark, *odd_rows()), path, SILVER_PARTITIONS)
    assert (commit.version, commit.rows, len(commit.days)) == (1, len(ODD), 3)
    key = lambda r: r[0]
    assert sorted(live(spark, path), key=key) == sorted(odd_rows(), key=key)
    assert versions.stored_days(spark, path) == [FIRST, SECOND, None]
    corrected = [(r[0] + "'", *r[1:]) for r in odd_rows() if r[1] is None]
    versions.write_days(rows(spark, *corrected), path, SILVER_PARTITIONS)
    want = [r for r in odd_rows() if r[1] is not None] + corrected
    assert sorted(versions.read_days(spark, path).collect(), key=str) == sorted(rows(spark, *want).collect(), key=str)


def test_plain_folders_keep_what_they_were_given(spark, tmp_path):
    data = odd_rows()
    lake.write_silver(rows(spark, *data), str(tmp_path), "stop_events")
    schema = spark.createDataFrame([], COLUMNS).schema
    back = lake.read_partitioned(spark, f"{tmp_path}/stop_events", schema)
    assert sorted(map(str, back.select("event_id").collect())) == sorted(f"Row(event_id='{r[0]}')" for r in data)
    moved = [(r[0], r[1], "new/type: 1", 7) for r in data if r[1] == SECOND]
    lake.write_silver(rows(spark, *moved), str(tmp_path), "stop_events")
    back = lake.read_partitioned(spark, f"{tmp_path}/stop_events", schema)
    want = [r for r in data if r[1] != SECOND] + moved
    assert sorted(map(str, back.collect())) == sorted(map(str, rows(spark, *want).collect()))


def test_days_are_swapped_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write_days(rows(spark, ("a", FIRST, "T", 1), ("b", SECOND, "T", 1), ("c", SECOND, None, 2), ("d", THIRD, "T", 1)), path, SILVER_PARTITIONS)
    versions.write_days(rows(spark, ("b", SECOND, "U", 9)), path, SILVER_PARTITIONS, days=[THIRD])  # the third day has lost its rows
    assert live(spark, path) == [("a", FIRST, "T", 1), ("b", SECOND, "U", 9)]
    assert versions.stored_days(spark, path) == [FIRST, SECOND]
    versions.write_days(rows(spark, ("e", SECOND, "T", 1)), path, SILVER_PARTITIONS, mode="append")
    assert [r[0] for r in live(spark, path)] == ["a", "b", "e"]
    assert [r[0] for r in live(spark, path, first=SECOND)] == ["b", "e"]
    assert live(spark, path, last=dt.date(2023, 1, 1)) == []
    assert [r.event_id for r in versions.read_days(spark, path, version=1).orderBy("event_id").collect()] == ["a", "b", "c", "d"]
    nothing = spark.createDataFrame([], COLUMNS)
    commit = versions.write_days(nothing, path, SILVER_PARTITIONS, days=["2024-01-01", SECOND])
    assert commit.rows == 0 and versions.read_days(spark, path).count() == 0 and versions.read_days(spark, path).columns == nothing.columns
    assert versions.stored_days(spark, path) == []


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["during the data", "before the listing", "before the manifest", "before the rename", "after the rename"])
def test_a_killed_writer_leaves_a_whole_day(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    before = [("a", FIRST, "T", 1), ("b", SECOND, "T", 1), ("c", SECOND, "U", 1)]
    after = [("a", FIRST, "T", 1), ("x", SECOND, "V", 1)]
    versions.write_days(rows(spark, *before), path, SILVER_PARTITIONS)
    reader = versions.read_days(spark, path)  # open during the swap
    new = rows(spark, ("x", SECOND, "V", 1))
    if step == "during the data":
        new = new.union(rows(spark, ("y", SECOND, "W", 2)).withColumn("event_id", F.raise_error(F.lit("killed"))))
    elif step == "before the listing":
        own = versions.Files.listed
        monkeypatch.setattr(versions.Files, "listed", lambda self, folder: own(self, folder) if "write=" not in folder else dies())
    elif step == "before the manifest":
        monkeypatch.setattr(versions.Files, "write", lambda *_: dies())
    elif step == "before the rename":
        monkeypatch.setattr(versions.Files, "rename_new", lambda *_: dies())
    else:
        renamed = versions.Files.rename_new
        monkeypatch.setattr(versions.Files, "rename_new", lambda *a: renamed(*a) and dies())

    def dies():
        raise Killed

    with pytest.raises(Exception):
        versions.write_days(new, path, SILVER_PARTITIONS)
    monkeypatch.undo()
    assert live(spark, path) == (after if step == "after the rename" else before)
    assert sorted(r.event_id for r in reader.collect()) == ["a", "b", "c"]
    versions.write_days(rows(spark, ("x", SECOND, "V", 1)), path, SILVER_PARTITIONS)  # the next writer is not hindered
    assert live(spark, path) == after
    versions.vacuum(spark, path, keep=1, grace_hours=0)
    assert live(spark, path) == after
    left = {name for name in os.listdir(path) if name.startswith("write=")}
    assert left == {f"write={w}" for day in versions.manifest(spark, path)["days"].values() for w in day}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []
    frames = [rows(spark, (f"e{k}", dt.date(2024, 2, k + 1), "T", k)) for k in range(6)]

    def write(frame):
        try:
            versions.write_days(frame, path, SILVER_PARTITIONS)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(f,)) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert [r[0] for r in live(spark, path)] == [f"e{k}" for k in range(6)]
    assert versions.manifest(spark, path)["version"] == 6


def test_vacuum_spares_what_may_be_in_use(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        versions.write_days(rows(spark, (f"e{k}", FIRST, "T", 1)), path, SILVER_PARTITIONS)
    assert versions.vacuum(spark, path, keep=2) == 0  # all folders are younger than the grace period
    reader = versions.read_days(spark, path)
    versions.write_days(rows(spark, ("e4", FIRST, "T", 1)), path, SILVER_PARTITIONS)
    assert versions.vacuum(spark, path, keep=2, grace_hours=0) == 3
    assert [r.event_id for r in reader.collect()] == ["e3"] and [r[0] for r in live(spark, path)] == ["e4"]
    with pytest.raises(ValueError):
        versions.read_days(spark, path, version=1)


def test_other_columns_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write_days(rows(spark, ("a", FIRST, "T", 1)), path, SILVER_PARTITIONS)
    with pytest.raises(ValueError):
        versions.write_days(rows(spark, ("a", FIRST, "T", 1)).withColumn("more", F.lit(1)), path, SILVER_PARTITIONS)
    with pytest.raises(ValueError):
        versions.write_days(rows(spark, ("a", FIRST, "T", 1)), path, SILVER_PARTITIONS, mode="ignore")
    with pytest.raises(ValueError):
        versions.read_days(spark, str(tmp_path / "nothing"))
    assert [r[0] for r in live(spark, path)] == ["a"]


def test_days_without_reading_files(spark, tmp_path):
    path = f"{tmp_path}/stop_events"
    versions.write_days(rows(spark, ("a", SECOND, "T", 1), ("b", FIRST, "T", 1), ("c", None, "T", 1)), path, SILVER_PARTITIONS)
    days = stored_silver_days(spark, str(tmp_path), "stop_events")
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and [r.event_dt for r in days.collect()] == [FIRST, SECOND]
    with open(f"{path}/_manifest/v{1:012d}.json") as held:
        assert sorted(json.load(held)["days"]) == ["event_dt=2024-01-01", "event_dt=2024-01-02", "event_dt=__HIVE_DEFAULT_PARTITION__"]
    inputs = versions.read_days(spark, path, SECOND, SECOND).inputFiles()
    assert inputs and all("event_dt=2024-01-02" in f for f in inputs)


def test_ingest_replaces_days(spark, tmp_path):
    from headwise.schemas import SILVER_COLUMNS, STOP_CALL

    names = sorted({c for columns in SILVER_COLUMNS.values() for c in columns})
    kinds = {"event_dt": "date", "gps_idx": "int", "id_empresa": "int"}
    base = spark.createDataFrame([("a", FIRST), ("b", SECOND)], "event_id string, event_dt date").withColumns(
        {"tipo_mensagem": F.lit(STOP_CALL), "gps_idx": F.lit(0), "id_empresa": F.lit(1)})
    points = base.select(*[F.col(c) if c in base.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in names])
    done = ingest(points, str(tmp_path))
    assert {n: c.rows for n, c in done.items()} == {"gps_events": 2, "stop_events": 2, "fare_events": 0, "operational_events": 0}
    ingest(points.where("event_id = 'a'"), str(tmp_path), days=[FIRST, SECOND])
    loaded = lake.load_silver(spark, str(tmp_path))
    assert {n: [r.event_id for r in t.collect()] for n, t in loaded.items()} == {
        "gps_events": ["a"], "stop_events": ["a"], "fare_events": [], "operational_events": []}
    assert loaded["fare_events"].columns == SILVER_COLUMNS["fare_events"]
