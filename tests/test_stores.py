"""Stored tables whose versions share files: chunks in buckets, and the action log."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from basketwise.operators import actions
from basketwise.sources.chunk_store import ChunkStore
from basketwise.sources.log_store import PLACE, ActionLog
from basketwise.sources.versions import Versions, VersionTaken


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def chunks(spark, rows):
    return spark.createDataFrame([(f"{s}::chunk_{i}", s, i, t) for s, i, t in rows], "id string, source string, chunk_index int, text string")


def content(df):
    return sorted((r.source, r.chunk_index, r.text) for r in df.collect())


def test_an_upsert_rewrites_its_buckets_only(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s", buckets=16)
    assert store.read() is None
    first = [(f"d{d}", i, f"t{d}.{i}") for d in range(40) for i in range(3)]
    assert store.upsert(chunks(spark, first)) == 1
    before, opened, old = files(store.path), store.read(), store.folders()
    batch = [("d7", 0, "new"), ("d7", 9, "more")]
    assert store.upsert(chunks(spark, batch)) == 2
    new = store.folders()
    touched = {b for b in new if new[b] != old.get(b)}
    assert 1 <= len(touched) <= 2
    written = files(store.path) - before
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in written} == touched
    want = {(s, i): t for s, i, t in first} | {(s, i): t for s, i, t in batch}  # d7's other chunks are left over
    assert content(store.read()) == sorted((s, i, t) for (s, i), t in want.items())
    assert content(opened) == sorted(first) and content(store.read(1)) == sorted(first)  # readers keep their version


def test_reopened_with_other_settings(spark, tmp_path):
    ChunkStore(spark, f"{tmp_path}/s", buckets=4).upsert(chunks(spark, [("a", i, "x") for i in range(20)]))
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", 7)
    store = ChunkStore(other, f"{tmp_path}/s", buckets=99)
    store.upsert(chunks(other, [("a", i, "x") for i in range(20)]))
    assert store.read().count() == 20 and set(store.folders()) <= {0, 1, 2, 3}


def test_reset_and_empty_batches(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s", buckets=4)
    store.upsert(chunks(spark, [("a", 0, "x"), ("b", 0, None)]))
    before = files(store.path)
    store.upsert(chunks(spark, [("z", 0, "x")]).limit(0))
    assert files(store.path) == before and store.read().count() == 2
    store.upsert(chunks(spark, [("c", 0, "y")]), reset=True)
    assert content(store.read()) == [("c", 0, "y")]
    with pytest.raises(ValueError):
        store.upsert(chunks(spark, [("c", 0, "y")]).drop("text"))


def test_a_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, f"{tmp_path}/s", buckets=4)
    store.upsert(chunks(spark, [("a", 0, "x")]))

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(store.versions, "commit", crash)
    with pytest.raises(OSError):
        store.upsert(chunks(spark, [("a", 0, "y"), ("b", 0, "z")]))
    monkeypatch.undo()
    assert content(ChunkStore(spark, store.path).read()) == [("a", 0, "x")]


def test_two_writers_leave_both_batches(spark, tmp_path):
    path = f"{tmp_path}/s"
    ChunkStore(spark, path, buckets=4).upsert(chunks(spark, [("a", 0, "x")]))
    batches = [chunks(spark, [(f"w{k}", i, "t") for i in range(5)]) for k in range(3)]
    threads = [threading.Thread(target=ChunkStore(spark, path).upsert, args=(b,)) for b in batches]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ChunkStore(spark, path).read().count() == 16 and Versions(spark, path).latest() == 4


def test_a_version_is_committed_once(spark, tmp_path):
    versions = Versions(spark, f"{tmp_path}/v")
    assert versions.latest() == 0
    versions.commit(1, {"n": "é"})
    with pytest.raises(VersionTaken):
        versions.commit(1, {"n": 2})
    assert versions.read(1) == {"n": "é"} and versions.latest() == 1


SCHEMA = "reference_id string, recommendation string, amount_inr int, result string, timestamp string, status_checked_at string, extra string"


def records(spark, *rows):
    return spark.createDataFrame([(r, f"do {r}", 499, result, at, None, extra) for r, result, at, extra in rows], SCHEMA).coalesce(1)


def shown(log):
    rows = log.orderBy(PLACE).collect()
    return [(r.reference_id, r.result, r.status_checked_at, dict(r.other_fields or {})) for r in rows]


@pytest.fixture
def log(spark, tmp_path):
    store = ActionLog(spark, f"{tmp_path}/log")
    store.append(records(spark, ("a", "made", "2024-01-01T00:00:00+00:00", "e1"), ("a", "made", "2024-01-02T00:00:00+00:00", None), ("b", "made", "2024-01-01T00:00:00+00:00", None)))
    return store


UPDATES = "reference_id string, result string, status_checked_at string, method string"


def test_update_read_compact_read(spark, log):
    log.update(spark.createDataFrame([("a", "paid", "t1", "card"), ("z", "paid", "t1", None)], UPDATES))
    log.append(records(spark, ("a", "made", "2024-01-03T00:00:00+00:00", None)))
    log.update(spark.createDataFrame([("a", None, "t2", "cash"), ("b", "lost", "t2", None)], UPDATES))
    want = [
        ("a", "made", None, {"extra": '"e1"'}), ("a", "paid", "t1", {"method": '"card"'}), ("b", "lost", "t2", {}),
        ("a", "made", "t2", {"method": '"cash"'}),
    ]
    assert shown(log.read()) == want
    changes = log.manifest()["changes"]
    assert len(changes) == 2 and log.compact() == 5
    assert log.manifest()["changes"] == [] and len(log.manifest()["records"]) == 1
    assert shown(log.read()) == want and shown(log.read(4)) == want  # an older version can still be read
    log.update(spark.createDataFrame([("b", "found", "t3", None)], UPDATES))
    assert shown(log.read())[2] == ("b", "found", "t3", {})


def test_an_update_writes_the_change_only(spark, log):
    before = files(log.path)
    log.update(spark.createDataFrame([("b", "paid", "t1", None)], UPDATES))
    written = files(log.path) - before
    assert sum(spark.read.parquet(f).count() for f in written) == 1


def test_equals_the_update_of_a_whole_log(spark, log):
    updates = spark.createDataFrame([("a", "paid", "t1", "card"), ("b", None, "t1", None)], UPDATES)
    whole = actions.apply_status_updates(log.read(), updates.drop("method"), PLACE)
    def rows(df):
        return sorted(repr((r.reference_id, r.timestamp, r.result, r.status_checked_at)) for r in df.collect())

    want = rows(whole)
    log.update(updates)
    assert rows(log.read()) == want


def test_a_crash_between_the_steps_of_a_compaction(spark, log, monkeypatch):
    log.update(spark.createDataFrame([("a", "paid", "t1", None)], UPDATES))
    want = shown(log.read())

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(log.versions, "commit", crash)
    with pytest.raises(OSError):
        log.compact()
    with pytest.raises(OSError):
        log.append(records(spark, ("c", "made", None, None)))
    monkeypatch.undo()
    assert shown(ActionLog(spark, log.path).read()) == want


def test_an_empty_log(spark, tmp_path):
    store = ActionLog(spark, f"{tmp_path}/none")
    assert store.read().count() == 0
    store.update(spark.createDataFrame([("a", "paid", "t1", None)], UPDATES))
    store.compact()
    assert store.read().count() == 0
    store.append(spark.createDataFrame([("a",)], "reference_id string"))
    row = store.read().first()
    assert row.reference_id == "a" and row.timestamp and row.other_fields is None and row[PLACE].version == 3


def test_ties_fall_to_the_later_place(spark, tmp_path):
    store = ActionLog(spark, f"{tmp_path}/log")
    at = "2024-01-01T00:00:00+00:00"
    store.append(records(spark, ("a", "1", at, None), ("a", "2", at, None)))
    store.append(records(spark, ("a", "3", at, None), ("a", "4", "unreadable", None)))
    store.update(spark.createDataFrame([("a", "paid", "t1", None)], UPDATES))
    assert [r[1] for r in shown(store.read())] == ["1", "2", "paid", "4"]
    assert store.read().agg(F.count_if(F.col("status_checked_at") == "t1")).first()[0] == 1
