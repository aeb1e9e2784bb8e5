"""Record tables: outcomes, pruned writes, killed and concurrent writers, and the stream sink's batches."""

import re

import pytest
from pyspark.sql import functions as F

from evidlake.sources.store import RecordStore, StaleWrite
from evidlake.streaming import jobs

SCHEMA = "k long, kind string, digest string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def table(spark, folder, rows=(), buckets=8, schema=SCHEMA):
    t = RecordStore.create(spark, str(folder), frame(spark, [], schema).schema, frame(spark, [], schema).columns[0], buckets)
    if rows:
        t.put(frame(spark, rows, schema), "digest")
    return t


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_outcomes(spark, tmp_path):
    t = table(spark, tmp_path, [(1, "a", "x"), (2, "a", "x"), (3, "a", None)])
    again = t.put(frame(spark, [(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (4, "a", "z"), (5, "a", "p"), (5, "a", "q"), (None, "a", "x"), (3, "a", None), (6, "a", None), (6, "a", "x")]), "digest", identity=("kind",))
    want = [(1, "UNCHANGED", 1), (2, "REVISED", 2), (3, "UNCHANGED", 1), (4, "INSERTED", 1), (5, "CONFLICT", None), (5, "CONFLICT", None), (6, "CONFLICT", None), (6, "CONFLICT", None), (None, "NULL_KEY", None)]
    assert got(again, "k", "outcome", "revision") == sorted(want, key=str)
    assert got(t.put(frame(spark, [(1, "other", "y")]), "digest", identity=("kind",)), "outcome") == [("IDENTITY_COLLISION",)]
    assert got(t.put(frame(spark, [(1, "a", "y"), (7, "a", "y")]), "digest", immutable=True), "k", "outcome") == [(1, "CONFLICT"), (7, "INSERTED")]
    assert got(t.current(), "k", "digest", "revision") == [(1, "x", 1), (2, "y", 2), (3, None, 1), (4, "z", 1), (7, "y", 1)]
    assert got(t.history().where("k = 2"), "digest", "revision") == [("x", 1), ("y", 2)]
    told = got(t.log(), "k", "outcome", "write")
    t.compact_log()
    assert got(t.log(), "k", "outcome", "write") == told and len(t.manifest().log) == 1
    t.vacuum()
    assert got(t.log(), "k", "outcome", "write") == told and got(t.current(), "k") == [(1,), (2,), (3,), (4,), (7,)]
    assert got(t.lookup(frame(spark, [(2, "", ""), (9, "", "")]), "k"), "k") == [(2,)]


def test_endpoints(spark, tmp_path):
    nodes = table(spark, tmp_path / "n", [(i, "n", "d") for i in range(5)])
    edges = table(spark, tmp_path / "e", schema="edge_id string, source int, target int, digest string")
    out = edges.put(frame(spark, [("a", 1, 2, "d"), ("b", 1, 9, "d"), ("c", None, 2, "d")], "edge_id string, source int, target int, digest string"), "digest", identity=("source", "target"), endpoints={"source": nodes, "target": nodes})
    assert got(out, "edge_id", "outcome") == [("a", "INSERTED"), ("b", "MISSING_ENDPOINT"), ("c", "MISSING_ENDPOINT")]
    assert got(edges.current(), "edge_id") == [("a",)]


def test_a_write_reads_and_writes_only_its_buckets(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "a", "x") for i in range(4000)], buckets=64)
    before = t.manifest()
    few = frame(spark, [(i, "a", "y") for i in (5, 17, 900)])
    touched = t._touched(few, "k", before)
    read = t._judged(before, few, touched, "digest", False, (), {}).inputFiles()
    assert 1 <= len(touched) <= 3 and {int(re.search(r"bucket=(\d+)", f)[1]) for f in read} == set(touched)
    t.put(few, "digest")
    after = t.manifest()
    assert {int(b) for b in after.data if after.data[b] != before.data[b]} == set(touched)
    assert t.current().count() == 4000 and t.current().where("digest = 'y'").count() == 3
    t.put(few, "digest")
    assert t.manifest().data == after.data  # a replay writes no data


@pytest.mark.parametrize("at", ["data", "manifest"])
def test_a_killed_write_changes_nothing(spark, tmp_path, monkeypatch, at):
    t = table(spark, tmp_path, [(1, "a", "x"), (2, "a", "x")])
    old, version = got(t.current(), "k", "digest", "revision"), t.manifest().version

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if at == "data":
            real = RecordStore._touched
            calls = []
            m.setattr(RecordStore, "_touched", lambda *a: killed() if len(calls) else calls.append(1) or real(*a))
        else:
            m.setattr(RecordStore, "_publish", killed)
        with pytest.raises(RuntimeError, match="killed"):
            t.put(frame(spark, [(2, "a", "y"), (3, "a", "z")]), "digest")
    assert got(t.current(), "k", "digest", "revision") == old and t.manifest().version == version and t.log().count() == 2
    assert t.vacuum() >= 1 and got(t.current(), "k", "digest", "revision") == old
    t.put(frame(spark, [(2, "a", "y"), (3, "a", "z")]), "digest")
    assert got(t.current(), "k", "digest", "revision") == [(1, "x", 1), (2, "y", 2), (3, "z", 1)]


def test_two_writers(spark, tmp_path, monkeypatch):
    """The other writer publishes while this one works: this one starts again and both take effect."""
    t, other = table(spark, tmp_path, [(1, "a", "x")]), RecordStore(spark, str(tmp_path))
    real, calls = RecordStore._judged, []

    def judged(self, *args):
        if self is t and not calls:
            calls.append(1)
            other.put(frame(spark, [(1, "a", "theirs"), (2, "a", "theirs")]), "digest")
        return real(self, *args)

    monkeypatch.setattr(RecordStore, "_judged", judged)
    assert got(t.put(frame(spark, [(1, "a", "ours"), (3, "a", "ours")]), "digest"), "k", "outcome", "revision") == [(1, "REVISED", 3), (3, "INSERTED", 1)]
    assert got(t.current(), "k", "digest", "revision") == [(1, "ours", 3), (2, "theirs", 1), (3, "ours", 1)]
    with pytest.raises(StaleWrite):
        t._publish(t.manifest())


def test_latest(spark, tmp_path):
    t = table(spark, tmp_path)
    t.put_latest(frame(spark, [(1, "a", "3"), (1, "b", "5"), (2, "a", "1"), (None, "a", "9")]), "digest")
    t.put_latest(frame(spark, [(1, "c", "4"), (2, "c", "2")]), "digest")
    assert got(t.current(), "k", "kind", "digest") == [(1, "b", "5"), (2, "c", "2")]


def test_batches_of_a_stream(spark, tmp_path, monkeypatch):
    """A batch that fails between its data and its conflicts is written anew; one that was written changes nothing when it comes again."""
    schema = "evidence_id string, digest string"
    sink, root = jobs.evidence_sink(str(tmp_path / "t"), buckets=4), str(tmp_path / "t")
    sink(frame(spark, [("a", "1"), ("b", "1"), ("a", "1")], schema), 0)
    second = frame(spark, [("a", "2"), ("c", "1"), ("d", "1"), ("d", "2")], schema)
    real = RecordStore._publish

    def failing(self, manifest):
        if manifest.version:
            raise RuntimeError("lost driver")
        real(self, manifest)

    with monkeypatch.context() as m:
        m.setattr(RecordStore, "_publish", failing)
        with pytest.raises(RuntimeError, match="lost driver"):
            sink(second, 1)
    t = RecordStore(spark, root)
    assert got(t.current(), "evidence_id") == [("a",), ("b",)] and t.log().where("outcome = 'CONFLICT'").isEmpty()
    for _ in range(2):  # the replay, and a replay of what has been written
        sink(second, 1)
        assert got(t.current(), "evidence_id", "digest") == [("a", "1"), ("b", "1"), ("c", "1")]
        assert got(t.log().where("outcome = 'CONFLICT'"), "evidence_id", "digest") == [("a", "2"), ("d", "1"), ("d", "2")]
    sink(frame(spark, [("a", "9")], schema), 0)  # older than the last
    assert t.log().where("outcome = 'CONFLICT'").count() == 3 and t.manifest().batches == {"evidence": 1}
    assert t.log().select(F.countDistinct("write")).first()[0] == 2
