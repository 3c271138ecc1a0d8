"""Appends that are whole or not at all, and journals frozen at a record."""

import pytest

from chronofold.functions.storage import fresh_path
from chronofold.sources import commits
from chronofold.sources.commits import AppendConflict, CommittedJournal

REQUEST = "run_id string, type string, payload string, at_ns bigint, n int"


@pytest.fixture
def parts(spark):
    runs = spark.createDataFrame([("a", 2), ("b", 2), ("old", 1)], "run_id string, schema_version int")
    rows = [("a", "x", "{}", 1, i) for i in range(5)] + [("b", "x", "7", 1, 9), ("new", "x", "{}", 1, 10), ("old", "x", None, 1, 11)]
    return CommittedJournal(spark, fresh_path(spark, "log")), runs, spark.createDataFrame(rows, REQUEST)


def append(log, runs, rows, batch, expected):
    return log.append(rows, runs, batch_id=batch, expected=expected, order=["n"])


def test_appends_follow_each_other(spark, parts):
    log, runs, rows = parts
    assert log.journal() is None and log.end() == (0, 1)
    first = append(log, runs, rows, "one", 1)
    assert (first["number"], first["accepted"], first["refused"], first["next"]) == (1, 5, 3, 6)
    assert append(log, runs, rows, "one", 1) == first and append(log, runs, rows, "one", 6) == first
    append(log, runs, rows.limit(0), "nothing", 6)
    append(log, runs, rows, "two", 6)
    assert log.end() == (3, 11)
    assert sorted((r["seq"], r["n"]) for r in log.journal().collect()) == [(i + 1, i % 5) for i in range(10)]
    assert sorted(r["reason"] for r in log.quarantine(1).collect()) == ["payload_not_object", "unregistered_run", "unsupported_schema"]


def test_a_reader_at_a_record_sees_no_later_append(spark, parts):
    log, runs, rows = parts
    append(log, runs, rows, "one", 1)
    frozen = log.journal(upto=1)
    before = sorted(map(tuple, frozen.collect()))
    append(log, runs, rows, "two", 6)
    assert sorted(map(tuple, log.journal(upto=1).collect())) == before == sorted(map(tuple, frozen.collect()))
    assert log.journal().count() == 10


def test_a_writer_behind_the_end_is_refused(spark, parts):
    log, runs, rows = parts
    append(log, runs, rows, "one", 1)
    with pytest.raises(AppendConflict):
        append(log, runs, rows, "two", 1)
    assert log.end() == (1, 6) and log.journal().count() == 5


def test_two_writers_of_one_record(spark, parts, monkeypatch):
    """Both saw the same end; the second finds the record taken and leaves nothing to read."""
    log, runs, rows = parts
    slow = CommittedJournal(spark, log.root)
    monkeypatch.setattr(slow, "end", lambda: (0, 1))
    append(log, runs, rows, "one", 1)
    with pytest.raises(AppendConflict):
        append(slow, runs, rows, "two", 1)
    assert log.end() == (1, 6) and log.journal().count() == 5 and log.quarantine().count() == 3


def test_a_failure_between_journal_and_record_leaves_neither(spark, parts, monkeypatch):
    log, runs, rows = parts

    def fail(record):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(log, "_commit", fail)
        with pytest.raises(OSError):
            append(log, runs, rows, "one", 1)
    assert log.journal() is None and log.quarantine() is None and log.end() == (0, 1)
    monkeypatch.setattr(commits, "with_sequence", fail)
    with pytest.raises(TypeError):
        append(log, runs, rows, "one", 1)
    monkeypatch.undo()
    append(log, runs, rows, "one", 1)
    assert log.journal().count() == 5
