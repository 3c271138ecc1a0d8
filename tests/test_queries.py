"""Every registered query against the same answer computed by DuckDB SQL."""

import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F

from chronofold.functions.storage import fresh_path
from chronofold.plans import inputs, streams
from chronofold.streaming import runs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())


def test_streams_take_many_batches_and_drop_state(spark, sf):
    """Runs come in two batches each, era after era; values and facts go when runs end."""
    runs.prepare(spark)
    stream, delay = streams.two_visits(spark, sf)
    out, check = fresh_path(spark, "many"), fresh_path(spark, "many-state")
    rows = runs.follow_runs(stream, watermark=delay).select("kind", "run_id", "seq")
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    with_rows = [p for p in query.recentProgress if p.numInputRows]
    assert len(with_rows) > 5
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert max(held) > 500 and held[-1] < 10
    assert all(held[2 * era + 1] < held[2 * era] / 2 for era in range(streams.ERAS))
    found = {r["kind"]: r["n"] for r in spark.read.parquet(out).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    journal = inputs.journal(spark, sf)
    assert found[runs.EVENT] == journal.count() + 1 and runs.LATE not in found
    assert found[runs.ENDED] >= journal.select("run_id").distinct().count()


def test_entry(spark):
    assert entry.entry(spark).count() == 3
