"""What keeps a query's cost in proportion to its rows: one parse, one hash, few state calls."""

import gzip
import hashlib

from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions.storage import write_json
from chronofold.operators import artifacts, redaction
from chronofold.plans import inputs as I
from chronofold.plans import streams
from chronofold.streaming import journal as S


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_payload_is_parsed_once(spark):
    rows = [
        (N.RUN_STARTED, '{"workflow_version":"w","input":{"a":1},"other":2,"start_node":null}'),
        (N.RUN_STARTED, "{"),
        (N.RUN_STARTED, "7"),
        (N.RUN_STARTED, None),
        (N.EFFECT_COMPLETED, '{"result":null,"index":0,"error":"x","effect_id":"e"}'),
        ("unknown", '{"input":1}'),
        (None, '{"input":1}'),
    ]
    df = spark.createDataFrame(rows, "type string, payload string")
    shown = df.select(redaction.public_payload().alias("p"))
    assert [r.p for r in shown.collect()] == [
        '{"input":{"redacted":true},"start_node":null,"workflow_version":"w"}', None, "{}", "{}",
        '{"effect_id":"e","index":0,"result":{"redacted":true}}', "{}", "{}",
    ]
    fields = redaction.unmasked_fields(df.withColumn("n", F.monotonically_increasing_id()))
    assert sorted((r.payload, r.field) for r in fields.collect()) == sorted([
        ('{"input":1}', "input"), ('{"input":1}', "input"), ('{"result":null,"index":0,"error":"x","effect_id":"e"}', "error"),
        ('{"result":null,"index":0,"error":"x","effect_id":"e"}', "result"), (rows[0][1], "input"), ("{", redaction.UNREADABLE),
    ])
    for plan in (optimized(shown), optimized(fields)):
        assert plan.count("parseJson(payload") == 1


def test_a_digest_is_computed_once(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    got = df.select(X.nonzero_digest(F.col("t"), 8).alias("h"))
    assert [r.h for r in got.collect()] == [hashlib.sha256(b"a").hexdigest()[:16], None]
    assert optimized(got).count("sha2(") == 1


def test_receipt_chains_are_joined_without_broadcast(spark, sf):
    audited = artifacts.audit_receipts(*I.receipt_chains(spark, sf))
    assert executed(audited).count("BroadcastHashJoin") == 1  # the constant table of criteria


def test_files_of_lines_are_compressed(spark, tmp_path):
    rows = spark.range(5_000).select(F.lit('{"mode":"aware"}').alias("value"), "id")
    write_json(rows, f"{tmp_path}/json")
    lines = rows.select("value")
    lines.coalesce(1).write.option("compression", "gzip").text(f"{tmp_path}/text")
    assert {p.suffix for p in (tmp_path / "json").glob("part-*")} == {".gz"}
    (file,) = (tmp_path / "text").glob("part-*")
    content = gzip.decompress(file.read_bytes())
    (plain := tmp_path / "text" / "plain.txt").write_bytes(content)
    found = {r.path.rsplit("/", 1)[-1]: (r.sha256, r.bytes) for r in artifacts.written_references(spark, f"{tmp_path}/text").collect()}
    told = (hashlib.sha256(content).hexdigest(), len(content))
    assert found == {file.name: told, plain.name: told}


def test_captured_lines_are_compressed(spark, sf, tmp_path):
    stream = streams.as_stream(spark, I.spans(spark, sf))
    S.capture_lines(stream, f"{tmp_path}/out", f"{tmp_path}/check", every=None).awaitTermination()
    assert {p.suffix for p in (tmp_path / "out").glob("part-*")} == {".gz"}


def test_an_arrival_is_one_batch_of_as_many_files_as_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "fresh_path", lambda s, label: f"{tmp_path}/{label}")
    stream = streams.as_stream(spark, spark.range(20_000), F.col("id") % 3)
    cores = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "stream-in").glob("part-*"))) == 3 * cores
    batches = {}
    sink = lambda batch, n: batches.update({n: batch.agg(F.min(F.col("id") % 3), F.max(F.col("id") % 3), F.count("*")).first()})
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert {n: tuple(b) for n, b in batches.items()} == {0: (0, 0, 6667), 1: (1, 1, 6667), 2: (2, 2, 6666)}


def test_a_batch_of_starts_is_judged_from_one_read(spark, tmp_path, monkeypatch):
    cuts = []
    monkeypatch.setattr(S, "cut", lambda df: cuts.append(1) or df.localCheckpoint())
    rows = spark.createDataFrame([("r", "{}", "a", "w")], "run_id string, input string, start_node string, workflow_version string")
    rows.withColumn("time", F.timestamp_micros(F.lit(1))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    journal = spark.createDataFrame([], "run_id string, seq bigint, type string, payload string")
    got = []
    S.coalesce_starts(stream, lambda: journal, lambda judged, n: got.extend(judged.collect()), checkpoint=f"{tmp_path}/check").awaitTermination()
    assert [(r.run_id, r.verdict) for r in got] == [("r", "new")] and len(cuts) >= 1
