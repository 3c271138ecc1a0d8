"""Frames the registered queries start from, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.decode import decode
from chronofold.operators.fold import fold
from chronofold.operators.projection import project
from chronofold.plans import fixture
from chronofold.plans.fixture import graph_nodes, graph_routes, journal, runs  # noqa: F401


def order_key(run_id: str = "run_id") -> Column:
    """The order a fixture run was made from."""
    return F.substring(run_id, 5, 30).cast("bigint")


def spans(spark: SparkSession, d: str) -> DataFrame:
    return project(journal(spark, d))


def decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode(journal(spark, d))


def states(spark: SparkSession, d: str) -> DataFrame:
    return fold(journal(spark, d), graph_nodes(spark))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return fixture.facts(spark, d)


def attributes(*fields: str) -> Column:
    """Only these of a span's attributes; the others need not be written on the way."""
    return F.struct(*[F.col(f"attributes.{c}").alias(c) for c in fields]).alias("attributes")


def store_columns(sent: DataFrame, *more: str) -> DataFrame:
    """Of spans only what a trace store is made from and checked on."""
    plain = ("run_id", "mode", "trace_id", "span_id", "parent_span_id", "name", "start_time_ns", "family", "seq")
    return sent.select(*plain, *more, attributes("operation_name", "effect_source"))


def damaged_store(sent: DataFrame) -> DataFrame:
    """What a trace store might hold of these spans; ``o_orderkey % 10`` picks the damage."""
    k, root = order_key(), F.col("family") == 0
    service = F.concat(F.lit("chronofold-"), F.col("mode"))
    side = F.when(F.col("mode") == "aware", 0).otherwise(1)
    source = F.col("attributes.effect_source")
    copies = F.when((k % 10 == 3) & root, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = sent.where(~((k % 10 == 0) & root)).withColumn("copy", F.explode(copies))
    rows = kept.select(
        "trace_id",
        "span_id",
        F.when(F.col("parent_span_id").isNull() & (k % 2 == 0), "").otherwise(F.col("parent_span_id")).alias("parent_span_id"),
        F.when((k % 10 == 2) & root, F.concat("name", F.lit("-renamed"))).otherwise(F.col("name")).alias("name"),
        F.when((k % 10 == 4) & root, "other-service").otherwise(service).alias("service_name"),
        F.col("attributes.operation_name").alias("operation_name"),
        F.when((k % 10 == 5) & source.isNotNull(), "").otherwise(source).alias("effect_source"),
        F.expr("start_time_ns div 1000000").alias("ts_ms"),
        (F.col("seq") * 8 + side + 2 * F.col("copy")).alias("ingest_seq"),
    )
    foreign = sent.where((k % 10 == 1) & root).select(
        "trace_id",
        F.substring(F.sha2(F.concat(F.lit("foreign:"), "mode", F.lit(":"), "run_id"), 256), 1, 16).alias("span_id"),
        F.lit("").alias("parent_span_id"),
        F.lit("foreign").alias("name"),
        service.alias("service_name"),
        F.lit("run").alias("operation_name"),
        F.lit(None).cast("string").alias("effect_source"),
        F.expr("start_time_ns div 1000000").alias("ts_ms"),
        (F.col("seq") * 8 + 6 + side).alias("ingest_seq"),
    )
    return rows.unionByName(foreign)


def store(spark: SparkSession, d: str) -> DataFrame:
    return damaged_store(spans(spark, d))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Calls an effect store logged: one per intent, some repeated with another amount."""
    f = facts(spark, d).where("type = 'effect_intent'")
    again = F.when(F.col("c") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return f.withColumn("again", F.explode(again)).select(
        (F.col("seq") + F.col("again")).alias("seq"),
        F.col("effect_key").alias("idempotency_key"),
        (F.col("cents") + F.col("again")).alias("amount_cents"),
        "run_id",
    )


ATTEMPTS_SQL = """attempts as (select seq + again as seq, effect_key as idempotency_key, cents + again as amount_cents, run_id
  from facts join (values (0), (1)) r(again) on again = 0 or c % 50 = 0 where type = 'effect_intent')"""


def events_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def documents_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


# Paths that spread the given texts over every rule of the artifact selection.
PATHS_SQL = """case doc_id % 12
  when 0 then 'src/a/f' || doc_id || '.py' when 1 then 'scripts/f' || doc_id || '.py'
  when 2 then 'verify/f' || doc_id || '.py' when 3 then 'web/app/f' || doc_id || '.ts'
  when 4 then 'deploy/f' || doc_id || '.yaml' when 5 then 'vendor/f' || doc_id
  when 6 then 'f' || doc_id || '.md' when 7 then 'web/node_modules/f' || doc_id || '.js'
  when 8 then 'src/__pycache__/f' || doc_id || '.pyc' when 9 then 'web/f' || doc_id || '-debug.log'
  when 10 then 'other/f' || doc_id || '.txt' else 'web/data/generated/f' || doc_id || '.json' end"""

GROUP_SQL = """case doc_id % 12 when 0 then 'source' when 1 then 'source' when 2 then 'source' when 3 then 'web'
  when 4 then 'deployment' when 5 then 'vendor' when 6 then 'publication' end"""


def text_files(spark: SparkSession, d: str) -> DataFrame:
    return documents_table(spark, d).select(F.expr(PATHS_SQL).alias("path"), F.col("text").alias("content"), "doc_id")


def run_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per order with the values its run is made of."""
    rows = fixture.run_rows(spark, d)
    workflow = F.when(F.col("tkey") == 6, "loop/v1").when(F.col("tkey").isin(7, 8, 10), "gated/v1").otherwise("settle/v1")
    return rows.withColumn("workflow", workflow)


def receipt_chains(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three receipts, inputs and evidence per order; ``o_orderkey % 12`` picks one defect.

    1 schema, 2 declared lineage, 3 inputs hash, 4 verdict, 5 criterion missing, 6 not
    true, 7 unknown, 8 predecessor, 9 evidence, 10 phase order, 11 one receipt absent.
    All but 10 and 11 sit at position 1.
    """
    from chronofold.operators.artifacts import PHASE_CRITERIA, PHASES

    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("lineage_id"))
    kind, second = F.col("lineage_id") % 12, F.col("position") == 1
    rows = o.select("lineage_id", F.posexplode(F.array(*[F.lit(p) for p in PHASES])).alias("position", "good_phase"))
    l, p = F.col("lineage_id").cast("string"), F.col("position").cast("string")
    swapped = F.when(F.col("position") == 0, PHASES[1]).when(second, PHASES[0]).otherwise(PHASES[2])
    rows = rows.withColumn("phase", F.when(kind == 10, swapped).otherwise(F.col("good_phase")))

    def reference(position: Column, salt: str) -> Column:
        at = position.cast("string")
        return F.struct(
            F.concat(F.lit(f"{salt}/"), l, F.lit("/"), at, F.lit(".json")).alias("path"),
            F.sha2(F.concat_ws(":", F.lit(salt), l, at), 256).alias("sha256"),
            (position + 100).cast("bigint").alias("bytes"),
        )

    criteria = F.lit(None).cast("map<string,boolean>")
    for phase, names in PHASE_CRITERIA.items():
        good = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(True))])
        fewer = F.create_map(*[x for c in names[1:] for x in (F.lit(c), F.lit(True))])
        false = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(c != names[0]))])
        more = F.create_map(*[x for c in (*names, "extra") for x in (F.lit(c), F.lit(True))])
        damaged = F.when(second & (kind == 5), fewer).when(second & (kind == 6), false).when(second & (kind == 7), more)
        criteria = F.when(F.col("phase") == phase, damaged.otherwise(good)).otherwise(criteria)
    own = reference(F.col("position"), "receipts")
    before = F.when(F.col("position") > 0, reference(F.col("position") - 1, "receipts"))
    wrong = reference(F.col("position"), "wrong")
    bad = lambda n: second & (kind == n)
    good_inputs = F.sha2(F.concat_ws(":", F.lit("inputs"), l), 256)
    receipts = rows.select(
        "lineage_id",
        "position",
        "good_phase",
        F.when(bad(2), F.lit(-1)).otherwise(F.col("lineage_id")).alias("declared_lineage"),
        F.when(bad(1), 2).otherwise(1).alias("schema_version"),
        F.when(bad(3), F.lit("other")).otherwise(good_inputs).alias("inputs_sha256"),
        F.when(bad(4), "FAIL").otherwise("PASS").alias("verdict"),
        "phase",
        criteria.alias("criteria"),
        F.lit(True).alias("has_previous"),
        F.when(bad(8), wrong).otherwise(before).alias("previous"),
        reference(F.col("position"), "evidence").alias("evidence"),
        own["path"].alias("path"),
        own["sha256"].alias("sha256"),
        own["bytes"].alias("bytes"),
    )
    evidence = receipts.select(
        F.col("evidence.path").alias("path"),
        "lineage_id",
        F.col("phase"),
        F.lit(1).alias("schema_version"),
        F.when(second & (kind == 9), "FAIL").otherwise("PASS").alias("verdict"),
        "inputs_sha256",
        "criteria",
    )
    inputs = o.select("lineage_id", good_inputs.alias("sha256"))
    return receipts, inputs, evidence


def two_versions(spark: SparkSession, d: str) -> DataFrame:
    """Small documents of version 1 (even ids) and version 2 (odd ids)."""
    number = F.col("event_id").cast("string")
    old = F.concat(
        F.lit('{"schemaVersion":1,"runId":"run-'), number,
        F.lit('","groundTruth":{"stepAttempts":2,"journalEffects":1,"businessExecutions":1},'
              '"aware":{"mode":"aware","spans":[{"span_id":"a","duration_nano":7,"start_time_unix_nano":1785000000000000001,"end_time_unix_nano":"1785000000000000008"}]},'
              '"naive":{"mode":"naive","spans":[]},"comparison":{"awareExecutedEffectSpans":1,"awareReplayedEffectSpans":1,"naiveExecutedEffectSpans":2,"naiveReplayedEffectSpans":0},'
              '"queryBack":{"aware":{"verified":true},"naive":{"verified":true}}}'),
    )
    new = F.concat(
        F.lit('{"schemaVersion":2,"runId":"run-'), number,
        F.lit('","groundTruth":{"activationAttempts":2,"providerAttempts":1},"control":{"mode":"control"}}'),
    )
    return events_table(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, old).otherwise(new).alias("body"))
