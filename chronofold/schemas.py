"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType()}


def _table(columns: str) -> T.StructType:
    """A flat schema from ``name type, ...``; needs no running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


JOURNAL = _table(
    "seq bigint, run_id string, type string, node string, activation_id string, "
    "attempt_id string, payload string, at double, at_ns bigint"
)
JOURNAL_V1 = _table(
    "seq bigint, run_id string, type string, node string, payload string, at double"
)
RUNS = _table("run_id string, schema_version int, created_at_ns bigint")
TRACE_STORE = _table(
    "trace_id string, span_id string, parent_span_id string, name string, service_name string, "
    "operation_name string, effect_source string, ts_ms bigint, ingest_seq bigint"
)
ARTIFACT_REF = "struct<path: string, sha256: string, bytes: bigint>"

# Payload fields with one fixed JSON type parse straight to it: a value of another JSON
# type (true for an integer, 1 for a boolean) becomes null and fails the check. Text
# fields stay VARIANT because a JSON parser would render any value as text.
PAYLOAD = (
    "journal_schema_version bigint, workflow_version variant, start_node variant, "
    "activation_id variant, input variant, patch variant, recovery boolean, effect_id variant, "
    "`index` bigint, label variant, request_fingerprint variant, adapter_version variant, "
    "idempotency_key_fingerprint variant, retry_safe boolean, source_intent_seq bigint, "
    "source_effect_seq bigint, retry_of_intent_seq variant, started_at_ns bigint, "
    "ended_at_ns bigint, next_node variant, next_activation_id variant, error variant, reason variant"
)
# The parts of it that effects and that starts of runs and attempts have.
EFFECT_PAYLOAD = (
    "effect_id variant, `index` bigint, label variant, request_fingerprint variant, adapter_version variant, "
    "idempotency_key_fingerprint variant, retry_safe boolean, source_intent_seq bigint, source_effect_seq bigint, "
    "retry_of_intent_seq variant, started_at_ns bigint, ended_at_ns bigint"
)
START_PAYLOAD = "journal_schema_version bigint, workflow_version variant, recovery boolean"
