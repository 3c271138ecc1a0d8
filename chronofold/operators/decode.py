"""Journal rows with their payload turned into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.schemas import EFFECT_PAYLOAD, PAYLOAD, START_PAYLOAD


def event_time() -> Column:
    """``at_ns`` when positive, else the float seconds cut to nanoseconds."""
    return F.when(F.col("at_ns") > 0, F.col("at_ns")).otherwise(
        (F.col("at") * F.lit(1_000_000_000.0)).cast("bigint")
    )


def text_of(variant: str) -> Column:
    """The value when it is non-empty JSON text, else null."""
    value = F.when(
        F.schema_of_variant(variant) == "STRING", F.variant_get(variant, "$", "string")
    )
    return F.nullif(value, F.lit(""))


def is_present(variant: str) -> Column:
    return F.col(variant).isNotNull() & ~F.is_variant_null(variant)


def is_object(variant: str) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def shown(variant: str) -> Column:
    """Any JSON value as plain text: text as it is, ``None``, ``True`` and ``False`` for
    null and booleans, and the JSON form of everything else."""
    kind = F.schema_of_variant(variant)
    return (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.when(F.variant_get(variant, "$", "boolean"), "True").otherwise("False"))
        .otherwise(F.variant_get(variant, "$", "string"))
    )


def decode(events: DataFrame) -> DataFrame:
    """Typed facts of each event; ``result`` and other bulky fields are left behind."""
    parsed = events.withColumn("p", F.from_json("payload", PAYLOAD))
    fingerprint = "p.idempotency_key_fingerprint"
    retry = "p.retry_of_intent_seq"
    retry_of = F.when(
        F.schema_of_variant(retry) == "BIGINT", F.variant_get(retry, "$", "bigint")
    )
    reason = F.when(F.col("type") == N.ATTEMPT_FAILED, F.col("p.error")).when(F.col("type") == N.RUN_FAILED, F.col("p.reason"))
    flat = parsed.select(
        "run_id",
        "seq",
        "type",
        "node",
        "activation_id",
        "attempt_id",
        event_time().alias("time_ns"),
        F.col("p.journal_schema_version").alias("journal_version"),
        text_of("p.workflow_version").alias("workflow_version"),
        text_of("p.start_node").alias("start_node"),
        text_of("p.activation_id").alias("start_activation"),
        is_object("p.input").alias("input_ok"),
        is_object("p.patch").alias("patch_ok"),
        F.col("p.recovery").alias("recovery"),
        text_of("p.effect_id").alias("effect_id"),
        F.col("p.index").alias("index"),
        text_of("p.label").alias("label"),
        text_of("p.request_fingerprint").alias("request_fingerprint"),
        text_of("p.adapter_version").alias("adapter_version"),
        text_of(fingerprint).alias("idempotency_key_fingerprint"),
        (is_present(fingerprint) & text_of(fingerprint).isNull()).alias("fingerprint_bad"),
        F.col("p.retry_safe").alias("retry_safe"),
        F.col("p.source_intent_seq").alias("source_intent_seq"),
        F.col("p.source_effect_seq").alias("source_effect_seq"),
        retry_of.alias("retry_of_intent_seq"),
        (is_present(retry) & retry_of.isNull()).alias("retry_bad"),
        F.col("p.started_at_ns").alias("started_at_ns"),
        F.col("p.ended_at_ns").alias("ended_at_ns"),
        text_of("p.next_node").alias("next_node"),
        text_of("p.next_activation_id").alias("next_activation"),
        reason.alias("reason"),
    )
    # In a step of its own: with all other fields its method was too long for the JVM to compile.
    failure = F.when(F.col("type") == N.APPROVAL_DENIED, "approval denied").otherwise(
        F.coalesce(shown("reason"), F.when(F.col("type") == N.ATTEMPT_FAILED, "attempt failed"))
    )
    return flat.withColumn("failure", failure).drop("reason")


def decode_effects(events: DataFrame) -> DataFrame:
    """Only what spans are made of and judged by. Of a payload no more is parsed than its type of event
    has: effects their own fields, starts of runs and attempts theirs, the others none."""
    kind = F.col("type")
    effect, start = kind.isin(*N.EFFECT_TYPES), kind.isin(N.RUN_STARTED, N.ATTEMPT_STARTED)
    parsed = events.withColumns(
        {
            "p": F.from_json(F.when(effect, F.col("payload")), EFFECT_PAYLOAD),
            "s": F.from_json(F.when(start, F.col("payload")), START_PAYLOAD),
        }
    )
    fingerprint, retry = "p.idempotency_key_fingerprint", "p.retry_of_intent_seq"
    retry_of = F.when(F.schema_of_variant(retry) == "BIGINT", F.variant_get(retry, "$", "bigint"))
    texts = ("effect_id", "label", "request_fingerprint", "adapter_version")
    typed = parsed.select(
        "run_id",
        "seq",
        "type",
        "node",
        "activation_id",
        "attempt_id",
        event_time().alias("time_ns"),
        F.col("s.journal_schema_version").alias("journal_version"),
        text_of("s.workflow_version").alias("workflow_version"),
        F.col("s.recovery").alias("recovery"),
        *[text_of(f"p.{c}").alias(c) for c in texts],
        text_of(fingerprint).alias("idempotency_key_fingerprint"),
        is_present(fingerprint).alias("has_fingerprint"),
        *[F.col(f"p.{c}").alias(c) for c in ("index", "retry_safe", "source_intent_seq", "source_effect_seq")],
        retry_of.alias("retry_of_intent_seq"),
        is_present(retry).alias("has_retry"),
        *[F.col(f"p.{c}").alias(c) for c in ("started_at_ns", "ended_at_ns")],
    )
    return typed.withColumns(
        {
            "fingerprint_bad": F.col("has_fingerprint") & F.col("idempotency_key_fingerprint").isNull(),
            "retry_bad": F.col("has_retry") & F.col("retry_of_intent_seq").isNull(),
        }
    )


def identity_ok(strict: bool) -> Column:
    """Effect identity rules; ``strict`` adds the two the fold has and the projection has not."""
    ok = (
        F.col("effect_id").isNotNull()
        & (F.col("index") >= 0)
        & F.col("label").isNotNull()
        & F.col("request_fingerprint").isNotNull()
        & F.col("adapter_version").isNotNull()
        & ~F.col("fingerprint_bad")
        & F.col("retry_safe").isNotNull()
    )
    if strict:
        ok &= (F.col("adapter_version") != "unspecified") & (
            ~F.col("retry_safe") | F.col("idempotency_key_fingerprint").isNotNull()
        )
    return F.coalesce(ok, F.lit(False))


def times_ok() -> Column:
    start, end = F.col("started_at_ns"), F.col("ended_at_ns")
    return F.coalesce((start >= 1) & (end >= 1) & (end >= start), F.lit(False))
