"""External effects: what was recorded, what may run again, what must not."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions.joins import skew_join
from chronofold.functions.running import GROUP_ROWS, hot_groups, ordinal

SCOPE = ("run_id", "activation_id")


def pending_intents(decoded: DataFrame) -> DataFrame:
    """Intents that no completion names."""
    done = decoded.where(F.col("type") == N.EFFECT_COMPLETED).select(
        "run_id", F.col("source_intent_seq").alias("seq")
    )
    return decoded.where(F.col("type") == N.EFFECT_INTENT).join(done, ["run_id", "seq"], "left_anti")


def effect_ledger(decoded: DataFrame) -> DataFrame:
    """Per run, activation and effect: the facts counted and the outcome still unknown."""
    kind = F.col("type")
    facts = decoded.where(kind.isin(*N.EFFECT_TYPES)).select(
        *SCOPE, "effect_id", "seq", "type", F.lit(False).alias("open"), F.lit(False).alias("safe")
    )
    still_open = pending_intents(decoded).select(
        *SCOPE,
        "effect_id",
        "seq",
        F.lit("pending").alias("type"),
        F.lit(True).alias("open"),
        (F.col("retry_safe") & F.col("idempotency_key_fingerprint").isNotNull()).alias("safe"),
    )
    return (
        facts.unionByName(still_open)
        .groupBy(*SCOPE, "effect_id")
        .agg(
            F.count_if(kind == N.EFFECT_INTENT).alias("intents"),
            F.count_if(kind == N.EFFECT_COMPLETED).alias("completions"),
            F.count_if(kind == N.EFFECT_RESOLVED).alias("resolutions"),
            F.max(F.when(F.col("open"), F.col("seq"))).alias("pending_intent_seq"),
            F.max_by("safe", F.when(F.col("open"), F.col("seq"))).alias("retry_allowed"),
        )
    )


def duplicate_completions(decoded: DataFrame) -> DataFrame:
    """Activations that completed one effect id or one index more than once."""
    done = decoded.where(F.col("type") == N.EFFECT_COMPLETED)
    # Two completions of one intent count once, as the later one replaces the earlier.
    per_intent = done.groupBy("run_id", "activation_id", "source_intent_seq").agg(
        F.max_by("effect_id", "seq").alias("effect_id"), F.max_by("index", "seq").alias("index")
    )
    by_id = per_intent.groupBy(*SCOPE, F.concat(F.lit("id "), "effect_id").alias("identity")).count()
    by_index = per_intent.groupBy(
        *SCOPE, F.concat(F.lit("index "), F.col("index").cast("string")).alias("identity")
    ).count()
    return by_id.unionByName(by_index).where("count > 1")


def call_requests(
    requests: DataFrame, *, order: str = "call_order", width: int = GROUP_ROWS
) -> DataFrame:
    """Effect calls with their index inside the attempt, default id and fingerprints.

    ``requests``: run_id, activation_id, attempt_id, call_order, label, request (JSON
    text), adapter_version, effect_id, idempotency_key, retry_safe.
    """
    key = ["run_id", "attempt_id"]
    numbered = ordinal(requests, key, order, "index", hot=hot_groups(requests, key, width))
    return (
        numbered.withColumn(
            "effect_id",
            F.coalesce(
                F.nullif(F.col("effect_id"), F.lit("")),
                F.concat(F.lit("call-"), F.col("index").cast("string")),
            ),
        )
        .withColumn("request_fingerprint", X.fingerprint(F.coalesce("request", F.lit("null"))))
        .withColumn("idempotency_key_fingerprint", X.key_fingerprint(F.col("idempotency_key")))
    )


def _recorded(decoded: DataFrame) -> DataFrame:
    """Completed and pending effects, one row per way a call can meet them."""
    done = decoded.where(F.col("type") == N.EFFECT_COMPLETED).withColumn("recorded", F.lit(True))
    rows = done.unionByName(pending_intents(decoded).withColumn("recorded", F.lit(False)))
    fact = F.struct("recorded", "seq", "source_intent_seq", *N.IDENTITY_FIELDS)
    keys = F.array(
        F.concat(F.lit("id "), "effect_id"),
        F.concat(F.lit("index "), F.col("index").cast("string")),
    )
    # A recorded result wins over a pending intent; among equals the latest wins.
    return (
        rows.select(*SCOPE, F.explode(keys).alias("key"), fact.alias("fact"))
        .groupBy(*SCOPE, "key")
        .agg(F.max("fact").alias("fact"))
    )


def plan_calls(calls: DataFrame, decoded: DataFrame) -> DataFrame:
    """What to do with each call: resolve, execute, refuse, or report a mismatch.

    A call meets recorded facts by effect id first and by index only when no fact has
    its id; all seven identity fields must then agree.
    """
    known = _recorded(decoded)
    by_id = known.select(
        *SCOPE, F.col("key").alias("id_key"), F.col("fact").alias("id_fact")
    )
    by_index = known.select(
        *SCOPE, F.col("key").alias("index_key"), F.col("fact").alias("index_fact")
    )
    keyed = calls.withColumn("id_key", F.concat(F.lit("id "), "effect_id")).withColumn(
        "index_key", F.concat(F.lit("index "), F.col("index").cast("string"))
    )
    hot = hot_groups(calls, list(SCOPE))  # many calls may name one effect
    met = skew_join(keyed, by_id, [*SCOPE, "id_key"], hot=hot)
    met = skew_join(met, by_index, [*SCOPE, "index_key"], hot=hot)
    collision = F.coalesce("id_fact", "index_fact")
    met = met.withColumn("met", collision)
    differs = [
        F.when(~F.col(c).eqNullSafe(F.col(f"met.{c}")), F.lit(c)) for c in sorted(N.IDENTITY_FIELDS)
    ]
    mismatched = F.when(F.col("met").isNotNull(), F.array_join(F.array_compact(F.array(*differs)), ", "))
    has_key = F.coalesce(F.col("idempotency_key") != "", F.lit(False))
    valid = (
        F.coalesce(F.col("label") != "", F.lit(False))
        & F.coalesce((F.col("adapter_version") != "") & (F.col("adapter_version") != "unspecified"), F.lit(False))
        & (~F.col("retry_safe") | has_key)
    )
    recorded = F.coalesce(F.col("id_fact.recorded"), F.lit(False))
    pending = F.coalesce(~F.col("id_fact.recorded"), F.lit(False))
    verdict = (
        F.when(~valid, "invalid_arguments")
        .when(F.coalesce(F.col("mismatched") != "", F.lit(False)), "identity_mismatch")
        .when(recorded, "resolve")
        .when(pending & ~(F.col("retry_safe") & has_key), "unknown_outcome")
        .otherwise("execute")
    )
    planned = met.withColumn("mismatched", mismatched).withColumn("verdict", verdict)
    return planned.select(
        *calls.columns,
        "verdict",
        F.when(F.col("verdict") == "identity_mismatch", F.col("mismatched")).alias("mismatched"),
        F.when(F.col("verdict") == "resolve", F.col("met.seq")).alias("source_effect_seq"),
        F.when(F.col("verdict") == "resolve", F.col("met.source_intent_seq")).alias("source_intent_seq"),
        F.when((F.col("verdict") == "execute") & pending, F.col("met.seq")).alias("retry_of_intent_seq"),
    )


def run_calls(plan: DataFrame, adapter: Callable, started_at_ns: Column, ended_at_ns: Column) -> DataFrame:
    """Call the adapter for the calls that may run; results come back as JSON text.

    ``adapter`` takes a pandas frame of calls and returns the result texts in order.
    """

    def execute(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(result=adapter(batch))

    wanted = plan.where("verdict = 'execute'").withColumn("started_at_ns", started_at_ns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    done = wanted.mapInPandas(execute, f"{schema}, result string")
    return done.withColumn("ended_at_ns", ended_at_ns)


def apply_once(attempts: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One business row per idempotency key: ``(rows to keep, verdict per attempt)``.

    The first attempt of a key decides its amount, unless the key is stored already. An
    attempt that names another amount is a conflict; it is logged like all attempts.
    """
    valid = F.coalesce((F.col("idempotency_key") != "") & (F.col("amount_cents") >= 1), F.lit(False))
    first = (
        attempts.where(valid)
        .groupBy("idempotency_key")
        .agg(F.min_by("amount_cents", "seq").alias("amount_cents"))
        .withColumn("is_new", F.lit(True))
    )
    if stored is not None:
        old = stored.select("idempotency_key", "amount_cents").withColumn("is_new", F.lit(False))
        first = old.unionByName(first.join(old, "idempotency_key", "left_anti"))
    kept = first.where("is_new").select(
        "idempotency_key", X.receipt_token(F.col("idempotency_key")).alias("receipt"), "amount_cents"
    )
    hot = hot_groups(attempts, ["idempotency_key"])
    owner = first.select("idempotency_key", F.col("amount_cents").alias("kept_cents"))
    judged = skew_join(attempts, owner, ["idempotency_key"], hot=hot).withColumn(
        "verdict",
        F.when(~valid, "invalid")
        .when(F.col("kept_cents") != F.col("amount_cents"), "conflict")
        .otherwise("applied"),
    )
    return kept, judged


def store_summary(attempts: DataFrame, kept: DataFrame) -> DataFrame:
    return attempts.agg(F.count("*").alias("attempts")).crossJoin(
        kept.agg(F.count("*").alias("business_executions"))
    )
