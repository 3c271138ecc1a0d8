"""Runs that show one crash, one recovery and one effect read back from the journal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions.running import GROUP_ROWS, hot_groups, running_values
from chronofold.operators.decode import decode

# How often each event type occurs in such a run.
EVENT_COUNTS = {
    N.RUN_STARTED: 1,
    N.ATTEMPT_STARTED: 2,
    N.EFFECT_INTENT: 1,
    N.EFFECT_COMPLETED: 1,
    N.ATTEMPT_ABANDONED: 1,
    N.EFFECT_RESOLVED: 1,
    N.ACTIVATION_FINISHED: 1,
    N.RUN_FINISHED: 1,
}


@dataclass(frozen=True)
class EffectContract:
    """The one effect a registered run makes."""

    effect_id: str = "settle"
    label: str = "payments:settle"
    adapter_version: str = "store/v1"
    node: str = "settle"
    workflow: str = "settle/v1"


def check_registered(
    events: DataFrame, contract: EffectContract = EffectContract(), *, width: int = GROUP_ROWS
) -> DataFrame:
    """One row per run with the first property it lacks, null when it has them all."""
    hot = hot_groups(events, ["run_id"], width)
    kind = F.col("type")
    rows = running_values(
        decode(events), ["run_id"], "seq", hot=hot, peak={"b_time": F.col("time_ns"), "b_seq": F.col("seq")}
    )
    counts = [F.count_if(kind == t).alias(f"n_{t}") for t in EVENT_COUNTS]
    attempt = kind == N.ATTEMPT_STARTED

    def of(t: str, column: str, name: str):
        return F.max(F.when(kind == t, F.col(column))).alias(name)

    identity = F.struct(*N.IDENTITY_FIELDS)
    per_run = rows.groupBy("run_id").agg(
        *counts,
        F.count("*").alias("n"),
        F.count_if(F.col("b_seq") >= F.col("seq")).alias("unordered"),
        F.count_if(F.col("b_time") > F.col("time_ns")).alias("backwards"),
        F.min_by(F.struct("activation_id", "attempt_id"), F.when(attempt, F.col("seq"))).alias("first"),
        F.max_by(F.struct("activation_id", "attempt_id"), F.when(attempt, F.col("seq"))).alias("second"),
        *[of(t, c, f"{t}_{c}") for t in N.EFFECT_TYPES for c in ("activation_id", "attempt_id", "seq")],
        of(N.ATTEMPT_ABANDONED, "attempt_id", "abandoned_attempt"),
        of(N.ACTIVATION_FINISHED, "attempt_id", "finished_attempt"),
        of(N.EFFECT_COMPLETED, "source_intent_seq", "c_intent"),
        of(N.EFFECT_RESOLVED, "source_intent_seq", "r_intent"),
        of(N.EFFECT_RESOLVED, "source_effect_seq", "r_effect"),
        *[F.max(F.when(kind == t, identity)).alias(f"{t}_identity") for t in N.EFFECT_TYPES],
    )
    right_counts = F.col("n") == sum(EVENT_COUNTS.values())
    for t, count in EVENT_COUNTS.items():
        right_counts &= F.col(f"n_{t}") == count
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    distinct = (
        F.coalesce(F.col("first.activation_id") != "", F.lit(False))
        & same("first.activation_id", "second.activation_id")
        & F.coalesce(F.col("first.attempt_id") != F.col("second.attempt_id"), F.lit(False))
    )
    one_activation = F.lit(True)
    for t in N.EFFECT_TYPES:
        one_activation &= same(f"{t}_activation_id", "first.activation_id")
    scopes = (
        same(f"{N.EFFECT_INTENT}_attempt_id", "first.attempt_id")
        & same(f"{N.EFFECT_COMPLETED}_attempt_id", "first.attempt_id")
        & same("abandoned_attempt", "first.attempt_id")
        & same(f"{N.EFFECT_RESOLVED}_attempt_id", "second.attempt_id")
        & same("finished_attempt", "second.attempt_id")
    )
    chain = (
        same("c_intent", f"{N.EFFECT_INTENT}_seq")
        & same("r_intent", f"{N.EFFECT_INTENT}_seq")
        & same("r_effect", f"{N.EFFECT_COMPLETED}_seq")
    )
    i = f"{N.EFFECT_INTENT}_identity"
    kept = same(f"{N.EFFECT_COMPLETED}_identity", i) & same(f"{N.EFFECT_RESOLVED}_identity", i)
    registered = (
        F.col(f"{i}.effect_id").eqNullSafe(F.lit(contract.effect_id))
        & F.col(f"{i}.index").eqNullSafe(F.lit(0))
        & F.col(f"{i}.label").eqNullSafe(F.lit(contract.label))
        & F.col(f"{i}.adapter_version").eqNullSafe(F.lit(contract.adapter_version))
        & F.col(f"{i}.retry_safe").eqNullSafe(F.lit(True))
    )
    hashes = F.coalesce(
        X.is_hex(F.col(f"{i}.request_fingerprint"), 64)
        & X.is_hex(F.col(f"{i}.idempotency_key_fingerprint"), 64),
        F.lit(False),
    )
    broken = (
        F.when(~right_counts, "event_counts")
        .when(F.col("unordered") > 0, "sequence_order")
        .when(F.col("backwards") > 0, "time_order")
        .when(~distinct, "attempt_pair")
        .when(~one_activation, "activation_changed")
        .when(~scopes, "attempt_scope")
        .when(~chain, "source_chain")
        .when(~kept, "identity_changed")
        .when(~registered, "effect_contract")
        .when(~hashes, "fingerprint_form")
    )
    return per_run.select("run_id", broken.alias("broken"))
