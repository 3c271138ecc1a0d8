"""Facts an event names by key: its source effect, or an id used earlier in the run.

Every event names at most one earlier fact and provides at most one. Spread over
``(run_id, key)`` and read in order, one pass answers all of it: completions find their
intent, resolutions their completion, retries the intent they repeat, and activation or
attempt ids their first use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions.running import HotGroups, running_values

SOURCE_FIELDS = ("seq", "type", "node", "activation_id", "attempt_id", "source_intent_seq", *N.IDENTITY_FIELDS)
SAME_EFFECT = ("node", "activation_id", *N.IDENTITY_FIELDS)


def _key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind), value.cast("string"))


def named_key() -> Column:
    kind = F.col("type")
    return (
        F.when(kind == N.EFFECT_COMPLETED, _key("s", F.col("source_intent_seq")))
        .when(kind == N.EFFECT_RESOLVED, _key("s", F.col("source_effect_seq")))
        .when(kind == N.EFFECT_INTENT, _key("s", F.col("retry_of_intent_seq")))
        .when(kind == N.ATTEMPT_STARTED, _key("t", F.col("attempt_id")))
        .when(kind == N.RUN_STARTED, _key("a", F.col("start_activation")))
        .when(
            (kind == N.ACTIVATION_FINISHED) & (F.col("next_node") != N.END_NODE),
            _key("a", F.col("next_activation")),
        )
    )


def with_named_facts(events: DataFrame, hot: HotGroups) -> DataFrame:
    """One row with ``names`` per event, for the key it names (null when it names none),
    and one more without for each fact others may name.

    Adds ``src`` (the source effect, if it came before), ``used`` (an earlier completion
    used that source) and ``seen`` (an id was used before).
    """
    kind = F.col("type")
    naming = F.struct(named_key().alias("key"), F.lit(True).alias("names"))
    providing = F.struct(_key("s", F.col("seq")).alias("key"), F.lit(False).alias("names"))
    provides = kind.isin(N.EFFECT_INTENT, N.EFFECT_COMPLETED)
    # Plain arrays: a filter with a lambda would leave generated code.
    touches = F.when(provides, F.array(naming, providing)).otherwise(F.array(naming))
    entries = events.select("*", F.explode(touches).alias("t")).select(
        *events.columns, F.col("t.key").alias("key"), F.col("t.names").alias("names")
    )
    named = F.col("names") & F.col("key").isNotNull()
    source = F.struct(*[F.col(c) for c in SOURCE_FIELDS])
    return running_values(
        entries,
        ["run_id", "key"],
        "seq",
        hot=hot,
        last={"src": F.when(~F.col("names"), source)},
        peak={
            "used": F.when(named & (kind == N.EFFECT_COMPLETED), True),
            "seen": F.when(named, True),
        },
    )


def same_effect() -> Column:
    result = F.lit(True)
    for c in SAME_EFFECT:
        result &= F.col(c).eqNullSafe(F.col(f"src.{c}"))
    return result


def source_is(kind: str) -> Column:
    return F.coalesce((F.col("src.type") == kind) & (F.col("src.seq") < F.col("seq")), F.lit(False))


def used() -> Column:
    return F.coalesce(F.col("used"), F.lit(False))


def seen() -> Column:
    return F.coalesce(F.col("seen"), F.lit(False))
