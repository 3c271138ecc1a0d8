"""Journal events as trace spans, in the aware and the control view.

The aware view keeps a result read back from the journal apart from a real call; the
control view does not and counts it as one more call. All of it happens on the event
rows after a single exchange by run: prior state, named facts, whole-attempt and
whole-run values, and then each event that owns a span becomes that span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions.running import (
    GROUP_ROWS,
    HotGroups,
    group_values,
    hot_groups,
    running_values,
)
from chronofold.names import DEFAULT_NAMING, SpanNaming
from chronofold.operators import decode as D
from chronofold.operators import lookups as L
from chronofold.operators.fold import RULE_SLOTS, pack, rule_name

FAR = 1 << 56  # shifts whole-run rules before or after every event rule


def _run_rule(number: int, shift: int) -> Column:
    return (F.col("seq") * 0 + F.lit(shift)) * RULE_SLOTS + number


def _no_scope() -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return blank("node") | blank("activation_id") | blank("attempt_id")


def _first_rule() -> Column:
    """What the first event of a run breaks by its own fields."""
    return F.when(
        (F.col("type") != N.RUN_STARTED)
        | ~F.col("journal_version").eqNullSafe(F.lit(N.JOURNAL_VERSION))
        | F.col("workflow_version").isNull(),
        3,
    )


def _own_rule() -> Column:
    """What an event of an attempt breaks by its own fields, whatever came before."""
    kind = F.col("type")
    starts = F.coalesce(F.col("started_at_ns") >= 1, F.lit(False))
    member = (
        F.when(_no_scope(), 7)
        .when(kind.isin(*N.EFFECT_TYPES) & ~D.identity_ok(strict=False), 8)
        .when((kind == N.EFFECT_INTENT) & ~starts, 8)
        .when((kind == N.EFFECT_INTENT) & F.col("retry_bad"), 9)
        .when((kind == N.EFFECT_COMPLETED) & (F.col("source_intent_seq").isNull() | ~D.times_ok()), 10)
        .when(
            (kind == N.EFFECT_RESOLVED)
            & (F.col("source_effect_seq").isNull() | F.col("source_intent_seq").isNull() | ~D.times_ok()),
            11,
        )
    )
    return F.when(kind == N.ATTEMPT_STARTED, F.when(_no_scope() | F.col("recovery").isNull(), 6)).when(
        kind.isin(*N.EFFECT_TYPES, *N.ATTEMPT_END_TYPES), member
    )


def _state_rule(first: Column | None = None, own: Column | None = None) -> Column:
    """The rule an event breaks by the state before it; ``first`` and ``own`` may be columns made earlier."""
    kind = F.col("type")
    first = _first_rule() if first is None else first
    own = _own_rule() if own is None else own
    open_id = F.col("b_open.id")
    outside = (
        ~F.col("attempt_id").eqNullSafe(open_id)
        | ~F.col("node").eqNullSafe(F.col("b_open.node"))
        | ~F.col("activation_id").eqNullSafe(F.col("b_open.act"))
    )
    return (
        F.when(F.col("b_seq").isNull(), first)
        .when(F.col("b_terminal"), 4)
        .when(kind == N.ATTEMPT_STARTED, F.when(open_id.isNotNull(), 5).otherwise(own))
        .when(kind.isin(*N.EFFECT_TYPES, *N.ATTEMPT_END_TYPES), F.when(outside, 7).otherwise(own))
        .when(
            kind.isin(N.AWAITING_APPROVAL, N.APPROVAL_GRANTED, N.APPROVAL_DENIED),
            F.when(open_id.isNotNull(), 12),
        )
        .when(kind.isin(N.RUN_FINISHED, N.RUN_FAILED), F.when(open_id.isNotNull(), 13))
        .otherwise(14)
    )


def _lookup_rule() -> Column:
    kind = F.col("type")
    same_intent = L.source_is(N.EFFECT_INTENT) & L.same_effect()
    completion = same_intent & ~L.used() & F.col("attempt_id").eqNullSafe(F.col("src.attempt_id"))
    resolution = (
        L.source_is(N.EFFECT_COMPLETED)
        & L.same_effect()
        & F.col("src.source_intent_seq").eqNullSafe(F.col("source_intent_seq"))
    )
    return F.when(
        F.col("names") & F.col("key").isNotNull(),
        F.when((kind == N.ATTEMPT_STARTED) & L.seen(), 6)
        .when((kind == N.EFFECT_INTENT) & ~same_intent, 9)
        .when((kind == N.EFFECT_COMPLETED) & ~completion, 10)
        .when((kind == N.EFFECT_RESOLVED) & ~resolution, 11),
    )


def _checked(events: DataFrame, hot: HotGroups) -> DataFrame:
    """Event rows with the packed number of the rule they break, if any."""
    kind = F.col("type")
    none = F.lit(None).cast("string")
    opened = F.struct(
        F.col("attempt_id").alias("id"), F.col("node").alias("node"), F.col("activation_id").alias("act")
    )
    closed = F.struct(none.alias("id"), none.alias("node"), none.alias("act"))
    state = running_values(
        D.decode(events),
        ["run_id"],
        "seq",
        hot=hot,
        last={
            "b_open": F.when(kind == N.ATTEMPT_STARTED, opened).when(
                kind.isin(*N.ATTEMPT_END_TYPES), closed
            )
        },
        peak={
            "b_seq": F.col("seq"),
            "b_terminal": F.when(kind.isin(N.RUN_FINISHED, N.RUN_FAILED), True),
        },
    )
    judged = state.select(
        "run_id",
        "seq",
        "type",
        "time_ns",
        *[c for c in L.SOURCE_FIELDS if c not in ("seq", "type")],
        "source_effect_seq",
        "retry_of_intent_seq",
        "start_activation",
        "next_node",
        "next_activation",
        "recovery",
        "workflow_version",
        "started_at_ns",
        "ended_at_ns",
        F.least(
            pack(_state_rule()), F.when(F.col("seq") <= F.col("b_seq"), _run_rule(2, -FAR))
        ).alias("state_rule"),
    )
    # Rows of provided facts have done their part; their events have rows of their own.
    return L.with_named_facts(judged, hot).withColumn(
        "broken", F.least("state_rule", pack(_lookup_rule()))
    ).where("names")


def _with_ends(events: DataFrame, width: int, hot: HotGroups) -> DataFrame:
    """Checked rows plus when and how their attempt and run ended."""
    kind = F.col("type")
    attempt_hot = (
        hot if hot.keys is None else hot_groups(events, ["run_id", "attempt_id"], width)
    )
    is_end = kind.isin(*N.ATTEMPT_END_TYPES)
    rows = group_values(
        _checked(events, hot),
        ["run_id", "attempt_id"],
        "seq",
        {
            "attempt_end_type": F.max(F.when(is_end, kind)),
            "attempt_closed": F.max(F.when(is_end, F.col("time_ns"))),
            "attempt_last": F.max_by("time_ns", "seq"),
        },
        hot=attempt_hot,
    ).withColumn("attempt_end", F.coalesce("attempt_closed", "attempt_last"))
    is_terminal = kind.isin(N.RUN_FINISHED, N.RUN_FAILED)
    backwards = (kind == N.ATTEMPT_STARTED) & (F.col("attempt_end") < F.col("time_ns"))
    return group_values(
        rows.withColumn("broken", F.least("broken", F.when(backwards, _run_rule(16, FAR)))),
        ["run_id"],
        "seq",
        {
            "run_broken": F.min("broken"),
            "run_attempts": F.count_if(kind == N.ATTEMPT_STARTED),
            "run_terminal": F.max(F.when(is_terminal, kind)),
            "run_begin": F.min_by("time_ns", "seq"),
            "run_closed": F.max(F.when(is_terminal, F.col("time_ns"))),
            "run_last": F.max_by("time_ns", "seq"),
        },
        hot=hot,
    ).withColumn("run_end", F.coalesce("run_closed", "run_last"))


def _plain(events: DataFrame, width: int) -> bool:
    """No run has more than ``width`` events, and every event has a sequence number and a time."""
    odd = F.col("seq").isNull() | D.event_time().isNull()
    per_run = events.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(odd).alias("odd"))
    return not per_run.where((F.col("n") > width) | (F.col("odd") > 0)).take(1)


_FACT = ("run_id", "fact", "started_id")
_HASHED = ("request_fingerprint", "idempotency_key_fingerprint")


def _owns_span() -> Column:
    return F.col("type").isin(N.RUN_STARTED, N.ATTEMPT_STARTED, N.EFFECT_COMPLETED, N.EFFECT_RESOLVED)


def _slim(events: DataFrame) -> DataFrame:
    """What the projection asks of an event: tests of its own fields are made before the shuffle, and
    fields that only some types have are one struct, null for all others. Hashes are bytes."""
    kind = F.col("type")
    typed = D.decode_effects(events)
    fact = F.when(kind == N.EFFECT_COMPLETED, F.col("source_intent_seq")).when(
        kind == N.EFFECT_RESOLVED, F.col("source_effect_seq")
    ).when(kind == N.EFFECT_INTENT, F.col("retry_of_intent_seq"))
    is_effect = kind.isin(*N.EFFECT_TYPES)
    return typed.select(
        "run_id",
        "seq",
        "type",
        "node",
        "activation_id",
        "attempt_id",
        "time_ns",
        "recovery",
        "workflow_version",
        _first_rule().alias("first_rule"),
        _own_rule().alias("own_rule"),
        fact.alias("fact"),
        F.when(is_effect, F.struct(*[X.packed_hex(F.col(c)).alias(c) if c in _HASHED else F.col(c) for c in N.IDENTITY_FIELDS])).alias("effect"),
        F.when(is_effect, F.struct("source_intent_seq", "source_effect_seq", "started_at_ns", "ended_at_ns")).alias("when"),
    )


def _plain_judged(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Events that own a span, break a rule or begin a run, with the packed number of the rule they break
    and how and when their attempt and run ended. For runs as ``_plain`` wants them.

    Two sorts: by sequence, and by the fact an event names. In a run that breaks no other rule the next end of an
    attempt after its start is its own, and an attempt without end lasts until the last event.
    """
    kind = F.col("type")
    none = F.lit(None).cast("string")
    opened = F.struct(F.col("attempt_id").alias("id"), F.col("node").alias("node"), F.col("activation_id").alias("act"))
    closed = F.struct(none.alias("id"), none.alias("node"), none.alias("act"))
    is_end, is_terminal = kind.isin(*N.ATTEMPT_END_TYPES), kind.isin(N.RUN_FINISHED, N.RUN_FAILED)
    ordered = Window.partitionBy("run_id").orderBy("seq")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ",".join(f"'{t}'" for t in N.ATTEMPT_END_TYPES)
    next_end = f"lead(case when type in ({ends}) then struct(type, time_ns) end) ignore nulls over (partition by run_id order by seq)"
    slim = _slim(events)
    if runs is not None:  # an inner join stays above the decoding, so payloads are not shuffled
        slim = slim.join(runs, "run_id")
    state = slim.select(
        "*",
        F.last(F.when(kind == N.ATTEMPT_STARTED, opened).when(is_end, closed), ignorenulls=True).over(before).alias("b_open"),
        F.max("seq").over(before).alias("b_seq"),
        F.max(F.when(is_terminal, True)).over(before).alias("b_terminal"),
        F.expr(next_end).alias("next_end"),
        F.count_if(kind == N.ATTEMPT_STARTED).over(whole).alias("run_attempts"),
        F.max(F.when(is_terminal, kind)).over(whole).alias("run_terminal"),
        F.first("time_ns").over(whole).alias("run_begin"),
        F.max(F.when(is_terminal, F.col("time_ns"))).over(whole).alias("run_closed"),
        F.last("time_ns").over(whole).alias("run_last"),
    )
    started = kind == N.ATTEMPT_STARTED
    attempt_end = F.coalesce("next_end.time_ns", "run_last")
    rule = F.least(
        pack(_state_rule(F.col("first_rule"), F.col("own_rule"))),
        F.when(F.col("seq") <= F.col("b_seq"), _run_rule(2, -FAR)),
        F.when(started & (attempt_end < F.col("time_ns")), _run_rule(16, FAR)),
    )
    run = F.struct(
        F.col("run_attempts").alias("attempts"),
        F.col("run_terminal").alias("terminal"),
        F.col("run_begin").alias("begin"),
        F.coalesce("run_closed", "run_last").alias("end"),
    )
    attempt = F.struct(F.col("next_end.type").alias("end_type"), attempt_end.alias("end"))
    base = ("run_id", "seq", "type", "node", "activation_id", "attempt_id", "effect", "when", "fact")
    judged = state.select(
        *base,
        rule.alias("state_rule"),
        F.col("b_seq").isNull().alias("is_first"),
        F.when(started, F.col("attempt_id")).alias("started_id"),
        F.when(started | (kind == N.RUN_STARTED), F.struct("time_ns", "recovery", "workflow_version")).alias("start"),
        F.when(started, attempt).alias("attempt"),
        F.when(_owns_span() | F.col("b_seq").isNull(), run).alias("run"),
    )
    keeps = _owns_span() | F.col("state_rule").isNotNull() | F.col("is_first") | F.col("fact").isNotNull()
    provides = kind.isin(N.EFFECT_INTENT, N.EFFECT_COMPLETED)
    one, both = F.array(F.lit(True)), F.array(F.lit(True), F.lit(False))
    copies = F.when(provides, F.when(keeps, both).otherwise(F.array(F.lit(False)))).when(keeps, one)
    entries = judged.select("*", F.explode(copies).alias("names"))
    own = ("state_rule", "started_id", "start", "attempt", "run")
    entries = entries.select(
        *[c for c in base if c != "fact"],
        F.when(F.col("names"), F.col("fact")).otherwise(F.col("seq")).alias("fact"),
        *[F.when(F.col("names"), F.col(c)).alias(c) for c in own],
        "names",
    )
    earlier = Window.partitionBy(*_FACT).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    source = F.struct("seq", "type", "node", "activation_id", "attempt_id", "when.source_intent_seq", "effect")
    named = F.col("names") & (F.col("fact").isNotNull() | F.col("started_id").isNotNull())
    found = entries.select(
        "*",
        F.last(F.when(~F.col("names"), source), ignorenulls=True).over(earlier).alias("src"),
        F.max(F.when(named & (kind == N.EFFECT_COMPLETED), True)).over(earlier).alias("used"),
        F.max(F.when(named, True)).over(earlier).alias("seen"),
    )
    same = F.lit(True)
    for c in ("node", "activation_id", "effect"):
        same &= F.col(c).eqNullSafe(F.col(f"src.{c}"))
    same_intent = L.source_is(N.EFFECT_INTENT) & same
    completion = same_intent & ~L.used() & F.col("attempt_id").eqNullSafe(F.col("src.attempt_id"))
    resolution = L.source_is(N.EFFECT_COMPLETED) & same & F.col("src.source_intent_seq").eqNullSafe(F.col("when.source_intent_seq"))
    lookup = F.when(
        named,
        F.when(started & L.seen(), 6)
        .when((kind == N.EFFECT_INTENT) & ~same_intent, 9)
        .when((kind == N.EFFECT_COMPLETED) & ~completion, 10)
        .when((kind == N.EFFECT_RESOLVED) & ~resolution, 11),
    )
    return found.where("names").select(
        "run_id", "seq", "type", "node", "activation_id", "attempt_id", "effect", "when", "start", "attempt", "run",
        F.least("state_rule", pack(lookup)).alias("broken"),
    )


def _plain_owners(events: DataFrame, runs: DataFrame | None) -> DataFrame:
    """The events that own a span in sound runs, in the columns ``span_rows`` asks for."""
    rows = _plain_judged(events, runs).withColumn("run_broken", F.min("broken").over(Window.partitionBy("run_id")))
    sound = F.col("run_broken").isNull() & (F.col("run.attempts") > 0) & (F.col("run.end") >= F.col("run.begin"))
    return rows.where(sound & _owns_span()).select(
        "run_id",
        "seq",
        "type",
        "node",
        "activation_id",
        "attempt_id",
        *[F.col(f"effect.{c}").alias(c) for c in ("effect_id", "index", "label", "adapter_version")],
        X.unpacked_hex(F.col("effect.request_fingerprint")).alias("request_fingerprint"),
        *[F.col(f"when.{c}").alias(c) for c in ("source_effect_seq", "started_at_ns", "ended_at_ns")],
        *[F.col(f"start.{c}").alias(c) for c in ("time_ns", "recovery", "workflow_version")],
        F.col("attempt.end_type").alias("attempt_end_type"),
        F.col("attempt.end").alias("attempt_end"),
        F.col("run.terminal").alias("run_terminal"),
        F.col("run.end").alias("run_end"),
    )


def projection_rules(
    events: DataFrame, *, width: int = GROUP_ROWS, hot: HotGroups | None = None
) -> DataFrame:
    """One row per run with the first projection rule it breaks (null when sound)."""
    if hot is None and _plain(events, width):
        of_run = {"run_attempts": "run.attempts", "run_begin": "run.begin", "run_end": "run.end"}
        rows = _plain_judged(events).select("run_id", "broken", *[F.col(c).alias(n) for n, c in of_run.items()])
    else:
        rows = _with_ends(events, width, hot or hot_groups(events, ["run_id"], width))
    packed = F.coalesce(
        F.min("broken"),
        F.min(F.when(F.col("run_attempts") == 0, F.lit(FAR) * RULE_SLOTS + 15)),
        F.min(F.when(F.col("run_end") < F.col("run_begin"), F.lit(FAR) * RULE_SLOTS + 16)),
    )
    per_run = rows.groupBy("run_id").agg(packed.alias("packed"))
    per_run = per_run.withColumn(
        "packed", F.when(F.col("packed") < 0, F.col("packed") + FAR * RULE_SLOTS).otherwise(F.col("packed"))
    )
    at = F.expr(f"packed div {RULE_SLOTS}")
    return per_run.select(
        "run_id",
        rule_name("P").alias("rule"),
        F.when((at > 0) & (at < FAR), at).alias("rule_seq"),
    )


ATTRIBUTE_KEYS = {
    # Attribute suffix of each typed attribute column.
    "adapter_version": "effect.adapter.version",
    "effect_id": "effect.id",
    "effect_index": "effect.index",
    "effect_label": "effect.label",
    "effect_outcome": "effect.outcome",
    "request_fingerprint": "effect.request.fingerprint",
    "effect_source": "effect.source",
    "source_sequence": "effect.source.sequence",
    "activation_id": "activation.id",
    "attempt_id": "attempt.id",
    "attempt_outcome": "attempt.outcome",
    "attempt_recovery": "attempt.recovery",
    "node": "node.name",
    "operation_name": "operation.name",
    "run_id": "run.id",
    "run_outcome": "run.outcome",
    "workflow_version": "workflow.version",
}


def attributes_json(column: str = "attributes", naming: SpanNaming = DEFAULT_NAMING) -> Column:
    """The typed attributes as JSON with dotted, sorted keys; absent ones stay absent."""
    keyed = {naming.key(v): k for k, v in ATTRIBUTE_KEYS.items()} | {"error.type": "error_type"}
    return F.to_json(F.struct(*[F.col(f"{column}.{keyed[k]}").alias(k) for k in sorted(keyed)]))


def project(
    events: DataFrame,
    *,
    modes: Sequence[str] = N.MODES,
    naming: SpanNaming = DEFAULT_NAMING,
    width: int = GROUP_ROWS,
    hot: HotGroups | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """The span table of every sound run; runs that break a rule give no span.

    ``runs`` (run_id, each once) names the runs to project where not all are asked for.
    """
    if hot is None and _plain(events, width):
        return span_rows(_plain_owners(events, runs), modes, naming)
    if runs is not None:
        events = events.join(runs, "run_id", "left_semi")
    hot = hot or hot_groups(events, ["run_id"], width)
    kind = F.col("type")
    sound = (
        F.col("run_broken").isNull()
        & (F.col("run_attempts") > 0)
        & (F.col("run_end") >= F.col("run_begin"))
    )
    effect = kind.isin(N.EFFECT_COMPLETED, N.EFFECT_RESOLVED)
    owners = _with_ends(events, width, hot).where(
        sound & (kind.isin(N.RUN_STARTED, N.ATTEMPT_STARTED) | effect) & F.col("names")
    )
    return span_rows(owners, modes, naming)


def span_rows(owners: DataFrame, modes: Sequence[str], naming: SpanNaming) -> DataFrame:
    """The spans of events that own one, given how and when their attempt and run ended."""
    kind = F.col("type")
    effect = kind.isin(N.EFFECT_COMPLETED, N.EFFECT_RESOLVED)
    both = owners.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    aware = F.col("mode") == "aware"
    resolved = (kind == N.EFFECT_RESOLVED) & aware
    run, att = kind == N.RUN_STARTED, kind == N.ATTEMPT_STARTED
    seq = F.col("seq").cast("string")
    text = F.lit

    def attempt_identity() -> Column:
        return F.concat(text("attempt:"), F.col("attempt_id"))

    def span(identity: Column) -> Column:
        return X.span_id(F.col("run_id"), F.col("mode"), identity, naming)

    identity = (
        F.when(run, "run")
        .when(att, attempt_identity())
        .when(resolved, F.concat(text("effect-resolve:"), seq))
        .otherwise(F.concat(text("effect-execute:"), seq))
    )
    a = naming.attribute
    name = (
        F.when(run, f"{a}.run")
        .when(att, F.concat(text(f"{a}.activation "), F.col("node")))
        .when(resolved, F.concat(text(f"{a}.effect.resolve "), F.col("label")))
        .otherwise(F.concat(text(f"{a}.effect.execute "), F.col("label")))
    )
    outcome = (
        F.when(F.col("attempt_end_type") == N.ATTEMPT_ABANDONED, "abandoned")
        .when(F.col("attempt_end_type") == N.ATTEMPT_FAILED, "failed")
        .when(F.col("attempt_end_type") == N.ACTIVATION_FINISHED, "completed")
        .otherwise("open")
    )
    run_outcome = (
        F.when(F.col("run_terminal") == N.RUN_FINISHED, "finished")
        .when(F.col("run_terminal") == N.RUN_FAILED, "failed")
        .otherwise("open")
    )
    failed = (run & (run_outcome == "failed")) | (att & outcome.isin("abandoned", "failed"))
    attributes = F.struct(
        F.when(run, "run")
        .when(att, "activation")
        .when(resolved, "effect.resolve")
        .otherwise("effect.execute")
        .alias("operation_name"),
        F.col("run_id"),
        F.when(run, F.col("workflow_version")).alias("workflow_version"),
        F.when(run, run_outcome).alias("run_outcome"),
        F.when(~run, F.col("node")).alias("node"),
        F.when(~run, F.col("activation_id")).alias("activation_id"),
        F.when(~run, F.col("attempt_id")).alias("attempt_id"),
        F.when(att, outcome).alias("attempt_outcome"),
        F.when(att, F.col("recovery")).alias("attempt_recovery"),
        F.when(att & (outcome == "abandoned"), f"{a}.attempt.abandoned").alias("error_type"),
        F.when(effect, F.col("effect_id")).alias("effect_id"),
        F.when(effect, F.col("index")).alias("effect_index"),
        F.when(effect, F.col("label")).alias("effect_label"),
        F.when(effect, F.col("adapter_version")).alias("adapter_version"),
        F.when(effect, F.col("request_fingerprint")).alias("request_fingerprint"),
        F.when(effect, F.when(resolved, "resolved_from_journal").otherwise("executed")).alias(
            "effect_outcome"
        ),
        F.when(effect & aware, F.when(resolved, "journal").otherwise("external")).alias("effect_source"),
        F.when(resolved, F.col("source_effect_seq")).alias("source_sequence"),
    )
    trace = X.trace_id(F.col("run_id"), F.col("mode"), naming)
    source_span = span(F.concat(text("effect-execute:"), F.col("source_effect_seq").cast("string")))
    keyed = both.select(
        "mode",
        "run_id",
        identity.alias("identity"),
        name.alias("name"),
        trace.alias("trace_id"),
        F.when(att, span(text("run"))).when(effect, span(attempt_identity())).alias("parent_span_id"),
        F.when(effect, F.col("started_at_ns")).otherwise(F.col("time_ns")).alias("start_time_ns"),
        F.when(run, F.col("run_end"))
        .when(att, F.col("attempt_end"))
        .otherwise(F.col("ended_at_ns"))
        .alias("end_time_ns"),
        F.lit("INTERNAL").alias("kind"),
        F.when(failed, "ERROR").otherwise("UNSET").alias("status"),
        F.when(resolved, "resolved").when(effect, "executed").otherwise("structural").alias("classification"),
        attributes.alias("attributes"),
        F.when(
            resolved, F.array(F.struct(trace.alias("trace_id"), source_span.alias("span_id")))
        )
        .otherwise(F.array().cast("array<struct<trace_id:string,span_id:string>>"))
        .alias("links"),
        F.when(run, 0).when(att, 1).when(kind == N.EFFECT_COMPLETED, 2).otherwise(3).alias("family"),
        "seq",
    )
    return keyed.withColumn(
        "span_id", X.span_id(F.col("run_id"), F.col("mode"), F.col("identity"), naming)
    ).withColumn("duration_ns", F.col("end_time_ns") - F.col("start_time_ns"))


def effect_counts(spans: DataFrame) -> DataFrame:
    """Per run and mode: executed, resolved, effect spans and all spans."""
    return spans.groupBy("run_id", "mode").agg(
        F.count_if(F.col("classification") == "executed").alias("executed"),
        F.count_if(F.col("classification") == "resolved").alias("resolved"),
        F.count_if(F.col("classification").isin("executed", "resolved")).alias("effect_spans"),
        F.count("*").alias("total_spans"),
    )
