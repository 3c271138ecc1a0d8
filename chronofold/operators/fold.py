"""The state of every run, or the first rule its events break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions.joins import lookup_join
from chronofold.functions.running import GROUP_ROWS, HotGroups, hot_groups, running_values
from chronofold.operators import decode as D
from chronofold.operators import lookups as L

RULE_SLOTS = 64

AFTER = ("a_open", "a_status", "a_granted", "a_at", "a_version", "a_failure")
"""What the events of a run up to one of them leave behind."""


def pack(rule: Column) -> Column:
    """Event position and rule number in one integer, so a plain min finds the first."""
    return F.col("seq") * RULE_SLOTS + rule


def graph_by_version(nodes: DataFrame) -> DataFrame:
    """One row per workflow version: its start node and node -> needs approval."""
    return nodes.groupBy("workflow_version").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("name", "requires_approval")))
        ).alias("graph_nodes"),
        F.max(F.when(F.col("is_start"), F.col("name"))).alias("graph_start"),
    )


def _types(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def state_setters() -> dict[str, Column]:
    """What each kind of event sets in the state of its run; null where it sets nothing."""
    kind = F.col("type")
    to_end = F.col("next_node") == N.END_NODE
    return {
        "b_open": F.when(kind == N.ATTEMPT_STARTED, F.struct(F.col("attempt_id").alias("id"))).when(
            _types(*N.ATTEMPT_END_TYPES), F.struct(F.lit(None).cast("string").alias("id"))
        ),
        "b_status": F.when(_types(N.ATTEMPT_FAILED, N.APPROVAL_DENIED), "failed")
        .when(kind == N.AWAITING_APPROVAL, "awaiting_approval")
        .when(kind == N.APPROVAL_GRANTED, "running")
        .when(kind == N.RUN_FINISHED, "finished"),
        "b_granted": F.when(kind == N.APPROVAL_GRANTED, True).when(
            _types(N.ACTIVATION_FINISHED, N.AWAITING_APPROVAL), False
        ),
        "b_at": F.when(
            kind == N.RUN_STARTED,
            F.struct(F.col("start_node").alias("node"), F.col("start_activation").alias("act")),
        ).when(
            kind == N.ACTIVATION_FINISHED,
            F.struct(
                F.col("next_node").alias("node"),
                F.when(to_end, "").otherwise(F.col("next_activation")).alias("act"),
            ),
        ),
        "b_version": F.when(kind == N.RUN_STARTED, F.col("workflow_version")),
        "b_failure": F.col("failure"),
    }


def with_prior_state(decoded: DataFrame, hot: HotGroups) -> DataFrame:
    """Each event with the run state all earlier events leave behind."""
    setters = state_setters()
    peaks = {
        "b_seq": F.col("seq"),
        "b_terminal": F.when(_types(N.RUN_FINISHED, N.RUN_FAILED), True),
    }
    state = running_values(
        decoded, ["run_id"], "seq", hot=hot, last=setters, peak=peaks, end_flag="segment_end"
    )
    after = {n.replace("b_", "a_", 1): F.coalesce(c, F.col(n)) for n, c in setters.items()}
    return state.withColumns(after)


def _with_scope(state: DataFrame) -> DataFrame:
    """Adds what many rules ask of an event, so that each asks for a column.

    Repeated in every rule these tests made one method of more than 8,000 bytes, which the JVM
    interprets for every event.
    """
    in_scope = F.col("node").eqNullSafe(F.col("b_at.node")) & F.col("activation_id").eqNullSafe(F.col("b_at.act"))
    return state.withColumns(
        {
            "in_scope": in_scope,
            "in_attempt": in_scope & F.col("attempt_id").eqNullSafe(F.col("b_open.id")),
            "running": F.coalesce(F.col("b_status") == "running", F.lit(True)),
            "identified": D.identity_ok(strict=True),
            "needs_approval": F.element_at("graph_nodes", F.col("b_at.node")),
        }
    )


def _state_rule() -> Column:
    """The rule an event with its scope (``_with_scope``) breaks by the state before it."""
    kind = F.col("type")
    status = F.coalesce("b_status", F.lit("running"))
    granted = F.coalesce("b_granted", F.lit(False))
    open_id = F.col("b_open.id")
    running, in_scope, in_attempt = F.col("running"), F.col("in_scope"), F.col("in_attempt")
    active = running & open_id.isNotNull()
    needs_approval = F.col("needs_approval")
    known = lambda c: F.coalesce(F.map_contains_key("graph_nodes", c), F.lit(False))
    text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    at_least_1 = F.coalesce(F.col("started_at_ns") >= 1, F.lit(False))

    def rules(*tests: tuple[Column, int]) -> Column:
        result = F.when(tests[0][0], tests[0][1])
        for test, number in tests[1:]:
            result = result.when(test, number)
        return result

    first = rules(
        (kind != N.RUN_STARTED, 3),
        (~F.col("journal_version").eqNullSafe(F.lit(N.JOURNAL_VERSION)), 4),
        (F.col("workflow_version").isNull(), 5),
        (F.col("graph_nodes").isNull(), 6),
        (~F.col("input_ok"), 7),
        (F.col("start_node").isNull() | F.col("start_activation").isNull(), 8),
        (
            ~F.col("node").eqNullSafe(F.col("start_node"))
            | ~F.col("activation_id").eqNullSafe(F.col("start_activation")),
            9,
        ),
        (
            ~F.col("start_node").eqNullSafe(F.col("graph_start")) | ~known(F.col("start_node")),
            10,
        ),
    )
    effect = rules(
        (~active, 16),
        (~in_attempt, 17),
        (~F.col("identified"), 18),
        ((kind == N.EFFECT_INTENT) & ~at_least_1, 19),
        ((kind == N.EFFECT_INTENT) & F.col("retry_bad"), 20),
        (
            (kind == N.EFFECT_COMPLETED) & (F.col("source_intent_seq").isNull() | ~D.times_ok()),
            21,
        ),
        (
            (kind == N.EFFECT_RESOLVED) & (F.col("source_effect_seq").isNull() | ~D.times_ok()),
            22,
        ),
    )
    onward = F.col("next_node") != N.END_NODE
    return (
        F.when(F.col("b_seq").isNull(), first)
        .when(F.col("b_terminal"), 11)
        .when(
            kind == N.ATTEMPT_STARTED,
            rules(
                (~running | open_id.isNotNull(), 12),
                (~in_scope | needs_approval.isNull(), 13),
                (needs_approval & ~granted, 14),
                (~text("attempt_id"), 15),
            ),
        )
        .when(_types(*N.EFFECT_TYPES), effect)
        .when(kind == N.ATTEMPT_ABANDONED, F.when(~active | ~in_attempt, 23))
        .when(kind == N.ATTEMPT_FAILED, F.when(~active | ~in_attempt, 24))
        .when(
            kind == N.ACTIVATION_FINISHED,
            rules(
                (~active | ~in_attempt | ~F.col("patch_ok") | F.col("next_node").isNull(), 25),
                (onward & ~known(F.col("next_node")), 26),
                (onward & F.col("next_activation").isNull(), 27),
            ),
        )
        .when(
            kind == N.AWAITING_APPROVAL,
            F.when(
                ~running
                | open_id.isNotNull()
                | granted
                | ~F.coalesce(needs_approval, F.lit(False))
                | ~in_scope,
                28,
            ),
        )
        .when(
            _types(N.APPROVAL_GRANTED, N.APPROVAL_DENIED),
            F.when((status != "awaiting_approval") | ~in_scope, 29),
        )
        .when(
            kind == N.RUN_FINISHED,
            F.when(
                ~running | open_id.isNotNull() | ~F.col("b_at.node").eqNullSafe(F.lit(N.END_NODE)), 30
            ),
        )
        .when(kind == N.RUN_FAILED, F.when((status != "failed") | open_id.isNotNull(), 31))
        .otherwise(32)
    )


def _lookup_rule() -> Column:
    kind = F.col("type")
    pending = L.source_is(N.EFFECT_INTENT) & ~L.used() & L.same_effect()
    retry = pending & F.coalesce(F.col("retry_safe"), F.lit(False))
    completion = pending & F.col("attempt_id").eqNullSafe(F.col("src.attempt_id"))
    resolution = (
        L.source_is(N.EFFECT_COMPLETED)
        & L.same_effect()
        & F.col("src.source_intent_seq").eqNullSafe(F.col("source_intent_seq"))
    )
    return F.when(
        F.col("names") & F.col("key").isNotNull(),
        F.when((kind == N.EFFECT_INTENT) & ~retry, 20)
        .when((kind == N.EFFECT_COMPLETED) & ~completion, 21)
        .when((kind == N.EFFECT_RESOLVED) & ~resolution, 22)
        .when((kind == N.ACTIVATION_FINISHED) & L.seen(), 27),
    )


def fold(
    events: DataFrame,
    nodes: DataFrame,
    *,
    width: int = GROUP_ROWS,
    hot: HotGroups | None = None,
) -> DataFrame:
    """One row per run: final state when valid, else the first broken rule and its seq."""
    hot = hot or hot_groups(events, ["run_id"], width)
    state = _with_graph(with_prior_state(D.decode(events), hot), nodes)
    final = F.struct(*[F.col(c) for c in AFTER])
    judged = state.select(
        "run_id",
        "seq",
        "type",
        *[c for c in L.SOURCE_FIELDS if c not in ("seq", "type")],
        "source_effect_seq",
        "retry_of_intent_seq",
        "start_activation",
        "next_node",
        "next_activation",
        _state_rule().alias("state_rule"),
        F.when(F.col("segment_end"), final).alias("final"),
    )
    checked = L.with_named_facts(judged, hot)
    per_run = checked.groupBy("run_id").agg(
        F.min(F.least(pack(F.col("state_rule")), pack(_lookup_rule()))).alias("packed"),
        F.max_by("final", F.when(F.col("final").isNotNull(), F.col("seq"))).alias("final"),
        F.count_if("names").alias("n_events"),
        F.count_if(F.col("type") == N.ACTIVATION_FINISHED).alias("n_completed"),
    )
    return shown_states(per_run)


def shown_states(per_run: DataFrame) -> DataFrame:
    """Rows (run_id, packed, final, n_events, n_completed) as the fold shows them; ``final`` holds AFTER."""
    ok = F.col("packed").isNull()
    status = F.coalesce("final.a_status", F.lit("running"))
    shown = {
        "workflow_version": F.col("final.a_version"),
        "status": status,
        "next_node": F.col("final.a_at.node"),
        "activation_id": F.nullif(F.col("final.a_at.act"), F.lit("")),
        "open_attempt_id": F.col("final.a_open.id"),
        "approval_granted": F.coalesce("final.a_granted", F.lit(False)),
        "failure_reason": F.when(status == "failed", F.col("final.a_failure")),
    }
    return per_run.select(
        "run_id",
        rule_name("E").alias("rule"),
        F.expr(f"packed div {RULE_SLOTS}").alias("rule_seq"),
        *[F.when(ok, shown[c]).alias(c) for c in STATE_COLUMNS],
        F.when(ok, F.col("n_completed")).alias("n_completed"),
        "n_events",
    )


def rule_name(letter: str) -> Column:
    number = (F.col("packed") % RULE_SLOTS).cast("string")
    return F.concat(F.lit(letter), F.lpad(number, 2, "0"))


STATE_COLUMNS = (
    "workflow_version",
    "status",
    "next_node",
    "activation_id",
    "open_attempt_id",
    "approval_granted",
    "failure_reason",
)


def _with_graph(state: DataFrame, nodes: DataFrame) -> DataFrame:
    graph = graph_by_version(nodes).withColumnRenamed("workflow_version", "graph_version")
    keyed = state.withColumn("graph_version", F.coalesce("b_version", "a_version"))
    return _with_scope(lookup_join(keyed, graph, ["graph_version"]))
