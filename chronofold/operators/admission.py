"""What may enter a journal, and what a run should do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions.joins import lookup_join, skew_join
from chronofold.functions.running import HotGroups, hot_groups


def admit_events(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Append requests with ``reason``: null when accepted, else why not."""
    known = runs.select("run_id", F.col("schema_version").alias("run_version"))
    joined = skew_join(requests, known, ["run_id"], hot=hot_groups(requests, ["run_id"]))
    payload = F.coalesce(F.col("payload"), F.lit("{}"))
    shape = F.schema_of_variant(X.strict_json(payload))
    reason = (
        F.when(F.col("run_version").isNull() & (F.coalesce("run_id", F.lit("")) != ""), "unregistered_run")
        .when(F.coalesce("run_id", F.lit("")) == "", "empty_run_id")
        .when(F.col("run_version") != N.JOURNAL_VERSION, "unsupported_schema")
        .when(F.coalesce(F.col("at_ns") < 1, F.lit(True)), "bad_time")
        .when(~F.coalesce(shape.startswith("OBJECT"), F.lit(False)), "payload_not_object")
    )
    return joined.withColumn("reason", reason).drop("run_version")


def begin_runs(requests: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """``run_started`` facts for the runs that exist neither as run nor as events.

    ``requests``: request_seq, run_id, input (JSON text), start_node, workflow_version,
    at_ns. The earliest request of a run wins; ids derive from the run, so a repeated
    task writes the same fact.
    """
    fields = ("input", "start_node", "workflow_version", "at_ns")
    first = requests.groupBy("run_id").agg(
        F.min_by(F.struct(*fields), "request_seq").alias("r")
    )
    absent = first.join(runs.select("run_id"), "run_id", "left_anti").join(
        events.select("run_id").distinct(), "run_id", "left_anti"
    )
    activation = X.stable_id("act", F.col("run_id"), F.lit("1"))

    def text(c: Column) -> Column:
        """The value as a JSON string literal."""
        wrapped = F.to_json(F.struct(c.alias("v")))
        return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)

    started = absent.select("run_id", "r.*").withColumn("activation_id", activation)
    payload = F.concat(
        F.lit('{"activation_id":'),
        text(F.col("activation_id")),
        F.lit(',"input":'),
        X.canonical_json(F.col("input")),
        F.lit(f',"journal_schema_version":{N.JOURNAL_VERSION},"start_node":'),
        text(F.col("start_node")),
        F.lit(',"workflow_version":'),
        text(F.col("workflow_version")),
        F.lit("}"),
    )
    return started.select(
        "run_id",
        F.lit(N.RUN_STARTED).alias("type"),
        F.col("start_node").alias("node"),
        "activation_id",
        payload.alias("payload"),
        "at_ns",
    )


def recorded_starts(events: DataFrame) -> DataFrame:
    """What the journal says of the start of each run; one row per run."""
    first_seq = events.groupBy("run_id").agg(F.min("seq").alias("seq"))
    first = events.where(F.col("type") == N.RUN_STARTED).select(
        "run_id", "seq", F.try_parse_json("payload").alias("v"), "payload"
    )
    field = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return first_seq.join(first, ["run_id", "seq"], "left").select(
        "run_id",
        F.lit(True).alias("exists"),
        F.col("v").isNotNull().alias("has_start"),
        field("journal_schema_version", "bigint").alias("old_version"),
        field("workflow_version", "string").alias("old_workflow"),
        field("start_node", "string").alias("old_start"),
        F.sha2(X.canonical_json(F.col("payload"), "input"), 256).alias("old_input"),
    )


def judge_starts(requests: DataFrame, events: DataFrame) -> DataFrame:
    """New, same or conflicting start of each requested run.

    ``requests``: run_id, input, start_node, workflow_version.
    """
    return judge_recorded(requests, recorded_starts(events))


def judge_recorded(requests: DataFrame, recorded: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Like ``judge_starts``, by the starts that were read from the journal before."""
    joined = skew_join(requests, recorded, ["run_id"], hot=hot or hot_groups(requests, ["run_id"]))
    verdict = (
        F.when(F.col("exists").isNull(), "new")
        .when(~F.col("has_start"), "no_run_started")
        .when(~F.col("old_version").eqNullSafe(F.lit(N.JOURNAL_VERSION)), "legacy_schema")
        .when(~F.col("old_workflow").eqNullSafe(F.col("workflow_version")), "other_workflow")
        .when(~F.col("old_start").eqNullSafe(F.col("start_node")), "other_start")
        .when(~F.col("old_input").eqNullSafe(X.fingerprint(F.col("input"))), "other_input")
        .otherwise("same")
    )
    return joined.withColumn("verdict", verdict).select(*requests.columns, "verdict")


def resume_plan(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """The next step of every sound run and the events it would append."""
    graph = nodes.select(
        "workflow_version", F.col("name").alias("next_node"), F.col("requires_approval").alias("gate")
    )
    joined = lookup_join(states.where("rule is null"), graph, ["workflow_version", "next_node"])
    gated = F.coalesce(F.col("gate"), F.lit(False)) & ~F.col("approval_granted")
    step = (
        F.when(F.col("status").isin("finished", "failed"), "nothing")
        .when(F.col("next_node") == N.END_NODE, "finish")
        .when(gated & (F.col("status") == "awaiting_approval"), "wait")
        .when(gated, "ask_approval")
        .when(F.col("open_attempt_id").isNotNull(), "abandon_and_retry")
        .otherwise("start_attempt")
    )
    appends = (
        F.when(F.col("step") == "finish", N.RUN_FINISHED)
        .when(F.col("step") == "ask_approval", N.AWAITING_APPROVAL)
        .when(F.col("step") == "abandon_and_retry", f"{N.ATTEMPT_ABANDONED},{N.ATTEMPT_STARTED}")
        .when(F.col("step") == "start_attempt", N.ATTEMPT_STARTED)
        .otherwise("")
    )
    return joined.withColumn("step", step).withColumn("appends", appends).drop("gate")


def judge_approvals(decisions: DataFrame, states: DataFrame) -> DataFrame:
    """Approval decisions against run states, with the facts an accepted one appends."""
    waiting = states.where("rule is null").select("run_id", "status", "next_node", "activation_id")
    joined = skew_join(decisions, waiting, ["run_id"], hot=hot_groups(decisions, ["run_id"]))
    accepted = F.coalesce(
        (F.col("status") == "awaiting_approval") & F.col("activation_id").isNotNull(), F.lit(False)
    )
    appends = F.when(
        accepted,
        F.when(F.col("granted"), N.APPROVAL_GRANTED).otherwise(f"{N.APPROVAL_DENIED},{N.RUN_FAILED}"),
    ).otherwise("")
    return joined.select(
        *decisions.columns, accepted.alias("accepted"), "next_node", "activation_id", appends.alias("appends")
    )
