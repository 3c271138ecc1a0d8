"""Queries over whole runs, span trees, documents and artifact chains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions import stats
from chronofold.functions.storage import cut, fresh_path
from chronofold.operators import admission, artifacts, documents, effects, exports, graph, readback, redaction, registered, state, stored_states, trees
from chronofold.operators.projection import attributes_json, project, projection_rules
from chronofold.plans import inputs as I
from chronofold.plans.registry import query
from chronofold.plans.relational import (
    CALLS_SQL,
    FROZEN_SQL,
    HISTOGRAM_SQL,
    SOURCE_FACTS_SQL,
    STARTS_SQL,
    UNIQUE_SQL,
    bucket_counts,
    call_table,
    frozen_and_current,
    source_facts,
    start_requests,
)
from chronofold.plans.scans import FOLD_SQL

def shown(df):
    """Run states without nulls, for comparison."""
    return df.select(
        *[c for c in df.columns if c in ("run_id", "at_seq")],
        F.coalesce("rule", F.lit("none")).alias("rule"),
        F.coalesce(F.col("rule_seq"), F.lit(-1)).alias("rule_seq"),
        *[F.coalesce(c, F.lit("none")).alias(c) for c in ("status", "next_node", "activation_id", "open_attempt_id", "failure_reason")],
        F.coalesce("approval_granted", F.lit(False)).alias("approval_granted"),
        F.coalesce("n_completed", F.lit(-1)).alias("n_completed"),
        "n_events",
    )


# Where the first broken rule of a damaged fixture run sits.
BROKEN_AT = "k * 32 + case tkey when 11 then 4 when 12 then 20 when 13 then 8 when 14 then 8 when 15 then 9 when 16 then 14 end"
RULE = "case tkey when 11 then 'E03' when 12 then 'E11' when 13 then 'E21' when 14 then 'E21' when 15 then 'E21' when 16 then 'E22' end"

REPLAY_SQL = f"""req as (select 'run-' || o_orderkey as run_id, o_orderkey * 32 + 2 + o_custkey % 18 as at_seq from orders),
  pre as (select f.*, r.at_seq from facts f join req r on f.run_id = r.run_id and f.seq <= r.at_seq),
  rep as (select run_id, at_seq, max(k) as k, max(tkey) as tkey, max(workflow) as workflow, count(*) as n_events,
    max({RULE}) filter (where at_seq >= {BROKEN_AT}) as rule, max({BROKEN_AT}) filter (where at_seq >= {BROKEN_AT}) as rule_seq,
    coalesce(arg_max(case type when 'awaiting_approval' then type when 'approval_granted' then 'running' when 'run_finished' then 'finished' else 'failed' end, seq)
      filter (where type in ('attempt_failed', 'approval_denied', 'awaiting_approval', 'approval_granted', 'run_finished')), 'running') as status,
    arg_max(coalesce(next_node, 'settle'), seq) filter (where type in ('run_started', 'activation_finished')) as next_node,
    arg_max(case when type = 'run_started' then activation_id when next_act is null then '' else 'act-' || k || '-' || next_act end, seq) filter (where type in ('run_started', 'activation_finished')) as act,
    arg_max(case when type = 'attempt_started' then attempt_id else '' end, seq) filter (where type in ('attempt_started', 'attempt_abandoned', 'attempt_failed', 'activation_finished')) as open_id,
    coalesce(arg_max(type = 'approval_granted', seq) filter (where type in ('approval_granted', 'activation_finished', 'awaiting_approval')), false) as granted,
    count(*) filter (where type = 'activation_finished') as n_completed from pre group by 1, 2),
  shown as (select *, case when tkey = 8 then 'approval denied' else 'EffectError: settle' end as reason from rep)"""

SHOWN_SQL = """coalesce(rule, 'none') as rule, coalesce(rule_seq, -1) as rule_seq, case when rule is null then status else 'none' end as status,
  case when rule is null then next_node else 'none' end as next_node, case when rule is null then coalesce(nullif(act, ''), 'none') else 'none' end as activation_id,
  case when rule is null then coalesce(nullif(open_id, ''), 'none') else 'none' end as open_attempt_id,
  case when rule is null and status = 'failed' then reason else 'none' end as failure_reason, rule is null and granted as approval_granted,
  case when rule is null then n_completed else -1 end as n_completed, n_events"""

FULL_SQL = REPLAY_SQL.replace("o_orderkey * 32 + 2 + o_custkey % 18 as at_seq", "o_orderkey * 32 + 31 as at_seq")


@query("v01_fold", f"with {FULL_SQL} select run_id, {SHOWN_SQL} from shown", on="journal")
def _(s, d):
    return shown(I.states(s, d))


def _requests(s, d):
    return s.read.parquet(f"{d}/orders.parquet").selectExpr(
        "'run-' || o_orderkey as run_id", "o_orderkey * 32 + 2 + o_custkey % 18 as at_seq"
    )


def replayed(s, d):
    return state.replay(I.journal(s, d), _requests(s, d), I.graph_nodes(s))


@query("v02_replay_of_prefix", f"with {REPLAY_SQL} select run_id, at_seq, {SHOWN_SQL} from shown", on="journal")
def _(s, d):
    return shown(replayed(s, d))


@query("v02_replay_from_states", f"with {REPLAY_SQL} select run_id, at_seq, {SHOWN_SQL} from shown", on="journal")
def _(s, d):
    """Slots of 8 sequence numbers, so that most requests of these short runs begin at a state."""
    journal, nodes = I.journal(s, d), I.graph_nodes(s)
    folder = fresh_path(s, "states")
    stored_states.store_states(journal, nodes, every=8).write(folder)
    stored = stored_states.StoredStates.read(s, folder, 8)
    return shown(stored_states.replay_from_states(journal, _requests(s, d), nodes, stored))


@query(
    "v03_resume_plan",
    f"""with {REPLAY_SQL}, steps as (select *, workflow = 'gated/v1' and next_node = 'settle' and not granted as gated from shown where rule is null)
        select run_id, case when status in ('finished', 'failed') then 'nothing' when next_node = '__end__' then 'finish' when gated and status = 'awaiting_approval' then 'wait'
          when gated then 'ask_approval' when coalesce(open_id, '') <> '' then 'abandon_and_retry' else 'start_attempt' end as step,
        case when status in ('finished', 'failed') then '' when next_node = '__end__' then 'run_finished' when gated and status = 'awaiting_approval' then ''
          when gated then 'awaiting_approval' when coalesce(open_id, '') <> '' then 'attempt_abandoned,attempt_started' else 'attempt_started' end as appends from steps""",
    on="journal",
)
def _(s, d):
    return admission.resume_plan(replayed(s, d), I.graph_nodes(s)).select("run_id", "step", "appends")


@query(
    "v04_approval_admission",
    """select run_id, k % 24 = 10 as granted, tkey = 10 as accepted, case when tkey <> 10 then '' when k % 24 = 10 then 'approval_granted' else 'approval_denied,run_failed' end as appends
       from (select distinct run_id, k, tkey from facts)""",
    on="journal",
)
def _(s, d):
    decisions = I.run_facts(s, d).select("run_id", (F.col("k") % 24 == 10).alias("granted"))
    return admission.judge_approvals(decisions, I.states(s, d)).select("run_id", "granted", "accepted", "appends")


@query("v05_start_admission", f"with v as ({STARTS_SQL}) select run_id, verdict, verdict in ('new', 'same') as admitted from v", on="journal")
def _(s, d):
    judged = admission.judge_starts(start_requests(s, d), I.journal(s, d))
    return judged.select("run_id", "verdict", F.col("verdict").isin("new", "same").alias("admitted"))


@query(
    "v06_effect_ledger",
    """with f as (select *, k * 32 + src_off as source_seq from facts where type like 'effect%'),
         p as (select run_id, activation_id, max(seq) as pending, arg_max(retry_safe, seq) as safe from f i where type = 'effect_intent'
           and not exists (select 1 from f c where c.run_id = i.run_id and c.type = 'effect_completed' and c.source_seq = i.seq) group by 1, 2)
       select f.run_id, f.activation_id, 'settle' as effect_id, count(*) filter (where type = 'effect_intent') as intents, count(*) filter (where type = 'effect_completed') as completions,
         count(*) filter (where type = 'effect_resolved') as resolutions, coalesce(max(p.pending), -1) as pending_intent_seq, coalesce(bool_or(p.safe), false) as retry_allowed
       from f left join p on f.run_id = p.run_id and f.activation_id = p.activation_id group by 1, 2""",
    on="journal",
)
def _(s, d):
    ledger = effects.effect_ledger(I.decoded(s, d))
    return ledger.withColumns(
        {"pending_intent_seq": F.coalesce("pending_intent_seq", F.lit(-1)), "retry_allowed": F.coalesce("retry_allowed", F.lit(False))}
    )


@query(
    "v07_identity_mismatch",
    f"with {CALLS_SQL} select run_id, case kind when 1 then 'label' when 2 then 'request_fingerprint' else 'effect_id' end as mismatched from plan where verdict = 'identity_mismatch'",
    on="journal",
)
def _(s, d):
    plan = effects.plan_calls(effects.call_requests(call_table(s, d)), I.decoded(s, d))
    return plan.where("verdict = 'identity_mismatch'").select("run_id", "mismatched")


def settle(batch: pd.DataFrame) -> pd.Series:
    """A stand-in for an external provider: answers with the amount it was asked for."""
    return '{"settled":' + batch["request"].str.extract(r":(\d+)", expand=False) + "}"


EXECUTED_SQL = f"""with {CALLS_SQL}, amount as (select run_id, max(cents) as cents from facts group by 1)
  select p.run_id, case when kind = 3 then 'other' else 'settle' end as effect_id, '{{"settled":' || case when kind = 2 then 1 else a.cents end || '}}' as result
  from plan p join amount a on p.run_id = a.run_id where verdict = 'execute'"""


def _executed(s, d):
    plan = effects.plan_calls(effects.call_requests(call_table(s, d)), I.decoded(s, d))
    now = F.col("call_order") + 1
    return effects.run_calls(plan, settle, now, now + 1).select("run_id", "effect_id", "result")


@query("v08_resolve_or_execute", EXECUTED_SQL, on="journal")
def _(s, d):
    return _executed(s, d)


@query(
    "v09_idempotent_apply",
    f"""with {I.ATTEMPTS_SQL}, kept as (select idempotency_key, arg_min(amount_cents, seq) as cents from attempts group by 1)
        select a.seq, a.idempotency_key, case when k.cents = a.amount_cents then 'applied' else 'conflict' end as verdict from attempts a join kept k on a.idempotency_key = k.idempotency_key""",
    on="journal",
)
def _(s, d):
    return effects.apply_once(I.attempts(s, d))[1].select("seq", "idempotency_key", "verdict")


@query(
    "v10_projection_rules",
    """select run_id, case tkey when 8 then 'P15' when 10 then 'P15' when 11 then 'P03' when 12 then 'P04' when 13 then 'P10' when 14 then 'P10' when 15 then 'P10' when 16 then 'P11' else 'none' end as rule,
         case when tkey > 10 then k * 32 + case tkey when 11 then 4 when 12 then 20 when 13 then 8 when 14 then 8 when 15 then 9 else 14 end else -1 end as rule_seq
       from (select distinct run_id, k, tkey from facts)""",
    on="journal",
)
def _(s, d):
    rules = projection_rules(I.journal(s, d))
    return rules.select("run_id", F.coalesce("rule", F.lit("none")).alias("rule"), F.coalesce("rule_seq", F.lit(-1)).alias("rule_seq"))


def span_columns(spans):
    """Spans without nulls, for comparison."""
    return spans.select(
        "mode",
        "run_id",
        "identity",
        "name",
        "trace_id",
        "span_id",
        F.coalesce("parent_span_id", F.lit("none")).alias("parent_span_id"),
        F.col("start_time_ns").alias("start_ns"),
        F.col("end_time_ns").alias("end_ns"),
        "status",
        "classification",
        attributes_json().alias("attributes"),
        F.coalesce(F.get("links", F.lit(0))["span_id"], F.lit("none")).alias("link_span_id"),
    )


@query(
    "v11_span_projection",
    """select mode, run_id, identity, name, trace_id, span_id, coalesce(parent_span_id, 'none') as parent_span_id, start_ns, end_ns, status, classification, attributes,
       coalesce(link_span_id, 'none') as link_span_id from spans""",
    on="spans",
)
def _(s, d):
    return span_columns(I.spans(s, d))


@query(
    "v12_registered_journal",
    "select run_id, case when tkey = 1 then 'none' when tkey = 14 then 'none' when tkey = 16 then 'source_chain' else 'event_counts' end as broken from (select distinct run_id, tkey from facts)",
    on="journal",
)
def _(s, d):
    return registered.check_registered(I.journal(s, d)).select("run_id", F.coalesce("broken", F.lit("none")).alias("broken"))


def damaged_trees(s, d):
    """Span tables with one tree defect per run, chosen by ``(k div 12) % 8``."""
    k = I.order_key()
    plain = ("run_id", "mode", "family", "identity", "name", "kind", "classification", "links")
    ids = ("trace_id", "span_id", "parent_span_id", "start_time_ns", "end_time_ns", "duration_ns")
    read = I.attributes("operation_name", "workflow_version", "node", "attempt_outcome", "attempt_recovery")
    sent = cut(I.spans(s, d).select(*plain, *ids, read)).withColumn("_kind", F.expr("cast(substring(run_id, 5) as bigint) div 12 % 8"))
    kind, run, mode = F.col("_kind"), F.col("run_id"), F.col("mode")
    name = lambda n: F.concat(F.lit("attempt:att-"), k.cast("string"), F.lit(f"-{n}"))
    first, second = F.col("identity") == name(1), F.col("identity") == name(2)
    id1, id2 = X.span_id(run, mode, name(1)), X.span_id(run, mode, name(2))
    run_ns = F.lit(20_000_000)  # longer than any fixture run
    cycle = (kind == 7) & (first | second)
    sent = sent.withColumns(
        {
            "span_id": F.when((kind == 1) & second, id1).otherwise(F.col("span_id")),
            "parent_span_id": F.when((kind == 2) & second, F.lit(None).cast("string"))
            .when((kind == 4) & first, F.lit("0123456789abcdef"))
            .when((kind == 7) & first, id2)
            .when((kind == 7) & second, id1)
            .otherwise(F.col("parent_span_id")),
            "trace_id": F.when((kind == 3) & first, F.lit("f" * 32)).otherwise(F.col("trace_id")),
            "duration_ns": F.when((kind == 5) & first, F.col("duration_ns") + 1).otherwise(F.col("duration_ns")),
            "_shift": F.when((kind == 6) & first, run_ns).otherwise(0),
        }
    )
    start, end = F.col("start_time_ns"), F.col("end_time_ns")
    sent = sent.withColumn("start_time_ns", F.when(cycle, start - run_ns).otherwise(start - F.col("_shift")))
    sent = sent.withColumn("end_time_ns", F.when(cycle, end + run_ns).otherwise(end))
    changed = cycle | (F.col("_shift") > 0)
    sent = sent.withColumn("duration_ns", F.when(changed, F.col("end_time_ns") - F.col("start_time_ns")).otherwise(F.col("duration_ns")))
    # In the cycle both attempts get one and the same interval.
    both = F.expr("max(case when _kind = 7 and family = 1 then end_time_ns end) over (partition by run_id, mode)")
    low = F.expr("min(case when _kind = 7 and family = 1 then start_time_ns end) over (partition by run_id, mode)")
    sent = sent.withColumns({"_low": low, "_high": both})
    sent = sent.withColumns(
        {
            "start_time_ns": F.when((kind == 7) & (F.col("family") == 1), F.col("_low")).otherwise(F.col("start_time_ns")),
            "end_time_ns": F.when((kind == 7) & (F.col("family") == 1), F.col("_high")).otherwise(F.col("end_time_ns")),
        }
    )
    seven = (kind == 7) & (F.col("family") == 1)
    sent = sent.withColumn("duration_ns", F.when(seven, F.col("end_time_ns") - F.col("start_time_ns")).otherwise(F.col("duration_ns")))
    return sent.drop("_kind", "_shift", "_low", "_high")


@query(
    "v13_span_tree_check",
    """with r as (select run_id, mode, tkey, (k // 12) % 8 as kind, count(*) as n from spans group by 1, 2, 3, 4)
       select run_id, mode, n as spans, case when n <> 5 then 'span_count' else case kind when 1 then 'duplicate_span_id' when 2 then 'root_count' when 3 then 'trace_id_changed'
         when 4 then 'missing_parent' when 5 then 'bad_interval' when 6 then 'escapes_parent' when 7 then 'not_connected' else case tkey when 1 then 'none' else 'root_contract' end end end as broken from r""",
    on="spans",
)
def _(s, d):
    sent = damaged_trees(s, d)
    checked = trees.check_trees(sent, workflow="settle/v1", node="settle")
    return checked.select("run_id", "mode", "spans", F.coalesce("broken", F.lit("none")).alias("broken"))


@query(
    "v14_arm_comparison_check",
    """with c as (select run_id, max(tkey) as tkey, count(*) filter (where mode = 'aware' and classification = 'executed') as a, count(*) filter (where mode = 'aware' and classification = 'resolved') as r,
         count(*) filter (where mode = 'control' and classification = 'executed') as c from spans group by 1)
       select run_id, a as aware_executed, r as aware_resolved, c as control_executed, case when a <> 1 or r <> 1 then 'aware_counts' when c <> 2 then 'control_counts' else 'none' end as broken from c""",
    on="spans",
)
def _(s, d):
    checked = trees.compare_arms(cut(I.spans(s, d)), effect_id="settle", label="payments:settle", adapter_version="store/v1")
    return checked.select("run_id", "aware_executed", "aware_resolved", "control_executed", F.coalesce("broken", F.lit("none")).alias("broken"))


VERIFY_SQL = f"""{UNIQUE_SQL}, verified as (select s.trace_id, s.run_id, s.mode, s.n as spans_sent, d.got as spans_retrieved, d.missing, d.unexpected, d.mismatched, d.dup as duplicate_rows,
    d.missing = 0 and d.unexpected = 0 and d.mismatched = 0 as identity_verified, d.att as attributes_verified, d.lo = 'chronofold-' || s.mode and d.hi = 'chronofold-' || s.mode as service_verified
  from (select trace_id, run_id, mode, count(*) as n from spans group by 1, 2, 3) s join (select trace_id, count(service_name) as got, count(*) filter (where verdict = 'missing') as missing,
    count(*) filter (where verdict = 'unexpected') as unexpected, count(*) filter (where verdict = 'mismatched') as mismatched, cast(coalesce(sum(copies - 1), 0) as bigint) as dup,
    bool_and(coalesce(attributes_equal, false)) as att, min(service_name) as lo, max(service_name) as hi from diff group by 1) d on s.trace_id = d.trace_id)"""


@query(
    "v15_readback_verification",
    f"with {VERIFY_SQL} select *, identity_verified and attributes_verified and service_verified and duplicate_rows = 0 as verified from verified",
    on="store",
)
def _(s, d):
    sent = cut(I.store_columns(I.spans(s, d)))
    return readback.verify_readback(sent, I.damaged_store(sent)).drop("plan_sound")


def retained(s, d):
    """Proofs of every trace with one disagreement per run, chosen by ``k % 6``."""
    sent = cut(I.store_columns(I.spans(s, d), "end_time_ns"))
    kind = I.order_key() % 6
    proofs = readback.query_windows(sent, F.count("*").alias("n")).select(
        "run_id",
        "mode",
        F.concat(F.lit("trace_id = '"), "trace_id", F.when(kind == 1, " ").otherwise(""), F.lit("'")).alias("expression"),
        "start_ms",
        F.when(kind == 2, F.col("end_ms") + 1).otherwise(F.col("end_ms")).alias("end_ms"),
        "row_limit",
        F.col("n").alias("spans_sent"),
        F.when(kind == 4, F.col("n") - 1).otherwise(F.col("n")).alias("spans_retrieved"),
        F.lit(0).alias("duplicate_rows"),
        "trace_id",
        F.when(kind == 5, 0).otherwise(1).alias("query_attempts"),
        *[F.lit(True).alias(c) for c in ("verified", "identity_verified", "attributes_verified", "service_verified")],
    )
    rows = readback.retained_fields(sent)
    root = F.col("operation_name") == "run"
    rows = rows.withColumn("name", F.when((kind == 3) & root, "renamed").otherwise(F.col("name")))
    return proofs, rows, sent


@query(
    "v16_retained_proofs",
    """select distinct run_id, mode, case k % 6 when 1 then 'request_differs' when 2 then 'request_differs' when 3 then 'rows_differ' when 4 then 'summary_differs'
       when 5 then 'bad_attempts' else 'none' end as broken from spans""",
    on="spans",
)
def _(s, d):
    return readback.verify_retained(*retained(s, d)).select("run_id", "mode", F.coalesce("broken", F.lit("none")).alias("broken"))


GOOD_SQL = "good as (select k, run_id from (select distinct k, run_id, c, tkey from facts) where tkey = 1 and k % 10 in (6, 7, 8, 9) and c % 50 <> 0)"


def built(s, d):
    """Evidence documents of the runs whose traces read back exactly."""
    events = I.journal(s, d)
    a = I.attempts(s, d).groupBy("run_id").agg(
        F.count("*").alias("provider_attempts"), F.count_distinct("idempotency_key").alias("business_executions")
    )
    # Only runs that pass the gates on their events can have a document, so only they are projected.
    likely = cut(documents.likely_runs(events, a))
    sent = cut(project(events, runs=likely.select("run_id")))
    hashed = F.sha2("run_id", 256)
    provenance = I.runs(s, d).select(
        "run_id",
        F.struct(
            F.concat(F.lit("journals/"), "run_id").alias("journalPath"),
            hashed.alias("journalSha256"),
            F.lit(7).alias("lineageCheckedArtifacts"),
            F.lit("v1-test").alias("lineageId"),
            F.lit("lineage/inputs.json").alias("lineageInputsPath"),
            hashed.alias("lineageInputsSha256"),
            F.lit(None).cast("string").alias("lineageManifestPath"),
            F.lit(None).cast("string").alias("lineageManifestSha256"),
            F.lit(True).alias("lineageCandidate"),
            F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))").alias("phaseReceipts"),
        ).alias("provenance"),
    )
    return documents.build_documents(events, sent, I.damaged_store(sent), a, provenance, likely=likely)


@query(
    "k07_evidence_document",
    f"""with {GOOD_SQL}, w as (select s.run_id, max(case when mode = 'aware' then trace_id end) as aware_trace, max(case when mode = 'control' then trace_id end) as control_trace,
          greatest(0, min(start_ns) // 1000000 - 300000)::bigint as start_ms, string_agg(attributes, '|' order by seq) filter (where mode = 'aware') as a,
          string_agg(span_id, '|' order by span_id) filter (where mode = 'control') as ids
        from spans s join good g on s.run_id = g.run_id group by 1)
        select run_id, aware_trace, control_trace, start_ms, sha256(a) as attributes_sha256, ids as control_row_ids, 9::bigint as events from w""",
    on="spans",
)
def _(s, d):
    docs = documents.parse_documents(built(s, d))
    by_seq = F.array_sort(
        F.transform(F.col("d.aware.spans"), lambda x: F.struct(x["start_time_unix_nano"].alias("t"), x["identity"].alias("i"), F.to_json(x["attributes"]).alias("a")))
    )
    # Effects and attempts share no start time in the fixture except an intent, so order by time.
    return docs.select(
        "run_id",
        F.col("d.aware.traceId").alias("aware_trace"),
        F.col("d.control.traceId").alias("control_trace"),
        F.col("d.queryBack.aware.request.start").alias("start_ms"),
        F.sha2(F.array_join(F.transform(by_seq, lambda x: x["a"]), "|"), 256).alias("attributes_sha256"),
        F.array_join(F.transform(F.col("d.queryBack.control.selectedRows"), lambda r: r["spanId"]), "|").alias("control_row_ids"),
        F.size("d.journal.events").cast("bigint").alias("events"),
    )


@query(
    "k10_flat_summary",
    f"""with {GOOD_SQL} select 2::bigint as schema_version, run_id, 9::bigint as hard_exit_code, 2::bigint as activation_attempts, 1::bigint as effect_intents, 1::bigint as effect_completions,
        1::bigint as journal_resolutions, 1::bigint as provider_attempts, 1::bigint as business_executions, 1::bigint as aware_executed_effect_spans, 1::bigint as aware_resolved_effect_spans,
        2::bigint as control_executed_effect_spans, true as query_back_verified, 'v1-test' as lineage_id from good""",
    on="spans",
)
def _(s, d):
    flat = documents.flat_summary(built(s, d))
    ok = F.col("query_back.aware.verified") & F.col("query_back.control.verified")
    return flat.withColumn("query_back_verified", ok).withColumn("lineage_id", F.col("provenance.lineageId")).drop("query_back", "provenance")


@query("v17_document_gates", f"with {GOOD_SQL} select g.run_id, 0::bigint as issues from good g", on="spans")
def _(s, d):
    docs = cut(built(s, d))
    issues = documents.document_issues(docs).groupBy("run_id").agg(F.count("*").alias("issues"))
    return docs.select("run_id").join(issues, "run_id", "left").fillna(0)


# (kind, text to find, text to put, expected issues)
_MUTATIONS = (
    ('"hardExitCode":9', '"hardExitCode":8', (("hardExitCode", "exit_code"),)),
    ('"seed":23', '"seed":20000', (("seed", "seed_range"),)),
    ('"status":"finished"', '"status":"open"', (("status", "status"),)),
    ('"providerAttempts":1', '"providerAttempts":2', (("groundTruth.providerAttempts", "ground_truth"),)),
    ('"awareResolvedEffectSpans":1', '"awareResolvedEffectSpans":3', (("comparison.awareResolvedEffectSpans", "comparison"),)),
    ('{"schemaVersion"', '{"extra":1,"schemaVersion"', (("", "unknown_key"),)),
    ('"result":{"redacted":true}', '"result":{"a":1}', (("journal.events.3.payload.result", "not_redacted"),)),
    ('"verified":true', '"verified":false', (("queryBack.aware.verified", "proof_flag"), ("queryBack.control.verified", "proof_flag"))),
    ("chronofold-control", "other", (("control.serviceName", "service_name"),)),
    ('"duplicateRows":0', '"duplicateRows":1', (("queryBack.aware.duplicateRows", "proof_duplicates"), ("queryBack.control.duplicateRows", "proof_duplicates"))),
    ("store/v1", "store/v2", (("journal.events", "effect_contract"),)),
    ('"run_finished"', '"run_failed"', (("journal.events", "count_run_finished"), ("journal.events", "unexpected_type"))),
    ('"limit":100', '"limit":99', (("queryBack.aware.request", "proof_request"), ("queryBack.control.request", "proof_request"))),
    ("flow.node.name", "gen_ai.node", (("", "forbidden_attribute"),)),
    ('"lineageCandidate":true', '"lineageCandidate":false', (("provenance", "provenance_kind"),)),
)
_EXPECTED_ISSUES = ", ".join(f"({i + 1}, '{p}', '{c}')" for i, (_f, _t, found) in enumerate(_MUTATIONS) for p, c in found)


def mutated(s, d):
    """Documents with one damaged text each, chosen by ``(k div 12) % 17``."""
    kind = F.expr("cast(substring(run_id, 5) as bigint) div 12 % 17")
    body = F.col("body")
    text = F.when(kind == 16, F.substring("body", 1, 100))
    for i, (find, put, _found) in enumerate(_MUTATIONS):
        text = text.when(kind == i + 1, F.replace(body, F.lit(find), F.lit(put)))
    return cut(built(s, d)).withColumn("body", text.otherwise(body))


@query(
    "v18_document_issues",
    f"with {GOOD_SQL}, m as (select * from (values {_EXPECTED_ISSUES}, (16, '', 'not_json')) t(kind, path, code)) select g.run_id, m.path, m.code from good g join m on (g.k // 12) % 17 = m.kind",
    on="spans",
)
def _(s, d):
    return documents.document_issues(mutated(s, d))


@query(
    "v19_old_documents",
    """select event_id, 'run-' || event_id as run_id, 'control' as second_mode, '1785000000000000001' as start_text, '1785000000000000008' as end_text, '7' as duration_text,
       2::bigint as control_executed, 'none' as duplicate_rows from events where event_id % 2 = 0""",
)
def _(s, d):
    out = documents.normalize_old(I.two_versions(s, d))
    span = F.get("aware.spans", F.lit(0))
    return out.select(
        "event_id",
        F.col("runId").alias("run_id"),
        F.col("control.mode").alias("second_mode"),
        span["start_time_unix_nano"].alias("start_text"),
        span["end_time_unix_nano"].alias("end_text"),
        span["duration_nano"].alias("duration_text"),
        F.col("comparison.controlExecutedEffectSpans").alias("control_executed"),
        F.coalesce(F.col("queryBack.aware.duplicateRows").cast("string"), F.lit("none")).alias("duplicate_rows"),
    )


@query(
    "v20_redaction_audit",
    """select seq, case when type = 'run_started' then 'input' when type in ('attempt_abandoned', 'run_failed') then 'reason' when type = 'attempt_failed' then 'error' when type = 'effect_completed' then 'result'
       when type = 'activation_finished' then 'patch' when type in ('awaiting_approval', 'run_finished') then 'state' else 'by' end as field from facts
       where k % 3 = 0 and type not in ('attempt_started', 'effect_intent', 'effect_resolved')""",
    on="journal",
)
def _(s, d):
    shown = F.when(I.order_key() % 3 == 0, F.col("payload")).otherwise(redaction.public_payload())
    return redaction.unmasked_fields(I.journal(s, d).withColumn("payload", shown)).select("seq", "field")


def graphs(s, d):
    """One small graph per order with one defect each, chosen by ``k % 7``."""
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.expr("'w' || o_orderkey as workflow_version"))
    kind = F.col("k") % 7
    pair = lambda *names: F.array(*[F.lit(n) for n in names])
    names = F.when(kind == 6, pair("a", "b", "b")).otherwise(pair("a", "b"))
    nodes = o.select("workflow_version", F.explode(names).alias("name"))
    edge = lambda f, t, p=1: F.struct(F.lit(f).alias("from_node"), F.lit(p).alias("priority"), F.lit(None).cast("string").alias("predicate"), F.lit(t).alias("target"))
    good = [edge("a", "b"), edge("b", N.END_NODE)]
    edges = (
        F.when(kind == 2, F.array(good[0]))
        .when(kind == 3, F.array(*good, edge("q", "a")))
        .when(kind == 4, F.array(edge("a", "nowhere"), good[1]))
        .when(kind == 5, F.array(*good, edge("a", "b")))
        .otherwise(F.array(*good))
    )
    routes = o.select("workflow_version", F.explode(edges).alias("e")).select("workflow_version", "e.*")
    starts = o.select("workflow_version", F.when(kind == 1, "z").otherwise("a").alias("start"))
    return nodes, routes, starts


@query(
    "v21_graph_validation",
    """select 'w' || o_orderkey as workflow_version, case o_orderkey % 7 when 1 then 'start_not_defined' when 2 then 'node_without_route' when 3 then 'route_from_undefined_node'
         when 4 then 'edge_points_nowhere' when 5 then 'duplicate_route' else 'duplicate_node' end as problem,
       case o_orderkey % 7 when 1 then 'z' when 2 then 'b' when 3 then 'q' when 4 then 'nowhere' when 5 then 'a' else 'b' end as subject from orders where o_orderkey % 7 > 0""",
)
def _(s, d):
    return graph.graph_problems(*graphs(s, d))


ROUTES_SQL = """select o_orderkey as k, case when o_orderkey % 4 = 3 then '__end__' when o_orderkey % 4 = 2 then '__end__' when o_custkey % 3 < 2 then 'settle' else '__end__' end as target,
  'none' as route_error from orders"""


def moving(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.selectExpr(
        "o_orderkey as k",
        "case when o_orderkey % 4 = 2 then 'settle/v1' else 'loop/v1' end as workflow_version",
        "case when o_orderkey % 4 = 3 then 'ghost' else 'settle' end as node",
        "o_custkey % 3 as visit",
    )


@query("v22_next_step", ROUTES_SQL)
def _(s, d):
    out = graph.next_nodes(moving(s, d), I.graph_routes(s), I.graph_nodes(s), ["visit < 2"])
    return out.select("k", "target", F.coalesce("route_error", F.lit("none")).alias("route_error"))


@query(
    "v23_artifact_audit",
    f"""with {FROZEN_SQL}, f as (select grp, path, count(*) as listed, min(sha256) as sha256, min(bytes) as bytes from frozen group by 1, 2),
          p as (select path, min(sha256) <> max(sha256) or min(bytes) <> max(bytes) as conflict from frozen group by 1)
        select coalesce(f.grp, n.grp) as "group", coalesce(f.path, n.path) as path, case when f.path is null then 'missing_from_inputs' when f.path like '%/../%' then 'path_not_canonical'
          when listed > 1 and not conflict then 'duplicate_path' when conflict then 'reference_conflict' when n.path is null then 'artifact_missing' when n.bytes <> f.bytes then 'size_mismatch'
          when n.sha256 <> f.sha256 then 'hash_mismatch' else 'ok' end as verdict
        from f full outer join now n on f.grp = n.grp and f.path = n.path left join p on p.path = f.path""",
)
def _(s, d):
    return artifacts.audit_artifacts(*frozen_and_current(s, d))


@query(
    "v24_receipt_chain_audit",
    """select o_orderkey as lineage_id, case o_orderkey % 12 when 0 then 'none' when 1 then 'receipt_schema' when 2 then 'lineage_mismatch' when 3 then 'inputs_mismatch' when 4 then 'not_pass'
         when 5 then 'criteria_invalid' when 6 then 'criteria_invalid' when 7 then 'criteria_invalid' when 8 then 'chain_broken' when 9 then 'evidence_mismatch' else 'phase_policy' end as failure,
       o_orderkey % 12 = 0 as ready from orders""",
)
def _(s, d):
    receipts, inputs, evidence = I.receipt_chains(s, d)
    short = receipts.where(~((F.col("lineage_id") % 12 == 11) & (F.col("position") == 2)))
    return artifacts.audit_receipts(short, inputs, evidence).withColumn("failure", F.coalesce("failure", F.lit("none")))


@query(
    "v25_export_identity",
    """select run_id, mode, case when k % 4 = 0 or k % 4 = 2 then 1 else 0 end::bigint as lost, case when k % 4 = 2 then 1 else 0 end::bigint as foreign_ids,
       case when k % 4 = 1 then 1 else 0 end::bigint as repeated, k % 4 = 3 as identity_match from (select distinct run_id, k, mode from spans)""",
    on="spans",
)
def _(s, d):
    sent = cut(I.spans(s, d))
    kind, root = I.order_key() % 4, F.col("family") == 0
    copies = F.when(root & (kind == 0), F.array().cast("array<int>")).when(root & (kind == 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    written = sent.withColumn("copy", F.explode(copies)).withColumn(
        "span_id", F.when(root & (kind == 2), F.reverse("span_id")).otherwise(F.col("span_id"))
    )
    return exports.check_exported(sent, written).select(
        "run_id", "mode", "lost", F.col("foreign").alias("foreign_ids"), "repeated", "identity_match"
    )


@query(
    "v26_delivery_audit",
    """select 'run-' || o_orderkey as run_id, m.mode, case o_orderkey % 6 when 1 then 'staged_differs' when 2 then 'snapshot_not_bound' when 3 then 'final_not_delivered'
       when 4 then 'receipt_not_delivered' when 5 then 'receipt_not_delivered' else 'none' end as failure from orders cross join (values ('aware'), ('control')) m(mode)""",
)
def _(s, d):
    k = I.order_key() % 6
    arms = I.runs(s, d).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in N.MODES]))).select("run_id", "mode")
    h = lambda salt: F.sha2(F.concat(F.lit(salt), "run_id", "mode"), 256)
    result = F.when(k == 4, "FAILURE").otherwise("SUCCESS")
    outcomes = arms.select(
        "run_id", "mode", F.lit("http://127.0.0.1:4318/v1/traces").alias("endpoint"), result.alias("result"), (k != 5).alias("cleanup_ok")
    )
    deliveries = exports.delivery_receipts(outcomes).withColumn("sha256", h("d")).withColumn("bytes", F.lit(20).cast("bigint"))
    staged = arms.select("run_id", "mode", h("spans").alias("spans_sha256"), h("s").alias("sha256"), F.lit(10).cast("bigint").alias("bytes"))
    finals = arms.select(
        "run_id",
        "mode",
        F.when(k == 1, "x").otherwise(h("spans")).alias("spans_sha256"),
        F.struct(F.when(k == 2, "x").otherwise(h("s")).alias("sha256"), F.lit(10).cast("bigint").alias("bytes")).alias("staged"),
        F.struct(h("d").alias("sha256"), F.lit(20).cast("bigint").alias("bytes")).alias("delivery"),
        F.struct(
            F.lit(True).alias("attempted"),
            (k != 3).alias("acknowledged"),
            F.lit("DELIVERED").alias("state"),
            F.lit("SUCCESS").alias("result"),
            F.lit("SUCCESS").alias("cleanup_state"),
        ).alias("otlp"),
    )
    return exports.audit_delivery(finals, staged, deliveries).withColumn("failure", F.coalesce("failure", F.lit("none")))


@query(
    "v27_view_differences",
    "select s.run_id, s.mode, s.identity, s.classification from spans s join spans r on r.run_id = s.run_id and r.classification = 'resolved' and r.attempt_id = s.attempt_id where s.family > 1",
    on="spans",
)
def _(s, d):
    sent = cut(I.spans(s, d).select("run_id", "mode", "identity", "classification", I.attributes("attempt_id", "effect_id")))
    return trees.difference_rows(sent).select("run_id", "mode", "identity", "classification")


@query(
    "v28_span_depth",
    """select mode, identity, run_id, cast(case k % 4 when 1 then case when family = 0 then 2 when family = 1 then 2 when att1 then 2 else 3 end
         when 2 then family2 + 1 else family2 end as int) as depth
       from (select *, case when family > 1 then 2 else family end as family2, attempt_id = 'att-' || k || '-1' as att1 from spans)""",
    on="spans",
)
def _(s, d):
    k = I.order_key()
    first = X.span_id(F.col("run_id"), F.col("mode"), F.concat(F.lit("attempt:att-"), k.cast("string"), F.lit("-1")))
    root = F.col("family") == 0
    parent = F.when(root & (k % 4 == 1), first).when(root & (k % 4 == 2), F.lit("ffffffffffffffff")).otherwise(F.col("parent_span_id"))
    sent = cut(I.spans(s, d).select("mode", "identity", "run_id", "span_id", parent.alias("parent_span_id")))
    return trees.with_depth(sent).select("mode", "identity", "run_id", "depth")


REFERENCES_SQL = """select 'e' || event_id as id, location, path, coalesce(sha, 'none') as sha256, coalesce(bytes, -1) as bytes, problem from (
  select event_id, '$.a' as location, 'p' || event_id as path, sha256(cast(event_id as varchar)) as sha, event_id as bytes, 'none' as problem from events
  union all select event_id, '$.list[1].deep', 'q' || event_id, sha256('q' || event_id), 3, 'none' from events where event_id % 3 = 0
  union all select event_id, '$.deep' || repeat('[0]', 24), 'd' || event_id, sha256('d' || event_id), 5, 'none' from events where event_id % 40 = 7
  union all select event_id, '$.half', 'none', sha256('h' || event_id), -1, 'incomplete' from events where event_id % 3 = 1
  union all select event_id, '$.bad', 'b', 'xyz', 1, 'bad_hash' from events where event_id % 3 = 2)"""


def _references(s, d):
    e = F.col("event_id").cast("string")
    ref = lambda p, h, b: F.concat(F.lit('{"path":"'), p, F.lit('","sha256":"'), h, F.lit('","bytes":'), b, F.lit("}"))
    extra = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"list":[1,{"deep":'), ref(F.concat(F.lit("q"), e), F.sha2(F.concat(F.lit("q"), e), 256), F.lit("3")), F.lit("}]")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('"half":{"sha256":"'), F.sha2(F.concat(F.lit("h"), e), 256), F.lit('"}')))
        .otherwise(F.concat(F.lit('"bad":'), ref(F.lit("b"), F.lit("xyz"), F.lit("1"))))
    )
    inner = ref(F.concat(F.lit("d"), e), F.sha2(F.concat(F.lit("d"), e), 256), F.lit("5"))
    deep = F.concat(F.lit('"deep":' + "[" * 24), inner, F.lit("]" * 24 + ","))
    deep = F.when(F.col("event_id") % 40 == 7, deep).otherwise(F.lit(""))
    body = F.concat(F.lit('{"a":'), ref(F.concat(F.lit("p"), e), F.sha2(e, 256), e), F.lit(',"n":{"m":[]},'), deep, extra, F.lit("}"))
    docs = I.events_table(s, d).select(F.concat(F.lit("e"), e).alias("id"), body.alias("body"))
    refs = artifacts.nested_references(docs)
    return refs.select(
        "id", "location", F.coalesce("path", F.lit("none")).alias("path"), F.coalesce("sha256", F.lit("none")).alias("sha256"),
        F.coalesce("bytes", F.lit(-1)).alias("bytes"), F.coalesce("problem", F.lit("none")).alias("problem"),
    )


@query("v29_nested_references", REFERENCES_SQL)
def _(s, d):
    return _references(s, d)


@query("v30_source_facts_audit", SOURCE_FACTS_SQL, on="journal")
def _(s, d):
    return exports.audit_source_facts(*source_facts(s, d)).withColumn("failure", F.coalesce("failure", F.lit("none")))


@query(
    "v31_provenance_stability",
    """select o_orderkey as id, case o_orderkey % 5 when 1 then 'lineage_id' when 2 then 'inputs_sha256' when 3 then 'manifest_sha256' when 4 then 'absent' else 'none' end as changed from orders""",
)
def _(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    kind = F.col("id") % 5
    text = F.col("id").cast("string")
    before = o.select("id", text.alias("lineage_id"), F.sha2(text, 256).alias("inputs_sha256"), F.lit(None).cast("string").alias("manifest_sha256"))
    after = before.where(kind != 4).select(
        "id",
        F.when(kind == 1, "other").otherwise(F.col("lineage_id")).alias("lineage_id"),
        F.when(kind == 2, "other").otherwise(F.col("inputs_sha256")).alias("inputs_sha256"),
        F.when(kind == 3, "other").otherwise(F.col("manifest_sha256")).alias("manifest_sha256"),
    )
    return artifacts.provenance_stability(before, after).withColumn("changed", F.coalesce("changed", F.lit("none")))


@query("z01_effect_adapter", EXECUTED_SQL, on="journal")
def _(s, d):
    return _executed(s, d)


@query("z02_route_chooser", ROUTES_SQL)
def _(s, d):
    @F.pandas_udf("boolean")
    def again(visit: pd.Series) -> pd.Series:
        return visit < 2

    rows = moving(s, d).withColumn("go_on", again("visit"))
    routes = I.graph_routes(s).withColumn("predicate", F.when(F.col("predicate").isNotNull(), "go_on"))
    out = graph.next_nodes(rows, routes, I.graph_nodes(s), ["go_on"])
    return out.select("k", "target", F.coalesce("route_error", F.lit("none")).alias("route_error"))


@query("z04_histogram_quantile_in_sql", HISTOGRAM_SQL)
def _(s, d):
    stats.register_sql_functions(s)
    return s.sql(
        "select event_type, q, round(histogram_quantile(bounds, counts, q), 6) as value from {rows} lateral view explode(array(0.5D, 0.9D, 0.999D)) z as q",
        rows=bucket_counts(s, d),
    )


@query(
    "z05_fold_as_aggregate",
    f"with {FOLD_SQL} select coalesce(rule, 'none') as rule, coalesce(status, 'none') as status, count(*) as runs from expected group by 1, 2",
    on="journal",
)
def _(s, d):
    return I.states(s, d).groupBy(F.coalesce("rule", F.lit("none")).alias("rule"), F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("runs"))


@query("z06_references_of_json", f"select location, problem, count(*) as n from ({REFERENCES_SQL}) group by 1, 2")
def _(s, d):
    return _references(s, d).groupBy("location", "problem").agg(F.count("*").alias("n"))
