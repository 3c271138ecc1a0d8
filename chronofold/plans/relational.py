"""Queries over joins, aggregates, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions import stats
from chronofold.functions.joins import lookup_join
from chronofold.functions.running import hot_groups, ordinal, running_values
from chronofold.functions.storage import cut
from chronofold.operators import admission, artifacts, effects, exports, readback, state, trees
from chronofold.operators import lookups as L
from chronofold.operators.fold import with_prior_state
from chronofold.operators.projection import effect_counts
from chronofold.operators.registered import EVENT_COUNTS
from chronofold.plans import inputs as I
from chronofold.plans.registry import query
from chronofold.plans.scans import OBSERVATIONS_SQL, observations
from chronofold.plans.scalars import STATE_SQL
from chronofold.sources import journal as J

PAIRS_SQL = """f as (select *, k * 32 + src_off as source_seq, k * 32 + int_off as int_seq from facts)"""


def _named(s, d):
    """Events with the source effect they name."""
    rows = I.decoded(s, d)
    hot = hot_groups(rows, ["run_id"])
    return L.with_named_facts(rows, hot).where("names and key is not null")


@query(
    "j01_completion_to_intent",
    f"""with {PAIRS_SQL} select c.run_id, c.seq, coalesce(i.seq, -1) as intent_seq, i.seq is not null as found,
          row_number() over (partition by c.run_id, c.source_seq order by c.seq) > 1 as used_before
        from f c left join f i on c.run_id = i.run_id and c.source_seq = i.seq and i.type = 'effect_intent' and i.seq < c.seq
        where c.type = 'effect_completed'""",
    on="journal",
)
def _(s, d):
    found = L.source_is(N.EFFECT_INTENT)
    return _named(s, d).where(F.col("type") == N.EFFECT_COMPLETED).select(
        "run_id", "seq", F.when(found, F.col("src.seq")).otherwise(-1).alias("intent_seq"), found.alias("found"), L.used().alias("used_before")
    )


@query(
    "j02_resolution_to_completion",
    f"""with {PAIRS_SQL} select r.run_id, r.seq, c.seq is not null as found, coalesce(c.source_seq = r.int_seq, false) as same_intent
        from f r left join f c on r.run_id = c.run_id and r.source_seq = c.seq and c.type = 'effect_completed' and c.seq < r.seq
        where r.type = 'effect_resolved'""",
    on="journal",
)
def _(s, d):
    found = L.source_is(N.EFFECT_COMPLETED)
    same = found & F.col("src.source_intent_seq").eqNullSafe(F.col("source_intent_seq"))
    return _named(s, d).where(F.col("type") == N.EFFECT_RESOLVED).select("run_id", "seq", found.alias("found"), same.alias("same_intent"))


@query(
    "j03_retry_to_pending_intent",
    f"""with {PAIRS_SQL} select r.run_id, r.seq, r.source_seq as retries, i.seq is not null and not exists (
          select 1 from f c where c.run_id = r.run_id and c.type = 'effect_completed' and c.source_seq = i.seq and c.seq < r.seq) as pending
        from f r left join f i on r.run_id = i.run_id and r.source_seq = i.seq and i.type = 'effect_intent'
        where r.type = 'effect_intent' and r.src_off is not null""",
    on="journal",
)
def _(s, d):
    return _named(s, d).where(F.col("type") == N.EFFECT_INTENT).select(
        "run_id", "seq", F.col("retry_of_intent_seq").alias("retries"), (L.source_is(N.EFFECT_INTENT) & ~L.used()).alias("pending")
    )


@query(
    "j04_event_in_active_attempt",
    """with s as (select run_id, seq, type, attempt_id, last_value(case when type = 'attempt_started' then attempt_id when type in ('attempt_abandoned', 'attempt_failed', 'activation_finished') then '' end ignore nulls)
              over (partition by run_id order by seq rows between unbounded preceding and 1 preceding) as open_id from facts)
       select run_id, seq, coalesce(open_id = attempt_id, false) as in_attempt from s
       where type in ('effect_intent', 'effect_completed', 'effect_resolved', 'attempt_abandoned', 'attempt_failed', 'activation_finished')""",
    on="journal",
)
def _(s, d):
    rows = I.decoded(s, d)
    prior = with_prior_state(rows, hot_groups(rows, ["run_id"]))
    inside = F.coalesce(F.col("b_open.id") == F.col("attempt_id"), F.lit(False))
    return prior.where(F.col("type").isin(*N.EFFECT_TYPES, *N.ATTEMPT_END_TYPES)).select("run_id", "seq", inside.alias("in_attempt"))


@query(
    "j05_span_to_parent",
    """with up as (select *, max(case when family = 0 then start_ns end) over r as run_start, max(case when family = 0 then end_ns end) over r as run_finish,
            max(case when family = 1 then start_ns end) over a as att_start, max(case when family = 1 then end_ns end) over a as att_finish,
            max(case when family = 1 then att_outcome end) over a as outcome from spans
          window r as (partition by run_id, mode), a as (partition by run_id, mode, attempt_id)),
        p as (select *, case family when 0 then null when 1 then run_start else att_start end as p_start, case family when 0 then null when 1 then run_finish else att_finish end as p_end from up) select mode, span_id, p_start is not null as parent_found, coalesce(p_start, -1) as parent_start from p""",
    on="spans",
)
def _(s, d):
    sent = cut(I.spans(s, d).select("run_id", "mode", "span_id", "parent_span_id", "start_time_ns", "end_time_ns"))
    return trees.with_parent(sent).select("mode", "span_id", "parent_found", F.coalesce("parent_start_time_ns", F.lit(-1)).alias("parent_start"))


@query(
    "j06_link_to_span",
    """with l as (select *, list(span_id) over (partition by run_id, mode) as ids from spans)
       select run_id, mode, identity, link_span_id as span_id, list_contains(ids, link_span_id) as found from l where link_span_id is not null""",
    on="spans",
)
def _(s, d):
    return trees.check_links(cut(I.spans(s, d))).drop("trace_id")


@query(
    "j07_effect_to_attempt_outcome",
    """with up as (select *, max(case when family = 0 then start_ns end) over r as run_start, max(case when family = 0 then end_ns end) over r as run_finish,
            max(case when family = 1 then start_ns end) over a as att_start, max(case when family = 1 then end_ns end) over a as att_finish,
            max(case when family = 1 then att_outcome end) over a as outcome from spans
          window r as (partition by run_id, mode), a as (partition by run_id, mode, attempt_id)),
        p as (select *, case family when 0 then null when 1 then run_start else att_start end as p_start, case family when 0 then null when 1 then run_finish else att_finish end as p_end from up) select mode, span_id, classification, outcome from p where family > 1 and outcome is not null""",
    on="spans",
)
def _(s, d):
    sent = cut(I.spans(s, d)).withColumn("outcome", F.col("attributes.attempt_outcome"))
    rows = trees.with_parent(sent, ("outcome",)).where("family > 1")
    return rows.select("mode", "span_id", "classification", F.col("parent_outcome").alias("outcome"))


UNIQUE_SQL = """uniq as (select trace_id, span_id, arg_max(nullif(parent_span_id, ''), ingest_seq) as p0, arg_max(coalesce(parent_span_id, ''), ingest_seq) as parent,
    arg_max(name, ingest_seq) as name, arg_max(service_name, ingest_seq) as service_name, arg_max(operation_name, ingest_seq) as operation_name,
    arg_max(coalesce(effect_source, ''), ingest_seq) as source, count(*) as copies from store group by 1, 2),
  diff as (select coalesce(s.trace_id, u.trace_id) as trace_id, coalesce(s.span_id, u.span_id) as span_id,
    case when u.span_id is null then 'missing' when s.span_id is null then 'unexpected'
      when coalesce(s.parent_span_id, '') <> u.parent or s.name <> u.name then 'mismatched' else 'equal' end as verdict,
    s.span_id is not null and u.span_id is not null and s.operation = u.operation_name and coalesce(s.source, '') = u.source as attributes_equal,
    u.copies, u.service_name from spans s full outer join uniq u on s.trace_id = u.trace_id and s.span_id = u.span_id)"""


@query(
    "j08_sent_against_received",
    f"with {UNIQUE_SQL} select trace_id, span_id, verdict, coalesce(attributes_equal, false) as attributes_equal from diff",
    on="store",
)
def _(s, d):
    sent = cut(I.store_columns(I.spans(s, d)))
    rows = readback.differences(sent, I.damaged_store(sent))
    return rows.select("trace_id", "span_id", "verdict", F.coalesce("attributes_equal", F.lit(False)).alias("attributes_equal"))


@query(
    "j09_intents_without_completion",
    f"""with {PAIRS_SQL} select run_id, seq from f i where type = 'effect_intent' and not exists
        (select 1 from f c where c.run_id = i.run_id and c.type = 'effect_completed' and c.source_seq = i.seq)""",
    on="journal",
)
def _(s, d):
    return effects.pending_intents(I.decoded(s, d)).select("run_id", "seq")


def call_table(s, d):
    """One effect call per started run; ``k % 5`` picks how it differs from the record."""
    f = I.facts(s, d).where("type = 'run_started'")
    k = F.col("k") % 5
    return f.select(
        "run_id",
        "activation_id",
        F.concat(F.lit("att-"), F.col("k").cast("string"), F.lit("-9")).alias("attempt_id"),
        F.col("k").alias("call_order"),
        F.when(k == 1, "payments:other").otherwise("payments:settle").alias("label"),
        F.when(k == 2, F.lit('{"amount_cents":1}')).otherwise(F.col("request")).alias("request"),
        F.when(k == 4, "unspecified").otherwise("store/v1").alias("adapter_version"),
        F.when(k == 3, F.lit("other")).otherwise(F.lit("settle")).alias("effect_id"),
        F.when(F.col("tkey") == 4, F.lit(None).cast("string")).otherwise(F.col("effect_key")).alias("idempotency_key"),
        (F.col("tkey") != 4).alias("retry_safe"),
    )


CALLS_SQL = f"""{PAIRS_SQL}, done as (select run_id, max(seq) as seq, max(source_seq) as intent from f where type = 'effect_completed' and act = 1 group by 1),
  pend as (select run_id, max(seq) as seq from f i where type = 'effect_intent' and act = 1 and not exists
    (select 1 from f c where c.run_id = i.run_id and c.type = 'effect_completed' and c.source_seq = i.seq) group by 1),
  calls as (select s.run_id, s.k % 5 as kind, s.tkey, d.seq as done_seq, d.intent, p.seq as pend_seq, d.seq is not null or p.seq is not null as met
    from f s left join done d on s.run_id = d.run_id left join pend p on s.run_id = p.run_id where s.type = 'run_started'),
  plan as (select *, case when kind = 4 then 'invalid_arguments' when met and kind in (1, 2, 3) then 'identity_mismatch'
    when kind < 4 and kind <> 3 and done_seq is not null then 'resolve' when kind <> 3 and pend_seq is not null and tkey = 4 then 'unknown_outcome' else 'execute' end as verdict from calls)"""


@query(
    "j10_call_to_recorded_effect",
    f"""with {CALLS_SQL} select run_id, verdict, coalesce(case when verdict = 'resolve' then done_seq end, -1) as source_effect_seq,
        coalesce(case when verdict = 'execute' and done_seq is null and kind <> 3 then pend_seq end, -1) as retry_of_intent_seq from plan""",
    on="journal",
)
def _(s, d):
    plan = effects.plan_calls(effects.call_requests(call_table(s, d)), I.decoded(s, d))
    none = F.lit(-1)
    return plan.select(
        "run_id", "verdict", F.coalesce("source_effect_seq", none).alias("source_effect_seq"),
        F.coalesce("retry_of_intent_seq", none).alias("retry_of_intent_seq"),
    )


def start_requests(s, d):
    f = I.run_facts(s, d)
    k = F.col("k")
    cents = F.when(k % 5 == 0, F.col("cents") + 1).otherwise(F.col("cents"))
    return f.select(
        F.when(k % 10 == 3, F.concat(F.lit("new-"), k.cast("string"))).otherwise(F.col("run_id")).alias("run_id"),
        F.concat(F.lit('{"amount_cents": '), cents.cast("string"), F.lit("}")).alias("input"),
        F.when(k % 7 == 1, "elsewhere").otherwise("settle").alias("start_node"),
        F.when(k % 11 == 2, "other/v1").otherwise(F.col("workflow")).alias("workflow_version"),
    )


STARTS_SQL = """select case when k % 10 = 3 then 'new-' || k else run_id end as run_id,
    case when k % 10 = 3 then 'new' when tkey = 11 then 'no_run_started' when k % 11 = 2 then 'other_workflow' when k % 7 = 1 then 'other_start'
      when k % 5 = 0 then 'other_input' else 'same' end as verdict from (select distinct k, run_id, tkey from facts)"""


@query("j11_start_to_registered_run", STARTS_SQL, on="journal")
def _(s, d):
    return admission.judge_starts(start_requests(s, d), I.journal(s, d)).select("run_id", "verdict")


FROZEN_SQL = f"""cur as (select {I.GROUP_SQL} as grp, {I.PATHS_SQL} as path, sha256(text) as sha256, strlen(text) as bytes, doc_id from documents),
  now as (select * from cur where grp is not null and doc_id % 20 <> 3),
  frozen as (select grp, case when doc_id % 20 = 8 then grp || '/../' || path else path end as path,
      case when doc_id % 20 = 4 then sha256('x' || path) else sha256 end as sha256, case when doc_id % 20 = 5 then bytes + 1 else bytes end as bytes
    from cur where grp is not null and doc_id % 20 <> 2
    union all select grp, path, sha256, bytes from cur where grp is not null and doc_id % 20 = 6
    union all select grp, path, sha256('y' || path), bytes from cur where grp is not null and doc_id % 20 = 0)"""


def frozen_and_current(s, d):
    files = I.text_files(s, d)
    ids = files.select("path", "doc_id")
    refs = artifacts.artifact_references(files).join(ids, "path")
    m = F.col("doc_id") % 20
    current = refs.where(m != 3).drop("doc_id")
    listed = refs.where(m != 2).select(
        "group",
        F.when(m == 8, F.concat("group", F.lit("/../"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(m == 4, F.sha2(F.concat(F.lit("x"), "path"), 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(m == 5, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
    )
    twice = refs.where(m == 6).drop("doc_id")
    other = refs.where(m == 0).withColumn("sha256", F.sha2(F.concat(F.lit("y"), "path"), 256)).drop("doc_id")
    return listed.unionByName(twice).unionByName(other), current


@query(
    "j12_frozen_against_current",
    f"""with {FROZEN_SQL} select coalesce(f.grp, n.grp) as "group", coalesce(f.path, n.path) as path, f.path is not null as frozen, n.path is not null as current
        from (select distinct grp, path from frozen) f full outer join now n on f.grp = n.grp and f.path = n.path""",
)
def _(s, d):
    frozen, current = frozen_and_current(s, d)
    left = frozen.select("group", "path").distinct().withColumn("frozen", F.lit(True))
    both = left.join(current.select("group", "path", F.lit(True).alias("current")), ["group", "path"], "full_outer")
    return both.fillna(False, ["frozen", "current"])


@query(
    "j13_difference_rows_by_key",
    "select s.mode, s.span_id from spans s where s.family > 0 and exists (select 1 from spans r where r.run_id = s.run_id and r.classification = 'resolved' and r.attempt_id = s.attempt_id and s.family > 1)",
    on="spans",
)
def _(s, d):
    return trees.difference_rows(cut(I.spans(s, d))).select("mode", "span_id")


@query(
    "j14_events_with_graph_node",
    "select seq, workflow, coalesce(workflow = 'gated/v1' and not (type = 'run_finished' or (type = 'run_failed' and tkey <> 8)), false) as gated from facts",
    on="journal",
)
def _(s, d):
    f = I.facts(s, d).select("seq", "workflow", F.expr("case when type = 'run_finished' or (type = 'run_failed' and tkey <> 8) then null else 'settle' end as node"))
    nodes = I.graph_nodes(s).select(F.col("workflow_version").alias("workflow"), F.col("name").alias("node"), "requires_approval")
    joined = lookup_join(f, nodes, ["workflow", "node"])
    return joined.select("seq", "workflow", F.coalesce("requires_approval", F.lit(False)).alias("gated"))


@query(
    "j15_spans_to_proof",
    f"""with {UNIQUE_SQL}, v as (select trace_id, count(*) filter (where verdict <> 'equal') = 0 as identity_ok from diff group by 1)
        select s.run_id, s.mode, count(*) as spans, bool_and(v.identity_ok) as identity_verified from spans s join v on s.trace_id = v.trace_id group by 1, 2""",
    on="store",
)
def _(s, d):
    sent = cut(I.store_columns(I.spans(s, d)))
    proofs = readback.verify_readback(sent, I.damaged_store(sent)).select("run_id", "mode", "identity_verified")
    counted = sent.groupBy("run_id", "mode").agg(F.count("*").alias("spans"))
    return counted.join(proofs, ["run_id", "mode"])


FACTS_SQL = f"""{I.ATTEMPTS_SQL}, per as (select run_id, count(*) as n, count(distinct idempotency_key) as e, max(sha256(idempotency_key)) as key from attempts group by 1)"""


def source_facts(s, d):
    """Sanitised facts, documents and store rows; ``k % 6`` picks the disagreement."""
    a = I.attempts(s, d)
    kind = I.order_key() % 6
    per = a.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_distinct("idempotency_key").alias("e"), F.max(F.sha2("idempotency_key", 256)).alias("key")
    )
    facts = per.select(
        "run_id",
        F.when(kind == 2, F.col("n") + 1).otherwise(F.col("n")).alias("provider_attempts"),
        F.col("e").alias("business_executions"),
        F.when(kind == 3, "short").otherwise(F.col("key")).alias("key_sha256"),
        F.when(kind == 1, "x").otherwise("same").alias("events_sha256"),
        F.when(kind == 4, 0).otherwise(10).alias("observed_bytes"),
    )
    docs = per.where(kind != 5).select(
        "run_id", F.col("n").alias("doc_attempts"), F.col("e").alias("doc_executions"), F.lit("same").alias("doc_events_sha256")
    )
    return facts, docs, a.withColumn("kept", F.lit(True))


SOURCE_FACTS_SQL = f"""with {FACTS_SQL} select run_id, case cast(substring(run_id, 5) as bigint) % 6 when 5 then 'no_document' when 1 then 'events_differ'
    when 4 then 'nothing_observed' when 2 then 'counts_differ' when 3 then 'key_hash_form' else 'none' end as failure from per"""


@query("j16_facts_document_store", SOURCE_FACTS_SQL, on="journal")
def _(s, d):
    return exports.audit_source_facts(*source_facts(s, d)).select("run_id", F.coalesce("failure", F.lit("none")).alias("failure"))


@query(
    "j17_child_inside_parent",
    """with up as (select *, max(case when family = 0 then start_ns end) over r as run_start, max(case when family = 0 then end_ns end) over r as run_finish,
            max(case when family = 1 then start_ns end) over a as att_start, max(case when family = 1 then end_ns end) over a as att_finish,
            max(case when family = 1 then att_outcome end) over a as outcome from spans
          window r as (partition by run_id, mode), a as (partition by run_id, mode, attempt_id)),
        p as (select *, case family when 0 then null when 1 then run_start else att_start end as p_start, case family when 0 then null when 1 then run_finish else att_finish end as p_end from up) select mode, span_id, coalesce(start_ns + case when k % 4 = 1 and family = 1 then -1000000000 else 0 end
            < p_start + case when family > 1 and k % 4 = 1 then -1000000000 else 0 end or end_ns > p_end, false) as escapes from p""",
    on="spans",
)
def _(s, d):
    moved = cut(I.spans(s, d).select("run_id", "mode", "span_id", "parent_span_id", "start_time_ns", "end_time_ns", "family"))
    early = (I.order_key() % 4 == 1) & (F.col("family") == 1)
    moved = moved.withColumn("start_time_ns", F.when(early, F.col("start_time_ns") - 1_000_000_000).otherwise(F.col("start_time_ns")))
    return trees.with_parent(moved).select("mode", "span_id", F.coalesce(trees.escapes_parent(), F.lit(False)).alias("escapes"))


@query(
    "j18_prefix_requests",
    "select r.run_id, r.at_seq, count(*) as events from journal j join (select 'run-' || o_orderkey as run_id, o_orderkey * 32 + 4 + 4 * n.n as at_seq from orders cross join (values (0), (1), (2)) n(n)) r on j.run_id = r.run_id and j.seq <= r.at_seq group by 1, 2",
    on="journal",
)
def _(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet")
    requests = orders.select(
        F.expr("'run-' || o_orderkey as run_id"), F.explode(F.expr("array(o_orderkey * 32 + 4, o_orderkey * 32 + 8, o_orderkey * 32 + 12)")).alias("at_seq")
    )
    return state.prefixes(I.journal(s, d), requests).groupBy("run_id", "at_seq").agg(F.count("*").alias("events"))


@query(
    "j19_receipt_to_evidence",
    """select o_orderkey as lineage_id, n.p as position, not ((o_orderkey % 12 = 9 and n.p = 1) or (o_orderkey % 12 = 10 and n.p < 2)) as matches
       from orders cross join (values (0), (1), (2)) n(p)""",
)
def _(s, d):
    receipts, _, evidence = I.receipt_chains(s, d)
    proof = evidence.select(F.col("path").alias("epath"), F.col("verdict").alias("everdict"), F.col("phase").alias("ephase"))
    joined = receipts.withColumn("epath", F.col("evidence.path")).join(proof, "epath", "left")
    ok = F.coalesce((F.col("everdict") == "PASS") & (F.col("ephase") == F.col("good_phase")), F.lit(False))
    return joined.select("lineage_id", F.col("position").cast("int").alias("position"), ok.alias("matches"))


@query("a01_events_by_type", "select run_id, type, count(*) as n from facts group by 1, 2", on="journal")
def _(s, d):
    return I.journal(s, d).groupBy("run_id", "type").agg(F.count("*").alias("n"))


@query(
    "a02_registered_counts",
    """select run_id, tkey = 1 or tkey in (14, 16) as registered from (select distinct run_id, tkey from facts)""",
    on="journal",
)
def _(s, d):
    n = I.journal(s, d).groupBy("run_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("type") == t).alias(t) for t in EVENT_COUNTS]
    )
    ok = F.col("n") == sum(EVENT_COUNTS.values())
    for t, count in EVENT_COUNTS.items():
        ok &= F.col(t) == count
    return n.select("run_id", ok.alias("registered"))


COUNTS_SQL = """select run_id, mode, count(*) filter (where classification = 'executed') as executed, count(*) filter (where classification = 'resolved') as resolved,
  count(*) filter (where classification in ('executed', 'resolved')) as effect_spans, count(*) as total_spans from spans group by 1, 2"""


@query("a03_effect_counts_by_mode", COUNTS_SQL, on="spans")
def _(s, d):
    return effect_counts(I.spans(s, d))


@query(
    "a04_ground_truth",
    f"""with {I.ATTEMPTS_SQL}, e as (select run_id, count(*) filter (where type = 'attempt_started') as attempts, count(*) filter (where type = 'effect_intent') as intents,
          count(*) filter (where type = 'effect_completed') as completions, count(*) filter (where type = 'effect_resolved') as resolutions from facts group by 1),
          p as (select run_id, count(*) as n, count(distinct idempotency_key) as x from attempts group by 1)
        select e.*, coalesce(p.n, 0) as provider_attempts, coalesce(p.x, 0) as business_executions from e left join p on e.run_id = p.run_id""",
    on="journal",
)
def _(s, d):
    t = F.col("type")
    counted = I.journal(s, d).groupBy("run_id").agg(
        F.count_if(t == N.ATTEMPT_STARTED).alias("attempts"),
        F.count_if(t == N.EFFECT_INTENT).alias("intents"),
        F.count_if(t == N.EFFECT_COMPLETED).alias("completions"),
        F.count_if(t == N.EFFECT_RESOLVED).alias("resolutions"),
    )
    calls = I.attempts(s, d).groupBy("run_id").agg(
        F.count("*").alias("provider_attempts"), F.count_distinct("idempotency_key").alias("business_executions")
    )
    return counted.join(calls, "run_id", "left").fillna(0)


@query(
    "a05_arm_comparison",
    """with w as (select run_id, workflow from spans where family = 0 and mode = 'aware')
       select w.workflow as workflow_version, count(distinct w.run_id) as runs, count(*) filter (where mode = 'aware' and classification = 'executed') as aware_executed,
         count(*) filter (where mode = 'aware' and classification = 'resolved') as aware_resolved, count(*) filter (where mode = 'control' and classification = 'executed') as control_executed
       from spans s join w on s.run_id = w.run_id group by 1""",
    on="spans",
)
def _(s, d):
    sent = I.spans(s, d)
    aware, control = F.col("mode") == "aware", F.col("mode") == "control"
    executed = F.col("classification") == "executed"
    per_run = sent.groupBy("run_id").agg(
        F.max("attributes.workflow_version").alias("workflow_version"),
        F.count_if(aware & executed).alias("a"),
        F.count_if(aware & (F.col("classification") == "resolved")).alias("r"),
        F.count_if(control & executed).alias("c"),
    )
    return per_run.groupBy("workflow_version").agg(
        F.count("*").alias("runs"), F.sum("a").alias("aware_executed"), F.sum("r").alias("aware_resolved"), F.sum("c").alias("control_executed")
    )


@query("a06_attempt_end", "select run_id, att_id as attempt_id, max(at_ns) as end_ns, max(case when type in ('attempt_abandoned', 'attempt_failed', 'activation_finished') then type else '' end) as ended_by from (select *, attempt_id as att_id from facts where att is not null) group by 1, 2", on="journal")
def _(s, d):
    t, j = F.col("type"), I.journal(s, d).where("attempt_id is not null")
    ends = t.isin(*N.ATTEMPT_END_TYPES)
    return j.groupBy("run_id", "attempt_id").agg(
        F.coalesce(F.max(F.when(ends, F.col("at_ns"))), F.max_by("at_ns", "seq")).alias("end_ns"),
        F.max(F.when(ends, t).otherwise("")).alias("ended_by"),
    )


@query(
    "a07_run_end_and_outcome",
    "select run_id, max_by(at_ns, seq) as last_ns, coalesce(max(case type when 'run_finished' then 'finished' when 'run_failed' then 'failed' end), 'open') as outcome from facts where tkey <> 12 group by 1 union all select run_id, max(at_ns) filter (where type = 'run_finished'), 'finished' from facts where tkey = 12 group by 1",
    on="journal",
)
def _(s, d):
    t = F.col("type")
    closing = t.isin(N.RUN_FINISHED, N.RUN_FAILED)
    outcome = F.when(t == N.RUN_FINISHED, "finished").when(t == N.RUN_FAILED, "failed")
    return I.journal(s, d).groupBy("run_id").agg(
        F.coalesce(F.max(F.when(closing, F.col("at_ns"))), F.max_by("at_ns", "seq")).alias("last_ns"),
        F.coalesce(F.max(outcome), F.lit("open")).alias("outcome"),
    )


@query(
    "a08_state_merge",
    f"""with {STATE_SQL} select run_id, key, value from (select run_id, unnest(json_keys(state)) as key, state from merged) t,
        lateral (select json_extract(state, '$.' || key)::varchar as value) where state is not null and key is not null""",
    on="journal",
)
def _(s, d):
    return state.state_values(I.journal(s, d))


@query(
    "a09_completed_nodes",
    "select run_id, cast(0 as bigint) as part, string_agg('settle', '>' order by seq) as nodes, count(*) as n from facts where type = 'activation_finished' group by 1",
    on="journal",
)
def _(s, d):
    done = exports.completed_nodes(I.journal(s, d))
    return done.select("run_id", "part", F.array_join("completed", ">").alias("nodes"), F.size("completed").cast("bigint").alias("n"))


@query("a10_distinct_attempts", "select run_id, count(distinct attempt_id) as attempts, count(distinct activation_id) as activations from facts group by 1", on="journal")
def _(s, d):
    return I.journal(s, d).groupBy("run_id").agg(
        F.count_distinct("attempt_id").alias("attempts"), F.count_distinct("activation_id").alias("activations")
    )


@query("a11_trace_bounds", "select trace_id, min(start_ns) as first_ns, max(end_ns) as last_ns from spans group by 1", on="spans")
def _(s, d):
    return I.spans(s, d).groupBy("trace_id").agg(F.min("start_time_ns").alias("first_ns"), F.max("end_time_ns").alias("last_ns"))


@query("a12_duplicate_rows", "select trace_id, count(*) - count(distinct span_id) as duplicate_rows from store group by 1", on="store")
def _(s, d):
    return I.store(s, d).groupBy("trace_id").agg((F.count("*") - F.count_distinct("span_id")).alias("duplicate_rows"))


@query(
    "a13_effect_store_summary",
    f"with {I.ATTEMPTS_SQL} select count(*) as attempts, count(distinct idempotency_key) as business_executions from attempts",
    on="journal",
)
def _(s, d):
    a = I.attempts(s, d)
    return effects.store_summary(a, effects.apply_once(a)[0])


@query("a14_one_service_per_trace", "select trace_id, min(service_name) = max(service_name) and min(service_name) like 'chronofold-%' as one_service from store group by 1", on="store")
def _(s, d):
    low, high = F.min("service_name"), F.max("service_name")
    return I.store(s, d).groupBy("trace_id").agg(((low == high) & low.startswith("chronofold-")).alias("one_service"))


@query("a15_duplicate_identities", "select trace_id, span_id, count(*) as copies from store group by 1, 2 having count(*) > 1", on="store")
def _(s, d):
    return I.store(s, d).groupBy("trace_id", "span_id").agg(F.count("*").alias("copies")).where("copies > 1")


@query(
    "a16_quantiles",
    """with v as (select event_type, case when event_id % 7 = 0 then null when event_id = 11 then 1e12 else value end as value from events
         union all select 'constant', 2.5 from events)
       select event_type, round(quantile_cont(value, 0), 6) as q0, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as q2,
       round(quantile_cont(value, 0.95), 6) as q3, round(quantile_cont(value, 1), 6) as q4 from v group by 1""",
)
def _(s, d):
    events = I.events_table(s, d)
    odd = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") == 11, 1e12).otherwise(F.col("value"))
    rows = events.select("event_type", odd.alias("value")).unionByName(events.select(F.lit("constant").alias("event_type"), F.lit(2.5).alias("value")))
    q = stats.exact_quantiles(rows, "event_type", "value", (-1, 0.25, 0.5, 0.95, 2))
    return q.select("event_type", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(5)])


@query(
    "a17_rates",
    f"with {OBSERVATIONS_SQL} select group_key, cast(sum(value) as bigint) as numerator, count(*) as denominator, round(avg(value), 9) as rate from observations group by 1",
    on="spans",
)
def _(s, d):
    return stats.rates(observations(s, d)).withColumn("rate", F.round("rate", 9))


# Draws differ from engine to engine, so the bounds are held against the normal interval.
@query(
    "a18_rate_intervals",
    f"""with {OBSERVATIONS_SQL}, seen as (select group_key, value from observations union all select 'constant', 1.0 from observations)
        select group_key, cast(sum(value) as bigint) as numerator, count(*) as denominator, round(avg(value), 9) as rate,
          min(value) = max(value) as degenerate, true as ordered, true as near_normal from seen group by 1""",
    on="spans",
)
def _(s, d):
    constant = F.lit("constant").alias("group_key")
    seen = cut(observations(s, d))  # read twice
    got = stats.rate_intervals(seen.unionByName(seen.select(constant, F.lit(1.0).alias("value"))))
    half = 1.959963984540054 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("denominator"))
    slack = 0.1 * half + 3 / F.col("denominator")
    near = lambda bound, at: F.abs(F.col(bound) - at) <= slack
    return got.select(
        "group_key", "numerator", "denominator", F.round("rate", 9).alias("rate"), "degenerate",
        ((F.col("low") <= F.col("rate")) & (F.col("rate") <= F.col("high"))).alias("ordered"),
        (near("low", F.col("rate") - half) & near("high", F.col("rate") + half)).alias("near_normal"),
    )


@query(
    "a19_valid_and_rejected",
    "select count(*) filter (where event_id % 5 <> 0) as valid, count(*) filter (where event_id % 5 = 0) as rejected from events",
)
def _(s, d):
    from chronofold.operators.documents import parse_documents

    body = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props"))
    parsed = parse_documents(I.events_table(s, d).select("event_id", body.alias("body")))
    return parsed.agg(F.count_if("readable").alias("valid"), F.count_if(~F.col("readable")).alias("rejected"))


_BUCKET_SQL = "case " + " ".join(f"when n <= {b} then {i}" for i, b in enumerate(stats.LATENCY_BOUNDS_NS)) + f" else {len(stats.LATENCY_BOUNDS_NS)} end"


@query(
    "a20_latency_histogram",
    f"""select end_ns // 60000000000 * 60 as window_start_s, mode, name, cast({_BUCKET_SQL} as bigint) as bucket, count(*) as spans, cast(sum(n) as bigint) as total_ns
        from (select *, (end_ns - start_ns) * (1 + k % 2000) as n from spans) group by 1, 2, 3, 4""",
    on="spans",
)
def _(s, d):
    stretched = I.spans(s, d).withColumn("duration_ns", F.col("duration_ns") * (1 + I.order_key() % 2000))
    return stats.latency_histogram(stretched)


def bucket_counts(s, d):
    """Per event type the counts of values in fixed buckets, as arrays."""
    bounds = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
    b = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        b = F.when(F.col("value") <= bounds[i], i).otherwise(b)
    counts = I.events_table(s, d).groupBy("event_type").agg(
        F.array(*[F.count_if(b == i).cast("double") for i in range(len(bounds) + 1)]).alias("counts")
    )
    return counts.withColumn("bounds", F.array(*[F.lit(x) for x in bounds]))


HISTOGRAM_SQL = """with b as (select * from (values (0, 0.0, 1.0), (1, 1.0, 5.0), (2, 5.0, 10.0), (3, 10.0, 25.0), (4, 25.0, 50.0), (5, 50.0, 100.0), (6, 100.0, 250.0), (7, 250.0, null)) t(i, lo, hi)),
  c as (select event_type, b.i, b.lo, b.hi, count(*) filter (where value <= coalesce(b.hi, 1e300) and (value > b.lo or b.i = 0)) as n from events cross join b group by 1, 2, 3, 4),
  r as (select *, sum(n) over (partition by event_type order by i) as upto, sum(n) over (partition by event_type) as total from c),
  h as (select event_type, q, i, lo, hi, n, upto, total * q as rank from r cross join (values (0.5e0), (0.9e0), (0.999e0)) z(q) where n > 0 and upto >= total * q
    qualify row_number() over (partition by event_type, q order by i) = 1)
  select event_type, q, round(case when hi is null then lo else lo + (hi - lo) * (rank - (upto - n)) / n end, 6) as value from h"""


@query("a21_histogram_quantile", HISTOGRAM_SQL)
def _(s, d):
    rows = bucket_counts(s, d).withColumn("q", F.explode(F.array(F.lit(0.5), F.lit(0.9), F.lit(0.999))))
    return rows.select("event_type", "q", F.round(stats.histogram_quantile("bounds", "counts", "q"), 6).alias("value"))


@query(
    "a22_reference_conflicts",
    f"with {FROZEN_SQL} select path, count(*) as listed, count(distinct sha256 || ':' || bytes) > 1 as conflict from frozen group by 1",
)
def _(s, d):
    frozen, _ = frozen_and_current(s, d)
    form = F.concat_ws(":", "sha256", F.col("bytes").cast("string"))
    return frozen.groupBy("path").agg(F.count("*").alias("listed"), (F.min(form) != F.max(form)).alias("conflict"))


@query(
    "w01_sequence_increases",
    """select run_id, arrival, seq, coalesce(seq <= lag(seq) over (partition by run_id order by arrival), false) as broken
       from (select run_id, k * 64 + off * 2 as arrival, case when k % 8 = 3 and off = 6 then seq - 2 when k % 8 = 5 and off = 6 then seq - 4 else seq end as seq from facts)""",
    on="journal",
)
def _(s, d):
    k, off = F.col("k"), F.col("off")
    seq = F.when((k % 8 == 3) & (off == 6), F.col("seq") - 2).when((k % 8 == 5) & (off == 6), F.col("seq") - 4).otherwise(F.col("seq"))
    rows = I.facts(s, d).select("run_id", (k * 64 + off * 2).alias("arrival"), seq.alias("seq"))
    out = running_values(rows, ["run_id"], "arrival", hot=hot_groups(rows, ["run_id"]), last={"before": F.col("seq")})
    return out.select("run_id", "arrival", "seq", F.coalesce(F.col("seq") <= F.col("before"), F.lit(False)).alias("broken"))


@query(
    "w02_time_never_decreases",
    """select run_id, seq, coalesce(t < lag(t) over (partition by run_id order by seq), false) as broken
       from (select run_id, seq, at_ns - case when k % 8 = 3 and off = 6 then 5000000 else 0 end as t from facts)""",
    on="journal",
)
def _(s, d):
    late = F.when((F.col("k") % 8 == 3) & (F.col("off") == 6), 5_000_000).otherwise(0)
    rows = I.facts(s, d).select("run_id", "seq", (F.col("at_ns") - late).alias("t"))
    out = running_values(rows, ["run_id"], "seq", hot=hot_groups(rows, ["run_id"]), last={"before": F.col("t")})
    return out.select("run_id", "seq", F.coalesce(F.col("t") < F.col("before"), F.lit(False)).alias("broken"))


def _prior(s, d):
    rows = I.decoded(s, d)
    return with_prior_state(rows, hot_groups(rows, ["run_id"]))


@query(
    "w03_open_attempt_before",
    """with s as (select run_id, seq, last_value(case when type = 'attempt_started' then attempt_id when type in ('attempt_abandoned', 'attempt_failed', 'activation_finished') then '' end ignore nulls)
              over (partition by run_id order by seq rows between unbounded preceding and 1 preceding) as open_id from facts)
       select run_id, seq, coalesce(nullif(open_id, ''), 'none') as open_attempt from s""",
    on="journal",
)
def _(s, d):
    return _prior(s, d).select("run_id", "seq", F.coalesce("b_open.id", F.lit("none")).alias("open_attempt"))


@query(
    "w04_state_before",
    """select run_id, seq,
         coalesce(last_value(case when type in ('attempt_failed', 'approval_denied') then 'failed' when type = 'run_finished' then 'finished'
           when type = 'approval_granted' then 'running' when type = 'awaiting_approval' then type end ignore nulls) over w, 'running') as status,
         coalesce(last_value(case when type in ('approval_granted', 'activation_finished', 'awaiting_approval') then type = 'approval_granted' end ignore nulls) over w, false) as granted,
         coalesce(last_value(case when type = 'run_started' then 'settle' when type = 'activation_finished' then coalesce(next_node, 'none') end ignore nulls) over w, 'none') as node,
         coalesce(last_value(case when type = 'run_started' then activation_id when type = 'activation_finished' then coalesce('act-' || k || '-' || next_act, '') end ignore nulls) over w, 'none') as activation
       from facts window w as (partition by run_id order by seq rows between unbounded preceding and 1 preceding)""",
    on="journal",
)
def _(s, d):
    return _prior(s, d).select(
        "run_id",
        "seq",
        F.coalesce("b_status", F.lit("running")).alias("status"),
        F.coalesce("b_granted", F.lit(False)).alias("granted"),
        F.coalesce("b_at.node", F.lit("none")).alias("node"),
        F.coalesce("b_at.act", F.lit("none")).alias("activation"),
    )


@query(
    "w05_after_terminal",
    "select run_id, seq from (select *, coalesce(max(case when type in ('run_finished', 'run_failed') then 1 end) over (partition by run_id order by seq rows between unbounded preceding and 1 preceding), 0) as t from facts) where t = 1",
    on="journal",
)
def _(s, d):
    return _prior(s, d).where("b_terminal").select("run_id", "seq")


FIRST_SQL = """select run_id, case tkey when 11 then 'E03' when 12 then 'E11' when 13 then 'E21' when 14 then 'E21' when 15 then 'E21' else 'E22' end as rule,
  k * 32 + case tkey when 11 then 4 when 12 then 20 when 13 then 8 when 14 then 8 when 15 then 9 else 14 end as rule_seq
  from (select distinct k, run_id, tkey from facts) where tkey > 10"""


@query("w06_first_violation", FIRST_SQL, on="journal")
def _(s, d):
    return I.states(s, d).where("rule is not null").select("run_id", "rule", "rule_seq")


@query(
    "w07_call_index_in_attempt",
    "select run_id, seq, cast(row_number() over (partition by run_id, attempt_id order by seq) - 1 as bigint) as call_index from facts where type in ('effect_intent', 'effect_resolved')",
    on="journal",
)
def _(s, d):
    calls = I.journal(s, d).where(F.col("type").isin(N.EFFECT_INTENT, N.EFFECT_RESOLVED))
    key = ["run_id", "attempt_id"]
    return ordinal(calls, key, "seq", "call_index", hot=hot_groups(calls, key)).select("run_id", "seq", "call_index")


@query(
    "w08_activation_id_reused",
    """select run_id, seq, id, row_number() over (partition by run_id, id order by seq) > 1 as reused from (
         select run_id, seq, activation_id as id from facts where type = 'run_started'
         union all select run_id, seq, 'act-' || k || '-' || case when k % 24 = 6 then 1 else next_act end from facts where next_act is not null)""",
    on="journal",
)
def _(s, d):
    again = F.col("k") % 24 == 6
    ids = F.when(F.col("type") == N.RUN_STARTED, F.col("activation_id")).when(
        F.col("next_act").isNotNull(),
        F.concat(F.lit("act-"), F.col("k").cast("string"), F.lit("-"), F.when(again, 1).otherwise(F.col("next_act")).cast("string")),
    )
    rows = I.facts(s, d).select("run_id", "seq", ids.alias("id")).where("id is not null")
    out = running_values(rows, ["run_id", "id"], "seq", hot=hot_groups(rows, ["run_id"]), peak={"seen": F.lit(True)})
    return out.select("run_id", "seq", "id", F.coalesce("seen", F.lit(False)).alias("reused"))


@query(
    "w09_receipt_predecessor",
    """select o_orderkey as lineage_id, n.p as position, not (o_orderkey % 12 = 8 and n.p = 1) as linked from orders cross join (values (0), (1), (2)) n(p)""",
)
def _(s, d):
    receipts, _, _ = I.receipt_chains(s, d)
    rows = running_values(
        receipts.where("position < 3"), ["lineage_id"], "position", hot=hot_groups(receipts, ["lineage_id"]),
        last={"before": F.struct("path", "sha256", "bytes")},
    )
    return rows.select("lineage_id", F.col("position").cast("int").alias("position"), F.col("previous").eqNullSafe(F.col("before")).alias("linked"))


@query("w10_sequence_assignment", "select event_id, row_number() over (order by ts, event_id) + 999 as seq from events")
def _(s, d):
    return J.with_sequence(I.events_table(s, d).select("event_id", "ts"), 1000, ["ts", "event_id"]).select("event_id", "seq")


@query("o01_events_by_seq", "select seq, run_id, type from journal", on="journal")
def _(s, d):
    return I.journal(s, d).select("seq", "run_id", "type").orderBy("seq")


@query("o02_runs_newest_first", "select run_id, min(seq) as first_seq from journal group by 1", on="journal")
def _(s, d):
    return J.list_runs(I.journal(s, d))


@query("o03_unique_rows_by_time", "select trace_id, span_id, max(ts_ms) as ts_ms from store group by 1, 2", on="store")
def _(s, d):
    # Written once: both kinds of rows of the store are made of the spans.
    rows = readback.unique_rows(I.damaged_store(cut(I.store_columns(I.spans(s, d)))), ("ts_ms",)).select("trace_id", "span_id", "ts_ms")
    return rows.orderBy(F.coalesce(F.col("ts_ms").cast("string"), F.lit("")), "span_id")


@query(
    "o04_retained_order",
    """select trace_id, span_id, cast(row_number() over (order by span_id, name, coalesce(parent_span_id, ''), operation, coalesce(source, '')) - 1 as bigint) as place from spans""",
    on="spans",
)
def _(s, d):
    rows = readback.retained_fields(I.spans(s, d))
    keys = {f"_k{i}": c for i, c in enumerate(readback.retained_order())}
    # Written once: cutting the order into ranges samples its rows first and would project them twice.
    keyed = cut(rows.select("trace_id", "span_id", *[c.alias(n) for n, c in keys.items()]))
    return J.with_sequence(keyed, 0, list(keys), keep=["trace_id", "span_id"]).select("trace_id", "span_id", F.col("seq").alias("place"))


@query(
    "o05_limited_trace_rows",
    "select trace_id, span_id from (select *, row_number() over (partition by trace_id order by ts_ms, ingest_seq) as r from store) where r <= 2",
    on="store",
)
def _(s, d):
    sent = cut(I.store_columns(I.spans(s, d), "end_time_ns"))
    return readback.scan_traces(I.damaged_store(sent), readback.query_windows(sent), 2).select("trace_id", "span_id")


@query(
    "o06_document_ledger",
    """select 'r' || lpad(cast(event_id as varchar), 9, '0') as id, 'invalid' as kind from events order by event_id <> 17, event_id desc limit 12""",
)
def _(s, d):
    from chronofold.operators.documents import document_ledger

    docs = I.events_table(s, d).select(F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"), F.col("props").alias("body"))
    return document_ledger(docs, "r000000017")


@query(
    "o07_span_order",
    "select run_id, mode, span_id, cast(row_number() over (partition by run_id, mode order by family, seq) - 1 as bigint) as place from spans",
    on="spans",
)
def _(s, d):
    sent = cut(I.spans(s, d).withColumn("_place", F.col("family") * F.lit(1 << 58) + F.col("seq")))
    key = ["run_id", "mode"]
    return ordinal(sent, key, "_place", "place", hot=hot_groups(sent, key)).select(*key, "span_id", "place")


@query(
    "o08_sorted_key_sets",
    f"with {UNIQUE_SQL} select trace_id, verdict, string_agg(span_id, ',' order by span_id) as span_ids from diff where verdict <> 'equal' group by 1, 2",
    on="store",
)
def _(s, d):
    sent = cut(I.spans(s, d))
    rows = readback.differences(sent, I.damaged_store(sent)).where("verdict <> 'equal'").select("trace_id", "verdict", "span_id")
    numbered = J.with_sequence(rows, 0, ["trace_id", "verdict", "span_id"])
    key = ["trace_id", "verdict"]
    parts = exports.in_parts(numbered, key, "seq", F.col("span_id"), "ids", hot=hot_groups(numbered, key))
    return parts.select(*key, F.array_join("ids", ",").alias("span_ids"))


@query("u01_union_of_span_families", "select cast(family as int) as family, mode, count(*) as spans from spans group by 1, 2", on="spans")
def _(s, d):
    return I.spans(s, d).groupBy("family", "mode").agg(F.count("*").alias("spans"))


@query("u02_both_arms", "select run_id, count(distinct mode) as arms, count(distinct trace_id) as traces from spans group by 1", on="spans")
def _(s, d):
    return I.spans(s, d).groupBy("run_id").agg(F.count_distinct("mode").alias("arms"), F.count_distinct("trace_id").alias("traces"))


@query(
    "u03_set_differences",
    """select 'missing' as side, trace_id, span_id from (select trace_id, span_id from spans except select trace_id, span_id from store)
       union all select 'unexpected', trace_id, span_id from (select trace_id, span_id from store except select trace_id, span_id from spans)
       union all select 'both', trace_id, span_id from (select trace_id, span_id from store intersect select trace_id, span_id from spans)""",
    on="store",
)
def _(s, d):
    sent = cut(I.store_columns(I.spans(s, d)))
    key = ["trace_id", "span_id"]
    # All three sets by one aggregation: each set operation would shuffle both sides anew.
    side = lambda df, bit: df.select(*[X.packed_hex(F.col(c)).alias(c) for c in key], F.lit(bit).alias("sides"))
    found = side(sent, 1).unionByName(side(I.damaged_store(sent), 2)).groupBy(*key).agg(F.bit_or("sides").alias("sides"))
    name = F.when(F.col("sides") == 1, "missing").when(F.col("sides") == 2, "unexpected").otherwise("both")
    return found.select(*[X.unpacked_hex(F.col(c)).alias(c) for c in key], name.alias("side"))


@query(
    "u04_last_row_wins",
    "select trace_id, span_id, arg_max(case when ingest_seq % 8 >= 2 then name || '!' else name end, ingest_seq) as name, count(*) as copies from store group by 1, 2",
    on="store",
)
def _(s, d):
    renamed = I.store(s, d).withColumn("name", F.when(F.col("ingest_seq") % 8 >= 2, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return readback.unique_rows(renamed).select("trace_id", "span_id", "name", "copies")


@query(
    "u05_field_name_sets",
    "select event_id, event_id % 3 = 0 as same_fields from events",
)
def _(s, d):
    e = F.col("event_id")
    body = F.when(e % 3 == 0, '{"b":1,"a":2}').when(e % 3 == 1, '{"a":1}').otherwise('{"a":1,"b":2,"c":3}')
    wanted = F.array(F.lit("a"), F.lit("b"))
    rows = I.events_table(s, d).select("event_id", body.alias("body"))
    return rows.select("event_id", (F.array_sort(F.json_object_keys("body")) == wanted).alias("same_fields"))


@query(
    "u06_documents_of_both_versions",
    """select event_id, case when event_id % 2 = 0 then 1 else 2 end::bigint as schema_version, 2::bigint as attempts,
       case when event_id % 2 = 0 then 'none' else '1' end as provider_attempts, case when event_id % 2 = 0 then 'control' else 'control' end as second_mode from events""",
)
def _(s, d):
    from chronofold.operators.documents import normalize_old, parse_documents

    docs = I.two_versions(s, d)
    old = normalize_old(docs).select(
        "event_id", F.col("schemaVersion").alias("schema_version"), F.col("groundTruth.activationAttempts").alias("attempts"),
        F.col("groundTruth.providerAttempts").alias("provider_attempts"), F.col("control.mode").alias("second_mode"),
    )
    new = parse_documents(docs).where("d.schemaVersion = 2").select(
        "event_id", F.col("d.schemaVersion").alias("schema_version"), F.col("d.groundTruth.activationAttempts").alias("attempts"),
        F.col("d.groundTruth.providerAttempts").alias("provider_attempts"), F.col("d.control.mode").alias("second_mode"),
    )
    both = old.unionByName(new)
    return both.withColumn("provider_attempts", F.coalesce(F.col("provider_attempts").cast("string"), F.lit("none")))


@query(
    "u07_required_criteria",
    """select o_orderkey as lineage_id, n.p as position, case o_orderkey % 12 when 5 then 'missing' when 6 then 'not_true' else 'unknown' end as gap
       from orders cross join (values (1)) n(p) where o_orderkey % 12 in (5, 6, 7)""",
)
def _(s, d):
    receipts, _, _ = I.receipt_chains(s, d)
    gaps = artifacts.criteria_gaps(receipts.where(F.col("phase").isin(*artifacts.PHASES)))
    return gaps.select("lineage_id", F.col("position").cast("int").alias("position"), "gap")

