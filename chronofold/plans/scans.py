"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions.storage import LINES_COMPRESSION, cut, fresh_path, write_json
from chronofold.functions.running import hot_groups, ordinal
from chronofold.operators import admission, artifacts, documents, effects, exports, readback, state
from chronofold.operators.projection import effect_counts
from chronofold.plans import inputs as I
from chronofold.plans.registry import query
from chronofold.schemas import JOURNAL, JOURNAL_V1
from chronofold.sources.commits import AppendConflict, CommittedJournal
from chronofold.sources import journal as J


@query(
    "s01_run_events_in_order",
    "select run_id, seq, type, cast(row_number() over (partition by run_id order by seq) - 1 as bigint) as ordinal from journal",
    on="journal",
)
def _(s, d):
    j = I.journal(s, d)
    return ordinal(j, ["run_id"], "seq", hot=hot_groups(j, ["run_id"])).select("run_id", "seq", "type", "ordinal")


@query(
    "s02_prefix_of_each_run",
    "select j.run_id, j.seq, j.type from journal j join (select 'run-' || o_orderkey as run_id, o_orderkey * 32 + 2 + o_custkey % 18 as at_seq from orders) r on j.run_id = r.run_id and j.seq <= r.at_seq",
    on="journal",
)
def _(s, d):
    return state.prefixes(I.journal(s, d), _requests(s, d)).select("run_id", "seq", "type")


def _requests(s, d):
    return s.read.parquet(f"{d}/orders.parquet").selectExpr(
        "'run-' || o_orderkey as run_id", "o_orderkey * 32 + 2 + o_custkey % 18 as at_seq"
    )


@query("s03_runs_newest_first", "select run_id, min(seq) as first_seq from journal group by 1", on="journal")
def _(s, d):
    return J.list_runs(I.journal(s, d))


@query(
    "s04_schema_gate",
    """select c.name as column_name, c.name in ('activation_id', 'attempt_id', 'at_ns') as missing, n.rows_behind
       from (values ('activation_id'), ('at'), ('at_ns'), ('attempt_id'), ('node'), ('payload'), ('run_id'), ('seq'), ('type')) c(name)
       cross join (select count(*) as rows_behind from journal) n""",
    on="journal",
)
def _(s, d):
    old = I.journal(s, d).select(JOURNAL_V1.fieldNames())
    missing = J.missing_columns(old)
    gate = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in missing).alias("missing")) for c in JOURNAL.fieldNames()])
    return old.agg(F.count("*").alias("rows_behind")).select(F.explode(gate).alias("g"), "rows_behind").select("g.*", "rows_behind")


@query(
    "s05_upgrade_old_journal",
    """select seq, run_id, type, coalesce(cast(null as varchar), 'none') as activation_id, cast(0 as bigint) as at_ns,
       cast(trunc("at" * 1000000000.0e0) as bigint) as time_ns from journal""",
    on="journal",
)
def _(s, d):
    from chronofold.operators.decode import event_time

    up = J.upgrade(I.journal(s, d).select(JOURNAL_V1.fieldNames()))
    return up.select(
        "seq", "run_id", "type", F.coalesce("activation_id", F.lit("none")).alias("activation_id"), "at_ns", event_time().alias("time_ns")
    )


@query(
    "s06_decode_or_quarantine",
    """select seq, run_id, case when k % 7 = 0 then 'unknown_type' when k % 11 = 0 then 'payload_not_json'
         when k % 13 = 0 then 'payload_not_object' else 'ok' end as reason from facts""",
    on="journal",
)
def _(s, d):
    k = I.order_key()
    raw = I.journal(s, d).withColumns(
        {
            "type": F.when(k % 7 == 0, "strange").otherwise(F.col("type")),
            "payload": F.when(k % 11 == 0, F.substring("payload", 1, 5)).when(k % 13 == 0, "[1,2]").otherwise(F.col("payload")),
        }
    )
    return J.admit_rows(raw).select("seq", "run_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(
    "s07_effect_store",
    f"""with {I.ATTEMPTS_SQL} select idempotency_key, count(*) as attempts, min(seq) as first_seq, arg_min(amount_cents, seq) as amount_cents,
        'rf_' || substring(sha256(idempotency_key), 1, 10) as receipt from attempts group by idempotency_key""",
    on="journal",
)
def _(s, d):
    a = I.attempts(s, d)
    kept, _ = effects.apply_once(a)
    calls = a.groupBy("idempotency_key").agg(F.count("*").alias("attempts"), F.min("seq").alias("first_seq"))
    return calls.join(kept, "idempotency_key")


@query(
    "s08_trace_store_scan",
    """with w as (select trace_id, greatest(0, min(start_ns) // 1000000 - 300000) as lo, max(end_ns) // 1000000 + 300000 as hi from spans group by 1)
       select s.trace_id, s.span_id, s.name, s.ts_ms, row_number() over (partition by s.trace_id order by ts_ms, ingest_seq) as rank
       from store s join w on s.trace_id = w.trace_id and s.ts_ms between w.lo and w.hi
       qualify row_number() over (partition by s.trace_id order by ts_ms, ingest_seq) <= 1000""",
    on="store",
)
def _(s, d):
    sent = cut(I.spans(s, d))
    rows = readback.scan_traces(I.damaged_store(sent), readback.query_windows(sent))
    return rows.select("trace_id", "span_id", "name", "ts_ms", F.col("rank").cast("bigint").alias("rank"))


@query(
    "s09_flatten_response",
    """select run_id || '/' || mode as id, trace_id, span_id, coalesce(parent_span_id, 'none') as parent_span_id, name,
       'chronofold-' || mode as service_name, operation as operation_name, coalesce(source, 'none') as effect_source from spans""",
    on="spans",
)
def _(s, d):
    row = F.struct(
        F.struct(
            "trace_id",
            "span_id",
            "parent_span_id",
            "name",
            F.concat(F.lit("chronofold-"), "mode").alias("service.name"),
            F.col("attributes.operation_name").alias("flow.operation.name"),
            F.col("attributes.effect_source").alias("flow.effect.source"),
        ).alias("data")
    )
    # One response per span: the response of a whole trace would be one growing row.
    results = F.array(
        F.struct(F.lit("A").alias("queryName"), F.array(row).alias("rows")),
        F.struct(F.lit("B").alias("queryName"), F.array(row).alias("rows")),
        F.struct(F.lit("A").alias("queryName"), F.slice(F.array(row), 1, 0).alias("rows")),
    )
    body = F.to_json(F.struct(F.struct(F.struct(results.alias("results")).alias("data")).alias("data")))
    responses = I.spans(s, d).select(F.concat_ws("/", "run_id", "mode").alias("id"), body.alias("body"))
    none = F.lit("none")
    return readback.flatten_response(responses).withColumns(
        {"parent_span_id": F.coalesce("parent_span_id", none), "effect_source": F.coalesce("effect_source", none)}
    )


@query(
    "s10_documents_with_bad_files",
    """select 'f' || event_id as id, event_id % 5 <> 0 as readable, case when event_id % 5 <> 0 then 'run-' || event_id else 'none' end as run_id
       from events""",
)
def _(s, d):
    text = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 3)).otherwise(
        F.concat(F.lit('{"schemaVersion":2,"runId":"run-'), F.col("event_id").cast("string"), F.lit('"}'))
    )
    files = I.events_table(s, d).select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("id"), text.alias("body"))
    parsed = documents.parse_documents(files)
    return parsed.select("id", "readable", F.coalesce("d.runId", F.lit("none")).alias("run_id"))


@query(
    "s11_artifacts_with_digest",
    f"""select grp as "group", path, sha256(text) as sha256, cast(strlen(text) as bigint) as bytes
        from (select {I.PATHS_SQL} as path, {I.GROUP_SQL} as grp, text from documents) where grp is not null""",
)
def _(s, d):
    return artifacts.artifact_references(I.text_files(s, d))


@query(
    "s12_control_files",
    """select event_id, case when event_id % 3 = 0 then 'json_invalid' when event_id % 3 = 1 then 'not_an_object' else 'ok' end as verdict from events""",
)
def _(s, d):
    e = F.col("event_id")
    content = F.when(e % 3 == 0, F.concat("props", F.lit("}"))).when(e % 3 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return artifacts.control_files(I.events_table(s, d).select("event_id", content.alias("content"))).select("event_id", "verdict")


OBSERVATIONS_SQL = """observations as (select workflow as group_key,
  case when sum(case when mode = 'control' and classification = 'executed' then 1 else 0 end) >
            sum(case when mode = 'aware' and classification = 'executed' then 1 else 0 end) then 1.0e0 else 0.0e0 end as value
  from spans s where family >= 0 group by run_id, workflow)"""


def observations(s, d):
    sent = cut(I.spans(s, d).select("run_id", "mode", "family", "classification", I.attributes("workflow_version")))  # read twice
    workflow = sent.where("family = 0 and mode = 'aware'").select("run_id", F.col("attributes.workflow_version").alias("group_key"))
    return J.observations(effect_counts(sent).join(workflow, "run_id"))


@query(
    "s14_rate_observations",
    f"with {OBSERVATIONS_SQL} select group_key, value, count(*) as runs from observations group by 1, 2",
    on="spans",
)
def _(s, d):
    return observations(s, d).groupBy("group_key", "value").agg(F.count("*").alias("runs"))


@query(
    "k01_append_admission",
    """with j as (select seq, case when k % 9 = 1 then 'unregistered_run' when k % 9 = 2 then 'empty_run_id' when k % 9 = 3 then 'unsupported_schema'
         when k % 9 = 4 then 'bad_time' when k % 9 = 5 then 'payload_not_object' else 'accepted' end as reason from facts)
       select seq as request_seq, reason, case when reason = 'accepted' then 1000 + row_number() over (partition by reason order by (seq // 32) % 2, seq) - 1 else -1 end as seq from j""",
    on="journal",
)
def _(s, d):
    k = I.order_key()
    rows = I.journal(s, d).withColumn("kind", k % 9)
    rows = rows.withColumns(
        {
            "run_id": F.when(F.col("kind") == 1, F.concat(F.lit("new-"), "run_id")).when(F.col("kind") == 2, "").otherwise(F.col("run_id")),
            "at_ns": F.when(F.col("kind") == 4, F.lit(0)).otherwise(F.col("at_ns")),
            "payload": F.when(F.col("kind") == 5, F.lit("7")).otherwise(F.col("payload")),
        }
    )
    known = I.runs(s, d).withColumn("schema_version", F.when(I.order_key() % 9 == 3, 1).otherwise(F.col("schema_version")))
    rows = rows.withColumn("request_seq", F.col("seq"))
    log = CommittedJournal(s, fresh_path(s, "committed"), first=1_000)
    parts = {name: rows.where(F.expr("(request_seq div 32) % 2") == i) for i, name in enumerate(("even", "odd"))}
    log.append(parts["even"], known, batch_id="even", expected=1_000, order=["request_seq"])
    _, end = log.end()
    log.append(parts["even"], known, batch_id="even", expected=end, order=["request_seq"])  # again: nothing changes
    try:
        log.append(parts["odd"], known, batch_id="odd", expected=1_000, order=["request_seq"])
        raise RuntimeError("an append behind the journal's end must be refused")
    except AppendConflict:
        log.append(parts["odd"], known, batch_id="odd", expected=end, order=["request_seq"])
    written = log.journal().select("request_seq", F.lit("accepted").alias("reason"), "seq")
    return written.unionByName(log.quarantine().select("request_seq", "reason", F.lit(-1).cast("bigint").alias("seq")))


@query(
    "k02_begin_run_once",
    """select run_id, 'settle' as node, 'act_' || substring(sha256(run_id || '|1'), 1, 32) as activation_id,
         '{"activation_id":"act_' || substring(sha256(run_id || '|1'), 1, 32) || '","input":{"amount_cents":' || cents ||
         '},"journal_schema_version":2,"start_node":"settle","workflow_version":"settle/v1"}' as payload, at_ns
       from (select 'new-' || k as run_id, cents, at_ns from facts where type = 'run_started' and k % 3 = 0)""",
    on="journal",
)
def _(s, d):
    started = I.facts(s, d).where("type = 'run_started'")
    twice = started.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("new-"), F.col("k").cast("string"))).otherwise(F.col("run_id"))
    requests = twice.select(
        (F.col("k") * 2 + F.col("n")).alias("request_seq"),
        name.alias("run_id"),
        F.concat(F.lit('{ "amount_cents": '), (F.col("cents") + F.col("n")).cast("string"), F.lit(" }")).alias("input"),
        F.lit("settle").alias("start_node"),
        F.lit("settle/v1").alias("workflow_version"),
        "at_ns",
    )
    known = I.runs(s, d).where(I.order_key() % 3 == 1)  # the rest is known by its events only
    return admission.begin_runs(requests, known, I.journal(s, d)).drop("type")


PUBLIC_SQL = """case type
  when 'run_started' then '{"activation_id":"' || activation_id || '","input":{"redacted":true},"journal_schema_version":2,"start_node":"settle","workflow_version":"' || workflow || '"}'
  when 'attempt_started' then '{"recovery":' || cast(recovery as varchar) || '}'
  when 'attempt_abandoned' then '{"reason":{"redacted":true}}'
  when 'attempt_failed' then '{"error":{"redacted":true}}'
  when 'awaiting_approval' then '{"state":{"redacted":true}}'
  when 'approval_granted' then '{"at_ns":' || at_ns || ',"by":{"redacted":true}}'
  when 'approval_denied' then '{"at_ns":' || at_ns || ',"by":{"redacted":true}}'
  when 'activation_finished' then '{"next_activation_id":' || case when next_act is null then 'null' else '"act-' || k || '-' || next_act || '"' end || ',"next_node":"' || next_node || '","patch":{"redacted":true}}'
  when 'run_finished' then '{"state":{"redacted":true}}'
  when 'run_failed' then '{"reason":{"redacted":true}}'
  when 'effect_completed' then '{"adapter_version":"store/v1","effect_id":"settle","ended_at_ns":' || at_ns || ',"idempotency_key_fingerprint":' || case when retry_safe then '"' || key_fp || '"' else 'null' end || ',"index":0,"label":"payments:settle","request_fingerprint":"' || request_fp || '","result":{"redacted":true},"retry_safe":' || cast(retry_safe as varchar) || ',"source_intent_seq":' || (k * 32 + src_off) || ',"started_at_ns":' || case when lag_ns < 0 then at_ns + 1 else started_ns end || '}'
  when 'effect_intent' then '{"adapter_version":"store/v1","effect_id":"settle","idempotency_key_fingerprint":' || case when retry_safe then '"' || key_fp || '"' else 'null' end || ',"index":0,"label":"payments:settle","request_fingerprint":"' || request_fp || '","retry_of_intent_seq":' || coalesce(cast(k * 32 + src_off as varchar), 'null') || ',"retry_safe":' || cast(retry_safe as varchar) || ',"started_at_ns":' || at_ns || '}'
  else '{"adapter_version":"store/v1","effect_id":"settle","ended_at_ns":' || at_ns || ',"idempotency_key_fingerprint":' || case when retry_safe then '"' || key_fp || '"' else 'null' end || ',"index":0,"label":"payments:settle","request_fingerprint":"' || request_fp || '","retry_safe":' || cast(retry_safe as varchar) || ',"source_effect_seq":' || (k * 32 + src_off) || ',"source_intent_seq":' || (k * 32 + int_off) || ',"started_at_ns":' || at_ns || '}'
  end"""

# Expected outcome of each fixture run (scenario or defect), from its construction.
FOLD_SQL = """expected as (select distinct k, run_id, tkey,
  case tkey when 11 then 'E03' when 12 then 'E11' when 13 then 'E21' when 14 then 'E21' when 15 then 'E21' when 16 then 'E22' end as rule,
  case when tkey in (0,1,2,5,6,7) then 'finished' when tkey in (3,4,8) then 'failed' when tkey = 9 then 'running' when tkey = 10 then 'awaiting_approval' end as status,
  case when tkey in (0,1,2,5,6,7) then '__end__' when tkey < 11 then 'settle' end as next_node from facts)"""


@query(
    "k03_nested_run_export",
    f"""with {FOLD_SQL}, ev as (select run_id, string_agg(seq || ':' || type || ':' || {PUBLIC_SQL}, '|' order by seq) as events, count(*) as n,
          string_agg(case when type = 'activation_finished' then 'settle' end, '>' order by seq) as completed from facts group by run_id)
        select e.run_id, cast(0 as bigint) as part, e.status, e.next_node, coalesce(v.completed, '') as completed, sha256(v.events) as events_sha256,
          v.n as n_events, 'settle' as start, 1::bigint as graph_nodes
        from expected e join ev v on e.run_id = v.run_id where e.rule is null""",
    on="journal",
)
def _(s, d):
    out = exports.export_runs(I.journal(s, d), I.states(s, d), I.graph_nodes(s))
    line = F.transform("events", lambda e: F.concat_ws(":", e["seq"].cast("string"), e["type"], e["payload"]))
    return out.select(
        F.col("runId").alias("run_id"),
        "part",
        "status",
        F.col("nextNode").alias("next_node"),
        F.array_join("completed", ">").alias("completed"),
        F.sha2(F.array_join(line, "|"), 256).alias("events_sha256"),
        F.size("events").cast("bigint").alias("n_events"),
        F.col("graph.start").alias("start"),
        F.size("graph.nodes").cast("bigint").alias("graph_nodes"),
    )


@query(
    "k04_span_envelopes",
    """select run_id, mode, cast(0 as bigint) as part, trace_id, count(*) as span_count, 'chronofold-' || mode as service,
         string_agg(identity, '|' order by family, seq) as identities from spans group by run_id, mode, trace_id""",
    on="spans",
)
def _(s, d):
    sent = cut(I.spans(s, d).drop("classification", "links", "duration_ns"))
    digests = sent.select("run_id").distinct().withColumn("journal_sha256", F.sha2("run_id", 256))
    env = exports.envelopes(sent, digests)
    return env.select(
        "run_id", "mode", "part", "trace_id", "span_count", F.col("resource.`service.name`").alias("service"),
        F.array_join(F.transform("spans", lambda x: x["identity"]), "|").alias("identities"),
    )


SPAN_LINE_SQL = """'{"attributes":' || attributes || ',"end_time_unix_nano":' || end_ns || ',"kind":"INTERNAL","name":"' || name ||
  '","parent_span_id":' || coalesce('"' || parent_span_id || '"', 'null') || ',"span_id":"' || span_id || '","start_time_unix_nano":' || start_ns ||
  ',"status":"' || status || '","trace_id":"' || trace_id || '"}'"""


@query("k05_span_lines", f"select {SPAN_LINE_SQL} as value from spans", on="spans")
def _(s, d):
    path = fresh_path(s, "span-lines")
    lines = I.spans(s, d).select(exports.span_document().alias("value"))
    lines.write.mode("append").option("compression", LINES_COMPRESSION).text(path)
    return s.read.text(path)


@query(
    "k06_reference_of_written_lines",
    f"select count(*) as lines, cast(sum(strlen({SPAN_LINE_SQL}) + 1) as bigint) as bytes, true as references_hold from spans",
    on="spans",
)
def _(s, d):
    path = fresh_path(s, "referenced")
    lines = I.spans(s, d).select(exports.span_document().alias("value"))
    # A file is hashed whole, so its lines are limited: about 50 MB before compression.
    lines.write.option("maxRecordsPerFile", 100_000).option("compression", LINES_COMPRESSION).text(path)
    files = artifacts.written_references(s, path)
    inside = s.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("line_bytes")
    )
    whole = s.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("content"))
    both = files.join(inside, "path", "left").join(whole, "path", "left")
    holds = (F.col("bytes") == F.coalesce("line_bytes", F.lit(0))) & ((F.col("sha256") == F.col("content")) | (F.col("bytes") == 0))
    return both.agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.bool_and(holds).alias("references_hold"))


@query("k08_replace_only_when_told", "select run_id, mode, span_id, 'replaced' as version from spans", on="spans")
def _(s, d):
    path = fresh_path(s, "replace")
    rows = cut(I.spans(s, d).select("run_id", "mode", "span_id"))  # written twice, made once
    write_json(rows.withColumn("version", F.lit("first")), path)
    try:
        write_json(rows.withColumn("version", F.lit("second")), path)
    except Exception as refused:  # the path exists
        if "PATH_ALREADY_EXISTS" not in str(refused):
            raise
    else:
        raise AssertionError("an existing export was replaced")
    write_json(rows.withColumn("version", F.lit("replaced")), path, replace=True)
    return s.read.schema("run_id string, mode string, span_id string, version string").json(path)


@query(
    "k09_journal_digest",
    """select run_id, sha256(sha256(string_agg(sha256(concat_ws(chr(31), cast(seq as varchar), type, coalesce(node, chr(0)), coalesce(activation_id, chr(0)),
         coalesce(attempt_id, chr(0)), payload, cast(at_ns as varchar))), '' order by seq))) as journal_sha256 from journal group by run_id""",
    on="journal",
)
def _(s, d):
    return exports.journal_digests(I.journal(s, d))

