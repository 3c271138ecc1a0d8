"""Queries over scalar functions, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.operators import readback, redaction, state
from chronofold.operators.exports import resource_attributes
from chronofold.operators.projection import attributes_json
from chronofold.plans import inputs as I
from chronofold.plans.registry import query
from chronofold.plans.scans import FOLD_SQL, PUBLIC_SQL


@query(
    "x01_canonical_json",
    """select event_id, case when event_id % 11 = 0 then null else '{"a":' || event_id || ',"k":' || json_extract_string(props, '$.k') ||
         case when event_id % 3 = 0 then ',"n":[' || event_id || '.0,1e+16,1e-07,0.5,' || event_id || '123456789012345678901234567890123456789012,"ü/\\n"]' else '' end ||
         ',"z":{"b":[1,null],"c":"' || event_type || '"}}' end as canonical from events""",
)
def _(s, d):
    number = F.col("event_id").cast("string")
    odd = F.concat(
        F.lit(',"n" : ['), number, F.lit(".0, 1e16, 1E-7, 0.50, "), number,
        F.lit('123456789012345678901234567890123456789012, "\\u00fc\\/\\n"]'),
    )
    text = F.concat(
        F.lit('{ "z" : {"c":"'), "event_type", F.lit('", "b":[1, null]}'), F.when(F.col("event_id") % 3 == 0, odd).otherwise(F.lit("")),
        F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit(', "a":'), number,
        F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return I.events_table(s, d).select("event_id", X.canonical_json(text).alias("canonical"))


@query("x02_request_fingerprint", "select run_id, seq, request_fp as fingerprint from facts", on="journal")
def _(s, d):
    spaced = F.regexp_replace("request", ":", " : ")
    return I.facts(s, d).select("run_id", "seq", X.fingerprint(spaced).alias("fingerprint"))


@query(
    "x03_key_fingerprint",
    "select seq, case when k % 3 = 0 or k % 3 = 1 then 'none' else key_fp end as fingerprint from facts",
    on="journal",
)
def _(s, d):
    key = F.when(F.col("k") % 3 == 0, F.lit(None).cast("string")).when(F.col("k") % 3 == 1, "").otherwise(F.col("effect_key"))
    return I.facts(s, d).select("seq", F.coalesce(X.key_fingerprint(key), F.lit("none")).alias("fingerprint"))


@query(
    "x04_nonzero_digest",
    "select run_id, substring(sha256(run_id), 1, 8) as four, substring(sha256(run_id), 1, 32) as sixteen from (select distinct run_id from facts)",
    on="journal",
)
def _(s, d):
    runs = I.runs(s, d)
    return runs.select("run_id", X.nonzero_digest(F.col("run_id"), 4).alias("four"), X.nonzero_digest(F.col("run_id"), 16).alias("sixteen"))


@query(
    "x05_trace_id",
    "select run_id, mode, substring(sha256('chronofold:trace:' || mode || ':' || run_id), 1, 32) as trace_id from (select distinct run_id from facts) cross join (values ('aware'), ('control')) m(mode)",
    on="journal",
)
def _(s, d):
    both = I.runs(s, d).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in N.MODES])))
    return both.select("run_id", "mode", X.trace_id(F.col("run_id"), F.col("mode")).alias("trace_id"))


@query(
    "x06_span_id",
    "select seq, substring(sha256('chronofold:span:aware:' || run_id || ':effect-execute:' || seq), 1, 16) as span_id from facts",
    on="journal",
)
def _(s, d):
    identity = F.concat(F.lit("effect-execute:"), F.col("seq").cast("string"))
    return I.journal(s, d).select("seq", X.span_id(F.col("run_id"), F.lit("aware"), identity).alias("span_id"))


@query(
    "x07_hex_rendering",
    """select seq, lpad(to_hex(at_ns), 16, '0') as span_hex_upper, lower(lpad(to_hex(at_ns), 16, '0')) as span_hex,
         lower(lpad(to_hex(cast(seq as hugeint) * 1000000007 * 1000000009 * 1000000021), 32, '0')) as trace_hex,
         'ffffffffffffffff' || lower(to_hex(18446744073709551615::ubigint - cast(seq as ubigint))) as high_trace_hex from facts""",
    on="journal",
)
def _(s, d):
    big = F.col("seq").cast("decimal(10,0)") * F.lit(1000000007).cast("decimal(10,0)")
    big = (big.cast("decimal(20,0)") * F.lit("1000000030000000189").cast("decimal(19,0)")).cast("decimal(38,0)")
    # 2**128 - 1 - seq, an id of 39 digits.
    low = F.lit("63374607431768211455").cast("decimal(20,0)") - F.col("seq").cast("decimal(20,0)")
    high = F.concat(F.lit("3402823669209384634"), F.lpad(low.cast("decimal(20,0)").cast("string"), 20, "0"))
    span = X.span_hex(F.col("at_ns"))
    return I.journal(s, d).select("seq", F.upper(span).alias("span_hex_upper"), span.alias("span_hex"), X.trace_hex(big).alias("trace_hex"), X.trace_hex(high).alias("high_trace_hex"))


@query("x08_effect_key", "select seq, effect_key from facts where act is not null", on="journal")
def _(s, d):
    j = I.journal(s, d).where("activation_id is not null")
    return j.select("seq", X.effect_key(F.col("run_id"), F.col("activation_id"), "settle").alias("effect_key"))


@query("x09_receipt_token", "select seq, 'rf_' || substring(key_fp, 1, 10) as receipt from facts", on="journal")
def _(s, d):
    return I.facts(s, d).select("seq", X.receipt_token(F.col("effect_key")).alias("receipt"))


@query("x10_stable_id", "select seq, 'att_' || substring(sha256(run_id || '|' || seq), 1, 32) as new_id from facts", on="journal")
def _(s, d):
    return I.journal(s, d).select("seq", X.stable_id("att", F.col("run_id"), F.col("seq").cast("string")).alias("new_id"))


@query(
    "x11_event_clock",
    """select seq, case when seq % 4 = 0 then cast(trunc("at" * 1000000000.0e0) as bigint) else at_ns end as time_ns from journal""",
    on="journal",
)
def _(s, d):
    from chronofold.operators.decode import event_time

    j = I.journal(s, d).withColumn("at_ns", F.when(F.col("seq") % 4 == 0, F.lit(0)).otherwise(F.col("at_ns")))
    return j.select("seq", event_time().alias("time_ns"))


def _attributes(test: str):
    def run(s, d):
        return I.spans(s, d).where(test).select("span_id", attributes_json().alias("attributes"))

    return run


for _name, _spark, _duck in (
    ("x12_run_attributes", "family = 0", "family = 0"),
    ("x13_attempt_attributes", "family = 1", "family = 1"),
    ("x14_effect_attributes", "family > 1", "family > 1"),
):
    query(_name, f"select span_id, attributes from spans where {_duck}", on="spans")(_attributes(_spark))


@query(
    "x15_public_payload",
    f"""select seq, {PUBLIC_SQL} as payload from facts
        union all select -seq, 'none' from facts where k % 10 = 0""",
    on="journal",
)
def _(s, d):
    rows = I.journal(s, d).select("run_id", "seq", "type", "payload")
    # Damaged copies: the text ends inside its object.
    torn = rows.where(I.order_key() % 10 == 0).withColumns({"seq": -F.col("seq"), "payload": F.expr("substring(payload, 1, length(payload) - 1)")})
    shown = F.coalesce(redaction.public_payload(), F.lit("none"))
    return rows.unionByName(torn).select("seq", shown.alias("payload"))


@query("x16_span_duration", "select span_id, end_ns - start_ns as duration_ns from spans", on="spans")
def _(s, d):
    return I.spans(s, d).select("span_id", "duration_ns")


@query(
    "x17_duration_label",
    """select seq, case when n < 1000 then n || ' ns'
         when n < 1000000 then printf('%.1f', n / 1e3 + case when n % 1000 in (250, 750) then 0.01 else 0 end) || ' µs'
         when n < 1000000000 then printf('%.1f', n / 1e6 + case when n % 1000000 in (250000, 750000) then 0.01 else 0 end) || ' ms'
         else printf('%.2f', n / 1e9 + case when n % 1000000000 in (125000000, 375000000, 625000000, 875000000) then 0.001 else 0 end) || ' s' end as label
       from (select seq, case seq % 5 when 0 then 0 when 1 then seq % 1000 when 2 then k * 7 + 1000 when 3 then k * 1009 + 1000000 else k * 1000003 + 1000000000 end as n from facts)""",
    on="journal",
)
def _(s, d):
    n = F.expr(
        "case seq % 5 when 0 then 0 when 1 then seq % 1000 when 2 then k * 7 + 1000 when 3 then k * 1009 + 1000000 else k * 1000003 + 1000000000 end"
    )
    return I.facts(s, d).select("seq", X.duration_label(n).alias("label"))


@query("x18_ns_as_text", "select seq, cast(at_ns as varchar) as at_unix_nano from facts", on="journal")
def _(s, d):
    return I.journal(s, d).select("seq", X.ns_text(F.col("at_ns")).alias("at_unix_nano"))


@query(
    "x19_query_window",
    """select run_id, mode, trace_id, greatest(0, min(start_ns) // 1000000 - 300000)::bigint as start_ms, max(end_ns) // 1000000 + 300000 as end_ms,
       greatest(100, count(*) * 4)::bigint as row_limit from spans group by 1, 2, 3""",
    on="spans",
)
def _(s, d):
    return readback.query_windows(I.spans(s, d))


@query(
    "x20_field_normaliser",
    """select ingest_seq, lower(trace_id) as trace_id, lower(span_id) as span_id, coalesce(nullif(parent_span_id, ''), 'none') as parent_span_id,
       coalesce(nullif(effect_source, ''), 'none') as effect_source from store""",
    on="store",
)
def _(s, d):
    rows = I.store(s, d).withColumns({"trace_id": F.upper("trace_id"), "span_id": F.upper("span_id")})
    none = F.lit("none")
    return readback.normalized(rows).select(
        "ingest_seq", "trace_id", "span_id", F.coalesce("parent_span_id", none).alias("parent_span_id"),
        F.coalesce("effect_source", none).alias("effect_source"),
    )


@query(
    "x21_typed_checks",
    "select seq, k % 4 <> 0 and k % 4 <> 3 as text_ok, k % 5 not in (0, 1, 2) as integer_ok, k % 5 = 4 as time_ok from facts",
    on="journal",
)
def _(s, d):
    from chronofold.operators.decode import text_of

    texts = "case k % 4 when 0 then '\"\"' when 3 then '5' else '\"x\"' end"
    numbers = "case k % 5 when 0 then 'true' when 1 then '\"7\"' when 2 then '1.5' when 3 then '0' else '12' end"
    body = F.concat(F.lit('{"t":'), F.expr(texts), F.lit(',"n":'), F.expr(numbers), F.lit("}"))
    p = I.facts(s, d).select("seq", F.from_json(body, "t variant, n bigint").alias("p"))
    return p.select(
        "seq",
        text_of("p.t").isNotNull().alias("text_ok"),
        F.col("p.n").isNotNull().alias("integer_ok"),
        F.coalesce(F.col("p.n") >= 1, F.lit(False)).alias("time_ok"),
    )


@query(
    "x22_form_predicates",
    """select event_id, event_id % 2 = 0 as sha_ok, event_id % 3 = 0 as trace_ok, event_id % 5 <> 0 as run_ok, event_id % 7 <> 0 as lineage_ok from events""",
)
def _(s, d):
    e = F.col("event_id")
    h = F.sha2(e.cast("string"), 256)
    return I.events_table(s, d).select(
        "event_id",
        X.is_hex(F.when(e % 2 == 0, h).otherwise(F.concat(F.substring(h, 1, 63), F.lit("G"))), 64).alias("sha_ok"),
        X.is_hex(F.when(e % 3 == 0, F.substring(h, 1, 32)).otherwise(F.substring(h, 1, 31)), 32).alias("trace_ok"),
        X.is_run_id(F.concat(F.when(e % 5 == 0, "-").otherwise("r"), e.cast("string"))).alias("run_ok"),
        X.is_lineage_id(F.concat(F.lit("v"), e.cast("string"), F.when(e % 7 == 0, "-").otherwise("x"))).alias("lineage_ok"),
    )


_URLS = (
    # url template with the id, loopback origin?, loopback endpoint?, cleaned form
    ("http://127.0.0.1:{}/", True, True, "http://127.0.0.1:{}/"),
    ("http://localhost:{}", True, True, "http://localhost:{}"),
    ("http://[::1]:{}", True, True, "http://[::1]:{}"),
    ("https://localhost:{}/v1/traces", False, True, "https://localhost:{}/v1/traces"),
    ("http://user:pw@127.0.0.1:{}/x?q=1#f", False, False, "http://127.0.0.1:{}/x"),
    ("http://10.0.0.1:{}/", False, False, "http://10.0.0.1:{}/"),
    ("http://127.0.0.1/{}", False, True, "http://127.0.0.1/{}"),
    ("http://a b:{}", False, False, "<invalid-endpoint>"),
)
_URL_CASES = " ".join(f"when {i} then '{u.split('{}')[0]}' || (1000 + event_id % 9000) || '{u.split('{}')[1]}'" for i, (u, *_r) in enumerate(_URLS))
_CLEAN_CASES = " ".join(
    f"when {i} then '{c.split('{}')[0]}'" + (f" || (1000 + event_id % 9000) || '{c.split('{}')[1]}'" if "{}" in c else "")
    for i, (*_r, c) in enumerate(_URLS)
)
_ORIGINS = ", ".join(str(i) for i, u in enumerate(_URLS) if u[1])
_ENDPOINTS = ", ".join(str(i) for i, u in enumerate(_URLS) if u[2])


@query(
    "x23_loopback_urls",
    f"""select event_id, event_id % 8 in ({_ORIGINS}) as origin_ok, event_id % 8 in ({_ENDPOINTS}) as endpoint_ok,
        case event_id % 8 {_CLEAN_CASES} end as cleaned from events""",
)
def _(s, d):
    rows = I.events_table(s, d).withColumn("url", F.expr(f"case event_id % 8 {_URL_CASES} end"))
    u = F.col("url")
    return rows.select(
        "event_id",
        X.is_loopback_origin(u).alias("origin_ok"),
        X.is_loopback_endpoint(u).alias("endpoint_ok"),
        X.safe_endpoint(u).alias("cleaned"),
    )


@query(
    "x24_confined_paths",
    """select event_id, event_id % 6 in (0, 5) as confined, event_id % 6 in (0, 4) as canonical from events""",
)
def _(s, d):
    path = F.expr(
        "case event_id % 6 when 0 then 'a/b' || event_id when 1 then '/a' || event_id when 2 then 'a/../b' || event_id "
        "when 3 then '' when 4 then 'C:x' || event_id else 'a//b' || event_id end"
    )
    return I.events_table(s, d).withColumn("path", path).select(
        "event_id", X.is_confined_path(F.col("path")).alias("confined"), X.is_canonical_path(F.col("path")).alias("canonical")
    )


@query("x25_legacy_ns_text", "select seq, cast(at_ns as varchar) as nanos from facts", on="journal")
def _(s, d):
    return I.journal(s, d).select("seq", X.legacy_ns_text(F.col("at_ns")).alias("nanos"))


@query(
    "x26_forbidden_attributes",
    "select seq, k % 3 = 0 as forbidden from facts",
    on="journal",
)
def _(s, d):
    prefix = F.when(F.col("k") % 3 == 0, "gen_ai.").otherwise("flow.")
    text = F.concat(F.lit('{"'), prefix, F.lit('model":"'), "run_id", F.lit('"}'))
    return I.facts(s, d).select("seq", X.has_forbidden_attribute(text).alias("forbidden"))


@query("x27_span_names", "select span_id, name, identity from spans", on="spans")
def _(s, d):
    return I.spans(s, d).select("span_id", "name", "identity")


@query("x28_trace_url", "select distinct trace_id, 'http://127.0.0.1:8080/trace/' || trace_id as url from spans", on="spans")
def _(s, d):
    traces = I.spans(s, d).select("trace_id").distinct()
    return traces.select("trace_id", X.trace_url(F.lit("http://127.0.0.1:8080//"), F.col("trace_id")).alias("url"))


@query("x29_event_detail", f"select seq, type, coalesce(node, '') as node, substring({PUBLIC_SQL}, 1, 90) as detail from (select *, case when type = 'run_finished' or (type = 'run_failed' and tkey <> 8) then null else 'settle' end as node from facts)", on="journal")
def _(s, d):
    j = I.journal(s, d)
    return j.select("seq", "type", F.coalesce("node", F.lit("")).alias("node"), X.event_detail(redaction.public_payload()).alias("detail"))


STATE_SQL = """merged as (select run_id, '{' || concat_ws(',', '"amount_cents":' || max(case when type = 'run_started' then cents end),
    '"receipt":' || max(case when type = 'activation_finished' then '"' || json_extract_string(patch, '$.receipt') || '"' end),
    '"visit":' || max(case when type = 'activation_finished' and tkey = 6 then act end)) || '}' as state
  from (select *, row_number() over (partition by run_id, type order by seq desc) as back from facts)
  where type = 'run_started' or (type = 'activation_finished' and back = 1) group by run_id)"""


@query(
    "x30_shallow_patch_merge",
    f"with {STATE_SQL} select m.run_id, m.state from merged m where m.run_id in (select run_id from facts where type = 'run_started')",
    on="journal",
)
def _(s, d):
    j = I.journal(s, d)
    started = j.where(F.col("type") == N.RUN_STARTED).select("run_id")
    return state.merged_state(j).join(started, "run_id", "left_semi")


@query(
    "x31_resource_attributes",
    """select distinct run_id, mode, '{"service.name":"chronofold-' || mode || '","service.version":"1","telemetry.sdk.language":"python"}' as resource from spans""",
    on="spans",
)
def _(s, d):
    rows = I.spans(s, d).select("run_id", "mode").distinct()
    return rows.select("run_id", "mode", F.to_json(resource_attributes(F.col("mode"))).alias("resource"))


@query(
    "f01_one_of_each_type",
    "select run_id, type, count(*) as n, count(*) = 1 as single from facts where type in ('run_started', 'effect_intent', 'run_finished') group by 1, 2",
    on="journal",
)
def _(s, d):
    j = I.journal(s, d).where(F.col("type").isin(N.RUN_STARTED, N.EFFECT_INTENT, N.RUN_FINISHED))
    return j.groupBy("run_id", "type").agg(F.count("*").alias("n")).withColumn("single", F.col("n") == 1)


@query(
    "f02_retained_fields",
    """select run_id, mode, trace_id, span_id, coalesce(parent_span_id, 'none') as parent_span_id, name, 'chronofold-' || mode as service_name,
       operation as operation_name, coalesce(source, 'none') as effect_source from spans""",
    on="spans",
)
def _(s, d):
    none = F.lit("none")
    return readback.retained_fields(I.spans(s, d)).withColumns(
        {"parent_span_id": F.coalesce("parent_span_id", none), "effect_source": F.coalesce("effect_source", none)}
    )


@query(
    "f03_arm_projection",
    """select mode, trace_id, span_id, 'chronofold-' || mode as service_name, 'http://127.0.0.1:8080/trace/' || trace_id as trace_url,
       cast(start_ns as varchar) as start_text, cast(end_ns as varchar) as end_text, cast(end_ns - start_ns as varchar) as duration_text from spans""",
    on="spans",
)
def _(s, d):
    return I.spans(s, d).select(
        "mode",
        "trace_id",
        "span_id",
        F.concat(F.lit("chronofold-"), "mode").alias("service_name"),
        X.trace_url(F.lit("http://127.0.0.1:8080"), F.col("trace_id")).alias("trace_url"),
        X.ns_text(F.col("start_time_ns")).alias("start_text"),
        X.ns_text(F.col("end_time_ns")).alias("end_text"),
        X.ns_text(F.col("duration_ns")).alias("duration_text"),
    )


@query(
    "f04_source_facts",
    f"with {I.ATTEMPTS_SQL} select run_id, count(*) as provider_attempts, count(distinct idempotency_key) as business_executions, max(sha256(idempotency_key)) as key_sha256 from attempts group by 1",
    on="journal",
)
def _(s, d):
    return I.attempts(s, d).groupBy("run_id").agg(
        F.count("*").alias("provider_attempts"),
        F.count_distinct("idempotency_key").alias("business_executions"),
        F.max(F.sha2("idempotency_key", 256)).alias("key_sha256"),
    )


@query(
    "f05_journal_table",
    f"""select seq, type, coalesce(case when type = 'run_finished' or (type = 'run_failed' and tkey <> 8) then null else 'settle' end, 'workflow') as node,
        coalesce(activation_id, '—') as activation_id, coalesce(attempt_id, '—') as attempt_id, {PUBLIC_SQL} as payload from facts""",
    on="journal",
)
def _(s, d):
    dash = F.lit("—")
    return I.journal(s, d).withColumn("payload", redaction.public_payload()).select(
        "seq",
        "type",
        F.coalesce("node", F.lit("workflow")).alias("node"),
        F.coalesce("activation_id", dash).alias("activation_id"),
        F.coalesce("attempt_id", dash).alias("attempt_id"),
        F.when(F.col("payload") == "{}", "").otherwise(F.col("payload")).alias("payload"),
    )


@query(
    "f06_by_class_mode_operation",
    "select span_id, mode, classification, operation from spans where classification in ('executed', 'resolved') and (mode = 'aware' or operation = 'effect.execute')",
    on="spans",
)
def _(s, d):
    op = F.col("attributes.operation_name")
    return I.spans(s, d).where(
        F.col("classification").isin("executed", "resolved") & ((F.col("mode") == "aware") | (op == "effect.execute"))
    ).select("span_id", "mode", "classification", op.alias("operation"))


@query(
    "f07_status_line",
    f"""with {FOLD_SQL}, {STATE_SQL} select e.run_id,
          case e.status when 'finished' then 'done' when 'awaiting_approval' then 'HELD' else e.status end as word,
          case e.tkey when 6 then 'settle -> settle' when 0 then 'settle' when 1 then 'settle' when 2 then 'settle' when 5 then 'settle' when 7 then 'settle' else '(none)' end as completed,
          e.next_node, substring(m.state, 1, 300) as state from expected e join merged m on e.run_id = m.run_id where e.rule is null""",
    on="journal",
)
def _(s, d):
    return state.status_lines(I.journal(s, d), I.states(s, d))


