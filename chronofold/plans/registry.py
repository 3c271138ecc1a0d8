"""Named queries and, where SQL can say it, the same answer for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.plans import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DUCKDB_DAYS = "date_diff('day', DATE '1970-01-01', cast(o_orderdate as date))"
DUCKDB_SHA = "sha256({})"

SPAN_STEPS = [
    (
        "attempt_ends",
        """select run_id, att, max(at_ns) as att_end, max(case type when 'attempt_abandoned' then 'abandoned'
           when 'attempt_failed' then 'failed' when 'activation_finished' then 'completed' end) as att_outcome
           from facts where att is not null group by 1, 2""",
    ),
    (
        "run_ends",
        """select run_id, max(at_ns) as run_end, coalesce(max(case type when 'run_finished' then 'finished'
           when 'run_failed' then 'failed' end), 'open') as run_outcome from facts group by 1""",
    ),
    (
        "owners",
        """select f.*, e.att_end, coalesce(e.att_outcome, 'open') as att_outcome, r.run_end, r.run_outcome, m.mode,
             m.mode = 'aware' and f.type = 'effect_resolved' as resolved,
             case f.type when 'run_started' then 0 when 'attempt_started' then 1 when 'effect_completed' then 2 else 3 end as family
           from facts f left join attempt_ends e on f.run_id = e.run_id and f.att = e.att
           join run_ends r on f.run_id = r.run_id cross join (values ('aware'), ('control')) m(mode)
           where f.tkey < 11 and f.tkey not in (8, 10)
             and f.type in ('run_started', 'attempt_started', 'effect_completed', 'effect_resolved')""",
    ),
    (
        "named",
        """select *, case when family = 0 then 'run' when family = 1 then 'attempt:' || attempt_id
             when resolved then 'effect-resolve:' || seq else 'effect-execute:' || seq end as identity,
           case when family = 0 then 'run' when family = 1 then 'activation' when resolved then 'effect.resolve'
             else 'effect.execute' end as operation,
           case when family < 2 or mode = 'control' then null when resolved then 'journal' else 'external' end as source,
           substring(sha256('chronofold:trace:' || mode || ':' || run_id), 1, 32) as trace_id
           from owners""",
    ),
    (
        "spans",
        """select mode, run_id, k, tkey, seq, family, identity, operation, source, trace_id, attempt_id, att_outcome, recovery, workflow,
           case when family = 0 then 'flow.run' when family = 1 then 'flow.activation settle'
             else 'flow.' || operation || ' payments:settle' end as name,
           substring(sha256('chronofold:span:' || mode || ':' || run_id || ':' || identity), 1, 16) as span_id,
           case when family = 0 then null else substring(sha256('chronofold:span:' || mode || ':' || run_id || ':' ||
             case when family = 1 then 'run' else 'attempt:' || attempt_id end), 1, 16) end as parent_span_id,
           case when family < 2 then at_ns when family = 2 then started_ns else at_ns end as start_ns,
           case when family = 0 then run_end when family = 1 then att_end else at_ns end as end_ns,
           case when (family = 0 and run_outcome = 'failed') or (family = 1 and att_outcome in ('abandoned', 'failed'))
             then 'ERROR' else 'UNSET' end as status,
           case when family < 2 then 'structural' when resolved then 'resolved' else 'executed' end as classification,
           case when resolved then substring(sha256('chronofold:span:aware:' || run_id || ':effect-execute:' || (k * 32 + src_off)), 1, 16) end as link_span_id,
           '{' || case when family = 1 and att_outcome = 'abandoned' then '"error.type":"flow.attempt.abandoned",' else '' end ||
             case when family > 0 then '"flow.activation.id":"' || activation_id || '","flow.attempt.id":"' || attempt_id || '",' else '' end ||
             case when family = 1 then '"flow.attempt.outcome":"' || att_outcome || '","flow.attempt.recovery":' || cast(recovery as varchar) || ',' else '' end ||
             case when family > 1 then '"flow.effect.adapter.version":"store/v1","flow.effect.id":"settle","flow.effect.index":0,"flow.effect.label":"payments:settle","flow.effect.outcome":"' ||
               case when resolved then 'resolved_from_journal' else 'executed' end || '","flow.effect.request.fingerprint":"' || request_fp || '",' else '' end ||
             case when source is not null then '"flow.effect.source":"' || source || '",' else '' end ||
             case when resolved then '"flow.effect.source.sequence":' || (k * 32 + src_off) || ',' else '' end ||
             case when family > 0 then '"flow.node.name":"settle",' else '' end ||
             '"flow.operation.name":"' || operation || '","flow.run.id":"' || run_id || '"' ||
             case when family = 0 then ',"flow.run.outcome":"' || run_outcome || '","flow.workflow.version":"' || workflow || '"' else '' end || '}' as attributes
           from named""",
    ),
]

STORE_STEPS = [
    (
        "store",
        """select trace_id, span_id, case when parent_span_id is null and k % 2 = 0 then '' else parent_span_id end as parent_span_id,
             case when k % 10 = 2 and family = 0 then name || '-renamed' else name end as name,
             case when k % 10 = 4 and family = 0 then 'other-service' else 'chronofold-' || mode end as service_name,
             operation as operation_name,
             case when k % 10 = 5 and source is not null then '' else source end as effect_source,
             start_ns // 1000000 as ts_ms, seq * 8 + case when mode = 'aware' then 0 else 1 end + 2 * c.copy as ingest_seq
           from spans s join (values (0), (1)) c(copy) on c.copy = 0 or (s.k % 10 = 3 and s.family = 0)
           where not (k % 10 = 0 and family = 0)
           union all
           select trace_id, substring(sha256('foreign:' || mode || ':' || run_id), 1, 16), '', 'foreign', 'chronofold-' || mode, 'run', null,
             start_ns // 1000000, seq * 8 + 6 + case when mode = 'aware' then 0 else 1 end
           from spans where k % 10 = 1 and family = 0""",
    )
]


def with_steps(sql: str, *, spans: bool = False, store: bool = False) -> str:
    steps = fixture.journal_ctes(DUCKDB_DAYS, DUCKDB_SHA)
    if spans or store:
        steps = steps + SPAN_STEPS
    if store:
        steps = steps + STORE_STEPS
    prefix = ",\n".join(f"{name} as ({text})" for name, text in steps)
    body = sql.strip()
    joined = ", " + body[len("with ") :] if body.startswith("with ") else "\n" + body
    return f"with {prefix}{joined}"


def query(name: str, oracle: str | None = None, on: str = "") -> Callable:
    """Register a query. ``on`` names what the oracle reads: tables, journal, spans, store."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = (
                oracle.strip() if not on else with_steps(oracle, spans=on == "spans", store=on == "store")
            )
        return fn

    return register
