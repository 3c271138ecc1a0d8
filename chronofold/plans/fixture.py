"""A scenario journal as a pure function of the ``orders`` table.

One order is one run and ``o_orderkey % 12`` picks its scenario. The event list of a
scenario is a small fixed template, so the journal is a join of ``orders`` with a
constant table. The SQL texts below hold only syntax shared by Spark and DuckDB;
``{sha}`` and ``{days}`` are filled in per engine, which lets a check build the very
same journal on the other side.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ord:type[activation.attempt][>source ords]; see FIXTURES.md.
TEMPLATES = """
0  1:run_started[1] 2:attempt_started[1.1] 3:effect_intent[1.1] 4:effect_completed[1.1]>3 5:activation_finished[1.1] 6:run_finished
1  1:run_started[1] 2:attempt_started[1.1] 3:effect_intent[1.1] 4:effect_completed[1.1]>3 5:attempt_abandoned[1.1] 6:attempt_started[1.2] 7:effect_resolved[1.2]>4,3 8:activation_finished[1.2] 9:run_finished
2  1:run_started[1] 2:attempt_started[1.1] 3:effect_intent[1.1] 4:effect_completed[1.1]>3 5:attempt_abandoned[1.1] 6:attempt_started[1.2] 7:activation_finished[1.2] 8:run_finished
3  1:run_started[1] 2:attempt_started[1.1] 3:effect_intent[1.1] 4:effect_completed[1.1]>3 5:attempt_abandoned[1.1] 6:attempt_started[1.2] 7:attempt_failed[1.2] 8:run_failed
4  1:run_started[1] 2:attempt_started[1.1] 3:effect_intent[1.1] 4:attempt_abandoned[1.1] 5:attempt_started[1.2] 6:attempt_failed[1.2] 7:run_failed
5  1:run_started[1] 2:attempt_started[1.1] 3:effect_intent[1.1] 4:attempt_abandoned[1.1] 5:attempt_started[1.2] 6:effect_intent[1.2]>3 7:effect_completed[1.2]>6 8:activation_finished[1.2] 9:run_finished
6  1:run_started[1] 2:attempt_started[1.1] 3:effect_intent[1.1] 4:effect_completed[1.1]>3 5:activation_finished[1.1] 6:attempt_started[2.2] 7:effect_intent[2.2] 8:effect_completed[2.2]>7 9:activation_finished[2.2] 10:run_finished
7  1:run_started[1] 2:awaiting_approval[1] 3:approval_granted[1] 4:attempt_started[1.1] 5:activation_finished[1.1] 6:run_finished
8  1:run_started[1] 2:awaiting_approval[1] 3:approval_denied[1] 4:run_failed
9  1:run_started[1] 2:attempt_started[1.1] 3:effect_intent[1.1] 4:effect_completed[1.1]>3
10 1:run_started[1] 2:awaiting_approval[1]
"""

TEMPLATE_COLUMNS = (
    "tkey ord off type act att src_off int_off started_off recovery next_act next_node lag_ns workflow"
).split()


def _parse(line: str) -> tuple[int, list[dict]]:
    scenario, *items = line.split()
    rows = []
    for item in items:
        ord_, type_, act, att, refs = re.fullmatch(
            r"(\d+):(\w+?)(?:\[(\d+)(?:\.(\d+))?\])?(?:>([\d,]+))?", item
        ).groups()
        refs = [int(r) for r in (refs or "").split(",") if r]
        rows.append(
            {
                "ord": int(ord_),
                "off": 2 * int(ord_),
                "type": type_,
                "act": int(act) if act else None,
                "att": int(att) if att else None,
                "refs": refs,
                "lag_ns": 0,
            }
        )
    return int(scenario), rows


def _finish(tkey: int, scenario: int, rows: list[dict]) -> list[tuple]:
    workflow = "loop/v1" if scenario == 6 else "gated/v1" if scenario in (7, 8, 10) else "settle/v1"
    out, abandoned = [], False
    finishes = [r["ord"] for r in rows if r["type"] == "activation_finished"]
    for r in rows:
        t, refs = r["type"], r["refs"]
        more = t == "activation_finished" and r["ord"] != finishes[-1]
        out.append(
            (
                tkey,
                r["ord"],
                r["off"],
                t,
                r["act"],
                r["att"],
                2 * refs[0] if refs else None,
                2 * refs[1] if len(refs) > 1 else None,
                refs[0] if refs and t == "effect_completed" else None,
                abandoned if t == "attempt_started" else None,
                r["act"] + 1 if more else None,
                "settle" if more else "__end__" if t == "activation_finished" else None,
                r["lag_ns"],
                workflow,
            )
        )
        abandoned = abandoned or t == "attempt_abandoned"
    return out


@cache
def template_rows() -> tuple[tuple, ...]:
    parsed = dict(_parse(line) for line in TEMPLATES.strip().splitlines())
    rows: list[tuple] = []
    for scenario, items in parsed.items():
        rows += _finish(scenario, scenario, items)
    for defect in range(6):
        items = [dict(r) for r in parsed[1]]
        if defect == 0:
            items = items[1:]
        elif defect == 1:
            items.append({"ord": 10, "off": 20, "type": "attempt_started", "act": 1, "att": 3, "refs": [], "lag_ns": 0})
        elif defect == 2:
            items = [r for r in items if r["ord"] != 3]
        elif defect == 3:
            items[3]["lag_ns"] = -1
        elif defect == 4:
            items.insert(4, {**items[3], "off": items[3]["off"] + 1})
        else:
            items[6]["refs"] = [4, 2]
        rows += _finish(11 + defect, 11, items)
    return tuple(rows)


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"'{value}'" if isinstance(value, str) else str(value)


def template_sql() -> str:
    rows = ",\n".join("(" + ",".join(_literal(v) for v in r) + ")" for r in template_rows())
    return f"select * from (values {rows}) t({', '.join(TEMPLATE_COLUMNS)})"


RUNS_SQL = """
select o_orderkey as k, o_custkey as c,
  cast(case when o_orderkey % 12 < 11 then o_orderkey % 12 else 11 + o_custkey % 6 end as int) as tkey,
  'run-' || cast(o_orderkey as string) as run_id,
  cast(@days@ as bigint) * 86400000000000 + (o_orderkey % 997) * 1000 as base_ns,
  '{"amount_cents":' || cast(cast(round(o_totalprice * 100) as bigint) as string) || '}' as request,
  cast(round(o_totalprice * 100) as bigint) as cents
from orders
"""

ROWS_SQL = """
select r.k, r.c, r.tkey, r.run_id, r.request, r.cents, t.ord, t.off, t.type, t.act, t.att, t.workflow,
  t.src_off, t.int_off, t.recovery, t.next_act, t.next_node, t.lag_ns,
  r.k * 32 + t.off as seq,
  r.base_ns + t.ord * 1000000 as at_ns,
  r.base_ns + coalesce(t.started_off, t.ord) * 1000000 as started_ns,
  case when t.act is not null then 'act-' || cast(r.k as string) || '-' || cast(t.act as string) end as activation_id,
  case when t.att is not null then 'att-' || cast(r.k as string) || '-' || cast(t.att as string) end as attempt_id,
  r.tkey <> 4 as retry_safe,
  r.run_id || ':act-' || cast(r.k as string) || '-' || cast(coalesce(t.act, 1) as string) || ':settle' as effect_key
from run_rows r join template t on r.tkey = t.tkey
"""

FACTS_SQL = """
select *, @sha_request@ as request_fp, @sha_key@ as key_fp,
  '{"receipt":"rc_' || substring(@sha_key@, 1, 10) || '"' ||
    case when tkey = 6 then ',"visit":' || cast(coalesce(act, 1) as string) else '' end || '}' as patch
from fact_rows
"""

PAYLOAD_SQL = """
case type
when 'run_started' then '{"activation_id":"' || activation_id || '","input":' || request ||
  ',"journal_schema_version":2,"start_node":"settle","workflow_version":"' || workflow || '"}'
when 'attempt_started' then '{"recovery":' || case when recovery then 'true' else 'false' end || '}'
when 'attempt_abandoned' then '{"reason":"recovery_resume"}'
when 'attempt_failed' then '{"error":"EffectError: settle"}'
when 'awaiting_approval' then '{"state":' || request || '}'
when 'approval_granted' then '{"at_ns":' || cast(at_ns as string) || ',"by":"operator"}'
when 'approval_denied' then '{"at_ns":' || cast(at_ns as string) || ',"by":"operator"}'
when 'activation_finished' then '{"next_activation_id":' ||
  case when next_act is null then 'null' else '"act-' || cast(k as string) || '-' || cast(next_act as string) || '"' end ||
  ',"next_node":"' || next_node || '","patch":' || patch || '}'
when 'run_finished' then '{"state":' || request || '}'
when 'run_failed' then '{"reason":"' || case when tkey = 8 then 'approval denied' else 'EffectError: settle' end || '"}'
else '{"adapter_version":"store/v1","effect_id":"settle"' ||
  case when type <> 'effect_intent' then ',"ended_at_ns":' || cast(at_ns as string) else '' end ||
  ',"idempotency_key_fingerprint":' || case when retry_safe then '"' || key_fp || '"' else 'null' end ||
  ',"index":0,"label":"payments:settle","request_fingerprint":"' || request_fp || '"' ||
  case when type = 'effect_completed' then ',"result":' || patch else '' end ||
  case when type = 'effect_intent' then ',"retry_of_intent_seq":' ||
    case when src_off is null then 'null' else cast(k * 32 + src_off as string) end else '' end ||
  ',"retry_safe":' || case when retry_safe then 'true' else 'false' end ||
  case when type = 'effect_resolved' then ',"source_effect_seq":' || cast(k * 32 + src_off as string) ||
    ',"source_intent_seq":' || cast(k * 32 + int_off as string) else '' end ||
  case when type = 'effect_completed' then ',"source_intent_seq":' || cast(k * 32 + src_off as string) else '' end ||
  ',"started_at_ns":' || cast(case when type = 'effect_completed' then
      case when lag_ns < 0 then at_ns + 1 else started_ns end else at_ns end as string) || '}'
end
"""

JOURNAL_SQL = """
select seq, run_id, type,
  case when type = 'run_finished' or (type = 'run_failed' and tkey <> 8) then null else 'settle' end as node,
  activation_id, attempt_id, @payload@ as payload,
  at_ns / 1000000000.0e0 as at, at_ns
from facts
"""


def journal_ctes(days: str, sha: str) -> list[tuple[str, str]]:
    """The journal as named SQL steps over ``orders``; the last one is ``journal``."""

    def fill(text: str) -> str:
        for mark, value in (
            ("@days@", days),
            ("@sha_request@", sha.format("request")),
            ("@sha_key@", sha.format("effect_key")),
            ("@payload@", PAYLOAD_SQL),
        ):
            text = text.replace(mark, value)
        return text

    return [
        ("template", template_sql()),
        ("run_rows", fill(RUNS_SQL)),
        ("fact_rows", ROWS_SQL),
        ("facts", fill(FACTS_SQL)),
        ("journal", fill(JOURNAL_SQL)),
    ]


SPARK_DAYS = "unix_date(cast(o_orderdate as date))"
SPARK_SHA = "sha2({}, 256)"


def _step(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """Run one SQL step with its inputs bound as frames instead of named views."""
    text = dict(journal_ctes(SPARK_DAYS, SPARK_SHA))[name]
    text = text.replace("{", "{{").replace("}", "}}")
    for key in inputs:
        text = re.sub(rf"\b(from|join) {key}\b", rf"\1 {{{key}}}", text)
    return spark.sql(text, **inputs)


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(orders.inputFiles()) < cores:  # one small test file would be one task
        orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        orders = orders.repartition(cores, "o_orderkey")
    return _step(spark, "run_rows", orders=orders)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with the raw values its payload is made of."""
    template = F.broadcast(_step(spark, "template"))  # a constant of about 120 rows
    rows = _step(spark, "fact_rows", run_rows=run_rows(spark, sf_dir), template=template)
    return _step(spark, "facts", fact_rows=rows)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, "journal", facts=facts(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_rows(spark, sf_dir).selectExpr(
        "run_id", "2 as schema_version", "base_ns + 1000000 as created_at_ns"
    )


def graph_nodes(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """select * from (values
        ('settle/v1', 'settle', false, 'Settle one order', true),
        ('loop/v1', 'settle', false, 'Settle and come back once', true),
        ('gated/v1', 'settle', true, 'Settle after approval', true)
        ) t(workflow_version, name, requires_approval, description, is_start)"""
    )


def graph_routes(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """select * from (values
        ('settle/v1', 'settle', 1, cast(null as string), '__end__'),
        ('loop/v1', 'settle', 1, 'visit < 2', 'settle'),
        ('loop/v1', 'settle', 2, cast(null as string), '__end__'),
        ('gated/v1', 'settle', 1, cast(null as string), '__end__')
        ) t(workflow_version, from_node, priority, predicate, target)"""
    )
