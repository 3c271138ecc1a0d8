"""Evidence documents: built per run, read tolerantly, checked rule by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions.storage import cut
from chronofold.names import DEFAULT_NAMING, SpanNaming
from chronofold.operators import readback as R
from chronofold.operators.decode import event_time
from chronofold.operators.projection import attributes_json
from chronofold.operators.redaction import MASK, SENSITIVE_FIELDS, public_payload
from chronofold.operators.registered import EVENT_COUNTS, EffectContract, check_registered
from chronofold.operators.trees import check_trees, compare_arms, reached_from_root

# Fixed format: keys of the evidence document.
_EVENT = (
    "struct<seq: bigint, type: string, node: string, activationId: string, attemptId: string, "
    "payload: variant, atUnixNano: string>"
)
_SPAN = (
    "struct<identity: string, name: string, trace_id: string, span_id: string, parent_span_id: string, "
    "kind: string, start_time_unix_nano: string, end_time_unix_nano: string, duration_nano: string, "
    "status: string, attributes: variant, links: array<struct<trace_id: string, span_id: string>>, "
    "classification: string>"
)
_ARM = f"struct<mode: string, traceId: string, serviceName: string, signozUrl: string, spans: array<{_SPAN}>>"
_ROW = (
    "struct<spanId: string, name: string, parentSpanId: string, operationName: string, "
    "effectSource: string, traceId: string, serviceName: string>"
)
_REQUEST = (
    "struct<start: bigint, `end`: bigint, requestType: string, compositeQuery: struct<queries: "
    "array<struct<type: string, spec: struct<name: string, signal: string, disabled: boolean, "
    "filter: struct<expression: string>, `limit`: bigint, `offset`: bigint>>>>>"
)
_PROOF = (
    "struct<traceId: string, spansSent: bigint, spansRetrieved: bigint, queryAttempts: bigint, "
    "duplicateRows: bigint, identityVerified: boolean, attributesVerified: boolean, "
    f"serviceNameVerified: boolean, verified: boolean, request: {_REQUEST}, selectedRows: array<{_ROW}>>"
)
_TRUTH = ("activationAttempts", "effectIntents", "effectCompletions", "journalResolutions", "providerAttempts", "businessExecutions")
_COMPARISON = ("awareExecutedEffectSpans", "awareResolvedEffectSpans", "controlExecutedEffectSpans")
_PROVENANCE = (
    "journalPath: string, journalSha256: string, lineageCheckedArtifacts: bigint, lineageId: string, "
    "lineageInputsPath: string, lineageInputsSha256: string, lineageManifestPath: string, "
    "lineageManifestSha256: string, lineageCandidate: boolean, "
    "phaseReceipts: map<string, struct<path: string, sha256: string, bytes: bigint>>"
)
DOCUMENT = (
    "schemaVersion bigint, generatedAt string, runId string, seed bigint, source string, status string, "
    "hardExitCode bigint, "
    f"groundTruth struct<{', '.join(f'{c}: bigint' for c in _TRUTH)}>, "
    f"journal struct<events: array<{_EVENT}>>, aware {_ARM}, control {_ARM}, "
    f"comparison struct<{', '.join(f'{c}: bigint' for c in _COMPARISON)}>, "
    f"queryBack struct<aware: {_PROOF}, control: {_PROOF}>, provenance struct<{_PROVENANCE}>"
)
TOP_KEYS = (
    "aware", "comparison", "control", "generatedAt", "groundTruth", "hardExitCode", "journal", "provenance",
    "queryBack", "runId", "schemaVersion", "seed", "source", "status",
)
MAX_EVENTS, MAX_SPANS = 512, 256


def proof_frame(spans: DataFrame, store: DataFrame, naming: SpanNaming = DEFAULT_NAMING) -> DataFrame:
    """Read-back proofs of the traces that verify, with the query that found them."""
    verified = R.verify_readback(spans, store, naming).where("verified").drop("trace_id")
    return verified.join(R.query_windows(spans), ["run_id", "mode"])


def likely_runs(events: DataFrame, effects: DataFrame, contract: EffectContract = EffectContract()) -> DataFrame:
    """The rows of ``effects`` whose run passes the gates that need no spans."""
    single = effects.where("provider_attempts = 1 and business_executions = 1")
    sound_events = check_registered(events, contract).where("broken is null").select("run_id")
    return sound_events.join(single, "run_id")


def build_documents(
    events: DataFrame,
    spans: DataFrame,
    store: DataFrame,
    effects: DataFrame,
    provenance: DataFrame,
    *,
    likely: DataFrame | None = None,
    contract: EffectContract = EffectContract(),
    naming: SpanNaming = DEFAULT_NAMING,
    base_url: str = "http://127.0.0.1:8080/",
    seed: int = 23,
    source: str = "journal",
    generated_at: str = "1970-01-01T00:00:00+00:00",
) -> DataFrame:
    """One evidence document (JSON text) per run that passes every gate.

    ``effects``: run_id, provider_attempts, business_executions. ``provenance``: run_id
    and a struct of that name. ``likely``: what ``likely_runs`` gave, where it is at hand;
    ``spans`` and ``store`` need then hold no other runs. The gates fix the number of events and spans of a run, so
    the arrays built here have a known small size.
    """
    tree = ["run_id"]
    # The cheap gates first; only runs that pass them reach the tree walk.
    if likely is None:
        likely = cut(likely_runs(events, effects, contract))
    candidates = cut(spans.join(likely.select("run_id"), tree, "left_semi"))
    trees = check_trees(candidates, workflow=contract.workflow, node=contract.node, naming=naming)
    sound_trees = trees.where("broken is null").groupBy("run_id").agg(F.count("*").alias("n")).where("n = 2").select("run_id")
    arms = compare_arms(
        candidates,
        effect_id=contract.effect_id,
        label=contract.label,
        adapter_version=contract.adapter_version,
        naming=naming,
    ).where("broken is null")
    traces = candidates.select(F.lower("trace_id").alias("trace_id")).distinct()
    returned = store.withColumn("trace_id", F.lower("trace_id")).join(traces, "trace_id", "left_semi")
    proofs = cut(proof_frame(candidates, returned, naming))
    proven = proofs.groupBy("run_id").agg(F.count("*").alias("n")).where("n = 2").select("run_id")
    passed = cut(likely.join(sound_trees, tree).join(arms.drop("broken"), tree).join(proven, tree))
    kept_events = events.join(passed.select("run_id"), tree, "left_semi")
    kept_spans = candidates.join(passed.select("run_id"), tree, "left_semi")

    journal = kept_events.select(
        "run_id",
        F.struct(
            "seq",
            "type",
            "node",
            F.col("activation_id").alias("activationId"),
            F.col("attempt_id").alias("attemptId"),
            public_payload().alias("payload"),
            X.ns_text(event_time()).alias("atUnixNano"),
        ).alias("e"),
    )
    journal = journal.groupBy("run_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    as_variant = lambda c: F.parse_json(c)
    span = F.struct(
        "family",
        "seq",
        F.struct(
            "identity",
            "name",
            "trace_id",
            "span_id",
            "parent_span_id",
            "kind",
            X.ns_text(F.col("start_time_ns")).alias("start_time_unix_nano"),
            X.ns_text(F.col("end_time_ns")).alias("end_time_unix_nano"),
            X.ns_text(F.col("duration_ns")).alias("duration_nano"),
            "status",
            attributes_json(naming=naming).alias("attributes"),
            "links",
            "classification",
        ).alias("span"),
    )
    arm = kept_spans.groupBy("run_id", "mode").agg(
        F.min("trace_id").alias("trace_id"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    rows = R.retained_fields(kept_spans, naming).groupBy("run_id", "mode").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("span_id").alias("spanId"),
                    F.col("name"),
                    F.col("parent_span_id").alias("parentSpanId"),
                    F.col("operation_name").alias("operationName"),
                    F.col("effect_source").alias("effectSource"),
                    F.col("trace_id").alias("traceId"),
                    F.col("service_name").alias("serviceName"),
                )
            )
        ).alias("rows")
    )
    sides = arm.join(rows, ["run_id", "mode"]).join(proofs.drop("trace_id"), ["run_id", "mode"])
    request = F.struct(
        F.col("start_ms").alias("start"),
        F.col("end_ms").alias("end"),
        F.lit("raw").alias("requestType"),
        F.struct(
            F.array(
                F.struct(
                    F.lit("builder_query").alias("type"),
                    F.struct(
                        F.lit("A").alias("name"),
                        F.lit("traces").alias("signal"),
                        F.lit(False).alias("disabled"),
                        F.struct(
                            F.concat(F.lit("trace_id = '"), "trace_id", F.lit("'")).alias("expression")
                        ).alias("filter"),
                        F.col("row_limit").alias("limit"),
                        F.lit(0).alias("offset"),
                    ).alias("spec"),
                )
            ).alias("queries")
        ).alias("compositeQuery"),
    )
    packed = sides.select(
        "run_id",
        "mode",
        F.struct(
            "mode",
            F.col("trace_id").alias("traceId"),
            F.concat(F.lit(f"{naming.service}-"), "mode").alias("serviceName"),
            X.trace_url(F.lit(base_url), F.col("trace_id")).alias("signozUrl"),
            F.transform(
                "spans",
                lambda s: s["span"].withField("attributes", as_variant(s["span"]["attributes"])),
            ).alias("spans"),
        ).alias("arm"),
        F.struct(
            F.col("trace_id").alias("traceId"),
            F.col("spans_sent").alias("spansSent"),
            F.col("spans_retrieved").alias("spansRetrieved"),
            F.lit(1).alias("queryAttempts"),
            F.lit(0).alias("duplicateRows"),
            *[F.lit(True).alias(c) for c in ("identityVerified", "attributesVerified", "serviceNameVerified", "verified")],
            request.alias("request"),
            F.col("rows").alias("selectedRows"),
        ).alias("proof"),
    )
    packed = cut(packed)
    mode = lambda m: packed.where(F.col("mode") == m).select(
        "run_id", F.col("arm").alias(m), F.col("proof").alias(f"{m}_proof")
    )
    joined = (
        passed.join(journal, tree).join(mode("aware"), tree).join(mode("control"), tree).join(provenance, tree)
    )
    document = F.struct(
        F.lit(2).alias("schemaVersion"),
        F.lit(generated_at).alias("generatedAt"),
        F.col("run_id").alias("runId"),
        F.lit(seed).alias("seed"),
        F.lit(source).alias("source"),
        F.lit("finished").alias("status"),
        F.lit(9).alias("hardExitCode"),
        F.struct(
            F.lit(EVENT_COUNTS[N.ATTEMPT_STARTED]).alias("activationAttempts"),
            F.lit(EVENT_COUNTS[N.EFFECT_INTENT]).alias("effectIntents"),
            F.lit(EVENT_COUNTS[N.EFFECT_COMPLETED]).alias("effectCompletions"),
            F.lit(EVENT_COUNTS[N.EFFECT_RESOLVED]).alias("journalResolutions"),
            F.col("provider_attempts").alias("providerAttempts"),
            F.col("business_executions").alias("businessExecutions"),
        ).alias("groundTruth"),
        F.struct(
            F.transform("events", lambda e: e.withField("payload", as_variant(e["payload"]))).alias("events")
        ).alias("journal"),
        "aware",
        "control",
        F.struct(
            F.col("aware_executed").alias("awareExecutedEffectSpans"),
            F.col("aware_resolved").alias("awareResolvedEffectSpans"),
            F.col("control_executed").alias("controlExecutedEffectSpans"),
        ).alias("comparison"),
        F.struct(F.col("aware_proof").alias("aware"), F.col("control_proof").alias("control")).alias("queryBack"),
        "provenance",
    )
    # Nulls the format requires (parent of the root, node of the end) stay in the text.
    return joined.select("run_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("body"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document files as ``(path, body)``; a broken file is a row, not a failure."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Parsed document ``d`` and ``readable``: the body is a JSON object."""
    shape = F.schema_of_variant(X.strict_json(F.col("body")))
    readable = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    return documents.withColumn("readable", readable).withColumn(
        "d", F.when(readable, F.from_json("body", DOCUMENT))
    )


def _issue(test: Column, path: str | Column, code: str) -> Column:
    where = F.lit(path) if isinstance(path, str) else path
    return F.when(F.coalesce(test, F.lit(True)), F.struct(where.alias("path"), F.lit(code).alias("code")))


def _none() -> Column:
    return F.lit(None).cast("struct<path: string, code: string>")


def _indexed(array: Column, test, prefix: str, code: str, suffix: str = "") -> Column:
    """One issue per array element for which ``test(element, index)`` holds."""

    def per_item(item: Column, index: Column) -> Column:
        where = F.concat(F.lit(f"{prefix}."), index.cast("string"), F.lit(suffix))
        return F.when(test(item, index), F.struct(where.alias("path"), F.lit(code).alias("code"))).otherwise(_none())

    return F.transform(F.coalesce(array, F.array()), per_item)


def _attribute(span: Column, key: str) -> Column:
    return F.try_variant_get(span["attributes"], f"$['{key}']", "string")


def _arm_issues(mode: str, naming: SpanNaming) -> tuple[list[Column], list[Column]]:
    arm, proof = F.col(f"d.{mode}"), F.col(f"d.queryBack.{mode}")
    spans = F.coalesce(arm["spans"], F.array())
    n = F.size(spans)
    ids = F.transform(spans, lambda s: s["span_id"])
    roots = F.filter(spans, lambda s: s["parent_span_id"].isNull())
    number = lambda c: c.cast("decimal(20,0)")
    expected = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["span_id"].alias("spanId"),
                s["name"].alias("name"),
                s["parent_span_id"].alias("parentSpanId"),
                F.coalesce(_attribute(s, naming.key("operation.name")), F.lit("")).alias("operationName"),
                _attribute(s, naming.key("effect.source")).alias("effectSource"),
                s["trace_id"].alias("traceId"),
                arm["serviceName"].alias("serviceName"),
            ),
        )
    )
    low = F.array_min(F.transform(spans, lambda s: number(s["start_time_unix_nano"])))
    high = F.array_max(F.transform(spans, lambda s: number(s["end_time_unix_nano"])))
    spec = F.get(proof["request"]["compositeQuery"]["queries"], F.lit(0))["spec"]
    request_ok = (
        (proof["request"]["start"] == F.greatest(F.lit(0), X.quotient(low, 1_000_000) - X.WINDOW_PAD_MS))
        & (proof["request"]["end"] == X.quotient(high, 1_000_000) + X.WINDOW_PAD_MS)
        & (spec["filter"]["expression"] == F.concat(F.lit("trace_id = '"), arm["traceId"], F.lit("'")))
        & (spec["limit"] == F.greatest(F.lit(100), n * 4))
    )
    # Only arms within the span limit are walked; beyond it that rule is broken already.
    rounds = F.when(n.between(1, MAX_SPANS), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    reached = F.when(n > MAX_SPANS, ids).otherwise(reached_from_root(spans, rounds))
    service = naming.service_name(mode)
    p = f"{mode}.spans"
    single = [
        _issue(arm["mode"] != mode, f"{mode}.mode", "mode"),
        _issue(~X.is_hex(arm["traceId"], 32), f"{mode}.traceId", "trace_id_form"),
        _issue(arm["serviceName"] != service, f"{mode}.serviceName", "service_name"),
        _issue(~X.is_trace_url(arm["signozUrl"], arm["traceId"]), f"{mode}.signozUrl", "trace_url"),
        _issue(n != 5, p, "span_count"),
        _issue(~n.between(1, MAX_SPANS), p, "span_limit"),
        _issue(F.size(F.array_distinct(ids)) != n, p, "duplicate_span_id"),
        _issue(F.size(roots) != 1, p, "root_count"),
        F.when(F.size(roots) >= 1, _issue(F.size(F.array_distinct(reached)) != F.size(F.array_distinct(ids)), p, "not_connected")),
        _issue(proof["traceId"] != arm["traceId"], f"queryBack.{mode}.traceId", "proof_trace"),
        _issue(proof["spansSent"] != n, f"queryBack.{mode}.spansSent", "proof_sent"),
        _issue(proof["spansRetrieved"] != proof["spansSent"], f"queryBack.{mode}.spansRetrieved", "proof_retrieved"),
        _issue(proof["duplicateRows"] != 0, f"queryBack.{mode}.duplicateRows", "proof_duplicates"),
        _issue(~proof["queryAttempts"].between(1, 100), f"queryBack.{mode}.queryAttempts", "proof_attempts"),
        *[
            _issue(~proof[c], f"queryBack.{mode}.{c}", "proof_flag")
            for c in ("identityVerified", "attributesVerified", "serviceNameVerified", "verified")
        ],
        _issue(~proof["selectedRows"].eqNullSafe(expected), f"queryBack.{mode}.selectedRows", "proof_rows"),
        _issue(~request_ok, f"queryBack.{mode}.request", "proof_request"),
    ]
    parent = lambda s: F.get(F.filter(spans, lambda q: q["span_id"] == s["parent_span_id"]), F.lit(0))
    start, end = "start_time_unix_nano", "end_time_unix_nano"
    nano = "^[0-9]{1,20}$"
    text = lambda c: F.coalesce(F.length(c).between(1, 256), F.lit(False))
    shape = lambda s: (
        X.is_hex(s["span_id"], 16)
        & (s["parent_span_id"].isNull() | X.is_hex(s["parent_span_id"], 16))
        & s[start].rlike(nano)
        & s[end].rlike(nano)
        & s["duration_nano"].rlike(nano)
        & (number(s["duration_nano"]) <= 86_400_000_000_000)
        & text(s["identity"])
        & text(s["name"])
        & s["classification"].isin("executed", "resolved", "structural")
        & (F.size("d.aware.spans") >= 0)
        & (F.size(s["links"]) <= 16)
    )
    repeated = [
        _indexed(spans, lambda s, i: ~F.coalesce(shape(s), F.lit(False)), p, "span_form"),
        _indexed(spans, lambda s, i: s["trace_id"] != arm["traceId"], p, "other_trace", ".trace_id"),
        _indexed(
            spans,
            lambda s, i: s["parent_span_id"].isNotNull() & ~F.array_contains(ids, s["parent_span_id"]),
            p,
            "missing_parent",
            ".parent_span_id",
        ),
        _indexed(
            spans,
            lambda s, i: (number(s[end]) < number(s[start]))
            | (number(s[end]) - number(s[start]) != number(s["duration_nano"])),
            p,
            "bad_interval",
            ".duration_nano",
        ),
        _indexed(
            spans,
            lambda s, i: (number(s[start]) < number(parent(s)[start])) | (number(s[end]) > number(parent(s)[end])),
            p,
            "escapes_parent",
        ),
    ]
    return single, repeated


def _journal_issues(contract: EffectContract) -> tuple[list[Column], list[Column]]:
    events = F.coalesce(F.col("d.journal.events"), F.array())
    where = "journal.events"
    of = lambda t: F.filter(events, lambda e: e["type"] == t)
    one = lambda t: F.get(of(t), F.lit(0))
    field = lambda e, f, kind="string": F.try_variant_get(e["payload"], f"$.{f}", kind)
    raw = lambda e, f: F.to_json(F.variant_get(e["payload"], f"$.{f}", "variant"))
    attempts = of(N.ATTEMPT_STARTED)
    a1, a2 = F.get(attempts, F.lit(0)), F.get(attempts, F.lit(1))
    intent, done, back = one(N.EFFECT_INTENT), one(N.EFFECT_COMPLETED), one(N.EFFECT_RESOLVED)
    left, finish = one(N.ATTEMPT_ABANDONED), one(N.ACTIVATION_FINISHED)
    complete = (F.size(attempts) == 2) & intent.isNotNull() & done.isNotNull() & back.isNotNull() & left.isNotNull() & finish.isNotNull()
    pair = (a1["activationId"] != "") & (a1["activationId"] == a2["activationId"]) & (a1["attemptId"] != a2["attemptId"])
    scope = (
        (intent["activationId"] == a1["activationId"])
        & (done["activationId"] == a1["activationId"])
        & (back["activationId"] == a1["activationId"])
        & (intent["attemptId"] == a1["attemptId"])
        & (done["attemptId"] == a1["attemptId"])
        & (left["attemptId"] == a1["attemptId"])
        & (back["attemptId"] == a2["attemptId"])
        & (finish["attemptId"] == a2["attemptId"])
    )
    chain = (
        (field(done, "source_intent_seq", "bigint") == intent["seq"])
        & (field(back, "source_intent_seq", "bigint") == intent["seq"])
        & (field(back, "source_effect_seq", "bigint") == done["seq"])
    )
    identity = (
        (field(intent, "effect_id") == contract.effect_id)
        & (raw(intent, "index") == "0")
        & (field(intent, "label") == contract.label)
        & (field(intent, "adapter_version") == contract.adapter_version)
        & (raw(intent, "retry_safe") == "true")
        & X.is_hex(field(intent, "request_fingerprint"), 64)
        & X.is_hex(field(intent, "idempotency_key_fingerprint"), 64)
    )
    guarded = lambda issue: F.when(complete, issue)
    previous = lambda i: F.get(events, i - 1)
    number = lambda c: c.cast("decimal(20,0)")
    single = [
        _issue(~F.size(events).between(1, MAX_EVENTS), where, "event_limit"),
        *[_issue(F.size(of(t)) != n, where, f"count_{t}") for t, n in EVENT_COUNTS.items()],
        _issue(
            F.size(F.array_except(F.transform(events, lambda e: e["type"]), F.array(*[F.lit(t) for t in EVENT_COUNTS]))) > 0,
            where,
            "unexpected_type",
        ),
        guarded(_issue(~pair, where, "attempt_pair")),
        guarded(_issue(~scope, where, "attempt_scope")),
        guarded(_issue(~chain, where, "source_chain")),
        guarded(_issue(~identity, where, "effect_contract")),
        *[
            guarded(
                _issue(
                    ~raw(done, f).eqNullSafe(raw(intent, f)) | ~raw(back, f).eqNullSafe(raw(intent, f)),
                    where,
                    f"identity_{f}",
                )
            )
            for f in N.IDENTITY_FIELDS
        ],
    ]
    repeated = [
        _indexed(events, lambda e, i: (i > 0) & (e["seq"] <= previous(i)["seq"]), where, "sequence_order", ".seq"),
        _indexed(
            events,
            lambda e, i: (i > 0) & (number(e["atUnixNano"]) < number(previous(i)["atUnixNano"])),
            where,
            "time_order",
            ".atUnixNano",
        ),
        _indexed(
            events,
            lambda e, i: ~F.coalesce(e["atUnixNano"].rlike("^[0-9]{1,20}$") & (e["seq"] > 0) & e["type"].isin(*N.LIVE_TYPES), F.lit(False)),
            where,
            "event_form",
        ),
        *[
            _indexed(
                events,
                lambda e, i, f=f: F.coalesce(raw(e, f) != MASK, F.lit(False)),
                where,
                "not_redacted",
                f".payload.{f}",
            )
            for f in SENSITIVE_FIELDS
        ],
    ]
    return single, repeated


def _provenance_issues() -> list[Column]:
    p = F.col("d.provenance")
    base = (
        X.is_confined_path(p["journalPath"])
        & X.is_hex(p["journalSha256"], 64)
        & (p["lineageCheckedArtifacts"] > 0)
        & X.is_lineage_id(p["lineageId"])
        & X.is_confined_path(p["lineageInputsPath"])
        & X.is_hex(p["lineageInputsSha256"], 64)
    )
    receipts = F.coalesce(F.cardinality(p["phaseReceipts"]), F.lit(0))
    candidate = (
        F.coalesce(p["lineageCandidate"], F.lit(False))
        & p["lineageManifestPath"].isNull()
        & p["lineageManifestSha256"].isNull()
        & (receipts == 0)
    )
    final = (
        p["lineageCandidate"].isNull()
        & X.is_confined_path(p["lineageManifestPath"])
        & F.coalesce(X.is_hex(p["lineageManifestSha256"], 64), F.lit(False))
        & (receipts > 0)
    )
    return [
        _issue(~base, "provenance", "provenance_form"),
        _issue(~(candidate | final), "provenance", "provenance_kind"),
    ]


def document_issues(
    documents: DataFrame,
    *,
    contract: EffectContract = EffectContract(),
    naming: SpanNaming = DEFAULT_NAMING,
) -> DataFrame:
    """Every broken rule of every document as ``(key columns, path, code)``.

    Arrays of a document are bounded by its format, so all rules are expressions over
    one row; nothing is shuffled.
    """
    keys = [c for c in documents.columns if c != "body"]
    parsed = parse_documents(documents)
    truth, comparison = F.col("d.groundTruth"), F.col("d.comparison")
    operation, source = naming.key("operation.name"), naming.key("effect.source")
    of = lambda mode, *kinds: F.filter(F.coalesce(F.col(f"d.{mode}.spans"), F.array()), lambda s: s["classification"].isin(*kinds))
    executed, resolved = of("aware", "executed"), of("aware", "resolved", "replayed")
    again, never = of("control", "executed"), of("control", "resolved", "replayed")
    e0, r0 = F.get(executed, F.lit(0)), F.get(resolved, F.lit(0))
    link = F.get(r0["links"], F.lit(0))
    right_counts = (F.size(executed) == 1) & (F.size(resolved) == 1)
    linked = (F.size(r0["links"]) == 1) & (link["span_id"] == e0["span_id"]) & (link["trace_id"] == F.col("d.aware.traceId"))
    blind = F.exists(
        again,
        lambda s: (F.coalesce(_attribute(s, operation), F.lit("")) != "effect.execute")
        | F.variant_get(s["attributes"], f"$['{source}']", "variant").isNotNull(),
    )
    # The counts a registered run shows.
    truths = dict(zip(_TRUTH, (2, 1, 1, 1, 1, 1)))
    views = dict(zip(_COMPARISON, (1, 1, 2)))
    text = lambda c, most: F.coalesce(F.length(c).between(1, most), F.lit(False))
    single = [
        _issue(F.col("d.schemaVersion") != 2, "schemaVersion", "schema_version"),
        _issue(F.size(F.array_except(F.json_object_keys("body"), F.array(*[F.lit(k) for k in TOP_KEYS]))) > 0, "", "unknown_key"),
        _issue(~text(F.col("d.runId"), 128), "runId", "run_id_form"),
        _issue(~F.col("d.seed").between(0, 10_000), "seed", "seed_range"),
        _issue(~text(F.col("d.source"), 64), "source", "source_form"),
        _issue(F.col("d.status") != "finished", "status", "status"),
        _issue(F.try_to_timestamp("d.generatedAt").isNull(), "generatedAt", "generated_at"),
        _issue(F.col("d.hardExitCode") != 9, "hardExitCode", "exit_code"),
        *[_issue(truth[k] != v, f"groundTruth.{k}", "ground_truth") for k, v in truths.items()],
        *[_issue(comparison[k] != v, f"comparison.{k}", "comparison") for k, v in views.items()],
        _issue(F.col("d.aware.traceId") == F.col("d.control.traceId"), "control.traceId", "same_trace"),
        _issue(~right_counts, "aware.spans", "aware_counts"),
        F.when(right_counts, _issue(~linked, "aware.spans", "resolution_link")),
        _issue((F.size(again) != 2) | (F.size(never) != 0), "control.spans", "control_counts"),
        _issue((_attribute(e0, operation) != "effect.execute") | (_attribute(e0, source) != "external"), "aware.spans", "execution_source"),
        _issue((_attribute(r0, operation) != "effect.resolve") | (_attribute(r0, source) != "journal"), "aware.spans", "resolution_source"),
        _issue(blind, "control.spans", "control_not_blind"),
        _issue(X.has_forbidden_attribute(F.col("body")), "", "forbidden_attribute"),
        *_provenance_issues(),
    ]
    repeated: list[Column] = []
    for one, many in (_arm_issues("aware", naming), _arm_issues("control", naming), _journal_issues(contract)):
        single += one
        repeated += many
    unreadable = F.array(F.struct(F.lit("").alias("path"), F.lit("not_json").alias("code")))
    found = F.when(~F.col("readable"), unreadable).otherwise(
        F.array_compact(F.concat(F.array(*single), F.flatten(F.array(*repeated))))
    )
    exploded = parsed.select(*keys, F.explode(found).alias("i"))
    return exploded.select(*keys, "i.path", "i.code")


def flat_summary(documents: DataFrame) -> DataFrame:
    """The fourteen-column summary of each document."""
    d = parse_documents(documents).where("readable")
    return d.select(
        F.col("d.schemaVersion").alias("schema_version"),
        F.col("d.runId").alias("run_id"),
        F.col("d.hardExitCode").alias("hard_exit_code"),
        F.col("d.groundTruth.activationAttempts").alias("activation_attempts"),
        F.col("d.groundTruth.effectIntents").alias("effect_intents"),
        F.col("d.groundTruth.effectCompletions").alias("effect_completions"),
        F.col("d.groundTruth.journalResolutions").alias("journal_resolutions"),
        F.col("d.groundTruth.providerAttempts").alias("provider_attempts"),
        F.col("d.groundTruth.businessExecutions").alias("business_executions"),
        F.col("d.comparison.awareExecutedEffectSpans").alias("aware_executed_effect_spans"),
        F.col("d.comparison.awareResolvedEffectSpans").alias("aware_resolved_effect_spans"),
        F.col("d.comparison.controlExecutedEffectSpans").alias("control_executed_effect_spans"),
        F.col("d.queryBack").alias("query_back"),
        F.col("d.provenance").alias("provenance"),
    )


# Fixed format: keys of the older document that later ones renamed.
_OLD_SPAN = (
    "struct<identity: string, name: string, trace_id: string, span_id: string, parent_span_id: string, "
    "kind: string, start_time_unix_nano: string, end_time_unix_nano: string, duration_nano: bigint, "
    "status: string, attributes: variant, links: array<struct<trace_id: string, span_id: string>>, classification: string>"
)
_OLD_ARM = f"struct<mode: string, traceId: string, serviceName: string, signozUrl: string, spans: array<{_OLD_SPAN}>>"
_OLD_PROOF = "struct<traceId: string, spansSent: bigint, spansRetrieved: bigint, queryAttempts: bigint, verified: boolean>"
OLD_DOCUMENT = (
    "schemaVersion bigint, generatedAt string, runId string, seed bigint, source string, status string, hardExitCode bigint, "
    "groundTruth struct<businessExecutions: bigint, journalEffects: bigint, stepAttempts: bigint>, "
    "journal struct<events: array<struct<seq: bigint, type: string, node: string, payload: variant, at: double>>>, "
    f"aware {_OLD_ARM}, naive {_OLD_ARM}, "
    "comparison struct<awareExecutedEffectSpans: bigint, awareReplayedEffectSpans: bigint, "
    "naiveExecutedEffectSpans: bigint, naiveReplayedEffectSpans: bigint>, "
    f"queryBack struct<aware: {_OLD_PROOF}, naive: {_OLD_PROOF}>"
)


def normalize_old(documents: DataFrame) -> DataFrame:
    """Version 1 documents in the names of version 2; facts they never held are null."""
    d = documents.withColumn("d", F.from_json("body", OLD_DOCUMENT)).where("d.schemaVersion = 1")
    none = F.lit(None).cast("bigint")
    unknown = F.lit(None).cast("boolean")

    def spans(column: str) -> Column:
        return F.transform(
            column,
            lambda s: s.withField("duration_nano", s["duration_nano"].cast("string"))
            .withField("start_time_unix_nano", X.legacy_ns_text(s["start_time_unix_nano"]))
            .withField("end_time_unix_nano", X.legacy_ns_text(s["end_time_unix_nano"])),
        )

    def arm(column: str, mode: str) -> Column:
        a = F.col(column)
        return F.struct(
            F.lit(mode).alias("mode"),
            a["traceId"].alias("traceId"),
            a["serviceName"].alias("serviceName"),
            a["signozUrl"].alias("signozUrl"),
            spans(f"{column}.spans").alias("spans"),
        )

    def proof(column: str) -> Column:
        q = F.col(column)
        return F.struct(
            *[q[c].alias(c) for c in ("traceId", "spansSent", "spansRetrieved", "queryAttempts")],
            none.alias("duplicateRows"),
            *[unknown.alias(c) for c in ("identityVerified", "attributesVerified", "serviceNameVerified")],
            q["verified"].alias("verified"),
        )

    keys = [c for c in documents.columns if c != "body"]
    return d.select(
        *keys,
        F.lit(1).cast("bigint").alias("schemaVersion"),
        *[F.col(f"d.{c}").alias(c) for c in ("generatedAt", "runId", "seed", "source", "status", "hardExitCode")],
        F.struct(
            F.col("d.groundTruth.stepAttempts").alias("activationAttempts"),
            none.alias("effectIntents"),
            F.col("d.groundTruth.journalEffects").alias("effectCompletions"),
            none.alias("journalResolutions"),
            none.alias("providerAttempts"),
            F.col("d.groundTruth.businessExecutions").alias("businessExecutions"),
        ).alias("groundTruth"),
        F.col("d.journal").alias("journal"),
        arm("d.aware", "aware").alias("aware"),
        arm("d.naive", "control").alias("control"),
        F.struct(
            F.col("d.comparison.awareExecutedEffectSpans").alias("awareExecutedEffectSpans"),
            F.col("d.comparison.awareReplayedEffectSpans").alias("awareResolvedEffectSpans"),
            F.col("d.comparison.naiveExecutedEffectSpans").alias("controlExecutedEffectSpans"),
        ).alias("comparison"),
        F.struct(proof("d.queryBack.aware").alias("aware"), proof("d.queryBack.naive").alias("control")).alias("queryBack"),
    )


def document_ledger(documents: DataFrame, featured: str, limit: int = 12) -> DataFrame:
    """The featured run first, then the newest ids, each with valid or invalid."""
    invalid = document_issues(documents).select("id").distinct().withColumn("bad", F.lit(True))
    judged = documents.select("id").where(X.is_run_id(F.col("id"))).join(invalid, "id", "left")
    return (
        judged.select("id", F.when(F.col("bad"), "invalid").otherwise("valid").alias("kind"))
        .orderBy(F.col("id") != featured, F.desc("id"))
        .limit(limit)
    )


__all__: Sequence[str] = (
    "DOCUMENT",
    "build_documents",
    "document_issues",
    "document_ledger",
    "flat_summary",
    "normalize_old",
    "parse_documents",
    "proof_frame",
    "read_documents",
)
