"""Nested exports of runs and spans, and the checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.functions.joins import lookup_join, skew_join
from chronofold.functions.running import GROUP_ROWS, HotGroups, hot_groups, ordinal
from chronofold.functions.storage import cut
from chronofold.names import DEFAULT_NAMING, SpanNaming
from chronofold.operators.decode import event_time
from chronofold.operators.projection import attributes_json
from chronofold.operators.redaction import public_payload

PART_ROWS = 4_096


def in_parts(
    rows: DataFrame, key: list[str], order: str, item: Column, name: str, *, hot: HotGroups, part_rows: int = PART_ROWS
) -> DataFrame:
    """Ordered arrays per key, cut in parts so no array grows with the group.

    A group of up to ``part_rows`` rows is one part, number 0. Longer groups keep every
    row, spread over as many parts as needed.
    """
    return _into_parts(ordinal(rows.withColumn("_item", item), key, order, "_at", hot=hot), key, name, part_rows)


def _into_parts(numbered: DataFrame, key: list[str], name: str, part_rows: int) -> DataFrame:
    """Rows with ``_item`` and their place ``_at`` in the group, as arrays."""
    part = F.expr(f"_at div {part_rows}").alias("part")
    packed = numbered.groupBy(*key, part).agg(
        F.array_sort(F.collect_list(F.struct("_at", F.col("_item").alias("i")))).alias("_items")
    )
    return packed.select(*key, "part", F.transform("_items", lambda s: s["i"]).alias(name))


def public_events(events: DataFrame, *, width: int = GROUP_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Per run the ordered public events, in parts."""
    item = F.struct(
        "seq",
        "type",
        "node",
        F.col("activation_id").alias("activationId"),
        F.col("attempt_id").alias("attemptId"),
        public_payload().alias("payload"),
        X.ns_text(event_time()).alias("atUnixNano"),
    )
    hot = hot_groups(events, ["run_id"], width)
    return in_parts(events, ["run_id"], "seq", item, "events", hot=hot, part_rows=part_rows)


def completed_nodes(events: DataFrame, *, width: int = GROUP_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Per run the finished nodes in order, repeats kept, in parts."""
    done = events.where("type = 'activation_finished'")
    hot = hot_groups(done, ["run_id"], width)
    return in_parts(done, ["run_id"], "seq", F.col("node"), "completed", hot=hot, part_rows=part_rows)


def export_runs(events: DataFrame, states: DataFrame, nodes: DataFrame, **sizes: int) -> DataFrame:
    """Runs with state, finished nodes, public events and their graph, ready for JSON."""
    graph = nodes.groupBy("workflow_version").agg(
        F.struct(
            F.max(F.when(F.col("is_start"), F.col("name"))).alias("start"),
            F.first("workflow_version").alias("version"),
            F.array_sort(
                F.collect_list(
                    F.struct("name", "description", F.col("requires_approval").alias("requiresApproval"))
                )
            ).alias("nodes"),
        ).alias("graph")
    )
    packed = public_events(events, **sizes)
    hot = hot_groups(packed, ["run_id"])
    joined = skew_join(packed, states.where("rule is null"), ["run_id"], hot=hot, how="inner")
    finished = F.filter("events", lambda e: e["type"] == N.ACTIVATION_FINISHED)
    joined = lookup_join(joined, graph, ["workflow_version"])
    return joined.select(
        F.lit(2).alias("schemaVersion"),
        F.lit("business values omitted").alias("redaction"),
        "graph",
        F.col("run_id").alias("runId"),
        "part",
        "status",
        F.transform(finished, lambda e: e["node"]).alias("completed"),  # of this part's events
        F.col("next_node").alias("nextNode"),
        "events",
    )


def resource_attributes(mode: Column, naming: SpanNaming = DEFAULT_NAMING) -> Column:
    return F.struct(
        F.concat(F.lit(f"{naming.service}-"), mode).alias("service.name"),
        F.lit(naming.service_version).alias("service.version"),
        F.lit("python").alias("telemetry.sdk.language"),
    )


def span_document(naming: SpanNaming = DEFAULT_NAMING) -> Column:
    """One span as the JSON text a file of spans holds."""
    rest = F.to_json(
        F.struct(
            F.col("end_time_ns").alias("end_time_unix_nano"),
            "kind",
            "name",
            "parent_span_id",
            "span_id",
            F.col("start_time_ns").alias("start_time_unix_nano"),
            "status",
            "trace_id",
        ),
        {"ignoreNullFields": "false"},
    )
    # The attributes are JSON without nulls already; put in as they are, they need not be parsed again.
    return F.concat(F.lit('{"attributes":'), attributes_json(naming=naming), F.lit(","), F.substring(rest, 2, 2**31 - 1))


def planned_identities(spans: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Per (run, mode) what an export must hold: spans, distinct ids, one trace.

    Where ``hot`` says that no export is large, its ids are dealt by (run, mode), as bytes.
    """
    if hot is not None and hot.keys is None:
        slim = spans.select("run_id", "mode", *[X.packed_hex(F.col(c)).alias(c) for c in ("trace_id", "span_id")])
        spans = slim.repartition("run_id", "mode").withColumn("trace_id", X.unpacked_hex(F.col("trace_id")))
    return spans.groupBy("run_id", "mode").agg(
        F.count("*").alias("span_count"),
        F.count_distinct("span_id").alias("distinct_ids"),
        F.min("trace_id").alias("trace_id"),
        (F.min("trace_id") != F.max("trace_id")).alias("several_traces"),
    )


def envelopes(
    spans: DataFrame,
    digests: DataFrame,
    *,
    naming: SpanNaming = DEFAULT_NAMING,
    width: int = GROUP_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Export envelopes of every (run, mode): spans in family order, in parts.

    An export with two trace ids or a repeated span id is refused (no row). ``digests``:
    run_id, journal_sha256.
    """
    key = ["run_id", "mode"]
    hot = hot_groups(spans, key, width)
    identity = planned_identities(spans, hot)
    good = identity.where("distinct_ids = span_count and not several_traces").join(digests, "run_id", "left")
    # Families follow each other; sequence numbers order inside a family.
    place = F.col("family") * F.lit(1 << 58) + F.col("seq")
    # The documents are made behind the shuffle, since they say more than the rows; ids and hashes travel as bytes.
    ids = ("trace_id", "span_id", "parent_span_id")
    hashed = F.col("attributes.request_fingerprint")
    with_hash = lambda c: F.col("attributes").withField("request_fingerprint", c).alias("attributes")
    rows = spans.withColumns({c: X.packed_hex(F.col(c)) for c in ids} | {"attributes": with_hash(X.packed_hex(hashed)), "_place": place})
    numbered = ordinal(rows, key, "_place", "_at", hot=hot)
    numbered = numbered.withColumns({c: X.unpacked_hex(F.col(c)) for c in ids} | {"attributes": with_hash(X.unpacked_hex(hashed))})
    item = F.struct("identity", "span_id", span_document(naming).alias("body"))
    packed = _into_parts(numbered.withColumn("_item", item), key, "spans", part_rows)
    return skew_join(packed, good, key, hot=hot, how="inner").select(
        F.lit(1).alias("schema_version"),
        *key,
        "part",
        "trace_id",
        "span_count",
        "journal_sha256",
        resource_attributes(F.col("mode"), naming).alias("resource"),
        "spans",
    )


def check_exported(spans: DataFrame, written: DataFrame) -> DataFrame:
    """Planned against written span ids of each (run, mode), and the verdict."""
    key = ["run_id", "mode", "trace_id", "span_id"]
    planned = spans.groupBy(*key).agg(F.count("*").alias("planned"))
    found = written.groupBy(*key).agg(F.count("*").alias("written"))
    both = planned.join(found, key, "full_outer")
    return both.groupBy("run_id", "mode").agg(
        F.count_if(F.col("written").isNull()).alias("lost"),
        F.count_if(F.col("planned").isNull()).alias("foreign"),
        F.count_if((F.col("planned") > 1) | (F.col("written") > 1)).alias("repeated"),
        (F.min("trace_id") != F.max("trace_id")).alias("several_traces"),
    ).withColumn(
        "identity_match",
        (F.col("lost") == 0) & (F.col("foreign") == 0) & (F.col("repeated") == 0) & ~F.col("several_traces"),
    )


def parents_first(spans: DataFrame) -> DataFrame:
    """Spans an export would emit before their parent."""
    place = F.struct("family", "seq")
    parents = spans.select("run_id", "mode", F.col("span_id").alias("parent_span_id"), place.alias("parent_place"))
    joined = spans.withColumn("place", place).join(parents, ["run_id", "mode", "parent_span_id"])
    return joined.where("parent_place >= place")


def journal_digests(
    events: DataFrame, *, width: int = GROUP_ROWS, part_rows: int = PART_ROWS
) -> DataFrame:
    """Content digest of every run: hash of the hashes of its rows, part by part, in order."""
    text = F.concat_ws(
        "\x1f",
        F.col("seq").cast("string"),
        "type",
        *[F.coalesce(c, F.lit("\x00")) for c in ("node", "activation_id", "attempt_id")],
        "payload",
        F.col("at_ns").cast("string"),
    )
    hot = hot_groups(events, ["run_id"], width)
    parts = in_parts(events, ["run_id"], "seq", F.sha2(text, 256), "rows", hot=hot, part_rows=part_rows)
    digest = parts.select("run_id", "part", F.sha2(F.array_join("rows", ""), 256).alias("digest"))
    whole = None
    while True:  # a run is folded until one part is left, by its own number of rows
        folded = digest.groupBy("run_id", F.expr(f"part div {part_rows}").alias("part")).agg(
            F.array_sort(F.collect_list(F.struct("part", "digest"))).alias("d")
        )
        digest = folded.select(
            "run_id", "part", F.sha2(F.array_join(F.transform("d", lambda s: s["digest"]), ""), 256).alias("digest")
        )
        if hot.keys is None and width <= part_rows**2:  # no run is longer than two levels hold
            return _joined(whole, digest)
        digest = cut(digest)
        long = digest.where("part > 0").select("run_id").distinct()
        whole = _joined(whole, digest.join(long, "run_id", "left_anti"))
        digest = digest.join(long, "run_id", "left_semi")
        if digest.isEmpty():
            return whole


def _joined(whole: DataFrame | None, digest: DataFrame) -> DataFrame:
    done = digest.select("run_id", F.col("digest").alias("journal_sha256"))
    return done if whole is None else whole.unionByName(done)


def audit_delivery(finals: DataFrame, staged: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Final exports against their staged copy and delivery receipt; first failure each.

    ``finals``: run_id, mode, span_count, spans_sha256, staged STRUCT<sha256, bytes>,
    delivery STRUCT<sha256, bytes>, otlp STRUCT<attempted, acknowledged, state, result,
    cleanup_state>. ``staged``: run_id, mode, spans_sha256, sha256, bytes. ``deliveries``:
    run_id, mode, sha256, bytes, attempted, acknowledged, state, exporter_result,
    cleanup_state.
    """
    key = ["run_id", "mode"]
    s = staged.select(*key, F.struct("spans_sha256", "sha256", "bytes").alias("s"))
    d = deliveries.select(
        *key,
        F.struct("sha256", "bytes", "attempted", "acknowledged", "state", "exporter_result", "cleanup_state").alias("d"),
    )
    joined = finals.join(s, key, "left").join(d, key, "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def clean(prefix: str, result: str) -> Column:
        return F.coalesce(
            F.col(f"{prefix}.attempted")
            & F.col(f"{prefix}.acknowledged")
            & (F.col(f"{prefix}.state") == "DELIVERED")
            & (F.col(f"{prefix}.{result}") == "SUCCESS")
            & (F.col(f"{prefix}.cleanup_state") == "SUCCESS"),
            F.lit(False),
        )

    binds = (
        same("staged.sha256", "s.sha256")
        & same("staged.bytes", "s.bytes")
        & same("delivery.sha256", "d.sha256")
        & same("delivery.bytes", "d.bytes")
    )
    failure = (
        F.when(~same("spans_sha256", "s.spans_sha256"), "staged_differs")
        .when(~binds, "snapshot_not_bound")
        .when(~clean("otlp", "result"), "final_not_delivered")
        .when(~clean("d", "exporter_result"), "receipt_not_delivered")
    )
    return joined.select(*key, failure.alias("failure"))


def delivery_receipts(outcomes: DataFrame) -> DataFrame:
    """Receipt fields from the outcome of each delivery attempt.

    ``outcomes``: run_id, mode, endpoint, result (null when none was asked for),
    cleanup_ok.
    """
    asked = F.col("endpoint").isNotNull()
    success = F.coalesce(F.col("result") == "SUCCESS", F.lit(False))
    return outcomes.select(
        "run_id",
        "mode",
        F.when(~asked, "NOT_REQUESTED").when(success, "DELIVERED").otherwise("FAILED").alias("state"),
        asked.alias("attempted"),
        (asked & success).alias("acknowledged"),
        X.safe_endpoint(F.col("endpoint")).alias("endpoint"),
        F.when(asked, F.col("result")).alias("exporter_result"),
        F.when(~asked, "NOT_REQUESTED").when(F.col("cleanup_ok"), "SUCCESS").otherwise("FAILED").alias("cleanup_state"),
    )


def audit_source_facts(facts: DataFrame, documents: DataFrame, store: DataFrame) -> DataFrame:
    """Sanitised source facts against the document and the effect store, per run.

    ``facts``: run_id, provider_attempts, business_executions, key_sha256, events_sha256,
    observed_bytes. ``documents``: run_id, doc_attempts, doc_executions, doc_events_sha256.
    ``store``: run_id, idempotency_key (one row per attempt), kept BOOLEAN.
    """
    counted = store.groupBy("run_id").agg(
        F.count("*").alias("store_attempts"),
        F.count_distinct(F.when(F.col("kept"), F.col("idempotency_key"))).alias("store_executions"),
        F.max(F.sha2("idempotency_key", 256)).alias("store_key"),
    )
    joined = facts.join(documents, "run_id", "left").join(counted, "run_id", "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    failure = (
        F.when(F.col("doc_attempts").isNull(), "no_document")
        .when(~same("events_sha256", "doc_events_sha256"), "events_differ")
        .when(~F.coalesce(F.col("observed_bytes") > 0, F.lit(False)), "nothing_observed")
        .when(
            ~same("provider_attempts", "doc_attempts") | ~same("business_executions", "doc_executions"), "counts_differ"
        )
        .when(~F.coalesce(X.is_hex(F.col("key_sha256"), 64), F.lit(False)), "key_hash_form")
        .when(
            ~same("key_sha256", "store_key")
            | ~same("provider_attempts", "store_attempts")
            | ~same("business_executions", "store_executions"),
            "store_differs",
        )
    )
    return joined.select("run_id", failure.alias("failure"))
