"""Spans that were sent against the rows a trace store gives back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import scalar as X
from chronofold.functions.joins import SALTS, skew_join
from chronofold.functions.running import hot_groups
from chronofold.names import DEFAULT_NAMING, SpanNaming

FIELDS = (
    "trace_id",
    "span_id",
    "parent_span_id",
    "name",
    "service_name",
    "operation_name",
    "effect_source",
)
ROW_LIMIT = 1_000
MAX_ROW_LIMIT = 10_000


def normalized(rows: DataFrame) -> DataFrame:
    """Lower-case ids; an empty parent or source counts as none."""
    none = F.lit("")
    return rows.withColumns(
        {
            "trace_id": F.lower(F.coalesce("trace_id", none)),
            "span_id": F.lower(F.coalesce("span_id", none)),
            "parent_span_id": F.nullif(F.lower("parent_span_id"), none),
            "name": F.coalesce("name", none),
            "service_name": F.coalesce("service_name", none),
            "operation_name": F.coalesce("operation_name", none),
            "effect_source": F.nullif(F.col("effect_source"), none),
        }
    )


def retained_fields(spans: DataFrame, naming: SpanNaming = DEFAULT_NAMING, *more: str) -> DataFrame:
    """The seven fields of each span that a read-back can be checked on, and ``more`` as they are."""
    service = F.concat(F.lit(f"{naming.service}-"), F.col("mode"))
    return spans.select(
        "run_id",
        "mode",
        F.lower("trace_id").alias("trace_id"),
        F.lower("span_id").alias("span_id"),
        F.nullif(F.lower("parent_span_id"), F.lit("")).alias("parent_span_id"),
        "name",
        service.alias("service_name"),
        F.coalesce("attributes.operation_name", F.lit("")).alias("operation_name"),
        F.col("attributes.effect_source").alias("effect_source"),
        *more,
    )


def retained_order() -> list[Column]:
    none = F.lit("")
    return [
        F.col("span_id"),
        F.col("name"),
        F.coalesce("parent_span_id", none),
        F.col("operation_name"),
        F.coalesce("effect_source", none),
    ]


def query_windows(spans: DataFrame, *more: Column) -> DataFrame:
    """The trace query of each (run, mode): id, padded time range, row limit; and ``more`` aggregates."""
    return spans.groupBy("run_id", "mode").agg(
        F.min(F.lower("trace_id")).alias("trace_id"),
        X.window_start_ms(F.min("start_time_ns")).alias("start_ms"),
        X.window_end_ms(F.max("end_time_ns")).alias("end_ms"),
        X.window_limit(F.count("*")).alias("row_limit"),
        *more,
    )


def check_query(trace_id: str, start_ms: int, end_ms: int, limit: int) -> None:
    if len(trace_id) != 32 or set(trace_id.lower()) - set("0123456789abcdef"):
        raise ValueError("trace id must be 32 hex digits")
    if start_ms < 0 or end_ms <= start_ms:
        raise ValueError("time range is empty or negative")
    if not 1 <= limit <= MAX_ROW_LIMIT:
        raise ValueError("limit must be between 1 and 10000")


def scan_trace(store: DataFrame, trace_id: str, start_ms: int, end_ms: int, limit: int = ROW_LIMIT) -> DataFrame:
    """Rows of one trace in a time range, by time; the limit is part of the query."""
    check_query(trace_id, start_ms, end_ms, limit)
    hit = (F.lower("trace_id") == trace_id.lower()) & F.col("ts_ms").between(start_ms, end_ms)
    return store.where(hit).orderBy("ts_ms", "ingest_seq").limit(limit).select(*FIELDS)


def scan_traces(store: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """The same scan for many traces at once.

    Each window's own ``row_limit`` holds, up to 10,000 rows, or ``limit`` for all where it
    is given. A first ranking inside hashed shares of a trace drops rows beyond the limit,
    so a trace with very many rows does not pile up in one task.
    """
    if limit is not None and not 1 <= limit <= MAX_ROW_LIMIT:
        raise ValueError("limit must be between 1 and 10000")
    rows = store.withColumn("trace_id", F.lower("trace_id"))
    most = F.lit(limit) if limit is not None else F.least(F.col("row_limit"), F.lit(MAX_ROW_LIMIT))
    wanted = windows.select("trace_id", "start_ms", "end_ms", most.alias("_most"))
    hits = skew_join(rows, wanted, ["trace_id"], hot=hot_groups(rows, ["trace_id"]), how="inner")
    hits = hits.where("ts_ms between start_ms and end_ms")
    order = ("ts_ms", "ingest_seq")
    hits = hits.withColumn("_share", F.pmod(F.xxhash64("span_id", "ingest_seq"), F.lit(SALTS)))
    inside = Window.partitionBy("trace_id", "_share").orderBy(*order)
    hits = hits.withColumn("_in", F.row_number().over(inside)).where("_in <= _most").drop("_share", "_in")
    ranked = F.row_number().over(Window.partitionBy("trace_id").orderBy(*order))
    return hits.withColumn("rank", ranked).where("rank <= _most").drop("_most")


RESPONSE = (
    "data struct<data: struct<results: array<struct<queryName: string, "
    "rows: array<struct<data: map<string,string>>>>>>>"
)


def flatten_response(responses: DataFrame, naming: SpanNaming = DEFAULT_NAMING) -> DataFrame:
    """Trace-store responses (``id``, ``body`` JSON text) as rows of query A."""
    parsed = responses.select("id", F.from_json("body", RESPONSE).alias("b"))
    results = parsed.select("id", F.explode("b.data.data.results").alias("r")).where("r.queryName = 'A'")
    rows = results.select("id", F.explode("r.rows").alias("row"))
    field = lambda k: F.try_element_at("row.data", F.lit(k))
    return rows.select(
        "id",
        field("trace_id").alias("trace_id"),
        field("span_id").alias("span_id"),
        field("parent_span_id").alias("parent_span_id"),
        field("name").alias("name"),
        field("service.name").alias("service_name"),
        field(naming.key("operation.name")).alias("operation_name"),
        field(naming.key("effect.source")).alias("effect_source"),
    )


CHECKED = tuple(c for c in FIELDS if c not in ("trace_id", "span_id"))
IDS = ("trace_id", "span_id", "parent_span_id")


def _packed(rows: DataFrame) -> DataFrame:
    """Ids as bytes, for the shuffle."""
    return rows.withColumns({c: X.packed_hex(F.col(c)) for c in IDS if c in rows.columns})


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: X.unpacked_hex(F.col(c)) for c in rows.columns if c.endswith(IDS)})


def unique_rows(rows: DataFrame, fields: Sequence[str] = (*CHECKED, "ts_ms")) -> DataFrame:
    """One row per span, the last one that came in, with ``fields`` and the number of copies."""
    last = F.max_by(F.struct(*fields), "ingest_seq")
    grouped = _packed(normalized(rows)).groupBy("trace_id", "span_id").agg(last.alias("r"), F.count("*").alias("copies"))
    return _unpacked(grouped.select("trace_id", "span_id", "r.*", "copies"))


def _compared(spans: DataFrame, store: DataFrame, naming: SpanNaming) -> DataFrame:
    """Rows of ``differences`` with ids as bytes, and ``n_sent``, the times a span was sent.

    Both sides are sorted together by span and compared in one window, since a join would
    shuffle each by itself and a trace by its spans. Where no trace is large they are dealt
    by trace, so that what follows per trace needs no further exchange.
    """
    named = F.coalesce("attributes.operation_name", F.lit("")) != ""
    sent = retained_fields(spans.withColumn("_named", named), naming, "_named").withColumn("from_store", F.lit(False))
    got = normalized(store).select(*FIELDS, "ingest_seq", F.lit(True).alias("from_store"))
    both = _packed(sent.unionByName(got, allowMissingColumns=True))
    if hot_groups(both, ["trace_id"]).keys is None:
        both = both.repartition("trace_id")
    ordered = Window.partitionBy("trace_id", "span_id").orderBy("from_store")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stored = F.col("from_store")
    last = F.max_by(F.struct(*CHECKED), F.when(stored, F.col("ingest_seq"))).over(whole)
    rows = both.select(
        "*",
        last.alias("got"),
        F.count_if(stored).over(whole).alias("n_got"),
        F.count_if(~stored).over(whole).alias("n_sent"),
        F.row_number().over(ordered).alias("nth"),
    ).where("not from_store or (n_sent = 0 and nth = 1)")
    seen, was_sent = F.col("n_got") > 0, ~stored
    joined = rows.select(
        "trace_id",
        "span_id",
        F.when(was_sent, True).alias("sent"),
        *[F.when(was_sent, F.col(c)).alias(f"sent_{c}") for c in CHECKED],
        F.when(seen, True).alias("received"),
        F.when(seen, F.col("n_got")).alias("copies"),
        *[F.col(f"got.{c}").alias(f"got_{c}") for c in CHECKED],
        "n_sent",
        "run_id",
        "mode",
        "_named",
    )
    same = lambda c: F.col(f"sent_{c}").eqNullSafe(F.col(f"got_{c}"))
    verdict = (
        F.when(F.col("received").isNull(), "missing")
        .when(F.col("sent").isNull(), "unexpected")
        .when(~(same("parent_span_id") & same("name")), "mismatched")
        .otherwise("equal")
    )
    return joined.withColumn("verdict", verdict).withColumn(
        "attributes_equal",
        F.col("sent").isNotNull() & F.col("received").isNotNull() & same("operation_name") & same("effect_source"),
    )


def differences(spans: DataFrame, store: DataFrame, naming: SpanNaming = DEFAULT_NAMING) -> DataFrame:
    """Full outer comparison, one row per (trace, span) of either side."""
    return _unpacked(_compared(spans, store, naming).drop("n_sent", "run_id", "mode", "_named"))


def verify_readback(spans: DataFrame, store: DataFrame, naming: SpanNaming = DEFAULT_NAMING) -> DataFrame:
    """Per sent trace: what is missing, unexpected or different, and the verdict."""
    rows = _compared(spans, store, naming)
    kind = F.col("verdict")
    joined = rows.groupBy("trace_id").agg(
        F.first("run_id", ignorenulls=True).alias("run_id"),
        F.first("mode", ignorenulls=True).alias("mode"),
        F.count_if("sent").alias("spans_sent"),
        F.count_if(F.col("sent") & ((F.col("n_sent") > 1) | F.col("span_id").isNull() | ~F.col("_named"))).alias("_unsound"),
        F.count_if(kind == "missing").alias("missing"),
        F.count_if(kind == "unexpected").alias("unexpected"),
        F.count_if(kind == "mismatched").alias("mismatched"),
        F.count_if(~F.col("attributes_equal")).alias("attributes_different"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("received")).alias("spans_retrieved"),
        F.min("got_service_name").alias("_low"),
        F.max("got_service_name").alias("_high"),
    ).where("spans_sent > 0")
    # Nothing is known of what has no trace id.
    told = ("missing", "unexpected", "mismatched", "attributes_different", "duplicate_rows", "spans_retrieved")
    joined = joined.withColumns({c: F.when(F.col("trace_id").isNotNull(), F.col(c)) for c in told})
    service = F.concat(F.lit(f"{naming.service}-"), F.col("mode"))
    identity = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("mismatched") == 0)
    return _unpacked(joined).select(
        "trace_id",
        "run_id",
        "mode",
        "spans_sent",
        "spans_retrieved",
        "missing",
        "unexpected",
        "mismatched",
        "duplicate_rows",
        identity.alias("identity_verified"),
        (F.col("attributes_different") == 0).alias("attributes_verified"),
        F.coalesce((F.col("_low") == service) & (F.col("_high") == service), F.lit(False)).alias("service_verified"),
        (F.col("_unsound") == 0).alias("plan_sound"),
    ).withColumn(
        "verified",
        F.col("identity_verified")
        & F.col("attributes_verified")
        & F.col("service_verified")
        & F.col("plan_sound")
        & (F.col("duplicate_rows") == 0),
    )


def verify_retained(
    proofs: DataFrame, proof_rows: DataFrame, spans: DataFrame, naming: SpanNaming = DEFAULT_NAMING
) -> DataFrame:
    """Kept proofs against the spans: request, rows and summary; the first that differs.

    ``proofs``: run_id, mode, expression, start_ms, end_ms, row_limit, spans_sent,
    spans_retrieved, duplicate_rows, trace_id, query_attempts and four flags.
    ``proof_rows``: run_id, mode and the seven retained fields.
    """
    tree = ["run_id", "mode"]
    one = F.coalesce(F.min("trace_id") == F.max("trace_id"), F.lit(False))
    wanted = query_windows(spans, F.count("*").alias("n"), one.alias("one_trace"))
    wanted = wanted.select(*tree, *[F.col(c).alias(f"w_{c}") for c in ("trace_id", "start_ms", "end_ms", "row_limit", "n", "one_trace")])
    sides = retained_fields(spans, naming).withColumn("side", F.lit(1)).unionByName(
        proof_rows.withColumn("side", F.lit(-1))
    )
    # Rows are counted by 128 bits of their hash; dealt by tree, a tree is shuffled once.
    alike = F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256)
    sides = sides.select(*tree, F.unhex(F.substring(alike, 1, 32)).alias("alike"), "side")
    if hot_groups(sides, tree).keys is None:
        sides = sides.repartition(*tree)
    unequal = (
        sides.groupBy(*tree, "alike")
        .agg(F.sum("side").alias("balance"))
        .where("balance <> 0")
        .groupBy(*tree)
        .agg(F.count("*").alias("unequal_rows"))
    )
    joined = proofs.join(wanted, tree, "left").join(unequal, tree, "left")
    same = lambda c, w: F.col(c).eqNullSafe(F.col(w))
    request = (
        F.col("expression").eqNullSafe(F.concat(F.lit("trace_id = '"), F.col("w_trace_id"), F.lit("'")))
        & same("start_ms", "w_start_ms")
        & same("end_ms", "w_end_ms")
        & same("row_limit", "w_row_limit")
    )
    flags = F.col("verified") & F.col("identity_verified") & F.col("attributes_verified") & F.col("service_verified")
    summary = (
        flags
        & (F.col("duplicate_rows") == 0)
        & same("spans_sent", "w_n")
        & same("spans_retrieved", "w_n")
        & same("trace_id", "w_trace_id")
    )
    broken = (
        F.when(F.col("w_n").isNull(), "no_spans")
        .when(~F.col("w_one_trace"), "several_traces")
        .when(~request, "request_differs")
        .when(F.col("unequal_rows").isNotNull(), "rows_differ")
        .when(~F.coalesce(summary, F.lit(False)), "summary_differs")
        .when(~F.coalesce(F.col("query_attempts") >= 1, F.lit(False)), "bad_attempts")
    )
    return joined.select(*tree, broken.alias("broken"))
