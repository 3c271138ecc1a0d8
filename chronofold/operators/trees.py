"""Span trees: parents, intervals, connectivity, depth, and the two views compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import scalar as X
from chronofold.functions.joins import skew_join
from chronofold.functions.running import GROUP_ROWS, hot_groups, null_safe_join
from chronofold.functions.storage import cut
from chronofold.names import DEFAULT_NAMING, SpanNaming

TREE = ("run_id", "mode")
MAX_DEPTH = 8
FEW_SPANS = 64
"""A tree of so many spans at most is walked as one array."""
IDS = ("span_id", "parent_span_id")


def _by_parent(spans: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Left join on the parent id; a parent with very many children is split."""
    key = [*TREE, "parent_span_id"]
    children = spans.where("parent_span_id is not null")
    return skew_join(spans, right, key, hot=hot_groups(children, key, width))


def with_parent(
    spans: DataFrame, fields: Sequence[str] = ("start_time_ns", "end_time_ns"), width: int = GROUP_ROWS
) -> DataFrame:
    """Each span with ``parent_found`` and the named fields of its parent.

    Span ids that occur twice count once here, so a damaged table cannot multiply rows.
    """
    spans = spans.withColumns({c: X.packed_hex(F.col(c)) for c in IDS})  # ids are shuffled as bytes
    parents = spans.groupBy(*TREE, F.col("span_id").alias("parent_span_id")).agg(
        F.lit(True).alias("parent_found"),
        *[F.max_by(f, "start_time_ns").alias(f"parent_{f}") for f in fields],
    )
    joined = _by_parent(spans, parents, width)
    plain = {c: X.unpacked_hex(F.col(c)) for c in IDS}
    return joined.withColumns(plain | {"parent_found": F.coalesce("parent_found", F.lit(False))})


def escapes_parent() -> Column:
    """The span starts before or ends after the parent it has."""
    return F.col("parent_found") & (
        (F.col("start_time_ns") < F.col("parent_start_time_ns"))
        | (F.col("end_time_ns") > F.col("parent_end_time_ns"))
    )


def _inner_nodes(spans: DataFrame) -> DataFrame:
    """Spans that are somebody's parent, once each, with their own parent."""
    used = (
        spans.where("parent_span_id is not null")
        .select(*TREE, F.col("parent_span_id").alias("span_id"))
        .distinct()
    )
    nodes = spans.groupBy(*TREE, "span_id").agg(F.max("parent_span_id").alias("parent_span_id"))
    return nodes.join(used, [*TREE, "span_id"], "left_semi")


def with_depth(spans: DataFrame, width: int = GROUP_ROWS) -> DataFrame:
    """Number of distinct ancestors, at most 8; cycles and missing parents end the walk.

    Trees of few spans are shuffled once and walked each by itself, all others by joins.
    """
    hot = hot_groups(spans, TREE, min(FEW_SPANS, width))
    if hot.keys is None:
        return _depth_by_tree(spans)
    if not hot.bounded:
        return _depth_by_joins(spans, width)
    few = null_safe_join(spans, F.broadcast(hot.keys), TREE, "left_anti")
    return _depth_by_tree(few).unionByName(_depth_by_joins(hot.only(spans), width))


def _depth_by_tree(spans: DataFrame) -> DataFrame:
    rest = [c for c in spans.columns if c not in TREE]
    item = F.struct(*[X.packed_hex(F.col(c)).alias(c) if c in IDS else F.col(c) for c in rest])
    trees = spans.groupBy(*TREE).agg(F.collect_list(item).alias("_s"))
    plain = lambda x: F.struct(*[X.unpacked_hex(x[c]).alias(c) if c in IDS else x[c].alias(c) for c in rest])
    trees = trees.select(*TREE, F.transform("_s", plain).alias("_s"))
    known = F.col("run_id").isNotNull() & F.col("mode").isNotNull()

    def above(tip: Column) -> Column:
        parents = F.transform(F.filter("_s", lambda s: s["span_id"] == tip), lambda s: s["parent_span_id"])
        return F.when(known, F.array_max(parents))

    def step(path: Column, _: Column) -> Column:
        return F.array_union(path, F.filter(F.array(above(F.element_at(path, -1))), lambda x: x.isNotNull()))

    rounds = F.sequence(F.lit(1), F.lit(MAX_DEPTH - 1))

    def depth(s: Column) -> Column:
        path = F.aggregate(rounds, F.array(s["parent_span_id"]), step)
        return F.when(s["parent_span_id"].isNull(), 0).otherwise(F.size(path))

    walked = F.transform("_s", lambda s: F.struct(*[s[c].alias(c) for c in rest], depth(s).alias("depth")))
    return trees.select(*TREE, F.inline(walked)).select(*spans.columns, "depth")


def _depth_by_joins(spans: DataFrame, width: int) -> DataFrame:
    """The spans that are somebody's parent are written once; a fixed number of joins among
    them goes up one ancestor each. Those without a parent end no walk that others do not."""
    inner = cut(_inner_nodes(spans))
    inner = inner.where("parent_span_id is not null")
    up = inner.select(*TREE, F.col("span_id").alias("tip"), F.col("parent_span_id").alias("onward"))
    none = F.array().cast("array<string>")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(none)
    walk = inner.select(*TREE, "span_id", one("parent_span_id").alias("path"), F.col("parent_span_id").alias("tip"))
    for _ in range(MAX_DEPTH - 2):
        walk = walk.join(up, [*TREE, "tip"], "left").select(
            *TREE, "span_id", F.concat("path", one("onward")).alias("path"), F.col("onward").alias("tip")
        )
    above = walk.select(*TREE, F.col("span_id").alias("parent_span_id"), F.col("path").alias("_path"))
    joined = _by_parent(spans, above, width)
    chain = F.concat(F.array("parent_span_id"), F.coalesce("_path", none))
    depth = F.when(F.col("parent_span_id").isNull(), 0).otherwise(
        F.least(F.lit(MAX_DEPTH), F.size(F.array_distinct(F.slice(chain, 1, MAX_DEPTH))))
    )
    return joined.withColumn("depth", depth).select(*spans.columns, "depth")


def reached_from_root(spans: Column, rounds: Column) -> Column:
    """Ids of the spans that hang from the first parentless one, in a short array of spans."""
    roots = F.filter(spans, lambda s: s["parent_span_id"].isNull())
    return F.aggregate(
        rounds,
        F.transform(F.slice(roots, 1, 1), lambda s: s["span_id"]),
        lambda known, _: F.array_union(
            known,
            F.transform(F.filter(spans, lambda s: F.array_contains(known, s["parent_span_id"])), lambda s: s["span_id"]),
        ),
    )


def check_trees(
    spans: DataFrame, *, workflow: str, node: str, n_spans: int = 5, naming: SpanNaming = DEFAULT_NAMING
) -> DataFrame:
    """Number of spans and the first broken tree rule of every (run, mode), null when sound.

    The first rule fixes the number of spans, so all others are tested on arrays of that
    length. Rows beyond it are dropped before the exchange; a count tells how many there are.
    """
    a = naming.attribute
    op = F.col("attributes.operation_name")
    plain = (F.col("kind") == "INTERNAL") & (F.size("links") == 0) & (F.col("classification") == "structural")
    root_ok = (
        plain
        & (F.col("identity") == "run")
        & (F.col("name") == f"{a}.run")
        & (op == "run")
        & F.col("attributes.workflow_version").eqNullSafe(F.lit(workflow))
    )
    activation_ok = (
        plain & (F.col("name") == f"{a}.activation {node}") & F.col("attributes.node").eqNullSafe(F.lit(node))
    )
    activation = op == "activation"
    outcome, recovery = F.col("attributes.attempt_outcome"), F.col("attributes.attempt_recovery")
    yes = lambda c: F.coalesce(c, F.lit(False))
    no_interval = (F.col("end_time_ns") < F.col("start_time_ns")) | ~F.col("duration_ns").eqNullSafe(
        F.col("end_time_ns") - F.col("start_time_ns")
    )
    facts = F.struct(
        "span_id", "parent_span_id", "trace_id", "start_time_ns", "end_time_ns",
        yes(no_interval).alias("bad_interval"), yes(root_ok).alias("root_ok"), yes(activation).alias("activation"),
        yes(activation_ok).alias("activation_ok"), yes(activation & (outcome == "abandoned") & ~recovery).alias("first_try"),
        yes(activation & (outcome == "completed") & recovery).alias("recovered"),
    )
    rank = F.row_number().over(Window.partitionBy(*TREE).orderBy("span_id"))
    few = spans.select(*TREE, "span_id", facts.alias("s")).withColumn("_rank", rank).where(F.col("_rank") <= n_spans)
    packed = few.groupBy(*TREE).agg(F.collect_list("s").alias("s"))
    counted = spans.groupBy(*TREE).agg(F.count("*").alias("spans"))
    s = F.col("s")
    ids, roots = F.transform(s, lambda x: x["span_id"]), F.filter(s, lambda x: x["parent_span_id"].isNull())
    number = lambda test: F.size(F.filter(s, test))
    known = lambda x: F.array_contains(ids, x["parent_span_id"])
    outside = lambda x: F.exists(
        s,
        lambda p: (p["span_id"] == x["parent_span_id"])
        & ((x["start_time_ns"] < p["start_time_ns"]) | (x["end_time_ns"] > p["end_time_ns"])),
    )
    rounds = F.sequence(F.lit(1), F.lit(n_spans))
    top = F.get(roots, F.lit(0))["span_id"]
    broken = (
        F.when(F.col("spans") != n_spans, "span_count")
        .when(F.size(F.array_distinct(ids)) != n_spans, "duplicate_span_id")
        .when(F.size(roots) != 1, "root_count")
        .when(F.size(F.array_distinct(F.transform(s, lambda x: x["trace_id"]))) != 1, "trace_id_changed")
        .when(number(lambda x: x["parent_span_id"].isNotNull() & ~known(x)) > 0, "missing_parent")
        .when(number(lambda x: x["bad_interval"]) > 0, "bad_interval")
        .when(number(outside) > 0, "escapes_parent")
        .when(F.size(reached_from_root(s, rounds)) != n_spans, "not_connected")
        .when(number(lambda x: x["parent_span_id"].isNull() & ~x["root_ok"]) > 0, "root_contract")
        .when(number(lambda x: x["activation"]) != 2, "activation_count")
        .when(
            number(lambda x: x["activation"] & ~(x["activation_ok"] & (x["parent_span_id"] == top))) > 0,
            "activation_contract",
        )
        .when((number(lambda x: x["first_try"]) != 1) | (number(lambda x: x["recovered"]) != 1), "attempt_topology")
    )
    return packed.join(counted, [*TREE]).select(*TREE, "spans", broken.alias("broken"))


def effect_key() -> Column:
    return F.coalesce(
        F.concat(F.col("attributes.attempt_id"), F.lit(":"), F.col("attributes.effect_id")),
        F.col("identity"),
    )


def difference_rows(spans: DataFrame) -> DataFrame:
    """Spans of both views whose effect the aware view shows as read back."""
    keyed = spans.withColumn("effect_key", effect_key())
    read_back = (
        keyed.where("mode = 'aware' and classification in ('resolved', 'replayed')")
        .select("run_id", "effect_key")
        .distinct()
    )
    return keyed.join(read_back, ["run_id", "effect_key"], "left_semi")


def compare_arms(
    spans: DataFrame,
    *,
    effect_id: str,
    label: str,
    adapter_version: str,
    naming: SpanNaming = DEFAULT_NAMING,
    width: int = GROUP_ROWS,
) -> DataFrame:
    """Per run: effect counts of both views and the first broken comparison rule."""
    a = naming.attribute
    outcome = spans.withColumn("attempt_outcome", F.col("attributes.attempt_outcome"))
    joined = with_parent(outcome, ("attempt_outcome",), width)
    aware, control = F.col("mode") == "aware", F.col("mode") == "control"
    executed = F.col("classification") == "executed"
    resolved = F.col("classification") == "resolved"
    effect = executed | resolved
    at = lambda f: F.col(f"attributes.{f}")
    contract = (
        at("effect_id").eqNullSafe(F.lit(effect_id))
        & at("effect_index").eqNullSafe(F.lit(0))
        & at("effect_label").eqNullSafe(F.lit(label))
        & at("adapter_version").eqNullSafe(F.lit(adapter_version))
        & (F.col("kind") == "INTERNAL")
    )
    execute = (at("operation_name") == "effect.execute") & (F.col("name") == f"{a}.effect.execute {label}")
    resolve = (at("operation_name") == "effect.resolve") & (F.col("name") == f"{a}.effect.resolve {label}")
    external = at("effect_source").eqNullSafe(F.lit("external"))
    journal = at("effect_source").eqNullSafe(F.lit("journal"))
    blind = at("effect_source").isNull() & (F.size("links") == 0)
    parent = F.col("parent_attempt_outcome")
    link = F.when(F.size("links") == 1, F.get("links", F.lit(0)))
    per_run = joined.groupBy("run_id").agg(
        F.count_if(aware & executed).alias("aware_executed"),
        F.count_if(aware & resolved).alias("aware_resolved"),
        F.count_if(control & executed).alias("control_executed"),
        F.count_if(control & resolved).alias("control_resolved"),
        F.count_if(effect & ~contract).alias("bad_contract"),
        F.count_if(aware & executed & ~(execute & external)).alias("bad_execution"),
        F.count_if(aware & resolved & ~(resolve & journal)).alias("bad_resolution"),
        F.count_if(control & executed & ~(execute & blind)).alias("bad_control"),
        F.max(F.when(aware & executed, F.concat("trace_id", "span_id"))).alias("_source"),
        F.max(F.when(aware & resolved, F.concat(link["trace_id"], link["span_id"]))).alias("_link"),
        F.max(F.when(aware, F.col("trace_id"))).alias("_aware_trace"),
        F.max(F.when(control, F.col("trace_id"))).alias("_control_trace"),
        F.count_if(aware & executed & (parent == "abandoned")).alias("_a1"),
        F.count_if(aware & resolved & (parent == "completed")).alias("_a2"),
        F.count_if(control & executed & (parent == "abandoned")).alias("_c1"),
        F.count_if(control & executed & (parent == "completed")).alias("_c2"),
    )
    topology = (F.col("_a1") == 1) & (F.col("_a2") == 1) & (F.col("_c1") == 1) & (F.col("_c2") == 1)
    broken = (
        F.when(F.col("_aware_trace").eqNullSafe(F.col("_control_trace")), "same_trace")
        .when((F.col("aware_executed") != 1) | (F.col("aware_resolved") != 1), "aware_counts")
        .when((F.col("control_executed") != 2) | (F.col("control_resolved") != 0), "control_counts")
        .when(F.col("bad_contract") > 0, "effect_contract")
        .when(F.col("bad_execution") > 0, "execution_source")
        .when(F.col("bad_resolution") > 0, "resolution_source")
        .when(~F.col("_link").eqNullSafe(F.col("_source")), "resolution_link")
        .when(F.col("bad_control") > 0, "control_not_blind")
        .when(~topology, "effect_topology")
    )
    return per_run.withColumn("broken", broken).select(
        "run_id", "aware_executed", "aware_resolved", "control_executed", "control_resolved", "broken"
    )


def check_links(spans: DataFrame) -> DataFrame:
    """Every span link with ``found``: whether the span it names exists in its trace."""
    links = spans.select(
        "run_id", "mode", "identity", F.explode("links").alias("link")
    ).select("run_id", "mode", "identity", F.col("link.trace_id").alias("trace_id"), F.col("link.span_id").alias("span_id"))
    known = spans.select(*TREE, "trace_id", "span_id").distinct().withColumn("found", F.lit(True))
    joined = links.join(known, [*TREE, "trace_id", "span_id"], "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))
