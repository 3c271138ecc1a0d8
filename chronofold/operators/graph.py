"""Workflow graphs kept as tables: checks and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions.joins import lookup_join

V = "workflow_version"


def graph_problems(nodes: DataFrame, routes: DataFrame, starts: DataFrame) -> DataFrame:
    """Every defect of every graph as ``(workflow_version, problem, subject)``.

    ``starts`` names the START node of each version. A route is one row, or several with
    rising priority when a predicate chooses the target.
    """
    known = nodes.select(V, F.col("name").alias("subject")).distinct()
    leaving = routes.select(V, F.col("from_node").alias("subject")).distinct()
    static = routes.where("predicate is null").groupBy(V, "from_node").agg(
        F.max("target").alias("target"), F.count("*").alias("n")
    )
    choosing = routes.where("predicate is not null").select(V, "from_node").distinct()

    def problem(df: DataFrame, name: str) -> DataFrame:
        return df.select(V, F.lit(name).alias("problem"), "subject")

    parts = [
        problem(
            starts.select(V, F.col("start").alias("subject")).join(known, [V, "subject"], "left_anti"),
            "start_not_defined",
        ),
        problem(known.join(leaving, [V, "subject"], "left_anti"), "node_without_route"),
        problem(leaving.join(known, [V, "subject"], "left_anti"), "route_from_undefined_node"),
        problem(
            static.join(choosing, [V, "from_node"], "left_anti")
            .where(F.col("target") != N.END_NODE)
            .select(V, F.col("target").alias("subject"))
            .join(known, [V, "subject"], "left_anti"),
            "edge_points_nowhere",
        ),
        problem(
            nodes.groupBy(V, F.col("name").alias("subject")).count().where("count > 1"),
            "duplicate_node",
        ),
        problem(
            routes.groupBy(V, F.col("from_node").alias("subject"), "priority")
            .count()
            .where("count > 1"),
            "duplicate_route",
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()


def next_nodes(
    states: DataFrame, routes: DataFrame, nodes: DataFrame, predicates: Sequence[str]
) -> DataFrame:
    """The node each state moves to: END without a route, else the first route that holds.

    ``states``: workflow_version, node and the columns the predicates read.
    ``predicates`` lists the SQL conditions that occur in ``routes``; each is evaluated
    once per row as a column and picked by its text.
    """
    by_node = routes.groupBy(V, F.col("from_node").alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("priority", "predicate", "target"))).alias("options")
    )
    keyed = lookup_join(states, by_node, [V, "node"])
    if predicates:
        outcomes = [x for t in predicates for x in (F.lit(t), F.coalesce(F.expr(t), F.lit(False)))]
        test = F.create_map(*outcomes)
    else:
        test = F.create_map(F.lit(""), F.lit(False))

    def holds(option: Column) -> Column:
        met = F.coalesce(F.element_at(test, option["predicate"]), F.lit(False))
        return option["predicate"].isNull() | met

    target = F.when(F.col("options").isNull(), N.END_NODE).otherwise(
        F.get(F.filter("options", holds), F.lit(0))["target"]
    )
    names = nodes.groupBy(V).agg(F.collect_set("name").alias("names"))
    judged = lookup_join(keyed.withColumn("target", target), names, [V])
    ok = (F.col("target") == N.END_NODE) | F.array_contains("names", F.col("target"))
    return judged.withColumn(
        "route_error",
        F.when(F.col("target").isNull(), "no_route_chosen").when(~F.coalesce(ok, F.lit(False)), "undefined_target"),
    ).drop("options", "names")
