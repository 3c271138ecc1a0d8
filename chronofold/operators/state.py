"""Merged run state, replays of prefixes, and short listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions.joins import skew_join
from chronofold.functions.running import GROUP_ROWS, hot_groups
from chronofold.operators.exports import completed_nodes
from chronofold.operators.fold import fold

# How a status is shown.
STATUS_WORD = {"finished": "done", "failed": "failed", "awaiting_approval": "HELD", "running": "running"}


def state_values(events: DataFrame) -> DataFrame:
    """Last written value per run and key, as JSON text.

    The input counts as the first patch. Grouping by (run, key) with a maximum combines
    before the exchange, so a run with very many patches stays cheap.
    """
    source = F.when(F.col("type") == N.RUN_STARTED, "$.input").when(F.col("type") == N.ACTIVATION_FINISHED, "$.patch")
    patches = events.withColumn("_at", source).where("_at is not null").select(
        "run_id",
        "seq",
        F.when(
            F.col("_at") == "$.input", F.try_variant_get(F.try_parse_json("payload"), "$.input", "map<string,variant>")
        )
        .otherwise(F.try_variant_get(F.try_parse_json("payload"), "$.patch", "map<string,variant>"))
        .alias("patch"),
    )
    pairs = patches.select("run_id", "seq", F.explode(F.map_entries("patch")).alias("e"))
    texts = pairs.select("run_id", "seq", F.col("e.key").alias("key"), F.to_json(F.col("e.value")).alias("value"))
    return texts.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"))


def json_object(entries: Column) -> Column:
    """JSON text of sorted ``(key, value)`` structs whose values are JSON already."""
    parts = F.transform(
        F.array_sort(entries),
        lambda e: F.concat(F.regexp_extract(F.to_json(F.struct(e["key"].alias("k"))), r'^\{"k":(.*)\}$', 1), F.lit(":"), e["value"]),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def merged_state(events: DataFrame) -> DataFrame:
    """The state of each run as one JSON object; its size is the size of that state."""
    return state_values(events).groupBy("run_id").agg(
        json_object(F.collect_list(F.struct("key", "value"))).alias("state")
    )


def prefixes(events: DataFrame, requests: DataFrame, *, width: int = GROUP_ROWS) -> DataFrame:
    """Events up to ``at_seq`` of each request (run_id, at_seq), keyed by ``replay_id``.

    Several requests for one run give one prefix each.
    """
    joined = skew_join(events, requests, ["run_id"], hot=hot_groups(events, ["run_id"], width), how="inner")
    return joined.where("seq <= at_seq")


def replay(events: DataFrame, requests: DataFrame, nodes: DataFrame, *, width: int = GROUP_ROWS) -> DataFrame:
    """State of each requested run as of ``at_seq``; routes come from the recorded events."""
    cut = prefixes(events, requests, width=width)
    token = F.concat_ws("@", "run_id", F.col("at_seq").cast("string"))
    states = fold(cut.withColumn("run_id", token).drop("at_seq"), nodes, width=width)
    return states.withColumn("at_seq", F.regexp_extract("run_id", "@([0-9-]+)$", 1).cast("bigint")).withColumn(
        "run_id", F.regexp_replace("run_id", "@[0-9-]+$", "")
    )


def status_lines(events: DataFrame, states: DataFrame) -> DataFrame:
    """One line per run: status word, finished nodes joined by arrows, next node, short state."""
    word = F.lit(None).cast("string")
    for status, shown in STATUS_WORD.items():
        word = F.when(F.col("status") == status, shown).otherwise(word)
    arrows = F.array_sort(F.collect_list(F.struct("part", F.array_join("completed", " -> ").alias("text"))))
    done = completed_nodes(events).groupBy("run_id").agg(F.array_join(arrows["text"], " -> ").alias("completed"))
    joined = states.where("rule is null").join(done, "run_id", "left").join(merged_state(events), "run_id", "left")
    return joined.select(
        "run_id",
        word.alias("word"),
        F.coalesce(F.nullif("completed", F.lit("")), F.lit("(none)")).alias("completed"),
        "next_node",
        F.substring(F.coalesce("state", F.lit("{}")), 1, 300).alias("state"),
    )
