"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

The journal is a table in real use, so it and the span table are written once before the
clock starts (their own cost is reported as ``journal_fixture`` and ``span_projection``).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from chronofold.functions.storage import fresh_path
from chronofold.operators import effects, readback, trees
from chronofold.operators.decode import decode
from chronofold.operators.fold import fold
from chronofold.operators.projection import effect_counts, project, projection_rules
from chronofold.operators.registered import check_registered
from chronofold.operators.state import merged_state
from chronofold.plans import inputs as I


def _first_file(df) -> str:
    return sorted(df.inputFiles())[0]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chronofold-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    if "BENCH_SHARED" in os.environ:
        builder = builder.config("spark.checkpoint.dir", os.environ["BENCH_SHARED"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    journal, spans, store = (fresh_path(spark, n) for n in ("journal", "spans", "store"))
    timed("journal_fixture", lambda: I.journal(spark, folder).write.parquet(journal))
    events = spark.read.parquet(journal)
    timed("span_projection", lambda: project(events).write.parquet(spans))
    sent = spark.read.parquet(spans)
    I.damaged_store(sent).write.parquet(store)
    received, nodes = spark.read.parquet(store), I.graph_nodes(spark)

    # One pass over one file of each table first, so that the times are not those of a cold JVM.
    few, some, got = (spark.read.parquet(_first_file(df)) for df in (events, sent, received))
    for warm in (fold(few, nodes), projection_rules(few), readback.verify_readback(some, got)):
        drain(warm)

    timed("fold", lambda: drain(fold(events, nodes)))
    timed("projection_rules", lambda: drain(projection_rules(events)))
    timed("effect_counts", lambda: drain(effect_counts(sent)))
    timed("state_merge", lambda: drain(merged_state(events)))
    timed("registered_check", lambda: drain(check_registered(events)))
    timed("readback_check", lambda: drain(readback.verify_readback(sent, received)))
    timed("tree_check", lambda: drain(trees.check_trees(sent, workflow="settle/v1", node="settle")))
    timed("span_depth", lambda: drain(trees.with_depth(sent)))
    timed(
        "arm_comparison",
        lambda: drain(trees.compare_arms(sent, effect_id="settle", label="payments:settle", adapter_version="store/v1")),
    )
    timed("effect_ledger", lambda: drain(effects.effect_ledger(decode(events))))
    counted = [v for k, v in times.items() if k != "journal_fixture"]
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(counted), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
