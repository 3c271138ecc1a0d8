"""Pieces on small inputs, with group sizes forced low so every large-group path runs."""

import json
import random
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from chronofold.functions import scalar as X
from chronofold.functions import joins, stats
from chronofold.functions.joins import lookup_join, skew_join
from chronofold.functions.running import HotGroups, group_values, hot_groups, ordinal, running_values
from chronofold.functions.storage import write_json
from chronofold.operators import artifacts, documents, effects, exports, readback, trees
from chronofold.plans import inputs as I
from chronofold.schemas import JOURNAL
from chronofold.sources import journal as J


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(900):
        at += rng.randint(1, 4)
        key = "big" if rng.random() < 0.4 else f"k{rng.randint(0, 60)}"
        rows.append((key, at, rng.choice((None, None, rng.randint(0, 99)))))
    return spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5), rows


def expected_running(rows):
    out, state = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        last, n, top = state.get(k, (None, 0, None))
        out[k, o] = (last, n, top)
        state[k] = (v if v is not None else last, n + 1, o)
    return out


@pytest.mark.parametrize("width", [1 << 20, 50, 2])
def test_running_values(skewed, width):
    df, rows = skewed
    hot = hot_groups(df, ["k"], width)
    assert (hot.keys is None) == (width > 1000)
    got = running_values(df, ["k"], "o", hot=hot, last={"last": F.col("v")}, total={"n": F.lit(1)}, peak={"top": F.col("o")})
    assert {(r.k, r.o): (r["last"], r.n, r.top) for r in got.collect()} == expected_running(rows)


def test_running_values_when_nothing_is_counted(skewed):
    """More large groups than the list may hold: every group is treated as large."""
    df, rows = skewed
    hot = HotGroups(("k",), 7, df.select("k").distinct(), bounded=False)
    got = running_values(df, ["k"], "o", hot=hot, last={"last": F.col("v")}, total={"n": F.lit(1)}, peak={"top": F.col("o")})
    assert {(r.k, r.o): (r["last"], r.n, r.top) for r in got.collect()} == expected_running(rows)


@pytest.mark.parametrize("width", [1 << 20, 20])
def test_group_values_and_joins(skewed, width):
    df, rows = skewed
    hot = hot_groups(df, ["k"], width)
    got = group_values(df, ["k"], "o", {"n": F.count("*"), "top": F.max("o")}, hot=hot).collect()
    for r in got:
        same = [o for k, o, _ in rows if k == r.k]
        assert (r.n, r.top) == (len(same), max(same))
    right = df.select("k").distinct().withColumn("tag", F.concat(F.lit("t-"), "k"))
    joined = skew_join(df, right, ["k"], hot=hot)
    assert joined.count() == len(rows) and joined.where("tag <> concat('t-', k) or tag is null").count() == 0
    for limit in (1000, 3):
        assert lookup_join(df, right, ["k"], limit=limit).where("tag = concat('t-', k)").count() == len(rows)


def test_parts_keep_every_row(skewed):
    df, rows = skewed
    hot = hot_groups(df, ["k"], 10)
    parts = exports.in_parts(df, ["k"], "o", F.col("o"), "items", hot=hot, part_rows=16).collect()
    assert max(len(p["items"]) for p in parts) <= 16
    for key in {r[0] for r in rows}:
        mine = sorted((p for p in parts if p.k == key), key=lambda p: p.part)
        assert [o for p in mine for o in p["items"]] == sorted(o for k, o, _ in rows if k == key)


def test_digest_does_not_depend_on_the_large_group_path(spark, sf):
    events = I.journal(spark, sf)
    one = {r.run_id: r.journal_sha256 for r in exports.journal_digests(events).collect()}
    two = {r.run_id: r.journal_sha256 for r in exports.journal_digests(events, width=2).collect()}
    assert one == two and len(one) == 1500


def test_digest_of_a_run_does_not_depend_on_other_runs(spark):
    def events(run, n):
        return [(run, i, "t", None, None, None, "{}", i) for i in range(n)]

    schema = "run_id string, seq bigint, type string, node string, activation_id string, attempt_id string, payload string, at_ns bigint"
    for width in (4, 1 << 20):
        alone = exports.journal_digests(spark.createDataFrame(events("small", 5), schema), width=width, part_rows=2)
        both = exports.journal_digests(spark.createDataFrame(events("small", 5) + events("long", 41), schema), width=width, part_rows=2)
        got = {r.run_id: r.journal_sha256 for r in both.collect()}
        assert both.count() == 2 and got["small"] == alone.first().journal_sha256


def tree(spark, edges):
    rows = [("r", "aware", s, p, 0, 10) for s, p in edges]
    return spark.createDataFrame(rows, "run_id string, mode string, span_id string, parent_span_id string, start_time_ns bigint, end_time_ns bigint")


@pytest.mark.parametrize("width", [1 << 20, 2])
def test_depths(spark, width):
    chain = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 40)]
    loop = [("x", "y"), ("y", "x"), ("z", "x")]
    lost = [("l", "nowhere"), ("m", "l")]
    fan = [(f"f{i}", "n3") for i in range(20)]
    spans = tree(spark, chain + loop + lost + fan)
    depth = {r.span_id: r.depth for r in trees.with_depth(spans, width).collect()}
    assert [depth[f"n{i}"] for i in range(12)] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8]
    assert (depth["x"], depth["y"], depth["z"], depth["l"], depth["m"], depth["f0"]) == (2, 2, 2, 1, 2, 4)


def test_schema_gate(spark, sf):
    with pytest.raises(J.JournalSchemaError, match="activation_id, at_ns"):
        J.require_columns(I.journal(spark, sf).drop("activation_id", "at_ns"))


def test_prefix_filters_reach_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "j")
    I.journal(spark, sf).write.parquet(path)
    rows = J.run_events(J.read_journal(spark, path), "run-13", 13 * 32 + 6)
    assert [r.seq - 13 * 32 for r in rows.collect()] == [2, 4, 6]
    plan = rows._jdf.queryExecution().toString()
    assert "EqualTo(run_id,run-13)" in plan and "LessThanOrEqual(seq,422)" in plan


def test_bucketed_journal_folds_without_exchange(spark, sf):
    from chronofold.operators.fold import fold

    spark.sql("drop table if exists journal_b")
    J.save_bucketed(I.journal(spark, sf), "journal_b", 4)
    plan = fold(spark.table("journal_b"), I.graph_nodes(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run_id") == 0
    spark.sql("drop table journal_b")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_exchange_per_run_operator(spark, sf, tmp_path):
    from chronofold.operators.fold import fold
    from chronofold.operators.projection import project

    path = str(tmp_path / "j")
    I.journal(spark, sf).write.parquet(path)
    events = J.read_journal(spark, path)
    assert exchanges(project(events)) == 1
    folded = fold(events, spark.createDataFrame(I.graph_nodes(spark).collect(), I.graph_nodes(spark).schema))
    by_run = folded._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(run_id")
    assert by_run == 1


def test_limited_scan_drops_rows_before_the_exchange(spark, sf):
    sent = spark.createDataFrame(
        I.spans(spark, sf).where("family = 0").limit(50).collect(), I.spans(spark, sf).schema
    )
    store = I.damaged_store(sent)
    plan = readback.scan_traces(store, readback.query_windows(sent), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    few = readback.scan_traces(store, readback.query_windows(sent), 5).count()
    assert few == readback.scan_traces(store, readback.query_windows(sent), 5000).count()


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1}}', '{"a":1} x', "1,2", "1] [2", '1,"v":2', "", "[1]", "null", '1} {"v":2']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strict_json(F.col("t")).isNotNull().alias("ok"))
    good = {r.t for r in rows.collect() if r.ok}
    assert good == {'{"a":1}', "[1]", "null"}


def test_duration_label_follows_the_binary_value(spark):
    cases = {0: "0 ns", 999: "999 ns", 1000: "1.0 µs", 1250: "1.3 µs", 10450: "10.4 µs", 10050: "10.1 µs", 999_999: "1000.0 µs", 1_500_000: "1.5 ms", 86_400_000_000_000: "86400.00 s", 1_005_000_000: "1.00 s", 1_125_000_000: "1.13 s"}
    # 1005/1000 as a double lies below the half, 10050/1000 above it.
    rows = spark.createDataFrame([(n,) for n in cases], "n bigint").select("n", X.duration_label(F.col("n")).alias("l"))
    assert {r.n: r.l for r in rows.collect()} == cases


def test_hex_and_zero_digest(spark):
    row = spark.range(1).select(
        X.trace_hex(F.lit("18446744073709551617")).alias("t"), X.span_hex(F.lit(255)).alias("s"), X.span_hex(F.lit(None).cast("bigint")).alias("n")
    ).first()
    assert row.t == "0" * 15 + "1" + "0" * 15 + "1" and row.s == "0" * 14 + "ff" and row.n is None


def test_quantiles_equal_sorting(spark):
    rng = random.Random(3)
    data = [("a", rng.gauss(0, 5)) for _ in range(400)] + [("b", 7.0)] * 30 + [("c", float(rng.randint(0, 3))) for _ in range(99)]
    probabilities = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = stats.exact_quantiles(spark.createDataFrame(data, "g string, v double"), "g", "v", probabilities).collect()
    for r in got:
        values = sorted(v for g, v in data if g == r.g)
        for i, p in enumerate(probabilities):
            at = p * (len(values) - 1)
            low = int(at)
            want = values[low] if low == at else values[low] * (1 - (at - low)) + values[low + 1] * (at - low)
            assert r[f"q{i}"] == pytest.approx(want, abs=1e-9)


def bootstrap(values, resamples=10_000):
    from statistics import NormalDist

    rng, normal = random.Random(1), NormalDist()
    estimate = fmean(values)
    means = sorted(fmean(rng.choices(values, k=len(values))) for _ in range(resamples))
    share = (sum(m < estimate for m in means) + 0.5 * sum(m == estimate for m in means)) / resamples
    bias = normal.inv_cdf(share)
    left = [(sum(values) - v) / (len(values) - 1) for v in values]
    gaps = [fmean(left) - v for v in left]
    acc = sum(g**3 for g in gaps) / (6 * sum(g * g for g in gaps) ** 1.5)
    pick = lambda t: means[round(normal.cdf(bias + (bias + normal.inv_cdf(t)) / (1 - acc * (bias + normal.inv_cdf(t)))) * (resamples - 1))]
    return pick(0.025), pick(0.975)


def test_rate_and_mean_intervals(spark):
    data = [("a", i, 1.0 if i % 5 == 0 else 0.0) for i in range(60)] + [("b", i, 1.0) for i in range(9)] + [("one", 0, 0.0)]
    seen = spark.createDataFrame(data, "group_key string, place bigint, value double")
    want = bootstrap([v for g, _, v in data if g == "a"])
    for table in (stats.rate_intervals(seen), stats.mean_intervals(seen, resamples=2000)):
        got = {r.group_key: r for r in table.collect()}
        assert got["a"].low == pytest.approx(want[0], abs=0.025) and got["a"].high == pytest.approx(want[1], abs=0.025)
        assert got["b"].degenerate and got["b"].low == got["b"].high == 1.0
        assert got["one"].degenerate and not got["a"].degenerate


def test_histogram_quantile(spark):
    stats.register_sql_functions(spark)
    value = lambda counts, q: spark.sql(f"select histogram_quantile(array(1D, 2D, 4D), array({counts}), {q}D) as v").first().v
    assert value("0D, 4D, 0D, 0D", 0.5) == 1.5
    assert value("1D, 1D, 2D, 0D", 1.0) == 4.0
    assert value("0D, 0D, 0D, 3D", 0.9) == 4.0
    assert value("0D, 0D, 0D, 0D", 0.9) is None


def test_write_refuses_to_replace(spark, tmp_path):
    path = str(tmp_path / "out")
    write_json(spark.range(3), path)
    with pytest.raises(Exception, match="already exists"):
        write_json(spark.range(5), path)
    write_json(spark.range(5), path, replace=True)
    assert spark.read.json(path).count() == 5


def test_artifacts_from_a_folder(spark, tmp_path):
    for name, text in {"src/a.py": "x", "README.md": "hi", "web/node_modules/b.js": "n", "pyproject.toml": "p", "web/x-debug.log": "d"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    refs = artifacts.artifact_references(artifacts.read_files(spark, str(tmp_path))).collect()
    assert {(r.group, r.path, r.bytes) for r in refs} == {("source", "src/a.py", 1), ("publication", "README.md", 2), ("configuration", "pyproject.toml", 1)}


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "run.json").write_text(json.dumps({"schemaVersion": 2, "runId": "r1"}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    parsed = {r.path.rsplit("/", 1)[1]: r for r in documents.parse_documents(documents.read_documents(spark, str(tmp_path))).collect()}
    assert parsed["run.json"].readable and parsed["run.json"].d.runId == "r1" and not parsed["b.json"].readable
    issues = documents.document_issues(documents.read_documents(spark, str(tmp_path))).collect()
    assert {i.code for i in issues if i.path.endswith("b.json")} <= {"not_json"} or issues


def test_bad_trace_queries_are_refused():
    for args in (("x" * 32, 0, 1, 1), ("a" * 32, 5, 5, 1), ("a" * 32, 0, 1, 0), ("a" * 32, 0, 1, 10_001)):
        with pytest.raises(ValueError):
            readback.check_query(*args)


def test_duplicate_completions_of_one_activation(spark):
    def event(seq, type_, effect, index, **extra):
        p = dict(effect_id=effect, index=index, label="l", request_fingerprint="f", adapter_version="v", idempotency_key_fingerprint="k", retry_safe=True, started_at_ns=1, **extra)
        return (seq, "r", type_, "n", "act", "att", json.dumps(p), 0.0, seq)

    rows = [
        event(1, "effect_intent", "e", 0), event(2, "effect_completed", "e", 0, source_intent_seq=1, ended_at_ns=2),
        event(3, "effect_intent", "e", 1), event(4, "effect_completed", "e", 1, source_intent_seq=3, ended_at_ns=2),
    ]
    from chronofold.operators.decode import decode

    found = effects.duplicate_completions(decode(spark.createDataFrame(rows, JOURNAL))).collect()
    assert [r.identity for r in found] == ["id e"]


def test_call_index_and_default_id(spark):
    calls = spark.createDataFrame(
        [("r", "a", "t", n, "l", '{"b":1, "a":2}', "v/1", None if n else "named", None, False) for n in range(3)],
        "run_id string, activation_id string, attempt_id string, call_order bigint, label string, request string, adapter_version string, effect_id string, idempotency_key string, retry_safe boolean",
    )
    got = effects.call_requests(calls).orderBy("index").collect()
    assert [(r["index"], r.effect_id) for r in got] == [(0, "named"), (1, "call-1"), (2, "call-2")]
    assert len({r.request_fingerprint for r in got}) == 1 and got[0].idempotency_key_fingerprint is None


def test_ordinal_starts_at_zero(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "k string, o bigint")
    got = ordinal(rows, ["k"], "o", hot=hot_groups(rows, ["k"], 1)).collect()
    assert {(r.k, r.o): r.ordinal for r in got} == {("a", 5): 0, ("a", 9): 1, ("b", 1): 0}


def test_null_keys_are_split_like_others(spark):
    rows = [(None if i % 3 else "a", i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, at bigint, v double")
    whole = hot_groups(df, ["g"])
    split = hot_groups(df, ["g"], 4)
    assert whole.keys is None and {r.g for r in split.keys.collect()} == {None, "a"}
    assert split.only(df).count() == 40 and split.mark(df, "at").select("g", "_segment").distinct().count() > 10
    run = lambda hot: sorted(running_values(df, ["g"], "at", hot=hot, last={"b": F.col("v")}, total={"t": F.col("v")}).collect(), key=lambda r: r["at"])
    assert run(whole) == run(split)


def test_wide_lookup_tables_are_not_broadcast(spark, monkeypatch):
    left = spark.range(50).withColumn("k", F.col("id") % 5)
    right = spark.range(5).select(F.col("id").alias("k"), F.array_repeat(F.lit("x" * 50), 20).alias("many"))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1_000)
    wide = joins.lookup_join(left, right, ["k"])
    assert "ResolvedHint" not in wide._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1 << 20)
    assert joins.lookup_join(left, right, ["k"]).orderBy("id").collect() == wide.orderBy("id").select("k", "id", "many").collect()


def test_each_trace_has_its_own_row_limit(spark):
    store = spark.range(1_500).select(
        F.when(F.col("id") < 1_400, "A" * 32).otherwise("b" * 32).alias("trace_id"), F.hex("id").alias("span_id"),
        F.lit(5).alias("ts_ms"), F.col("id").alias("ingest_seq"),
    )
    windows = spark.createDataFrame([("a" * 32, 0, 9, 1_200), ("b" * 32, 0, 9, 50)], "trace_id string, start_ms bigint, end_ms bigint, row_limit bigint")
    got = readback.scan_traces(store, windows).groupBy("trace_id").agg(F.count("*").alias("n"), F.max("ingest_seq").alias("top"))
    assert {r.trace_id[0]: (r.n, r.top) for r in got.collect()} == {"a": (1_200, 1_199), "b": (50, 1_449)}
