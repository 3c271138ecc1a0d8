"""What the findings of round 3 asked for: work that is not done twice."""

import json
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.llm import near_dedup
from chronofold.llm.scratch import Scratch
from chronofold.operators import admission, exports
from chronofold.operators.decode import decode
from chronofold.operators.projection import project, projection_rules
from chronofold.plans import catalog, domain, inputs, relational, scans, streams
from chronofold.schemas import JOURNAL
from chronofold.streaming import journal as journal_streams
from chronofold.streaming.runs import HANDED, RunProcessor


class Store:
    def __init__(self):
        self.calls, self.held, self.value = [], {}, None

    def getValue(self, key):
        self.calls.append("get")
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls.append("put")
        self.held[key] = value

    def clear(self):
        self.calls.append("clear")
        self.held, self.value = {}, None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def __init__(self):
        self.run, self.facts = Store(), Store()

    def getValueState(self, name, schema):
        return self.run

    def getMapState(self, name, key, value):
        return self.facts

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def event(seq, kind, attempt=None, names=None, src=None):
    return Row(
        seq=seq, type=kind, attempt_id=attempt, time_ns=seq * 10**6, time_ms=seq, e=json.dumps({"node": "n"}), names=names,
        src=src, sets=json.dumps({"b_status": kind}),
    )


EVENTS = [
    event(1, N.RUN_STARTED, names="a1"),
    event(2, N.ATTEMPT_STARTED, "t", names="tt"),
    event(3, N.EFFECT_INTENT, "t", src='{"seq":3}'),
    event(4, N.EFFECT_COMPLETED, "t", names="s3", src='{"seq":4}'),
    event(5, N.EFFECT_COMPLETED, "t", names="s3"),
    event(6, N.ACTIVATION_FINISHED, "t"),
    event(7, N.RUN_FINISHED),
]


@pytest.mark.parametrize("cuts", [[7], [3, 7], [1, 2, 3, 4, 5, 6, 7]])
def test_facts_of_a_run(cuts):
    """Facts are found within and across batches; what a batch needs again is not fetched again."""
    handle = Handle()
    processor = RunProcessor(1_000, 1_000, False)
    processor.init(handle)
    rows, low = [], 0
    for high in cuts:
        rows += processor.handleInputRows(("r",), iter(EVENTS[low:high]), None)
        low = high
    told = {r["seq"]: (r["src"], r["used"], r["seen"]) for r in rows if r["kind"] == "event"}
    assert told[3] == (None, False, False) and told[4] == ('{"seq":3}', False, False) and told[5] == ('{"seq":3}', True, True)
    assert json.loads(rows[-1]["before"] or "{}") == {} and {r["kind"] for r in rows} == {"event", "attempt", "run"}
    assert [c.split()[0] for c in HANDED.split(", ")] == rows[0].__fields__
    assert not handle.facts.held
    if cuts == [7]:  # each key asked for once, and nothing kept of a run that is over
        assert handle.facts.calls == ["get"] * 4 + ["clear"]


def written(monkeypatch, module):
    """The columns of every table the module writes on its way."""
    tables, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: tables.append(df.columns) or cut(df))
    return tables


@pytest.mark.parametrize(
    "module, name, unused",
    [
        (scans, "k08_replace_only_when_told", {"attributes", "links", "trace_id"}),
        (domain, "v15_readback_verification", {"links", "identity", "status", "end_time_ns"}),
        (domain, "v27_view_differences", {"links", "trace_id", "span_id", "name"}),
        (domain, "v28_span_depth", {"links", "attributes", "trace_id", "name"}),
        (scans, "a18_rate_intervals", {"links", "identity", "trace_id", "name", "seq"}),
        (relational, "j05_span_to_parent", {"links", "attributes", "trace_id", "name"}),
        (relational, "o05_limited_trace_rows", {"links", "identity", "status"}),
    ],
)
def test_only_what_is_read_is_written(spark, sf, monkeypatch, module, name, unused):
    tables = written(monkeypatch, module)
    assert catalog.QUERIES[name](spark, sf).count()
    assert len(tables) == 1 and not unused & set(tables[0])


def test_signatures_of_all_rows_go_early(spark, monkeypatch):
    """When sets are written, signatures are on disk for the nodes only."""
    kept, live = {}, {}

    class Watched(Scratch):
        def keep(self, df, label="table", **options):
            live[label] = set(kept)
            back = super().keep(df, label, **options)
            kept[back._scratch_path] = label
            return back

        def remove(self, path):
            kept.pop(path, None)
            super().remove(path)

    words = [f"word{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words, "more"])), (4, "other")], "doc_id bigint, text string")
    got = near_dedup.near_duplicates(docs, k=3, scratch=Watched(spark))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert not any("/signed-" in p for p in live["sets"]) and any("/nodes-" in p for p in live["sets"])


def test_starts_are_read_from_the_journal_once(spark, sf, monkeypatch):
    """The journal stands still, so its starts are made once and not once a batch."""
    read = []
    watch = lambda module: monkeypatch.setattr(module, "recorded_starts", lambda df: read.append(1) or admission.recorded_starts(df))
    watch(streams)
    assert catalog.QUERIES["t08_coalesced_starts"](spark, sf).count() == 1500
    assert read == [1]


def test_starts_of_a_growing_journal_are_read_anew(spark, tmp_path):
    """Without prepared starts each batch sees what the journal holds at that moment."""
    for n, run in enumerate(("a", "b")):
        row = spark.createDataFrame([(run, "{}", "n", "w")], "run_id string, input string, start_node string, workflow_version string")
        row.withColumn("time", F.timestamp_micros(F.lit(1 + n))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held, got = [], {}

    def journal():
        return spark.createDataFrame(held, "run_id string, seq bigint, type string, payload string")

    def sink(judged, n):
        got.update({r.run_id: r.verdict for r in judged.collect()})
        held.extend((run, 1, N.RUN_FINISHED, "{}") for run in ("a", "b"))

    journal_streams.coalesce_starts(stream, journal, sink, checkpoint=f"{tmp_path}/check").awaitTermination()
    assert sorted(got.values()) == ["new", "no_run_started"]


def test_methods_of_the_fold_are_short_enough_to_be_compiled(spark, sf):
    """The JVM interprets generated methods of more than 8,000 bytes, for every event."""
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        text = getattr(debug, "MODULE$").codegenString(inputs.states(spark, sf)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_failures_are_shown_as_before(spark):
    """Each kind of failing event has its own text; others have none."""
    told = [
        (N.ATTEMPT_FAILED, '{"error":"e","reason":"r"}', "e"),
        (N.ATTEMPT_FAILED, '{"error":null}', "None"),
        (N.ATTEMPT_FAILED, '{"reason":"r"}', "attempt failed"),
        (N.ATTEMPT_FAILED, "no json", "attempt failed"),
        (N.RUN_FAILED, '{"error":"e","reason":true}', "True"),
        (N.RUN_FAILED, '{"error":"e"}', None),
        (N.APPROVAL_DENIED, '{"error":"e","reason":"r"}', "approval denied"),
        (N.RUN_FINISHED, '{"error":"e","reason":"r"}', None),
        (None, '{"error":"e","reason":"r"}', None),
    ]
    rows = [(n, "r", kind, None, None, None, payload, 1.0, 1) for n, (kind, payload, _) in enumerate(told)]
    found = {r["seq"]: r["failure"] for r in decode(spark.createDataFrame(rows, JOURNAL)).collect()}
    assert found == {n: text for n, (_, _, text) in enumerate(told)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_take_two_sorts(spark, sf):
    """One by sequence and one by the fact an event names; the ends of attempts take none."""
    assert len(re.findall(r"[ +]- Sort \[", plan(project(inputs.journal(spark, sf))))) == 2


@pytest.mark.parametrize("odd", [{"at_ns": None, "at": None}, {"seq": None}])
def test_spans_of_odd_journals(spark, sf, odd):
    """An event without time or number takes the journal through the general form."""
    events = inputs.journal(spark, sf).where("run_id in ('run-1', 'run-13', 'run-6')")
    lost = F.col("run_id").eqNullSafe("run-13") & (F.col("type") == N.ATTEMPT_ABANDONED)
    events = events.withColumns({c: F.when(lost, F.lit(v)).otherwise(F.col(c)) for c, v in odd.items()})
    show = lambda df: sorted(map(str, df.collect()))
    assert show(project(events)) == show(project(events, width=3))
    assert show(projection_rules(events)) == show(projection_rules(events, width=3))


@pytest.mark.parametrize("width", [1 << 20, 3])
def test_spans_of_some_runs(spark, sf, width):
    events = inputs.journal(spark, sf)
    some = events.where("seq % 3 = 0").select("run_id").distinct()
    show = lambda df: sorted(map(str, df.select("run_id", "mode", "span_id").collect()))
    assert show(project(events, width=width, runs=some)) == show(project(events).join(some, "run_id", "left_semi"))


def test_retained_order_is_written_before_it_is_cut(spark, sf, monkeypatch):
    tables = written(monkeypatch, relational)
    assert catalog.QUERIES["o04_retained_order"](spark, sf).count()
    assert len(tables) == 1 and {"trace_id", "span_id"} < set(tables[0]) and not {"run_id", "mode", "service_name"} & set(tables[0])


def test_trees_are_made_of_what_is_read(spark, sf, monkeypatch):
    tables = written(monkeypatch, domain)
    assert catalog.QUERIES["v13_span_tree_check"](spark, sf).count()
    assert len(tables) == 1 and not {"status", "seq"} & set(tables[0])


def test_documents_project_likely_runs_only(spark, sf, monkeypatch):
    tables = written(monkeypatch, domain)
    domain.built(spark, sf)
    assert [("payload" in t, "provider_attempts" in t) for t in tables] == [(False, True), (False, False)]


def test_span_lines_do_not_parse_attributes(spark, sf):
    lines = inputs.spans(spark, sf).select(exports.span_document())
    assert "parse_json" not in plan(lines) and json.loads(lines.first()[0])["attributes"]
