"""The window forms of both rule sets against sequential readings of the same rules."""

import json

import pytest
from runs import GRAPHS, many, nodes_frame
from sequential import fold as sequential_fold
from sequential import projection_rule

from chronofold.operators.fold import fold
from chronofold.operators.projection import project, projection_rules
from chronofold.operators.state import merged_state
from chronofold.schemas import JOURNAL


def frame(spark, runs):
    rows = [tuple(e[c] for c in JOURNAL.fieldNames()) for events in runs.values() for e in events]
    return spark.createDataFrame(rows, JOURNAL).repartition(4)


@pytest.fixture(scope="module")
def runs():
    return many(11, 3_000)


@pytest.mark.parametrize("width", [1 << 20, 3])
def test_fold_equals_sequential(spark, runs, width):
    """``width`` 3 makes most runs large groups, cut in segments of three sequence numbers."""
    got = {r.run_id: r for r in fold(frame(spark, runs), nodes_frame(spark), width=width).collect()}
    assert set(got) == set(runs)
    seen = set()
    for run_id, events in runs.items():
        want, row = sequential_fold(events, GRAPHS), got[run_id]
        if isinstance(want, tuple):
            seen.add(want[0])
            assert (row.rule, row.rule_seq) == want, (run_id, events)
            continue
        assert row.rule is None, (run_id, row)
        assert (row.status, row.next_node, row.activation_id) == (want["status"], want["node"], want["act"])
        assert (row.open_attempt_id, row.approval_granted) == (want["attempt"], want["granted"])
        assert row.failure_reason == want["reason"] and row.n_completed == len(want["completed"])
        assert row.n_events == len(events)
    assert {"E03", "E04", "E11", "E12", "E13", "E16", "E17", "E18", "E21", "E22", "E25", "E30", "E32"} <= seen


def test_state_merge_equals_sequential(spark, runs):
    merged = {r.run_id: json.loads(r.state) for r in merged_state(frame(spark, runs)).collect()}
    for run_id, events in runs.items():
        want = sequential_fold(events, GRAPHS)
        if not isinstance(want, tuple):
            assert merged.get(run_id, {}) == want["values"]


@pytest.mark.parametrize("width", [1 << 20, 3])
def test_projection_rules_equal_sequential(spark, runs, width):
    got = {r.run_id: (r.rule, r.rule_seq) for r in projection_rules(frame(spark, runs), width=width).collect()}
    seen = set()
    for run_id, events in runs.items():
        want = projection_rule(events) or (None, None)
        seen.add(want[0])
        assert got[run_id] == want, (run_id, events)
    assert {"P03", "P04", "P05", "P06", "P07", "P08", "P10", "P11", "P13", "P14", "P15"} <= seen


def test_spans_do_not_depend_on_width(spark, runs):
    events = frame(spark, runs)
    show = lambda df: sorted(map(str, df.drop("attributes").collect()))
    assert show(project(events)) == show(project(events, width=3))


def base(spark):
    return [
        ("run_started", "a", "act1", None, dict(input={}, journal_schema_version=2, workflow_version="g/v1", start_node="a", activation_id="act1")),
        ("attempt_started", "a", "act1", "att1", dict(recovery=False)),
        ("effect_intent", "a", "act1", "att1", dict(IDENT, started_at_ns=1, retry_of_intent_seq=None)),
        ("effect_completed", "a", "act1", "att1", dict(IDENT, source_intent_seq=3, started_at_ns=1, ended_at_ns=2, result=None)),
        ("activation_finished", "a", "act1", "att1", dict(patch={}, next_node="__end__", next_activation_id=None)),
        ("run_finished", None, None, None, dict(state={})),
    ]


IDENT = dict(effect_id="e", index=0, label="l", request_fingerprint="f", adapter_version="v", idempotency_key_fingerprint="k", retry_safe=True)
# (rule, index of the event to change, payload field, value) or a column to change
ONE_RULE = [
    ("E04", 0, "journal_schema_version", 1),
    ("E05", 0, "workflow_version", ""),
    ("E06", 0, "workflow_version", "other"),
    ("E07", 0, "input", []),
    ("E08", 0, "start_node", ""),
    ("E09", 0, "start_node", "b"),
    ("E18", 2, "index", True),
    ("E18", 2, "label", 5),
    ("E18", 2, "adapter_version", "unspecified"),
    ("E18", 2, "idempotency_key_fingerprint", None),
    ("E18", 2, "retry_safe", 1),
    ("E19", 2, "started_at_ns", 0),
    ("E20", 2, "retry_of_intent_seq", "3"),
    ("E20", 2, "retry_of_intent_seq", 3),
    ("E21", 3, "source_intent_seq", True),
    ("E21", 3, "ended_at_ns", 0),
    ("E25", 4, "patch", [1]),
    ("E25", 4, "next_node", ""),
    ("E26", 4, "next_node", "nowhere"),
    ("E27", 4, "next_node", "b"),
    (None, 2, "retry_of_intent_seq", None),
]


def test_one_negative_per_rule(spark):
    rows = []
    for n, (_rule, at, field, value) in enumerate(ONE_RULE):
        for i, (t, node, act, att, p) in enumerate(base(spark)):
            p = dict(p, **{field: value}) if i == at else p
            rows.append((i + 1, f"r{n}", t, node, act, att, json.dumps(p, sort_keys=True), 0.0, 100 + i))
    got = {r.run_id: r.rule for r in fold(spark.createDataFrame(rows, JOURNAL), nodes_frame(spark)).collect()}
    assert [got[f"r{n}"] for n in range(len(ONE_RULE))] == [r[0] for r in ONE_RULE]


def test_start_must_be_the_graph_start(spark):
    events = base(spark)
    t, _, act, att, p = events[0]
    events[0] = (t, "b", act, att, dict(p, start_node="b"))
    rows = [(i + 1, "r", t, node, act, att, json.dumps(p), 0.0, 100 + i) for i, (t, node, act, att, p) in enumerate(events)]
    assert fold(spark.createDataFrame(rows, JOURNAL), nodes_frame(spark)).first().rule == "E10"


def test_duplicate_sequence_and_negative_time(spark):
    rows = []
    for i, (t, node, act, att, p) in enumerate(base(spark)):
        rows.append((1 if i == 1 else i + 1, "dup", t, node, act, att, json.dumps(p), 0.0, 100 + i))
        rows.append((i + 1, "back", t, node, act, att, json.dumps(p), 0.0, 100 - 10 * i))
    got = {r.run_id: r.rule for r in projection_rules(spark.createDataFrame(rows, JOURNAL)).collect()}
    assert got == {"dup": "P02", "back": "P16"}
