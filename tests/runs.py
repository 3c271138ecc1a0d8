"""Random journals: mostly sound walks of a small graph, then damaged in one or two places."""

from __future__ import annotations

import json
import random

GRAPHS = {
    "g/v1": {"start": "a", "nodes": {"a": False, "b": True, "c": False}},
    "h/v1": {"start": "a", "nodes": {"a": True, "b": False}},
}
SHA = "0123456789abcdef" * 4


def nodes_frame(spark):
    rows = [(v, n, gate, "", n == g["start"]) for v, g in GRAPHS.items() for n, gate in g["nodes"].items()]
    return spark.createDataFrame(rows, "workflow_version string, name string, requires_approval boolean, description string, is_start boolean")


class Writer:
    def __init__(self, rng, run_id, seq):
        self.rng, self.run_id, self.seq, self.t, self.events = rng, run_id, seq, 1_000_000_000, []

    def add(self, type_, node, payload, act=None, att=None):
        self.seq += self.rng.choice((1, 1, 2, 5))
        self.t += self.rng.randint(0, 3_000)
        self.events.append(
            dict(seq=self.seq, run_id=self.run_id, type=type_, node=node, activation_id=act, attempt_id=att,
                 payload=json.dumps(payload, sort_keys=True, separators=(",", ":")), at=self.t / 1e9, at_ns=self.t)
        )
        return self.seq


def identity(rng, i):
    safe = rng.random() < 0.7
    return dict(effect_id=f"e{i}", index=i, label="x:y", request_fingerprint=SHA, adapter_version="s/v1",
                idempotency_key_fingerprint=SHA if safe else None, retry_safe=safe)


def sound_run(rng, run_id, seq):
    w = Writer(rng, run_id, seq)
    version = rng.choice(list(GRAPHS))
    graph = GRAPHS[version]
    node, n_act, n_att = graph["start"], 1, 0
    w.add("run_started", node, dict(input={"n": rng.randint(0, 9)}, journal_schema_version=2, workflow_version=version,
                                    start_node=node, activation_id="act1"), "act1")
    for _ in range(rng.randint(1, 4)):
        act = f"act{n_act}"
        if graph["nodes"][node]:
            w.add("awaiting_approval", node, {"state": {}}, act)
            if rng.random() < 0.15:
                return w.events
            if rng.random() < 0.15:
                w.add("approval_denied", node, {"by": "x", "at_ns": 5}, act)
                w.add("run_failed", node, {"reason": "approval denied"})
                return w.events
            w.add("approval_granted", node, {"by": "x", "at_ns": 5}, act)
        ident, intent, done, recovery = identity(rng, rng.randint(0, 2)), None, None, False
        while True:
            n_att += 1
            att = f"att{n_att}"
            w.add("attempt_started", node, {"recovery": recovery}, act, att)
            if done is not None:
                w.add("effect_resolved", node, dict(ident, source_effect_seq=done, source_intent_seq=intent, started_at_ns=w.t, ended_at_ns=w.t), act, att)
            elif rng.random() < 0.8 and (intent is None or ident["retry_safe"]):
                intent = w.add("effect_intent", node, dict(ident, started_at_ns=w.t + 1, retry_of_intent_seq=intent), act, att)
                if rng.random() < 0.8:
                    done = w.add("effect_completed", node, dict(ident, source_intent_seq=intent, started_at_ns=w.t, ended_at_ns=w.t + 9, result={"r": 1}), act, att)
            roll = rng.random()
            if roll < 0.25:
                w.add("attempt_abandoned", node, {"reason": "recovery_resume"}, act, att)
                recovery = True
                continue
            if roll < 0.32:
                w.add("attempt_failed", node, {"error": "boom"}, act, att)
                w.add("run_failed", node, {"reason": "boom"})
                return w.events
            if roll < 0.38:
                return w.events
            break
        last = rng.random() < 0.4
        target = "__end__" if last else rng.choice(list(graph["nodes"]))
        n_act += 1
        w.add("activation_finished", node, dict(patch={"n": rng.randint(0, 9), rng.choice("pq"): node}, next_node=target,
                                                next_activation_id=None if last else f"act{n_act}"), act, att)
        if last:
            w.add("run_finished", None, {"state": {}})
            return w.events
        node = target
    return w.events


FIELDS = ("effect_id", "index", "label", "request_fingerprint", "adapter_version", "idempotency_key_fingerprint", "retry_safe",
          "started_at_ns", "ended_at_ns", "source_intent_seq", "source_effect_seq", "retry_of_intent_seq", "recovery", "patch",
          "next_node", "next_activation_id", "input", "journal_schema_version", "workflow_version", "start_node", "activation_id", "error", "reason")
VALUES = (None, "", "a", "b", "zz", "unspecified", 0, -1, 1, 7, True, False, {}, [], "act1", 10**15)


def damage(rng, events):
    events = [dict(e) for e in events]
    for _ in range(rng.choice((0, 1, 1, 2))):
        i = rng.randrange(len(events))
        kind = rng.randrange(7)
        if kind == 0:
            del events[i]
        elif kind == 1:
            seqs = [e["seq"] for e in events]
            j = rng.randrange(len(events))
            events[i], events[j] = events[j], events[i]
            for e, s in zip(events, seqs):
                e["seq"] = s
        elif kind == 2:
            events[i]["type"] = rng.choice([e["type"] for e in events] + ["step_started", "attempt_started", "run_finished", "run_failed", "awaiting_approval"])
        elif kind == 3:
            c = rng.choice(("node", "activation_id", "attempt_id"))
            events[i][c] = rng.choice((None, "", "a", "b", "act1", "act2", "att1", "att2"))
        elif kind == 4:
            extra = dict(rng.choice(events))
            extra["seq"] = events[-1]["seq"] + 1
            events.append(extra)
        else:
            p = json.loads(events[i]["payload"])
            present = [f for f in FIELDS if f in p]
            if present:
                f = rng.choice(present)
                if rng.random() < 0.2:
                    del p[f]
                else:
                    seqs = [e["seq"] for e in events]
                    p[f] = rng.choice(VALUES + tuple(seqs))
                events[i]["payload"] = json.dumps(p, sort_keys=True, separators=(",", ":"))
        if not events:
            break
    return events


def many(seed, n):
    rng = random.Random(seed)
    runs, seq = {}, 0
    for i in range(n):
        events = damage(rng, sound_run(rng, f"r{i}", seq))
        if events:
            runs[f"r{i}"] = events
            seq = max(e["seq"] for e in events) + 1
    return runs
