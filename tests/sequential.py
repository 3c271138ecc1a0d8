"""Plain sequential readings of the journal rules, one event at a time, for checks only."""

from __future__ import annotations

import json

END = "__end__"
IDENTITY = ("effect_id", "index", "label", "request_fingerprint", "adapter_version", "idempotency_key_fingerprint", "retry_safe")
EFFECTS = ("effect_intent", "effect_completed", "effect_resolved")
CLOSERS = {"attempt_abandoned": 23, "attempt_failed": 24, "activation_finished": 25}


class Broken(Exception):
    def __init__(self, rule, seq):
        self.rule, self.seq = rule, seq


def is_text(v):
    return isinstance(v, str) and v != ""


def is_int(v):
    return isinstance(v, int) and not isinstance(v, bool)


def identity_ok(p, strict):
    good = (
        is_text(p.get("effect_id"))
        and is_int(p.get("index"))
        and p["index"] >= 0
        and is_text(p.get("label"))
        and is_text(p.get("request_fingerprint"))
        and is_text(p.get("adapter_version"))
        and (p.get("idempotency_key_fingerprint") is None or is_text(p["idempotency_key_fingerprint"]))
        and isinstance(p.get("retry_safe"), bool)
    )
    if good and strict:
        good = p["adapter_version"] != "unspecified" and not (
            p["retry_safe"] and p.get("idempotency_key_fingerprint") is None
        )
    return good


def same(a, b):
    return (a["node"], a["activation_id"]) == (b["node"], b["activation_id"]) and all(
        a["p"].get(f) == b["p"].get(f) for f in IDENTITY
    )


def times_ok(p):
    s, e = p.get("started_at_ns"), p.get("ended_at_ns")
    return is_int(s) and is_int(e) and s >= 1 and e >= s


def fold(events, graphs):
    """``(rule, seq)`` or the final state as a dict. ``events`` are in order, one run."""
    events = [{**e, "p": json.loads(e["payload"])} for e in events]
    try:
        return _fold(events, graphs)
    except Broken as b:
        return (f"E{b.rule:02d}", b.seq)


def _fold(events, graphs):
    first = events[0]
    p, seq = first["p"], first["seq"]

    def need(ok, rule, at=None):
        if not ok:
            raise Broken(rule, seq if at is None else at)

    need(first["type"] == "run_started", 3)
    need(p.get("journal_schema_version") == 2 and is_int(p["journal_schema_version"]), 4)
    need(is_text(p.get("workflow_version")), 5)
    need(p["workflow_version"] in graphs, 6)
    graph = graphs[p["workflow_version"]]
    need(isinstance(p.get("input"), dict), 7)
    need(is_text(p.get("start_node")) and is_text(p.get("activation_id")), 8)
    need(first["node"] == p["start_node"] and first["activation_id"] == p["activation_id"], 9)
    need(p["start_node"] == graph["start"] and p["start_node"] in graph["nodes"], 10)
    st = dict(status="running", node=p["start_node"], act=p["activation_id"], attempt=None, granted=False, reason=None)
    values, completed, used_ids = dict(p["input"]), [], {p["activation_id"]}
    intents, completions, done, over = {}, {}, set(), False
    for e in events[1:]:
        p, seq, t = e["p"], e["seq"], e["type"]
        here = (e["node"], e["activation_id"]) == (st["node"], st["act"])
        active = st["status"] == "running" and st["attempt"] is not None
        need(not over, 11)
        if t == "attempt_started":
            need(st["status"] == "running" and st["attempt"] is None, 12)
            need(here and st["node"] in graph["nodes"], 13)
            need(not graph["nodes"][st["node"]] or st["granted"], 14)
            need(is_text(e["attempt_id"]), 15)
            st["attempt"] = e["attempt_id"]
        elif t in EFFECTS:
            need(active, 16)
            need(here and e["attempt_id"] == st["attempt"], 17)
            need(identity_ok(p, True), 18)
            if t == "effect_intent":
                need(is_int(p.get("started_at_ns")) and p["started_at_ns"] >= 1, 19)
                r = p.get("retry_of_intent_seq")
                if r is not None:
                    need(is_int(r) and r in intents and r not in done and same(intents[r], e) and p["retry_safe"], 20)
                intents[seq] = e
            elif t == "effect_completed":
                r = p.get("source_intent_seq")
                need(is_int(r) and r in intents and r not in done, 21)
                need(same(intents[r], e) and intents[r]["attempt_id"] == e["attempt_id"] and times_ok(p), 21)
                done.add(r)
                completions[seq] = e
            else:
                r = p.get("source_effect_seq")
                need(is_int(r) and r in completions and same(completions[r], e), 22)
                need(completions[r]["p"].get("source_intent_seq") == p.get("source_intent_seq") and times_ok(p), 22)
        elif t in CLOSERS:
            rule = CLOSERS[t]
            need(active and here and e["attempt_id"] == st["attempt"], rule)
            st["attempt"] = None
            if t == "attempt_failed":
                st.update(status="failed", reason=str(p.get("error", "attempt failed")))
            elif t == "activation_finished":
                need(isinstance(p.get("patch"), dict) and is_text(p.get("next_node")), 25)
                values.update(p["patch"])
                completed.append(st["node"])
                st["granted"] = False
                if p["next_node"] == END:
                    st.update(node=END, act="")
                else:
                    need(p["next_node"] in graph["nodes"], 26)
                    need(is_text(p.get("next_activation_id")) and p["next_activation_id"] not in used_ids, 27)
                    used_ids.add(p["next_activation_id"])
                    st.update(node=p["next_node"], act=p["next_activation_id"])
        elif t == "awaiting_approval":
            gate = graph["nodes"].get(st["node"], False)
            need(st["status"] == "running" and st["attempt"] is None and not st["granted"] and gate and here, 28)
            st["status"] = "awaiting_approval"
        elif t in ("approval_granted", "approval_denied"):
            need(st["status"] == "awaiting_approval" and here, 29)
            if t == "approval_granted":
                st.update(status="running", granted=True)
            else:
                st.update(status="failed", reason="approval denied")
        elif t == "run_finished":
            need(st["status"] == "running" and st["attempt"] is None and st["node"] == END, 30)
            st["status"], over = "finished", True
        elif t == "run_failed":
            need(st["status"] == "failed" and st["attempt"] is None, 31)
            st["reason"], over = str(p.get("reason", st["reason"])), True
        else:
            need(False, 32)
    return dict(st, act=st["act"] or None, completed=completed, values=values)


def projection_rule(events):
    """First projection rule a run breaks as ``(rule, seq)``, or None."""
    events = [{**e, "p": json.loads(e["payload"])} for e in events]
    try:
        _project(events)
    except Broken as b:
        return (f"P{b.rule:02d}", b.seq)
    return None


def _project(events):
    first = events[0]
    if any(a["seq"] >= b["seq"] for a, b in zip(events, events[1:])):
        raise Broken(2, None)
    p = first["p"]
    if first["type"] != "run_started" or p.get("journal_schema_version") != 2 or not is_text(p.get("workflow_version")):
        raise Broken(3, first["seq"])
    opened, attempts, intents, completions, done, over = None, {}, {}, {}, set(), False
    last_of = {}
    for e in events[1:]:
        p, seq, t = e["p"], e["seq"], e["type"]
        scoped = all(is_text(e[c]) for c in ("node", "activation_id", "attempt_id"))

        def need(ok, rule):
            if not ok:
                raise Broken(rule, seq)

        need(not over, 4)
        if t == "attempt_started":
            need(opened is None, 5)
            need(scoped and e["attempt_id"] not in attempts and isinstance(p.get("recovery"), bool), 6)
            attempts[e["attempt_id"]] = e
            opened = e
            last_of[e["attempt_id"]] = e
        elif t in EFFECTS or t in CLOSERS:
            need(scoped and opened is not None, 7)
            need(all(e[c] == opened[c] for c in ("node", "activation_id", "attempt_id")), 7)
            last_of[e["attempt_id"]] = e
            if t in EFFECTS:
                need(identity_ok(p, False), 8)
            if t == "effect_intent":
                need(is_int(p.get("started_at_ns")) and p["started_at_ns"] >= 1, 8)
                r = p.get("retry_of_intent_seq")
                if r is not None:
                    need(is_int(r) and r in intents and same(intents[r], e), 9)
                intents[seq] = e
            elif t == "effect_completed":
                r = p.get("source_intent_seq")
                need(is_int(r) and r in intents and same(intents[r], e), 10)
                need(intents[r]["attempt_id"] == e["attempt_id"] and r not in done and times_ok(p), 10)
                done.add(r)
                completions[seq] = e
            elif t == "effect_resolved":
                r = p.get("source_effect_seq")
                need(is_int(r) and r in completions and same(completions[r], e) and is_int(p.get("source_intent_seq")), 11)
                need(completions[r]["p"]["source_intent_seq"] == p["source_intent_seq"] and times_ok(p), 11)
            else:
                opened = None
        elif t in ("awaiting_approval", "approval_granted", "approval_denied"):
            need(opened is None, 12)
        elif t in ("run_finished", "run_failed"):
            need(opened is None, 13)
            over = True
        else:
            need(False, 14)
    if not attempts:
        raise Broken(15, None)
    for a, e in attempts.items():
        if last_of[a]["at_ns"] < e["at_ns"]:
            raise Broken(16, None)
    if events[-1]["at_ns"] < first["at_ns"]:
        raise Broken(16, None)
