"""Runs followed event by event: one keyed state per run, rules as events come.

The processor only carries values: what earlier events of the run left behind, the facts
later events may name, and which attempt and run are still open. It hands each event on
with the state before it, so the rules are the same column expressions the batch fold and
the batch projection use. It also hands on what becomes known later: an attempt or a run
with its end, an attempt that stayed open too long, and an event that came too late.

State: one small value per run, and one map entry per fact that an event may name. The
entries go when the run ends or falls silent; the value stays a while, so that an event
behind the end is still seen as one, and goes when its timer fires.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronofold import names as N
from chronofold.names import DEFAULT_NAMING, SpanNaming
from chronofold.operators import fold as E
from chronofold.operators import lookups as L
from chronofold.operators import projection as P
from chronofold.operators.decode import decode

EVENT, LATE, ATTEMPT, RUN, OPEN, ENDED = "event", "late", "attempt", "run", "open", "ended"
"""Kinds of rows: an event with the state before it; one not above the last sequence seen;
an attempt or a run with its end; an attempt open longer than the limit; state removed."""

SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
"""Timers and maps of keyed state need this store; set it before the stream starts."""


BEFORE = (
    "b_open struct<id: string, node: string, act: string>, b_at struct<node: string, act: string>, "
    "b_status string, b_granted boolean, b_version string, b_failure string, b_terminal boolean, b_seq bigint"
)
"""The state before an event, as the rules name it."""


HANDED = (
    "kind string, run_id string, seq bigint, type string, e string, before string, src string, "
    "used boolean, seen boolean, end_type string, end_ns bigint"
)
"""What the processor hands on: events, states and facts stay the JSON they are, since taking
them apart a row at a time costs more than the rules; ``follow_runs`` makes columns of them."""


class RunProcessor(StatefulProcessor):
    """State of one run. ``limit_ms``: how long an attempt may stay open before it is reported.
    ``idle_ms``: how long a run may be silent before its state goes."""

    def __init__(self, limit_ms: int, idle_ms: int, processing_time: bool) -> None:
        self.limit_ms, self.idle_ms, self.processing_time = limit_ms, idle_ms, processing_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text = T.StructType([T.StructField("value", T.StringType())])
        self.run = handle.getValueState("run", text)
        self.facts = handle.getMapState("facts", text, text)

    def _row(self, kind: str, run_id: str, e: dict | Row, before: str | None = None, **more) -> Row:
        last = {"src": None, "used": None, "seen": None, "end_type": None, "end_ns": None} | more
        return Row(kind=kind, run_id=run_id, seq=e["seq"], type=e["type"], e=e["e"], before=before, **last)

    def _fact(self, facts: dict[str, dict], key: str) -> dict:
        """What is known under a key; ``facts`` holds what this batch read or changed."""
        if key not in facts:
            found = self.facts.getValue((key,))
            facts[key] = json.loads(found[0]) if found else {}
        return facts[key]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.run.get()
        state = json.loads(held[0]) if held else {"set": {}, "begin": None, "attempts": {}, "closed": False, "timers": []}
        newest = timerValues.getCurrentProcessingTimeInMs() if self.processing_time else 0
        facts, changed = {}, set()
        for r in sorted(rows, key=lambda r: r["seq"]):
            last = state["set"].get("b_seq")
            if last is not None and r["seq"] <= last:
                yield self._row(LATE, key[0], r)
                continue
            fact, name = {}, r["names"]
            if name is not None:
                fact = self._fact(facts, name)
                done = fact.get("used") or r["type"] == N.EFFECT_COMPLETED
                facts[name] = {"src": fact.get("src"), "seen": True, "used": done}
                changed.add(name)
            used, seen = bool(fact.get("used")), bool(fact.get("seen"))
            yield self._row(EVENT, key[0], r, before=json.dumps(state["set"]), src=fact.get("src"), used=used, seen=seen)
            if r["src"] is not None:
                own = f"s{r['seq']}"
                facts[own] = self._fact(facts, own) | {"src": r["src"]}
                changed.add(own)
            state["set"] |= json.loads(r["sets"]) | {"b_seq": r["seq"]}
            yield from self._follow(state, key[0], r)
            newest = newest if self.processing_time else max(newest, r["time_ms"])
        if state["closed"]:
            self.facts.clear()
        else:
            for name in changed:
                self.facts.updateValue((name,), (json.dumps(facts[name]),))
        self._wait(state, newest)
        self.run.update((json.dumps(state),))

    def _follow(self, state: dict, run_id: str, r: Row) -> Iterator[Row]:
        """Keep the open run and attempt; hand them on when they end."""
        own = {"seq": r["seq"], "type": r["type"], "e": r["e"], "ms": r["time_ms"], "last_ns": r["time_ns"]}
        opened = state["attempts"].get(r["attempt_id"] or "")
        if opened:
            opened["last_ns"] = r["time_ns"]
        if state["begin"] is None:
            state["begin"] = own
        state["begin"]["last_ns"] = r["time_ns"]
        if r["type"] == N.ATTEMPT_STARTED:
            state["attempts"][r["attempt_id"] or ""] = own
        elif r["type"] in N.ATTEMPT_END_TYPES and opened:
            del state["attempts"][r["attempt_id"] or ""]
            yield self._row(ATTEMPT, run_id, opened, end_type=r["type"], end_ns=r["time_ns"])
        elif r["type"] in (N.RUN_FINISHED, N.RUN_FAILED) and not state["closed"]:
            state["closed"] = True
            yield self._row(RUN, run_id, state["begin"], end_type=r["type"], end_ns=r["time_ns"])

    def _wait(self, state: dict, newest: int) -> None:
        """One timer for the end of the silence, one for the attempt that is open longest."""
        if newest:
            state["idle"] = newest + self.idle_ms
        wanted = {state["idle"]} if state.get("idle") else set()
        limits = [self._limit(a, newest) for a in state["attempts"].values() if not a.get("told")]
        wanted |= {min(limits)} if limits else set()
        for old in set(state["timers"]) - wanted:
            self.handle.deleteTimer(old)
        for new in wanted - set(state["timers"]):
            self.handle.registerTimer(new)
        state["timers"] = sorted(wanted)

    def _limit(self, attempt: dict, now: int) -> int:
        if self.processing_time:  # counted from when the start was seen
            attempt["ms"] = attempt["ms"] if attempt.get("seen") else now
            attempt["seen"] = True
        return attempt["ms"] + self.limit_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.run.get()
        if not held:
            return
        state, now = json.loads(held[0]), expiredTimerInfo.getExpiryTimeInMs()
        state["timers"] = [t for t in state["timers"] if t != now]
        for opened in state["attempts"].values():
            if not opened.get("told") and self._limit(opened, now) <= now:
                opened["told"] = True
                yield self._row(OPEN, key[0], opened)
        if now < state["idle"]:
            self._wait(state, 0)
            self.run.update((json.dumps(state),))
            return
        if not state["closed"]:
            for opened in state["attempts"].values():
                yield self._row(ATTEMPT, key[0], opened, end_ns=opened["last_ns"])
            yield self._row(RUN, key[0], state["begin"], end_ns=state["begin"]["last_ns"])
        for timer in state["timers"]:
            self.handle.deleteTimer(timer)
        self.facts.clear()
        self.run.clear()
        yield self._row(ENDED, key[0], state["begin"])

    def close(self) -> None:
        pass


def _setters() -> dict:
    opened = F.struct(F.col("attempt_id").alias("id"), F.col("node").alias("node"), F.col("activation_id").alias("act"))
    kind = F.col("type")
    nothing = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("id", "node", "act")])
    own = {
        "b_open": F.when(kind == N.ATTEMPT_STARTED, opened).when(kind.isin(*N.ATTEMPT_END_TYPES), nothing),
        "b_terminal": F.when(kind.isin(N.RUN_FINISHED, N.RUN_FAILED), True),
    }
    return E.state_setters() | own


def follow_runs(
    events: DataFrame,
    *,
    watermark: str = "10 minutes",
    limit_ms: int = 3_600_000,
    idle_ms: int = 3_600_000,
    processing_time: bool = False,
) -> DataFrame:
    """Events of a stream with the state before them, and what becomes known of runs, as they go on.

    Events of a run are taken in order of sequence within a batch; one whose sequence is
    not above the last one seen is ``late``, whether it repeats an event or was delayed.
    Timers run on event time and Spark itself drops rows behind the watermark; with
    ``processing_time`` they run on the clock, no row is dropped, and the query has to be
    stopped, since it goes on after the last row for the sake of its timers. An attempt open for
    ``limit_ms`` is reported once; a run without events for ``idle_ms`` loses its state, and
    its open attempt and run are handed on without an end type.
    """
    rows = decode(events)
    shape = rows.schema
    source = F.struct(*L.SOURCE_FIELDS)
    keyed = rows.select(
        "run_id",
        "seq",
        "type",
        "attempt_id",
        "time_ns",
        F.expr("time_ns div 1000000").alias("time_ms"),
        F.timestamp_micros(F.expr("time_ns div 1000")).alias("event_time"),
        F.to_json(F.struct(*rows.columns)).alias("e"),
        L.named_key().alias("names"),
        F.when(F.col("type").isin(N.EFFECT_INTENT, N.EFFECT_COMPLETED), F.to_json(source)).alias("src"),
        F.to_json(F.struct(*[c.alias(n) for n, c in _setters().items()])).alias("sets"),
    ).withWatermark("event_time", watermark)
    plain = [f for f in shape.fields if f.name not in ("run_id", "seq", "type")]
    before = T.StructType.fromDDL(BEFORE)
    sources = T.StructType([f for c in L.SOURCE_FIELDS for f in shape.fields if f.name == c])
    processor = RunProcessor(limit_ms, idle_ms, processing_time)
    time_mode = "processingTime" if processing_time else "eventTime"
    handed = keyed.groupBy("run_id").transformWithState(processor, HANDED, "Append", time_mode)
    own = T.StructType([T.StructField(f.name, f.dataType) for f in plain])
    parsed = handed.withColumns({"e": F.from_json("e", own), "before": F.from_json("before", before), "src": F.from_json("src", sources)})
    return parsed.select("kind", "run_id", "seq", "type", "e.*", "before.*", "src", "used", "seen", "end_type", "end_ns")


def event_states(followed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each event with the rule it breaks, if the events before it were sound, and the state after it."""
    setters = E.state_setters()
    after = {n.replace("b_", "a_", 1): F.coalesce(c, F.col(f"{n}.id" if n == "b_open" else n)) for n, c in setters.items() if n != "b_open"}
    opened = F.when(setters["b_open"].isNotNull(), setters["b_open"]["id"]).otherwise(F.col("b_open.id"))
    rows = followed.where(F.col("kind") == EVENT).withColumns(after | {"a_open": opened})
    rows = E._with_graph(rows.withColumns({"names": F.lit(True), "key": L.named_key()}), nodes)
    status = F.coalesce("a_status", F.lit("running"))
    return rows.select(
        "run_id",
        "seq",
        "type",
        F.least(E.pack(E._state_rule()), E.pack(E._lookup_rule())).alias("packed"),
        F.struct(
            F.col("a_version").alias("workflow_version"),
            status.alias("status"),
            F.col("a_at.node").alias("next_node"),
            F.nullif(F.col("a_at.act"), F.lit("")).alias("activation_id"),
            F.col("a_open").alias("open_attempt_id"),
            F.coalesce("a_granted", F.lit(False)).alias("approval_granted"),
            F.when(status == "failed", F.col("a_failure")).alias("failure_reason"),
        ).alias("state"),
    )


def latest_states(states: DataFrame) -> DataFrame:
    """The state or first broken rule of every run, as ``fold`` gives it, of the events so far."""
    runs = states.groupBy("run_id").agg(
        F.min("packed").alias("packed"),
        F.max_by("state", "seq").alias("final"),
        F.count_if(F.col("type") == N.ACTIVATION_FINISHED).alias("n_completed"),
        F.count("*").alias("n_events"),
    )
    ok = F.col("packed").isNull()
    return runs.select(
        "run_id",
        E.rule_name("E").alias("rule"),
        F.expr(f"packed div {E.RULE_SLOTS}").alias("rule_seq"),
        *[F.when(ok, F.col(f"final.{c}")).alias(c) for c in E.STATE_COLUMNS],
        F.when(ok, F.col("n_completed")).alias("n_completed"),
        "n_events",
    )


def spans_and_breaks(followed: DataFrame, naming: SpanNaming = DEFAULT_NAMING) -> DataFrame:
    """Spans as soon as their facts are complete, each once, and broken rules (``broken``).

    Whether a run is sound shows only with its last event; ``sound_spans`` takes the spans
    of the others away.
    """
    effect = F.col("type").isin(N.EFFECT_COMPLETED, N.EFFECT_RESOLVED)
    owner = F.col("kind").isin(ATTEMPT, RUN) | ((F.col("kind") == EVENT) & effect)
    starts = F.col("type").isin(N.RUN_STARTED, N.ATTEMPT_STARTED)
    ends = {
        "attempt_end_type": F.when(F.col("kind") == ATTEMPT, F.col("end_type")),
        "attempt_end": F.when(F.col("kind") == ATTEMPT, F.col("end_ns")),
        "run_terminal": F.when(F.col("kind") == RUN, F.col("end_type")),
        "run_end": F.when(F.col("kind") == RUN, F.col("end_ns")),
    }
    backwards = F.col("kind").isin(ATTEMPT, RUN) & (F.col("end_ns") < F.col("time_ns"))
    rows = followed.withColumns({"names": F.lit(True), "key": L.named_key()})
    broken = F.when(F.col("kind") == EVENT, F.least(E.pack(P._state_rule()), E.pack(P._lookup_rule())))
    rows = rows.withColumn("broken", F.coalesce(broken, F.when(backwards, F.lit(P.FAR * E.RULE_SLOTS + 16)))).withColumns(ends)
    spans = P.span_rows(rows.where(owner & (starts | effect)), N.MODES, naming)
    fails = rows.where("broken is not null").select("run_id", "broken")
    return spans.withColumn("broken", F.lit(None).cast("bigint")).unionByName(fails, allowMissingColumns=True)


def sound_spans(found: DataFrame) -> DataFrame:
    """The spans of runs with an attempt and without a broken rule, from what the stream wrote."""
    sound = found.groupBy("run_id").agg(F.min("broken").alias("first"), F.max(F.col("family") == 1).alias("attempts"))
    sound = sound.where("first is null and attempts").select("run_id")
    return found.where("broken is null").drop("broken").join(sound, "run_id", "left_semi")


def prepare(spark: SparkSession) -> None:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


class ReadbackProcessor(StatefulProcessor):
    """One sent span and the answers of its read-back tries, up to a deadline and a number of tries."""

    def __init__(self, deadline_ms: int, most: int) -> None:
        self.deadline_ms, self.most = deadline_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("span", T.StructType([T.StructField("value", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        state = json.loads(held[0]) if held else {"sent": None, "name": None, "tries": 0, "done": False, "early": [], "timer": None}
        for r in rows:
            if r["sent"]:
                if state["sent"] is None:
                    state["sent"], state["name"] = r["time_ms"], r["name"]
            elif not state["done"]:
                state["early"].append([r["time_ms"], r["name"]])
        if state["sent"] is not None and not state["done"]:
            answers, state["early"] = sorted(state["early"], key=lambda a: (a[0], a[1] or "")), []
            for time, name in answers:
                if not state["sent"] <= time <= state["sent"] + self.deadline_ms:
                    continue
                state["tries"] += 1
                if name is not None and name == state["name"]:
                    yield self._done(state, key, True, "found")
                elif state["tries"] == self.most:
                    yield self._done(state, key, False, "tries")
                if state["done"]:
                    break
        first = state["sent"] if state["sent"] is not None else min(a[0] for a in state["early"])
        timer = first + self.deadline_ms
        if timer != state["timer"]:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            self.handle.registerTimer(timer)
            state["timer"] = timer
        self.state.update((json.dumps(state),))

    def _done(self, state: dict, key, verified: bool, reason: str) -> Row:
        state["done"] = True
        return Row(trace_id=key[0], span_id=key[1], verified=verified, reason=reason, tries=state["tries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held:
            state = json.loads(held[0])
            if state["sent"] is not None and not state["done"]:
                yield self._done(state, key, False, "deadline")
            self.state.clear()

    def close(self) -> None:
        pass


def readback(sent: DataFrame, answers: DataFrame, *, watermark: str = "10 minutes", deadline_ms: int = 30_000, most: int = 30) -> DataFrame:
    """trace_id, span_id, verified, reason, tries: what became of each sent span, once.

    ``sent``: trace_id, span_id, name, time. ``answers``: the same columns, one row per try
    that asked for the span, with a null name where it was not there. A span is verified by
    the first answer with its name within ``deadline_ms``; it fails at try ``most`` or at the
    deadline, whichever is first. Ids of answers are compared in lower case. An answer that
    comes before its span waits for it until its own deadline.
    """
    columns = ["trace_id", "span_id", "name", "time"]
    small = [F.lower(c).alias(c) if c.endswith("_id") else F.col(c) for c in columns]
    both = sent.select(*columns, F.lit(True).alias("sent")).unionByName(answers.select(*small, F.lit(False).alias("sent")))
    both = both.withColumn("time_ms", F.unix_millis("time")).withWatermark("time", watermark)
    return both.groupBy("trace_id", "span_id").transformWithState(
        ReadbackProcessor(deadline_ms, most), "trace_id string, span_id string, verified boolean, reason string, tries int", "Append", "eventTime"
    )
