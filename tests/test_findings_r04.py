"""What the findings of round 4 asked for."""

import random

import __spark_entry__ as entry
from pyspark.sql import functions as F

from chronofold.functions import scalar as X
from chronofold.functions.running import hot_groups
from chronofold.operators import artifacts, exports, readback, trees
from chronofold.plans import inputs

QUERIES = entry.queries()

REFERENCE = "struct<path:string,sha256:string,bytes:bigint>"
RECEIPT = (
    "lineage_id bigint, position int, declared_lineage bigint, schema_version int, inputs_sha256 string, verdict string, phase string, "
    f"criteria map<string,boolean>, has_previous boolean, previous {REFERENCE}, evidence {REFERENCE}, path string, sha256 string, bytes bigint"
)
EVIDENCE = "path string, lineage_id bigint, phase string, schema_version int, verdict string, inputs_sha256 string, criteria map<string,boolean>"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chain(lineage, more=0, **changed):
    """A sound chain of receipts and its evidence, with ``more`` receipts behind; ``changed``: values of the second receipt."""
    receipts, evidence, before = [], [], None
    for at in range(len(artifacts.PHASES) + more):
        phase = artifacts.PHASES[at % len(artifacts.PHASES)]
        criteria = {c: True for c in artifacts.PHASE_CRITERIA[phase]}
        own, proof = (f"r/{lineage}/{at}", f"h{lineage}{at}", 9), (f"e/{lineage}/{at}", "x", 1)
        row = {"lineage_id": lineage, "position": at, "declared": lineage, "schema": 1, "inputs": f"i{lineage}", "verdict": "PASS", "phase": phase}
        row |= {"criteria": criteria, "has_previous": True, "previous": before, "evidence": proof, "own": own}
        evidence.append((proof[0], lineage, phase, 1, "PASS", f"i{lineage}", criteria))
        row |= changed if at == 1 else {}
        receipts.append((*list(row.values())[:-1], *row["own"]))
        before = own
    return receipts, evidence


def audit(spark, chains, inputs):
    receipts = spark.createDataFrame([r for c in chains for r in c[0]], RECEIPT)
    evidence = spark.createDataFrame([e for c in chains for e in c[1]], EVIDENCE)
    return artifacts.audit_receipts(receipts, spark.createDataFrame(inputs, "lineage_id bigint, sha256 string"), evidence)


def test_receipts_travel_as_fingerprints(spark):
    """criteria are judged before the exchange; neither they nor texts of references are shuffled."""
    plan = executed(audit(spark, [chain(1)], [(1, "i1")]))
    assert "Generate" not in plan and "FullOuter" not in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any(word in line for line in shuffled for word in ("criterion", "criteria"))


def test_receipt_chains_of_any_length_and_repeated_rows(spark):
    names = artifacts.PHASE_CRITERIA[artifacts.PHASES[1]]
    chains = [
        chain(1), chain(2, more=1), chain(3, criteria={c: c != names[2] for c in names}), chain(4, criteria={c: True for c in names[1:]}),
        chain(5, criteria={c: True for c in (*names, "extra")}), chain(6, previous=("w", "w", 1)), chain(7, evidence=("none", "x", 1)),
        chain(8), chain(9, evidence=None), chain(10, inputs=None), chain(11, criteria=None), chain(12, criteria={c: None for c in names}),
    ]
    chains[7][1].append(chains[7][1][0])  # evidence that comes twice counts its receipt twice, as any join would
    inputs = [(n, f"i{n}") for n in range(1, 13)] + [(13, "i13"), (None, "i")]
    got = {r.lineage_id: (r.failure, r.ready) for r in audit(spark, chains, inputs).collect()}
    failures = {1: None, 2: "duplicate_phase", 3: "criteria_invalid", 4: "criteria_invalid", 5: "criteria_invalid", 6: "chain_broken", 7: "evidence_mismatch"}
    failures |= {8: "phase_policy", 9: "evidence_missing", 10: "inputs_mismatch", 11: "criteria_invalid", 12: "criteria_invalid", 13: "receipts_missing", None: "receipts_missing"}
    assert got == {k: (v, v is None) for k, v in failures.items()}


def sent_and_stored(spark):
    """Spans and store rows with every kind of difference; nulls, repeats and odd ids included."""
    spans = [
        ("r", "aware", "t1", "aa", None, "n", 1, 2, 0, 1, ("op", None)),
        ("r", "aware", "t1", "BB", "aa", "n", 1, 2, 1, 2, ("op", "external")),
        ("r", "aware", "t1", "bb", "aa", "n", 1, 2, 1, 3, ("op", "external")),
        ("r", "aware", "t1", "gone", "", "n", 1, 2, 1, 4, (None, None)),
        ("q", "control", "00ff", "0a", None, "n", 1, 2, 0, 5, ("op", None)),
        ("p", "control", None, "cc", None, "n", 1, 2, 0, 6, ("op", None)),
        ("o", "aware", "t4", None, None, "n", 1, 2, 0, 7, ("op", None)),
    ]
    spans = spark.createDataFrame(
        spans,
        "run_id string, mode string, trace_id string, span_id string, parent_span_id string, name string, start_time_ns bigint, "
        "end_time_ns bigint, family int, seq bigint, attributes struct<operation_name:string,effect_source:string>",
    )
    store = [
        ("T1", "aa", "", "n", "chronofold-aware", "op", "", 1, 1),
        ("t1", "bb", "aa", "other", "chronofold-aware", "op", "external", 1, 2),
        ("t1", "bb", "aa", "n", "chronofold-aware", "op", "external", 5, 3),
        ("t1", "more", "aa", "n", "chronofold-aware", "op", None, 1, 4),
        ("t1", "more", "aa", "n", "chronofold-aware", "op", None, 2, 5),
        ("00ff", "0a", None, "n", "chronofold-control", "op", None, 1, None),
        (None, "cc", None, "n", "x", "op", None, 1, 7),
    ]
    columns = "trace_id string, span_id string, parent_span_id string, name string, service_name string, operation_name string, effect_source string, ts_ms bigint, ingest_seq bigint"
    return spans, spark.createDataFrame(store, columns)


def test_differences_and_verdicts_of_odd_rows(spark):
    """What the full outer join gave: one row per sent span, one per key that only the store has."""
    spans, store = sent_and_stored(spark)
    rows = readback.differences(spans, store).select("trace_id", "span_id", "verdict", "copies", "attributes_equal", "got_name", "sent_parent_span_id")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        ("t1", "aa", "equal", 1, True, "n", None), ("t1", "bb", "equal", 2, True, "n", "aa"), ("t1", "bb", "equal", 2, True, "n", "aa"),
        ("t1", "gone", "missing", None, False, None, None), ("t1", "more", "unexpected", 2, False, "n", None),
        ("00ff", "0a", "mismatched", 1, False, None, None), (None, "cc", "missing", None, False, None, None),
        ("", "cc", "unexpected", 1, False, "n", None), ("t4", None, "missing", None, False, None, None),
    ], key=str)
    told = {r.trace_id: r for r in readback.verify_readback(spans, store).collect()}
    assert set(told) == {"t1", "00ff", None, "t4"}
    t1 = told["t1"]
    assert (t1.run_id, t1.spans_sent, t1.spans_retrieved, t1.missing, t1.unexpected, t1.mismatched, t1.duplicate_rows) == ("r", 4, 4, 1, 1, 0, 3)
    assert not t1.plan_sound and t1.service_verified and not told["t4"].plan_sound and told["00ff"].plan_sound
    assert told[None].missing is None and told[None].identity_verified is None and told[None].spans_sent == 1


def test_a_readback_is_shuffled_once(spark, monkeypatch):
    """F11, F12, F16: sent and stored rows share one exchange; large traces are dealt by span."""
    spans, store = sent_and_stored(spark)
    plan = executed(readback.verify_readback(spans, store))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    small = sorted(map(str, readback.verify_readback(spans, store).collect()))
    monkeypatch.setattr(readback, "hot_groups", lambda df, key: hot_groups(df, key, 2))
    assert "hashpartitioning(trace_id" in executed(readback.differences(spans, store)) and sorted(map(str, readback.verify_readback(spans, store).collect())) == small


def test_sets_of_ids_take_one_exchange(spark, sf):
    """three set operations shuffled each side three times."""
    plan = executed(QUERIES["u03_set_differences"](spark, sf))
    assert plan.count("Exchange hashpartitioning") == 1


def test_retained_rows_travel_as_hashes(spark):
    """F8: rows are told apart by a hash, a missing row and one that comes twice included."""
    spans, _ = sent_and_stored(spark)
    spans = spans.where("trace_id is not null and span_id is not null")
    kept = readback.retained_fields(spans)
    flags = [F.lit(True).alias(c) for c in ("verified", "identity_verified", "attributes_verified", "service_verified")]
    proofs = readback.query_windows(spans, F.count("*").alias("spans_sent")).select(
        "*", F.concat(F.lit("trace_id = '"), "trace_id", F.lit("'")).alias("expression"), F.col("spans_sent").alias("spans_retrieved"),
        F.lit(0).alias("duplicate_rows"), F.lit(1).alias("query_attempts"), *flags,
    )
    told = lambda rows: {r.run_id: r.broken for r in readback.verify_retained(proofs, rows, spans).collect()}
    assert told(kept) == {"r": None, "q": None}
    assert told(kept.where("span_id <> 'gone'")) == {"r": "rows_differ", "q": None}
    assert told(kept.unionByName(kept.where("run_id = 'q'"))) == {"r": None, "q": "rows_differ"}
    plan = executed(readback.verify_retained(proofs, kept, spans))
    assert not any("operation_name" in line or "service_name" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert plan.count("hashpartitioning(run_id") + plan.count("REPARTITION_BY_COL") <= 6


def test_hex_texts_as_bytes_come_back(spark):
    texts = ["", "00ff", "0", "abc", "ABCD", "zz", "trace", "é", None, "0" * 64]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.packed_hex(F.col("t")).alias("p"))
    got = {r.t: (r.p, r.back) for r in rows.withColumn("back", X.unpacked_hex(F.col("p"))).collect()}
    assert all(back == t for t, (_, back) in got.items()) and len({bytes(p) for p, _ in got.values() if p is not None}) == len(texts) - 1
    assert len(got["0" * 64][0]) == 33 and got[None] == (None, None)


def test_small_trees_are_walked_in_one_exchange(spark):
    """depths of trees of few spans need no joins, and are those the joins give."""
    rng, rows = random.Random(9), []
    for tree in range(60):
        ids = [f"{n:02x}" if n % 3 else f"Span{n}" for n in range(rng.randint(1, 14))]
        run, mode = rng.choice([f"r{tree}"] * 9 + [None]), rng.choice(["aware"] * 9 + [None])
        rows += [(run, mode, rng.choice([*ids, *ids, None]), rng.choice([*ids, *ids, None, "none"]), n) for n in range(len(ids))]
    rows += [("chain", "aware", f"c{n}", f"c{n + 1}", n) for n in range(12)]
    spans = spark.createDataFrame(rows, "run_id string, mode string, span_id string, parent_span_id string, n int")
    small = trees.with_depth(spans)
    plan = executed(small)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    told = sorted(map(str, small.collect()))
    assert len(told) == len(rows) and {r.depth for r in small.where("run_id = 'chain'").collect()} == set(range(1, 9))
    mixed = trees.with_depth(spans, 5)
    assert "Join" in executed(mixed) and sorted(map(str, mixed.collect())) == told
    assert sorted(map(str, trees._depth_by_joins(spans, 5).collect())) == told


def test_envelope_bodies_are_made_behind_the_shuffle(spark, sf):
    """rows travel instead of their documents, and ids are dealt by export once."""
    sent = spark.createDataFrame(inputs.spans(spark, sf).where("run_id < 'run-2'").limit(400).collect(), inputs.spans(spark, sf).schema)
    env = exports.envelopes(sent, sent.select("run_id").distinct().withColumn("journal_sha256", F.lit("x")))
    spark.conf.set("spark.sql.debug.maxToStringFields", 1_000)
    plan = executed(env)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "JsonEvaluator" in plan and "JsonEvaluator" not in plan[plan.index("Exchange hashpartitioning(run_id") :]
    bodies = {s.identity + r.run_id + r.mode: s.body for r in env.collect() for s in r.spans}
    docs = sent.select(F.concat("identity", "run_id", "mode").alias("k"), exports.span_document().alias("d"))
    assert bodies == {r.k: r.d for r in docs.collect()} and len(bodies) == 400
    twice = exports.envelopes(sent.unionByName(sent.limit(1)), sent.select("run_id").distinct().withColumn("journal_sha256", F.lit("x")))
    assert twice.count() == env.count() - 1
