"""Near-duplicate documents by SuperMinHash signatures.

Every shingle draws a random value and a place for each of its turns; places follow a
permutation of its own, so a document of n shingles fills n places a turn and the turns end
as soon as no later value could win. Signatures are banded; documents that share a band
are compared on their full shingle sets; confirmed links are grouped by union-find.

Equal sets are one node. Inside a bucket the nodes are first compared with four of its
nodes only, best estimates first. What the links found so far leave in different groups is
then compared with every bucket partner in another group whose signature, and whose number
of shingles that any other such document holds, allow the similarity. So a large group of
copies never needs all its pairs, and no pair that may be a link is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm import words as W
from chronofold.llm.components import components
from chronofold.llm.scratch import Scratch

REGISTERS, ROWS, BANDS = 256, 6, 42
"""A pair of similarity 0.8 shares none of 42 bands of 6 registers with probability 3e-6,
one of 0.85 with 3e-9."""

PLANES = 4
LONGS = REGISTERS // 64
BITS = PLANES * LONGS
"""Longs that hold PLANES bits of each register."""

TURN_ELEMENTS = 1 << 16


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; see ``near_duplicates``."""
    hashes, _, _, first = W.word_hashes(buf, offsets)
    powers = [np.uint64(pow(int(W.BASE), i + 1, 1 << 64)) for i in range(k)]
    n = len(hashes) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        if n > 0:
            rolled += hashes[i : i + n] * powers[i]
    rolled = W.mix(rolled + np.uint64(k))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            few = (hashes[lo:hi] * np.array(powers[: hi - lo], np.uint64)).sum(dtype=np.uint64)
            yield W.mix(np.array([few + np.uint64(hi - lo)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _draw(elements: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """A value in [turn, turn + 1) and a place to swap with, for each element."""
    bits = W.mix(elements + np.uint64((turn + 1) * int(W.BASE) % (1 << 64)))
    value = turn + (bits >> np.uint64(12)).astype(np.float64) / float(1 << 52)
    width = np.uint64(REGISTERS - turn)
    return value, turn + ((W.mix(bits) >> np.uint64(32)) * width >> np.uint64(32)).astype(np.int64)


def superminhash(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS values for each non-empty set."""
    out = np.full((len(sets), REGISTERS), np.inf)
    flat = out.ravel()
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= TURN_ELEMENTS):
            size += len(sets[hi])
            hi += 1
        _fill(flat, sets, lo, hi)
        lo = hi
    return out


def _fill(flat: np.ndarray, sets: list[np.ndarray], lo: int, hi: int) -> None:
    elements = np.concatenate(sets[lo:hi])
    owner = np.repeat(np.arange(lo, hi), [len(s) for s in sets[lo:hi]])
    value, place = _draw(elements, 0)
    np.minimum.at(flat, owner * REGISTERS + place, value)
    table, order, swapped = flat.reshape(-1, REGISTERS), None, place
    for turn in range(1, REGISTERS):
        open_ = np.zeros(len(table), bool)
        open_[lo:hi] = table[lo:hi].max(axis=1) > turn
        live = open_[owner]
        if not live.any():
            return
        if order is None:
            swapped = swapped[live]
        else:
            order = order[live] if not live.all() else order
        elements, owner = elements[live], owner[live]
        at = np.arange(len(elements))
        if order is None:  # most elements end after the first turn
            order = np.tile(np.arange(REGISTERS, dtype=np.uint8), (len(elements), 1))
            order[at, swapped] = 0
            order[:, 0] = swapped
        value, other = _draw(elements, turn)
        place = order[at, other].astype(np.int64)
        order[at, other] = order[:, turn]
        order[:, turn] = place
        np.minimum.at(flat, owner * REGISTERS + place, value)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, number of shingles, digest of the set, PLANES bits of each register, band hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = W.text_bytes(batch.column(1))
            for lo, hi in W.row_slices(offsets):
                part = offsets[lo : hi + 1]
                sets = list(shingle_sets(buf[part[0] : part[-1]], part - part[0], k))
                full = [i for i, s in enumerate(sets) if len(s)]
                regs = superminhash([sets[i] for i in full]).view(np.uint64)
                mixed = W.mix(regs)
                bits = [
                    np.packbits((mixed >> np.uint64(i) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                    for i in range(PLANES)
                ]
                bits = np.concatenate(bits, axis=1)
                bands = np.zeros((len(full), BANDS), np.uint64)
                for i in range(ROWS):
                    bands = W.mix(bands * W.BASE + regs[:, i : BANDS * ROWS : ROWS])
                bands = W.mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                row = np.full(len(sets), -1)
                row[full] = np.arange(len(full))
                empty = pa.array(row < 0)
                take = np.maximum(row, 0)
                one = np.zeros((1, BITS), np.int64), np.zeros((1, BANDS), np.int64)
                bits, bands = (x if len(x) else y for x, y in zip((bits, bands), one, strict=True))
                flat = pa.array(bands[take].ravel())
                at = pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32())
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest, pa.binary()),
                        *[pa.array(bits[take, i]) for i in range(BITS)],
                        pa.ListArray.from_arrays(at, flat),
                    ],
                    ["doc_id", "n", "digest", *[f"s{i}" for i in range(BITS)], "bands"],
                )

    longs = "".join(f", s{i} bigint" for i in range(BITS))
    return docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id bigint, n bigint, digest binary{longs}, bands array<bigint>"
    )


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = W.text_bytes(batch.column(1))
            for lo, hi in W.row_slices(offsets):
                part = offsets[lo : hi + 1]
                sets = [s.tobytes() for s in shingle_sets(buf[part[0] : part[-1]], part - part[0], k)]
                digest = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(digest, pa.binary()), pa.array(sets, pa.binary())],
                    ["node", "digest", "items"],
                )

    return docs.select("doc_id", "text").mapInArrow(make, "node bigint, digest binary, items binary")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    top, bottom = threshold.numerator, threshold.denominator

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[i] = bottom * common >= top * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    return full.mapInArrow(check, "a bigint, b bigint")


def _possible(threshold: Fraction):
    """Columns: the sizes and signatures of p and q allow the similarity; how they differ.

    Two registers agree in PLANES bits with probability J + (1 - J) / 2**PLANES. Four
    and a half standard deviations below the expected count leave out three of a million links
    that just reach the threshold, as many as the bands do.
    """
    t = float(threshold)
    agree = t + (1 - t) / (1 << PLANES)
    least = int(REGISTERS * agree - 4.5 * (REGISTERS * agree * (1 - agree)) ** 0.5)
    differ = " + ".join(
        "bit_count(" + " | ".join(f"(p.s{j * LONGS + i} ^ q.s{j * LONGS + i})" for j in range(PLANES)) + ")"
        for i in range(LONGS)
    )
    sizes = f"{threshold.denominator} * least(p.n, q.n) >= {threshold.numerator} * greatest(p.n, q.n)"
    return F.expr(f"{sizes} and {differ} <= {REGISTERS - least}"), F.expr(differ)


def _shared_items(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, common): how many items of each node's set another of the nodes holds too.

    No pair of these nodes has more items in common than the smaller of the two counts.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in parts])
            items = np.concatenate(parts or [np.zeros(0, np.int64)])
            for lo in range(0, len(items), 1 << 16):
                hi = lo + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi]), pa.array(items[lo:hi])], ["node", "item"])

    own = sets.select("node", "items").join(nodes, "node")
    rows = own.mapInArrow(spread, "node bigint, item bigint")
    lone = rows.groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    lone = lone.groupBy("node").agg(F.count("*").alias("lone"))
    sizes = own.select("node", (F.octet_length("items") / 8).cast("bigint").alias("n"))
    return sizes.join(lone, "node", "left").select("node", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"))


def near_duplicates(
    docs: DataFrame, *, k: int = 5, threshold: Fraction = Fraction(4, 5), scratch: Scratch | None = None
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; words are runs without ASCII white space; a text of fewer than
    ``k`` words is one shingle, a text without words (or null) has none and no link.
    component_id is the smallest doc_id reachable over links of at least ``threshold``.
    Repeated rows get equal results; rows that share a doc_id share its links, also those that
    another text under that doc_id has; a row whose
    doc_id is null is linked with nothing, has no component_id and is kept. An empty table
    gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    signed = scratch.keep(signatures(docs, k), "signed")
    # Signatures are on disk once: those of all rows go as soon as those of the nodes are written.
    named = scratch.keep(signed.select("doc_id", "n", "digest"), "named")
    sound = named.where("doc_id is not null and n > 0")
    nodes = sound.groupBy("digest").agg(F.min("doc_id").alias("node"))
    found = signed.join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "digest"])
    # An id of several texts ties their sets: each is named by its least id, which may be another's.
    several = sound.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    several = scratch.keep(several.where("low <> high").select("doc_id"), "several")
    tied = sound.select("doc_id", "digest").join(several, "doc_id").join(nodes, "digest").where("doc_id <> node")
    tied = tied.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    unique = scratch.keep(found.withColumnRenamed("doc_id", "node").dropDuplicates(["node", "digest"]), "nodes")
    scratch.drop(signed)

    banded = unique.select("node", F.posexplode("bands").alias("place", "band"))
    order = F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("node"))
    buckets = banded.groupBy("band").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.min(order).alias("first"), F.max(order).alias("last")
    )
    buckets = buckets.where("low < high").select("band", F.array("low", "high", "first.node", "last.node").alias("hubs"))
    # Aggregates are written, so that the joins on them are of two exchanges and a frequent band
    # or set can be split between tasks.
    buckets = scratch.keep(buckets, "hubs")
    shared = scratch.keep(banded.join(buckets, "band"), "buckets")
    facts = unique.select("node", "n", *[f"s{i}" for i in range(BITS)])
    members = shared.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    wanted = unique.join(members, "node").select(F.col("node").alias("doc_id"), "digest")
    sets = _sets(texts.join(wanted.select("doc_id").distinct(), "doc_id"), k)
    sets = scratch.keep(
        sets.join(wanted.withColumnRenamed("doc_id", "node"), ["node", "digest"]).dropDuplicates(["node", "digest"]).select("node", "items"),
        "sets",
    )

    possible, differ = _possible(threshold)
    hubs = shared.select("node", F.explode("hubs").alias("hub")).where("node <> hub").distinct()
    rated = hubs.join(facts.alias("p"), hubs.node == F.col("p.node")).join(facts.alias("q"), hubs.hub == F.col("q.node"))
    rated = rated.where(possible).select(hubs.node, "hub", differ.alias("differ"))
    best = rated.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("differ", "hub"))).where("r <= 3")
    first = best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = scratch.keep(_confirm(first, sets, threshold).unionByName(tied), "links")
    grouped = scratch.keep(components(links, scratch), "grouped")

    known = unique.select("node", "n", "bands", *[f"s{i}" for i in range(BITS)])
    known = known.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = shared.select("node", "band", "place").join(known.select("node", "component"), "node")
    mixed = held.groupBy("band").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("band")
    mixed = scratch.keep(mixed, "mixed")
    at_odds = scratch.keep(held.join(mixed, "band").select("node", "band", "place"), "mixed")
    common = _shared_items(sets, at_odds.select("node").distinct())
    places = F.expr("transform(bands, x -> cast(shiftright(x, 32) as int)) as bands")
    facing = known.select("node", "n", "component", *[f"s{i}" for i in range(BITS)], places).join(common, "node")
    open_ = scratch.keep(at_odds.join(facing, "node"), "open")
    # The last condition takes a pair at the first band it shares, not once for each band.
    within = "least(p.common, q.common)"
    allowed = f"{threshold.denominator} * {within} >= {threshold.numerator} * (p.n + q.n - {within})"
    once = F.expr("array_position(zip_with(p.bands, q.bands, (x, y) -> x = y), true) = p.place + 1")
    more = open_.alias("p").join(
        open_.alias("q"),
        F.expr(f"p.band = q.band and p.node < q.node and p.component <> q.component and {allowed}") & possible & once,
    )
    more = more.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    rest = scratch.keep(_confirm(more, sets, threshold), "links")
    stars = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(stars.unionByName(rest), scratch)

    of_set = nodes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    of_set = scratch.keep(of_set, "components")
    labelled = named.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of_set, "digest", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")))
    result = labelled.select("doc_id", "n_shingles", own.alias("component_id"))
    result = result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    result = scratch.keep(result, "result")
    scratch.drop(named, unique, shared, sets, links, grouped, at_odds, open_, rest)
    return result
