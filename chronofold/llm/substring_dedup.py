"""Repeated byte strings across documents by prefix-free parsing.

Triggers of a rolling hash cut every text into phrases: a position is a trigger when the
hash of its ``PROBE`` bytes is the least among ``REACH`` neighbours to the right of some
start, so a trigger depends on nearby bytes only, equal strings have equal triggers, and
no phrase is longer than ``REACH`` starts. A phrase is the run of string starts whose first
trigger is the same. Two strings of ``length`` bytes are equal only if they stand at the
same distance from their triggers and the triggers' right contexts agree.

The dictionary is the set of phrases with their right context. Phrases whose trigger
context occurs once hold no repeat. Equal dictionary entries repeat as a whole, however
often, and need no look at their bytes. Only where different entries share a trigger
context is one entry of each kind cut into blocks of starts, which are judged in the same
way by what all their strings have in common and by all they cover, and the few blocks
left open start by start. The order of
suffixes is needed to the depth of ``length`` bytes and only up to equality, so suffixes
and the parse behind them are named by 128-bit fingerprints and brought together by these
names in a distributed aggregation instead of one suffix array: a frequent phrase would
otherwise bring all its contexts into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import words as W
from chronofold.llm.scratch import Scratch

PROBE, REACH = 16, 300
BLOCK = 16
"""Starts of a block; blocks are counted from the trigger, so equal strings share theirs."""

SHAPE = 512
STARTS = 4 << 20
"""String starts handled at a time; a longer text is parsed in parts, with the same result."""

OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
"""A second multiplier, for fingerprints that must not fail together with the first."""


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def parse(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Phrases of a run of texts: text, first start in it, shape, trigger and context names.

    The shape is the distance from the first start to the trigger times SHAPE, and the starts.
    """
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not starts.any():
        return none, none, none, none, none
    sums = W.prefix(buf, W.PLAIN)
    n = len(buf) - PROBE + 1
    probes = W.mix((sums[PROBE:] - sums[:-PROBE]) * W.powers(len(buf), W.INVERSE)[:n])
    place = np.uint64(24)
    probes = (probes >> place << place) | np.arange(n, dtype=np.uint64)
    least = window_minima(probes, REACH)
    at = W.ragged(offsets[:-1], starts)
    trigger = (least[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), starts)
    new = np.ones(len(at), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(at)))
    lo, anchor, text = at[first], trigger[first], text[first]
    near = W.range_hash(sums, anchor, anchor + length - REACH + 1)
    other = W.prefix(buf, W.PLAIN, OTHER)
    whole = W.range_hash(other, lo, lo + many - 1 + length, OTHER)
    whole = W.mix(whole + (anchor - lo).astype(np.uint64) * np.uint64(1 << 20) + many.astype(np.uint64))
    return text, lo - offsets[text], (anchor - lo) * SHAPE + many, near.view(np.int64), whole.view(np.int64)


def blocks(buf: np.ndarray, first: np.ndarray, shape: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Blocks of at most ``width`` starts of some phrases, in one text.

    For each: its phrase, first start, shape, the name of what the strings of all starts
    at these distances have in common, and the name of all that its own strings cover.
    """
    many, ahead = shape % SHAPE, shape // SHAPE
    at = W.ragged(first, many)
    phrase = np.repeat(np.arange(len(first)), many)
    far = ahead[phrase] - (at - first[phrase])
    block = far // width
    new = np.ones(len(at), bool)
    new[1:] = (phrase[1:] != phrase[:-1]) | (block[1:] != block[:-1])
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(at)))
    start, far, block = at[lead], far[lead], block[lead]
    low = start + far - width * block
    near = W.range_hash(W.prefix(buf, W.PLAIN), low, low - (width - 1) + length)
    near = W.mix(near + block.astype(np.uint64))
    whole = W.range_hash(W.prefix(buf, W.PLAIN, OTHER), start, start + n - 1 + length, OTHER)
    whole = W.mix(whole + (far * SHAPE + n).astype(np.uint64))
    return phrase[lead], start, far * SHAPE + n, near.view(np.int64), whole.view(np.int64)


def _parsed(docs: DataFrame, length: int, id_type: str) -> DataFrame:
    """One row per text: its number, id, size, digest, packed bytes and phrases."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            buf, offsets = W.text_bytes(batch.column(1))
            for lo, hi in W.row_slices(offsets):
                part = offsets[lo : hi + 1]
                piece, at = buf[part[0] : part[-1]], part - part[0]
                if len(piece) <= STARTS + length:
                    found = [parse(piece, at, length)]
                else:  # one long text, a run of starts at a time
                    found = []
                    for a in range(0, len(piece) - length + 1, STARTS):
                        t, s, *rest = parse(view := piece[a : a + STARTS + length - 1], np.array([0, len(view)]), length)
                        found.append((t, s + a, *rest))
                text, first, shape, near, whole = (np.concatenate(c) for c in zip(*found, strict=True))
                cuts = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32())
                raw = memoryview(piece)
                views = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(hi - lo)),
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(v).hexdigest() for v in views]),
                        pa.array([packer.compress(v) for v in views], pa.binary()),
                        pa.ListArray.from_arrays(cuts, pa.array(first)),
                        pa.ListArray.from_arrays(cuts, pa.array(shape, pa.int32())),
                        pa.ListArray.from_arrays(cuts, pa.array(near)),
                        pa.ListArray.from_arrays(cuts, pa.array(whole)),
                    ],
                    ["number", "doc_id", "n_bytes", "digest", "packed", "first", "shape", "near", "whole"],
                )
                number += hi - lo

    return docs.select("doc_id", "text").mapInArrow(
        rows,
        f"number bigint, doc_id {id_type}, n_bytes bigint, digest string, packed binary, first array<bigint>, "
        "shape array<int>, near array<bigint>, whole array<bigint>",
    )


def _unpack(raw: pa.Scalar, size: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_buffer(), max_output_size=max(size, 1)), np.uint8)


def _blocks(texts: DataFrame, length: int, width: int) -> DataFrame:
    """(number, first, shape, near, whole, own) for the blocks of each text's asked phrases."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                buf = _unpack(batch.column(2)[i], batch.column(1)[i].as_py())
                asked = batch.column(3)[i].values
                first, shape = asked.field("first").to_numpy(), asked.field("shape").to_numpy().astype(np.int64)
                own = asked.field("own").to_numpy(zero_copy_only=False)
                for x, y in _runs(first):
                    base = int(first[x])
                    part = buf[base : int(first[y - 1]) + REACH + length]
                    phrase, start, kind, near, whole = blocks(part, first[x:y] - base, shape[x:y], length, width)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(start), batch.column(0)[i].as_py())), pa.array(start + base),
                            pa.array(kind, pa.int32()), pa.array(near), pa.array(whole), pa.array(own[x:y][phrase]),
                        ],
                        ["number", "first", "shape", "near", "whole", "own"],
                    )

    return texts.select("number", "n_bytes", "packed", "asked").mapInArrow(
        rows, "number bigint, first bigint, shape int, near bigint, whole bigint, own boolean"
    )


def _runs(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of ascending starts that span about STARTS bytes at most."""
    x = 0
    while x < len(first):
        y = int(np.searchsorted(first, first[x] + STARTS, "left"))
        yield x, y
        x = y


def _judge(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(number, first, shape, gone, ask, own) of the rows that are repeats or stay open.

    ``gone``: all strings of the row repeat. ``ask``: the row is the one of its kind to be
    looked at in detail; ``own`` says that its own strings are still open.
    """
    contexts = rows.groupBy("near").agg(
        F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"), F.max("own").alias("open")
    )
    # Aggregates are written, so that each join below is one of two exchanges and a frequent
    # name can be split between tasks.
    contexts = contexts.where("n > 1 and open").select("near", (F.col("low") != F.col("high")).alias("mixed"))
    contexts = scratch.keep(contexts, "contexts")
    repeated = scratch.keep(rows.join(contexts, "near"), "repeated")
    mixed = repeated.where("mixed")
    alike = mixed.groupBy("near", "whole").agg(F.count("*").alias("n"), F.min(F.struct("number", "first")).alias("one"))
    alike = scratch.keep(alike, "alike")
    shown = (F.col("one.number") == F.col("number")) & (F.col("one.first") == F.col("first"))
    alone = F.col("n") == 1
    mixed = mixed.join(alike, ["near", "whole"]).select(
        "number", "first", "shape", (F.col("own") & ~alone).alias("gone"), shown.alias("ask"), (F.col("own") & alone).alias("own")
    )
    no = F.lit(False)
    whole = repeated.where("not mixed and own").select("number", "first", "shape", F.lit(True).alias("gone"), no.alias("ask"), no.alias("own"))
    return whole.unionByName(mixed.where("gone or ask"))


def _cut_out(marked: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            for i in range(batch.num_rows):
                size = batch.column(1)[i].as_py()
                buf = _unpack(batch.column(2)[i], size)
                runs = batch.column(3)[i].values
                first, many = runs.field("first").to_numpy(), runs.field("shape").to_numpy().astype(np.int64) % SHAPE
                step = np.zeros(size + 1, np.int64)
                np.add.at(step, first, 1)
                np.add.at(step, first + many - 1 + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                out[0].append(int(gone.sum()))
                out[1].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                out[2].append(hashlib.sha256(buf[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                ["number", "n_removed", "n_spans", "kept_sha256"],
            )

    return marked.select("number", "n_bytes", "packed", "runs").mapInArrow(
        rows, "number bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, *, length: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when a string of ``length`` bytes that covers it also starts anywhere else,
    in the same text or another, as the texts were given. Texts are UTF-8 bytes; null is
    empty; a text shorter than ``length`` stays whole. Repeated rows are repeats of each
    other, so all of their bytes go if they are long enough; null ids are ordinary. An
    empty table gives no rows; other columns are not read.
    """
    if length < REACH + PROBE:
        raise ValueError(f"length must be at least {REACH + PROBE}")
    scratch = scratch or Scratch(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = scratch.keep(_parsed(docs, length, id_type), "texts")
    phrases = texts.select("number", F.inline(F.arrays_zip("first", "shape", "near", "whole")))
    judged = _judge(phrases.withColumn("own", F.lit(True)), scratch)
    each = F.struct("first", "shape", "gone", "ask", "own")
    judged = judged.groupBy("number").agg(F.array_sort(F.collect_list(each)).alias("judged"))
    # From here on only texts that hold a repeat or may hold one.
    facts = scratch.keep(texts.select("number", "doc_id", "n_bytes", "digest"), "facts")
    held = scratch.keep(texts.select("number", "n_bytes", "packed").join(judged, "number"), "held")
    scratch.drop(texts)

    asked = held.select("number", "n_bytes", "packed", F.filter("judged", lambda x: x["ask"]).alias("asked"))
    found = scratch.keep(_judge(_blocks(asked.where("size(asked) > 0"), length, BLOCK), scratch), "blocks")
    open_ = found.where("ask").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("first", "shape", "own"))).alias("asked"))
    starts = scratch.keep(_blocks(held.drop("judged").join(open_, "number"), length, 1), "starts")
    twice = starts.groupBy("near", "whole").agg(F.count("*").alias("n")).where("n > 1").select("near", "whole")
    twice = scratch.keep(twice, "twice")
    single = starts.where("own").join(twice, ["near", "whole"]).select("number", "first", "shape")

    runs = found.where("gone").select("number", "first", "shape").unionByName(single)
    runs = runs.groupBy("number").agg(F.collect_list(F.struct("first", "shape")).alias("more"))
    whole = F.transform(F.filter("judged", lambda x: x["gone"]), lambda x: F.struct(x["first"].alias("first"), x["shape"].alias("shape")))
    marked = held.join(runs, "number", "left").withColumn("runs", F.when(F.col("more").isNull(), whole).otherwise(F.concat(whole, "more")))
    cut = _cut_out(marked.where("size(runs) > 0"), length)
    facts = facts.join(cut, "number", "left")
    zero = F.lit(0).cast("bigint")
    result = facts.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
    )
    result = scratch.keep(result, "result")
    return result
