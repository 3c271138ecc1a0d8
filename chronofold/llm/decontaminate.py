"""Benchmark decontamination by rare word-pair seeds and Smith-Waterman alignment.

A seed is a pair of neighbouring item words that a document has side by side or with one word
between. An alignment of score ``least`` or more needs a number of seeds that follows from
the length of its item (see ``item_seeds``). So the pairs that stand in most documents can be left
out as far as the others must still hold a part of that number, without loss. The rare ones are
joined with those of the documents, counted for each item and stretch of a document, and the
stretches with enough of them are aligned with the whole item. The best local alignments say
how much of the item each passage holds, edited words and gaps included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm import words as W
from chronofold.llm.scratch import Scratch

MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
"""Share of the highest possible alignment score from which a passage is a copy."""

LEAST_WORDS = 3
"""Items of fewer words are no evidence of a copy unless they stand whole."""

LEFT_OUT = 0.5
"""Share of the seeds an alignment needs that may be among the frequent ones left out."""

LIST_ITEMS = 512
"""Items of one row of a text when they are aligned; a text with more has more rows."""

PAIR, SINGLE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8865B)
FEWEST_BITS, MOST_BITS = 15, 27
"""Bounds of the bitmap that tasks test keys with: 4 KiB to 16 MiB."""


def plain_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, letter case and ASCII marks aside, and each text's first word."""
    hashes, _, _, first = W.word_hashes(buf, offsets, W.FOLDED, between=W.MARKS)
    return hashes, first


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return W.mix(left * PAIR + right).view(np.int64)


def single_keys(hashes: np.ndarray) -> np.ndarray:
    return W.mix(hashes ^ SINGLE).view(np.int64)


def alignment_bounds(length: int, least: float) -> tuple[int, int, int, int]:
    """Of an item with that many words: score a copy has, words it spans at most, need and unit.

    Between two matches that are ``i`` words apart in the item and ``d`` in the document lie
    at least max(i, d) - 1 errors, so the second match adds at most 3 - max(i, d): 2 for
    neighbours on both sides, 1 for neighbours of the item with one word between in the
    document, otherwise no more than half a point for each step along the item. Summed over
    an item of n words, a score T takes 3 * (pairs of the first kind) + (pairs of the second)
    of at least 2T - n - 3. Where that is no more than 0 every word is a seed of its own, and
    half of T must match. ``unit`` is the most that one place of the item adds to the sum.
    """
    if length < LEAST_WORDS:
        least = 1.0
    score = max(1, int(np.ceil(least * MATCH * length - 1e-9)))
    span = length + max(0, MATCH * length - score)
    need = 2 * score - length - 3
    return (score, span, need, 3) if need > 0 else (score, span, -(-score // MATCH), 1)


def item_seeds(items: DataFrame, least: float) -> DataFrame:
    """(iu, iv, key, times, length, span, need, unit): the seeds of items (iu, iv, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = plain_words(*W.text_bytes(batch.column("text")))
            for row, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if a == b:
                    continue
                _, span, need, unit = alignment_bounds(int(b - a), least)
                item = hashes[a:b]
                key, times = np.unique(single_keys(item) if unit == 1 else pair_keys(item[:-1], item[1:]), return_counts=True)
                own = [batch.column(c)[row].as_py() for c in ("iu", "iv")]
                fixed = [np.full(len(key), x, np.int64) for x in (*own, b - a, span, need, unit)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*fixed[:2], key, times, *fixed[2:])],
                    ["iu", "iv", "key", "times", "length", "span", "need", "unit"],
                )

    return items.mapInArrow(make, ", ".join(f"{c} bigint" for c in ("iu", "iv", "key", "times", "length", "span", "need", "unit")))


class KeyFilter:
    """A bitmap of a table's keys. A key that is there always passes; few others do.

    Its size follows the number of keys up to 2**MOST_BITS bits; beyond, more keys pass that
    the join drops. Spark makes it in blocks of 4 KiB, so no list of keys reaches the driver.
    """

    def __init__(self, keys: DataFrame) -> None:
        number = keys.count()
        self.bits = min(max(FEWEST_BITS, (16 * number).bit_length()), MOST_BITS)
        slot = F.col("key").bitwiseAND(F.lit((1 << self.bits) - 1)) + 1
        blocks = keys.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap")
        )
        held = np.zeros(1 << (self.bits - 3), np.uint8)
        for row in blocks.collect():  # at most 2**(MOST_BITS - 15) rows
            at = (row["block"] - 1) << 12
            held[at : at + 4096] = np.frombuffer(row["bitmap"], np.uint8)
        self.held = keys.sparkSession.sparkContext.broadcast(held)

    def among(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & ((1 << self.bits) - 1)
        return (self.held.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def text_keys(hashes: np.ndarray, first: np.ndarray, wanted: KeyFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, weight) of what may be seeds in some texts."""
    end = np.repeat(first[1:], np.diff(first))
    out = []
    for apart, weight in ((1, 3), (2, 1), (0, 1)):
        if apart:
            at = np.flatnonzero(np.arange(len(hashes)) + apart < end)
            keys = pair_keys(hashes[at], hashes[at + apart])
        else:
            at, keys = np.arange(len(hashes)), single_keys(hashes)
        ok = wanted.among(keys)
        out.append(np.stack([at[ok], keys[ok], np.full(int(ok.sum()), weight)]))
    place, key, weight = np.concatenate(out, axis=1)
    return place, key, weight


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    buf, offsets = W.text_bytes(batch.column("text"))
    for lo, hi in W.row_slices(offsets):
        part = offsets[lo : hi + 1]
        yield lo, *plain_words(buf[part[0] : part[-1]], part - part[0])


def document_counts(texts: DataFrame, wanted: KeyFilter) -> DataFrame:
    """(key, docs): rows of ``texts`` (text) that hold each wanted key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, first in _slices(batch):
                place, key, _ = text_keys(hashes, first, wanted)
                text = np.searchsorted(first, place, "right") - 1
                order = np.lexsort((text, key))
                key, text = key[order], text[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                keys, docs = np.unique(key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], ["key", "docs"])

    return texts.mapInArrow(count, "key bigint, docs bigint").groupBy("key").agg(F.sum("docs").alias("docs"))


def rare_seeds(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """Seeds without the most frequent ones of each item: iu, iv, key, span, need.

    What is left out could add ``unit`` for each of its places to the sum an alignment needs; the
    others must hold the rest. Seeds in no document go as well, and items whose other seeds
    cannot reach their need any more.
    """
    item = Window.partitionBy("iu", "iv")
    whole = item.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = item.orderBy(F.desc("docs"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = seeds.join(counts, "key", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    # The longest prefix of the order that stays within the allowance; needs stay above 0.
    rows = rows.withColumn("out", F.sum("times").over(upto) <= F.floor((F.col("need") - 1) * LEFT_OUT / F.col("unit")))
    lost = F.sum(F.when(F.col("out"), F.col("times") * F.col("unit")).otherwise(0)).over(whole)
    held = F.sum(F.when(~F.col("out") & (F.col("docs") > 0), F.col("times") * F.col("unit")).otherwise(0)).over(whole)
    rows = rows.withColumns({"need": F.col("need") - lost, "held": held})
    return rows.where("not out and docs > 0 and held >= need").select("iu", "iv", "key", "span", "need")


def seed_places(texts: DataFrame, wanted: KeyFilter) -> DataFrame:
    """(u, v, key, place, weight) of the wanted keys in ``texts`` (u, v, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hashes, first in _slices(batch):
                place, key, weight = text_keys(hashes, first, wanted)
                text = np.searchsorted(first, place, "right") - 1
                row = pa.array(lo + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u").take(row), batch.column("v").take(row), *(pa.array(c) for c in (key, place - first[text], weight))],
                    ["u", "v", "key", "place", "weight"],
                )

    return texts.mapInArrow(find, "u bigint, v bigint, key bigint, place bigint, weight bigint")


def seeded_stretches(places: DataFrame, seeds: DataFrame, copies: DataFrame) -> DataFrame:
    """(u, v, iu, iv, blocks): the stretches of texts with seeds enough for an alignment.

    A block has as many words as an alignment with that item spans at most, so any alignment
    lies in one block and the next. ``copies`` (u, v, n) says how many rows hold a text that is
    there more than once; each row has given the same places.
    """
    block = F.floor(F.col("place") / F.col("span"))
    both = F.explode(F.when(block > 0, F.array(block - 1, block)).otherwise(F.array(block))).alias("block")
    found = places.join(seeds, "key").select("u", "v", "iu", "iv", "need", "weight", both)
    sums = found.groupBy("u", "v", "iu", "iv", "block").agg(F.sum("weight").alias("sum"), F.first("need").alias("need"))
    sums = sums.where("sum >= need").join(copies, ["u", "v"], "left").where("sum >= need * coalesce(n, 1)")
    return sums.groupBy("u", "v", "iu", "iv").agg(F.array_sort(F.collect_list("block")).alias("blocks"))


def align_ends(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and first passage word of the best local alignment that ends before each word.

    One row of the table for each word of the item; gaps along the passage follow from a
    running maximum, so a row is a few array operations.
    """
    m = len(passage)
    places = np.arange(m + 1)
    score, start = np.zeros(m + 1, np.int64), places
    best, best_start = score.copy(), places.copy()
    slope = places * -GAP
    for word in item:
        diagonal = np.zeros(m + 1, np.int64)
        diagonal[1:] = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        origin = places.copy()
        origin[1:] = np.where(score[:-1] > 0, start[:-1], places[:-1])
        down = score + GAP
        row = np.maximum(diagonal, down)
        origin = np.where(diagonal >= down, origin, start)
        origin = np.where(row > 0, origin, places)
        row = np.maximum(row, 0)
        lifted = np.maximum.accumulate(row + slope)
        source = np.maximum.accumulate(np.where(row + slope == lifted, places, 0))
        score, start = lifted - slope, origin[source]
        better = score > best
        best, best_start = np.where(better, score, best), np.where(better, start, best_start)
    return best, best_start


def top_score(item: np.ndarray, passage: np.ndarray) -> int:
    """Score of the best local alignment, without its place."""
    slope = np.arange(len(passage) + 1) * -GAP
    steps = np.where(item[:, None] == passage, MATCH, MISMATCH)
    score, top = np.zeros(len(passage) + 1, np.int64), 0
    for step in steps:
        row = np.maximum(score + GAP, 0)
        np.maximum(row[1:], score[:-1] + step, out=row[1:])
        row += slope
        score = np.maximum.accumulate(row, out=row) - slope
        top = max(top, int(score.max()))
    return top


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score and the passage words it covers (end exclusive)."""
    score, start = align_ends(item, passage)
    top = int(np.argmax(score))
    return int(score[top]), int(start[top]) if score[top] else 0, top


def apart(item: np.ndarray, passage: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Alignments of at least that score that share no passage word, the best ones first."""
    pieces = [(0, len(passage))]
    while pieces:
        a, b = pieces.pop()
        if MATCH * (b - a) < least or top_score(item, passage[a:b]) < least:
            continue
        score, start = align_ends(item, passage[a:b])
        enough = np.flatnonzero(score >= least)
        taken = np.zeros(b - a + 1, bool)
        parts = []
        for end in enough[np.argsort(-score[enough], kind="stable")].tolist():
            begin = int(start[end])
            if not taken[begin:end].any():
                taken[begin:end] = True
                parts.append((begin, end))
                yield int(score[end]), a + begin, a + end
        # What is left may hold another one whose best alignment reached into these.
        parts.sort()
        edges = [0, *(x for p in parts for x in p), b - a]
        if parts:
            pieces += [(a + lo, a + hi) for lo, hi in zip(edges[::2], edges[1::2], strict=True)]


def aligned(rows: DataFrame, least: float) -> DataFrame:
    """(u, v, iu, iv, score, first_word, end_word) of ``rows`` (u, v, text, items).

    ``items`` holds (iu, iv, item, blocks) of the items to align the text with.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                held = batch.column("items")[row].as_py()
                hashes, _ = plain_words(*W.text_bytes(batch.column("text").slice(row, 1)))
                own = batch.column("u")[row].as_py(), batch.column("v")[row].as_py()
                for one in held:
                    item, _ = plain_words(*W.text_bytes(pa.array([one["item"]])))
                    score, span, _, _ = alignment_bounds(len(item), least)
                    for a, b in stretches(np.array(one["blocks"]), span):
                        for points, s, e in apart(item, hashes[a:b], score):
                            out.append((*own, one["iu"], one["iv"], points / (MATCH * len(item)), a + s, a + e))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out, strict=True)], ["u", "v", "iu", "iv", "score", "first_word", "end_word"]
                )

    return rows.mapInArrow(search, "u bigint, v bigint, iu bigint, iv bigint, score double, first_word bigint, end_word bigint")


def stretches(blocks: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Word ranges of the blocks, each with the one behind it; those that overlap are one."""
    cuts = np.flatnonzero(np.diff(blocks) > 1) + 1
    return [(int(part[0]) * span, (int(part[-1]) + 2) * span) for part in np.split(blocks, cuts)]


def _name(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def find_copies(
    docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST, key: str = "doc_id", least_words: int = LEAST_WORDS
) -> DataFrame:
    """Passages of ``docs`` that copy test items: ``key``, item_id, score, first_word, end_word.

    Score is the alignment score over the highest an item can have; a document has a row
    for each passage apart. Letter case and ASCII marks don't count. Null and empty texts
    hold nothing; an item of fewer than ``LEAST_WORDS`` words counts only where it stands whole,
    and one of fewer than ``least_words`` words not at all; very long texts are searched whole;
    repeated rows of either table give repeated rows; empty tables give no rows; other columns
    are not read. Equal texts are searched once.
    """
    scratch = Scratch(docs.sparkSession)
    u, v = _name(F.col("text"))
    rows = docs.where("text is not null").select(F.col(key).alias("key"), "text", u.alias("u"), v.alias("v"))
    tests = benchmark.where("text is not null").select("item_id", "text", u.alias("iu"), v.alias("iv"))
    items = tests.groupBy("iu", "iv").agg(F.first("text").alias("text"))
    seeds = scratch.keep(item_seeds(items, least).where(F.col("length") >= least_words), "seeds")
    counts = document_counts(rows.select("text"), KeyFilter(seeds.select("key").distinct()))
    rare = scratch.keep(rare_seeds(seeds, counts), "rare")
    places = seed_places(rows.select("u", "v", "text"), KeyFilter(rare.select("key").distinct()))
    copies = rows.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1")
    found = scratch.keep(seeded_stretches(places, rare, copies), "stretches")
    # Each text once, with its items in lists of bounded length.
    order = F.row_number().over(Window.partitionBy("u", "v").orderBy("iu", "iv"))
    lists = found.join(items.withColumnRenamed("text", "item"), ["iu", "iv"]).withColumn("list", F.floor((order - 1) / LIST_ITEMS))
    lists = lists.groupBy("u", "v", "list").agg(F.collect_list(F.struct("iu", "iv", "item", "blocks")).alias("items"))
    texts = rows.join(found.select("u", "v").distinct(), ["u", "v"], "left_semi").groupBy("u", "v").agg(F.first("text").alias("text"))
    passages = scratch.keep(aligned(texts.join(lists, ["u", "v"]).select("u", "v", "text", "items"), least), "passages")
    scratch.drop(seeds, rare, found)
    out = rows.select("key", "u", "v").join(passages, ["u", "v"]).join(tests.select("item_id", "iu", "iv"), ["iu", "iv"])
    return out.select(F.col("key").alias(key), "item_id", "score", "first_word", "end_word")
