"""Phrase collocations from suffix trees built apart, by vertical partitioning.

A suffix is what follows a word inside its piece of text, cut after ``longest`` words. The
tree of all suffixes is never whole anywhere. It is cut at prefixes: first words, and where
a first word has more suffixes than the memory budget, its first two words, dealt over
parts, and so on. Rows are spread by the hash of their prefix and part and sorted by it; a
task gathers whole prefixes up to the budget, builds their subtree (sorted leaves, nodes
where leading words change), reads each node's count off the totals of its leaves and goes
on with the next group. Only nodes above a cut, shared by several groups, are added up later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.joins import lookup_join
from chronofold.llm import words as W
from chronofold.llm.scratch import Scratch

BUDGET = 1 << 18
"""Suffixes a group may hold; beside them only the rows of one batch are in memory."""

SLICE = 4 << 20
"""Bytes of text whose equal suffixes are counted together before they leave a task."""

BREAKS = np.zeros(256, bool)
"""Bytes that end a piece: . , ; : ! ? and line breaks."""
BREAKS[[ord(c) for c in ".,;:!?"]] = True
BREAKS[10:14] = True

BETWEEN = BREAKS.copy()
BETWEEN[[9, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SECOND = W.byte_table(2, True)
STEP = np.uint64(0xD6E8FEB86659FD93)


PACKED = 1 << 10
"""Most suffixes of one first word that travel in one row."""

SHARE = 1 << 10
"""No group is cut coarser than this share of all suffixes, so that small inputs spread too."""

PARTS = 64
"""Parts a prefix above the budget is dealt over."""

ROWS = "lang string, prefix string, part bigint, depth int, rest string, n array<int>"
"""Suffixes of one first word: what follows it, one to a line, and how often each stands.
Suffixes that share ``depth`` words have the same ``part``."""


def _suffixes(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, names: pa.Array, longest: int) -> pa.RecordBatch | None:
    """Rows of the suffixes of some texts, equal ones once, by lang and first word.

    Words are in lower case. Suffixes are told apart by two 64-bit hashes.
    """
    first, starts, ends, bounds = W.word_hashes(buf, offsets, W.FOLDED, between=BETWEEN)
    second = W.word_hashes(buf, offsets, SECOND, between=BETWEEN)[0]
    n = len(first)
    if not n:
        return None
    broken = np.append(0, np.cumsum(BREAKS[buf], dtype=np.int64))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    last = np.ones(n, bool)  # the last word of its piece
    last[:-1] = (broken[starts[1:]] != broken[ends[:-1]]) | (text[1:] != text[:-1])
    size = np.ones(n, np.int64)
    for _ in range(longest - 1):
        size[:-1] = np.where(last[:-1], 1, np.minimum(size[1:] + 1, longest))
    kinds = kind[text]
    lead = W.mix(first + W.mix(second + kinds.astype(np.uint64) * STEP))

    def named(hashes: np.ndarray) -> np.ndarray:
        out = W.mix(kinds.astype(np.uint64) + STEP)
        for k in range(longest):
            there = np.flatnonzero(size > k)
            out[there] = W.mix(out[there] * STEP + hashes[there + k])
        return out

    after = np.where(size > 1, np.append(first[1:], np.uint64(0)), np.uint64(0))
    first, second = named(first), named(second)
    order = np.lexsort((first, after, lead))
    new = np.ones(n, bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, n))
    shown = order[at]
    head = np.ones(len(at), bool)  # the first suffix of its row
    head[1:] = lead[shown[1:]] != lead[shown[:-1]]
    groups = np.flatnonzero(head)
    place = np.arange(len(at)) - groups[np.cumsum(head) - 1]
    groups = np.flatnonzero(place % PACKED == 0)
    bounds = np.append(groups, len(at))
    more = size[shown] > 1
    held = np.maximum(size[shown] - 1, 1)
    word = W.ragged(shown + more, held)
    alone = np.repeat(~more, held)
    rest = _text(buf, np.where(alone, ends[word], starts[word]), ends[word], np.cumsum(held), np.cumsum(held)[bounds[1:] - 1])
    whose = shown[groups]
    prefix = _text(buf, starts[whose], ends[whose], np.arange(1, len(whose) + 1), np.arange(1, len(whose) + 1))
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(kinds[whose])), prefix, pa.array(np.zeros(len(groups), np.int64)), pa.array(np.ones(len(groups), np.int32)),
            rest, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(counts, pa.int32())),
        ],
        COLUMNS,
    )


COLUMNS = ["lang", "prefix", "part", "depth", "rest", "n"]


def _text(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lines: np.ndarray, values: np.ndarray) -> pa.Array:
    """Strings of words start..end-1: a space behind each word, a line break behind the
    words before each of ``lines``, nothing behind those before each of ``values``."""
    wide = ends - starts + 1
    chars = LOWER[np.append(buf, np.uint8(32))[W.ragged(starts, wide)]]
    stops = np.cumsum(wide) - 1
    chars[stops] = 32
    chars[stops[lines - 1]] = 10
    keep = np.ones(len(chars), bool)
    keep[stops[values - 1]] = False
    cuts = np.append(0, stops[values - 1] - np.arange(len(values)))
    return pa.LargeStringArray.from_buffers(len(values), pa.py_buffer(cuts), pa.py_buffer(chars[keep])).cast(pa.string())


def count_suffixes(docs: DataFrame, longest: int) -> DataFrame:
    """ROWS of the suffixes of whole texts; equal ones of a slice of texts are counted together."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).fill_null("und").dictionary_encode()
            kind = langs.indices.to_numpy()
            buf, offsets = W.text_bytes(batch.column(1))
            for lo, hi in W.row_slices(offsets, SLICE):
                at = offsets[lo : hi + 1]
                for a, b in _parts(buf[at[0] : at[-1]]):
                    found = _suffixes(buf[at[0] + a : at[0] + b], np.clip(at - at[0], a, b) - a, kind[lo:hi], langs.dictionary, longest)
                    if found is not None:
                        yield found

    return docs.select("lang", "text").mapInArrow(rows, ROWS)


def _dealt(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ROWS dealt over PARTS by the first ``words`` words behind the prefix."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.split_pattern(batch.column("rest"), "\n")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lines).to_numpy())
            if not len(row):
                continue
            flat = lines.flatten()
            head = pc.replace_substring_regex(flat, f"^((?:[^ ]+ ){{{words - 1}}}[^ ]+) .*$", "\\1").dictionary_encode()
            hashes = pd.util.hash_array(head.dictionary.to_numpy(zero_copy_only=False))
            bucket = (hashes % np.uint64(PARTS)).astype(np.int64)[head.indices.to_numpy()]
            order = np.argsort(row * PARTS + bucket, kind="stable")
            name = (row * PARTS + bucket)[order]
            groups = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            offsets = pa.array(np.append(groups, len(name)), pa.int32())
            whose, order = pa.array(name[groups] // PARTS), pa.array(order)
            part = batch.column("part").to_numpy()[whose.to_numpy()] * (PARTS + 1) + 1 + name[groups] % PARTS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(whose), batch.column("prefix").take(whose), pa.array(part),
                    pa.array(batch.column("depth").to_numpy()[whose.to_numpy()] + np.int32(1)),
                    pc.binary_join(pa.ListArray.from_arrays(offsets, flat.take(order)), "\n"),
                    pa.ListArray.from_arrays(offsets, batch.column("n").flatten().take(order)),
                ],
                COLUMNS,
            )

    return deal


def _parts(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about SLICE bytes that end behind the end of a piece; all of it, if it is short."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(lo + SLICE, n)
        while hi < n and not BREAKS[buf[hi - 1]]:
            found = np.flatnonzero(BREAKS[buf[hi : hi + SLICE]])
            hi = hi + int(found[0]) + 1 if len(found) else min(hi + SLICE, n)
        yield lo, hi
        lo = hi


def _words(phrase: Column | str, k: Column | int) -> Column:
    """The first k words, or the last -k ones."""
    return F.call_function("substring_index", F.col(phrase) if isinstance(phrase, str) else phrase, F.lit(" "), F.lit(k) if isinstance(k, int) else k)


def build_subtrees(rows: pa.Table, longest: int, least: int) -> pa.RecordBatch:
    """Nodes (lang, phrase, size, f, whole) of the subtrees of whole parts of prefixes.

    Nodes of fewer than ``depth`` words belong to several groups: they are not ``whole``.
    Of the others, those with ``least`` or more occurrences are shown.
    """
    rows = rows.combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    lang = column("lang").dictionary_encode()
    lines = pc.split_pattern(column("rest"), "\n")
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lines).to_numpy())
    behind = pc.split_pattern(lines.flatten(), " ")
    blank = pc.equal(lines.flatten(), "").to_numpy(zero_copy_only=False)
    more = np.where(blank, 0, pc.list_value_length(behind).to_numpy())
    before = pc.split_pattern(column("prefix"), " ")
    own = pc.list_value_length(before).to_numpy()
    tails = behind.flatten()
    every = pa.concat_arrays([before.flatten(), tails.filter(pc.not_equal(tails, ""))]).dictionary_encode()
    codes = every.indices.to_numpy()
    first = np.cumsum(own) - own
    next_ = int(own.sum()) + np.cumsum(more) - more
    grid = np.full((len(row), longest), -1, np.int32)
    for k in range(longest):
        inside = np.flatnonzero(own[row] > k)
        grid[inside, k] = codes[first[row[inside]] + k]
        inside = np.flatnonzero((own[row] <= k) & (own[row] + more > k))
        grid[inside, k] = codes[next_[inside] + k - own[row[inside]]]
    kind, depth = lang.indices.to_numpy()[row], rows.column("depth").to_numpy()[row]
    order = np.lexsort((*grid.T[::-1], kind))
    grid, kind, depth = grid[order], kind[order], depth[order]
    n = column("n").flatten().to_numpy()[order]
    new = np.ones(len(n), bool)
    new[1:] = kind[1:] != kind[:-1]
    out = [], [], [], [], []
    for size in range(1, longest + 1):
        new[1:] |= grid[1:, size - 1] != grid[:-1, size - 1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(n, at) if len(at) else n
        whole = depth[at] <= size
        shown = (grid[at, size - 1] >= 0) & ((total >= least) | ~whole)
        at = at[shown]
        columns = [every.dictionary.take(pa.array(grid[at, k])) for k in range(size)]
        out[0].append(lang.dictionary.take(pa.array(kind[at])))
        out[1].append(pc.binary_join_element_wise(*columns, " ") if size > 1 else columns[0])
        out[2].append(pa.array(np.full(len(at), size, np.int32)))
        out[3].append(pa.array(total[shown]))
        out[4].append(pa.array(whole[shown]))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], ["lang", "phrase", "size", "f", "whole"])


def _gathered(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.Table]:
    """Groups of whole prefixes, as few as hold ``budget`` suffixes, from rows sorted by ``place``."""
    held, count = [], 0
    for batch in batches:
        at = batch.schema.get_field_index("n")
        held.append(batch.set_column(at, "n", batch.column(at).cast(pa.list_(pa.int64()))))
        count += len(batch.column(at).flatten())
        if count < budget:
            continue
        table = pa.Table.from_batches(held)
        place = table.column("place").to_numpy()
        cut = int(np.searchsorted(place, place[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        if _many(rest) >= budget:
            rest = _summed(rest)
        held, count = rest.to_batches(), _many(rest)
    if held:
        yield pa.Table.from_batches(held)


def _many(rows: pa.Table) -> int:
    return int(pc.sum(pc.list_value_length(rows.column("n"))).as_py() or 0)


def _summed(rows: pa.Table) -> pa.Table:
    """Each suffix of one place once: they came from very many slices of text."""
    lines = pc.split_pattern(rows.column("rest").combine_chunks(), "\n")
    row = pa.array(np.repeat(np.arange(rows.num_rows), pc.list_value_length(lines).to_numpy()))
    keys = ["lang", "prefix", "part", "depth", "place"]
    flat = rows.select(keys).take(row).append_column("rest", lines.flatten()).append_column("n", rows.column("n").combine_chunks().flatten())
    one = flat.group_by([*keys, "rest"]).aggregate([("n", "sum")])
    n = one.column("n_sum").combine_chunks()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1), pa.int32()), n)
    return one.append_column("n", lists).select(rows.column_names)


def count_phrases(docs: DataFrame, *, longest: int, least: int, scratch: Scratch, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of 1 to ``longest`` words with ``least`` or more
    occurrences, and (lang, n) with all word occurrences."""
    leaves = scratch.keep(count_suffixes(docs, longest), "suffixes", compression="zstd")
    words = leaves.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    words = scratch.keep(words, "words")
    rows = F.sum(F.size("n").cast("bigint")).alias("rows")
    total = leaves.agg(rows).first()[0] or 0
    limit = min(budget, max(total // SHARE, PACKED))
    key = ["lang", "prefix", "part"]
    placed, open_ = None, leaves
    for size in range(1, longest):
        heavy = open_.groupBy(*key).agg(rows).where(F.col("rows") > limit).select(*key)
        heavy = scratch.keep(heavy, "heavy")
        if heavy.isEmpty():
            break
        marked = lookup_join(open_, heavy.withColumn("more", F.lit(True)), key)
        light = marked.where("more is null").select(*COLUMNS)
        placed = light if placed is None else placed.unionByName(light)
        open_ = marked.where("more").select(*COLUMNS).mapInArrow(_dealt(size), ROWS)
    placed = open_ if placed is None else placed.unionByName(open_)
    place = F.xxhash64(*key)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * budget)))
    placed = placed.repartition(parts, place).withColumn("place", place).sortWithinPartitions("place")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, budget):
            yield build_subtrees(group, longest, least)

    found = placed.mapInArrow(nodes, "lang string, phrase string, size int, f bigint, whole boolean")
    found = scratch.keep(found, "found")
    scratch.drop(leaves)
    shared = found.where("not whole").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return scratch.keep(found.where("whole").drop("whole").unionByName(shared), "nodes"), words


def phrase_collocations(
    docs: DataFrame,
    *,
    longest: int = 3,
    least: int = 10,
    share: tuple[int, int] = (50, 100),
    top: int = 2000,
    budget: int = BUDGET,
    scratch: Scratch | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words of each lang.

    Texts are lower-cased (A to Z) and split into pieces at . , ; : ! ? and line breaks,
    pieces into words at spaces and tabs; a null text is empty, a null lang is ``und``.
    Phrases do not leave their piece. A phrase counts from ``least`` occurrences ``a`` on;
    of its cuts in two, with ``l`` and ``r`` occurrences of the parts, the one of the least
    score floor(1000000 * a * a / (l * r)) is reported, the first of equals. A phrase inside a
    longer one that has ``share`` of its occurrences or more goes. ``n`` counts the words of
    the lang. Order: score, then a, both descending, then the phrase's bytes. Repeated rows
    count as often as they stand; very long texts are cut at ends of pieces; an empty table
    gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    nodes, words = count_phrases(docs, longest=longest, least=least, scratch=scratch, budget=budget)
    phrases = nodes.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", _words("phrase", F.col("k")).alias("first"), _words("phrase", F.col("k") - F.col("size")).alias("rest"))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = scratch.keep(cuts.join(nodes.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part]), count)
    # Decimals of 38 digits: exact for counts below 10**15.
    score = F.expr("(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(weakest)

    inner = [(i, m) for m in range(2, longest) for i in range(longest - m + 1)]
    if inner:
        inside = [F.when((F.col("size") >= i + m) & (F.col("size") > m), _words(_words("phrase", i + m), -m)) for i, m in inner]
        longer = phrases.where("size > 2").select("lang", "a", F.explode(F.array_compact(F.array(*inside))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        held = F.coalesce(F.col("longer") * share[1] >= F.col("a") * share[0], F.lit(False))
        scored = scored.join(longer, ["lang", "phrase"], "left").where(~held)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    best = scratch.keep(best, "best")
    return lookup_join(best, words, ["lang"]).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
