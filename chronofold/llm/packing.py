"""Best-fit packing by large-item matching.

Documents are tokenized and cut only where they are longer than a sequence. What decides a
packing is how many pieces there are of each length, at most one row for every length up
to the capacity. From this histogram the driver matches lengths above a third of the
capacity, of which at most two share a sequence, largest with the largest that fits, and
puts shorter ones best-fit into the gaps, all for whole groups of equal sequences at once.
The pieces themselves stay in Spark: each finds its place by its rank among the pieces of
its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm import tokens
from chronofold.llm.scratch import Scratch

SALTS = 256
"""Parts in which the pieces of one length are numbered; one length may be a third of all."""


def token_pieces(
    docs: DataFrame, *, capacity: int, end_id: int, tokenizer: str, keep_ids: bool = False
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32
    and, if asked for, ids (little-endian unsigned 32-bit)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    if keep_ids:
        schema += ", ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for row, ids, at in tokens.token_rows(batch.column(1), tokenizer, end_id):
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                n = np.diff(at)
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                lo = (at[doc] + start) * 4
                views = [raw[a:b] for a, b in zip(lo.tolist(), (lo + length * 4).tolist(), strict=True)]
                columns = [
                    keys.take(pa.array(doc + row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(v) for v in views], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([bytes(v) for v in views], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan_bins(histogram: Mapping[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for all pieces, and the number of sequences.

    Each place is (length, first rank, pieces per sequence, first sequence, offset): the
    pieces of that length from that rank on go into consecutive sequences from there on.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("a piece is empty or longer than a sequence")
    rank = dict.fromkeys(left, 0)
    places: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    rooms: list[int] = []
    sequences = 0

    def open_room(room: int, first: int, many: int) -> None:
        if room not in gaps:
            gaps[room] = []
            bisect.insort(rooms, room)
        gaps[room].append((first, many))

    def place(n: int, first: int, many: int, each: int, offset: int) -> None:
        places.append((n, rank[n], each, first, offset))
        rank[n] += many * each
        left[n] -= many * each

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else 0
        if b == a and left[a] == 1:
            b = large[k - 1] if k > 0 else 0
        if b == a:
            many = left[a] // 2
            place(a, sequences, many, 2, 0)
        else:
            many = min(left[a], left[b]) if b else left[a]
            place(a, sequences, many, 1, 0)
            if b:
                place(b, sequences, many, 1, a)
        open_room(capacity - a - b, sequences, many)
        sequences += many
        for n in {a, b} - {0}:
            if not left[n]:
                large.pop(bisect.bisect_left(large, n))

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = min(capacity // n, left[n])
                many = left[n] // each
                open_room(capacity, sequences, many)
                sequences += many
                continue
            room = rooms[at]
            first, there = gaps[room].pop()
            each = min(room // n, left[n])
            many = min(there, left[n] // each)
            place(n, first, many, each, capacity - room)
            if there > many:
                gaps[room].append((first + many, there - many))
            elif not gaps[room]:
                del gaps[room]
                rooms.pop(at)
            open_room(room - each * n, first, many)
    return np.array(sorted(places), np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, *, capacity: int, scratch: Scratch) -> DataFrame:
    """Add sequence_id and offset to rows that hold doc_id, piece, start, length, ids_crc32.

    ``pieces`` must be stable when read again (written, or a plain scan).
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, _ = plan_bins(counts, capacity)
    keys = (places[:, 0] << 44) + places[:, 1]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(parts, ["length", "_salt"])
    names = [c for c in pieces.columns]
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before") - 1).alias("_rank"))
    at = names.index("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(at).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            row = places[np.searchsorted(keys, (n << 44) + rank, "right") - 1]
            step, inside = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            columns = [*batch.columns[: len(names)], pa.array(row[:, 3] + step), pa.array(row[:, 4] + inside * n)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, f"{schema}, sequence_id bigint, offset bigint")


def best_fit_packing(
    docs: DataFrame,
    *,
    capacity: int = 4096,
    end_id: int = 1,
    tokenizer: str | None = None,
    keep_ids: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    A null or empty text is one piece that holds the end id only; repeated rows and null
    ids are packed like any others; an empty table gives no rows; other columns are not
    read. Ranks need a stable input, so the pieces are written to the shared folder once.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    pieces = scratch.keep(
        token_pieces(
            docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer or tokens.default_tokenizer(), keep_ids=keep_ids
        ),
        "pieces",
    )
    return pack(pieces, capacity=capacity, scratch=scratch)
