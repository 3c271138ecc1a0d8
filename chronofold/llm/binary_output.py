"""Token ids in files of fixed-width bit packing.

Each id takes the least number of bits that hold the vocabulary. A file is a Parquet table
whose rows are chunks: whole documents in ascending doc_id order, about ``CHUNK_IDS`` ids,
cut into blocks of ``BLOCK_IDS`` ids that begin at a byte. A chunk carries its documents'
ids and first positions and the byte offset of every block, so any block is unpacked alone
with numpy. Parquet is the container because Spark writes and reads it in any store; the
payload is the packed binary itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm import tokens

BLOCK_IDS = 4096
CHUNK_IDS = 1 << 17


def bits_for(vocabulary: int) -> int:
    """Bits that hold the ids 0 .. vocabulary - 1; at least one."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as bytes, ``width`` bits each, lowest bit first, padded to a whole byte."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(ids, f"<u{width // 8}").view(np.uint8)
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")


def unpack_block(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return raw[: n * width // 8].view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(raw, bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack_chunk(ids: np.ndarray, width: int, block: int = BLOCK_IDS) -> tuple[bytes, list[int]]:
    """All blocks of a chunk and the byte offset of each."""
    parts = [pack_block(ids[i : i + block], width) for i in range(0, len(ids), block)]
    sizes = np.cumsum([0, *map(len, parts)])
    return b"".join(p.tobytes() for p in parts), sizes[:-1].tolist()


def read_ids(payload: bytes, offsets: list[int], n_ids: int, width: int, lo: int, hi: int, block: int = BLOCK_IDS) -> np.ndarray:
    """Ids lo..hi-1 of a chunk; only the blocks that hold them are unpacked."""
    raw, out = np.frombuffer(payload, np.uint8), []
    for b in range(lo // block, -(-hi // block)):
        end = offsets[b + 1] if b + 1 < len(offsets) else len(raw)
        got = unpack_block(raw[offsets[b] : end], min(block, n_ids - b * block), width)
        out.append(got[max(0, lo - b * block) : hi - b * block])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _chunk_schema(id_type: str) -> str:
    return (
        "shard int, chunk int, first bigint, n_ids int, width int, "
        f"doc_ids array<{id_type}>, doc_first array<int>, block_at array<int>, payload binary"
    )


def write_token_files(docs: DataFrame, path: str, *, end_id: int = 1, tokenizer: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the files below ``path``.

    Null texts are empty; null doc_ids come first; rows of equal doc_id follow each other
    by their text. A shard is one range of doc_id and one task; ``first`` counts within it.
    """
    tokenizer = tokenizer or tokens.default_tokenizer()
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    width = bits_for(tokens.Encoder(tokenizer).vocabulary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        chunk = first = held = 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            n = np.concatenate(sizes)
            payload, at = pack_chunk(flat, width)
            key = pa.concat_arrays(keys)
            row = [
                pa.array([shard], pa.int32()),
                pa.array([chunk], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([len(flat)], pa.int32()),
                pa.array([width], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key),
                pa.array([(np.cumsum(n) - n).tolist()], pa.list_(pa.int32())),
                pa.array([at], pa.list_(pa.int32())),
                pa.array([payload], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, ["shard", "chunk", "first", "n_ids", "width", "doc_ids", "doc_first", "block_at", "payload"])

        for batch in batches:
            for row, flat, at in tokens.token_rows(batch.column(1), tokenizer, end_id):
                lo = 0
                while lo < len(at) - 1:
                    hi = int(np.searchsorted(at, at[lo] + CHUNK_IDS - held, "right")) - 1
                    hi = min(max(hi, lo + 1), len(at) - 1)
                    keys.append(batch.column(0).slice(row + lo, hi - lo))
                    ids.append(flat[at[lo] : at[hi]])
                    sizes.append(np.diff(at[lo : hi + 1]))
                    held += int(at[hi] - at[lo])
                    lo = hi
                    if held >= CHUNK_IDS or lo < len(at) - 1:
                        yield out()
                        chunk, first, held = chunk + 1, first + held, 0
                        keys, ids, sizes = [], [], []
        if keys:
            yield out()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, _chunk_schema(id_type)).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in all shards.
    """
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per writing task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = {r["shard"]: r["b"] for r in sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b")).collect()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n_ids, width = (batch.column(k)[i].as_py() for k in range(4))
                doc_first = np.array(batch.column(5)[i].as_py(), np.int64)
                at = batch.column(6)[i].as_py()
                ids = read_ids(batch.column(7)[i].as_py(), at, n_ids, width, 0, n_ids)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                n = np.diff(np.append(doc_first, n_ids))
                ends = doc_first + n
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(doc_first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(4)[i].values, pa.array(doc_first + first + bases[shard]), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    needed = files.select("shard", "first", "n_ids", "width", "doc_ids", "doc_first", "block_at", "payload")
    return needed.mapInArrow(decode, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
