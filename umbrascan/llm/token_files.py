"""Token ids in a compressed file format: static range asymmetric numeral system (rANS) blocks.

A file set is a Parquet table of blocks.  Every block holds whole documents in ascending order of their key and can be
decoded alone: ``LANES`` interleaved states share one stream of 32-bit words, all blocks share one frequency table,
and ``SEGMENTS`` checkpoints (states and place in the stream) let a reader start inside a block or decode its segments
side by side.  A CRC-32 guards the payload and another the ids.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbrascan.llm.pretokens import LibraryIds, once
from umbrascan.llm.shared import binaries, shared_dir, stored, strings

LOW = np.uint64(1 << 31)
BLOCK = 1 << 22
HEAD = "<IHHII"


class Tables:
    """Frequencies scaled to a power of two; every symbol that occurs keeps at least one slot."""

    def __init__(self, counts: dict[int, int]):
        symbols = np.array(sorted(counts) or [0], np.int64)
        n = np.array([counts.get(int(s), 1) for s in symbols], np.float64)
        self.bits = max(20, int(len(symbols) * 4).bit_length())
        size = 1 << self.bits
        share = np.maximum(1, np.floor(n * (size / n.sum()))).astype(np.int64)
        over = int(share.sum()) - size
        for i in np.argsort(-share, kind="stable"):  # takes from, or gives to, the most frequent
            if over == 0:
                break
            step = min(over, int(share[i]) - 1) if over > 0 else over
            share[i] -= step
            over -= step
        self.freq = np.zeros(int(symbols[-1]) + 1, np.uint64)
        self.freq[symbols] = share
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol_at = np.repeat(symbols, share).astype(np.uint32)
        self.first = int(symbols[0])


def shape(n: int) -> tuple[int, int, int]:
    """Lanes, segments and steps of a segment for ``n`` ids."""
    lanes, segments = (2048, 4) if n >= 1 << 18 else (max(1, min(512, n // 32)), 1)
    return lanes, segments, -(-n // (lanes * segments))


def encode_block(ids: np.ndarray, t: Tables) -> bytes:
    """Payload of one block: head, checkpoints, words."""
    lanes, segments, steps = shape(len(ids))
    rows = np.full(lanes * segments * steps, t.first, np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(segments * steps, lanes)
    bits, mask32 = np.uint64(t.bits), np.uint64(0xFFFFFFFF)
    room, down = np.uint64(63 - t.bits), np.uint64(32)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * len(rows)
    marks: list[np.ndarray] = [x] * segments
    for i in range(len(rows) - 1, -1, -1):
        f, c = t.freq[rows[i]], t.cum[rows[i]]
        full = x >= (f << room)
        words[i] = (x[full] & mask32).astype(np.uint32)
        x = np.where(full, x >> down, x)
        q = x // f
        x = (q << bits) + (x - q * f) + c
        if i % steps == 0:
            marks[i // steps] = x
    sizes = np.cumsum([0, *map(len, words)])
    starts = [int(sizes[s * steps]) for s in range(segments)]
    head = struct.pack(HEAD, len(ids), lanes, segments, steps, int(sizes[-1]))
    return b"".join([head, np.array(starts, "<u8").tobytes(), *(m.astype("<u8").tobytes() for m in marks), *(w.astype("<u4").tobytes() for w in words)])


def decode_block(payload: bytes, t: Tables, only: int | None = None) -> np.ndarray:
    """Ids of a block, all segments side by side, or of the segment ``only``."""
    n, lanes, segments, steps, _ = struct.unpack_from(HEAD, payload)
    at = struct.calcsize(HEAD)
    pointer = np.frombuffer(payload, "<u8", segments, at).astype(np.int64)
    x = np.frombuffer(payload, "<u8", segments * lanes, at + 8 * segments).reshape(segments, lanes).astype(np.uint64)
    words = np.frombuffer(payload, "<u4", -1, at + 8 * segments * (1 + lanes))
    if only is not None:
        pointer, x = pointer[only : only + 1], x[only : only + 1]
    out = np.empty((len(x), steps, lanes), np.uint32)
    bits, low, down = np.uint64(t.bits), np.uint64((1 << t.bits) - 1), np.uint64(32)
    for i in range(steps):
        slot = x & low
        s = t.symbol_at[slot.astype(np.int64)]
        out[:, i] = s
        x = t.freq[s] * (x >> bits) + slot - t.cum[s]
        short = x < LOW
        place = np.cumsum(short, axis=1)
        x[short] = (x[short] << down) | words[(place + (pointer[:, None] - 1))[short]]
        pointer += place[:, -1]
    flat = out.reshape(-1)
    return flat[: max(0, n - (only or 0) * steps * lanes)] if only is not None else flat[:n]


def tokenized(docs: DataFrame, path: str, pattern: str, end_id: int, key: str, text: str) -> DataFrame:
    """``key`` and the packed ids with the end id; every task adds a row without ids whose ``counts`` are those of its ids."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = once(("ids", path), lambda: LibraryIds(path, pattern))
        end = np.array([end_id], library.kind).tobytes()
        total, key_kind = np.zeros(library.vocab_size, np.int64), None
        for batch in batches:
            key_kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = [library.packed(t) + end for t in strings(part.column(1))]
                total += np.bincount(np.frombuffer(b"".join(packed), library.kind), minlength=len(total))
                yield pa.RecordBatch.from_arrays([part.column(0), binaries(packed), pa.nulls(len(packed), pa.binary())], [key, "ids", "counts"])
        if key_kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_kind), pa.nulls(1, pa.binary()), binaries([total.astype("<i8").tobytes()])], [key, "ids", "counts"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids binary, counts binary")


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """Occurrences of each id over all documents, from the tasks' counts; at most a row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                part = np.frombuffer(cell.as_py(), "<i8")
                total = part + (total if len(total) else 0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    parts = tokens.filter("counts IS NOT NULL").select("counts")
    return {r["id"]: r["n"] for r in parts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def _blocks(tables: Tables, kind: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, keys, sizes, held, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload = encode_block(ids, tables)
            cells = [[part], [number], [n], [payload], [zlib.crc32(payload)], [zlib.crc32(ids.astype("<u4"))], [keys], [sizes]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(key_kind), pa.list_(pa.int64())]
            names = ["part", "block", "n", "payload", "crc", "ids_crc", "keys", "sizes"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names)

        for batch in batches:
            key_kind = batch.schema.field(0).type
            for key, raw in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(raw.as_py(), kind)
                keys.append(key.as_py())
                sizes.append(len(ids))
                held.append(ids)
                n += len(ids)
                if n >= block:
                    yield flush()
                    number, keys, sizes, held, n = number + 1, [], [], [], 0
        if held:
            yield flush()

    return run


def write(
    docs: DataFrame, folder: str, path: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text", block: int = BLOCK
) -> None:
    """Writes the ids of every whole text, each followed by ``end_id``, to ``folder`` in ascending order of ``key``.

    A null or empty text is the end id alone.  Rows that repeat a key follow each other; null keys come first.  Other
    columns are not written.  Part and block numbers give the order of the blocks.
    """
    kind = "<u2" if _vocab(path) <= 1 << 16 else "<u4"
    tokens = tokenized(docs, path, pattern, end_id, key, text).withColumn("row", F.monotonically_increasing_id())
    tokens = stored(tokens, "tokens")
    counts = count_ids(tokens)
    ordered = tokens.filter("ids IS NOT NULL").select(key, "row", "ids").repartitionByRange(key, "row").sortWithinPartitions(key, "row").select(key, "ids")
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"part int, block int, n long, payload binary, crc long, ids_crc long, keys array<{key_type}>, sizes array<long>"
    blocks = ordered.mapInArrow(_blocks(Tables(counts), kind, block), schema)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    spark = docs.sparkSession
    symbols = [(json.dumps({str(k): v for k, v in counts.items()}),)]
    spark.createDataFrame(symbols, "counts string").coalesce(1).write.parquet(f"{folder}/tables")


def _vocab(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(True)


def read(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document of a file set: key, start, n_tokens, ids_crc32, and, if wanted, the packed ids.

    Blocks are decoded in parallel; a damaged payload, or a frequency table that gives other ids, fails the job.
    """
    counts = {int(k): v for k, v in json.loads(spark.read.parquet(f"{folder}/tables").first()["counts"]).items()}
    tables = Tables(counts)
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, payload, crc, ids_crc, keys, sizes = (batch.column(c)[i].as_py() for c in range(7))
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"block {number} of part {part} is damaged")
                ids = decode_block(payload, tables).astype("<u4")
                if zlib.crc32(ids) != ids_crc:
                    raise ValueError(f"block {number} of part {part} decodes to other ids than were written")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cells = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                for at in range(0, len(cells), 1000):
                    some = cells[at : at + 1000]
                    n = len(some)
                    columns = [
                        pa.array(keys[at : at + n], batch.schema.field(5).type.value_type), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()),
                        pa.array(starts[at : at + n], pa.int64()), pa.array(sizes[at : at + n], pa.int64()),
                        pa.array([zlib.crc32(c) for c in some], pa.int64()), binaries(some) if with_ids else pa.nulls(n, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [key, "part", "block", "at", "n_tokens", "ids_crc32", "ids"])

    schema = f"`{key}` {kind}, part int, block int, at long, n_tokens long, ids_crc32 long, ids binary"
    decoded = blocks.select("part", "block", "payload", "crc", "ids_crc", "keys", "sizes").mapInArrow(run, schema)
    sizes = blocks.select("part", "block", "n")
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("total")).select("part", ahead.alias("ahead"))  # a row per task of the writer
    begins = sizes.select("part", "block", inside.alias("inside")).join(parts, "part")
    out = decoded.join(begins, ["part", "block"])
    return out.select(key, (F.col("ahead") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def write_and_read(
    docs: DataFrame, path: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """Writes a file set below the shared folder and reads it back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder, path, pattern, end_id, key, text)
    return read(docs.sparkSession, folder, key, with_ids)
