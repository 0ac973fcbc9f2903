"""Byte-level BPE encoding and decoding on padded numpy matrices.

Distinct pre-tokens of a slice of texts are laid out as rows of token ids, in matrices of similar length.  Each round
every row merges its leftmost pair of least rank: the pair's rank is found in a hash table of packed pairs, the two
cells become one, and rows without a mergeable pair leave the matrix.  Only the two ranks beside a merge are looked up
again.  Pre-tokens of more than ``LONG`` bytes, where a round per merge would cost the square of the length, are merged
with a heap; the result is the same.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from umbrascan.llm.pretokens import Splitter, once
from umbrascan.llm.shared import binaries, by_rows, strings

NONE = np.int32(2**31 - 1)
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512)
LONG = WIDTHS[-1]
SLICE_CHARS = 2_000_000


class PairTable:
    """(left id, right id) -> rank of the joined token: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where the pair doesn't merge or the right cell is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Bpe:
    """A rank file: merging, and the bytes of each id."""

    def __init__(self, path: str, pattern: str, limit: int = 400_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (a, b, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None
        ]
        left, right, rank = np.array(pairs, np.int64).T
        self.pairs = PairTable((left << 32) | right, rank.astype(np.int32))
        self.split = Splitter(pattern).split
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of at most ``width`` bytes."""
        size = np.array([len(p) for p in pieces])
        cells = np.full((len(pieces), width), -1, np.int32)
        cells[np.arange(width) < size[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(pieces), width - 1)
        out, row = [b""] * len(pieces), np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                ended = cells[done]
                real = ended >= 0
                packed, ends = ended[real].astype("<u4").tobytes(), np.cumsum(real.sum(1)) * 4
                for i, a, b in zip(row[done].tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    out[i] = packed[a:b]
                cells, ranks, row, at, best = cells[~done], ranks[~done], row[~done], at[~done], best[~done]
                if not len(row):
                    break
            width, line = cells.shape[1] - 1, np.arange(len(row))
            cells[line, at] = best
            cells = cells[np.arange(width + 1) != (at + 1)[:, None]].reshape(-1, width)
            ranks = ranks[np.arange(width + 1) != at[:, None]].reshape(-1, width)
            after = np.minimum(at + 1, width - 1)
            ranks[line, at] = np.where(at + 1 < width, self.pairs.find(best, cells[line, after]), NONE)
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.pairs.find(cells[inner, at[inner] - 1], best[inner])
            used = int((cells >= 0).sum(1).max())
            if used < width:
                cells, ranks = cells[:, :used], ranks[:, :used]
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges on a linked list, least rank and then leftmost first."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(len(ids) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] else len(ids)
            if j >= len(ids) or rank(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            ids[i], parts[j], after[i] = r, b"", after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (x := rank(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank(parts[before[i]] + parts[i])) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([i for i, p in zip(ids, parts) if p], "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Merges pre-tokens that are not in the cache yet."""
        if len(self.known) + len(pieces) > self.limit:
            self.known = {}
        lines: dict[int, list[tuple[str, bytes]]] = {w: [] for w in WIDTHS}
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[piece] = self.merge_long(raw)
            else:
                lines[next(w for w in WIDTHS if len(raw) <= w)].append((piece, raw))
        for width, line in lines.items():
            step = max(1, 4_000_000 // width)
            for at in range(0, len(line), step):
                part = line[at : at + step]
                self.known.update(zip((p for p, _ in part), self.merge_matrix([r for _, r in part], width)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self.split(t) for t in texts[at:end]]
            new = set().union(*split).difference(self.known)
            if len(self.known) + len(new) > self.limit:
                self.known, new = {}, set().union(*split)
            self.learn(list(new))
            out += [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
            at = end
        return out

    def decode(self, packed: list[bytes]) -> list[bytes]:
        return [b"".join(map(self.bytes_of.__getitem__, np.frombuffer(p, "<u4").tolist())) for p in packed]


def encode(
    df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``key`` and the packed ids of every whole text, as the ``tiktoken`` library gives them without special tokens.

    ``decoded`` names a column for the bytes read back from the ids, in the same pass.  A null or empty text has empty
    ids; repeated rows and null keys stay as they are; other columns are not carried.
    """
    kind = df.schema[key].dataType
    out = f"{ids} binary" + (f", {decoded} binary" if decoded else "")

    def work(batch: pa.RecordBatch):
        bpe = once(("bpe", path, pattern), lambda: Bpe(path, pattern))
        packed = bpe.encode(strings(batch.column(1)))
        back = [binaries(bpe.decode(packed))] if decoded else []
        names = [key, ids, *([decoded] if decoded else [])]
        yield pa.RecordBatch.from_arrays([batch.column(0), binaries(packed), *back], names)

    return df.select(F.col(key), F.col(text)).mapInArrow(by_rows(work), f"`{key}` {kind.simpleString()}, {out}")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns but ``out``, and the bytes of the packed ids; null ids give empty bytes."""
    rest = df.drop(out)
    schema = StructType([*rest.schema.fields, StructField(out, BinaryType())])
    at = rest.columns.index(ids)

    def work(batch: pa.RecordBatch):
        bpe = once(("bpe", path, pattern), lambda: Bpe(path, pattern))
        back = binaries(bpe.decode([x or b"" for x in batch.column(at).to_pylist()]))
        yield pa.RecordBatch.from_arrays([*batch.columns, back], schema.names)

    return rest.mapInArrow(by_rows(work), schema)
