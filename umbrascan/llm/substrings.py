"""Removal of passages that repeat across documents, by suffix automata of reference shards.

The reference of a document is every document with a smaller key, so the reference grows with the corpus and can't be
sent to all tasks.  It is cut into shards by anchors: the least hash of a run of ``GRAM`` words inside a window names
the window's shard, so equal windows always share a shard.  Consecutive windows of one anchor are a segment.  A shard
holds the distinct segments of an anchor; its automaton takes them in ascending order of their first document, and every
segment is streamed through it for matching statistics before it is added: where the match is as long as a window and
its first document is smaller, the window repeats.  Copies of a segment are counted before anything is moved, so a
passage in very many documents is one segment.  An anchor with more than ``CROWD`` distinct segments (the edge of a
common passage) would make a shard of unbounded size; its windows are compared one by one, by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from umbrascan.llm.shared import binaries, stored
from umbrascan.llm.shingles import BASE, grams, mixed, word_hashes

WINDOW, GRAM, CROWD = 50, 8, 64
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class Automaton:
    """A suffix automaton of word sequences added in ascending order of document; a state knows its first document."""

    def __init__(self):
        self.next, self.link, self.size, self.first = [{}], [-1], [0], [None]

    def _state(self, size: int, first, link: int, step: dict) -> int:
        self.next.append(step)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state for the part of ``q`` that ends the sequences of ``p`` and ``word``."""
        part = self._state(self.size[p] + 1, self.first[q], self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def add(self, words: list, doc) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.size[last] + 1, doc, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            last = new

    def repeats(self, words: list, doc, window: int) -> list[int]:
        """Starts of the windows of ``words`` that a smaller document holds."""
        state = length = 0
        out = []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= window:
                while self.size[self.link[state]] >= window:
                    state = self.link[state]
                length = min(length, self.size[state])
                if self.first[state] < doc:
                    out.append(i - window + 1)
        return out


def prefix_sums(hashes: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """What ``run_hash`` needs: sums of hashes times falling powers of an odd base, and the rising powers."""
    n = len(hashes)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    power = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]))
    down, up = power(inverse), power(base)
    return np.concatenate([[np.uint64(0)], np.add.accumulate(hashes * down[:n])]), up


def run_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start up to end."""
    total, up = sums
    return mixed((total[end] - total[start]) * up[start] + (end - start).astype(np.uint64))


def _spots(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for doc, version, raw in zip(*(part.column(i).to_pylist() for i in range(3))):
                    words = raw.split()
                    if len(words) < window:
                        continue
                    hashes = word_hashes(words)
                    runs = grams(hashes, GRAM)
                    starts = np.arange(len(words) - window + 1)
                    anchor = np.lib.stride_tricks.sliding_window_view(runs, window - GRAM + 1).argmin(axis=1) + starts
                    first = np.flatnonzero(np.diff(anchor, prepend=-1))
                    n = np.diff(np.append(first, len(starts)))
                    seg = run_hash(prefix_sums(hashes, BASE), first, first + n + window - 1)
                    values = (np.full(len(n), doc), np.full(len(n), version), runs[anchor[first]].view(np.int64), seg.view(np.int64), first, n)
                    for column, value in zip(rows, values):
                        column.append(value)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in rows], ["doc", "version", "anchor", "seg", "at", "n"])

    return run


def _segments(window: int):
    """(raw, wanted) -> the words of wanted segments; of crowded anchors, two hashes of each window instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "seg", "first", "offset", "one", "two", "words"]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            for row in range(batch.num_rows):
                doc, raw, wanted = (batch.column(i)[row].as_py() for i in range(3))
                words, out = raw.split(), []
                sums = None
                for w in wanted:
                    at, n = w["at"], w["n"]
                    if not w["crowd"]:
                        out.append((w["anchor"], w["seg"], doc, 0, None, None, b" ".join(words[at : at + n + window - 1])))
                        continue
                    if sums is None:
                        hashes = word_hashes(words)
                        sums = [prefix_sums(hashes, b) for b in (BASE, OTHER)]
                    starts = np.arange(at, at + n)
                    one, two = (run_hash(s, starts, starts + window).view(np.int64).tolist() for s in sums)
                    out += [(w["anchor"], w["seg"], doc, i, one[i], two[i], None) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _shards(window: int):
    """Segments in order of anchor and first document -> their repeated windows, as offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, None
        for batch in batches:
            out = []
            for anchor, seg, first, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if anchor != shard:
                    shard, automaton = anchor, Automaton()
                words = raw.split(b" ")
                out += [(anchor, seg, i) for i in automaton.repeats(words, first, window)]
                automaton.add(words, first)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "seg", "offset"])

    return run


def _cut(text_at: int, window: int, names: list[str]):
    """Adds n_words, n_removed and kept; spans of windows (at, n) are the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                total, removed, kept = [], [], []
                for raw, spans in zip(part.column(text_at).cast(pa.binary()).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    words = (raw or b"").split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    for span in spans or ():
                        edge[span["at"]] += 1
                        edge[span["at"] + span["n"] + window - 1] -= 1
                    out = np.cumsum(edge[:-1]) > 0
                    gone = int(out.sum())
                    total.append(len(words))
                    removed.append(gone)
                    kept.append(b" ".join(words if not gone else [w for w, x in zip(words, out.tolist()) if not x]).decode())
                columns = [*part.columns[:-1], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_windows(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(doc, version, at, n): runs of windows that also start in a document with a smaller key.

    ``version`` is a hash of the text, so that rows which repeat a key with other texts keep apart.
    """
    raw = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).cast("binary").alias("raw"))
    raw = raw.filter("doc IS NOT NULL AND raw IS NOT NULL")
    spots = stored(raw.mapInArrow(_spots(window), "doc long, version long, anchor long, seg long, at long, n long"), "spots")

    segs = spots.groupBy("anchor", "seg").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    anchors = segs.groupBy("anchor").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("variants")).filter("lo < hi")
    useful = segs.join(anchors.select("anchor", "variants"), "anchor").filter("variants > 1 OR last > first")
    hits = stored(spots.join(useful.select("anchor", "seg", "first", "variants"), ["anchor", "seg"]), "hits")
    copies = hits.filter("doc > first").select("doc", "version", "at", "n")
    own = hits.filter("doc = first AND variants > 1")

    # one holder of each distinct segment gives its words
    heads = own.dropDuplicates(["anchor", "seg"]).withColumn("crowd", F.col("variants") > CROWD)
    wanted = heads.groupBy("doc", "version").agg(F.collect_list(F.struct("anchor", "seg", "at", "n", "crowd")).alias("wanted"))
    rows = raw.join(wanted, ["doc", "version"]).select("doc", "raw", "wanted")
    segments = rows.mapInArrow(_segments(window), "anchor long, seg long, first long, offset long, one long, two long, words binary")
    segments = stored(segments, "segments")

    shards = segments.filter("words IS NOT NULL").select("anchor", "seg", "first", "words")
    streamed = shards.repartition("anchor").sortWithinPartitions("anchor", "first", "seg")
    found = streamed.mapInArrow(_shards(window), "anchor long, seg long, offset long")
    windows = segments.filter("words IS NULL").select("anchor", "seg", "first", "offset", "one", "two")
    earliest = windows.groupBy("one", "two").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most")
    single = windows.join(earliest, ["one", "two"]).filter("least < first").select("anchor", "seg", "offset")
    offsets = found.union(single).groupBy("anchor", "seg").agg(F.collect_set("offset").alias("offsets"))  # at most WINDOW - GRAM + 1
    edges = own.join(offsets, ["anchor", "seg"]).select("doc", "version", F.explode("offsets").alias("o"), "at")
    return copies.union(edges.select("doc", "version", F.col("at") + F.col("o"), F.lit(1).cast("long")))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, out: tuple[str, str, str] = ("n_words", "n_removed", "kept")
) -> DataFrame:
    """All columns of ``docs``, and three more, ``out``: numbers of words, of removed words, and the words that stay, joined by one space.

    Words are runs of characters other than ASCII white space, unchanged.  A word goes if a window of ``window``
    consecutive words covers it that, as a whole, also starts in a document with a smaller key; windows are judged on
    the input, not on what is left.  A null or empty text has no words.  Rows of a null key neither lose words nor serve
    as reference; rows that repeat a key are no reference for each other.  Columns that have the names of
    ``out`` are replaced.  Keys must be integers.
    """
    docs = docs.drop(*out)
    found = repeated_windows(docs, key, text, window)
    spans = found.groupBy("doc", "version").agg(F.collect_list(F.struct("at", "n")).alias("__spans"))
    marked = docs.withColumn("__doc", F.col(key).cast("long")).withColumn("__version", F.xxhash64(text))
    spans = spans.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), "__spans")
    joined = marked.join(spans, ["__doc", "__version"], "left").select(*[marked[c] for c in docs.columns], "__spans")
    added = [StructField(name, kind) for name, kind in zip(out, (LongType(), LongType(), StringType()))]
    schema = StructType([*docs.schema.fields, *added])
    return joined.mapInArrow(_cut(docs.columns.index(text), window, schema.names), schema)
