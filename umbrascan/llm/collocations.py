"""Phrases whose words stand together more often than their parts do, by top-order marginalisation.

Every word position gives one window: the word and the next ones as lead columns, padded where the piece ends.  Only these
longest windows are counted; ``ROLLUP`` over the columns then sums them into the counts of all shorter prefixes, so no
length but the longest is ever taken from the texts.

A window ends early where a longer phrase from there cannot occur ``least`` times.  That is decided by hashed arrays of fixed
size, whose cells are upper bounds: the first pass counts words and pairs of neighbours, the second one longer phrases all of
whose pairs may be frequent.  Windows only lose words that no phrase needs, so the counts that are kept stay exact, whatever
the arrays hold.  An array is ``2 ** CELLS`` saturating bytes a task and one bit a cell when shared, at any input.  Its
cells fill up with rare pairs at some 1e10 words; from there on ever more windows travel at full length, with the same results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from umbrascan.llm.hot_joins import join_hot
from umbrascan.llm.shared import stored

CELLS, CHUNK = 26, 18
#: words that a task holds before it sums them up
HELD = 3 << 20
#: distinct windows that a task holds before it gives them out
KEPT = 2 << 20
#: tasks a core that read the texts
TASKS = 2
#: marks the end of a piece; no byte of UTF-8 text
BREAK = b"\xff"
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", BREAK * 10 + b"abcdefghijklmnopqrstuvwxyz")
_WORD, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Codes(dict):
    """Numbers words in the order of their first sight; 0 is a break."""

    def __init__(self):
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with ``BREAK`` between pieces."""
    return text.translate(_BREAKS).replace(BREAK, b" \xff ").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _cells(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELLS)).astype(np.int64)


def _longer(x: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return _mixed((x ^ (x >> np.uint64(29))) * _PAIR + word * _WORD)


class Bits:
    """Which cells may hold frequent phrases."""

    def __init__(self, packed: bytes):
        self.packed = np.frombuffer(packed, np.uint8)

    def of(self, x: np.ndarray) -> np.ndarray:
        cells = _cells(x)
        return (self.packed[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.uint64, list[bytes], np.ndarray, np.ndarray]]:
    """(lang, text) rows -> per language and at most some HELD words: the language, its hash, words, their hashes, codes in
    order with breaks between pieces.  A longer text is one run of its own."""
    held: dict[str, tuple[Codes, list[np.ndarray]]] = {}

    def run(lang: str):
        codes, parts = held.pop(lang)
        words = list(codes)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        return lang, np.uint64(xxhash.xxh64_intdigest(lang)), words, hashes, np.concatenate([*parts, [0]])

    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if (raw := text.as_py()) is None:
                continue
            codes, parts = held.setdefault(lang, (Codes(), []))
            seen = tokens(raw)
            parts.append(np.fromiter(map(codes.__getitem__, seen), np.int32, len(seen)))
            parts.append(np.zeros(1, np.int32))
            total += len(seen)
            if total >= HELD:
                for name in list(held):
                    yield run(name)
                total = 0
    for name in list(held):
        yield run(name)


def _starts(codes: np.ndarray, hashes: np.ndarray, lang: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words, and the hashes of the words there."""
    at = np.flatnonzero(codes)
    return at, _mixed(hashes[codes[at]] * _WORD + lang)


def _lengths(codes: np.ndarray, hashes: np.ndarray, lang: np.uint64, pairs: Bits, longer: Bits | None, longest: int, seen=None):
    """Positions of words that may be frequent, and for each the length of the longest phrase from there that may be.

    Without ``longer`` only pairs are looked at; ``seen`` is then called with the hashes of all phrases of three words and
    more whose pairs may be frequent.
    """
    at, x = _starts(codes, hashes, lang)
    length = np.zeros(len(codes) + 1, np.int8)
    often = pairs.of(x)
    length[at[often]] = 1
    joined = np.zeros(len(codes) + 1, bool)
    two = at[codes[np.minimum(at + 1, len(codes) - 1)] != 0]
    joined[two] = pairs.of(_longer(x[np.searchsorted(at, two)], hashes[codes[two + 1]]))
    on, x = at[often], x[often]
    for k in range(2, longest + 1):
        keep = joined[on + k - 2]
        on, x = on[keep], _longer(x[keep], hashes[codes[on[keep] + k - 1]])
        if k > 2:
            if seen is not None:
                seen(x)
            else:
                keep = longer.of(x)
                on, x = on[keep], x[keep]
        length[on] = k
    for _ in range(longest - 1):  # the rest of a frequent phrase is frequent
        length[:-1] = np.minimum(length[:-1], length[1:] + 1)
    return np.flatnonzero(length[:-1]), length


def _added(total: np.ndarray, x: np.ndarray, least: int) -> None:
    cells = _cells(x)
    cells.sort()
    edges = np.flatnonzero(np.diff(cells, prepend=-1))
    counts = np.diff(edges, append=len(cells))
    total[cells[edges]] = np.minimum(least, total[cells[edges]] + counts)


def _sketch(least: int, longest: int, pairs: bytes | None):
    """(lang, text) -> words per language, and chunks of the task's cells, each at most ``least``.

    The first pass counts words and pairs; with their bits, ``pairs``, the second one counts longer phrases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.uint8)
        n: dict[str, int] = {}
        bits = Bits(pairs) if pairs else None
        for lang, salt, _, hashes, codes in _runs(batches):
            if bits:
                _lengths(codes, hashes, salt, bits, None, longest, lambda x: _added(total, x, least))
                continue
            at, x = _starts(codes, hashes, salt)
            n[lang] = n.get(lang, 0) + len(at)
            _added(total, x, least)
            two = codes[at + 1] != 0
            _added(total, _longer(x[two], hashes[codes[at[two] + 1]]), least)
        names, kinds = ["lang", "n", "chunk", "cells"], [pa.string(), pa.int64(), pa.int32(), pa.binary()]
        rows = [(k, v, None, None) for k, v in n.items()]
        for i in range(1 << (CELLS - CHUNK)):
            part = total[i << CHUNK : (i + 1) << CHUNK]
            if part.any():
                rows.append((None, None, i, zlib.compress(part.tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def _summed(least: int):
    """Chunks in order of their number -> one bit a cell: whether it holds ``least`` over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, np.zeros(1 << CHUNK, np.uint16)

        def row() -> pa.RecordBatch:
            bits = np.packbits(total >= least).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            for i, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i != chunk:
                    if chunk is not None:
                        yield row()
                    chunk, total = i, np.zeros(1 << CHUNK, np.uint16)
                total = np.minimum(least, total + np.frombuffer(zlib.decompress(cells.as_py()), np.uint8))
        if chunk is not None:
            yield row()

    return run


def _distinct(lead: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as columns of ``lead``, at least one -> each once, with the sum of its counts."""
    order = np.lexsort(lead[::-1])
    lead = lead[:, order]
    edges = np.flatnonzero(np.concatenate([[True], (np.diff(lead, axis=1) != 0).any(axis=0)]))
    return lead[:, edges], np.add.reduceat(counts[order], edges)


class Kept:
    """A language's distinct windows over several runs; its codes number only words of windows."""

    def __init__(self):
        self.codes, self.parts = Codes(), []

    def __len__(self) -> int:
        return sum(len(counts) for _, counts in self.parts)

    def add(self, words: list[bytes], lead: np.ndarray, counts: np.ndarray) -> None:
        used = np.unique(lead)
        codes = np.zeros(len(words), np.int32)
        codes[used] = [self.codes[words[i]] for i in used]
        self.parts.append((codes[lead], counts))

    def merge(self) -> None:
        if len(self.parts) > 1:
            lead, counts = zip(*self.parts)
            self.parts = [_distinct(np.concatenate(lead, axis=1), np.concatenate(counts))]


def _windows(pairs: bytes, longer: bytes, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) -> distinct windows of a task with their counts; lead columns are empty where a window is padded.

    A task merges the windows of its runs and gives each out once, unless it holds more than KEPT of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, more = Bits(pairs), Bits(longer)
        names = ["lang", *(f"w{i + 1}" for i in range(longest)), "n"]
        kept: dict[str, Kept] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang in list(kept):
                held = kept.pop(lang)
                held.merge()
                names_of = pa.array([b"", *list(held.codes)[1:]], pa.binary()).cast(pa.string())
                for lead, counts in held.parts:
                    for at in range(0, len(counts), 20_000):
                        some = lead[:, at : at + 20_000]
                        lang_column = pa.array([lang] * some.shape[1], pa.string())
                        columns = [names_of.take(pa.array(codes)) for codes in some]
                        yield pa.RecordBatch.from_arrays([lang_column, *columns, pa.array(counts[at : at + 20_000], pa.int64())], names)

        for lang, salt, words, hashes, codes in _runs(batches):
            start, length = _lengths(codes, hashes, salt, two, more, longest)
            if not len(start):
                continue
            padded = np.concatenate([codes, np.zeros(longest, codes.dtype)])
            lead = np.stack([np.where(length[start] > i, padded[start + i], 0) for i in range(longest)])
            kept.setdefault(lang, Kept()).add(words, *_distinct(lead, np.ones(len(start), np.int64)))
            if sum(map(len, kept.values())) > KEPT:
                for held in kept.values():
                    held.merge()
                if sum(map(len, kept.values())) > KEPT // 2:
                    yield from rows()
        yield from rows()

    return run


def _bits(sketched: DataFrame, least: int) -> bytes:
    """One bit a cell, at any size of the input."""
    chunks = sketched.filter("chunk IS NOT NULL").select("chunk", "cells").repartition("chunk").sortWithinPartitions("chunk")
    frequent = np.zeros((1 << (CELLS - CHUNK), 1 << (CHUNK - 3)), np.uint8)
    for row in chunks.mapInArrow(_summed(least), "chunk int, bits binary").toLocalIterator():
        frequent[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return frequent.tobytes()


def _dealt(texts: DataFrame) -> DataFrame:
    """``texts`` in at most TASKS tasks a core.

    Every task gives out its cells and the frequent phrases that it sees.  With a task for each split of the files, both grow
    with the tasks times the frequent phrases; with tasks by cores only with the phrases.  Where executors come and go, the
    cores are not known, and the splits stay.
    """
    spark = texts.sparkSession
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return texts
    return texts.coalesce(TASKS * spark.sparkContext.defaultParallelism)


def phrase_counts(texts: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, text as bytes) -> (lang, phrase, k, a) of 1 to ``longest`` words with a >= ``least``, and (lang, n)."""
    texts = _dealt(texts)
    shape = "lang string, n long, chunk int, cells binary"
    sketched = stored(texts.mapInArrow(_sketch(least, longest, None), shape), "sketch")
    totals = sketched.filter("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = _bits(sketched, least)
    longer = _bits(stored(texts.mapInArrow(_sketch(least, longest, pairs), shape), "sketch"), least)
    columns = [f"w{i + 1}" for i in range(longest)]
    schema = "lang string, " + ", ".join(f"{c} string" for c in columns) + ", n long"
    windows = texts.mapInArrow(_windows(pairs, longer, longest), schema)
    counted = windows.groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    level = (F.lit(longest) - F.bit_count(F.grouping_id())).cast("int")
    rolled = counted.rollup("lang", *columns).agg(level.alias("k"), F.sum("n").alias("a")).filter(F.col("a") >= least)
    words = F.expr(f"slice(array({', '.join(columns)}), 1, k)")
    whole = rolled.filter("k > 0").withColumn("words", words).filter(F.element_at("words", -1) != "")
    return stored(whole.select("lang", F.array_join("words", " ").alias("phrase"), "k", "a"), "phrases"), totals


def score() -> Column:
    """floor(1000 * a * n / (l * r)) of long columns, exact while both products have at most 38 digits."""
    whole = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    return F.expr(f"CAST(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * {whole('n')} AS DECIMAL(38,0)) DIV ({whole('l')} * {whole('r')})")


def phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, inside: int = 100
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks (U+000A to U+000D), and pieces into words at spaces
    and tabs.  A phrase has 2 to ``longest`` words and a >= ``least`` occurrences; cut in two, its score is
    floor(1000 * a * n / (l * r)) for the counts l and r of the parts and n words of the language, and the lowest cut, of equal
    ones the first, counts.  Phrases inside a longer one with 100 * f(longer) >= ``inside`` * a are dropped.  Ranks are by score,
    then a, then the phrase's UTF-8 bytes.  A null language is ``und``, a null text empty; repeated rows count; an empty
    table, or one without frequent phrases, gives no rows.  Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    counts, totals = phrase_counts(texts, least, longest)
    name = lambda phrase: F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), phrase)
    known = counts.select(name(F.col("phrase")).alias("key"), "a")
    candidates = counts.filter("k > 1").withColumns({"words": F.split("phrase", " "), "id": F.xxhash64("lang", "phrase")})

    cuts = candidates.select("lang", "phrase", "k", "a", "words", "id", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    part = lambda words: name(F.array_join(F.expr(words), " "))
    cuts = stored(cuts.withColumns({"key": part("slice(words, 1, cut)"), "rest": part("slice(words, cut + 1, k - cut)")}).drop("words"), "cuts")
    left = join_hot(cuts, known.withColumnRenamed("a", "l"), "key", "id", "inner").drop("key")
    both = join_hot(stored(left, "left-parts"), known.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest", "id", "inner")
    scored = both.join(totals, "lang")
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score().alias("score"), "cut", "l", "r", "a", "n")).alias("low"))

    spans = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(words, i, s), ' '))))")
    longer = candidates.filter("k > 2").select("lang", F.col("a").alias("f"), F.explode(spans).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = lowest.select("lang", "phrase", "low.*").join(around, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("f").isNull() | (F.lit(100) * F.col("f") < F.lit(inside) * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    local = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(local)).filter(F.col("rank") <= top)  # a part's first rows hold all that the whole needs
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
