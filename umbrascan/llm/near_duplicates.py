"""Near-duplicate documents by HyperMinHash.

A document's shingle hashes fall into 2**7 buckets; a bucket's register keeps of its least hash the number of leading
zeros and ten bits after them, 16 bits in all.  Four registers are a band, and documents that share a band are
candidates.  The share of equal registers, less the collisions expected of compressed registers, estimates the Jaccard
similarity; pairs six deviations below the threshold are given up, the others are confirmed on full shingle sets.

Documents of equal sets are one class from the start.  In a first round every class is tried with the first class of each of
its bands, in one of PIVOTS orders, which joins a group of copies in at most PIVOTS times as many pairs as it has members,
even if one of these classes is far from the others.  In a second round bands that still
hold several components compare all classes across components, in blocks of bounded rows and bytes of shingle hashes (a single
document beyond that is a block's only excess): a first pass over registers
names the classes of a block that have a likely partner there, a second one confirms on their full sets and reports only
the links that join components.  No pass makes a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrascan.llm.components import components
from umbrascan.llm.shared import binaries, stored
from umbrascan.llm.shingles import shingle_set

BUCKET_BITS, MANTISSA, ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
EMPTY = 0xFFFF
PIVOTS = 4
#: most rows, and expected bytes of shingle hashes, of each side of a block
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: expected equal registers of two unrelated sets, as a share of 2**BUCKET_BITS / 2**MANTISSA
COLLISION = 0.169919487159739


def registers(hashes: np.ndarray) -> np.ndarray:
    """Compressed minima of sorted distinct 64-bit hashes; ``EMPTY`` where a bucket has none."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    first = np.searchsorted(hashes, edges)
    ends = np.append(first[1:], len(hashes))
    used = np.flatnonzero(first < ends)
    rest = hashes[first[used]] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    part, power = np.frexp(rest.astype(np.float64))
    zeros = 64 - BUCKET_BITS - power
    out[used] = (zeros << MANTISSA) + np.maximum(0, (part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return out


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float) -> np.ndarray:
    """Whether register rows may belong to sets of similarity ``least``: the estimate is not six deviations below."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    ratio = np.maximum(size_a, size_b) / np.maximum(1, np.minimum(size_a, size_b))
    chance = COLLISION * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    used = np.maximum(1, used)
    return (same - chance) / used >= least - 6 * np.sqrt(least * (1 - least) / used) - 1 / used


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, marks, regs = [], [], []
                for raw in part.column(2).to_pylist():
                    hashes = shingle_set((raw or b"").lower().split(), words)
                    sizes.append(len(hashes))
                    marks.append(xxhash.xxh128_digest(hashes.tobytes()) if len(hashes) else None)
                    regs.append(registers(hashes).tobytes() if len(hashes) else None)
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc", "n_shingles", "mark", "regs"])

    return run


def _salted(keys: np.ndarray, band: np.ndarray) -> np.ndarray:
    """One number for a band and its registers."""
    h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + band.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, regs, n) -> a row per band that isn't empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            reps, sizes = np.asarray(part.column(0)), np.asarray(part.column(2))
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64).reshape(len(reps), BANDS)
            row, band = np.nonzero(keys != -1)
            yield pa.RecordBatch.from_arrays([pa.array(_salted(keys[row, band], band)), pa.array(reps[row]), pa.array(sizes[row])], ["band", "rep", "n"])


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (2, 3))
                keep = likely(a, b, np.asarray(part.column(4)), np.asarray(part.column(5)), least)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


class Block:
    """Askers and members of one band, with registers and perhaps full sets; ``both`` marks members that also ask."""

    def __init__(self, t: pa.Table):
        self.rep, self.comp, self.n, self.asks, self.both = (np.asarray(t[c]) for c in ("rep", "component", "n_shingles", "asks", "both"))
        self.regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        self.keys = self.regs.view(np.int64)
        salted = _salted(self.keys[0], np.arange(BANDS))
        self.slot = int(np.flatnonzero(salted == t["band"][0].as_py())[0])

    def likely(self, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Askers and their likely partners of other components.  A pair is taken in the first band that it shares, and
        of two askers by the smaller."""
        members = np.flatnonzero(~self.asks)
        for i in np.flatnonzero(self.asks).tolist():
            near = np.minimum(self.n[members], self.n[i]) >= least * np.maximum(self.n[members], self.n[i])
            near &= (self.comp[members] != self.comp[i]) & ~(self.both[members] & (self.rep[members] < self.rep[i]))
            others = members[near]
            others = others[likely(self.regs[others], self.regs[i], self.n[others], self.n[i], least)]
            shared = (self.keys[others] == self.keys[i]) & (self.keys[i] != -1)
            others = others[shared.argmax(axis=1) == self.slot]
            if len(others):
                yield i, others


def _by_block(work, names: list[str], kinds: list[pa.DataType]):
    """Rows in order of (band, i, j) -> ``work`` on each such block, which has some ``2 * BLOCK`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(t: pa.Table) -> np.ndarray:
            keys = np.stack([np.asarray(t[c]).astype(np.int64) for c in ("band", "i", "j")])
            return np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1

        def solved(t: pa.Table):
            edges = [0, *marks(t).tolist(), t.num_rows]
            for x, y in zip(edges, edges[1:]):
                columns = work(t.slice(x, y - x))
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                t = pa.Table.from_batches([batch.slice(at, 256)])
                held = pa.concat_tables([held, t]) if held is not None else t
                if len(ends := marks(held)):  # the last block may go on in the next batch
                    yield from solved(held.slice(0, int(ends[-1])))
                    held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            yield from solved(held)

    return run


def _involved(least: float):
    """The rows of a block that have a likely partner there."""

    def work(t: pa.Table):
        used = np.zeros(t.num_rows, bool)
        for i, others in Block(t).likely(least):
            used[i] = True
            used[others] = True
        kept = t.filter(pa.array(used))
        return [kept[c].combine_chunks() for c in ("band", "i", "j", "rep", "component", "asks", "both")]

    return work


def _joining(least: float, percent: int):
    """Links of a block, confirmed on full sets, that join components of it."""

    def work(t: pa.Table):
        block, lists = Block(t), t["hashes"].combine_chunks()
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        sets = [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        home: dict[int, int] = {}

        def root(x: int) -> int:
            while home.get(x, x) != x:
                x = home[x]
            return x

        u, v = [], []
        for i, others in block.likely(least):
            sizes = np.array([len(sets[o]) for o in others])
            joined = np.concatenate([sets[o] for o in others])
            at = np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
            for o in others[both * 100 >= percent * (sizes + len(sets[i]) - both)].tolist():
                x, y = root(int(block.comp[i])), root(int(block.comp[o]))
                if x != y:
                    home[max(x, y)] = min(x, y)
                    u.append(int(block.rep[i]))
                    v.append(int(block.rep[o]))
        return [u, v]

    return work


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set((raw or b"").lower().split(), words) for raw in part.column(1).to_pylist()]
                marks = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
                lists = pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), binaries(marks), lists], ["doc", "mark", "hashes"])

    return run


def _full_sets(reps: DataFrame, texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(rep, hashes) of the classes in ``reps``."""
    wanted = reps.distinct().join(classes.select("rep", "doc", "mark"), "rep")
    raw = texts.join(wanted.select("doc"), "doc", "left_semi")
    sets = raw.mapInArrow(_sets(words), "doc long, mark binary, hashes array<long>")
    return stored(sets.join(wanted, ["doc", "mark"]).dropDuplicates(["rep"]).select("rep", "hashes"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough, as links (u, v)."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
    return sized.filter(F.col("i") * 100 >= percent * (F.col("s") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, row: str | None = None
) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id (smallest key reachable over links) and kept.

    Documents are linked if their sets of ``words``-word shingles, of words between ASCII white space with A-Z lowered,
    have a Jaccard similarity of ``percent`` per cent or more.  A document of fewer words is one shingle; one without
    words, or with a null text, is linked with nothing.  Rows of a null key take no part: they have a null component and
    are kept.  Rows that repeat a key count as documents of their own: each has the component of its own text, and of a
    component's rows of its smallest key one is kept.  Keys must be integers; other columns are not carried, but for
    ``row``, a column of distinct integers to tell rows of one key apart.
    """
    least = percent / 100
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    raw = docs.select(number.alias("row"), F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("raw"))
    sketched = stored(raw.mapInArrow(_sketch(words), "row long, doc long, n_shingles long, mark binary, regs binary"), "sketches")
    part = sketched.filter("doc IS NOT NULL AND mark IS NOT NULL")
    firsts = part.groupBy("mark").agg(F.min(F.struct("doc", "row")).alias("first")).select("mark", "first.*")
    classes = part.join(firsts, ["mark", "doc", "row"])  # a class has a number of its own: one key may begin several
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    rows = classes.select("rep", "regs", "n_shingles").mapInArrow(_bands, "band long, rep long, n long")
    shared = rows.groupBy("band").agg(F.min_by("rep", F.xxhash64("rep", F.pmod("band", F.lit(PIVOTS)))).alias("pivot"), F.count("*").alias("reps")).filter("reps > 1").drop("reps")
    bands = stored(rows.join(shared, "band"), "bands")
    pairs = bands.filter("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    side = lambda name, regs, n: classes.select(F.col("rep").alias(name), F.col("regs").alias(regs), F.col("n_shingles").alias(n))
    known = pairs.join(side("a", "x", "p"), "a").join(side("b", "y", "q"), "b").select("a", "b", "x", "y", "p", "q")
    stars = stored(known.mapInArrow(_estimated(least), "a long, b long"), "pairs")
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("raw"))
    sets = _full_sets(stars.select(F.col("a").alias("rep")).union(stars.select("b")), texts, classes, words)
    links = stored(_confirmed(stars, sets, percent), "links")
    joined = components(links)

    # second round: bands whose classes are still of several components
    labelled = bands.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
    main = joined.select(F.col("node").alias("pivot"), F.col("component").alias("main"))
    labelled = labelled.join(main, "pivot", "left").withColumn("asks", F.col("component") != F.coalesce("main", "pivot"))
    blocks = lambda n, hashes: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(hashes * 8 / BLOCK_BYTES)).cast("int")
    still = labelled.groupBy("band").agg(
        F.count("*").alias("size"),
        F.count_if("asks").alias("askers"),
        blocks(F.count_if("asks"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0))).alias("is"),
        blocks(F.count("*"), F.sum("n")).alias("js"),
    )
    still = still.filter("askers > 0 AND size > 2").drop("askers", "size")  # a pair was tried with its pivot
    split = stored(labelled.select("band", "rep", "component", "asks").join(still, "band"), "open-bands")
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    askers = split.filter("asks").withColumns({"both": F.lit(False), "i": place("is"), "j": every("js")})
    members = split.withColumns({"both": F.col("asks"), "i": every("is"), "j": place("js")}).withColumn("asks", F.lit(False))
    shape = ["band", "i", "j", "rep", "component", "asks", "both"]
    sketch = classes.select("rep", "regs", "n_shingles")
    in_blocks = lambda df: df.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    meeting = in_blocks(askers.select(shape).union(members.select(shape)).join(sketch, "rep"))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    schema = "band long, i int, j int, rep long, component long, asks boolean, both boolean"
    involved = stored(meeting.mapInArrow(_by_block(_involved(least), shape, kinds), schema), "involved")
    if not involved.isEmpty():
        sets = _full_sets(involved.select("rep"), texts, classes, words)
        full = in_blocks(involved.join(sketch, "rep").join(sets, "rep"))
        more = full.mapInArrow(_by_block(_joining(least, percent), ["u", "v"], [pa.int64(), pa.int64()]), "u long, v long")
        joined = components(links.union(more))

    found = classes.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select("mark", F.coalesce("component", "rep").alias("component"), F.struct("doc", "row").alias("first"))
    least = found.groupBy("component").agg(F.min("first").alias("least"))
    found = found.join(least, "component").select("mark", "least")
    out = sketched.select("row", "doc", "n_shingles", "mark").join(found, "mark", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("least.doc", "doc"))
    kept = F.col("doc").isNull() | F.coalesce((F.col("doc") == F.col("least.doc")) & (F.col("row") == F.col("least.row")), F.lit(True))
    shown = [F.col("doc").alias(key), "n_shingles", component.alias("component_id"), kept.alias("kept")]
    return out.select(*shown, *([F.col("row").alias(row)] if row else []))
