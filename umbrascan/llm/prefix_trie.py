"""Shared prefixes of conversations as a z-fast trie.

A sequence of turns is a path of 128-bit hashes, one per prefix, each made of the hash before it and the turn.  The trie is
compacted: a node spans the depths (lo, depth] of its edge.  Its handle is the hash of the prefix whose length is the
2-fattest number of that range, the one that the highest power of two divides, and a table maps handles to nodes.  The exit
node of a path is found by fat binary search: the 2-fattest depth of the open range is looked up; a hit moves the lower end
to the node's depth, a miss the upper end below the depth tried, so a path of ``n`` turns takes about ``log2 n`` look-ups.

Paths are inserted in batches.  All pending paths are located at once; of those that leave the trie at the same place with
the same next turn the longest is inserted, with a split of the edge where it leaves in the middle; the others stay for the
next batch, in which they are located below that place only.  Sums over subtrees are taken on the compacted trie, from the
leaves upwards, and edges are expanded into their nodes at the very end.

Nothing is gathered per key: leaders, sums and child counts are combined before shuffles, look-ups of a hot handle are
salted, and every batch is a written table.  Batches are as many as the paths' nested branches, and upward rounds as many as
the compacted trie is high.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrascan.llm.hot_joins import join_hot
from umbrascan.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
NODE = ["extent", "top", "lo", "depth", "edge", "words"]
CHUNK = 1 << 14


def crc32_share(key: str, parts: int) -> Column:
    """crc32 of the decimal key, modulo ``parts``."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % parts).cast("int")


def rebuilt(rows: DataFrame, every: int = 20, parts: int = 4) -> DataFrame:
    """(conv_id, turns): conversations whose first turns come from the conversation at the start of their id's block.

    The first ``h`` turns of conversation ``c`` are those of ``c - c % every`` (all that it has, none if it is absent; ``%`` is
    SQL's, whose sign is that of ``c``), where ``h`` is crc32(decimal c) % parts; its own turns after its first ``h`` follow.  Turns are in order of ``turn``,
    null first; rows of equal ``turn`` in order of their digest, so repeated rows stay as turns of their own.  Null roles
    and texts are empty, rows of a null conv_id take no part, an empty table gives none.  A turn is (digest, words).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 32))
    turns = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t")
    )
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = stored(lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")), "turns")
    base = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, parts - 1).alias("first"))
    h = crc32_share("conv_id", parts)
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    first = F.slice(F.coalesce("first", F.expr("slice(turns, 1, 0)")), F.lit(1), h)
    return met.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, digests) -> (conv_id, hashes of all prefixes, the root's first)."""
    for batch in batches:
        paths = []
        for digests in batch.column(1).to_pylist():
            path = [ROOT]
            for d in digests:
                path.append(hashlib.blake2b(path[-1] + d, digest_size=16).digest())
            paths.append(path)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.binary()))], ["conv_id", "path"])


def paths(convs: DataFrame) -> DataFrame:
    """(conv_id, turns) -> (conv_id, path, words, end): hashes of all prefixes, words per turn, hash of the whole."""
    hashed = convs.select("conv_id", "turns.digest").mapInArrow(_paths, "conv_id long, path array<binary>")
    both = hashed.join(convs.select("conv_id", F.col("turns.words").alias("words")), "conv_id")
    return both.withColumn("end", F.element_at("path", -1))


def fattest(lo: str, hi: str) -> Column:
    """The number in (lo, hi] that the highest power of two divides."""
    return F.expr(f"CAST(shiftleft(shiftright({hi}, length(bin({lo} ^ {hi})) - 1), length(bin({lo} ^ {hi})) - 1) AS INT)")


def _located(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pending paths with ``lo`` at the end of a fat binary search and ``head``, the hash that starts the edge to look at.

    ``head`` is null if the path ends at a node.  The node found by a handle may reach beyond the path; then its own edge is
    the one that the path leaves, else that of its child, if there is one.
    """
    handles = nodes.withColumn("f", fattest("lo", "depth")).select(
        F.expr("edge[f - lo - 1]").alias("handle"), F.col("lo").alias("n_lo"), F.col("depth").alias("n_depth"), F.col("extent").alias("n_extent")
    )
    shape = ["rep", "path", "words", "lo", "hi", "head"]
    now = pending.withColumns({"hi": F.size("path") - 1, "head": F.get("path", F.col("lo") + 1)})
    done = None
    while True:
        finished = now.filter("lo >= hi").select(shape)
        done = finished if done is None else done.union(finished)
        active = now.filter("lo < hi").withColumn("f", fattest("lo", "hi")).withColumn("handle", F.expr("path[f]"))
        active = stored(active, "search")
        if active.isEmpty():
            return done
        met = join_hot(active, handles, "handle", "rep")
        hit, inside = F.col("n_depth").isNotNull(), F.expr("n_depth < size(path) AND path[least(n_depth, size(path) - 1)] = n_extent")
        now = met.withColumns(
            {
                "head": F.when(hit & inside, F.get("path", F.col("n_depth") + 1)).when(hit, F.get("path", F.col("n_lo") + 1)).otherwise(F.col("head")),
                "hi": F.when(hit, F.when(inside, F.col("hi")).otherwise(F.col("n_depth"))).otherwise(F.col("f") - 1),
                "lo": F.when(hit, F.col("n_depth")).otherwise(F.col("lo")),
            }
        ).select(shape)
        now = stored(now, "search")


def _left_at(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pending paths with ``m``, the depth at which they leave the trie, and ``cut``, the extent of the edge left in its middle."""
    found = stored(_located(pending, nodes), "located")
    heads = nodes.select(F.expr("edge[0]").alias("head"), F.col("lo").alias("n_lo"), F.col("depth").alias("n_depth"), F.col("extent").alias("n_extent"), "edge")
    met = join_hot(found.filter("head IS NOT NULL"), heads, "head", "rep")
    same = F.expr("size(filter(sequence(1, least(size(edge), size(path) - 1 - n_lo)), i -> path[n_lo + i] = edge[i - 1]))")
    m = F.when(F.col("n_lo").isNull(), F.col("lo")).otherwise(F.col("n_lo") + same)
    met = met.withColumn("m", m).select("rep", "path", "words", "m", F.when(F.col("m") < F.col("n_depth"), F.col("n_extent")).alias("cut"))
    at_node = found.filter("head IS NULL").select("rep", "path", "words", F.col("lo").alias("m"), F.lit(None).cast("binary").alias("cut"))
    return met.union(at_node)


def _split(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Nodes whose edges are cut at the depths of ``cuts`` (cut, at)."""
    places = cuts.groupBy(F.col("cut").alias("extent")).agg(F.sort_array(F.collect_set("at")).alias("ats"))
    met = nodes.join(places, "extent", "left")
    ends = F.expr("concat(coalesce(ats, slice(array(0), 1, 0)), array(depth))")
    pieces = met.select("*", F.posexplode(ends).alias("i", "till"), ends.alias("ends")).withColumn("since", F.expr("if(i = 0, lo, ends[greatest(i - 1, 0)])"))
    return pieces.select(
        F.expr("edge[till - lo - 1]").alias("extent"),
        F.expr("if(i = 0, top, edge[greatest(since - lo - 1, 0)])").alias("top"),
        F.col("since").alias("lo"),
        F.col("till").alias("depth"),
        F.expr("slice(edge, since - lo + 1, till - since)").alias("edge"),
        F.expr("slice(words, since - lo + 1, till - since)").alias("words"),
    )


def build(keys: DataFrame) -> DataFrame:
    """Distinct paths (rep, path, words) -> nodes of the compacted trie without its root.

    A node is (extent, top, lo, depth, edge, words): the hash at its end, its parent's extent, the depths between, and the
    hashes and word counts along its edge.  Every path ends at a node; the empty path ends at the root.
    """
    nodes, batch = None, keys.filter("size(path) > 1").select("rep", "path", "words", F.lit(0).alias("lo"))
    while True:
        if nodes is None:
            left = batch.withColumns({"m": F.col("lo"), "cut": F.lit(None).cast("binary")}).drop("lo")
        else:
            left = _left_at(batch, nodes)
        left = stored(left.withColumns({"depth": F.size("path") - 1, "next": F.get("path", F.col("m") + 1)}), "left")
        leaders = left.filter("next IS NOT NULL").groupBy("next").agg(F.max(F.struct("depth", F.negate("rep").alias("rep"))).alias("best"))
        led = left.join(leaders.select(F.negate("best.rep").alias("rep")), "rep", "left_semi")
        leaves = led.select(
            F.expr("path[depth]").alias("extent"),
            F.expr("path[m]").alias("top"),
            F.col("m").alias("lo"),
            "depth",
            F.expr("slice(path, m + 2, depth - m)").alias("edge"),
            F.expr("slice(words, m + 1, depth - m)").alias("words"),
        )
        cuts = left.filter("cut IS NOT NULL").select("cut", F.col("m").alias("at")).distinct()
        nodes = stored((_split(nodes, cuts).union(leaves) if nodes is not None else leaves).select(NODE), "nodes")
        waiting = left.filter("next IS NOT NULL").join(leaders.select(F.negate("best.rep").alias("rep")), "rep", "left_anti")
        batch = stored(waiting.select("rep", "path", "words", F.col("m").alias("lo")), "waiting")
        if batch.isEmpty():
            return nodes


def subtree_sums(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes, the root's too, with n, least, kids, leaves and below.

    ``ends`` gives per end hash the number of sequences and the least id; ``below`` is the sum over all nodes strictly under
    a node's end of (n - 1) times the words on their edges.  Every round adds up the nodes whose children are done.
    """
    spark = nodes.sparkSession
    lists = "array<binary>", "array<int>"
    root = spark.range(1).select(
        F.lit(ROOT).alias("extent"), F.lit(None).cast("binary").alias("top"), F.lit(-1).alias("lo"), F.lit(0).alias("depth"),
        F.array(F.lit(ROOT)).cast(lists[0]).alias("edge"), F.array(F.lit(0)).cast(lists[1]).alias("words"),
    )
    every = nodes.union(root)
    kids = nodes.groupBy(F.col("top").alias("extent")).agg(F.count("*").alias("kids"))
    own = every.join(kids, "extent", "left").join(ends.select(F.col("end").alias("extent"), "n", "least"), "extent", "left")
    zero = F.lit(0).cast("long")
    weight = F.expr("aggregate(words, 0L, (a, w) -> a + w)")
    light = own.select(
        "extent", "top", weight.alias("weight"), F.coalesce("kids", zero).alias("kids"), F.coalesce("n", zero).alias("n"), "least",
        F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"), zero.alias("below"), zero.alias("got"),
    )
    open_, done = stored(light, "open"), None
    while True:
        ready = open_.filter("got = kids")
        done = ready if done is None else done.union(ready)
        told = ready.filter("top IS NOT NULL").groupBy(F.col("top").alias("extent")).agg(
            F.count("*").alias("t_got"), F.sum("n").alias("t_n"), F.min("least").alias("t_least"),
            F.sum("leaves").alias("t_leaves"), F.sum(F.col("below") + (F.col("n") - 1) * F.col("weight")).alias("t_below"),
        )
        rest = open_.filter("got < kids").join(told, "extent", "left")
        plus = lambda c: F.col(c) + F.coalesce(f"t_{c}", zero)
        rest = rest.withColumns({c: plus(c) for c in ("got", "n", "leaves", "below")} | {"least": F.least("least", "t_least")})
        open_ = stored(rest.select(light.columns), "open")
        if open_.isEmpty():
            break
    sums = done.select("extent", "n", "least", "kids", "leaves", "below")
    return every.join(sums, "extent")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (end, conv_id) -> runs of ids of one end, as comma-joined text, at most CHUNK ids a run."""
    end, ids = None, []

    def row() -> pa.RecordBatch:
        cells = [pa.array([end], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])]
        return pa.RecordBatch.from_arrays(cells, ["end", "first", "ids"])

    for batch in batches:
        out = []
        for e, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (e != end or len(ids) >= CHUNK):
                out.append(row())
                ids = []
            end = e
            ids.append(i)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids in order -> one SHA-256 per end."""
    end, state = None, None
    for batch in batches:
        ends, hashes = [], []
        for e, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            if state is not None and e == end:
                state.update(b",")
            else:
                if state is not None:
                    ends.append(end)
                    hashes.append(state.hexdigest())
                end, state = e, hashlib.sha256()
            state.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(hashes, pa.string())], ["extent", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([state.hexdigest()])], ["extent", "ends_sha256"])


def end_digests(members: DataFrame) -> DataFrame:
    """(conv_id, end) -> (extent, ends_sha256): SHA-256 of the ascending, comma-joined ids of each end.

    Ids are joined into runs in range partitions first, so that a hot end costs its last task one row per CHUNK ids; the
    digest itself is sequential by definition and is fed run by run.
    """
    by = ["end", "conv_id"]
    runs = members.select(by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, "end binary, first long, ids string")
    ordered = runs.repartition("end").sortWithinPartitions("end", "first").select("end", "ids")
    return ordered.mapInArrow(_digests, "extent binary, ends_sha256 string")


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compacted nodes -> a row per depth of their edges."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()]
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            t = batch.slice(at, 1000)
            words = t.column(t.schema.get_field_index("words")).to_pylist()
            lo, least, parent, n, kids, leaves, below = (t.column(t.schema.get_field_index(c)).to_pylist() for c in ("lo", "least", "parent", "n", "kids", "leaves", "below"))
            ends = t.column(t.schema.get_field_index("ends_sha256")).to_pylist()
            for part in range(0, len(words), 100):
                cells: list[list] = [[] for _ in names]
                for i in range(part, min(part + 100, len(words))):
                    size = len(words[i])
                    saved = below[i] + (n[i] - 1) * np.cumsum(np.array(words[i][::-1], np.int64))[::-1]
                    inner = [least[i]] * (size - 1)
                    for cell, values in zip(
                        cells,
                        (
                            [least[i]] * size, range(lo[i] + 1, lo[i] + size + 1), [parent[i], *inner], [n[i]] * size, [1] * (size - 1) + [kids[i]],
                            [leaves[i]] * size, saved.tolist(), [empty] * (size - 1) + [ends[i] or empty],
                        ),
                    ):
                        cell.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names)


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns), the empty one included.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's n_convs - 1 times its last turn's words) and ends_sha256 (of the ids that end
    there).  Turnless sequences end at the root; no sequences give no rows.
    """
    members = stored(paths(convs), "paths")
    ends = stored(members.groupBy("end").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")), "ends")
    if ends.isEmpty():
        return members.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    keys = stored(members.select(F.col("conv_id").alias("rep"), "path", "words").join(ends.select(F.col("least").alias("rep")), "rep", "left_semi"), "keys")
    nodes = build(keys)
    summed = stored(subtree_sums(nodes, ends), "sums")
    above = summed.select(F.col("extent").alias("top"), F.col("least").alias("parent"))
    root = summed.filter("top IS NULL").withColumn("parent", F.lit(None).cast("long"))
    placed = join_hot(summed.filter("top IS NOT NULL"), above, "top", "extent", "inner").select(root.columns).union(root)
    full = placed.join(end_digests(members), "extent", "left").select("lo", "words", "least", "parent", "n", "kids", "leaves", "below", "ends_sha256")
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    return full.mapInArrow(_expanded, schema)
