import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from umbrascan.llm import bpe, packing, token_counts, token_files
from umbrascan.llm.pretokens import LibraryIds, Splitter

ALPHABET = "aabbcde theingéñ字符ΣσаЖ 9²½\n\t\x1c\x85\xa0'st re.,_-{}|ʼˁ😀́İ"
ODD = ["", " ", "a  b", " \n x", "<|endoftext|>x<|startoftext|>", "İİΣΑΣ", "a" * 1500, "abcde" * 300, "é" * 400, "字" * 50]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(600)]


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(9000, None, "x"), (9001, "same", "x"), (9001, "same", "x"), (None, "no key", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_latin_splitter_is_the_pattern(texts):
    s = Splitter(P.PATTERN)
    for t in texts:
        cut = "".join(c for c in t if c < "̀")
        assert s._latin(cut) == s._any(cut)


def test_bpe_is_tiktoken(spark, table):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.Bpe(path, P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(table, path, P.PATTERN, decoded="decoded").join(table.select("doc_id", "text"), "doc_id").collect()
    assert len(got) > 600
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert r["decoded"].decode() == (r["text"] or "")
    back = bpe.decode(bpe.encode(table, path, P.PATTERN), path, P.PATTERN)
    assert back.count() == table.count()
    assert bpe.encode(table.limit(0), path, P.PATTERN).count() == 0


def test_long_pieces_merge_alike():
    b = bpe.Bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(3)
    for n in (2, 17, 300, 512):
        piece = "".join(rng.choice("abcdeth") for _ in range(n)).encode()
        assert b.merge_long(piece) == b.merge_matrix([piece], 512)[0]


def test_counts_are_the_library(table):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {(r["doc_id"]): r for r in token_counts.count(table, path, limit=20).collect()}
    for r in table.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_bytes"], g["over_limit"]) == (n, len((r["text"] or "").encode()), n > 20)


def test_proven_strings_are_one_token():
    c = token_counts.WordCounter(P.path("word_bpe_49k.json"))
    assert len(c.counts) > 20_000
    for w in random.Random(1).sample(sorted(c.counts), 500):
        assert len(c.tok.encode(w, add_special_tokens=False).ids) == 1


def test_library_ids(texts):
    path = P.path("byte_bpe_50k.json")
    ids, library = LibraryIds(path, P.PATTERN, room=20_000), Tokenizer.from_file(path)
    for t in texts:
        assert np.frombuffer(ids.packed(t), ids.kind).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 33, 5000, 300_000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype("<u2")
    values, counts = np.unique(ids, return_counts=True)
    t = token_files.Tables(dict(zip(values.tolist(), counts.tolist())))
    payload = token_files.encode_block(ids, t)
    assert (token_files.decode_block(payload, t) == ids).all()
    parts = [token_files.decode_block(payload, t, i) for i in range(token_files.shape(n)[1])]
    assert (np.concatenate(parts)[:n] == ids).all()


def test_token_files(spark, table, tmp_path):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_files.write(table, str(tmp_path), path, P.PATTERN, 2, block=500)
    got = token_files.read(spark, str(tmp_path)).orderBy("start").collect()
    at, keys = 0, []
    want = {}
    for r in table.collect():
        want.setdefault(r["doc_id"], np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"))
    for r in got:
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
        keys.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert keys == sorted(keys) and len(got) == table.count()


def test_another_frequency_table_fails(spark, table, tmp_path):
    token_files.write(table, f"{tmp_path}/a", P.path("byte_bpe_50k.json"), P.PATTERN, 2, block=500)
    counts = json.loads(spark.read.parquet(f"{tmp_path}/a/tables").first()["counts"])
    last = max(counts, key=int)
    counts[str(int(last) + 1)] = counts.pop(last)  # as many slots in the same order, for another id
    spark.read.parquet(f"{tmp_path}/a/blocks").write.parquet(f"{tmp_path}/b/blocks")
    spark.createDataFrame([(json.dumps(counts),)], "counts string").write.parquet(f"{tmp_path}/b/tables")
    assert token_files.read(spark, f"{tmp_path}/a").count() == table.count()
    with pytest.raises(Exception, match="decodes to other ids"):
        token_files.read(spark, f"{tmp_path}/b").collect()


def test_token_files_of_nothing(spark, table, tmp_path):
    token_files.write(table.limit(0), str(tmp_path), P.path("byte_bpe_50k.json"), P.PATTERN, 2)
    assert token_files.read(spark, str(tmp_path)).count() == 0


def test_best_fit():
    lengths = np.random.default_rng(1).integers(1, 101, 2000)
    bins, offsets, fills = packing.best_fit(lengths, 100)
    for b in range(len(fills)):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: offsets[i]):
            assert offsets[i] == at
            at += lengths[i]
        assert at == fills[b] <= 100
    assert len(fills) <= lengths.sum() / 100 * 1.02 + 1


def test_packing(spark, table):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(table, path, P.PATTERN, capacity=64).collect()
    want = {}
    for r in table.collect():
        want.setdefault(r["doc_id"], np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4"))
    seqs, total = {}, 0
    for r in rows:
        ids = want[r["doc_id"]]
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        assert r["length"] == 64 or r["piece"] == 0
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(want[r["doc_id"]]) for r in table.select("doc_id").collect())
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(seqs) <= total / 64 * 1.05 + 2
    assert packing.pack(table.limit(0), path, P.PATTERN).count() == 0


def test_packing_mixes_lengths_that_follow_the_layout(spark):
    text = lambda n: F.repeat(F.lit(" a"), n - 1)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, text(55)).otherwise(text(45)).alias("text"))
    rows = packing.pack(docs.repartitionByRange(4, "doc_id"), P.path("byte_bpe_50k.json"), P.PATTERN, capacity=100).cache()
    assert {r["length"] for r in rows.select("length").distinct().collect()} == {45, 55}
    assert rows.select("sequence_id").distinct().count() <= 240  # 200 at best; sorted by length, 300


def test_packing_tree_joins_small_partitions(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).repartition(100)
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, capacity=64)
    assert rows.select("sequence_id").distinct().count() <= 45  # 600 pieces of 4 tokens fill 38 sequences
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("c")).filter("n > 64 OR k != c").count() == 0
