import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbrascan.llm import collocations, queries


def brute(docs, least=100, longest=5, top=2000):
    """[(lang, text)] -> result rows, from all n-grams and Python's integers."""
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    inner = {}
    for (lang, words), f in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = (lang, words[i : i + k])
                inner[key] = max(inner.get(key, 0), f)
    rows = []
    for (lang, words), a in often.items():
        if 100 * inner.get((lang, words), 0) >= 100 * a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    out, seen = [], Counter()
    for lang, *rest in rows:
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], *rest))
    return out


def result(spark, docs, **options):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, phrase string, n int").repartition(3)
    return sorted(map(tuple, collocations.phrases(df, **options).collect()))


VOCABULARY = [f"w{i}" for i in range(12)] + ["é", "字", "a\x1cb", "x\xa0y", "\x00", "İ"]


def corpus(seed, n):
    rng = random.Random(seed)
    docs = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            if rng.random() < 0.2:
                words += rng.choice([["New", "york", "city"], ["of", "the"], ["a", "b", "c", "d", "e", "f"]])
            else:
                words.append(VOCABULARY[min(int(rng.expovariate(0.4)), len(VOCABULARY) - 1)])
            words.append(rng.choice(["", "", "", "", ".", ",", "\n", "!", "\x0b", ":"]))
        text = "".join(rng.choice([" ", "\t", "  "]) + w if w not in (".", ",", "\n", "!", "\x0b", ":") else w for w in words)
        docs.append((rng.choice(["en", "en", "en", "de", None, ""]), text))
    return docs


@pytest.mark.parametrize("least,top", [(100, 2000), (3, 2000), (20, 5)])
def test_equals_brute_force(spark, least, top):
    docs = corpus(least, 400) + [("en", None), (None, ""), ("en", " . , "), ("fr", "only here")]
    want = brute(docs, least, top=top)
    assert len(want) >= 5
    assert result(spark, docs, least=least, top=top) == sorted(want)


def test_small_sketch_and_runs(spark, monkeypatch):
    """Cells that many pairs share, and runs of few words, change nothing."""
    monkeypatch.setattr(collocations, "CELLS", 19)
    monkeypatch.setattr(collocations, "HELD", 50)
    docs = corpus(5, 300)
    assert result(spark, docs, least=5) == sorted(brute(docs, 5))


def test_runs_of_a_task_are_merged(spark, monkeypatch):
    """A task gives out each window once, however many runs its texts make."""
    phrases = ["a b c", "d e", "a d", "c c a b"]
    rows = [(lang, p.encode()) for _ in range(50) for lang in ("en", "de") for p in phrases]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 7]), (pa.string(), pa.binary()))], ["lang", "text"]) for i in range(0, len(rows), 7)]
    every = bytes([255]) * (1 << (collocations.CELLS - 3))
    windows = collocations._windows(every, every, 5)

    def counted():
        return [(*r.values(),) for b in windows(iter(batches)) for r in b.to_pylist()]

    whole = counted()
    assert sum(r[-1] for r in whole) == sum(len(p.split()) for _, p in rows) and ("en", "c", "c", "a", "b", "", 50) in whole
    monkeypatch.setattr(collocations, "HELD", 20)
    assert sorted(counted()) == sorted(whole)
    monkeypatch.setattr(collocations, "KEPT", 12)
    parts = Counter()
    for *window, n in (out := counted()):
        parts[tuple(window)] += n
    assert len(out) > len(whole) and sorted((*w, n) for w, n in parts.items()) == sorted(whole)


def test_tasks_follow_the_cores(spark, monkeypatch):
    """More splits of the files don't make more tasks that each give out their phrases."""
    keep, tasks = collocations.stored, []

    def counted(df, name):
        if name == "sketch":
            tasks.append(df.rdd.getNumPartitions())
        return keep(df, name)

    monkeypatch.setattr(collocations, "stored", counted)
    cores = spark.sparkContext.defaultParallelism
    texts = spark.createDataFrame([("en", bytearray(b"a b c"))] * 100, "lang string, text binary").repartition(3 * cores)
    counts, _ = collocations.phrase_counts(texts, 100, 5)
    assert {(r["phrase"], r["a"]) for r in counts.collect()} == {(p, 100) for p in ("a", "b", "c", "a b", "b c", "a b c")}
    assert tasks == [2 * cores] * 2


def test_wide_numbers_and_ties(spark):
    docs = [("en", "a b " * 60_000), ("en", "c d. " * 150), ("en", "e f. " * 150), ("en", "d c. " * 100)]
    assert result(spark, docs) == sorted(brute(docs))


def test_empty_and_rare(spark):
    assert result(spark, [("en", "a b c")]) == []
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.phrases(df).collect() == []


def test_exact_division(spark):
    big = spark.createDataFrame([(10**13, 10**13 + 7, 3 * 10**12 + 1, 2 * 10**12 + 3)], "a long, n long, l long, r long")
    a, n, left, right = big.first()
    assert big.select(collocations.score().alias("s")).first()["s"] == 1000 * a * n // (left * right)


def test_rollup_is_the_only_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counts, totals = collocations.phrase_counts(texts, 20, 5)
    assert counts.agg(F.max("k")).first()[0] >= 2 and totals.count() == docs.select("lang").distinct().count()


def test_query_equals_sql(spark, sf):
    sf = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(queries.oracles()["op12_collocations"])
    assert sorted(map(tuple, queries.op12_collocations(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())
