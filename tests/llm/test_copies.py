import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from umbrascan.llm import components, near_duplicates, substrings

from . import brute


def corpus(seed, n, words, vocabulary):
    """Texts with exact and near copies, shared passages and short ones."""
    rng = random.Random(seed)
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base = [make(words) for _ in range(6)]
    passage, docs = make(70), []
    for i in range(n):
        kind, text = i % 6, list(rng.choice(base))
        if kind == 1:
            for _ in range(rng.randint(1, 6)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        elif kind == 2:
            text = make(rng.randint(0, 12))
        elif kind == 3:
            text = make(rng.randint(5, 80)) + passage + make(rng.randint(0, 80))
        elif kind == 4:
            text = text[rng.randint(0, 20) :] + text[: rng.randint(0, 30)]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.02 else w for w in text)))
    return docs


VOCABULARY = [f"w{i}" for i in range(300)] + ["é", "字", "a\x1cb", "x\xa0y"]


def frame(spark, docs):
    odd = [(9000, None), (9001, ""), (9002, " \n "), (9003, docs[0][1]), (9003, docs[0][1]), (None, docs[0][1])]
    rows = [(i, t, "x", "y") for i, t in docs + odd]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, doc string").repartition(5), [(i, t) for i, t in docs + odd if i is not None]


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5)])
def test_near_duplicates(spark, seed, k):
    df, docs = frame(spark, corpus(seed, 150, 120, VOCABULARY))
    got = near_duplicates.near_duplicates(df, words=k).collect()
    want = brute.near(docs, k)
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_chains_are_found_in_blocks(spark, monkeypatch):
    """Neighbours of a chain are alike, its ends are not; blocks of two classes each."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 2)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(30)]
    random.Random(4).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(df, words=4).collect()}
    assert got == brute.near(docs, 4)
    assert {c for _, c in got.values()} == {0}


def test_texts_that_share_a_key(spark):
    """Two texts of one key are documents of their own, in the operator and in the pipeline's stage."""
    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    near = text("a") + " more"
    rows = [(1, text("a")), (5, near), (5, text("b")), (7, text("b")), (8, text("c")), (8, text("c")), (8, text("d"))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    numbered = df.coalesce(1).withColumn("n", F.monotonically_increasing_id())
    got = {r["n"]: (r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(numbered, row="n").collect()}
    assert {n: got[n][0] for n in got} == {0: 1, 1: 1, 2: 5, 3: 5, 4: 8, 5: 8, 6: 8}
    assert [got[n][1] for n in (0, 1, 2, 3, 6)] == [True, False, True, False, True] and got[4][1] != got[5][1]
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, text("a")), (5, text("b")), (8, text("c")), (8, text("d"))]
    assert kept.columns == df.columns


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(1, None)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    home = {}
    for u, v in links:
        if v is not None and u != v:
            a, b = home.setdefault(u, {u}), home.setdefault(v, {v})
            if a is not b:
                a |= b
                for x in b:
                    home[x] = a
    assert got == {x: min(s) for x, s in home.items()}
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed,crowd", [(1, 64), (2, 2), (3, 0)])
def test_substrings(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    docs = corpus(seed, 120, 150, VOCABULARY) + [(500, "same " * 200), (501, "same " * 120), (502, "a b " * 80)]
    df, docs = frame(spark, docs)
    got = substrings.remove_repeats(df)
    want = brute.repeats(docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "doc", "n_words", "n_removed", "kept"] and len(rows) == df.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_automaton():
    rng = random.Random(6)
    seen, a = [], substrings.Automaton()
    for doc in range(40):
        words = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        want = [i for i in range(len(words) - 3) if any(words[i : i + 4] == s[j : j + 4] for s in seen for j in range(len(s) - 3))]
        assert a.repeats(words, doc, 4) == want
        a.add(words, doc)
        seen.append(words)
