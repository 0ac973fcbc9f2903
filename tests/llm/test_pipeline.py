import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from umbrascan.llm import queries

from . import brute


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "packing"]

    clean = by_name["toxicity"](spark, docs, sf).cache()
    assert clean.columns == docs.columns
    scores = queries.op1_toxicity(spark, sf)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in scores.filter("predicted = 0").collect()}

    kept = by_name["near_dedup"](spark, clean, sf).cache()
    want = brute.near([(r["doc_id"], r["text"]) for r in clean.collect()], 5)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d}

    cut = by_name["substring_dedup"](spark, kept, sf).cache()
    want = brute.repeats([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert cut.columns == docs.columns and cut.count() == kept.count()
    for r in cut.collect():
        assert " ".join(brute.WORD.findall(r["text"])) == want[r["doc_id"]][2]
        assert r["n_chars"] == len(r["text"])

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lengths = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in cut.collect()}
    got = by_name["packing"](spark, cut, sf).collect()
    assert sum(r["length"] for r in got) == sum(lengths.values())
    assert len({r["sequence_id"] for r in got}) <= sum(lengths.values()) / 2048 * 1.02 + 2


def test_stages_take_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (901, "", "en", "s", 0)], docs.schema)
    rows = docs.unionByName(odd).withColumn("kept", docs["lang"]).withColumn("score", docs["lang"])
    for name, stage in corpus_pipeline.STAGES[:3]:
        done = stage(spark, rows, sf)
        assert done.columns == rows.columns, name
        assert done.filter("doc_id IS NULL").count() == 1, name
        assert stage(spark, rows.limit(0), sf).count() == 0
