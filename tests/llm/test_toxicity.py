import random

import numpy as np
from pyspark.sql import functions as F
from umbrascan.llm import toxicity as T


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    docs = []
    for i in range(n):
        text, bad = [rng.choice(words) for _ in range(rng.randint(3, 150))], i % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["zyxw", "qqpo", "vuvu" + rng.choice("abcdef") * 2]))
        docs.append((i, " ".join(text), int(bad)))
    return docs


def test_gradients():
    rng = np.random.default_rng(0)
    m = T.new_model({b"aa": 1, b"bb": 2})
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    words, index = [b"aa", b"bb", b"ccc", b"dddd"], rng.integers(0, 5, (6, T.WINDOW))
    truth, weight = np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6)

    def loss():
        x = np.concatenate([T.inputs(m, words), np.zeros((1, T.WIDTH))])
        s = T.sigmoid(T.logits(m.p, x @ m.p["wf"] + m.p["cf"], x @ m.p["wb"] + m.p["cb"], index).astype(np.float64))
        return -(truth * np.log(s) + (1 - truth) * np.log(1 - s)).mean()

    for k, g in T.gradients(m, words, index, truth, weight).items():
        if isinstance(g, tuple):
            whole = np.zeros_like(m.p[k])
            whole[g[0]] = g[1]
            g = whole
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        m.p[k][at] += 1e-3
        up = loss()
        m.p[k][at] -= 2e-3
        down = loss()
        m.p[k][at] += 1e-3
        assert abs(g[at] - (up - down) / 2e-3) < 1e-3 * abs(g[at]) + 1e-6, k


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 100, 1000):
        starts = T.windows_of(n)
        covered = set().union(*(range(s, s + T.WINDOW) for s in starts.tolist()))
        assert covered >= set(range(n)) and (np.diff(starts) <= T.STRIDE).all()


def test_held_out_accuracy(spark):
    docs = corpus(1, 900)
    rows = [(i, t, "x", "x") for i, t, _ in docs] + [(5000, None, "x", "x"), (5001, "", "x", "x"), (None, "zyxw", "x", "x"), (5002, "ab " * 30_000 + "zyxw qqpo", "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(1, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    model = T.fit(df, labels)
    got = T.score(df, model).withColumn("held", T.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and got[0].__fields__[:2] == ["doc_id", "text"]
    score = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(score[i]["predicted"], y) for i, _, y in docs if score[i]["held"]]
    assert len(held) > 100
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert (score[5000]["predicted"], score[5001]["predicted"], score[5002]["predicted"]) == (0, 0, 1)
    assert T.score(df.limit(0), model).count() == 0


def test_one_class_only(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert {r["predicted"] for r in T.score(df, T.fit(df, labels)).collect()} == {0}
    assert {r["predicted"] for r in T.score(df, T.fit(df, labels.limit(0))).collect()} == {0}


def plain_logit(m, words):
    """One window, step by step."""
    p, n = m.p, T.HIDDEN
    x = T.inputs(m, words) if words else np.zeros((0, T.WIDTH))
    x = np.concatenate([x, np.zeros((T.WINDOW - len(words), T.WIDTH))])
    states = {}
    for way, steps in (("f", range(T.WINDOW)), ("b", range(T.WINDOW - 1, -1, -1))):
        h = np.zeros(n)
        for t in steps:
            g, s = x[t] @ p["w" + way] + p["c" + way], h @ p["u" + way]
            z, r = 1 / (1 + np.exp(-(g[:n] + s[:n]))), 1 / (1 + np.exp(-(g[n : 2 * n] + s[n : 2 * n])))
            c = np.tanh(g[2 * n :] + r * s[2 * n :])
            h = (1 - z) * c + z * h
            states[way, t] = h
    h = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(T.WINDOW)])
    e = np.exp(np.tanh(h @ p["a"]) @ p["v"])
    return float((e / e.sum()) @ h @ p["o"] + p["d"][0])


def test_scores_equal_a_plain_loop_over_all_windows():
    docs = corpus(2, 80)
    model = T.train([T.words_of(t) for _, t, _ in docs], [bool(y) for *_, y in docs], epochs=1)
    texts = [t for _, t, _ in docs[:12]] + ["", None, "zyxw", "Ab-cd!  ÉÉ 字 zyxw", "word " * 500 + "qqpo"]
    want = []
    for text in texts:
        words = T.words_of(text)
        top = max(plain_logit(model, words[s : s + T.WINDOW]) for s in T.windows_of(len(words)).tolist())
        want.append(1 / (1 + np.exp(-np.clip((top - model.cut) * model.slope, -60, 60))))
    assert np.allclose(T.Scorer(model).scores(texts), want, atol=1e-4)


def test_labels_that_no_single_word_carries():
    """Toxic is "up" right before "down"; both words, and the reverse order, are as frequent in clean texts."""
    rng = random.Random(6)
    words = [w.encode() for w in ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st")]

    def text(bad):
        out = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        for pair in [[b"down", b"up"], [b"up", rng.choice(words), b"down"]] + [[b"up", b"down"]] * bad:
            at = rng.randrange(len(out) + 1)
            while 0 < at < len(out) and {out[at - 1], out[at]} & {b"up", b"down"}:
                at = rng.randrange(len(out) + 1)
            out[at:at] = pair
        return out

    bad = [i % 2 == 0 for i in range(1200)]
    docs = [text(b) for b in bad]
    assert not T._signals(docs[:900], bad[:900])
    model = T.train(docs[:900], bad[:900])
    found = T.Scorer(model).tops(docs[900:]) > model.cut
    assert (found == np.array(bad[900:])).mean() > 0.8
