"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (zero for words not seen in training) plus the vectors of its hashed character
3- and 4-grams.  Texts are read in windows of ``WINDOW`` words that overlap by half, all of them; a text's score comes
from its highest window.  Only labels say what is toxic, and only of whole documents: training starts from windows that
hold a word or character gram much more frequent in toxic documents, or, of toxic documents without one, from all their
windows.  It goes on with false alarms of clean documents and the window of each toxic document that the network itself
finds highest, so labels that no single word carries are learned as well.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from umbrascan.llm.pretokens import once

WINDOW, STRIDE = 24, 12
WIDTH, HIDDEN, ATTEND = 16, 8, 8
GRAMS, VOCAB = 1 << 16, 20_000
#: what a parameter loses in each step that uses it
DECAY = 3e-4
#: bounds of the training sample: documents of each class, bytes of a document, toxic windows
TOXIC_DOCS, CLEAN_DOCS, DOC_BYTES, WINDOWS = 1000, 2000, 20_000, 4000
#: word vectors that a worker keeps, and windows scored at a time
KEPT_WORDS, AT_ONCE = 200_000, 4096
#: letters stay, other ASCII becomes a space
LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LETTERS).split()


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows of ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


def gram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the 3- and 4-grams of ``^word$`` for all words in a row, and where each word's begin."""
    sizes = np.array([len(w) for w in words], np.int64) + 2
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # bytes of the word from here on
    padded = np.concatenate([flat, np.zeros(3, np.uint32)])
    three = (padded[:-3] * np.uint32(31) + padded[1:-2]) * np.uint32(31) + padded[2:-1]
    four = three * np.uint32(31) + padded[3:]
    slot = lambda h, salt: ((h * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(7)) % np.uint32(GRAMS)
    table = np.stack([np.where(left >= 3, slot(three, 1), GRAMS), np.where(left >= 4, slot(four, 77), GRAMS)], axis=1).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    return table.ravel(), starts * 2


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Parameters, and the words that have a vector."""

    vocab: dict[bytes, int]
    p: dict[str, np.ndarray]
    cut: float = 0.0
    slope: float = 1.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def new_model(vocab: dict[bytes, int], seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    gram = rng.standard_normal((GRAMS + 1, WIDTH)).astype(np.float32) * 0.02
    gram[GRAMS] = 0  # stands for no gram
    p = {"word": np.zeros((len(vocab) + 1, WIDTH), np.float32), "gram": gram}
    for way in "fb":
        p |= {f"w{way}": make(WIDTH, 3 * HIDDEN), f"u{way}": make(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"a": make(2 * HIDDEN, ATTEND), "v": make(ATTEND), "o": make(2 * HIDDEN), "d": np.zeros(1, np.float32)}
    return Model(vocab, p)


def inputs(m: Model, words: list[bytes]) -> np.ndarray:
    """Input vectors of words."""
    slots, starts = gram_slots(words)
    grams = np.add.reduceat(m.p["gram"][slots], starts, axis=0)
    return grams + m.p["word"][[m.vocab.get(w, 0) for w in words]]


def run(rows: np.ndarray, index: np.ndarray, u: np.ndarray, backward: bool, keep: bool = False):
    """Hidden states (step, window, unit) over rows of gate inputs; and what the way back needs."""
    n, steps = index.shape
    h, out, kept = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), {}
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        g = rows[index[:, t]]
        s = h @ u
        zr = sigmoid(g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(g[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
        if keep:
            kept[t] = (h, z, r, c, s[:, 2 * HIDDEN :])
        h = c + z * (h - c)
        out[t] = h
    return out, kept


def logits(p: dict, forward: np.ndarray, backward: np.ndarray, index: np.ndarray, keep: bool = False):
    """One logit a window, from gate inputs of both ways."""
    hf, kf = run(forward, index, p["uf"], False, keep)
    hb, kb = run(backward, index, p["ub"], True, keep)
    h = np.concatenate([hf, hb], axis=2)
    e = np.tanh(h @ p["a"])
    weight = np.exp(e @ p["v"])
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, h)
    out = pooled @ p["o"] + p["d"][0]
    return (out, (h, e, weight, pooled, kf, kb)) if keep else out


def gradients(m: Model, words: list[bytes], index: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted log loss for windows over ``words``, whose number stands for padding in ``index``.

    Of the tables of words and grams, the rows that were used and their gradients.
    """
    p = m.p
    x = np.concatenate([inputs(m, words), np.zeros((1, WIDTH), np.float32)])
    forward, backward = x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]
    out, (h, e, att, pooled, kf, kb) = logits(p, forward, backward, index, keep=True)
    d = ((sigmoid(out) - truth) * weight / len(truth)).astype(np.float32)
    g = {"o": pooled.T @ d, "d": d.sum(keepdims=True)}
    dpool = d[:, None] * p["o"]
    dh = att[:, :, None] * dpool
    datt = np.einsum("tnh,nh->tn", h, dpool)
    dscore = att * (datt - (att * datt).sum(axis=0))
    g["v"] = np.einsum("tn,tna->a", dscore, e)
    de = dscore[:, :, None] * p["v"] * (1 - e * e)
    g["a"] = np.einsum("tnh,tna->ha", h, de)
    dh += de @ p["a"].T
    dx = np.zeros_like(x)
    for way, kept, side, order in (("f", kf, 0, range(WINDOW - 1, -1, -1)), ("b", kb, HIDDEN, range(WINDOW))):
        u, back = p["u" + way], np.zeros((len(truth), HIDDEN), np.float32)
        du, drows = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
        for t in order:
            before, z, r, c, s = kept[t]
            total = dh[t, :, side : side + HIDDEN] + back
            dc = total * (1 - z) * (1 - c * c)
            gates = np.concatenate([total * (before - c) * z * (1 - z), dc * s * r * (1 - r), dc], axis=1)
            inner = np.concatenate([gates[:, : 2 * HIDDEN], dc * r], axis=1)
            du += before.T @ inner
            back = total * z + inner @ u.T
            np.add.at(drows, index[:, t], gates)
        g["u" + way], g["w" + way], g["c" + way] = du, x.T @ drows, drows.sum(axis=0)
        dx += drows @ p["w" + way].T
    ids = np.array([m.vocab.get(w, 0) for w in words])
    g["word"] = summed(ids, dx[:-1], 0)
    slots, starts = gram_slots(words)
    lengths = np.diff(np.append(starts, len(slots)))
    g["gram"] = summed(slots, np.repeat(dx[:-1], lengths, axis=0), GRAMS)
    return g


def summed(rows: np.ndarray, values: np.ndarray, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows but ``fixed``, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    distinct, first = np.unique(rows[order], return_index=True)
    sums = np.add.reduceat(values[order], first, axis=0)
    return distinct[distinct != fixed], sums[distinct != fixed]


def _signals(docs: list[list[bytes]], toxic: list[bool]) -> dict[bytes, float]:
    """Log odds of words and character grams that are much more frequent in toxic documents."""
    seen = {True: Counter(), False: Counter()}
    for words, bad in zip(docs, toxic):
        found = set(words)
        for w in set(words):
            w = b"^" + w + b"$"
            found.update(b"~" + w[i : i + 5] for i in range(len(w) - 4))
        seen[bad].update(found)
    n, c = sum(toxic), len(toxic) - sum(toxic)
    odds = {s: np.log((k + 0.5) / (n + 1)) - np.log((seen[False][s] + 0.5) / (c + 1)) for s, k in seen[True].items() if k >= max(5, n // 50)}
    return {s: o for s, o in odds.items() if o > 3}


def train(docs: list[list[bytes]], toxic: list[bool], epochs: int = 4, seed: int = 5) -> Model:
    """Fits the network on documents of known label."""
    rng = np.random.default_rng(seed)
    first = {tuple(words): i for i, words in reversed(list(enumerate(docs)))}  # copies would pass for evidence
    docs, toxic = [docs[i] for i in sorted(first.values())], [toxic[i] for i in sorted(first.values())]
    df = Counter(w for words in docs for w in set(words))
    m = new_model({w: i + 1 for i, (w, n) in enumerate(df.most_common(VOCAB)) if n >= 3}, seed)
    if not any(toxic) or all(toxic):
        m.cut, m.slope = (-1e3 if any(toxic) else 1e3), 1.0
        return m
    signals = _signals(docs, toxic)

    def strength(w: bytes) -> float:
        x = b"^" + w + b"$"
        return max([signals.get(w, 0.0), *(signals.get(b"~" + x[i : i + 5], 0.0) for i in range(len(x) - 4))])

    strong = {w for w in df if strength(w) > 0}
    negative: list[list[bytes]] = []
    suspects: list[list[list[bytes]]] = []  # windows of each toxic document
    marked: list[list[bytes]] = []
    unmarked: list[list[bytes]] = []
    for words, bad in zip(docs, toxic):
        spans = [words[s : s + WINDOW] for s in windows_of(len(words)).tolist()]
        if not bad:
            negative += spans
            continue
        suspects.append(spans)
        signs = [s for s in spans if not strong.isdisjoint(s)]
        marked += signs
        unmarked += spans if not signs else []
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
    step, trained = 0, np.zeros(GRAMS + 1, bool)

    def fit(good: list[list[bytes]], bad: list[list[bytes]], rounds: int) -> None:
        nonlocal step
        spans, truth = good + bad, np.array([1.0] * len(good) + [0.0] * len(bad), np.float32)
        weight = np.where(truth > 0, len(truth) / (2 * max(1, len(good))), len(truth) / (2 * max(1, len(bad)))).astype(np.float32)
        weight = np.minimum(weight, 8)
        for _ in range(rounds):
            order = rng.permutation(len(spans))
            for at in range(0, len(order), 256):
                pick = order[at : at + 256]
                words = sorted({w for i in pick for w in spans[i]}) or [b""]
                place = {w: i for i, w in enumerate(words)}
                index = np.full((len(pick), WINDOW), len(words))
                for row, i in enumerate(pick):
                    index[row, : len(spans[i])] = [place[w] for w in spans[i]]
                g = gradients(m, words, index, truth[pick], weight[pick])
                step += 1
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, x in g.items():
                    rows, x = x if isinstance(x, tuple) else (slice(None), x)
                    first = moments[k][0][rows] * 0.9 + 0.1 * x
                    second = moments[k][1][rows] * 0.999 + 0.001 * x * x
                    moments[k][0][rows], moments[k][1][rows] = first, second
                    m.p[k][rows] -= rate * first / (np.sqrt(second) + 1e-8) + DECAY * m.p[k][rows]
                    if k == "gram":
                        trained[rows] = True

    sample = lambda spans, n: [spans[i] for i in rng.permutation(len(spans))[:n]]
    positive = sample(marked, WINDOWS)
    positive += sample(unmarked, max(0, WINDOWS - len(positive)))
    fit(positive, sample(negative, 2 * len(positive)), epochs)
    hidden = len(unmarked) > len(marked)  # most toxic windows are still to be found
    for _ in range(8 if hidden else 2):
        scorer = Scorer(m)
        alarms = [s for s, x in zip(negative, scorer.windows(negative)) if x > -2.0]
        found = scorer.windows([s for spans in suspects for s in spans])
        ends = np.cumsum([len(spans) for spans in suspects])
        tops = [spans[int(np.argmax(found[end - len(spans) : end]))] for spans, end in zip(suspects, ends.tolist())]
        known = {tuple(s) for s in marked}
        positive = sample(marked, WINDOWS)
        positive += sample([s for s in tops if tuple(s) not in known], max(0, WINDOWS - len(positive)))
        fit(positive, sample(alarms, len(positive)) + sample(negative, len(positive)), 2)
    m.p["gram"][~trained] = 0
    tops = Scorer(m).tops(docs)
    truth = np.array(toxic)
    places = np.sort(tops)
    missed = np.searchsorted(np.sort(tops[truth]), places) / truth.sum()
    alarms = 1 - np.searchsorted(np.sort(tops[~truth]), places) / (~truth).sum()
    good = places[missed + 2 * alarms <= (missed + 2 * alarms).min() + 0.0005]
    m.cut = float((good.min() + good.max()) / 2)  # the middle of all cuts about as good as the best
    return m


class Scorer:
    """Scores texts with gate inputs of words kept from call to call."""

    def __init__(self, m: Model):
        self.m, self.place = m, {}
        self.rows = {way: np.tile(m.p["c" + way], (KEPT_WORDS + 1, 1)) for way in "fb"}

    def learn(self, words: set[bytes]) -> None:
        """Makes room for words that are not kept yet; the padding is the last row."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > KEPT_WORDS:
            self.place, new = {}, list(words)
            if len(new) > KEPT_WORDS:
                self.rows = {way: np.tile(self.m.p["c" + way], (len(new) + 1, 1)) for way in "fb"}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            x, first = inputs(self.m, part), len(self.place)
            for way in "fb":
                self.rows[way][first : first + len(part)] = x @ self.m.p["w" + way] + self.m.p["c" + way]
            self.place.update(zip(part, range(first, first + len(part))))

    def tops(self, docs: list[list[bytes]]) -> np.ndarray:
        """The highest logit of each text's windows."""
        self.learn(set().union(*docs))
        pad, blocks, owner = len(self.rows["f"]) - 1, [], []
        for i, words in enumerate(docs):
            ids = np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))
            if len(ids) < WINDOW:
                ids = np.concatenate([ids, np.full(WINDOW - len(ids), pad, np.int32)])
            starts = windows_of(len(words))
            blocks.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts])
            owner.append(np.full(len(starts), i))
        index, owner = np.concatenate(blocks), np.concatenate(owner)
        out = np.full(len(docs), -np.inf, np.float32)
        for at in range(0, len(index), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            np.maximum.at(out, owner[part], logits(self.m.p, self.rows["f"], self.rows["b"], index[part]))
        return out

    def windows(self, spans: list[list[bytes]]) -> np.ndarray:
        return np.concatenate([self.tops(spans[at : at + 4000]) for at in range(0, len(spans), 4000)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= 1_000_000):
                size += len(texts[end] or "")
                end += 1
            out.append(self.tops([words_of(t) for t in texts[at:end]]))
            at = end
        return 1 / (1 + np.exp(-np.clip((np.concatenate(out).astype(np.float64) - self.m.cut) * self.m.slope, -60, 60)))


def held_out(key):
    """Rows that training never sees."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model fitted on the driver, on a bounded sample of labelled documents that aren't held out.

    At most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` documents, chosen by a hash of the key, and of these the ones of at most
    ``DOC_BYTES`` bytes.  Null keys, labels and texts are left out; of several labels for a key the highest counts.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("bad"))
    by_hash = lambda bad, n: known.filter(F.col("bad") == bad).orderBy(F.xxhash64("k"), "k").limit(n)
    sample = by_hash(1, TOXIC_DOCS).union(by_hash(0, CLEAN_DOCS))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.octet_length("t") <= DOC_BYTES)
    rows = texts.join(F.broadcast(sample), "k").groupBy("k").agg(F.min("t").alias("t"), F.max("bad").alias("bad")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["k"]).encode()), r["k"]))
    return train([words_of(r["t"]) for r in rows], [bool(r["bad"]) for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", predicted: str = "predicted") -> DataFrame:
    """All columns of ``docs``, and two more: ``out`` in 0 to 1, and ``predicted``, 1 from 0.5 on.

    Columns that have these names are replaced.  Every window of every whole text is scored; an empty or null text is
    one window of padding; repeated rows are scored alike.
    """
    rest = docs.drop(out, predicted)
    at = rest.columns.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values, of bounded size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(("toxicity", shipped.value["name"]), lambda: Scorer(Model(**shipped.value)))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = scorer.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, out])

    scored = rest.mapInArrow(work, StructType([*rest.schema.fields, StructField(out, DoubleType())]))
    return scored.withColumn(predicted, (F.col(out) >= 0.5).cast("int"))
