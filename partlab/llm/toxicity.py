"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word's input is the mean of trained vectors: one for the word itself (if the training sample
holds it often enough) and one for each of its character n-grams. Two gated recurrent layers
read a window of words from both sides, attention pools their states, and a logistic unit
scores the window. Windows overlap by half and cover the whole text; a document's score is a
logistic function of statistics over all its windows, fitted on documents that the network
hasn't seen. Training and scoring are numpy; windows of many documents run in one batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, SegmentHash, chunks, give_back, held_out

#: Labelled documents that are learnt from at most, by label 1 and 0.
SAMPLE_ROWS = (1_500, 2_500)
#: The network is trained on all their windows; those of one document weigh as much as so many
#: of a short one at most.
DOC_WEIGHT = 16
WINDOW, STRIDE = 32, 16
WIDTH, HIDDEN, BUCKETS = 12, 8, 1 << 14
NGRAMS = (3, 4, 5)
EPOCHS, LEAST_STEPS, BATCH, RATE, WORD_DOCS = 2, 400, 128, 0.01, 5
#: Words that a worker remembers the inputs of.
CACHE_WORDS = 70_000
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def words_in(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words."""
    if n <= WINDOW:
        return np.zeros(int(n > 0), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def features_of(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, buckets): buckets[bounds[i]:bounds[i + 1]] are word i's rows of the vector table."""
    marked = [f"<{w}>" for w in words]
    lengths = np.array([len(w) for w in marked])
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    h = SegmentHash(code)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))
    own = np.array([known.get(w, -1) for w in words])
    who, what = [np.flatnonzero(own >= 0)], [own[own >= 0]]
    for k in NGRAMS:
        at = np.flatnonzero(left >= k)
        who.append(owner[at])
        what.append((h(at, at + k) % np.uint64(BUCKETS)).astype(np.int64) + len(known))
    # a word shorter than the n-grams (one letter with its marks has three characters) has one at least
    who, what = np.concatenate(who), np.concatenate(what)
    order = np.argsort(who, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(words))))), what[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    known: dict[str, int]
    vectors: np.ndarray  # (known words + buckets) x WIDTH
    into: np.ndarray  # WIDTH x 6 HIDDEN: both directions, reset, update and new
    bias: np.ndarray  # 6 HIDDEN
    around: np.ndarray  # 2 x HIDDEN x 3 HIDDEN
    attend: np.ndarray  # 2 HIDDEN
    out: np.ndarray  # 2 HIDDEN
    out_bias: np.ndarray  # 1
    document: np.ndarray  # weights of the window statistics, the last is the constant

    def params(self) -> list[np.ndarray]:
        return [self.vectors, self.into, self.bias, self.around, self.attend, self.out, self.out_bias]


def new_network(known: dict[str, int], seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    g = lambda *s, by=0.3: (r.standard_normal(s) * by).astype(np.float32)
    return Network(known, g(len(known) + BUCKETS, WIDTH, by=0.5), g(WIDTH, 6 * HIDDEN), np.zeros(6 * HIDDEN, np.float32), g(2, HIDDEN, 3 * HIDDEN), g(2 * HIDDEN), g(2 * HIDDEN), np.zeros(1, np.float32), np.array([0, 1, 0, 0], float))


def word_vectors(net: Network, bounds: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(bounds), 1)
    sums = np.add.reduceat(np.concatenate([net.vectors[buckets], np.zeros((1, WIDTH), np.float32)]), np.minimum(bounds[:-1], len(buckets)), axis=0)
    sums[np.diff(bounds) == 0] = 0
    return sums / n[:, None].astype(np.float32)


def run(net: Network, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Window logits from projected inputs x (T, B, 6 HIDDEN) and mask (T, B); with ``keep``
    also what the gradient needs."""
    T, B, _ = x.shape
    H = HIDDEN
    states = np.zeros((T, 2, B, H), np.float32)
    both = np.empty((2, B, 3 * H), np.float32)
    h = np.zeros((2, B, H), np.float32)
    memo = []
    full = bool(mask.all())
    for t in range(T):
        both[0], both[1] = x[t, :, : 3 * H], x[T - 1 - t, :, 3 * H :]
        u = np.matmul(h, net.around)
        rz = both[:, :, : 2 * H] + u[:, :, : 2 * H]
        rz *= 0.5
        np.tanh(rz, out=rz)
        rz *= 0.5
        rz += 0.5
        r, z = rz[:, :, :H], rz[:, :, H:]
        n = r * u[:, :, 2 * H :]
        n += both[:, :, 2 * H :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if not full:
            m = np.stack([mask[t], mask[T - 1 - t]])[:, :, None]
            new = np.where(m, new, h)
        if keep:
            memo.append((h, r, z, n, u[:, :, 2 * H :]))
        h = new
        states[t, 0], states[T - 1 - t, 1] = h[0], h[1]
    a = states[:, 0] @ net.attend[:H]
    a += states[:, 1] @ net.attend[H:]
    if not full:
        a = np.where(mask, a, -1e9).astype(np.float32)
    a -= a.max(axis=0)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    pooled = np.einsum("tb,tdbh->bdh", a, states).reshape(B, 2 * H)
    logit = pooled @ net.out + net.out_bias[0]
    return (logit, states, a, pooled, memo) if keep else logit


def gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0):
    """(loss, gradient of x, gradients of around, attend, out, out_bias) of the mean weighted
    cross-entropy."""
    T, B, _ = x.shape
    H = HIDDEN
    logit, states, a, pooled, memo = run(net, x, mask, True)
    p = _sigmoid(logit)
    loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
    d = (weight * (p - y) / B).astype(np.float32)
    g_out, g_bias = d @ pooled, d.sum(keepdims=True)
    dp = (d[:, None] * net.out).reshape(B, 2, H)
    da = np.einsum("bdh,tdbh->tb", dp, states)
    ds = a[:, None, :, None] * dp.transpose(1, 0, 2)[None]
    de = a * (da - (a * da).sum(axis=0))
    g_attend = np.concatenate([np.einsum("tb,tbh->h", de, states[:, k]) for k in (0, 1)])
    ds += de[:, None, :, None] * net.attend.reshape(1, 2, 1, H)
    dx = np.zeros_like(x)
    g_around = np.zeros_like(net.around)
    dh = np.zeros((2, B, H), np.float32)
    for t in range(T - 1, -1, -1):
        h, r, z, n, un = memo[t]
        dh[0] += ds[t, 0]
        dh[1] += ds[T - 1 - t, 1]
        m = np.stack([mask[t], mask[T - 1 - t]])[:, :, None]
        dnew = np.where(m, dh, 0)
        dn = dnew * (1 - z) * (1 - n * n)
        dz = dnew * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        du = np.concatenate([dr, dz, dn * r], axis=2)
        g_around += np.matmul(h.transpose(0, 2, 1), du)
        gate = np.concatenate([dr, dz, dn], axis=2)
        dx[t, :, : 3 * H] += gate[0]
        dx[T - 1 - t, :, 3 * H :] += gate[1]
        dh = np.where(m, dnew * z, dh) + np.matmul(du, net.around.transpose(0, 2, 1))
    return loss, dx, g_around, g_attend, g_out, g_bias


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        by = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= by * m / (np.sqrt(v) + 1e-8)


def statistics(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document, from the logits of its windows: mean probability, largest logit, mean
    logit and the constant 1."""
    n = np.diff(np.append(first, len(logits)))
    mean_p = np.add.reduceat(_sigmoid(logits.astype(np.float64)), first) / n
    return np.stack([mean_p, np.maximum.reduceat(logits, first), np.add.reduceat(logits, first) / n, np.ones(len(n))], axis=1)


def train(texts: Iterable[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """The network from labelled texts: three quarters of them teach it windows, the rest how
    windows make a document's score. The texts are gone through once, before the labels are."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_in(t)], np.int32) for t in texts]
    y = np.array(labels, float)
    names = list(vocabulary)
    del vocabulary
    part = rng.random(len(docs)) < 0.75
    if not 0 < y[part].sum() < part.sum():
        part[:] = True
    in_docs = np.zeros(len(names), np.int32)
    for d, p in zip(docs, part):
        if p:
            in_docs[np.unique(d)] += 1
    known = {w: i for i, w in enumerate(sorted(names[k] for k in np.flatnonzero(in_docs >= WORD_DOCS)))}
    net = new_network(known, seed)
    rate = (y.sum() + 0.1) / (len(y) + 1)
    net.document = np.array([0, 0, 0, np.log(rate / (1 - rate))])
    if not 0 < y.sum() < len(y):
        return net
    made = [(b, k.astype(np.int32)) for b, k in (features_of(names[i : i + 30_000], known) for i in range(0, len(names), 30_000))]
    bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(b) for b, _ in made]))))
    buckets = np.concatenate([b for _, b in made])
    del made
    teach = [docs[k] for k in np.flatnonzero(part)]
    starts = [windows_of(len(own)) for own in teach]
    n = np.array([len(x) for x in starts])
    ids = np.full((n.sum(), WINDOW), -1, np.int32)
    for at, x, own in zip(np.cumsum(n) - n, starts, teach):
        for k, begin in enumerate(x):
            got = own[begin : begin + WINDOW]
            ids[at + k, : len(got)] = got
    label = np.repeat(y[part], n).astype(np.float32)
    weight = np.repeat(np.minimum(1, DOC_WEIGHT / np.maximum(n, 1)), n).astype(np.float32)
    adam = _Adam(net.params(), RATE)
    epochs = max(epochs, min(40, -(-LEAST_STEPS * BATCH // len(ids))))  # small samples are gone through more often
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            _learn(net, adam, ids[at], label[at], weight[at], bounds, buckets)
    rest = np.flatnonzero(~part) if (~part).any() and 0 < y[~part].sum() < (~part).sum() else np.arange(len(y))
    rest = rest[[len(docs[k]) > 0 for k in rest]]
    scorer, found = Scorer(net), [np.zeros((0, 4))]
    for lo, hi in chunks([len(docs[k]) for k in rest], 200_000):
        logits, first, _ = scorer.windows([[names[w] for w in docs[k]] for k in rest[lo:hi]])
        found.append(statistics(logits, first))
    net.document = _logistic(np.concatenate(found), y[rest])
    return net


def _learn(net: Network, adam: _Adam, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, bounds: np.ndarray, buckets: np.ndarray) -> None:
    mask = ids.T >= 0
    words, back = np.unique(np.where(mask, ids.T, 0), return_inverse=True)
    n = np.diff(bounds)[words]
    at = np.repeat(bounds[:-1][words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    own = buckets[at]
    inner = np.concatenate(([0], np.cumsum(n)))
    vec = word_vectors(net, inner, own)
    x = (vec @ net.into + net.bias)[back.reshape(mask.shape)]
    _, dx, g_around, g_attend, g_out, g_bias = gradients(net, x, mask, y, weight)
    flat = dx.reshape(-1, dx.shape[2])
    order = np.argsort(back.ravel(), kind="stable")
    per_word = np.add.reduceat(flat[order], np.searchsorted(back.ravel()[order], np.arange(len(words))), axis=0)
    dvec = (per_word @ net.into.T) / np.maximum(n, 1)[:, None]
    g_vectors = np.zeros_like(net.vectors)
    spread = np.repeat(dvec, n, axis=0)
    order = np.argsort(own, kind="stable")
    at_bucket, begin = np.unique(own[order], return_index=True)
    g_vectors[at_bucket] = np.add.reduceat(spread[order], begin, axis=0)
    adam.step([g_vectors, vec.T @ per_word, per_word.sum(axis=0), g_around, g_attend, g_out, g_bias])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """A network with a bounded table of the projected inputs of words already met."""

    def __init__(self, net: Network):
        self.net = net
        self.row: dict[str, int] = {}
        self.inputs = np.zeros((0, 6 * HIDDEN), np.float32)

    def _learn(self, words: set[str]) -> None:
        if len(self.row) + len(words) > CACHE_WORDS:
            self.row, self.inputs = {}, self.inputs[:0]
        new = sorted(w for w in words if w not in self.row)
        if new:
            base = len(self.inputs)
            made = word_vectors(self.net, *features_of(new, self.net.known)) @ self.net.into + self.net.bias
            self.inputs = np.concatenate([self.inputs, made.astype(np.float32)])
            self.row.update({w: base + i for i, w in enumerate(new)})

    def windows(self, docs: list[list[str]], batch: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits of all windows, each document's first window, documents): documents without
        words have no window and are left out."""
        found = [w for d in docs for w in d]
        at = list(map(self.row.get, found))
        if None in at:
            self._learn(set(found))
            at = list(map(self.row.__getitem__, found))
        ids = np.array(at, np.int64)
        n = np.array([len(d) for d in docs])
        base = np.cumsum(n) - n
        which = np.flatnonzero(n)
        starts = [windows_of(n[k]) for k in which]
        first = np.cumsum([0] + [len(s) for s in starts])[:-1].astype(np.int64)
        start = np.concatenate([s + base[k] for s, k in zip(starts, which)]) if len(which) else np.zeros(0, np.int64)
        size = np.concatenate([np.full(len(s), min(n[k], WINDOW)) for s, k in zip(starts, which)]) if len(which) else np.zeros(0, np.int64)
        logits = np.zeros(len(start), np.float32)
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), batch):
            w = order[i : i + batch]
            steps = np.arange(size[w[-1]])[:, None]
            mask = steps < size[w]
            x = self.inputs[ids[np.minimum(start[w] + steps, len(ids) - 1)]]
            logits[w] = run(self.net, x, mask)
        return logits, first, which

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A score from 0 to 1 for each text. A text without words has no window: the
        statistics of a window with probability 0 stand for it."""
        out = np.empty(len(texts))
        none = float(_sigmoid(np.array([0, -4.0, -4.0, 1]) @ self.net.document))
        for lo, hi in chunks([len(t or "") for t in texts], CHUNK_CHARS):
            logits, first, which = self.windows([words_in(t) for t in texts[lo:hi]])
            said = np.full(hi - lo, none)
            if len(which):
                said[which] = _sigmoid(statistics(logits, first) @ self.net.document)
            out[lo:hi] = said
        return out


def sample(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of the labelled documents that are learnt from, in a fixed order: by label
    1 and 0 those with the smallest hashes of their ids, ``rows`` at most. Held-out and
    unlabelled rows, null ids and null texts take no part; a document labelled both ways counts
    as toxic, an id with several texts has the one of the smallest hash."""
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    own = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    parts = [own.where(F.col("toxic") == k).orderBy(rank, "doc_id").limit(most).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__y")) for k, most in ((1, rows[0]), (0, rows[1]))]
    chosen = parts[0].unionAll(parts[1])  # sum(rows) rows at most, so it can be broadcast
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    got = texts.join(F.broadcast(chosen), texts["doc_id"] == F.col("__id"))
    one = got.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t"), F.first("__y").alias("toxic"))
    return one.orderBy("toxic", "__id").select("t.text", "toxic")


def train_on(docs: DataFrame, labels: DataFrame) -> Network:
    toxic: list[int] = []

    def texts() -> Iterator[str]:
        for r in sample(docs, labels).toLocalIterator():
            toxic.append(int(r["toxic"]))
            yield r["text"]

    net = train(texts(), toxic)
    give_back()
    return net


def toxic_score(text: Column, net: Network) -> Column:
    """DOUBLE column: the score of a text column; null counts as empty."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for s in batches:
            yield pd.Series(scorer.score(list(s)))
        del scorer
        give_back()

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, net: Network | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Null and empty texts have the score of a text without words. Without labels every score is
    0.1; with one label only, the smoothed share of label 1. Repeated rows give repeated
    results; labels only teach, and no column but the text enters a score.
    """
    net = net or train_on(docs, labels)
    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), toxic_score(F.col("text"), net).alias("score"))
    return said.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches ``threshold``. Null and empty
    texts have the score of a text without words, so that all of them stay or go; rows that
    repeat likewise. Without labels all stay."""
    net = train_on(docs, labels)
    return docs.where(toxic_score(F.col("text"), net) < threshold)
