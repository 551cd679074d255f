"""Language identification by segmentation-marginalised unigrams.

For each language there is a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. Piece probabilities are fitted by expectation
maximisation, whose expected counts come from the forward and backward sums.

All words of a batch go through the lattice together: position by position in numpy.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, SegmentHash, chunks, give_back, held_out, materialize

#: Labelled documents that the probabilities are fitted on at most.
SAMPLE_ROWS = 3_000
ROUNDS, SMOOTHING = 3, 0.05
#: Tokens between white space that a worker remembers.
CACHE_WORDS = 180_000
NONE = "und"

_MARK = "▁"
_FILTER_BITS = 20


@lru_cache(maxsize=1)
def _letters() -> re.Pattern:
    """Runs of letters as str.isalpha has them. What re calls a word character, but no digit,
    also holds signs such as ½ and ②."""
    others = [c for c in range(sys.maxunicode + 1) if chr(c).isnumeric() and not chr(c).isdecimal() and not chr(c).isalpha()]
    starts = [c for i, c in enumerate(others) if not i or others[i - 1] != c - 1]
    ends = [c for i, c in enumerate(others) if i + 1 == len(others) or others[i + 1] != c + 1]
    return re.compile("[^\\W\\d_" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]+")


def words_in(text: str | None) -> list[str]:
    """Runs of letters of the lower-cased text."""
    return _letters().findall(text.lower()) if text else []


class Lattice:
    """Finds the vocabulary's pieces in words. Id 0 is "a character that no piece is"; the last
    row of a probability table is for "no piece" and holds zeros."""

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in pieces if p]
        self.longest = max(map(len, self.pieces), default=1)
        code = np.frombuffer("".join(self.pieces).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(p) for p in self.pieces])
        h = SegmentHash(code)(np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(h)
        self.hash, self.id = h[order], (order + 1).astype(np.int32)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[h >> np.uint64(64 - _FILTER_BITS)] = True
        self.none = len(self.pieces) + 1

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids[k - 1, position]): the piece of k characters from each position of all
        marked words one after another."""
        lengths = np.array([len(w) + 1 for w in words])
        code = np.frombuffer("".join(_MARK + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(code)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # characters to the word's end
        h, out = SegmentHash(code), np.full((self.longest, n), self.none, np.int32)
        at = np.arange(n)
        for k in range(1, self.longest + 1):
            at = at[left[at] >= k]
            if not len(at):
                break
            x = h(at, at + k)
            hit = self.seen[x >> np.uint64(64 - _FILTER_BITS)]
            y, where = x[hit], at[hit]
            j = np.searchsorted(self.hash, y)
            j[j == len(self.hash)] = 0
            good = self.hash[j] == y
            out[k - 1, where[good]] = self.id[j[good]]
            if k == 1:
                out[0, out[0] == self.none] = 0
        return lengths, out


def _blocks(lengths: np.ndarray, cells: int = 1 << 17) -> Iterator[np.ndarray]:
    """Words by falling length, in blocks of so many table cells at most (or a single word)."""
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        n = max(1, cells // (int(lengths[order[i]]) + 1))
        yield order[i : i + n]
        i += n


def log_likelihood(lattice: Lattice, table: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), words x languages. ``table``: (pieces + 2) x languages."""
    out = np.zeros((len(words), table.shape[1]), np.float64)
    if not words:
        return out
    lengths, ids = lattice.ids(words)
    starts = np.cumsum(lengths) - lengths
    longest = lattice.longest
    for block in _blocks(lengths):
        n, at = lengths[block], starts[block]
        alpha: list[np.ndarray] = [np.ones((len(block), table.shape[1]))]
        scale = np.zeros(len(block))
        for j in range(1, n[0] + 1):
            live = int(np.searchsorted(-n, -j, side="right"))  # words of j characters at least
            a = np.zeros((live, table.shape[1]))
            for k in range(1, min(longest, j) + 1):
                i = ids[k - 1, at[:live] + (j - k)]
                has = np.flatnonzero(i != lattice.none)
                if len(has):
                    a[has] += alpha[-k][has] * table[i[has]]
            alpha.append(a)
            done = int(np.searchsorted(-n, -j - 1, side="right"))
            if done < live:
                out[block[done:live]] = np.log(a[done:] + 1e-300) + scale[done:live, None]
            if j % 8 == 0 and done:
                recent = alpha[-longest:]
                top = np.maximum(np.max([x[:done].max(axis=1) for x in recent], axis=0), 1e-300)
                alpha = [x[:done] / top[:, None] for x in recent]
                scale = scale[:done] + np.log(top)
            else:
                alpha = alpha[-longest:]
    return out


#: Positions after which the forward and backward sums of a word are scaled anew.
_SCALED = 24


def expected_counts(lattice: Lattice, p: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language: forward and backward sums over all segmentations
    of words of any length. Position by position a sum is a number and the logarithm of its
    scale, so that no sum of a long word is lost."""
    out = np.zeros(len(p))
    if not words:
        return out
    lengths, ids = lattice.ids(words)
    starts = np.cumsum(lengths) - lengths
    for block in _blocks(lengths):
        n, at = lengths[block], starts[block]
        m, every = int(n[0]), np.arange(len(block))
        f, b = np.zeros((m + 1, len(block))), np.zeros((m + 1, len(block)))
        fs, bs = np.zeros((m + 1, len(block))), np.zeros((m + 1, len(block)))
        f[0] = 1
        b[n, every] = 1
        live = [int(np.searchsorted(-n, -j, side="right")) for j in range(m + 1)]

        def pieces(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
            """Which words have a piece of k characters at position j, and which."""
            i = ids[k - 1, at[: live[j + k]] + j]
            has = np.flatnonzero(i != lattice.none)
            return has, i[has]

        for j in range(1, m + 1):
            fs[j] = fs[j - 1]
            for k in range(1, min(lattice.longest, j) + 1):
                w, i = pieces(j - k, k)
                f[j, w] += f[j - k, w] * p[i] * (1 if m <= _SCALED else np.exp(fs[j - k, w] - fs[j, w]))
            if j % _SCALED == 0:
                fs[j, : live[j]] += np.log(f[j, : live[j]])
                f[j, : live[j]] = 1
        for j in range(m - 1, -1, -1):
            c = live[j + 1]
            bs[j, :c] = bs[j + 1, :c]
            for k in range(1, min(lattice.longest, m - j) + 1):
                w, i = pieces(j, k)
                b[j, w] += b[j + k, w] * p[i] * (1 if m <= _SCALED else np.exp(bs[j + k, w] - bs[j, w]))
            if j and j % _SCALED == 0:
                bs[j, :c] += np.log(b[j, :c])
                b[j, :c] = 1
        all_f, all_fs = f[n, every], fs[n, every]
        for j in range(m):
            for k in range(1, min(lattice.longest, m - j) + 1):
                w, i = pieces(j, k)
                share = f[j, w] * p[i] * b[j + k, w] / all_f[w] * np.exp(fs[j, w] + bs[j + k, w] - all_fs[w])
                out += np.bincount(i, share * weight[block[w]], len(out))
    return out


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log
    table: np.ndarray  # (pieces + 2) x languages
    vocabulary: str  # the model file that the pieces are from


@lru_cache(maxsize=2)
def _lattice(vocabulary: str) -> Lattice:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    # texts are lower-cased: pieces with capitals never occur in them
    return Lattice(sorted({p for p in pieces if p == p.lower() and (p.strip(_MARK).isalpha() or p == _MARK)}))


def counted(texts: Iterable[str]) -> dict[str, int]:
    """How often each word is in the texts."""
    count: dict[str, int] = {}
    for t in texts:
        for w in words_in(t):
            count[w] = count.get(w, 0) + 1
    return count


def fit(texts: list[str], languages: list[str], vocabulary: str, rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language from labelled texts."""
    names = sorted(set(languages))
    words = {lang: counted(t for t, own in zip(texts, languages) if own == lang) for lang in names}
    return fit_counts(words, {lang: languages.count(lang) for lang in names}, vocabulary, rounds)


def fit_counts(count: dict[str, dict[str, int]], docs: dict[str, int], vocabulary: str, rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language from how often each word occurs in its documents, and
    the number of these."""
    lattice = _lattice(vocabulary)
    names = sorted(docs)
    size = lattice.none + 1
    table = np.zeros((size, len(names)))
    for j, lang in enumerate(names):
        own = count.get(lang, {})
        words = sorted(own)
        weight = np.array([own[w] for w in words], float)
        p = np.zeros(size)
        p[: lattice.none] = 1 / lattice.none
        for _ in range(rounds):
            p[: lattice.none] = expected_counts(lattice, p, words, weight)[: lattice.none] + SMOOTHING
            p /= p.sum()
        table[:, j] = p
    prior = np.log(np.array([docs[x] for x in names], float) + 1)
    return Model(names, prior, table, vocabulary)


class Scorer:
    """A model with a bounded table of what was already scored: for each token between white
    space the log-likelihoods of its words, and their number."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, _lattice(model.vocabulary)
        self.row: dict[str, int] = {}
        self.said = np.zeros((0, len(model.languages) + 1), np.float64)

    def _learn(self, tokens: set[str]) -> None:
        if len(self.row) + len(tokens) > CACHE_WORDS:
            self.row, self.said = {}, self.said[:0]
        new = sorted(w for w in tokens if w not in self.row)
        if new:
            split = [_letters().findall(t) for t in new]
            n = np.array([len(x) for x in split])
            add = np.zeros((len(new), self.said.shape[1]))
            if n.any():
                each = log_likelihood(self.lattice, self.model.table, [w for x in split for w in x])
                has = np.flatnonzero(n)
                add[has, :-1] = np.add.reduceat(each, (np.cumsum(n) - n)[has], axis=0)
                add[:, -1] = n
            base = len(self.said)
            self.said = np.concatenate([self.said, add])
            self.row.update({w: base + i for i, w in enumerate(new)})

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, posterior probability) of each text; ``und`` and 0 without letters."""
        lang, score = [NONE] * len(texts), np.zeros(len(texts))
        if not self.model.languages:
            return lang, score
        for lo, hi in chunks([len(t or "") for t in texts], CHUNK_CHARS):
            split = [t.lower().split() if t else [] for t in texts[lo:hi]]
            found = [w for s in split for w in s]
            if not found:
                continue
            at = list(map(self.row.get, found))
            if None in at:
                self._learn(set(found))
                at = list(map(self.row.__getitem__, found))
            n = np.array([len(s) for s in split])
            has = np.flatnonzero(n)
            total = np.add.reduceat(self.said[at], (np.cumsum(n) - n)[has], axis=0)
            total, has = total[total[:, -1] > 0, :-1] + self.model.prior, has[total[:, -1] > 0]
            total -= total.max(axis=1, keepdims=True, initial=-np.inf)
            post = np.exp(total)
            post /= post.sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            score[lo + has] = post[np.arange(len(has)), best]
            for i, b in zip(has, best):
                lang[lo + i] = self.model.languages[b]
        return lang, score


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, lang) of ``rows`` documents at most that may be learnt from: those with the
    smallest hashes of id, text and language; rows equal in these three count once. Held-out
    rows, null texts and null languages take no part."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull())
    by_id, by_text = F.xxhash64(F.col("doc_id").cast("string")), F.xxhash64("text", "lang")
    may = labelled.where(F.col("text").isNotNull()).select(by_id.alias("h"), by_text.alias("k"), "text", "lang")
    # among ids with small hashes only: as large a share as it takes for enough rows that differ
    n = labelled.count()
    share = 4 * rows / n if n else 1.0
    while True:
        among = may if share >= 1 else materialize(may.where(F.col("h") < int(-(2**63) + share * 2**64)), "language-sample")
        pairs = among.select("h", "k").distinct()
        if share >= 1 or pairs.count() >= rows:
            break
        share *= 4
    cut = pairs.orderBy("h", "k").limit(rows).agg(F.max(F.struct("h", "k")).alias("cut")).first()[0]
    if cut is None:
        return docs.select("text", "lang").limit(0)
    chosen = among.where(F.struct("h", "k") <= F.struct(F.lit(cut["h"]).alias("h"), F.lit(cut["k"]).alias("k")))
    return chosen.dropDuplicates(["h", "k"]).select("text", "lang")


def train(docs: DataFrame, vocabulary: str, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on a sample, whose words are counted where its texts are: the driver gets each word
    of a language once."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                n = counted(texts)
                # a row without a word stands for the documents
                yield pd.DataFrame({"lang": lang, "word": [None, *n], "n": [len(texts), *n.values()]})

    count: dict[str, dict[str, int]] = {}
    docs_of: dict[str, int] = {}
    for lang, word, n in sample(docs, rows).mapInPandas(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        if word is None:
            docs_of[lang] = n
        else:
            count.setdefault(lang, {})[word] = n
    model = fit_counts(count, docs_of, vocabulary)
    del count
    give_back()
    return model


def predicted(text: Column, model: Model) -> Column:
    """STRUCT<lang: STRING, score: DOUBLE> of a text column."""
    shared = _broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for s in batches:
            lang, score = scorer.score(list(s))
            yield pd.DataFrame({"lang": lang, "score": score})
        del scorer
        give_back()

    return run(text)


def _broadcast(model: Model):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)


def identify(docs: DataFrame, vocabulary: str, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the posterior probability).

    Texts that are null, empty or without a letter get ``und`` and 0; so does every text if
    there was nothing to learn from. Ties go to the first language by name. Repeated rows give
    repeated results. Only the text is an input of a prediction.
    """
    model = model or train(docs, vocabulary)
    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without rows whose language can't be told: ``und``, or a score
    below ``least``. Null and empty texts and texts without a letter go; rows that repeat stay
    or go alike; without a row to learn from all go."""
    model = train(docs, vocabulary)
    p = predicted(F.col("text"), model)
    name = "__language"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, p).where((F.col(f"{name}.lang") != NONE) & (F.col(f"{name}.score") >= least)).drop(name)
