"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick token positions of a short span and ignore the others, so a span still hashes
alike after a substitution at an ignored place. Every mask is applied at every position of test
items and documents; equal hashes are hits. A hit fixes how item and document are aligned; the
tokens along that alignment are then compared. A match counts 1 and a mismatch -3, so what has a
sum above 0 is over 75 % equal. An overlap is each best run of enough tokens, and each item that
has such a sum as a whole: near an end, a run loses all beyond a substitution. Items shorter
than a mask are looked for as whole sequences of tokens.

A hit that goes on from a hit one token before is on the same alignment and is left out, so
that a repeated line makes as many hits as alignments, not as many as pairs of repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, chunks, materialize, mix64, words_of

#: Positions that count, by mask. All have eight places and weight six; each place is ignored by
#: one at least, so that one substitution hides no item of eight tokens or more.
MASKS = ("11011011", "11101101", "10110111", "11110011", "11001111", "01111110")
SPAN = 8
#: Tokens of a run at least (a shorter item: all its tokens), and what a mismatch counts.
LEAST_TOKENS, MISMATCH = 13, 3
#: Bytes of the index that one block, which is broadcast, may hold. A larger benchmark is
#: searched block after block, each against all documents.
BLOCK_BYTES = 48 << 20
#: What a token takes in the index: its hash and, by mask, a seed, the seed before and a place.
TOKEN_BYTES = 8 + 24 * len(MASKS)
#: Tokens along alignments that are compared in one step.
STEP = 1 << 21

_FILTER_BITS = 20
with np.errstate(over="ignore"):
    _FACTOR = mix64(np.arange(1, SPAN + 1, dtype=np.uint64)) | np.uint64(1)

#: Letters of scripts that put no blanks between words: each is a token of its own.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_LETTER = re.compile(f"([{_UNSPACED}])")


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts one after another, and each text's bounds in them: lower-cased
    runs of anything but ASCII signs, and single letters of scripts without blanks."""
    low = [(t or "").lower() for t in texts]
    return words_of([t if t.isascii() else _LETTER.sub(r" \1 ", t) for t in low], punctuation=True)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask at each position."""
    n = max(len(words) - SPAN + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, on in enumerate(mask):
            if on == "1":
                out += words[k : k + n] * _FACTOR[k]
        return mix64(out)


def _sequence(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens from each position."""
    m = max(len(words) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += words[k : k + m] * _FACTOR[k]
        return mix64(out + np.uint64(n))


def _before(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """40 bits of the seed one position before; 0 and 1 are left for the beginnings of texts."""
    return h[np.maximum(at - 1, 0)] >> np.uint64(24) | np.uint64(2)


@dataclass
class Index:
    """A block of test items: tokens; by mask (distinct seeds, where each begins, seed number and
    seed before, item, position), sorted; by length below the span (hashes, items)."""

    ids: list[int | None]
    tokens: np.ndarray
    bounds: np.ndarray
    tables: list[tuple[np.ndarray, ...]]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build(ids: list[int | None], texts: list[str]) -> Index:
    words, bounds = tokens_of(texts)
    tables = []
    item = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    for mask in MASKS:
        h = seeds(words, mask)
        at = np.arange(len(h))
        at = at[at + SPAN <= bounds[item[at] + 1]] if len(h) else at
        pos = (at - bounds[item[at]]).astype(np.int32)
        before = np.where(pos == 0, np.uint64(0), _before(h, at))
        order = np.lexsort((before, h[at]))
        own, start, number = np.unique(h[at][order], return_index=True, return_inverse=True)
        tables.append((own, np.append(start, len(order)), number.astype(np.uint64) << np.uint64(40) | before[order], item[at][order], pos[order]))
    short = {}
    length = np.diff(bounds)
    for n in range(1, SPAN):
        which = np.flatnonzero(length == n)
        if len(which):
            h = _sequence(words, n)[bounds[:-1][which]]
            order = np.argsort(h, kind="stable")
            short[n] = h[order], which[order]
    return Index(ids, words, bounds, tables, short)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the values of all ranges [lo, hi)."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        self.seen = []
        for own, *_ in index.tables:
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[own >> np.uint64(64 - _FILTER_BITS)] = True
            self.seen.append(seen)

    def alignments(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (document, item, document position - item position) of all hits."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, seen, (own, start, key, item, pos) in zip(MASKS, self.seen, self.index.tables):
            x = seeds(words, mask)
            at = np.flatnonzero(seen[x >> np.uint64(64 - _FILTER_BITS)])
            if not len(at) or not len(own):
                continue
            r = np.minimum(np.searchsorted(own, x[at]), len(own) - 1)
            hit = own[r] == x[at]
            at, r = at[hit], r[hit]
            doc = np.searchsorted(bounds, at, "right") - 1
            whole = at + SPAN <= bounds[doc + 1]
            at, r, doc = at[whole], r[whole], doc[whole]
            before = np.where(at == bounds[doc], np.uint64(1), _before(x, at))
            k = r.astype(np.uint64) << np.uint64(40) | before
            # of a seed's places those that go on from a hit are a range in the middle
            lo, hi = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
            for a, b in ((start[r], lo), (hi, start[r + 1])):
                n = np.cumsum(np.maximum(b - a, 0))
                for i, j in chunks((b - a).tolist(), STEP) if len(n) and n[-1] else ():
                    who, p = _ranges(a[i:j], b[i:j])
                    who += i
                    found.append(np.unique(np.stack([doc[who], item[p], at[who] - bounds[doc[who]] - pos[p]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def _equal(self, words: np.ndarray, bounds: np.ndarray, where: np.ndarray) -> np.ndarray:
        """How many tokens are equal along each alignment."""
        out = np.zeros(len(where), np.int64)
        doc, item, shift = where.T
        i0, d0 = self.index.bounds[item], bounds[doc]
        first = np.maximum(0, -shift)
        n = np.minimum(self.index.bounds[item + 1] - i0, bounds[doc + 1] - d0 - shift) - first
        for a, b in chunks(n.tolist(), STEP):
            who, p = _ranges(first[a:b], first[a:b] + n[a:b])
            who += a
            same = self.index.tokens[i0[who] + p] == words[d0[who] + shift[who] + p]
            out[a:b] = np.bincount(who - a, same, b - a)
        return out

    def overlaps(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text its verified overlaps (item id, start and end token, equal tokens): of
        each item the one with most equal tokens, the first of equals."""
        out: list[list[tuple[int | None, int, int, int]]] = [[] for _ in texts]
        for lo, hi in chunks([len(t or "") for t in texts], CHUNK_CHARS):
            words, bounds = tokens_of(texts[lo:hi])
            best = self._short(words, bounds)
            where = self.alignments(words, bounds)
            length = np.diff(self.index.bounds)[where[:, 1]]
            equal = self._equal(words, bounds, where)
            may = equal * (MISMATCH + 1) > MISMATCH * np.minimum(LEAST_TOKENS, length)
            where, equal = where[may], equal[may]
            # of a document and an item: first the alignment of most equal tokens
            order = np.lexsort((where[:, 2], -equal, where[:, 1], where[:, 0]))
            where, equal = where[order], equal[order]
            new = np.flatnonzero(np.any(np.diff(where[:, :2], axis=0, prepend=-1), axis=1))
            for a, b in zip(new, [*new[1:], len(where)]):
                doc, item = int(where[a, 0]), int(where[a, 1])
                got = self._best(words[bounds[doc] : bounds[doc + 1]], item, where[a:b, 2], equal[a:b])
                if got:
                    best[doc, item] = got
            for (doc, item), (equal_tokens, a, b) in sorted(best.items()):
                out[lo + doc].append((self.index.ids[item], a, b, equal_tokens))
        return out

    def _best(self, words: np.ndarray, item: int, shifts: np.ndarray, equal: np.ndarray) -> tuple[int, int, int] | None:
        """(equal tokens, start, end) of the best overlap of a document's words with an item.
        No run has more equal tokens than its alignment, so most alignments needn't be cut into
        runs once one is."""
        i0, i1 = self.index.bounds[item], self.index.bounds[item + 1]
        best: tuple[int, int, int] | None = None
        left = np.arange(len(shifts))
        while len(left):
            shift = int(shifts[left[0]])
            first, end = max(0, -shift), min(int(i1 - i0), len(words) - shift)
            same = self.index.tokens[i0 + first : i0 + end] == words[shift + first : shift + end]
            runs = _runs(same, min(LEAST_TOKENS, int(i1 - i0)))
            at = np.flatnonzero(same)
            if len(at) > MISMATCH * (i1 - i0 - len(at)):
                runs.append((int(at[0]), int(at[-1]) + 1))
            for a, b in runs:
                got = (int(same[a:b].sum()), shift + first + a, shift + first + b)
                if best is None or (-got[0], got[1], got[2]) < (-best[0], best[1], best[2]):
                    best = got
            left = left[1:]
            if best:  # a run begins at its alignment's shift at least
                left = left[(equal[left] > best[0]) | (equal[left] == best[0]) & (np.maximum(shifts[left], 0) < best[1])]
        return best

    def _short(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) -> (equal tokens, start, end) of the first copies of items shorter
        than the masks."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, (h, which) in self.index.short.items():
            x = _sequence(words, n)
            at = np.flatnonzero(h[np.minimum(np.searchsorted(h, x), len(h) - 1)] == x)
            doc = np.searchsorted(bounds, at, "right") - 1
            whole = at + n <= bounds[doc + 1]
            at, doc = at[whole], doc[whole]
            _, once = np.unique(np.stack([doc.astype(np.uint64), x[at]], axis=1), axis=0, return_index=True)
            for k in once:
                for j in range(int(np.searchsorted(h, x[at[k]], "left")), int(np.searchsorted(h, x[at[k]], "right"))):
                    start = int(at[k] - bounds[doc[k]])
                    out[int(doc[k]), int(which[j])] = (n, start, start + n)
        return out


def _runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The best run, and those to the left and right of it likewise, that have ``least`` tokens."""
    out, parts = [], [(0, len(same))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < least:
            continue
        a, b = _best_run(same[lo:hi])
        if b - a >= least:
            out.append((lo + a, lo + b))
        if b > a:
            parts += [(lo + b, hi), (lo, lo + a)]
    return out


def _best_run(same: np.ndarray) -> tuple[int, int]:
    """[start, end) of the run with the largest sum, a match 1 and a mismatch -MISMATCH; of
    equals the first, as long as it can be."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISMATCH))))
    low = np.minimum.accumulate(total)
    gain = total - low
    if not gain.max():
        return 0, 0
    b = int(gain.argmax())
    a = int((total == low[b]).argmax())
    b = int(np.flatnonzero((gain == gain[b]) & (low == low[b]))[-1])
    return a, b


OVERLAP = "array<struct<item_id:bigint,start:int,end:int,equal:int>>"


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    """Indexes of the benchmark's blocks, of bounded size each (a larger single item is a block
    of its own). Null texts are no items; of items with equal texts that of the smallest id
    stands for all."""
    b = benchmark.where(F.col(text_col).isNotNull()).groupBy(F.lower(text_col).alias("t")).agg(F.min(F.struct(F.col(id_col).cast("long").alias("i"))).alias("i")).select("i.i", "t")
    tokens = b.agg(F.sum(F.regexp_count("t", F.lit(r"[0-9A-Za-z]+|[^\x00-\x7F]")))).first()[0] or 0
    size = int(tokens) * TOKEN_BYTES
    n = 1 + 2 * size // block_bytes if size > block_bytes else 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        rows = sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield build([r[0] for r in rows], [r[1] for r in rows])


def _found(text: Column, index: Index) -> Column:
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(index)

    @F.pandas_udf(OVERLAP)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(shared.value)
        names = ("item_id", "start", "end", "equal")
        for s in batches:
            yield pd.Series([[dict(zip(names, o)) for o in x] for x in searcher.overlaps(list(s))], dtype=object)

    return run(text)


def overlaps(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of (doc_id, text): doc_id and ``overlaps``, the verified overlaps with benchmark
    items, ordered by item. One block of the benchmark (the usual case) takes one pass without a
    shuffle; of more blocks, each pass writes only the rows that have overlaps, which are then
    joined on id and text hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for index in _blocks(benchmark, item_col, item_text, block_bytes):
        if not len(index.ids):
            continue
        parts.append(index)
        if len(parts) == 2:
            break
    if not parts:
        return rows.select("doc_id", F.array().cast(OVERLAP).alias("overlaps"))
    if len(parts) == 1:
        return rows.select("doc_id", _found(F.col("text"), parts[0]).alias("overlaps"))
    del parts
    keyed = rows.withColumn("h", F.xxhash64("text"))
    hits = None
    for index in _blocks(benchmark, item_col, item_text, block_bytes):
        got = keyed.select("doc_id", "h", _found(F.col("text"), index).alias("o")).where(F.size("o") > 0).distinct()
        got = materialize(got, "overlaps")
        hits = got if hits is None else hits.unionAll(got)
    merged = hits.groupBy("doc_id", "h").agg(F.array_sort(F.flatten(F.collect_list("o"))).alias("o")).select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "o")
    joined = keyed.select("doc_id", "h").join(merged, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    return joined.select("doc_id", F.coalesce("o", F.array().cast(OVERLAP)).alias("overlaps"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated (it has a verified overlap), item_ids (of all items it
    overlaps, ascending, null first), longest (equal tokens of the longest overlap, 0 without).

    Null and empty texts, texts without a letter or digit, and an empty benchmark give no
    overlap. Repeated rows give repeated results; items with equal texts count as one, that of
    the smallest id. Items of fewer than eight tokens are found where all their tokens stand in
    a row.
    """
    o = overlaps(docs, benchmark)
    ids = F.sort_array(F.array_distinct(F.transform("overlaps", lambda x: x["item_id"])))
    longest = F.coalesce(F.array_max(F.transform("overlaps", lambda x: x["equal"])), F.lit(0))
    return o.select("doc_id", "overlaps").select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), ids.alias("item_ids"), longest.alias("longest"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns, without the rows that have a verified overlap with an item. Null
    and empty texts stay; rows that repeat stay or go alike; an empty benchmark lets all stay."""
    for i, index in enumerate(_blocks(benchmark, "item_id", "text", block_bytes)):
        if i:  # so that a worker holds one block at a time
            docs = materialize(docs, "decontaminated")
        docs = docs.where(F.size(_found(F.col("text"), index)) == 0)
    return docs


__all__ = ["build", "contamination", "drop_contaminated", "overlaps", "Searcher"]
