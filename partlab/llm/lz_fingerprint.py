"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each is the shortest piece of what follows that is
not yet a phrase, so it prolongs a known phrase by one character. The hashes of the phrase set
give a minimum-hash signature; the share of equal places of two signatures estimates how much
of the phrase sets two texts have in common, a likeness like that of joint compression.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SegmentHash, mix64

#: Places of a signature; each is 16 bits of a minimum, 4 hexadecimal digits.
PLACES = 64
#: Rows of a block of the ordered table, and blocks, at most.
BLOCK_ROWS, MOST_BLOCKS = 1_000, 20_000

with np.errstate(over="ignore"):
    _FACTOR = mix64(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    _SHIFT = mix64(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_NOTHING = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)


def phrases(text: str, start: int, seen: set[str], stop_before: int | None = None) -> tuple[list[int], int]:
    """Parse ``text`` from ``start``; ``seen`` holds the phrases so far and gets the new ones.

    Gives the starts of the new phrases and where parsing ended. With ``stop_before`` it ends
    at the first phrase that would reach past that position. What is left at the end of the
    text is a known phrase (or nothing) and adds none. The set is closed under prefixes, so the
    length of the next phrase can be searched from the length of the last.
    """
    n = len(text)
    limit = n if stop_before is None else stop_before
    starts, i, k = [], start, 1
    add = seen.add
    while i < n:
        w = text[i : i + k]
        if w in seen:
            j = i + k
            while w in seen:
                if j >= n:
                    return starts, i
                j += 1
                w = text[i:j]
        else:
            while k > 1:
                shorter = text[i : i + k - 1]
                if shorter in seen:
                    break
                w = shorter
                k -= 1
        k = len(w)
        if i + k > limit:
            break
        starts.append(i)
        add(w)
        i += k
    return starts, i


def minima(code: np.ndarray, starts: list[int], end: int) -> np.ndarray:
    """The minima under each permutation of the phrases' hashes; phrase i runs to phrase i + 1."""
    if not starts:
        return _NOTHING
    first = starts[0]
    at = np.array(starts, np.int64) - first
    h = SegmentHash(code[first:end])(at, np.append(at[1:], end - first))
    out = np.empty(PLACES, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 4096):
            part = (h[i : i + 4096, None] * _FACTOR + _SHIFT).min(axis=0)
            out = part if i == 0 else np.minimum(out, part)
    return out


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def as_text(m: np.ndarray) -> str:
    """The signature's places as hexadecimal digits; a text without phrases has ``f`` only."""
    if m is _NOTHING:
        return "ffff" * PLACES
    return mix64(m.copy()).astype(">u2").tobytes().hex()


def fingerprint(text: str | None) -> str:
    text = text or ""
    starts, end = phrases(text, 0, set())
    return as_text(minima(_code(text), starts, end))


def likeness(a: str, b: str) -> float:
    """The share of equal places, 0 to 1. Texts without phrases are like each other only."""
    none = "ffff" * PLACES
    if a == none or b == none:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint16) for s in (a, b))
    return float((x == y).mean())


def edit(text: str, following: str) -> str:
    """The last floor(n / 4) characters replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def both(text: str, edited: str) -> tuple[str, str]:
    """Fingerprints of a text and of its edit; what both begin with is parsed once."""
    cut = len(text) - len(text) // 4
    seen: set[str] = set()
    shared, at = phrases(text, 0, seen, cut)
    code, code_e = _code(text), _code(edited)
    base = minima(code, shared, at)
    own, end = phrases(text, at, seen)
    for s, e in zip(own, [*own[1:], end]):
        seen.discard(text[s:e])
    other, end_e = phrases(edited, at, seen)

    def joined(x: np.ndarray) -> np.ndarray:
        return x if base is _NOTHING else base if x is _NOTHING else np.minimum(base, x)

    return as_text(joined(minima(code, own, end))), as_text(joined(minima(code_e, other, end_e)))


def fingerprints(text: Column) -> Column:
    """STRING column of fingerprints; null counts as the empty text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fingerprint)

    return run(text)


#: Ids pass Python as text, so that nulls and all 64 bits are kept.
RESULT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition; each row's next one follows it in its block. Two rows and
    their results are held at a time."""
    held: tuple | None = None  # (block, is own, doc_id, text)
    waiting: list | None = None  # a result that lacks the likeness to the next row
    out: list[list] = []
    for pdf in batches:
        for row in zip(pdf["block"], pdf["copied"], pdf["doc_id"], pdf["text"]):
            row = (row[0], row[1] == 0, row[2], row[3] if isinstance(row[3], str) else "")
            if held and held[1]:
                if held[0] != row[0]:
                    raise RuntimeError("a block ended without the row that follows it")
                edited = edit(held[3], row[3])
                own, other = both(held[3], edited)
                if waiting:
                    out.append([*waiting, likeness(waiting[3], own)])
                waiting = [held[2], len(held[3]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other)]
                if not row[1]:
                    out.append([*waiting, likeness(own, fingerprint(row[3]))])
                    waiting = None
                    held = None
                    continue
            held = row if row[1] else None
        if len(out) >= 500:
            yield _frame(out)
            out = []
    yield _frame(out)


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Per document: n_chars (code points; null text counts as empty), the fingerprints of its
    text and of its edited text, SHA-256 of the edited text, and the likeness of its fingerprint
    to the edited text's and to the next document's.

    Documents are ordered by doc_id (null first), then by the text's hash; the last is followed
    by the first. Equal rows are equal neighbours. The table is cut into blocks of consecutive
    ids; the row that follows a block's last goes there too, so one shuffle of the texts is all,
    and a task holds two rows at a time, however large its block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.select("doc_id").count()
    if not n:
        return docs.sparkSession.createDataFrame([], RESULT.replace("doc_id string", "doc_id long"))
    blocks = min(MOST_BLOCKS, max(1, n // BLOCK_ROWS))
    cuts: list[int] = []
    if blocks > 1:
        at = [i / blocks for i in range(1, blocks)]
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * blocks))).first()[0] or []))
    rows = rows.withColumn("h", F.xxhash64("text"))
    if cuts:
        known = F.from_json(F.lit(str([int(c) for c in cuts])), "array<bigint>")
        # how many cuts are at or below the id: a binary search by halves
        halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
        low = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.try_element_at(known, at + step) <= F.col("doc_id"), at + step).otherwise(at))
        block = F.when(F.col("doc_id").isNull(), 0).otherwise(low)
    else:
        block = F.lit(0)
    rows = rows.withColumn("block", block.cast("int"))
    # the first row of each block (as many as blocks, MOST_BLOCKS + 1 at most) also follows the block before
    firsts = rows.groupBy("block").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    order = W.orderBy("block")
    firsts = firsts.select(F.col("block").alias("fb"), F.col("f.doc_id").alias("fd"), F.col("f.h").alias("fh"), F.lag("block").over(order).alias("before"))
    last = F.max("fb").over(W.partitionBy())
    firsts = firsts.select("fb", "fd", "fh", F.coalesce("before", last).alias("before"))
    joined = rows.join(F.broadcast(firsts), (F.col("block") == F.col("fb")) & F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh")), "left")
    own = F.struct(F.col("block"), F.lit(0).alias("copied"))
    places = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("block"), F.lit(1).alias("copied")))).otherwise(F.array(own))
    dealt = joined.select("doc_id", "h", "text", F.explode(places).alias("p")).select("doc_id", "h", "text", "p.block", "p.copied")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "copied", "doc_id", "h", "text")
    out = ordered.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_neighbours, RESULT)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
