"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A text is cut where no piece of the vocabulary can reach across (before a word mark, around
characters that no piece holds, after a letter that a comma or another never-joined sign
follows). Each such part is encoded by backtracking: an Aho-Corasick automaton gives the
longest piece at every position; a piece is taken only if it is compatible with the piece
before it, that is, if merging the two pieces' characters anew gives those two pieces; if no
shorter piece fits either, the last piece is given back and its end is marked in a bitfield of
failed positions, so each position fails once at most. The sequence found is the one that
merging by score would give.

Parts recur, so a worker keeps a bounded table of encoded parts.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

#: Parts that each of a worker's two tables remembers, and the longest part (characters). When
#: one is full, the older one is emptied: a matter of speed only.
CACHE_PARTS, CACHE_CHARS = 90_000, 40
#: Pairs of pieces whose check is remembered.
CACHE_PAIRS = 200_000

MARK = "▁"
LETTER = r"[^\W\d_]"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol message."""
    i = 0

    def number() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        n = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i : i + n]
        i += n


@dataclass(frozen=True)
class Normaliser:
    """What a model does to a text before it is cut into pieces."""

    mark_first: bool

    @classmethod
    def of(cls, model: bytes) -> Normaliser:
        """Read from a serialised model. Models that aren't of the merge type, or that change
        a text by more than the mark for blanks, are refused: they would be encoded wrongly."""
        trainer = dict(_fields(b"".join(v for k, v in _fields(model) if k == 2)))
        rules = dict(_fields(b"".join(v for k, v in _fields(model) if k == 3)))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type (BPE) model")
        if rules.get(2) or rules.get(6) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model's normaliser changes texts: only the mark for blanks is supported")
        return cls(bool(rules.get(3, 1)))

    def marked(self, text: str) -> str:
        return (MARK if self.mark_first else "") + text.replace(" ", MARK)


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(i) for i in self.bytes)
        normal = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.ids}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:  # a single character is the shortest match anyway
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pair: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.normaliser = Normaliser.of(sp.serialized_model_proto())
        self.parts = self._parts()
        cut = [p for p in self.ids if self.parts.findall(p) != [p]]
        if cut:
            raise ValueError(f"pieces that the cutting pattern splits: {cut[:5]}")
        self.texts = ["" if sp.is_control(i) else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.texts[self.unk] = " ⁇ "
        self.byte_of = {i: b for b, i in enumerate(self.bytes)} if self.has_bytes else {}

    def forget(self) -> None:
        """Drops what was remembered: a worker outlives its task."""
        for memory in (self.pair, self.cache, self.older):
            memory.clear()
        give_back()

    def _parts(self) -> re.Pattern:
        """What no piece reaches across, found from the vocabulary itself."""
        inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(x[0] != MARK and x[1] == MARK for x in inside):
            return re.compile(r"(?s).+")
        known = {c for p in self.ids for c in p}
        # one class of letters, for what the vocabulary holds and for the pattern: it has signs
        # such as ², which are no letters to str.isalpha
        letter = re.compile(LETTER).match
        never = [c for c in map(chr, range(33, 127)) if not c.isalnum() and not any(x[1] == c and letter(x[0]) for x in inside)]
        lone = [c for c in map(chr, [*range(1, 32)]) if c not in known]
        stop, one = re.escape("".join(never)), re.escape("".join(lone))
        # a lone sign; marks and then either letters (up to a sign that never follows one) or what comes before the next mark
        letters = rf"{LETTER}+(?=[{stop}{one}{MARK}]|\Z)" if never or one else r"(?!)"
        return re.compile(rf"[{one}]|{MARK}*{letters}|{MARK}*[^{MARK}{one}]+|{MARK}+" if one else rf"{MARK}*{letters}|{MARK}*[^{MARK}]+|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """Merging from single characters, best score first, leftmost among equals: the
        definition, used for the pair checks and by the tests."""
        if len(text) <= 48:  # a scan is quicker than a heap
            return self._merged_short(list(text))
        sym: list[str | None] = list(text)
        after = [*range(1, len(sym)), -1]
        before = [-1, *range(len(sym) - 1)]
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and (s := sym[i] + sym[j]) in self.score:
                heapq.heappush(heap, (-self.score[s], i, s, j))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, s, j = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or after[i] != j or sym[i] + sym[j] != s:
                continue
            sym[i], sym[j] = s, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in sym if s is not None]

    def _merged_short(self, sym: list[str]) -> list[str]:
        score = self.score.get
        none = float("-inf")
        gain = [score(a + b, none) for a, b in zip(sym, sym[1:])]
        while gain:
            best = max(gain)
            if best == none:
                break
            i = gain.index(best)
            s = sym[i] = sym[i] + sym[i + 1]
            del sym[i + 1], gain[i]
            if i < len(gain):
                gain[i] = score(s + sym[i + 1], none)
            if i:
                gain[i - 1] = score(sym[i - 1] + s, none)
        return sym

    def fits(self, left: str, right: str) -> bool:
        found = self.pair.get((left, right))
        if found is None:
            if len(self.pair) >= CACHE_PAIRS:
                self.pair.clear()
            found = self.pair[left, right] = self.merged(left + right) == [left, right]
        return found

    def backtrack(self, part: str) -> list[str]:
        """The pieces of a part; characters that no piece holds stand alone."""
        n = len(part)
        pairs, shorter = self.pair, self.shorter
        longest = [1] * n
        for end, k in self.automaton.iter(part):
            at = end - k + 1
            if k > longest[at]:
                longest[at] = k
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        i = 0
        left: str | None = None
        piece: str | None = part[: longest[0]]
        if longest[0] == n:
            alone = self.alone.get(part)
            if alone is None:
                alone = self.alone[part] = self.merged(part) == [part]
            if alone:
                return [part]
            piece = shorter.get(part)
        while True:
            if piece is not None:
                end = i + len(piece)
                if not failed[end >> 3] & (1 << (end & 7)):
                    fits = left is None or pairs.get((left, piece))
                    if fits is None:
                        fits = self.fits(left, piece)
                    if fits:
                        out.append(piece)
                        if end >= n:
                            return out
                        i = end
                        left = piece
                        piece = part[i : i + longest[i]]
                        continue
                piece = shorter.get(piece)
                if piece is not None:
                    continue
            failed[i >> 3] |= 1 << (i & 7)
            if not out:
                raise ValueError(f"no encoding of {part!r}")
            back = out.pop()
            i -= len(back)
            left = out[-1] if out else None
            piece = shorter.get(back)

    def part_ids(self, part: str) -> bytes:
        """Ids of a part, little-endian unsigned 32-bit integers."""
        pieces = self.backtrack(part)
        ids = list(map(self.ids.get, pieces))
        if None in ids:
            ids = []
            for p in pieces:
                i = self.ids.get(p)
                if i is not None:
                    ids.append(i)
                elif self.has_bytes:
                    ids += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
                else:
                    ids.append(self.unk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str | None) -> bytes:
        """All ids of a text with begin and end ids, as little-endian unsigned 32-bit integers.
        Null counts as the empty text."""
        ends = np.array([self.bos, self.eos], "<u4").tobytes()
        if not text:
            return ends
        found = self.parts.findall(self.normaliser.marked(text))
        cache, older = self.cache, self.older
        out = list(map(cache.get, found))
        if None in out:
            for k, (part, got) in enumerate(zip(found, out)):
                if got is None:
                    got = cache.get(part) or older.get(part) or self.part_ids(part)
                    if len(part) <= CACHE_CHARS:
                        if len(cache) >= CACHE_PARTS:  # what isn't met again while the next fills up goes
                            older = self.older = cache
                            cache = self.cache = {}
                        cache[part] = got
                    out[k] = got
        return ends[:4] + b"".join(out) + ends[4:]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids give nothing, runs of byte ids their UTF-8 text (a byte
        that is part of no character gives U+FFFD), the mark that encoding put first is taken off."""
        table, byte_of = self.texts, self.byte_of
        if not byte_of or byte_of.keys().isdisjoint(ids):
            said = "".join(map(table.__getitem__, ids))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_utf8(run))
                    run.clear()
                parts.append(table[i])
            if run:
                parts.append(_utf8(run))
            said = "".join(parts)
        if not self.normaliser.mark_first:
            return said
        first = next((i for i in ids if table[i] or i in byte_of), None)
        return said[1:] if first is not None and first not in byte_of and table[first].startswith(" ") and first != self.unk else said


def _utf8(run: bytes) -> str:
    out, raw = [], bytes(run)
    i = 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + k].decode("utf-8"))
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_lock = threading.Lock()


@lru_cache(maxsize=2)
def _load(model_file: str) -> Codec:
    return Codec(model_file)


def codec(model_file: str) -> Codec:
    """The worker's codec for a model file, loaded once."""
    with _lock:
        return _load(model_file)


@contextmanager
def _task(model_file: str) -> Iterator[Codec]:
    """The codec for one task. Encoding makes many small lists and no cycles of references, so
    the collector, which would go through all remembered parts again and again, rests."""
    c = codec(model_file)
    gc.disable()
    try:
        yield c
    finally:
        gc.enable()
        c.forget()


def encode(text: Column, model_file: str) -> Column:
    """Column of ids (ARRAY<INT>) with begin and end ids; null and empty texts give these two."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with _task(model_file) as c:
            for s in batches:
                yield pd.Series([np.frombuffer(c.encode_bytes(t), "<i4") for t in s], dtype=object)

    return run(text)


def decode(ids: Column, model_file: str) -> Column:
    """Column of the texts of ids; null ids give null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model_file)
        for s in batches:
            yield pd.Series([None if x is None else c.decode([int(i) for i in x]) for x in s], dtype=object)

    return run(ids)


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: doc_id, the number of ids, and SHA-256 of ids and of the text decoded from
    them.

    One row a document, repeated rows included; null text counts as empty; other columns of
    ``docs`` are neither read nor carried. Needs no shuffle.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with _task(model_file) as c:
            for s in batches:
                n, a, b = [], [], []
                for t in s:
                    raw = c.encode_bytes(t)
                    n.append(len(raw) // 4)
                    a.append(hashlib.sha256(raw).hexdigest())
                    said = c.decode(np.frombuffer(raw, "<u4").tolist())
                    b.append(hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest())
                yield pd.DataFrame({"n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens`` in place of any columns of these names."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("token_ids", "n_tokens")]
    ids = docs.select(*keep, encode(F.col("text"), model_file).alias("token_ids"))
    return ids.withColumn("n_tokens", F.size("token_ids").cast("long"))


__all__ = ["Codec", "codec", "decode", "digest", "encode", "encoded"]
