"""Near-duplicate groups by min-max hashing.

A document's set holds its distinct word shingles. Each of a number of permutations is
evaluated once for a shingle and gives two values of the signature, the set's minimum and its
maximum. Bands of the signature deal the distinct sets into buckets; who shares a bucket is a
candidate, and every link is decided on the full sets.

* Equal sets are one class from the start, so copies cost one row each.
* Each bucket has a lead, the member with the most neighbours. A bucket's other members are
  compared with it only: pairs in proportion to the members. What a comparison leaves is the
  pair's difference, the shingles that one of the two sets has and the other has not.
* Members of one lead that are still in different components are found by these differences,
  without loss. Two sets' distance is the size of their differences' difference, so two that
  are linked, but in different components, share shingles of their differences, and more the
  larger these are. Shingles that no other difference holds can't be shared. The rarest of the
  rest index the members; who can't reach the number that is needed with anyone of another
  component leaves its place in the index. What stays is compared in rounds, a bounded number
  of members with all others a round.
* Components come from alternating large-star and small-star steps over written tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, IdFilter, bits_at, chunks, materialize, mix64, words_of

WORDS = 5
#: Probability that a pair right at the threshold shares no bucket; values of a signature at most.
MISS, MOST_VALUES = 5e-6, 336
#: Members of an index place that are compared with all others of it in one round.
LEADS = 32

_NO_ID = -(2**63)  # stands for a null id: it sorts first, as null does


@dataclass(frozen=True)
class Banding:
    rows: int
    bands: int

    @property
    def permutations(self) -> int:
        return (self.rows * self.bands + 1) // 2


def banding(threshold: float) -> Banding:
    """The most selective bands that miss a pair at the threshold with probability MISS at most."""
    best = None
    for rows in range(2, 16):
        bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows))
        if rows * bands <= MOST_VALUES:
            best = Banding(rows, bands)
    if best is None:
        raise ValueError("the threshold is too low for so short a signature")
    return best


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer words has its whole sequence
    as one; a text without words (or null) has none."""
    hashes, bounds = words_of(texts)
    with np.errstate(over="ignore"):
        n = len(hashes) - words + 1
        run = np.zeros(max(n, 0), np.uint64)
        factor = mix64(np.arange(1, words + 1, dtype=np.uint64))| np.uint64(1)
        for k in range(words):
            run += hashes[k : k + max(n, 0)] * factor[k]
        run = mix64(run)
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= words:
                out.append(np.unique(run[lo : hi - words + 1]))
            elif hi > lo:
                own = (hashes[lo:hi] * factor[: hi - lo]).sum(dtype=np.uint64) + np.uint64(int(hi - lo)) * np.uint64(0x9E3779B97F4A7C15)
                out.append(mix64(np.array([own], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (mix64(i * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (mix64(i * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All minima, then all maxima, under the permutations x -> a * x + b modulo 2**32."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = None, None
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            y = np.multiply.outer(a, x[i : i + 2048])
            y += b[:, None]
            lo, hi = y.min(axis=1), y.max(axis=1)
            low = lo if low is None else np.minimum(low, lo)
            high = hi if high is None else np.maximum(high, hi)
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray, by: Banding) -> np.ndarray:
    """One 64-bit key for each band, documents x bands; the band's number is part of it."""
    used = signatures[:, : by.rows * by.bands].reshape(len(signatures), by.bands, by.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(1, by.bands + 1, dtype=np.uint64)), used.shape[:2]).copy()
        for k in range(by.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + used[:, :, k])
    return key


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers; (0, 0) for the empty one."""
    with np.errstate(over="ignore"):
        k = np.array([mix64(shingles).sum(dtype=np.uint64), mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)])
    return tuple(k.view(np.int64).tolist())


def _signed(by: Banding):
    """Rows (id, text) to (id, n, k1, k2, bands)."""
    a, b = _permutations(by.permutations)
    words = WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for lo, hi in chunks([len(t or "") for t in texts], CHUNK_CHARS):
                sets = shingle_sets(texts[lo:hi], words)
                n = np.array([len(s) for s in sets], np.int64)
                sig = np.zeros((len(sets), 2 * len(a)), np.uint32)
                k1, k2 = np.array([set_key(s) for s in sets], np.int64).T
                for i, s in enumerate(sets):
                    if len(s):
                        sig[i] = signature(s, a, b)
                keys = band_keys(sig, by)
                keys = keys[n > 0]
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, by.bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                    names=["id", "n", "k1", "k2", "bands"],
                )

    return run


def _sets(table):
    """Rows (id, text, place in the filter) that the filter lets through, as (id, k1, k2, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(bits_at(table.value, batch.column(2).to_numpy()))
            if not len(at):
                continue
            batch = batch.take(pa.array(at))
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for lo, hi in chunks([len(t or "") for t in texts], CHUNK_CHARS):
                sets = shingle_sets(texts[lo:hi])
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                k1, k2 = np.array([set_key(s) for s in sets], np.int64).T
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "k1", "k2", "s"])

    return run


def linked(n: Column, m: Column, apart: Column, percent: int) -> Column:
    """Whether sets of sizes n and m that differ in ``apart`` shingles have 100 * intersection >=
    percent * union."""
    return (100 + percent) * apart.cast("long") <= (100 - percent) * (n + m)


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sizes n and m and ``d``, the shingles that only one of them
    has. A set goes to its pairs as b first: a lead's set is read, not sent, for each of its
    members."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("m"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("d"))


def components(edges: DataFrame, what: str = "links") -> DataFrame:
    """(v, c): the smallest node that each node of the edges (a, b) can reach, itself included.

    Large-star and small-star steps in turn; every round is a written table. A node's
    neighbours are never gathered: each step is a minimum and a join on the node.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), what)
    state = None
    if e.isEmpty():
        return e.select(F.col("u").alias("v"), F.col("v").alias("c"))
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(moved.unionAll(m.select("u", F.col("m").alias("v"))).distinct(), what)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("v"), F.col("v").alias("c"))
        state = now


def _star(classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of each bucket's lead a with the bucket's other members b."""
    dealt = classes.select("rep", F.explode("bands").alias("key"))
    buckets = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialize(dealt.join(buckets, "key"), "members")
    near = members.groupBy("rep").agg(F.sum("m").alias("w"))
    ranked = members.select("key", "rep").join(near, "rep").select("key", "rep", F.struct("w", (-F.col("rep")).alias("r")).alias("o"))
    leads = ranked.groupBy("key").agg(F.max("o").alias("o")).select("key", (-F.col("o.r")).alias("lead"))
    pairs = members.join(leads, "key").where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    return materialize(pairs.distinct(), "star")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (v, c) after links (a, b) between components."""
    joined = components(links)
    known = labels.unionAll(joined.join(labels.select("v"), "v", "left_anti"))
    top = joined.select(F.col("v").alias("c"), F.col("c").alias("top"))
    return materialize(known.join(top, "c", "left").select("v", F.coalesce("top", "c").alias("c")), "labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``c``, the component of their ``b``."""
    return rows.join(labels.select(F.col("v").alias("b"), "c"), "b", "left").withColumn("c", F.coalesce("c", "b"))


def _least_of_others(rows: DataFrame, *place: str) -> DataFrame:
    """Rows (place, c, e) of places with several components, with ``other``: the least e among
    the rows of their place in other components. Minima are pre-aggregated, and tables are
    written before they are joined, so that no place has to fit into one task."""
    first = rows.groupBy(*place).agg(F.min(F.struct("e", "c")).alias("f"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    first = materialize(first.select(*place, F.col("f.e").alias("e1"), F.col("f.c").alias("c1")), "least")
    rows = materialize(rows.join(first, list(place)), "marked")
    second = materialize(rows.where("c != c1").groupBy(*place).agg(F.min("e").alias("e2")), "least")
    rows = rows.join(second, list(place))
    return rows.withColumn("other", F.when(F.col("c") == F.col("c1"), F.col("e2")).otherwise(F.col("e1"))).drop("c1", "e1", "e2")


def _index(cells: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members, places) of the leads whose members are in several components.

    With e = (100 + percent) * size of the difference - (100 - percent) * size of the set, two
    members are linked if and only if their differences share (e + e') / (2 * (100 + percent))
    shingles or more; if that is 0 or less, both are linked with the lead itself. So a member
    needs a least number of shared shingles, given the least e' of other components. It takes
    places (a, t) for its rarest shared shingles t, as many as leave fewer than it needs; ``cap``
    is the largest e' of a member that it can be linked with, with t as its first shared one.
    """
    up, down = 100 + percent, 100 - percent
    rows = _labelled(cells, labels).withColumn("size", F.size("d").cast("long")).withColumn("e", up * F.col("size") - down * F.col("m"))
    need = F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("other")) / (2 * up)))
    members = _least_of_others(rows, "a").withColumn("take", F.col("size") - need + 1).where("take > 0")
    members = materialize(members.select("a", "b", "c", "m", "d", "size", "e", "take"), "members-apart")
    tokens = members.select("a", "b", F.explode("d").alias("t"))
    often = tokens.groupBy("a", "t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(often, ["a", "t"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    rows = members.drop("d").join(shared, ["a", "b"])
    take = F.col("take") - (F.col("size") - F.size("s"))
    rows = rows.withColumn("k", F.size("s")).withColumn("s", F.slice("s", F.lit(1), F.greatest(F.lit(0), take).cast("int")))
    rows = rows.select("a", "b", "c", "e", "k", F.posexplode("s").alias("i", "s"))
    places = rows.select("a", F.col("s.t").alias("t"), "b", "c", "e", (2 * up * (F.col("k") - F.col("i")) - F.col("e")).alias("cap"))
    return members, materialize(places, "places")


def _joined_apart(cells: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The labels after all links between members of one lead that its own links leave apart."""
    members, places = _index(cells, labels, percent)
    differs = members.select("a", "b", "m", "d")
    while True:
        alive = materialize(_least_of_others(places, "a", "t").where("cap >= other").drop("other"), "places")
        if alive.isEmpty():
            return labels
        # a round: LEADS members of a place, one for each value of a hash, with all others of it
        leads = alive.groupBy("a", "t", F.pmod(F.xxhash64("b"), F.lit(LEADS)).alias("h")).agg(F.min(F.struct("e", "b", "c", "cap")).alias("l"))
        leads = materialize(leads.select("a", "t", "l"), "leads")
        met = alive.join(leads, ["a", "t"]).where("c != l.c AND e <= l.cap AND l.e <= cap")
        first = F.col("b") < F.col("l.b")
        pairs = met.select("a", F.when(first, F.col("b")).otherwise(F.col("l.b")).alias("b"), F.when(first, F.col("l.b")).otherwise(F.col("b")).alias("b2"), F.when(first, F.col("c")).otherwise(F.col("l.c")).alias("c"), F.when(first, F.col("l.c")).otherwise(F.col("c")).alias("c2"))
        right = differs.select("a", F.col("b").alias("b2"), F.col("m").alias("m2"), F.col("d").alias("d2"))
        both = pairs.distinct().join(differs, ["a", "b"]).join(right, ["a", "b2"])
        apart = F.size("d") + F.size("d2") - 2 * F.size(F.array_intersect("d", "d2"))
        links = materialize(both.where(linked(F.col("m"), F.col("m2"), apart, percent)).select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct(), "links")
        places = alive.join(leads.select("a", "t", F.col("l.b").alias("b")), ["a", "t", "b"], "left_anti")
        if not links.isEmpty():
            labels = _merged(labels, links)
            places = _labelled(places.drop("c"), labels).select(*alive.columns)


def _numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """The classes with ``rep``, a number of each class alone, and whether that is ``own``, its
    smallest id. Where classes share one (a null or repeated id with different texts), all have
    a hash, another one until no two are equal."""
    rep, salt = F.col("own"), 0
    while not classes.groupBy(rep.alias("rep")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").isEmpty():
        rep, salt = F.xxhash64("own", "k1", "k2", F.lit(salt)), salt + 1
    return classes.withColumn("rep", rep), not salt


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """Per row of (doc_id, text): id (of a null one _NO_ID), n, k1 and k2 of its set, c (the
    smallest id of its group) and kept."""
    by = banding(percent / 100)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "text")
    signed = materialize(rows.mapInArrow(_signed(by), "id long, n long, k1 long, k2 long, bands array<long>"), "signatures")
    found = signed.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes, by_id = _numbered(materialize(found, "classes"))

    star = _star(classes)

    # the full sets of all that takes part, once; a filter keeps other texts out of the shuffle
    some = star.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    takes_part = materialize(classes.select("rep", F.col("own").alias("id"), "k1", "k2").join(some, "rep", "left_semi"), "taking-part")
    ids = IdFilter(takes_part, "id")
    sets = rows.select("id", "text", ids.place(F.col("id")).alias("at")).mapInArrow(_sets(ids.table), "id long, k1 long, k2 long, s array<long>")
    sets = sets.dropDuplicates(["id", "k1", "k2"])  # of repeated rows
    sets = materialize(sets.join(takes_part, ["id", "k1", "k2"]).select(F.col("rep").alias("id"), "s"), "sets")

    cells = materialize(differences(star, sets), "cells")
    labels = components(cells.where(linked(F.col("n"), F.col("m"), F.size("d"), percent)).select("a", "b"))
    labels = _joined_apart(cells, labels, percent)
    final = labels.withColumnRenamed("v", "rep")

    labelled = classes.select("k1", "k2", "rep", "own", "copies").join(final, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    if not by_id:  # the class of the smallest id stands for a group; of several the one of the smallest key
        first = labelled.groupBy("c").agg(F.min(F.struct("own", "k1", "k2", "rep")).alias("first"))
        labelled = labelled.join(first, "c").select("k1", "k2", "rep", "copies", F.col("first.own").alias("c"), F.col("first.rep").alias("lead"))
    else:
        labelled = labelled.select("k1", "k2", "rep", "copies", "c", F.col("c").alias("lead"))
    labelled = labelled.where((F.col("copies") > 1) | (F.col("lead") != F.col("rep"))).select("k1", "k2", "c", (F.col("lead") == F.col("rep")).alias("leads"))
    out = signed.select("id", "n", "k1", "k2").join(labelled, ["k1", "k2"], "left")
    c = F.when(F.col("n") > 0, F.coalesce("c", "id")).otherwise(F.col("id"))
    leads = F.coalesce("leads", F.lit(True)) | (F.col("n") == 0)
    return out.select("id", "n", "k1", "k2", c.alias("c"), (leads & (c == F.col("id"))).alias("kept"))


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links with 100 * intersection >=
    percent * union; ``kept`` says whether it is the row's own, and of sets of one group under
    that id holds for one only. Null and empty texts, and texts of white space, have no shingle,
    no link and are kept. Of rows with equal ids and sets all are in one group and all have the
    same ``kept``; rows of one id, or of null ids, with different sets are judged each by its
    own. A null id counts as smaller than any other.
    Nothing is gathered by copy group: equal sets are pre-aggregated, and the last join meets
    only sets that have copies or links.
    """
    real = lambda x: F.when(F.col(x) != _NO_ID, F.col(x))
    return _judged(docs, percent).select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("c").alias("component_id"), "kept")


def _key(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Number of shingles and key of each text's set."""
    for batch in texts:
        t, rows = batch.to_list(), []
        for lo, hi in chunks([len(x or "") for x in t], CHUNK_CHARS):
            rows += [(len(s), *set_key(s)) for s in shingle_sets(t[lo:hi])]
        yield pd.DataFrame(rows, columns=["n", "k1", "k2"], dtype=np.int64)


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate group: one of the smallest
    doc_id (null first), of several with equal sets that of the first text. Rows without
    shingles all stay; rows that repeat an id, or have none, with different sets are judged each
    by its own."""
    judged = materialize(_judged(docs, percent), "judged")
    by_id = judged.where(F.col("id") != _NO_ID).groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("kept")).alias("gone"), F.count_if(F.col("kept") & (F.col("n") > 0)).alias("first"))
    # ids all of whose rows go, and ids whose rows are judged one by one
    marked = materialize(by_id.where("gone > 0 OR first > 1").select(F.col("id").alias("__id"), (F.col("gone") < F.col("m")).alias("__each")), "marked")
    own = F.col("doc_id").cast("long")
    # most rows are told by the filter to stay and are not shuffled
    may = IdFilter(marked, "__id").may_hold(own)
    doubtful = docs.where(own.isNotNull() & may).join(marked, own == F.col("__id"), "left")
    kept = docs.where(own.isNotNull() & ~may).unionByName(doubtful.where("__id IS NULL").select(*docs.columns))
    unnamed = judged.where((F.col("id") == _NO_ID) & (F.col("n") > 0)).isEmpty()
    if unnamed and marked.where("__each").isEmpty():
        return kept.unionByName(docs.where(own.isNull()))
    each = doubtful.where("__each").select(*docs.columns).unionByName(docs.where(own.isNull()))
    each = each.select(F.struct(*docs.columns).alias("row"), F.coalesce(own, F.lit(_NO_ID)).alias("id"), F.pandas_udf(_key, "n long, k1 long, k2 long")("text").alias("set"))
    one = each.where("set.n > 0").groupBy("id", "set.k1", "set.k2").agg(F.min_by("row", "row.text").alias("row"))
    one = one.join(judged.where("kept AND n > 0").select("id", "k1", "k2"), ["id", "k1", "k2"], "left_semi")
    return kept.unionByName(each.where("set.n = 0").select("row.*")).unionByName(one.select("row.*"))


__all__ = ["banding", "components", "differences", "groups", "keep_first", "shingle_sets"]
