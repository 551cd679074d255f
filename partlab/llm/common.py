"""Helpers shared by the corpus operators: table access, shared storage, held-out folds."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step of a Python kernel takes at a time. It bounds a
#: worker's memory; results don't depend on it. A longer single text is a step of its own.
CHUNK_CHARS = 800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes and rows of an Arrow batch at most: a batch of long texts must not fill a worker.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python kernels are fed with, in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, a laptop) a temporary
    folder is made and set; a cluster without a shared folder is refused, because executors
    would write where nobody else reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='partlab-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/partlab/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: its owner clears the shared folder
        pass


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32(id as text) mod 4 is 2. A null id
    counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: Bits of an id filter at most (32 MB).
MOST_BITS = 1 << 28


class IdFilter:
    """A bitmap of hashed ids, to leave out most rows whose id is not among some ids before a
    shuffle. It has no false negatives; a join after it makes the result exact. Its size is
    eight bits an id, MOST_BITS at most, whatever the number of ids: beyond that it lets more
    rows through."""

    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.bits = min(MOST_BITS, 1 << max(15, (8 * n).bit_length()))
        at = self.place(F.col(column)) + 1
        rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
        table = np.zeros(self.bits // 8, np.uint8)
        for r in rows:
            table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def may_hold(self, key: Column) -> Column:
        table = self.table

        @F.pandas_udf("boolean")
        def look(at: pd.Series) -> pd.Series:
            return pd.Series(bits_at(table.value, at.to_numpy()))

        return look(self.place(key))


def bits_at(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def give_back() -> None:
    """Returns freed memory to the system: after training, the driver's Python needs little."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator decides
        pass


def chunks(lengths: Sequence[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths add up to at most ``most`` (or a single item)."""
    lo = total = 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_P = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 2**64))
        have += step
    return out[:n]


_KEPT = 1 << 20
_kept: dict[int, np.ndarray] = {}


def _cached_powers(base: int, n: int) -> np.ndarray:
    """As _powers; up to _KEPT of them are kept, in steps of powers of two."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        if n > _KEPT:
            return _powers(base, n)
        with np.errstate(over="ignore"):
            have = _kept[base] = _powers(base, 1 << max(12, (n - 1).bit_length()))
    return have[:n]


class SegmentHash:
    """64-bit hashes of many segments of one array of symbols.

    A prefix sum of symbol * P**i gives any segment's polynomial value in two reads; the
    inverse power moves it to a common origin, so equal segments have equal hashes wherever
    they stand.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, np.uint64)
            np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _cached_powers(_P, n), out=self.total[1:])
            self.back = _cached_powers(_PINV, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.total[end] - self.total[start]) * self.back[start]
            return mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def words_of(texts: list[str | None], punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and each text's bounds in them.

    A-Z are lower-cased; words end at ASCII white space, with ``punctuation`` at any ASCII
    character that is no letter or digit. ``bounds[i]:bounds[i + 1]`` are the words of text i;
    null and empty texts have none.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    gap = (_PUNCT if punctuation else _SPACE)[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
    start, end = edge[::2], edge[1::2]
    words = SegmentHash(_LOWER[data])(start, end)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    bounds = np.concatenate(([0], np.searchsorted(start, ends)))
    return words, bounds
