"""Shared plumbing of the corpus operators: staging, chunking, packed exchanges.

The heavy operators move *packed arrays* through Spark's shuffle instead of one
row per word or byte.  Documents are grouped into chunks of a few megabytes
(``_chunk``, a hash of the row's content, so a hot source or a large group of
copies spreads evenly).  A chunk sends each bucket of the key space at most one
array in which every key appears once, however often the chunk holds it; the
bucket answers with an array aligned to the one it received.  A key that a third
of all rows hold therefore costs one entry per chunk, never one per row.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Set here only where the session names none, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corroborate-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table below the shared folder that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Iterable[str] = ()) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, with the named extra columns."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in extra)
    )


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null id: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % n


def carried(docs: DataFrame, made: Iterable[str]) -> list[str]:
    """Columns of ``docs`` that pass through; a clash goes to the operator's own column."""
    taken = {m.lower() for m in made}
    return [c for c in docs.columns if c.lower() not in taken]


def plan_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int]:
    """(chunks, buckets) for ``docs``: chunks of about ``chunk_bytes`` of text.

    One aggregate over the text column; the figures only size the exchange and
    never change a result."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = row["b"] or 0
    chunks = max(1, math.ceil(total / chunk_bytes), min(parts, math.ceil(total / (1 << 20))))
    return chunks, max(1, min(parts, chunks), chunks // 8)


def with_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    return docs.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the row offsets (null: empty)."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string()).fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def small_batches(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """The same rows in batches of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        end = np.cumsum(np.asarray(sizes).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = end[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(end, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def long_column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and validity of an integer column (nulls read 0)."""
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.int64())
    ok = np.asarray(col.is_valid())
    return np.asarray(col.fill_null(0)).astype(np.int64), ok


def blobs(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads each 64-bit value over all bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        return x ^ (x >> np.uint64(31))


_BASE = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n, kept for the next call."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        base = _BASE[which]
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= CHUNK_BYTES + (CHUNK_BYTES >> 2):
            _POWERS[which] = have
    return have[0][: n + 1], have[1][: n + 1]


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte slice: eight bytes at a time through a mixing step, chained; ``which`` gives unrelated hashes."""
    size = ends - starts
    h = mix(size.astype(np.uint64), which)
    at = np.flatnonzero((size > 0) & (size <= LONG_SLICE))
    lanes = _lanes(buf)
    done = 0
    while len(at):
        with np.errstate(over="ignore"):
            h[at] = mix(h[at] ^ _lane(lanes, starts[at] + done, size[at] - done), which)
        done += 8
        at = at[size[at] > done]
    for k in np.flatnonzero(size > LONG_SLICE):
        h[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes(), which)
    return h


LONG_SLICE = 512


def _lanes(buf: np.ndarray) -> np.ndarray:
    """Of each position the eight bytes from there on (zeros beyond the end)."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number, those after the ``left``-th zero."""
    return lanes[at].view("<u8").ravel() & _FIRST_BYTES[np.minimum(left, 8)]


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def equal_slices(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether each slice of ``a`` has the bytes of its slice of ``b``."""
    same = a_size == b_size
    at = np.flatnonzero(same & (a_size > 0) & (a_size <= LONG_SLICE))
    x, y, done = _lanes(a), _lanes(b), 0
    while len(at):
        left = a_size[at] - done
        same[at] = _lane(x, a_start[at] + done, left) == _lane(y, b_start[at] + done, left)
        done += 8
        at = at[same[at] & (a_size[at] > done)]
    for k in np.flatnonzero(same & (a_size > LONG_SLICE)):
        same[k] = np.array_equal(a[a_start[k] : a_start[k] + a_size[k]], b[b_start[k] : b_start[k] + b_size[k]])
    return same


def running_sum(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Sum of all bytes before each position, each times its power of the base."""
    run = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf), which)[0][:-1], out=run[1:])
    return run


def piece_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, run: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each of many overlapping slices of at most a few hundred bytes, from one running sum (``run``, if at hand)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = running_sum(buf, which) if run is None else run
    with np.errstate(over="ignore"):
        return mix((run[ends] - run[starts]) * powers(len(buf), which)[1][starts] + (ends - starts).astype(np.uint64), which)


def every_slice_hash(buf: np.ndarray, width: int, which: int = 0, run: np.ndarray | None = None) -> np.ndarray:
    """``piece_hashes`` of the ``width`` bytes from every position that has so many."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = running_sum(buf, which) if run is None else run
    with np.errstate(over="ignore"):
        h = run[width:] - run[:-width]
        h *= powers(len(buf), which)[1][:n]
        h += np.uint64(width)
        return mix(h, which)


def word_spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of non-separator bytes within a row."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    bounds = off[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < n)]
    before[bounds] = False
    after[bounds - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def window_hash(words: np.ndarray, at: np.ndarray | None, length: int, seed: int = 0) -> np.ndarray:
    """Hash of ``length`` consecutive word hashes from each position in ``at`` (None: every one)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = np.uint64(_BASE[seed] | 1)
    h = np.zeros(n if at is None else len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            h = h * q + (words[j : j + n] if at is None else words[at + j])
        return mix(h, 7 + seed)


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + length) of some start."""
    begun = np.cumsum(np.bincount(starts, minlength=n))
    open_ = begun.copy()
    open_[length:] -= begun[:-length]
    return open_ > 0


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20
