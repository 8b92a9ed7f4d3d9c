"""Suffix-array dedup: repeated byte strings from merged shard Burrows-Wheeler transforms.

Two equal windows of ``length`` bytes hold the same minimiser, the window's least hash
of ``SEED_BYTES`` bytes.  One packed exchange tells each chunk of documents which of its
minimisers another document holds too; only windows with such a minimiser can repeat.
A stretch of consecutive windows with one minimiser is cut out as a piece and dealt to
the bucket of its minimiser, so all places of a repeated string meet in one bucket, and
a chunk sends equal pieces once with their smallest doc_id.

In a bucket equal pieces are one, of the smallest doc_id, and a piece is left out where no
other piece of the bucket has its minimiser with half of a string's further bytes before
or behind it, as it shares no string. The pieces left form
shards of about ``SHARD_BYTES``: the suffixes of each are sorted by themselves and give a
Burrows-Wheeler transform.  The transforms are then merged without sorting the suffixes
of all shards: an interleave of the shards is refined by one symbol per round, each round
dealing the interleave by the symbols that the transforms show in the present order.
After k rounds the order is that of the first k symbols, and a boundary
that first shows in round k says that its neighbours share k - 1 symbols; after
``length`` rounds the blocks left are the intervals of suffixes with a common prefix of
``length``, and their smallest document owns the string.

Defined results: a null text is empty; matches never cross documents; rows with a null
doc_id neither lose bytes nor cause a removal; rows sharing a doc_id are one document
for the test of "smaller"; a removal may cut a character, so the text kept is bytes;
repeated rows each give a row; an empty table gives an empty one; input columns named
like a result are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C

LENGTH, SEED_BYTES, RUN, CHUNK_BYTES, SHARD_BYTES = 50, 25, 26, 2 << 20, 256 << 10


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _slabs(start: np.ndarray, end: np.ndarray) -> Iterator[slice]:
    """Pieces in their order, about ``CHUNK_BYTES`` at a time: tables of powers stay small and are kept."""
    part = np.cumsum(end - start) // CHUNK_BYTES
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
        yield slice(a, b)


def _distinct(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first piece of each kind, kind of each piece) of pieces of a text."""
    a, b = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    for own in _slabs(start, end):
        base, upto = int(start[own].min()), int(end[own].max())
        for which, out in enumerate((a, b)):
            out[own] = C.piece_hashes(text[base:upto], start[own] - base, end[own] - base, which)
    order = np.lexsort((b, a))
    new = np.ones(len(start), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    kind = np.empty(len(start), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


class _Chunk:
    """Runs of windows of one chunk with one minimiser: first window, windows and minimiser of each."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.buf, self.off = C.text_buffer(table.column("text"))
        self.ids, ok = C.long_column(table, "doc_id")
        n = len(self.buf) - length + 1
        low = _sliding_min(C.every_slice_hash(self.buf, SEED_BYTES), length - SEED_BYTES + 1) if n > 0 else np.zeros(0, np.uint64)
        # windows in a row with one minimiser are a run, of at most RUN windows
        new = np.ones(len(low) + 1, bool)
        np.not_equal(low[1:], low[:-1], out=new[1:-1])
        new[np.minimum(self.off, len(low))] = True
        head = np.flatnonzero(new[:-1])
        row = np.searchsorted(self.off, head, side="right") - 1
        size = np.minimum(np.append(head[1:], len(low)), self.off[row + 1] - length + 1) - head
        some = np.flatnonzero((size > 0) & ok[row])
        head, row, size = head[some], row[some], size[some]
        cuts = -(-size // RUN)
        since = RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        self.head, self.size = np.repeat(head, cuts) + since, np.minimum(RUN, np.repeat(size, cuts) - since)
        self.key, self.of = np.unique(low[self.head], return_inverse=True)
        self.doc = self.ids[np.repeat(row, cuts)]
        some, other = np.full(len(self.key), np.iinfo(np.int64).max), np.full(len(self.key), np.iinfo(np.int64).min)
        np.minimum.at(some, self.of, self.doc)
        np.maximum.at(other, self.of, self.doc)
        self.local = some != other
        self.bucket = ((self.key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)

    def picks(self):
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.searchsorted(self.bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            if cuts[b + 1] > cuts[b]:
                yield b, order[cuts[b] : cuts[b + 1]]

    def pieces(self, got: dict) -> None:
        """The distinct pieces, one per run whose minimiser another document holds too."""
        bits = self.local.copy()
        for b, pick in self.picks():
            bits[pick] |= np.unpackbits(np.frombuffer(got[b], np.uint8), count=len(pick)).astype(bool)
        self.runs = np.flatnonzero(bits[self.of])
        start, size = self.head[self.runs], self.size[self.runs]
        first, self.same = _distinct(self.buf, start, start + size + self.length - 1)
        self.owner = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.owner, self.same, self.doc[self.runs])
        self.start, self.windows, self.where = start[first], size[first], self.bucket[self.of[self.runs[first]]]

    def piece_picks(self):
        order = np.argsort(self.where, kind="stable")
        cuts = np.searchsorted(self.where[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            if cuts[b + 1] > cuts[b]:
                yield b, order[cuts[b] : cuts[b + 1]]


def _ask(length: int, buckets: int):
    def run(key, table):
        chunk, out, where = _Chunk(table, length, buckets), [], []
        for b, pick in chunk.picks():
            where.append(b)
            out.append(chunk.key[pick].astype(np.uint32).tobytes())
        return pa.table({"bucket": pa.array(where, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})

    return run


def _shared(key, table):
    parts = C.blobs(table["blob"], np.uint32)
    _, inverse, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    out = [np.packbits(p).tobytes() for p in np.split((n > 1)[inverse], np.cumsum([len(p) for p in parts])[:-1])]
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "blob": pa.array(out, pa.binary())})


def _answers(table: pa.Table) -> dict[int, bytes]:
    return {b: x.as_py() for b, x in zip(table["bucket"].to_pylist(), table["blob"], strict=True)}


def _send(length: int, buckets: int):
    """The distinct pieces of a chunk, per bucket: text, sizes, owners."""

    def run(key, left, right):
        chunk = _Chunk(left, length, buckets)
        chunk.pieces(_answers(right))
        rows: dict[str, list] = {"bucket": [], "text": [], "facts": []}
        for b, pick in chunk.piece_picks():
            span = chunk.windows[pick] + length - 1
            ends = np.cumsum(span)
            text = chunk.buf[np.repeat(chunk.start[pick] - (ends - span), span) + np.arange(ends[-1])]
            rows["bucket"].append(b)
            rows["text"].append(zstandard.compress(text.tobytes(), 1))
            rows["facts"].append(zstandard.compress(np.stack([chunk.windows[pick], chunk.owner[pick]]).astype("<i8").tobytes(), 1))
        n = len(rows["bucket"])
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array([key[0].as_py() if left.num_rows else 0] * n, pa.int32()), "text": pa.array(rows["text"], pa.binary()), "facts": pa.array(rows["facts"], pa.binary())})

    return run


class Shard:
    """Suffix order and Burrows-Wheeler transform of some pieces, each closed by symbol 0.

    The pieces are taken in their own order, so that equal suffixes stand in the order of
    their pieces and the transform's n-th occurrence of a symbol is the n-th suffix that
    begins with it, the closing symbol included."""

    def __init__(self, text: np.ndarray, span: np.ndarray):
        width = -(-(int(span.max()) + 1) // 8) * 8
        rows = np.zeros((len(span), width + 8), np.uint8)
        ends = np.cumsum(span)
        piece = np.repeat(np.arange(len(span)), span)
        rows[piece, np.arange(ends[-1]) - (ends - span)[piece]] = text + np.uint8(1)  # UTF-8 has no byte 255
        self.perm = np.argsort(np.ascontiguousarray(rows[:, :width]).view(f"S{width}").ravel(), kind="stable")
        rows, span = rows[self.perm], span[self.perm]
        self.piece = np.repeat(np.arange(len(span)), span + 1)
        self.place = np.arange(len(self.piece)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
        at = self.piece * (width + 8) + self.place
        flat = rows.ravel()
        self.order = self._order(np.lib.stride_tricks.sliding_window_view(flat, 8)[at].copy().view(">u8").ravel().astype(np.uint64), span[self.piece] - self.place, width)
        symbol = flat[at]
        before = np.where(self.place == 0, np.arange(len(at)) + span[self.piece], np.arange(len(at)) - 1)
        self.bwt = symbol[before[self.order]]

    @staticmethod
    def _order(key: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
        """Suffixes by their text, equal ones by place. key: their first 8 symbols; left: symbols before the closing one."""
        n, have = np.arange(len(key)), 8
        while True:
            order = np.argsort(key)
            new = np.ones(len(key), np.uint64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(len(key), np.uint64)
            rank[order] = np.cumsum(new)
            if have >= width:
                return np.argsort((rank << np.uint64(32)) | n.astype(np.uint64))
            after = np.where(left >= have, rank[np.minimum(n + have, len(n) - 1)], np.uint64(0))
            key, have = (rank << np.uint64(32)) | after, have * 2


def merge(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Refine the interleave of the shards ``rounds`` times.

    A round deals the interleave by the symbol in front of each suffix; the n-th of a shard
    that gets a symbol is the n-th suffix of the shard that begins with it (``front``).
    Returns, in merged order, the entry of each suffix (shards end to end) and its common
    prefix with the one before it (``rounds`` if it goes on)."""
    flat = np.concatenate(transforms)
    front, at = np.empty(len(flat), np.int64), 0
    for t in transforms:
        front[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t))
        at += len(t)
    entry, block = np.arange(len(flat)), np.zeros(len(flat), np.int64)
    common = np.zeros(len(flat), np.int16)  # rounds in which an entry was in the block of the one before it
    for _ in range(rounds):
        symbol = flat[entry]
        order = np.argsort(symbol, kind="stable")
        block <<= 8
        block |= symbol
        entry, block = front[entry[order]], block[order]
        same = block[1:] == block[:-1]
        common[1:] += same
        block[0] = 0
        np.cumsum(~same, out=block[1:])
    return entry, common


def _repeated(text: np.ndarray, start: np.ndarray, windows: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Which windows of distinct pieces, end to end, begin a string that a smaller owner has too."""
    span = windows + length - 1
    part = (np.cumsum(span) - span) // SHARD_BYTES
    shards, owners, rooms, first = [], [], [], []
    begin = np.cumsum(windows) - windows
    for own in np.split(np.arange(len(span)), np.flatnonzero(np.diff(part)) + 1):
        n, ends = span[own], np.cumsum(span[own])
        s = Shard(text[np.repeat(start[own] - (ends - n), n) + np.arange(ends[-1])], n)
        of = own[s.perm[s.piece[s.order]]]
        shards.append(s.bwt)
        owners.append(owner[of])
        rooms.append(s.place[s.order] < windows[of])
        first.append(begin[of] + s.place[s.order])
    entry, common = merge(shards, length)
    block = np.cumsum(common < length)  # an interval of suffixes that share ``length`` bytes
    owned, room, window = np.concatenate(owners), np.concatenate(rooms), np.concatenate(first)
    inside = room[entry]
    entry, block = entry[inside], block[inside]
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.repeat(np.minimum.reduceat(owned[entry], head), np.diff(np.append(head, len(block))))
    flag = np.zeros(int(windows.sum()), bool)
    flag[window[entry]] = least < owned[entry]
    return flag


def _meeting(text: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """The distinct pieces that may share a string with another one.

    Two that do have one minimiser, and where each holds it once they stand side by side at
    it: of the bytes that a shared string has around it, half lie before or behind it."""
    span, half = windows + length - 1, (length - SEED_BYTES + 1) // 2
    low, once = np.empty(len(start), np.uint64), np.empty(len(start), bool)
    sides = [(half, SEED_BYTES), (0, SEED_BYTES + half)]
    whole, around = np.empty((2, len(start)), bool), np.empty((2, len(start)), np.uint64)
    for own in _slabs(start, start + span):
        n, ends = span[own], np.cumsum(span[own])
        body = text[np.repeat(start[own] - (ends - n), n) + np.arange(ends[-1])]
        run = C.running_sum(body)
        hashed = C.every_slice_hash(body, SEED_BYTES, run=run)
        across = (ends[:-1, None] - np.arange(1, SEED_BYTES)).ravel()
        hashed[across] = np.iinfo(np.uint64).max
        low[own] = np.minimum.reduceat(hashed, ends - n)
        hit = np.flatnonzero(hashed == np.repeat(low[own], n)[: len(hashed)])
        begin = np.searchsorted(hit, ends - n)
        once[own] = np.diff(np.append(begin, len(hit))) == 1
        at = hit[begin]
        for k, (before, behind) in enumerate(sides):
            whole[k, own] = (at - before >= ends - n) & (at + behind <= ends)
            at_whole = at[whole[k, own]]
            around[k, own][whole[k, own]] = C.piece_hashes(body, at_whole - before, at_whole + behind, run=run)
    _, same, count = np.unique(low, return_inverse=True, return_counts=True)
    keep = (np.bincount(same, ~once) > 0)[same]  # a minimiser that a piece repeats tells no place
    for has, key in zip(whole, around, strict=True):
        _, of, n = np.unique(key[has], return_inverse=True, return_counts=True)
        keep[has] |= n[of] > 1
    return np.flatnonzero(keep & (count[same] > 1))


def _intervals(length: int):
    """Which windows of each chunk's pieces begin a string that a smaller doc_id owns too."""

    def run(key, table):
        text = np.frombuffer(b"".join(zstandard.decompress(x.as_buffer()) for x in table["text"]), np.uint8)
        facts = [np.frombuffer(zstandard.decompress(x.as_buffer()), "<i8").reshape(2, -1) for x in table["facts"]]
        windows, owner = np.concatenate(facts, axis=1)
        span = windows + length - 1
        start = np.cumsum(span) - span
        # equal pieces of several chunks are one, of the smallest owner
        first, kind = _distinct(text, start, start + span)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, owner)
        some = _meeting(text, start[first], windows[first], length)
        size = windows[first]
        flag = np.zeros(int(size.sum()), bool)
        begin = np.cumsum(size) - size
        if len(some):
            n = size[some]
            flag[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = _repeated(text, start[first[some]], n, least[some], length)
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        bits = flag[np.repeat(begin[kind], windows) + inner] | np.repeat(owner > least[kind], windows)
        cuts = np.cumsum([int(f[0].sum()) for f in facts])[:-1]
        out = [np.packbits(x).tobytes() for x in np.split(bits, cuts)]
        return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "blob": pa.array(out, pa.binary())})

    return run


def _finish(length: int, buckets: int, keep: bool, schema: pa.Schema):
    def run(key, left, right):
        chunk = _Chunk(left, length, buckets)
        first = right.filter(pc.equal(right["step"], 0))
        second = _answers(right.filter(pc.equal(right["step"], 1)))
        chunk.pieces(_answers(first))
        begin = np.cumsum(chunk.windows) - chunk.windows
        bits = np.zeros(int(chunk.windows.sum()), bool)
        for b, pick in chunk.piece_picks():
            n = chunk.windows[pick]
            at = np.repeat(begin[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bits[at] = np.unpackbits(np.frombuffer(second[b], np.uint8), count=len(at)).astype(bool)
        n = chunk.size[chunk.runs]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flag = bits[np.repeat(begin[chunk.same], n) + inner] | np.repeat(chunk.owner[chunk.same] < chunk.doc[chunk.runs], n)
        starts = (np.repeat(chunk.head[chunk.runs], n) + inner)[flag]
        gone = C.cover(starts, length, len(chunk.buf))
        total = np.concatenate([[0], np.cumsum(gone)])
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inside = chunk.off[:-1][np.diff(chunk.off) > 0]
        edge[inside] = gone[inside]
        spans = np.concatenate([[0], np.cumsum(edge)])
        a, b = chunk.off[:-1], chunk.off[1:]
        kept = [chunk.buf[s:e][~gone[s:e]].tobytes() for s, e in zip(a, b, strict=True)]
        made = {
            "n_bytes": pa.array(b - a), "n_removed": pa.array(total[b] - total[a]), "n_spans": pa.array(spans[b] - spans[a]),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if keep:
            made["kept"] = pa.array(kept, pa.binary())
        return pa.table({f.name: made[f.name] if f.name in made else left.column(f.name) for f in schema})

    return run


_BITS = "bucket int, chunk int, blob binary"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a smaller doc_id.

    Returns the columns of ``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, if
    ``keep``, kept (the bytes left)."""
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept": "binary"} if keep else {})
    base = C.ids(docs, extra=C.carried(docs, [*kinds, "kept", "doc_id", "text", "_chunk"]))
    schema = base.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items()}).schema
    chunks, buckets = C.plan_chunks(base, CHUNK_BYTES)
    buckets = max(buckets, chunks // 2)
    by_chunk = C.with_chunk(base, chunks).groupBy("_chunk")
    shared = by_chunk.applyInArrow(_ask(length, buckets), _BITS).groupBy("bucket").applyInArrow(_shared, _BITS)
    sent = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_send(length, buckets), "bucket int, chunk int, text binary, facts binary")
    found = sent.groupBy("bucket").applyInArrow(_intervals(length), _BITS)
    told = shared.withColumn("step", F.lit(0)).unionByName(found.withColumn("step", F.lit(1)))
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_finish(length, buckets, keep, to_arrow_schema(schema)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs, keep=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
