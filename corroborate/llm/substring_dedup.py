"""Substring dedup by level-wise doubling.

A word window can only repeat if every shorter window inside it repeats.  Level
one takes windows of a short length over the whole corpus and learns which of
them occur in more than one document.  Only positions whose windows repeated are
extended to twice the length (two overlapping survivors make one longer window),
and so on until the wanted length; the last level also learns whether a smaller
``doc_id`` holds the window.

Each level is one packed exchange (see ``_common``): a chunk of documents sends
its distinct window hashes per bucket, 4 bytes each at the short levels, and gets
one bit back for each.  At the last level a key has 96 bits plus the bucket.

Defined results: a null or blank text has no words; a document with fewer words
than the window loses none; rows with a null ``doc_id`` neither lose words nor
cause a removal; rows sharing a ``doc_id`` are one document for the test of
"smaller"; repeated rows each give a row; an empty table gives an empty one;
input columns named like a result are replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WINDOW = 13


def levels(window: int, first: int | None = None) -> list[int]:
    """Window lengths, each at most twice the one before."""
    out = [first or (window + 1) // 2]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


class _Chunk:
    """Window keys of one chunk, level after level."""

    def __init__(self, table: pa.Table, lens: list[int]):
        self.lens = lens
        self.buf, self.off = C.text_buffer(table.column("text"))
        self.ids, ok = C.long_column(table, "doc_id")
        self.starts, self.ends, self.row = C.word_spans(self.buf, self.off, C.ASCII_SPACE)
        self.words = C.slice_hashes(self.buf, self.starts, self.ends)
        n = len(self.words) - lens[0] + 1
        at = np.arange(max(n, 0))
        self.at = at[(self.row[at] == self.row[at + lens[0] - 1]) & ok[self.row[at]]] if n > 0 else at[:0]
        self.level = 0

    def keys(self) -> None:
        """Distinct windows at this level: hash, smallest doc_id, whether two documents here hold it."""
        length = self.lens[self.level]
        h = C.window_hash(self.words, self.at, length)
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        self.group = np.empty(len(s), np.int64)
        self.group[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        docs = self.ids[self.row[self.at[order]]]
        self.hash = s[heads]
        self.low = np.minimum.reduceat(docs, heads) if len(heads) else docs[:0]
        self.local = (np.maximum.reduceat(docs, heads) != self.low) if len(heads) else np.zeros(0, bool)
        self.check = C.window_hash(self.words, self.at[order[heads]], length, 1) if self.last else None

    @property
    def last(self) -> bool:
        return self.level == len(self.lens) - 1

    def send(self, buckets: int) -> list[tuple[int, bytes]]:
        where = ((self.hash >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            pick = order[cuts[b] : cuts[b + 1]]
            if not len(pick):
                continue
            if self.last:
                rec = np.empty(len(pick), _FULL)
                rec["h"], rec["c"], rec["d"] = self.hash[pick], self.check[pick].astype(np.uint32), self.low[pick]
                out.append((b, rec.tobytes()))
            else:
                out.append((b, self.hash[pick].astype(np.uint32).tobytes()))
        return out

    def receive(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """The answer bit of each distinct window."""
        where = ((self.hash >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        bits = np.zeros(len(self.hash), bool)
        for b, got in answers.items():
            pick = order[cuts[b] : cuts[b + 1]]
            bits[pick] = np.unpackbits(np.frombuffer(got, np.uint8), count=len(pick)).astype(bool)
        return bits

    def extend(self, bits: np.ndarray) -> None:
        """Keep the positions whose windows repeat at both ends of the next length."""
        alive = np.zeros(len(self.words), bool)
        alive[self.at[(bits | self.local)[self.group]]] = True
        length, self.level = self.lens[self.level], self.level + 1
        more = self.lens[self.level]
        at = np.flatnonzero(alive)
        at = at[at + more <= len(self.words)]
        at = at[alive[at + more - length]]
        self.at = at[self.row[at] == self.row[at + more - 1]]

    def removed(self, bits: np.ndarray) -> np.ndarray:
        mine = self.ids[self.row[self.at]]
        gone = bits[self.group] | (self.low[self.group] < mine)
        return C.cover(self.at[gone], self.lens[-1], len(self.words))


_FULL = np.dtype([("h", "<u8"), ("c", "<u4"), ("d", "<i8")])


def _answers(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for lv, b, x in zip(table["level"].to_pylist(), table["bucket"].to_pylist(), table["blob"], strict=True):
        out.setdefault(lv, {})[b] = x.as_py()
    return out


def _replayed(table: pa.Table, lens: list[int], buckets: int, got: dict[int, dict[int, bytes]], upto: int) -> _Chunk:
    c = _Chunk(table, lens)
    for lv in range(upto):
        c.keys()
        c.extend(c.receive(got.get(lv, {}), buckets))
    c.keys()
    return c


_ASK = "level int, bucket int, chunk int, blob binary"


def _ask(lens: list[int], buckets: int, level: int):
    def rows(chunk: int, table: pa.Table, got: dict) -> pa.Table:
        sent = _replayed(table, lens, buckets, got, level).send(buckets)
        return pa.table(
            {
                "level": pa.array([level] * len(sent), pa.int32()),
                "bucket": pa.array([b for b, _ in sent], pa.int32()),
                "chunk": pa.array([chunk] * len(sent), pa.int32()),
                "blob": pa.array([x for _, x in sent], pa.binary()),
            }
        )

    if level == 0:
        return lambda key, table: rows(key[0].as_py(), table, {})
    return lambda key, left, right: rows(key[0].as_py() if left.num_rows else 0, left, _answers(right))


def _answer(lens: list[int]):
    """What a bucket tells each chunk about the keys that chunk sent."""

    def run(key, table):
        level, out = key[1].as_py(), []
        if level < len(lens) - 1:
            parts = C.blobs(table["blob"], np.uint32)
            sizes = np.array([len(p) for p in parts])
            _, inv, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            flag = (n > 1)[inv]
        else:
            parts = C.blobs(table["blob"], _FULL)
            sizes = np.array([len(p) for p in parts])
            rec = np.concatenate(parts)
            order = np.lexsort((rec["d"], rec["c"], rec["h"]))
            s = rec[order]
            new = np.ones(len(s), bool)
            new[1:] = (s["h"][1:] != s["h"][:-1]) | (s["c"][1:] != s["c"][:-1])
            low = s["d"][np.flatnonzero(new)][np.cumsum(new) - 1]
            flag = np.empty(len(s), bool)
            flag[order] = low < s["d"]
        for part in np.split(flag, np.cumsum(sizes)[:-1]):
            out.append(np.packbits(part).tobytes())
        return pa.table(
            {"level": table["level"], "bucket": table["bucket"], "chunk": table["chunk"], "blob": pa.array(out, pa.binary())}
        )

    return run


def _finish(lens: list[int], buckets: int, keep_text: bool, schema: pa.Schema):
    def run(key, left, right):
        got = _answers(right)
        c = _replayed(left, lens, buckets, got, len(lens) - 1)
        gone = c.removed(c.receive(got.get(len(lens) - 1, {}), buckets))
        per_row = np.searchsorted(c.row, np.arange(left.num_rows + 1))
        dropped = np.concatenate([[0], np.cumsum(gone)])
        n_words = np.diff(per_row)
        n_gone = dropped[per_row[1:]] - dropped[per_row[:-1]]
        raw = c.buf.tobytes()
        sha, kept = [], []
        for r in range(left.num_rows):
            words = raw[c.off[r] : c.off[r + 1]].split()
            if n_gone[r]:
                words = [w for w, g in zip(words, gone[per_row[r] : per_row[r + 1]].tolist(), strict=True) if not g]
            text = b" ".join(words)
            sha.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                kept.append(text)
        made = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if keep_text:
            made["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table({f.name: made[f.name] if f.name in made else left.column(f.name) for f in schema})

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, first: int | None = None, keep_text: bool = True) -> DataFrame:
    """Remove each word covered by a ``window``-word run that also starts in a smaller doc_id.

    Returns the columns of ``docs`` with n_words, n_removed, kept_sha256 and, if
    ``keep_text``, kept_text (kept words joined by one space)."""
    made = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    rest = [c for c in C.carried(docs, [*made, "doc_id", "text", "_chunk"])]
    base = C.ids(docs, extra=rest)
    lens = levels(window, first)
    chunks, buckets = C.plan_chunks(base)
    base = C.with_chunk(base, chunks)
    by_chunk = base.groupBy("_chunk")
    told = None
    for level in range(len(lens)):
        if level == 0:
            asked = by_chunk.applyInArrow(_ask(lens, buckets, 0), _ASK)
        else:
            asked = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_ask(lens, buckets, level), _ASK)
        answer = asked.groupBy("bucket", "level").applyInArrow(_answer(lens), _ASK)
        told = answer if told is None else told.unionByName(answer)
    shown = base.drop("_chunk")
    out = shown.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_sha256": F.lit("")})
    if keep_text:
        out = out.withColumn("kept_text", F.lit(""))
    from pyspark.sql.pandas.types import to_arrow_schema

    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(
        _finish(lens, buckets, keep_text, to_arrow_schema(out.schema)), out.schema
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), win AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT r, j FROM (SELECT win.r, unnest(range(i, i + 13)) AS j FROM win JOIN low USING (s) WHERE low.d < win.doc_id)
), kept AS (
  SELECT t.r, string_agg(t.x, ' ' ORDER BY t.j) AS k, count(*) AS n
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM words) t
  LEFT JOIN gone ON gone.r = t.r AND gone.j = t.j WHERE gone.r IS NULL GROUP BY t.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""
