"""Benchmark decontamination as a prefix-filtered set join.

Each item of the benchmark is cut into windows of ``window`` consecutive words
(an item of fewer words is one window).  A window is the set of its word
shingles; a document contains the window only if it holds every one of them, so
one shingle per window, the necessary prefix, is enough to find candidates.
Shingles are ordered by how rarely they occur in the documents, counted over the
whole corpus, and the rarest of a window is its prefix.  A document position
whose shingle is a prefix proposes a window start; the length and positional
bounds drop starts for which the window would not lie inside the document; the
rest is compared word by word over the item-sized window.

The benchmark is a stated set of queries: it is read in blocks of about
``block_bytes`` of text, each small enough to broadcast, and every block is run
against all documents, so a large benchmark costs more passes and not more
memory.  A longer item is cut into parts that overlap by all but one word of a
window, so each of its windows is whole in one part.  Documents are never shuffled.

Defined results: words are runs of bytes outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``
after lower-casing A-Z; a null text has no words; items with a null id or no
words take no part; items sharing an id count once; repeated documents each give
a row; an empty benchmark leaves every document clean; input columns named like
a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 2 << 20

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[0x30:0x3A] = _NOT_WORD[0x61:0x7B] = _NOT_WORD[0x80:] = False


class _Words:
    """The words of all rows: hash, bytes, place and, per row, where its words begin."""

    def __init__(self, column):
        buf, off = C.text_buffer(column)
        self.buf = C.ASCII_LOWER[buf]
        self.start, ends, row = C.word_spans(self.buf, off, _NOT_WORD)
        self.size = ends - self.start
        self.hash, self.first = C.slice_hashes(self.buf, self.start, ends), np.searchsorted(row, np.arange(len(off)))


class Windows:
    """The distinct windows of one block of items, as word-hash sequences by length."""

    def __init__(self, item_ids: list, texts: list[str], window: int):
        self.words = _Words(pa.array(texts, pa.string()))
        words, first = self.words.hash, self.words.first
        seen: dict[bytes, list[int]] = {}
        self.seq: list[np.ndarray] = []
        self.at: list[int] = []
        self.items: list[list[str]] = []
        for k, item in enumerate(item_ids):
            own = words[first[k] : first[k + 1]]
            if item is None or not len(own):
                continue
            n = min(window, len(own))
            for i in range(len(own) - n + 1):
                seq, start = own[i : i + n], int(first[k]) + i
                known = seen.setdefault(seq.tobytes(), [])
                at = next((w for w in known if self._text(self.at[w], n) == self._text(start, n)), len(self.seq))
                if at == len(self.seq):
                    known.append(at)
                    self.seq.append(seq)
                    self.at.append(start)
                    self.items.append([])
                self.items[at].append(str(item))
        self.items = [sorted(set(x)) for x in self.items]
        self.prefix: dict[int, tuple] = {}

    def _text(self, first: int, n: int) -> list[bytes]:
        w = self.words
        return [w.buf[s : s + z].tobytes() for s, z in zip(w.start[first : first + n], w.size[first : first + n], strict=True)]

    def shingles(self) -> dict[int, np.ndarray]:
        """Every shingle of the windows, by shingle length."""
        out: dict[int, list] = {}
        for seq in self.seq:
            s = min(SHINGLE, len(seq))
            out.setdefault(s, []).append(C.window_hash(seq, None, s))
        return {s: np.unique(np.concatenate(x)) for s, x in out.items()}

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """The rarest shingle of each window (ties: the first) becomes its prefix."""
        found: dict[int, list] = {}
        for w, seq in enumerate(self.seq):
            s = min(SHINGLE, len(seq))
            h = C.window_hash(seq, None, s)
            rare = min(range(len(h)), key=lambda i: (counts.get((s, int(h[i])), 0), i))
            found.setdefault(s, []).append((int(h[rare]), w, rare, len(seq)))
        for s, rows in found.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            at = np.array([r[1:] for r in rows], np.int64)
            self.prefix[s] = (key, *at.T)
        self.first_word = np.array(self.at, np.int64)


def _member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of ``h`` that occur in the sorted ``keys`` (a bit table answers most)."""
    table = np.zeros(1 << 20, bool)
    table[(keys >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)])
    pos = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    return at[keys[pos] == h[at]]


def _count_shingles(wanted):
    """Occurrences of the wanted shingles in each partition of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = wanted.value
        total = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
        for batch in C.small_batches(batches):
            own = _Words(batch.column(0))
            words, first = own.hash, own.first
            for s, k in keys.items():
                h = C.window_hash(words, None, s)
                at = _member(h, k)
                at = at[np.searchsorted(first, at, side="right") == np.searchsorted(first, at + s - 1, side="right")]
                total[s] += np.bincount(np.searchsorted(k, h[at]), minlength=len(k))
        for s, k in keys.items():
            hit = np.flatnonzero(total[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(hit), pa.int32()), pa.array(k[hit].view(np.int64)), pa.array(total[s][hit])], ["s", "h", "n"]
            )

    return run


def _match(block, out: pa.Schema):
    """Add one block's hits to the state columns ``_hit`` (a bit per word) and ``_items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win: Windows = block.value
        for batch in C.small_batches(batches):
            doc = _Words(batch.column(batch.schema.get_field_index("text")))
            words, first = doc.hash, doc.first
            step = np.zeros(len(words) + 1, np.int32)
            found: dict[int, set] = {}
            for s, (key, window, offset, length) in win.prefix.items():
                h = C.window_hash(words, None, s)
                at = _member(h, key)
                low, high = np.searchsorted(key, h[at]), np.searchsorted(key, h[at], side="right")
                rep = high - low
                pos = np.repeat(at, rep)
                which = np.repeat(low - np.concatenate([[0], np.cumsum(rep)[:-1]]) if len(rep) else low, rep) + np.arange(len(pos))
                row = np.searchsorted(first, pos, side="right") - 1
                start, n = pos - offset[which], length[which]
                fits = (start >= first[row]) & (start + n <= first[row + 1])
                row, start, n, which = row[fits], start[fits], n[fits], window[which[fits]]
                same = np.ones(len(start), bool)
                for j in range(int(n.max()) if len(n) else 0):
                    k = np.flatnonzero(same & (j < n))
                    x, y = start[k] + j, win.first_word[which[k]] + j
                    same[k] = C.equal_slices(doc.buf, doc.start[x], doc.size[x], win.words.buf, win.words.start[y], win.words.size[y])
                row, start, n, which = row[same], start[same], n[same], which[same]
                np.add.at(step, start, 1)
                np.add.at(step, start + n, -1)
                for r, w in set(zip(row.tolist(), which.tolist(), strict=True)):
                    found.setdefault(r, set()).update(win.items[w])
            hit = np.cumsum(step[:-1]) > 0
            bits, items, n_hit = (batch.column(c).to_pylist() for c in ("_hit", "_items", "n_hit"))
            for r in found:
                own = hit[first[r] : first[r + 1]]
                if bits[r]:
                    own = own | np.unpackbits(np.frombuffer(bits[r], np.uint8), count=len(own)).astype(bool)
                bits[r], n_hit[r] = np.packbits(own).tobytes(), int(own.sum())
                items[r] = sorted(set(items[r] or []) | found[r])
            made = {"_hit": pa.array(bits, pa.binary()), "_items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(np.diff(first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in out], schema=out)

    return run


def item_parts(text: str, window: int, part_bytes: int) -> Iterator[str]:
    """A text of more than ``part_bytes`` in parts of about so many (16 windows at least), each window of words whole in one."""
    if len(text) * 4 <= part_bytes or len(text.encode()) <= part_bytes:
        yield text
        return
    words = _Words(pa.array([text], pa.string()))
    ends, n, first = words.start + words.size, len(words.start), 0
    while True:
        upto = int(np.searchsorted(ends, words.start[first] + part_bytes, side="right")) if n else 0
        last = min(n, max(upto, first + 16 * window))
        yield words.buf[words.start[first] : ends[last - 1]].tobytes().decode() if n else ""
        if last == n:
            return
        first = last - window + 1


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """The benchmark's rows, long ones in parts, in blocks of about ``block_bytes`` of text."""
    item_ids, texts, size = [], [], 0
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():
        for part in item_parts(row.text, window, block_bytes):
            own = len(part.encode())
            if size and size + own > block_bytes:
                yield item_ids, texts
                item_ids, texts, size = [], [], 0
            item_ids.append(row.item_id)
            texts.append(part)
            size += own
    yield item_ids, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns of ``docs`` with n_words, n_hit, n_items, items (list), items_sha256, contaminated."""
    spark = docs.sparkSession
    made = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
    rest = C.carried(docs, [*made, "doc_id", "text", "_hit", "_items"])
    out = C.ids(docs, extra=rest)
    out = out.withColumns({"_hit": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>"), "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long")})
    schema = out.schema
    arrow = to_arrow_schema(schema)
    for item_ids, texts in item_blocks(benchmark, window, block_bytes):
        win = Windows(item_ids, texts, window)
        wanted = spark.sparkContext.broadcast(win.shingles())
        counted = C.ids(docs).select("text").mapInArrow(_count_shingles(wanted), "s int, h long, n long")
        counts = {(r.s, r.h % (1 << 64)): r.n for r in counted.groupBy("s", "h").agg(F.sum("n").alias("n")).toLocalIterator()} if win.seq else {}
        win.choose(counts)
        out = out.mapInArrow(_match(spark.sparkContext.broadcast(win), arrow), schema)
    items = F.coalesce("_items", F.array().cast("array<string>"))
    out = out.withColumns(
        {"n_items": F.size(items).cast("long"), "items": items, "items_sha256": F.sha2(F.concat_ws(",", items).cast("binary"), 256)}
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("_hit", "_items")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), m AS (SELECT DISTINCT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
