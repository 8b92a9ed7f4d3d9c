"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are counted down to distinct ones first, so a thousand copies of a text
are one row.  Two fingerprints that differ in at most ``distance`` bits agree on all
bits of some choice of blocks (cut 64 bits into m blocks; at least m - distance of
them are equal), so each fingerprint is dealt to one bucket per choice and every link
is found in some bucket.  Within a bucket the fingerprints are sorted by Gray rank,
which puts those with shared bits next to each other, and an index is laid over the
order: a node holds the bits that all its members share (mask and value), its parent
those that all its children share.  The self-join walks pairs of nodes from the top,
drops a pair as soon as the shared bits alone differ in more than ``distance`` places,
and drops it too when both sides already lie in one component.

A bucket of more than ``bucket_rows`` fingerprints is dealt in blocks, each pair of
blocks a group of its own, so no group grows with the corpus.  A bucket emits one link
per fingerprint to its component there, never all pairs; links become components by
alternating large-star and small-star steps, checkpointed in the shared folder.

Defined results: a null or blank text has fingerprint zero and is linked like any
other; a text of fewer words than the shingle is one shingle; component_id is the
smallest non-null doc_id reachable (null if there is none); repeated rows each give a
row; an empty table gives an empty one; input columns named like a result are
replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C

WORDS, DISTANCE, SEED, BUCKET_ROWS, FAN = 4, 4, 42, 4096, 8


def fingerprints(column, words: int = WORDS, width: int = 1) -> np.ndarray:
    """SimHash of each text's word shingles, repeats included: ``width`` words of 64 bits, the first from XXH64 itself."""
    out = np.zeros((len(column), width), np.uint64)
    h, counts = _shingle_hashes(column, words)
    rows = np.flatnonzero(counts)
    if len(rows):
        out[rows] = _majorities(h, counts[rows], width)
    return out


def sketches(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``BANDS`` keys and a SimHash of 64 * ``WIDTH`` bits of each text's set of word shingles, zero for a blank text.

    A key hashes ``ROWS`` MinHash values, so texts of Jaccard similarity s share a given one with chance s ** ``ROWS``."""
    keys, codes = np.zeros((len(column), BANDS), np.uint64), np.zeros((len(column), WIDTH), np.uint64)
    h, counts = shingle_sets(column, words)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return keys, codes
    own = counts[rows]
    codes[rows] = _majorities(h, own, WIDTH)
    begin = np.cumsum(own) - own
    for k in range(BANDS):
        key = np.zeros(len(rows), np.uint64)
        for r in range(ROWS):
            key = C.mix(key ^ np.minimum.reduceat((h ^ _SALTS[k, r, 0]) * (_SALTS[k, r, 1] | np.uint64(1)), begin), k)
        keys[rows, k] = key
    return keys, codes


def shingle_sets(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as hashes in ascending order one text after another, and their number per text.

    A text of fewer words is one shingle; one without words has none."""
    buf, off = C.text_buffer(column)
    buf = C.ASCII_LOWER[buf]
    starts, ends, row = C.word_spans(buf, off, C.ASCII_SPACE)
    word, first = C.slice_hashes(buf, starts, ends), np.searchsorted(row, np.arange(len(off)))
    n = np.diff(first)
    at = np.arange(max(0, len(word) - words + 1))
    at = at[row[at] == row[at + words - 1]] if len(at) else at
    value, owner = [C.window_hash(word, at, words)], [row[at]]
    for size in range(1, words):
        few = np.flatnonzero(n == size)
        if len(few):
            value.append(C.window_hash(word, first[few], size))
            owner.append(few)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(n))


def _shingle_hashes(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all texts' shingles one after another, repeats included, and their number per text."""
    hashes: list[int] = []
    counts = np.zeros(len(column), np.int64)
    digest = xxhash.xxh64_intdigest
    for r, text in enumerate(column):
        own = (text.as_py() or "").encode().lower().split()
        if not own:
            continue
        joined = b" ".join(own)
        if len(own) <= words:
            hashes.append(digest(joined, SEED))
            counts[r] = 1
            continue
        at = [0]
        for w in own:
            at.append(at[-1] + len(w) + 1)
        hashes += [digest(joined[s : e - 1], SEED) for s, e in zip(at, at[words:])]
        counts[r] = len(own) - words + 1
    return np.array(hashes, np.uint64), counts


def _majorities(h: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """For each group of consecutive values the bits that most of them have."""
    out = np.zeros((len(counts), width), np.uint64)
    for w in range(width):
        ones = _count_bits(h if w == 0 else C.mix(h, w), counts)
        out[:, w] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _count_bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each group of consecutive values, how many have each bit; eight one-byte counters to a word, 255 rows at most."""
    begin = np.cumsum(counts) - counts
    pieces = -(-counts // 255)
    at = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lanes = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    part = np.add.reduceat(lanes, at, axis=0).view(np.uint8).astype(np.int32)
    return np.add.reduceat(part, np.cumsum(pieces) - pieces, axis=0)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Nodes over fingerprints in Gray order; each level groups FAN nodes of the one below."""

    def __init__(self, codes: np.ndarray):
        self.order = np.lexsort(gray_rank(codes).T[::-1])
        self.codes = codes[self.order]
        self.mask = [np.full(codes.shape, (1 << 64) - 1, np.uint64)]
        self.value = [self.codes]
        while len(self.value[-1]) > FAN:
            at = np.arange(0, len(self.value[-1]), FAN)
            mask, value = self.mask[-1], self.value[-1]
            same = np.bitwise_and.reduceat(value, at) | ~np.bitwise_or.reduceat(value, at)
            self.mask.append(np.bitwise_and.reduceat(mask, at) & same)
            self.value.append(np.bitwise_and.reduceat(value, at))

    def components(self, distance: int) -> np.ndarray:
        """For each fingerprint the first one of its component."""
        n = len(self.codes)
        label = np.arange(n)
        near = np.flatnonzero(_differing(self.codes[1:] ^ self.codes[:-1]) <= distance)
        label = _union(label, near, near + 1)
        top = len(self.value) - 1
        k = len(self.value[top])
        a, b = np.triu_indices(k)
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 1 << 18:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            shared = self.mask[level][a] & self.mask[level][b]
            keep = _differing(shared & (self.value[level][a] ^ self.value[level][b])) <= distance
            a, b = a[keep], b[keep]
            span = FAN**level
            low, high = self._ends(label, level, span)
            keep = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                label = _union(label, a, b)
                continue
            below = len(self.value[level - 1])
            kids = np.arange(FAN)
            x = np.repeat((a[:, None] * FAN + kids), FAN, axis=1).ravel()
            y = np.tile((b[:, None] * FAN + kids), (1, FAN)).ravel()
            keep = (x < below) & (y < below) & (x <= y)
            if level == 1:
                keep &= x < y
            stack.append((level - 1, x[keep], y[keep]))
        return label

    @staticmethod
    def _ends(label: np.ndarray, level: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        if level == 0:
            return label, label
        at = np.arange(0, len(label), span)
        return np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)


def _differing(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the components of a[i] and b[i]; a label is the least place of its component."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def block_choices(n: int, distance: int, target: int = 512) -> tuple[list[int], list[tuple[int, ...]]]:
    """Block masks and the choices of blocks that must agree, fine enough for n fingerprints."""
    for m in range(distance + 1, 2 * distance + 3):
        if n >> (64 * (m - distance) // m) <= target:
            break
    cuts = [64 * k // m for k in range(m + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return masks, list(combinations(range(m), m - distance))


def _deal(keep: np.ndarray):
    """A row per mask in ``keep`` (masks x 1): its number, the bits there, node and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *words = (np.asarray(c).astype(np.int64) for c in batch.columns)
            codes = np.stack([w.view(np.uint64) for w in words], axis=1)
            for c, mask in enumerate(keep):
                bits = codes & mask
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), c, np.int32)), pa.array(bits[:, 0].view(np.int64)), *batch.columns], ["c", "bits", *batch.schema.names])

    return run


def _link(distance: int, words: list[str]):
    def run(key, table):
        c, bits, x, y, node = (np.asarray(table.column(n)).astype(np.int64) for n in ("c", "bits", "x", "y", "node"))
        codes = np.stack([np.asarray(table.column(n)).astype(np.int64).view(np.uint64) for n in words], axis=1)
        order = np.lexsort((node, y, x, bits, c))
        c, bits, x, y, node, codes = c[order], bits[order], x[order], y[order], node[order], codes[order]
        new = np.ones(len(node) + 1, bool)
        new[1:-1] = (c[1:] != c[:-1]) | (bits[1:] != bits[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        at = np.flatnonzero(new)
        size = np.diff(at)
        pair = at[:-1][size == 2]
        pair = pair[_differing(codes[pair] ^ codes[pair + 1]) <= distance]
        u, v = [node[pair]], [node[pair + 1]]
        for s, e in zip(at[:-1][size > 2], at[1:][size > 2], strict=True):
            index = GrayIndex(codes[s:e])
            label = index.components(distance)
            least = np.full(len(label), len(label))
            np.minimum.at(least, label, index.order)  # nodes stand in ascending order
            own = np.flatnonzero(least[label] != index.order)
            u.append(node[s:e][least[label[own]]])
            v.append(node[s:e][index.order[own]])
        return pa.table({"u": pa.array(np.concatenate(u), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64())})

    return run


def links(codes: DataFrame, keep: np.ndarray, n: int, distance: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links u, v between nodes (columns node and one per word) that span the components of every bucket."""
    kinds = ", ".join(f"{w} long" for w in codes.columns)
    return bucket_links(codes.mapInArrow(_deal(keep), f"c int, bits long, {kinds}"), n * len(keep), distance, bucket_rows)


def bucket_links(dealt: DataFrame, rows: int, distance: int, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """The same for about ``rows`` rows already dealt to buckets (c, bits); without ``bucket_rows`` no bucket is split."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = dealt.columns[3:]
    groups = max(2 * parts, rows // 20_000)
    if bucket_rows is None:
        whole = dealt.withColumns({"x": F.lit(0), "y": F.lit(0), "g": F.pmod(F.xxhash64("c", "bits"), F.lit(groups))})
        return whole.groupBy("g").applyInArrow(_link(distance, words), "u long, v long")
    hot = dealt.groupBy("c", "bits").agg(F.count("*").alias("rows")).where(F.col("rows") > bucket_rows)
    blocks = F.ceil(F.col("rows") / F.lit(bucket_rows / 2)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.join(hot.select("c", "bits", blocks.alias("blocks")), ["c", "bits"], "left").withColumn("own", F.when(F.col("blocks").isNotNull(), own))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.withColumn("other", other)
    x, y = F.coalesce(F.least("own", "other"), F.lit(0)), F.coalesce(F.greatest("own", "other"), F.lit(0))
    pairs = pairs.select("c", "bits", "node", *words, x.alias("x"), y.alias("y")).withColumn("g", F.pmod(F.xxhash64("c", "bits", "x", "y"), F.lit(groups)))
    return pairs.groupBy("g").applyInArrow(_link(distance, words), "u long, v long")


def exact_masks(n: int, distance: int) -> np.ndarray:
    """Masks of which two 64-bit fingerprints within ``distance`` bits always share one."""
    masks, choices = block_choices(n, distance)
    return np.array([[sum(masks[k] for k in c)] for c in choices], np.uint64)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of an edge, by star contraction."""
    now = C.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = C.cut(small.where("u <> v").distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """Columns of ``docs`` with fingerprint (16 hex digits) and component_id."""
    rest = C.carried(docs, ["fingerprint", "component_id", "doc_id", "text", "_fp"])
    base = C.ids(docs, extra=rest)
    schema = base.withColumn("_fp", F.lit(0).cast("long")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, limit=2 << 20):
            fp = pa.array(fingerprints(batch.column(batch.schema.get_field_index("text")), words)[:, 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([fp if f.name == "_fp" else batch.column(f.name) for f in arrow], schema=arrow)

    coded = base.mapInArrow(run, schema)
    return classify(coded, distance)


def classify(coded: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Replace ``_fp`` by fingerprint and component_id."""
    marked = C.cut(coded)
    classes = C.cut(marked.groupBy("_fp").agg(F.min("doc_id").alias("low")))
    n = classes.count()
    found = components(links(classes.select(F.col("_fp").alias("node"), F.col("_fp").alias("word")), exact_masks(n, distance), n, distance))
    rooted = classes.join(found, classes["_fp"] == found["node"], "left").select("_fp", "low", F.coalesce("root", "_fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.select("_fp", "root").join(lowest, "root").select("_fp", "component_id")
    out = marked.join(of, "_fp")
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0"))).drop("_fp")


#: Two texts of Jaccard similarity 0.8 share none of the keys with chance (1 - 0.8 ** ROWS) ** BANDS = 6e-7, however many texts there are.
BANDS, ROWS, WIDTH, WIDE_DISTANCE = 20, 3, 4, 76
#: Of a group of candidates, at most about so many texts and bytes of text are held against all others at a time.
LEADERS, LEADER_BYTES, PART_BYTES, _HALVINGS = 2048, 16 << 20, 8 << 20, 40
_SALTS = np.random.default_rng(7).integers(0, 1 << 64, (BANDS, ROWS, 2), np.uint64)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, limit=2 << 20):
            texts = batch.column(1)
            sketch = np.concatenate(sketches(texts, words), axis=1)
            same = [hashlib.sha256(b" ".join((t.as_py() or "").encode().lower().split())).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "same", "sketch"])

    return run


def _deal_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (bits, node) per key of each sketch; a key's band is mixed into it."""
    for batch in batches:
        both = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, BANDS + WIDTH)
        node = np.asarray(batch.column(0)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, :BANDS].ravel()), pa.array(np.repeat(node, BANDS))], ["bits", "node"])


def _code_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and the words of the SimHash of each sketch."""
    for batch in batches:
        both = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, BANDS + WIDTH)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(both[:, BANDS + w].copy()) for w in range(WIDTH))], ["node", *_WORD_NAMES])


_WORD_NAMES = [f"w{k}" for k in range(WIDTH)]


class Kept:
    """Texts of one group that stay: shingles, and SimHashes that tell which of them can be alike at all."""

    def __init__(self, similarity: float):
        self.similarity, self.shingles, self.codes = similarity, [], np.zeros((64, WIDTH), np.uint64)

    def add(self, code: np.ndarray, shingles: np.ndarray) -> None:
        n = len(self.shingles)
        if n == len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.codes[n] = code
        self.shingles.append(shingles)

    def like(self, code: np.ndarray, own: np.ndarray) -> bool:
        """Whether one of these texts is at least ``similarity`` alike, the nearest by SimHash first."""
        apart = _differing(self.codes[: len(self.shingles)] ^ code)
        near = np.flatnonzero(apart <= WIDE_DISTANCE)
        for k in near[np.argsort(apart[near], kind="stable")]:
            other = self.shingles[k]
            least, most = sorted((len(own), len(other)))
            if least < self.similarity * most:
                continue
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= self.similarity * (least + most - both):
                return True
        return False


def _sets(column, words: int) -> list[np.ndarray]:
    value, counts = shingle_sets(column, words)
    return np.split(value, np.cumsum(counts)[:-1]) if len(counts) else []


def _codes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDTH)


def _resolve(words: int, similarity: float):
    """Of each group the texts that stay, smallest doc_id first: a text goes if it is like one that stays."""

    def run(key, table):
        order = np.lexsort((np.asarray(table["doc_id"]), np.asarray(table["root"])))
        root, codes, own = np.asarray(table["root"]), _codes(table["code"]), _sets(table["text"], words)
        stays, last, kept = np.zeros(len(order), bool), None, Kept(similarity)
        for k in order.tolist():
            if root[k] != last:
                last, kept = root[k], Kept(similarity)
            if not kept.like(codes[k], own[k]):
                kept.add(codes[k], own[k])
                stays[k] = True
        return pa.table({"doc_id": table["doc_id"], "root": table["root"], "stays": pa.array(stays)})

    return run


def _compare(words: int, similarity: float):
    """Of a part of a group, the texts that no leader is like."""

    def run(key, left, right):
        kept = Kept(similarity)
        for code, own in zip(_codes(right["code"]), _sets(right["text"], words), strict=True):
            kept.add(code, own)
        gone = np.array([kept.like(c, own) for c, own in zip(_codes(left["code"]), _sets(left["text"], words), strict=True)], bool)
        return pa.table({"doc_id": left["doc_id"], "root": left["root"], "gone": pa.array(gone)})

    return run


def star_links(dealt: DataFrame, codes: DataFrame, rows: int, distance: int, hot_rows: int) -> DataFrame:
    """Links u, v that join what each bucket of ``dealt`` (bits, node) proposes, one or two per node and none lost.

    Buckets of up to ``hot_rows`` nodes go through the Gray-order index, with their ``codes`` (node and words), which
    nodes alone in all their buckets never need.  All nodes of a larger one are linked to its least node, without any
    comparison: candidates only, so that a bucket costs one link per node.  A node's links of all buckets are then drawn
    to the least of its up to ``BANDS`` neighbours before anything is joined."""
    size = dealt.groupBy("bits").agg(F.count("*").alias("rows"), F.min("node").alias("least")).where("rows > 1")
    met = C.cut(dealt.join(size, "bits").select("bits", "node", "least", (F.col("rows") > hot_rows).alias("hot")))
    cool = met.where("not hot").select(F.lit(0).alias("c"), "bits", "node").join(codes, "node").select("c", "bits", "node", *_WORD_NAMES)
    ends = bucket_links(cool, rows, distance, None).unionByName(met.where("hot and least <> node").select(F.col("node").alias("u"), F.col("least").alias("v")))
    ends = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    near = ends.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("near"))
    first = F.element_at("near", 1)
    rest = near.select(first.alias("v"), F.explode(F.slice("near", 2, BANDS * BUCKET_ROWS)).alias("u"))
    return near.select("u", first.alias("v")).unionByName(rest.select("u", "v").distinct())


def confirmed_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, leaders: int = LEADERS) -> DataFrame:
    """Columns of ``docs`` with ``kept``: false for a row that repeats a kept document.

    Texts of equal words are one; of the others, those that share one of ``BANDS`` MinHash keys and whose 256-bit
    SimHashes differ in at most ``WIDE_DISTANCE`` bits are linked (two texts of Jaccard similarity 0.8 differ in about
    39, in 48 if they are of four and five shingles), and linked texts form a group of candidates.  Within a group the
    smallest doc_id stays, and every text whose shingles are at least ``similarity`` alike to one that stays goes, in
    the order of doc_id.  Groups of up to ``leaders`` texts are settled in one task each.  Of a larger one the texts
    of the smallest doc_ids, about ``leaders``, are settled among themselves, and all others, dealt to parts by hash,
    are held against those that stay; what is left goes into the next round.

    Rows with a null doc_id are kept; rows sharing a doc_id share its fate; a null or blank text has no words and
    equals any other such text; repeated rows each give a row; an empty table gives an empty one; an input column
    named kept is replaced."""
    spark = docs.sparkSession
    base = C.ids(docs)
    marked = C.cut(base.where("doc_id is not null").mapInArrow(_signatures(words), "doc_id long, same binary, sketch binary"))
    texts = C.cut(marked.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")).withColumn("node", F.xxhash64("same")))
    kinds = ", ".join(f"{w} long" for w in _WORD_NAMES)
    dealt = texts.select("node", "sketch").mapInArrow(_deal_keys, "bits long, node long")
    codes = texts.select("node", "sketch").mapInArrow(_code_words, f"node long, {kinds}")
    found = components(star_links(dealt, codes, texts.count() * BANDS, WIDE_DISTANCE, BUCKET_ROWS))
    members = texts.join(found, "node").unionByName(texts.join(found.select(F.col("root").alias("node")).distinct(), "node").withColumn("root", F.col("node")))
    code = F.substring("sketch", 8 * BANDS + 1, 8 * WIDTH)
    left = C.cut(base.join(members.select("doc_id", "root", code.alias("code")).distinct(), "doc_id").groupBy("doc_id", "root").agg(F.min("code").alias("code"), F.min("text").alias("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (left.agg(F.sum(size)).first()[0] or 0) // PART_BYTES)
    gone = marked.join(texts.select("same", F.col("doc_id").alias("first")), "same").where("doc_id > first").select("doc_id")
    dropped = [gone]
    while True:
        facts = left.groupBy("root").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
        small = (F.col("n") <= leaders) & (F.col("bytes") <= LEADER_BYTES)
        whole = left.join(facts.where(small).select("root"), "root", "left_semi")
        dropped.append(whole.withColumn("g", F.pmod(F.xxhash64("root"), F.lit(4 * tasks))).groupBy("g").applyInArrow(_resolve(words, similarity), "doc_id long, root long, stays boolean").where("not stays").select("doc_id"))
        large = C.cut(facts.where(~small))
        if large.isEmpty():
            break
        # the texts up to a quantile of doc_id: a beginning of the order, whatever its exact size
        share = F.least(F.lit(leaders) / F.col("n"), F.lit(LEADER_BYTES) / F.greatest("bytes", F.lit(1)))
        ranks = left.join(large.select("root"), "root").groupBy("root").agg(F.percentile_approx("doc_id", [2.0**-k for k in range(_HALVINGS)], 20_000).alias("at"))
        halvings = F.least(F.ceil(-F.log2(share)), F.lit(_HALVINGS - 1)).cast("int")
        limit = large.join(ranks, "root").select("root", F.element_at("at", halvings + 1).alias("limit"), F.ceil(F.greatest(F.col("bytes") / PART_BYTES, F.col("n") / 4096)).cast("int").alias("parts"))
        split = C.cut(left.join(C.cut(limit), "root"))
        first = C.cut(split.where("doc_id <= limit").groupBy("root").applyInArrow(_resolve(words, similarity), "doc_id long, root long, stays boolean"))
        dropped.append(first.where("not stays").select("doc_id"))
        chosen = split.join(first.where("stays").select("doc_id"), "doc_id").select(F.col("root").alias("of"), F.col("code").alias("code"), F.col("text").alias("text"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"))
        others = split.where("doc_id > limit").select("doc_id", "root", "code", "text", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
        measured = others.groupBy("root", "part").cogroup(chosen.groupBy("of", "at")).applyInArrow(_compare(words, similarity), "doc_id long, root long, gone boolean")
        measured = C.cut(measured)
        dropped.append(measured.where("gone").select("doc_id"))
        left = C.cut(split.join(measured.where("not gone").select("doc_id"), "doc_id").select("doc_id", "root", "code", "text"))
    out = dropped[0]
    for more in dropped[1:]:
        out = out.unionByName(more)
    out = out.distinct().withColumnRenamed("doc_id", "_gone id")
    joined = docs.select(*C.carried(docs, ["kept"])).join(out, F.col("doc_id").cast("long") == F.col("_gone id"), "left")
    return joined.withColumn("kept", F.col("_gone id").isNull()).drop("_gone id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = C.ids(docs)
    coded = rows.mapInArrow(_only_codes, "doc_id long, _fp long")
    return classify(coded).select("doc_id", "fingerprint", "component_id")


def _only_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.small_batches(batches, limit=2 << 20):
        fp = pa.array(fingerprints(batch.column(1))[:, 0].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "_fp"])
