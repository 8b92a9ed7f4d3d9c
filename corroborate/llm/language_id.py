"""Language identification with bit-sliced Bloom filters.

The filter is a table of slots; a slot's word has one bit per language.  Adding an
n-gram of a language sets that language's bit in each of its slots, so the AND of
an n-gram's slots is the mask of all languages that contain it: one lookup answers
for every language.  A text's n-grams are looked up, the bits counted per language,
each count corrected for the false positives that the language's share of set bits
predicts, and the language with the largest corrected share of n-grams wins.

Fitting reads a bounded sample of labelled rows: all of them up to ``max_rows``,
else a share of each language chosen by a hash of the row.  An n-gram belongs to a
language if at least ``min_share`` of its sampled documents (and two) hold it, so
the model is bounded by the share, whatever the corpus.  Prediction sees text only.

Defined results: a text that is null or has no letter gets ``und`` and score 0; a
text none of whose n-grams is known gets the most frequent language with score 0;
ties go to the language that comes first by number of rows, then by name; rows
with a null lang teach nothing; with nothing to learn from every text is ``und``;
repeated rows each give a row; an empty table gives an empty one; input columns
named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C

N, HASHES, SLOTS_PER_GRAM, MIN_SHARE, MAX_ROWS = 4, 3, 6, 0.003, 40_000
UNDETERMINED = "und"


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """All 4-byte windows of each text, set in spaces and lower-cased in ASCII, and each row's first."""
    buf, off = C.text_buffer(column)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    padded = np.full(len(buf) + 3 * len(size) + N, 0x20, np.uint32)
    padded[np.arange(len(buf)) + 3 * row + 2] = np.where(C.ASCII_SPACE[buf], np.uint8(0x20), C.ASCII_LOWER[buf])
    start = np.arange(len(buf)) + 3 * row
    g = padded[start] << np.uint32(24) | padded[start + 1] << np.uint32(16) | padded[start + 2] << np.uint32(8) | padded[start + 3]
    return g, off


def _slots(g: np.ndarray, k: int, bits: int) -> np.ndarray:
    mult = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)[k])
    return ((g.astype(np.uint64) * mult) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class BloomSlices:
    languages: list[str]
    bits: int
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], gram: np.ndarray, language: np.ndarray) -> BloomSlices:
        bits = max(10, int(np.ceil(np.log2(max(1, SLOTS_PER_GRAM * len(np.unique(gram)))))))
        table = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
        for k in range(HASHES):
            np.bitwise_or.at(table, (_slots(gram, k, bits), language // 64), np.uint64(1) << (language % 64).astype(np.uint64))
        full = np.array([np.mean((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
        return cls(languages, bits, table, full**HASHES)

    def masks(self, g: np.ndarray, word: int) -> np.ndarray:
        own = self.table[:, word]
        out = own[_slots(g, 0, self.bits)]
        for k in range(1, HASHES):
            out = out & own[_slots(g, k, self.bits)]
        return out

    def shares(self, g: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each text, the corrected share of its n-grams that each language contains."""
        n = np.maximum(np.diff(first), 1)
        out = np.zeros((len(n), len(self.languages)))
        for word in range(self.table.shape[1]):
            mask = self.masks(g, word)
            for i in range(64 * word, min(len(self.languages), 64 * word + 64)):
                hits = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                hit = hits[first[1:]] - hits[first[:-1]]
                out[:, i] = np.clip((hit - n * self.false_rate[i]) / (n * (1 - self.false_rate[i]) + 1e-12), 0, 1)
        return out


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language number, n-gram, documents) of each batch."""
    for batch in C.small_batches(batches):
        g, first = grams(batch.column(0))
        language = np.asarray(batch.column(1)).astype(np.uint64)
        row = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(first))
        pairs = np.unique((row << np.uint64(32)) | g)
        key, n = np.unique((language[(pairs >> np.uint64(32)).astype(np.int64)] << np.uint64(32)) | (pairs & np.uint64(0xFFFFFFFF)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def fit(labelled: DataFrame, min_share: float = MIN_SHARE, max_rows: int = MAX_ROWS) -> BloomSlices:
    """labelled: columns doc_id, text, lang."""
    rows = labelled.where("lang is not null and text is not null")
    counts = sorted(((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()), key=lambda x: (-x[1], x[0]))
    languages = [x for x, _ in counts]
    if not languages:
        return BloomSlices.build([], np.zeros(0, np.uint32), np.zeros(0, np.int64))
    each = max_rows / len(languages)
    spark = labelled.sparkSession
    known = spark.createDataFrame([(x, i, min(1.0, each / n)) for i, (x, n) in enumerate(counts)], "lang string, number int, share double")
    sample = rows.join(F.broadcast(known), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    sampled = sample.groupBy("number").agg(F.count("*").alias("docs"))
    found = sample.select("text", "number").mapInArrow(_document_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = found.withColumn("number", F.shiftright("key", 32).cast("int")).join(F.broadcast(sampled), "number")
    kept = found.where((F.col("n") >= 2) & (F.col("n") >= F.lit(min_share) * F.col("docs")) | (F.col("docs") < 20)).select("key").toPandas()
    key = kept["key"].to_numpy(np.int64)
    return BloomSlices.build(languages, (key & 0xFFFFFFFF).astype(np.uint32), key >> 32)


def identify(docs: DataFrame, model: BloomSlices) -> DataFrame:
    """Columns of ``docs`` with lang_pred, score and coverage (share of n-grams that lang_pred contains)."""
    made = {"lang_pred": "string", "score": "double", "coverage": "double"}
    base = docs.select(*C.carried(docs, made))
    schema = base.withColumns({k: F.lit(None).cast(v) for k, v in made.items()}).schema
    arrow = to_arrow_schema(schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in C.small_batches(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            g, first = grams(texts)
            letter = np.concatenate([[0], np.cumsum(((g >> np.uint32(8)) & np.uint32(0xFF)).astype(np.uint8) - np.uint8(0x61) < 26, dtype=np.int64)])
            ok = letter[first[1:]] > letter[first[:-1]]
            for k in np.flatnonzero(~ok & (np.diff(first) > 0)):
                ok[k] = any(c.isalpha() for c in texts[int(k)].as_py() or "")
            if m.languages:
                shares = m.shares(g, first)
                best = shares.argmax(axis=1)
                top, total = shares[np.arange(len(best)), best], shares.sum(axis=1)
                score = np.where(total > 0, top / np.maximum(total, 1e-12), 0.0)
            else:
                ok[:] = False
                best, top, score = np.zeros(len(ok), int), np.zeros(len(ok)), np.zeros(len(ok))
            out = {
                "lang_pred": pa.array([m.languages[b] if k else UNDETERMINED for b, k in zip(best, ok, strict=True)], pa.string()),
                "score": pa.array(np.where(ok, score, 0.0)), "coverage": pa.array(np.where(ok, top, 0.0)),
            }
            yield pa.RecordBatch.from_arrays([out[f.name] if f.name in out else batch.column(f.name) for f in arrow], schema=arrow)

    return base.mapInArrow(run, schema)


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(C.crc_mod(doc_id, 4) == 2, F.lit(False))


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id")).select("doc_id", F.col("text").cast("string").alias("text"), "lang")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(C.ids(docs), fit(train_rows(docs)))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "coverage")
