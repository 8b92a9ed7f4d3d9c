"""Language-model scores by prediction by partial matching (PPM) over byte contexts.

The model is a trie of byte contexts up to ``ORDER`` symbols, with the counts of what
followed each in the training texts (every text is set in start marks and closed by an
end mark).  A symbol is predicted by the longest context that has seen it; every longer
context escapes with the probability of method C, distinct / (total + distinct), and
symbols that a longer context offered are excluded from the shorter ones.  Beyond the
empty context all symbols left are equally likely.  A text's score is the sum of the
log10 probabilities of its bytes and the end mark.

The trie is never held whole.  A chunk of documents sends each bucket its distinct
(context, symbol) grams with their training counts, compressed; a bucket holds all
contexts that end in the same ``SUFFIX`` symbols, hence every context of its grams from
that order up, and answers each gram with its log probability.  Shorter contexts come
from the table of grams of SUFFIX symbols, at most 257**3 entries, counted beforehand and
broadcast; question, answer and score are one plan, so that the texts are dealt once.
The counts cover the whole training corpus and grow with it.

The base score is a smoothed unigram model over words; word counts travel the same way,
keyed by 80-bit hashes and the bucket.

Defined results: a null or blank text has only the end token and the end mark; rows
with a null id are training rows; repeated rows count as often as they occur and each
give a row; an empty table gives an empty one; with no training rows every symbol is
equally likely and N and V are 0; input columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

ORDER, SUFFIX, SYMBOLS, MARK, CHUNK_BYTES = 5, 3, 257, 256, 8 << 20
_BITS = np.uint64(9)


def _grams(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(distinct grams that end at a byte or end mark, blocks of rows). Of a block: the row of
    each of its grams, these in ascending order, where each distinct one's run begins, and its
    place among all distinct grams.

    Symbols are numbered as they occur here, so that a gram and its row are one number and the
    numbers are sorted by themselves."""
    symbols = np.append(np.flatnonzero(np.bincount(buf, minlength=256)), MARK)
    bits = max(1, (len(symbols) - 1).bit_length())
    left = 64 - bits * (order + 1)
    code = np.zeros(256, np.uint8 if bits <= 8 else np.uint16)
    code[symbols[:-1]] = np.arange(len(symbols) - 1)
    size = np.diff(off) + 1
    end = np.cumsum(size + order)
    ends = np.ones(end[-1] if len(end) else 0, bool)  # of a gram; a row's first ``order`` marks end none
    ends[((end - size - order)[:, None] + np.arange(order)).ravel()] = False
    text = ends.copy()
    text[end - 1] = False
    padded = np.full(len(text), len(symbols) - 1, code.dtype)
    padded[text] = code[buf]
    n = max(0, len(padded) - order)
    g = padded[:n].astype(np.uint64)
    for j in range(1, order + 1):
        g <<= np.uint64(bits)
        g |= padded[j : j + n]
    g = g[ends[order:]]
    del text, padded, ends
    first, blocks, found = np.concatenate([[0], np.cumsum(size)]), [], []
    for a in range(0, max(len(size), 1), 1 << left):
        n = size[a : a + (1 << left)]
        key = g[first[a] : first[a] + n.sum()]  # worked on in place, as it is large
        key <<= np.uint64(left)
        key |= np.repeat(np.arange(len(n), dtype=np.uint32), n)
        key.sort()
        head = np.flatnonzero(np.concatenate([[True], (key[1:] ^ key[:-1]) >> np.uint64(left) > 0])) if len(key) else np.zeros(0, int)
        found.append(key[head] >> np.uint64(left))
        key &= np.uint64((1 << left) - 1)
        blocks.append((key.astype(np.uint32) + np.uint32(a), head))
    distinct = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    gram = np.zeros(len(distinct), np.uint64)
    for j in range(order, -1, -1):
        gram = (gram << _BITS) | symbols.astype(np.uint64)[(distinct >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1)]
    return gram, [(row, head, np.searchsorted(distinct, own)) for (row, head), own in zip(blocks, found, strict=True)]


def _part(g: np.ndarray, symbols: int) -> np.ndarray:
    """The last ``symbols`` symbols of each gram."""
    return g & np.uint64((1 << (9 * symbols)) - 1)


class _Level:
    """Counts of the grams whose context has one length, with PPM's sums by context."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, length: int = SUFFIX):
        self.length = length
        order = np.argsort(gram, kind="stable")
        gram, count = gram[order], count[order]
        new = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, int)
        self.gram, self.count = gram[new], np.add.reduceat(count, new) if len(new) else count
        context = self.gram >> _BITS
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, int)
        self.context = context[head]
        self.total = np.add.reduceat(self.count, head) if len(head) else head
        self.distinct = np.diff(np.append(head, len(context)))
        self.head = head

    def shadow(self, shorter: _Level) -> np.ndarray:
        """For each context, what the shorter context counts for the symbols seen here."""
        if not len(self.head):
            return np.zeros(0, np.int64)
        n = shorter.count[np.searchsorted(shorter.gram, _part(self.gram, self.length))]
        return np.add.reduceat(n, self.head)


def _levels(gram: np.ndarray, count: np.ndarray, low: int, high: int) -> list[_Level]:
    """Levels with contexts of ``low`` to ``high`` symbols, shortest first."""
    out = []
    for k in range(high, low - 1, -1):
        level = _Level(_part(gram, k + 1), count, k)
        gram, count = level.gram, level.count
        out.insert(0, level)
    return out


def _log_probabilities(asked: np.ndarray, levels: list[_Level]) -> np.ndarray:
    """log10 P(symbol | context) of each gram, levels from the empty context up."""
    out = np.zeros(len(asked))
    open_ = np.ones(len(asked), bool)
    shadow_total, shadow_distinct = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if len(level.context):
            part = _part(asked, k + 1)
            c = np.minimum(np.searchsorted(level.context, part >> _BITS), len(level.context) - 1)
            known = open_ & (level.context[c] == part >> _BITS)
            g = np.minimum(np.searchsorted(level.gram, part), len(level.gram) - 1)
            seen = known & (level.gram[g] == part)
            total = level.total[c] - shadow_total
            distinct = level.distinct[c] - shadow_distinct
            bottom = np.maximum(total + distinct, 1)
            out[seen] += np.log10(level.count[g[seen]] / bottom[seen])
            escape = known & ~seen & (distinct > 0)
            out[escape] += np.log10(distinct[escape] / bottom[escape])
            open_ &= ~seen
            below = level.shadow(levels[k - 1]) if k else None
            shadow_total = np.where(known, below[c] if k else 0, 0)
            shadow_distinct = np.where(known, level.distinct[c], 0)
    left = np.maximum(SYMBOLS - shadow_distinct[open_], 1)
    out[open_] -= np.log10(left)
    return out


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, byte planes apart and compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(value: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(value.as_buffer()), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def listed(values: np.ndarray) -> bytes:
    """Doubles as the list of distinct ones and the place of each in it, compressed."""
    table, at = np.unique(values, return_inverse=True)
    code = at.astype("<u2" if len(table) <= 1 << 16 else "<u4")
    planes = np.ascontiguousarray(code.view(np.uint8).reshape(len(code), -1).T)
    return zstandard.compress(np.array([len(table), code.itemsize], "<u4").tobytes() + table.astype("<f8").tobytes() + planes.tobytes(), 3)


def unlisted(value: pa.Scalar) -> np.ndarray:
    raw = zstandard.decompress(value.as_buffer())
    n, width = np.frombuffer(raw, "<u4", 2)
    code = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8 + 8 * n).reshape(width, -1).T).view(f"<u{width}").ravel()
    return np.frombuffer(raw, "<f8", n, 8)[code]


class _Chunk:
    """The distinct grams and words of one chunk, in the order of its messages."""

    def __init__(self, table: pa.Table, buckets: int):
        self.buckets = buckets
        buf, off = C.text_buffer(table.column("text"))
        self.train = np.asarray(table.column("_train").combine_chunks()).astype(bool)
        self.gram, self.blocks = _grams(buf, off, ORDER)
        self.text = C.ASCII_LOWER[buf]
        self.start, self.end, self.row = C.word_spans(self.text, off, C.ASCII_SPACE)
        h = C.slice_hashes(self.text, self.start, self.end)
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        self.some, self.of_word = order[new], np.empty(len(h), np.int64)  # an occurrence of each word; the word of each occurrence
        self.of_word[order] = np.cumsum(new) - 1
        self.word = h[self.some]
        suffix = _part(self.gram >> _BITS, SUFFIX)
        self.gram_bucket = (C.mix(suffix) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        self.word_bucket = ((self.word >> np.uint64(20)) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))

    def gram_counts(self) -> np.ndarray:
        """How often each gram occurs in training rows."""
        out = np.zeros(len(self.gram), np.uint32)
        for row, head, at in self.blocks:
            if len(head):
                out[at] += np.add.reduceat(self.train[row], head, dtype=np.uint32)
        return out

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """A second hash of each word and how often it occurs in training rows."""
        check = C.slice_hashes(self.text, self.start[self.some], self.end[self.some], 1).astype(np.uint32)
        return check, np.bincount(self.of_word, self.train[self.row], minlength=len(self.word)).astype(np.uint32)

    def gram_sums(self, value: np.ndarray) -> np.ndarray:
        """Of each row the sum of its grams' values."""
        out = np.zeros(len(self.train))
        for row, head, at in self.blocks:
            out += np.bincount(row, np.repeat(value[at], np.diff(np.append(head, len(row)))), minlength=len(out))
        return out

    def word_sums(self, value: np.ndarray) -> np.ndarray:
        """Of each row the sum of its words' values."""
        return np.bincount(self.row, value[self.of_word], minlength=len(self.train))

    def picks(self, where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            if cuts[b + 1] > cuts[b]:
                yield b, order[cuts[b] : cuts[b + 1]]


def _ask(buckets: int):
    def run(key, table):
        chunk = _Chunk(table, buckets)
        kind, bucket, keys, counts = [], [], [], []

        def put(*row):
            for column, x in zip((kind, bucket, keys, counts), row, strict=True):
                column.append(x)

        count = chunk.gram_counts()
        for b, pick in chunk.picks(chunk.gram_bucket):
            gram = chunk.gram[pick]  # ascending
            put("gram", b, packed(np.diff(gram, prepend=gram[:1])), packed(np.append(gram[:1], count[pick].astype(np.uint64))))
        second, times = chunk.word_counts()
        for b, pick in chunk.picks(chunk.word_bucket):
            check = second[pick].astype(np.uint16).astype(np.uint64) << np.uint64(32)
            put("word", b, packed(np.diff(chunk.word[pick], prepend=np.uint64(0))), packed(check | times[pick]))
        return pa.table(
            {
                "kind": pa.array(kind, pa.string()), "bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(kind), pa.int32()),
                "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary()),
            }
        )

    return run


_ASKED = "kind string, bucket int, chunk int, keys binary, counts binary"


def _answer(short):
    """A bucket's log probabilities of the grams, or counts of the words, that each chunk sent."""

    def run(key, table):
        kind = key[0].as_py()
        if kind == "gram":
            facts = [unpacked(x) for x in table["counts"]]
            parts = [np.cumsum(unpacked(x), dtype=np.uint64) + f[0] for x, f in zip(table["keys"], facts, strict=True)]
            gram, count = np.concatenate(parts), np.concatenate([f[1:] for f in facts]).astype(np.int64)
            trained = count > 0
            levels = short.value + _levels(gram[trained], count[trained], SUFFIX, ORDER)
            distinct, inverse = np.unique(gram, return_inverse=True)
            value = _log_probabilities(distinct, levels)[inverse]
        else:
            parts, value, _ = _word_totals(table)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        found = [packed(v) if kind == "word" else listed(v) for v in np.split(value, cuts)]
        return pa.table({"kind": table["kind"], "bucket": table["bucket"], "chunk": table["chunk"], "found": pa.array(found, pa.binary())})

    return run


def _word_totals(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(words of each message, count over all of each, count of each distinct word)."""
    parts = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table["keys"]]
    facts = np.concatenate([unpacked(x) for x in table["counts"]])
    word, check, n = np.concatenate(parts), facts >> np.uint64(32), (facts & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((check, word))
    new = np.ones(len(word), bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    total = np.add.reduceat(n[order], np.flatnonzero(new))
    value = np.empty(len(word), np.int64)
    value[order] = total[np.cumsum(new) - 1]
    return parts, value, total


def _word_facts(key, table):
    """A bucket's training words, repeats included, and different ones."""
    if key[0].as_py() != "word":
        return pa.table({"tokens": pa.array([], pa.int64()), "types": pa.array([], pa.int64())})
    total = _word_totals(table)[2]
    return pa.table({"tokens": pa.array([int(total.sum())]), "types": pa.array([int((total > 0).sum())])})


_ANSWERED = "kind string, bucket int, chunk int, found binary"


def _finish(buckets: int, ends: int):
    def run(key, left, right):
        chunk = _Chunk(left, buckets)
        gram, word = np.zeros(len(chunk.gram)), np.zeros(len(chunk.word), np.int64)
        got = {(k, b): x for k, b, x in zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["found"], strict=True)}
        for b, pick in chunk.picks(chunk.gram_bucket):
            gram[pick] = unlisted(got["gram", b])
        for b, pick in chunk.picks(chunk.word_bucket):
            word[pick] = unpacked(got["word", b])
        n_words = np.bincount(chunk.row, minlength=left.num_rows)
        known = chunk.word_sums((word > 0).astype(float)).astype(np.int64)
        top = chunk.word_sums(np.log10(word + 0.1)) + np.log10(ends + 0.1)
        return pa.table(
            {
                "doc_id": left["doc_id"], "held_out": pa.array(~chunk.train),
                "n_tokens": pa.array(n_words + 1), "n_known": pa.array(known + (ends > 0)),
                "top": pa.array(top), "score": pa.array(chunk.gram_sums(gram)),
            }
        )

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, top double, score double"


def _short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of ``SUFFIX`` symbols and their counts."""
    for batch in C.small_batches(batches):
        gram, blocks = _grams(*C.text_buffer(batch.column(0)), SUFFIX - 1)
        n = np.zeros(len(gram), np.int64)
        for row, head, at in blocks:
            n[at] += np.diff(np.append(head, len(row)))
        yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n)], ["gram", "n"])


def lm_scores(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    train: which rows the model learns from (null: they do)."""
    spark = docs.sparkSession
    base = C.ids(docs).withColumn("_train", F.coalesce(train, F.lit(True)))
    chunks, buckets = C.plan_chunks(base, CHUNK_BYTES)
    short = base.where("_train").select("text").mapInArrow(_short_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    # at most 257**3 grams of three symbols exist, whatever the corpus
    order = np.argsort(short["gram"].to_numpy(np.int64))
    low = _levels(short["gram"].to_numpy(np.int64)[order].astype(np.uint64), short["n"].to_numpy(np.int64)[order], 0, SUFFIX - 1)
    ends = base.where("_train").count()
    # one plan from here on: the texts are dealt once, for the question and for the score
    by_chunk = C.with_chunk(base, chunks).groupBy("_chunk")
    asked = by_chunk.applyInArrow(_ask(buckets), _ASKED).groupBy("kind", "bucket")
    answered = asked.applyInArrow(_answer(spark.sparkContext.broadcast(low)), _ANSWERED)
    scored = by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(_finish(buckets, ends), _SCORED)
    facts = asked.applyInArrow(_word_facts, "tokens long, types long").agg(
        (F.coalesce(F.sum("tokens"), F.lit(0)) + ends).alias("tokens"), (F.coalesce(F.sum("types"), F.lit(0)) + int(ends > 0)).alias("types")
    )
    bottom = F.log10(F.col("tokens") + 0.1 * (F.col("types") + 1))
    return scored.crossJoin(F.broadcast(facts)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.col("tokens").alias("train_tokens"), (F.col("top") - F.col("n_tokens") * bottom).alias("base_score"), "score"
    )


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(C.crc_mod(doc_id, 10) == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, ~held_out("doc_id"))
