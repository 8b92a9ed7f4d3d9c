"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding.  Whether a merge happens at a place depends only on a bounded stretch
to its right: rule (u, v) can be disturbed only by a better-ranked rule that
takes a token ending where v ends, that one only by a still better one, and so
on.  ``sufficient_lookahead`` follows these chains over the merge list and gives
the longest reach in symbols.  ``BpeEncoder.stream`` keeps a buffer of a constant
number of symbols, merges it, and emits each token that ends at least the
lookahead before the end of what it has seen; the rest is merged again with more
input.  Since no merge of the whole crosses an emitted boundary, the tokens are
those of merging the whole text at once.  ``BpeEncoder.transduce`` is the same machine
over many words at a time, each with its own window; it is what the operator runs.  A
text passes in pieces of at most ``GROUP_BYTES``, or of one longer word, whose distinct
words go through once.

Decoding.  ``Decoder`` reads ids one by one.  Where the vocabulary file names a
byte-level decoder it is a byte-to-text state machine (pending bytes of an
unfinished character are its only state, ill-formed bytes give U+FFFD); where the
file names none, tokens are joined by one space, as its library does.

Defined results: a null or empty text has no tokens and decodes to the empty
text; the strings of special tokens in a text become those tokens; repeated rows
each give a row; an empty table gives an empty one; input columns named like a
result are replaced by it.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import functions as F

from . import _common as C

GROUP_BYTES = 2 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    out |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], width) -> int:
    """Symbols to the right of a token's end that can still change it.

    merges: rules from best to worst; width: symbols in a token."""
    reach: dict[str, int] = {}
    right: dict[str, str] = {}
    most = 0
    for u, v in merges:
        chain, token = 0, v
        while token is not None:
            chain = max(chain, reach.get(token, 0))
            token = right.get(token)
        own = width(v) + chain
        most = max(most, own)
        reach[u] = max(reach.get(u, 0), own)
        right.setdefault(u + v, v)
    return most


_NONE = np.int32(1 << 30)


class BpeEncoder:
    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rules = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(merges)}
        cut = len(self.suffix)
        self.width = lambda t: len(t) - cut if cut and t.endswith(self.suffix) else len(t)
        self.lookahead = sufficient_lookahead(merges, self.width)
        shown = byte_symbols()
        self.first = [self.vocab[c] for c in shown]
        self.final = [self.vocab[c + self.suffix] for c in shown]
        self.size = {i: self.width(t) for t, i in self.vocab.items()}
        self.buffer = max(64, 4 * self.lookahead)
        self.first_of, self.final_of = np.array(self.first, np.int32), np.array(self.final, np.int32)
        self.size_of = np.zeros(max(self.size) + 1, np.int64)
        self.size_of[list(self.size)] = list(self.size.values())
        self._hash_tables()

    def merge(self, syms: list[int]) -> list[int]:
        """Apply the best-ranked rule, leftmost first, until none applies: a queue of (rank, place) over a linked list."""
        rules, n = self.rules, len(syms)
        syms, after, before = list(syms), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*rules[p], k) for k, p in enumerate(zip(syms, syms[1:])) if p in rules]
        heapq.heapify(queue)
        while queue:
            rank, new, k = heapq.heappop(queue)
            nxt = after[k]
            if syms[k] < 0 or nxt >= n or rules.get((syms[k], syms[nxt])) != (rank, new):
                continue
            syms[k], syms[nxt], after[k] = new, -1, after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (rule := rules.get((new, syms[after[k]]))) is not None:
                    heapq.heappush(queue, (*rule, k))
            if before[k] >= 0 and (rule := rules.get((syms[before[k]], new))) is not None:
                heapq.heappush(queue, (*rule, before[k]))
        return [s for s in syms if s >= 0]

    def symbols(self, word: bytes) -> Iterator[int]:
        for b in memoryview(word)[:-1]:
            yield self.first[b]
        yield self.final[word[-1]]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Token ids of a symbol stream, holding at most ``buffer`` symbols."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) < self.buffer:
                continue
            end, safe = 0, len(held) - self.lookahead
            for token in self.merge(list(held)):
                if end + self.size[token] > safe:
                    break
                end += self.size[token]
                yield token
            held = held[end:]
        yield from self.merge(held)

    def transduce(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``stream`` over many words at once: tokens of all words in order, and the word of each.

        flat: the words' bytes; ends: index of each word's last byte.  Of each word a window of at most ``buffer``
        symbols is merged; the tokens that end at least the lookahead before the window's end are emitted, and the window
        moves on to the first that is not.  A word that ends within its window is done."""
        syms = self.first_of[flat]
        syms[ends] = self.final_of[flat[ends]]
        at, stop = np.concatenate([[0], ends[:-1] + 1]), ends + 1
        left = np.arange(len(ends))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        while len(left):
            size = np.minimum(stop[left] - at[left], self.buffer)
            begin = np.cumsum(size) - size
            window = np.arange(len(left), dtype=np.int32).repeat(size)
            tokens, of = self._merge_windows(syms[at[left][window] - begin[window] + np.arange(len(window))], window)
            whole = at[left] + size == stop[left]
            if whole.all():
                out.append((left[of], tokens))
                break
            end = np.cumsum(self.size_of[tokens]) - begin[of]
            stable = whole[of] | (end <= size[of] - self.lookahead)
            out.append((left[of[stable]], tokens[stable]))
            moved = np.zeros(len(left), np.int64)
            np.maximum.at(moved, of[stable], end[stable])
            at[left] += moved
            left = left[~whole]
        of, tokens = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(out) > 2:
            order = np.argsort(of, kind="stable")
            of, tokens = of[order], tokens[order]
        return tokens, of

    def _merge_windows(self, syms: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many windows at once, each one's best rule per round: tokens in order and the window of each."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(syms):
            new = np.ones(len(owner), bool)
            np.not_equal(owner[1:], owner[:-1], out=new[1:])
            rank = np.full(len(syms), _NONE, np.int32)
            pair = np.flatnonzero(~new[1:])
            rank[pair] = self.rank(syms[pair], syms[pair + 1])
            heads = np.flatnonzero(new)
            best = np.minimum.reduceat(rank, heads)
            length = np.diff(np.append(heads, len(syms)))
            best = np.repeat(best, length)
            over = best == _NONE
            done.append((owner[over], syms[over]))
            at = np.flatnonzero((rank == best) & ~over)
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.diff(at, prepend=-9) > 1, np.arange(len(at)), 0))
            at = at[run % 2 == 0]  # of overlapping places the leftmost
            syms[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            syms, owner = syms[keep], owner[keep]
        if not done:
            return syms, owner
        owner, syms = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return syms[order], owner[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the rule for each pair of symbols, from tables of hashed pairs."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(key), _NONE, np.int32)
        left = np.arange(len(key))
        for mult, keys, ranks, crowded in self.tables:
            slot = ((key[left] * mult) >> np.uint64(46)).astype(np.int64)
            hit = keys[slot] == key[left]
            out[left[hit]] = ranks[slot[hit]]
            left = left[~hit & crowded[slot]]
        return out

    def _hash_tables(self) -> None:
        """Pairs by hash; pairs whose slot is taken go to the next table."""
        key = np.array([(a << 32) | b for a, b in self.rules], np.uint64)
        rank = np.array([r for r, _ in self.rules.values()], np.int32)
        self.made = np.zeros(len(rank), np.int32)
        self.made[rank] = [new for _, new in self.rules.values()]
        self.tables, mult = [], 0x5851F42D4C957F2D
        while len(key):
            slot = ((key * np.uint64(mult)) >> np.uint64(46)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            keys, ranks = np.full(1 << 18, (1 << 64) - 1, np.uint64), np.zeros(1 << 18, np.int32)
            keys[slot[first]], ranks[slot[first]] = key[first], rank[first]
            crowded = np.zeros(1 << 18, bool)
            rest = np.ones(len(key), bool)
            rest[first] = False
            crowded[slot[rest]] = True
            self.tables.append((np.uint64(mult), keys, ranks, crowded))
            key, rank, mult = key[rest], rank[rest], (mult * 0x2545F4914F6CDD1D + 2) % (1 << 64) | 1


class Decoder:
    """Ids to text, one id at a time."""

    def __init__(self, spec: dict):
        self.text = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens") or []}
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.value = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["id"] for t in spec.get("added_tokens") or []}
        self.listed = [self.text.get(i, "") for i in range(max(self.text, default=-1) + 1)]
        self.reset()

    def reset(self) -> None:
        self.pending = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, token: int) -> str:
        text = self.text.get(token, "")
        if not self.bytewise:
            text, self.begun = (" " if self.begun else "") + text, True
            return text
        if token in self.special:
            return self.finish() + text
        return self.pending.decode(bytes(self.value[c] for c in text))

    def push_many(self, tokens: np.ndarray) -> str:
        """What ``push`` gives for each of the ids, joined."""
        if self.bytewise or not len(tokens):
            return "".join(map(self.push, tokens.tolist()))
        lead, self.begun = " " if self.begun else "", True
        return lead + " ".join(map(self.listed.__getitem__, tokens.tolist()))

    def finish(self) -> str:
        return self.pending.decode(b"", True)


class Tokenizer:
    """Normalise, split and encode as the vocabulary file says; remembers words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.encoder, self.decoder = BpeEncoder(spec), Decoder(spec)
        kinds = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        self.nfc = any(k["type"] == "NFC" for k in kinds)
        self.lower = any(k["type"] == "Lowercase" for k in kinds)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.latin_rules = pattern.endswith(_LETTERS_DIGITS_REST) and all("'" in p for p in pattern.removesuffix(_LETTERS_DIGITS_REST).split("|") if p)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The words of each stretch between special tokens; a special token alone."""
        parts = self.marks.split(text) if self.marks and any(s in text for s in self.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [part]
                continue
            if self.nfc and not part.isascii():
                part = unicodedata.normalize("NFC", part)
            if self.lower:
                part = part.lower() if part.isascii() or "Σ" not in part else "".join(c.lower() for c in part)
            yield self.split.findall(part)

    def plain_tokens(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of stretches without ASCII white space, split by the vocabulary's own pattern, and the stretch of each."""
        words, of_word, given, place = [], [], [], []  # ordinary words; special tokens and where they stand
        for k, raw in enumerate(stretches):
            for turn, found in enumerate(self.pieces(raw.decode())):
                for w in found:
                    if turn % 2:
                        given.append((self.special[w], len(of_word)))
                    else:
                        words.append(w.encode())
                        place.append(len(of_word))
                    of_word.append(k)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) - 1
        tokens, word = self.encoder.transduce(np.frombuffer(b"".join(words), np.uint8), ends) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        at = np.array(place, np.int64)[word] if words else word
        if given:
            tokens, at = np.concatenate([tokens, np.array([t for t, _ in given], np.int32)]), np.concatenate([at, np.array([p for _, p in given], np.int64)])
            order = np.argsort(at, kind="stable")
            tokens, at = tokens[order], at[order]
        return tokens, np.array(of_word, np.int64)[at]

    def distinct_tokens(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many stretches: all tokens in order, and where each stretch's begin.

        Stretches of ASCII and two-byte Latin letters are split and lower-cased bytewise;
        any other goes through the pattern."""
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size)])
        flat = buf[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
        odd = _CLASS[flat] == 3
        lead = np.flatnonzero(flat == 0xC3)
        next_byte = flat[np.minimum(lead + 1, len(flat) - 1)]
        tail = np.zeros(len(flat), bool)
        tail[lead + 1 - (lead + 1 == len(flat))] = True
        odd |= (flat >= 0x80) & (flat < 0xC0) & ~tail
        odd[lead[(next_byte == 0x97) | (next_byte == 0xB7)]] = True
        slow = np.logical_or.reduceat(odd, at[:-1]) if len(size) else np.zeros(0, bool)
        if not (self.lower and self.latin_rules):
            slow[:] = True
        owner = np.repeat(np.arange(len(size)), size)
        fast = ~slow[owner]
        flat, owner, tail = flat[fast], owner[fast], tail[fast]
        flat = C.ASCII_LOWER[flat]
        flat = np.where(tail & (flat < 0x9F), flat + np.uint8(0x20), flat)
        kind = _CLASS[flat]
        begin = np.ones(len(flat), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1) | (owner[1:] != owner[:-1])
        word_at = np.flatnonzero(begin)
        tokens, word = self.encoder.transduce(flat, np.append(word_at[1:], len(flat)) - 1) if len(flat) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        whose = owner[word_at[word]] if len(word) else np.zeros(0, np.int64)
        rest = np.flatnonzero(slow)
        if len(rest):
            more, of = self.plain_tokens([buf[starts[k] : ends[k]].tobytes() for k in rest])
            tokens, whose = np.concatenate([tokens, more]), np.concatenate([whose, rest[of]])
            order = np.argsort(whose, kind="stable")
            tokens, whose = tokens[order], whose[order]
        return tokens, np.searchsorted(whose, np.arange(len(size) + 1))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, token ids) in order; the ids of a long text come in several pieces, so that memory does not follow its length.

        White space ends every word, so the stretches between it are independent: a piece is cut into stretches, each
        distinct one is encoded once, and the texts' tokens are gathered from those."""
        buf, off = C.text_buffer(texts)
        for row, end, a, b in _text_pieces(buf, off):
            part, own = buf[a:b], np.clip(off[row : end + 1] - a, 0, b - a)
            starts, ends, which = C.word_spans(part, own, C.ASCII_SPACE)
            first, inverse = _distinct(part, starts, ends)
            tokens, at = self.distinct_tokens(part, starts[first], ends[first])
            n = np.diff(at)[inverse]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = tokens[np.repeat(at[inverse] - total[:-1], n) + np.arange(total[-1])].astype("<u4")
            cuts = total[np.searchsorted(which, np.arange(end - row + 1))]
            for k in range(end - row):
                yield row + k, ids[cuts[k] : cuts[k + 1]]


def _text_pieces(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last) of groups of texts; a long text in several, cut at white space."""
    row = 0
    while row < len(off) - 1:
        end = max(row + 1, int(np.searchsorted(off, off[row] + GROUP_BYTES, side="right")) - 1)
        a, stop = int(off[row]), int(off[end])
        while stop - a > GROUP_BYTES:  # one text
            space = np.flatnonzero(C.ASCII_SPACE[buf[a : a + GROUP_BYTES]])
            cut = a + int(space[-1]) + 1 if len(space) else next((k for k in range(a + GROUP_BYTES, stop) if C.ASCII_SPACE[buf[k]]), stop)
            yield row, end, a, cut
            a = cut
        yield row, end, a, stop
        row = end


def _distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of slice, and the kind of each: by hash, then compared byte by byte."""
    _, first, kind = np.unique(C.slice_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    if C.equal_slices(buf, starts, size, buf, starts[first][kind], size[first][kind]).all():
        return first, kind
    seen: dict[bytes, int] = {}
    kind = np.array([seen.setdefault(buf[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends, strict=True)], np.int64)
    return np.unique(kind, return_index=True)[1], kind


_LETTERS_DIGITS_REST = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Of a byte: letter 0, digit 1, other 2, and 3 for what only the pattern can judge (controls, ' and <, most non-ASCII).
_CLASS = np.full(256, 3, np.uint8)
_CLASS[0x21:0x7F] = 2
_CLASS[[0x27, 0x3C]] = 3
_CLASS[0x30:0x3A] = 1
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = 0


class _Coded:
    """One text on its way: what is kept of its ids and of the text they decode to."""

    def __init__(self, decoder: Decoder, keep: bool):
        decoder.reset()
        self.decoder, self.n, self.ids, self.text = decoder, 0, hashlib.sha256(), hashlib.sha256()
        self.kept: tuple[list, list] | None = ([], []) if keep else None

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.ids.update(ids.tobytes())
        self._show(self.decoder.push_many(ids))
        if self.kept:
            self.kept[0].extend(ids.tolist())

    def _show(self, text: str) -> None:
        self.text.update(text.encode())
        if self.kept:
            self.kept[1].append(text)

    def close(self, made: dict[str, list]) -> None:
        self._show(self.decoder.finish())
        made["n_tokens"].append(self.n)
        made["ids_sha256"].append(self.ids.hexdigest())
        made["decoded_sha256"].append(self.text.hexdigest())
        if self.kept:
            made["token_ids"].append(self.kept[0])
            made["decoded"].append("".join(self.kept[1]))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Columns of ``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, token_ids and decoded.

    vocabulary: path of the vocabulary file on every executor."""
    path = vocabulary or default_vocabulary()
    rest = C.carried(docs, ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded", "doc_id", "text"])
    base = C.ids(docs, extra=rest)
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<int>", "decoded": "string"} if keep_ids else {})
    schema = base.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items()}).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            made: dict[str, list] = {k: [] for k in kinds}
            now, at = None, -1
            for row, ids in tok.encode(batch.column("text")):
                if row != at:
                    if now:
                        now.close(made)
                    now, at = _Coded(tok.decoder, keep_ids), row
                now.add(ids)
            if now:
                now.close(made)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in arrow], schema=arrow)

    return base.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_encode(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
