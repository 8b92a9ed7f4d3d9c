"""Byte-level BPE by backtracking over longest matches, in time linear in the text.

The vocabulary is a list of byte strings with ranks; merging always joins the neighbours whose joined bytes have the
smallest rank, the leftmost of equals.  A sequence of tokens is what merging leaves exactly if every two neighbours are
what merging leaves of their own bytes (``compatible``).  So a piece is encoded from left to right: take the longest token
that matches here and is compatible with the token before, else the next shorter one; where none is, the place is a dead
end, the last token is taken back and a shorter one tried.  A dead end is remembered and never entered again, so no place
is left more than once.  Longest matches come from a pyahocorasick automaton over bytes written as Latin-1 characters.

``compatible`` undoes the merges of both tokens from the last to the first and looks whether the two inner neighbours
would have been joined before the merge undone last; its answers are remembered by pair, those of a piece by piece, in
tables of a bounded size that start anew when full.

A text is split by the vocabulary's pattern, each match separately; a match that is itself a token is that token.  Long
texts are split in stretches, cut where no match can cross (from a letter to another sign, or before white space).

Defined results: a null or empty text has no tokens and decodes to no bytes; strings of special tokens are ordinary text;
repeated rows each give a row; an empty table gives an empty one; input columns named like a result are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C

STRETCH, KEPT_PIECES, KEPT_PAIRS, LONG_PIECE = 1 << 18, 1 << 19, 1 << 20, 256
#: Between a letter and another sign, or ahead of white space, no match of the pattern goes on.
_CUT = r"(?<=\p{L})(?=[^\p{L}])|(?<=\P{White_Space})(?=\p{White_Space})"


class _Pieces(dict):
    """Ids of a piece as little-endian 32-bit numbers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """An encoder and decoder for ranks (bytes of a token: rank) and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no token")
        # the library's \s is Unicode's white space
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cut = regex.compile(_CUT)
        self.parts: dict[int, tuple[int, int]] = {}
        self.rule: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}
        self.span, self.size = max(self.token) + 1, {r: len(b) for r, b in self.token.items()}
        whole = self._learn()
        self.longest = max(map(len, ranks))
        self.automaton, self.shorter = ahocorasick.Automaton(), {}
        for text, rank in sorted(whole.items()):  # a prefix comes before what it begins
            below = next((whole[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in whole), None)
            self.shorter[rank] = below
            shown = text.decode("latin-1")
            for k in range(2, len(shown)):  # a beginning that is no token stands for the longest one in it
                if not self.automaton.exists(shown[:k]):
                    self.automaton.add_word(shown[:k], self.automaton.get(shown[: k - 1]))
            self.automaton.add_word(shown, rank)
        self.memo = _Pieces(self.encode_piece)

    def _learn(self) -> dict[bytes, int]:
        """Set down the last merge of every token, from the smallest rank up; the tokens that merging can reach."""
        whole: dict[bytes, int] = {}
        for text, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(text) == 1:
                whole[text] = rank
                continue
            for k in range(1, len(text)):
                a, b = whole.get(text[:k]), whole.get(text[k:])
                if a is not None and b is not None and self._undone(a, b):
                    self.parts[rank], self.rule[a, b], whole[text] = (a, b), rank, rank
                    break
            else:
                if self._merged(text) == [text]:
                    raise ValueError("a token is made of tokens of a larger rank")
        return whole

    def _merged(self, text: bytes) -> list[bytes]:
        """Merging by definition; only for a token that no two smaller ones make."""
        out = [text[k : k + 1] for k in range(len(text))]
        while len(out) > 1:
            rank, at = min((self.ranks.get(a + b, len(self.token) + max(self.token)), k) for k, (a, b) in enumerate(zip(out, out[1:])))
            if rank not in self.token:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens."""
        known = self.pairs.get(key := left * self.span + right)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._undone(left, right)
        return known

    def _undone(self, left: int, right: int) -> bool:
        before = None  # merges of this rank or more came after
        while True:
            made = self.rule.get((left, right))
            if made is not None and (before is None or made < before):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:  # of equal merges the left one comes first, and the middle is left of this one
                before, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        reach, begun, size, shorter, pairs, span, longest = self.automaton.longest_prefix, self.automaton.get, self.size, self.shorter, self.pairs, self.span, self.longest
        shown, n, at, last, out = piece.decode("latin-1"), len(piece), 0, -1, []
        dead: set[int] = set()
        while at < n:
            near = shown[at : at + longest]
            token = begun(near[: reach(near)])  # the longest that begins here
            while True:
                if token is None:
                    dead.add(at)
                    token = out.pop()
                    last = out[-1] if out else -1
                    at -= size[token]
                elif not dead or at + size[token] not in dead:
                    fits = last < 0 or pairs.get(last * span + token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            out.append(token)
            at += size[token]
            last = token
        return out

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches of a text, a bounded stretch at a time."""
        at = 0
        while at < len(text):
            end = at + STRETCH
            found = self.cut.search(text, end) if end < len(text) else None
            end = found.start() if found else len(text)
            yield self.split.findall(text[at:end])
            at = end

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit numbers, stretch by stretch."""
        for pieces in self.stretches(text):
            yield b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def byte_bpe_encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Columns of ``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, token_ids and decoded (bytes).

    vocabulary: path of a file of ranks on every executor; pattern: what splits a text."""
    import public_tokenizers

    path, pattern = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    rest = C.carried(docs, ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded", "doc_id", "text"])
    base = C.ids(docs, extra=rest)
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<int>", "decoded": "binary"} if keep_ids else {})
    schema = base.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items()}).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = coder(path, pattern)
        for batch in C.small_batches(batches):
            made: dict[str, list] = {k: [] for k in kinds}
            for text in batch.column("text"):
                n, ids_sum, text_sum, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in tok.encode(text.as_py() or ""):
                    shown = tok.decode(ids)
                    n += len(ids) // 4
                    ids_sum.update(ids)
                    text_sum.update(shown)
                    if keep_ids:
                        kept.append((ids, shown))
                made["n_tokens"].append(n)
                made["ids_sha256"].append(ids_sum.hexdigest())
                made["decoded_sha256"].append(text_sum.hexdigest())
                if keep_ids:
                    made["token_ids"].append(np.frombuffer(b"".join(i for i, _ in kept), "<u4").astype(np.int32))
                    made["decoded"].append(b"".join(s for _, s in kept))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in arrow], schema=arrow)

    return base.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return byte_bpe_encode(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
