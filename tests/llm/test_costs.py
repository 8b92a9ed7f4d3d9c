"""What the corpus operators leave undone because it can't change a result."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corroborate.llm import lm_scoring, suffix_dedup
from corroborate.llm import _common as C

RND = random.Random(29)


def noise(n: int, letters: str = "abcdefghijklmnop") -> str:
    return "".join(RND.choice(letters) for _ in range(n))


def removed(chunks: list[list[tuple[int, str]]], monkeypatch) -> tuple[list[tuple[int, int, int]], int]:
    """(doc_id, n_bytes, n_removed) by the steps of op4 in one bucket, and the bytes whose suffixes were merged."""
    merged, inner = [], suffix_dedup._repeated

    def repeated(text, start, windows, owner, length):
        merged.append(int((windows + length - 1).sum()))
        return inner(text, start, windows, owner, length)

    monkeypatch.setattr(suffix_dedup, "_repeated", repeated)
    tables = [pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([x for _, x in rows])}) for rows in chunks]
    of = lambda table, k: table.filter(pa.compute.equal(table["chunk"], k))
    shared = suffix_dedup._shared(None, pa.concat_tables([suffix_dedup._ask(50, 1)((pa.scalar(k),), t) for k, t in enumerate(tables)]))
    sent = pa.concat_tables([suffix_dedup._send(50, 1)((pa.scalar(k),), t, of(shared, k)) for k, t in enumerate(tables)])
    found = suffix_dedup._intervals(50)(None, sent) if sent.num_rows else shared.slice(0, 0)
    told = pa.concat_tables([x.append_column("step", pa.array([step] * x.num_rows, pa.int32())) for step, x in enumerate((shared, found))])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64())])
    out = [suffix_dedup._finish(50, 1, False, schema)((pa.scalar(k),), t, of(told, k)) for k, t in enumerate(tables)]
    return [tuple(r.values()) for t in out for r in t.to_pylist()], sum(merged)


def brute(chunks: list[list[tuple[int, str]]]) -> list[tuple[int, int, int]]:
    rows, owner, out = [r for rows in chunks for r in rows], {}, []
    for i, x in rows:
        for k in range(len(x) - 49):
            owner[x[k : k + 50]] = min(i, owner.get(x[k : k + 50], i))
    for i, x in rows:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 49):
            gone[k : k + 50] |= owner[x[k : k + 50]] < i
        out.append((i, len(x), int(gone.sum())))
    return out


def test_passages_shorter_than_a_string_are_not_merged(monkeypatch):
    passage = noise(37)
    edge = [chr(0x21 + k) for k in range(40)]  # of no two texts alike
    chunks = [[(k, noise(70) + edge[k] + passage + edge[k] + noise(70)) for k in part] for part in (range(20), range(20, 40))]
    got, merged = removed(chunks, monkeypatch)
    assert got == brute(chunks) and not any(n for *_, n in got)
    assert merged == 0


@pytest.mark.parametrize("length", [44, 50, 51, 62, 90])
def test_passages_at_any_distance_from_their_seed_are_removed(length, monkeypatch):
    passages = [noise(length) for _ in range(30)]
    chunks = [[(100 * c + k, noise(RND.randrange(40)) + p + noise(RND.randrange(40))) for k, p in enumerate(passages)] for c in range(3)]
    got, _ = removed(chunks, monkeypatch)
    assert got == brute(chunks) and any(n for *_, n in got) == (length >= 50)


def test_repeated_seeds_have_no_place(monkeypatch):
    parts = [noise(period, "ab") for period in (1, 2, 3, 7, 25, 26, 30)]
    texts = [(noise(RND.randrange(30)) + p * (150 // len(p)))[: RND.randrange(60, 150)] + noise(RND.randrange(30)) for p in parts for _ in range(6)]
    RND.shuffle(texts)
    chunks = [[(k, x) for k, x in enumerate(texts) if k % 3 == c] for c in range(3)]
    got, _ = removed(chunks, monkeypatch)
    assert got == brute(chunks) and any(n for *_, n in got)


def test_random_texts_of_few_letters(monkeypatch):
    for _ in range(10):
        base = noise(400, "ab")
        texts = []
        for _ in range(24):
            a = RND.randrange(330)
            x = list(base[a : a + RND.randrange(45, 140)])
            if RND.random() < 0.5:
                x[RND.randrange(len(x))] = "c"
            texts.append("".join(x))
        chunks = [[(k % 9, x) for k, x in enumerate(texts) if k % 2 == c] for c in range(2)]
        assert removed(chunks, monkeypatch)[0] == brute(chunks)


def row_grams(x: bytes) -> list[int]:
    symbols = [256] * 5 + list(x) + [256]
    return [sum(v << (9 * (5 - j)) for j, v in enumerate(symbols[k : k + 6])) for k in range(len(x) + 1)]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz .", "".join(map(chr, range(1, 0x250)))])
@pytest.mark.parametrize("rows", [0, 1, 7, 2500])
def test_grams_of_rows_equal_brute_force(letters, rows):
    texts = [noise(RND.randrange(40), letters) for _ in range(rows)]
    if rows > 2:
        texts[1], texts[2] = "", None
    buf, off = C.text_buffer(pa.array(texts, pa.string()))
    if rows > 2:
        buf = buf.copy()
        buf[3:5] = 255  # not UTF-8, yet not the end mark
    gram, blocks = lm_scoring._grams(buf, off, 5)
    want = [Counter(row_grams(buf[a:b].tobytes())) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert gram.tolist() == sorted(set().union(*want))
    got = [Counter() for _ in want]
    for row, head, at in blocks:
        for r, k in zip(row.tolist(), np.repeat(at, np.diff(np.append(head, len(row)))).tolist(), strict=True):
            got[r][int(gram[k])] += 1
    assert got == want


def test_every_byte_value_leaves_room_for_the_mark():
    buf = np.repeat(np.arange(256, dtype=np.uint8), 9)
    RND.shuffle(buf)
    off = np.append(np.arange(0, len(buf), 1), len(buf))
    gram, blocks = lm_scoring._grams(buf, off, 5)
    assert len(blocks) > 1 and gram.tolist() == sorted({g for b in range(256) for g in row_grams(bytes([b]))})
    assert sum(len(row) for row, *_ in blocks) == 2 * len(buf)


def test_the_second_hash_is_taken_of_different_words_only(monkeypatch):
    hashed, inner = Counter(), C.slice_hashes

    def slices(buf, starts, ends, which=0):
        hashed[which] += len(starts)
        return inner(buf, starts, ends, which)

    monkeypatch.setattr(C, "slice_hashes", slices)
    table = pa.table({"doc_id": pa.array(range(50)), "text": pa.array(["one two Two three " * 20] * 50), "_train": pa.array([k % 5 > 0 for k in range(50)])})
    out = lm_scoring._ask(1)((pa.scalar(0),), table)
    assert hashed == {0: 4000, 1: 3}
    words = out.filter(pa.compute.equal(out["kind"], "word"))
    assert sorted((lm_scoring.unpacked(words["counts"][0]) & np.uint64(0xFFFFFFFF)).tolist()) == [800, 800, 1600]
