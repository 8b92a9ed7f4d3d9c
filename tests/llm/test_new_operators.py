"""Ball k-means, byte-level BPE and the filter audit against brute force, with nulls, ties and repeats."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import ball_kmeans, byte_bpe, filter_audit


def plain_kmeans(points, start, rounds):
    """points: (id, components); the contract's rounds one vector at a time."""
    centroids = [list(c) for c in start]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(p)[1] for _, p in points]
        for j in range(len(centroids)):
            members = [p for (_, p), o in zip(points, own) if o == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    found = [near(p) for _, p in points]
    held = lambda x: min(2**63 - 1, x)
    per = {}
    for d, j in found:
        per[j] = per.get(j, 0) + held(d)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0), j, held(d), held(per[j]), held(sum(per.values())), sha[j]) for (i, _), (d, j) in zip(points, found))


def shown(df):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("scale", [1.0, 40.0, 1e5, 1e12])
def test_ball_kmeans_equals_plain(spark, scale):
    rng = np.random.default_rng(int(scale) % 97)
    rows = [(k, [float(round(x, 2)) * scale for x in rng.normal(size=4)]) for k in range(300)]
    rows += [(500 + k, rows[3][1]) for k in range(120)] + [(7, rows[7][1]), (None, rows[9][1]), (600, [0.0, -0.0, 0.0, 0.0])]
    unusable = [(700, None), (701, []), (702, [1.0]), (703, [1.0, None, 1.0, 1.0]), (704, [math.nan, 0.0, 0.0, 0.0]), (705, [math.inf, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + unusable], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    v = ball_kmeans.quantised(frame, dim=4)
    start = ball_kmeans.first_centroids(v, k=9)
    points = [(i, [math.floor(64 * x) for x in e]) for i, e in rows]
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), p) for i, p in points if i is not None)
    assert start == [p for _, p in hashed[:9]]
    assert shown(ball_kmeans.ball_kmeans(v, start, rounds=3)) == plain_kmeans(points, start, 3)


def test_ball_kmeans_of_extreme_components_and_few_vectors(spark):
    rows = [(1, [1e300, -1e300]), (2, [-1e300, 3.0]), (3, [0.5, 0.5]), (4, [0.25, -0.25])]
    v = ball_kmeans.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=2)
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    points = [(i, [held(math.floor(64 * int(x))) if abs(x) > 1e9 else math.floor(64 * x) for x in e]) for i, e in rows]
    start = ball_kmeans.first_centroids(v)
    assert len(start) == 4
    assert shown(ball_kmeans.ball_kmeans(v, start)) == plain_kmeans(points, start, 3)
    none = v.where("false")
    assert ball_kmeans.first_centroids(none) == [] and ball_kmeans.ball_kmeans(none, []).count() == 0


def test_balls_compare_less_and_find_the_same():
    rng = np.random.default_rng(3)
    heart = rng.integers(-300, 300, size=(12, 8))
    points = (heart[rng.integers(0, 12, 4000)] + rng.integers(-9, 9, size=(4000, 8))).astype(float)
    labels, _ = ball_kmeans.nearest(points, heart.astype(float))
    moved = (heart + rng.integers(-3, 3, size=heart.shape)).astype(float)
    moved[5] = moved[4]  # equal centroids: the smaller number
    got, distance, asked = ball_kmeans.reassign(points, labels, moved)
    want, best = ball_kmeans.nearest(points, moved)
    assert (got == want).all() and (distance == best).all()
    assert asked < 0.3 * points.shape[0] * len(moved)
    tie = np.array([[5.0, 0.0]])  # midway: compared although the radius only reaches half the distance
    assert ball_kmeans.reassign(tie, np.array([1]), np.array([[0.0, 0.0], [10.0, 0.0]]))[0].tolist() == [0]


@pytest.fixture(scope="module")
def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.coder(path, P.PATTERN)


def ids_of(coder, text):
    return np.frombuffer(b"".join(coder.encode(text)), "<u4").tolist()


RND = random.Random(11)
ALPHABETS = ["ab", "the ", "aé日本語 \n", "0123 .,'st", "!?-—…\t ", "  \x1c\x85 x", "日本語中文", "😀👍🏽a"]
TEXTS = ["", " ", "\n\n  x", "it's we'll I'D 's", "a" * 5000, "<|endoftext|>", "é" * 700, "1" * 900, "퟿\U0010ffff", "日" * 3000, "  " * 200]
TEXTS += ["".join(RND.choice(a) for _ in range(n)) for a in ALPHABETS for n in (1, 2, 3, 7, 30, 400)]


def test_byte_bpe_equals_library(library):
    tok, coder = library
    for text in TEXTS:
        assert ids_of(coder, text) == tok.encode_ordinary(text)
    for k in range(400):
        text = "".join(chr(RND.choice([RND.randrange(32, 127), RND.randrange(160, 0x800), RND.randrange(0x3000, 0x9FFF)])) for _ in range(RND.randrange(1, 25)))
        assert ids_of(coder, text) == tok.encode_ordinary(text)


def test_byte_bpe_backtracks_over_any_bytes(library):
    tok, coder = library
    tokens = list(coder.token.values())
    for k in range(2000):  # bytes of joined tokens, not text: dead ends are common
        piece = b"".join(RND.choice(tokens) for _ in range(RND.randrange(1, 6)))[: RND.randrange(1, 60)]
        assert coder.encode_piece(piece) == tok._core_bpe.encode_single_piece(piece)
    assert coder.encode_piece(b"") == []


def test_byte_bpe_stretches_cut_no_match(library, monkeypatch):
    tok, coder = library
    monkeypatch.setattr(byte_bpe, "STRETCH", 5)
    for text in TEXTS:
        assert ids_of(coder, text) == tok.encode_ordinary(text)


def test_byte_bpe_of_vocabularies():
    base = {bytes([b]): b for b in range(256)}
    coder = byte_bpe.ByteBpe(base | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcxyz": 260}, r"\s+|\S+")
    assert coder.encode_piece(b"abcd") == [258, 100] and coder.encode_piece(b"abc") == [258] and coder.encode_piece(b"bcd") == [257, 100]
    assert coder.encode_piece(b"abcxyz") == [260] and coder.encode_piece(b"abcxyzz")[0] == 258  # no merge makes it: only a whole match is
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe(base | {b"abc": 256, b"ab": 257}, r"\S+")
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 0}, r"\S+")


def test_byte_bpe_rows(spark, library):
    tok, _ = library
    rows = [(k, t, "c", 1) for k, t in enumerate(TEXTS)] + [(900, None, "c", 1), (900, None, "c", 1), (None, "x y", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, Token_IDs string, n int").repartition(3)
    got = byte_bpe.byte_bpe_encode(frame)
    assert sorted(got.columns) == sorted(["doc_id", "text", "n", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded"])
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        ids = tok.encode_ordinary(text)
        assert r["token_ids"] == ids and bytes(r["decoded"]).decode() == text and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.byte_bpe_encode(frame.where("false")).count() == 0


def audited(rows, labels):
    """Every order over every document in turn."""
    import re

    marks = {}
    for i, q, t in labels:
        have = marks.setdefault(i, [False, False])
        have[0] |= q == 1
        have[1] |= t == 1
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        docs.append((source or "", fails, marks.get(i, [False, False]) if i is not None else [False, False]))
    out = []
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for k, f in enumerate(order):
                hit = [d for d in left if d[1][f]]
                shapley[f] += len(hit)
                steps.append((part, "".join(order), k + 1, len(left) - len(hit), len(hit), sum(d[1][f] for d in gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own),
                              sum(d[2][0] for d in hit), sum(d[2][1] for d in hit)))
                left, gone = [d for d in left if not d[1][f]], gone + hit
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_filter_audit_equals_every_order(spark):
    word = lambda n, m: " ".join(f"w{RND.randrange(m)}" for _ in range(n))
    kinds = [None, "", " \t", word(60, 900), word(60, 9), word(49, 900), word(50, 900) + " #", "ABC " * 60, "É" * 300 + " A b", word(70, 900) + " |", word(3000, 500)]
    rows = [(k, kinds[k * 7 % len(kinds)], RND.choice(["a", "b", "", None])) for k in range(80)] + [(5, kinds[3], "a"), (5, kinds[3], "a"), (None, kinds[3], "a"), (None, "x", None), (-4, "x", "only")]
    labels = [(k, RND.choice([0, 1, None]), RND.choice([0, 1, None])) for k in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, source string, fails int, part string").repartition(4)
    got = filter_audit.filter_audit(docs, spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert filter_audit.filter_audit(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_filter_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "a", "s")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels, part_col="lang", filters={"L": lambda text, words: F.length(text) > 1}, repeats="R").orderBy("filter_order", "step").collect()
    assert [(r["filter_order"], r["step"], r["kept"], r["removed"], r["shapley"]) for r in got] == [("LR", 1, 2, 1, 2), ("LR", 2, 1, 1, 2), ("RL", 1, 2, 1, 2), ("RL", 2, 1, 1, 2)]
