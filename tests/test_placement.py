"""Image placement against a plain walk over each page."""

import random

from corroborate.operators import placement as P

OP = "report_id int, page int, seq int, op string, args array<double>"


def walked(rows):
    """(report, page, seq, box) of every image, page by page."""
    pages = {}
    for r in rows:
        pages.setdefault(r[:2], []).append(r)
    out = []
    for page, ops in pages.items():
        ops.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or []))
        now, stack = [1, 0, 0, 1, 0, 0], []
        for _, _, seq, op, args in ops:
            if op == "save":
                stack.append(now)
            elif op == "restore":
                now = stack.pop() if stack else [1, 0, 0, 1, 0, 0]
            elif op == "transform" and args and len(args) == 6 and None not in args:
                p, q = args, now
                cell = lambda i, j: p[2 * i] * q[j] + p[2 * i + 1] * q[2 + j]
                now = [cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1), cell(2, 0) + q[4], cell(2, 1) + q[5]]
            elif op in P.PAINT:
                at = [(now[0] * x + now[2] * y + now[4], now[1] * x + now[3] * y + now[5]) for x in (0, 1) for y in (0, 1)]
                xs, ys = zip(*at)
                out.append((*page, seq, min(xs), min(ys), max(xs), max(ys)))
    return sorted(out, key=str)


def found(spark, rows, segment):
    got = P.image_boxes(spark.createDataFrame(rows, OP), ["report_id", "page"], segment)
    assert got.columns == ["report_id", "page", "seq", "x0", "y0", "x1", "y1"]
    return sorted([(a, b, c, *map(float, box)) for a, b, c, *box in got.collect()], key=str)


def plain(rows):
    return sorted([(*r[:3], *map(float, r[3:])) for r in rows], key=str)


def test_segments_change_nothing(spark):
    rng = random.Random(3)
    kinds = ["save", "save", "restore", "restore", "transform", "transform", "text", None, *P.PAINT]
    number = lambda: rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0])
    rows = []
    # one page holds most rows; keys are null too
    for page, size in [((1, 1), 400), ((1, 2), 30), ((2, 1), 1), ((None, 1), 40), ((2, None), 40)]:
        for seq in range(size):
            op = rng.choice(kinds)
            # moves and turns that keep numbers small, so that every order of multiplying is exact
            turn = rng.choice([[1.0, 0.0, 0.0, 1.0], [0.0, 1.0, -1.0, 0.0], [-1.0, 0.0, 0.0, 1.0]])
            rows.append((*page, seq, op, [*turn, number(), number()] if op == "transform" else None))
    for segment in (1, 3, 16, 10**6):
        assert found(spark, rows, segment) == plain(walked(rows)), segment


def test_what_is_not_an_operator_takes_no_part(spark):
    paint = P.PAINT[0]
    rows = [(1, 1, 0, "restore", None), (1, 1, 1, "transform", [2.0, 0.0, 0.0, 3.0, 1.0, 1.0]), (1, 1, 2, "transform", [2.0]), (1, 1, 3, "transform", [None] * 6), (1, 1, 4, "transform", None), (1, 1, 5, paint, [1.0]), (1, 1, 5, paint, None),
            (1, 1, 6, "restore", None), (1, 1, 7, "restore", None), (1, 1, 8, paint, None), (1, 1, None, "transform", [1.0, 0.0, 0.0, 1.0, 9.0, 9.0]), (2, 1, None, paint, None)]
    # the row without a place comes first, and the restore after it goes back to the identity
    want = [(1, 1, 5, 1.0, 1.0, 3.0, 4.0)] * 2 + [(1, 1, 8, 0.0, 0.0, 1.0, 1.0), (2, 1, None, 0.0, 0.0, 1.0, 1.0)]
    for segment in (1, 2, 100):
        assert found(spark, rows, segment) == plain(want) == plain(walked(rows))
    assert found(spark, [], 4) == []


def test_frames_deeper_than_a_segment(spark):
    move = [1.0, 0.0, 0.0, 1.0, 1.0, 0.0]
    rows = [(1, 1, 2 * k + j, op, args) for k in range(50) for j, (op, args) in enumerate([("save", None), ("transform", move)])]
    rows += [(1, 1, 100 + 2 * k + j, op, None) for k in range(52) for j, op in enumerate([P.PAINT[1], "restore"])]
    got = found(spark, rows, 7)
    assert got == plain(walked(rows)) and {r[3] for r in got} == {float(k) for k in range(51)}
