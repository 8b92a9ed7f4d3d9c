"""Where images lie on a page, from the page's drawing operators: saved and restored affine frames as a segmented scan.

Rows are operators: the keys of a page, ``seq`` (its place in the page, a whole number), ``op`` (save, restore, transform
or one of ``PAINT``; others take no part) and ``args`` (six numbers of a transform).  A frame [a, b, c, d, e, f] takes
(x, y) to (a x + c y + e, b x + d y + f); an image fills the unit square of the frame in force.

A page is walked in segments of ``segment`` places, each a stream over sorted rows, so a page that holds a third of all
rows is many tasks.  What a segment does to any stack is three things: how many frames it takes from those before it,
what it then does to the frame in force, and which frames it leaves on top.  Pages of several segments are walked once
for these, one row a segment, which are scanned into the state each segment starts from.  All others are walked once.

A restore without a save gives the identity.  Transforms with other than six given numbers, and rows without ``op``, take
no part.  Rows without ``seq`` come first; of equal ``seq`` the smaller (op, args).  An empty table has no boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The operators that paint an image.
PAINT = ("paintImageXObject", "paintImageMaskXObject", "paintInlineImageXObject")
SEGMENT = 65_536
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_WALKED = "_seg long, _carry boolean, seq long, op string, args array<double>, state array<array<double>>"

Frame = tuple[float, float, float, float, float, float]


def within(inner: Frame, outer: Frame) -> Frame:
    """The frame of ``inner`` seen from outside ``outer``."""
    a, b, c, d, e, f = outer
    x = lambda p, q: p * a + q * c
    y = lambda p, q: p * b + q * d
    return x(*inner[0:2]), y(*inner[0:2]), x(*inner[2:4]), y(*inner[2:4]), x(*inner[4:6]) + e, y(*inner[4:6]) + f


class Frames:
    """The frame in force, those saved below it, and how many were asked for below the first."""

    def __init__(self, state: list | None = None) -> None:
        self.now, self.saved, self.taken = IDENTITY, [], 0
        if state is not None and len(state):
            *self.saved, self.now = [tuple(float(x) for x in m) for m in state]

    def take(self, op: str, args: list | None) -> None:
        if op == "save":
            self.saved.append(self.now)
        elif op == "restore":
            self.taken += not self.saved
            self.now = self.saved.pop() if self.saved else IDENTITY
        elif op == "transform":
            self.now = within(tuple(args), self.now)

    def follow(self, taken: int, left: list) -> None:
        """What a segment does that takes ``taken`` frames and leaves ``left``, the last of them in force."""
        for _ in range(min(taken, len(self.saved) + 1)):
            self.take("restore", None)
        *on_top, now = [within(tuple(m), self.now) for m in left]
        self.saved += on_top
        self.now = now

    def state(self) -> list[list[float]]:
        return [list(m) for m in (*self.saved, self.now)]


def _schema(rows: DataFrame, keys: list[str], rest: str) -> StructType:
    return StructType([StructField(k, rows.schema[k].dataType) for k in keys] + StructType.fromDDL(rest).fields)


def _groups(batches: Iterator, names: list[str]) -> Iterator[tuple[tuple, bool, tuple]]:
    """Rows of sorted batches with their key and whether it is another than the row before had."""
    before = None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in batch.schema.names]):
            key = row[: len(names)]
            yield key, key != before, row[len(names) :]
            before = key


def _written(rows: list[tuple], schema) -> Iterator:
    import pyarrow as pa

    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _streamed(made: Callable[[Iterator], Iterator[tuple]], schema: StructType, size: int = 4_096):
    """Turns a walk over record batches into batches of at most ``size`` of its rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        held = []
        for row in made(batches):
            held.append(row)
            if len(held) == size:
                yield from _written(held, arrow)
                held = []
        yield from _written(held, arrow)

    return run


def _walk(keys: list[str]):
    """The frame of every painted image, over rows sorted within page and segment."""

    def made(batches: Iterator) -> Iterator[tuple]:
        frames = Frames()
        for key, new, (carry, seq, op, args, state) in _groups(batches, [*keys, "_seg"]):
            if new:
                frames = Frames(state if carry else None)
            if carry:
                continue
            if op in PAINT:
                yield (*key[:-1], seq, list(frames.now))
            else:
                frames.take(op, args)

    return made


def _reduce(keys: list[str]):
    """Per segment how many frames it takes and which it leaves."""

    def made(batches: Iterator) -> Iterator[tuple]:
        frames, last = Frames(), None
        for key, new, (_, _, op, args, _) in _groups(batches, [*keys, "_seg"]):
            if new:
                if last is not None:
                    yield (*last, frames.taken, frames.state())
                frames, last = Frames(), key
            frames.take(op, args)
        if last is not None:
            yield (*last, frames.taken, frames.state())

    return made


def _scan(keys: list[str]):
    """The state every segment starts from, over segments sorted within their page."""

    def made(batches: Iterator) -> Iterator[tuple]:
        frames = Frames()
        for key, new, (seg, taken, left) in _groups(batches, keys):
            frames = Frames() if new else frames
            yield (*key, seg, True, None, None, None, frames.state())
            frames.follow(taken, left)

    return made


def image_frames(ops: DataFrame, keys: list[str], segment: int = SEGMENT) -> DataFrame:
    """The keys, ``seq`` and ``frame`` of every painted image."""
    whole = (F.size("args") == 6) & F.forall("args", lambda x: x.isNotNull())
    used = ops.where(F.col("op").isin("save", "restore", *PAINT) | ((F.col("op") == "transform") & F.coalesce(whole, F.lit(False))))
    seq = F.col("seq").cast("long")
    rows = used.select(*keys, F.coalesce(F.floor(seq / segment), F.lit(-(2**62))).cast("long").alias("_seg"), F.lit(False).alias("_carry"), seq.alias("seq"), "op", F.col("args").cast("array<double>").alias("args"))
    rows = rows.withColumn("state", F.lit(None).cast("array<array<double>>"))
    sort = [*keys, "_seg", F.desc("_carry"), F.asc_nulls_first("seq"), "op", "args"]
    dealt = lambda x: x.repartition(*keys, "_seg").sortWithinPartitions(*sort)

    several = rows.groupBy(*keys).agg((F.min("_seg") < F.max("_seg")).alias("_m")).where("_m").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    long = rows.join(several, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi")
    reduced, walked = (_schema(rows, keys, x) for x in ("_seg long, taken long, left array<array<double>>", _WALKED))
    effects = dealt(long).mapInArrow(_streamed(_reduce(keys), reduced), reduced)
    carries = effects.repartition(*keys).sortWithinPartitions(*keys, "_seg").mapInArrow(_streamed(_scan(keys), walked), walked)
    out = _schema(rows, keys, "seq long, frame array<double>")
    return dealt(rows.unionByName(carries)).mapInArrow(_streamed(_walk(keys), out), out)


def image_boxes(ops: DataFrame, keys: list[str], segment: int = SEGMENT) -> DataFrame:
    """The keys, ``seq``, and the box x0, y0, x1, y1 of every painted image, in the page's own units."""
    a, b, c, d, e, f = (F.col("frame")[i] for i in range(6))
    xs, ys = [e, a + e, c + e, a + c + e], [f, b + f, d + f, b + d + f]
    sides = {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
    return image_frames(ops, keys, segment).select(*keys, "seq", *[v.alias(k) for k, v in sides.items()])
