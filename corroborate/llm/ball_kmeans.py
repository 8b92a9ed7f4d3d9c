"""Ball k-means: exact k-means in which a cluster is a ball and only close centroids are compared.

Vectors are packed in blocks that carry each member's cluster from round to round.  In a block every cluster is a ball
about its centroid whose radius is its farthest member's distance.  A centroid is a neighbour if half its distance from
the ball's centre lies within the radius; no other can be nearest to a member.  The neighbours' half distances cut the
ball into a stable core, whose members stay without a comparison, and annuli: a member of the n-th annulus is compared
with the first n neighbours only.  Only the first round compares with all centroids.

A round is one job without a shuffle of vectors: blocks go in and out, and each task adds one row of sums per cluster.
Those sums are added up by Spark; what reaches the driver is one row per cluster and component, whatever the input's size.
Rounds are tables in the shared folder, so a lost executor repeats its tasks only; a table goes when the next one stands.

Everything is in whole numbers: components are floor(scale * x) with x in double precision, held to the range of a long;
distances are squared.  They are computed in doubles where these are exact, else in Python's integers.  Comparisons count
equality, so that a tie is always compared and goes to the smaller cluster.

Defined results: vectors that are null, of another length than ``dim``, or hold a null or non-finite component take no
part; rows with a null id are assigned but never start a cluster; repeated rows are separate vectors (and may start
several clusters; equal ids are ordered by their components); with fewer than k vectors there are fewer clusters;
distances and sums beyond a long read its limit; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
EXACT, LONG = 2.0**53, (1 << 63) - 1
_BLOCK = "ids binary, points binary, width int, labels binary, distances binary"
_TABLE = f"{_BLOCK}, cluster int, n long, distance decimal(38,0), sums array<decimal(38,0)>"


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x) of each usable vector."""
    x = F.col("embedding").cast("array<double>")
    usable = (F.size(x) == dim) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors of the k smallest hashes of seed and id."""
    own = vectors.where(F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    return [list(r["v"]) for r in own.orderBy("h", "v").limit(k).select("v").collect()]


def _blocks(dim: int):
    """Vectors to blocks, in the smallest whole numbers that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, given = C.long_column(pa.table({"vec_id": batch.column("vec_id")}), "vec_id")
            points = np.asarray(batch.column("v").flatten()).astype(np.int64).reshape(-1, dim)
            low, high = int(points.min()), int(points.max())
            width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
            packed = ids.tobytes() + np.packbits(given).tobytes()
            yield pa.RecordBatch.from_pydict({"ids": pa.array([packed], pa.binary()), "points": pa.array([points.astype(f"<i{width}").tobytes()], pa.binary()), "width": pa.array([width], pa.int32()),
                                              "labels": pa.array([None], pa.binary()), "distances": pa.array([None], pa.binary())})

    return run


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each point and centroid; both as doubles or both as Python's integers."""
    if points.dtype == object:
        return np.array([[((p - c) ** 2).sum() for c in centroids] for p in points], object).reshape(len(points), len(centroids))
    return (points * points).sum(1)[:, None] - 2 * (points @ centroids.T) + (centroids * centroids).sum(1)[None, :]


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller of equals, and its squared distance, by comparing all."""
    found = _squared(points, centroids)
    best = np.argmin(found, axis=1) if len(points) else np.zeros(0, np.int64)
    return best.astype(np.int64), found[np.arange(len(points)), best]


def reassign(points: np.ndarray, labels: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``nearest`` from the clusters of the round before: cores stay, annuli meet their neighbours; also the distances computed."""
    move = points - centroids[labels]
    own = (move * move).sum(axis=1)
    out, distance, asked = labels.copy(), own.copy(), len(points)
    gaps = _squared(centroids, centroids)
    for cluster in np.unique(labels):
        members = np.flatnonzero(labels == cluster)
        radius = own[members].max()
        near = [j for j in range(len(centroids)) if j != cluster and gaps[cluster, j] <= 4 * radius]
        near.sort(key=lambda j: (gaps[cluster, j], j))
        if not near:
            continue
        edge = np.array([gaps[cluster, j] for j in near])
        annulus = np.searchsorted(edge, 4 * own[members], side="right")  # half a distance of at most the member's: compared
        for n in range(1, len(near) + 1):
            inside = members[annulus == n]
            if not len(inside):
                continue
            rivals = np.array(sorted([cluster, *near[:n]]))
            best, found = nearest(points[inside], centroids[rivals])
            out[inside], distance[inside] = rivals[best], found
            asked += len(inside) * n
    return out, distance, asked


def _round(centroids: list[list[int]]):
    """Assign every block's vectors; a task ends with one row of sums per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = len(centroids), len(centroids[0])
        whole = np.array(centroids, object).reshape(k, dim)
        largest = max(abs(x) for c in centroids for x in c)
        count, distance, sums = [0] * k, [0] * k, np.zeros((k, dim), object)
        for batch in batches:
            for row in batch.to_pylist():
                points = np.frombuffer(row["points"], f"<i{row['width']}").astype(np.int64).reshape(-1, dim)
                top = max(abs(int(points.min())), abs(int(points.max())))
                if dim * (top + largest) ** 2 < EXACT:
                    p, c = points.astype(float), whole.astype(float)
                else:
                    p, c = points.astype(object), whole
                if row["labels"] is None:
                    label, found = nearest(p, c)
                else:
                    label, found, _ = reassign(p, np.frombuffer(row["labels"], "<i4").astype(np.int64), c)
                held = np.array([min(LONG, int(x)) for x in found], np.int64)
                for j in np.unique(label):
                    own = label == j
                    count[j] += int(own.sum())
                    distance[j] += sum(held[own].tolist()) if p.dtype == object else int(held[own].sum())
                    sums[j] += points[own].astype(object).sum(axis=0) if p.dtype == object else points[own].sum(axis=0).astype(object)
                yield _rows([row | {"labels": label.astype("<i4").tobytes(), "distances": held.astype("<i8").tobytes()}])
        used = [j for j in range(k) if count[j]]
        if used:
            yield _rows([{"cluster": j, "n": count[j], "distance": decimal.Decimal(distance[j]), "sums": [decimal.Decimal(int(x)) for x in sums[j]]} for j in used])

    return run


_KINDS = {
    "ids": pa.binary(), "points": pa.binary(), "width": pa.int32(), "labels": pa.binary(), "distances": pa.binary(),
    "cluster": pa.int32(), "n": pa.int64(), "distance": pa.decimal128(38, 0), "sums": pa.list_(pa.decimal128(38, 0)),
}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], t) for n, t in _KINDS.items()})


def _totals(table: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that has members: their number, summed distance and componentwise sums."""
    parts = table.where(F.col("cluster").isNotNull())
    size = {r["cluster"]: (r["n"], int(r["d"])) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("d")).collect()}
    sums: dict[int, dict[int, int]] = {}
    each = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    for r in each.collect():
        sums.setdefault(r["cluster"], {})[r["at"]] = int(r["x"])
    return {c: (*size[c], [x for _, x in sorted(sums[c].items())]) for c in size}


def _members(final: dict[int, tuple[int, str]], total: int):
    """Blocks back to one row per vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                label, distance = np.frombuffer(row["labels"], "<i4"), np.frombuffer(row["distances"], "<i8")
                n = len(label)
                ids, given = np.frombuffer(row["ids"], np.int64, n), np.unpackbits(np.frombuffer(row["ids"], np.uint8, offset=8 * n), count=n).astype(bool)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(ids, mask=~given), "cluster": pa.array(label, pa.int32()), "distance": pa.array(distance),
                    "cluster_inertia": pa.array([final[c][0] for c in label.tolist()], pa.int64()), "inertia": pa.array(np.full(n, total)),
                    "centroid_sha256": pa.array([final[c][1] for c in label.tolist()], pa.string()),
                })

    return run


def ball_kmeans(vectors: DataFrame, start: list[list[int]], rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of ``vectors`` (vec_id and v) after ``rounds`` of moving the centroids."""
    spark = vectors.sparkSession
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], out)
    centroids, before = [[int(x) for x in c] for c in start], None
    blocks = vectors.mapInArrow(_blocks(len(centroids[0])), _BLOCK)
    for turn in range(rounds + 1):
        path = C.scratch(spark, f"ball-kmeans-{turn}")
        blocks.mapInArrow(_round(centroids), _TABLE).write.parquet(path)
        if before:
            C.discard(spark, before)
        table, before = spark.read.parquet(path), path
        blocks, totals = table.where(F.col("ids").isNotNull()).select("ids", "points", "width", "labels", "distances"), _totals(table)
        if turn < rounds:
            for c, (n, _, sums) in totals.items():
                centroids[c] = [x // n for x in sums]
    held = {c: min(LONG, d) for c, (_, d, _) in totals.items()}
    final = {c: (held[c], hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in held}
    return blocks.mapInArrow(_members(final, min(LONG, sum(d for _, d, _ in totals.values()))), out)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return ball_kmeans(vectors, first_centroids(vectors))


def _sql(rounds: int = ROUNDS) -> str:
    """Rounds one by one: distances to all centroids, the nearest, sums per component."""
    near = lambda c: f"""
  SELECT rid, vec_id, e, cluster, distance FROM (
    SELECT v.rid, v.vec_id, v.e, c.cluster, d.distance, row_number() OVER (PARTITION BY v.rid ORDER BY d.distance, c.cluster) AS r
    FROM v, {c} c, LATERAL (SELECT list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT AS distance) d
  ) WHERE r = 1"""  # noqa: E731
    steps = [f"""v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT (row_number() OVER (ORDER BY h, e) - 1)::INTEGER AS cluster, e FROM (SELECT sha256('{SEED}:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {K})
)"""]
    for r in range(rounds):
        steps.append(f"a{r} AS ({near(f'c{r}')})")
        steps.append(f"""m{r} AS (
  SELECT cluster, list(floor_sum ORDER BY i) AS e FROM (
    SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_sum
    FROM (SELECT cluster, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY cluster, i)
  ) GROUP BY cluster
), c{r + 1} AS (SELECT cluster, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    steps.append(f"z AS ({near(f'c{rounds}')})")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, z.cluster, distance, (sum(distance) OVER (PARTITION BY z.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM z JOIN c{rounds} ON z.cluster = c{rounds}.cluster"""


SQL = _sql()
