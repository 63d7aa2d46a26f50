"""Centroid clustering on bit planes: exact distances by popcounts.

A component x is the integer floor(1024 * x) in two's complement.  The same bit of a
vector's 64 components is one plane, packed into one 64-bit word, and weighs 2^p (the
sign plane -2^p).  So the dot product of two vectors is the sum over pairs of their
planes of ``weight * weight * popcount(plane & plane)``, and the squared distance follows
from three of them, all in integers.  A centroid is packed alike.

The packed table is written once.  Each round reads it, assigns every vector to the
nearest centroid (ties: the smaller number), adds up each task's vectors by cluster as
counts of set bits, and sums the tasks' rows in Spark; the driver holds the centroids only.
A centroid becomes the exact floor of its vectors' mean; an empty one stays.  All sums are
integers, so neither partitions nor retries change a result.

Inputs and results: vectors that are null, of another length than 64, or with null or
non-finite components are left out; rows that repeat an id are vectors of their own; a
null id is read as empty text where starts are chosen; of vectors with one id the one of
smaller components starts first; with fewer vectors than ``k`` each is a centroid; an
empty table gives an empty one.  A component whose square would not fit the sums (from
2^27 after scaling) raises an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ints, store, table

DIMS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Scaled components stay below 2^LIMIT, so 64 squared differences fit 63 bits.
LIMIT = 27


def weights(planes: int) -> np.ndarray:
    """Weight of each plane in two's complement, the sign last."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def to_planes(x: np.ndarray, planes: int) -> np.ndarray:
    """Integers (rows, 64) → packed planes (rows, planes) of uint64."""
    out = np.empty((len(x), planes), np.uint64)
    for p in range(planes):
        out[:, p] = np.packbits((x >> p & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of packed vectors with one packed vector, or row by row."""
    w = weights(x.shape[1])
    c = np.broadcast_to(c, x.shape)
    out = np.zeros(len(x), np.int64)
    for q in range(x.shape[1]):
        out += w[q] * (np.bitwise_count(x & c[:, q:q + 1]).astype(np.int64) @ w)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest packed centroid and the squared distance to it."""
    own = products(x, x)
    size = products(centroids, centroids)
    best, dist = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    for i, c in enumerate(centroids):
        d = own - 2 * products(x, c) + size[i]
        closer = d < dist
        best[closer], dist[closer] = i, d[closer]
    return best, dist


def _rows(column, planes: int) -> np.ndarray:
    bufs = column.buffers()
    at = np.frombuffer(bufs[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(bufs[2], np.uint8)[at[0]:at[-1]].view(np.uint64).reshape(-1, planes)


def _pack(planes: int):
    def run(batches):
        for b in batches:
            x = ints(b.column("q").flatten()).reshape(-1, DIMS)
            packed = to_planes(x, planes).view(np.uint8).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "planes"])
    return run


def _sums(planes: int, centroids: np.ndarray):
    """Per task and cluster: vectors, their summed distance and summed components."""
    def run(batches):
        k = len(centroids)
        n, dist, bits = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, planes, DIMS), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b.column("planes"), planes)
            own, d = nearest(x, centroids)
            n += np.bincount(own, minlength=k)
            np.add.at(dist, own, d)
            for c in np.unique(own):
                here = x[own == c].view(np.uint8).reshape(-1, planes, 8)
                for p in range(planes):
                    bits[c, p] += np.unpackbits(here[:, p], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total = np.einsum("p,kpj->kj", weights(planes), bits)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(dist[some]),
                 pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "distance", "sums"])
    return run


def _assigned(planes: int, centroids: np.ndarray, names: list[str], inertia: dict[int, int], text: list[str]):
    def run(batches):
        of_cluster = np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64)
        for b in batches:
            own, d = nearest(_rows(b.column("planes"), planes), centroids) if b.num_rows else \
                (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(own), pa.array(d), pa.array(of_cluster[own]),
                 pa.array(np.full(len(own), sum(inertia.values()), np.int64)),
                 pa.array(text, pa.string()).take(pa.array(own))], names=names)
    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every kept vector."""
    names = [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("id"), v.alias("v")) \
        .where((F.size("v") == DIMS) & ~F.exists("v", odd)) \
        .select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))
    far = kept.agg(F.max(F.array_max(F.transform("q", lambda x: F.greatest(x, -x - 1))))).first()[0]
    if far is None:
        return vectors.sparkSession.createDataFrame([], schema)
    if far >= 1 << LIMIT:
        raise ValueError(f"a scaled component reaches {far}; distances of 2^{LIMIT} and more would not fit a long")
    planes = int(far).bit_length() + 1
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    starts = kept.select(key.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    centroids = [[int(x) for x in r["q"]] for r in starts]
    packed = store(kept.mapInArrow(_pack(planes), f"id {kind}, planes binary"))

    def measured(centroids):
        """Sums of the clusters around ``centroids``: at most k rows for each component."""
        words = to_planes(np.array(centroids, np.int64), planes)
        parts = packed.select("planes").mapInArrow(_sums(planes, words), "cluster int, n long, distance long, sums array<long>")
        wide = parts.select("cluster", "n", "distance", F.posexplode("sums").alias("j", "s"))
        return wide.groupBy("cluster", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "distance", "s")]) \
            .collect()

    for _ in range(rounds):
        moved = [list(c) for c in centroids]
        for r in measured(centroids):
            moved[r["cluster"]][r["j"]] = int(r["s"]) // int(r["n"])
        if moved == centroids:   # all later rounds would give the same
            break
        centroids = moved
    inertia = {r["cluster"]: int(r["distance"]) for r in measured(centroids) if r["j"] == 0}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return packed.mapInArrow(_assigned(planes, to_planes(np.array(centroids, np.int64), planes), names, inertia, text), schema)


def op13_bitplanes(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q FROM v QUALIFY c < 8),
r(step, c, m) AS (
  SELECT 0, c, q FROM s
  UNION ALL
  SELECT r.step + 1, r.c, coalesce(n.m, r.m) FROM r LEFT JOIN (
    SELECT c, list(CASE WHEN x >= 0 THEN x // n ELSE -((n - 1 - x) // n) END::BIGINT ORDER BY j) AS m FROM (
      SELECT c, j, sum(x)::HUGEINT AS x, count(*) AS n FROM (
        SELECT a.c, unnest(a.q) AS x, unnest(range(64)) AS j FROM (
          SELECT v.i, any_value(v.q) AS q, arg_min(r.c, 8 * list_sum(list_transform(list_zip(v.q, r.m),
                 lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT + r.c) AS c
          FROM v, r GROUP BY v.i) a)
      GROUP BY c, j) GROUP BY c) n ON n.c = r.c
  WHERE r.step < 10),
d AS (
  SELECT v.i, v.vec_id, r.c, r.m, list_sum(list_transform(list_zip(v.q, r.m),
         lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
  FROM v, r WHERE r.step = 10 QUALIFY row_number() OVER (PARTITION BY v.i ORDER BY distance, r.c) = 1)
SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM d
"""
