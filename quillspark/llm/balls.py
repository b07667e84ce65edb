"""Centroid clustering by ball k-means, exact on integer vectors.

A cluster is a ball: its centroid and a radius within which all its members lie.
After an assignment the radius about the old centroid is known; about the new one
it is at most that plus the way the centroid has moved.  Another centroid can take
a member only if it lies within twice the radius: these are the ball's
*neighbours*, in order of distance.  A member's own distance ``d`` to its centroid
says how many of them matter: one at ``g`` from the centroid is farther from the
member than its own whenever ``g > 2 d``.  Members for which that holds for the
nearest neighbour are the ball's *stable core* and are compared with nothing; the
others lie in *annuli*, the n-th of which is compared with the n nearest
neighbours exactly.  All tests are on squared integers, so ties are seen and go
to the smaller number.

Vectors are packed into blocks once; a round is one pass over the blocks, whose
tasks send on a sum for each cluster that they hold.  What reaches the driver is
the ``k`` centroids and figures of as many balls, whatever the number of vectors,
and no vector is dealt out by its cluster, so a cluster of any size or very many
equal vectors are no single task.

Defined cases: a null vector, one of another length, with a null or non-finite
component, or with a component that is ``2 ** 27`` or more when scaled (squared
distances would not fit 64 bits) takes no part; rows are clustered one by one, so
repeated rows count as often as they occur; a null id takes part and is seeded by
the hash of an empty number; equal hashes go by components; fewer vectors than
``k`` make as many clusters; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discarded, settings, table, trim_memory, written
from quillspark.llm.packed import FEW_BLOCKS

K, DIM, ROUNDS, SCALE, SEED, MOST = 40, 64, 5, 256, 2, 1 << 27
#: Vectors of a block.
BLOCK = 4096
FIGURES = "c int, n long, far long, total long, compared long, s array<long>"
ASSIGNED = f"ids array<long>, ints binary, cluster binary, distance binary, figures array<struct<{', '.join(x.replace(' ', ':', 1) for x in FIGURES.split(', '))}>>"
FIGURES_ARROW = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("far", pa.int64()), ("total", pa.int64()), ("compared", pa.int64()), ("s", pa.list_(pa.int64()))]))
ASSIGNED_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("ints", pa.binary()), ("cluster", pa.binary()), ("distance", pa.binary()), ("figures", FIGURES_ARROW)])


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``(vec_id, ints array<long>)`` of the rows that take part: ``floor(scale * x)`` of each component."""
    sound = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < MOST))  # false for NaN and infinities
    kept = vectors.filter(F.coalesce(sound & ~F.exists("embedding", lambda x: F.isnan(x.cast("double"))), F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("ints"))


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "ints").orderBy("key", "ints").limit(k).collect()
    return np.array([r.ints for r in found], np.int64)


def blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Rows in blocks, all in cluster 0."""

    def deal(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = part["ints"].flatten().to_numpy().astype("<i4")
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["vec_id"]), "ints": [x.tobytes()],
                    "cluster": [bytes(4 * part.num_rows)], "distance": [b""], "figures": [[]],
                }, schema=ASSIGNED_ARROW)

    return written(rows.mapInArrow(deal, ASSIGNED), "vectors")


class Balls:
    """Centroids, and of each the neighbours that its members can go to; ``radius`` None is without bound."""

    def __init__(self, centroids: np.ndarray, radius: list[int | None]):
        self.centroids, self.k = centroids, len(centroids)
        self.near, self.gap = [], []
        for i, r in enumerate(radius):
            gap = self.squared(centroids, centroids[i])
            order = np.lexsort((np.arange(self.k), gap))
            order = order[order != i]
            if r is not None:
                order = order[gap[order] <= 4 * r * r]
            self.near.append(order)
            self.gap.append(gap[order])

    @staticmethod
    def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = x - c
        if len(d) and np.abs(d).max() < 1 << 22:  # sums of 64 squares are exact in doubles, which are faster
            d = d.astype(np.float64)
        return np.einsum("ij,ij->i", d, d).astype(np.int64)

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New clusters of members ``x`` of ``own`` ones, squared distances, and how many centroids each was compared with."""
        new, best, compared = own.copy(), np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
        for i in np.unique(own):
            at = np.flatnonzero(own == i)
            best[at] = self.squared(x[at], self.centroids[i])
            annulus = np.searchsorted(self.gap[i], 4 * best[at], "right")  # 0: the stable core
            compared[at] += annulus
            for n, j in enumerate(self.near[i][: annulus.max()]):
                some = at[annulus > n]
                d = self.squared(x[some], self.centroids[j])
                won = (d < best[some]) | ((d == best[some]) & (j < new[some]))
                new[some[won]], best[some[won]] = j, d[won]
        return new, best, compared


def assigned(held: DataFrame, balls: Balls, dim: int) -> DataFrame:
    """One pass: every block's new clusters and distances, with its figures of each cluster."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw = b["ints"][i].as_py()
                x = np.frombuffer(raw, "<i4").reshape(-1, dim).astype(np.int64)
                own, dist, compared = balls.assign(x, np.frombuffer(b["cluster"][i].as_py(), "<i4"))
                figures = []
                for c in np.unique(own):
                    m = own == c
                    figures.append({"c": int(c), "n": int(m.sum()), "far": int(dist[m].max()), "total": int(dist[m].sum()), "compared": int(compared[m].sum()), "s": x[m].sum(0).tolist()})
                yield pa.RecordBatch.from_pydict({"ids": b["ids"].slice(i, 1), "ints": [raw], "cluster": [own.astype("<i4").tobytes()], "distance": [dist.astype("<i8").tobytes()], "figures": [figures]}, schema=ASSIGNED_ARROW)
        trim_memory()

    with settings(held.sparkSession, FEW_BLOCKS):
        return written(held.mapInArrow(run, ASSIGNED), "assigned")


def figures(held: DataFrame, dim: int) -> dict[int, dict]:
    """Of every cluster with members: how many, squared radius, summed distance, comparisons, and component sums."""
    one = held.select(F.explode("figures").alias("f")).select("f.*")
    told = one.groupBy("c").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("total").alias("total"), F.sum("compared").alias("compared")).collect()
    sums = one.select("c", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).collect()
    out = {r.c: r.asDict() | {"s": [0] * dim} for r in told}
    for r in sums:
        out[r.c]["s"][r.i] = r.x
    return out


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[dict[int, dict]]]:
    """Blocks with final clusters, the final centroids, and each pass's figures."""
    rows = integers(vectors, dim, scale)
    centroids = seeds(rows, k, seed)
    held = blocks(rows, dim)
    passes: list[dict[int, dict]] = []
    if not len(centroids):
        return held, centroids, passes
    radius: list[int | None] = [None] * len(centroids)
    for n in range(rounds + 1):
        new = assigned(held, Balls(centroids, radius), dim)
        discarded(held)
        held, found = new, figures(new, dim)
        passes.append(found)
        if n < rounds:
            moved = np.array([[x // found[c]["n"] for x in found[c]["s"]] if c in found else centroids[c] for c in range(len(centroids))], np.int64)
            way = [isqrt(int(((a - b) ** 2).sum())) + 1 for a, b in zip(moved, centroids)]
            radius = [isqrt(found[c]["far"]) + 1 + way[c] if c in found else 0 for c in range(len(centroids))]
            centroids = moved
    return held, centroids, passes


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    held, centroids, passes = ball_kmeans(vectors, k, rounds, dim, scale, seed)
    total = {c: f["total"] for c, f in passes[-1].items()} if passes else {}
    of_cluster = np.array([total.get(c, 0) for c in range(len(centroids))], np.int64)
    whole = sum(total.values())
    signs = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                c = np.frombuffer(b["cluster"][i].as_py(), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [b["ids"][i].values, pa.array(c, pa.int32()), pa.array(np.frombuffer(b["distance"][i].as_py(), "<i8"), pa.int64()), pa.array(of_cluster[c], pa.int64()), pa.array(np.full(len(c), whole), pa.int64()), pa.array(signs[c].tolist(), pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return held.mapInArrow(rows, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op12_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))
