"""Approximate nearest neighbours by inner product: multi-index hashing.

Codes: vectors are made comparable by angle (scaled by the largest norm, with
one more component filling each up to it), centred, and turned by several
rotations learned by iterative quantization on a bounded sample; the signs are
``bits`` bits, cut into substrings of 16.

Radius: a query takes that within which a share of the sample's codes lie.  The
share is learned too: the least that finds ``recall`` of the neighbours of up to
256 sample vectors within the sample, where a neighbour's rank is scaled to the
sample's part of the table.  The radius holds ``k`` rows of the sample at least,
so it never ends with fewer than there are.  One rule for tables of all sizes.

Search: by the pigeonhole principle a code within radius ``r = s * m + a`` of
``s`` substrings differs by at most ``m`` bits in one of the first ``a + 1``
substrings or by at most ``m - 1`` in one of the others, so the buckets of those
values hold every code within the radius.  Rows are always found by probing
buckets; there are two plans for where they lie, with the same candidates.  Where
probing is estimated to touch under an eighth of the table, every code is entered
into the buckets of its substrings and a join on (substring, value) meets the
queries' probes.  Else - the radii of vectors without structure, around two fifths
of all bits, reach into every part of the table - rows are dealt into groups of
bounded size, a task enters its group's codes into buckets of its own, and the
queries stream past.  Either way only the codes within the radius have their inner
products taken, on the original vectors in double precision.  ``exact=True`` takes
the largest radius there is.

Defined cases: vectors that are null, empty, zero, of another than the
commonest length, or with null or non-finite components take no part, nor do
rows without an id; repeated rows are candidates each, but never of their own
id; with fewer candidates than ``k`` all are given; ties go to the smaller id;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import settings, table, written

WIDTH = 16  # bits of a substring
BLOCK_ARROW = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("radii", pa.binary())])
BLOCK = "ids binary, vectors binary, codes binary, radii binary"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of packed codes, a row of ``a`` by a row of ``b``."""
    x, y = np.ascontiguousarray(a).view("<u8"), np.ascontiguousarray(b).view("<u8")
    d = np.zeros((len(a), len(b)), np.uint16)
    for j in range(x.shape[1]):
        d += np.bitwise_count(x[:, j : j + 1] ^ y[None, :, j])
    return d


@dataclass
class Coder:
    """Learned rotations, the sample's codes, and the share of them that a radius takes in."""

    top_norm: float
    mean: np.ndarray
    turns: np.ndarray
    sample: np.ndarray
    share: float = 1.0

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Packed bits, a row a vector."""
        return np.packbits((self.lifted(x) - self.mean) @ self.turns > 0, axis=1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        y = x / self.top_norm
        return np.hstack([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(1, keepdims=True)))])

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Codes of queries: only their direction counts, and nothing is to be filled up."""
        y = np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])
        return np.packbits((y - self.mean) @ self.turns > 0, axis=1)

    def radii(self, asked: np.ndarray, k: int) -> np.ndarray:
        """Per query the distance within which the share of the sample's codes lie, ``k`` and itself at least."""
        n = len(self.sample)
        if self.share >= 1 or n <= k + 1:
            return np.full(len(asked), 8 * asked.shape[1])
        i = min(n - 1, max(k, int(np.ceil(self.share * n)) - 1))
        return np.partition(distances(asked, self.sample), i, axis=1)[:, i].astype(np.int64)


def learn(sample: np.ndarray, top_norm: float, rows: int, k: int, bits: int = 256, recall: float = 0.97, rounds: int = 12, seed: int = 5) -> Coder:
    """Rotations by iterative quantization from random starts, as many as give ``bits`` bits, and the share for ``recall`` of ``k`` neighbours among ``rows``."""
    rng = np.random.default_rng(seed)
    c = Coder(top_norm, np.zeros(sample.shape[1] + 1), np.zeros((0, 0)), np.zeros((0, 0), np.uint8))
    y = c.lifted(sample)
    c.mean = y.mean(0)
    y = y - c.mean
    d, turns = y.shape[1], []
    while sum(t.shape[1] for t in turns) < bits:
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(y.T @ np.sign(y @ turn))
            turn = u @ vt
        turns.append(turn)
    c.turns = np.hstack(turns)[:, : -(-bits // 64) * 64]
    c.sample = c.codes(sample)
    n = len(sample)
    near = min(n - 1, max(1, round(k * n / max(rows, n))))  # the rank that k-th has in a sample of this part
    if n <= k + 1 or near < 1:
        return c
    some = rng.permutation(n)[:256]
    score = sample[some] @ sample.T
    score[np.arange(len(some)), some] = -np.inf
    true = np.argpartition(-score, near - 1, axis=1)[:, :near]
    dist = distances(c.asked(sample[some]), c.sample)
    needed = np.array([np.searchsorted(np.sort(r), r[t], "right") for r, t in zip(dist, true)])  # codes as near as that neighbour's
    c.share = float(min(1.0, np.quantile(needed, recall) / n))
    return c


def usable(vectors: DataFrame) -> DataFrame:
    """``(id, v array<double>)`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    rows = rows.filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (sizes.n if sizes else 0))


def packed_blocks(rows: DataFrame, coder, block: int, k: int | None = None) -> DataFrame:
    """Blocks of ids, vectors and codes, those of queries (``k`` given) with their radii; ``g`` is the partition they were made in."""

    def deal(batches):
        c = pickle.loads(coder.value)

        def made(ids, x):
            codes = c.codes(x) if k is None else c.asked(x)
            radii = b"" if k is None else c.radii(codes, k).astype("<i8").tobytes()
            return pa.RecordBatch.from_pydict({"ids": [ids.astype("<i8").tobytes()], "vectors": [x.astype("<f8").tobytes()], "codes": [codes.tobytes()], "radii": [radii]}, schema=BLOCK_ARROW)

        ids, xs, n = [], [], 0
        for b in batches:
            if b.num_rows:
                ids.append(b["id"].to_numpy())
                xs.append(b["v"].flatten().to_numpy().reshape(b.num_rows, -1))
                n += b.num_rows
            if n >= block:
                i, x = np.concatenate(ids), np.concatenate(xs)
                for s in range(0, n - n % block, block):
                    yield made(i[s : s + block], x[s : s + block])
                ids, xs, n = [i[n - n % block :]], [x[n - n % block :]], n % block
        if n:
            yield made(np.concatenate(ids), np.concatenate(xs))

    return written(rows.mapInArrow(deal, BLOCK).withColumn("g", F.spark_partition_id()), "vectors")


def unpacked(b, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and codes of a block."""
    ids = np.frombuffer(b["ids"][n].as_py(), "<i8")
    return ids, np.frombuffer(b["vectors"][n].as_py(), "<f8").reshape(len(ids), -1), np.frombuffer(b["codes"][n].as_py(), np.uint8).reshape(len(ids), -1)


def bounds(radii: np.ndarray, s: int) -> np.ndarray:
    """Bits by which each of ``s`` substrings may differ in a probe, a row a radius; -1: not probed."""
    m, a = np.divmod(radii, s)
    return np.where(np.arange(s) <= a[:, None], m[:, None], m[:, None] - 1)


def ball(m: int) -> np.ndarray:
    """Values of a substring with at most ``m`` bits set."""
    out = [0]
    for n in range(1, min(m, WIDTH) + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(WIDTH), n)]
    return np.array(out if m >= 0 else [], np.int64)


def probed_share(coder: Coder, k: int, some: int = 256) -> tuple[float, float]:
    """Estimated part of a table's rows that a query's probes touch (rows in several probed buckets count as often), and the number of its probes."""
    asked = coder.sample[:some]
    s = asked.shape[1] * 8 // WIDTH
    may = bounds(coder.radii(asked, k), s)
    x, y = asked.view("<u2"), np.ascontiguousarray(coder.sample).view("<u2")
    touched = sum(float((np.bitwise_count(x[:, j : j + 1] ^ y[None, :, j]) <= may[:, j : j + 1]).mean()) for j in range(s))
    probes = float(np.mean([[sum(comb(WIDTH, i) for i in range(m + 1)) for m in r.tolist()] for r in may]) * s)
    return touched, probes


class Buckets:
    """Codes by the buckets of their substrings: for each substring the rows in order of its value, and where a value's begin."""

    def __init__(self, codes: np.ndarray):
        self.whole, parts = codes.view("<u8"), codes.view("<u2")
        self.rows = [np.argsort(p, kind="stable") for p in parts.T]
        self.starts = [np.append(0, np.cumsum(np.bincount(p, minlength=1 << WIDTH))) for p in parts.T]
        self.balls: dict[int, np.ndarray] = {}

    def within(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """Rows of the codes within ``radius`` of one, each once: those of the probed buckets whose whole distance is."""
        seen = np.zeros(len(self.whole), bool)
        for part, m, rows, starts in zip(asked.view("<u2").tolist(), bounds(np.array([radius]), len(self.rows))[0].tolist(), self.rows, self.starts):
            if m not in self.balls:
                self.balls[m] = ball(m)
            values = self.balls[m] ^ part
            first = starts[values]
            n = starts[values + 1] - first
            first, n = first[n > 0], n[n > 0]
            seen[rows[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.whole[found] ^ asked.view("<u8")).sum(1) <= radius]


def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` rows of largest inner product with ``q``."""
    score = (x * q).sum(1)  # in one order of addition, so that equal vectors tie
    if len(ids) > k:
        near = score >= np.partition(score, -k)[-k]
        ids, score = ids[near], score[near]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


FOUND = "query_id long, vec_id long, score double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def by_groups(index: DataFrame, queries: DataFrame, groups: int, k: int) -> DataFrame:
    """Candidates by probing the buckets of every group of rows; the queries are dealt into as many parts as keep all cores at work.

    A task holds one group and a few query blocks at a time.
    """
    spark = index.sparkSession
    parts = max(1, min(queries.count(), -(-spark.sparkContext.defaultParallelism // groups)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.select("g", numbers(parts).alias("p"), F.lit(0).alias("kind"), "ids", "vectors", "codes", "radii")
    asked = queries.select(numbers(groups).alias("g"), F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("p"), F.lit(1).alias("kind"), "ids", "vectors", "codes", "radii")
    both = held.union(asked).repartition(groups * parts, "g", "p").sortWithinPartitions("g", "p", "kind")

    def search(batches):
        at, blocks, buckets = None, [], None
        for b in batches:
            for n in range(b.num_rows):
                cell = b["g"][n].as_py(), b["p"][n].as_py()
                if cell != at:
                    at, blocks, buckets = cell, [], None
                if b["kind"][n].as_py() == 0:
                    blocks.append(unpacked(b, n))
                    continue
                if buckets is None and blocks:
                    ids, x, codes = (np.concatenate(c) for c in zip(*blocks))
                    blocks, buckets = [], Buckets(codes)
                if buckets is None:  # no row is in this group
                    continue
                q_ids, q, asked = unpacked(b, n)
                found = []
                for i, radius in enumerate(np.frombuffer(b["radii"][n].as_py(), "<i8").tolist()):
                    rows = buckets.within(asked[i], radius)
                    rows = rows[ids[rows] != q_ids[i]]
                    found.append(best(q[i], ids[rows], x[rows], k))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(i) for i, _ in found])), *(pa.array(np.concatenate(c)) for c in zip(*found))], schema=FOUND_ARROW)

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):  # rows are blocks
        return written(both.mapInArrow(search, FOUND), "found")


def by_buckets(index: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates by probing: codes and probes meet on (substring, value), then on the whole distance, then on the vectors.

    Codes travel as numbers of 64 bits; a pair found in several substrings counts once.
    """
    kind = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("code", pa.list_(pa.int64())), ("radius", pa.int64())])

    def entries(probing: bool):
        def run(batches):
            balls: dict[int, np.ndarray] = {}
            for b in batches:
                for n in range(b.num_rows):
                    ids, _, codes = unpacked(b, n)
                    s = codes.shape[1] * 8 // WIDTH
                    whole, parts = codes.view("<i8"), codes.view("<u2").astype(np.int64)
                    radii = np.frombuffer(b["radii"][n].as_py(), "<i8") if probing else np.zeros(len(ids), np.int64)
                    may = bounds(radii, s)
                    balls.update((m, ball(m)) for m in set(np.unique(may).tolist() if probing else ()) - balls.keys())
                    for at in range(0, len(ids), 64):
                        key, owner = [], []
                        for i in range(at, min(at + 64, len(ids))):
                            for j in range(s):
                                values = parts[i, j] ^ balls[int(may[i, j])] if probing else parts[i, j : j + 1]
                                key.append(j << WIDTH | values)
                                owner.append(np.full(len(values), i))
                        key, owner = np.concatenate(key), np.concatenate(owner)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key, pa.int64()), pa.array(ids[owner]), pa.FixedSizeListArray.from_arrays(pa.array(whole[owner].ravel()), whole.shape[1]).cast(pa.list_(pa.int64())), pa.array(radii[owner])], schema=kind)

        return run

    form = "key long, id long, code array<long>, radius long"
    held = index.mapInArrow(entries(False), form).select("key", F.col("id").alias("vec_id"), F.col("code").alias("held"))
    asked = queries.mapInArrow(entries(True), form).select("key", F.col("id").alias("query_id"), F.col("code").alias("asked"), "radius")
    apart = F.aggregate(F.zip_with("asked", "held", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    pairs = held.join(asked, "key").filter((F.col("vec_id") != F.col("query_id")) & (apart <= F.col("radius"))).select("query_id", "vec_id").distinct()
    vectors = rows.select("id", "v")
    both = pairs.join(vectors.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), "vec_id").join(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def scored(batches):
        for b in batches:
            q, x = (b[c].flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1)) for c in ("q", "x"))
            yield pa.RecordBatch.from_arrays([b["query_id"], b["vec_id"], pa.array((q * x).sum(1))], schema=FOUND_ARROW)

    return both.select("query_id", "vec_id", "q", "x").mapInArrow(scored, FOUND)


def nearest(vectors: DataFrame, query_ids, k: int = 20, bits: int = 256, recall: float = 0.97, exact: bool = False, plan: str | None = None, sample_rows: int = 8192, index_block: int = 8192, query_block: int = 256, group_rows: int = 65_536) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for rows of ``vectors`` where the column ``query_ids`` holds, their ``k`` nearest others.

    ``recall``: of neighbours within the sample, from which radii are learned; ``plan``: ``buckets`` (joined by value) or
    ``blocks`` (in groups of ``group_rows`` rows), else by estimate.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sample.empty:
        return empty
    top_norm, n, ids = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count("*"), F.count_distinct("id")).first()
    coder = learn(np.stack(sample["v"].to_numpy()), float(top_norm), n, k, bits, recall)
    if exact:
        coder.share = 1.0
    if plan is None:
        touched, probes = probed_share(coder, k)
        plan = "buckets" if touched * n + probes < n / 8 and ids == n else "blocks"  # repeated ids have several vectors
    shared = spark.sparkContext.broadcast(pickle.dumps(coder))  # of fixed size: sample_rows codes and the rotations
    groups = -(-n // group_rows)
    index = packed_blocks(rows.repartition(groups) if plan == "blocks" else rows, shared, index_block)
    queries = packed_blocks(rows.filter(query_ids), shared, query_block, k)
    found = by_groups(index, queries, groups, k) if plan == "blocks" else by_buckets(index, queries, rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
