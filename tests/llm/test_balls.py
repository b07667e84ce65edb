import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import balls as b
from tests.llm.helpers import SF, saved


def brute(rows, k=b.K, rounds=b.ROUNDS, dim=b.DIM):
    """Every vector against every centroid in whole numbers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(((key(i), v) for i, v in kept))[:k]]
    x = np.array([v for _, v in kept], object).reshape(len(kept), dim)
    for n in range(rounds + 1):
        d = [[sum((p - q) ** 2 for p, q in zip(v, m)) for m in c] for v in x.tolist()]
        own = [min(range(len(c)), key=lambda j: (e[j], j)) for e in d]
        if n < rounds:
            for j in range(len(c)):
                m = [v for v, o in zip(x.tolist(), own) if o == j]
                c[j] = [sum(col) // len(m) for col in zip(*m)] if m else c[j]
    dist = [e[o] for e, o in zip(d, own)] if len(kept) else []
    total = [sum(e for e, o in zip(dist, own) if o == j) for j in range(len(c))]
    sign = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, o, e, total[o], sum(dist), sign[o]) for (i, _), o, e in zip(kept, own, dist)), key=str)


def rows(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return df.withColumns({"cluster": F.lit("x"), "ints": F.lit(1), "ids": F.lit(2), "c": F.lit(3), "key": F.lit("k")})


def test_whole_table(spark):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows(b.op12_balls(spark, SF)) == brute(data)


def test_awkward_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    make = lambda s=1.0: (s * rng.normal(size=64)).tolist()
    one, nan, inf, none = make(), make(), make(), make()
    nan[3], inf[5], none[63] = float("nan"), float("-inf"), None
    data = [(i, make()) for i in range(70)] + [(70, one), (71, one), (71, one), (72, nan), (73, inf), (74, none), (75, None), (76, []), (77, one[:63]), (78, one + [0.0]), (None, make(3)), (None, make(3)), (79, [0.0] * 64), (80, [-0.001] * 64)]
    got = rows(b.op12_balls(spark, saved(vectors(spark, data), tmp_path, "embeddings")))
    assert got == brute(data) and len(got) == 70 + 3 + 2 + 2
    big = [(1, [1e300] * 64), (2, [4e5] * 64), (3, one)]
    assert {r[0] for r in rows(b.clustered(vectors(spark, big)))} == {2, 3}
    assert rows(b.clustered(vectors(spark, big[:2]))) == [(2, 0, 0, 0, 0, hashlib.sha256(",".join(["102400000"] * 64).encode()).hexdigest())]
    assert b.clustered(vectors(spark, data).limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0, 1, 4])
def test_ties_and_empty_clusters(spark, spread):
    """Vectors on a small grid: equal distances, equal seeds and clusters that lose all members."""
    rng = np.random.default_rng(spread)
    data = [(i, (rng.integers(0, spread + 1, 3) / 256).tolist()) for i in range(60)]
    assert rows(b.clustered(vectors(spark, data), k=12, dim=3)) == brute(data, 12, b.ROUNDS, 3)


def test_few_comparisons_where_there_are_clusters(spark):
    """Stable cores and annuli spare most of the comparisons, and the radius never leaves out a neighbour."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 8)) * 20
    x = np.floor(256 * (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)))).astype(np.int64)
    c = x[rng.choice(len(x), 30, False)]
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    own, dist, compared = b.Balls(c, [None] * 30).assign(x, np.zeros(len(x), np.int32))
    assert (own == all_.argmin(1)).all() and (dist == all_.min(1)).all()
    radius = [math.isqrt(int(dist[own == j].max())) + 1 if (own == j).any() else 0 for j in range(30)]
    again, dist2, compared = b.Balls(c, radius).assign(x, own)
    assert (again == own).all() and (dist2 == dist).all() and compared.sum() < 30 * len(x) / 3
    assert (compared == 1).any(), "a stable core"


def test_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = [(i, rng.normal(size=64).tolist()) for i in range(300)]
    want = rows(b.clustered(vectors(spark, data)))
    monkeypatch.setattr(b, "BLOCK", 7)
    assert rows(b.clustered(vectors(spark, data).repartition(13))) == want
