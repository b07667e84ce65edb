import numpy as np

from quillspark.llm import neighbours as n
from tests.llm.helpers import saved

SF = "/root/testdata/sf0.1"


def exact(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x[i] * x).sum(1)
        rest = np.flatnonzero(ids != ids[i])
        order = rest[np.lexsort((ids[rest], -s[rest]))][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want, got = exact(ids, x), found(n.op3_neighbours(spark, SF))
    assert want.keys() == got.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 20 for q in want]) >= 0.9
    assert all(abs(s - float(x[ids == q][0] @ x[ids == v][0])) < 1e-12 for q in list(got)[:5] for v, s in got[q])


def test_ties_and_rows_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0]), (40, None), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(n.op3_neighbours(spark, saved(df, tmp_path, "embeddings")))
    assert got == {0: [(1, 1.0), (2, 1.0), (20, -1.0)], 20: [(0, -1.0), (1, -1.0), (2, -1.0)]}
    assert n.op3_neighbours(spark, saved(df.limit(0), tmp_path / "e", "embeddings")).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8), np.uint8)
    asked = codes[:40] ^ np.packbits(rng.random((40, 64)) < 0.15, axis=1)
    radii = rng.integers(0, 30, 40)
    bits = lambda x: np.unpackbits(x, axis=-1).sum(-1)
    distance = bits(asked[:, None] ^ codes[None])
    assert (n.distances(asked, codes) == distance).all()
    may, x, y = n.bounds(radii, 4), asked.view("<u2"), codes.view("<u2")
    probed = np.zeros(distance.shape, bool)
    for i in range(40):
        for j in range(4):
            probed[i] |= np.isin(y[:, j], x[i, j] ^ n.ball(int(may[i, j])))
    assert probed[distance <= radii[:, None]].all()


def clustered(spark, count, seed=4):
    """Vectors around ``count / 25`` centres."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((count // 25, 48)).repeat(25, 0) + 0.05 * rng.standard_normal((count // 25 * 25, 48))
    return np.arange(len(x)), x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_both_plans_and_the_exact_search(spark):
    from pyspark.sql import functions as F

    ids, x, df = clustered(spark, 3000)
    want = exact(ids, x)
    one, two, whole = (found(n.nearest(df, F.col("id") % 20 == 0, **how)) for how in ({"plan": "buckets"}, {"plan": "blocks"}, {"exact": True, "plan": "blocks"}))
    assert one == two and {q: [i for i, _ in v] for q, v in whole.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in one[q]}) / 20 for q in want]) >= 0.9


def test_recall_and_candidates_by_size(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    for count in (400, 900, 1100, 6000):
        x = rng.standard_normal((count, 24))
        x[5] *= 30  # one norm far above the others
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        want, got = exact(np.arange(count), x), found(n.nearest(df, F.col("id") % 20 == 0))
        assert all(len(v) == 20 for v in got.values())
        assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 20 for q in want]) >= 0.9, count


def test_probes_touch_few_rows_of_clusters():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((320, 48)).repeat(25, 0) + 0.05 * rng.standard_normal((8000, 48))
    coder = n.learn(x, float(np.linalg.norm(x, axis=1).max()), 100_000, 20)
    touched, probes = n.probed_share(coder, 20)
    within = (n.distances(coder.asked(x[:200]), coder.sample) <= coder.radii(coder.asked(x[:200]), 20)[:, None]).mean()
    assert within < 0.02 and touched * 100_000 + probes < 100_000 / 8


def test_groups_and_parts_hold_every_code_within_the_radius(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 20))
    x[::3] = x[0]  # a third are copies of one
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact(np.arange(700), x)
    for rows in (150, 65_536):  # five groups; one, its queries in several parts
        got = found(n.nearest(df, F.col("id") % 20 == 0, exact=True, plan="blocks", index_block=64, query_block=8, group_rows=rows))
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_buckets_of_a_group():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (600, 16), np.uint8)
    codes[200:400] = codes[0]
    held = n.Buckets(codes)
    for i, radius in ((0, 0), (1, 40), (2, 55), (3, 128)):
        assert held.within(codes[i], radius).tolist() == np.flatnonzero(n.distances(codes[i : i + 1], codes)[0] <= radius).tolist()
