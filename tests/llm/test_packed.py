import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import packed
from tests.llm.helpers import as_dict


def sends(spark, blocks, keys_each, coarse, seed=1):
    """Blocks of keys from a common pool, as they are sent."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 64, 3 * keys_each, np.uint64)
    of = {f"b{i}": np.unique(rng.choice(pool, keys_each)) for i in range(blocks)}
    rows = [r for b, k in of.items() for r in packed.sent(b, k, None, coarse, n_kind="u1").to_pylist()]
    return of, spark.createDataFrame(rows, packed.SENT)


def test_merged_answers_equal_direct_ones(spark):
    of, rows = sends(spark, 30, 200, 4)
    total = {}
    for k in of.values():
        for x in k.tolist():
            total[x] = total.get(x, 0) + 1
    got = as_dict(packed.merged_answers(rows, lambda s: np.minimum(s, 255), "u1", 37, 30, n_kind="u1", fan=4), "block")
    for b, k in of.items():
        assert packed.received([x.asDict() for x in got[b]["got"]], "u1").tolist() == [total[x] for x in k.tolist()]


def test_rows_grow_with_blocks_and_levels_only(spark):
    """Blocks and ranges 16 times as many: rows sent a block and level stay the same."""
    for blocks, parts in ((840, 105), (13_440, 1680), (10**8, 12_500_000)):
        assert all(groups * to <= 2 * packed.FAN * blocks for groups, _, to in packed.levels(parts, blocks))
    per_block = []
    for blocks in (16, 256):
        fan = 8
        _, rows = sends(spark, blocks, 60, fan)
        way = packed.levels(4 * blocks, blocks, fan)
        assert rows.count() <= fan * blocks and all(groups * to <= 2 * fan * blocks * fan for groups, _, to in way)
        per_block.append(max(groups * to for groups, _, to in way) / blocks)
        out = packed.merged_answers(rows, lambda s: s, "<u4", 4 * blocks, blocks, n_kind="u1", fan=fan)
        assert out.select(F.sum(F.size("got"))).first()[0] <= fan * blocks
    assert per_block[1] <= 2 * per_block[0]


def test_many_levels(spark):
    of, rows = sends(spark, 40, 100, 2)
    total = {}
    for k in of.values():
        for x in k.tolist():
            total[x] = total.get(x, 0) + 1
    assert len(packed.levels(30, 40, 2)) == 4
    got = as_dict(packed.merged_answers(rows, lambda s: s, "<u4", 30, 40, n_kind="u1", fan=2), "block")
    for b, k in of.items():
        assert packed.received([x.asDict() for x in got[b]["got"]], "<u4").tolist() == [total[x] for x in k.tolist()]


def test_wide_keys_differ_by_either_half(spark):
    keys = np.array([(1 << 60, 5), (1 << 60, 6), (7, 5), (1 << 60, 5)], packed.WIDE)
    got, at, n = packed.distinct(keys)
    assert got.tolist() == [(7, 5), (1 << 60, 5), (1 << 60, 6)] and at.tolist() == [1, 2, 0, 1] and n.tolist() == [1, 2, 1]
    rng = np.random.default_rng(3)
    pool = np.array([(int(a), int(b)) for a in rng.integers(0, 1 << 64, 60, np.uint64) for b in rng.integers(0, 3, 2)], packed.WIDE)
    of = {f"b{i}": packed.distinct(rng.choice(pool, 40))[0] for i in range(20)}
    total = {}
    for k in of.values():
        for x in k.tolist():
            total[x] = total.get(x, 0) + 1
    rows = spark.createDataFrame([r for b, k in of.items() for r in packed.sent(b, k, None, 4, n_kind="u1").to_pylist()], packed.SENT)
    got = as_dict(packed.merged_answers(rows, lambda s: s, "u1", 37, 20, n_kind="u1", fan=4, wide=True), "block")
    for b, k in of.items():
        assert packed.received([x.asDict() for x in got[b]["got"]], "u1").tolist() == [total[x] for x in k.tolist()]
