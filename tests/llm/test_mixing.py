import math
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing as m
from tests.llm.helpers import AWKWARD, SF, documents, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levels(sizes, weights=m.WEIGHTS, share=m.SHARE, most=m.MOST):
    """Targets by sharing again what is above, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: most * sizes[s] for s in above}
        left, free = left - sum(most * sizes[s] for s in above), free - above
    return out


def tilt(sizes, target, most=m.MOST):
    """The multiplier by plain bisection."""
    lo, hi = -50.0, 50.0
    for _ in range(300):
        mid = (lo + hi) / 2
        got = sum(s * min(most, math.exp(min(mid * s, 700))) for s in sizes)
        lo, hi = (mid, hi) if got < target else (lo, mid)
    return (lo + hi) / 2


def compare(got, docs, near=0.01):
    """``docs``: (doc_id, text, source)."""
    size = {}
    for _, text, s in docs:
        size.setdefault(s, []).append(len(WORD.findall(text or "")))
    want = levels({s: sum(x) for s, x in size.items()})
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t, _ in docs)
    taken = {}
    for r in got:
        assert r.source_size == sum(size[r.source]) and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        least = min([x for x in size[s] if x], default=0)
        assert abs(t - want[s]) <= max(near * want[s], least), (s, t, want[s])
    return want, size


def rows_of(spark, folder):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_whole_table(spark):
    docs = rows_of(spark, SF)
    got = m.mixed(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want, size = compare(got, docs)
    for s in size:
        lengths = [x for x in size[s] if x]
        if 0 < want[s] < 2 * sum(lengths) * (1 - 1e-9):
            t = tilt(lengths, want[s])
            for r in got:
                if r.source == s and r.size:
                    assert r.rate == pytest.approx(min(2.0, math.exp(t * r.size)), rel=1e-5)
                    assert abs(r.copies - r.rate) < 2


def test_rates_have_the_least_divergence(spark):
    """No other rates that meet the target are nearer to one copy each."""
    got = [r for r in m.mixed(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.size and 0 < r.rate < 2]
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    cost = lambda x: x * math.log(x) - x
    for rows in by.values():
        a, b = min(rows, key=lambda r: r.size), max(rows, key=lambda r: r.size)
        if a.size == b.size:
            continue
        for step in (1e-3, -1e-3):  # words moved from one document to another
            x, y = a.rate + step / a.size, b.rate - step / b.size
            if 0 < x < 2 and 0 < y < 2:
                assert cost(x) + cost(y) >= cost(a.rate) + cost(b.rate) - 1e-9


def test_awkward_rows(spark, tmp_path):
    docs = [(i, t, ["a", "b", None, "B", "", "ü"][i % 6]) for i, t in enumerate(AWKWARD * 4)] + [(1000, "w " * 60_000, "a"), (1001, "v " * 3, "long"), (1001, "v " * 3, "long"), (1001, "v " * 4, "long"), (None, "n n", None), (None, "n n", None), (1002, " \t ", "blank"), (1003, None, "blank")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "n": F.lit(1), "part": F.lit(2), "rate": F.lit(3), "src": F.lit("s"), "h": F.lit(5)})
    folder = saved(df, tmp_path)
    got = m.op13_mixing(spark, folder).collect()
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want = levels(size)
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert all(r.taken <= 2 * r.size for r in got) and len(got) == len(docs)
    again = m.op13_mixing(spark, saved(df.repartition(7), tmp_path / "again"))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert m.op13_mixing(spark, saved(df.limit(0), tmp_path / "none")).count() == 0


def test_equal_documents_split_their_copies(spark):
    """One size over many parts: as many further copies as the rate asks, no more than one apart."""
    docs = [(i, "a b c", "x") for i in range(700)] + [(i, "a b c d", "y") for i in range(700, 1100)]
    df = documents(spark, []).limit(0).select("doc_id", "text", "source").union(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    got = m.mixed(df, weights=(1, 2), share=1.25).collect()
    n = {}
    for r in got:
        n.setdefault(r.source, []).append(r.copies)
    assert max(n["x"]) - min(n["x"]) <= 1 and max(n["y"]) - min(n["y"]) <= 1
    target = {r.source: r.target for r in got}
    assert abs(sum(n["x"]) * 3 - target["x"]) <= 1.5 and abs(sum(n["y"]) * 4 - target["y"]) <= 2


def test_one_long_document_among_short_ones(spark):
    docs = [(0, "w " * 5000, "x")] + [(i, "w " * (1 + i % 3), "x") for i in range(1, 900)] + [(i, "w " * 9, "y") for i in range(1000, 1600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    compare(m.mixed(df).collect(), docs, near=0.001)


def test_sources_rank_by_code_point(spark):
    df = spark.createDataFrame([(x, 10) for x in ("b", "Z", "é", "a", "\U0001F600", "￮")], "src string, source_size long").withColumn("nul", F.lit(False)).union(spark.createDataFrame([("", 10, True)], "src string, source_size long, nul boolean"))
    got = [(r.src, r.rank) for r in m.numbered(df.repartition(5)).orderBy("rank").collect()]
    assert [s for s, _ in got] == ["Z", "a", "b", "é", "￮", "\U0001F600", ""] and [r for _, r in got] == list(range(7))


def test_documents_drawn(spark):
    df = spark.createDataFrame([(1, "a a", "x"), (2, "b", "x"), (3, "c c c", "y")], "doc_id long, text string, source string")
    mix = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id long, copies int")
    assert sorted((r.doc_id, r["copy"]) for r in m.drawn(df, mix).collect()) == [(1, 1), (1, 2), (3, 1)]
