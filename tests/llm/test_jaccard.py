import re

import numpy as np
import pytest

from quillspark.llm import jaccard as j
from tests.llm.helpers import AWKWARD, SF, as_dict, documents, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(texts, size):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute(ids, texts, size=3, tenths=9):
    s = sets(texts, size)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and (len(s[a]) * tenths <= 10 * len(s[b]) and len(s[b]) * tenths <= 10 * len(s[a])):
                o = len(s[a] & s[b])
                if 10 * o >= tenths * (len(s[a]) + len(s[b]) - o):
                    x, y = find(ids[a]), find(ids[b])
                    parent[max(x, y)] = min(x, y)
    return {i: (len(x), find(i)) for i, x in zip(ids, s)}


def copies(rng, base, n, rate, vocabulary=5000):
    out = []
    for _ in range(n):
        w = list(base)
        for k in np.flatnonzero(rng.random(len(w)) < rate):
            w[k] = f"e{rng.integers(vocabulary)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,tenths", [(3, 9), (5, 8)])
def test_equals_brute_force(spark, size, tenths):
    rng = np.random.default_rng(4)
    texts = list(AWKWARD)
    for n in (5, 30, 120):
        base = [f"w{rng.integers(400)}" for _ in range(n * 3)]
        texts += [" ".join(base)] + copies(rng, base, 12, 0.01) + copies(rng, base, 12, 0.025)
        texts += [" ".join(base[: len(base) * 19 // 20]), " ".join(base + base[:3])]
    base = [f"v{i}" for i in range(100)]
    texts += [" ".join(base)] + [" ".join([*base[:k], "z", *base[k:]]) for k in range(0, 100, 5)]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    got = as_dict(j.jaccard_groups(documents(spark, texts), size, tenths))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(list(range(len(texts))), texts, size, tenths)


def test_long_postings_are_dealt_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = copies(rng, base, 60, 0.02)
    docs = documents(spark, texts)
    rows = spark.createDataFrame([(i % 3, i, 10, 10, 1) for i in range(40)], "token long, rid long, n int, s int, l int")
    pairs = {(r.x, r.y) for r in j.candidates(rows, None, 9, most=4).collect()}
    assert pairs == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3}
    got = as_dict(j.jaccard_groups(docs))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in brute(list(range(60)), texts).items()}


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = as_dict(j.op6_jaccard(spark, SF))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute([r.doc_id for r in rows], [r.text for r in rows])


@pytest.mark.parametrize("size", [1, 3, 5])
def test_a_block_is_cut_at_once(size):
    rng = np.random.default_rng(7)
    texts = [(t or "").encode() for t in AWKWARD] + [" ".join(f"w{k}" for k in rng.integers(0, 20, n)).encode() for n in range(40)]
    keys, ends = j.Shingler(size)(texts)
    parts = [keys[s:e] for s, e in zip([0, *ends[:-1]], ends)]
    brute_sets = sets([t.decode() for t in texts], size)
    assert len(parts) == len(texts) and all((p[1:] > p[:-1]).all() for p in parts)
    assert all(len(set(p.tolist()) & set(q.tolist())) == len(a & b) for p, a in zip(parts, brute_sets) for q, b in zip(parts, brute_sets))
    assert [len(x) for x in j.Shingler(size)([])] == [0, 0]


def test_prefix_shares_enough():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = set(range(n))
        y = set(list(x)[: n - int(rng.integers(0, max(1, n // 8)))]) | {1000 + int(k) for k in rng.integers(0, 9, int(rng.integers(0, max(1, n // 10))))}
        o = len(x & y)
        if 10 * o < 9 * (len(x) + len(y) - o):
            continue
        rank = rng.permutation(2000)
        (lx, px), (ly, py) = (j.choose(len(s), np.sort(rng.integers(1, 50, len(s))), 9) for s in (x, y))
        px, py = (set(sorted(s, key=lambda t: rank[t])[:p]) for s, p in ((x, px), (y, py)))
        assert len(px & py) >= min(lx, ly)


def test_empty_repeated_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.op6_jaccard(spark, saved(df, tmp_path)).collect()), key=str)
    assert got == [(3, 2, 3), (3, 2, 3), (7, 2, 3), (9, 0, 9), (None, 2, None)]
    assert j.op6_jaccard(spark, saved(df.limit(0), tmp_path / "e")).count() == 0
