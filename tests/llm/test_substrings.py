import hashlib
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import substrings as s
from tests.llm.helpers import AWKWARD, SF, as_dict, documents, saved


def brute(texts, length):
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[hash(b[i : i + length])] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append({"n_bytes": len(b), "n_removed": int(gone.sum()), "n_spans": len(edges) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


def compare(got, texts, ids=None):
    want = brute(texts, s.LENGTH)
    for i, w in zip(ids or range(len(texts)), want):
        assert {k: v for k, v in got[i].items() if k != "doc_id"} == w, i


def test_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    make = lambda n: "".join(rng.choice(list("abcdefghij é"), n))
    p, q = make(450), make(1200)
    texts = [
        *AWKWARD, make(100) + p + make(50), p + make(700), make(30) + p[:399] + make(30), make(30) + p[:400] + make(30), q, q, q[:800] + "X" + q[801:], make(10) + q[300:900] + p + q[200:700],
        p + p, "ab" * 600, make(3000), make(399), make(400),
    ]
    compare(as_dict(s.op2_substrings(spark, saved(documents(spark, texts), tmp_path))), texts)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    compare(as_dict(s.op2_substrings(spark, SF)), [r.text for r in rows], [r.doc_id for r in rows])


def test_family_merges_equal_ranks(spark):
    family = s.SuffixFamily()
    frame = lambda *k: spark.createDataFrame([(x // 2, x, 1) for x in k], "head long, key long, n long")
    assert family.add(frame(1, 2)).count() == 0
    assert {r.key for r in family.add(frame(2, 3, 3)).collect()} == {2, 3}
    assert [r for r, _ in family.levels] == [1]
    assert {r.key for r in family.add(frame(1, 9)).collect()} == {1}
    assert [r for r, _ in family.levels] == [1, 0]
    family.add(frame(9))
    assert [r for r, _ in family.levels] == [2]


def test_null_and_repeated_ids(spark, tmp_path):
    t = "xyz " * 300
    rows = [(None, t), (None, "b" * 10), (5, "c" * 9), (5, t), (5, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.op2_substrings(spark, saved(df, tmp_path)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(9, 0), (10, 0), (1200, 1200), (1200, 1200), (1200, 1200)]
    assert s.op2_substrings(spark, saved(df.limit(0), tmp_path / "e")).count() == 0


@pytest.mark.parametrize("length,prefix", [(40, 24)])
def test_other_lengths(spark, length, prefix):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), 200)) for _ in range(6)] + ["ab" * 50, "ab" * 30 + "c"]
    texts.append(texts[0][50:120] + "z")
    got = as_dict(s.repeated_bytes(documents(spark, texts), length, prefix, batches=3, block_bytes=300))
    for i, w in enumerate(brute(texts, length)):
        spans = got[i]["spans"]
        assert (sum(spans[1::2]) - sum(spans[::2]), len(spans) // 2, got[i]["kept_sha256"]) == (w["n_removed"], w["n_spans"], w["kept_sha256"])


def alike():
    """Two different texts of 400 letters that sums of letters times powers of an odd base, modulo 2 ** 64, cannot tell apart."""
    h = s.Hasher()
    rng = np.random.default_rng(8)
    words = rng.integers(97, 123, (1 << 19, 12)).astype(np.uint8)
    powers = np.array([pow(int(h.base), i, 1 << 64) for i in range(12)], np.uint64)
    low = (h.value[words] * powers).sum(1, dtype=np.uint64)
    factor = 1
    for i in range(5):
        factor = factor * (pow(int(h.base), 12 << i, 1 << 64) - 1) % (1 << 64)
    bits = 64 - ((factor & -factor).bit_length() - 1)
    low &= np.uint64((1 << bits) - 1)
    order = np.argsort(low, kind="stable")
    at = np.flatnonzero(low[order][1:] == low[order][:-1])[0]
    a, b = words[order[at]].tobytes(), words[order[at + 1]].tobytes()
    odd = [bin(i).count("1") % 2 for i in range(32)]
    x, y = (b"".join([p, q][o] for o in odd) + b"common end 12345" for p, q in ((a, b), (b, a)))
    assert x != y and len(x) == 400
    one, two = (h.of(h.sums(np.frombuffer(t, np.uint8)), np.array([0]), 400) for t in (x, y))
    assert one == two
    return x.decode(), y.decode()


def test_texts_made_to_clash(spark, tmp_path):
    """Nothing goes that repeats nowhere, whatever the hash of the anchors takes for equal."""
    x, y = alike()
    texts = [x, y, x[:-1] + "6", y[:-1] + "6", x[:399], y[1:]]
    got = as_dict(s.op2_substrings(spark, saved(documents(spark, texts), tmp_path)))
    compare(got, texts)
    assert all(r["n_removed"] == 0 for r in got.values())


def test_a_long_text(spark, tmp_path):
    rng = np.random.default_rng(2)
    part = "".join(rng.choice(list("abcdefgh "), 5000))
    texts = ["".join(rng.choice(list("abcdefgh "), 3_000_000)) + part, "x" + part + "y", "short"]
    got = as_dict(s.op2_substrings(spark, saved(documents(spark, texts), tmp_path)))
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in range(3)] == [(5000, 1), (5000, 1), (0, 0)]
