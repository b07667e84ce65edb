import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import brown as b
from tests.llm.helpers import AWKWARD, SF, as_dict, documents, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute(texts):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in texts.items()}


def check(got, texts):
    for i, (held, n, known, total, base) in brute(texts).items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_base_equals_brute_force(spark, tmp_path):
    texts = dict(enumerate([*AWKWARD, *(f"w{i} w{i % 3} END End end" for i in range(30))]))
    check(as_dict(b.op10_class_bigrams(spark, saved(documents(spark, texts.values()), tmp_path))), texts)
    assert b.op10_class_bigrams(spark, saved(documents(spark, ["x"]).limit(0), tmp_path / "e")).count() == 0


def test_whole_table_and_perplexity(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = as_dict(b.op10_class_bigrams(spark, SF))
    check(got, texts)
    held = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # classes predict better than words alone


def likelihood(m, cls, k):
    one = np.zeros((len(m), k))
    one[np.arange(len(m)), cls] = 1
    big = one.T @ m @ one
    return b.xlogx(big).sum() - b.xlogx(big.sum(0)).sum() - b.xlogx(big.sum(1)).sum()


def test_exchange_finds_classes_and_raises_likelihood():
    rng = np.random.default_rng(0)
    top, seq = 12, []
    for i in range(4000):  # words 0-5 and 6-11 alternate
        seq.append(int(rng.integers(6)) + 6 * (i % 2))
    size = top + b.TAILS + 2
    m = np.zeros((size, size), np.int64)
    np.add.at(m, (seq[:-1], seq[1:]), 1)
    cls = b.exchange(m, top, classes=2, sweeps=6)
    assert len(set(cls[:6])) == 1 and len(set(cls[6:12])) == 1 and cls[0] != cls[6]
    m = rng.integers(0, 9, (size, size))
    start = np.concatenate([np.arange(top) % 4, 4 + np.arange(size - top)])
    got = b.exchange(m, top, classes=4)
    assert likelihood(m, got, 4 + size - top) >= likelihood(m, start, 4 + size - top)


def test_probabilities_of_known_tokens_sum_to_at_most_one(spark):
    """Texts of at most two words exclude each other: of all that known words make, the probabilities sum to below one."""
    train = [f"a b c d{i % 4} a" for i in range(20)] + ["a", "b c", "c"] * 5
    known = sorted({w for t in train for w in t.split()})
    asked = ["", *known, *(f"{x} {y}" for x in known for y in known)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(train)] + [(1000 + i, t, 0) for i, t in enumerate(asked)], "id long, text string, extra long")
    got = {r.id: r.score for r in b.score_texts(docs, top=3, classes=2).collect()}
    total = sum(10 ** got[1000 + i] for i in range(len(asked)))
    assert all(x < 0 for x in got.values()) and 0.2 < total < 1
    more = spark.createDataFrame([(i, t, 1) for i, t in enumerate(train)] + [(2000 + i, t, 0) for i, t in enumerate(["new1", "nëw", "n-w", "never"])], "id long, text string, extra long")
    unseen = [r.score for r in b.score_texts(more, top=3, classes=2).collect() if r.id >= 2000]
    assert total + sum(10**x for x in unseen) < 1


def brute_scores(docs, top, classes):
    """Scores of ``(id, text, train)`` word by word; only ``exchange`` of the top words is the operator's (tested by itself)."""
    import xxhash

    digest = lambda w: xxhash.xxh3_64_intdigest(w)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    texts = {i: ([*b.fold_words((t or "").encode()), b.END], train) for i, t, train in docs}
    learned = [w for w, train in texts.values() if train]
    n = Counter(x for w in learned for x in w)
    known = sorted(sorted((w for w in n if w != b.END), key=lambda w: (-n[w], signed(digest(w))))[:top], key=digest)
    start, end, size = classes + b.TAILS, classes + b.TAILS + 1, classes + b.TAILS + 2
    place = {w: i for i, w in enumerate(known)} | {b.END: top + b.TAILS + 1}
    symbol = lambda w: place.get(w, top + b.tail_of(w))
    m = np.zeros((top + b.TAILS + 2,) * 2, np.int64)
    for w in learned:
        for x, y in zip([top + b.TAILS, *map(symbol, w)], map(symbol, w)):
            m[x, y] += 1
    cls = b.exchange(m, top, classes)
    first = {w: int(cls[symbol(w)]) for w in {x for w, _ in texts.values() for x in w}}
    big = np.zeros((size, size))
    beside = {}
    for w in learned:
        seq = [start, *(first[x] for x in w), start]
        for k, x in enumerate(w):
            big[seq[k], seq[k + 1]] += 1
            if x != b.END and x not in place:
                left, right = beside.setdefault(x, (Counter(), Counter()))
                left[seq[k]] += 1
                right[seq[k + 2]] += 1
    h = lambda x: x * math.log(x) if x > 0 else 0.0
    of = dict(first)
    for w, (left, right) in beside.items():
        gains = []
        for c in range(classes):
            g = sum(h(big[k, c] + x) - h(big[k, c]) for k, x in left.items()) + sum(h(big[c, k] + x) - h(big[c, k]) for k, x in right.items())
            out_, in_ = big[c].sum(), big[:, c].sum()
            gains.append(g - h(out_ + n[w]) + h(out_) - h(in_ + n[w]) + h(in_))
        of[w] = max(range(classes), key=lambda c: (round(gains[c], 9), -c))
    once = {w for w in beside if n[w] == 1}
    trans, tokens = np.zeros((size, size)), Counter()
    for w in learned:
        prior, rare = start, None
        for x in w:
            c, tail = of[x], first[x] if x in once else None
            tokens[c] += 1
            trans[prior, c] += 1
            if tail is not None:
                trans[prior, tail] += 1
            if rare is not None:
                trans[rare, c] += 1
                if tail is not None:
                    trans[rare, tail] += 1
            prior, rare = c, tail
    types = Counter(of[w] for w in [*known, *beside])
    probability = (trans + b.ADD) / (trans.sum(1, keepdims=True) + b.ADD * size)
    out = {}
    for i, (w, _) in texts.items():
        total, prior = 0.0, start
        for x in w:
            c = of[x]
            p = probability[prior, c]
            if c < classes:
                p *= (n[x] + b.ADD) / (tokens[c] + b.ADD * types[c])
            elif c != end:
                p *= b.ADD / (b.ADD * (1 + trans[:, c].sum()))
            total, prior = total + math.log10(p), c
        out[i] = total
    return out


@pytest.mark.parametrize("top,classes", [(5, 2), (30, 6), (500, 3)])
def test_scores_equal_brute_force(spark, top, classes):
    rng = np.random.default_rng(top)
    pool = [f"w{i}" for i in range(40)] + [f"plain{chr(97 + i)}" for i in range(20)] + [f"é{i}" for i in range(9)] + ["a-b", "x_y", "Zed"]
    text = lambda k: " ".join(pool[int(x) % len(pool)] for x in rng.zipf(1.4, k))
    docs = [(i, text(int(rng.integers(0, 25))), int(i % 4 > 0)) for i in range(60)] + [(100, None, 1), (101, "", 0), (102, "never seen wörds 12 --", 0), (103, "once", 1), (104, "plaina " * 3000, 0)]
    got = {r.id: r.score for r in b.score_texts(spark.createDataFrame(docs, "id long, text string, extra long"), top=top, classes=classes, block_bytes=600).collect()}
    assert got == pytest.approx(brute_scores(docs, top, classes), rel=1e-9)


def test_looks_of_many_words():
    words = [b"a1", b"\xc3\xa91", "é".encode(), b"x-y", b"word", b" end", b"{", b"`", b"z", b"7"]
    assert b.looks(words).tolist() == [b.tail_of(w) for w in words] and len(b.looks([])) == 0


def test_every_training_word_gets_a_learned_class(spark):
    """Words beyond the commonest ones, all of one look: those like nouns stand after "the", those like verbs after "to"."""
    letters = "abcdefghijklmnopqrst"
    nouns, verbs = [f"n{a}{c}" for a in letters for c in "xyz"], [f"v{a}{c}" for a in letters for c in "xyz"]
    train = [f"the {n} to {v} the {a} to {c}" for i, (n, v) in enumerate(zip(nouns, verbs)) for a, c in [(("no", "na")[i % 2], ("vo", "va")[i // 2 % 2])]] * 2
    asked = [f"the {n} to {v}" for n, v in zip(nouns, verbs[1:])] + [f"the {v} to {n}" for n, v in zip(nouns, verbs[1:])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(train)] + [(1000 + i, t, 0) for i, t in enumerate(asked)], "id long, text string, extra long")
    got = {r.id: r.score for r in b.score_texts(docs, top=6, classes=4).collect()}
    half = len(asked) // 2
    assert all(got[1000 + i] > got[1000 + half + i] + 1 for i in range(half))


def test_placing_equals_exchange_gain_by_brute_force():
    rng = np.random.default_rng(3)
    classes, size = 3, 3 + b.TAILS + 2
    big = rng.integers(0, 30, (size, size)).astype(float)
    want, rows = [], []
    for w in range(40):
        n = int(rng.integers(1, 6))
        left, right = rng.integers(0, size, n), rng.integers(0, size, n)
        rows += [(w, int(x)) for x in left] + [(w, size + int(x)) for x in right]
        gains = []
        for c in range(classes):
            out_, in_ = big.sum(1), big.sum(0)
            gain = 0.0
            for side, x in ((0, left), (1, right)):
                for k, m in zip(*np.unique(x, return_counts=True)):
                    old = big[k, c] if side == 0 else big[c, k]
                    gain += b.xlogx(old + m) - b.xlogx(old)
            gains.append(gain - b.xlogx(out_[c] + n) + b.xlogx(out_[c]) - b.xlogx(in_[c] + n) + b.xlogx(in_[c]))
        want.append(int(np.argmax(gains)))
    keys = sorted(Counter(rows).items())
    word, code, n = (np.array(x) for x in zip(*((w, c, m) for (w, c), m in keys)))
    for most in (1, 10, 10_000):
        words, got = b.best_classes(word, code, n, big, classes, most)
        assert words.tolist() == list(range(40)) and got.tolist() == want


def test_merges_by_levels_give_the_same_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 500) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, int(i % 5 > 0)) for i, t in enumerate(texts)], "id long, text string, extra long").repartition(6)
    score = lambda: {r.id: r.asDict() for r in b.score_texts(docs, top=20, classes=4, block_bytes=2000, part_bytes=1000).collect()}
    direct = score()
    monkeypatch.setattr(b.packed, "FAN", 3)
    assert len(b.packed.levels(-(-sum(map(len, texts)) // 1000), 13, 3)) == 2
    merged = score()
    assert merged.keys() == direct.keys() == set(range(120))
    for i, r in direct.items():
        assert merged[i] == pytest.approx(r, rel=1e-12)


def test_near_counts_survive_packing():
    rng = np.random.default_rng(6)
    size, keys = 9, np.sort(rng.integers(0, 1 << 64, 50, np.uint64))
    word, code = rng.integers(0, 40, 3000), rng.integers(0, 2 * size, 3000)  # ten words without neighbours
    want = Counter(zip(word.tolist(), code.tolist()))
    near = b.Near(keys, word, code, np.ones(3000), size)
    for whole, parts in ((True, 5), (False, 1)):
        edges = np.searchsorted(b.packed.part_of(keys, parts), np.arange(parts + 1))
        rows = b.pa.table({c: b.pa.array(v, b.pa.binary()) for c, v in near.cut(edges, range(parts), whole).items()})
        got, at, sizes = b.all_near(b.pa.concat_tables([rows, rows]), size, whole)  # two blocks alike
        mask = np.uint64((1 << (64 if whole else 40)) - 1)
        assert sum(sizes) == 100 and got.keys[at].tolist() == (np.concatenate([keys, keys]) & mask).tolist()
        total = Counter()
        for j in range(len(got.word)):
            w = int(np.flatnonzero(keys & mask == got.keys[got.word[j]])[0])
            total[w, int(got.code[j])] += int(got.count[j])
        assert total == {k: 2 * n for k, n in want.items()}


def test_texts_are_cut_once(spark):
    """Every pass reads blocks of places, hashes and looks, no texts; also with more words than two bytes tell apart."""
    many = " ".join(f"w{i}" for i in range(70_000))
    for texts in ([many, "w1 w2", None, "w2 é 12", many], ["a b-c", "", "A 1"]):
        docs = spark.createDataFrame([(i, t, int(i > 0)) for i, t in enumerate(texts)], "id long, text string, extra long").coalesce(1)
        blocks = b.token_blocks(docs, 1 << 22)
        (row,) = b.packed.each(blocks.select("ids", "n_bytes", *b.CUT).toArrow().to_batches(), "ids", "n_bytes", *b.CUT)
        raw = [(t or "").encode() for t in texts]
        *want, words = b.tokens(raw)
        assert "texts" not in blocks.columns and row[0].tolist() == list(range(len(texts))) and row[1] == sum(map(len, raw))
        assert [x.tolist() for x in b.uncut(*row[2:])] == [*(x.tolist() for x in want), b.looks(words).tolist()]


def test_answers_are_joined_with_a_byte_a_word(spark, monkeypatch):
    """The last shuffle of blocks carries no hashes and looks, but what scoring needs of them; scores are those of brute force, also in several blocks."""
    joined, join = [], b.packed.with_answers
    monkeypatch.setattr(b.packed, "with_answers", lambda blocks, got: (joined.append(blocks), join(blocks, got))[1])
    texts = {i: f"the w{i % 7} of é{i % 3} {i} end END the" for i in range(60)} | {60: None, 61: "new-word 7"}
    docs = spark.createDataFrame([(i, t, int(zlib.crc32(str(i).encode()) % 10 != 0)) for i, t in texts.items()], "id long, text string, extra long")
    got = {r["id"]: {**r.asDict(), "held_out": r.extra == 0} for r in b.score_texts(docs, top=5, classes=2, block_bytes=300).collect()}
    check(got, texts)
    assert not {"keys", "looks"} & set(joined[0].columns)
    rows = joined[0].collect()
    assert len(rows) > 3
    for r in rows:
        at = b.places_of(bytes(r["at"]), len(r.kinds))
        kinds = np.frombuffer(bytes(r.kinds), np.uint8)[at]
        starts = np.cumsum(r.sizes) - r.sizes
        for i, s, n in zip(r.ids, starts, r.sizes):
            raw = [b.END if w is None else w.encode() for w in words(texts[i])]
            assert n == len(raw)
            for w, k in zip(raw, kinds[s : s + n].tolist()):
                assert (k == 2 + b.TAILS + 1) == (w == b.END)
                assert k < 2 or w == b.END or k == 2 + b.tail_of(w) + b.TO_PLACE


def test_a_null_id_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d"), (None, "a b c d"), (1 << 60 | 1, "x y")], "doc_id long, text string")
    got = as_dict(b.op10_class_bigrams(spark, saved(df, tmp_path)))
    check({"" if i is None else i: r for i, r in got.items()}, {1: "a b c d", "": "a b c d", 1 << 60 | 1: "x y"})
