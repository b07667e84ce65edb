import hashlib
import itertools
import zlib

import numpy as np

from quillspark.llm import langid as g
from tests.llm.helpers import AWKWARD, as_dict, documents, saved

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = as_dict(g.op4_language(spark, SF))
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97


def test_code_switched_words_get_their_own_labels(spark):
    model = g.train(spark.read.parquet(f"{SF}/documents.parquet"), 60)
    some = {lang: text for lang, text in g.labelled(spark.read.parquet(f"{SF}/documents.parquet"), 3)}
    a, b = (g.fold_words(some[x])[:40] for x in ("de", "fr"))
    e = g.emissions(a + b, model.weights)[None]
    post, _, _ = g.marginals(e, model.trans, np.array([len(a) + len(b)]))
    best = [model.languages[i] for i in post[0].argmax(1)]
    assert np.mean([x == "de" for x in best[: len(a)]]) > 0.8 and np.mean([x == "fr" for x in best[len(a) :]]) > 0.8


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, t, lengths = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), np.array([4, 2])
    got, _, _ = g.marginals(e, t, lengths)
    for row, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(e[row, i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(got[row, :n], want / want.sum(1, keepdims=True))


def test_edge_cases(spark, tmp_path):
    docs = documents(spark, [*AWKWARD, "123 ... 456", "der und die Katze"])
    got = as_dict(g.op4_language(spark, saved(docs, tmp_path)))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 3, len(AWKWARD)))
    assert all(r["lang_pred"] in ("en", "und") for r in got.values())
    from pyspark.sql import functions as F

    none = as_dict(g.op4_language(spark, saved(docs.withColumn("lang", F.lit(None).cast("string")), tmp_path / "n")))
    assert {r["lang_pred"] for r in none.values()} == {"und"}
    assert g.op4_language(spark, saved(docs.limit(0), tmp_path / "e")).count() == 0


def test_every_language_is_learned_from_an_ordered_sample(spark):
    rows = [(i, f"w{i % 70}a w{i % 70}b w{i % 70}c " * 5 + f"n{i}", f"l{i % 70:02d}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = g.labelled(df, 4), g.labelled(df.repartition(7), 4)
    assert one == two and len(one) == 280 and len({x for x, _ in one}) == 70
    model = g.train(df, 4)
    assert len(model.languages) == 70 and model.predict([b"w69a w69b w69c w69a w69b"])[0][0] == "l69"
    assert max(len(t) for _, t in g.labelled(spark.createDataFrame([(1, "x " * 300_000, "en")], "doc_id long, text string, lang string"))) == 2 * 1200 - 1


def plain(model, text):
    """Language and score word by word in plain loops: features, forward-backward by sums of products, means over words with letters."""
    words = g.fold_words((text or "").encode())
    k = len(model.languages)
    slot = lambda x: int(g.mix64(np.array([x % (1 << 64)], np.uint64))[0] >> np.uint64(64 - g.BITS))
    lexica = {int(key): [i for i, x in enumerate(row) if x] for key, row in zip(model.lexicon.keys, model.lexicon.languages)}
    rows, letters = [], []
    for w in words:
        marked, slots = b"\x02" + w + b"\x03", []
        for n in (1, 2, 3, 4):
            slots += [slot(int.from_bytes(marked[i : i + n], "little") + (n << 40)) for i in range(len(marked) - n + 1)]
        key = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        slots.append(slot(key))
        slots += [slot((9 << 40) + i + 1) for i in lexica[key]] if key in lexica else [slot(9 << 40)]
        rows.append(model.weights[slots].astype(float).sum(0) * min(1.0, 40 / len(slots)))
        letters.append(any(c.isalpha() for c in w.decode("utf-8", "replace")))
    if not any(letters):
        return "und", 0.0
    t, p = np.exp(model.trans), [np.exp(r - r.max()) for r in rows]
    fwd, bwd = [p[0]], [np.ones(k)]
    for x in p[1:]:
        nxt = np.array([sum(fwd[-1][a] * t[a, b] for a in range(k)) * x[b] for b in range(k)])
        fwd.append(nxt / nxt.sum())
    for x in reversed(p[1:]):
        nxt = np.array([sum(t[a, b] * x[b] * bwd[0][b] for b in range(k)) for a in range(k)])
        bwd.insert(0, nxt / nxt.sum())
    post = [f * b / (f * b).sum() for f, b in zip(fwd, bwd)]
    mean = sum(q for q, x in zip(post, letters) if x) / sum(letters)
    return model.languages[int(mean.argmax())], float(mean.max())


def test_predictions_equal_brute_force(spark, tmp_path):
    """A small table: learned as the query learns, then every text predicted in plain loops."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id % 7 = 0 AND length(text) < 3000").collect()
    texts = [(r.doc_id, r.text, r.lang) for r in rows] + [(10**6 + i, t, None) for i, t in enumerate([*AWKWARD, "12 34 .. --", "mixed: der Hund und the dog le chien"])]
    folder = saved(spark.createDataFrame(texts, "doc_id long, text string, lang string"), tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = g.train(docs.filter(~g.held_out(docs["doc_id"])))
    got = as_dict(g.op4_language(spark, folder))
    assert len(got) == len(texts) and model.lexicon.languages.any(0).all()
    for i, t, _ in texts:
        lang, score = plain(model, t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-3, (i, got[i], lang, score)


def test_lexica_hold_what_training_texts_repeat():
    x = g.Lexicon([{b"der": 5, b"und": 3, b"rar": 2}, {b"the": 9, b"und": 4}])
    word, code = x.of(g.hashed([b"der", b"und", b"the", b"rar", b"new"]))
    assert sorted(zip(word.tolist(), code.tolist())) == [(0, 1), (1, 1), (1, 2), (2, 2), (3, 0), (4, 0)]
    assert g.Lexicon([]).of(g.hashed([b"a"]))[1].tolist() == [0]


def test_long_texts_are_learned_from_all_over_and_predicted_whole(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long, "xx"), (2, "kurz und gut", "de")], "doc_id long, text string, lang string")
    words = {lang: t.split() for lang, t in g.labelled(docs, most_runs=10)}
    assert len(words["xx"]) == 120 and words["xx"][0] == b"w0" and int(words["xx"][-1][1:]) > 50_000 and words["de"] == [b"kurz", b"und", b"gut"]
    model = g.train(spark.read.parquet(f"{SF}/documents.parquet"), 40)
    some = {lang: t.decode() for lang, t in g.labelled(spark.read.parquet(f"{SF}/documents.parquet"), 2)}
    turns = some["en"] + " " + (some["de"] + " ") * (2_000_000 // len(some["de"]))
    assert model.predict([turns.encode()])[0][0] == "de"
