"""Language of texts, also code-switched ones, by a linear-chain CRF over words.

A word's features are its byte n-grams of 1 to 4 with the word's edges marked -
those at an edge are its affixes -, the whole word, and for every language whose
lexicon holds it that it does (or that none does).  A language's lexicon is the
words that its training texts hold ``LEAST`` times.  Features are hashed into
``2 ** bits`` weights a language.  Transition weights between
languages are learned with them: training sequences join runs of words from
documents of several languages, and the gradient is that of the conditional
likelihood, by forward-backward.

Training takes a bounded sample of labelled rows: at most ``per_language`` documents
of every language, those first by a hash of text and id.  A document is learned
from in runs of 12 words: all of them, or where it has more than ``most_runs``, as
many spread evenly over the whole text.
Every labelled language is learned.  Prediction covers every word of every text: forward-backward marginals, summed over words with letters; the
language of largest mean marginal is the answer and that mean its score.

Whether a text is of a learned language at all is another question, which
marginals between languages cannot answer: its share of 4-byte n-grams known
from the language of each word (as predicted, so mixed texts are spared) is held
against that of labelled texts left out when the n-grams were gathered.

Defined cases: ``und`` with score 0 for null, empty and letterless texts and
where nothing could be learned (no labelled text); rows are judged one by one;
ties go to the language first by name; extra columns are ignored; an empty table
gives no rows; texts of any length are predicted whole.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import batch, fold_words, mix64, slices, strings, table, trim_memory

UND = "und"
BITS = 18
GRAMS = (1, 2, 3, 4)
#: Words of a training run, and how often a lexicon's words are found in training.
RUN, LEAST = 12, 3


class Lexicon:
    """Which languages' lexica hold a word; words by hash."""

    def __init__(self, counts: list[dict[bytes, int]], least: int = LEAST):
        held = [{w for w, n in c.items() if n >= least} for c in counts]
        words = sorted(set().union(*held)) if held else []
        keys = hashed(words)
        order = np.argsort(keys)
        self.keys, self.languages = keys[order], np.array([[w in h for h in held] for w in words], bool).reshape(len(words), len(held))[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word, code)`` of words given by hash: a code for each language that holds it, 0 for none."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        word, language = np.nonzero(self.languages[at] & hit[:, None]) if len(self.keys) else (np.zeros(0, np.int64),) * 2
        none = np.flatnonzero(~hit)
        return np.concatenate([word, none]), np.concatenate([language + 1, np.zeros(len(none), np.int64)])


def hashed(words: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words], np.uint64) if words else np.zeros(0, np.uint64)


def features(words: list[bytes], bits: int = BITS, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: one flat array, and where each word's begin."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    flat = np.frombuffer(b"".join(marked) + b"\0" * 8, np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(word))  # bytes from here to the word's end
    out, owner = [], []
    code = np.zeros(len(word), np.uint64)
    for n in GRAMS:
        code = code | flat[n - 1 : n - 1 + len(word)] << np.uint64(8 * (n - 1))
        keep = left >= n
        out.append(code[keep] + np.uint64(n << 40))
        owner.append(word[keep])
    whole = hashed(words)
    held, code = lexicon.of(whole) if lexicon is not None else (np.zeros(0, np.int64),) * 2
    flat_out, owner = np.concatenate([*out, whole, code.astype(np.uint64) + np.uint64(9 << 40)]), np.concatenate([*owner, np.arange(len(words)), held])
    order = np.argsort(owner, kind="stable")
    slots = (mix64(flat_out[order]) >> np.uint64(64 - bits)).astype(np.int64)
    return slots, np.searchsorted(owner[order], np.arange(len(words)))


def emissions(words: list[bytes], weights: np.ndarray, lexicon: Lexicon | None = None) -> np.ndarray:
    """A row a word: its features' weights summed, by language; long words count by the mean of as many as 40."""
    slots, starts = features(words, lexicon=lexicon)
    sums = np.add.reduceat(weights[slots], starts, axis=0)
    n = np.diff(np.append(starts, len(slots)))
    return sums * np.minimum(1.0, 40.0 / n)[:, None].astype(np.float32)


def marginals(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each label at each step of padded sequences ``e[batch, step, label]``; forward and backward vectors too."""
    b, n, k = e.shape
    p = np.exp(e - e.max(2, keepdims=True))
    t = np.exp(trans)
    fwd, bwd = np.empty_like(p), np.ones_like(p)
    fwd[:, 0] = p[:, 0] / p[:, 0].sum(1, keepdims=True)
    for i in range(1, n):
        x = (fwd[:, i - 1] @ t) * p[:, i]
        fwd[:, i] = x / x.sum(1, keepdims=True)
    for i in range(n - 2, -1, -1):
        x = (p[:, i + 1] * bwd[:, i + 1]) @ t.T
        x /= x.sum(1, keepdims=True)
        bwd[:, i] = np.where((lengths > i + 1)[:, None], x, 1.0)
    post = fwd * bwd
    return post / post.sum(2, keepdims=True), fwd, bwd


def learn(samples: list[tuple[str, bytes]], languages: list[str], bits: int = BITS, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, Lexicon]:
    """Weights, transitions and lexica from labelled texts, by AdaGrad on the conditional likelihood."""
    k, rng = len(languages), np.random.default_rng(seed)
    halves, counts = [], [Counter() for _ in range(k)]
    for lang, text in samples:
        w, i = fold_words(text), languages.index(lang)
        counts[i].update(w)
        halves += [(i, w[j : j + RUN]) for j in range(0, len(w), RUN)]
    lexicon = Lexicon(counts)
    order = rng.permutation(len(halves))
    # A sequence is two runs: mostly of one language, at times of two, as in code-switched text.
    by: dict[int, list[list[bytes]]] = {i: [] for i in range(k)}
    for j in order:
        by[halves[j][0]].append(halves[j][1])
    sequences = []
    for i in range(k):
        r = by[i]
        for a in range(0, len(r) - 1, 2):
            sequences.append([(i, w) for w in r[a]] + [(i, w) for w in r[a + 1]])
    mixed = [halves[j] for j in order]
    for (i, a), (j, c) in list(zip(mixed[::6], mixed[1::6])):
        sequences.append([(i, w) for w in a] + [(j, w) for w in c])
    sequences = [s for s in sequences if s]
    weights, trans = np.zeros((1 << bits, k), np.float32), np.zeros((k, k), np.float64)
    g_w, g_t = np.full((1 << bits, k), 1e-3, np.float32), np.full((k, k), 1.0)
    for _ in range(epochs):
        deal = rng.permutation(len(sequences))
        for at in range(0, len(deal), 128):
            part = [sequences[i] for i in deal[at : at + 128]]
            lengths = np.array([len(s) for s in part])
            n = lengths.max()
            words = [w for s in part for _, w in s]
            slots, starts = features(words, bits, lexicon)
            sizes = np.diff(np.append(starts, len(slots)))
            scale = np.minimum(1.0, 40.0 / sizes).astype(np.float32)
            flat = np.add.reduceat(weights[slots], starts, axis=0) * scale[:, None]
            mask = np.arange(n) < lengths[:, None]
            e, y = np.zeros((len(part), n, k)), np.zeros((len(part), n), int)
            e[mask], y[mask] = flat, [i for s in part for i, _ in s]
            post, fwd, bwd = marginals(e, trans, lengths)
            error = post.copy()
            np.put_along_axis(error, y[..., None], np.take_along_axis(error, y[..., None], 2) - 1, 2)
            g = (error[mask].astype(np.float32) * scale[:, None]) / len(part)
            step = np.empty((1 << bits, k), np.float32)
            for c in range(k):
                step[:, c] = np.bincount(slots, np.repeat(g[:, c], sizes), 1 << bits)
            g_w += step * step
            weights -= 0.5 * step / np.sqrt(g_w)
            p = np.exp(e - e.max(2, keepdims=True))
            pair = fwd[:, :-1, :, None] * np.exp(trans) * (p * bwd)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            both = mask[:, 1:]
            want = np.zeros((k, k))
            np.add.at(want, (y[:, :-1][both], y[:, 1:][both]), 1)
            step_t = (pair[both].sum(0) - want) / len(part)
            g_t += step_t**2
            trans -= 0.3 * step_t / np.sqrt(g_t)
    return weights, trans, lexicon


def labelled(docs: DataFrame, per_language: int = 250, most_runs: int = 100) -> list[tuple[str, bytes]]:
    """At most ``per_language`` texts of every language, first by a hash of id and text, then by text; of each at most ``most_runs`` runs of words, from all over it.

    Labels are names of languages, some hundreds at most: their counts are broadcast, and each has a megabyte of weights.
    """
    some = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = some.groupBy("lang").count()
    # About three times as many as needed by a threshold on the hash, so that little is sorted.
    place = F.pmod("h", F.lit(1_000_003))
    near = some.join(F.broadcast(counts), "lang").filter(place * F.col("count") < F.lit(3 * per_language * 1_000_003)).select("lang", "text", "h")
    order = Window.partitionBy("lang").orderBy("h", "text")
    first = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)

    def spread(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                texts = []
                for t in strings(b["text"]):
                    w = fold_words(t)
                    n = -(-len(w) // RUN)
                    if n > most_runs:
                        w = [x for i in range(most_runs) for x in w[i * n // most_runs * RUN :][:RUN]]
                    texts.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays([b["lang"], b["n"], pa.array(texts, pa.binary())], names=["lang", "n", "words"])

    runs = first.select("lang", "n", "text").mapInArrow(spread, "lang string, n int, words binary")
    return [(r.lang, bytes(r.words)) for r in runs.orderBy("lang", "n").toLocalIterator()]


def fours(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-byte n-grams of words with their edges marked, and where each word's begin; shorter ones are filled up."""
    marked = [(b"\x02" + w + b"\x03").ljust(4, b"\0") for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    flat = np.frombuffer(b"".join(marked) + b"\0" * 3, np.uint8).astype(np.uint64)
    code = sum(flat[i : i + sizes.sum()] << np.uint64(8 * i) for i in range(4))
    ends = np.cumsum(sizes)
    keep = np.repeat(ends, sizes) - np.arange(len(code)) >= 4
    n = sizes - 3
    return (mix64(code[keep]) >> np.uint64(64 - BITS)).astype(np.int64), np.cumsum(n) - n


class Model:
    """Languages, hashed weights and transitions; predicts blocks of texts.

    ``known``: hashed n-grams of each language; ``least``: the share of them below which a text is of none (None: cannot be told).
    """

    def __init__(self, languages: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: Lexicon | None = None):
        self.languages, self.weights, self.trans, self.lexicon = languages, weights, trans, lexicon
        self.known, self.least = np.zeros((1 << BITS, len(languages)), bool), None

    def gather(self, samples: list[tuple[str, bytes]], least_texts: int = 5, least_grams: int = 100) -> None:
        """Known n-grams of four texts in five of each language, and what share of them the others have."""
        apart, at = [], dict.fromkeys(self.languages, 0)
        seen = [np.zeros(1 << BITS, np.int64) for _ in self.languages]
        for lang, text in samples:
            at[lang] += 1
            words = fold_words(text)
            if at[lang] % 5 == 0:
                apart.append(text)
            elif words:
                seen[self.languages.index(lang)] += np.bincount(fours(words)[0], minlength=1 << BITS)
        self.known = np.stack([x > 1 for x in seen], 1)
        shares = [have / n for *_, have, n in self.judged(apart) if n >= least_grams]
        if len(shares) >= least_texts:
            low = float(np.quantile(shares, 0.01))
            self.least = max(0.0, low - (1 - low) / 2)

    def fits(self, have: float, n: float) -> bool:
        """Whether a text with so many known of ``n`` n-grams may be of a learned language; short ones have the benefit of the doubt."""
        if self.least is None:
            return n > 0
        return n > 0 and have / n + 2 * float(np.sqrt(self.least * (1 - self.least) / n)) >= self.least

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        return [x[:2] for x in self.judged(texts)]

    def looked_up(self, words: list[bytes], some: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, known n-grams by language and all n-grams of each word, made for ``some`` words at a time."""
        out = []
        for at in range(0, len(words), some):
            part = words[at : at + some]
            grams, starts = fours(part)
            out.append((emissions(part, self.weights, self.lexicon), np.add.reduceat(self.known[grams].astype(np.int32), starts, axis=0), np.diff(np.append(starts, len(grams)))))
        return tuple(np.concatenate(x) for x in zip(*out))

    def judged(self, texts: list[bytes], most_cells: int = 400_000) -> list[tuple[str, float, float, float]]:
        """Language, score, known n-grams and all n-grams of each text."""
        cut = [fold_words(t) for t in texts]
        place: dict[bytes, int] = {}
        index = [[place.setdefault(w, len(place)) for w in c] for c in cut]
        letters = np.array([any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in place], bool)
        out: list[tuple[str, float, float, float]] = [(UND, 0.0, 0.0, 0.0)] * len(texts)
        index = [np.array(x, np.int64) for x in index]
        todo = [i for i, x in enumerate(index) if len(x) and letters[x].any()]
        if not self.languages or not todo:
            return out
        rows, have, n_grams = self.looked_up(list(place))
        todo.sort(key=lambda i: len(index[i]))
        while todo:
            n = len(index[todo[-1]])
            part = [todo.pop() for _ in range(min(len(todo), max(1, most_cells // n)))]
            lengths = np.array([len(index[i]) for i in part])
            mask = np.arange(n) < lengths[:, None]
            all_ = np.concatenate([index[i] for i in part])
            e = np.zeros((len(part), n, len(self.languages)), np.float32)
            e[mask] = rows[all_]
            counted = np.zeros((len(part), n), np.float32)
            counted[mask] = letters[all_]
            post, _, _ = marginals(e, self.trans.astype(np.float32), lengths)
            mean = (post * counted[..., None]).sum(1) / counted.sum(1, keepdims=True)
            with_letters, row = letters[all_], np.repeat(np.arange(len(part)), lengths)
            found = np.bincount(row, have[all_, post[mask].argmax(1)] * with_letters, len(part))
            total = np.bincount(row, n_grams[all_] * with_letters, len(part))
            for i, m, h, t in zip(part, mean.astype(float), found.tolist(), total.tolist()):
                best = int(np.argmax(m))
                out[i] = self.languages[best], float(min(1.0, m[best])), h, t
        return out


def train(labelled_docs: DataFrame, per_language: int = 250) -> Model:
    samples = labelled(labelled_docs, per_language)
    languages = sorted({x for x, _ in samples})
    if not languages:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((0, 0)))
    model = Model(languages, *learn(samples, languages))
    model.gather(samples)
    return model


def identify(docs: DataFrame, model: Model, fits: bool = False, text: bool = True) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (and ``fits``, whether any learned language does) to every row of ``docs``, by its text alone; columns of these names are replaced.

    Without ``text`` it is left out of the rows, and does not come back from Python.
    """
    from pyspark.sql import types as T

    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score", *["fits"] * fits)]
    back = [f for f in kept if text or f.name != "text"]
    schema = T.StructType([*back, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("fits", T.BooleanType())] * fits])
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # of fixed size: 2 ** BITS weights a language

    def run(batches):
        m = pickle.loads(shared.value)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                got = m.judged(strings(b["text"]))
                told = [pa.array([m.fits(h, n) for *_, h, n in got], pa.bool_())] if fits else []
                yield pa.RecordBatch.from_arrays([*(b[f.name] for f in back), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), *told], names=schema.names)
        m = whole = b = got = told = None  # what is still held cannot be given back
        trim_memory()  # workers live on from stage to stage

    return docs.select(*(docs[f"`{f.name}`"] for f in kept)).mapInArrow(run, schema)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
