"""Language-model scores by class-based bigrams (Brown's model with exchange clustering).

Every word of the training texts is put into one of ``classes`` classes by
exchange.  The commonest ``top`` words come first, in several sweeps: each in
turn moves to the class that raises the likelihood of the class bigrams most.
Then every other word is placed by the same measure in one pass against the
classes so found, by the classes of its neighbours throughout the corpus (those
outside the ``top`` count there by their look).  A text's score sums log10 of
class transition and of word emission probabilities over its words and its end.

Words not seen in training have tail classes by their look.  What precedes and
follows them, and how many there may be, is taken from words seen once, which
count in their own class and in their look's tail.

Counts cover every training text: words are hashed (64 bits) and counted by
packed exchange, each block getting the counts of just its own words; how often
each class is beside them goes the same way (at most two numbers a class, however
common a word is), and their classes come back.  Beyond ``packed.FAN`` hash
ranges both are merged by levels on the way.  Bigrams of the
``top`` words and of classes are summed in each task before they are shuffled;
only these matrices, of fixed size, and the ``top`` words reach the driver.

Defined cases: null and empty texts hold the end alone; rows are scored one by
one, so repeated rows repeat (and count as often in training); a null doc_id
counts as the empty string for the split; with no training text every token is
unknown; extra columns are ignored; an empty table gives no rows; texts of any
length are scored whole; equally common words go by their hash, and equal gains to
the class of smaller number.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import packed
from quillspark.llm.common import batch, fold_words, settings, slices, strings, swept, table, written

END = b" end"  # no word holds a space
END_KEY = np.uint64(xxhash.xxh3_64_intdigest(END))
UNSEEN, ONCE = 255, 128  # as a placed word's class: none, and a flag on it
TO_PLACE = 128  # a flag on a word's class before: it is of its look, and still to be placed
TAILS = 4
ADD = 0.1


def tail_of(word: bytes) -> int:
    """Words outside the vocabulary by their look: with digits, with bytes beyond ASCII, with signs, or plain."""
    if any(0x30 <= c <= 0x39 for c in word):
        return 0
    if not word.isascii():
        return 1
    return 3 if word.isalpha() else 2


def looks(words: list[bytes]) -> np.ndarray:
    """``tail_of`` each word."""
    if not words:
        return np.zeros(0, np.int64)
    flat, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    some = lambda x: np.logical_or.reduceat(x, np.cumsum(sizes) - sizes)
    low = flat | 0x20
    return np.where(some((flat >= 0x30) & (flat <= 0x39)), 0, np.where(some(flat >= 0x80), 1, np.where(some((low < 0x61) | (low > 0x7A)), 2, 3)))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of a block: each token's place among its sorted distinct hashes, tokens a text, the hashes, and the words in that order."""
    place: dict[bytes, int] = {}
    flat: list[int] = []
    sizes = []
    for t in texts:
        w = fold_words(t)
        w.append(END)
        flat += [place.setdefault(x, len(place)) for x in w]
        sizes.append(len(w))
    words = list(place)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    keys, at = np.unique(hashes, return_inverse=True)
    first = np.zeros(len(keys), np.int64)
    first[at] = np.arange(len(words))
    return at[np.array(flat, np.int64)], np.array(sizes, np.int64), keys, [words[i] for i in first]


TOKENS = "block string, ids array<long>, extra array<long>, n_bytes long, sizes array<long>, keys binary, looks binary, at binary"
TOKENS_ARROW = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("keys", "looks", "at"))])
CUT = ["sizes", "keys", "looks", "at"]


def token_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``packed.blocks`` of texts cut once for all passes: tokens a text, the sorted distinct hashes, their words' looks, and each token's place among them."""

    def deal(batches):
        for whole in batches:
            for b in slices(whole, "text", block_bytes):
                texts = strings(b["text"])
                at, sizes, keys, words = tokens(texts)
                yield batch(
                    TOKENS_ARROW, block=[uuid.uuid4().hex], ids=[b["id"].to_pylist()], extra=[b["extra"].to_pylist()], n_bytes=[sum(map(len, texts))], sizes=[sizes],
                    keys=[keys.astype("<u8").tobytes()], looks=[looks(words).astype(np.uint8).tobytes()], at=[at.astype("<u2" if len(keys) <= 1 << 16 else "<u4").tobytes()],
                )
        packed.trim_memory()

    rows = docs.select(F.col("id").cast("long").alias("id"), "text", F.col("extra").cast("long").alias("extra")).mapInArrow(deal, TOKENS)
    with settings(docs.sparkSession, {"parquet.block.size": str(8 << 20)}):  # blocks can then be dealt to many tasks when read again
        return written(rows, "tokens")


def places_of(at: bytes, words: int) -> np.ndarray:
    """Each token's place among a block's words, of which there are so many."""
    return np.frombuffer(at, "<u2" if words <= 1 << 16 else "<u4").astype(np.int64)


def uncut(sizes: np.ndarray, keys: bytes, look: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``tokens`` gives them, with looks in place of words."""
    return places_of(at, len(keys) // 8), sizes, np.frombuffer(keys, "<u8"), np.frombuffer(look, np.uint8).astype(np.int64)


def classed(blocks: DataFrame, seeds) -> DataFrame:
    """Blocks to be joined with answers: a byte a word in place of its hash and look, the class of a ``top`` word or the end, or the tail of one to be placed (flagged)."""
    kept = ["block", "ids", "extra", "sizes", "at"]

    def run(batches):
        s = pickle.loads(seeds.value)
        for b in batches:
            kinds = []
            for keys, look in zip(b["keys"], b["looks"]):
                c, rare = s.of(np.frombuffer(keys.as_buffer(), "<u8"), np.frombuffer(look.as_buffer(), np.uint8).astype(np.int64))
                kinds.append((c | rare * TO_PLACE).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(kinds, pa.binary())], names=[*kept, "kinds"])
        packed.trim_memory()

    return blocks.select(*kept, "keys", "looks").mapInArrow(run, "block string, ids array<long>, extra array<long>, sizes array<long>, at binary, kinds binary")


def count_kind(parts: int) -> str:
    """Of counts sent: a block's fit 32 bits, those merged of many blocks need not."""
    return "<i8" if parts > packed.FAN else "<u4"


def sends(blocks: DataFrame, parts: int) -> DataFrame:
    kind, coarse = count_kind(parts), min(parts, packed.FAN)

    def run(batches):
        for block, train, *cut in packed.each(batches, "block", "extra", *CUT):
            at, sizes, keys, _ = uncut(*cut)
            learned = np.repeat(train > 0, sizes)
            yield packed.sent(block, keys, np.bincount(at[learned], minlength=len(keys)), coarse, n_kind=kind)

    return blocks.select("block", "extra", *CUT).mapInArrow(run, packed.SENT)


def counted(sent: DataFrame, top: int, kind: str) -> DataFrame:
    """Answers to blocks, and per range its sum, number of known words and commonest words."""
    out = pa.schema([("block", pa.string()), ("part", pa.int32()), ("n", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("key", pa.int64()), ("count", pa.int64())])

    def answer(t: pa.Table) -> pa.Table:
        keys, sums, at, sizes = packed.totals(t, False, kind)
        given, ends = sums.astype("<u8")[at], np.cumsum(sizes)
        rows = [{"block": b, "part": p, "n": given[e - s : e].tobytes()} for b, p, s, e in zip(t["block"].to_pylist(), t["part"].to_pylist(), sizes, ends)]
        rows.append({"tokens": int(sums.sum()), "types": int((sums > 0).sum())})
        order = np.lexsort((keys, -sums))[:top]
        rows += [{"key": int(k), "count": int(n)} for k, n in zip(keys[order].view(np.int64), sums[order]) if n]
        packed.trim_memory()
        return pa.Table.from_pylist(rows, schema=out)

    return written(sent.groupBy("part").applyInArrow(answer, "block string, part int, n binary, tokens long, types long, key long, count long"), "counts")


def bigrams(blocks: DataFrame, vocabulary: np.ndarray, top: int) -> np.ndarray:
    """Counts of neighbours in training texts: vocabulary (by hash), tails, start and end; a matrix of fixed size."""
    size = top + TAILS + 2
    shared = blocks.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, m = shared.value, np.zeros(size * size, np.int64)
        for train, *cut in packed.each(batches, "extra", *CUT):
            at, sizes, keys, look = uncut(*cut)
            ids = symbol_of(keys, look, known, top)[at]
            before = np.concatenate([[top + TAILS], ids[:-1]])
            before[np.cumsum(sizes)[:-1]] = top + TAILS
            m += np.bincount((before * size + ids)[np.repeat(train > 0, sizes)], minlength=size * size)
        yield from by_row(m.reshape(size, size))

    return summed(blocks.select("extra", *CUT).mapInArrow(run, ROW), size)


ROW = "row int, at binary, n binary"
ROW_ARROW = pa.schema([("row", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])


def by_row(m: np.ndarray):
    """A task's matrix, sparse, a row each."""
    rows = np.flatnonzero(m.any(1))
    at = [np.flatnonzero(m[r]) for r in rows]
    yield batch(ROW_ARROW, row=rows, at=[a.astype("<u4").tobytes() for a in at], n=[m[r][a].astype("<i8").tobytes() for r, a in zip(rows, at)])


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' matrices."""

    def add(t: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(t["at"].to_pylist()), "<u4")
        n = np.frombuffer(b"".join(t["n"].to_pylist()), "<i8")
        sums = np.zeros(size, np.int64)
        np.add.at(sums, at, n)
        return pa.table({"row": t["row"][:1], "at": pa.array([b""], pa.binary()), "n": pa.array([sums.astype("<i8").tobytes()], pa.binary())})

    out = np.zeros((size, size), np.int64)
    for r in rows.groupBy("row").applyInArrow(add, ROW).toLocalIterator():
        out[r.row] = np.frombuffer(r.n, "<i8")
    return out


def symbol_of(keys, look, known: np.ndarray, top: int) -> np.ndarray:
    """``known``: sorted hashes; its places are the symbols, then come tails, start and end."""
    i = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    hit = known[i] == keys if len(known) else np.zeros(len(keys), bool)
    out = np.where(hit, i, 0).astype(np.int64)
    rest = np.flatnonzero(~hit)
    out[rest] = np.where(keys[rest] == END_KEY, top + TAILS + 1, top + look[rest])
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(m: np.ndarray, top: int, classes: int = 48, sweeps: int = 4) -> np.ndarray:
    """Class of each symbol: the vocabulary's words by exchange clustering, the others a class of their own each."""
    size = len(m)
    m = m.astype(np.float64)
    count = m.sum(0)
    cls = np.empty(size, np.int64)
    order = np.argsort(-count[:top], kind="stable")
    cls[order] = np.arange(top) % classes
    cls[top:] = classes + np.arange(size - top)
    k = classes + size - top
    one = np.zeros((size, k))
    one[np.arange(size), cls] = 1
    after, before = m @ one, m.T @ one  # of a word: what follows and precedes it, by class
    big = one.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not count[w]:
                continue
            a, own = cls[w], m[w, w]
            big[a] -= after[w]
            big[:, a] -= before[w]
            big[a, a] += own
            r, l = after[w].copy(), before[w].copy()  # without w itself, so for any class alike
            r[a] -= own
            l[a] -= own
            rows, cols = big[:classes], big[:, :classes].T
            gain = (xlogx(rows + r) - xlogx(rows)).sum(1) + (xlogx(cols + l) - xlogx(cols)).sum(1)
            d = np.arange(classes)
            corner = big[d, d]
            gain += xlogx(corner + r[d] + l[d] + own) - xlogx(corner) - (xlogx(corner + r[d]) - xlogx(corner)) - (xlogx(corner + l[d]) - xlogx(corner))
            out_, in_ = rows.sum(1), cols.sum(1)
            gain -= xlogx(out_ + r.sum() + own) - xlogx(out_) + xlogx(in_ + l.sum() + own) - xlogx(in_)
            b = int(np.argmax(gain))
            big[b] += r
            big[:, b] += l
            big[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                after[:, a] -= m[:, w]
                after[:, b] += m[:, w]
                before[:, a] -= m[w]
                before[:, b] += m[w]
        if moved <= top // 200:
            break
    return cls


class Seeds:
    """The ``top`` words' classes, and the bigrams of those classes, tails, start and end."""

    def __init__(self, known: np.ndarray, m: np.ndarray, top: int, classes: int):
        if not 0 < classes * (TAILS + 1) + TAILS + 2 <= 256:  # then codes of neighbours are below SEVERAL
            raise ValueError("classes and looks have to fit a byte")
        self.known, self.top, self.classes = known, top, classes
        self.cls = exchange(m, top, classes)
        self.size, self.start = classes + TAILS + 2, classes + TAILS
        one = np.zeros((len(m), self.size))
        one[np.arange(len(m)), self.cls] = 1
        self.big = one.T @ m.astype(float) @ one

    def of(self, keys: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's words their classes, tails where not of the ``top``; and which of them are still to be placed."""
        sym = symbol_of(keys, look, self.known, self.top)
        return self.cls[sym], (sym >= self.top) & (keys != END_KEY)


CONTEXT = "block string, part int, keys binary, n binary, near binary, more binary"
CONTEXT_ARROW = pa.schema([("block", pa.string()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "n", "near", "more"))])
SEVERAL = 128  # a flag on a neighbour's code: its count is among those in ``more``


class Near:
    """Words to be placed and the classes beside them: a code is the class before, or ``size`` more than the one after.

    ``keys`` are sorted hashes; ``word`` (a place among them), ``code`` and ``count`` list each word's distinct codes in order.
    """

    def __init__(self, keys: np.ndarray, word: np.ndarray, code: np.ndarray, count: np.ndarray, size: int):
        self.keys = keys
        pair, at = np.unique(word * 2 * size + code, return_inverse=True)
        self.word, self.code = pair // (2 * size), pair % (2 * size)
        self.count = np.bincount(at, count, len(pair)).astype(np.int64)

    def cut(self, edges: np.ndarray, used: list[int], whole: bool) -> dict[str, list[bytes]]:
        """Columns of rows with keys from ``edges[i]`` to ``edges[i + 1]``: the keys, codes a word, the codes, and counts above 1."""
        ends = np.searchsorted(self.word, np.arange(len(self.keys) + 1))
        several = self.count > 1
        ends_more = np.concatenate([[0], np.cumsum(several)])
        code, more = (self.code | several * SEVERAL).astype(np.uint8), self.count[several].astype("<u8" if whole else "<u4")
        n, keys = np.diff(ends).astype(np.uint8), key_bytes(self.keys, whole)
        spans = [(edges[i], edges[i + 1], ends[edges[i]], ends[edges[i + 1]]) for i in used]
        return {
            "keys": [keys[i:j].tobytes() for i, j, _, _ in spans], "n": [n[i:j].tobytes() for i, j, _, _ in spans],
            "near": [code[i:j].tobytes() for _, _, i, j in spans], "more": [more[ends_more[i] : ends_more[j]].tobytes() for _, _, i, j in spans],
        }


def key_bytes(keys: np.ndarray, whole: bool) -> np.ndarray:
    """Rows of bytes: whole hashes, or their lowest 40 bits where keys are not sent on to other ranges (more are the same in a range)."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if whole else 5]


def sent_keys(t: pa.Table, whole: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of one range: distinct keys, each sent key's place among them, and how many each row sent."""
    width = 8 if whole else 5
    raw = t["keys"].to_pylist()
    flat = np.zeros((sum(map(len, raw)) // width, 8), np.uint8)
    flat[:, :width] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    distinct, at = np.unique(flat.view("<u8").ravel(), return_inverse=True)
    return distinct, at, [len(x) // width for x in raw]


def all_near(t: pa.Table, size: int, whole: bool) -> tuple[Near, np.ndarray, list[int]]:
    """What a range's rows say together, with places and sizes as ``sent_keys`` gives."""
    distinct, at, sizes = sent_keys(t, whole)
    join = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
    code = join("near", "u1").astype(np.int64)
    count = np.ones(len(code), np.int64)
    count[code >= SEVERAL] = join("more", "<u8" if whole else "<u4")
    return Near(distinct, np.repeat(at, join("n", "u1")), code % SEVERAL, count, size), at, sizes


def contexts(blocks: DataFrame, seeds, parts: int) -> DataFrame:
    """What a block knows of its words to be placed, by hash range: key, and in training how often each class is before and after it."""
    whole, parts = parts > packed.FAN, min(parts, packed.FAN)

    def run(batches):
        s = pickle.loads(seeds.value)
        for block, train, *cut in packed.each(batches, "block", "extra", *CUT):
            at, sizes, keys, look = uncut(*cut)
            c, rare = s.of(keys, look)
            c_at = c[at]
            before = np.concatenate([[s.start], c_at[:-1]])
            before[np.cumsum(sizes)[:-1]] = s.start
            after = np.concatenate([c_at[1:], [s.start]])  # only of an end
            some = np.flatnonzero(np.repeat(train > 0, sizes) & rare[at])
            word = (np.cumsum(rare) - 1)[at[some]]
            near = Near(keys[rare], np.concatenate([word, word]), np.concatenate([before[some], s.size + after[some]]), np.ones(2 * len(some)), s.size)
            edges = np.searchsorted(packed.part_of(near.keys, parts), np.arange(parts + 1))
            used = [i for i in range(parts) if edges[i] < edges[i + 1]]
            yield batch(CONTEXT_ARROW, block=[block] * len(used), part=used, **near.cut(edges, used, whole))

    return blocks.select("block", "extra", *CUT).mapInArrow(run, CONTEXT)


def merging(size: int):
    """``fold`` and ``places`` of the packed exchange for what ``contexts`` sends."""

    def fold(t: pa.Table):
        near, _, _ = all_near(t, size, True)
        return near.keys, lambda edges, used: near.cut(edges, used, True)

    return fold, lambda t: sent_keys(t, True)[1:]


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, big: np.ndarray, classes: int, most: int = 40_000) -> tuple[np.ndarray, np.ndarray]:
    """Of words given by sorted ``(word, code, n)`` - neighbours of class ``code`` before, or ``code - len(big)`` after - the classes that raise the likelihood of ``big`` most."""
    beside = np.vstack([big[:, :classes], big[:classes].T])
    held, all_out, all_in = xlogx(beside), big[:classes].sum(1), big[:, :classes].sum(0)
    once = xlogx(beside + 1) - held
    words, starts = np.unique(word, return_index=True)
    ends = np.append(starts[1:], len(word))
    out, i = np.zeros(len(words), np.int64), 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        a, b = starts[i], ends[j - 1]
        gain = once[code[a:b]]
        more = np.flatnonzero(n[a:b] > 1)
        if len(more):
            x = code[a:b][more]
            gain[more] = xlogx(beside[x] + n[a:b][more][:, None]) - held[x]
        gain = np.add.reduceat(gain, starts[i:j] - a, axis=0)
        total = np.add.reduceat(n[a:b], starts[i:j] - a)[:, None] / 2  # a neighbour on either side
        gain -= xlogx(all_out + total) - xlogx(all_out) + xlogx(all_in + total) - xlogx(all_in)
        out[i:j] = gain.argmax(1)
        i = j
    return words, out


def placed(sent: DataFrame, seeds, whole: bool) -> DataFrame:
    """Answers to blocks: a byte a word, its class (flagged if it was seen once) or ``UNSEEN``; and per range how many words each class got."""

    def answer(t: pa.Table) -> pa.Table:
        s = pickle.loads(seeds.value)
        near, at, sizes = all_near(t, s.size, whole)
        words, cls = best_classes(near.word, near.code, near.count, s.big, s.classes)
        out = np.full(len(near.keys), UNSEEN, np.uint8)
        out[words] = cls
        out[np.bincount(near.word, near.count, len(near.keys)) == 2] |= ONCE  # one neighbour on either side
        out, ends = out[at], np.cumsum(sizes)
        packed.trim_memory()
        rows = [{"block": b, "part": p, "n": out[e - k : e].tobytes()} for b, p, k, e in zip(t["block"].to_pylist(), t["part"].to_pylist(), sizes, ends)]
        return pa.Table.from_pylist([*rows, {"types": np.bincount(cls, minlength=s.classes).tolist()}], schema=pa.schema([("block", pa.string()), ("part", pa.int32()), ("n", pa.binary()), ("types", pa.list_(pa.int64()))]))

    return written(sent.groupBy("part").applyInArrow(answer, "block string, part int, n binary, types array<long>"), "classes")


class ClassModel:
    """Log10 probabilities of class transitions and of words in their classes.

    ``big``: bigrams of classes, tails, start and end, where words seen once count as their tails too; ``types``: words a class.
    """

    def __init__(self, seeds: Seeds, big: np.ndarray, tokens: np.ndarray, types: np.ndarray):
        k, c = seeds.size, seeds.classes
        self.classes, self.size, self.start = c, k, seeds.start
        self.trans = np.log10((big + ADD) / (big.sum(1, keepdims=True) + ADD * k))
        below = np.ones(k)  # the end is its class' only token
        below[:c] = tokens[:c] + ADD * types
        below[c : c + TAILS] = ADD * (1 + big[:, c : c + TAILS].sum(0))  # as many may come anew as were seen once, and one
        self.below = np.log10(np.where(below > 0, below, 1.0))

    def score(self, seq: np.ndarray) -> float:
        """Of a text's marked classes, without the words' own counts."""
        c = own(seq, self.classes, self.size)
        before = np.concatenate([[self.start], c[:-1]])
        return float((self.trans[before, c] - self.below[c]).sum())


def own(seq: np.ndarray, classes: int, size: int) -> np.ndarray:
    """Classes of marked ones: from ``size`` on they are of words seen once, by look and class."""
    return np.where(seq < size, seq, (seq - size) % classes)


def transitions(rows: DataFrame, size: int, start: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of training texts' classes, and tokens a class. A word seen once counts again as its look's tail, before and after."""

    def run(batches):
        m, tokens = np.zeros((size, size), np.int64), np.zeros(size, np.int64)
        for b in (b for whole in batches for b in slices(whole, "seq", 128 << 10)):
            seq = [np.frombuffer(x, np.uint8).astype(np.int64) for x in b["seq"].to_pylist()]
            sizes, seq = np.array([len(x) for x in seq]), np.concatenate(seq)
            c = own(seq, classes, size)
            once = seq >= size
            tail = np.where(once, classes + (seq - size) // classes, c)
            tokens += np.bincount(c, minlength=size)
            starts = np.cumsum(sizes) - sizes
            first = np.zeros(len(seq), bool)
            first[starts] = True
            prior = lambda x, edge: np.where(first, edge, np.concatenate([[edge], x[:-1]]))
            c_, tail_, once_ = prior(c, start), prior(tail, start), prior(once, False)
            for which, x, y in ((slice(None), c_, c), (once, c_, tail), (once_, tail_, c), (once & once_, tail_, tail)):
                m += np.bincount((x * size + y)[which], minlength=size * size).reshape(size, size)
        packed.trim_memory()
        whole = np.vstack([np.hstack([m, np.zeros((size, 1), np.int64)]), np.append(tokens, 0)])
        yield from by_row(whole)

    out = summed(rows.filter("extra > 0").select("seq").mapInArrow(run, ROW), size + 1)
    return out[:size, :size], out[size, :size]


def score_texts(docs: DataFrame, top: int = 1000, classes: int = 48, block_bytes: int = 1 << 20, part_bytes: int = 8 << 20) -> DataFrame:
    """``docs(id, text, extra)``, extra 1 for training texts: id, extra, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = token_blocks(docs, block_bytes)
    with settings(docs.sparkSession, packed.FEW_BLOCKS):
        return block_scores(blocks, top, classes, block_bytes, part_bytes)


def block_scores(blocks: DataFrame, top: int, classes: int, block_bytes: int, part_bytes: int) -> DataFrame:
    """``score_texts`` of what is dealt into blocks."""
    spark = blocks.sparkSession
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = packed.parts_for(size, part_bytes)
    way, kind = packed.levels(parts, -(-int(size) // block_bytes), packed.FAN), count_kind(parts)
    fold, places = packed.summing(kind)
    last, steps = packed.climbed(sends(blocks, parts), way, fold, packed.SENT)
    counts = counted(last, top, kind)
    swept(spark)  # of what was sent, before more is
    sums = packed.descended(counts.filter("block IS NOT NULL").select("block", "part", "n"), steps, places, "<u8")
    total, types = (int(x or 0) for x in counts.agg(F.sum("tokens"), F.sum("types")).first())
    common = counts.filter(F.col("key").isNotNull() & (F.col("key") != int(END_KEY.view(np.int64)))).orderBy(F.desc("count"), "key").limit(top).select("key").collect()
    known = np.sort(np.array([r.key for r in common], np.int64).view(np.uint64))
    seeds = Seeds(known, bigrams(blocks, known, top), top, classes)
    shared = spark.sparkContext.broadcast(pickle.dumps(seeds))  # of fixed size
    fold, places = merging(seeds.size)
    last, steps = packed.climbed(contexts(blocks, shared, parts), way, fold, CONTEXT)
    answers = placed(last, shared, bool(way))
    swept(spark)
    found = packed.descended(answers.filter("block IS NOT NULL").select("block", "part", "n"), steps, places, "u1")
    schema = pa.schema([("id", pa.int64()), ("extra", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("words", pa.float64()), ("seq", pa.binary())])

    def mark(batches):
        s = pickle.loads(shared.value)
        for ids, train, sums, cls, sizes, at, kinds in packed.each(batches, "ids", "extra", "got", "cls", "sizes", "at", "kinds"):
            sums = packed.received(sums, "<u8").astype(np.float64)
            kinds = np.frombuffer(kinds, np.uint8).astype(np.int64)
            at, c, rare = places_of(at, len(kinds)), kinds % TO_PLACE, kinds >= TO_PLACE
            end = c == s.size - 1  # the end alone is of that class
            given, tail = packed.received(cls, "u1").astype(np.int64), c[rare] - s.classes
            c[rare] = np.where(given == UNSEEN, c[rare], np.where(given >= ONCE, s.size + tail * s.classes + given - ONCE, given))
            starts = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x[at], starts)
            counted_ = np.where(end, 0.0, np.log10(sums + ADD))
            seq = c[at].astype(np.uint8)
            yield batch(
                schema, id=ids, extra=train, n_tokens=sizes, n_known=add((sums > 0).astype(np.int64)), base_score=add(np.log10((sums + ADD) / (total + ADD * (types + 1)))), words=add(counted_),
                seq=[seq[i : i + n].tobytes() for i, n in zip(starts.tolist(), sizes.tolist())],
            )

    both = packed.with_answers(packed.with_answers(classed(blocks, shared), packed.gathered(sums, "got")), packed.gathered(found, "cls"))
    rows = written(both.select("ids", "extra", "got", "cls", "sizes", "at", "kinds").mapInArrow(mark, "id long, extra long, n_tokens long, n_known long, base_score double, words double, seq binary"), "marked")
    in_class = np.zeros(classes) + np.bincount(seeds.cls[: len(known)], minlength=classes)
    for r in answers.filter("types IS NOT NULL").select(F.posexplode("types").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():
        in_class[r.c] += r.n
    model = spark.sparkContext.broadcast(pickle.dumps(ClassModel(seeds, *transitions(rows, seeds.size, seeds.start, classes), in_class)))

    def run(batches):
        m = pickle.loads(model.value)
        for b in batches:
            score = [w + m.score(np.frombuffer(x, np.uint8).astype(np.int64)) for w, x in zip(b["words"].to_pylist(), b["seq"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("id", "extra", "n_tokens", "n_known")), pa.array([total] * b.num_rows, pa.int64()), b["base_score"], pa.array(score, pa.float64())], names=["id", "extra", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "id long, extra long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (rest != 0).cast("long").alias("extra"))
    return score_texts(docs).select(F.col("id").alias("doc_id"), (F.col("extra") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
