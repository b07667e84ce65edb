"""Removal of long repeated substrings by a logarithmic family of suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts somewhere
else.  The index holds the suffixes at anchors only: the anchor of a window is
the place, among its first ``length - prefix + 1``, whose 16 bytes hash least
(leftmost first).  Equal windows have equal anchors at equal offsets, and the
``prefix`` bytes from there lie within both, so a window can be repeated only if
its anchor's suffix has a common prefix of ``prefix`` bytes with another.

*Family.*  Each new batch of texts gets a suffix array: its anchors' suffixes in
order of their first bytes, then of a hash of the prefix, equal ones counted.  It
is merge-scanned against every level, which gives the long matches, and levels
of equal rank are merged into one of the next, so there are at most log2 of the
number of batches.

*Verification.*  Matching anchors only name windows to look at.  These are compared
whole, by 128-bit hashes of their bytes under a secret drawn anew for each run,
with those of all other texts by packed exchange; texts cannot be made to clash
without the secret, and a clash by chance is not to be expected at any size that
can be stored.  Of equal texts one stands for all and every window of it is
repeated; texts are equal by SHA-256.

Anchors are about one in a hundred bytes and windows are looked at only near
long matches; very common passages take part once a block of texts.

Defined cases: an empty table gives no rows; a text of any length is one row of a
block and taken whole; a null text is empty; texts shorter than ``length`` keep all;
rows are judged one by one, so rows of equal text repeat each other, whatever
their ids; a null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from secrets import randbits

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import packed
from quillspark.llm.common import batch, discarded, mix64, table, written

LENGTH, PREFIX, GRAM = 400, 208, 16


class Hasher:
    """Hashes of all substrings of one length, by prefix sums modulo 2 ** 64."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers can be undone
        self.undo = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + n // 4, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.undo))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.up[: n - 1], dtype=np.uint64)])

    def of(self, sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return mix64((sums[at + length] - sums[at]) * self.down[at] + np.uint64(length))


def loads(raw: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of ``n`` places as little-endian numbers."""
    raw = raw + bytes(16)
    out = np.empty(n, "<u8")
    for o in range(min(8, n)):
        out[o::8] = np.frombuffer(raw, "<u8", len(range(o, n, 8)), o)
    return out


class Windows:
    """Windows of a block's texts that lie within one text, with their anchors."""

    def __init__(self, texts: list[bytes], length: int, prefix: int, hasher: Hasher):
        self.raw, self.length, self.prefix, self.hasher = b"".join(texts), length, prefix, hasher
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        n = len(self.raw)
        self.sums = hasher.sums(np.frombuffer(self.raw, np.uint8))
        count = np.maximum(0, self.sizes - length + 1)
        first = np.repeat(self.ends - self.sizes - (np.cumsum(count) - count), count)
        self.start = np.arange(count.sum()) + first  # of each window, in the block
        if not len(self.start):
            self.anchor = self.start
            return
        a = loads(self.raw, n)
        gram = mix64(a ^ mix64(np.concatenate([a[8:], np.zeros(min(8, n), np.uint64)]) + np.uint64(GRAM)))
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        width, reach = length - prefix + 1, 1
        while reach * 2 <= width:
            low[: n - reach] = np.minimum(low[: n - reach], low[reach:])
            reach *= 2
        rest = width - reach
        self.anchor = (np.minimum(low[self.start], low[self.start + rest]) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors' places and the hashes of their prefixes."""
        at = np.unique(self.anchor)
        return at, self.hasher.of(self.sums, at, self.prefix)

    def heads(self, at: np.ndarray) -> np.ndarray:
        """First eight bytes as signed numbers in the order of the bytes."""
        return (loads(self.raw, len(self.raw))[at].astype("<u8").byteswap() ^ np.uint64(1 << 63)).view(np.int64)

    def digests(self, at: np.ndarray, secret: int) -> np.ndarray:
        """128-bit hashes of the windows from ``at``."""
        view, digest, length = memoryview(self.raw), xxhash.xxh3_128_digest, self.length
        return np.frombuffer(b"".join([digest(view[i : i + length], secret) for i in at.tolist()]), packed.WIDE)

    def matched(self, keys: np.ndarray) -> np.ndarray:
        """Windows whose anchor's prefix is among ``keys``."""
        at, own = self.anchors()
        hit = np.zeros(len(self.raw) + 1, bool)
        hit[at[np.isin(own, keys)]] = True
        return self.start[hit[self.anchor]]


class SuffixFamily:
    """Levels of sorted suffix arrays ``(head, key, n)``; ``add`` scans, then merges equal ranks."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def array(suffixes: DataFrame) -> DataFrame:
        rows = suffixes.groupBy("head", "key").agg(F.sum("n").alias("n"))
        return written(rows.sortWithinPartitions("head", "key"), "suffixes")

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Takes a batch ``(head, key, n)`` in; returns the keys of its long matches, with itself and with all before."""
        new = self.array(suffixes)
        found = new.filter("n > 1").select("key")
        for _, level in self.levels:
            found = found.union(new.hint("merge").join(level.select("head", "key"), ["head", "key"]).select("key"))
        found = written(found.distinct(), "matches")
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, old = self.levels.pop()
            both = self.array(old.union(new))
            discarded(old, new)
            new, rank = both, rank + 1
        self.levels.append((rank, new))
        return found


def suffixes(blocks: DataFrame, length: int, prefix: int) -> DataFrame:
    """``(block, head, key, n)``: a block's distinct anchor suffixes with their counts there."""
    schema = pa.schema([("block", pa.string()), ("head", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        hasher = Hasher()
        for block, texts in packed.each(batches, "block", "texts"):
            w = Windows(texts, length, prefix, hasher)
            at, keys = w.anchors()
            keys, first, n = np.unique(keys, return_index=True, return_counts=True)
            yield batch(schema, block=[block] * len(keys), head=w.heads(at[first]) if len(at) else [], key=keys.view(np.int64), n=n)

    return blocks.select("block", "texts").mapInArrow(run, "block string, head long, key long, n long")


def narrowed(blocks: DataFrame, keys: DataFrame, length: int, prefix: int) -> DataFrame:
    """Blocks of the texts with matched windows only, and the keys that match there."""

    def run(batches):
        hasher = Hasher()
        for block, texts, keys in packed.each(batches, "block", "texts", "keys"):
            keys = np.sort(keys.view(np.uint64))
            w = Windows(texts, length, prefix, hasher)
            of = np.unique(np.searchsorted(w.ends, w.matched(keys), "right"))
            yield pa.RecordBatch.from_pydict({"block": [block], "texts": [[texts[i] for i in of]], "keys": [keys.view(np.int64)]}, schema=pa.schema([("block", pa.string()), ("texts", pa.list_(pa.binary())), ("keys", pa.list_(pa.int64()))]))

    joined = blocks.select("block", "texts").join(keys.hint("shuffle_hash"), "block")
    return written(joined.mapInArrow(run, "block string, texts array<binary>, keys array<long>"), "narrowed")


def repeated_spans(blocks: DataFrame, parts: int, number: int, length: int, prefix: int) -> DataFrame:
    """``(sig, spans array<int>, kept_sha256)`` of each text of narrowed blocks, about ``number`` of them: repeated runs as start, end, ..."""
    secret = randbits(64)

    def send(batches):
        hasher = Hasher()
        for block, texts, keys in packed.each(batches, "block", "texts", "keys"):
            w = Windows(texts, length, prefix, hasher)
            got, _, n = packed.distinct(w.digests(w.matched(keys.view(np.uint64)), secret))
            yield packed.sent(block, got, n, min(parts, packed.FAN), n_kind="u1")

    got = packed.merged_answers(blocks.mapInArrow(send, packed.SENT), lambda sums: sums > 1, "u1", parts, number, n_kind="u1", wide=True)
    schema = pa.schema([("sig", pa.string()), ("spans", pa.list_(pa.int32())), ("kept_sha256", pa.string())])

    def cut(batches):
        hasher = Hasher()
        for texts, keys, sums in packed.each(batches, "texts", "keys", "got"):
            w = Windows(texts, length, prefix, hasher)
            at = w.matched(keys.view(np.uint64))
            _, place, _ = packed.distinct(w.digests(at, secret))
            at = at[packed.received(sums, "u1")[place] > 0]
            of = np.searchsorted(w.ends, at, "right")
            sig, spans, kept = [], [], []
            for i, t in enumerate(texts):
                s = at[np.searchsorted(of, i) : np.searchsorted(of, i, "right")] - (w.ends[i] - w.sizes[i])
                new = np.flatnonzero(np.diff(s, prepend=-length - 1) > length)
                runs = [] if not len(s) else [x for p in zip(s[new].tolist(), (s[np.append(new[1:] - 1, len(s) - 1)] + length).tolist()) for x in p]
                sig.append(hashlib.sha256(t).hexdigest())
                spans.append(runs)
                kept.append(hashlib.sha256(b"".join(t[x:y] for x, y in zip([0, *runs[1::2]], [*runs[::2], len(t)]))).hexdigest())
            yield batch(schema, sig=sig, spans=spans, kept_sha256=kept)

    return packed.with_answers(blocks, got).mapInArrow(cut, "sig string, spans array<int>, kept_sha256 string")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, batches: int = 4, block_bytes: int = 1 << 20) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, spans (start, end, ... of what goes), kept_sha256."""
    sig = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    docs = docs.withColumn("node", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    signs = written(docs.select("doc_id", "node", "n_bytes", sig.alias("sig")), "signs")
    classes = signs.groupBy("sig").agg(F.min("node").alias("node"), F.count("*").alias("m"))
    reps = docs.filter(F.col("n_bytes") >= length).join(classes.select("node").distinct(), "node", "left_semi")
    blocks = packed.blocks(reps.select(F.col("node").alias("id"), "text", F.lit(0).alias("extra")), block_bytes)
    total = signs.agg(F.sum("n_bytes")).first()[0] or 0
    anchors = written(suffixes(blocks, length, prefix), "anchors")
    family = SuffixFamily()
    found = [family.add(anchors.filter(F.pmod(F.xxhash64("block"), F.lit(batches)) == i)) for i in range(batches)]
    matches = reduce(DataFrame.union, found).distinct()
    keys = anchors.select("block", "key").join(matches, "key", "left_semi").groupBy("block").agg(F.collect_list("key").alias("keys"))
    near = narrowed(blocks, keys, length, prefix)
    discarded(blocks, anchors, *found, *(level for _, level in family.levels))
    cut = repeated_spans(near, packed.parts_for(total), -(-int(total) // block_bytes), length, prefix)
    # Written, so that the join below can split the partition of a very common text.
    done = written(classes.join(cut.dropDuplicates(["sig"]), "sig", "left").select("sig", "m", "spans", "kept_sha256"), "spans")
    discarded(near)
    out = signs.join(done, "sig", "left")
    whole = (F.col("m") > 1) & (F.col("n_bytes") >= length)
    none = F.expr("cast(array() as array<int>)")
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.array(F.lit(0), F.col("n_bytes").cast("int"))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sig")).alias("kept_sha256"),
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(sequence(0, size(spans) div 2 - 1), 0L, (a, i) -> a + spans[2 * i + 1] - spans[2 * i])")
    return out.select(
        "doc_id", "n_bytes", F.when(F.size("spans") > 0, removed).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256",
    )
