"""Packed exchange: counts of hashed keys over a whole corpus, given back in the order asked.

Texts are first dealt into blocks, written once to the shared folder, so that
later passes see the same blocks.  A block sends its distinct keys, packed by
hash range into one binary a range; a range's task counts each key over all
blocks and answers every block with as many counts, in the order sent.  A key
goes to its range at most once a block, however often it occurs, so very common
keys do not make a range large, and no row is made for a single key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import settings, slices, strings, trim_memory, written

SENT = "block string, part int, keys binary, n binary"
SENT_ARROW = pa.schema([("block", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
BLOCKS = "block string, ids array<long>, texts array<binary>, extra array<long>"
BLOCKS_ARROW = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary())), ("extra", pa.list_(pa.int64()))])


#: Keys of 128 bits, where a rare clash of 64 would make a wrong result.
WIDE = np.dtype([("high", "<u8"), ("low", "<u8")])
#: Ranges that a block sends to at most; finer ones are reached through merges of as many blocks.
FAN = 512
#: For stages over blocks: both sides of a Python task hold a batch, so one is made of few blocks.
FEW_BLOCKS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def blocks(docs: DataFrame, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs(id long, text, extra long)`` as rows of about ``block_bytes`` of text, written to the shared folder."""

    def deal(batches):
        for whole in batches:
            for b in slices(whole, "text", block_bytes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex], pa.string()), pa.array([b["id"].to_pylist()], pa.list_(pa.int64())), pa.array([strings(b["text"])], pa.list_(pa.binary())), pa.array([b["extra"].to_pylist()], pa.list_(pa.int64()))],
                    schema=BLOCKS_ARROW,
                )

    rows = docs.select(F.col("id").cast("long").alias("id"), "text", F.col("extra").cast("long").alias("extra")).mapInArrow(deal, BLOCKS)
    with settings(docs.sparkSession, {"parquet.block.size": str(8 << 20)}):  # blocks can then be dealt to many tasks when read again
        return written(rows, "blocks")


def each(batches, *names: str):
    """Rows as tuples, one at a time, so that a task holds one block's objects; lists of numbers as arrays, those with nulls as lists."""
    for b in batches:
        for i in range(b.num_rows):
            row = [b[n][i] for n in names]
            yield tuple(x.values.to_numpy() if pa.types.is_list(x.type) and pa.types.is_integer(x.type.value_type) and x.is_valid and not x.values.null_count else x.as_py() for x in row)
    trim_memory()


def parts_for(total_bytes: int, part_bytes: int = 8 << 20) -> int:
    """Hash ranges for a corpus of so many text bytes: in proportion, so a range's task has a bounded part."""
    return max(12, -(-int(total_bytes) // part_bytes))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and their counts; wide ones by both halves."""
    if keys.dtype != WIDE:
        return np.unique(keys, return_inverse=True, return_counts=True)
    order = np.lexsort((keys["low"], keys["high"]))
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ranked["high"][1:] != ranked["high"][:-1]) | (ranked["low"][1:] != ranked["low"][:-1])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at, np.bincount(at, minlength=int(new.sum()))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges by the upper 32 bits."""
    keys = keys["high"] if keys.dtype == WIDE else keys
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def sent(block: str, keys: np.ndarray, n: np.ndarray | None, parts: int, half: bool = False, n_kind: str = "<u4") -> pa.RecordBatch:
    """Rows for sorted distinct ``keys`` of a block, uint64 or ``WIDE``, with their counts there (of type ``n_kind``, at most its largest value; left out where all are 1).

    ``half`` sends the lower 32 bits: fit where a rare excess in a sum does no harm.
    """
    edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    used = [i for i in range(parts) if edges[i] < edges[i + 1]]
    cut = lambda a, kind: [a[edges[i] : edges[i + 1]].astype(kind).tobytes() for i in used]
    n = None if n is None or (n == 1).all() else n
    return pa.RecordBatch.from_pydict(
        {"block": [block] * len(used), "part": used, "keys": cut(keys, "<u4" if half else keys.dtype), "n": [None] * len(used) if n is None else cut(np.minimum(n, np.iinfo(n_kind).max), n_kind)}, schema=SENT_ARROW
    )


def totals(t: pa.Table, half: bool = False, n_kind: str = "<u4", wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of one range: distinct keys, their sums, each sent key's place among them, and how many each row sent."""
    raw, kind = t["keys"].to_pylist(), WIDE if wide else np.dtype("<u4" if half else "<u8")
    keys, sizes = np.frombuffer(b"".join(raw), kind), [len(x) // kind.itemsize for x in raw]
    found, at, times = distinct(keys)
    n = t["n"].to_pylist()
    if all(x is None for x in n):
        return found, times, at, sizes
    n = np.concatenate([np.ones(s, n_kind) if x is None else np.frombuffer(x, n_kind) for s, x in zip(sizes, n)])
    return found, np.bincount(at, n, len(found)).astype(np.int64), at, sizes


def answers(sends: DataFrame, give: Callable[[np.ndarray], np.ndarray], kind: str, half: bool = False, n_kind: str = "<u4", wide: bool = False) -> DataFrame:
    """``(block, part, n)``: the ranges' answers to blocks; ``give`` makes them of the sums."""

    def answer(t: pa.Table) -> pa.Table:
        _, sums, at, sizes = totals(t, half, n_kind, wide)
        out = give(sums).astype(kind)[at]
        del at, sums
        trim_memory()
        ends = np.cumsum(sizes)
        return pa.table({"block": t["block"], "part": t["part"], "n": pa.array([out[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())})

    return sends.groupBy("part").applyInArrow(answer, "block string, part int, n binary")


def levels(parts: int, blocks: int, fan: int = FAN) -> list[tuple[int, int, int]]:
    """Merges on the way to ``parts`` ranges: groups of blocks, ranges that they come from, and ranges that they go to.

    A level sends at most a row for each of its groups and ranges, ``fan`` a block.
    """
    out, at = [], min(parts, fan)
    while at < parts:
        blocks, to = max(1, -(-blocks // fan)), at * min(fan, -(-parts // at))
        out.append((blocks, at, to))
        at = to
    return out


def climbed(sends: DataFrame, way: list[tuple[int, int, int]], fold: Callable, schema: str) -> tuple[DataFrame, list[DataFrame]]:
    """What arrives at the finest ranges, and the sends of each level on the way.

    ``fold(table)`` gives the sorted distinct keys (uint64 or ``WIDE``) of what a group of
    blocks sends to a range, and ``cut(edges, used)`` with the columns of the rows
    that go on: of keys from ``edges[i]`` to ``edges[i + 1]`` for each i in ``used``.
    """

    def merging(fine: int, to: int):
        def merge(t: pa.Table) -> pa.Table:
            keys, cut = fold(t)
            c = int(t["part"][0].as_py())
            edges = np.searchsorted(part_of(keys, to) - np.uint64(c * fine), np.arange(fine + 1))  # by the place within the coarse range
            used = [i for i in range(fine) if edges[i] < edges[i + 1]]
            rows = {"block": pa.array([f"{t['g'][0].as_py()} {c}"] * len(used), pa.string()), "part": pa.array([c * fine + i for i in used], pa.int32())}
            return pa.table(rows | {name: pa.array(x, pa.binary()) for name, x in cut(edges, used).items()})

        return merge

    steps = []
    for groups, coarse, to in way:
        sends = written(sends.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups))), "sent")
        steps.append(sends)
        sends = sends.groupBy("g", "part").applyInArrow(merging(to // coarse, to), schema)
    return sends, steps


def descended(rows: DataFrame, steps: list[DataFrame], places: Callable, kind: str) -> DataFrame:
    """Answers ``(block, part, n)`` of the finest ranges, brought back to the blocks that asked; ``places(table)`` as ``climbed`` folds."""

    def back(t: pa.Table, found: pa.Table) -> pa.Table:
        at, sizes = places(t)
        order = np.argsort(np.array(found["at"][0].as_py())) if found.num_rows else []
        data = found["n"][0].as_py() if found.num_rows else []
        out, ends = np.frombuffer(b"".join(data[i] for i in order), kind)[at], np.cumsum(sizes)
        return pa.table({"block": t["block"], "part": t["part"], "n": pa.array([out[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())})

    for sends in reversed(steps):
        got = rows.groupBy("block").agg(F.collect_list(F.struct("part", "n")).alias("got"))
        got = got.select(F.split("block", " ")[0].cast("long").alias("g"), F.split("block", " ")[1].cast("int").alias("part"), F.transform("got", lambda x: x["part"]).alias("at"), F.transform("got", lambda x: x["n"]).alias("n"))
        rows = sends.groupBy("g", "part").cogroup(got.groupBy("g", "part")).applyInArrow(back, "block string, part int, n binary")
    return rows


def summing(n_kind: str, wide: bool = False) -> tuple[Callable, Callable]:
    """``fold`` and ``places`` for keys with counts of type ``n_kind``."""

    def fold(t: pa.Table):
        keys, sums, _, _ = totals(t, False, n_kind, wide)
        n = np.minimum(sums, np.iinfo(n_kind).max)
        return keys, lambda edges, used: {c: [x[edges[i] : edges[i + 1]].astype(k).tobytes() for i in used] for c, x, k in (("keys", keys, keys.dtype), ("n", n, n_kind))}

    return fold, lambda t: totals(t, False, n_kind, wide)[2:]


def merged_answers(sends: DataFrame, give: Callable[[np.ndarray], np.ndarray], kind: str, parts: int, blocks: int, n_kind: str = "<u4", fan: int = FAN, wide: bool = False) -> DataFrame:
    """``answers`` for any number of ranges and blocks, where whole keys were sent to at most ``fan`` coarse ranges.

    What ``fan`` blocks send to a coarse range is merged, sent on to the finer
    ranges within it as one block's, and so forth; answers come back the same way.
    So rows grow with blocks and levels, not with blocks times ranges.  A merge
    holds what ``fan`` blocks have in one range, about a block's keys.
    """
    fold, places = summing(n_kind, wide)
    last, steps = climbed(sends, levels(parts, blocks, fan), fold, SENT)
    return gathered(descended(answers(last, give, kind, n_kind=n_kind, wide=wide), steps, places, kind))


def gathered(rows: DataFrame, name: str = "got") -> DataFrame:
    """``(block, name array<struct<part, n>>)`` of answers ``(block, part, n)``."""
    return rows.groupBy("block").agg(F.collect_list(F.struct("part", "n")).alias(name))


def received(got: list[dict] | None, kind: str) -> np.ndarray:
    """A block's answers in the order of its sorted keys."""
    return np.frombuffer(b"".join(x["n"] for x in sorted(got or [], key=lambda x: x["part"])), kind)


def with_answers(blocks: DataFrame, got: DataFrame) -> DataFrame:
    return blocks.join(got.hint("shuffle_hash"), "block", "left")
