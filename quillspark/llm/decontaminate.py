"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows (13 consecutive words, or the whole item if shorter) must be
wholly contained in a document to count, so by the prefix filter one token of
each window is necessary: its rarest by the corpus' own counts.  Documents are
probed by these tokens only; a hit at a word fixes where the window would begin
(positional bound) and that it must end within the document (length bound), and
then the words themselves are compared.

The window index is sent to every task while it holds at most ``most_windows``
windows, a proven bound; more windows are taken in blocks of that size, each
with a pass of its own, and the hits are united by document, so the result is
the same and no task ever holds more than one block.

Defined cases: a null or wordless text has no words and is never contaminated;
items without words or with a null id are ignored; repeated item ids count
once; document rows are judged one by one, so repeated rows repeat; texts of any
length are taken whole; without items or documents there are no hits or no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ALNUM_FOLD, batch, fold_words, strings, table, written

WINDOW = 13


def words_of(text: bytes) -> list[bytes]:
    return fold_words(text, ALNUM_FOLD)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item_id string, window binary)``: each distinct window of each item, words joined by a space."""
    schema = pa.schema([("item_id", pa.string()), ("window", pa.binary())])

    def cut(batches):
        for b in batches:
            ids, out = [], []
            for item, text in zip(b["item_id"].to_pylist(), strings(b["text"])):
                w = words_of(text)
                for x in {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
                    ids.append(item)
                    out.append(x)
            yield batch(schema, item_id=ids, window=out)

    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(cut, "item_id string, window binary").distinct()


def rarity(docs: DataFrame, vocabulary) -> dict[bytes, int]:
    """How often each word of a block's vocabulary stands in the documents (all of them)."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        known, seen = vocabulary.value, Counter()
        for b in batches:
            for text in strings(b["text"]):
                seen.update(filter(known.__contains__, words_of(text)))
        yield batch(schema, word=list(seen), n=list(seen.values()))

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.toLocalIterator()}


def index_of(block: list[tuple[str, bytes]], seen: dict[bytes, int]) -> dict:
    """necessary word -> list of (its offset, words in the window, {window: item numbers}); and the items."""
    items = sorted({i for i, _ in block})
    number = {x: n for n, x in enumerate(items)}
    by: dict[bytes, dict] = defaultdict(lambda: defaultdict(list))
    for item, window in block:
        w = window.split(b" ")
        k = min(range(len(w)), key=lambda i: (seen.get(w[i], 0), w[i], i))
        by[w[k]][k, len(w)].append((window, number[item]))
    out = {}
    for word, forms in by.items():
        out[word] = []
        for (k, n), found in forms.items():
            d: dict[bytes, list[int]] = defaultdict(list)
            for window, i in found:
                d[window].append(i)
            out[word].append((k, n, dict(d)))
    return {"keys": out, "items": items}


def hits(words: list[bytes], keys: dict) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word ranges that windows cover, and the numbers of their items."""
    ranges, items, total = [], set(), len(words)
    for i in [i for i, w in enumerate(words) if w in keys]:
        for k, n, found in keys[words[i]]:
            start = i - k
            if start >= 0 and start + n <= total and (x := found.get(b" ".join(words[start : start + n]))):
                ranges.append((start, start + n))
                items.update(x)
    ranges.sort()
    merged: list[tuple[int, int]] = []
    for s, e in ranges:
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged, items


def probe(docs: DataFrame, index, size: int = WINDOW) -> DataFrame:
    """Per document row: n_words, the hit ranges (flat start, end, ...) and the ids of the items found."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("n_words", pa.int64()), ("ranges", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def scan(batches):
        keys, names = index.value["keys"], index.value["items"]
        for b in batches:
            n, ranges, items = [], [], []
            for text in strings(b["text"]):
                w = words_of(text)
                r, i = hits(w, keys)
                n.append(len(w))
                ranges.append([x for pair in r for x in pair])
                items.append([names[x] for x in i])
            yield batch(schema, doc_id=b["doc_id"].to_pylist(), row=b["row"].to_pylist(), n_words=n, ranges=ranges, items=items)

    return docs.mapInArrow(scan, "doc_id long, row string, n_words long, ranges array<int>, items array<string>")


def covered(ranges):
    """Words in a union of ranges, each ``(s, e)``, sorted by start."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["to"], x["e"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(ranges), start, step, lambda a: a["n"])


def contained_windows(docs: DataFrame, items: DataFrame, size: int = WINDOW, most_windows: int = 200_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit and the sorted ids of the items with a window in it."""
    spark = docs.sparkSession
    wins = written(windows(items, size), "windows")
    n_blocks = max(1, -(-wins.count() // most_windows))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        (F.lit("") if n_blocks == 1 else F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), F.coalesce("text", F.lit(""))))).alias("row"),
    )
    pairs = F.when(F.size("ranges") > 0, F.expr(
        "transform(sequence(0, cast(size(ranges) / 2 as int) - 1), i -> named_struct('s', ranges[2 * i], 'e', ranges[2 * i + 1]))"
    )).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))
    out = None
    for n in range(n_blocks):
        part = wins if n_blocks == 1 else wins.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == n)
        block = [(r.item_id, bytes(r.window)) for r in part.toLocalIterator()]
        vocabulary = spark.sparkContext.broadcast(frozenset(x for _, w in block for x in w.split(b" ")))
        index = spark.sparkContext.broadcast(index_of(block, rarity(docs, vocabulary)))
        found = probe(keyed, index, size)
        if n_blocks == 1:
            return found.select("doc_id", "n_words", covered(pairs).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
        found = written(found.withColumn("ranges", pairs), "hits")
        more = found.filter(F.size("items") > 0).dropDuplicates(["row"]).select("row", "ranges", "items")
        out = (found.select("doc_id", "row", "n_words"), more) if out is None else (out[0], out[1].union(more))
    base, more = out
    more = more.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return base.join(more, "row", "left").select(
        "doc_id", "n_words",
        F.coalesce(covered(F.col("ranges")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def contaminated(n_hit, n_words):
    """The contract's rule: at least a twentieth of the words, and any at all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contained_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
