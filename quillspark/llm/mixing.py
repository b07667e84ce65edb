"""Mixing sources to target weights by entropy balancing.

Every source gets a target of words: its weight's share of the whole mix, at most
``most`` times what it has, what is above that dealt to the others by weight.
Document rates ``r`` are those of least relative entropy to one copy each,
``sum(r log r - r)``, among all that meet the targets ``sum(size * r) = target``
with ``r <= most``.  They are exponentially tilted, ``r = min(most, exp(tilt *
size))`` with one multiplier a source, found where the convex dual's gradient is
zero: all sources take Newton steps at once, within brackets that halve where a
step would leave them.  Documents of one source and size have one rate, so the
steps run over counts by (source, size), a table far smaller than the corpus.

*Copies.*  A source's sizes are gone through from large to small; each is rounded
to whole copies of all its documents together, down or up so that the words over
or under, carried along, are fewest.  What is left at the end is made up where it
fits, again from large to small, and by exchanging a copy of one size for one of
another, so a source of more than a few documents hits its target to a thousandth.  Within a size, all
documents get the same number of copies but for some that get one more: those of
smallest hash of doc_id within parts that split any number of equal sizes.

*Skew.*  The sums are pre-aggregated; documents are dealt by (source, size, part),
never by source alone.  What is gone through in one task is a source's distinct
sizes, at most the square root of twice its words.  Sums are of decimals, so their
order does not matter and reruns agree.

Defined cases: a null or wordless text has size 0 and is not taken; null is a
source of its own, after all others; rows of equal doc_id count one by one, and
which of them gets the further copy is the same for rows that are the same; an
empty table gives no rows; a source without words has target 0; extra columns are
ignored; texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import discarded, table, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of a part, about: so many parts split every size.
PART = 100_000
ROUNDS = 200
#: Copies of two sizes are exchanged until a source is as near to its target as this share of it.
CLOSE = 0.001
KEY = ["nul", "src"]


def word_count(text):
    """Runs of what is neither space nor tab to carriage return, in constant memory a text."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last: a distributed sort, then offsets of its partitions."""
    m = F.col("m")
    ordered = written(sources.orderBy(*KEY).withColumn("m", F.monotonically_increasing_id()), "sources")
    parts = ordered.groupBy(F.shiftright(m, 33).alias("p")).agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(W.orderBy("p")) - F.col("n"))  # a row for each partition of the sort
    return ordered.withColumn("p", F.shiftright(m, 33)).join(before, "p").withColumn("rank", F.col("before") + m.bitwiseAND((1 << 33) - 1)).drop("p", "n", "before", "m")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources(nul, src, source_size)`` with ``target``: shares by weight, none above ``most`` times its source."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = written(numbered(sources).withColumns({"weight": weight, "bound": F.col("source_size").cast("double") * most}), "weighed")
    whole = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("bound")
        found = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("bound")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if found[0] in (full, None) or not found[2]:
            break
        full, level = found[0], (whole - found[1]) / found[2]
    asked = F.least("bound", F.col("weight") * level) if full >= 0 else F.col("bound")
    return rows.withColumn("target", asked).drop("weight")


def tilts(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``(nul, src, tilt)`` of every source with words; infinite where all or nothing is taken."""
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    told = cells.groupBy(*KEY).agg(F.min("size").cast("double").alias("low"), F.max("size").cast("double").alias("high"), F.sum((F.col("n") * F.col("size")).cast("decimal(38,0)") * F.col("size")).cast("double").alias("square"))
    s = sources.filter("source_size > 0").join(told, KEY).withColumn("ratio", F.col("target") / F.col("source_size"))
    log, closed = F.log("ratio"), (F.col("ratio") <= 0) | (F.col("target") >= F.col("bound") * (1 - 1e-12))
    up = F.col("ratio") > 1
    # A document's rate is between those of the source's smallest and largest: the multiplier lies between what either alone would need.
    state = s.select(
        *KEY, "target",
        F.when(F.col("ratio") <= 0, F.lit(float("-inf"))).when(closed, F.lit(float("inf"))).otherwise(log * F.col("source_size") / F.col("square")).alias("tilt"),
        F.when(~closed, F.when(up, log / F.col("high")).otherwise(log / F.col("low"))).alias("lo"), F.when(~closed, F.when(up, F.log(F.lit(float(most))) / F.col("low")).otherwise(log / F.col("high"))).alias("hi"), closed.alias("done"),
    )
    state = written(state, "tilts")
    for _ in range(ROUNDS):
        if not state.filter("NOT done").limit(1).count():
            return state.select(*KEY, "tilt")
        rate = F.exp(F.col("tilt") * size)
        exact = lambda c: F.sum(c.cast("decimal(38,6)"))
        open_ = cells.join(state.filter("NOT done").select(*KEY, "tilt"), KEY)
        g = open_.groupBy(*KEY).agg(exact(n * size * F.least(F.lit(float(most)), rate)).cast("double").alias("got"), exact(F.when(rate < most, n * size * size * rate).otherwise(F.lit(0.0))).cast("double").alias("slope"))
        x = state.join(g, KEY, "left").withColumn("miss", F.col("got") - F.col("target"))
        lo, hi = F.when(F.col("miss") < 0, F.greatest("lo", "tilt")).otherwise(F.col("lo")), F.when(F.col("miss") > 0, F.least("hi", "tilt")).otherwise(F.col("hi"))
        x = x.withColumns({"lo": lo, "hi": hi}).withColumn("step", F.when(F.col("slope") > 0, F.col("tilt") - F.col("miss") / F.col("slope")))
        half = F.when(F.col("lo") > 0, F.sqrt(F.col("lo") * F.col("hi"))).otherwise(-F.sqrt(F.col("lo") * F.col("hi")))
        met = F.coalesce((F.abs("miss") <= F.col("target") * 1e-9 + 1e-3) | (F.abs(F.col("hi") - F.col("lo")) <= F.abs("hi") * 1e-14), F.lit(False))
        tilt = F.when(F.col("done") | met, F.col("tilt")).when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise(half)
        new = written(x.select(*KEY, "target", tilt.alias("tilt"), "lo", "hi", (F.col("done") | met).alias("done")), "tilts")
        discarded(state)
        state = new
    raise RuntimeError("tilts did not settle")


def copies(cells: DataFrame, most: int = MOST) -> DataFrame:
    """``(nul, src, size, n, k)``: copies of all documents of a size together; ``cells`` have their ``rate``."""
    schema = "nul boolean, src string, size long, n long, k long"

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        sizes, many, out, left = rows["size"].tolist(), rows["n"].tolist(), [], 0.0
        for size, n, rate in zip(sizes, many, rows["rate"].tolist()):
            k = int(n * rate)
            k += abs(left + (n * rate - k - 1) * size) < abs(left + (n * rate - k) * size)  # down, or up where that leaves less
            left += (n * rate - k) * size
            out.append(k)
        for i, (size, n) in enumerate(zip(sizes, many)):
            k = min(max(out[i] + round(left / size), 0), most * n)
            left -= (k - out[i]) * size
            out[i] = k
        size, n, k = np.array(sizes[::-1]), np.array(many[::-1]), np.array(out[::-1])
        while abs(left) > CLOSE * abs(k @ size + left):
            more, less = size[k < most * n], size[k > 0]
            if not len(more) or not len(less):
                break
            at = np.searchsorted(more, less + left)
            near = np.stack([more[np.clip(at + d, 0, len(more) - 1)] - less for d in (-1, 0)])
            side, j = np.unravel_index(np.abs(left - near).argmin(), near.shape)
            gain = int(near[side, j])
            if abs(left - gain) >= abs(left):
                break
            k[np.searchsorted(size, less[j] + gain)] += 1
            k[np.searchsorted(size, less[j])] -= 1
            left -= gain
        out = k[::-1].tolist()
        return rows.assign(k=out)[["nul", "src", "size", "n", "k"]]

    return cells.select(*KEY, "size", "n", F.round("rate", 9).alias("rate")).groupBy(*KEY).applyInPandas(carry, schema)


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: doc_id, source, size, source_size, target, rate, copies, taken."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("src"), word_count(F.col("text")).alias("size"))
    rows = rows.select("doc_id", F.col("src").isNull().alias("nul"), F.coalesce("src", F.lit("")).alias("src"), "size", F.xxhash64("doc_id").alias("h"))
    rows = written(rows, "sizes")
    parts = max(16, rows.count() // PART)
    rows = rows.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    counts = written(rows.groupBy(*KEY, "size", "part").agg(F.count("*").alias("m")), "counts")
    sources = counts.groupBy(*KEY).agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    sources = written(targets(sources, weights, share, most), "targets")
    cells = written(counts.filter("size > 0").groupBy(*KEY, "size").agg(F.sum("m").alias("n")), "cells")
    rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size")))
    rated = written(cells.join(tilts(cells, sources, most), KEY).withColumn("rate", rate), "rates")
    whole = written(copies(rated, most).join(rated.select(*KEY, "size", "rate"), [*KEY, "size"]), "copies")
    # Of a size's further copies every part gets its share; running sums over the parts leave none out.
    upto = F.sum("m").over(W.partitionBy(*KEY, "size").orderBy("part")).cast("decimal(20,0)")
    more = (F.col("k") % F.col("n")).cast("decimal(18,0)")
    dealt = counts.join(whole, [*KEY, "size"]).withColumns({"upto": upto, "more": more, "each": F.expr("k div n")})
    dealt = dealt.withColumn("extra", F.expr("cast((more * upto) div n - (more * (upto - m)) div n as long)"))
    dealt = dealt.join(sources, KEY).select(*KEY, "size", "part", "each", "extra", "rate")
    place = F.row_number().over(W.partitionBy(*KEY, "size", "part").orderBy("h", "doc_id"))
    out = rows.join(dealt, [*KEY, "size", "part"], "left").withColumn("copies", F.coalesce(F.col("each") + (place <= F.col("extra")).cast("long"), F.lit(0).cast("long")))
    out = out.join(sources.select(*KEY, "source_size", "target"), KEY)
    return out.select(
        "doc_id", F.when(~F.col("nul"), F.col("src")).alias("source"), "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"),
    )


def drawn(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it is taken, with the copy's number; ids that repeat are not told apart and stay as often as their rows were given."""
    n = mix.groupBy("doc_id").agg(F.max("copies").alias("copies")).withColumnRenamed("doc_id", "mixed_id")
    return docs.join(n, F.col("doc_id").eqNullSafe(F.col("mixed_id"))).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("mixed_id", "copies")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "rate", "taken")
