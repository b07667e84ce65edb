"""Connected components by alternating large-star and small-star rounds.

Before the rounds every task joins what its own edges connect, a bounded number of
edges at a time, and sends on a star for each such part: fewer edges, and far
shorter ways for the rounds to go.  Every round is one aggregation with map-side combine and one join on node ids,
so no group is ever gathered in one task and nothing is collected to the
driver but one changed-edges count per round.
"""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none, as in tests, a temporary one is made and
    set; on a cluster its executors could not see that, so it has to be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import re
        import tempfile

        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")

        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Where frames that were written lie.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def discarded(*frames: DataFrame) -> None:
    """Delete what ``written`` made for these frames; nothing that is still to be run may read them."""
    for df in frames:
        path = _PLACES.pop(df, None)
        if path:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def swept(spark) -> None:
    """Have the driver collect garbage now: Spark then deletes the shuffle files of frames that nothing holds any more.

    Else these stay until the driver's memory happens to fill, beside all that is written meanwhile.
    """
    import gc
    import time

    gc.collect()
    time.sleep(0.2)  # what ended last is let go of once its listeners have heard
    spark.sparkContext._jvm.System.gc()


def _larger_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(low, "u").filter("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v").distinct()
    )


def _smaller_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


#: Edges that a task joins at a time.
CHUNK = 500_000


def _joined(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with the same components: within each task's chunks, stars about the smallest node."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def star(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        coded = pa.chunked_array([*t["u"].chunks, *t["v"].chunks]).combine_chunks().dictionary_encode()
        nodes, rank = coded.dictionary, np.empty(len(coded.dictionary), np.int64)
        order = pc.sort_indices(nodes).to_numpy()
        rank[order] = np.arange(len(order))
        ends = rank[coded.indices.to_numpy()].reshape(2, -1)
        low = np.arange(len(order))
        while True:  # hook each root to the smallest that it meets, then follow to the roots
            a, b = low[ends[0]], low[ends[1]]
            small, large = np.minimum(a, b), np.maximum(a, b)
            if (small == large).all():
                break
            np.minimum.at(low, large, small)
            while (low[low] != low).any():
                low = low[low]
        inner = np.flatnonzero(low != np.arange(len(order)))
        ranked = nodes.take(pa.array(order))
        return pa.RecordBatch.from_arrays([ranked.take(pa.array(inner)), ranked.take(pa.array(low[inner]))], schema=schema)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield star(held, b.schema)
                held, n = [], 0
        if held:
            yield star(held, held[0].schema)

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph.

    ``edges(u, v)`` of any orderable type; rows with nulls and self-loops are
    ignored, repeated edges count once.  Returns ``(node, component)`` with the
    smallest node of the component, one row for each node that has an edge to
    another; isolated nodes are the caller's to add.
    """
    current = written(
        _joined(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )

    def marked(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    mark = marked(current)
    for _ in range(max_rounds):
        before, current = current, written(_smaller_star(_larger_star(current)), "edges")
        discarded(before)
        seen = marked(current)
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
