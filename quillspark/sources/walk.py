"""A folder walked by tasks: no task lists the whole tree, and reading is dealt out by bytes.

The frontier of folders is a table.  Each round a task takes some folders and goes
down from them until it has seen ``MOST`` entries; the folders that it did not get
to are the next frontier.  So rounds are few for a tree of any shape and a folder
of very many files is one task's only for its own names.  Listings are written, a
round each.  Files are then packed: running sums of their bytes, in order of
paths, cut them into partitions of about equal size.
"""

from __future__ import annotations

import os
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.components import discarded, written
from quillspark.operators.edits import JOURNALS

LISTED = "path string, kind string, size_bytes long, modified_at timestamp"
READ = "path string, ext string, size_bytes long, modified_at timestamp, modified_on date, content string"
#: Entries that a task lists before it hands the rest back, bytes of a partition, and what opening a file counts as.
MOST, PARTITION_BYTES, OPEN_BYTES = 20_000, 64 << 20, 4096
#: Folders of the frontier that one task takes.
FOLDERS = 64


def _expanded(root: str, exclude: frozenset, extensions: frozenset, most: int):
    """Lists folders and what is below them: kinds ``file``, ``nested`` (a repository of its own, not entered) and ``folder`` (still to do)."""

    def run(batches):
        for b in batches:
            todo, out, seen = b["path"].to_pylist(), [], 0
            while todo:
                if seen >= most:
                    out += [(p, "folder", 0, None) for p in todo]
                    break
                rel = todo.pop()
                try:
                    entries = list(os.scandir(os.path.join(root, rel)))
                except (FileNotFoundError, NotADirectoryError, PermissionError):
                    continue  # gone meanwhile, or not ours to read
                if rel and any(e.name == ".git" for e in entries):
                    out.append((rel, "nested", 0, None))
                    continue
                seen += len(entries) + 1
                for e in entries:
                    if e.name in exclude or e.name == JOURNALS:
                        continue
                    path = f"{rel}/{e.name}" if rel else e.name
                    try:
                        if e.is_dir(follow_symlinks=False):
                            todo.append(path)
                        elif e.is_file() and (not extensions or e.name.rsplit(".", 1)[-1] in extensions):
                            s = e.stat()
                            out.append((path, "file", s.st_size, datetime.fromtimestamp(int(s.st_mtime), UTC)))
                    except FileNotFoundError:
                        continue
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.timestamp("us", "UTC"))], names=["path", "kind", "size_bytes", "modified_at"])

    return run


def walked(spark: SparkSession, root: str, exclude: list[str] | None = None, extensions: str = "md,txt,pdf", most: int = MOST) -> DataFrame:
    """``(path, kind, size_bytes, modified_at)`` of all files below ``root`` (kind ``file``) and of the repositories within it, which are not entered (``nested``).

    Excluded names are pruned wherever they are; links to folders are not followed.
    What cannot be a path in UTF-8 fails the listing.
    """
    run = _expanded(root, frozenset(exclude or []), frozenset(x for x in extensions.split(",") if x), most)
    frontier, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = written(frontier.mapInArrow(run, LISTED), "listed")
        rounds.append(found)
        left = found.filter("kind = 'folder'").count()
        if not left:
            break
        frontier = found.filter("kind = 'folder'").select("path").repartition(-(-left // FOLDERS))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    out = written(out.filter("kind <> 'folder'"), "walked")
    discarded(*rounds)
    return out


def packed(listing: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Files with the ``bin`` they are read in: each bin holds about ``partition_bytes``, a larger file alone about its own size.

    The running sum is made within ranges of paths, then over the ranges' sums.
    """
    files = listing.filter("kind = 'file'").withColumn("weight", F.col("size_bytes") + OPEN_BYTES)
    ranged = written(files.repartitionByRange("path").withColumn("range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("range").agg(F.sum("weight").alias("w"))  # a row a range
    before = sums.withColumn("before", F.sum("w").over(W.orderBy("range")) - F.col("w")).drop("w")
    upto = F.sum("weight").over(W.partitionBy("range").orderBy("path"))
    out = ranged.join(before, "range").withColumn("at", F.col("before") + upto - F.col("weight") / 2)
    return out.withColumn("bin", F.floor(F.col("at") / partition_bytes).cast("int")).drop("weight", "range", "before", "at")


def read_folder(spark: SparkSession, root: str, exclude: list[str] | None = None, extensions: str = "md,txt,pdf", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``files(path, ext, size_bytes, modified_at, modified_on, content)`` below ``root``, listed and read by tasks; paths are relative to it.

    What is gone when it is read, or no text, is left out; a PDF has no content.
    """
    listing = written(packed(walked(spark, root, exclude, extensions), partition_bytes), "packed")
    bins = (listing.agg(F.max("bin")).first()[0] or 0) + 1

    def read(batches):
        for b in batches:
            held, size = [], 0
            for path, n, modified in zip(*(b[c].to_pylist() for c in ("path", "size_bytes", "modified_at"))):
                text = None
                try:
                    if not path.endswith(".pdf"):
                        with open(os.path.join(root, path), encoding="utf-8", newline="") as f:
                            text = f.read()
                except (OSError, UnicodeDecodeError):
                    continue
                name = path.rsplit("/", 1)[-1]
                held.append((path, name.rsplit(".", 1)[-1] if "." in name else "", n, modified, modified.date(), text))
                size += len(text or "")
                if size >= 4 << 20:
                    yield _files(held)
                    held, size = [], 0
            if held:
                yield _files(held)

    return listing.repartitionById(bins, F.col("bin")).mapInArrow(read, READ)


def _files(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.date32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ.split(", ")])
