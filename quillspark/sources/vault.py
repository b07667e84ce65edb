"""Reading a folder of notes: a Python data source that keeps what Spark's own readers drop.

Spark's file sources leave out names that begin with a dot or an underscore and
do not take note of nested repositories.  ``vault`` walks the tree once on the
driver, listing paths only, prunes excluded and nested folders there, and reads
contents in as many partitions as asked for.
"""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.operators.edits import JOURNALS

SCHEMA = "path string, ext string, size_bytes long, modified_at timestamp, modified_on date, content string"


def listed(root: str, exclude: list[str], extensions: list[str]) -> tuple[list[str], list[str]]:
    """Relative paths of files, and folders that are repositories of their own (pruned)."""
    found, nested = [], []
    for folder, dirs, files in os.walk(root):
        rel = os.path.relpath(folder, root)
        if rel != "." and (".git" in dirs or ".git" in files):
            nested.append(rel.replace(os.sep, "/"))
            dirs[:] = []
            continue
        dirs[:] = sorted(d for d in dirs if d not in exclude and d != JOURNALS)
        found += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in sorted(files) if f not in exclude and (not extensions or f.rsplit(".", 1)[-1] in extensions)]
    return found, nested


class Part(InputPartition):
    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


class VaultReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.exclude = [x for x in options.get("exclude", "").split(",") if x]
        self.extensions = [x for x in options.get("extensions", "md,txt,pdf").split(",") if x]
        self.n = int(options.get("partitions", "8"))

    def partitions(self):
        paths, _ = listed(self.root, self.exclude, self.extensions)
        return [Part(paths[i :: self.n]) for i in range(min(self.n, max(1, len(paths))))]

    def read(self, part):
        for p in part.paths:
            full = os.path.join(self.root, p)
            try:
                st = os.stat(full)
                text = None
                if not p.endswith(".pdf"):
                    with open(full, encoding="utf-8", newline="") as f:
                        text = f.read()
            except (OSError, UnicodeDecodeError):
                continue  # gone meanwhile, or no text
            t = datetime.fromtimestamp(int(st.st_mtime), UTC)
            yield (p, p.rsplit(".", 1)[-1] if "." in p else "", st.st_size, t, t.date(), text)


class VaultSource(DataSource):
    @classmethod
    def name(cls):
        return "vault"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return VaultReader(self.options)


def read_vault(spark: SparkSession, root: str, exclude: list[str] | None = None, partitions: int = 8, extensions: str = "md,txt,pdf") -> DataFrame:
    """``files(path, ext, size_bytes, modified_at, modified_on, content)`` of a folder; paths are relative to it."""
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").option("exclude", ",".join(exclude or [])).option("partitions", partitions).option("extensions", extensions).load(root)


def write_snapshot(files: DataFrame, path: str) -> None:
    """A Parquet snapshot by top-level folder, so that later reads of one zone prune the others."""
    from pyspark.sql import functions as F

    files.withColumn("zone_dir", F.regexp_extract("path", r"\A([^/]*)/", 1)).write.mode("overwrite").partitionBy("zone_dir").parquet(path)


def registered(spark: SparkSession, vaults: list[dict], watched: bool = False) -> DataFrame:
    """The registry of vaults that are enabled (and watched)."""
    rows = [(v["name"], v["path"], bool(v.get("enabled", True)), bool(v.get("watch", False))) for v in vaults]
    df = spark.createDataFrame(rows, "name string, path string, enabled boolean, watch boolean").filter("enabled")
    return df.filter("watch") if watched else df


def count_notes(files: DataFrame, system_dirs: list[str]) -> DataFrame:
    """Markdown notes outside the system folders at the top."""
    from pyspark.sql import functions as F

    return files.filter(F.col("path").endswith(".md") & ~F.split("path", "/")[0].isin(system_dirs)).agg(F.count("*").alias("notes"))
