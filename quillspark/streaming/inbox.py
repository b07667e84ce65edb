"""Streams: the inbox as it fills, rounds of sync, and windows over events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import VaultConfig
from quillspark.operators import bridges as B
from quillspark.operators import edits as E
from quillspark.operators import graph as G
from quillspark.operators import hubs as H
from quillspark.operators import inbox as I
from quillspark.operators.components import discarded, written

LANDED = "path string, content string, modified_on timestamp, version long"


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Inbox versions landed as Parquet, append only: an edited note is a new row of a later time or, within one time, of a higher ``version``."""
    return spark.readStream.schema(LANDED).parquet(folder)


def newest(versions: DataFrame) -> DataFrame:
    """The last version of every path, by time, version and content."""
    return versions.groupBy("path").agg(F.max(F.struct("modified_on", "version", "content")).alias("v")).select("path", "v.*")


#: Batches after which what was planned is brought together in one folder.
COMPACT = 20
PLANNED = "path string, modified_on timestamp, version long, digest string"


class Planned:
    """What was planned of every path last, beside a checkpoint: a folder a batch, brought together now and then.

    A batch that is redone does not see its own folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs, self.path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def batches(self, kind: str) -> list[int]:
        """Numbers of whole folders of a kind (``upto``: all up to a batch, ``batch``: one)."""
        if not self.fs.exists(self.path):
            return []
        whole = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path)]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(kind + "-") and self.fs.exists(whole(f"{self.folder}/{n}/_SUCCESS")))

    def before(self, n: int) -> DataFrame:
        """The last of every path before batch ``n``; few paths where they are brought together, and only those are read again."""
        upto = [x for x in self.batches("upto") if x < n][-1:]
        one = [x for x in self.batches("batch") if (upto or [-1])[0] < x < n]
        paths = [f"{self.folder}/upto-{x}" for x in upto] + [f"{self.folder}/batch-{x}" for x in one]
        rows = self.spark.read.schema(PLANNED).parquet(*paths) if paths else self.spark.createDataFrame([], PLANNED)
        return rows.groupBy("path").agg(F.max(F.struct("modified_on", "version", "digest")).alias("v")).select("path", "v.*")

    def keep(self, rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch-{n}")
        old = self.batches("upto")
        if n - (old or [-1])[-1] >= COMPACT:
            # Batch n may be redone: it stays out, and what the last gathering was made of stays until the next.
            self.before(n).write.mode("overwrite").parquet(f"{self.folder}/upto-{n - 1}")
            gone = [f"upto-{x}" for x in old[:-1]] + [f"batch-{x}" for x in self.batches("batch") if x <= (old or [-1])[-1]]
            for name in gone:
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)


def watch(stream: DataFrame, apply: Callable[[DataFrame], None], as_of: str, checkpoint: str, analyse=None, config: VaultConfig | None = None, once: bool = True, every: str = "5 seconds"):
    """Plan each micro-batch's newest versions and hand the edits to ``apply``; a batch that is redone plans the same again.

    What was planned is kept beside the checkpoint, so that an older version that
    comes in a later batch is left alone, and so is one with the same text.
    """

    def one(batch: DataFrame, n: int) -> None:
        kept = Planned(batch.sparkSession, f"{checkpoint}-seen")
        sign = F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)
        last = written(newest(batch).withColumn("digest", sign), "batch")
        had = kept.before(n).select(F.col("path").alias("of"), F.struct("modified_on", "version").alias("had"), F.col("digest").alias("same"))
        now = F.struct("modified_on", "version")
        fresh = last.join(had, F.col("path") == F.col("of"), "left").filter(F.col("had").isNull() | ((now >= F.col("had")) & (F.col("digest") != F.col("same"))))
        fresh = written(fresh.select("path", "content", "modified_on", "version", "digest"), "fresh")
        # Kept after they are planned: a batch that failed between is planned again.
        apply(I.process(fresh.withColumn("modified_on", F.to_date("modified_on")), as_of, analyse, config))
        kept.keep(fresh.select("path", "modified_on", "version", "digest"), n)
        discarded(last)

    out = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def watch_folder(spark: SparkSession, root: str, as_of: str, checkpoint: str, apply: Callable[[DataFrame], None] | None = None, analyse=None, config: VaultConfig | None = None, once: bool = True, every: str = "5 seconds"):
    """Watch a vault's inbox on disk: what is put in or edited is planned once, and applied there (or handed to ``apply``)."""
    from quillspark.sources.folder import inbox_stream

    config = config or VaultConfig()
    return watch(inbox_stream(spark, root, config.inbox_dir), apply or (lambda plan: E.apply_to_disk(plan, root)), as_of, checkpoint, analyse, config, once, every)


class Service:
    """A watcher and a sync loop for each vault, until ``stop``."""

    def __init__(self, queries: dict, loops: dict, ended):
        self.queries, self.loops, self.ended = queries, loops, ended
        self.failed: dict[str, list] = {}

    def stop(self) -> None:
        self.ended.set()
        for q in self.queries.values():
            q.stop()
        for t in self.loops.values():
            t.join()


def serve(spark: SparkSession, vaults: list[dict], checkpoints: str, as_of: Callable[[], str], config: Callable[[dict], VaultConfig] | None = None, analyse=None, times: int | None = None, every: str = "5 seconds") -> Service:
    """For each enabled vault ``{name, path, watch}`` a sync loop on its folder, and beside it a watcher where ``watch`` is set.

    A vault that fails a round is tried again in the next; its failures are in ``Service.failed``.
    """
    import threading

    from quillspark.sources.walk import read_folder

    configs = {v["name"]: (config or (lambda v: VaultConfig.load(v["path"])))(v) for v in vaults if v.get("enabled", True)}
    ended = threading.Event()
    out = Service({}, {}, ended)

    def loop(v: dict) -> None:
        name, n, c = v["name"], 0, configs[v["name"]]
        while not ended.is_set() and (times is None or n < times):
            bad = []
            try:
                files = written(read_folder(spark, v["path"], c.graph_excluded()), "vault")
                after, bad = sync(files, c)
                E.apply_to_disk(changes_to_plan(files, after), v["path"])
            except Exception as e:  # the other vaults, and the next round, go on
                bad = [*bad, f"round: {e}"]
            out.failed.setdefault(name, []).append(bad)
            n += 1
            if times is None or n < times:
                ended.wait(c.interval_seconds())

    for v in vaults:
        if v.get("enabled", True):
            if v.get("watch"):
                out.queries[v["name"]] = watch_folder(spark, v["path"], as_of(), f"{checkpoints}/{v['name']}", analyse=analyse, config=configs[v["name"]], once=False, every=every)
            out.loops[v["name"]] = threading.Thread(target=loop, args=(v,), daemon=True)
            out.loops[v["name"]].start()
    return out


def changes_to_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edits that make ``before`` into ``after``, tied to what the files were."""
    old = before.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("expects"))
    rows = after.select("path", "content").join(old, "path", "left").filter(~F.sha2(F.col("content").cast("binary"), 256).eqNullSafe(F.col("expects")) & F.col("content").isNotNull())
    return rows.select("path", F.lit("write").alias("action"), F.lit(None).cast("string").alias("new_path"), F.col("content").alias("new_content"), F.lit("sync").alias("reason"), "expects")


def rounds(load: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], None], config: VaultConfig | None = None, times: int | None = None, wait: Callable[[float], None] = time.sleep, steps: list[str] | None = None) -> list[list[str]]:
    """The sync loop: load, plan a round, hand ``apply`` the files as they are and would be, wait the interval; ``times`` rounds, or without end.

    Returns the failed steps of every round.
    """
    config, failed = config or VaultConfig(), []
    while times is None or len(failed) < times:
        if failed:
            wait(config.interval_seconds())
        files = load()
        after, bad = sync(files, config, steps)
        apply(files, after)
        failed.append(bad)
    return failed


def sync_edits(files: DataFrame, config: VaultConfig | None = None, only: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """What a sync round writes: hubs, home, index, then bridge notes, backlinks, related projects, auto tags, each planned on what the ones before wrote.

    ``only`` names the steps to take (those the config has switched on, if not given). Returns ``(path, content)`` of the
    files with their last texts, null where no step has any, and the steps that failed; a failing step does not stop the
    next. Steps keep their edits beside the files, so no step writes or moves the whole vault.
    """
    config = config or VaultConfig()

    def docs(notes):
        return B.project_docs(notes, config)

    def shared(notes):
        return written(B.bridges(B.concept_hits(docs(notes), config.concepts), config.concepts), "shared")

    steps = {
        "hubs": lambda n: H.hub_plan(n, config), "home": lambda n: H.home_plan(n, config), "index": lambda n: H.index_plan(n, G.edges(n), config, protected=True),
        "bridge notes": lambda n: B.bridge_note_plan(shared(n), n, config), "backlinks": lambda n: B.backlink_plan(docs(n), B.backlinks(docs(n), n, config), config),
        "related": lambda n: B.related_plan(shared(n), n, config), "auto tags": lambda n: B.auto_tag_plan(docs(n), config.concepts),
    }
    v, failed = E.Overlay(files), []
    for name, step in steps.items():
        if name not in (config.steps() if only is None else only):
            continue
        try:
            v.take(step(G.notes(v.files(), config.graph_excluded())))
        except Exception as e:
            failed.append(f"{name}: {e}")
    return v.edits, failed


def sync(files: DataFrame, config: VaultConfig | None = None, only: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A sync round without disk: the files as ``sync_edits`` would make them, and the steps that failed."""
    edits, failed = sync_edits(files, config, only)
    if edits is not None:
        plan = edits.select("path", F.lit("write").alias("action"), F.lit(None).cast("string").alias("new_path"), F.col("content").alias("new_content"))
        files = E.applied(files, plan)
    return written(files, "sync"), failed


def event_windows(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and tumbling window, with a watermark where ``events`` is a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
