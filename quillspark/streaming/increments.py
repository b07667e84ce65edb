"""Sync rounds that plan only what a change can touch.

Every step of a round keeps, beside the vault, the digests of the notes that it
last planned on.  What differs from them now - edits from outside and what the
steps before have written in this round - is the step's change set.  A reverse
index says which outputs a note feeds:

=============  ===========================================================
output         fed by
=============  ===========================================================
hub            the paths of its project's notes, and itself
home           which projects there are, and itself
index          whether it is there (it is protected)
bridge note    which projects hold its concept, and itself
see-also part  its own document; a Zettelkasten name that it holds
related part   the concepts of its project and who shares them, its hub
auto tags      its own document
=============  ===========================================================

An output that nothing changed feeds would be planned as it was, so only the
others are planned: by the same functions, on the notes that feed them.  Two
tables carry what whole texts would have to be read for, ``hits(project, concept,
path)`` and ``found(path, zettel)``; rows of changed documents are made anew.  A
round without a memory plans all.  So rounds equal full ones, edit for edit.

Texts that a round reads: those of changed notes, of notes that feed a touched
output, and, when a Zettelkasten name is new, those that may hold it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import VaultConfig
from quillspark.operators import bridges as B
from quillspark.operators import edits as E
from quillspark.operators import graph as G
from quillspark.operators import hubs as H
from quillspark.operators.changes import changes, digest, digests
from quillspark.operators.components import written

STEPS = ["hubs", "home", "index", "bridge notes", "backlinks", "related", "auto tags"]


@dataclass
class Memory:
    """What rounds remember; frames lie in the shared folder, ``saved`` and ``loaded`` carry them between sessions."""

    seen: dict[str, DataFrame] = field(default_factory=dict)
    hits: DataFrame | None = None
    found: DataFrame | None = None

    def saved(self, folder: str) -> None:
        for name, df in [*((f"seen-{STEPS.index(k)}", v) for k, v in self.seen.items()), ("hits", self.hits), ("found", self.found)]:
            if df is not None:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def loaded(cls, spark: SparkSession, folder: str) -> Memory:
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        read = lambda name: spark.read.parquet(f"{folder}/{name}") if fs.exists(path(f"{folder}/{name}/_SUCCESS")) else None
        seen = {k: read(f"seen-{i}") for i, k in enumerate(STEPS)}
        return cls({k: x for k, x in seen.items() if x is not None}, read("hits"), read("found"))


@dataclass
class Round:
    """The edits of a round, last text a path; how many outputs each step looked at; what to remember."""

    plan: DataFrame
    planned: dict[str, int]
    memory: Memory


class _Vault(E.Overlay):
    """The files of a vault under the edits so far, with their digests."""

    def __init__(self, files: DataFrame, config: VaultConfig):
        super().__init__(files)
        self.config, self.digests = config, written(digests(self.base), "digests")
        self.before = self.digests

    def notes(self, paths: DataFrame | list[str] | None = None) -> DataFrame:
        return G.notes(self.files(paths), self.config.graph_excluded())

    def names(self) -> DataFrame:
        """All notes without their texts."""
        return G.notes(self.digests.select("path", F.lit("").alias("content")), self.config.graph_excluded())

    def took(self, new: DataFrame) -> None:
        self.digests = written(self.digests.join(new.select("path"), "path", "left_anti").unionByName(digests(new)), "digests")

    def differing(self) -> DataFrame:
        """Edits that change a file or make one; told by digests, no text of the files is moved for it."""
        was = self.before.select("path", F.col("digest").alias("was"))
        return self.edits.withColumn("now", digest(F.col("content"))).join(was, "path", "left").filter(~F.col("now").eqNullSafe(F.col("was"))).select("path", "content")


def _project(path="path"):
    return F.split(F.col(path), "/")[0]


def round_of_changes(files: DataFrame, memory: Memory | None = None, config: VaultConfig | None = None) -> Round:
    """One round over ``files``: what ``sync`` writes, from what changed since ``memory``."""
    config = config or VaultConfig()
    old, new = memory or Memory(), Memory()
    v, planned = _Vault(files, config), {}
    zk = config.zettelkasten_dir

    def changed(step: str) -> DataFrame | None:
        """``(path, kind)`` since the step last ran, a renamed note as one that went and one that came; None without a memory."""
        new.seen[step] = v.digests
        if step not in old.seen:
            return None
        c = changes(old.seen[step], v.digests)
        came = c.select("path", F.when(F.col("kind") == "renamed", "added").otherwise(F.col("kind")).alias("kind"))
        return written(came.union(c.filter("kind = 'renamed'").select(F.col("old_path").alias("path"), F.lit("removed"))), "changed")

    def docs_of(notes: DataFrame) -> DataFrame:
        return B.project_docs(notes, config)

    def step(name: str, plan: DataFrame | None, outputs: int) -> None:
        if name not in config.steps():  # without a memory it plans all once it is switched on
            planned[name] = 0
            new.seen.pop(name, None)
            return
        planned[name] = outputs
        if plan is not None:
            v.take(plan)

    def paths_of(df: DataFrame) -> DataFrame:
        return written(df.select("path").distinct(), "paths")

    # Hubs and home: names decide, edits only where a hub itself was edited.
    c = changed("hubs")
    keys = None if c is None else written(docs_of(_as_notes(c.filter("kind <> 'changed'"), config)).select("project").union(c.filter(F.col("path") == F.concat(_project(), F.lit("/"), _project(), F.lit(".md"))).select(_project())).distinct(), "projects")
    if keys is None:
        step("hubs", H.hub_plan(v.notes(), config), _count(docs_of(v.names()).select("project").distinct()))
    else:
        near = paths_of(v.digests.withColumn("project", _project()).join(keys, "project", "left_semi"))
        step("hubs", H.hub_plan(v.notes(near), config) if keys.count() else None, keys.count())
    c = changed("home")
    touched = c is None or c.filter("kind <> 'changed' OR path = 'Home.md'").limit(1).count()
    if touched:
        home = v.notes(["Home.md"]).unionByName(v.names().filter("path <> 'Home.md'"))
        step("home", H.home_plan(home, config), 1)
    else:
        step("home", None, 0)
    changed("index")
    absent = not v.digests.filter("path = 'index.md'").limit(1).count()
    if absent:
        notes = v.notes()
        step("index", H.index_plan(notes, G.edges(notes), config, protected=True), 1)
    else:
        step("index", None, 0)

    # Bridge notes: by concept.
    c = changed("bridge notes")
    hits, concepts = _hits(v, c, old.hits, config)
    if c is not None:
        own = c.select(F.regexp_extract("path", rf"\A{_quoted(zk)}/([^/]*)\.md\z", 1).alias("concept")).filter("concept <> ''")
        concepts = written(concepts.union(own).distinct(), "concepts")
    some = hits if concepts is None else hits.join(concepts, "concept", "left_semi")
    if concepts is None or concepts.limit(1).count():
        bridges = B.bridges(some, config.concepts)
        at = paths_of(bridges.select(F.concat(F.lit(f"{zk}/"), "concept", F.lit(".md")).alias("path")))
        step("bridge notes", B.bridge_note_plan(bridges, v.notes(at), config), _count(at))
    else:
        step("bridge notes", None, 0)

    # See-also parts: by document and by name.
    c = changed("backlinks")
    listed = F.col("path").rlike(rf"\A{_quoted(zk)}/[^/]*\.md\z")
    if c is None:
        docs, found = docs_of(v.notes()), None
        new.found = written(B.backlinks(docs, v.notes(), config), "found")
        step("backlinks", B.backlink_plan(docs, new.found, config), _count(docs_of(v.names()).select("path")))
    else:
        names = c.filter(listed & F.col("kind").isin("added", "removed"))
        gone = names.filter("kind = 'removed'").select(F.regexp_extract("path", r"([^/]*)\.md\z", 1).alias("zettel"))
        mine = docs_of(v.notes(paths_of(c.filter("kind <> 'removed'"))))
        all_names = v.names().filter(F.col("parent") == zk)
        anew = B.backlinks(mine, all_names, config)
        came = all_names.join(names.filter("kind = 'added'").select("path"), "path", "left_semi")
        kept = old.found.join(c.select("path"), "path", "left_anti").join(gone, "zettel", "left_anti")
        more = kept.limit(0)
        if came.limit(1).count():
            rest = docs_of(v.notes()).join(c.select("path"), "path", "left_anti")
            more = B.backlinks(rest, came, config)
        new.found = written(kept.unionByName(anew.select("path", "zettel")).unionByName(more.select("path", "zettel")).distinct(), "found")
        hit = old.found.join(gone, "zettel", "left_semi").select("path").union(new.found.join(came.select(F.col("stem").alias("zettel")), "zettel", "left_semi").select("path"))
        near = paths_of(c.filter("kind <> 'removed'").select("path").union(hit))
        docs = docs_of(v.notes(near))
        step("backlinks", B.backlink_plan(docs, new.found, config), _count(docs.select("path")))

    # Related parts: by project, of who shares a touched concept before or after.
    c = changed("related")
    before = hits
    hits, concepts = _hits(v, c, hits, config)
    if c is None:
        step("related", B.related_plan(B.bridges(hits, config.concepts), v.notes(), config), _count(hits.select("project").distinct()))
    else:
        # Concepts may have changed since this step last ran, in the bridge step's view as well.
        since = [x for x in (old.hits, before) if x is not None]
        moved = concepts
        for x in since:
            moved = moved.union(_differing(x, hits))
        moved = written(moved.distinct(), "moved")
        at = c.filter(F.col("path") == F.concat(_project(), F.lit("/"), _project(), F.lit(".md"))).select(_project().alias("project"))
        projects = at
        for x in [*since, hits]:
            projects = projects.union(x.join(moved, "concept", "left_semi").select("project"))
        projects = written(projects.distinct(), "projects")
        n = projects.count()
        if n:
            about = hits.join(projects, "project", "left_semi").select("concept").distinct()
            bridges = B.bridges(hits.join(about, "concept", "left_semi"), config.concepts)
            hubs = paths_of(projects.select(F.concat("project", F.lit("/"), "project", F.lit(".md")).alias("path")))
            step("related", B.related_plan(bridges, v.notes(hubs), config), n)
        else:
            step("related", None, 0)
    new.hits = hits

    c = changed("auto tags")
    docs = docs_of(v.notes() if c is None else v.notes(paths_of(c.filter("kind <> 'removed'"))))
    step("auto tags", B.auto_tag_plan(docs, config.concepts), _count(docs_of(v.names()).select("path") if c is None else docs.select("path")))

    out = files.sparkSession.createDataFrame([], "path string, content string") if v.edits is None else v.differing()
    plan = out.select("path", F.lit("write").alias("action"), F.lit(None).cast("string").alias("new_path"), F.col("content").alias("new_content"), F.lit("sync").alias("reason"))
    return Round(plan, planned, new)


def _count(df: DataFrame) -> int:
    return df.count()


def _quoted(name: str) -> str:
    return "\\Q" + name + "\\E"


def _as_notes(c: DataFrame, config: VaultConfig) -> DataFrame:
    return G.notes(c.select("path", F.lit("").alias("content")), config.graph_excluded())


def _hits(v: _Vault, c: DataFrame | None, old: DataFrame | None, config: VaultConfig) -> tuple[DataFrame, DataFrame | None]:
    """Concept hits now, and the concepts whose hits of changed documents came or went."""
    if c is None or old is None:
        return written(B.concept_hits(B.project_docs(v.notes(), config), config.concepts), "hits"), None
    mine = v.notes(c.filter("kind <> 'removed'").select("path"))
    anew = written(B.concept_hits(B.project_docs(mine, config), config.concepts), "hits")
    was = old.join(c.select("path"), "path", "left_semi").select("project", "concept", "path")
    now = written(old.join(c.select("path"), "path", "left_anti").select("project", "concept", "path").unionByName(anew.select("project", "concept", "path")), "hits")
    return now, written(was.select("concept").union(anew.select("concept")).distinct(), "concepts")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concepts whose projects differ between two tables of hits."""
    x, y = (h.select("concept", "project").distinct() for h in (a, b))
    return x.join(y, ["concept", "project"], "left_anti").select("concept").union(y.join(x, ["concept", "project"], "left_anti").select("concept"))
