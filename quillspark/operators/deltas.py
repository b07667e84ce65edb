"""The link graph kept up to date: only what a change can touch is resolved again.

State is three tables: ``names(path, stem_path, stem)``, ``links(src, pos,
raw_target, alias, dst)`` with where each one leads, and ``edges(src, dst)``.  A
link's target depends on at most three keys of the index (its path, the path
without ``.md``, its last name).  The index can change only at the keys of notes
that came or went, since an edit gives a note no other name.  So a link is
resolved again if its note is new or edited, or if one of its keys is among those
whose smallest path has changed.  All steps are equi-joins whose one side is as
large as the change; the others are filtered, not looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.operators.components import written

NAMES = ["path", "stem_path", "stem"]
LINKS = ["src", "pos", "raw_target", "alias", "dst"]


@dataclass
class LinkState:
    names: DataFrame
    links: DataFrame

    def edges(self) -> DataFrame:
        """Distinct ``(src, dst)``."""
        return self.links.filter("dst IS NOT NULL").select("src", "dst").distinct()


@dataclass
class Delta:
    state: LinkState
    #: Links that were resolved again, and edges that came and went.
    resolved: DataFrame
    added: DataFrame
    removed: DataFrame


def built(notes: DataFrame) -> LinkState:
    """The state of a whole vault."""
    return LinkState(written(notes.select(*NAMES), "names"), written(G.resolved(G.links(notes), notes).select(*LINKS), "links"))


def asked_keys(target):
    """The index keys that a link asks for, with the index they are of."""
    k1 = F.lower(F.replace(target, F.lit("\\"), F.lit("/")))
    k2 = F.regexp_replace(k1, r"(\.md)+\z", "")
    key = lambda kind, k: F.concat(F.lit(kind), k)
    return F.array_distinct(F.array(key("p:", k1), key("p:", k2), key("s:", G.last_part(k2))))


def held_keys(names: DataFrame) -> DataFrame:
    """``(key, path)`` of what each note is found by."""
    return names.select("path", F.explode(F.array(F.concat(F.lit("p:"), F.lower("stem_path")), F.concat(F.lit("s:"), F.lower("stem")))).alias("key"))


def updated(state: LinkState, notes: DataFrame, changes: DataFrame) -> Delta:
    """The state after ``changes(path, kind, old_path)`` to what is now ``notes``; texts are read of added, changed and renamed notes only."""
    came = changes.filter("kind IN ('added', 'renamed')").select("path")
    went = changes.filter("kind = 'removed'").select("path").union(changes.filter("kind = 'renamed'").select(F.col("old_path").alias("path")))
    edited = changes.filter("kind = 'changed'").select("path")
    touched = written(came.union(edited).distinct(), "touched")
    went = written(went.union(edited).distinct(), "went")  # an edited note's links go and come
    fresh = written(notes.join(touched, "path", "left_semi").select(*NAMES, "content"), "fresh")

    names = state.names.join(went, "path", "left_anti").unionByName(fresh.select(*NAMES))
    names = written(names, "names")
    moved = held_keys(state.names.join(went, "path", "left_semi")).union(held_keys(fresh)).select("key").distinct()
    was, now = (held_keys(n).join(moved, "key", "left_semi").groupBy("key").agg(F.min("path").alias(c)) for n, c in ((state.names, "was"), (names, "now")))
    keys = written(was.join(now, "key", "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select("key"), "keys")

    kept = state.links.join(went.select(F.col("path").alias("src")), "src", "left_anti")
    hit = kept.select("raw_target").distinct().withColumn("key", F.explode(asked_keys(F.col("raw_target")))).join(keys, "key", "left_semi").select("raw_target").distinct()
    hit = written(hit, "hit")
    again = kept.join(hit, "raw_target", "left_semi").drop("dst").unionByName(G.links(fresh))
    # Only notes under the keys that are asked for make up the index.
    asked = again.select(F.explode(asked_keys(F.col("raw_target"))).alias("key")).distinct()
    index = names.join(held_keys(names).join(asked, "key", "left_semi").select("path").distinct(), "path", "left_semi")
    done = written(G.resolved(again, index).select(*LINKS), "resolved")
    links = written(kept.join(hit, "raw_target", "left_anti").select(*LINKS).unionByName(done), "links")

    new = LinkState(names, links)
    # Edges of the links that were looked at, before and after; another link of a note to the same one keeps an edge.
    before = state.links.join(went.select(F.col("path").alias("src")), "src", "left_semi").select(*LINKS).unionByName(kept.join(hit, "raw_target", "left_semi").select(*LINKS))
    pairs = lambda df: df.filter("dst IS NOT NULL").select("src", "dst").distinct()
    near = written(pairs(before), "pairs")
    sources = near.select("src").distinct()
    added = pairs(done).join(pairs(state.links.join(pairs(done).select("src").distinct(), "src", "left_semi")), ["src", "dst"], "left_anti")
    removed = near.join(pairs(links.join(sources, "src", "left_semi")), ["src", "dst"], "left_anti")
    return Delta(new, done, added, removed)
