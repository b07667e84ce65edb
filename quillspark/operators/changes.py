"""What differs between two snapshots of a vault: a change set, its summary, and its commit line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(content):
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def digests(files: DataFrame) -> DataFrame:
    """``(path, digest)``: what a later round compares with; no texts."""
    return files.select("path", digest(F.col("content")).alias("digest"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, kind, old_path)`` of two frames ``(path, digest)``: ``added``, ``changed``, ``removed`` or ``renamed``.

    One full outer join on the path.  Where one file came and one went with the same
    digest, they are one renamed file; where several did (empty ones, copies), which
    became which is not to be told, and they count as added and removed.
    """
    both = before.select("path", F.col("digest").alias("old")).join(after.select("path", F.col("digest").alias("new")), "path", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    one = both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("kind"), F.coalesce("new", "old").alias("digest"))
    came, went = F.col("kind") == "added", F.col("kind") == "removed"
    sides = one.filter(came | went).groupBy("digest").agg(F.count_if(came).alias("a"), F.count_if(went).alias("r"), F.max(F.when(came, F.col("path"))).alias("path"), F.max(F.when(went, F.col("path"))).alias("old_path"))
    renamed = sides.filter("a = 1 AND r = 1").select("path", F.lit("renamed").alias("kind"), "old_path")
    paired = renamed.select("path").union(renamed.select("old_path"))
    return one.join(paired, "path", "left_anti").select("path", "kind", F.lit(None).cast("string").alias("old_path")).union(renamed)


def change_counts(found: DataFrame) -> DataFrame:
    """One row: how many files were added, changed, renamed and removed."""
    return found.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "changed", "renamed", "removed")))


def commit_summary(found: DataFrame) -> DataFrame:
    """``(message, added, changed, renamed, removed)`` of a change set: what kinds of note it touches, a renamed file under both its names."""
    names = found.select("kind", F.explode(F.array_compact(F.array("path", "old_path"))).alias("file"), F.lit(0).alias("one"))
    f = F.col("file")
    flags = names.agg(
        F.max((f.contains("/") & f.endswith(F.concat(F.split(f, "/")[0], F.lit(".md")))).cast("int")).alias("moc"), F.max((f.contains("Zettelkasten") | f.contains("zettelkasten")).cast("int")).alias("zk"),
        F.max((f.contains("/src/") | f.endswith(".rs")).cast("int")).alias("src"),
    )
    parts = F.concat_ws(", ", F.when(F.col("moc") == 1, "MOC"), F.when(F.col("zk") == 1, "bridge notes"), F.when(F.col("src") == 1, "source"))
    out = change_counts(found).join(flags, F.lit(True))  # one row each
    n = F.col("added") + F.col("changed") + F.col("renamed") + F.col("removed")
    message = F.concat(F.lit("chore(vault): auto-update "), F.when(parts == "", "vault content").otherwise(parts), F.lit(" ("), n.cast("string"), F.lit(" files)"))
    return out.select(message.alias("message"), "added", "changed", "renamed", "removed")
