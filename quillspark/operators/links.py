"""Broken-link check: a cascade of lookups for every link occurrence, and the repairs it calls for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph as G


def text_stems(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """``.txt`` files by lower-cased path without extension: the smallest path of each."""
    names = G.EXCLUDED_DIRS if exclude is None else exclude
    txt = files.filter(F.col("path").endswith(".txt"))
    txt = txt.filter(~G.excluded(F.col("path"), names)) if names else txt
    return txt.groupBy(F.expr("lower(left(path, length(path) - 4))").alias("k")).agg(F.min("path").alias("txt_path"))


def check_links(files: DataFrame, notes: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """``(source, pos, target, issue, match)``; issue null where the link resolves.

    In order: a note; a ``.txt`` file of that name (``extension_mismatch``); a
    note after hyphens become spaces, or spaces hyphens (``filename_mismatch``);
    else ``unresolved``.  ``exclude`` is what ``notes`` were made with.
    """
    found = G.links(notes).withColumn("clean", F.regexp_replace("raw_target", r"\.md\z", ""))
    found = G.resolved(found, notes, "clean")
    asked = found.filter("dst IS NULL").select("clean").distinct().withColumns({
        "t": F.lower("clean"), "s1": F.replace(F.lower("clean"), F.lit("-"), F.lit(" ")), "h1": F.replace(F.lower("clean"), F.lit(" "), F.lit("-")),
    }).withColumns({"s2": G.last_part(F.col("s1")), "h2": G.last_part(F.col("h1"))})
    paths, stems = G.path_index(notes), G.stem_index(notes)
    asked = asked.join(text_stems(files, exclude).withColumnRenamed("k", "t"), "t", "left")
    for key, index in (("s1", paths), ("s2", stems), ("h1", paths), ("h2", stems)):
        asked = asked.join(index.select(F.col("k").alias(key), F.col("p").alias(f"p_{key}")), key, "left")
    asked = asked.select("clean", "txt_path", F.coalesce("p_s1", "p_s2", "p_h1", "p_h2").alias("near"))
    issue = (
        F.when(F.col("dst").isNotNull(), F.lit(None).cast("string")).when(F.col("txt_path").isNotNull(), "extension_mismatch")
        .when(F.col("near").isNotNull(), "filename_mismatch").otherwise("unresolved")
    )
    return found.join(asked, "clean", "left").select(
        F.col("src").alias("source"), "pos", F.col("raw_target").alias("target"), issue.alias("issue"), F.coalesce("dst", "txt_path", "near").alias("match")
    )


def issue_counts(checked: DataFrame) -> DataFrame:
    """Occurrences by outcome, ``resolved`` among them."""
    return checked.groupBy(F.coalesce("issue", F.lit("resolved")).alias("issue")).agg(F.count("*").alias("links"), F.count_distinct("source").alias("files"))


def link_totals(checked: DataFrame) -> DataFrame:
    """``(check, scanned, issues, fixed)`` of link occurrences: resolved ones among those scanned; fixed are those that a repair can mend."""
    broken, mended = F.col("issue").isNotNull(), F.col("issue").isin("extension_mismatch", "filename_mismatch")
    return checked.agg(F.lit("links").alias("check"), F.count("*").alias("scanned"), F.count_if(broken).alias("issues"), F.count_if(mended).alias("fixed"))


def repair_plan(checked: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Edits for fixable links: ``.txt`` files renamed; misnamed notes renamed to the target where nothing links to them, else the link rewritten.

    A rename is planned only if nothing has the new path, and once a file (the
    smallest new path).
    """
    here = files.select(F.col("path").alias("new_path"))
    txt = checked.filter("issue = 'extension_mismatch'").select(F.col("match").alias("path"), F.expr("concat(left(match, length(match) - 4), '.md')").alias("new_path"))
    miss = checked.filter("issue = 'filename_mismatch'")
    linked = edges.select(F.col("dst").alias("match"))
    bare = F.regexp_replace("target", r"\.md\z", "")
    folder = F.regexp_extract("match", r"\A(.*/)?[^/]*\z", 1)
    free = miss.join(linked, "match", "left_anti").select(F.col("match").alias("path"), F.concat(folder, G.last_part(bare), F.lit(".md")).alias("new_path"))
    renames = txt.union(free).groupBy("path").agg(F.min("new_path").alias("new_path")).join(here, "new_path", "left_anti")
    kept = miss.join(linked, "match", "left_semi").select("source", "target", F.regexp_replace("match", r"\.md\z", "").alias("new")).distinct()
    pairs = kept.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("target", "new"))).alias("pairs"))
    written = files.join(pairs, files["path"] == pairs["source"]).select("path", F.aggregate("pairs", F.col("content"), lambda c, x: T.replaced_link(c, x["target"], x["new"])).alias("new_content"))
    return renames.select("path", F.lit("rename").alias("action"), "new_path", F.lit(None).cast("string").alias("new_content"), F.lit("link target").alias("reason")).union(
        written.select("path", F.lit("write"), F.lit(None).cast("string"), "new_content", F.lit("link rewritten"))
    )
