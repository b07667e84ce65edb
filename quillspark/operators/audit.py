"""Audits of tags and frontmatter: one row an issue, and the edits that mend them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import FOLDER_TYPE_TAGS, TYPE_TAGS
from quillspark.functions import text as T
from quillspark.operators import graph as G

PROJECTS = "99-Archives/projects/"
LAWS = "03-Resources/Laws-Of-Software-Engineering/"


def lookup(c, table: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def type_tag(path):
    """By file name, else by the name of the folder; null for documents that are not checked."""
    parts = F.split(path, "/")
    return F.coalesce(lookup(F.element_at(parts, -1), TYPE_TAGS), F.when(F.size(parts) > 1, lookup(F.get(parts, F.size(parts) - 2), FOLDER_TYPE_TAGS)))


def required(notes: DataFrame, scope: str = "vault") -> DataFrame:
    """Checked documents with the tags they need: ``needs array<struct<tag, issue>>``, in order."""
    one = lambda tag, issue: F.struct(tag.alias("tag"), F.lit(issue).alias("issue"))
    layer = one(F.lit("layer/raw"), "missing_layer")
    p = F.col("path")
    projects = notes.filter(p.startswith(PROJECTS)).withColumn("type_tag", type_tag(p)).filter("type_tag IS NOT NULL")
    projects = projects.withColumn("needs", F.array(layer, one(F.col("type_tag"), "missing_type"), one(F.get(F.split("path", "/"), F.lit(2)), "missing_project"))).withColumn("malforms", F.lit(True)).drop("type_tag")
    if scope == "project":
        return projects
    laws = notes.filter(p.startswith(LAWS)).withColumn("needs", F.array(layer, one(F.lit("type/reference"), "missing_type"))).withColumn("malforms", F.lit(False))
    return projects.unionByName(laws)


def with_tag_issues(notes: DataFrame, scope: str = "vault") -> DataFrame:
    tags = F.when(F.col("has_fm"), T.listed_tags(F.col("fm_yaml"))).otherwise(F.array().cast("array<string>"))
    return required(notes, scope).withColumn("have", tags).withColumns({
        "missing": F.filter("needs", lambda x: ~F.array_contains("have", x["tag"])),
        "bad_line": F.when(F.col("malforms") & F.col("has_fm"), T.malformed_line(F.col("fm_yaml"))),
    })


def check_tags(notes: DataFrame, scope: str = "vault") -> DataFrame:
    """``(file, issue, detail)`` of documents under the projects folder (and, for the whole vault, the laws)."""
    found = with_tag_issues(notes, scope)
    missing = F.transform("missing", lambda x: F.struct(x["issue"].alias("issue"), F.concat(F.lit("Expected tag: "), x["tag"]).alias("detail")))
    bad = F.when(F.col("bad_line").isNotNull(), F.array(F.struct(F.lit("yaml_malform").alias("issue"), F.concat(F.lit("Malformed YAML: "), F.col("bad_line")).alias("detail")))).otherwise(F.array().cast("array<struct<issue:string,detail:string>>"))
    return found.select(F.col("path").alias("file"), F.explode(F.concat(bad, missing)).alias("x")).select("file", "x.issue", "x.detail")


def tag_fix_plan(notes: DataFrame, scope: str = "vault") -> DataFrame:
    found = with_tag_issues(notes, scope).filter("size(missing) > 0 OR bad_line IS NOT NULL")
    tags = F.transform("missing", lambda x: x["tag"])
    yaml = F.when(F.col("bad_line").isNotNull(), F.replace("fm_yaml", F.lit("]project:"), F.lit("]\nproject:"))).otherwise(F.col("fm_yaml"))
    found = found.withColumn("yaml", yaml)
    mended = F.when(F.size("missing") > 0, T.with_tags(F.col("yaml"), tags)).otherwise(F.col("yaml"))
    fresh = T.reassembled(F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]\n")), F.col("content"))
    new = F.when(F.col("has_fm"), T.reassembled(mended, F.col("body"))).when(F.size("missing") > 0, fresh).otherwise(F.col("content"))
    return edits(found.withColumn("new_content", new), "tags added")


def primary(path):
    """A primary document of a project folder."""
    parts = F.split(path, "/")
    return path.startswith(PROJECTS) & lookup(F.element_at(parts, -1), TYPE_TAGS).isNotNull()


def frontmatter_flags(notes: DataFrame) -> DataFrame:
    c = F.col("content")
    return notes.withColumns({
        "closing_brace_malform": T.glued_project(c), "broken_yaml_list": T.broken_tag_list(c), "empty_tags": T.empty_tags(c),
        "missing_frontmatter": primary(F.col("path")) & ~F.col("has_fm"),
    })


def check_frontmatter(notes: DataFrame) -> DataFrame:
    """``(file, issue, detail)``: up to four a note."""
    name = F.element_at(F.split("path", "/"), -1)
    kinds = [
        ("closing_brace_malform", F.lit("Opening --- and project: on same line")), ("broken_yaml_list", F.lit("tags: followed by non-list value")),
        ("empty_tags", F.lit("tags: [] — user decision required")), ("missing_frontmatter", F.concat(F.lit("PRIMARY doc "), name, F.lit(" has no frontmatter"))),
    ]
    rows = F.array(*(F.when(F.coalesce(F.col(k), F.lit(False)), F.struct(F.lit(k).alias("issue"), d.alias("detail"))) for k, d in kinds))
    return frontmatter_flags(notes).select(F.col("path").alias("file"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("file", "x.issue", "x.detail")


def frontmatter_fix_plan(notes: DataFrame) -> DataFrame:
    """Detectors run in order, each on the text as mended so far; missing frontmatter is put before the original text."""
    step = notes.withColumn("one", T.unglued_project(F.col("content")))
    step = step.withColumn("two", T.mended_tag_list(F.col("one")))
    parts = F.split("path", "/")
    kind = lookup(F.element_at(parts, -1), TYPE_TAGS)
    fresh = F.concat(F.lit("---\ntags: [layer/raw, "), kind, F.lit(", "), F.get(parts, F.lit(2)), F.lit("]\n---\n"), F.col("content"))
    new = F.when(primary(F.col("path")) & ~T.has_frontmatter(F.col("two")), fresh).otherwise(F.col("two"))
    return edits(step.withColumn("new_content", new), "frontmatter mended")


def file_counts(issues: DataFrame) -> DataFrame:
    """Issues and distinct files by kind."""
    return issues.groupBy("issue").agg(F.count("*").alias("issues"), F.count_distinct("file").alias("files"))


def totals(check: str, scanned: DataFrame, issues, fixed) -> DataFrame:
    """``(check, scanned, issues, fixed)`` by one aggregation over the rows a check looks at: how many, their issues, and how many of these a fix mends."""
    return scanned.agg(F.lit(check).alias("check"), F.count("*").alias("scanned"), F.coalesce(F.sum(issues), F.lit(0)).cast("long").alias("issues"), F.coalesce(F.sum(fixed), F.lit(0)).cast("long").alias("fixed"))


def tag_totals(notes: DataFrame, scope: str = "vault") -> DataFrame:
    """Totals of the tag check; a fix of a file mends all its issues."""
    n = F.size("missing") + F.col("bad_line").isNotNull().cast("int")
    return totals("tags", with_tag_issues(notes, scope), n, n)


def frontmatter_totals(notes: DataFrame) -> DataFrame:
    """Totals of the frontmatter check; ``fixed`` counts files that a fix changes, and empty tags are never mended."""
    flags = frontmatter_flags(notes)
    on = [F.coalesce(F.col(k), F.lit(False)).cast("int") for k in ("closing_brace_malform", "broken_yaml_list", "missing_frontmatter", "empty_tags")]
    return totals("frontmatter", flags, on[0] + on[1] + on[2] + on[3], ((on[0] + on[1] + on[2]) > 0).cast("int"))


def watched_totals(plan: DataFrame, notes: DataFrame, name: str) -> tuple[DataFrame, DataFrame, object, object]:
    """A plan and what it reads, with observers that count both as they pass: ``(notes, plan, scanned, fixed)``.

    The counts come with the action that writes the plan, so nothing is read a
    second time: ``scanned.get`` and ``fixed.get`` hold them when it is done.
    """
    from pyspark.sql import Observation

    scanned, fixed = Observation(f"{name} scanned"), Observation(f"{name} fixed")
    return notes.observe(scanned, F.count("*").alias("scanned")), plan.observe(fixed, F.count("*").alias("fixed")), scanned, fixed


def edits(df: DataFrame, reason: str) -> DataFrame:
    """Rows whose ``new_content`` differs, as edits."""
    return df.filter(~F.col("new_content").eqNullSafe(F.col("content"))).select(
        "path", F.lit("write").alias("action"), F.lit(None).cast("string").alias("new_path"), "new_content", F.lit(reason).alias("reason")
    )


__all__ = ["check_tags", "check_frontmatter", "tag_fix_plan", "frontmatter_fix_plan", "file_counts", "type_tag", "required", "edits", "G"]
