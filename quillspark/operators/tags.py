"""Tags: counts, co-occurrence, clusters and canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.components import connected_components

SIMILAR = 0.6


def exploded(notes: DataFrame) -> DataFrame:
    """``(path, pos, tag)`` of inline tags."""
    return notes.select("path", F.posexplode(T.inline_tags(F.col("fm_yaml")))).select("path", "pos", F.col("col").alias("tag"))


def counts(notes: DataFrame) -> DataFrame:
    """Tags by occurrences, repeats within a note counted."""
    return exploded(notes).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def tag_docs(notes: DataFrame) -> DataFrame:
    """Distinct ``(tag, path)``, tags normalized."""
    return exploded(notes).select(T.normalized_tag(F.col("tag")).alias("tag"), "path").distinct()


def doc_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("tag").agg(F.count("*").alias("docs"))


def jaccard(docs: DataFrame, most: float = SIMILAR) -> DataFrame:
    """Pairs ``a < b`` of tags whose document sets overlap by more than ``most``.

    Only tags that share a document can, so pairs come from the documents' own
    tag lists - at most a few dozen tags each - and are counted, not compared.
    Set sizes go with the tags, and pairs that their sizes rule out become no rows.
    """
    sized = docs.join(doc_counts(docs), "tag").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("tag", "docs"))).alias("t"))
    left = sized.select("t", F.posexplode("t").alias("i", "a"))
    alike = lambda y: F.least(F.col("a.docs"), y["docs"]) / F.greatest(F.col("a.docs"), y["docs"]) > most
    pairs = left.select("a", F.explode(F.filter(F.slice("t", F.col("i") + 2, F.size("t")), alike)).alias("b"))
    both = pairs.groupBy(F.col("a.tag").alias("a"), F.col("b.tag").alias("b"), F.col("a.docs").alias("na"), F.col("b.docs").alias("nb")).agg(F.count("*").alias("both"))
    ratio = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return both.withColumn("ratio", F.round(ratio, 6)).filter(ratio > most).select("a", "b", "both", "ratio")


def clusters(docs: DataFrame) -> DataFrame:
    """``(canonical, aliases, document_count)``: linked tags under the most used one (ties by name); lone tags too."""
    member = membership(docs)
    own = F.col("tag") == F.col("canonical")
    return member.groupBy("canonical").agg(F.array_sort(F.collect_list(F.when(~own, F.col("tag")))).alias("aliases"), F.max(F.when(own, F.col("docs"))).alias("document_count"))


def membership(docs: DataFrame) -> DataFrame:
    """``(tag, docs, canonical)`` of every tag."""
    found = connected_components(jaccard(docs).select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = doc_counts(docs).join(found.withColumnRenamed("node", "tag"), "tag", "left").withColumn("group", F.coalesce("component", "tag"))
    best = named.groupBy("group").agg(F.min(F.struct((-F.col("docs")).alias("m"), "tag")).alias("top"))
    return named.join(best, "group").select("tag", "docs", F.col("top.tag").alias("canonical"))


def merged_suggestions(clusters: DataFrame, suggested: DataFrame) -> DataFrame:
    """Suggested aliases ``(canonical, aliases)`` added to a cluster that has the name, as canonical or alias; others become clusters of 0 documents."""
    names = clusters.select("canonical", F.explode(F.concat(F.array("canonical"), "aliases")).alias("tag"))
    more = suggested.select(F.col("canonical").alias("tag"), F.col("aliases").alias("more"))
    hit = names.join(more, "tag").groupBy("canonical").agg(F.flatten(F.collect_list(F.concat(F.array("tag"), "more"))).alias("more"))
    old = clusters.join(hit, "canonical", "left").withColumn("aliases", F.when(F.col("more").isNull(), F.col("aliases")).otherwise(F.array_remove(F.array_union("aliases", F.array_sort("more")), F.col("canonical")))).drop("more")
    new = more.join(names, "tag", "left_anti").select(F.col("tag").alias("canonical"), F.col("more").alias("aliases"), F.lit(0).cast("long").alias("document_count"))
    return old.unionByName(new)


def before_after(notes: DataFrame) -> DataFrame:
    """Tags as written, and distinct canonical ones a document."""
    docs = tag_docs(notes)
    after = docs.join(membership(docs), "tag").select("path", "canonical").distinct().agg(F.count("*").alias("after"))
    return exploded(notes).agg(F.count("*").alias("before")).join(after, F.lit(True))


def normalization_plan(notes: DataFrame, member: DataFrame) -> DataFrame:
    """Tag lines rewritten to sorted distinct canonical tags, where that changes the text."""
    names = tag_docs(notes).join(member.select("tag", "canonical"), "tag", "left").groupBy("path").agg(F.array_sort(F.collect_set(F.coalesce("canonical", "tag"))).alias("names"))
    line = F.concat(F.lit("tags: ["), F.array_join("names", ", "), F.lit("]"))
    new = F.regexp_replace(F.col("content"), F.lit(r"(?s)\A(.*?)(?dm:^tags:\s*\[[^\n]*?\])"), F.concat(F.lit("$1"), F.regexp_replace(line, r"([\\$])", r"\\$1")))
    out = notes.join(names, "path").select("path", "content", new.alias("new_content"))
    return out.filter("new_content <> content").select("path", F.lit("write").alias("action"), F.lit(None).cast("string").alias("new_path"), "new_content", F.lit("tags normalized").alias("reason"))
