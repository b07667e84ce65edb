"""The link graph of a corpus: notes, links, resolved edges and what is measured on them.

``files(path, ext, content, ...)`` is the one input; every function returns a
DataFrame.  Link targets are resolved by equi-joins on lower-cased keys, one row
a key on the index side (the smallest path), so nothing is assumed to be small
and Spark broadcasts what it finds to be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import EXCLUDED_DIRS
from quillspark.functions import text as T
from quillspark.operators.components import connected_components, written

HUBS = 10


def excluded(path, names: list[str]):
    """Whether any part of a path is one of ``names``."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def ancestors(path):
    """The folders that a path lies in, from the top down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, n), "/")))


def nested_repos(files: DataFrame) -> DataFrame:
    """``(root)``: folders below the top that hold ``.git``, a file or a folder."""
    hit = F.regexp_extract("path", r"\A(.+?)/\.git(?:/|\z)", 1)
    return files.filter(F.col("path").contains("/.git")).select(hit.alias("root")).filter("root <> ''").distinct()


def outside_nested(files: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Without files under a nested repository; ``repos(root)`` lists their folders.

    Each path asks for its folders, an equi-join on them: only the paths that a
    repository holds are looked up by path again, so no text is copied a folder.
    """
    if repos is None:
        return files
    inside = files.select("path", F.explode(F.array_compact(ancestors(F.col("path")))).alias("root")).join(repos.select("root").distinct(), "root", "left_semi")
    return files.join(inside.select("path").distinct(), "path", "left_anti")


def notes(files: DataFrame, exclude: list[str] | None = None, repos: DataFrame | None = None) -> DataFrame:
    """Markdown files of the graph with their names, frontmatter and body taken apart."""
    names = EXCLUDED_DIRS if exclude is None else exclude
    kept = files.filter(F.col("path").endswith(".md"))
    if names:
        kept = kept.filter(~excluded(F.col("path"), names))
    kept = outside_nested(kept, repos)
    parts = F.split("path", "/")
    return kept.withColumns({
        "stem_path": F.expr("left(path, length(path) - 3)"),
        "stem": F.expr("left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - 3)"),
        "parent": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"),
        "depth": F.size(parts),
        "fm_yaml": T.frontmatter(F.col("content")),
        "has_fm": T.has_frontmatter(F.col("content")),
        "body": T.body(F.col("content")),
    })


def links(notes: DataFrame) -> DataFrame:
    """One row a link occurrence outside code: ``(src, pos, raw_target, alias)``."""
    return notes.select(F.col("path").alias("src"), F.posexplode(T.wikilinks(F.col("content")))).select("src", "pos", F.col("col.target").alias("raw_target"), F.col("col.alias").alias("alias"))


def path_index(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.lower("stem_path").alias("k")).agg(F.min("path").alias("p"))


def stem_index(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.lower("stem").alias("k")).agg(F.min("path").alias("p"))


def last_part(c):
    return F.element_at(F.split(c, "/"), -1)


def resolved(links: DataFrame, notes: DataFrame, target: str = "raw_target") -> DataFrame:
    """``links`` with ``dst``: by full path, then without ``.md``, then by last name; null if none.

    Targets repeat, so each distinct one is resolved once.
    """
    asked = links.select(F.col(target).alias("asked")).distinct().withColumn("k1", F.lower(F.replace("asked", F.lit("\\"), F.lit("/"))))
    asked = asked.withColumn("k2", F.regexp_replace("k1", r"(\.md)+\z", "")).withColumn("k3", last_part(F.col("k2")))
    paths, stems = path_index(notes), stem_index(notes)
    for n, index in ((1, paths), (2, paths), (3, stems)):
        asked = asked.join(index.select(F.col("k").alias(f"k{n}"), F.col("p").alias(f"p{n}")), f"k{n}", "left")
    found = asked.select("asked", F.coalesce("p1", "p2", "p3").alias("dst"))
    return links.join(found, links[target] == found["asked"], "left").drop("asked")


def edges(notes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Distinct ``(src, dst)`` of resolved links."""
    found = resolved(links(notes), notes) if found is None else found
    return found.filter("dst IS NOT NULL").select("src", "dst").distinct()


def orphans(notes: DataFrame, edges: DataFrame, exclude_seeded: bool = False, least_bytes: int = 0) -> DataFrame:
    """Notes without links in or out, with the report's filters."""
    out = notes.join(edges.select(F.col("src").alias("path")), "path", "left_anti").join(edges.select(F.col("dst").alias("path")), "path", "left_anti")
    if exclude_seeded:
        out = out.filter(~(F.col("path").contains("/seeded/") | F.col("path").startswith("seeded/")))
    if least_bytes:
        out = out.filter((F.octet_length("content") >= least_bytes) & (F.octet_length(T.strip_frontmatter(F.col("content"))) >= least_bytes))
    return out.select("path")


def broken_edges(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Edges to what is no note."""
    return edges.join(notes.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "dst")


def degrees(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, incoming, outgoing)`` of every note, 0 where none."""
    ends = edges.select(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    sums = ends.groupBy("path").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    return notes.select("path").join(sums, "path", "left").select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("incoming", "outgoing")))


def hub_notes(edges: DataFrame, n: int = HUBS) -> DataFrame:
    """The ``n`` notes most linked to; ties by path."""
    return edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("incoming")).orderBy(F.desc("incoming"), "path").limit(n)


def components(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, component)`` of every note, named by its smallest path; links count either way."""
    found = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return notes.select("path").join(found.withColumnRenamed("node", "path"), "path", "left").select("path", F.coalesce("component", "path").alias("component"))


#: A middle note of more ways through it than this is heavy: its ways are dealt to several tasks.
HEAVY = 1 << 20


def two_hop_pairs(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Unordered pairs at distance 1 or 2 along the links; ``source`` is the side the way starts from, the smaller if both do.

    A note with very many links in and out has their product of ways: its incoming
    links are dealt to as many keys as bound a key's ways, and meet a copy of its
    outgoing ones on each.  All others keep one key and are not copied.
    """
    one = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = one.select(F.col("b").alias("m"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(one.select("a", F.lit(0), F.lit(1)))
    ways = ends.groupBy("m").agg(F.sum("i").cast("double").alias("i"), F.sum("o").cast("double").alias("o")).filter("i * o > 0")
    keys = written(ways.filter(F.col("i") * F.col("o") > heavy).select(F.col("m").alias("b"), F.ceil(F.col("i") * F.col("o") / heavy).cast("int").alias("keys")), "heavy")
    into = one.join(keys, "b", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("keys")), F.lit(0)).cast("int"))
    out = one.select(F.col("a").alias("b"), F.col("b").alias("c")).join(keys, "b", "left")
    step = out.select("b", "c", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("keys"), F.lit(1)) - 1)).alias("salt"))
    two = into.select("a", "b", "salt").join(step, ["b", "salt"]).filter("a <> c").select("a", F.col("c").alias("b"))
    pairs = one.union(two)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.min("a").alias("source")).select("source", F.when(F.col("source") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("target"))


def two_hop_classes(edges: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The same ways in bounded rows: pairs through notes of at most ``most`` ways, and for the others who is on which side.

    ``(source, target)`` as ``two_hop_pairs`` makes them of all links and light
    middles; ``(middle, path, side)`` with side ``in`` or ``out``: every ``in`` member
    of a middle is two steps from every ``out`` member but itself.  Rows grow with
    links, not with their products.
    """
    one = edges.filter("src <> dst").distinct()
    ends = one.select(F.col("dst").alias("m"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(one.select("src", F.lit(0), F.lit(1)))
    ways = ends.groupBy("m").agg(F.sum("i").cast("double").alias("i"), F.sum("o").cast("double").alias("o"))
    big = written(ways.filter(F.col("i") * F.col("o") > most).select("m"), "heavy")
    into = one.join(big, F.col("dst") == F.col("m"), "left_anti").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    out = one.join(big, F.col("src") == F.col("m"), "left_anti").select(F.col("src").alias("b"), F.col("dst").alias("c"))
    pairs = one.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(into.join(out, "b").filter("a <> c").select("a", F.col("c").alias("b")))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    found = pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.min("a").alias("source")).select("source", F.when(F.col("source") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("target"))
    sides = one.join(big, F.col("dst") == F.col("m")).select(F.col("m").alias("middle"), F.col("src").alias("path"), F.lit("in").alias("side"))
    sides = sides.union(one.join(big, F.col("src") == F.col("m")).select("m", "dst", F.lit("out")))
    return found, sides


def graph_health(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: notes, links, average, orphans, components, broken edges, and the hubs.

    The names of the notes are written once, so that no figure reads texts.
    """
    notes = written(notes.select("path"), "names")
    n = notes.agg(F.count("*").alias("total_notes"))
    e = edges.agg(F.count("*").alias("total_links"))
    o = orphans(notes, edges).agg(F.count("*").alias("orphan_count"))
    b = broken_edges(edges, notes).agg(F.count("*").alias("broken_links"))
    c = components(notes, edges).agg(F.count_distinct("component").alias("components"))
    h = hub_notes(edges).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("incoming")).alias("m"), "path"))), lambda x: F.concat_ws(":", x["path"], (-x["m"]).cast("string"))), ",").alias("hubs"))
    out = n
    for one in (e, o, b, c, h):  # one row each
        out = out.join(one, F.lit(True))
    return out.withColumn("average_links", F.when(F.col("total_notes") > 0, F.round(F.col("total_links") / F.col("total_notes"), 6)).otherwise(F.lit(0.0)))


def page_links(pages: DataFrame) -> DataFrame:
    """The same graph of web pages: distinct ``(page_id, href)`` with the page that the address is of, if any."""
    href = r"""href=["']([^"'#\s>]+)"""
    out = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(href), F.lit(1)))).alias("href"))
    of = pages.filter("url IS NOT NULL").groupBy(F.col("url").alias("href")).agg(F.min("page_id").alias("target_id"))
    return out.join(of, "href", "left").select("page_id", "href", "target_id")
