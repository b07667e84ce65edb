"""Hub notes of projects, the home note, the index, and book projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import VaultConfig
from quillspark.functions import text as T
from quillspark.operators import graph as G
from quillspark.operators.audit import edits
from quillspark.operators.bridges import project_docs

# Sections that other steps own, the group of a project's topmost notes, and where archived projects lie.
PRESERVED = ["## Related Projects", "## Key Concepts"]
CORE = "Core Docs"
ARCHIVED = "99-Archives/projects"


def groups(notes: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """``(project, grp, links)``: each project folder's notes by subfolder, in order; those at its top are core documents."""
    docs = project_docs(notes, config)
    p = F.split("path", "/")
    grp = F.when(F.size(p) == 2, F.lit(CORE)).otherwise(F.array_join(F.slice(p, 2, F.size(p) - 2), "/"))
    return docs.groupBy("project", grp.alias("grp")).agg(F.array_sort(F.collect_list("stem_path")).alias("links"))


def hub_plan(notes: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """Project hubs written anew, core documents first, sections kept that other steps own."""
    line = F.array_join(F.transform("links", lambda x: F.concat(F.lit("- [["), x, F.lit("]]\n"))), "")
    head = F.when(F.col("grp") == CORE, F.lit(CORE)).otherwise(T.capitalized_path(F.col("grp")))
    parts = groups(notes, config).select("project", F.struct((F.col("grp") != CORE).alias("late"), "grp", F.concat(F.lit("## "), head, F.lit("\n"), line, F.lit("\n")).alias("text")).alias("part"))
    text = parts.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("text"))
    fresh = F.concat(F.lit("---\nproject: "), "project", F.lit("\ntype: moc\ntags: ["), "project", F.lit("]\n---\n\n# "), T.capitalized(F.col("project")), F.lit(" MOC\n\n"), "text")
    new = text.select(F.concat("project", F.lit("/"), "project", F.lit(".md")).alias("path"), fresh.alias("fresh"))
    p = F.split("path", "/")
    hubs = notes.select("path", "content").filter(F.col("path") == F.concat(p[0], F.lit("/"), p[0], F.lit(".md")))  # no other text is moved to the join
    out = new.join(hubs, "path", "left")
    kept = F.when(F.col("content").isNull(), F.lit("")).otherwise(T.preserved_sections(F.col("content"), PRESERVED))
    return edits(out.withColumn("new_content", F.concat("fresh", kept)), "project hub")


def hubs_present(notes: DataFrame) -> DataFrame:
    """``P/P.md`` notes, sorted."""
    p = F.split("path", "/")
    return notes.filter((F.size(p) == 2) & (F.concat(p[0], F.lit(".md")) == F.get(p, F.lit(1)))).select("path").orderBy("path")


def home_plan(notes: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """The home note: a link to every project hub."""
    names = groups(notes, config).select("project").distinct().agg(F.array_sort(F.collect_list("project")).alias("p"))
    text = F.concat(F.lit("---\ntype: moc\ntags: [home]\n---\n\n# Home\n\n## Projects\n"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("- [["), x, F.lit("/"), x, F.lit("]]\n"))), ""))
    old = notes.filter("path = 'Home.md'").select("path", "content")
    out = names.select(F.lit("Home.md").alias("path"), text.alias("text")).join(old, "path", "left")
    kept = F.when(F.col("content").isNull(), F.lit("")).otherwise(T.preserved_sections(F.col("content"), PRESERVED))
    return edits(out.withColumn("new_content", F.concat("text", kept)), "home note")


def project_links(notes: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """Archived projects: their hub if they have one, else the folder with a slash."""
    config = config or VaultConfig()
    p = F.split("path", "/")
    inside = notes.filter(F.col("path").startswith(ARCHIVED + "/") & (F.size(p) > 3)).withColumn("name", F.get(p, F.lit(2)))
    inside = inside.filter(~F.col("name").startswith(".") & ~F.col("name").isin(config.all_system_dirs() + config.exclude))
    hub = F.max((F.col("path") == F.concat(F.lit(ARCHIVED + "/"), "name", F.lit("/"), "name", F.lit(".md"))).cast("int"))
    folder = F.concat(F.lit(ARCHIVED + "/"), "name", F.lit("/"))
    return inside.groupBy("name").agg(hub.alias("hub")).select(F.when(F.col("hub") == 1, F.concat(folder, "name")).otherwise(folder).alias("link"))


# The index note's headings, and what stands under one that has nothing.
SECTIONS = ["Areas", "Active Projects", "Zettelkasten (Wiki Layer)", "Key Concepts", "Governance"]
EMPTY = ["No area notes found", "No active projects found", "No zettelkasten notes found", "Build vault graph first to see key concepts", ""]


def index_sections(notes: DataFrame, edges: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """``(section, pos, line)`` of the index, in order of section and position."""
    config = config or VaultConfig()
    under = lambda d: notes.filter(F.col("path").startswith(d + "/")).select(F.col("stem_path").alias("link"))
    link = F.concat(F.lit("- [["), "link", F.lit("]]"))
    rows = [(0, under("02-Areas")), (1, project_links(notes, config)), (2, under(config.zettelkasten_dir))]
    out = None
    for n, links in rows:
        one = links.select(F.lit(n).alias("section"), F.col("link").alias("pos"), link.alias("line"))
        out = one if out is None else out.union(one)
    hubs = G.hub_notes(edges)
    out = out.union(hubs.select(F.lit(3), F.format_string("%012d %s", 10**11 - F.col("incoming"), F.col("path")), F.concat(F.lit("- [["), F.regexp_replace("path", r"\.[^./]*\z", ""), F.lit("]] ("), F.col("incoming").cast("string"), F.lit(" incoming)"))))
    fixed = notes.sparkSession.createDataFrame([(4, "0", "- [[TAGGING]]"), (4, "1", "- [[Home]]")], "section int, pos string, line string")
    readme = notes.filter("path = 'README.md'").select(F.lit(4), F.lit("2"), F.lit("- [[README]]"))
    return out.union(fixed).union(readme)


def index_plan(notes: DataFrame, edges: DataFrame, config: VaultConfig | None = None, protected: bool = False) -> DataFrame:
    """The index note written anew; a protected one only where it is absent."""
    config = config or VaultConfig()
    rows = index_sections(notes, edges, config).groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("lines"))
    heads = notes.sparkSession.createDataFrame([(i, s, e) for i, (s, e) in enumerate(zip(SECTIONS, EMPTY))], "section int, head string, none string")
    body = heads.join(rows, "section", "left").select(F.struct("section", F.concat(F.lit("## "), "head", F.lit("\n"), F.coalesce("lines", F.concat(F.lit("<!-- "), "none", F.lit(" -->\n"))), F.lit("\n")).alias("text")).alias("s"))
    top = f"---\nproject: root\ntype: agent-index\ntags: [agent-entry, layer/raw]\n---\n\n# {config.name} -- Agent Index\n\n"
    text = body.agg(F.concat(F.lit(top), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "")).alias("new_content")).withColumn("path", F.lit("index.md"))
    out = text.join(notes.filter("path = 'index.md'").select("path", "content"), "path", "left")
    return edits(out.filter("content IS NULL") if protected else out, "index")


def book_status(files: DataFrame) -> DataFrame:
    """Book projects, those with both of their two notes: ``(project, genre, draft, edit, publish, sources)``."""
    p = F.split("path", "/")
    inside = files.filter(F.col("path").startswith("01-Projects/") & (F.size(p) > 2)).withColumns({"project": F.get(p, F.lit(1)), "rest": F.array_join(F.slice(p, 3, F.size(p)), "/")})
    has = lambda c: F.max(c.cast("int")) == 1
    rest = F.col("rest")
    out = inside.groupBy("project").agg(
        has(rest == "PRD.md").alias("prd"), has(rest == "STYLE.md").alias("style"), F.max(F.when(rest == "PRD.md", T.field(F.col("content"), "genre"))).alias("genre"),
        *(has(rest.startswith(d + "/")).alias(n) for d, n in (("drafts", "draft"), ("edits", "edit"), ("publish", "publish"), ("sources", "sources"))),
    )
    return out.filter("prd AND style").select("project", F.coalesce("genre", F.lit("")).alias("genre"), "draft", "edit", "publish", "sources")


def has_tag(content, tag: str):
    """``tag`` anywhere in the raw frontmatter."""
    return F.coalesce(T.raw_frontmatter(content).contains(tag), F.lit(False))


def book_sources(files: DataFrame, tag: str) -> DataFrame:
    """Notes tagged for a book."""
    return files.filter(F.col("path").endswith(".md") & has_tag(F.col("content"), tag)).select("path")


def book_source_plan(files: DataFrame, name: str) -> DataFrame:
    """Notes tagged ``book/name`` outside the book as links in its ``sources``, one a file name (the smallest path) and none that is there."""
    root = f"01-Projects/{name}/"
    found = book_sources(files.filter(~F.col("path").startswith(root)), f"book/{name}")
    target = F.concat(F.lit(root + "sources/"), F.element_at(F.split("path", "/"), -1))
    links = found.groupBy(target.alias("new_path")).agg(F.min("path").alias("path"))
    links = links.join(files.select(F.col("path").alias("new_path")), "new_path", "left_anti")
    return links.select("path", F.lit("link").alias("action"), "new_path", F.lit(None).cast("string").alias("new_content"), F.lit("book source").alias("reason"))


def book_export_plan(files: DataFrame, name: str, folder: str) -> DataFrame:
    """A book's files but hidden ones and sources, at any depth, as copies under ``folder``."""
    root = f"01-Projects/{name}/"
    rest = F.substring("path", len(root) + 1, 1 << 30)
    kept = files.filter(F.col("path").startswith(root) & ~F.exists(F.split(rest, "/"), lambda x: x.startswith(".") | (x == "sources")))
    return kept.select("path", F.lit("copy").alias("action"), F.concat(F.lit(f"{folder}/{name}/"), rest).alias("new_path"), F.col("content").alias("new_content"), F.lit("book export").alias("reason"))


# The two notes of a new book, its folders, and where its sources lead.
BOOK_PRD = "---\ntitle: {name}\ngenre: {genre}\nlanguage: {lang}\ntarget_audience: \nword_count_goal: 0\n---\n\n# {name}\n\n## Overview\n\n## Target Audience\n\n## Goals\n\n## Word Count Target\n"
BOOK_STYLE = "---\ntype: style-guide\n---\n\n# Style Guide\n\n## Voice\n\n## Tone\n\n## Forbidden Patterns\n"
BOOK_FOLDERS = ["drafts", "edits", "publish/cover"]
BOOK_SOURCES = "03-Resources"


def book_init_plan(files: DataFrame, name: str, genre: str = "", lang: str = "en") -> DataFrame:
    """A book's two notes where they are absent."""
    root = f"01-Projects/{name}/"
    texts = [(root + "PRD.md", BOOK_PRD.format(name=name, genre=genre, lang=lang)), (root + "STYLE.md", BOOK_STYLE)]
    new = files.sparkSession.createDataFrame(texts, "path string, new_content string")
    out = new.join(files.select("path"), "path", "left_anti")
    return out.select("path", F.lit("write").alias("action"), F.lit(None).cast("string").alias("new_path"), "new_content", F.lit("book").alias("reason"))


def book_folder_plan(files: DataFrame, name: str) -> DataFrame:
    """A book's folders, and its ``sources`` as a link to the resources, each where nothing is there or under it."""
    root = f"01-Projects/{name}/"
    rows = [(root + f, "folder", None) for f in BOOK_FOLDERS] + [(BOOK_SOURCES, "link", root + "sources")]
    new = files.sparkSession.createDataFrame(rows, "path string, action string, new_path string").withColumn("at", F.coalesce("new_path", "path"))
    held = files.filter(F.col("path").startswith(root)).select(F.explode(F.concat(F.array("path"), F.array_compact(G.ancestors(F.col("path"))))).alias("at")).distinct()
    return new.join(held, "at", "left_anti").select("path", "action", "new_path", F.lit(None).cast("string").alias("new_content"), F.lit("book").alias("reason"))


def folder_status(files: DataFrame, folders: list[str], names: list[str]) -> DataFrame:
    """``(name, present, items)``: entries right in each folder (null for an absent one), and whether each file is there (0 items)."""
    spark = files.sparkSession
    asked = spark.createDataFrame([(x, True) for x in folders] + [(x, False) for x in names], "name string, folder boolean")
    within = F.explode(F.array(*(F.when(F.col("path").startswith(d + "/"), F.struct(F.lit(d).alias("name"), F.split(F.substring("path", len(d) + 2, 1 << 30), "/")[0].alias("entry"))) for d in folders))) if folders else None
    found = spark.createDataFrame([], "name string, items long")
    if folders:
        found = files.select(within.alias("x")).filter("x IS NOT NULL").select("x.*").distinct().groupBy("name").agg(F.count("*").alias("items"))
    there = files.filter(F.col("path").isin(names)).select(F.col("path").alias("name"), F.lit(0).cast("long").alias("items")).distinct()
    return asked.join(found.union(there), "name", "left").select("name", F.col("items").isNotNull().alias("present"), "items")


def status_rollup(files: DataFrame) -> DataFrame:
    """``(level, folder, ext, state, files, notes, bytes)``: every folder's files at any depth, by extension and by review state.

    Each file counts in all its folders (the whole vault is the folder without a
    name, of level 0): the folders are exploded once, without texts, and one
    aggregation makes the sets (folder), (folder, ext) and (folder, state); ext and
    state are null where they are summed over.  A state is the frontmatter's
    ``status``, ``none`` without one.
    """
    name = F.element_at(F.split("path", "/"), -1)
    state = F.coalesce(F.nullif(T.unquoted(F.regexp_extract(F.split("content", "\n---", 2)[0], r"(?dm)^status:[^\S\n]*([^\n]*)$", 1)), F.lit("")), F.lit("none"))
    one = files.select(
        F.concat(F.array(F.lit("")), F.array_compact(G.ancestors(F.col("path")))).alias("folders"), F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit("")).alias("ext"),
        F.when(F.col("content").startswith("---\n"), state).otherwise(F.lit("none")).alias("state"), F.col("path").endswith(".md").alias("note"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"),
    )
    # Summed by a file's own folder first, so that what is exploded grows with folders and not with files.
    own = one.groupBy("folders", "ext", "state").agg(F.count("*").alias("n"), F.count_if("note").alias("notes"), F.sum("size").alias("bytes"))
    rows = own.select(F.explode("folders").alias("folder"), "ext", "state", "n", "notes", "bytes")
    sets = rows.groupingSets([[F.col("folder")], [F.col("folder"), F.col("ext")], [F.col("folder"), F.col("state")]], F.col("folder"), F.col("ext"), F.col("state"))
    out = sets.agg(F.sum("n").alias("files"), F.sum("notes").alias("notes"), F.sum("bytes").alias("bytes"))
    level = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return out.select(level.alias("level"), "folder", "ext", "state", "files", "notes", "bytes")
