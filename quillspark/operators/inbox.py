"""The inbox: review states and where confirmed notes go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quillspark.config import VaultConfig
from quillspark.functions import text as T

FIELDS = ["status", "summary", "processed_at", "category", "subcategory", "candidate_type", "recommended_action", "reasoning", "detail"]
# Categories by what kind of note was proposed.
CATEGORY_OF = {"ConceptSeed": "Zettelkasten", "Project": "Projects", "Area": "Areas", "Resource": "Resources"}


def with_frontmatter(files: DataFrame) -> DataFrame:
    """``fm`` (struct of one-line fields, null where absent) and ``rest`` of every note."""
    out = files.withColumn("parts", T.split_frontmatter(F.col("content")))
    get = lambda n: F.nullif(T.unquoted(F.regexp_extract(F.coalesce("parts.yaml", F.lit("")), rf"(?dm)^{n}:[^\S\n]*([^\n]*)$", 1)), F.lit(""))
    return out.withColumns({"fm": F.struct(*(get(n).alias(n) for n in FIELDS)), "rest": F.col("parts.body")}).drop("parts")


def inbox(files: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """Markdown and PDF files right in the inbox, and Markdown anywhere under the conversions folder."""
    config = config or VaultConfig()
    p = F.split("path", "/")
    right = (p[0] == config.inbox_dir) & (F.size(p) == 2) & (F.col("path").endswith(".md") | F.col("path").endswith(".pdf"))
    return files.filter(right | (F.col("path").startswith("temp_conversions/") & F.col("path").endswith(".md")))


def inbox_count(files: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """Entries right in the inbox, folders among them."""
    p = F.split("path", "/")
    return files.filter((p[0] == (config or VaultConfig()).inbox_dir) & (F.size(p) > 1)).agg(F.count_distinct(p[1]).alias("inbox_count"))


def targets(fm: str = "fm"):
    """Category, subcategory and detail of a confirmed note, with their fallbacks."""
    kind = F.col(f"{fm}.candidate_type")
    named = F.lit(None).cast("string")
    for k, v in CATEGORY_OF.items():
        named = F.when(kind == k, v).otherwise(named)
    category = F.coalesce(F.col(f"{fm}.category"), named, kind, F.lit("Resources"))
    sub = F.coalesce(F.col(f"{fm}.subcategory"), F.when(category == "Zettelkasten", "fleeting").otherwise("Reference"))
    detail = F.coalesce(F.col(f"{fm}.detail"), F.when(category == "Resources", "Articles-Papers").otherwise(""))
    return category, sub, detail


def destination(category, sub, detail, config: VaultConfig | None = None):
    """The folder for a category, in any case; what is unknown goes to the archive."""
    zk = (config or VaultConfig()).zettelkasten_dir
    c, s, d = F.lower(category), F.lower(sub), F.lower(detail)
    reference = F.concat(F.lit("03-Resources/Reference/"), F.when(d == "books-notes", "Books-Notes").when(d == "tutorials-guides", "Tutorials-Guides").when(d == "cheat-sheets", "Cheat-Sheets").otherwise("Articles-Papers"))
    return (
        F.when(c == "projects", "01-Projects").when(c == "areas", "02-Areas").when(c == "archive", "99-Archives")
        .when(c == "zettelkasten", F.concat(F.lit(zk + "/"), F.when(s.isin("literature", "permanent"), s).otherwise("fleeting")))
        .when(c == "resources", F.when(s == "technical", "03-Resources/Technical").when(s == "ideas", f"{zk}/fleeting").when(s == "reference", reference).otherwise("03-Resources/Reference/Articles-Papers"))
        .otherwise("99-Archives")
    )


def routing(files: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """``(path, state, new_path)``: ``analyse`` new notes, leave those under review or done, ``move`` confirmed ones. Nothing moves unconfirmed."""
    rows = with_frontmatter(inbox(files, config))
    status = F.col("fm.status")
    state = F.when(F.col("path").endswith(".pdf"), "convert").when(status == "confirmed", "move").when(status.isin("needs_review", "processed"), "skip").otherwise("analyse")
    new = F.concat(destination(*targets(), config), F.lit("/"), F.element_at(F.split("path", "/"), -1))
    return rows.select("path", state.alias("state"), F.when(state == "move", new).alias("new_path"), "content", "fm", "rest")


def field_set(content, name: str, value: str):
    """A one-line frontmatter field set; other lines, known or not, stay as they are."""
    parts = T.split_frontmatter(content)
    pattern = rf"(?dm)^{name}:[^\n]*$"
    yaml = F.when(parts["yaml"].rlike(pattern), F.regexp_replace(parts["yaml"], pattern, f"{name}: {value}")).otherwise(F.concat(F.coalesce(parts["yaml"], F.lit("")), F.when(F.coalesce(parts["yaml"], F.lit("")) == "", "").otherwise("\n"), F.lit(f"{name}: {value}")))
    return F.concat(F.lit("---\n"), yaml, F.lit("\n---\n"), parts["body"])


def process(files: DataFrame, as_of: str, analyse=None, config: VaultConfig | None = None) -> DataFrame:
    """Edits of one pass: confirmed notes move as processed; new ones go under review with what ``analyse`` proposes.

    ``analyse(df)`` adds ``proposed map<string,string>`` to the notes; none proposes nothing.
    """
    rows = routing(files, config)
    done = rows.filter("state = 'move'").select("path", F.lit("move").alias("action"), "new_path", field_set(field_set(F.col("content"), "status", "processed"), "processed_at", as_of).alias("new_content"), F.lit("confirmed").alias("reason"))
    fresh = rows.filter("state = 'analyse'")
    fresh = analyse(fresh) if analyse else fresh.withColumn("proposed", F.create_map().cast(T_.MapType(T_.StringType(), T_.StringType())))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("proposed")), lambda x: F.concat(x["key"], F.lit(": "), x["value"], F.lit("\n"))), "")
    base = field_set(F.col("content"), "status", "needs_review")
    text = F.regexp_replace(base, r"(?s)\A---\n(.*?\n)---\n", F.concat(F.lit("---\n$1"), F.regexp_replace(lines, r"([\\$])", r"\\$1"), F.lit("---\n")))
    new = fresh.select("path", F.lit("write"), F.lit(None).cast("string"), text, F.lit("needs review"))
    return done.union(new)
