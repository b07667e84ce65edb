"""Note cards, their scores, attention lists, related notes and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import VaultConfig
from quillspark.functions import text as T

STALE_DAYS, RECENT_DAYS, PANEL, RELATED = 30, 90, 10, 5
ZONES = ["Inbox", "Projects", "Areas", "Resources", "Zettelkasten", "Archives"]


def zone(path):
    """``struct<kind, name>`` by the first folders; name null but for projects and areas."""
    p = F.split(path, "/")
    make = lambda kind, name=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    return (
        F.when(p[0] == "00-Inbox", make("Inbox")).when(p[0] == "02-Areas", make("Areas", F.coalesce(F.get(p, F.lit(1)), F.lit("general"))))
        .when(p[0] == "03-Resources", make("Resources")).when(p[0] == "10-Zettelkasten", make("Zettelkasten"))
        .when((p[0] == "99-Archives") & (F.get(p, F.lit(1)) == "projects") & F.get(p, F.lit(2)).isNotNull(), make("Projects", F.get(p, F.lit(2)))).otherwise(make("Archives"))
    )


def zone_label(z):
    return F.when(z["name"].isNotNull(), F.concat(z["kind"], F.lit("/"), z["name"])).otherwise(z["kind"])


def days_since(day, as_of, missing: int):
    """Whole days up to ``as_of``, 0 at least; ``missing`` without a day."""
    return F.coalesce(F.greatest(F.datediff(as_of, day), F.lit(0)), F.lit(missing))


def scanned(files: DataFrame, config: VaultConfig | None = None) -> DataFrame:
    """Notes of the dashboard: its own exclusions, top level only."""
    config = config or VaultConfig()
    top = F.split("path", "/")[0]
    nested = F.size(F.split("path", "/")) > 1
    out = files.filter(F.col("path").endswith(".md") & ~(nested & (top.isin(config.dashboard_excluded()) | top.startswith("."))) & ~(~nested & top.startswith(".")))
    c, yaml = F.col("content"), T.frontmatter(F.col("content"))
    stem = F.expr("left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - 3)")
    tags = T.note_tags(yaml)
    return out.select(
        "path", T.title(c, stem).alias("title"), T.summary(yaml, T.body(c)).alias("summary"), tags.alias("tags"), zone(F.col("path")).alias("zone"),
        F.get(F.filter(tags, lambda t: t.startswith("layer/")), F.lit(0)).alias("layer"), F.size(T.words(T.body(c))).cast("long").alias("word_count"),
        T.body(c).contains("```mermaid").alias("has_mermaid"), "modified_on",
    )


def vitality(as_of):
    """1 to 5 of age, links, tags, length and being a hub."""
    age = F.least(days_since(F.col("modified_on"), as_of, RECENT_DAYS) / RECENT_DAYS, F.lit(1.0))
    raw = (
        (1.0 - age) * 0.30 + F.least((F.col("incoming_links") + F.col("outgoing_links")) / 10.0, F.lit(1.0)) * 0.25 + F.least(F.size("tags") / 7.0, F.lit(1.0)) * 0.20
        + F.least(F.col("word_count") / 1000.0, F.lit(1.0)) * 0.15 + F.when(F.col("incoming_links") >= 3, 1.0).otherwise(0.0) * 0.10
    )
    return F.greatest(F.least(F.round(raw * 5.0), F.lit(5.0)), F.lit(1.0)).cast("int")


def note_cards(files: DataFrame, degrees: DataFrame, as_of: str, config: VaultConfig | None = None) -> DataFrame:
    """Scanned notes with links in and out (0 outside the graph), vitality and orphan flag; ``as_of`` is the day of scoring."""
    day = F.to_date(F.lit(as_of))
    cards = scanned(files, config).join(degrees, "path", "left").withColumns({"incoming_links": F.coalesce("incoming", F.lit(0).cast("long")), "outgoing_links": F.coalesce("outgoing", F.lit(0).cast("long"))}).drop("incoming", "outgoing")
    return cards.withColumns({"vitality": vitality(day), "is_orphan": F.col("incoming_links") + F.col("outgoing_links") == 0, "age_days": days_since(F.col("modified_on"), day, 999)})


CARD_ORDER = [F.desc, "vitality"], [F.desc, "modified_on"], [F.asc, "path"]


def ordered(cards: DataFrame) -> DataFrame:
    return cards.orderBy(*(f(c) for f, c in CARD_ORDER))


def attention(cards: DataFrame, kind: str, n: int = PANEL) -> DataFrame:
    """The first ``n`` cards that are ``orphan``, ``stale`` or ``untagged``."""
    which = {"orphan": F.col("is_orphan"), "stale": F.col("age_days") > STALE_DAYS, "untagged": F.size("tags") == 0}[kind]
    return ordered(cards.filter(which)).limit(n)


def zone_counts(cards: DataFrame) -> DataFrame:
    """All six zones with their cards."""
    zones = cards.sparkSession.createDataFrame([(i, z) for i, z in enumerate(ZONES)], "pos int, kind string")
    n = cards.groupBy(F.col("zone.kind").alias("kind")).agg(F.count("*").alias("n"))
    return zones.join(n, "kind", "left").select("pos", "kind", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def find_related(cards: DataFrame, edges: DataFrame, path: str, n: int = RELATED) -> DataFrame:
    """``(path, score)``: 2 for each link either way, 1 for each shared tag; the best ``n``, then those that have cards."""
    links = edges.filter(F.col("dst") == path).select(F.col("src").alias("path"), F.lit(2).alias("s")).union(edges.filter(F.col("src") == path).select("dst", F.lit(2)))
    own = cards.filter(F.col("path") == path).select(F.explode(F.array_distinct("tags")).alias("tag"))
    shared = cards.filter(F.col("path") != path).select("path", F.explode("tags").alias("tag")).join(own, "tag").select("path", F.lit(1))
    best = links.union(shared).groupBy("path").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "path").limit(n)
    return best.join(cards.select("path", "title"), "path").select("path", "title", "score")


def search(cards: DataFrame, tags: list[str] | None = None, text: str = "", zones: list[str] | None = None) -> DataFrame:
    """Cards with any of ``tags``, with ``text`` in title, path, summary or a tag (any case), in any of ``zones``."""
    out = cards
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if text:
        t = text.lower()
        has = lambda c: F.lower(c).contains(t)
        out = out.filter(has(F.col("title")) | has(F.col("path")) | has(F.coalesce("summary", F.lit(""))) | F.exists("tags", has))
    return out.filter(F.col("zone.kind").isin(zones)) if zones else out


def since(cards: DataFrame, period: str, as_of: str) -> DataFrame:
    """Cards changed ``today``, in ``this_week`` or ``this_month`` as of a day, or ``all``."""
    day = F.to_date(F.lit(as_of))
    start = {"today": day, "this_week": F.trunc(day, "week"), "this_month": F.trunc(day, "month")}.get(period)
    return cards if start is None else cards.filter(F.col("modified_on") >= start)
