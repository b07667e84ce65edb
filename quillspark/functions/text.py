"""Markdown and frontmatter in Column expressions.

Patterns follow one dialect: ``(?d)`` makes only a line feed end a line, ``\\z``
is the end of the text, and white space is the Unicode kind (``(?U)``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WIKILINK = r"\[\[([^\]|]+?)(?:\|([^\]]+?))?\]\]"
#: A fenced block: from a line that opens it to the next that starts with the same marks, or the end.
FENCE = r"(?dms)^[^\S\n]*```.*?(?:^[^\S\n]*```[^\n]*$|\z)|^[^\S\n]*~~~.*?(?:^[^\S\n]*~~~[^\n]*$|\z)"
FRONTMATTER = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
FRONTMATTER_CRLF = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"
FRONTMATTER_LOOSE = r"(?s)\A---.*?---\n?"
TAGS_INLINE = r"(?dm)^tags:\s*\[(.*?)\]"
TAGS_HEADER = r"(?dm)^tags:\s*$"
TAGS_ITEM = r"(?dm)^\s+-\s+(.+)$"


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim(c), r'\A"+|"+\z', ""), r"\A'+|'+\z", "")


def lines(c: Column) -> Column:
    """Lines without their ends; no empty one after a last line feed."""
    parts = F.split(c, "\n", -1)
    parts = F.when(c.endswith("\n") | (c == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", ""))


def line_count(c: Column) -> Column:
    """How many ``lines`` there are, without making them."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit(""))) + F.when(c.endswith("\n") | (c == ""), 0).otherwise(1)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, FENCE, "")


def wikilinks(c: Column) -> Column:
    """``array<struct<target, alias>>`` of links outside fenced code, trimmed, empty targets dropped; alias null if none."""
    body = without_fences(c)
    targets = F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1))
    aliases = F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(2))
    pairs = F.transform(
        F.arrays_zip(targets.alias("t"), aliases.alias("a")),
        lambda x: F.struct(trim(x["t"]).alias("target"), F.nullif(trim(x["a"]), F.lit("")).alias("alias")),
    )
    return F.filter(pairs, lambda x: x["target"] != "")


def raw_targets(c: Column) -> Column:
    return F.transform(wikilinks(c), lambda x: x["target"])


def has_frontmatter(c: Column) -> Column:
    return c.rlike(FRONTMATTER)


def frontmatter(c: Column) -> Column:
    """The strict reader: text between the fences, empty if there are none."""
    return F.regexp_extract(c, FRONTMATTER, 1)


def body(c: Column) -> Column:
    return F.when(has_frontmatter(c), F.regexp_extract(c, FRONTMATTER, 2)).otherwise(c)


def split_frontmatter(c: Column) -> Column:
    """The reader that takes CRLF and a missing last line feed: ``struct<yaml, body>``; the body is as given where none is found."""
    unix = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    hit = unix.rlike(FRONTMATTER_CRLF)
    return F.struct(F.when(hit, F.regexp_extract(unix, FRONTMATTER_CRLF, 1)).alias("yaml"), F.when(hit, F.regexp_extract(unix, FRONTMATTER_CRLF, 2)).otherwise(c).alias("body"))


def strip_frontmatter(c: Column) -> Column:
    """The loose reader: the first closing ``---`` ends it, wherever it stands."""
    return F.regexp_replace(c, FRONTMATTER_LOOSE, "")


def raw_frontmatter(c: Column) -> Column:
    """The reader that asks for no closing fence; null without an opening one."""
    return F.when(c.startswith("---\n"), F.split(F.substring(c, 5, 1 << 30), "\n---", -1)[0])


def field(c: Column, name: str) -> Column:
    """First ``name:`` line of the raw frontmatter, trimmed; null if none."""
    found = F.filter(lines(raw_frontmatter(c)), lambda x: x.startswith(f"{name}:"))
    return trim(F.substring(F.get(found, F.lit(0)), len(name) + 2, 1 << 30))


def reassembled(yaml: Column, rest: Column) -> Column:
    return F.concat(F.lit("---\n"), F.regexp_replace(yaml, r"(?U)\s+\z", ""), F.lit("\n---\n"), rest)


def inline_tags(yaml: Column) -> Column:
    """Tags of the first ``tags: [...]`` line."""
    found = F.regexp_extract(yaml, TAGS_INLINE, 1)
    return F.filter(F.transform(F.split(found, ","), unquoted), lambda x: x != "")


def listed_tags(yaml: Column) -> Column:
    """Inline tags, else every indented list item if there is a bare ``tags:`` line."""
    items = F.filter(F.transform(F.regexp_extract_all(yaml, F.lit(TAGS_ITEM), F.lit(1)), unquoted), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(yaml.rlike(TAGS_INLINE), inline_tags(yaml)).when(yaml.rlike(TAGS_HEADER), items).otherwise(none)


def normalized_tag(c: Column) -> Column:
    return F.regexp_replace(trim(F.lower(c)), r"(?U)\s+", "-")


def with_tags(yaml: Column, missing: Column) -> Column:
    """``missing`` tags put into the YAML: into the inline line, in place of the list, or as a line of its own."""
    line = F.concat(F.lit("tags: ["), F.array_join(F.concat(listed_tags(yaml), F.array_except(missing, listed_tags(yaml))), ", "), F.lit("]"))
    literal = F.regexp_replace(line, r"([\\$])", r"\\$1")
    first = lambda text, pattern: F.regexp_replace(text, r"(?s)\A(.*?)" + pattern, F.concat(F.lit("$1"), literal))
    return (
        F.when(yaml.rlike(TAGS_INLINE), first(yaml, r"(?dm:^tags:\s*\[[^\n]*?\])"))
        .when(yaml.rlike(TAGS_HEADER), first(F.regexp_replace(yaml, TAGS_ITEM, ""), r"(?dm:^tags:\s*$)"))
        .otherwise(F.concat(line, F.lit("\n"), yaml))
    )


def title(c: Column, stem: Column) -> Column:
    """First line that starts with ``# ``, wherever it stands; else the stem."""
    found = F.filter(lines(c), lambda x: x.startswith("# "))
    return F.when(F.size(found) > 0, trim(F.regexp_replace(found[0], r"\A(# )+", ""))).otherwise(stem)


def cut(c: Column, most: int) -> Column:
    """At most ``most`` bytes, whole characters, with ``...`` if cut."""
    raw = F.substring(c.cast("binary"), 1, most)
    # A byte that continues a character is 10xxxxxx: step back over an unfinished one.
    back = F.regexp_replace(F.hex(raw), r"(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})\z", "")
    return F.when(F.octet_length(c) > most, F.concat(F.decode(F.unhex(back), "UTF-8"), F.lit("..."))).otherwise(c)


def summary(yaml: Column, rest: Column, most: int = 200) -> Column:
    """The frontmatter's ``summary`` where it is a string to a YAML parser, else the first body line that is neither blank nor a heading.

    What is odd, and says ``summary``, goes through the parser.
    """
    own = F.regexp_extract(yaml, r"(?dm)^summary: ([^\n]*)$", 1)
    odd = F.when(is_odd(yaml) & yaml.contains("summary"), yaml)
    said = F.when(odd.isNull(), F.when(own.rlike(PLAIN_TEXT), F.regexp_replace(own, r" +\z", ""))).otherwise(yaml_summary(odd))
    para = F.filter(lines(rest), lambda x: (trim(x) != "") & ~x.startswith("#"))
    return F.coalesce(said, cut(trim(F.get(para, F.lit(0))), most))


def digest_lines(c: Column) -> Column:
    """First three lines of content, joined, at most 150 characters."""
    kept = F.filter(lines(c), lambda x: ~x.startswith("---") & ~x.startswith("#") & (x != ""))
    return F.left(F.array_join(F.slice(kept, 1, 3), " "), F.lit(150))


def opening(c: Column) -> Column:
    """Five lines from the first that is neither empty nor a heading, joined, at most 200 characters."""
    arr = lines(c)
    at = F.array_position(F.transform(arr, lambda x: ~x.startswith("#") & (x != "")), F.lit(True))
    return F.left(F.when(at > 0, F.array_join(F.slice(arr, at.cast("int"), 5), " ")).otherwise(F.lit("")), F.lit(200))


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def capitalized_path(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "/"), capitalized), " / ")


def with_section(c: Column, header: str, text: Column) -> Column:
    """The section from a line starting with ``header`` to the next heading of two levels replaced; appended if absent."""
    put = F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("hit"), F.lit("").alias("out"))

    def step(a, x):
        head, ends = x.startswith(header), a["inside"] & (x.startswith("## ") | x.startswith("# "))
        kept = F.concat(a["out"], x, F.lit("\n"))
        return F.struct(
            F.when(head, True).when(ends, False).otherwise(a["inside"]).alias("inside"),
            (a["hit"] | head).alias("hit"),
            F.when(head, F.concat(a["out"], put)).when(a["inside"] & ~ends, a["out"]).otherwise(kept).alias("out"),
        )

    return F.aggregate(lines(c), start, step, lambda a: F.when(a["hit"], a["out"]).otherwise(F.concat(a["out"], text)))


def without_sections(c: Column, headers: list[str]) -> Column:
    """Sections of these headings dropped; one ends at the next heading of two levels that is none of them."""
    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("out"))

    def step(a, x):
        head = F.lit(False)
        for h in headers:
            head = head | x.startswith(h)
        inside = F.when(head, True).when(x.startswith("## ") | x.startswith("# "), False).otherwise(a["inside"])
        return F.struct(inside.alias("inside"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], x, F.lit("\n"))).alias("out"))

    return F.aggregate(lines(c), start, step, lambda a: a["out"])


def preserved_sections(c: Column, headers: list[str]) -> Column:
    """Sections of these headings, each up to the next second-level heading, after a blank line; empty if none."""
    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("out"))

    def step(a, x):
        head = F.lit(False)
        for h in headers:
            head = head | x.startswith(h)
        inside = F.when(head, True).when(a["inside"] & x.startswith("## "), False).otherwise(a["inside"])
        return F.struct(inside.alias("inside"), F.when(inside, F.concat(a["out"], x, F.lit("\n"))).otherwise(a["out"]).alias("out"))

    return F.aggregate(lines(c), start, step, lambda a: F.when(a["out"] != "", F.concat(F.lit("\n"), a["out"])).otherwise(F.lit("")))


def glued_project(c: Column) -> Column:
    """First line is ``---project: ...``."""
    return F.get(lines(c), F.lit(0)).rlike(r"(?d)\A---\s*project:(.*)\z")


def unglued_project(c: Column) -> Column:
    value = trim(F.regexp_extract(F.get(lines(c), F.lit(0)), r"(?d)\A---\s*project:(.*)\z", 1))
    after = F.when(c.contains("\n"), F.substring(c, F.instr(c, "\n") + 1, F.length(c))).otherwise(F.lit(""))
    return F.when(glued_project(c), F.concat(F.lit("---\nproject: "), value, F.lit("\n"), after)).otherwise(c)


def _with_next(c: Column) -> Column:
    """Lines with the trimmed line and the one after it, null after the last; made once, so that lambdas see its items alone."""
    arr = lines(c)
    after = F.concat(F.slice(arr, 2, F.greatest(F.size(arr), F.lit(1))), F.array(F.lit(None).cast("string")))
    return F.transform(F.arrays_zip(arr.alias("line"), after.alias("after")), lambda x: F.struct(x["line"].alias("line"), trim(x["line"]).alias("here"), trim(x["after"]).alias("next")))


def _broken(x: Column) -> Column:
    nxt = x["next"]
    return F.coalesce((x["here"] == "tags:") & ~nxt.startswith("- ") & ~nxt.startswith("[") & (nxt != ""), F.lit(False))


def broken_tag_list(c: Column) -> Column:
    """A bare ``tags:`` line followed by something that is no list."""
    return c.contains("tags:") & F.exists(_with_next(c), _broken)


def mended_tag_list(c: Column) -> Column:
    new = F.transform(F.filter(_with_next(c), lambda x: x["line"].isNotNull()), lambda x: F.when(_broken(x), F.lit("tags: []")).otherwise(x["line"]))
    return F.when(broken_tag_list(c), F.concat(F.array_join(new, "\n"), F.when(c.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))).otherwise(c)


def empty_tags(c: Column) -> Column:
    return c.rlike(r"(?dm)^tags:\s*\[\]\s*$")


def malformed_line(yaml: Column) -> Column:
    """First YAML line with ``]project:``; null if none."""
    return F.get(F.filter(lines(yaml), lambda x: x.contains("]project:")), F.lit(0))


def replaced_link(c: Column, old: Column, new: Column) -> Column:
    """``[[old]]`` and ``[[old|alias]]`` renamed, in fences too."""
    at = F.concat(F.lit(r"\[\[\Q"), old, F.lit(r"\E(\||\]\])"))
    return F.regexp_replace(c, at, F.concat(F.lit("[["), F.regexp_replace(new, r"([\\$])", r"\\$1"), F.lit("$1")))


def link_encoded(c: Column) -> Column:
    """Spaces, number signs and question marks as an opener's address takes them."""
    out = c
    for x, y in ((" ", "%20"), ("#", "%23"), ("?", "%3F")):
        out = F.replace(out, F.lit(x), F.lit(y))
    return out


def duration(seconds: Column) -> Column:
    """The two largest units from hours down, a zero second one left out."""
    s = seconds.cast("long")
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), F.when(b > 0, F.concat(F.lit(" "), b.cast("string"), F.lit(y))).otherwise(F.lit("")))
    whole = lambda e: F.floor(e).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, two(whole(s / 60), "m", s % 60, "s")).otherwise(two(whole(s / 3600), "h", whole(s % 3600 / 60), "m"))


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1 << 30, F.format_string("%.1f MB", n / float(1 << 20))).otherwise(F.format_string("%.1f GB", n / float(1 << 30)))
    )


def masked_key(c: Column) -> Column:
    """First and last four characters of a key that is long enough; ``missing`` without one."""
    return F.when(F.coalesce(c, F.lit("")) == "", "missing").when(F.length(c) > 8, F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4)))).otherwise(F.lit("****"))


#: YAML of plain one-line fields and at most inline tags, of which any reader makes the same.
PLAIN = r"(?d)\A(?:(?!tags:)[A-Za-z_]+: [A-Za-z][\w/ -]*(?:\n|\z)|tags: \[(?:[A-Za-z][\w/-]*(?:, [A-Za-z][\w/-]*)*)?\](?:\n|\z))*\z"


def is_odd(yaml: Column) -> Column:
    """Not ``PLAIN``, or with a field that is named twice, which is no YAML."""
    keys = F.regexp_extract_all(yaml, F.lit(r"(?dm)^([A-Za-z_]+):"), F.lit(1))
    return ~yaml.rlike(PLAIN) | (F.size(keys) > F.size(F.array_distinct(keys)))


def note_tags(yaml: Column) -> Column:
    """Tags as a YAML parser has them; only what is odd, and has any, goes through it."""
    odd = F.when(is_odd(yaml) & yaml.contains("tags"), yaml)
    return F.when(odd.isNull(), inline_tags(yaml)).otherwise(yaml_tags(odd))


#: A plain value that is a string to any reader: words, but none that YAML takes for a truth value or nothing.
PLAIN_TEXT = r"\A(?!(?:true|True|TRUE|false|False|FALSE|null|Null|NULL) *\z)[A-Za-z][\w/ -]*\z"
#: Plain scalars that are no strings in YAML's core schema: nothing, truth values, numbers.
NO_TEXT = r"(?:~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?(?:[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)|[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))?\Z"


def yaml_fields(text: str | None) -> dict:
    """A mapping's fields as parsed nodes; none of what is no YAML, no mapping, or names a field twice."""
    import yaml

    try:
        node = yaml.compose(text or "", Loader=yaml.SafeLoader)
    except Exception:
        return {}
    if not isinstance(node, yaml.MappingNode):
        return {}
    out = {k.value: v for k, v in node.value if isinstance(k, yaml.ScalarNode)}
    return out if len(out) == len(node.value) else {}


def yaml_text(node) -> str | None:
    """A scalar's text where the core schema has it as a string."""
    import re

    import yaml

    if not isinstance(node, yaml.ScalarNode):
        return None
    return None if not node.style and re.match(NO_TEXT, node.value) else node.value


def yaml_summary(c: Column) -> Column:
    """``summary`` by a real YAML parser (Arrow) where it is a string, null else."""
    @pandas_udf("string")
    def read(col: pd.Series) -> pd.Series:
        return col.map(lambda t: yaml_text(yaml_fields(t).get("summary")))

    return read(c)


def yaml_tags(c: Column) -> Column:
    """Tags by a real YAML parser (Arrow): items of a ``tags`` sequence that are strings."""
    @pandas_udf("array<string>")
    def read(col: pd.Series) -> pd.Series:
        import yaml

        def one(text):
            node = yaml_fields(text).get("tags")
            return [t for t in map(yaml_text, node.value) if t is not None] if isinstance(node, yaml.SequenceNode) else []

        return col.map(one)

    return read(c)
