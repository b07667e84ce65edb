"""DuckDB SQL for the queries, written apart from the operators and with other means where SQL has them."""

from __future__ import annotations

from quillspark.config import EXCLUDED_DIRS, FOLDER_TYPE_TAGS, STEM_TAGS, TYPE_TAGS, VaultConfig
from quillspark.sources.fixture import CONCEPTS, DUCK_SQL, LATER_DUCK, NESTED_DUCK

CONFIG = VaultConfig(concepts=CONCEPTS)


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


FM = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
FENCE = r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)|^[ \t]*~~~.*?(?:^[ \t]*~~~[^\n]*$|\z)"
WIKI = r"\[\[([^\]|]+?)(?:\|([^\]]+?))?\]\]"
INLINE = r"(?m)^tags:\s*\[(.*?)\]"
TAGS = f"list_filter(list_transform(string_split(regexp_extract({{0}}, '{INLINE}', 1), ','), lambda x: trim(trim(trim(x), '\"'), '''')), lambda x: x <> '')"
ITEMS = r"list_filter(list_transform(regexp_extract_all({0}, '(?m)^\s+-\s+(.+)$', 1), lambda x: trim(trim(trim(x), '" + '"' + r"'), '''')), lambda x: x <> '')"

#: As a YAML parser has them: nothing where the text is no YAML, else the inline or the block list.
CARD_TAGS = f"CASE WHEN contains(fm_yaml, ']project:') THEN [] WHEN regexp_matches(fm_yaml, '{INLINE}') THEN {TAGS.format('fm_yaml')} WHEN regexp_matches(fm_yaml, '(?m)^tags:[ \t]*$') THEN {ITEMS.format('fm_yaml')} ELSE [] END"
LINE = r"(?m)^tags:\s*\[[^\n]*?\]"


def rtrim(c: str) -> str:
    return rf"regexp_replace({c}, '\s+\z', '')"


def field_set(content: str, name: str, value: str) -> str:
    """A frontmatter line set, in SQL, of content that begins with a closed frontmatter or has none."""
    return rf"""CASE WHEN NOT regexp_matches({content}, '(?s)\A---\n(.*?)\n---\n?') THEN '---' || chr(10) || '{name}: {value}' || chr(10) || '---' || chr(10) || {content}
      WHEN regexp_matches(regexp_extract({content}, '(?s)\A---\n(.*?)\n---', 1), '(?m)^{name}:') THEN '---' || chr(10) || regexp_replace(regexp_extract({content}, '(?s)\A---\n(.*?)\n---\n?(.*)\z', 1), '(?m)^{name}:[^\n]*$', '{name}: {value}', 'g')
        || chr(10) || '---' || chr(10) || regexp_extract({content}, '(?s)\A---\n(.*?)\n---\n?(.*)\z', 2)
      ELSE '---' || chr(10) || regexp_extract({content}, '(?s)\A---\n(.*?)\n---\n?(.*)\z', 1) || chr(10) || '{name}: {value}' || chr(10) || '---' || chr(10) || regexp_extract({content}, '(?s)\A---\n(.*?)\n---\n?(.*)\z', 2) END"""


PATH_PARTS = "string_split(path, '/')"
WORD = "upper(x[1]) || x[2:]"
# The index note's headings, and what stands under one that has nothing.
SECTION = "['Areas', 'Active Projects', 'Zettelkasten (Wiki Layer)', 'Key Concepts', 'Governance']"
NONE = "['No area notes found', 'No active projects found', 'No zettelkasten notes found', 'Build vault graph first to see key concepts', '']"
CTES = {
    "files": DUCK_SQL,
    "notes": f"""SELECT *, left(path, length(path) - 3) AS stem_path, regexp_extract(path, '([^/]*)\\.md$', 1) AS stem, regexp_matches(content, '{FM}') AS has_fm,
        regexp_extract(content, '{FM}', 1) AS fm_yaml, CASE WHEN regexp_matches(content, '{FM}') THEN regexp_extract(content, '{FM}', 2) ELSE content END AS body
      FROM files WHERE path LIKE '%.md' AND NOT list_has_any(string_split(path, '/'), {listed(EXCLUDED_DIRS)})""",
    "found": f"""SELECT path, regexp_extract_all(regexp_replace(content, '{FENCE}', '', 'g'), '{WIKI}', 1) AS t, regexp_extract_all(regexp_replace(content, '{FENCE}', '', 'g'), '{WIKI}', 2) AS a FROM notes""",
    "links": "SELECT path AS src, CAST(pos AS INTEGER) AS pos, trim(t[pos + 1]) AS raw_target, nullif(trim(a[pos + 1]), '') AS alias FROM (SELECT *, unnest(range(len(t))) AS pos FROM found)",
    "pidx": "SELECT lower(stem_path) AS k, min(path) AS p FROM notes GROUP BY 1",
    "sidx": "SELECT lower(stem) AS k, min(path) AS p FROM notes GROUP BY 1",
    "res": r"""SELECT l.*, coalesce(a.p, b.p, c.p) AS dst FROM links l LEFT JOIN pidx a ON a.k = lower(raw_target) LEFT JOIN pidx b ON b.k = regexp_replace(lower(raw_target), '(\.md)+$', '')
      LEFT JOIN sidx c ON c.k = regexp_extract(regexp_replace(lower(raw_target), '(\.md)+$', ''), '[^/]*$')""",
    "edges": "SELECT DISTINCT src, dst FROM res WHERE dst IS NOT NULL",
    "deg": """SELECT n.path, CAST((SELECT count(*) FROM edges e WHERE e.dst = n.path) AS BIGINT) AS incoming, CAST((SELECT count(*) FROM edges e WHERE e.src = n.path) AS BIGINT) AS outgoing FROM notes n""",
    "orph": "SELECT path FROM deg WHERE incoming = 0 AND outgoing = 0",
    "und": "SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges",
    "comp": "SELECT a AS path, min(b) AS component FROM (WITH RECURSIVE r(a, b) AS (SELECT path, path FROM notes UNION SELECT r.a, und.v FROM r JOIN und ON r.b = und.u) SELECT * FROM r) GROUP BY 1",
    "hubs": "SELECT dst AS path, count(*) AS incoming FROM edges GROUP BY 1 ORDER BY incoming DESC, path LIMIT 10",
    "txt": f"SELECT lower(left(path, length(path) - 4)) AS k, min(path) AS p FROM files WHERE path LIKE '%.txt' AND NOT list_has_any(string_split(path, '/'), {listed(EXCLUDED_DIRS)}) GROUP BY 1",
    "clean": r"SELECT *, regexp_replace(raw_target, '\.md$', '') AS c FROM links",
    "checked": r"""SELECT src AS source, l.pos, raw_target AS target,
        CASE WHEN coalesce(a.p, b.p, c3.p) IS NOT NULL THEN NULL WHEN t.p IS NOT NULL THEN 'extension_mismatch' WHEN coalesce(s1.p, s2.p, h1.p, h2.p) IS NOT NULL THEN 'filename_mismatch' ELSE 'unresolved' END AS issue,
        coalesce(a.p, b.p, c3.p, t.p, s1.p, s2.p, h1.p, h2.p) AS match
      FROM clean l LEFT JOIN pidx a ON a.k = lower(c) LEFT JOIN pidx b ON b.k = regexp_replace(lower(c), '(\.md)+$', '') LEFT JOIN sidx c3 ON c3.k = regexp_extract(regexp_replace(lower(c), '(\.md)+$', ''), '[^/]*$')
      LEFT JOIN txt t ON t.k = lower(c) LEFT JOIN pidx s1 ON s1.k = replace(lower(c), '-', ' ') LEFT JOIN sidx s2 ON s2.k = regexp_extract(replace(lower(c), '-', ' '), '[^/]*$')
      LEFT JOIN pidx h1 ON h1.k = replace(lower(c), ' ', '-') LEFT JOIN sidx h2 ON h2.k = regexp_extract(replace(lower(c), ' ', '-'), '[^/]*$')""",
    "tagrows": f"SELECT path, CAST(pos AS INTEGER) AS pos, t[pos + 1] AS tag FROM (SELECT path, t, unnest(range(len(t))) AS pos FROM (SELECT path, {TAGS.format('fm_yaml')} AS t FROM notes))",
    "td": r"SELECT DISTINCT regexp_replace(trim(lower(tag)), '\s+', '-', 'g') AS tag, path FROM tagrows",
    "tn": "SELECT tag, count(*) AS docs FROM td GROUP BY 1",
    "jac": """SELECT x.tag AS a, y.tag AS b, count(*) AS both, round(count(*) / (any_value(nx.docs) + any_value(ny.docs) - count(*)), 6) AS ratio FROM td x JOIN td y ON x.path = y.path AND x.tag < y.tag
      JOIN tn nx ON nx.tag = x.tag JOIN tn ny ON ny.tag = y.tag GROUP BY 1, 2 HAVING count(*) / (any_value(nx.docs) + any_value(ny.docs) - count(*)) > 0.6""",
    "tcomp": "SELECT a AS tag, min(b) AS g FROM (WITH RECURSIVE r(a, b) AS (SELECT tag, tag FROM tn UNION SELECT r.a, u.v FROM r JOIN (SELECT a AS u, b AS v FROM jac UNION SELECT b, a FROM jac) u ON r.b = u.u) SELECT * FROM r) GROUP BY 1",
    "canon": "SELECT tag, docs, first_value(tag) OVER (PARTITION BY g ORDER BY docs DESC, tag) AS canonical FROM tcomp JOIN tn USING (tag)",
    "checkdocs": f"""SELECT *, coalesce({case("regexp_extract(path, '[^/]*$')", TYPE_TAGS)}, {case("string_split(path, '/')[-2]", FOLDER_TYPE_TAGS)}) AS tt,
        CASE WHEN NOT has_fm THEN [] WHEN regexp_matches(fm_yaml, '{INLINE}') THEN {TAGS.format('fm_yaml')} WHEN regexp_matches(fm_yaml, '(?m)^tags:\\s*$') THEN {ITEMS.format('fm_yaml')} ELSE [] END AS have FROM notes""",
    "need": """SELECT path, have, 'layer/raw' AS tag, 'missing_layer' AS issue FROM checkdocs WHERE (path LIKE '99-Archives/projects/%' AND tt IS NOT NULL) OR path LIKE '03-Resources/Laws-Of-Software-Engineering/%'
      UNION ALL SELECT path, have, tt, 'missing_type' FROM checkdocs WHERE path LIKE '99-Archives/projects/%' AND tt IS NOT NULL
      UNION ALL SELECT path, have, 'type/reference', 'missing_type' FROM checkdocs WHERE path LIKE '03-Resources/Laws-Of-Software-Engineering/%'
      UNION ALL SELECT path, have, string_split(path, '/')[3], 'missing_project' FROM checkdocs WHERE path LIKE '99-Archives/projects/%' AND tt IS NOT NULL""",
    "tagissues": """SELECT path AS file, issue, 'Expected tag: ' || tag AS detail FROM need WHERE NOT list_contains(have, tag)
      UNION ALL SELECT path, 'yaml_malform', 'Malformed YAML: ' || regexp_extract(fm_yaml, '(?m)^.*\\]project:.*$') FROM checkdocs WHERE path LIKE '99-Archives/projects/%' AND tt IS NOT NULL AND has_fm AND contains(fm_yaml, ']project:')""",
    "fmissues": f"""SELECT path AS file, 'closing_brace_malform' AS issue, 'Opening --- and project: on same line' AS detail FROM notes WHERE regexp_matches(split_part(content, chr(10), 1), '^---\\s*project:')
      UNION ALL SELECT path, 'broken_yaml_list', 'tags: followed by non-list value' FROM notes WHERE regexp_matches(content, '(?m)^[ \\t]*tags:[ \\t]*\\n[ \\t]*([^-\\[\\s]|-[^ ])')
      UNION ALL SELECT path, 'empty_tags', 'tags: [] — user decision required' FROM notes WHERE regexp_matches(content, '(?m)^tags:\\s*\\[\\]\\s*$')
      UNION ALL SELECT path, 'missing_frontmatter', 'PRIMARY doc ' || regexp_extract(path, '[^/]*$') || ' has no frontmatter' FROM notes WHERE path LIKE '99-Archives/projects/%' AND list_contains({listed(TYPE_TAGS)}, regexp_extract(path, '[^/]*$')) AND NOT has_fm""",
    "pdocs": f"""SELECT *, string_split(path, '/')[1] AS project FROM notes WHERE contains(path, '/') AND NOT list_contains({listed(CONFIG.all_system_dirs())}, string_split(path, '/')[1]) AND path NOT LIKE '.%'
      AND stem <> string_split(path, '/')[1] AND NOT list_has_any(string_split(path, '/'), ['src', 'target'])""",
    "hits": " UNION ALL ".join(f"SELECT project, '{c.name}' AS concept, path FROM pdocs WHERE " + " OR ".join(f"contains(lower(content), '{k}')" for k in c.keywords) for c in CONCEPTS),
    "br": f"SELECT concept, {case('concept', {c.name: ','.join(c.tags) for c in CONCEPTS})} AS tags, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, count(*) AS docs FROM hits GROUP BY 1, 2 HAVING count(DISTINCT project) >= 2",
    "zoned": """SELECT *, CASE string_split(path, '/')[1] WHEN '00-Inbox' THEN 'Inbox' WHEN '02-Areas' THEN 'Areas' WHEN '03-Resources' THEN 'Resources' WHEN '10-Zettelkasten' THEN 'Zettelkasten'
        WHEN '99-Archives' THEN CASE WHEN path LIKE '99-Archives/projects/%' THEN 'Projects' ELSE 'Archives' END ELSE 'Archives' END AS kind,
        CASE WHEN path LIKE '02-Areas/%' THEN '/' || string_split(path, '/')[2] WHEN path LIKE '99-Archives/projects/%' THEN '/' || string_split(path, '/')[3] ELSE '' END AS zname FROM files WHERE path LIKE '%.md'""",
    "scan": f"""SELECT z.*, regexp_extract(path, '([^/]*)\\.md$', 1) AS stem, regexp_matches(content, '{FM}') AS has_fm, regexp_extract(content, '{FM}', 1) AS fm_yaml,
        CASE WHEN regexp_matches(content, '{FM}') THEN regexp_extract(content, '{FM}', 2) ELSE content END AS body FROM zoned z""",
    "cards0": f"""SELECT path, kind || zname AS zone, kind, modified_on, {CARD_TAGS} AS tl,
        CASE WHEN regexp_matches(content, '(?m)^# ') THEN trim(regexp_replace(regexp_extract(content, '(?m)^# [^\\n]*$'), '^(# )+', '')) ELSE stem END AS title,
        CAST(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count, contains(body, '```mermaid') AS has_mermaid FROM scan""",
    "cards1": """SELECT c.*, coalesce(d.incoming, 0) AS incoming_links, coalesce(d.outgoing, 0) AS outgoing_links, greatest(DATE '2024-01-31' - modified_on, 0) AS age FROM cards0 c LEFT JOIN deg d USING (path)""",
    "cards": """SELECT *, incoming_links + outgoing_links = 0 AS is_orphan, CAST(greatest(least(round(((1.0::DOUBLE - least(age / 90.0::DOUBLE, 1.0::DOUBLE)) * 0.30::DOUBLE + least((incoming_links + outgoing_links) / 10.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE
        + least(len(tl) / 7.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE + least(word_count / 1000.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + CASE WHEN incoming_links >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.10::DOUBLE) * 5.0::DOUBLE), 5), 1) AS INTEGER) AS vitality,
        list_filter(tl, lambda t: starts_with(t, 'layer/'))[1] AS layer, array_to_string(tl, ',') AS tags FROM cards1""",
    "plinks": "SELECT name, max(path = '99-Archives/projects/' || name || '/' || name || '.md') AS hub FROM (SELECT path, string_split(path, '/')[3] AS name FROM notes WHERE path LIKE '99-Archives/projects/%/%') GROUP BY 1",
    "needed": f"""SELECT *, CASE WHEN path LIKE '99-Archives/projects/%' THEN ['layer/raw', tt, {PATH_PARTS}[3]] ELSE ['layer/raw', 'type/reference'] END AS needs,
        path LIKE '99-Archives/projects/%' AND has_fm AND contains(fm_yaml, ']project:') AS bad
      FROM checkdocs WHERE (path LIKE '99-Archives/projects/%' AND tt IS NOT NULL) OR path LIKE '03-Resources/Laws-Of-Software-Engineering/%'""",
    "lacking": """SELECT *, list_filter(needs, lambda x: NOT list_contains(have, x)) AS miss, CASE WHEN bad THEN replace(fm_yaml, ']project:', ']' || chr(10) || 'project:') ELSE fm_yaml END AS y FROM needed""",
    "lined": f"""SELECT *, CASE WHEN regexp_matches(y, '{INLINE}') THEN {TAGS.format('y')} WHEN regexp_matches(y, '(?m)^tags:\\s*$') THEN {ITEMS.format('y')} ELSE [] END AS old FROM lacking""",
    "tagline": "SELECT *, 'tags: [' || array_to_string(old || list_filter(miss, lambda x: NOT list_contains(old, x)), ', ') || ']' AS line FROM lined",
    "tagfixed": f"""SELECT path, content, CASE WHEN NOT has_fm THEN CASE WHEN len(miss) > 0 THEN '---' || chr(10) || 'tags: [' || array_to_string(miss, ', ') || ']' || chr(10) || '---' || chr(10) || content ELSE content END
        ELSE '---' || chr(10) || {rtrim(f"CASE WHEN len(miss) = 0 THEN y WHEN regexp_matches(y, '{INLINE}') THEN regexp_replace(y, '{LINE}', line) WHEN regexp_matches(y, '(?m)^tags:" + chr(92) + "s*$') THEN regexp_replace(regexp_replace(y, '(?m)^" + chr(92) + "s+-" + chr(92) + "s+(.+)$', '', 'g'), '(?m)^tags:" + chr(92) + "s*$', line) ELSE line || chr(10) || y END")} || chr(10) || '---' || chr(10) || body END AS new
      FROM tagline WHERE len(miss) > 0 OR bad""",
    "unglued": r"""SELECT *, CASE WHEN regexp_matches(content, '\A---[ \t]*project:[^\n]*') THEN '---' || chr(10) || 'project: ' || trim(regexp_extract(content, '\A---[ \t]*project:([^\n]*)', 1)) || chr(10) || regexp_replace(content, '\A[^\n]*\n?', '') ELSE content END AS one FROM notes""",
    "mended": r"""SELECT *, CASE WHEN regexp_matches(one, '(?m)^[ \t]*tags:[ \t]*\n[ \t]*([^-\[\s]|-[^ ])') THEN regexp_replace(replace(one, chr(13) || chr(10), chr(10)), '(?m)^[ \t]*tags:[ \t]*\n([ \t]*(?:[^-\[\s]|-[^ ]))', 'tags: []' || chr(10) || '\1', 'g') ELSE one END AS two FROM unglued""",
    "fmfixed": f"""SELECT path, content, CASE WHEN path LIKE '99-Archives/projects/%' AND list_contains({listed(TYPE_TAGS)}, {PATH_PARTS}[-1]) AND NOT regexp_matches(two, '{FM}')
        THEN '---' || chr(10) || 'tags: [layer/raw, ' || {case(PATH_PARTS + '[-1]', TYPE_TAGS)} || ', ' || {PATH_PARTS}[3] || ']' || chr(10) || '---' || chr(10) || content ELSE two END AS new FROM mended""",
    "retagged": f"SELECT path, content, regexp_replace(content, '{LINE}', 'tags: [' || array_to_string(names, ', ') || ']') AS new FROM notes JOIN (SELECT path, list_sort(list(DISTINCT canonical)) AS names FROM td JOIN canon USING (tag) GROUP BY 1) t USING (path)",
    "zback": r"""SELECT d.path, z.stem AS zettel FROM pdocs d JOIN notes z ON regexp_matches(z.path, '^10-Zettelkasten/[^/]*$') AND len(string_split(lower(replace(z.stem, '-', ' ')), ' ')) >= 2
        AND len(list_filter(string_split(lower(replace(z.stem, '-', ' ')), ' '), lambda w: NOT contains(lower(d.content), w))) = 0
        WHERE len(string_split(rtrim(d.content, chr(10)), chr(10))) + len(d.content) - len(rtrim(d.content, chr(10))) - CASE WHEN d.content LIKE '%' || chr(10) THEN 1 ELSE 0 END >= 3""",
    "linked": f"""SELECT d.path, content, {rtrim('content')} || chr(10) || chr(10) || '## See Also' || chr(10) || '- [[' || project || '/' || project || ']]' || coalesce(z.l, '') || chr(10) AS new
      FROM pdocs d LEFT JOIN (SELECT path, array_to_string(list_transform(list_sort(list(DISTINCT zettel)), lambda x: chr(10) || '- [[10-Zettelkasten/' || x || ']]'), '') AS l FROM zback GROUP BY 1) z USING (path)
      WHERE len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END >= 3""",
    "bridged": f"""SELECT path, content, CASE WHEN content IS NULL THEN fresh ELSE {rtrim('content')} || chr(10) || section || chr(10) END AS new FROM (
        SELECT '10-Zettelkasten/' || concept || '.md' AS path, section, '---' || chr(10) || 'tags: [' || replace(tags, ',', ', ') || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || replace(concept, '-', ' ') || chr(10) || chr(10)
          || '> Auto-generated bridge note.' || chr(10) || chr(10) || section || chr(10) AS fresh FROM (SELECT *, '## Related Projects' || chr(10) || array_to_string(list_transform(string_split(projects, ','), lambda p: '- [[' || p || '/' || p || ']]'), chr(10)) AS section FROM br)) b LEFT JOIN notes USING (path)""",
    "shared": "SELECT DISTINCT h.project, h.concept FROM hits h JOIN br USING (concept)",
    "near": "SELECT project, string_agg('- [[' || other || '/' || other || ']] — shared: ' || c || chr(10), '' ORDER BY other) AS n FROM (SELECT x.project, y.project AS other, string_agg(x.concept, ', ' ORDER BY x.concept) AS c FROM shared x JOIN shared y ON x.concept = y.concept AND x.project <> y.project GROUP BY 1, 2) GROUP BY 1",
    "kept": "SELECT project, string_agg('- [[10-Zettelkasten/' || concept || ']]' || chr(10), '' ORDER BY concept) AS k FROM shared GROUP BY 1",
    "related": f"""SELECT path, content, {rtrim('content')} || chr(10) || chr(10) || '## Related Projects' || chr(10) || coalesce(n, '') || chr(10) || '## Key Concepts' || chr(10) || k || chr(10) AS new
      FROM notes JOIN kept ON path = project || '/' || project || '.md' LEFT JOIN near USING (project)""",
    "grouped": f"SELECT project, CASE WHEN len({PATH_PARTS}) = 2 THEN 'Core Docs' ELSE array_to_string({PATH_PARTS}[2:-2], '/') END AS grp, string_agg('- [[' || stem_path || ']]' || chr(10), '' ORDER BY stem_path) AS l FROM pdocs GROUP BY 1, 2",
    "hubtext": f"""SELECT project, string_agg('## ' || CASE WHEN grp = 'Core Docs' THEN grp ELSE array_to_string(list_transform(string_split(grp, '/'), lambda x: {WORD}), ' / ') END || chr(10) || l || chr(10), '' ORDER BY grp <> 'Core Docs', grp) AS t FROM grouped GROUP BY 1""",
    "hubnew": """SELECT h.project || '/' || h.project || '.md' AS path, n.content, '---' || chr(10) || 'project: ' || h.project || chr(10) || 'type: moc' || chr(10) || 'tags: [' || h.project || ']' || chr(10) || '---' || chr(10) || chr(10)
        || '# ' || upper(h.project[1]) || h.project[2:] || ' MOC' || chr(10) || chr(10) || t AS new FROM hubtext h LEFT JOIN notes n ON n.path = h.project || '/' || h.project || '.md'""",
    "isec": r"""SELECT CAST(0 AS INTEGER) AS section, stem_path AS pos, '- [[' || stem_path || ']]' AS line FROM notes WHERE path LIKE '02-Areas/%'
        UNION ALL SELECT 1, l, '- [[' || l || ']]' FROM (SELECT '99-Archives/projects/' || name || '/' || CASE WHEN hub THEN name ELSE '' END AS l FROM plinks)
        UNION ALL SELECT 2, stem_path, '- [[' || stem_path || ']]' FROM notes WHERE path LIKE '10-Zettelkasten/%'
        UNION ALL SELECT 3, lpad(CAST(100000000000 - incoming AS VARCHAR), 12, '0') || ' ' || path, '- [[' || regexp_replace(path, '\.[^./]*$', '') || ']] (' || incoming || ' incoming)' FROM hubs
        UNION ALL SELECT 4, '0', '- [[TAGGING]]' UNION ALL SELECT 4, '1', '- [[Home]]'""",
    "itext": f"""SELECT i, '## ' || {SECTION}[i + 1] || chr(10) || coalesce((SELECT string_agg(line || chr(10), '' ORDER BY pos, line) FROM isec WHERE section = i), '<!-- ' || {NONE}[i + 1] || ' -->' || chr(10)) || chr(10) AS t FROM (SELECT unnest(range(5)) AS i)""",
    "inb": r"""SELECT path, regexp_extract(content, '(?s)\A---\n(.*?)\n---\n?(.*)\z', 1) AS y FROM files WHERE (regexp_matches(path, '^00-Inbox/[^/]*$') AND (path LIKE '%.md' OR path LIKE '%.pdf')) OR (path LIKE 'temp_conversions/%' AND path LIKE '%.md')""",
    "inb2": r"SELECT path, regexp_extract(y, '(?m)^status:[ \t]*([^\n]*)$', 1) AS status, nullif(regexp_extract(y, '(?m)^category:[ \t]*([^\n]*)$', 1), '') AS cat FROM inb",
    "said": "SELECT path, f.content, CASE (list_sum(list_transform(regexp_extract_all(hex(encode(rest)), '..'), lambda x: CAST('0x' || x AS INTEGER))) % 1000) % 4 WHEN 0 THEN 'ConceptSeed' WHEN 1 THEN 'Project' WHEN 2 THEN 'Area' WHEN 3 THEN 'Resource' ELSE 'ConceptSeed' END AS kind FROM (SELECT path, unix AS content, CASE WHEN regexp_matches(unix, '(?s)\\A---\\n(.*?)\\n---\\n?(.*)\\z') THEN regexp_extract(unix, '(?s)\\A---\\n(.*?)\\n---\\n?(.*)\\z', 2) ELSE raw END AS rest FROM (SELECT path, content AS raw, CASE WHEN content LIKE '---%' THEN replace(content, chr(13) || chr(10), chr(10)) ELSE content END AS unix FROM files)) f JOIN inb2 USING (path) WHERE NOT (status IN ('confirmed', 'needs_review', 'processed'))",
}


def again(of: str, prefix: str, names: str) -> dict[str, str]:
    """CTEs of ``names`` once more, on another table of files."""
    import re

    todo = names.split()
    swap = {"files": of} | {n: prefix + n for n in todo}
    return {prefix + n: re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {swap.get(m[2], m[2])}", CTES[n]) for n in todo}


CTES |= {"later": LATER_DUCK, **again("later", "l_", "notes found links pidx sidx res edges")}
CTES |= {"nestedfiles": NESTED_DUCK, **again("nestedfiles", "n_", "notes")}
CTES |= {
    "repos": r"SELECT DISTINCT regexp_extract(path, '^(.+?)/\.git(/.*)?$', 1) AS root FROM nestedfiles WHERE regexp_matches(path, '^.+/\.git(/|$)')",
    "diff": """SELECT path, CASE WHEN a.content IS NULL THEN 'added' WHEN b.content IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(b.content, a.content) AS text
      FROM files a FULL JOIN later b USING (path) WHERE a.content IS DISTINCT FROM b.content""",
    "pair": "SELECT text, max(path) FILTER (kind = 'added') AS path, max(path) FILTER (kind = 'removed') AS old_path FROM diff WHERE kind <> 'changed' GROUP BY 1 HAVING count(*) FILTER (kind = 'added') = 1 AND count(*) FILTER (kind = 'removed') = 1",
    "changed": """SELECT path, kind, NULL::VARCHAR AS old_path FROM diff WHERE kind = 'changed' OR (path NOT IN (SELECT path FROM pair) AND path NOT IN (SELECT old_path FROM pair)) UNION ALL SELECT path, 'renamed', old_path FROM pair""",
    "one": r"""SELECT string_split(path, '/') AS p, CASE WHEN contains(string_split(path, '/')[-1], '.') THEN string_split(string_split(path, '/')[-1], '.')[-1] ELSE '' END AS ext, path LIKE '%.md' AS note, strlen(content) AS size,
      CASE WHEN starts_with(content, '---' || chr(10)) THEN coalesce(nullif(trim(regexp_extract(string_split(content, chr(10) || '---')[1], '(?m)^status:[ \t]*([^\n]*)$', 1)), ''), 'none') ELSE 'none' END AS state FROM files""",
    "up": "SELECT CASE WHEN n = 0 THEN '' ELSE array_to_string(p[1:n], '/') END AS folder, n, ext, state, note, size FROM (SELECT *, unnest(range(len(p))) AS n FROM one)",
    "touched": "SELECT path AS file FROM changed UNION ALL SELECT old_path FROM changed WHERE old_path IS NOT NULL",
}


def sql(query: str) -> str:
    """The query after those of ``CTES`` that it needs, in order."""
    import re

    names, todo = set(), [query]
    while todo:
        text = todo.pop()
        for n in CTES:
            if n not in names and re.search(rf"\b(?:FROM|JOIN|from|join)\s+{n}\b", text):
                names.add(n)
                todo.append(CTES[n])
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in CTES if n in names)
    return f"WITH {ctes}\n{query}" if ctes else query


def attention(where: str) -> str:
    return f"SELECT path, vitality, CAST(modified_on AS VARCHAR) AS modified_on FROM cards c WHERE {where} ORDER BY vitality DESC, c.modified_on DESC, path LIMIT 10"


UNTAGGED = r"NOT regexp_matches(content, '(?m)^tags:\s*\[') AND NOT (has_fm AND contains(fm_yaml, 'tags:'))"
EARNED = " UNION ".join(
    [f"SELECT path, project AS tag FROM pdocs WHERE {UNTAGGED}"]
    + [f"SELECT path, '{t}' FROM pdocs WHERE {UNTAGGED} AND (" + " OR ".join(f"contains(lower(content), '{k}')" for k in c.keywords) + ")" for c in CONCEPTS for t in c.tags if t != "evergreen"]
    + [f"SELECT path, '{t}' FROM pdocs WHERE {UNTAGGED} AND stem = '{s}'" for s, tags in STEM_TAGS.items() for t in tags]
)
#: The steps of a sync round, each on the files as the ones before left them; none of the notes here has a section yet that a step has to keep.
CTES |= {
    "homenew": """SELECT 'Home.md' AS path, NULL::VARCHAR AS content, '---' || chr(10) || 'type: moc' || chr(10) || 'tags: [home]' || chr(10) || '---' || chr(10) || chr(10) || '# Home' || chr(10) || chr(10) || '## Projects' || chr(10)
        || string_agg('- [[' || project || '/' || project || ']]' || chr(10), '' ORDER BY project) AS new FROM (SELECT DISTINCT project FROM pdocs)""",
    "indexnew": """SELECT 'index.md' AS path, NULL::VARCHAR AS content, '---' || chr(10) || 'project: root' || chr(10) || 'type: agent-index' || chr(10) || 'tags: [agent-entry, layer/raw]' || chr(10) || '---' || chr(10) || chr(10) || '# vault -- Agent Index' || chr(10) || chr(10) || string_agg(t, '' ORDER BY i) AS new FROM itext""",
    "autonew": f"""SELECT path, content, CASE WHEN has_fm THEN '---' || chr(10) || fm_yaml || chr(10) || line || chr(10) || '---' || chr(10) || body ELSE '---' || chr(10) || line || chr(10) || '---' || chr(10) || chr(10) || content END AS new
      FROM notes JOIN (SELECT path, 'tags: [' || string_agg(tag, ', ' ORDER BY tag) || ']' AS line FROM ({EARNED}) GROUP BY 1) e USING (path)""",
}
ROUND = [
    ("hubnew", "notes pdocs grouped hubtext hubnew"), ("homenew", "notes pdocs homenew"), ("indexnew", "notes found links pidx sidx res edges hubs plinks isec itext indexnew"), ("bridged", "notes pdocs hits br bridged"),
    ("linked", "notes pdocs zback linked"), ("related", "notes pdocs hits br shared near kept related"), ("autonew", "notes pdocs autonew"),
]
for _n, (_plan, _names) in enumerate(ROUND):
    _files = f"after{_n}" if _n else "files"
    CTES |= again(_files, f"r{_n}_", _names)
    CTES[f"after{_n + 1}"] = f"SELECT path, coalesce(p.new, f.content) AS content FROM {_files} f FULL JOIN (SELECT path, new FROM r{_n}_{_plan} WHERE new IS DISTINCT FROM content) p USING (path)"


PLAN = "SELECT path, 'write' AS action, md5(new) AS digest FROM {0} WHERE new IS DISTINCT FROM content"
RULE = r"\A---\n(.*?\n)---\n"
QUERIES = {
    "tag_fix_plan": PLAN.format("tagfixed"),
    "virtual_apply": "SELECT n.path, md5(coalesce(t.new, n.content)) AS digest FROM needed n LEFT JOIN tagfixed t USING (path)",
    "frontmatter_fix_plan": PLAN.format("fmfixed"),
    "tag_normalization_plan": PLAN.format("retagged"),
    "backlink_plan": PLAN.format("linked"),
    "bridge_note_plan": PLAN.format("bridged"),
    "related_projects": PLAN.format("related"),
    "moc_plan": PLAN.format("hubnew"),
    "auto_tag_plan": f"""SELECT path, 'write' AS action, md5(CASE WHEN has_fm THEN '---' || chr(10) || fm_yaml || chr(10) || line || chr(10) || '---' || chr(10) || body ELSE '---' || chr(10) || line || chr(10) || '---' || chr(10) || chr(10) || content END) AS digest
      FROM notes JOIN (SELECT path, 'tags: [' || string_agg(tag, ', ' ORDER BY tag) || ']' AS line FROM ({EARNED}) GROUP BY 1) e USING (path)""",
    "index_plan": """SELECT 'index.md' AS path, 'write' AS action, md5('---' || chr(10) || 'project: root' || chr(10) || 'type: agent-index' || chr(10) || 'tags: [agent-entry, layer/raw]' || chr(10) || '---' || chr(10) || chr(10) || '# vault -- Agent Index' || chr(10) || chr(10) || string_agg(t, '' ORDER BY i)) AS digest FROM itext""",
    "card_summaries": r"""SELECT path, md5(coalesce(s, 'none')) AS digest, CAST(coalesce(strlen(s), -1) AS BIGINT) AS n_bytes FROM (SELECT path, CASE WHEN own <> '' THEN trim(trim(own), '"') WHEN strlen(p) > 200 THEN left(p, list_filter(range(0, 201), lambda i: strlen(left(p, CAST(i AS INTEGER))) <= 200)[-1]) || '...' ELSE p END AS s
      FROM (SELECT path, regexp_extract(fm_yaml, '(?m)^summary:[ \t]*(\S[^\n]*)$', 1) AS own, regexp_replace(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT starts_with(x, '#'))[1], '^\s+|\s+$', '', 'g') AS p FROM scan))""",
    "inbox_plan": f"""SELECT f.path, 'move' AS action, r.new_path, md5({field_set('(' + field_set("replace(f.content, chr(13) || chr(10), chr(10))", 'status', 'processed') + ')', 'processed_at', '2024-01-31')}) AS digest FROM files f JOIN (SELECT path,
          CASE lower(coalesce(cat, 'Resources')) WHEN 'projects' THEN '01-Projects' WHEN 'areas' THEN '02-Areas' WHEN 'archive' THEN '99-Archives' WHEN 'zettelkasten' THEN '10-Zettelkasten/fleeting'
          WHEN 'resources' THEN '03-Resources/Reference/Articles-Papers' ELSE '99-Archives' END || '/' || {PATH_PARTS}[-1] AS new_path FROM inb2 WHERE status = 'confirmed') r USING (path)
      UNION ALL SELECT path, 'write', NULL, md5(regexp_replace(base, '{RULE}', '---' || chr(10) || '\\1candidate_type: ' || kind || chr(10) || 'reasoning: stub' || chr(10) || '---' || chr(10), 's')) FROM (SELECT path, kind, {field_set('content', 'status', 'needs_review')} AS base FROM said)""",
    "ai_candidates": "SELECT path, kind AS candidate_type FROM said",
    "link_repair_plan": r"""SELECT path, 'rename' AS action, new_path, md5('') AS digest, 'link target' AS reason FROM (SELECT path, min(new_path) AS new_path FROM (
        SELECT match AS path, left(match, length(match) - 4) || '.md' AS new_path FROM checked WHERE issue = 'extension_mismatch'
        UNION ALL SELECT match, regexp_extract(match, '^(.*/)?[^/]*$', 1) || regexp_extract(regexp_replace(target, '\.md$', ''), '[^/]*$') || '.md' FROM checked WHERE issue = 'filename_mismatch' AND match NOT IN (SELECT dst FROM edges)) GROUP BY 1) WHERE new_path NOT IN (SELECT path FROM files)
      UNION ALL SELECT f.path, 'write', NULL, md5(list_reduce(list_prepend(f.content, p.pairs), lambda c, x: replace(replace(c, '[[' || split_part(x, chr(1), 1) || ']]', '[[' || split_part(x, chr(1), 2) || ']]'), '[[' || split_part(x, chr(1), 1) || '|', '[[' || split_part(x, chr(1), 2) || '|'))), 'link rewritten'
      FROM files f JOIN (SELECT source, list(DISTINCT target || chr(1) || regexp_replace(match, '\.md$', '') ORDER BY target || chr(1) || regexp_replace(match, '\.md$', '')) AS pairs FROM checked WHERE issue = 'filename_mismatch' AND match IN (SELECT dst FROM edges) GROUP BY 1) p ON f.path = p.source""",
    "inbox_count": "SELECT count(DISTINCT string_split(path, '/')[2]) AS inbox_count FROM files WHERE path LIKE '00-Inbox/%'",
    "folder_status": """SELECT name, n > 0 AS present, CAST(CASE WHEN n = 0 THEN -1 WHEN folder THEN n ELSE 0 END AS BIGINT) AS items FROM (
        SELECT d AS name, true AS folder, (SELECT count(DISTINCT string_split(substr(path, length(d) + 2), '/')[1]) FROM files WHERE starts_with(path, d || '/')) AS n FROM (SELECT unnest(['00-Inbox', '02-Areas', '01-Projects/book0', 'none']) AS d)
        UNION ALL SELECT d, false, (SELECT count(*) FROM files WHERE path = d) FROM (SELECT unnest(['01-Projects/book0/PRD.md', 'none.md']) AS d))""",
    "book_source_plan": """SELECT min(path) AS path, 'link' AS action, '01-Projects/book0/sources/' || regexp_extract(path, '[^/]*$') AS new_path FROM files
      WHERE path LIKE '%.md' AND path NOT LIKE '01-Projects/book0/%' AND starts_with(content, '---' || chr(10)) AND contains(string_split(substr(content, 5), chr(10) || '---')[1], 'layer/raw') GROUP BY 3""",
    "book_export_plan": "SELECT path, 'copy' AS action, '/out/' || substr(path, 13) AS new_path FROM files WHERE path LIKE '01-Projects/book0/%' AND NOT regexp_matches(substr(path, 19), '(^|/)(\\.|sources(/|$))')",
    "book_init_plan": """SELECT '01-Projects/book7/' || f AS path, 'write' AS action, md5(t) AS digest FROM (SELECT 'PRD.md' AS f, array_to_string(['---', 'title: book7', 'genre: essay', 'language: en', 'target_audience: ', 'word_count_goal: 0', '---', '', '# book7', '', '## Overview', '', '## Target Audience', '', '## Goals', '', '## Word Count Target', ''], chr(10)) AS t
      UNION ALL SELECT 'STYLE.md', array_to_string(['---', 'type: style-guide', '---', '', '# Style Guide', '', '## Voice', '', '## Tone', '', '## Forbidden Patterns', ''], chr(10)))
      UNION ALL SELECT '01-Projects/book0/' || f, 'write', md5('') FROM (SELECT unnest(['PRD.md', 'STYLE.md']) AS f) WHERE '01-Projects/book0/' || f NOT IN (SELECT path FROM files)""",
    "vault_notes": "SELECT path, stem, has_fm, CAST(strlen(content) AS BIGINT) AS n_bytes, md5(content) AS digest FROM notes",
    "wikilinks": "SELECT * FROM links",
    "raw_targets": "SELECT raw_target AS target, count(*) AS n FROM links GROUP BY 1",
    "link_edges": "SELECT * FROM edges",
    "graph_health": """SELECT (SELECT count(*) FROM notes) AS total_notes, (SELECT count(*) FROM edges) AS total_links, (SELECT count(*) FROM orph) AS orphan_count,
        (SELECT count(*) FROM edges WHERE dst NOT IN (SELECT path FROM notes)) AS broken_links, (SELECT count(DISTINCT component) FROM comp) AS components,
        (SELECT string_agg(path || ':' || incoming, ',' ORDER BY incoming DESC, path) FROM hubs) AS hubs, round((SELECT count(*) FROM edges) / (SELECT count(*) FROM notes), 6) AS average_links""",
    "orphans": r"SELECT path FROM orph JOIN notes USING (path) WHERE strlen(content) >= 200 AND strlen(regexp_replace(content, '(?s)\A---.*?---\n?', '')) >= 200 AND NOT contains(path, '/seeded/')",
    "broken_edges": "SELECT DISTINCT src, raw_target AS dst FROM res WHERE dst IS NULL AND raw_target NOT IN (SELECT path FROM notes)",
    "hub_notes": "SELECT * FROM hubs",
    "degrees": "SELECT * FROM deg",
    "connected_components": "SELECT * FROM comp",
    "two_hop_pairs": """SELECT source, CASE WHEN source = low THEN high ELSE low END AS target FROM (SELECT least(a, b) AS low, greatest(a, b) AS high, min(a) AS source FROM (
        SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT x.src, y.dst FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src <> y.dst AND x.src <> x.dst AND y.src <> y.dst) GROUP BY 1, 2)""",
    "check_links": "SELECT * FROM checked",
    "link_issue_counts": "SELECT coalesce(issue, 'resolved') AS issue, count(*) AS links, count(DISTINCT source) AS files FROM checked GROUP BY 1",
    "tags_exploded": "SELECT * FROM tagrows",
    "tag_counts": "SELECT tag, count(*) AS n FROM tagrows GROUP BY 1",
    "tag_docs": "SELECT * FROM tn",
    "tag_jaccard": "SELECT * FROM jac",
    "tag_clusters": "SELECT canonical, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (tag <> canonical), '') AS aliases, max(docs) FILTER (tag = canonical) AS document_count FROM canon GROUP BY 1",
    "tags_before_after": "SELECT (SELECT count(*) FROM tagrows) AS before, (SELECT count(*) FROM (SELECT DISTINCT path, canonical FROM td JOIN canon USING (tag))) AS after",
    "check_tags": "SELECT * FROM tagissues",
    "check_tags_projects": "SELECT * FROM tagissues WHERE file LIKE '99-Archives/projects/%'",
    "check_frontmatter": "SELECT * FROM fmissues",
    "frontmatter_file_counts": "SELECT issue, count(*) AS issues, count(DISTINCT file) AS files FROM fmissues GROUP BY 1",
    "project_docs": "SELECT project, path FROM pdocs",
    "concept_hits": "SELECT * FROM hits",
    "bridges": "SELECT * FROM br",
    "project_adjacency": "SELECT x.project, y.project AS other, string_agg(DISTINCT x.concept, ',' ORDER BY x.concept) AS shared FROM hits x JOIN hits y ON x.concept = y.concept AND x.project <> y.project GROUP BY 1, 2",
    "backlinks": r"""SELECT d.path, z.stem AS zettel FROM pdocs d JOIN notes z ON regexp_matches(z.path, '^10-Zettelkasten/[^/]*$') AND len(string_split(lower(replace(z.stem, '-', ' ')), ' ')) >= 2
        AND len(list_filter(string_split(lower(replace(z.stem, '-', ' ')), ' '), lambda w: NOT contains(lower(d.content), w))) = 0
        WHERE len(string_split(rtrim(d.content, chr(10)), chr(10))) + len(d.content) - len(rtrim(d.content, chr(10))) - CASE WHEN d.content LIKE '%' || chr(10) THEN 1 ELSE 0 END >= 3""",
    "auto_tags": f"SELECT path, string_agg(tag, ',' ORDER BY tag) AS tags FROM ({EARNED}) GROUP BY 1",
    "zones": "SELECT path, kind || zname AS zone FROM zoned",
    "zone_counts": "SELECT k.kind, count(c.path) AS n FROM (SELECT unnest(['Inbox', 'Projects', 'Areas', 'Resources', 'Zettelkasten', 'Archives']) AS kind) k LEFT JOIN cards c USING (kind) GROUP BY 1",
    "note_cards": "SELECT path, title, vitality, layer, word_count, CAST(modified_on AS VARCHAR) AS modified_on, incoming_links, outgoing_links, has_mermaid, is_orphan, tags, zone FROM cards",
    "attention_orphans": attention("is_orphan"),
    "attention_stale": attention("age > 30"),
    "attention_untagged": attention("len(tl) = 0"),
    "find_related": """SELECT path, title, score FROM (SELECT path, CAST(sum(s) AS BIGINT) AS score FROM (SELECT src AS path, 2 AS s FROM edges WHERE dst = '00-Inbox/note-0.md' UNION ALL SELECT dst, 2 FROM edges WHERE src = '00-Inbox/note-0.md'
        UNION ALL SELECT path, 1 FROM (SELECT path, unnest(tl) AS tag FROM cards WHERE path <> '00-Inbox/note-0.md') WHERE tag IN (SELECT unnest(tl) FROM cards WHERE path = '00-Inbox/note-0.md')) GROUP BY 1 ORDER BY score DESC, path LIMIT 5) JOIN cards USING (path)""",
    "search_cards": """SELECT path, title FROM cards WHERE list_has_any(tl, ['lang/de', 'lang/fr']) AND kind IN ('Areas', 'Inbox', 'Zettelkasten') AND (contains(lower(title), 'note 1') OR contains(lower(path), 'note 1') OR contains(lower(tags), 'note 1'))""",
    "recent_cards": "SELECT path, CAST(modified_on AS VARCHAR) AS modified_on FROM cards c WHERE c.modified_on >= DATE '2024-01-01'",
    "moc_groups": "SELECT project, CASE WHEN len(string_split(path, '/')) = 2 THEN 'Core Docs' ELSE array_to_string(string_split(path, '/')[2:-2], '/') END AS grp, string_agg(stem_path, ',' ORDER BY stem_path) AS links FROM pdocs GROUP BY 1, 2",
    "moc_files": "SELECT path FROM notes WHERE len(string_split(path, '/')) = 2 AND string_split(path, '/')[1] || '.md' = string_split(path, '/')[2]",
    "project_links": "SELECT '99-Archives/projects/' || name || '/' || CASE WHEN hub THEN name ELSE '' END AS link FROM plinks",
    "index_sections": r"""SELECT CAST(0 AS INTEGER) AS section, stem_path AS pos, '- [[' || stem_path || ']]' AS line FROM notes WHERE path LIKE '02-Areas/%'
        UNION ALL SELECT 1, l, '- [[' || l || ']]' FROM (SELECT '99-Archives/projects/' || name || '/' || CASE WHEN hub THEN name ELSE '' END AS l FROM plinks)
        UNION ALL SELECT 2, stem_path, '- [[' || stem_path || ']]' FROM notes WHERE path LIKE '10-Zettelkasten/%'
        UNION ALL SELECT 3, lpad(CAST(100000000000 - incoming AS VARCHAR), 12, '0') || ' ' || path, '- [[' || regexp_replace(path, '\.[^./]*$', '') || ']] (' || incoming || ' incoming)' FROM hubs
        UNION ALL SELECT 4, '0', '- [[TAGGING]]' UNION ALL SELECT 4, '1', '- [[Home]]'""",
    "inbox_routing": """SELECT path, CASE WHEN path LIKE '%.pdf' THEN 'convert' WHEN status = 'confirmed' THEN 'move' WHEN status IN ('needs_review', 'processed') THEN 'skip' ELSE 'analyse' END AS state,
        CASE WHEN status = 'confirmed' THEN CASE lower(coalesce(cat, 'Resources')) WHEN 'projects' THEN '01-Projects' WHEN 'areas' THEN '02-Areas' WHEN 'archive' THEN '99-Archives' WHEN 'zettelkasten' THEN '10-Zettelkasten/fleeting'
          WHEN 'resources' THEN '03-Resources/Reference/Articles-Papers' ELSE '99-Archives' END || '/' || regexp_extract(path, '[^/]*$') END AS new_path FROM inb2""",
    "book_status": r"""SELECT project, coalesce(genre, '') AS genre, draft, edit, publish, sources FROM (SELECT string_split(path, '/')[2] AS project, max(path LIKE '01-Projects/%/PRD.md') AS prd, max(path LIKE '01-Projects/%/STYLE.md') AS style,
        max(CASE WHEN path LIKE '%/PRD.md' THEN nullif(regexp_extract(content, '(?m)^genre: *(.*)$', 1), '') END) AS genre, max(path LIKE '01-Projects/%/drafts/%') AS draft, max(path LIKE '01-Projects/%/edits/%') AS edit,
        max(path LIKE '01-Projects/%/publish/%') AS publish, max(path LIKE '01-Projects/%/sources/%') AS sources FROM files WHERE path LIKE '01-Projects/%/%' GROUP BY 1) WHERE prd AND style""",
    "book_sources": "SELECT path FROM files WHERE path LIKE '%.md' AND starts_with(content, '---' || chr(10)) AND contains(string_split(substr(content, 5), chr(10) || '---')[1], 'layer/raw')",
    "note_count": f"SELECT count(*) AS notes FROM files WHERE path LIKE '%.md' AND NOT list_contains({listed(CONFIG.all_system_dirs())}, string_split(path, '/')[1])",
    "commit_summary": r"""SELECT 'chore(vault): auto-update ' || coalesce(nullif(concat_ws(', ', CASE WHEN (SELECT count(*) FROM touched WHERE contains(file, '/') AND ends_with(file, string_split(file, '/')[1] || '.md')) > 0 THEN 'MOC' END,
          CASE WHEN (SELECT count(*) FROM touched WHERE regexp_matches(file, '[Zz]ettelkasten')) > 0 THEN 'bridge notes' END, CASE WHEN (SELECT count(*) FROM touched WHERE contains(file, '/src/') OR ends_with(file, '.rs')) > 0 THEN 'source' END), ''), 'vault content')
        || ' (' || count(*) || ' files)' AS message, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'renamed') AS renamed, count(*) FILTER (kind = 'removed') AS removed FROM changed""",
    "sync_round": f"SELECT a.path, md5(a.content) AS digest FROM after{len(ROUND)} a LEFT JOIN files f USING (path) WHERE a.content IS DISTINCT FROM f.content",
    "snapshot_changes": "SELECT path, kind, old_path FROM changed",
    "delta_edges": "SELECT src, dst FROM l_edges",
    "edge_changes": "SELECT src, dst, 'added' AS change FROM l_edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM edges) UNION ALL SELECT src, dst, 'removed' FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM l_edges)",
    "outside_nested": "SELECT path, stem FROM n_notes WHERE NOT EXISTS (SELECT 1 FROM repos WHERE starts_with(path, root || '/'))",
    "nested_repos": "SELECT root FROM repos",
    "check_totals": """SELECT 'tags' AS "check", (SELECT count(*) FROM needed) AS scanned, (SELECT count(*) FROM tagissues) AS issues, (SELECT count(*) FROM tagissues) AS fixed
      UNION ALL SELECT 'frontmatter', (SELECT count(*) FROM notes), (SELECT count(*) FROM fmissues), (SELECT count(DISTINCT file) FROM fmissues WHERE issue <> 'empty_tags')
      UNION ALL SELECT 'links', (SELECT count(*) FROM checked), (SELECT count(*) FROM checked WHERE issue IS NOT NULL), (SELECT count(*) FROM checked WHERE issue IN ('extension_mismatch', 'filename_mismatch'))""",
    "status_rollup": r"""SELECT CAST(n AS INTEGER) AS level, folder, ext, state, count(*) AS files, count(*) FILTER (note) AS notes, CAST(sum(size) AS BIGINT) AS bytes FROM up GROUP BY GROUPING SETS ((n, folder), (n, folder, ext), (n, folder, state))""",
    "two_hop_classes": """SELECT count(*) AS pairs, CAST(0 AS INTEGER) AS members FROM (SELECT DISTINCT least(a, b) AS l, greatest(a, b) AS h FROM (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION ALL SELECT x.src, y.dst FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst))""",
    "home_plan": """SELECT 'Home.md' AS path, 'write' AS action, md5('---' || chr(10) || 'type: moc' || chr(10) || 'tags: [home]' || chr(10) || '---' || chr(10) || chr(10) || '# Home' || chr(10) || chr(10) || '## Projects' || chr(10) || string_agg('- [[' || project || '/' || project || ']]' || chr(10), '' ORDER BY project)) AS digest FROM (SELECT DISTINCT project FROM pdocs)""",
    "book_folder_plan": """SELECT path, action, new_path FROM (SELECT '01-Projects/' || b || '/' || f AS path, 'folder' AS action, NULL::VARCHAR AS new_path, '01-Projects/' || b || '/' || f AS spot FROM (SELECT unnest(['book0', 'book7']) AS b), (SELECT unnest(['drafts', 'edits', 'publish/cover']) AS f)
        UNION ALL SELECT '03-Resources', 'link', '01-Projects/' || b || '/sources', '01-Projects/' || b || '/sources' FROM (SELECT unnest(['book0', 'book7']) AS b))
      WHERE NOT EXISTS (SELECT 1 FROM files WHERE files.path = spot OR starts_with(files.path, spot || '/'))""",
    "page_link_graph": r"""SELECT DISTINCT l.page_id, l.href, coalesce(t.target_id, -1) AS target_id FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"''#\s>]+)', 1)) AS href FROM pages) l LEFT JOIN (SELECT url, min(page_id) AS target_id FROM pages GROUP BY 1) t ON t.url = l.href""",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
SQL = {name: sql(q) for name, q in QUERIES.items()}
