"""A synthetic vault over the driver's tables; one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.config import Concept

AS_OF = "2024-01-31"
CONCEPTS = [
    Concept("articles", ["the ", "una "], ["grammar", "evergreen"]), Concept("secrecy", ["password", "token", "api_key"], ["security"]),
    Concept("german", [" der ", " und "], ["lang/de"]), Concept("never", ["zzzzqqqq"], ["none"]),
]

#: {S}: the string type; {day}: a date so many days before AS_OF.
VAULT = """
SELECT CASE doc_id % 6 WHEN 0 THEN '00-Inbox' WHEN 1 THEN CASE WHEN doc_id % 30 = 13 THEN '02-Areas/.obsidian-x' ELSE '02-Areas/' || lang END WHEN 2 THEN '03-Resources/Technical'
    WHEN 3 THEN '10-Zettelkasten' WHEN 4 THEN '99-Archives/projects/' || source ELSE source || CASE WHEN doc_id % 7 = 0 THEN '/deep' ELSE '' END END
    || '/note-' || CAST(doc_id AS {S}) || '.md' AS path,
  CASE WHEN doc_id % 10 = 9 THEN '' WHEN doc_id % 10 = 8 THEN '---' || chr(10) || 'tags:' || chr(10) || '  - ' || source || chr(10) || '  - layer/wiki' || chr(10) || 'summary: "About ' || source || '"' || chr(10) || '---' || chr(10) ELSE '---' || chr(10) || 'tags: [' || source || ', lang/' || lang || CASE WHEN doc_id % 3 = 0 THEN ', layer/raw' ELSE '' END
    || CASE WHEN doc_id % 9 <> 4 THEN ', topic-' || source ELSE '' END || CASE WHEN doc_id % 8 = 1 THEN ', ' || upper(source) ELSE '' END || ']' || chr(10) || CASE doc_id % 4 WHEN 1 THEN 'status: confirmed' || chr(10) || 'category: '
    || CASE doc_id % 5 WHEN 0 THEN 'projects' WHEN 1 THEN 'Zettelkasten' WHEN 2 THEN 'Resources' WHEN 3 THEN 'Odd' ELSE 'Areas' END || chr(10)
    WHEN 2 THEN 'status: needs_review' || chr(10) ELSE '' END || '---' || chr(10) END
    || '# Note ' || CAST(doc_id AS {S}) || chr(10) || chr(10) || text || chr(10)
    || CASE WHEN doc_id % 4 <> 0 THEN 'See [[note-' || CAST((doc_id * 13 + 7) % (n + 50) AS {S}) || ']].' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN 'And [[x/Note-' || CAST((doc_id * 7 + 3) % n AS {S}) || '|alias]].' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN 'File [[extra-' || CAST(doc_id % 9 AS {S}) || ']] and [[note ' || CAST(doc_id % n AS {S}) || '.md]].' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 7 = 0 THEN '```' || chr(10) || '[[note-0]]' || chr(10) || '```' || chr(10) ELSE '' END AS content,
  {day} AS modified_on
FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'xx') AS lang, coalesce(source, 'src') AS source FROM documents) d CROSS JOIN (SELECT count(*) AS n FROM documents) c
UNION ALL
SELECT CASE WHEN k < 5 THEN '99-Archives/projects/src' || s || '/PRD.md' WHEN k < 10 THEN '99-Archives/projects/src' || s || '/ARCHITECTURE.md'
    WHEN k < 13 THEN '99-Archives/projects/src' || s || '/reports/weekly-' || s || '.md' WHEN k < 16 THEN '03-Resources/Laws-Of-Software-Engineering/law-' || s || '.md'
    WHEN k < 20 THEN 'src' || s || '/src' || s || '.md' WHEN k < 22 THEN '01-Projects/book' || s || '/PRD.md' WHEN k < 24 THEN '01-Projects/book' || s || '/STYLE.md'
    ELSE '99-Archives/projects/src1/src1.md' END,
  CASE k % 5 WHEN 0 THEN '---' || chr(10) || 'tags: [layer/raw, type/prd, src' || s || ']' || chr(10) || 'genre: essay' || chr(10) || '---' || chr(10) || '# T' || chr(10)
    WHEN 1 THEN '---project: foo' || chr(10) || 'tags:' || chr(10) || '  - layer/raw' || chr(10) || '---' || chr(10) || 'body' || chr(10)
    WHEN 2 THEN '---' || chr(10) || 'tags: [layer/raw, "type/report"]project: foo' || chr(10) || '---' || chr(10) || 'body' || chr(10)
    WHEN 3 THEN '---' || chr(10) || 'tags:' || chr(10) || 'next: 1' || chr(10) || '---' || chr(10) || 'x' || chr(10)
    ELSE '---' || chr(10) || 'tags: []' || chr(10) || '---' || chr(10) || 'see [[note-3]] and [[Note 4]]' || chr(10) END,
  DATE '2024-01-01'
FROM (SELECT n_nationkey AS k, CAST(CASE WHEN n_nationkey < 20 THEN n_nationkey % 5 WHEN n_nationkey < 22 THEN n_nationkey - 20 ELSE n_nationkey - 22 END AS {S}) AS s FROM nation) t
UNION ALL
SELECT '10-Zettelkasten/' || CASE r_regionkey WHEN 0 THEN 'in-the' WHEN 1 THEN 'of-the' WHEN 2 THEN 'de-la' WHEN 3 THEN 'single' ELSE 'no-hit-zzzq' END || '.md', '# Z' || chr(10), DATE '2023-12-01' FROM region
UNION ALL
SELECT '03-Resources/extra-' || CAST(r_regionkey AS {S}) || '.txt', 'plain', DATE '2023-12-01' FROM region
UNION ALL
SELECT '01-Projects/book' || CAST(r_regionkey AS {S}) || '/drafts/one.md', 'draft', DATE '2023-12-01' FROM region WHERE r_regionkey < 2
"""
#: The vault some time later: notes edited, moved, dropped and added, some with names that others have or wait for. {files}: the vault.
LATER = """
SELECT CASE WHEN k % 23 = 5 THEN replace(path, '/note-', '/moved-') ELSE path END AS path,
  CASE WHEN k % 19 = 3 THEN content || 'Now [[note-' || CAST(k % 7 AS {S}) || ']] and [[late-' || CAST(k % 6 AS {S}) || ']].' || chr(10) WHEN k % 31 = 8 THEN replace(content, '[[note-', '[[moved-') ELSE content END AS content, modified_on
FROM (SELECT *, CAST(nullif(regexp_extract(path, '/note-([0-9]+)', 1), '') AS INT) AS k FROM ({files}) f) t WHERE k IS NULL OR k % 29 <> 7
UNION ALL SELECT '00-A/note-' || CAST(r_regionkey AS {S}) || '.md', '# Shadow' || chr(10) || 'see [[note-' || CAST(r_regionkey + 40 AS {S}) || ']]' || chr(10), DATE '2024-02-01' FROM region
UNION ALL SELECT 'src1/late-' || CAST(r_regionkey AS {S}) || '.md', '# Late' || chr(10) || '[[moved-5]] the token' || chr(10), DATE '2024-02-01' FROM region
"""
#: Files of repositories within the vault: the folder of a ``.git`` file or folder and all below it, one in another, one beside a folder whose name begins alike.
NESTED = """
SELECT path, content, modified_on FROM ({files}) f
UNION ALL SELECT 'src1/' || d || '/' || f AS path, '# N' || chr(10) || 'see [[note-' || CAST(r_regionkey AS {S}) || ']]' || chr(10) AS content, DATE '2024-01-02' AS modified_on
FROM (SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'repo' WHEN 1 THEN 'repo/inner/deep' ELSE 'repo-not' END AS d, 'n' || CAST(r_regionkey AS {S}) || '.md' AS f FROM region) t
UNION ALL SELECT 'src1/repo/.git/config', 'x', DATE '2024-01-02' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'src1/repo/inner/.git', 'gitdir: x', DATE '2024-01-02' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'src2/linked/.git', 'gitdir: y', DATE '2024-01-02' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'src2/linked/b.md', '[[note-1]]', DATE '2024-01-02' FROM region WHERE r_regionkey < 2 AND r_regionkey > 0
"""
SPARK_SQL = VAULT.format(S="STRING", day="date_sub(DATE '2024-01-31', CAST(doc_id % 120 AS INT))")
DUCK_SQL = VAULT.format(S="VARCHAR", day="DATE '2024-01-31' - CAST(doc_id % 120 AS INTEGER)")


LATER_DUCK, NESTED_DUCK = (x.format(S="VARCHAR", files="SELECT * FROM files") for x in (LATER, NESTED))


def files(spark: SparkSession, sf_dir: str, kind: str = "now") -> DataFrame:
    """``files(path, content, modified_on)`` of the synthetic vault, of its ``later`` state, or with ``nested`` repositories."""
    sql = SPARK_SQL if kind == "now" else {"later": LATER, "nested": NESTED}[kind].format(S="STRING", files=SPARK_SQL)
    for t in ("documents", "nation", "region"):
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)
