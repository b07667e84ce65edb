import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.config import Concept, VaultConfig, resolve_vault
from quillspark.operators import ai, audit, bridges, dashboard, edits, graph, hubs, inbox, links, tags
from quillspark.operators.components import connected_components
from quillspark.sources import vault as V

DAY = datetime.date(2024, 1, 31)


@pytest.fixture(scope="module")
def files(spark):
    def make(d):
        return spark.createDataFrame([(p, c, DAY) for p, c in d.items()], "path string, content string, modified_on date")

    return make


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_resolution_order(files):
    f = files({"a/Note.md": "", "b/note.md": "", "c.md": "[[A/NOTE]] [[zzz/Note.md]] [[none]] [[x\\c]] [[Note#head]]"})
    n = graph.notes(f)
    got = {r.raw_target: r.dst for r in graph.resolved(graph.links(n), n).collect()}
    assert got == {"A/NOTE": "a/Note.md", "zzz/Note.md": "a/Note.md", "none": None, "x\\c": "c.md", "Note#head": None}


def test_hand_built_graph(spark, files):
    n = graph.notes(files({"a.md": "", "b.md": "", "c.md": ""}))
    e = spark.createDataFrame([("a.md", "b.md"), ("a.md", "missing.md")], "src string, dst string")
    assert rows(graph.orphans(n, e)) == [("c.md",)] and rows(graph.broken_edges(e, n)) == [("a.md", "missing.md")]
    assert graph.components(n, e.limit(1)).select("component").distinct().count() == 2
    hub = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("a", "b")], "src string, dst string")
    assert tuple(graph.hub_notes(hub, 1).first()) == ("hub", 2)
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    assert rows(graph.two_hop_pairs(pairs)) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_exclusion_and_orphan_filters(files):
    f = files({"_template/a.md": "", "x/seeded/b.md": "", "01-Projects/c.md": "", "ok/_n.md": "---\na: 1\n---\nhello", ".obsidian-x/d.md": "", "z.txt": ""})
    n = graph.notes(f)
    assert rows(n.select("path")) == [(".obsidian-x/d.md",), ("ok/_n.md",)]
    n = graph.notes(f, VaultConfig(tool_dirs=[".obsidian-x"]).graph_excluded())
    assert rows(n.select("path")) == [("ok/_n.md",)]
    e = graph.edges(n)
    assert graph.orphans(n, e, least_bytes=6).count() == 0 and graph.orphans(n, e, least_bytes=5).count() == 1
    assert graph.notes(f, []).count() == 5


def test_components_of_a_long_path_and_of_random_graphs(spark):
    path = [(i, i + 1) for i in range(700)]
    got = connected_components(spark.createDataFrame(path, "u long, v long"))
    assert got.count() == 701 and {r.component for r in got.collect()} == {0}
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(5, 5), (None, 3)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(rows(connected_components(spark.createDataFrame(pairs, "u long, v long"))))
    touched = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_link_check_and_repair(files):
    f = files({"src.md": "[[Nonexistent]] [[Some Note]] [[My-Note]] [[Both]] [[ok]]", "Some Note.txt": "t", "My Note.md": "m", "Both.md": "", "Both.txt": "", "ok.md": ""})
    n = graph.notes(f)
    got = {r.target: r.issue for r in links.check_links(f, n).collect()}
    assert got == {"Nonexistent": "unresolved", "Some Note": "extension_mismatch", "My-Note": "filename_mismatch", "Both": None, "ok": None}
    plan = {r.path: (r.action, r.new_path) for r in links.repair_plan(links.check_links(f, n), f, graph.edges(n)).collect()}
    assert plan == {"Some Note.txt": ("rename", "Some Note.md"), "My Note.md": ("rename", "My-Note.md")}
    after = edits.applied(f, links.repair_plan(links.check_links(f, n), f, graph.edges(n)))
    assert links.repair_plan(links.check_links(after, graph.notes(after)), after, graph.edges(graph.notes(after))).count() == 0
    linked = files({"src.md": "[[My-Note|x]] [[My Note]]", "My Note.md": "m"})
    plan = links.repair_plan(links.check_links(linked, graph.notes(linked)), linked, graph.edges(graph.notes(linked))).collect()
    assert [(r.path, r.new_content) for r in plan] == [("src.md", "[[My Note|x]] [[My Note]]")]


def test_tag_clusters(files):
    note = lambda *t: f"---\ntags: [{', '.join(t)}]\n---\nx\n"
    f = files({"a.md": note("Rust", "rust-lang"), "b.md": note("rust", "rust-lang"), "c.md": note("rust"), "d.md": note("python")})
    n = graph.notes(f)
    td = tags.tag_docs(n)
    assert rows(tags.clusters(td)) == [("python", [], 1), ("rust", ["rust-lang"], 3)]
    assert tuple(tags.before_after(n).first()) == (6, 4)
    plan = tags.normalization_plan(n, tags.membership(td))
    assert {r.path: r.new_content for r in plan.collect()} == {"a.md": note("rust"), "b.md": note("rust")}
    after = graph.notes(edits.applied(f, plan))
    assert tags.normalization_plan(after, tags.membership(tags.tag_docs(after))).count() == 0


def test_suggestions_merge(spark):
    c = spark.createDataFrame([("rust", ["rust-lang"], 3)], "canonical string, aliases array<string>, document_count long")
    s = spark.createDataFrame([("rust-lang", ["rs"]), ("go", ["golang"])], "canonical string, aliases array<string>")
    assert rows(tags.merged_suggestions(c, s)) == [("go", ["golang"], 0), ("rust", ["rust-lang", "rs"], 3)]


def test_tag_audit(files):
    base = "99-Archives/projects/p/"
    f = files({
        base + "PRD.md": "title: Test\n", base + "reports/weekly.md": "---\ntags: [layer/raw, p]\n---\n", base + "other.md": "", base + "DEBT.md": "---\ntags: [layer/raw, type/debt]project: p\n---\nb\n",
        "03-Resources/Laws-Of-Software-Engineering/x.md": "---\ncreated: 2026-05-14\n---\n# H\n",
    })
    n = graph.notes(f)
    got = rows(audit.check_tags(n).select("file", "issue"))
    assert got == sorted([(base + "PRD.md", i) for i in ("missing_layer", "missing_type", "missing_project")] + [(base + "reports/weekly.md", "missing_type"), (base + "DEBT.md", "missing_project"), (base + "DEBT.md", "yaml_malform")] + [("03-Resources/Laws-Of-Software-Engineering/x.md", i) for i in ("missing_layer", "missing_type")], key=str)
    assert audit.check_tags(n, "project").filter("file like '03%'").count() == 0
    plan = audit.tag_fix_plan(n)
    text = {r.path: r.new_content for r in plan.collect()}
    assert text["03-Resources/Laws-Of-Software-Engineering/x.md"] == "---\ntags: [layer/raw, type/reference]\ncreated: 2026-05-14\n---\n# H\n"
    assert text[base + "DEBT.md"] == "---\ntags: [layer/raw, type/debt, p]\nproject: p\n---\nb\n"
    assert text[base + "PRD.md"] == "---\ntags: [layer/raw, type/prd, p]\n---\ntitle: Test\n"
    after = graph.notes(edits.applied(f, plan))
    assert audit.check_tags(after).count() == 0 and audit.tag_fix_plan(after).count() == 0


def test_frontmatter_audit(files):
    base = "99-Archives/projects/p/"
    f = files({"a.md": "---project: foo\nx\n---\n", "b.md": "---\ntags:\nnext: 1\n---\n", "c.md": "---\ntags: []\n---\nx\n", base + "PRD.md": "no fm\n"})
    n = graph.notes(f)
    assert rows(audit.check_frontmatter(n).select("file", "issue")) == [(base + "PRD.md", "missing_frontmatter"), ("a.md", "closing_brace_malform"), ("b.md", "broken_yaml_list"), ("c.md", "empty_tags")]
    plan = audit.frontmatter_fix_plan(n)
    assert {r.path for r in plan.collect()} == {"a.md", "b.md", base + "PRD.md"}
    after = graph.notes(edits.applied(f, plan))
    assert rows(audit.check_frontmatter(after).select("issue")) == [("empty_tags",), ("empty_tags",)] and audit.frontmatter_fix_plan(after).count() == 0


CONCEPTS = [Concept("async", ["await", "async"], ["concurrency", "evergreen"]), Concept("db", ["sql"], ["data"])]


def test_projects_and_plans(files):
    f = files({
        "p/p.md": "# P\n## Related Projects\nold\n", "p/a.md": "we await\nx\ny\n", "p/src/skip.md": "sql", "q/q.md": "# Q\n", "q/sub/b.md": "ASYNC and sql graph theory\nl\nl\n",
        "10-Zettelkasten/graph-theory.md": "# G\n", "10-Zettelkasten/single.md": "", ".hidden/x.md": "await", "02-Areas/y.md": "await",
    })
    config = VaultConfig(concepts=CONCEPTS)
    n = graph.notes(f)
    docs = bridges.project_docs(n, config)
    assert rows(docs.select("path")) == [("p/a.md",), ("q/sub/b.md",)]
    found = bridges.bridges(bridges.concept_hits(docs, CONCEPTS), CONCEPTS)
    assert [(r.concept, r.projects) for r in found.collect()] == [("async", ["p", "q"])]
    note = bridges.bridge_note_plan(found, n, config).first()
    assert (note.path, note.new_content) == ("10-Zettelkasten/async.md", "---\ntags: [concurrency, evergreen]\n---\n\n# async\n\n> Auto-generated bridge note.\n\n## Related Projects\n- [[p/p]]\n- [[q/q]]\n")
    assert rows(bridges.backlinks(docs, n, config)) == [("q/sub/b.md", "graph-theory")]
    text = {r.path: r.new_content for r in bridges.backlink_plan(docs, bridges.backlinks(docs, n, config), config).collect()}
    assert text["q/sub/b.md"].endswith("\n\n## See Also\n- [[q/q]]\n- [[10-Zettelkasten/graph-theory]]\n")
    assert dict(rows(bridges.auto_tags(docs, CONCEPTS).select("path", "tags"))) == {"p/a.md": ["concurrency", "p"], "q/sub/b.md": ["concurrency", "data", "q"]}
    related = {r.path: r.new_content for r in bridges.related_plan(found, n, config).collect()}
    assert related["p/p.md"] == "# P\n\n## Related Projects\n- [[q/q]] — shared: async\n\n## Key Concepts\n- [[10-Zettelkasten/async]]\n\n"
    assert hubs.groups(n, config).filter("project = 'q'").first().grp == "sub"
    hub = {r.path: r.new_content for r in hubs.hub_plan(n, config).collect()}
    assert hub["q/q.md"] == "---\nproject: q\ntype: moc\ntags: [q]\n---\n\n# Q MOC\n\n## Sub\n- [[q/sub/b]]\n\n" and hub["p/p.md"].endswith("\n## Related Projects\nold\n")
    from quillspark.streaming.inbox import sync

    once, failed = sync(f, config)
    again, failed_again = sync(once, config)
    assert not failed and not failed_again
    assert {r.path for r in once.collect()} == {r.path for r in again.collect()}


def test_index(files):
    f = files({"02-Areas/a.md": "[[b]]", "10-Zettelkasten/b.md": "", "99-Archives/projects/x/x.md": "", "99-Archives/projects/y/PRD.md": ""})
    n = graph.notes(f)
    text = hubs.index_plan(n, graph.edges(n), VaultConfig(name="v")).first().new_content
    assert "# v -- Agent Index" in text and "- [[02-Areas/a]]" in text and "- [[99-Archives/projects/x/x]]" in text and "- [[99-Archives/projects/y/]]" in text and "(1 incoming)" in text
    empty = graph.notes(files({"x.txt": ""}))
    assert hubs.index_plan(empty, graph.edges(empty)).first().new_content.count("<!--") == 4
    kept = graph.notes(files({"index.md": "mine"}))
    assert hubs.index_plan(kept, graph.edges(kept), protected=True).count() == 0


@pytest.mark.parametrize("days,links_,tags_,words,least,most", [(0, 10, 5, 1000, 4, 5), (90, 0, 0, 50, 1, 2), (0, 3, 0, 100, 2, 5)])
def test_vitality_bounds(spark, days, links_, tags_, words, least, most):
    df = spark.createDataFrame([(DAY - datetime.timedelta(days), links_, 0, ["t"] * tags_, words)], "modified_on date, incoming_links long, outgoing_links long, tags array<string>, word_count long")
    assert least <= df.select(dashboard.vitality(F.lit(DAY))).first()[0] <= most


def test_zones(files):
    f = files({"00-Inbox/a.md": "", "01-Projects/b.md": "", "02-Areas/c.md": "", "99-Archives/projects/p/d.md": "", "99-Archives/e.md": "", "f.md": ""})
    assert [r[0] for r in f.orderBy("path").select(dashboard.zone_label(dashboard.zone(F.col("path")))).collect()] == ["Inbox", "Archives", "Areas/c.md", "Archives", "Projects/p", "Archives"]


@pytest.mark.parametrize("category,sub,detail,want", [
    ("Projects", "", "", "01-Projects"), ("AREAS", "", "", "02-Areas"), ("Zettelkasten", "Literature", "", "10-Zettelkasten/literature"), ("Resources", "Technical", "", "03-Resources/Technical"),
    ("Resources", "Reference", "books-notes", "03-Resources/Reference/Books-Notes"), ("Resources", "x", "", "03-Resources/Reference/Articles-Papers"), ("Other", "", "", "99-Archives"), ("Resources", "ideas", "", "10-Zettelkasten/fleeting"),
])
def test_destinations(spark, category, sub, detail, want):
    df = spark.createDataFrame([(category, sub, detail)], "a string, b string, c string")
    assert df.select(inbox.destination(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want


def test_inbox_states(files):
    f = files({"00-Inbox/a.md": "---\nstatus: confirmed\ncandidate_type: ConceptSeed\nown: kept\n---\nx", "00-Inbox/b.md": "---\nstatus: needs_review\n---\nx", "00-Inbox/c.md": "new\r\nnote", "00-Inbox/sub/d.md": "", "00-Inbox/e.pdf": ""})
    got = {r.path: (r.state, r.new_path) for r in inbox.routing(f).collect()}
    assert got == {"00-Inbox/a.md": ("move", "10-Zettelkasten/fleeting/a.md"), "00-Inbox/b.md": ("skip", None), "00-Inbox/c.md": ("analyse", None), "00-Inbox/e.pdf": ("convert", None)}
    plan = {r.path: r for r in inbox.process(f, "2024-01-31", lambda d: ai.candidates(d, "{content}")).collect()}
    assert plan["00-Inbox/a.md"].new_content == "---\nstatus: processed\ncandidate_type: ConceptSeed\nown: kept\nprocessed_at: 2024-01-31\n---\nx"
    assert plan["00-Inbox/c.md"].new_content.startswith("---\nstatus: needs_review\ncandidate_type: ") and plan["00-Inbox/c.md"].new_content.endswith("---\nnew\r\nnote")
    after = edits.applied(f, inbox.process(f, "2024-01-31"))
    assert inbox.routing(after).filter("state in ('move', 'analyse')").count() == 0


def test_stream_equals_batch(spark, files, tmp_path):
    from quillspark.streaming import inbox as S

    f = files({"00-Inbox/a.md": "---\nstatus: confirmed\n---\nx", "00-Inbox/c.md": "new"})
    f.select("path", "content", F.col("modified_on").cast("timestamp").alias("modified_on"), F.lit(0).cast("long").alias("version")).write.parquet(f"{tmp_path}/in")
    seen = []
    watch = lambda: S.watch(S.landed(spark, f"{tmp_path}/in"), lambda plan: seen.extend(rows(plan)), "2024-01-31", f"{tmp_path}/ck").awaitTermination()
    watch()
    assert seen == rows(inbox.process(f, "2024-01-31"))
    # Two versions of one time, and one that is older than what was planned.
    spark.createDataFrame(
        [("00-Inbox/c.md", "second", "2024-02-01", 1), ("00-Inbox/c.md", "third", "2024-02-01", 2), ("00-Inbox/a.md", "late", "2023-01-01", 0)], "path string, content string, t string, version long"
    ).select("path", "content", F.to_timestamp("t").alias("modified_on"), "version").write.mode("append").parquet(f"{tmp_path}/in")
    seen.clear()
    watch()
    assert [r[0] for r in seen] == ["00-Inbox/c.md"] and seen[0][3].endswith("---\nthird")


def test_sync_loop_and_step_flags(files):
    from quillspark.streaming import inbox as S

    f, applied, waits = files({"p/a.md": "text\n\nmore\n", "q/b.md": "x"}), [], []
    failed = S.rounds(lambda: f, lambda before, after: applied.append(after.count()), times=2, wait=waits.append, steps=["hubs"])
    assert failed == [[], []] and applied == [4, 4] and waits == [300]


def test_edits_that_contradict_each_other_fail(files, spark):
    f = files({"a.md": "a", "b.md": "b"})
    plan = lambda *rows: spark.createDataFrame(rows, "path string, action string, new_path string, new_content string, reason string")
    with pytest.raises(Exception, match="edits that differ for a.md"):
        edits.applied(f, plan(("a.md", "write", None, "AAA", ""), ("a.md", "write", None, "zzz", ""))).collect()
    with pytest.raises(Exception, match="two files for c.md"):
        edits.applied(f, plan(("a.md", "rename", "c.md", None, ""), ("b.md", "rename", "c.md", None, ""))).collect()
    with pytest.raises(Exception, match="there is a file b.md"):
        edits.applied(f, plan(("a.md", "rename", "b.md", None, ""))).collect()
    swapped = edits.applied(f, plan(("a.md", "rename", "b.md", None, ""), ("b.md", "rename", "a.md", None, ""), ("a.md", "copy", "z.md", None, "")))
    assert rows(swapped.select("path", "content")) == [("a.md", "b"), ("b.md", "a")]


def test_tags_of_cards_are_those_of_yaml(files):
    f = files({
        "a.md": "---\ntags:\n  - layer/wiki\n  - x\nother:\n  - y\n---\nt", "b.md": "---\ntags: [p, q]\n---\nt", "c.md": "---\ntags: [p, 7]\n---\nt", "d.md": "---\ntags: [p]bad: x\n---\nt", "e.md": "no",
    })
    got = {r.path: (r.tags, r.layer) for r in dashboard.scanned(f).collect()}
    assert got == {"a.md": (["layer/wiki", "x"], "layer/wiki"), "b.md": (["p", "q"], None), "c.md": (["p"], None), "d.md": ([], None), "e.md": ([], None)}


def test_orphans_are_linked_to_hubs(files):
    f = files({"p/p.md": "# P", "lone.md": "# One\n\nfirst\nsecond\n\n", "a.md": "[[p/p]]", "99-Archives/99-Archives.md": "no hub"})
    n = graph.notes(f)
    plan = ai.orphan_link_plan(n, graph.edges(n), client=lambda p: '{"suggested_links": ["p/p", "%s"]}' % ("first second" in p and "HUB p/p" in p and "HUB 99" not in p))
    assert {r.path: r.new_content for r in plan.collect()}["lone.md"] == "# One\n\nfirst\nsecond\n\n## See Also\n- [[p/p]]\n- [[True]]\n"
    assert ai.orphan_link_plan(n, graph.edges(n), client=lambda p: "none").count() == 0
    assert ai.orphan_link_plan(graph.notes(files({"lone.md": "x"})), graph.edges(n)).count() == 0
    assert {r.path: r.answer for r in ai.summarize(n, 50, str.upper).collect()}["p/p.md"].endswith("# P")
    assert ai.ping(lambda p: "OK")["ok"] and ai.ping(lambda p: 1 / 0)["answer"].startswith("ZeroDivisionError")


def test_tag_normalization_with_a_client(files):
    n = graph.notes(files({"a.md": "---\ntags: [Py, x]\n---\n", "b.md": "---\ntags: [py]\n---\n", "c.md": "---\ntags: [python, x]\n---\n", "d.md": "---\ntags: [python]\n---\n", "e.md": "---\ntags: [x]\n---\n"}))
    plan = {r.path: r.new_content for r in ai.normalized_tags(n, lambda p: '[{"canonical": "python", "aliases": ["py"]}]').collect()}
    assert plan == {"a.md": "---\ntags: [python, x]\n---\n", "b.md": "---\ntags: [python]\n---\n"}
    assert {r.path for r in ai.normalized_tags(n).collect()} == {"a.md"}


def test_book_projects(files):
    f = files({"01-Projects/b/PRD.md": "---\ngenre: essay\n---\n", "01-Projects/b/STYLE.md": "", "01-Projects/b/drafts/1.md": "", "01-Projects/c/PRD.md": "", "n.md": "---\ntags: [book/b, status/draft]\n---\n"})
    assert rows(hubs.book_status(f)) == [("b", "essay", True, False, False, False)]
    assert rows(hubs.book_sources(f, "book/b")) == [("n.md",)] and hubs.book_sources(f, "book/other").count() == 0
    assert rows(hubs.book_source_plan(f, "b").select("path", "action", "new_path")) == [("n.md", "link", "01-Projects/b/sources/n.md")]
    f = f.union(files({"01-Projects/b/sources/n.md": "", "01-Projects/b/.x/y.md": "", "01-Projects/b/a/sources/z.md": ""}))
    assert hubs.book_source_plan(f, "b").count() == 0
    assert rows(hubs.book_export_plan(f, "b", "/o").select("new_path")) == [("/o/b/PRD.md",), ("/o/b/STYLE.md",), ("/o/b/drafts/1.md",)]
    assert rows(hubs.book_init_plan(f, "c").select("path")) == [("01-Projects/c/STYLE.md",)]
    assert rows(hubs.folder_status(f, ["01-Projects/b", "no"], ["n.md", "no.md"])) == [("01-Projects/b", True, 6), ("n.md", True, 0), ("no", False, None), ("no.md", False, None)]
    assert inbox.inbox_count(files({"00-Inbox/a.md": "", "00-Inbox/d/x.md": "", "00-Inbox/d/y.md": "", "b.md": ""})).first()[0] == 2


def test_model_hooks(spark, files):
    assert ai.extract_json("x ```json\n{\"a\": 1}\n``` y") == '{"a": 1}' and ai.extract_json("so [1, [2]] x") == "[1, [2]]" and ai.extract_json("none") is None
    n = graph.notes(files({f"n{i}.md": f"text {i}" for i in range(6)}))
    pairs = spark.createDataFrame([(f"n{i}.md", f"n{i + 1}.md") for i in range(5)], "source string, target string")
    got = ai.relationships(pairs, n).collect()
    assert got and all(r.confidence >= 0.5 and r.relation in ai.RELATIONS for r in got)
    assert ai.answers(pairs, "source", lambda p: 1 / 0).filter("answer is not null").count() == 0


def test_real_folder(spark, tmp_path):
    for p in ("a.md", "_b.md", ".dot/c.md", ".git/x.md", "repo/.git/y", "repo/d.md", "with space/é.md", "t.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}\r\n", newline="")
    f = V.read_vault(spark, str(tmp_path), exclude=[".git"], partitions=3)
    assert rows(f.select("path")) == [(".dot/c.md",), ("_b.md",), ("a.md",), ("t.txt",), ("with space/é.md",)]
    assert f.filter("path = 'a.md'").first().content == "text of a.md\r\n"
    plan = spark.createDataFrame([("a.md", "move", "new/a.md", "moved"), ("_b.md", "write", None, "two")], "path string, action string, new_path string, new_content string")
    assert edits.apply_to_disk(plan, str(tmp_path)) == 3 and edits.apply_to_disk(plan, str(tmp_path)) == 0
    assert (tmp_path / "new/a.md").read_text() == "moved" and not (tmp_path / "a.md").exists()
    V.write_snapshot(V.read_vault(spark, str(tmp_path), exclude=[".git"]), f"{tmp_path}-snap")
    assert spark.read.parquet(f"{tmp_path}-snap").count() == 5


def test_config(tmp_path):
    (tmp_path / "vault.toml").write_text('[vault]\nname = "mine"\n[sync]\ninterval_minutes = 2\n[[graph.concepts]]\nname = "c"\nkeywords = ["k"]\n')
    c = VaultConfig.load(str(tmp_path), {"name": "other", "inbox_dir": "In"})
    assert (c.name, c.inbox_dir, c.interval_seconds(), c.interval_seconds(7), c.concepts[0].keywords) == ("mine", "In", 120, 7, ["k"])
    assert VaultConfig().interval_seconds() == 300 and resolve_vault(cwd=str(tmp_path), env="NO_SUCH") == str(tmp_path)


def test_queries_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as e

    c, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "nation", "region", "pages", "events"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    from quillspark.plans import registry

    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and set(queries) <= set(e.queries())
    for name in ("graph_health", "check_links", "tag_clusters", "tag_jaccard", "check_tags", "note_cards", "index_sections", "tag_fix_plan", "frontmatter_fix_plan", "moc_plan", "inbox_plan", "link_repair_plan"):
        got = queries[name](spark, sf).toPandas()
        want = c.sql(sql[name]).df()[list(got.columns)]
        text = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
        assert len(got) and text(got) == text(want), name


def test_sync_round_fails_with_a_step(spark, monkeypatch):
    from quillspark.plans import registry

    def lost(*_):
        raise OSError("lost task")

    monkeypatch.setattr(bridges, "backlinks", lost)
    with pytest.raises(RuntimeError, match="backlinks: lost task"):
        registry.queries()["sync_round"](spark, "/root/testdata/sf0.001")


def test_hierarchy_asks_for_all_tags(spark):
    asked = []

    def client(prompt):
        asked.append(prompt.split("\n")[1:])
        return '[{"canonical": "%s", "aliases": []}]' % asked[-1][0]

    tags = [f"t{i:05d}" for i in range(10_003)]
    got = ai.suggested_hierarchy(spark.range(10_003).selectExpr("format_string('t%05d', id) AS tag"), client, least=1)
    assert sum(asked, []) == tags and [x["canonical"] for x in got] == ["t00000", "t10000"]


def test_backlinks_equal_all_documents_against_all_names(files):
    """Words of any length, inside longer ones and over characters beyond the basic plane; empty texts and names of one word give nothing."""
    names = ["graph-theory", "a-b", "of x", "naïve-été", "\U0001f600-ok", "single", "zz-zz", "graph-xyzzy", "the-the"]
    texts = ["Graphs: theoryless\nl\nl", "b\na\nc", "xoF\n\n-", "NAÏVE ÉTÉ\n1\n2", "so \U0001f600ok\n1\n2", "", "one line of x", "zzz\nzz\n-", "été naïve\n1\n2", "theory\nof\nthe graph x"]
    f = files({**{f"p/{i}.md": t for i, t in enumerate(texts)}, **{f"10-Zettelkasten/{n}.md": "" for n in names}})
    n = graph.notes(f)
    found = rows(bridges.backlinks(bridges.project_docs(n), n))
    wanted = [
        (f"p/{i}.md", name) for i, t in enumerate(texts) for name in names
        if t.count("\n") >= 2 and len(name.replace("-", " ").split()) >= 2 and all(w in t.lower() for w in name.replace("-", " ").lower().split())
    ]
    assert found == sorted(wanted) and len(found) > 5


def shuffled(spark) -> int:
    """Bytes that the session's shuffles have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_backlinks_shuffle_what_is_found_alone(spark, files):
    """Every document holds every three figures of the names' numbers, but one number: no text, trigram or candidate leaves a task."""
    figures = " ".join(f"{i:03}" for i in range(1000))
    f = files({**{f"p/{i}.md": f"note\n{figures}\n{10_000 + 7 * i}\n" for i in range(200)}, **{f"10-Zettelkasten/note-{10_000 + i}.md": "" for i in range(1000)}})
    n = graph.notes(f)
    before = shuffled(spark)
    found = rows(bridges.backlinks(bridges.project_docs(n), n))
    assert {(f"p/{i}.md", f"note-{10_000 + 7 * i}") for i in range(143)} <= set(found)
    assert shuffled(spark) - before < 100_000


def test_names_in_blocks_places_and_candidates_in_parts(spark, files, monkeypatch):
    """Words of any number of bytes, over the ends of parts and at those of texts, names in several blocks: as all documents against all names."""
    from quillspark.operators import names as N

    monkeypatch.setattr(bridges, "NAMES", 7)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abé\0") for _ in range(n))
    words = [some(n) for n in (1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9, 12, 20)]
    words += [words[9] + x for x in ("a", "bé", "ab" * 9)]
    names = sorted({"-".join(rng.choice(words) for _ in range(rng.choice((2, 2, 3, 4)))) for _ in range(80)})
    texts = ["\n\n\n", *("\n\n\n" + "".join(rng.choice([*words, "\n", some(3)]) for _ in range(rng.choice((1, 5, 40)))) for _ in range(30))]
    f = files({**{f"p/{i}.md": t for i, t in enumerate(texts)}, **{f"10-Zettelkasten/{x}.md": "" for x in names}})
    n = graph.notes(f)
    wanted = sorted((f"p/{i}.md", x) for i, t in enumerate(texts) for x in names if all(w in t for w in x.split("-")))
    assert rows(bridges.backlinks(bridges.project_docs(n), n)) == wanted and len(wanted) > 50
    monkeypatch.setattr(N, "PLACES", 5)
    monkeypatch.setattr(N, "MANY", 3)
    import pyarrow as pa

    block = N.Names(pa.array(names), pa.array([x.split("-") for x in names]))
    part = pa.RecordBatch.from_pydict({"path": [f"p/{i}.md" for i in range(len(texts))], "text": texts}).slice(1)
    got = [x for b in block.rows([part, part.slice(0, 0)]) for x in zip(b["path"].to_pylist(), b["zettel"].to_pylist())]
    assert sorted(got) == wanted


def test_line_counts(spark):
    from quillspark.functions import text as T

    df = spark.createDataFrame([(x,) for x in ("", "\n", "a", "a\n", "a\nb", "a\r\n\n", "é\n\nz", None)], "c string")
    assert df.filter(~F.size(T.lines(F.col("c"))).eqNullSafe(T.line_count(F.col("c")))).filter("c IS NOT NULL").count() == 0


def laid_down(spark) -> int:
    """Bytes of what was written into the shared folder so far and lies there, and of all shuffles."""
    from quillspark.operators.components import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    return shuffled(spark) + sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet"))


def heavy_vault(files):
    """Much text that no step changes, beside a project; and its bytes."""
    rng = random.Random(3)
    vault = {f"02-Areas/n{i}.md": rng.randbytes(50_000).hex() for i in range(40)}
    return files({**vault, "index.md": "mine", "p/a.md": "await\nx\ny\n", "q/b.md": "await\nx\ny\n"}), sum(map(len, vault.values())) // 2


def test_steps_of_a_sync_do_not_write_the_vault_again(spark, files):
    from quillspark.streaming.inbox import sync

    f, n = heavy_vault(files)
    before = laid_down(spark)
    after, failed = sync(f, VaultConfig(concepts=[Concept("async", ["await"])]), ["hubs", "home", "bridge notes", "auto tags"])
    assert not failed and after.count() == 43 + 2 + 1 + 1
    assert laid_down(spark) - before < 4 * n


def test_rounds_of_changes_do_not_move_the_vault(spark, files):
    from quillspark.streaming import increments

    f, n = heavy_vault(files)
    before = laid_down(spark)
    r = increments.round_of_changes(f, None, VaultConfig(concepts=[Concept("async", ["await"])]))
    assert r.plan.count() == 2 + 1 + 1 + 2 and laid_down(spark) - before < n


def test_backlink_plan_moves_its_documents_once(spark, files):
    """Every document holds every three figures of the names' numbers, but one number."""
    figures = " ".join(f"{i:03}" for i in range(1000))
    docs = {f"p/{i}.md": f"note\n{figures}\n{10_000 + 7 * i}\n" for i in range(200)}
    n = graph.notes(files({**docs, **{f"10-Zettelkasten/note-{10_000 + i}.md": "" for i in range(1000)}}))
    own = bridges.project_docs(n)
    before = shuffled(spark)
    plan = dict(rows(bridges.backlink_plan(own, bridges.backlinks(own, n)).select("path", "new_content")))
    assert set(plan) == set(docs) and "\n- [[10-Zettelkasten/note-10007]]\n" in plan["p/1.md"]
    assert shuffled(spark) - before < sum(map(len, docs.values()))
