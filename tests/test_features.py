"""Walks, rules, totals, roll-ups and answers: each against a plain version."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.config import Concept, VaultConfig
from quillspark.functions import text as T
from quillspark.operators import ai, audit, bridges, edits, graph, hubs, links
from quillspark.sources import vault as V
from quillspark.sources import walk as K


def frame(spark, d):
    return spark.createDataFrame(list(d.items()), "path string, content string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_walk_by_tasks_equals_one_by_the_driver(spark, tmp_path):
    for p in ("a.md", "_b.md", ".dot/c.md", ".git/x.md", "repo/.git/y", "repo/d.md", "repo/in/.git", "wt/.git", "wt/e.md", "with space/é.md", "t.txt", "x.bin", "skip/z.md", "deep/1/2/3/4/5/f.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}")
    (tmp_path / "bad.md").write_bytes(b"\xff")
    os.symlink(tmp_path, tmp_path / "loop")
    want, nested = V.listed(str(tmp_path), [".git", "skip"], ["md", "txt", "pdf"])
    for most in (2, 1000):  # tasks that hand nearly all back, and that go down to the end
        got = K.walked(spark, str(tmp_path), [".git", "skip"], most=most)
        assert rows(got.filter("kind = 'file'").select("path")) == sorted([(p,) for p in want], key=str)
        assert rows(got.filter("kind = 'nested'").select("path")) == [(p,) for p in sorted(nested)]
    files = K.read_folder(spark, str(tmp_path), [".git", "skip"])
    assert rows(files.select("path", "content")) == sorted([(p, f"text of {p}") for p in want if p != "bad.md"], key=str)
    assert rows(files.select("path", "ext", "size_bytes", "modified_at", "modified_on", "content")) == rows(V.read_vault(spark, str(tmp_path), [".git", "skip"]))
    (tmp_path / "none").mkdir()
    assert K.read_folder(spark, str(tmp_path / "none")).count() == 0


def test_many_files_are_dealt_out_by_bytes(spark, tmp_path):
    """100,000 names; sizes differ a hundredfold, partitions stay within twice each other."""
    sizes = {}
    for d in range(100):
        (tmp_path / f"d{d}").mkdir()
        for i in range(1000):
            n = 10 + 990 * (i % 97 == 0)
            fd = os.open(f"{tmp_path}/d{d}/{i}.md", os.O_CREAT | os.O_WRONLY)
            os.write(fd, b"x" * n)
            os.close(fd)
            sizes[f"d{d}/{i}.md"] = n
    listing = K.walked(spark, str(tmp_path))
    assert listing.count() == 100_000
    packed = K.packed(listing, 32 << 20).groupBy("bin").agg(F.sum(F.col("size_bytes") + K.OPEN_BYTES).alias("w"), F.sum("size_bytes").alias("n")).collect()
    assert sum(r.n for r in packed) == sum(sizes.values())
    full = [r.w for r in sorted(packed, key=lambda r: r.bin)[:-1]]
    assert len(full) > 10 and max(full) <= 2 * min(full)


def test_nested_repositories_by_ancestors(spark):
    f = frame(spark, {"a.md": "", ".git/config": "", "r/.git/HEAD": "", "r/b.md": "", "r/x/y/c.md": "", "r2/d.md": "", "r.md": "", "w/.git": "gitdir", "w/e.md": "", "p/in/.git": "", "p/in/f.md": "", "p/g.md": "", "p/.github/h.md": ""})
    repos = graph.nested_repos(f)
    assert rows(repos) == [("p/in",), ("r",), ("w",)]
    n = graph.notes(f, [], repos)
    assert rows(n.select("path")) == [("a.md",), ("p/.github/h.md",), ("p/g.md",), ("r.md",), ("r2/d.md",)]
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_rules_by_automata(spark):
    import random

    rng = random.Random(3)
    letters = "abcé "
    concepts = [Concept(f"c{i % 900}", ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 7))) for _ in range(5)]) for i in range(1000)] + [Concept("upper", ["ABC"]), Concept("all", [""])]
    texts = {f"p/{i}.md": "".join(rng.choice("abcéD \n") for _ in range(rng.randrange(0, 400))) for i in range(40)}
    docs = frame(spark, texts).withColumn("project", F.lit("p"))
    want = sorted(("p", c.name, p) for p, t in texts.items() for c in {c.name: c for c in concepts if any(k in t.lower() for k in c.keywords)}.values())
    names = {}
    for c in concepts:
        names.setdefault(c.name, []).extend(c.keywords)
    want = sorted(("p", n, p) for p, t in texts.items() for n, ks in names.items() if any(k in t.lower() for k in ks))
    assert sum(len(c.keywords) for c in concepts) > 5000
    assert rows(bridges.concept_hits(docs, concepts)) == want
    assert rows(bridges.concept_hits(docs, concepts, most=700)) == want, "in blocks"
    few = concepts[:10]
    assert rows(bridges.concept_hits(docs, few)) == rows(bridges.concept_hits(docs, few, few=0))
    found = bridges.bridges(spark.createDataFrame([("p", "x", "1"), ("q", "x", "2"), ("p", "y", "3")], "project string, concept string, path string"), [Concept("x", [], ["t"]), Concept("x", [], ["u"])])
    assert rows(found) == [("x", ["t"], ["p", "q"], 2)]


def test_heavy_middles(spark):
    """A note with very many links in and out: pairs dealt to keys, or told by who is on which side."""
    light = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    heavy = [(f"i{k}", "hub") for k in range(60)] + [("hub", f"o{k}") for k in range(50)] + [("i0", "o0"), ("o1", "i1"), ("i2", "i2"), ("hub", "i3")]
    e = spark.createDataFrame(light + heavy, "src string, dst string")
    want = {}
    out = {}
    for s, d in light + heavy:
        if s != d:
            out.setdefault(s, set()).add(d)
    for s, ds in out.items():
        for d in ds:
            for t in {d} | (out.get(d, set()) - {s}):
                k = (min(s, t), max(s, t))
                want[k] = min(want.get(k, s), s)
    want = sorted((s, b if s == a else a) for (a, b), s in want.items())
    assert rows(graph.two_hop_pairs(e)) == want == rows(graph.two_hop_pairs(e, heavy=100))
    pairs, sides = graph.two_hop_classes(e, most=100)
    got = {tuple(sorted(p)) for p in rows(pairs)}
    side = {}
    for m, p, s in rows(sides):
        side.setdefault((m, s), set()).add(p)
    assert pairs.count() + sides.count() < 3 * e.count()
    told = got | {tuple(sorted((x, y))) for (m, s), xs in side.items() if s == "in" for x in xs for y in side.get((m, "out"), ()) if x != y}
    assert told == {tuple(sorted(p)) for p in want}
    big = spark.range(100_000).selectExpr("concat('i', id) AS src", "'hub' AS dst").union(spark.range(100_000).selectExpr("'hub'", "concat('o', id)"))
    pairs, sides = graph.two_hop_classes(big)
    assert (pairs.count(), sides.count()) == (200_000, 200_000)


def test_check_totals(spark):
    base = "99-Archives/projects/p/"
    f = frame(spark, {base + "PRD.md": "no fm\n", base + "DEBT.md": "---\ntags: [layer/raw, type/debt, p]\n---\nb\n", base + "other.md": "", "a.md": "---project: foo\nx\n---\n", "b.md": "---\ntags: []\n---\n[[none]] [[a]] [[Some Note]]", "Some Note.txt": ""})
    n = graph.notes(f)
    assert tuple(audit.tag_totals(n).first()) == ("tags", 2, 3, 3)
    assert tuple(audit.frontmatter_totals(n).first()) == ("frontmatter", 5, 3, 2)
    assert tuple(links.link_totals(links.check_links(f, n)).first()) == ("links", 3, 2, 1)
    assert tuple(audit.tag_totals(n.limit(0)).first()) == ("tags", 0, 0, 0)
    seen, plan, scanned, fixed = audit.watched_totals(None or audit.frontmatter_fix_plan(n), n, "frontmatter")
    plan.collect(), seen.collect()
    assert scanned.get == {"scanned": 5} and fixed.get == {"fixed": 2}
    mine = frame(spark, {"x.md": "[[gone]]", "tool/gone.txt": ""})
    assert links.check_links(mine, graph.notes(mine)).first().issue == "unresolved"


def test_tool_folders_are_left_out_of_text_stems(spark):
    f = frame(spark, {"x.md": "[[tool/gone]]", "tool/gone.txt": ""})
    c = VaultConfig(tool_dirs=["tool"])
    n = graph.notes(f, c.graph_excluded())
    assert links.check_links(f, n).first().issue == "extension_mismatch"
    assert links.check_links(f, n, c.graph_excluded()).first().issue == "unresolved"


def test_status_rollup(spark):
    f = frame(spark, {"a/x.md": "---\nstatus: confirmed\n---\n", "a/b/y.md": "---\nstatus: \"needs_review\"\n---\n", "a/b/z.txt": "abc", "top.md": "status: no", "a/noext": ""})
    got = {(r.folder, r.ext, r.state): (r.level, r.files, r.notes, r.bytes) for r in hubs.status_rollup(f).collect()}
    assert got["", None, None] == (0, 5, 3, sum(len(c) for _, c in f.collect()))
    assert got["a", None, None][:3] == (1, 4, 2) and got["a/b", None, None][:3] == (2, 2, 1) and got["a/b", "txt", None] == (2, 1, 0, 3)
    assert got["a", None, "confirmed"][1] == 1 and got["a", None, "needs_review"][1] == 1 and got["a", None, "none"][1] == 2 and got["a", "", None][1] == 1


def test_summaries_as_yaml_has_them(spark):
    long = "é" * 150
    f = frame(spark, {
        "block": "---\nsummary: |\n  two\n  lines\n---\npara", "folded": "---\nsummary: >-\n  one\n  line\n---\npara", "number": "---\nsummary: 12\n---\npara", "truth": "---\nsummary: true\n---\npara",
        "yes": "---\nsummary: yes\n---\npara", "quoted": "---\nsummary: \"About: it\"\n---\npara", "plain": "---\nsummary: Plain words\n---\npara", "invalid": "---\nsummary: a\nbad: [\n---\npara",
        "twice": "---\nsummary: a\nsummary: b\n---\npara", "none": "---\ntags: [x]\n---\n# H\n\n  para  \n", "date": "---\nsummary: 2024-01-01\n---\npara", "null": "---\nsummary: ~\n---\npara", "list": "---\nsummary: [a]\n---\npara",
        "empty": "---\nsummary: ''\n---\npara", "nofm": "para", "blank": "", "long": f"---\nx: 1\n---\n{long}", "deep": "---\nmeta:\n  summary: inner\n---\npara",
    })
    c = F.col("content")
    got = dict(rows(f.select("path", T.summary(T.frontmatter(c), T.body(c)))))
    want = {k: "para" for k in ("number", "truth", "invalid", "twice", "none", "null", "list", "nofm", "deep")} | {
        "block": "two\nlines", "folded": "one line", "yes": "yes", "quoted": "About: it", "plain": "Plain words", "date": "2024-01-01", "empty": "", "blank": None, "long": "é" * 100 + "...",
    }
    # The strict fence ends a block's text before its last line feed.
    assert got == want


def test_answers_are_kept(spark, tmp_path):
    calls = f"{tmp_path}/calls"
    os.makedirs(calls)

    def client(p):
        if p == "bad":
            raise OSError("no answer")
        with open(f"{calls}/{abs(hash(p))}-{os.getpid()}-{os.urandom(4).hex()}", "w"):
            pass
        return f'{{"x": "{p}"}}'

    asked = lambda: len(os.listdir(calls))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "id int, prompt string")
    store = ai.AnswerStore(spark, f"file://{tmp_path}/store", "client-1")
    got = {r.id: r.answer for r in ai.answers(df, "prompt", client, store=store).collect()}
    assert got == {1: '{"x": "a"}', 2: '{"x": "b"}', 3: '{"x": "a"}', 4: None, 5: None}
    assert asked() == 2 and (store.asked, store.failed) == (3, 1)
    more = df.union(spark.createDataFrame([(6, "c")], df.schema))
    got = {r.id: r.answer for r in ai.answers(more, "prompt", client, store=store).collect()}
    assert got[6] == '{"x": "c"}' and asked() == 3 and (store.asked, store.failed) == (2, 1)
    ai.answers(more.filter("prompt <> 'bad'"), "prompt", client, store=store).collect()
    assert asked() == 3 and store.asked == 0
    other = ai.AnswerStore(spark, f"file://{tmp_path}/store", "client-2")
    ai.answers(df.limit(1), "prompt", client, store=other).collect()
    assert asked() == 4
    assert df.columns + ["answer"] == ai.answers(df, "prompt", client).columns


def test_new_books_on_disk(spark, tmp_path):
    (tmp_path / "03-Resources").mkdir()
    (tmp_path / "03-Resources/r.md").write_text("r")
    files = lambda: V.read_vault(spark, str(tmp_path)).select("path", "content")
    plan = hubs.book_init_plan(files(), "b", "essay").unionByName(hubs.book_folder_plan(files(), "b"))
    assert edits.apply_to_disk(plan, str(tmp_path)) == 6
    root = tmp_path / "01-Projects/b"
    assert all((root / d).is_dir() for d in ("drafts", "edits", "publish/cover")) and (root / "sources").is_symlink() and (root / "sources/r.md").read_text() == "r"
    assert (root / "PRD.md").read_text().startswith("---\ntitle: b\ngenre: essay\n") and edits.apply_to_disk(plan, str(tmp_path)) == 0
    held = frame(spark, {"01-Projects/b/sources/n.md": "", "01-Projects/b/drafts/1.md": ""})
    assert rows(hubs.book_folder_plan(held, "b").select("path")) == [("01-Projects/b/edits",), ("01-Projects/b/publish/cover",)]


def test_manifest_note(spark):
    rel = spark.createDataFrame([("b", "c", "extends", 0.5), ("a", "c", "references", 0.75)], "source string, target string, relation string, confidence double")
    r = edits.manifest_plan(rel, ".tool").first()
    assert (r.path, r.new_content) == (".tool/relationships.json", '{"relationships":[{"source":"a","target":"c","relation":"references","confidence":0.75},{"source":"b","target":"c","relation":"extends","confidence":0.5}]}')


@pytest.mark.parametrize("size", [1, 3])
def test_grams_in_slices(spark, monkeypatch, size):
    monkeypatch.setattr(bridges, "SLICE", size)
    df = frame(spark, {"a": "abcdefgh\U0001f600é\nabc", "b": "", "c": "xy"})
    by = df.select("path", F.explode(bridges.slices(F.col("content"))).alias("s")).select("path", F.explode(bridges.grams(F.col("s"))).alias("g")).distinct()
    assert rows(by) == rows(df.select("path", F.explode(bridges.grams(F.col("content"))).alias("g")).distinct())


def test_settings_of_all_vaults(tmp_path):
    """Whole sections where a vault's own is as built in, single values where it sets none."""
    shared = tmp_path / "shared.toml"
    shared.write_text('[projects]\nexclude = ["x"]\n[graph]\nauto_tags = false\n[[graph.concepts]]\nname = "c"\nkeywords = ["k"]\n[sync]\ninterval_minutes = 9\n[daemon]\ninterval_seconds = 77\n[ai]\nprovider = "openai"\nmodel = "m"\nmax_concurrent = 3\n')
    (tmp_path / "a").mkdir()
    c = VaultConfig.load(str(tmp_path / "a"), shared=str(shared))
    assert (c.exclude, c.auto_tags, [x.name for x in c.concepts], c.interval_seconds()) == (["x"], False, ["c"], 77)
    assert c.steps() == ["hubs", "home", "index", "bridge notes", "backlinks", "related"] and (c.model.provider, c.model.max_concurrent) == ("openai", 3)
    (tmp_path / "a/vault.toml").write_text('[vault]\nname = "v"\nprotected_files = []\n[projects]\nexclude = ["y"]\n[graph]\nbacklinks = false\n[daemon]\ninterval_seconds = 5\n[ai]\nmodel = "mine"\n')
    c = VaultConfig.load(str(tmp_path / "a"), {"inbox_dir": "In"}, str(shared))
    assert (c.name, c.exclude, c.concepts, c.auto_tags, c.backlinks, c.interval_seconds(), c.sync_minutes, c.inbox_dir, c.protected_files) == ("v", ["y"], [], True, False, 5, 9, "In", [])
    assert (c.model.provider, c.model.model) == ("openai", "mine")
    assert VaultConfig.load(str(tmp_path / "none"), shared=str(tmp_path / "no")) == VaultConfig()


def test_steps_that_are_switched_off(spark):
    from quillspark.streaming import increments, inbox

    files = frame(spark, {"p/a.md": "await\nx\ny\n", "q/b.md": "await\nx\ny\n", "index.md": "mine"})
    c = VaultConfig(concepts=[Concept("async", ["await"])], backlinks=False, auto_tags=False, related_projects=False)
    after, failed = inbox.sync(files, c)
    text = dict(rows(after.select("path", "content")))
    assert not failed and "10-Zettelkasten/async.md" in text and text["p/a.md"] == "await\nx\ny\n"
    r = increments.round_of_changes(files, None, c)
    assert dict(rows(r.plan.select("path", "new_content"))) == {p: t for p, t in text.items() if p not in ("p/a.md", "q/b.md", "index.md")}
    assert r.planned["backlinks"] == r.planned["auto tags"] == 0 and "backlinks" not in r.memory.seen


def test_registry_prompts_and_lists(spark, tmp_path):
    from quillspark.config import load_prompts, resolve_vault

    vaults = [{"name": "a", "path": "/a", "watch": True}, {"name": "b", "path": "/b", "enabled": False, "watch": True}, {"name": "c", "path": "/c"}]
    assert rows(V.registered(spark, vaults).select("name")) == [("a",), ("c",)] and rows(V.registered(spark, vaults, watched=True).select("name")) == [("a",)]
    (tmp_path / "p.yaml").write_text("summary_template: mine {content}\nother: 3\n")
    p = load_prompts([str(tmp_path / "none.yaml"), str(tmp_path / "p.yaml")])
    assert p["summary_template"] == "mine {content}" and "{content}" in p["category_template"] and "other" not in p
    assert resolve_vault("/flag") == "/flag" and resolve_vault(cwd=str(tmp_path), env="NO_SUCH", registered=["/one"]) == "/one"
    assert resolve_vault(cwd=str(tmp_path), env="NO_SUCH", registered=["/one", "/two"]) is None
    c = VaultConfig(system_dirs=["10-Zettelkasten", "mine"])
    assert c.all_system_dirs().count("10-Zettelkasten") == 1 and c.all_system_dirs()[-1] == "mine"
