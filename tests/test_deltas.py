"""What is kept up to date equals what is built anew."""

import random

import pytest

from quillspark.config import Concept, VaultConfig
from quillspark.operators import changes as C
from quillspark.operators import deltas as D
from quillspark.operators import graph
from quillspark.streaming import increments as R
from quillspark.streaming.inbox import sync


def frame(spark, d):
    return spark.createDataFrame(list(d.items()), "path string, content string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes(spark):
    a = frame(spark, {"same": "s", "edit": "1", "gone": "g", "old": "moved text", "e1": "", "e2": "", "c1": "copy"})
    b = frame(spark, {"same": "s", "edit": "2", "new": "n", "fresh/old": "moved text", "e3": "", "e4": "", "c1": "copy", "c2": "copy"})
    found = C.changes(C.digests(a), C.digests(b))
    assert rows(found) == sorted([("c2", "added", None), ("e1", "removed", None), ("e2", "removed", None), ("e3", "added", None), ("e4", "added", None), ("edit", "changed", None), ("fresh/old", "renamed", "old"), ("gone", "removed", None), ("new", "added", None)], key=str)
    assert tuple(C.change_counts(found).first()) == (4, 1, 1, 3)
    assert C.changes(C.digests(a), C.digests(a)).count() == 0
    hub = C.changes(C.digests(a.limit(0)), C.digests(frame(spark, {"p/p.md": "1", "10-Zettelkasten/z.md": "2", "x/src/y.md": "3"})))
    assert tuple(C.commit_summary(hub).first()) == ("chore(vault): auto-update MOC, bridge notes, source (3 files)", 3, 0, 0, 0)
    assert C.commit_summary(C.changes(C.digests(a.limit(0)), C.digests(frame(spark, {"n.md": "1"})))).first().message == "chore(vault): auto-update vault content (1 files)"


def mutated(vault, rng, texts):
    out = dict(vault)
    for p in rng.sample(sorted(out), max(1, len(out) // 6)):
        kind = rng.choice(["edit", "drop", "move", "copy"])
        if kind == "edit":
            out[p] += rng.choice(texts)
        elif kind == "drop":
            del out[p]
        else:
            folder, name = rng.choice(["p", "q", "q/sub", "r", "10-Zettelkasten", "02-Areas", "00-A", "99-Archives/projects/p"]), p.rsplit("/", 1)[-1]
            new = f"{folder}/{name if rng.random() < 0.6 else 'n' + str(rng.randrange(30)) + '.md'}"
            if new not in out:
                out[new] = out[p]
                if kind == "move":
                    del out[p]
    return out


TEXTS = ["\nwe await\n", "\nsql here\n", "\ngraph theory and flow\n", "\n[[n1]]\n", "\n[[p/n2|x]] and [[N3.md]]\n", "\nnothing\n", "\n## See Also\n- mine\n", "\ndata flow\nflow\n"]


def start(rng):
    names = ["p/n1.md", "p/n2.md", "p/p.md", "q/n3.md", "q/sub/n4.md", "r/n5.md", "10-Zettelkasten/graph-theory.md", "10-Zettelkasten/data-flow.md", "02-Areas/n6.md", "00-Inbox/n7.md", "q/q.md", "r/deep/n8.md", "s/n9.md"]
    return {n: f"# {n}\n" + "".join(rng.sample(TEXTS, rng.randrange(4))) for n in names}


@pytest.mark.parametrize("seed", range(2))
def test_delta_edges_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    vault = start(rng)
    state = D.built(graph.notes(frame(spark, vault)))
    for _ in range(2):
        new = mutated(vault, rng, TEXTS)
        a, b = frame(spark, vault), frame(spark, new)
        notes = graph.notes(b)
        found = C.changes(C.digests(graph.notes(a)), C.digests(notes))
        d = D.updated(state, notes, found)
        want, was = rows(graph.edges(notes)), rows(state.edges())
        assert rows(d.state.edges()) == want
        assert rows(d.state.links) == rows(graph.resolved(graph.links(notes), notes).select(*D.LINKS))
        assert rows(d.added) == sorted(set(want) - set(was), key=str) and rows(d.removed) == sorted(set(was) - set(want), key=str)
        vault, state = new, d.state


def test_only_links_that_a_change_can_touch_are_resolved_again(spark):
    vault = {f"a/n{i}.md": f"[[n{(i + 1) % 200}]] [[none{i}]]" for i in range(200)}
    state = D.built(graph.notes(frame(spark, vault)))
    new = {**vault, "a/n7.md": "[[n3]]", "b/none9.md": "x", "A/n50.md": "shadow"}  # an edit, a note that a broken link waits for, and a smaller path of a name
    del new["a/n100.md"]
    notes = graph.notes(frame(spark, new))
    d = D.updated(state, notes, C.changes(C.digests(graph.notes(frame(spark, vault))), C.digests(notes)))
    assert sorted((r.src, r.raw_target, r.dst) for r in d.resolved.collect()) == [("a/n49.md", "n50", "A/n50.md"), ("a/n7.md", "n3", "a/n3.md"), ("a/n9.md", "none9", "b/none9.md"), ("a/n99.md", "n100", None)]
    assert rows(d.state.edges()) == rows(graph.edges(notes))
    assert rows(d.added) == [("a/n49.md", "A/n50.md"), ("a/n7.md", "a/n3.md"), ("a/n9.md", "b/none9.md")]
    assert rows(d.removed) == [("a/n100.md", "a/n101.md"), ("a/n49.md", "a/n50.md"), ("a/n7.md", "a/n8.md"), ("a/n99.md", "a/n100.md")]


CONFIG = VaultConfig(concepts=[Concept("async", ["await", "async"], ["concurrency", "evergreen"]), Concept("db", ["sql"], ["data"]), Concept("never", ["zzz"])])


def full(spark, vault):
    after, failed = sync(frame(spark, vault), CONFIG)
    assert not failed
    return {r.path: r.content for r in after.collect()}


def apply(vault, plan):
    return {**vault, **{r.path: r.new_content for r in plan.collect()}}


@pytest.mark.parametrize("seed", [0])
def test_rounds_of_changes_equal_full_rounds(spark, seed, tmp_path):
    rng = random.Random(seed)
    vault = start(rng)
    r = R.round_of_changes(frame(spark, vault), None, CONFIG)
    want = full(spark, vault)
    vault = apply(vault, r.plan)
    assert vault == want
    for n in range(2):
        vault = mutated(vault, rng, TEXTS)
        if n == 1:
            r.memory.saved(f"file://{tmp_path}/memory")
            r.memory = R.Memory.loaded(spark, f"file://{tmp_path}/memory")
        r = R.round_of_changes(frame(spark, vault), r.memory, CONFIG)
        want = full(spark, vault)
        got = apply(vault, r.plan)
        assert got == want, {p: (got.get(p), want.get(p)) for p in {*got, *want} if got.get(p) != want.get(p)}
        vault = got


def test_planned_outputs_grow_with_the_change(spark):
    vault = {f"p{i}/n{j}.md": f"# {i} {j}\nawait\nx\n" if j == 0 else f"# {i} {j}\ntext\nx\n" for i in range(6) for j in range(3)} | {"index.md": "mine", "10-Zettelkasten/some-name.md": ""}
    r = R.round_of_changes(frame(spark, vault), None, CONFIG)
    vault = apply(vault, r.plan)
    for _ in range(3):  # what rounds wrote is seen once by each step
        r = R.round_of_changes(frame(spark, vault), r.memory, CONFIG)
        vault = apply(vault, r.plan)
    assert r.plan.count() == 0 and r.planned == {"hubs": 0, "home": 0, "index": 0, "bridge notes": 0, "backlinks": 0, "related": 0, "auto tags": 0}
    vault = vault | {"p3/n1.md": vault["p3/n1.md"].replace("text", "more text"), "p5/new.md": "# N\nx\ny\n"}
    r = R.round_of_changes(frame(spark, vault), r.memory, CONFIG)
    assert r.planned == {"hubs": 1, "home": 1, "index": 0, "bridge notes": 0, "backlinks": 2, "related": 1, "auto tags": 2}
    assert {x.path for x in r.plan.collect()} == {"p5/p5.md", "p5/new.md"}
