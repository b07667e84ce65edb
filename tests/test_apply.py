"""Plans on disk: nothing is overwritten, and what was killed goes on."""

import pytest

from quillspark.operators import edits
from quillspark.sources import vault as V


@pytest.fixture
def plan(spark):
    return lambda *rows: spark.createDataFrame(rows, "path string, action string, new_path string, new_content string")


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and edits.JOURNALS not in p.parts}


def put(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


@pytest.mark.parametrize("rows,why", [
    ([("a/n.md", "move", "b/n.md", "new")], "there is a file b/n.md"),
    ([("a/n.md", "rename", "b/n.md", None)], "there is a file b/n.md"),
    ([("a/n.md", "write", None, "x"), ("a/n.md", "write", None, "y")], "edits that differ for a/n.md"),
    ([("a/n.md", "rename", "c.md", None), ("b/n.md", "rename", "c.md", None)], "two files for c.md"),
    ([("a/n.md", "rename", "c.md", None), ("c.md", "write", None, "x")], "two files for c.md"),
    ([("none.md", "rename", "c.md", None)], "none.md is gone"),
    ([("../x.md", "write", None, "x")], "outside the folder"),
    ([("a/n.md", "rename", "../x.md", None)], "outside the folder"),
    ([("a/n.md", "rename", "c.md", None), ("b/n.md", "move", "other.md", "z")], "there is a file other.md"),
])
def test_conflicts_are_found_before_anything_is_written(plan, tmp_path, rows, why):
    put(tmp_path, {"a/n.md": "one", "b/n.md": "two", "other.md": "three"})
    before = tree(tmp_path)
    with pytest.raises(edits.Conflict, match=why):
        edits.apply_to_disk(plan(*rows), str(tmp_path))
    assert tree(tmp_path) == before


def test_chains_swaps_and_all_actions(plan, tmp_path):
    put(tmp_path, {"a.md": "A", "b.md": "B", "c.md": "C", "w.md": "W", "s.md": "S", "t.md": "T"})
    p = plan(("a.md", "rename", "b.md", None), ("b.md", "move", "deep/c.md", "B2"), ("s.md", "rename", "t.md", None), ("t.md", "rename", "s.md", None), ("w.md", "write", None, "W2"), ("new/x.md", "write", None, "X"), ("c.md", "copy", "out/c.md", None), ("c.md", "link", "in/c.md", None))
    assert edits.apply_to_disk(p, str(tmp_path)) == 9
    want = {"b.md": "A", "deep/c.md": "B2", "t.md": "S", "s.md": "T", "w.md": "W2", "new/x.md": "X", "c.md": "C", "out/c.md": "C", "in/c.md": "C"}
    assert tree(tmp_path) == want and (tmp_path / "in/c.md").is_symlink()
    again = plan(("w.md", "write", None, "W2"), ("c.md", "copy", "out/c.md", None), ("gone.md", "move", "deep/c.md", "B2"))
    assert edits.apply_to_disk(again, str(tmp_path)) == 0 and tree(tmp_path) == want


def test_a_plan_is_tied_to_the_files_it_was_made_on(spark, tmp_path):
    import hashlib

    put(tmp_path, {"a.md": "edited since"})
    row = ("a.md", "write", None, "new", hashlib.sha256(b"as it was").hexdigest())
    p = spark.createDataFrame([row], "path string, action string, new_path string, new_content string, expects string")
    with pytest.raises(edits.Conflict, match="a.md is not what was planned on"):
        edits.apply_to_disk(p, str(tmp_path))
    (tmp_path / "a.md").write_text("as it was")
    assert edits.apply_to_disk(p, str(tmp_path)) == 1 and edits.apply_to_disk(p, str(tmp_path)) == 0


@pytest.mark.parametrize("stop", ["journal", "staged", "half placed"])
@pytest.mark.parametrize("way", ["same call", "resume"])
def test_a_killed_run_goes_on(spark, plan, tmp_path, monkeypatch, stop, way):
    put(tmp_path, {"a.md": "A", "b.md": "B", "w.md": "W", "v.md": "V"})
    p = plan(("a.md", "rename", "b.md", None), ("b.md", "move", "c.md", "B2"), ("w.md", "write", None, "W2"), ("v.md", "move", "d/v.md", "V2"))

    def killed(root, folder, path, *rest):
        if stop == "half placed" and path in ("a.md", "w.md"):
            return edits._placing(root, folder, path, *rest)
        raise RuntimeError("killed")

    monkeypatch.setattr(edits, "PHASES", {"journal": (killed,)}.get(stop, (edits._staging, killed)))
    with pytest.raises(Exception, match="killed"):
        edits.apply_to_disk(p, str(tmp_path))
    monkeypatch.undo()
    assert V.listed(str(tmp_path), [], ["md"])[0] == sorted(tree(tmp_path))
    edits.resume(spark, str(tmp_path)) if way == "resume" else edits.apply_to_disk(p, str(tmp_path))
    assert tree(tmp_path) == {"b.md": "A", "c.md": "B2", "w.md": "W2", "d/v.md": "V2"}
    assert edits.resume(spark, str(tmp_path)) == 0


def test_a_file_written_by_another_meanwhile_is_kept(spark, plan, tmp_path, monkeypatch):
    put(tmp_path, {"a.md": "A", "w.md": "W"})
    p = plan(("a.md", "rename", "b.md", None), ("w.md", "write", None, "W2"))

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(edits, "PHASES", (edits._staging, killed))
    with pytest.raises(Exception, match="killed"):
        edits.apply_to_disk(p, str(tmp_path))
    monkeypatch.undo()
    put(tmp_path, {"b.md": "another's", "w.md": "another's"})
    with pytest.raises(Exception, match="changed meanwhile|FileExists"):
        edits.resume(spark, str(tmp_path))
    assert (tmp_path / "b.md").read_text() == (tmp_path / "w.md").read_text() == "another's"
