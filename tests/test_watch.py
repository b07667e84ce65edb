"""A real folder watched: each edit is planned once, nothing lands rows by hand."""

import os
import time

import pytest

from quillspark.config import VaultConfig
from quillspark.sources import folder as S
from quillspark.streaming import inbox as I

AS_OF = "2024-01-31"


def put(root, path, text):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


@pytest.fixture
def seen(spark, tmp_path):
    """Runs the watcher over all there is and gives what it planned."""

    def run(root=tmp_path / "vault", apply=None):
        got = []
        time.sleep(0.15)  # files settle
        keep = lambda plan: got.extend(sorted((r.path, r.action, r.new_content) for r in plan.collect()))
        I.watch_folder(spark, str(root), AS_OF, str(tmp_path / "ck"), apply or keep).awaitTermination()
        return got

    return run


def test_edits_are_planned_once_also_after_a_restart(seen, tmp_path):
    root = tmp_path / "vault"
    put(root, "00-Inbox/a.md", "first")
    put(root, "00-Inbox/deep/no.md", "too deep")
    put(root, "00-Inbox/x.txt", "no note")
    put(root, "temp_conversions/b/c.md", "converted")
    put(root, "02-Areas/o.md", "elsewhere")
    assert [r[0] for r in seen()] == ["00-Inbox/a.md", "temp_conversions/b/c.md"]
    assert seen() == []
    put(root, "00-Inbox/a.md", "second")
    put(root, "00-Inbox/n.md", "new")
    got = seen()
    assert [r[0] for r in got] == ["00-Inbox/a.md", "00-Inbox/n.md"] and got[0][2].endswith("second")
    os.utime(root / "00-Inbox/a.md")
    assert seen() == [], "the same text again"
    assert seen() == []


def test_files_moved_in_and_files_gone(seen, tmp_path):
    root = tmp_path / "vault"
    put(root, "00-Inbox/a.md", "a")
    assert len(seen()) == 1
    put(root, "elsewhere/old.md", "old")
    os.utime(root / "elsewhere/old.md", (1, 1))
    os.rename(root / "elsewhere/old.md", root / "00-Inbox/old.md")
    assert [r[0] for r in seen()] == ["00-Inbox/old.md"], "its time of writing is long past"
    put(root, "00-Inbox/z.md", "z")
    assert len(seen()) == 1
    os.remove(root / "00-Inbox/z.md")  # the last one goes: the offset steps back, nothing comes twice
    assert seen() == []
    put(root, "00-Inbox/z2.md", "z2")
    (root / "00-Inbox/bad.md").write_bytes(b"\xff\xfe")
    assert [r[0] for r in seen()] == ["00-Inbox/z2.md"]


def test_gone_between_listing_and_reading(tmp_path):
    put(tmp_path, "00-Inbox/a.md", "a")
    put(tmp_path, "00-Inbox/b.md", "b")
    time.sleep(0.15)
    r = S.InboxReader({"path": str(tmp_path)})
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    os.remove(tmp_path / "00-Inbox/a.md")
    assert [x[0] for p in parts for x in r.read(p)] == ["00-Inbox/b.md"]
    high = r.latestOffset()
    os.remove(tmp_path / "00-Inbox/b.md")
    assert r.latestOffset() == high and r.partitions(high, high) == []


def test_what_just_changed_waits(tmp_path):
    put(tmp_path, "00-Inbox/a.md", "a")
    r = S.InboxReader({"path": str(tmp_path), "settle_ms": "60000"})
    assert r.latestOffset() == r.initialOffset()


def test_partitions_hold_bounded_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 20_000)
    for i in range(12):
        put(tmp_path, f"00-Inbox/{i:02d}.md", "x" * 5000)
    time.sleep(0.15)
    r = S.InboxReader({"path": str(tmp_path)})
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    assert len(parts) == 6 and sorted(x[0] for p in parts for x in r.read(p)) == [f"00-Inbox/{i:02d}.md" for i in range(12)]


def test_confirmed_notes_move_on_disk(seen, spark, tmp_path):
    """The whole way: a new note goes under review, is confirmed, moves; its own writes are not planned again."""
    from quillspark.operators import edits

    root = tmp_path / "vault"
    put(root, "00-Inbox/a.md", "text")
    apply = lambda plan: edits.apply_to_disk(plan, str(root))
    seen(apply=apply)
    assert "status: needs_review" in (root / "00-Inbox/a.md").read_text()
    assert seen() == []
    put(root, "00-Inbox/a.md", (root / "00-Inbox/a.md").read_text().replace("needs_review", "confirmed"))
    seen(apply=apply)
    moved = root / "03-Resources/Reference/Articles-Papers/a.md"
    assert "status: processed" in moved.read_text() and not (root / "00-Inbox/a.md").exists()
    assert seen() == []


def test_planned_is_brought_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT", 3)
    kept = I.Planned(spark, str(tmp_path / "p"))
    for n in range(11):
        rows = spark.createDataFrame([(f"p{n % 4}", n, f"d{n}")], "path string, version long, digest string").selectExpr("path", "timestamp_seconds(version) AS modified_on", "version", "digest")
        kept.keep(rows, n)
        assert {r.path: r.version for r in kept.before(n + 1).collect()} == {f"p{i % 4}": i for i in range(n + 1)}
        assert {r.path: r.version for r in kept.before(n).collect()} == {f"p{i % 4}": i for i in range(n)}
    assert len(kept.batches("upto")) <= 2 and len(kept.batches("batch")) <= 7


def test_a_service_syncs_each_vault_beside_a_watcher(spark, tmp_path):
    for name in ("one", "two", "off"):
        put(tmp_path, f"{name}/p/a.md", f"text of {name}\nl\nl\n")
        put(tmp_path, f"{name}/00-Inbox/n.md", "fresh")
    time.sleep(0.15)
    vaults = [{"name": n, "path": str(tmp_path / n), "watch": n == "one", "enabled": n != "off"} for n in ("one", "two", "off")]
    s = I.serve(spark, vaults, str(tmp_path / "cks"), lambda: AS_OF, lambda v: VaultConfig(name=v["name"]), times=1, every="1 second")
    for t in s.loops.values():
        t.join()
    s.queries["one"].processAllAvailable()
    s.stop()
    assert s.failed == {"one": [[]], "two": [[]]} and set(s.queries) == {"one"}
    for name in ("one", "two"):
        assert (tmp_path / name / "p/p.md").exists() and "## See Also" in (tmp_path / name / "p/a.md").read_text()
    assert not (tmp_path / "off/p/p.md").exists()
    assert "needs_review" in (tmp_path / "one/00-Inbox/n.md").read_text() and (tmp_path / "two/00-Inbox/n.md").read_text() == "fresh"
