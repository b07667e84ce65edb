"""Edit plans: made as DataFrames, looked at, applied to a frame or to disk.

``(path, action, new_path, new_content, reason)``; actions are ``write``,
``rename`` and ``move`` (rename with new content), ``copy``, ``link`` and ``folder``.  Applying a plan twice
changes nothing more.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import discarded, swept, written


def settled(plan: DataFrame) -> DataFrame:
    """``(path, np, nc)``: one edit a file; fails where a plan has two different ones for it, or two files for one new path."""
    one = plan.groupBy("path").agg(F.max("new_content").alias("nc"), F.max("new_path").alias("np"), F.min("new_content").alias("lc"), F.min("new_path").alias("lp"))
    clash = (F.col("nc") != F.col("lc")) | (F.col("np") != F.col("lp"))
    one = one.select("path", "nc", F.when(clash, F.raise_error(F.concat(F.lit("edits that differ for "), "path")).cast("string")).otherwise(F.col("np")).alias("np"))
    ends = one.filter("np IS NOT NULL").groupBy("np").agg(F.count("*").alias("n"))
    out = one.join(ends, "np", "left")
    return out.select("path", "nc", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two files for "), "np")).cast("string")).otherwise(F.col("np")).alias("np"))


def applied(files: DataFrame, plan: DataFrame) -> DataFrame:
    """``files`` as they would be: the next step of a sequence plans on this, no disk involved.

    Fails on edits that contradict each other, and on a new path that a file has which does not itself move away.
    """
    one = written(settled(plan.filter("action IN ('write', 'rename', 'move')")), "edits")  # copies and links leave the files as they are
    taken = files.select(F.col("path").alias("np")).join(one.filter("np IS NOT NULL").select(F.col("path").alias("np")), "np", "left_anti").withColumn("taken", F.lit(True))
    one = one.join(taken, "np", "left").select("path", "nc", F.when(F.col("taken") & (F.col("np") != F.col("path")), F.raise_error(F.concat(F.lit("there is a file "), "np")).cast("string")).otherwise(F.col("np")).alias("np"))
    out = files.join(one, "path", "full")
    cols = {"path": F.coalesce("np", "path"), "content": F.coalesce("nc", "content")}
    return out.select(*(cols.get(c, F.col(c)).alias(c) for c in files.columns))


class Overlay:
    """Files under the edits of the steps so far: a small table over a large one, which no step writes again.

    What asks for some paths moves the texts of these alone: filters on paths go
    through to both tables.
    """

    def __init__(self, files: DataFrame):
        self.base, self.edits = files.select("path", "content"), None

    def files(self, paths: DataFrame | list[str] | None = None) -> DataFrame:
        def some(df):
            return df if paths is None else df.filter(F.col("path").isin(paths)) if isinstance(paths, list) else df.join(paths, "path", "left_semi")

        if self.edits is None:
            return some(self.base)
        return some(self.base).join(self.edits.select("path"), "path", "left_anti").unionByName(some(self.edits))

    def take(self, plan: DataFrame) -> None:
        """Put the new texts of a plan over the files. The plan is run once; what was read from the edits before is no more."""
        new = written(plan.filter("new_content IS NOT NULL").select("path", F.col("new_content").alias("content")), "edits")
        if new.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            once = written(settled(new.select("path", F.col("content").alias("new_content"), F.lit(None).cast("string").alias("new_path"))).select("path", F.col("nc").alias("content")), "edits")
            discarded(new)
            new = once
        if new.limit(1).count():
            self.took(new)
            old, self.edits = self.edits, new
            if old is not None:
                self.edits = written(new.unionByName(old.join(new.select("path"), "path", "left_anti")), "edits")
                discarded(old, new)
        swept(plan.sparkSession)

    def took(self, new: DataFrame) -> None:
        """Called with the edits of a step that has any."""


#: Where a folder keeps the journals of plans that are applied to it; no note is ever read from there.
JOURNALS = ".edits"
JOURNAL = "path string, action string, new_path string, new_content string, staged string, before string, after string, done boolean"


class Conflict(ValueError):
    """A plan that the folder as it is does not allow; nothing was written."""


def plan_digest(plan: DataFrame) -> str:
    """Of the edits, whatever their order."""
    sums = plan.select(F.xxhash64("path", "action", "new_path", "new_content").cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("h")).first()
    return hashlib.sha256(f"{sums.n} {sums.h}".encode()).hexdigest()[:24]


def file_digest(path: str) -> str | None:
    """SHA-256 of a file, in slices; null where there is none."""
    out = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                out.update(part)
    except (FileNotFoundError, NotADirectoryError, IsADirectoryError):
        return None
    return out.hexdigest()


def _inspected(plan: DataFrame, root: str) -> DataFrame:
    """The plan with what its files are and will be, and a ``conflict`` where they do not allow it."""
    schema = f"{JOURNAL}, conflict string"

    def look(batches):
        import pyarrow as pa

        def one(path, action, new_path, content, leaves, expects):
            old, new = os.path.join(root, path), os.path.join(root, new_path or path)
            before, there = file_digest(old), file_digest(new) if new_path else None
            after = hashlib.sha256(content.encode()).hexdigest() if content is not None and action in ("write", "move") else before
            staged, done, why = hashlib.sha256(path.encode()).hexdigest()[:40], False, None
            outside = [p for p in (path, new_path if action not in ("copy",) else None) if p and (os.path.isabs(p) or os.path.normpath(p).split(os.sep)[0] in ("..", JOURNALS))]
            if outside:
                why = f"{outside[0]} is outside the folder"
            elif action == "folder":
                done = os.path.isdir(old)
                why = f"there is a file {path}" if before is not None else None
            elif action in ("copy", "link"):
                done = os.path.lexists(new)
                why = None if done or before or (action == "link" and os.path.isdir(old)) else f"{path} is gone"
            elif new_path in (None, path):
                done = before == after
                if not done and expects is not None and before != expects:
                    why = f"{path} is not what was planned on"
            elif before is None:
                done = there is not None and (content is None or there == after)
                why = None if done else f"{path} is gone"
            elif there is not None and not leaves:
                why = f"there is a file {new_path}"
            elif expects is not None and before != expects:
                why = f"{path} is not what was planned on"
            return path, action, new_path, content, staged, before, after, done, why

        for b in batches:
            rows = [one(*r) for r in zip(*(b[c].to_pylist() for c in ("path", "action", "new_path", "new_content", "leaves", "expects")))]
            kinds = [pa.string()] * 7 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")]) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=[f.split()[0] for f in schema.split(", ")])

    moved = plan.filter("new_path IS NOT NULL AND new_path <> path AND action IN ('rename', 'move')").select(F.col("path").alias("np")).distinct().withColumn("leaves", F.lit(True))
    expects = F.col("expects") if "expects" in plan.columns else F.lit(None).cast("string")
    rows = plan.withColumn("expects", expects).join(moved, F.col("new_path") == F.col("np"), "left")
    return rows.select("path", "action", "new_path", "new_content", F.coalesce("leaves", F.lit(False)).alias("leaves"), "expects").mapInArrow(look, schema)


def _whole(plan: DataFrame) -> DataFrame:
    """Fails where two edits of a plan contradict each other; each edit once."""
    one = plan.groupBy("path", "action", "new_path", "new_content").agg(*([F.max("expects").alias("expects")] if "expects" in plan.columns else [F.count("*").alias("n")]))
    own = one.filter("action IN ('write', 'rename', 'move')")
    twice = own.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("edits that differ for "), "path").alias("why"))
    ends = one.groupBy(F.coalesce("new_path", "path").alias("end")).agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("two files for "), "end").alias("why"))
    why = [r.why for r in twice.union(ends).orderBy("why").limit(20).collect()]
    if why:
        raise Conflict("; ".join(why))
    return one


def _put(source: str, target: str) -> None:
    """``source`` as ``target`` where there is none, in one step; never over another file."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    try:
        os.link(source, target)
    except FileExistsError:
        if file_digest(target) != file_digest(source):
            raise
    os.unlink(source)


def _fill(path: str, content: str) -> None:
    part = f"{path}.{os.getpid()}.{uuid.uuid4().hex[:8]}"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def _staging(root: str, folder: str, path, action, new_path, content, staged, before, after):
    """First phase: new texts are written aside, files that move are taken aside. Nothing that stays is touched."""
    old, aside = os.path.join(root, path), os.path.join(folder, staged)
    if action in ("write", "move") and content is not None and file_digest(aside + ".new") != after and file_digest(os.path.join(root, new_path or path)) != after:
        _fill(aside + ".new", content)
    if action in ("rename", "move") and new_path not in (None, path) and not os.path.exists(aside + ".old") and file_digest(old) == before:
        with contextlib.suppress(FileNotFoundError):  # another attempt at this task was first
            os.rename(old, aside + ".old")


def _placing(root: str, folder: str, path, action, new_path, content, staged, before, after):
    """Second phase: what was put aside goes where it belongs."""
    old, new, aside = os.path.join(root, path), os.path.join(root, new_path or path), os.path.join(folder, staged)
    if action == "folder":
        os.makedirs(old, exist_ok=True)
    elif action in ("copy", "link"):
        os.makedirs(os.path.dirname(new) or ".", exist_ok=True)
        if not os.path.lexists(new):
            if action == "link":
                os.symlink(os.path.relpath(old, os.path.dirname(new)), new)
            else:
                shutil.copyfile(old, f"{aside}.copy")
                _put(f"{aside}.copy", new)
    elif new_path in (None, path):
        if os.path.exists(aside + ".new"):
            if file_digest(new) not in (before, after):
                raise Conflict(f"{path} has changed meanwhile")
            os.makedirs(os.path.dirname(new) or ".", exist_ok=True)
            os.replace(aside + ".new", new)
    else:
        part = aside + (".new" if action == "move" and content is not None else ".old")
        if os.path.exists(part):
            _put(part, new)
        elif file_digest(new) != after:
            raise Conflict(f"{new_path} is not there and nothing is kept for it")
        with contextlib.suppress(FileNotFoundError):
            os.unlink(aside + ".old")


PHASES = (_staging, _placing)


def _run(journal: DataFrame, root: str, folder: str, phase) -> int:
    def work(batches):
        import pyarrow as pa

        for b in batches:
            n = 0
            for path, action, new_path, *rest, before, after in zip(*(b[c].to_pylist() for c in ("path", "action", "new_path", "new_content", "staged", "before", "after"))):
                phase(root, folder, path, action, new_path, *rest, before, after)
                n += 2 if action == "move" and new_path not in (None, path) and after != before else 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return journal.filter("NOT done").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _finish(spark, root: str, folder: str) -> int:
    journal = spark.read.schema(JOURNAL).parquet(f"file://{folder}/journal")
    n = 0
    for phase in PHASES:
        n = _run(journal, root, folder, phase)
    shutil.rmtree(folder)
    return n


def apply_to_disk(plan: DataFrame, root: str) -> int:
    """Write a plan into a folder the executors share. Returns the number of changes; a move with a new text is two.

    Before anything is written, the plan is held against itself (``edits that
    differ``, ``two files for``) and against the folder (a file that is gone, a new
    path that another file has, a path outside the folder, or, where the plan has a
    column ``expects``, a file whose SHA-256 is another); what contradicts it raises
    ``Conflict``.  Then a journal of the edits with the digests of every file before
    and after goes to ``.edits`` in the folder, and two phases run over it: new
    texts and moving files are put aside, then placed, never over a file that the
    journal does not know.  Each edit sees by the digests how far it came, so a lost
    task is simply done again, and a run that was killed goes on where it stopped,
    by the same call or by ``resume``.  A plan that is applied again changes nothing.
    """
    root = os.path.abspath(root)
    spark, folder = plan.sparkSession, os.path.join(root, JOURNALS, plan_digest(plan))
    if not os.path.exists(os.path.join(folder, "journal", "_SUCCESS")):
        found = written(_inspected(_whole(plan), root), "inspected")
        why = [r.conflict for r in found.filter("conflict IS NOT NULL").orderBy("conflict").limit(20).collect()]
        if why:
            raise Conflict("; ".join(why))
        if not found.filter("NOT done").limit(1).count():
            return 0
        os.makedirs(folder, exist_ok=True)
        found.drop("conflict").write.mode("overwrite").parquet(f"file://{folder}/journal")
    return _finish(spark, root, folder)


def resume(spark, root: str) -> int:
    """Finish what applied plans were killed in a folder; a journal that was not whole had written nothing yet and goes. Returns the changes of these plans."""
    root, n = os.path.abspath(root), 0
    top = os.path.join(root, JOURNALS)
    for name in sorted(os.listdir(top)) if os.path.isdir(top) else []:
        folder = os.path.join(top, name)
        if os.path.exists(os.path.join(folder, "journal", "_SUCCESS")):
            n += _finish(spark, root, folder)
        else:
            shutil.rmtree(folder)
    return n


def manifest(relationships: DataFrame, path: str) -> None:
    """The relationships as JSON lines in a folder."""
    relationships.write.mode("overwrite").json(path)


#: Where the manifest note of a vault lies, in the tool's own folder.
MANIFEST = "relationships.json"


def manifest_plan(relationships: DataFrame, folder: str) -> DataFrame:
    """One JSON file of all relationships, in order of source, target and relation: a small report, made of what passed the confidence cut."""
    row = F.struct("source", "target", "relation", F.col("confidence").cast("float").alias("confidence"))
    text = relationships.agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("relationships"))).alias("new_content"))
    return text.select(F.lit(f"{folder}/{MANIFEST}").alias("path"), F.lit("write").alias("action"), F.lit(None).cast("string").alias("new_path"), "new_content", F.lit("manifest").alias("reason"))
