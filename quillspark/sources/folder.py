"""A folder as a stream: notes as they are put in or edited, without anything landing them first.

``vault_inbox`` lists the inbox and the conversions folder at each trigger.  A
file's place in the stream is ``(stamp, path)``, its stamp the later of its times
of writing and of change of its entry, in nanoseconds: a file that is moved in
with an old time of writing still comes after what was read before.  The offset is
the place of the last file; a batch reads what lies between two offsets.  Files
that changed less than ``settle_ms`` ago wait, so that one offset never passes a
file that is stamped in the same tick later.  What is gone when it is read, or no
text, is passed over.  A note that is edited once more while it waits is read as
it is then, and comes again with its new stamp.
"""

from __future__ import annotations

import os
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, content string, modified_on timestamp, version long"
#: Bytes that a task reads, about.
PART_BYTES = 32 << 20


def found(root: str, inbox: str, converted: str, extensions: tuple[str, ...]) -> list[tuple[int, str, int]]:
    """``(stamp, path, size)`` of what can come: files right in the inbox, and Markdown anywhere under the conversions folder."""
    out = []

    def look(folder: str, deep: bool, kinds: tuple[str, ...]) -> None:
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except (FileNotFoundError, NotADirectoryError):
            return
        for e in entries:
            path = f"{folder}/{e.name}"
            try:
                if e.is_dir():
                    if deep:
                        look(path, deep, kinds)
                elif e.name.endswith(kinds):
                    s = e.stat()
                    out.append((max(s.st_mtime_ns, s.st_ctime_ns), path, s.st_size))
            except FileNotFoundError:
                continue

    look(inbox, False, extensions)
    look(converted, True, (".md",))
    return sorted(out)


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        super().__init__(files)
        self.files = files


class InboxReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.inbox = options["path"], options.get("inbox", "00-Inbox")
        self.converted = options.get("converted", "temp_conversions")
        self.extensions = tuple("." + x for x in options.get("extensions", "md,pdf").split(","))
        self.settle = int(options.get("settle_ms", "100")) * 1_000_000
        self.high = (0, "")

    def listed(self) -> list[tuple[int, str, int]]:
        return found(self.root, self.inbox, self.converted, self.extensions)

    def initialOffset(self) -> dict:
        return {"stamp": 0, "path": ""}

    def latestOffset(self) -> dict:
        still = time.time_ns() - self.settle
        for stamp, path, _ in self.listed():
            if stamp <= still:
                self.high = max(self.high, (stamp, path))
        return {"stamp": self.high[0], "path": self.high[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["stamp"], o["path"]) for o in (start, end))
        self.high = max(self.high, high)
        out, held = [[]], 0
        for stamp, path, size in self.listed():
            if low < (stamp, path) <= high:
                if held and held + size > PART_BYTES:
                    out, held = [*out, []], 0
                out[-1].append((stamp, path))
                held += size + 4096
        return [Files(x) for x in out if x]

    def read(self, partition: Files):
        for stamp, path in partition.files:
            full, text = os.path.join(self.root, path), None
            try:
                if path.endswith(".pdf"):
                    os.stat(full)
                else:
                    with open(full, encoding="utf-8", newline="") as f:
                        text = f.read()
            except (OSError, UnicodeDecodeError):
                continue
            yield path, text, datetime.fromtimestamp(stamp // 1_000_000_000, UTC), stamp

    def commit(self, end: dict) -> None:
        pass


class InboxSource(DataSource):
    @classmethod
    def name(cls):
        return "vault_inbox"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return InboxReader(self.options)


def inbox_stream(spark: SparkSession, root: str, inbox: str = "00-Inbox", settle_ms: int = 100) -> DataFrame:
    """Versions ``(path, content, modified_on, version)`` of inbox files as they come; the inbox is made where it is absent."""
    os.makedirs(os.path.join(root, inbox), exist_ok=True)
    spark.dataSource.register(InboxSource)
    return spark.readStream.format("vault_inbox").option("inbox", inbox).option("settle_ms", settle_ms).load(root)
