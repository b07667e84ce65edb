"""WARC archives of pages, read back by boundary-chain verification.

Writing: pages of equal payload (of ``least`` bytes on) are found by digest; the
one of smallest page_id becomes a response, the others revisit it.  Tasks write
archives of bounded size, each record a gzip member of its own (or plain).

Reading: archives are cut into byte ranges.  A task reports every place in its
range that could start a record - the member magic or, in plain archives, the
``WARC/1.`` line - with what it parses there and the offset of the successor.
Payloads may hold such places too.  From the start of each file the successors
are followed by pointer jumping (log2 of the record count rounds over arrays),
and only reached places are records.  Headers may be of any length.  A chain has
to end where its archive ends; if it does not, reading fails.

Defined cases: a null html is empty; rows are judged one by one, so repeated
rows give repeated records; all rows of a payload's smallest page_id are
responses; a null page_id is never referred to while another id has the payload;
a null url has no target header; an empty table gives no archives and no rows; a
payload of any length is one record, written and read whole; extra columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import batch, local_path, shared_folder, strings, table, written

LEAST = 100
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
MEMBER = b"\x1f\x8b\x08"
PLAIN = re.compile(rb"WARC/1\.[01]\r\n")


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages(page_id, url, html)`` with payload, digest, record type and what it refers to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    # Written, so that the join below reads it by an exchange of its own and Spark can split a very common payload's partition.
    out = rows.join(written(groups, "payloads"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"))


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return VERSION + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    name = lambda x: f"<{PAGE}{'null' if x is None else x}>"
    head = [("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", head, http + payload)
    return record("revisit", [*head, ("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)], http)


def write_warc(pages: DataFrame, folder: str, compress: bool = True, date: str = "2024-01-01T00:00:00Z", most: int = 64 << 20) -> DataFrame:
    """Write archives under ``folder``; returns ``(path, size)`` of those whose tasks succeeded."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64())])
    fs, path = local_path(folder)
    fs.create_dir(path, recursive=True)
    shut = (lambda x: gzip.compress(x, 1, mtime=0)) if compress else bytes

    def write(batches):
        fs, path = local_path(folder)
        out, made = None, []
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, size = fs.open_output_stream(f"{path}/{name}", compression=None), 0
                    size += out.write(shut(record("warcinfo", [("WARC-Date", date), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                size += out.write(shut(page_record(*row, date)))
                if size >= most:
                    out.close()
                    made.append((f"{folder}/{name}", size))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", size))
        yield batch(schema, path=[x for x, _ in made], size=[x for _, x in made])

    return written(decided(pages).mapInArrow(write, "path string, size long"), "archives")


def parsed(raw: bytes) -> tuple[dict, bytes, int] | None:
    """Headers (names in lower case), block and length of a plain record at the start of ``raw``; None if it is none."""
    m = PLAIN.match(raw)
    end = raw.find(b"\r\n\r\n") if m else -1
    if end < 0:
        return None
    head, at = {}, m.end()
    while at < end:  # line by line, so that what is no record is left at its first wrong line
        stop = raw.find(b"\r\n", at, end + 2)
        k, colon, v = raw[at:stop].partition(b":")
        if not colon:
            return None
        head[k.decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
        at = stop + 2
    if not head.get("content-length", "").isdigit():
        return None
    n = int(head["content-length"])
    return head, raw[end + 4 : end + 4 + n], end + 8 + n


def fields(head: dict, block: bytes) -> dict:
    """What a record says of its page; the digest of a payload that is there is taken from its bytes."""
    page = lambda x: int(v) if (v := x.strip("<>").removeprefix(PAGE)).lstrip("-").isdigit() else None
    kind = head.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else b""
    return {
        "record_type": kind, "page_id": page(head.get("warc-record-id", "")), "url": head.get("warc-target-uri"), "refers_to": page(head.get("warc-refers-to", "")),
        "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response" else head.get("warc-payload-digest", "").removeprefix("sha256:"),
        "payload_bytes": len(payload) if kind == "response" else int(n) if (n := head.get("warc-payload-length", "")).isdigit() else None,
        "payload": payload if kind == "response" else None,
    }


class Bytes:
    """A file read in steps from some offset on, as far as asked for."""

    def __init__(self, file, at: int, step: int = 1 << 20):
        self.file, self.at, self.step, self.held = file, at, step, b""

    def upto(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.file.read_at(max(self.step, n - len(self.held)), self.at + len(self.held)) if self.at + len(self.held) < self.size else b""):
            self.held += more
        return self.held

    def find(self, what: bytes, start: int) -> int:
        """Where ``what`` is first from ``start`` on, reading on as far as needed; -1 if nowhere."""
        while (at := self.held.find(what, start)) < 0:
            start, n = max(start, len(self.held) - len(what) + 1), len(self.held)
            if len(self.upto(n + 1)) == n:
                return -1
        return at

    @property
    def size(self) -> int:
        return self.file.size()


def candidates(file, start: int, end: int):
    """``(offset, successor, fields)`` of every place in ``[start, end)`` that parses as a record."""
    size = file.size()
    data = Bytes(file, start)
    held = data.upto(min(end + 16, size) - start)
    if file.read_at(2, 0) == MEMBER[:2]:
        at = held.find(MEMBER)
        while 0 <= at < end - start:
            if got := member(data, at, size - start):
                raw, n = got
                if p := parsed(raw):
                    yield start + at, start + at + n, fields(p[0], p[1])
            at = data.held.find(MEMBER, at + 1)
        return
    head_end = -1
    for m in PLAIN.finditer(held):
        if m.start() >= end - start:
            break
        if head_end < m.start():  # the next one is the same for all places before it
            head_end = data.find(b"\r\n\r\n", m.start())
            if head_end < 0:
                break
        p = parsed(data.held[m.start() : head_end + 4])
        if p and m.start() + p[2] <= size - start:
            raw = data.upto(m.start() + p[2])[m.start() : m.start() + p[2]]
            p = parsed(raw)
            yield start + m.start(), start + m.start() + p[2], fields(p[0], p[1])


def member(data: Bytes, at: int, size: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds and its length; None if there is none."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= size:
                return None
            part = data.upto(min(pos + (1 << 16), size))[pos : pos + (1 << 16)]
            out.append(z.decompress(part))
            pos += len(part)
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data) - at


def reached(offsets: np.ndarray, after: np.ndarray, first: int = 0) -> np.ndarray:
    """Which of the sorted ``offsets`` are on the chain of successors from ``first``, by pointer jumping."""
    n = len(offsets)
    jump = np.searchsorted(offsets, after)
    jump[(jump < n) & (offsets[np.minimum(jump, n - 1)] != after)] = n
    jump = np.append(jump, n)
    on = np.zeros(n + 1, bool)
    on[:n] = offsets == first
    for _ in range(max(1, int(n).bit_length())):
        on[jump[on]] = True
        jump = jump[jump]
    return on[:n]


KINDS = "path string, at long, after long, record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long"


def read_warc(archives: DataFrame, payload: bool = False, split: int = 8 << 20) -> DataFrame:
    """Records of ``archives(path, size)`` as reached from the start of each file: place, type, page, digest, size (and payload)."""
    names = [x.split()[0] for x in KINDS.split(", ")] + ["payload"] * payload
    kinds = KINDS + ", payload binary" * payload
    schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in kinds.split(", ")])
    ranges = archives.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    # A given number of tasks: a range is a few bytes of row but megabytes of file, so rows must not be gathered by their size.
    n = archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1
    ranges = ranges.repartition(max(1, min(int(n), 10_000)))

    def scan(batches):
        for b in batches:
            for path, size, start in zip(b["path"].to_pylist(), b["size"].to_pylist(), b["start"].to_pylist()):
                fs, name = local_path(path)
                with fs.open_input_file(name) as f:
                    # The end of the file is the last place of a chain, its own successor.
                    rows, held = [{c: None for c in names} | {"path": path, "at": size, "after": size}] if start + split >= size else [], 0
                    for at, after, x in candidates(f, start, min(start + split, size, f.size())):
                        rows.append({"path": path, "at": at, "after": after} | x)
                        held += len(x["payload"] or b"") * payload
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield batch(schema, **{c: [r[c] for r in rows] for c in names})
                            rows, held = [], 0
                    yield batch(schema, **{c: [r[c] for r in rows] for c in names})

    found = ranges.mapInArrow(scan, kinds)

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        at, after = t["at"].to_numpy(), t["after"].to_numpy()
        on = reached(at, after)
        if not on[-1] or at[-1] != after[-1]:
            raise ValueError(f"{t['path'][0]}: no record starts at byte {after[on].max(initial=0)}, before the end of the file")
        return t.filter(pa.array(on)).slice(0, int(on.sum()) - 1)

    if not payload:
        return found.groupBy("path").applyInArrow(chain, KINDS)
    found = written(found, "records")
    kept = found.select("path", "at", "after").groupBy("path").applyInArrow(chain, "path string, at long, after long")
    return found.join(kept.select("path", "at"), ["path", "at"], "left_semi")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/quillspark/warc-{uuid.uuid4().hex}"
    archives = write_warc(table(spark, sf_dir, "pages"), folder)
    out = read_warc(archives).filter(F.col("record_type").isin("response", "revisit"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
