"""Repair of conversations by the cheapest edits, of any number of turns.

Turns are kept, given another role, deleted or put in, so that the roles become
``(s?(ua)+)?``.  *Cost-to-go*: from the last turn back, the least cost that
finishes from each state of this grammar (start, after ``s``, after ``u``, after
``a``).  *Walk*: forward from the start, taking at each point the ASCII-least edit
among those whose cost and cost-to-go make up the cost at hand; the letters name
one transition each, so the walk is the ASCII-least of all cheapest edits.  The
turns it rebuilds are hashed as it goes.

*Long conversations.*  Rows are range-partitioned by conversation and turn, so
that a long conversation spreads over tasks, and packed in order into *pieces* of
bounded rows and bytes.  A piece of a conversation that has several is reduced to
the least costs from each state at its start to each at its end (sixteen numbers
for thousands of rows); from these the cost-to-go at every piece's end follows
without its rows.  The walk then streams the pieces, one at a time, holding none.
One task streams a conversation, as its one SHA-256 cannot be split; memory does
not grow with it but for the audit, a letter a row, which the result holds.

*Repeats.*  The first turn that has a role and text is found by aggregation over
digests, only where one occurs twice; rows that are the same in all columns are
told apart by a number they get when written.

Defined cases: null roles and texts are one space; null turns come first; rows of
one turn are ordered by role, then by SHA-256 of role and text; a null conv_id is
a conversation of its own; an empty table gives no rows; a conversation without
rows is the caller's to add (``op11`` does, from the rows before damage); texts of
any length are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import settings, table, trim_memory, written
from quillspark.llm.packed import FEW_BLOCKS

SPACE = " \t\n\x0b\x0c\r"
ROWS, BYTES = 4096, 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: 0 at the start, 1 after s, 2 after u, 3 after a. Where a role leads from each; none where it may not stand.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Where a turn that is put in or given another role leads: user, but assistant after a user.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: Cost-to-go after the last row: what has to be put in.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
BLANK, TWICE, CUT = 1, 2, 3


def backward(initials: list[str], faults: list[int], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost-to-go in each state before each row, and ``end`` after the last."""
    out = [end]
    for x, f in zip(reversed(initials), reversed(faults)):
        after = out[-1]
        base = [DELETE + c for c in after]
        if f not in (BLANK, TWICE):
            more, to = TRUNCATED * (f == CUT), AFTER.get(x)
            for q in range(4):
                base[q] = min(base[q], REROLE + more + after[NEXT[q]], more + after[to[q]] if to and to[q] is not None else FAR)
        u, a = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
        out.append((min(base[0], INSERT + u), min(base[1], INSERT + u), u, a))
    return out[::-1]


def forward(q: int, initials: list[str], faults: list[int], togo: list[tuple[int, ...]], last: bool):
    """Edits from state ``q``: ``(letter, row or None, state after)``, the ASCII-least that are cheapest."""
    n, i = len(initials), 0
    while i < n or (last and togo[n][q]):
        now = togo[i][q]
        if i < n and now == DELETE + togo[i + 1][q]:
            yield "D", i, q
            i += 1
        elif now == INSERT + togo[i][NEXT[q]]:
            q = NEXT[q]
            yield "I", None, q
        else:
            more, to = TRUNCATED * (faults[i] == CUT), AFTER.get(initials[i])
            keep = to is not None and to[q] is not None and now == more + togo[i + 1][to[q]]
            q = to[q] if keep else NEXT[q]
            yield ("K" if keep else "R"), i, q
            i += 1


PIECE = "conv_id long, seq long, turns array<long>, roles array<string>, texts array<string>, faults array<int>"
PIECE_ARROW = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32()))])


def faulted(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with each one's first fault: 1 blank, 2 a repeat, 3 cut off, else 0; written."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.withColumns({
        "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), "row": F.monotonically_increasing_id(),
        "fault": F.when(core == "", BLANK).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0),
    })
    rows = written(rows, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("t"), "turn", "row")
    first = rows.groupBy("conv_id", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = written(first.select(F.col("conv_id").alias("of"), F.col("digest").alias("sign"), F.col("first.row").alias("kept")), "repeated")
    out = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("sign")), "left")
    twice = F.col("kept").isNotNull() & (F.col("kept") != F.col("row")) & (F.col("fault") != BLANK)
    return out.select("conv_id", "turn", "role", "digest", "row", "text", F.when(twice, TWICE).otherwise(F.col("fault")).alias("fault"))


def pieces(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Rows in order, packed: each piece is of one conversation; ``seq`` is the order of pieces. Written."""

    def pack(batches):
        part, n, held, size, out, waiting = TaskContext.get().partitionId(), 0, [], 0, [], 0

        def flush():
            nonlocal held, size, n
            conv, turns, roles, texts, faults = zip(*held)
            out.append({"conv_id": conv[0], "seq": (part << 32) + n, "turns": turns, "roles": roles, "texts": texts, "faults": faults})
            held, size, n = [], 0, n + 1

        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if held and (held[0][0] != row[0] or len(held) >= most_rows or size >= most_bytes):
                    flush()
                    if waiting >= most_bytes:
                        yield pa.RecordBatch.from_pylist(out, schema=PIECE_ARROW)
                        out, waiting = [], 0
                held.append(row)
                size, waiting = size + len(row[3]), waiting + len(row[3]) + 64
        if held:
            flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=PIECE_ARROW)
        trim_memory()

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    with settings(rows.sparkSession, FEW_BLOCKS):
        return written(dealt.mapInArrow(pack, PIECE), "pieces")


def costs_to_go(packed: DataFrame) -> DataFrame:
    """``(seq, togo)``: cost-to-go at the end of each piece of the conversations that have several."""
    several = packed.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("of"))
    several = written(several, "several")

    def reduced(batches):
        for b in batches:
            for conv, seq, roles, faults in zip(*(b[c].to_pylist() for c in ("conv_id", "seq", "roles", "faults"))):
                initials = [r[:1] for r in roles]
                ways = [backward(initials, faults, tuple(0 if q == e else FAR for q in range(4)))[0] for e in range(4)]
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "seq": [seq], "ways": [[ways[e][q] for q in range(4) for e in range(4)]]})

    def folded(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["seq"].to_pylist(), t["ways"].to_pylist()), reverse=True)
        togo, out = END, []
        for seq, w in rows:
            out.append((seq, list(togo)))
            togo = tuple(min(w[4 * q + e] + togo[e] for e in range(4)) for q in range(4))
        return pa.table({"at": pa.array([s for s, _ in out], pa.int64()), "togo": pa.array([g for _, g in out], pa.list_(pa.int64()))})

    long = packed.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").select("conv_id", "seq", "roles", "faults")
    return long.mapInArrow(reduced, "conv_id long, seq long, ways array<long>").groupBy("conv_id").applyInArrow(folded, "at long, togo array<long>")


class Repair:
    """A conversation as its pieces come in."""

    def __init__(self, conv):
        self.conv, self.q, self.cost, self.audit, self.digest, self.kept = conv, 0, 0, [], hashlib.sha256(), 0
        self.faults, self.illegal, self.before, self.turn, self.turns, self.low = [0, 0, 0, 0], 0, None, None, 0, None

    def take(self, turns, roles, texts, faults, togo, last):
        """Rows of a piece in; the turns it rebuilds out, as ``(role, text, edit)``."""
        initials, out, edits = [r[:1] for r in roles], [], []
        for t, x, f in zip(turns, initials, faults):
            self.faults[f] += 1
            self.illegal += self.before is not None and self.before + x not in ("su", "ua", "au")
            self.before = x
            if t is not None and t != self.turn:
                self.turn, self.turns, self.low = t, self.turns + 1, t if self.low is None else self.low
        costs = backward(initials, faults, togo)
        for edit, i, q in forward(self.q, initials, faults, costs, last):
            edits.append(edit)
            self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + TRUNCATED * (edit in "KR" and faults[i] == CUT)
            self.q = q
            if edit != "D":
                out.append((roles[i] if edit == "K" else NAMES[q], "" if i is None else texts[i], edit))
        self.audit.append("".join(edits))
        for role, text, _ in out:
            self.digest.update((("\n" if self.kept else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.kept += 1
        return out

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[TWICE], "truncated": self.faults[CUT], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED_ARROW = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (x.split()[0] for x in REPAIRED.split(", "))])
TURNS = "conv_id long, pos long, role string, text string, edit string"
TURNS_ARROW = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def walked(rows: DataFrame, turns: bool, most_rows: int, most_bytes: int) -> DataFrame:
    packed = pieces(faulted(rows), most_rows, most_bytes)
    togo = costs_to_go(packed)
    last = F.max("seq").alias("last")
    ends = packed.groupBy("conv_id").agg(last).select(F.col("last").alias("at_end"))
    whole = packed.join(togo, F.col("seq") == F.col("at"), "left").join(ends, F.col("seq") == F.col("at_end"), "left")
    whole = whole.select("conv_id", "seq", "turns", "roles", "texts", "faults", "togo", F.col("at_end").isNotNull().alias("last"))

    def run(batches):
        now, done = None, []
        for b in batches:
            for i in range(b.num_rows):
                conv, seq, t, r, x, f, g, end = (b[c][i].as_py() for c in ("conv_id", "seq", "turns", "roles", "texts", "faults", "togo", "last"))
                now = now or Repair(conv)
                at = now.kept
                out = now.take(t, r, x, f, END if g is None else tuple(g), end)
                if turns and out:
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv, "pos": at + k, "role": a, "text": b_, "edit": e} for k, (a, b_, e) in enumerate(out)], schema=TURNS_ARROW)
                if end:
                    done.append(now.row())
                    now = None
                if not turns and len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema=REPAIRED_ARROW)
                    done = []
        if not turns and done:
            yield pa.RecordBatch.from_pylist(done, schema=REPAIRED_ARROW)
        trim_memory()

    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, TURNS if turns else REPAIRED)


def repaired(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """A row for each conversation of ``rows(conv_id, turn, role, text)``: its faults, the edits with their cost, and the digest of what they make."""
    return walked(rows, False, most_rows, most_bytes)


def repaired_turns(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """The conversations rebuilt: ``(conv_id, pos, role, text, edit)``, with positions from 0."""
    return walked(rows, True, most_rows, most_bytes)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as the query damages them, by CRC-32 of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return out.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repaired(damaged(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
