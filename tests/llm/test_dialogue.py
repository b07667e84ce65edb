import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import dialogue as d
from tests.llm.helpers import SF, saved

WS = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def sign(r):
    return hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()


def damage(rows):
    out = []
    for c, t, role, text in rows:
        sp = lambda x: " " if x is None else x
        k = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        role, text = sp(role), sp(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.rstrip(WS)
        out.append(1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def best(rows, fault):
    """Least (cost, audit) with the turns it gives, from every row and grammar state, by whole strings."""
    memo = {}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def go(i, q, put):
        if (i, q, put) in memo:
            return memo[i, q, put]
        found = [(0, "", ())] if i == len(rows) and q in ("", "a") else []

        def add(cost, letter, turn, i2, q2, put2=0):
            for c, a, t in [go(i2, q2, put2)] if go(i2, q2, put2) else []:
                found.append((cost + c, letter + a, ((turn,) if turn else ()) + t))

        if put < 2:  # more than two in a row at one place come back to a state
            for name in ("user", "assistant"):
                if (q, name[0]) in step:
                    add(5, "I", (name, ""), i, name[0], put + 1)
        if i < len(rows):
            _, _, role, text = rows[i]
            add(2, "D", None, i + 1, q)
            if fault[i] not in (1, 2):
                more = 5 * (fault[i] == 3)
                if (q, role[:1]) in step:
                    add(more, "K", (role, text), i + 1, step[q, role[:1]])
                for name in ("user", "assistant"):
                    if (q, name[0]) in step:
                        add(1 + more, "R", (name, text), i + 1, name[0])
        memo[i, q, put] = min(found, key=lambda x: (x[0], x[1]), default=None)
        return memo[i, q, put]

    return go(0, "", 0)


def brute(rows):
    """One conversation's row, of rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sign(r)))
    f = faults(rows)
    cost, audit, turns = best(rows, f)
    t = {r[1] for r in rows} - {None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    assert GRAMMAR.match("".join(r[:1] for r, _ in turns))
    return (max(t) - min(t) + 1 - len(t) if t else 0, f.count(1), f.count(2), f.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest())


def want(rows, ids=None):
    after = damage(rows) if ids is None else rows
    of = {}
    for r in after:
        of.setdefault(r[0], []).append(r)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: brute(of[c]) if c in of else empty for c in {r[0] for r in rows}}


def got(df):
    out = {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert len(out) == df.count()
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({"seq": F.lit(1), "fault": F.lit("x"), "row": F.lit(2), "of": F.lit(3), "last": F.lit(True), "kind": F.lit(0), "digest": F.lit("d")})


def test_all_edits_of_tiny_conversations():
    """The least of all edit sequences whatever, kept by the grammar as written."""
    texts = {0: "Yes.", 1: "", 3: "cut"}
    for n in range(3):
        for roles in itertools.product(["system", "user", "assistant", "x"], repeat=n):
            for kinds in itertools.product(texts, repeat=n):
                rows = [(1, i, r, texts[k] and texts[k].replace("Y", f"{i}Y")) for i, (r, k) in enumerate(zip(roles, kinds))]
                f, found = faults(rows), []
                for edits in itertools.product(*[[("D", None), ("K", r[2]), ("R", "user"), ("R", "assistant")] for r in rows]):
                    for ins in itertools.product([(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")], repeat=n + 1):
                        cost, audit, out = 0, "", ""
                        for i in range(n + 1):
                            for x in ins[i]:
                                cost, audit, out = cost + 5, audit + "I", out + x[0]
                            if i < n:
                                e, role = edits[i]
                                cost += {"D": 2, "K": 0, "R": 1}[e] + (1000 if e != "D" and f[i] in (1, 2) else 0) + (5 if e != "D" and f[i] == 3 else 0)
                                audit, out = audit + e, out + (role[:1] if role else "")
                        if cost < 1000 and GRAMMAR.match(out):
                            found.append((cost, audit))
                initials = [r[2][:1] for r in rows]
                costs = d.backward(initials, f, d.END)
                audit = "".join(e for e, _, _ in d.forward(0, initials, f, costs, True))
                assert (costs[0][0], audit) == min(found) == best(rows, f)[:2], rows


def awkward(n, seed):
    rng = random.Random(seed)
    texts = ["Hello there.", "What? ", "cut off", "", " \n", "Yes!", "no\x85", "é。", "Hello there.", "ok.\t"]
    return [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(-2, 12)]), rng.choice(["user", "assistant", "system", "User", "", None, "assistant", "user"]), rng.choice([None, *texts])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_awkward_rows(spark, tmp_path, seed):
    rows = awkward(120, seed) + [(9, None, None, None), (10, 10**12, "user", "x" * 200_000 + "."), (10, -(10**12), "system", "y " * 100_000)]
    assert got(d.op11_conversations(spark, saved(frame(spark, rows), tmp_path, "conversations"))) == want(rows)


def test_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert got(d.op11_conversations(spark, SF)) == want(rows)


def test_long_conversations_in_small_pieces(spark):
    """Conversations cut into many pieces, by rows and by bytes, equal those in one."""
    rows = [r for i, r in enumerate(awkward(300, 5))]
    df = frame(spark, rows)
    clean = [(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows]
    assert got(d.repaired(df, 3)) == want(clean, 1)
    assert got(d.repaired(df, 50, 40)) == got(d.repaired(df))


def test_turns_rebuilt(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B?"), (1, 2, "user", "B?"), (1, 3, "user", "C."), (2, 0, "user", "")]
    turns = [tuple(r) for r in d.repaired_turns(frame(spark, rows), 2).orderBy("conv_id", "pos").collect()]
    one = got(d.repaired(frame(spark, rows)))
    assert one[1][5:7] == (5, "DKDR") and one[2][6] == "D"
    assert turns == [(1, 0, "user", "B?", "K"), (1, 1, "assistant", "C.", "R")]
    assert one[1][7] == hashlib.sha256(b"user:B?\nassistant:C.").hexdigest()


def test_empty_table(spark, tmp_path):
    assert d.op11_conversations(spark, saved(frame(spark, [(1, 1, "user", "a.")]).limit(0), tmp_path, "conversations")).count() == 0
