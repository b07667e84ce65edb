"""N-gram Jaccard join with adaptive multi-match prefixes, down to connected groups.

Sets are the distinct ``size``-word shingles of whole texts, hashed to 64 bits.

1. Texts of one set are one class; its smallest doc_id stands for it.
2. Document frequencies of all shingles of class representatives are counted by
   packed exchange.  Tokens are ordered by (frequency, hash).  A shingle of one
   class only is shared with nothing, so a set with too few shared tokens can
   have no link and leaves here.
3. Prefixes: with overlap at least ``ceil(t * n)`` needed, a set's prefix of
   ``n - ceil(t * n) + l`` tokens shares at least ``l`` tokens with every linked
   set's.  Each document takes the ``l`` of least estimated cost - postings to
   read and candidates to verify, from the frequencies of its prefix - and two
   documents are candidates when they share ``min(l, l')`` prefix tokens.
4. Large groups of copies: before pairs are made, each document is compared with
   a leader, of those of equal min-hash the one with the largest share of shared
   tokens (that nearest to what the others are copies of).  Documents of one
   leader are a family: held as their differences from it, they are compared
   exactly by matrix products over blocks, and only one link of a document into
   each other component leaves the task.  Prefix postings then make pairs across
   families and components only; long ones are dealt as pairs of sub-blocks.
   This loses no link between components, and so none that matters.
5. Candidates that pass the size and shared-token bounds are verified on whole
   sets; links and earlier components give the components.

Defined cases: without words or text a set is empty and linked with nothing;
with fewer words than ``size`` it is the whole sequence; rows of one doc_id are
one node; a null doc_id takes part in nothing and has a null component; extra
columns are ignored; an empty table gives no rows; a text of any length is one row
of a block and taken whole; ties between leaders go to the smaller doc_id.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import packed
from quillspark.llm.common import batch, connected_components, discarded, fold_words, mix64, settings, slices, strings, swept, table, trim_memory, written

SALTS = 4
#: What reading a posting costs against verifying one token of a candidate.
POSTING, VERIFY = 1.0, 0.02
CHOICES = (1, 2, 3, 4, 6, 8)


class Shingler:
    """Distinct shingle hashes of texts, made for all texts of a block at once."""

    def __init__(self, size: int):
        self.size = size

    def shingles(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words."""
        out = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for i in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
        return out

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' sorted distinct uint64, one text after another, and the ends of each text's."""
        cut = [fold_words(t) for t in texts]
        words = np.array([len(w) for w in cut], np.int64)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(cut))), ">u8").astype(np.uint64)
        del cut
        runs, last = self.shingles(h, self.size), np.cumsum(words)
        count = np.where(words < self.size, np.minimum(words, 1), words - self.size + 1)
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        for w, e, n, to in zip(words.tolist(), last.tolist(), count.tolist(), ends.tolist()):
            if n:
                out[to - n : to] = runs[e - w : e - w + n] if w >= self.size else self.shingles(h[e - w : e], w)
                out[to - n : to].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[(ends - count)[count > 0]] = True
        return out[new], np.concatenate([[0], np.cumsum(new)])[ends]


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n, sig)`` of every row; sig is null for empty sets and null ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.string())])

    def run(batches):
        cut = Shingler(size)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                keys, ends = cut(strings(b["text"]))
                ids, n = b["doc_id"].to_pylist(), np.diff(ends, prepend=0)
                sig = [xxhash.xxh3_128_hexdigest(keys[e - s : e].tobytes()) if s and i is not None else None for i, s, e in zip(ids, n.tolist(), ends.tolist())]
                yield batch(schema, doc_id=ids, n=n, sig=sig)
        keys = sig = b = whole = None
        trim_memory()

    return written(docs.mapInArrow(run, "doc_id long, n long, sig string"), "signed")


def needed(n, tenths: int):
    """Least overlap of a set of ``n`` with any that it links to: ceil(tenths * n / 10)."""
    return (tenths * n + 9) // 10


def choose(n: int, df: np.ndarray, tenths: int) -> tuple[int, int]:
    """Extra tokens and prefix length of least estimated cost for a set with frequencies in order."""
    first = n - needed(n, tenths)
    postings = np.cumsum(df.astype(np.int64) - 1)
    best = None
    for l in CHOICES:
        if first + l > n:
            break
        read = float(postings[first + l - 1])
        cost = POSTING * read + VERIFY * n * read / l
        if best is None or cost < best[0]:
            best = cost, l
    return best[1], first + best[1]


def sends(blocks: DataFrame, size: int, parts: int) -> DataFrame:
    """Distinct shingles of each block; the range is by the upper half of the hash, so where it is the last one, the lower half is sent."""
    half, parts = parts <= packed.FAN, min(parts, packed.FAN)

    def run(batches):
        cut = Shingler(size)
        for block, texts in packed.each(batches, "block", "texts"):
            keys, n = np.unique(cut(texts)[0], return_counts=True)
            yield packed.sent(block, keys, n, parts, half=half, n_kind="u1")

    return blocks.select("block", "texts").mapInArrow(run, packed.SENT)


KEPT = "kind string, rid long, n int, s int, l int, token long, hashes binary"


def prefixes(blocks: DataFrame, got: DataFrame, size: int, tenths: int) -> DataFrame:
    """Of sets that could have a link: a row ``set`` with its shared tokens, rows ``token`` of its prefix, rows ``min`` of its min-hashes."""
    schema = pa.schema([("kind", pa.string()), ("rid", pa.int64()), ("n", pa.int32()), ("s", pa.int32()), ("l", pa.int32()), ("token", pa.int64()), ("hashes", pa.binary())])
    salts = mix64(np.arange(1, SALTS + 1, dtype=np.uint64))

    def run(batches):
        cut = Shingler(size)
        for ids, texts, sums in packed.each(batches, "ids", "texts", "got"):
            sets, ends = cut(texts)
            size_of = np.diff(ends, prepend=0)
            df = packed.received(sums, "u1")[packed.distinct(sets)[1]]
            common = np.diff(np.concatenate([[0], np.cumsum(df > 1)])[ends], prepend=0)
            rows: list[tuple] = []
            for i in np.flatnonzero((size_of > 0) & (common >= needed(size_of, tenths))).tolist():
                rid, n, s = int(ids[i]), int(size_of[i]), int(common[i])
                x, d = sets[ends[i] - n : ends[i]], df[ends[i] - n : ends[i]]
                order = np.argsort(d, kind="stable")  # by (frequency, hash), as hashes are in order
                l, length = choose(n, d[order], tenths)
                tokens = x[order[n - s : length]]
                shared = x[d > 1]
                rows.append(("set", rid, n, s, l, None, shared.tobytes()))
                rows += [("token", rid, n, s, l, t, None) for t in tokens.view(np.int64).tolist()]
                rows += [("min", rid, n, s, k, t, None) for k, t in enumerate(mix64(shared ^ salts[:, None]).min(1).view(np.int64).tolist())]
            if rows:
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows)))))

    return packed.with_answers(blocks, got).select("ids", "texts", "got").mapInArrow(run, KEPT)


def may_link(nx, sx, ny, sy, tenths: int):
    """Bounds by sizes and by tokens that are shared with anything: works on columns and on arrays."""
    least = np.minimum if isinstance(nx, np.ndarray) else F.least
    o = least(sx, sy)
    return (10 * nx >= tenths * ny) & (10 * ny >= tenths * nx) & (10 * o >= tenths * (nx + ny - o))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(x, y)`` with both sizes and both arrays of shared tokens."""
    of = lambda side: sets.select(F.col("rid").alias(side), F.col("n").alias(f"n{side}"), F.col("hashes").alias(f"h{side}"))
    return pairs.join(of("y"), "y").join(of("x"), "x").select("x", "y", "nx", "ny", "hx", "hy")


def verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Those of distinct ``pairs(x, y)`` that link, as edges ``(u, v)``."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for b in batches:
            u, v = [], []
            for x, y, nx, ny, hx, hy in zip(*(b[c].to_pylist() for c in ("x", "y", "nx", "ny", "hx", "hy"))):
                o = int(within(np.frombuffer(hx, np.uint64), np.frombuffer(hy, np.uint64)).sum())
                if 10 * o >= tenths * (nx + ny - o):
                    u.append(x)
                    v.append(y)
            yield batch(schema, u=u, v=v)

    return with_sets(pairs, sets).mapInArrow(run, "u long, v long")


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``b`` are in sorted ``a``."""
    if not len(a):
        return np.zeros(len(b), bool)
    i = np.searchsorted(a, b)
    i[i == len(a)] = 0
    return a[i] == b


def leaders(mins: DataFrame) -> DataFrame:
    """``(x, y)``: for each document the most central of the leaders of its min-hash groups, the leader first; none for leaders themselves."""
    lead = F.struct((F.col("s") / F.col("n")).alias("share"), (-F.col("rid")).alias("minus"))
    groups = mins.groupBy("l", "token").agg(F.max(lead).alias("top"), F.count("*").alias("m")).filter("m > 1")
    groups = written(groups, "groups")  # so that the join can split a large group's partition
    best = mins.join(groups, ["l", "token"]).groupBy("rid").agg(F.max("top").alias("top"))
    return best.select((-F.col("top.minus")).alias("x"), F.col("rid").alias("y")).filter("x <> y")


DELTA = "leader long, rid long, n int, common int, link boolean, missing array<long>, extra array<long>"


def deltas(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Documents as their difference from their leader: tokens of it that they lack, shared tokens that it lacks.

    Kept where the two have half of their tokens together; others are no family.
    ``common`` is the leader's number of shared tokens.
    """
    schema = pa.schema([("leader", pa.int64()), ("rid", pa.int64()), ("n", pa.int32()), ("common", pa.int32()), ("link", pa.bool_()), ("missing", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = []
            for x, y, nx, ny, hx, hy in zip(*(b[c].to_pylist() for c in ("x", "y", "nx", "ny", "hx", "hy"))):
                a, c = np.frombuffer(hx, np.uint64), np.frombuffer(hy, np.uint64)
                both = within(a, c)
                o = int(both.sum())
                if 2 * o >= nx + ny - o:
                    rows.append((x, y, ny, len(a), 10 * o >= tenths * (nx + ny - o), a[~within(c, a)].view(np.int64), c[~both].view(np.int64)))
            if rows:
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows)))))

    return written(with_sets(pairs, sets).mapInArrow(run, DELTA), "deltas")


def own_families(family: DataFrame, sets: DataFrame) -> DataFrame:
    """Leaders as members of their families, unless they follow another: nothing missing, nothing added."""
    heads = family.select("leader").distinct().join(family.select(F.col("rid").alias("leader")), "leader", "left_anti")
    none = F.array().cast("array<long>")
    return heads.join(sets.select(F.col("rid").alias("leader"), "n", (F.length("hashes") / 8).cast("int").alias("common")), "leader").select("leader", F.col("leader").alias("rid"), "n", "common", none.alias("missing"), none.alias("extra"))


def incidence(lists: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of ``lists`` shares with each of ``others``."""
    tokens, inverse = np.unique(np.concatenate([*lists, *others]) if lists or others else np.zeros(0, np.int64), return_inverse=True)
    out = np.zeros((len(lists), len(others)), np.float32)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.repeat(np.arange(len(others)), [len(x) for x in others])
    left, right = inverse[: len(row)], inverse[len(row) :]
    used = np.flatnonzero((np.bincount(left, minlength=len(tokens)) > 0) & (np.bincount(right, minlength=len(tokens)) > 0))
    place = np.full(len(tokens), -1)
    for at in range(0, len(used), 4096):  # a bounded number of tokens at a time
        part = used[at : at + 4096]
        place[:] = -1
        place[part] = np.arange(len(part))
        a, b = np.zeros((len(lists), len(part)), np.float32), np.zeros((len(others), len(part)), np.float32)
        i, j = place[left], place[right]
        a[row[i >= 0], i[i >= 0]] = 1
        b[col[j >= 0], j[j >= 0]] = 1
        out += a @ b.T
    return out


def in_families(deltas: DataFrame, comps: DataFrame, tenths: int, most: int = 1024) -> DataFrame:
    """Edges between documents of one leader, exact and without pairs as rows.

    ``|x & y| = common - |Mx | My| + |Ex & Ey|`` from what each lacks and adds.
    Families of several components are dealt as pairs of blocks of about
    ``most`` documents; of a document's links into another component one is kept.
    """
    rows = labelled(deltas, comps)
    groups = rows.groupBy("leader").agg(F.count("*").alias("m"), F.min("c").alias("c_min"), F.max("c").alias("c_max")).filter("c_min < c_max")
    rows = rows.join(written(groups.select("leader", "m"), "groups"), "leader")  # written, so that the join can split a large family's partition
    blocks = F.ceil(F.col("m") / most).cast("int")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("leader", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "i", "rid", "n", "common", "c", "missing", "extra")

    def compare(t: pa.Table) -> pa.Table:
        rid, n, c, i, common = (t[k].to_numpy().astype(np.int64) for k in ("rid", "n", "c", "i", "common"))
        lists = lambda k: [np.asarray(x, np.int64) for x in t[k].to_pylist()]
        missing, extra = lists("missing"), lists("extra")
        size = np.array([len(x) for x in missing])
        whole = t["a"][0].as_py() == t["b"][0].as_py()
        left, right = (np.arange(len(rid)),) * 2 if whole else (np.flatnonzero(i == t["a"][0].as_py()), np.flatnonzero(i == t["b"][0].as_py()))
        u, v = [], []
        for at in range(0, len(left), most):
            p = left[at : at + most]
            for to in range(0, len(right), most):
                q = right[to : to + most]
                pick = lambda x, k: [x[y] for y in k]
                lack = size[p][:, None] + size[q][None] - incidence(pick(missing, p), pick(missing, q))
                o = common[0] - lack + incidence(pick(extra, p), pick(extra, q))
                x, y = np.nonzero((10 * o >= tenths * (n[p][:, None] + n[q][None] - o)) & (c[p][:, None] != c[q][None]))
                _, one = np.unique(np.stack([p[x], c[q[y]]], 1), axis=0, return_index=True) if len(x) else (None, [])
                u.append(rid[p[x[one]]])
                v.append(rid[q[y[one]]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"u": cat(u), "v": cat(v)})

    return rows.groupBy("leader", "a", "b").applyInArrow(compare, "u long, v long")


def labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("c", F.col("rid"))
    return rows.join(comps.select(F.col("node").alias("rid"), F.col("component").alias("c0")), "rid", "left").withColumn("c", F.coalesce("c0", "rid")).drop("c0")


def candidates(tokens: DataFrame, comps: DataFrame | None, tenths: int, families: DataFrame | None = None, most: int = 512) -> DataFrame:
    """Pairs across components, and across families where given as ``(rid, leader)``, that share enough prefix tokens."""
    rows = labelled(tokens, comps)
    if families is None:
        rows = rows.withColumn("f", F.col("rid"))
    else:
        rows = rows.join(families.select("rid", "leader"), "rid", "left").withColumn("f", F.coalesce("leader", "rid"))
    groups = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.min("f").alias("f_min"), F.max("f").alias("f_max")).filter("c_min < c_max AND f_min < f_max")
    rows = rows.join(written(groups.select("token", "m"), "groups"), "token")  # written, so that the join can split a common token's partition
    blocks = F.ceil(F.col("m") / most).cast("int")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("token", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "i", "rid", "n", "s", "l", "c", "f")
    keys = ["token", "a", "b"]
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("need", pa.int32())])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            cols = {c: held[c].to_numpy() for c in held.column_names}
            if not len(cols["token"]):
                continue
            new = np.flatnonzero((cols["token"][1:] != cols["token"][:-1]) | (cols["a"][1:] != cols["a"][:-1]) | (cols["b"][1:] != cols["b"][:-1])) + 1
            if len(new):
                yield pairs(cols, np.concatenate([[0], new[:-1]]), new)
                held = held.slice(int(new[-1]))
        if held is not None and held.num_rows:
            yield pairs({c: held[c].to_numpy() for c in held.column_names}, [0], [held.num_rows])

    def pairs(cols, starts, ends):
        out = []
        for s, e in zip(starts, ends):
            if e - s < 2:
                continue
            i, rid, n, sh, l, c, f = (cols[k][s:e] for k in ("i", "rid", "n", "s", "l", "c", "f"))
            ok = (rid[:, None] < rid[None]) & (c[:, None] != c[None]) & (f[:, None] != f[None])
            ok &= may_link(n[:, None].astype(np.int64), sh[:, None].astype(np.int64), n[None].astype(np.int64), sh[None].astype(np.int64), tenths)
            if cols["a"][s] != cols["b"][s]:
                ok &= i[:, None] != i[None]
            p, q = np.nonzero(ok)
            out.append((rid[p], rid[q], np.minimum(l[p], l[q])))
        x, y, need = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(need, pa.int32())], schema=schema)

    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "x long, y long, need int")
    return found.groupBy("x", "y").agg(F.count("*").alias("k"), F.min("need").alias("need")).filter("k >= need").select("x", "y")


def jaccard_groups(docs: DataFrame, size: int = 3, tenths: int = 9, block_bytes: int = 2 << 20) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, where sets of Jaccard similarity of ``tenths`` tenths link."""
    with settings(docs.sparkSession, packed.FEW_BLOCKS):
        return _groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, tenths, block_bytes)


def _groups(docs: DataFrame, size: int, tenths: int, block_bytes: int) -> DataFrame:
    signs = signed(docs, size)
    classes = signs.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rid"))
    ids = classes.select(F.col("rid").alias("doc_id")).distinct()
    reps = docs.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("extra"))
    blocks = packed.blocks(reps, block_bytes)
    total = blocks.select(F.expr("aggregate(texts, 0L, (a, x) -> a + octet_length(x))").alias("n")).agg(F.sum("n")).first()[0] or 0
    parts, most = packed.parts_for(total), lambda sums: np.minimum(sums, 255)
    if parts <= packed.FAN:
        got = packed.gathered(packed.answers(sends(blocks, size, parts), most, "u1", half=True, n_kind="u1"))
    else:
        got = packed.merged_answers(sends(blocks, size, parts), most, "u1", parts, -(-int(total) // block_bytes), n_kind="u1")
    kept = written(prefixes(blocks, got, size, tenths), "prefixes")
    discarded(blocks)  # what follows reads sets, no texts
    swept(docs.sparkSession)
    sets, tokens, mins = (kept.filter(F.col("kind") == k) for k in ("set", "token", "min"))
    family = deltas(leaders(mins), sets, tenths)
    edges = written(family.filter("link").select(F.col("leader").alias("u"), F.col("rid").alias("v")), "links")
    comps = written(connected_components(edges), "components")
    members = written(family.select("leader", "rid", "n", "common", "missing", "extra").union(own_families(family, sets)), "families")
    swept(docs.sparkSession)
    edges = written(edges.union(in_families(members, comps, tenths)), "links")
    comps = written(connected_components(edges), "components")
    swept(docs.sparkSession)
    edges = edges.union(verified(candidates(tokens, comps, tenths, members), sets, tenths))
    comps = connected_components(edges)
    named = classes.join(comps.select(F.col("node").alias("rid"), "component"), "rid", "left").select("sig", F.coalesce("component", "rid").alias("component_id"))
    named = written(named, "named")  # so that the join below can split the partition of a very common set
    return signs.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
