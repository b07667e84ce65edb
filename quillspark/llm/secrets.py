"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans (kinds ``assign``, ``access``, ``hex``) are what three patterns find
by themselves.  Weak parts - account identifiers, 40-character secret-looking
runs and endpoints - say little alone; they are reported only when their
complement stands within ``scope`` code points in the same document:

* ``ident``: an identifier, if a secret (``assign`` or ``bare``) is in scope;
* ``bare``: a secret-looking run, if an identifier (``access`` or ``ident``) is;
* ``endpoint``: a URL or host and port, if both an identifier and a secret are.

The link is an interval join: parts are binned by position, complements are
offered to three bins, and a left semi join keeps weak parts with a partner, so
no pairs are made.  Parts are far smaller than the texts; they are written once
to the shared folder; a text is gone through three times a pattern (whether it
matches, what lies between matches, the matches), whatever its length.  A text of many
matches (a dump of keys) costs their number times its root.

Defined cases: a null or empty text has no spans; rows are judged one by one,
so repeated rows give repeated results and a null doc_id stays null; positions
count code points; columns other than those named are ignored, so extra ones
with any names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table, written

# The patterns of the base spans and the least lengths of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # maximal runs: the same as [0-9a-f]+ kept from 32 characters on
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Weak parts: an identifier by its label, a bare run of 40 key characters, an endpoint.
IDENT = r"""(?i:client_?id|account_?id|access_?key_?id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

ORDER = ["assign", "access", "hex", "ident", "bare", "endpoint"]
SPAN = "array<struct<s:int,k:int,e:int>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, value, join, emit, kind: str, base: Column | None = None) -> Column:
    """``emit(item, state)`` of every item in order, ``state`` being ``join`` of 0 and the values of those before it.

    Arrays grow by copying, so items are taken in chunks of about the root of
    their number: a text of n matches costs n times that root, not n squared.
    With ``base`` (a text) ``emit`` gets two more: its part that begins at the
    state before the chunk, up to the state after it, and where that part begins.
    """
    n = F.ceil(F.sqrt(F.size(items))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int")), lambda i: F.slice(items, i * n + 1, n))
    none = F.array().cast(f"array<{kind}>")

    def whole(chunks):
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: join(a, value(x))))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,t:int>>").alias("out"))
        edges = F.aggregate(sums, first, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), join(a["at"], x).alias("t")))).alias("out")), lambda a: a["out"])

        def one(z):
            def inner(part):
                more = (part, z["e"]["s"]) if base is not None else ()
                start = F.struct(z["e"]["s"].alias("at"), none.alias("out"))
                return F.aggregate(z["c"], start, lambda a, x: F.struct(join(a["at"], value(x)).alias("at"), F.concat(a["out"], F.array(emit(x, a["at"], *more))).alias("out")), lambda a: a["out"])

            return inner(None) if base is None else let(base.substr(z["e"]["s"] + 1, z["e"]["t"] - z["e"]["s"]), inner)

        return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), edges.alias("e")), one))

    return F.when(F.size(items) > 0, let(chunks, whole)).otherwise(none)


ITEM = "struct<s:int,k:int,e:int>"


def found(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of all leftmost non-overlapping matches, from the lengths of gaps and matches.

    ``split`` gives one gap more than there are matches, in the same order, so
    running sums of both lengths are the positions.
    """
    k = ORDER.index(kind)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("m"), (keep(m) if keep else F.lit(True)).alias("kept")))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda x: x["m"].isNotNull())
    span = lambda x, at: F.struct((at + x["g"]).alias("s"), F.when(x["m"]["kept"], F.lit(k)).otherwise(-1).alias("k"), (at + x["g"] + x["m"]["m"]).alias("e"))
    out = let(pairs, lambda p: running(p, lambda x: x["g"] + x["m"]["m"], lambda a, b: a + b, span, ITEM))
    return F.when(text.rlike(pattern), F.filter(out, lambda x: x["k"] >= 0)).otherwise(F.array().cast(SPAN))


def apart(weak: Column, base: Column) -> Column:
    """Weak spans that lie in no base span: one pass over both by their starts, with the farthest end of a base span so far."""
    first = len(ORDER[:3])
    both = F.array_sort(F.transform(F.concat(base, weak), lambda x: F.struct(x["s"].alias("s"), (x["k"] >= first).alias("late"), x["k"].alias("k"), x["e"].alias("e"))))
    told = lambda x, at: F.struct(x["s"].alias("s"), F.when(x["late"] & (at < x["e"]), x["k"]).otherwise(-1).alias("k"), x["e"].alias("e"))
    out = let(both, lambda b: running(b, lambda x: F.when(x["late"], 0).otherwise(x["e"]), F.greatest, told, ITEM))
    return F.when(F.size(weak) > 0, F.filter(out, lambda x: x["k"] >= 0)).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each of ``docs``: key, base and weak spans, and ``row``, a hash of key and text."""
    t = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(
        F.col(key).alias("doc_id"),
        F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" "), t)).alias("row"),
        found(t, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        found(t, ACCESS, "access", lambda m: F.length(m) >= ACCESS_LEAST).alias("access"),
        found(t, HEX, "hex").alias("hex"),
        found(t, IDENT, "ident").alias("ident"),
        found(t, BARE, "bare").alias("bare"),
        found(t, ENDPOINT, "endpoint").alias("endpoint"),
    )
    base = F.concat("assign", "access", "hex")
    return one.select(
        "doc_id", "row", "assign", "access", "hex",
        # A weak part inside a base span is that span, not another.
        apart(F.concat("ident", "bare", "endpoint"), base).alias("weak"),
        F.array_sort(base).alias("base"),
    )


def linked(scan: DataFrame, scope: int = 400) -> DataFrame:
    """Per ``row`` with any: the weak spans whose complements stand within ``scope`` code points."""
    parts = (
        scan.filter(F.size("weak") > 0)
        .select("row", F.explode(F.concat("assign", "access", "weak")).alias("p"))
        .select("row", "p.s", "p.k", "p.e", F.floor(F.col("p.s") / scope).alias("bin"))
        .distinct()
    )
    kind = {name: i for i, name in enumerate(ORDER)}

    def offered(*names: str) -> DataFrame:
        return parts.filter(F.col("k").isin([kind[n] for n in names])).select(
            F.col("row").alias("r"), F.col("s").alias("cs"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("b")
        )

    def near(weak: DataFrame, partner: DataFrame) -> DataFrame:
        on = (F.col("row") == F.col("r")) & (F.col("bin") == F.col("b")) & (F.abs(F.col("s") - F.col("cs")) <= scope)
        return weak.join(partner, on, "left_semi")

    ids, keys = offered("access", "ident"), offered("assign", "bare")
    of = {n: parts.filter(F.col("k") == kind[n]) for n in ("ident", "bare", "endpoint")}
    kept = near(of["bare"], ids).union(near(of["ident"], keys)).union(near(near(of["endpoint"], ids), keys))
    return kept.groupBy("row").agg(F.collect_set(F.struct("s", "k", "e")).alias("more"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """Base and linked spans of every row of ``docs`` (see the module): doc_id, counts, spans."""
    scan = written(scanned(docs), "secrets")
    return scan.join(linked(scan, scope), "row", "left").select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ORDER[:3]),
        "base",
        F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("found"),
    )


def masked(docs: DataFrame, scope: int = 400, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets (overlapping spans by the first one's) and ``n_chars`` counted anew."""
    scan = written(scanned(docs, text, key), "secrets")
    found = scan.join(linked(scan, scope), "row", "left").select("row", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))
    found = found.filter(F.size("spans") > 0).dropDuplicates(["row"]).withColumnRenamed("row", "masked_row")
    t = F.col(text)
    row = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" "), F.coalesce(t, F.lit(""))))
    names = F.array(*map(F.lit, ORDER))

    def piece(x, at, part, start):
        """What stands between the spans so far and this one, and its mark; nothing where it begins within them."""
        return F.when(x["s"] >= at, F.concat(part.substr(at - start + 1, x["s"] - at), F.lit("["), F.element_at(names, x["k"] + 1), F.lit("]"))).otherwise(F.lit(""))

    new = F.concat(
        F.array_join(running(F.col("spans"), lambda x: x["e"], F.greatest, piece, "string", t), ""),
        t.substr(F.array_max(F.transform("spans", lambda x: x["e"])) + 1, F.length(t)),
    )
    out = docs.join(found, row == F.col("masked_row"), "left").withColumn("masked_text", F.when(F.col("masked_row").isNotNull(), new).otherwise(t))
    cols = {text: F.col("masked_text"), "n_chars": F.when(F.col("masked_row").isNotNull(), F.length("masked_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*((cols.get(c) if cols.get(c) is not None else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_linked"),
    )
