"""Hooks for a language model: a client is any function from prompts to answers; the built-in one is a fixed stub.

Calls run in Arrow batches on the executors, ``concurrency`` of them at a time
by partitions.  What a client proposes is a proposal: moves need a person's
``status: confirmed``.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import VaultConfig
from quillspark.functions import text as T
from quillspark.operators import graph as G
from quillspark.operators import hubs as H
from quillspark.operators import tags
from quillspark.operators.audit import edits

BATCH, LEAST_CONFIDENCE, CONCURRENCY = 15, 0.5, 5
# How notes can be related.
RELATIONS = ["extends", "depends-on", "contradicts", "similar-to", "references", "related-to"]


def stub(prompt: str) -> str:
    """An answer fixed by the prompt, in fenced JSON."""
    n = sum(prompt.encode()) % 1000
    hubs = re.findall(r"^HUB (.+)$", prompt, re.M)
    if hubs:
        return "```json\n" + json.dumps({"suggested_links": [hubs[n % len(hubs)]]}) + "\n```"
    pairs = re.findall(r"^PAIR (\d+)", prompt, re.M)
    if pairs:
        return "```json\n" + json.dumps([{"pair": int(p), "relation": RELATIONS[(n + int(p)) % len(RELATIONS)], "confidence": ((n + 7 * int(p)) % 11) / 10} for p in pairs]) + "\n```"
    return '```json\n{"candidate_type": "' + ["ConceptSeed", "Project", "Area", "Resource"][n % 4] + '", "reasoning": "stub"}\n```'


def balanced(text: str) -> str | None:
    """The first object or array of balanced brackets; quotes are not minded."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    opens, closes, depth = text[at], {"{": "}", "[": "]"}[text[at]], 0
    for i in range(at, len(text)):
        depth += (text[i] == opens) - (text[i] == closes)
        if not depth:
            return text[at : i + 1]
    return None


def extract_json(text: str) -> str | None:
    """JSON out of an answer: a fence marked so, else any fence that holds an object or array, else the first balanced part."""
    for pattern in (r"```json\s*(.*?)```", r"```\s*([\[{].*?)```"):
        if m := re.search(pattern, text or "", re.S):
            return m[1].strip()
    return balanced(text or "")


def _asking(prompt: str, client: Callable[[str], str], read: Callable[[str], str | None], concurrency: int, per_second: float | None):
    """Asks a batch's prompts, ``concurrency`` at a time in a task; ``failed`` says how one failed."""

    def ask(batches):
        from concurrent.futures import ThreadPoolExecutor

        def one(p):
            try:
                return read(client(p)), None
            except Exception as e:  # one note's failure is not the batch's
                return None, f"{type(e).__name__}: {e}"[:300]

        began, spent = time.monotonic(), 0
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                for at in range(0, b.num_rows, concurrency):
                    part = b.slice(at, concurrency)
                    texts = part[prompt].to_pylist()
                    if per_second:
                        spent += sum(len(t or "") // 4 + 1 for t in texts)
                        time.sleep(max(0.0, spent / per_second - (time.monotonic() - began)))
                    got = list(pool.map(one, texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([a for a, _ in got], pa.string()), pa.array([f for _, f in got], pa.string())], names=[*part.schema.names, "answer", "failed"])

    return ask


def answers(
    df: DataFrame, prompt: str, client: Callable[[str], str] = stub, concurrency: int = CONCURRENCY, read: Callable[[str], str | None] = extract_json, store: AnswerStore | None = None, per_second: float | None = None,
) -> DataFrame:
    """``df`` with ``answer``, what ``read`` makes of the client's answer to the column ``prompt`` (its JSON, if not given); null where it fails.

    The rows stay in their partitions; in each task ``concurrency`` questions are out
    at a time, and no more than ``per_second`` tokens (a quarter of the characters)
    are sent.  With a ``store`` only prompts are asked that it has no answer to.
    """
    from pyspark.sql import types as S

    if store is not None:
        return store.answered(df, prompt, client, concurrency, read, per_second)
    schema = S.StructType([*df.schema, S.StructField("answer", S.StringType()), S.StructField("failed", S.StringType())])
    return df.mapInArrow(_asking(prompt, client, read, concurrency, per_second), schema).drop("failed")


class AnswerStore:
    """Answers kept in a folder of the shared file system, by digest of client name and prompt.

    What is asked is written partition by partition as new files of the store, so a
    run that is killed has kept the tasks that were done; questions that failed are
    not kept and are asked again.
    """

    SCHEMA = "digest string, answer string"

    def __init__(self, spark, folder: str, client_name: str):
        self.spark, self.folder, self.name = spark, folder, client_name
        #: Of the last call: how many were asked, and how many of them failed.
        self.asked = self.failed = 0

    def kept(self) -> DataFrame:
        """``(digest, answer)``, one a digest."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA + ", failed string").parquet(f"{self.folder}/*")
        return rows.filter("failed IS NULL").groupBy("digest").agg(F.max("answer").alias("answer"))

    def answered(self, df: DataFrame, prompt: str, client, concurrency: int = CONCURRENCY, read=extract_json, per_second: float | None = None) -> DataFrame:
        """``df`` with ``answer``; each distinct prompt that has none yet is asked once."""
        sign = F.sha2(F.concat(F.lit(self.name + "\0"), prompt).cast("binary"), 256)
        rows = df.withColumn("_digest", sign)
        new = rows.select(F.col("_digest").alias("digest"), F.col(prompt).alias("prompt")).filter("prompt IS NOT NULL").join(self.kept().select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
        schema = "digest string, prompt string, answer string, failed string"
        asked = new.mapInArrow(_asking("prompt", client, read, concurrency, per_second), schema).select("digest", "answer", "failed")
        batch = f"{self.folder}/batch={uuid.uuid4().hex}"
        asked.write.parquet(batch)
        told = self.spark.read.schema(self.SCHEMA + ", failed string").parquet(batch).agg(F.count("*"), F.count("failed")).first()
        self.asked, self.failed = told
        kept = self.kept().withColumnRenamed("digest", "_digest")
        return rows.join(kept, "_digest", "left").drop("_digest")


def candidates(notes: DataFrame, template: str, client: Callable[[str], str] = stub) -> DataFrame:
    """Classification of inbox notes: ``proposed map<string,string>``."""
    asked = notes.withColumn("prompt", F.replace(F.lit(template), F.lit("{content}"), F.col("rest")))
    return answers(asked, "prompt", client).withColumn("proposed", F.coalesce(F.from_json("answer", "map<string,string>"), F.create_map().cast("map<string,string>"))).drop("prompt", "answer")


def relationships(pairs: DataFrame, notes: DataFrame, client: Callable[[str], str] = stub, batch: int = BATCH) -> DataFrame:
    """``(source, target, relation, confidence)`` of note pairs, asked ``batch`` at a time, of enough confidence."""
    digest = notes.select(F.col("path").alias("p"), T.digest_lines(F.col("content")).alias("d"))
    a = digest.select(F.col("p").alias("source"), F.col("d").alias("ds"))
    b = digest.select(F.col("p").alias("target"), F.col("d").alias("dt"))
    rows = pairs.join(a, "source").join(b, "target")
    # Batches within a hash group, so that no global order is needed.
    rows = rows.withColumn("g", F.pmod(F.xxhash64("source", "target"), F.lit(1 << 20)))
    groups = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("source", "target", "ds", "dt"))).alias("all"))
    groups = groups.select("g", F.explode(F.expr(f"transform(sequence(0, int((size(all) - 1) / {batch})), i -> slice(all, i * {batch} + 1, {batch}))")).alias("part"))
    text = F.array_join(F.transform("part", lambda x, i: F.concat(F.lit("PAIR "), i.cast("string"), F.lit(": "), x["source"], F.lit(" | "), x["ds"], F.lit(" -> "), x["target"], F.lit(" | "), x["dt"])), "\n")
    got = answers(groups.withColumn("prompt", text), "prompt", client)
    found = got.select("part", F.explode(F.from_json("answer", "array<struct<pair:int,relation:string,confidence:float>>")).alias("r"))
    x = F.get("part", F.col("r.pair"))
    return found.select(x["source"].alias("source"), x["target"].alias("target"), "r.relation", "r.confidence").filter(F.col("source").isNotNull() & F.col("relation").isin(RELATIONS) & (F.col("confidence") >= LEAST_CONFIDENCE))


def insights(notes: DataFrame, question: str, client: Callable[[str], str] = stub, most_bytes: int = 6000) -> DataFrame:
    """An answer a note, on at most ``most_bytes`` of it."""
    return answers(notes.select("path", F.concat(F.lit(question + "\n"), T.cut(F.col("content"), most_bytes)).alias("prompt")), "prompt", client).select("path", "answer")


def orphan_link_plan(notes: DataFrame, edges: DataFrame, config: VaultConfig | None = None, client: Callable[[str], str] = stub) -> DataFrame:
    """Orphans with links to the project hubs that a client names for them; without hubs, or where it names none, nothing changes.

    Every question lists all hubs: they are as many as top-level project folders.
    """
    p = F.split("path", "/")
    config = config or VaultConfig()
    left_out = config.all_system_dirs() + config.exclude
    hubs = H.hubs_present(notes).filter(~p[0].isin(left_out) & ~p[0].startswith("."))
    listed = hubs.agg(F.array_join(F.array_sort(F.collect_list(F.expr("concat('HUB ', left(path, length(path) - 3))"))), "\n").alias("hubs")).filter("hubs <> ''")
    own = notes.join(G.orphans(notes, edges), "path", "left_semi").select("path", "content", T.title(F.col("content"), F.col("stem")).alias("title"), T.opening(F.col("content")).alias("opening"))
    prompt = F.concat(F.lit("Which hubs should this note be linked to? Answer {\"suggested_links\": [...]}.\nNote: "), "title", F.lit("\nSummary: "), "opening", F.lit("\n"), "hubs")
    got = answers(own.join(F.broadcast(listed), F.lit(True)).withColumn("prompt", prompt), "prompt", client)
    found = F.from_json("answer", "suggested_links array<string>")["suggested_links"]
    lines = F.array_join(F.transform(found, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    new = F.concat(F.regexp_replace("content", r"(?U)\s+\z", ""), F.lit("\n\n## See Also\n"), lines, F.lit("\n"))
    return edits(got.filter(F.size(found) > 0).withColumn("new_content", new), "orphan linked")


def summarize(notes: DataFrame, most: int = 200, client: Callable[[str], str] = stub, template: str = "Summarize the text in at most {length} characters, key points only.\n{content}") -> DataFrame:
    """``(path, answer)``: a client's answer as it is for every note's body."""
    prompt = F.replace(F.lit(template.replace("{length}", str(most))), F.lit("{content}"), F.col("body"))
    return answers(notes.select("path", prompt.alias("prompt")), "prompt", client, read=str).select("path", "answer")


def ping(client: Callable[[str], str], prompt: str = "Reply with OK.") -> dict:
    """Whether a client answers, how long it takes, and what it says or how it fails; asked once, on the driver."""
    began = time.monotonic()
    try:
        said, ok = client(prompt), True
    except Exception as e:
        said, ok = f"{type(e).__name__}: {e}", False
    return {"ok": ok, "seconds": time.monotonic() - began, "answer": said}


def normalized_tags(notes: DataFrame, client: Callable[[str], str] | None = None) -> DataFrame:
    """The plan of a whole tag normalization: clusters of tags, those a client adds, and the lines rewritten by them."""
    docs = tags.tag_docs(notes)
    member = tags.membership(docs).select("tag", "canonical")
    if client is not None:
        spark = notes.sparkSession
        rows = [(x["canonical"], [a for a in x.get("aliases") or [] if isinstance(a, str)]) for x in suggested_hierarchy(docs, client) if isinstance(x["canonical"], str)]
        more = tags.merged_suggestions(tags.clusters(docs), spark.createDataFrame(rows, "canonical string, aliases array<string>"))
        added = more.select("canonical", F.explode("aliases").alias("tag")).groupBy("tag").agg(F.min("canonical").alias("named"))
        member = member.join(added, "tag", "left").select("tag", F.coalesce("named", "canonical").alias("canonical"))
    return tags.normalization_plan(notes, member)


def suggested_hierarchy(tag_docs: DataFrame, client: Callable[[str], str] = stub, least: int = 2, batch: int = 10_000) -> list[dict]:
    """Clusters proposed for all tags of ``least`` documents, asked ``batch`` at a time by name, on the driver; none from an answer that is no list."""
    rows = tag_docs.groupBy("tag").count().filter(F.col("count") >= least).orderBy("tag").toLocalIterator()
    out: list[dict] = []
    while tags := [r.tag for r in islice(rows, batch)]:
        try:
            got = json.loads(extract_json(client("Group these tags as JSON [{canonical, aliases}].\n" + "\n".join(tags))) or "[]")
        except Exception:
            continue
        out += [x for x in got if isinstance(x, dict) and "canonical" in x] if isinstance(got, list) else []
    return out
