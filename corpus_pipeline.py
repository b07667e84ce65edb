"""From raw documents to token ids: five stages over the whole table, each on all its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``
(the last one token ids); between stages rows are written as Parquet and read
again.

Defined cases, for every stage: columns beside those of ``documents`` are dropped,
whatever their names; texts of any length are taken whole; rows are judged one by
one, so repeated rows share their fate, but for near duplicates, of which one row
stays; a null doc_id is a document like others, and none is another's copy; an
empty table stays empty.  Null, empty and letterless texts are of no language and
go in the first stage; where a later one is given them, they stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bytebpe, decontaminate, jaccard, langid, secrets
from quillspark.llm.common import settings, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Whole texts go to Python beside a model: few at a time.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Merge replay takes as long a byte in small blocks (0.55 s a MB at 1 MB, 0.52 at 4), and about 25 to 40 times a block's memory.
SMALLER = {"spark.sql.execution.arrow.maxBytesPerBatch": str(512 << 10)}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay, also those that mix several: those whose n-grams are known as often as labelled texts' are.

    The model learns as in the operator's query. Where no row is labelled nothing can be rejected.
    Verdicts are on texts alone, so only the digests of rejected ones are written between, and no texts.
    """
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.select(*COLUMNS)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    judged = langid.identify(docs.select(digest.alias("gone"), "text"), model, fits=True, text=False)
    with settings(spark, SMALL):
        gone = written(judged.filter((F.col("lang_pred") == langid.UND) | ~F.col("fits")).select("gone").distinct(), "gone")
    return docs.select(*COLUMNS).join(gone, digest == F.col("gone"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles of Jaccard similarity 0.8 or more, the document of smallest id stays.

    Documents without words and with a null id link with nothing and stay; of repeated rows of one id one stays.
    """
    groups = written(jaccard.jaccard_groups(docs, size=5, tenths=8), "groups")
    gone = groups.filter("component_id IS NOT NULL AND component_id <> doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    repeated = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    twice = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).union(twice.select(*COLUMNS))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark windows stay."""
    found = decontaminate.contained_windows(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.select(*COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti").select(*COLUMNS)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every span of a secret, linked ones too, is replaced by its kind in brackets."""
    return secrets.masked(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, with the digest of what they decode to.

    Written here, so that texts come to the tasks few at a time, whatever the session's batches are.
    """
    coded = bytebpe.encode_decode(docs.select(*COLUMNS), ("n_tokens", "ids", "decoded_sha256"), keep=["doc_id", "lang", "source", "n_chars"])
    with settings(spark, SMALLER):
        return written(coded, "ids")


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("secret_scan", secrets_masked),
    ("byte_bpe", token_ids),
]

#: Similarity groups, a learned model and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
