import pathlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillspark.llm import bytebpe, langid  # noqa: E402
from tests.llm import test_bytebpe, test_decontaminate, test_jaccard  # noqa: E402
from tests.llm.helpers import SF  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("p") / str(i))
        f(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, {r.doc_id: r.asDict() for r in docs.collect()}, {r.doc_id: r.asDict() for r in new.collect()}))
        assert i == len(corpus_pipeline.STAGES) - 1 or set(new.columns) >= set(corpus_pipeline.COLUMNS)
        docs = new
    return {name: (a, b) for name, a, b in out}


def test_language_keeps_clean_documents(stages):
    before, after = stages["language_id"]
    assert all(after[i] == before[i] for i in after) and len(after) > 0.95 * len(before)
    assert not any(r["lang"] is None for i, r in before.items() if i not in after)


def test_language_writes_no_texts_between(spark):
    from quillspark.llm.common import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    docs, before = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), size()
    foreign = spark.createDataFrame([(10**6 + i, t, None, "x", len(t)) for i, t in enumerate([FOREIGN[0], "", "1 2", FOREIGN[0]])] + [(10**6 + 4, None, None, "x", 0)], docs.select(*corpus_pipeline.COLUMNS).schema)
    left = corpus_pipeline.language(spark, docs.select(*corpus_pipeline.COLUMNS).union(foreign), SF)
    assert size() - before < 0.05 * pathlib.Path("/root/testdata/sf0.01/documents.parquet").stat().st_size
    assert left.columns == corpus_pipeline.COLUMNS and left.filter("doc_id >= 1000000").count() == 0 and left.count() > 0.95 * docs.count()


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    groups = test_jaccard.brute(list(before), [r["text"] for r in before.values()], 5, 8)
    assert set(after) == {i for i, (n, c) in groups.items() if c == i}


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    joined = " ".join(" ".join(test_decontaminate.words(t)) for _, t in items)
    maybe = [i for i, r in before.items() if any(" ".join(w) in joined for w in zip(*(test_decontaminate.words(r["text"])[k:] for k in range(13))))]
    gone = {i for i in maybe if test_decontaminate.brute(before[i]["text"], items)["contaminated"]}
    assert set(before) - set(after) == gone


def test_secrets_are_masked_and_clean_texts_kept(stages):
    before, after = stages["secret_scan"]
    assert before.keys() == after.keys()
    from tests.llm.test_secrets import PATTERNS, brute

    for i, r in before.items():
        want, spans = brute(r["text"])
        if spans:
            assert after[i]["text"] != r["text"] and after[i]["n_chars"] == len(after[i]["text"])
            for kind, (p, keep) in PATTERNS.items():
                assert not any(keep(m) for m in p.finditer(after[i]["text"])), after[i]["text"]


def test_ids(stages):
    before, after = stages["byte_bpe"]
    for i, r in before.items():
        assert after[i]["ids"] == test_bytebpe.LIBRARY.encode_ordinary(r["text"])


def test_ids_are_made_of_few_texts_at_a_time(spark, monkeypatch):
    """However large the session's batches are: a task holds a batch on both sides of the pipe."""
    import pyarrow as pa

    def sizes(docs, *_, **__):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")

    monkeypatch.setattr(bytebpe, "encode_decode", sizes)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(cast(id as string), 3000)").alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(9).alias("n_chars"))
    got = [r.n for r in corpus_pipeline.token_ids(spark, docs, SF).collect()]
    assert sum(got) > 30 << 20 and max(got) < 1 << 20


def test_near_duplicates_leave_no_copy_of_the_texts(spark):
    from quillspark.llm.common import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.rglob("blocks-*"))
    left = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert not set(folder.rglob("blocks-*")) - before and left.count() > 0


def test_run_equals_stages(spark, stages):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: r["ids"] for i, r in stages["byte_bpe"][1].items()}
    assert langid.UND == "und" and bytebpe.KINDS


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


FOREIGN = [
    "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "人人 生而 自由 在 尊严 和 权利 上 一律 平等 他们 赋有 理性 和 良心 并 应以 兄弟 关系 的 精神 相 对待",
    "xqzk vbnmw tgrfk zzxcv plkjh qwrtp bvcxz mnbtr kjhgf wqrtz xcvbn lkjhg ptrwq zxcvb nmlkj hgfds qwxzt rtplk bnmvc xzqwk",
]


@pytest.mark.parametrize("languages", [("de",), ("de", "fr"), ("de", "en", "es", "fr")])
def test_foreign_texts_and_gibberish_go_and_mixed_texts_stay(spark, languages):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS).filter(F.col("lang").isin(*languages))
    some = {r.lang: r.text for r in docs.filter("n_chars BETWEEN 1000 AND 3000").orderBy("doc_id").collect()}
    mixed = " ".join(some[x][:800] for x in languages)
    planted = spark.createDataFrame([(10**6 + i, t, None, "x", len(t)) for i, t in enumerate([*FOREIGN, mixed])], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(planted), SF).select("doc_id").collect()}
    assert [i for i in range(len(FOREIGN)) if 10**6 + i in kept] == [] and 10**6 + len(FOREIGN) in kept
    print(languages, docs.count(), len(kept) - 1)
    assert len(kept) - 1 > 0.95 * docs.count()


def test_awkward_rows_in_every_stage(spark, tmp_path):
    """Nulls, repeats, very long and empty texts, and columns whose names clash with those the stages use."""
    import hashlib

    from tests.llm.helpers import AWKWARD

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    clean = [r.text for r in docs.filter("lang = 'en' AND n_chars BETWEEN 800 AND 3000").orderBy("doc_id").limit(40).collect()]
    words = " ".join(clean).split()
    long = " ".join(words[(i * i) % len(words)] for i in range(150_000))
    odd = [(10**6 + i, t, None, None, None) for i, t in enumerate(AWKWARD)] + [(None, clean[0] + " one more", "en", "s", 1), (2 * 10**6, long, "en", "s", 1), *[(2 * 10**6 + 1, " ".join(words[i * 7 % len(words)] for i in range(400)), "en", "s", 1)] * 2]
    clash = {c: F.lit("x") for c in ("lang_pred", "score", "fits", "component_id", "n_hit", "n_words", "bad_id", "spans", "ids", "row", "kind", "node", "sig", "n")}
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns(clash)
    none = rows.filter(F.col("text").isNull() | (F.trim("text") == "")).count()
    assert none >= 3
    for name, stage in corpus_pipeline.STAGES:
        for given in (rows, rows.limit(0)):
            stage(spark, given, SF).write.mode("overwrite").parquet(f"{tmp_path}/{name}{given is rows}")
        got = spark.read.parquet(f"{tmp_path}/{name}True")
        assert spark.read.parquet(f"{tmp_path}/{name}False").count() == 0
        if name != "byte_bpe":
            assert got.columns == corpus_pipeline.COLUMNS
            kept = {}
            for r in got.collect():
                kept.setdefault(r.doc_id, []).append(r.text)
            assert kept[2 * 10**6] == [long] and None in kept
            assert len(kept[2 * 10**6 + 1]) == (1 if name == "near_duplicates" else 2)
            empty = sum(t is None or not t.strip(" \t\n\x0b\x0c\r") for x in kept.values() for t in x)
            assert empty == 0 if name == "language_id" else empty >= 3
        else:
            sha = {r.doc_id: r.decoded_sha256 for r in got.collect()}
            assert got.count() == rows.count() and sha[2 * 10**6] == hashlib.sha256(long.encode()).hexdigest() and sha[10**6] == hashlib.sha256(b"").hexdigest()
