import hashlib
import re

import pytest

from quillspark.llm import decontaminate as d
from tests.llm.helpers import AWKWARD, SF, as_dict, documents, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        if item is None or not x:
            continue
        for win in {tuple(x[i : i + 13]) for i in range(max(1, len(x) - 12))}:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found.add(str(item))
    return {
        "n_words": len(w), "n_hit": len(hit), "n_items": len(found),
        "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit) and 20 * len(hit) >= len(w),
    }


PASSAGE = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, PASSAGE), (2, "Short-item, three!"), (10, PASSAGE), (3, None), (4, " .. "), (None, "null id"), (5, "a a a a a a a a a a a a a"), (2, "Short-item, three!"), (7, "漢字 ÀÉ")]
TEXTS = [*AWKWARD, f"pre {PASSAGE} post", PASSAGE.upper() + " x" * 500, " ".join(PASSAGE.split()[3:16]), " ".join(PASSAGE.split()[3:15]), "short item three short item three short", "a " * 40, "null id", "漢字 àé 漢字 ÀÉ"]


@pytest.mark.parametrize("most", [200_000, 3])
def test_equals_brute_force(spark, tmp_path, most):
    saved(spark.createDataFrame(ITEMS, "item_id long, text string"), tmp_path, "benchmark")
    saved(documents(spark, TEXTS), tmp_path)
    docs, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    got = as_dict(d.contained_windows(docs, items, most_windows=most))
    for i, t in enumerate(TEXTS):
        want = brute(t, ITEMS)
        assert (got[i]["n_words"], got[i]["n_hit"], len(got[i]["items"])) == (want["n_words"], want["n_hit"], want["n_items"]), t


def test_query_over_the_whole_table(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = as_dict(d.op7_decontaminate(spark, SF))
    picked = [i for i in got if got[i]["n_hit"]] + sorted(docs)[:40]
    for i in picked:
        assert {k: v for k, v in got[i].items() if k != "doc_id"} == brute(docs[i], items)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    saved(none, tmp_path, "benchmark")
    saved(documents(spark, ["a b"]), tmp_path)
    assert [r.n_hit for r in d.op7_decontaminate(spark, str(tmp_path)).collect()] == [0]
    saved(documents(spark, ["a b"]).limit(0), tmp_path)
    assert d.op7_decontaminate(spark, str(tmp_path)).count() == 0
