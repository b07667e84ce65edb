import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bytebpe as b
from tests.llm.helpers import AWKWARD, SF, as_dict, documents, saved

tiktoken = pytest.importorskip("tiktoken")
REPLAY = b.codec(b.default_ranks(), b.default_pattern())
LIBRARY = tiktoken.Encoding("own", pat_str=b.default_pattern(), mergeable_ranks=REPLAY.replay.ranks, special_tokens={})
TEXTS = [*AWKWARD, "<|endoftext|> it's we'll", "aaaaaaaaaaaaaaaaaaaaaaa" * 30, "emoji 😀😀 ​", "0123456789 " * 3]


def brute(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return {
        "n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest(),
    }


def test_equals_library(spark, tmp_path):
    for folder, texts in ((saved(documents(spark, TEXTS), tmp_path), dict(enumerate(TEXTS))), (SF, {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})):
        got = as_dict(b.op8_byte_bpe(spark, folder))
        assert len(got) == len(texts)
        for i, t in texts.items():
            assert {k: v for k, v in got[i].items() if k != "doc_id"} == brute(t), t
    assert b.op8_byte_bpe(spark, saved(documents(spark, TEXTS).limit(0), tmp_path / "e")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab e", max_size=60)), max_size=8))
def test_blocks_of_any_texts(texts):
    cut, ids_of = REPLAY.block(texts)
    for text, pieces in zip(texts, cut):
        ids = [i for p in pieces for i in ids_of[p]]
        assert ids == LIBRARY.encode_ordinary(text)
        assert b"".join(REPLAY.replay.token[i] for i in ids) == text.encode()


def test_runs_of_few_letters_and_long_texts():
    rnd = random.Random(3)
    texts = ["a" * n for n in range(1, 50)] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 200))) for letters in ("ab", " \n\t=-#", "xX1.") for _ in range(200)]
    texts += ["q" * 50_000, " ".join(f"w{i}" for i in range(400_000)), "\n" * 5000 + "x"]
    cut, ids_of = REPLAY.block(texts)
    for text, pieces in zip(texts, cut):
        assert [i for p in pieces for i in ids_of[p]] == LIBRARY.encode_ordinary(text), text[:50]


def test_lower_ranks_made_by_a_merge_go_first():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 280, b"cd": 290, b"xy": 270}
    lib = tiktoken.Encoding("tiny", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = ["abcd", "abcabcd", "cdabcab", "xyabcdxy", "ababc"]
    assert b.MergeReplay(ranks).encode([w.encode() for w in words]) == [lib.encode_ordinary(w) for w in words]
