import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import tokenfiles as t
from tests.llm.helpers import AWKWARD, SF, as_dict, documents, saved

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
TEXTS = [*AWKWARD, "a<|endoftext|>b <|startoftext|>", "x \x01 y\x01z", "it's we'll DON'T", "é é ́ x", "a\u0085b c　d", "İstanbul ΣΑΣ ﬁ", "\x01", "1234 ½ ²", "<|STARTOFTEXT|> É", "ÀÖ×Þ\xa0\x85x", "Latin é " * 200_000]


def brute(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(got, ids, texts):
    start = 0
    for i, text in zip(ids, texts):
        want = brute(text)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes())), text
        start += len(want)


def test_query_equals_library(spark, tmp_path):
    check(as_dict(t.op1_token_files(spark, saved(documents(spark, TEXTS), tmp_path))), range(len(TEXTS)), TEXTS)
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    check(as_dict(t.op1_token_files(spark, SF)), [r.doc_id for r in rows], [r.text for r in rows])
    assert t.op1_token_files(spark, saved(documents(spark, TEXTS).limit(0), tmp_path / "e")).count() == 0


def test_stems_are_encoded_once():
    """Marks at a chunk's end, after all that they may not be parted from; a stem with many endings goes to the library once."""
    rng = np.random.default_rng(3)
    pieces = ["a", "zq", "é", "7", "½", "'s", "'re", "'", "’", "ª", "²", "µ", "\xad", "\xb4", "«", "_", "-", "***", "&", ".", ",", "\"", "()", "\x85", "ÿ"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 7))) + " x" for _ in range(3000)]
    c = t.ChunkCoder(FILE, most=500, most_stems=300)
    for at in range(0, 3000, 300):
        for text, got in zip(texts[at : at + 300], c.block(texts[at : at + 300])):
            assert got == brute(text)[:-1].tobytes(), text
    c, asked = t.ChunkCoder(FILE), []
    encode = c._encode
    c._encode = lambda chunks, *rest: (asked.extend(chunks), encode(chunks, *rest))
    for end in ("", ",", ".", "!?", "***"):
        c.block([" ".join(f"stem{chr(97 + k)}{end}" for k in range(26))])
    assert len(asked) == len(set(asked)) and sum(x.startswith("stem") for x in asked) == 26


def test_only_distinct_stems_become_strings():
    """Folded chunks are told apart as columns: the library is asked for a block's distinct stems, those of letters alone in one call, with ids of every text as the library's."""
    c, calls = t.ChunkCoder(FILE), []
    ids = c._ids
    c._ids = lambda lib, text: (calls.append((lib is c.letters, text)), ids(lib, text))[1]
    texts = ["Été stem, stem! stem7 \xaa\xb5 \xb2... ,", "", "stem  stem\n\nétÉ?! it's", "a\xa0b,", "stem," * 3, *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}," for i in range(600))]
    assert c.block(texts) == [brute(x)[:-1].tobytes() for x in texts]
    letters = [x.split(" ") for fast, x in calls if fast]
    assert len(letters) == 1 and len(letters[0]) == len(set(letters[0])) and {"stem", "été", "ªµ"} < set(letters[0])
    assert not any("stem" in x.split(" ") for fast, x in calls if not fast)
    calls.clear()
    assert c.block(texts) == [brute(x)[:-1].tobytes() for x in texts] and not calls


def test_files_and_random_access(spark, tmp_path):
    folder = f"file://{tmp_path}/f"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    manifest = t.write_token_files(docs, folder, FILE, shard_bytes=30_000)
    assert len(manifest["shards"]) > 1 and manifest["id_bytes"] == 2
    rows = {r.doc_id: r.text for r in docs.collect()}
    shard = t.Shard(folder, manifest["shards"][1]["name"])
    for i in shard.ids[::7].tolist():
        assert (shard.document(i) == brute(rows[i])).all()
    assert shard.document(10**9) is None
    got = t.read_token_files(spark, folder, manifest)
    assert {r.doc_id: r.ids for r in got.collect()} == {i: brute(x).tolist() for i, x in rows.items()}


def test_null_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (None, "x y z"), (2, "b"), (1, None)], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.n_tokens) for r in t.op1_token_files(spark, saved(df, tmp_path)).orderBy("start").collect()]
    assert got == [(None, 0, 4), (1, 4, 1), (2, 5, 2), (2, 7, 2)]


def test_tokenizers_that_keep_white_space_get_whole_texts():
    file = public_tokenizers.path("byte_bpe_50k.json")
    lib, coder = Tokenizer.from_file(file), t.ChunkCoder(file)
    for text in TEXTS:
        assert coder.block([text or ""])[0] == np.array(lib.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
