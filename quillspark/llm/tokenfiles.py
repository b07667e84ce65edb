"""Token-id output: shared-dictionary zstandard files with an offset index.

Every document's ids are serialized (little-endian, two bytes where the
vocabulary allows, else four) and compressed as a frame of its own against one
zstandard dictionary, trained on a bounded sample of such arrays: of at most 1,500
documents of 1 to 20,000 characters, first by a hash of the id, and 8 MB of ids.
Where a table has too few of them to train on, the dictionary is their plain
content; files are read back the same way.  A shard holds

    magic, sha-256 of the dictionary, bytes per id, frames ..., index, footer

where the index gives doc ids, frame offsets and token counts, so that a short
document is read with the footer, the index and one frame.  Shards are written
in ascending doc_id order by a range partitioning of the compressed frames;
texts are never shuffled.

Encoding calls the tokenizers library once for each distinct white-space-free
chunk of a block where the tokenizer drops white space and nothing in it reaches
across (tried on probes when it is loaded), so that a text's ids are its chunks'
ids in a row; tests compare with whole texts.  Other tokenizers get whole texts.
A bounded two-generation table keeps chunks (or their stems) between blocks.

Defined cases: a null text is empty and holds the end id alone; null doc ids
come first; rows of equal doc_id follow by their number of ids and their bytes;
repeated rows repeat; extra columns are ignored; an empty table gives no shards; a
text of any length is encoded whole, chunk by chunk, and is one frame.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import batch, local_path, shared_folder, slices, table, trim_memory, written

MAGIC = b"QSTOKEN1"
END_ID = 1
NULL_ID = -(1 << 63)  # stands for a null doc_id in an index
#: A chunk that parts others in one call; it always gives one id of its own.
PART = "\x01"


#: A tokenizer that parts texts so parts a letter or digit from a mark after it, whatever else stands around them.
PARTED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Marks that are taken off a chunk's end.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())

#: What the fast way below stands in for: composition, white space to one space, lower case.
FOLDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class ChunkCoder:
    """ids of texts as little-endian uint32 bytes, by way of a table of chunks.

    Where the tokenizer's normalizer is ``FOLDS``, texts of characters below U+0100
    (which composition leaves alone) are put in lower case before they are cut, and
    their chunks encoded without a normalizer.  A tokenizer that keeps white space,
    or joins across it, gets whole texts.  A new chunk that ends with marks is put
    together from its stem and them, where the tokenizer parts texts by ``PARTED``:
    stems are far fewer than chunks, and have a table of their own.  There chunks are
    cut and told apart as Arrow columns, so only a block's distinct stems become Python
    strings, and stems of letters alone, which nothing parts, are encoded by white space.
    """

    def __init__(self, file: str, most: int = 100_000, most_stems: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            raw = json.load(f)
        self.lib = Tokenizer.from_file(file)
        self.folds = (raw.get("normalizer") or {}).get("normalizers") == FOLDS
        self.plain = Tokenizer.from_str(json.dumps(raw | {"normalizer": None})) if self.folds else self.lib
        first, *then = (raw.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.stems = self.folds and [first.get(k) for k in ("pattern", "behavior", "invert")] == [{"Regex": PARTED}, "Removed", True]
        self.letters, suffix = None, raw["model"].get("end_of_word_suffix")
        if self.stems and suffix:
            spaced = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *then]}
            self.letters = Tokenizer.from_str(json.dumps(raw | {"normalizer": None, "pre_tokenizer": spaced, "added_tokens": []}))
            vocabulary = raw["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.part = self._ids(self.lib, PART)
        self.marks = [t["content"] for t in raw.get("added_tokens") or []]
        ab, a, b = (self._ids(self.lib, x) for x in ("Ab, \n\n cd", "Ab,", "cd"))
        self.cuts = ab == a + b and not self._ids(self.lib, " \n ") and self._ids(self.lib, " Ab, ") == a
        self.most, self.most_stems, self.young_stems, self.old_stems = most, most_stems, {}, {}
        self.tables: dict[bool, list[dict[str, bytes]]] = {x: [{}, {}] for x in (False, True)}  # young and old chunks, by whether they are folded

    @staticmethod
    def _ids(lib, text: str) -> list[int]:
        return lib.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, chunks: list[str], folded: bool, young: dict[str, bytes], per_call: int = 200) -> None:
        """Ids of new chunks: many in one string, parted by a chunk that none of them can contain."""
        lib = self.plain if folded else self.lib
        whole = lambda c: PART in c or any(m in c for m in self.marks)
        alone = [c for c in chunks if whole(c)] if not folded else []  # texts with either are not folded
        rest = [c for c in chunks if not whole(c)] if alone else chunks
        if folded and self.letters:
            words, rest = [c for c in rest if c.isalpha()], [c for c in rest if not c.isalpha()]
            for i in range(0, len(words), 5000):
                g = words[i : i + 5000]
                ids = np.array(self._ids(self.letters, " ".join(g)), "<u4")
                ends = np.flatnonzero(self.last[ids])
                if len(ends) != len(g) or ends[-1] != len(ids) - 1:
                    alone += g
                    continue
                raw, edges = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
                young.update(zip(g, [raw[s:t] for s, t in zip(edges, edges[1:])]))
        for i in range(0, len(rest), per_call):
            g = rest[i : i + per_call]
            ids = np.array(self._ids(lib, f" {PART} ".join(g)), "<u4")
            cuts = np.flatnonzero(ids == self.part[0]) if len(self.part) == 1 else ()
            if len(cuts) != len(g) - 1:
                alone += g
                continue
            raw, edges = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
            ends = [*(4 * cuts).tolist(), len(raw)] if len(g) > 1 else [len(raw)]
            young.update(zip(g, [raw[s:t] for s, t in zip(edges, ends)]))
        for c in alone:
            young[c] = np.array(self._ids(lib, c), "<u4").tobytes()

    def _by_stems(self, texts: list[str]) -> list[bytes]:
        """Ids of folded texts, each chunk's those of its stem and of the marks at its end."""
        import pyarrow.compute as pc

        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        chunks = words.values.dictionary_encode()
        pieces = stems_and_ends(chunks.dictionary).dictionary_encode()
        if len(self.young_stems) > self.most_stems:
            self.young_stems, self.old_stems = {}, self.young_stems
        stems, old = self.young_stems, self.old_stems
        asked = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), " ")[0].as_py().split(" ")  # none holds a space
        new = [p for p in asked if p not in stems]
        stems.update((p, old[p]) for p in new if p in old)
        self._encode([p for p in new if p not in old], True, stems)
        ids = [stems[p] for p in asked]
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids])
        flat, sizes = gathered(flat, sizes, pieces.indices.to_numpy())
        flat, sizes = gathered(flat, sizes[::2] + sizes[1::2], chunks.indices.to_numpy())
        ends = np.append(0, np.cumsum(sizes))[words.offsets.to_numpy()].tolist()
        return [flat[i:j].tobytes() for i, j in zip(ends, ends[1:])]

    def _folded(self, text: str) -> str | None:
        """The text in lower case, if that and no more is what the normalizer would do before it is cut."""
        if not self.folds or PART in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        low = text.lower()
        return None if any(m.lower() in low for m in self.marks) else low

    def block(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [np.array(self._ids(self.lib, t), "<u4").tobytes() for t in texts]
        out: list[bytes] = [b""] * len(texts)
        low = [self._folded(t) for t in texts]
        for folded in (False, True):
            which = [i for i, x in enumerate(low) if (x is not None) == folded]
            if not which:
                continue
            if folded and self.stems:
                for i, x in zip(which, self._by_stems([low[i] for i in which])):
                    out[i] = x
                continue
            if len(self.tables[folded][0]) > self.most:
                self.tables[folded] = [{}, self.tables[folded][0]]
            young, old = self.tables[folded]
            cut = [(low[i] if folded else texts[i]).replace("\n", " ").split(" ") for i in which]
            new = set().union(*cut).difference(young)
            kept = new & old.keys()
            young.update((c, old[c]) for c in kept)
            self._encode(list(new - kept), folded, young)
            get = young.__getitem__
            for i, c in zip(which, cut):
                out[i] = b"".join(map(get, c))
        return out


#: Characters below U+0100 that are letters or digits.
ALNUM = np.array([chr(c).isalnum() for c in range(256)])


def stems_and_ends(chunks: pa.StringArray) -> pa.StringArray:
    """Of each chunk of characters below U+0100 its stem and then the marks at its end, none where no letter or digit is before them: the same bytes with more offsets."""
    import pyarrow.compute as pc

    edges = np.frombuffer(chunks.buffers()[1], "<i4")[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
    ends = edges[:-1] + pc.binary_length(pc.ascii_rtrim(chunks, characters=MARKS)).to_numpy()
    some = np.flatnonzero(ends > edges[:-1])
    last = data[ends[some] - 1].astype(np.int64)
    wide = np.flatnonzero(last >= 0x80)  # the second of two bytes
    last[wide] = (data[ends[some[wide]] - 2].astype(np.int64) & 3) << 6 | last[wide] & 0x3F
    cut = np.zeros(len(chunks), bool)
    cut[some] = ALNUM[last]
    both = np.empty(2 * len(chunks) + 1, "<i4")
    both[::2], both[1::2] = edges, np.where(cut, ends, edges[1:])
    return pa.StringArray.from_buffers(2 * len(chunks), pa.py_buffer(both), chunks.buffers()[2])


def gathered(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that lie in ``flat`` one after another, those that ``at`` names in its order, and their sizes."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends + n, n)], n


_coders: dict[str, ChunkCoder] = {}


def coder(file: str) -> ChunkCoder:
    if file not in _coders:
        _coders[file] = ChunkCoder(file)
    return _coders[file]


def trained(samples: list[bytes], size: int = 112_640) -> bytes:
    """A zstandard dictionary of serialized id arrays; plain content of the samples where there are too few to train."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, threads=1).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or b"no samples")[:size].ljust(8, b"\0")


def compressor(dictionary: bytes, level: int = 3):
    """Digests the dictionary once; without that every frame would."""
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False)


def decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def id_bytes(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def encoded(docs: DataFrame, file: str, dictionary: bytes | None, width: int, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, n_tokens, frame)``: the ids with the end id, serialized and compressed (raw without a dictionary)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        c = coder(file)
        zip_ = compressor(shared.value).compress if shared.value else bytes
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                ids = [np.frombuffer(x + end, "<u4") for x in c.block([x or "" for x in b["text"].to_pylist()])]
                yield batch(schema, doc_id=b["doc_id"], n_tokens=[len(x) for x in ids], frame=[zip_(x.astype(f"<u{width}").tobytes()) for x in ids])
        trim_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def sample_arrays(docs: DataFrame, file: str, width: int, rows: int = 1500, most_bytes: int = 8 << 20) -> list[bytes]:
    """Serialized ids of at most ``rows`` documents, those first by a hash of the id, cut at ``most_bytes`` in all."""
    first = docs.select("doc_id", F.length("text").alias("n")).filter("n BETWEEN 1 AND 20000").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.join(F.broadcast(first.distinct()), "doc_id", "left_semi")
    out, held = [], 0
    for r in encoded(some, file, None, width).orderBy(F.xxhash64("doc_id"), "n_tokens", "frame").limit(rows).toLocalIterator():
        out.append(bytes(r.frame))
        held += len(out[-1])
        if held > most_bytes:
            break
    return out


def write_token_files(docs: DataFrame, folder: str, file: str, end_id: int = END_ID, shard_bytes: int = 48 << 20) -> dict:
    """Encode ``docs(doc_id, text)`` into shards under ``folder``; returns the manifest, also written there.

    The manifest lists the shards in order with their documents and ids before them.
    """
    from tokenizers import Tokenizer

    width = id_bytes(Tokenizer.from_file(file).get_vocab_size())
    dictionary = trained(sample_arrays(docs, file, width))
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, path = local_path(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary-{digest}.zdict", compression=None) as f:
        f.write(dictionary)
    frames = written(encoded(docs, file, dictionary, width, end_id), "frames")
    total = frames.agg(F.sum(F.length("frame") + 24)).first()[0] or 0
    n = max(1, -(-int(total) // shard_bytes), min(12, -(-int(total) // (1 << 20))))

    def write(batches):
        from pyspark import TaskContext

        _coders.clear()  # encoding is over in this worker
        trim_memory()
        fs, path = local_path(folder)
        ids, sizes, counts, name = [], [], [], f"shard-{uuid.uuid4().hex}.qst"
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(MAGIC + bytes.fromhex(digest) + struct.pack("<Q", width))
            data = b["frame"].to_pylist()
            out.write(b"".join(data))
            ids += [NULL_ID if x is None else x for x in b["doc_id"].to_pylist()]
            sizes += [len(x) for x in data]
            counts += b["n_tokens"].to_pylist()
        if out is None:
            return
        offsets = 48 + np.concatenate([[0], np.cumsum(sizes)])
        for a, kind in ((ids, "<i8"), (offsets, "<u8"), (counts, "<u8")):
            out.write(np.asarray(a, kind).tobytes())
        out.write(struct.pack("<QQQ", int(offsets[-1]), len(ids), sum(counts)) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "docs": [len(ids)], "tokens": [sum(counts)]}, schema=schema)

    schema = pa.schema([("part", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
    ordered = frames.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
    shards = written(ordered.mapInArrow(write, "part long, name string, docs long, tokens long"), "shards")  # a row a shard: what retried tasks left behind is not listed
    manifest = {"dictionary": digest, "id_bytes": width, "end_id": end_id, "shards": []}
    start = 0
    for r in shards.orderBy("part").collect():
        manifest["shards"].append({"name": r.name, "docs": r.docs, "tokens": r.tokens, "start": start})
        start += r.tokens
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """Random access to one shard: reads the footer and the index, then single frames."""

    def __init__(self, folder: str, name: str):
        self.fs, path = local_path(folder)
        self.file = self.fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        at, self.docs, self.tokens = struct.unpack("<QQQ", self.file.read_at(24, size - 32))
        head = self.file.read_at(48, 0)
        if head[:8] != MAGIC or self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{name} is no token shard")
        self.digest, self.width = head[8:40].hex(), struct.unpack("<Q", head[40:48])[0]
        with self.fs.open_input_stream(f"{path}/dictionary-{self.digest}.zdict", compression=None) as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.digest:
            raise ValueError("the dictionary is not the one the shard names")
        raw, n = self.file.read_at(24 * self.docs + 8, at), self.docs
        self.ids = np.frombuffer(raw, "<i8", n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 8 * n).astype(np.int64)
        self.counts = np.frombuffer(raw, "<u8", n, 16 * n + 8).astype(np.int64)
        self.unzip = decompressor(dictionary).decompress

    def frames(self, i: int, j: int) -> list[np.ndarray]:
        """Ids of documents i to j, uint32."""
        at = self.offsets[i : j + 1]
        raw = self.file.read_at(int(at[-1] - at[0]), int(at[0]))
        return [np.frombuffer(self.unzip(raw[s:e], max_output_size=int(n) * self.width), f"<u{self.width}").astype("<u4") for s, e, n in zip(at - at[0], at[1:] - at[0], self.counts[i:j])]

    def document(self, doc_id: int) -> np.ndarray | None:
        i = int(np.searchsorted(self.ids, doc_id))
        return self.frames(i, i + 1)[0] if i < self.docs and self.ids[i] == doc_id else None


def read_token_files(spark: SparkSession, folder: str, manifest: dict, columns=("ids",), most: int = 512) -> DataFrame:
    """``(doc_id, start, n_tokens)`` and of ``ids`` and ``ids_crc32`` the chosen, one row a document, a task a shard."""
    kinds = {"ids": (pa.list_(pa.int64()), "array<long>"), "ids_crc32": (pa.int64(), "long")}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *((c, kinds[c][0]) for c in columns)])
    rows = [(n, s["name"], s["start"]) for n, s in enumerate(manifest["shards"])]
    shards = spark.createDataFrame(rows, "n long, name string, start long").repartitionByRange(max(1, len(rows)), "n")

    def read(batches):
        for b in batches:
            for name, start in zip(b["name"].to_pylist(), b["start"].to_pylist()):
                s = Shard(folder, name)
                if s.digest != manifest["dictionary"]:
                    raise ValueError(f"{name} was written with another dictionary")
                starts = start + np.concatenate([[0], np.cumsum(s.counts)])
                for i in range(0, s.docs, most):
                    j = min(i + most, s.docs)
                    ids = s.frames(i, j)
                    made = {"ids": lambda: ids, "ids_crc32": lambda: [zlib.crc32(x.tobytes()) for x in ids]}
                    yield batch(schema, doc_id=[None if x == NULL_ID else x for x in s.ids[i:j].tolist()], start=starts[i:j], n_tokens=s.counts[i:j], **{c: made[c]() for c in columns})

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long" + "".join(f", {c} {kinds[c][1]}" for c in columns))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/quillspark/tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, manifest, ("ids_crc32",))
