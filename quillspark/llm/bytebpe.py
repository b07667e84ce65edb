"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a block of texts are laid out as one array of byte
tokens.  An inverted index leads from each pair's rank to the positions where it
stands; ranks are taken in order, all positions of a rank are merged at once, and
only the pairs with the touched neighbours enter the index again.  So each
distinct piece is merged once a block however often it occurs, and texts are then
encoded by looking their pieces up.

The corpus of a replay is a block of bounded size, whatever the table's: an index
over all pieces of a table would have to be shuffled back to every text.  Nothing
is shuffled or kept between tasks; a lost task is redone from its own rows.

Defined cases: a null text is empty and has no tokens; rows are encoded one by
one, so repeated rows repeat and a null doc_id stays null; an empty table gives no
rows; a text of any length is one row of one block; columns of ``docs`` that have
the name of a chosen one are replaced, others are kept.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspark.llm.common import slices, table, trim_memory

SHIFT = 20  # ids are below 2 ** SHIFT


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class MergeReplay:
    """Applies a rank table's merges to many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: x for x, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for x, r in ranks.items():
            for i in range(1, len(x)):
                a, b = ranks.get(x[:i]), ranks.get(x[i:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of neighbours' concatenations, -1 where they are no token or one of them is missing."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int32)
        key = a.astype(np.int64) << SHIFT | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.values[i], np.int32(-1))

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        whole = [self.ranks.get(p) for p in pieces]
        rest = [p for p, r in zip(pieces, whole) if r is None and p]
        done = iter(self._replay(rest) if rest else ())
        return [[r] if r is not None else next(done) if p else [] for p, r in zip(pieces, whole)]

    def alone(self, piece: bytes) -> list[int]:
        """One piece, pair by pair: for those few in which a merge makes a pair of lower rank than its own."""
        tok = [int(self.byte[c]) for c in piece]
        while len(tok) > 1:
            rank = [self.ranks.get(self.token[a] + self.token[b], 1 << SHIFT) for a, b in zip(tok, tok[1:])]
            least = min(rank)
            if least == 1 << SHIFT:
                break
            i = rank.index(least)
            tok[i : i + 2] = [least]
        return tok

    def _replay(self, pieces: list[bytes]) -> list[list[int]]:
        raw = b"".join(pieces)
        n, sizes = len(raw), np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        tok = np.full(n + 1, -1, np.int32)  # the last place stands for no neighbour
        tok[:n] = self.byte[np.frombuffer(raw, np.uint8)]
        right = np.arange(1, n + 2, dtype=np.int32)
        right[ends - 1] = n
        right[n] = n
        left = np.arange(-1, n, dtype=np.int32)
        left[ends - sizes] = n
        left[n] = n
        rank = self.pair(tok, tok[right])  # of the pair that begins at a place
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, r: np.ndarray) -> None:
            """Positions into the index, by rank."""
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)]):
                x = int(r[s])
                if x in index:
                    index[x].append(at[s:e])
                else:
                    index[x] = [at[s:e]]
                    heappush(heap, x)

        some = np.flatnonzero(rank >= 0).astype(np.int32)
        if len(some):
            enter(some, rank[some])
        heapify(heap)
        odd: list[np.ndarray] = []  # places of pieces that have to be done alone
        while heap:
            r = heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]  # else a neighbour was merged meanwhile
            if not len(at):
                continue
            second = right[at]
            if (chained := rank[second] == r).any():  # as in a run of one letter: the leftmost goes first
                at, second = self._leftmost(at, second, chained, rank, right, r)
            after, before = right[second], left[at]
            between = rank[after] == r  # the next one merges as well; what stood between them for a moment
            if between.any():
                was = self.pair(np.full(int(between.sum()), r), tok[after[between]])
                if ((was >= 0) & (was < r)).any():
                    odd.append(at[between][(was >= 0) & (was < r)])
            tok[at], tok[second], rank[second] = r, -1, -1
            right[at] = after
            left[after] = at
            left[n] = n
            places = np.concatenate([at, before[before < n]])
            new = self.pair(tok[places], tok[right[places]])
            rank[places] = new
            rank[n] = -1
            if ((new >= 0) & (new < r)).any():
                odd.append(places[(new >= 0) & (new < r)])
            if (some := new >= 0).any():
                enter(places[some], new[some])
        keep = tok[:n] >= 0
        edges = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, ends - sizes, dtype=np.int64))]).tolist()
        flat = tok[:n][keep].tolist()
        out = [flat[x:y] for x, y in zip(edges, edges[1:])]
        for i in np.unique(np.searchsorted(ends, np.concatenate(odd), "right")).tolist() if odd else ():
            out[i] = self.alone(pieces[i])
        return out

    @staticmethod
    def _leftmost(at, second, chained, rank, right, r):
        """Of pairs of one rank that share a token, every other from the left."""
        gone, keep = set(), np.ones(len(at), bool)
        order = np.argsort(at, kind="stable")
        for i in order.tolist():
            if int(at[i]) in gone:
                keep[i] = False
            elif chained[i]:
                gone.add(int(second[i]))
        return at[keep], second[keep]


class Codec:
    """Texts to ids and back."""

    def __init__(self, ranks_file: str, pattern: str):
        import regex

        with open(ranks_file, "rb") as f:
            self.replay = MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.pieces = regex.compile(pattern).findall

    def block(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Per text the numbers of its pieces, and the ids of every piece."""
        place: dict[str, int] = {}
        number = place.setdefault
        cut = [[number(p, len(place)) for p in self.pieces(t)] for t in texts]
        return cut, self.replay.encode([p.encode("utf-8", "surrogatepass") for p in place])


_codecs: dict[tuple, Codec] = {}


def codec(ranks_file: str, pattern: str) -> Codec:
    if (ranks_file, pattern) not in _codecs:
        _codecs.clear()
        _codecs[ranks_file, pattern] = Codec(ranks_file, pattern)
    return _codecs[ranks_file, pattern]


KINDS = {
    "n_tokens": (pa.int64(), "long"), "ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.binary(), "binary"),
    "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string"),
}


def encode_decode(docs: DataFrame, columns=("n_tokens", "ids", "decoded"), text: str = "text", keep: list[str] | None = None, ranks_file: str | None = None, pattern: str | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """Every row of ``docs`` with the chosen columns, and of its own those in ``keep`` (all, if not given).

    ``ids`` and ``decoded`` (the bytes the ids stand for), ``n_tokens``, and the
    digests ``ids_sha256`` (of decimal ids joined by one space) and
    ``decoded_sha256``, made where the ids are so that these need not leave the
    task.  Columns of the same names in ``docs`` are replaced; others are kept.
    """
    ranks_file, pattern = ranks_file or default_ranks(), pattern or default_pattern()
    kept = [f for f in docs.schema if f.name not in columns and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"{c} {KINDS[c][1]}" for c in columns))])

    def run(batches):
        c = codec(ranks_file, pattern)
        token = c.replay.token
        for b in (b for whole in batches for b in slices(whole, text, block_bytes)):
            cut, ids = c.block([x or "" for x in b[text].to_pylist()])
            made = {}
            if "n_tokens" in columns:
                sizes = [len(x) for x in ids]
                made["n_tokens"] = [sum([sizes[i] for i in d]) for d in cut]
            if "ids" in columns:
                made["ids"] = [[x for i in d for x in ids[i]] for d in cut]
            if "ids_sha256" in columns:
                decimal = [" ".join(map(str, x)) for x in ids]
                made["ids_sha256"] = [hashlib.sha256(" ".join([decimal[i] for i in d]).encode()).hexdigest() for d in cut]
            if "decoded" in columns or "decoded_sha256" in columns:
                decoded = [b"".join([token[x] for x in y]) for y in ids]
                if "decoded" in columns:
                    made["decoded"] = [b"".join([decoded[i] for i in d]) for d in cut]
                if "decoded_sha256" in columns:
                    made["decoded_sha256"] = [hashlib.sha256(b"".join([decoded[i] for i in d])).hexdigest() for d in cut]
            cut = ids = None
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), *(pa.array(made[x], KINDS[x][0]) for x in columns)], names=[*(f.name for f in kept), *columns])
        trim_memory()  # workers live on from stage to stage

    read = dict.fromkeys([*(f.name for f in kept), text])
    return docs.select(*(docs[f"`{c}`"] for c in read)).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, ("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])
