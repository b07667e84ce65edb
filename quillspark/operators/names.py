"""Which of many names have all their words in a text: one pass over the texts, nothing shuffled.

Words may be parts of longer ones, so that every place of a text may begin one.
``Names`` holds a block of names as arrays: words of up to eight bytes as numbers,
by length, longer ones under their first eight bytes.  A task compares all
places of its texts with them at once.  Each name hangs on the one of its words
that fewest names have; where a text holds that word, the others are looked for
among the words found in the text.  So what is looked at grows with what texts
hold, not with texts times names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a word that are compared as one number, and places and candidates that are looked at together.
KEY, PLACES, MANY = 8, 1 << 18, 1 << 20
#: Odd numbers that spread keys over the table of possible ones.
SPREAD, APART = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03


def _number(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w[:KEY].ljust(KEY, b"\0") for w in words), "<u8")


class Names:
    """Names with the words that a text has to hold of each, in any order."""

    def __init__(self, names: pa.Array, words: pa.Array):
        coded = words.flatten().cast(pa.binary()).dictionary_encode()
        self.names, self.words = names, len(coded.dictionary)
        of = np.repeat(np.arange(len(names)), words.value_lengths().to_numpy(zero_copy_only=False))
        both = np.unique(of.astype(np.int64) * max(self.words, 1) + coded.indices.to_numpy())  # a word once a name
        of, word = np.divmod(both, max(self.words, 1))
        often = np.bincount(word, minlength=self.words)
        order = np.lexsort((word, often[word], of))
        of, word = of[order], word[order]
        first = np.append(True, of[1:] != of[:-1])[: len(of)]
        by = np.argsort(word[first], kind="stable")
        #: Names by the word they hang on, and the other words of each.
        self.hung, self.hung_at = of[first][by], np.append(0, np.cumsum(np.bincount(word[first], minlength=self.words)))
        self.rest, self.rest_at = word[~first], np.append(0, np.cumsum(np.bincount(of[~first], minlength=len(names))))
        self._index(coded.dictionary.to_pylist())

    def _index(self, words: list[bytes]) -> None:
        size = np.array([len(w) for w in words], np.int64)
        bits = min(24, max(12, int(len(words)).bit_length() + 4))
        self.shift, self.table, self.short = np.uint64(64 - bits), np.zeros(1 << bits, bool), []
        keys = _number(words)
        for n in range(1, KEY + 1):
            at = np.flatnonzero(size == n if n < KEY else size >= KEY)  # all that are longer are found by their beginning
            if len(at):
                each, rank = np.unique(keys[at], return_inverse=True)
                word = np.full(len(each), -1)
                exact = size[at] == n
                word[rank[exact]] = at[exact]
                self.short.append((n, each, word))
                self.table[self._slot(each, n)] = True
        self.long: dict[bytes, int] = {w: i for i, w in enumerate(words) if len(w) > KEY}
        self.sizes: dict[int, list[int]] = {}
        for k, n in set(zip(keys[size > KEY].tolist(), size[size > KEY].tolist())):
            self.sizes.setdefault(k, []).append(n)

    def _slot(self, keys: np.ndarray, n: int) -> np.ndarray:
        return ((keys + np.uint64(n * APART % (1 << 64))) * SPREAD) >> self.shift

    def held(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``text * words + word``, sorted, once each: the words in texts that lie end to end in ``data``, text i from ``at[i]`` to ``at[i + 1]``."""
        found = [np.empty(0, np.int64)]
        for begin in range(int(at[0]), int(at[-1]), PLACES):
            end = min(begin + PLACES, int(at[-1]))
            part = np.zeros(end - begin + KEY, np.uint8)
            some = data[begin : min(end + KEY, int(at[-1]))]
            part[: len(some)] = some
            eight = np.ndarray(end - begin, "<u8", part, strides=(1,)).copy()
            hits = []
            for n, keys, word in self.short:
                key = eight & np.uint64((1 << 8 * n) - 1)
                place = np.flatnonzero(self.table[self._slot(key, n)])
                key = key[place]
                rank = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                place, rank = place[keys[rank] == key], rank[keys[rank] == key]
                whole = word[rank] >= 0
                hits.append((place[whole], np.full(whole.sum(), n), word[rank[whole]]))
                if n == KEY and self.long:
                    more = [(p, m, i) for p, k in zip(place.tolist(), keys[rank].tolist()) for m in self.sizes.get(k, ()) if (i := self.long.get(data[begin + p : begin + p + m].tobytes())) is not None]
                    hits += [tuple(np.array(x, np.int64) for x in zip(*more))] if more else []
            if hits:
                place, n, word = (np.concatenate(x) for x in zip(*hits))
                text = np.searchsorted(at, place + begin, "right") - 1
                inside = place + begin + n <= at[text + 1]
                found.append(np.unique(text[inside] * self.words + word[inside]))
        return np.unique(np.concatenate(found))

    def found(self, data: np.ndarray, at: np.ndarray):
        """``(texts, names)``, numbers of both, a bounded number of candidates at a time."""
        held = self.held(data, at)
        text, word = np.divmod(held, max(self.words, 1))
        n = self.hung_at[word + 1] - self.hung_at[word]
        text, word, n = text[n > 0], word[n > 0], n[n > 0]
        part = np.cumsum(n) // MANY
        for k in np.unique(part):
            some = part == k
            t, m = np.repeat(text[some], n[some]), n[some]
            name = self.hung[np.repeat(self.hung_at[word[some]] - np.cumsum(m) + m, m) + np.arange(len(t))]
            step = 0
            done: list[tuple] = []
            while len(t):
                more = self.rest_at[name + 1] - self.rest_at[name] > step
                done.append((t[~more], name[~more]))
                t, name = t[more], name[more]
                asked = t * self.words + self.rest[self.rest_at[name] + step]
                there = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
                t, name, step = t[there], name[there], step + 1
            yield tuple(np.concatenate(x) for x in zip(*done))

    def rows(self, batches):
        """``(path, zettel)`` of batches ``(path, text)``."""
        for b in batches:
            texts = b["text"].cast(pa.large_binary())
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for text, name in self.found(data, at):
                yield pa.RecordBatch.from_arrays([b["path"].take(pa.array(text)), self.names.take(pa.array(name))], names=["path", "zettel"])
