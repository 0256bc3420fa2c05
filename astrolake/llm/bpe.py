"""Byte-level BPE encoding and decoding.

Words (matches of the split pattern) of one slice of documents are looked up in a worker's word
table; unknown words are encoded together.  They are bucketed by byte length and laid out as padded
matrices.  In each round every row merges its leftmost pair of minimum rank: pair ranks come from a
hash table held in flat arrays, the merged position is closed up (compaction), and finished rows
leave the matrix.

The vocabulary and the pair table are a broadcast of fixed size.  The word table is only a cache:
it is emptied when full and never changes a result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from itertools import chain, count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from astrolake.llm.arrow import with_computed

NONE = np.int32(2**31 - 1)
# Rows longer than this are merged by `_merge_long`: all leftmost pairs of one rank per round.
LONG_ROW = 256
CACHED_WORDS = 300_000
_HASH = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id of the merged token."""

    def __init__(self, tokens: list[bytes]):
        rank = {token: i for i, token in enumerate(tokens)}
        found: dict[int, int] = {}
        for merged, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = merged
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, NONE, np.int32)
        mask = (1 << self.bits) - 1
        keys = np.fromiter(found.keys(), np.int64, len(found))
        values = np.fromiter(found.values(), np.int32, len(found))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(keys), bool)
            wins[first] = True
            wins &= free
            self.keys[slot[wins]] = keys[wins]
            self.merged[slot[wins]] = values[wins]
            keys, values, slot = keys[~wins], values[~wins], (slot[~wins] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * _HASH
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NONE where a pair does not merge or an id is negative."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = self.merged[slot]
        at = self.keys[slot]
        open_ = np.flatnonzero((at != keys) & (at != -1))
        out[at != keys] = NONE
        mask = (1 << self.bits) - 1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out


class Vocabulary:
    """Token bytes, ids of single bytes and the pair table."""

    def __init__(self, tokens: list[bytes]):
        rank = {token: i for i, token in enumerate(tokens)}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(tokens)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merged ids of each row of a matrix padded with -1."""
        done: list[np.ndarray] = [ids[:0, 0]] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        ranks = ranks.reshape(len(ids), ids.shape[1] - 1)
        while True:
            width = ids.shape[1]
            if width > 1:
                at = ranks.argmin(axis=1)  # the first of equal minima: the leftmost pair
                best = ranks[np.arange(len(ids)), at]
                over = best == NONE
            else:
                over = np.ones(len(ids), bool)
            if over.any():
                for row, values in zip(rows[over], ids[over]):
                    done[row] = values[values >= 0]
                if over.all():
                    return done
                live = ~over
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            # Close up: columns right of the merged pair move one to the left.
            column = np.arange(width - 1)
            n = np.arange(len(ids))
            ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[n, at] = best
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            if width > 2:
                has = at > 0
                ranks[n[has], at[has] - 1] = self.pairs.lookup(ids[n[has], at[has] - 1], best[has])
                has = at < width - 2
                ranks[n[has], at[has]] = self.pairs.lookup(best[has], ids[n[has], at[has] + 1])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Merged ids of one long word.

        All pairs of the minimum rank are merged from the left in one round.  That equals merging
        one by one as long as no new pair ranks lower, which is checked; else the round merges one.
        """
        while len(ids) > 1:
            ranks = self.pairs.lookup(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NONE:
                break
            hits = np.flatnonzero(ranks == best)
            # In a run of overlapping hits every second one is merged.
            run = np.cumsum(np.diff(hits, prepend=-2) != 1)
            first = hits[np.searchsorted(run, run)]
            hits = hits[(hits - first) % 2 == 0]
            merged = ids.copy()
            merged[hits] = best
            merged = np.delete(merged, hits + 1)
            at = hits - np.arange(len(hits))
            near = np.concatenate([
                self.pairs.lookup(merged[at[at > 0] - 1], merged[at[at > 0]]),
                self.pairs.lookup(merged[at[at < len(merged) - 1]],
                                  merged[at[at < len(merged) - 1] + 1]),
            ])
            if len(hits) > 1 and len(near) and near.min() < best:
                merged = np.delete(ids, hits[0] + 1)
                merged[hits[0]] = best
            ids = merged
        return ids

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [self.byte_id[:0]] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            size = len(word)
            if size > LONG_ROW:
                out[i] = self._merge_long(self.byte_id[np.frombuffer(word, np.uint8)])
            elif size:
                # exact widths for ordinary words, powers of two above
                width = size if size <= 16 else 1 << (size - 1).bit_length()
                buckets.setdefault(width, []).append(i)
        for width, members in buckets.items():
            for lo in range(0, len(members), 65_536):
                part = members[lo:lo + 65_536]
                raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), np.uint8)
                ids = self.byte_id[raw].reshape(len(part), width)
                sizes = np.array([len(words[i]) for i in part])
                ids[np.arange(width) >= sizes[:, None]] = -1
                for i, values in zip(part, self.merge_rows(ids)):
                    out[i] = values
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids.  An id outside the vocabulary is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length)):
            raise ValueError("id outside the vocabulary")
        return gather(self.flat, self.start[ids], self.length[ids])


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of the pieces flat[start:start + length]."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(start - (ends - length), length)
    return flat[shift + np.arange(total)]


# The public pattern for the standard library's expressions, which are faster.  Both split alike in
# texts of the characters below: Latin letters and marks without numbers such as a superscript two,
# which one of them takes for a letter, and without the controls that only one takes for a space.
# Letters are written out, since one look at a table is faster than three tests of a character's
# kind, and stand first: no other alternative begins like them.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PLAIN = {public_tokenizers.PATTERN: re.compile(
    f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\\s+(?!\\S)|\\s+").findall}
_OTHER = re.compile("[^\t-\r -\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]").search


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Function from a text to the matches of `pattern`."""
    general, plain = regex.compile(pattern).findall, _PLAIN.get(pattern)
    if plain is None:
        return general
    return lambda text: general(text) if _OTHER(text) else plain(text)


class _Numbers(dict):
    """Numbers of words, in the order of their first use; `new` holds those without ids."""

    def __init__(self, known: Iterable[str] = ()):
        super().__init__(zip(known, count()))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTable:
    """Ids of the words met so far, in one flat array.

    `encode_words` gives an array of ids for each word, or all ids in a row and the number of ids of
    each word.  When the table is full, words met only once are forgotten, or all if too many are left.
    """

    def __init__(self, pattern: str,
                 encode_words: Callable[[list[bytes]], list[np.ndarray] | tuple[np.ndarray, np.ndarray]]):
        self.findall = splitter(pattern)
        self.encode_words = encode_words
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbers()
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > CACHED_WORDS // 2:
            self._clear()
            return
        again = self.uses > 1
        self.index = _Numbers(w for w, i in self.index.items() if again[i])
        self.flat = gather(self.flat, self.start[kept], self.length[kept])
        self.length = self.length[kept]
        self.start = np.cumsum(self.length) - self.length
        self.uses = np.ones(len(kept), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        if len(self.index) > CACHED_WORDS:
            self._shrink()
        split = [self.findall(text) for text in texts]
        index = self.index
        counts = np.array([len(words) for words in split], np.int64)
        at = np.fromiter(
            map(index.__getitem__, chain.from_iterable(split)), np.int64, counts.sum()
        )
        if index.new:
            new, index.new = index.new, []
            try:
                ids = self.encode_words([word.encode() for word in new])
            except Exception:
                self._clear()  # a table with words without ids must not outlive its task
                raise
            if isinstance(ids, list):
                ids = np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
            flat, length = ids
            start = np.cumsum(length) - length + len(self.flat)
            self.flat = np.concatenate([self.flat, flat])
            self.start = np.concatenate([self.start, start])
            self.length = np.concatenate([self.length, length])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses += np.bincount(at, minlength=len(self.uses))
        length = self.length[at]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([[0], np.cumsum(length)])[bounds]
        return gather(self.flat, self.start[at], length), np.diff(sums)


_TABLES: dict[tuple, object] = {}


def _vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    if ("vocabulary", path) not in _TABLES:
        _TABLES["vocabulary", path] = Vocabulary(read_ranks(path))
    return _TABLES["vocabulary", path]


def _words(path: str, pattern: str) -> WordTable:
    if (path, pattern) not in _TABLES:
        _TABLES[path, pattern] = WordTable(pattern, _vocabulary(path).encode_words)
    return _TABLES[path, pattern]


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, column: str, ranks_path: str, pattern: str,
           output: str = "ids") -> DataFrame:
    """`df` with the token ids of a text column as `array<int>`.

    A null text counts as empty and has no ids.  Special tokens do not exist here: their strings
    are ordinary text.  Rows and other columns stay as they are; a column named `output` is
    replaced.  `ranks_path` must exist on every worker (an installed package or shared file).
    """
    def make():
        table = _words(ranks_path, pattern)

        def run(texts: pa.Array) -> list[pa.Array]:
            values, counts = table.encode([t or "" for t in texts.to_pylist()])
            return [list_array(values, counts)]

        return run

    return with_computed(df, column, f"`{output}` array<int>", make)


def decode(df: DataFrame, column: str, ranks_path: str, output: str = "decoded") -> DataFrame:
    """`df` with the bytes of an `array<int>` column of ids as `binary`.

    A null list gives null; a null id or one outside the vocabulary is an error.
    """
    def make():
        vocabulary = _vocabulary(ranks_path)

        def run(packed: pa.Array) -> list[pa.Array]:
            out = []
            for ids in packed:
                if not ids.is_valid:
                    out.append(None)
                    continue
                if ids.values.null_count:
                    raise ValueError("null id")
                out.append(vocabulary.decode(ids.values.to_numpy(zero_copy_only=False)).tobytes())
            return [pa.array(out, pa.binary())]

        return run

    return with_computed(df, column, f"`{output}` binary", make)
