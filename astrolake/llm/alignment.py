"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

Both tokenizers cut a text's bytes.  Where a token of each ends at the same byte there is a cut; cuts
part the tokens into groups, and every token of one side is linked to every token of the other in its
group.  All token streams of a slice are merged in lockstep: one state vector holds, per lane, the
next token of A and of B; every step compares the ends, advances the side that is behind, and emits a
group where both end.  Lanes that are done leave the vector.  A document is one lane, a long one
several, cut by A tokens.

Counts of pairs are aggregated per slice first.  A slice keeps its own list of distinct pairs; only
those meet the counts of the whole corpus, in a shuffle by pair, and return to their slice.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm.arrow import bound_batches, slices, with_computed
from astrolake.llm.bpe import WordTable, gather
from astrolake.llm.packing import byte_alphabet
from astrolake.session import drop_table, settled, write_table

# Bytes of text of a slice, and characters aligned at once; tokens of A a lane has, about.
SLICE_BYTES = 2 << 20
CHUNK_CHARS = 1 << 19
LANE_TOKENS = 256
# Characters at which a long text is cut.
PART_CHARS = 1 << 17
CACHED_WORDS = 400_000
# Links of one group expanded one by one; larger groups are counted by distinct tokens.
EXPANDED = 1 << 16
SPACE = "▁"


class Tokens:
    """Bytes of every token of a vocabulary, and its number as text with one more byte."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(token) for token in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        digits = [b"%d," % number for number in range(len(tokens))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_length = np.array([len(text) for text in digits], np.int64)
        self.digit_start = np.cumsum(self.digit_length) - self.digit_length

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start[ids], self.length[ids])


Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _byte_level(path: str, pattern: str) -> tuple[Tokens, Encode]:
    """A byte-level tokenizer of the `tokenizers` library, by its model on one match of its split
    `pattern` at a time, with a space before every text.  Strings of special tokens are ordinary
    text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize, alphabet = tokenizer.model.tokenize, byte_alphabet()
    back = {shown: byte for byte, shown in alphabet.items()}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]

    def encode_words(words: list[bytes]) -> list[np.ndarray]:
        shown = (word.decode("latin-1").translate(alphabet) for word in words)
        return [np.array([t.id for t in tokenize(word)], np.int32) for word in shown]

    table = WordTable(pattern, encode_words)
    return (Tokens([bytes(back[c] for c in name if c in back) for name in names]),
            lambda texts: table.encode([" " + text for text in texts]))


def _pieces(path: str) -> tuple[Tokens, Encode]:
    """A `sentencepiece` model that puts a space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in name.lstrip(SPACE) for name in names):
        raise ValueError("a piece has a space behind another character: texts cannot be cut")

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, counts.sum()), counts

    return Tokens([
        bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(SPACE, " ").encode()
        for i, name in enumerate(names)
    ]), encode


# Before a single space no token of either side goes on, so a text may be cut there: the first
# tokenizer gets the space with what follows, the second adds it.
_cut = re.compile(f"(?<=[^\\s{SPACE}]) (?=[^\\s{SPACE}])")
_other_space = re.compile(f"^ | $| [\\s{SPACE}]|[\\s{SPACE}] ")


def words_of(text: str) -> list[str]:
    """A text cut at its single spaces, without them."""
    return _cut.split(text) if _other_space.search(text) else text.split(" ")


def parts_of(text: str) -> Iterator[str]:
    """A text cut at some of its single spaces into parts of about `PART_CHARS`, without them."""
    at = 0
    while found := _cut.search(text, at + PART_CHARS):
        yield text[at:found.start()]
        at = found.end()
    yield text[at:]


class _Side:
    """Ids that one tokenizer gives to the words met so far."""

    def __init__(self, encode: Encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.flat, self.length = np.empty(0, np.int32), np.empty(0, np.int64)

    def add(self, words: list[str]) -> None:
        flat, length = self.encode(words)
        self.flat = np.concatenate([self.flat, flat])
        self.length = np.concatenate([self.length, length])
        self.start = np.cumsum(self.length) - self.length

    def ids(self, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and their number between the bounds."""
        length = self.length[at]
        sums = np.concatenate([[0], np.cumsum(length)])[bounds]
        return gather(self.flat, self.start[at], length), np.diff(sums)


class Words:
    """Both tokenizers' ids of words.  The table is only a cache: it is emptied when full."""

    def __init__(self, *sides: _Side):
        self.index: dict[str, int] = {}
        self.sides = sides

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each side: ids of all parts in a row, and their number per part."""
        index = self.index
        if len(index) > CACHED_WORDS:
            index.clear()
            for side in self.sides:
                side.clear()
        split = [words_of(part) for part in parts]
        new = [word for word in set().union(*split) if word not in index]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new))))
            for side in self.sides:
                side.add(new)
        counts = np.array([len(words) for words in split], np.int64)
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return [side.ids(at, bounds) for side in self.sides]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray,
             stop_a: np.ndarray) -> np.ndarray:
    """Groups (a, a_end, b, b_end) of all lanes, in the order of the tokens.

    `end_a`, `end_b` are the end bytes of all tokens; a lane starts at the given tokens, at a byte
    where both sides have a cut, and stops before token `stop_a`, at another.
    """
    a, b, stop = first_a.copy(), first_b.copy(), stop_a
    open_a, open_b = first_a.copy(), first_b.copy()
    groups = [np.empty((4, 0), np.int64)]
    while True:
        live = a < stop
        if not live.all():  # lanes that are done leave
            a, b, open_a, open_b, stop = (x[live] for x in (a, b, open_a, open_b, stop))
        if not len(a):
            break
        ahead = end_a[a] - end_b[b]
        at = np.flatnonzero(ahead == 0)
        a += ahead <= 0
        b += ahead >= 0
        if len(at):
            groups.append(np.stack([open_a[at], a[at], open_b[at], b[at]]))
            open_a[at], open_b[at] = a[at], b[at]
    found = np.concatenate(groups, axis=1)
    return found[:, np.argsort(found[0])]


def lanes(end_a: np.ndarray, end_b: np.ndarray, begins: np.ndarray,
          size: int = LANE_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first_a, first_b, stop_a) of lanes of about `size` tokens of A.  A lane begins at each of
    `begins` (tokens of A where a part does), and at the next cut behind each multiple of `size`."""
    found = [begins]
    open_ = np.arange(size, len(end_a), size)
    while len(open_):
        byte = end_a[open_ - 1]
        cut = end_b[np.searchsorted(end_b, byte)] == byte
        found.append(open_[cut])
        open_ = open_[~cut] + 1
    first_a = np.unique(np.concatenate(found))
    first_a = first_a[first_a < len(end_a)]
    before = np.where(first_a > 0, end_a[first_a - 1], 0)
    first_b = np.searchsorted(end_b, before, side="right")
    return first_a, first_b, np.append(first_a[1:], len(end_a))


def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `count` numbers each, in a row."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def folded(key: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their `times`; None means once each."""
    if times is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    if times is None or not len(key):
        return key[heads], np.diff(np.append(heads, len(key)))
    return key[heads], np.add.reduceat(times, heads)


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, owner: np.ndarray,
                 width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, links) of the distinct pairs of every document; the pair a * width + b of a document has
    the key document * size + pair.

    Links of a group are all its A tokens with all its B tokens, repeats included.
    """
    a, a_end, b, b_end = groups
    n_a, n_b = a_end - a, b_end - b
    small = n_a * n_b <= EXPANDED
    size_a, size_b = n_a[small], n_b[small]
    with_b = np.repeat(size_b, size_a)
    left = ids_a[runs(a[small], size_a)].astype(np.int64) * width
    left += np.repeat(owner[small] * size, size_a)
    key, times = folded(
        np.repeat(left, with_b) + ids_b[runs(np.repeat(b[small], size_a), with_b)], None)
    large = np.flatnonzero(~small)
    if not len(large):
        return key, times
    keys, counts = [key], [times]
    for at in large:
        some_a, count_a = np.unique(ids_a[a[at]:a_end[at]], return_counts=True)
        some_b, count_b = np.unique(ids_b[b[at]:b_end[at]], return_counts=True)
        pairs = some_a.astype(np.int64)[:, None] * width + some_b
        keys.append((owner[at] * size + pairs).ravel())
        counts.append((count_a[:, None] * count_b).ravel())
    return folded(np.concatenate(keys), np.concatenate(counts))


class _Writer:
    """Groups as text: `a1,a2|b1;a3|b2,b3;` with one separator behind every number."""

    def __init__(self, a: Tokens, b: Tokens):
        self.flat = np.concatenate([a.digits, b.digits])
        self.start_a, self.length_a = a.digit_start, a.digit_length
        self.start_b, self.length_b = b.digit_start + len(a.digits), b.digit_length

    def written(self, ids_a: np.ndarray, ids_b: np.ndarray,
                groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of all groups, and where each ends.  The groups take all ids in order."""
        n_a, n_b = groups[1] - groups[0], groups[3] - groups[2]
        before = np.cumsum(n_a + n_b) - (n_a + n_b)
        place_a, place_b = runs(before, n_a), runs(before + n_a, n_b)
        start = np.empty(len(ids_a) + len(ids_b), np.int64)
        length = np.empty(len(start), np.int64)
        start[place_a], length[place_a] = self.start_a[ids_a], self.length_a[ids_a]
        start[place_b], length[place_b] = self.start_b[ids_b], self.length_b[ids_b]
        ends = np.cumsum(length)
        text = gather(self.flat, start, length)
        text[ends[before + n_a - 1] - 1] = ord("|")
        closed = ends[before + n_a + n_b - 1]
        text[closed - 1] = ord(";")
        return text, closed


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        self.a, encode_a = _byte_level(path_a, pattern)
        self.b, encode_b = _pieces(path_b)
        self.words = Words(_Side(encode_a), _Side(encode_b))
        self.writer = _Writer(self.a, self.b)
        self.width = len(self.b.length)
        self.size = len(self.a.length) * self.width

    def chunks(self, texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """(owners, ids_a, ids_b, groups, owner of each group, equal) of runs of parts of the texts;
        owners are the texts with a part in the run, `equal` tells of each part whether both sides
        give the bytes of the text.  Groups exist for such parts only."""
        part, owner, size = [], [], 0
        for at, text in enumerate(texts):
            for piece in parts_of(text):
                part.append(piece)
                owner.append(at)
                size += len(piece)
                if size >= CHUNK_CHARS:
                    yield self._chunk(part, np.array(owner))
                    part, owner, size = [], [], 0
        if part:
            yield self._chunk(part, np.array(owner))

    def _chunk(self, parts: list[str], owner: np.ndarray) -> tuple[np.ndarray, ...]:
        (ids_a, count_a), (ids_b, count_b) = self.words.encode(parts)
        said = [b" " + part.encode() for part in parts]
        size = np.array([len(text) for text in said], np.int64)
        equal = self._equal(self.a, ids_a, count_a, said, size)
        equal &= self._equal(self.b, ids_b, count_b, said, size)
        ids_a, ids_b = ids_a[np.repeat(equal, count_a)], ids_b[np.repeat(equal, count_b)]
        end_a, end_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b])
        count_a = count_a[equal]
        groups = lockstep(end_a, end_b, *lanes(end_a, end_b, np.cumsum(count_a) - count_a))
        by_token = np.repeat(owner[equal], count_a)
        return owner, ids_a, ids_b, groups, by_token[groups[0]], equal

    @staticmethod
    def _equal(tokens: Tokens, ids: np.ndarray, counts: np.ndarray, said: list[bytes],
               size: np.ndarray) -> np.ndarray:
        """Whether the tokens of each part join to its bytes."""
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(tokens.length[ids])])
        same = total[ends] - total[ends - counts] == size
        if same.all():
            joined, wanted = tokens.bytes_of(ids), np.frombuffer(b"".join(said), np.uint8)
            begin = np.cumsum(size) - size
            return ~np.logical_or.reduceat(joined != wanted, begin)
        for at in np.flatnonzero(same):
            some = ids[ends[at] - counts[at]:ends[at]]
            same[at] = tokens.bytes_of(some).tobytes() == said[at]
        return same


_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}


def _aligner(*key: str) -> Aligner:
    """One per worker process, pair of files and split pattern."""
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


class _Sums:
    """What the chunks of a slice give, per text."""

    def __init__(self, aligner: Aligner, texts: list[str]):
        n = len(texts)
        self.sums = np.zeros((4, n), np.int64)  # n_a, n_b, n_groups, n_links
        bad = np.zeros(n, bool)
        digest = [hashlib.sha256() for _ in texts]
        begun = np.zeros(n, bool)
        links = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        full = np.array([at for at, text in enumerate(texts) if text], np.int64)
        for owner, ids_a, ids_b, groups, by, equal in aligner.chunks([texts[at] for at in full]):
            by = full[by]
            bad[full[owner[~equal]]] = True
            n_a, n_b = groups[1] - groups[0], groups[3] - groups[2]
            for row, values in enumerate((n_a, n_b, np.ones_like(n_a), n_a * n_b)):
                np.add.at(self.sums[row], by, values)
            if len(by):
                text, closed = aligner.writer.written(ids_a, ids_b, groups)
                edges = np.flatnonzero(np.diff(by, append=-1))
                begin = 0
                for at, end in zip(by[edges].tolist(), closed[edges].tolist()):
                    if begun[at]:
                        digest[at].update(b";")
                    digest[at].update(text[begin:end - 1])
                    begun[at], begin = True, end
            links.append(linked_pairs(ids_a, ids_b, groups, by, aligner.width, aligner.size))
        self.sums[:, bad] = 0
        self.digests = ["" if bad[at] or not begun[at] else digest[at].hexdigest()
                        for at in range(n)]
        key, times = links[-1] if len(links) < 3 else folded(*(
            np.concatenate([part[i] for part in links]) for i in range(2)))
        self.document, pair = np.divmod(key, aligner.size)
        good = ~bad[self.document]
        self.document, self.pair, self.times = self.document[good], pair[good], times[good]


_SUMS = ("n_a", "n_b", "n_groups", "n_links")
_OUT = (*_SUMS, "n_best", "count_sum", "groups_sha256")


class Alignment:
    """Alignment of a text column under two tokenizers.

    A is byte-level (a `tokenizers` file and its split pattern) and gets a space and the text; B is a
    `sentencepiece` model that adds the space itself.  Texts that are null or empty, or whose tokens
    of either side do not join to the bytes of space and text, have no tokens.  Rows with equal ids
    are documents of their own.  `keep` names the columns of `df` to bring along, all by default; what
    is not needed, such as the text, is better left out of the shuffle.  `drop` removes the working table; results that read it end there.
    """

    def __init__(self, df: DataFrame, text_column: str, path_a: str, path_b: str,
                 pattern: str = public_tokenizers.PATTERN, keep: Iterable[str] | None = None):
        self.spark = df.sparkSession
        self.names = [name for name in keep or df.columns if name not in _OUT]
        bound_batches(self.spark)
        # plain names inside, so that no column of the caller's clashes
        source = df.select(F.col(text_column).alias("t"), *(
            F.col(name).alias(f"c{at}") for at, name in enumerate(self.names)))
        kept = [field for field in source.schema.fields[1:]]
        added = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                 "_shard bigint, _links binary, _pairs binary, _docs binary")
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [added])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner, shard = _aligner(path_a, path_b, pattern), TaskContext.get().partitionId() << 40
            for batch in batches:
                for part in slices(batch, 0, SLICE_BYTES):
                    yield _aligned(part, aligner, shard)
                    shard += 1

        self.path = write_table(source.mapInArrow(run, schema), "alignment")
        self.width = _width(path_b)
        table = self.spark.read.parquet(self.path)
        listed = table.where("_pairs IS NOT NULL").select("_shard", "_pairs", "_docs")
        self.listed = listed.mapInArrow(_unpacked, "_shard bigint, at int, pair bigint, docs bigint")
        self.table = table.drop("_pairs", "_docs")
        totals = settled(self.listed.groupBy("pair").agg(F.sum("docs").alias("n")))
        a = F.call_function("div", F.col("pair"), F.lit(self.width))
        # at most one row per token of A: small by the vocabulary
        best = totals.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
        self.totals = totals.withColumn("a", a).join(F.broadcast(best), "a").select(
            "pair", "a", (F.col("pair") % self.width).alias("b"), "n",
            (F.col("n") == F.col("most")).alias("best"))

    def pairs(self) -> DataFrame:
        """(a, b, n): in how many documents each pair of ids is linked."""
        return self.totals.select("a", "b", "n")

    def documents(self) -> DataFrame:
        """The rows with n_a, n_b, n_groups, n_links, n_best (links to a pair that no other of its A
        id exceeds), count_sum (counts of the pairs of all links) and groups_sha256."""
        counts = self.listed.join(self.totals, "pair").select("_shard", "at", "n", "best")
        kept = [f for f in self.table.schema.fields if f.name not in ("_shard", "_links")]
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept]
                           + ["n_best bigint", "count_sum bigint"])
        joined = self.table.groupBy("_shard").cogroup(counts.groupBy("_shard")).applyInArrow(
            _counted, schema)
        return joined.select(*(
            F.col(f"c{at}").alias(name) for at, name in enumerate(self.names)), *_OUT)

    def drop(self) -> None:
        drop_table(self.spark, self.path)


def _width(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def _aligned(part: pa.RecordBatch, aligner: Aligner, shard: int) -> pa.RecordBatch:
    """The rows of a slice with their sums and links; the first row brings the slice's pairs."""
    found = _Sums(aligner, [text or "" for text in part.column(0).to_pylist()])
    pairs, at = np.unique(found.pair, return_inverse=True)
    docs = np.bincount(at, minlength=len(pairs))
    n = part.num_rows
    bounds = np.searchsorted(found.document, np.arange(n + 1))
    links = [_planes(at[lo:hi], found.times[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
    first = [True] + [False] * (n - 1)

    def once(values: np.ndarray) -> pa.Array:
        return pa.array([values.tobytes() if is_first else None for is_first in first], pa.binary())

    names = [field.name for field in part.schema][1:]
    return pa.RecordBatch.from_arrays(
        [*part.columns[1:], *map(pa.array, found.sums), pa.array(found.digests, pa.string()),
         pa.array(np.full(n, shard)), pa.array(links, pa.binary()),
         once(pairs.astype("<i8")), once(docs.astype("<u4"))],
        names=[*names, *_SUMS, "groups_sha256", "_shard", "_links", "_pairs", "_docs"])


def _planes(at: np.ndarray, times: np.ndarray) -> bytes:
    """Steps of the sorted numbers `at`, and `times`, byte plane by byte plane: all planes but the
    lowest are nearly constant, so that files and shuffles compress them."""
    rows = np.stack([np.diff(at, prepend=0), times]).astype("<i8")
    return rows.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes()


def _from_planes(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(packed, np.uint8).reshape(2, 8, -1)
    steps, times = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[..., 0]
    return np.cumsum(steps), times


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, at, pair, docs) of the lists of pairs."""
    for batch in batches:
        for shard, pairs, docs in zip(*(column.to_pylist() for column in batch.columns)):
            pair = np.frombuffer(pairs, "<i8")
            count = np.frombuffer(docs, "<u4").astype(np.int64)
            for lo in range(0, len(pair), 100_000):
                some = pair[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), shard)),
                    pa.array(np.arange(lo, lo + len(some), dtype=np.int32)),
                    pa.array(some), pa.array(count[lo:lo + 100_000]),
                ], names=["_shard", "at", "pair", "docs"])


def _counted(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a slice with the sums of their pairs' counts."""
    at = counts.column("at").to_numpy()
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at] = counts.column("n").to_numpy()
    best[at] = counts.column("best").to_numpy()
    n_best, count_sum = [], []
    for links in rows.column("_links").to_pylist():
        place, times = _from_planes(links)
        n_best.append(int((best[place] * times).sum()))
        count_sum.append(int((n[place] * times).sum()))
    kept = rows.drop_columns(["_shard", "_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(count_sum, pa.int64()))


def align(df: DataFrame, text_column: str, path_a: str, path_b: str,
          pattern: str = public_tokenizers.PATTERN,
          keep: Iterable[str] | None = None) -> DataFrame:
    """`df`, or its columns `keep`, with the columns of `Alignment.documents`, computed now; the working table is dropped."""
    job = Alignment(df, text_column, path_a, path_b, pattern, keep)
    result = settled(job.documents())
    job.drop()
    return result


def aligned_groups(df: DataFrame, text_column: str, path_a: str, path_b: str,
                   pattern: str = public_tokenizers.PATTERN, output: str = "groups") -> DataFrame:
    """`df` with the groups of each text as `array<struct<a:array<int>,b:array<int>>>`, in order; a
    text without tokens has none.  A column named `output` is replaced."""
    def make():
        aligner = _aligner(path_a, path_b, pattern)

        def run(texts: pa.Array) -> list[pa.Array]:
            said = [text or "" for text in texts.to_pylist()]
            found: list[list] = [[] for _ in said]
            bad = set()
            full = [at for at, text in enumerate(said) if text]
            for owner, ids_a, ids_b, groups, by, equal in aligner.chunks([said[at] for at in full]):
                bad.update(full[at] for at in owner[~equal])
                for (a, a_end, b, b_end), at in zip(groups.T, by):
                    found[full[at]].append({"a": ids_a[a:a_end], "b": ids_b[b:b_end]})
            for at in bad:
                found[at] = []
            kind = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
            return [pa.array(found, pa.list_(kind))]

        return run

    return with_computed(
        df, text_column, f"`{output}` array<struct<a:array<int>,b:array<int>>>", make, SLICE_BYTES)
