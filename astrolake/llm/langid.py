"""Language identification of words in code-switched text by a linear-chain conditional random field.

Every word has features: its prefixes and suffixes, its character n-grams, and membership in the
lexicon of each language (frequent words of the training sample).  Feature weights and the
transitions between the languages of neighbouring words are learned together by maximising the
conditional likelihood.  Forward-backward gives each word's distribution over languages; a document
takes the language with the largest mean.

Training uses a bounded sample of labelled rows (see `train`); prediction reads every word of every
text.  The chains of all documents of a slice are one stream, cut into chunks of equal length: a
product of transition matrices per chunk is computed for all chunks at once, so the time does not
depend on the length of a document.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolake.llm.arrow import with_computed

UNKNOWN = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
CHUNK = 64
# Numbers that the products of a slice, and the scores of the words met so far, hold at most.
PRODUCT_NUMBERS = 1 << 24
CACHED_NUMBERS = 1 << 23
CACHED_WORDS = 200_000
# Characters of a whole training sample, and languages of a model.
SAMPLE_CHARS = 64_000_000
MOST_LANGUAGES = 250
_HASH = np.uint64(0x9E3779B97F4A7C15)
_BEGIN, _END = 0x110000, 0x110001
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased words with at least one letter."""
    if not text:
        return []
    found = _WORDS(text.lower())
    return found if text.isascii() else [w for w in found if any(map(str.isalpha, w))]


def _mixed(kind: int, *codes: np.ndarray) -> np.ndarray:
    """Bucket of each combination of code points, by multiplication and shift."""
    value = np.full(len(codes[0]), kind, np.uint64)
    for code in codes:
        value = (value + code) * _HASH
        value ^= value >> np.uint64(29)
    return (value * _HASH >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def form_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all features of the words' forms, ordered by word: prefixes and suffixes of
    up to three letters, all n-grams of two and three letters with the edges of the word, and its
    length.  Repeated n-grams count each time."""
    sizes = np.array([len(word) for word in words], np.int64)
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    # edges are code points that no text has
    width = sizes + 2
    stop = np.cumsum(width)
    begin = stop - width
    codes = np.full(stop[-1] if len(stop) else 0, _BEGIN, np.uint64)
    codes[np.arange(len(text)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + 1] = text
    codes[stop - 1] = _END
    owner = np.repeat(np.arange(len(words)), width)
    found = [(np.arange(len(words)), _mixed(9, np.minimum(sizes, 12).astype(np.uint64)))]
    for n in (1, 2, 3):
        long = np.flatnonzero(sizes >= n)
        first, last = begin[long] + 1, stop[long] - 1 - n
        found.append((long, _mixed(n, *(codes[first + i] for i in range(n)))))
        found.append((long, _mixed(3 + n, *(codes[last + i] for i in range(n)))))
    for n in (2, 3):
        inside = np.flatnonzero(owner[n - 1:] == owner[:len(owner) - n + 1])
        found.append((owner[inside], _mixed(5 + n, *(codes[inside + i] for i in range(n)))))
    at, bucket = (np.concatenate(part) for part in zip(*found))
    order = np.argsort(at, kind="stable")
    return at[order], bucket[order]


@dataclass
class Model:
    """Languages in order, feature weights, transition and start scores, lexicons."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    lexicon: dict[str, tuple[int, ...]]

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, row of the weights) of all features, ordered by word.  Every word has some."""
        at, row = form_features(words)
        listed = [(i, BUCKETS + k) for i, word in enumerate(words) for k in self.lexicon.get(word, ())]
        if listed:
            more = np.array(listed, np.int64).T
            at, row = np.concatenate([at, more[0]]), np.concatenate([row, more[1]])
            order = np.argsort(at, kind="stable")
            at, row = at[order], row[order]
        return at, row

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores (words, languages)."""
        if not words:
            return np.zeros((0, len(self.languages)))
        at, row = self.features(words)
        return np.add.reduceat(self.weights[row], np.searchsorted(at, np.arange(len(words))), axis=0)


def posteriors(scores: np.ndarray, first: np.ndarray, moves: np.ndarray,
               starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Word posteriors (words, languages) of a stream of chains by forward-backward.

    `first` marks the first word of each chain; there the transition matrix is replaced by the start
    vector in every row, which cuts the stream exactly.
    """
    n, size = scores.shape
    if not n:
        return scores
    chunk = max(chunk, -(-n * size * size // PRODUCT_NUMBERS))
    count = -(-n // chunk)
    local = np.ones((count * chunk, size))
    local[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    local = local.reshape(count, chunk, size)
    # Padding behind the last word is a chain of its own.
    begins = np.ones(count * chunk, bool)
    begins[:n] = first
    begins = begins.reshape(count, chunk)
    move, start = np.exp(moves - moves.max()), np.exp(starts - starts.max())

    def step(t: int) -> np.ndarray:
        matrix = np.where(begins[:, t, None, None], start, move)
        return matrix * local[:, t, None, :]

    product = np.broadcast_to(np.eye(size), (count, size, size))
    for t in range(chunk):
        product = product @ step(t)
        product = product / product.max(axis=(1, 2), keepdims=True)
    ahead, back = np.ones((count, size)), np.ones((count, size))
    for c in range(1, count):
        value = ahead[c - 1] @ product[c - 1]
        ahead[c] = value / value.sum()
    for c in range(count - 2, -1, -1):
        value = product[c + 1] @ back[c + 1]
        back[c] = value / value.sum()
    out = np.empty((count, chunk, size))
    for t in range(chunk):
        ahead = np.einsum("ci,cij->cj", ahead, step(t))
        ahead /= ahead.sum(axis=1, keepdims=True)
        out[:, t] = ahead
    for t in range(chunk - 1, -1, -1):
        out[:, t] *= back
        if t:
            back = np.einsum("cij,cj->ci", step(t), back)
            back /= back.sum(axis=1, keepdims=True)
    out = out.reshape(-1, size)[:n]
    return out / out.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, str]], seed: int = 7, sequence: int = 48, sequences: int = 4000,
        epochs: int = 4, lexicon_size: int = 2000) -> Model:
    """Train on (language, text) pairs.

    However many texts there are, the model learns from `sequences` chains.  They are code-switched:
    runs of 4 to 24 words, each cut from anywhere in a text, follow one another until `sequence`
    words are reached.  So transitions are seen within and between languages.  Steps are Adagrad over
    mini-batches of chains.
    """
    languages = sorted({language for language, _ in samples})
    texts = {language: [] for language in languages}
    for language, text in sorted(samples):
        found = words_of(text)
        if found:
            texts[language].append(found)
    languages = [language for language in languages if texts[language]]
    size = len(languages)
    if not size:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0), {})
    lexicon: dict[str, tuple[int, ...]] = {}
    for at, language in enumerate(languages):
        counts = Counter(word for found in texts[language] for word in found)
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]
        for word, n in top:
            if n > 1:
                lexicon[word] = (*lexicon.get(word, ()), at)
    model = Model(languages, np.zeros((BUCKETS + size, size)), np.zeros((size, size)),
                  np.zeros(size), lexicon)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    chains = np.empty((sequences, sequence), np.int64)
    truth = np.empty((sequences, sequence), np.int64)
    for row in range(sequences):
        at = 0
        language = int(rng.integers(size))
        while at < sequence:
            found = texts[languages[language]][int(rng.integers(len(texts[languages[language]])))]
            want = min(int(rng.integers(4, 25)), sequence - at, len(found))
            begin = int(rng.integers(len(found) - want + 1))
            for word in found[begin:begin + want]:
                chains[row, at] = vocabulary.setdefault(word, len(vocabulary))
                truth[row, at] = language
                at += 1
            language = int(rng.integers(size))
    owner, flat = model.features(list(vocabulary))
    begins = np.searchsorted(owner, np.arange(len(vocabulary)))
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.moves, model.starts)]
    one = np.eye(size)
    batch = 100
    for _ in range(epochs):
        for rows in rng.permutation(sequences).reshape(-1, batch):
            emission = np.add.reduceat(model.weights[flat], begins, axis=0)[chains[rows]]
            posterior, pairs = _expectations(emission, model.moves, model.starts)
            target = one[truth[rows]]
            lift = (target - posterior).reshape(-1, size)
            by_word = np.stack([
                np.bincount(chains[rows].ravel(), lift[:, k], len(vocabulary)) for k in range(size)
            ], axis=1)
            touched = np.flatnonzero(by_word.any(axis=1))
            used = np.isin(owner, touched, kind="table")
            gradient = np.stack([
                np.bincount(flat[used], by_word[owner[used], k], BUCKETS + size)
                for k in range(size)
            ], axis=1)
            seen = np.einsum("nti,ntj->ij", target[:, :-1], target[:, 1:])
            gradients = (gradient, seen - pairs, target[:, 0].sum(0) - posterior[:, 0].sum(0))
            for value, change, square in zip(
                (model.weights, model.moves, model.starts), gradients, squares
            ):
                change = change / batch - 1e-4 * value
                square += change * change
                value += 0.1 * change / np.sqrt(square)
    return model


def _expectations(emission: np.ndarray, moves: np.ndarray,
                  starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and expected transition counts of chains of one length."""
    local = np.exp(emission - emission.max(axis=2, keepdims=True))
    move, start = np.exp(moves - moves.max()), np.exp(starts - starts.max())
    length = local.shape[1]
    ahead, back = np.empty_like(local), np.ones_like(local)
    value = start * local[:, 0]
    for t in range(length):
        if t:
            value = ahead[:, t - 1] @ move * local[:, t]
        ahead[:, t] = value / value.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        value = (back[:, t + 1] * local[:, t + 1]) @ move.T
        back[:, t] = value / value.sum(axis=1, keepdims=True)
    posterior = ahead * back
    posterior /= posterior.sum(axis=2, keepdims=True)
    # of each step: ahead_i * move_ij * behind_j, scaled to 1; the sum over steps is one product
    behind = (local * back)[:, 1:].reshape(-1, local.shape[2])
    before = ahead[:, :-1].reshape(behind.shape)
    before = before / ((before @ move) * behind).sum(axis=1, keepdims=True)
    return posterior, move * (before.T @ behind)


def held_out(id_column: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, id_column: str, text_column: str, language_column: str,
          per_language: int = 400, max_chars: int = 20_000) -> Model:
    """Fit on a sample of `df`: at most `per_language` distinct texts for each language.  Only rows
    with id, text and language whose id is not held out are seen.

    Of a text longer than `max_chars` characters a stretch of that length is taken, from a position
    given by a hash of the text; words at its ends may be cut.  The whole sample holds at most
    `SAMPLE_CHARS` characters: with many languages the stretches are shorter, and no language is left
    out.  More than `MOST_LANGUAGES` languages, which no model could hold, are an error.

    The sample is drawn by a hash of the text, from distinct texts.  Two small aggregations of the
    hashes size the draw, so that only about the stretches wanted are moved.
    """
    usable = df.where(
        F.col(id_column).isNotNull() & ~held_out(id_column)
        & F.col(text_column).isNotNull() & F.col(language_column).isNotNull()
    ).select(
        F.col(language_column).alias("language"), F.col(text_column).alias("text"),
        F.xxhash64(text_column).alias("draw"),
    )
    share = usable.select("language", "draw").distinct().groupBy("language").agg(
        F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.count("*")).alias("share")
    )
    shares = share.limit(MOST_LANGUAGES + 1).collect()
    if not shares:
        return fit([])
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    longest = max(1, min(max_chars, SAMPLE_CHARS // (len(shares) * per_language)))
    begin = F.pmod(F.xxhash64("draw"), F.length("text") - longest + 1).cast("int") + 1
    stretch = F.when(F.length("text") <= longest, F.col("text")).otherwise(
        F.substring("text", begin, F.lit(longest)))
    known = df.sparkSession.createDataFrame(shares, share.schema)
    drawn = usable.join(F.broadcast(known), "language").where(
        F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20)
    ).select("language", stretch.alias("text"), "draw").distinct()
    order = Window.partitionBy("language").orderBy("draw", "text")
    rows = drawn.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)
    return fit([(row.language, row.text) for row in rows.select("language", "text").collect()])


def predict(df: DataFrame, text_column: str, model: Model, language_output: str = "lang_pred",
            score_output: str = "score") -> DataFrame:
    """`df` with the predicted language and its mean posterior, from the text alone.

    A null text, one without letters, or a model without languages gives `und` and score 0.  Equal
    means go to the language that sorts first.  Columns named like the outputs are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        labels = shared.value
        index: dict[str, int] = {}
        known = np.zeros((0, len(labels.languages)))
        uses = np.zeros(0, np.int64)
        most = min(CACHED_WORDS, CACHED_NUMBERS // max(1, len(labels.languages)))

        def run(texts: pa.Array) -> list[pa.Array]:
            nonlocal known, uses
            if len(index) > most:
                # words met only once are forgotten, or all if too many are left
                again = uses > 1
                again &= again.sum() <= most // 2
                kept = [word for word, at in index.items() if again[at]]
                known, uses = known[again], np.ones(len(kept), np.int64)
                index.clear()
                index.update(zip(kept, range(len(kept))))
            split = [words_of(text) for text in texts.to_pylist()]
            counts = np.array([len(x) for x in split], np.int64)
            languages = np.full(len(split), UNKNOWN, object)
            means = np.zeros(len(split))
            full = np.flatnonzero(counts)
            if len(full) and labels.languages:
                new = [w for w in set().union(*split) if w not in index]
                if new:
                    index.update(zip(new, range(len(index), len(index) + len(new))))
                    known = np.concatenate([known, labels.scores(new)])
                    uses = np.concatenate([uses, np.zeros(len(new), np.int64)])
                at = np.fromiter(
                    map(index.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
                uses += np.bincount(at, minlength=len(uses))
                begin = np.cumsum(counts[full]) - counts[full]
                first = np.zeros(len(at), bool)
                first[begin] = True
                shares = posteriors(known[at], first, labels.moves, labels.starts)
                mean = np.add.reduceat(shares, begin, axis=0) / counts[full][:, None]
                best = mean.argmax(axis=1)
                languages[full] = np.array(labels.languages, object)[best]
                means[full] = np.clip(mean[np.arange(len(best)), best], 0.0, 1.0)
            return [pa.array(languages, pa.string()), pa.array(means)]

        return run

    return with_computed(df, text_column,
                         f"`{language_output}` string, `{score_output}` double", make)
