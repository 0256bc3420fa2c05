"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans of four kinds.  Around them and around everything else that has digits
or an at sign, a semi-Markov model labels whole segments: features look at a complete candidate span
(digit count, grouping, checksum, shape, neighbours), and a dynamic program over bounded segments
chooses boundaries and kinds jointly.  Spans it finds apart from the base ones are added.

A text is cut into clusters before: maximal runs of chunks with a digit or at sign, one space apart.
Candidates must contain one of these, so everything between clusters is outside any span and the
program over a cluster is the program over the text.  All scans are linear in the text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.llm.arrow import with_computed

KINDS = ("email", "ip", "card", "phone")
RANK = {kind: at for at, kind in enumerate(KINDS)}
Span = tuple[int, int, str]

# Longest candidate in tokens, and hashed feature space of the model.
SEGMENT = 16
BUCKETS = 1 << 14

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]").match
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer  # (...)+ would be quadratic in digits
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_CHUNK = re.compile(r"[0-9@]\S*").finditer
_TOKENS = re.compile(r"[0-9]+|[^\W\d_]+|\S").finditer
_SHAPES = ((re.compile(r"[0-9]+").sub, "9"), (re.compile(r"[^\W\d_]+").sub, "a"))
_LUHN_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_LUHN_DOUBLE[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _emails(text: str) -> list[Span]:
    """The local part of a match is everything allowed before its at sign, back to the last match;
    so at signs are looked at from left to right and nothing is scanned twice."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > low and _LOCAL(text, begin - 1):
            begin -= 1
        domain = _DOMAIN(text, at + 1) if begin < at else None
        low = at + 1
        if domain:
            out.append((begin, domain.end(), "email"))
            low = domain.end()
        at = text.find("@", low)
    return out


def _addresses(text: str) -> list[Span]:
    """Each run of dotted numbers is taken four numbers at a time."""
    out = []
    for run in _DOTTED(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append((at, at + size, "ip"))
            at += size + 1
    return out


def _cards(text: str) -> list[Span]:
    out = []
    for run in _DIGITS(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((run.start(), run.end(), "card"))
    return out


def _phones(text: str) -> list[Span]:
    out = []
    at = text.find("+")
    while at >= 0:
        found = _PHONE(text, at)
        if found:
            if 9 <= sum(map(str.isdigit, found.group())) <= 15:
                out.append((at, found.end(), "phone"))
            at = text.find("+", found.end())
        else:
            at = text.find("+", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Pattern matches, leftmost and non-overlapping per kind, by start and then kind."""
    found = _emails(text) + _addresses(text) + _cards(text) + _phones(text)
    return sorted(found, key=lambda span: (span[0], RANK[span[2]]))


@dataclass
class Cluster:
    """Tokens of one cluster, as (start, end) in the text."""

    begin: int
    tokens: list[tuple[int, int]]


def clusters(text: str) -> list[Cluster]:
    out, begin, end = [], -1, -2
    for chunk in _CHUNK(text):
        lo, hi = chunk.span()
        while lo > max(end, 0) and not text[lo - 1].isspace():
            lo -= 1
        if begin >= 0 and lo <= end + 1:
            end = hi
            continue
        if begin >= 0:
            out.append((begin, end))
        begin, end = lo, hi
    if begin >= 0:
        out.append((begin, end))
    return [Cluster(lo, [m.span() for m in _TOKENS(text, lo, hi)]) for lo, hi in out]


def span_features(text: str, lo: int, hi: int) -> tuple[str, ...]:
    """Features of a whole candidate span."""
    part = text[lo:hi]
    digits = "".join(c for c in part if "0" <= c <= "9")
    shape = part
    for sub, mark in _SHAPES:
        shape = sub(mark, shape)
    left = text[lo - 1] if lo else " "
    right = text[hi] if hi < len(text) else " "
    names = [
        f"d{min(len(digits), 20)}", f"s{shape[:24]}", f"at{part.count('@')}",
        f"l{'a' if left.isalnum() else 's' if left.isspace() else left}",
        f"r{'a' if right.isalnum() else 's' if right.isspace() else right}",
        "plus" if part[0] == "+" else "open" if part[0] == "(" else "plain",
    ]
    if 12 <= len(digits) <= 19 and "a" not in shape:
        names.append("luhn" if luhn(digits) else "no-luhn")
    numbers = part.split(".")
    if len(numbers) == 4 and shape == "9.9.9.9":
        names.append("octets" if all(map(_small, numbers)) else "no-octets")
    if "@" in part:
        names.append("domain" if _DOMAIN(part, part.index("@") + 1) else "no-domain")
    return tuple(names)


def candidates(text: str, cluster: Cluster) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first token, token after, features) of the spans that may be an entity."""
    out = []
    tokens = cluster.tokens
    for i, (lo, head) in enumerate(tokens):
        if not (text[lo].isalnum() or text[lo] in "+("):
            continue
        digits, mark = 0, False
        for j in range(i, min(i + SEGMENT, len(tokens))):
            a, b = tokens[j]
            if "0" <= text[a] <= "9":
                digits += b - a
            mark |= text[a] == "@"
            if (mark or digits >= 4) and text[b - 1].isalnum():
                out.append((i, j + 1, span_features(text, lo, b)))
    return out


class Model:
    """Segment weights per kind, and transition scores between segment labels (0 is outside)."""

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, len(KINDS)))
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self._known: dict[tuple[str, ...], list[float]] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "moves": self.moves, "_known": {}}

    @staticmethod
    def hashed(features: tuple[str, ...]) -> list[int]:
        return [zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in features]

    def score(self, features: tuple[str, ...]) -> list[float]:
        found = self._known.get(features)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            found = self.weights[self.hashed(features)].sum(axis=0).tolist()
            self._known[features] = found
        return found

    def gains(self) -> list[float]:
        """The most that a segment's transitions, for each kind, bring over a walk outside between
        the same neighbours, without the steps from outside to outside of that walk."""
        moves = self.moves
        into = (moves[:, 1:] - moves[:, :1]).max(axis=0)
        onward = (moves[1:] - moves[:1]).max(axis=1)
        return (into + np.maximum(onward, 0.0)).tolist()  # nothing follows the last segment

    def decode(self, text: str, cluster: Cluster) -> list[Span]:
        """The best segmentation of a cluster: Viterbi over segments.

        Left out are only segments that staying outside beats whatever stands beside them.
        """
        found = candidates(text, cluster)
        if not found:
            return []
        n, labels = len(cluster.tokens), len(KINDS) + 1
        moves = self.moves.T.tolist()  # [label][label before]
        gains, outside = self.gains(), moves[0][0]
        ending: list[list[tuple[int, list[float]]]] = [[] for _ in range(n + 1)]
        for i, j, features in found:
            score = self.score(features)
            stay = (j - i - 1) * outside - 1e-9
            if any(x + gain >= stay for x, gain in zip(score, gains)):
                ending[j].append((i, score))
        best = [[0.0] + [-1e30] * (labels - 1)]
        back: list[list[tuple[int, int]]] = [[(0, 0)] * labels]
        enter: list[list[tuple[float, int]]] = []
        for j in range(n + 1):
            if j:
                value, label = enter[j - 1][0]
                row, origin = [value] + [-1e30] * (labels - 1), [(j - 1, label)] * labels
                for i, score in ending[j]:
                    for kind in range(1, labels):
                        before, label = enter[i][kind]
                        if before + score[kind - 1] > row[kind]:
                            row[kind], origin[kind] = before + score[kind - 1], (i, label)
                best.append(row)
                back.append(origin)
            row = best[j]
            enter.append([
                max((row[y] + move[y], -y) for y in range(labels)) for move in moves
            ])
            enter[j] = [(value, -y) for value, y in enter[j]]
        label = max(range(labels), key=lambda y: (best[n][y], -y))
        out, j = [], n
        while j:
            i, before = back[j][label]
            if label:
                out.append((cluster.tokens[i][0], cluster.tokens[j - 1][1], KINDS[label - 1]))
            j, label = i, before
        return out[::-1]


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values)) if top > -1e29 else -1e30


def _variants(text: str, span: Span) -> list[str]:
    """Spellings of a span outside the patterns, to learn from."""
    part = text[span[0]:span[1]]
    if span[2] == "phone":
        return [part[1:], part[1:].replace("(", "").replace(")", "")]
    if span[2] == "card":
        digits = re.sub(r"[^0-9]", "", part)
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    return []


def _decoys(rng: np.random.Generator, count: int) -> list[str]:
    """Numbers and marks that are no personal data: dates, times, versions, amounts, codes."""
    out = []
    for _ in range(count):
        a, b, c, d = (int(x) for x in rng.integers([1900, 1, 1, 0], [2100, 13, 29, 100_000]))
        out += [
            f"{a}-{b:02}-{c:02}", f"{c}.{b}.{a}", f"{b}/{c}/{a}", f"{b}:{c:02}:{c:02}",
            f"v{b}.{c}.{d}", f"{b}.{c}", f"{d},{a}.{c:02}", f"{d}", f"{d}{a}", f"{a}-{a + b}",
            f"a{b}@b", f"@user{d}", f"{d}.{a}.{d}", f"{c} {b} {d}", f"{d}x{a}",
        ]
    return out


def training_cases(texts: list[str]) -> list[tuple[str, Cluster, list[Span]]]:
    """Clusters with their true spans: the base spans, longest first where kinds overlap, and
    variants of them in the same surroundings."""
    out = []
    for text in texts:
        spans = base_spans(text)
        for cluster in clusters(text):
            lo, hi = cluster.begin, cluster.tokens[-1][1]
            gold: list[Span] = []
            for span in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
                if lo <= span[0] and span[1] <= hi and all(
                    span[1] <= g[0] or g[1] <= span[0] for g in gold
                ):
                    gold.append(span)
            around = text[max(0, lo - 40):hi + 40]
            shift = max(0, lo - 40)
            out.append((around, [(a - shift, b - shift, k) for a, b, k in gold], lo - shift))
            for a, b, kind in gold:
                for new in _variants(text, (a, b, kind)):
                    if len(gold) == 1:
                        changed = text[shift:a] + new + text[b:hi + 40]
                        out.append((changed, [(a - shift, a - shift + len(new), kind)], lo - shift))
    cases = []
    for text, gold, begin in out:
        for cluster in clusters(text):
            if cluster.begin <= begin <= cluster.tokens[-1][1]:
                cases.append((text, cluster, sorted(gold)))
                break
    return cases


def drawn_cases(cases: list[tuple[str, Cluster, list[Span]]], most: int,
                rng: np.random.Generator) -> list[tuple[str, Cluster, list[Span]]]:
    """At most `most` cases, drawn per kind: each kind, and clusters without any, has an equal share,
    and what a rare one leaves of its share goes to the others.  A case of several kinds counts for
    the rarest of them."""
    shuffled = [cases[i] for i in rng.permutation(len(cases))]
    if len(shuffled) <= most:
        return shuffled
    counts = dict.fromkeys(("", *KINDS), 0)
    for _, _, gold in shuffled:
        for kind in {k for _, _, k in gold} or {""}:
            counts[kind] += 1
    kinds = [min({k for _, _, k in gold} or {""}, key=lambda k: (counts[k], k))
             for _, _, gold in shuffled]
    left, wanted = most, {}
    order = sorted(counts, key=lambda k: (kinds.count(k), k))
    for at, kind in enumerate(order):
        wanted[kind] = min(kinds.count(kind), left // (len(order) - at))
        left -= wanted[kind]
    out = []
    for case, kind in zip(shuffled, kinds):
        if wanted[kind]:
            wanted[kind] -= 1
            out.append(case)
    return out


def fit(texts: list[str], epochs: int = 5, most_cases: int = 2000, seed: int = 5) -> Model:
    """Train by gradient steps on the conditional likelihood of the segmentations.

    Expectations come from the semi-Markov forward-backward recursions.  At most `most_cases` of the
    clusters in the texts are learned from, drawn per kind (see `drawn_cases`), and 900 decoys.
    Without any case the model finds nothing.
    """
    model = Model()
    rng = np.random.default_rng(seed)
    cases = drawn_cases(training_cases(sorted(texts)), most_cases, rng)
    if cases:
        cases += [(f"of {x} and", clusters(f"of {x} and")[0], []) for x in _decoys(rng, 60)]
    labels = len(KINDS) + 1
    prepared = []
    for text, cluster, gold in cases:
        starts = {a: i for i, (a, _) in enumerate(cluster.tokens)}
        ends = {b: i + 1 for i, (_, b) in enumerate(cluster.tokens)}
        true = {(starts.get(a), ends.get(b)): KINDS.index(k) + 1 for a, b, k in gold}
        found = [(i, j, Model.hashed(f)) for i, j, f in candidates(text, cluster)]
        if found and set(true) <= {(i, j) for i, j, _ in found}:
            prepared.append((len(cluster.tokens), found, true))
    if not prepared:
        return model
    model.weights -= 0.05  # unseen features speak against an entity
    square_w, square_m = np.full(model.weights.shape, 1e-3), np.full(model.moves.shape, 1e-3)
    for _ in range(epochs):
        for at in rng.permutation(len(prepared)):
            n, found, true = prepared[at]
            scores = [model.weights[f].sum(axis=0).tolist() for _, _, f in found]
            moves = model.moves.tolist()
            by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for c, (i, j, _) in enumerate(found):
                by_end[j].append(c)
                by_start[i].append(c)
            ahead = [[0.0] + [-1e30] * (labels - 1)]
            for j in range(1, n + 1):
                row = [_logsum([ahead[j - 1][y] + moves[y][0] for y in range(labels)])]
                for kind in range(1, labels):
                    terms = [
                        ahead[found[c][0]][y] + moves[y][kind] + scores[c][kind - 1]
                        for c in by_end[j] for y in range(labels)
                    ]
                    row.append(_logsum(terms) if terms else -1e30)
                ahead.append(row)
            behind = [[0.0] * labels for _ in range(n + 1)]
            for i in range(n - 1, -1, -1):
                for y in range(labels):
                    terms = [moves[y][0] + behind[i + 1][0]] + [
                        moves[y][kind] + scores[c][kind - 1] + behind[found[c][1]][kind]
                        for c in by_start[i] for kind in range(1, labels)
                    ]
                    behind[i][y] = _logsum(terms)
            total = behind[0][0]
            change_m = np.zeros_like(model.moves)
            gradient: dict[int, np.ndarray] = {}
            for i in range(n):
                for y in range(labels):
                    if ahead[i][y] > -1e29:
                        change_m[y][0] -= exp(min(0.0, ahead[i][y] + moves[y][0]
                                                  + behind[i + 1][0] - total))
            for c, (i, j, features) in enumerate(found):
                lift = np.zeros(len(KINDS))
                for kind in range(1, labels):
                    for y in range(labels):
                        if ahead[i][y] > -1e29:
                            p = exp(min(0.0, ahead[i][y] + moves[y][kind] + scores[c][kind - 1]
                                        + behind[j][kind] - total))
                            lift[kind - 1] -= p
                            change_m[y][kind] -= p
                if (i, j) in true:
                    lift[true[i, j] - 1] += 1
                if np.abs(lift).max() > 1e-4:
                    for f in features:
                        gradient[f] = gradient.get(f, 0) + lift
            at_token, before = 0, 0
            starts = {i: (j, kind) for (i, j), kind in true.items()}
            while at_token < n:
                step, label = starts.get(at_token, (at_token + 1, 0))
                change_m[before][label] += 1
                at_token, before = step, label
            for f, change in gradient.items():
                square_w[f] += change * change
                model.weights[f] += 0.2 * change / np.sqrt(square_w[f])
            square_m += change_m * change_m
            model.moves += 0.1 * change_m / np.sqrt(square_m)
    return model


def train(df: DataFrame, text_column: str, rows: int = 2000, max_chars: int = 20_000) -> Model:
    """Fit on a bounded sample: `rows` distinct texts of at most `max_chars` characters with a digit
    or an at sign, drawn by the smallest hashes of the text."""
    drawn = df.select(F.col(text_column).alias("text")).where(
        (F.length("text") <= max_chars) & F.col("text").rlike("[0-9@]")
    ).select(F.xxhash64("text").alias("draw")).distinct()
    # The smallest hashes first, without the texts; then the texts below that bound, copies folded.
    smallest = [row.draw for row in drawn.orderBy("draw").limit(rows).collect()]
    if not smallest:
        return Model()
    texts = df.select(F.col(text_column).alias("text"), F.xxhash64(text_column).alias("draw")).where(
        (F.col("draw") <= smallest[-1]) & (F.length("text") <= max_chars)
        & F.col("text").rlike("[0-9@]")
    ).distinct().orderBy("draw", "text").limit(rows).collect()
    return fit([row.text for row in texts])


def spans_of(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those the model adds."""
    base = base_spans(text)
    starts = sorted((lo, hi) for lo, hi, _ in base)
    reach = 0
    ends = [reach := max(reach, hi) for _, hi in starts]
    begins = [lo for lo, _ in starts]
    added = []
    for cluster in clusters(text):
        for span in model.decode(text, cluster):
            before = bisect_left(begins, span[1])  # base spans that begin before this one ends
            if not before or ends[before - 1] <= span[0]:
                added.append(span)
    return base, sorted(base + added, key=lambda span: (span[0], RANK[span[2]]))


def _arrow_spans(rows: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array(
        [[{"kind": k, "start": lo, "end": hi} for lo, hi, k in row] for row in rows], kind
    )


def find(df: DataFrame, text_column: str, model: Model, base_output: str = "base_spans",
         output: str = "spans") -> DataFrame:
    """`df` with the base spans and all spans of a text, as arrays of (kind, start, end) in code
    points, end exclusive, by start and then kind.

    A null text counts as empty.  Columns named like the outputs are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            found = [spans_of(text or "", shared.value) for text in texts.to_pylist()]
            return [_arrow_spans([x for x, _ in found]), _arrow_spans([x for _, x in found])]

        return run

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return with_computed(df, text_column, f"`{base_output}` {kind}, `{output}` {kind}", make)


def redacted(text: str, spans: list[Span]) -> str:
    """`text` with each span replaced by its kind; overlapping spans become the first one."""
    out, at = [], 0
    for lo, hi, kind in spans:
        if lo >= at:
            out += (text[at:lo], f"<{kind.upper()}>")
        at = max(at, hi)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_column: str, model: Model) -> DataFrame:
    """`df` with all personal data in a text column replaced.  A null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([
                None if text is None else redacted(text, spans_of(text, shared.value)[1])
                for text in texts.to_pylist()
            ], pa.string())]

        return run

    return with_computed(df, text_column, "`_redacted` string", make).select(*(
        F.col("_redacted").alias(name) if name == text_column else F.col(name) for name in names
    ))
