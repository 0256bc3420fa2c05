"""Words of UTF-8 texts as numbers, part by part, so that long texts need no list of all words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

PART_BYTES = 1 << 20


class Words:
    """Runs of certain bytes, after A-Z are lower-cased.  `letters` is the inside of a byte class; it
    takes bytes above 0x7F all or not at all, so that no character is cut."""

    def __init__(self, letters: bytes):
        self.word = re.compile(b"[" + letters + b"]+")
        self.gap = re.compile(b"[^" + letters + b"]")

    def parts(self, text: bytes) -> Iterator[list[bytes]]:
        at, lowered = 0, text.lower()  # of bytes: A-Z only
        while at < len(lowered):
            cut = self.gap.search(lowered, at + PART_BYTES)
            end = cut.start() if cut else len(lowered)
            yield self.word.findall(lowered, at, end)
            at = end

    def numbers(self, text: bytes, number: Callable[..., int], *rest: Iterable) -> np.ndarray:
        """`number(word, ...)` of every word, with further arguments from `rest`."""
        parts = [
            np.fromiter(map(number, words, *rest), np.int32, len(words))
            for words in self.parts(text)
        ]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def spans(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Byte ranges of the words."""
        return (found.span() for found in self.word.finditer(text.lower()))
