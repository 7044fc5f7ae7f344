"""A bounded memory of words and what is known about each, for use in one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Vocabulary:
    """Rows of numbers for words; each distinct word is worked out once. Between blocks of texts ``most`` words, of ``most_chars`` characters in all, are kept at most."""

    def __init__(self, learn: Callable[[list[str]], np.ndarray], most: int = 400_000, most_chars: int = 16_000_000):
        self.learn, self.most, self.most_chars = learn, most, most_chars
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table, self.used, self.chars = None, 0, 0

    def look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The places of the words of each text in ``table``; they hold until the next call."""
        if self.used > self.most or self.chars > self.most_chars:
            self._clear()
        found, missed = [], []
        for i, words in enumerate(texts):
            try:  # most texts have no word that is new
                found.append(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)))
            except KeyError:
                found.append(None)
                missed.append(i)
        if missed:
            self._learn(list(set().union(*[texts[i] for i in missed]).difference(self.place)))
            for i in missed:
                found[i] = np.fromiter(map(self.place.__getitem__, texts[i]), np.int64, len(texts[i]))
        return found

    def _learn(self, words: list[str]) -> None:
        rows = self.learn(words)
        if self.table is None:
            self.table = np.empty((max(1024, 2 * len(words)), rows.shape[1]), rows.dtype)
        while self.used + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[self.used : self.used + len(words)] = rows
        self.place.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)
        self.chars += sum(map(len, words))
