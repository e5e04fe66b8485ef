"""Ids of words that a Python worker keeps between batches, the words least recently used forgotten first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Remembered:
    """Words with their ids, one word's after the other's. Beyond ``limit`` words the more recently used half stays."""

    def __init__(self, kind: type, limit: int):
        self.limit, self.now = limit, 0
        self.place: dict[str, int] = {}
        self._starts, self._ids = np.zeros(1025, np.int64), np.zeros(1 << 14, kind)
        self._used = np.zeros(1024, np.int64)

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Remember new words; the arrays grow by doubling, so adding costs what is added."""
        n, m = len(self.place), len(self.place) + len(words)
        self.place.update(zip(words, range(n, m), strict=True))
        if m > len(self._used):
            room = max(m, 2 * len(self._used))
            self._used = np.concatenate([self._used[:n], np.zeros(room - n, np.int64)])
            self._starts = np.concatenate([self._starts[: n + 1], np.zeros(room - n, np.int64)])
        ends = self._starts[n] + np.cumsum(size, dtype=np.int64)
        self._starts[n + 1 : m + 1] = ends
        end = int(self._starts[m])
        if end > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._starts[n]], np.zeros(max(end, 2 * len(self._ids)) - self._starts[n], self._ids.dtype)])
        self._ids[self._starts[n] : end] = ids
        self._used[n:m] = self.now

    def places(self, words: list[str], learn: Callable[[list[str]], None]) -> np.ndarray:
        """Place of each of these distinct words; ``learn`` adds those that are not remembered."""
        self.now += 1
        if len(self.place) > self.limit:
            self._forget()
        get = self.place.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            learn([words[i] for i in new.tolist()])
            found[new] = np.fromiter((self.place[words[i]] for i in new.tolist()), np.int64, len(new))
        self._used[found] = self.now
        return found

    def _forget(self) -> None:
        n = len(self.place)
        used = self._used[:n]
        kept = np.sort(np.argsort(-used, kind="stable")[: n // 2])
        ids, ends = self.gather(kept)
        words = list(self.place)
        self.place = {words[i]: k for k, i in enumerate(kept.tolist())}
        self._used = used[kept]
        self._starts, self._ids = ends, ids

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``places``, one word after the other, and their offsets."""
        begin = self._starts[places]
        size = self._starts[places + 1] - begin
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        return self._ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends
