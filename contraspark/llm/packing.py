"""Sum-of-squares packing of tokenised documents into fixed windows.

Each document is placed online into the fill level that makes the sum over levels of (number of open
windows at that level) squared smallest; an array counts the open windows of each level. The pieces
of a window are returned when it is full.

Every task packs the rows of its own partition in their order, so nothing is shuffled, and a task
that is run again makes the same windows. Window numbers hold the partition in their upper bits.

Documents of ``window`` ids or more first fill whole windows; the rest is placed. No number of open
windows is set: a task holds the rests in its open windows, at most the ids of its own partition,
whose size ``spark.sql.files.maxPartitionBytes`` bounds. When the rows end nothing is placed online
any more: the windows still open are closed from the fullest on with pieces cut from the emptiest,
and what is left over is cut into windows whose lengths are powers of two, which need no padding.

Defined cases: a null text counts as empty, so its document is the end id alone. Repeated rows and
repeated or null doc_ids are separate documents. Levels of equal growth: the fullest is taken, and an
open window before a new one. A text of any length is encoded as a whole. Columns other than doc_id
and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from contraspark.llm.common import slices, text_bytes
from contraspark.llm.remembered import Remembered
from contraspark.llm.words import LOWER, SPACE

WINDOW = 4096
#: Distinct words whose ids a Python worker remembers between batches.
CACHE_WORDS = 300_000
#: Text bytes encoded at once.
ENCODE_BYTES = 2 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PARTITION_BITS = 40
#: New units encoded in one call.
_TOGETHER = 100
_LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])


class Packer:
    """Open windows of one task. ``place`` takes a document and returns finished pieces.

    A piece is (document, start, ids, window, offset); a document is any object, ids any sequence.
    """

    def __init__(self, window: int = WINDOW, first_window: int = 0):
        self.window, self.next = window, first_window
        self.count = np.zeros(window + 1, np.int64)  # open windows of each fill level
        self.open: dict[int, list[int]] = defaultdict(list)  # level -> windows
        self.held: dict[int, list[tuple]] = {}  # window -> pieces so far

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _put(self, level: int, document: object, start: int, ids: Sequence) -> list[tuple]:
        """Put a piece into a window of that level; 0 opens one. Returns the pieces of a window that is full."""
        if level:
            number = self.open[level].pop()
            self.count[level] -= 1
        else:
            number = self._new()
            self.held[number] = []
        self.held[number].append((document, start, ids, number, level))
        level += len(ids)
        if level == self.window:
            return self.held.pop(number)
        self.open[level].append(number)
        self.count[level] += 1
        return []

    def _level(self, size: int) -> int:
        """The level for a document of ``size`` ids: smallest growth of the sum of squares, the fullest of equals."""
        n, w = self.count, self.window
        levels = np.flatnonzero(n[1 : w - size + 1]) + 1
        if not len(levels):
            return 0
        ends = levels + size
        growth = 2 - 2 * n[levels] + np.where(ends < w, 2 * n[np.minimum(ends, w - 1)], -1)
        best = len(levels) - 1 - int(growth[::-1].argmin())
        return int(levels[best]) if growth[best] <= 1 + 2 * n[size] else 0

    def place(self, document: object, ids: Sequence) -> list[tuple]:
        """Whole windows leave at once; only the rest is placed and held."""
        whole = len(ids) // self.window * self.window
        done = [(document, start, ids[start : start + self.window], self._new(), 0) for start in range(0, whole, self.window)]
        return done + self._put(self._level(len(ids) - whole), document, whole, ids[whole:]) if whole < len(ids) else done

    def own_ids(self) -> None:
        """Copy held ids out of the slice that they are views of, so that the slice's memory is freed."""
        for number, pieces in self.held.items():
            if any(p[2].base is not None for p in pieces):
                self.held[number] = [(d, start, ids.copy(), n, at) if ids.base is not None else (d, start, ids, n, at) for d, start, ids, n, at in pieces]

    def finish(self) -> list[tuple]:
        """Close all windows: fill the fullest with the contents of the emptiest, cut the last into powers of two."""
        windows = [(level, number) for level in sorted(self.open) for number in self.open[level]]
        done, low, high = [], 0, len(windows) - 1
        source = [p[:3] for p in self.held[windows[0][1]]] if windows else []

        def move(number: int, offset: int, room: int) -> tuple:
            document, start, ids = source.pop()
            if len(ids) > room:
                source.append((document, start + room, ids[room:]))
            return document, start, ids[:room], number, offset

        while low < high:
            level, number = windows[high]
            pieces = self.held[number]
            while level < self.window and low < high:
                if not source:
                    low += 1
                    if low < high:
                        source = [p[:3] for p in self.held[windows[low][1]]]
                    continue
                pieces.append(move(number, level, self.window - level))
                level += len(pieces[-1][2])
            if level == self.window:
                done += pieces
                high -= 1
            else:
                source, low = [p[:3] for p in pieces], high
        # One window's contents are left: cut them into windows of 2**k ids.
        left = sum(len(p[2]) for p in source)
        while left:
            room, number, offset = 1 << (left.bit_length() - 1), self._new(), 0
            left -= room
            while offset < room:
                done.append(move(number, offset, room - offset))
                offset += len(done[-1][2])
        return done


def _letters() -> np.ndarray:
    """Whether a code point below 0x10000 is a letter."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


class _Tokens:
    """Ids of texts by a tokenizer file, unit by unit; units are remembered between batches.

    The tokenizer must drop white space, split letters from marks and lower-case its input, as those of
    the word_bpe kind do. Then the ids of a text are those of its units: the words between ASCII blanks,
    cut where ASCII marks or digits and letters meet. Words with an apostrophe, which may start a part
    together with letters, or with other characters beyond ASCII than letters, which may compose or form
    a part with ASCII marks, stay whole. Arrow numbers the distinct units of a slice, so Python sees
    each of these once in a slice, and only units that are not remembered are encoded.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(definition)
        self.known, self.letter = Remembered(np.uint32, CACHE_WORDS), _letters()
        self.ends_part = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends_part[[i for piece, i in self.tokenizer.get_vocab(False).items() if piece.endswith(suffix)]] = True

    def forget(self) -> None:
        self.known = Remembered(np.uint32, CACHE_WORDS)

    def _units(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All units, one text's after the other's, and their offsets by text."""
        raw, offsets = text_bytes(column)
        n, space = len(raw), SPACE[raw]
        # Code points of two and three bytes, at their first byte; longer ones and non-letters make a word odd.
        ahead = np.append(raw, np.zeros(2, np.uint8)).astype(np.int32)
        lead = np.flatnonzero(raw >= 0xC0)
        first, second, third = ahead[lead], ahead[lead + 1] & 63, ahead[lead + 2] & 63
        point = np.where(first < 0xE0, (first & 31) << 6 | second, (first & 15) << 12 | second << 6 | third)
        odd = np.append(np.flatnonzero(raw == 39), lead[(first >= 0xF0) | ~self.letter[point & 0xFFFF]])
        word_start = ~space
        word_start[1:] &= space[:-1]
        word_start[offsets[:-1][offsets[:-1] < n]] = True
        word_start &= ~space
        word = np.cumsum(word_start)
        whole = np.zeros(int(word[-1]) + 1 if n else 1, bool)
        whole[word[odd]] = True
        letter = _LETTER[raw]
        start = word_start.copy()
        start[1:] |= ~space[1:] & (letter[1:] != letter[:-1]) & ~whole[word[1:]]
        at = np.flatnonzero(start)
        body = np.flatnonzero(~space)
        ends = np.append(np.searchsorted(body, at), len(body))
        units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(LOWER[raw[body]]))
        return units, np.searchsorted(at, offsets)

    def _learn(self, units: list[str]) -> None:
        """Encode new units. Units of letters alone are one part each, so many are encoded as one text and cut at the pieces that end a part."""
        plain = [u for u in units if u.isalpha()]
        groups = [plain[at : at + _TOGETHER] for at in range(0, len(plain), _TOGETHER)]
        alone = [u for u in units if not u.isalpha()]
        for group, coded in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            ids = np.array(coded, np.uint32)
            size = np.diff(np.flatnonzero(self.ends_part[ids]), prepend=-1)
            if len(size) == len(group) and size.sum() == len(ids):
                self.known.add(group, ids, size)
            else:  # a letter that lower-casing takes apart
                alone += group
        coded = self._encode(alone)
        self.known.add(alone, np.fromiter(chain.from_iterable(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and their offsets; null counts as empty."""
        units, first = self._units(column)
        coded = units.dictionary_encode()
        which = self.known.places(coded.dictionary.to_pylist(), self._learn)[coded.indices.to_numpy()] if len(units) else np.zeros(0, np.int64)
        flat, ends = self.known.gather(which)
        offsets = ends[first]
        return np.insert(flat, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    ``tokenizer_path`` is read on the driver; the file's content goes to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from contraspark.llm.packing import _tokens

        tokens = _tokens(definition.value)
        packer = Packer(window, TaskContext.get().partitionId() << _PARTITION_BITS)
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, offsets = tokens.encode(batch.column(1), end_id)
            done = []
            for doc_id, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                done += packer.place((doc_id, hi - lo), ids[lo:hi])
            yield from _batches(done)
            packer.own_ids()
        tokens.forget()  # the worker stays for other stages, where the units would only take memory
        yield from _batches(packer.finish())

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _batches(done: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(done), 2000):
        rows = done[at : at + 2000]
        size = np.array([len(r[2]) for r in rows], np.int64)
        raw = np.concatenate([r[2] for r in rows]).astype("<u4")
        ids = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.concatenate([[0], np.cumsum(size)]) * 4).astype(np.int32)), pa.py_buffer(raw)])
        long = lambda values: pa.array(values, pa.int64())
        columns = [long([r[0][0] for r in rows]), long([r[1] for r in rows]), pa.array(size), ids, long([r[0][1] for r in rows]), long([r[3] for r in rows]), long([r[4] for r in rows])]
        yield pa.record_batch(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


_kept: dict[int, _Tokens] = {}


def _tokens(definition: str) -> _Tokens:
    key = hash(definition)
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Tokens(definition)
    return _kept[key]
