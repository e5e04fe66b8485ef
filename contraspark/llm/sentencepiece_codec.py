"""SentencePiece encoding and decoding as batched numpy Viterbi.

The distinct words of a batch are grouped by length and each group advances together, one character
position at a time. The hashes of all substrings are probed in the sorted keys of the pieces (hits are
confirmed character by character), and the best piece ending at each position is stored as a
backpointer by vectorised maxima:

* unigram models take the predecessor with the largest sum of scores;
* BPE models keep, of the pieces that end at a position, the one that is consistent with the merges:
  the encoding of a prefix ends in piece t after piece p exactly when merging p + t gives p, t again.
  One such piece exists for each prefix; it is the maximum of a 0/1 score. This gives the ids of the
  sentencepiece library.

Words are the parts between spaces, with the space mark in front: no piece has a space mark after
another character. The merges of runs of several spaces have equal scores in some models, so that
their order is not decided by scores; such chunks are merged pair by pair instead.

Defined cases: null and empty texts give no ids. Characters without a piece become their UTF-8 bytes
(models with byte pieces) or the unknown id, which decodes to " \\u2047 ". A literal space mark counts
as a space, as in the library. Texts are taken as they are (identity normalisation); models with
another normaliser are refused. Texts are encoded as a whole, whatever their length. Of unigram
segmentations with equal sums of scores the one whose last piece is shorter is taken, at each position.
Repeated rows stay repeated, an empty table gives an empty one, and other columns are kept as they are
(one that has the name of the result is replaced).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contraspark.llm.common import list_array, slices, text_bytes
from contraspark.llm.remembered import Remembered

MARK = "▁"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
#: Distinct words whose ids a Python worker remembers between batches.
CACHE_WORDS = 600_000
#: Text bytes encoded at once.
ENCODE_BYTES = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 22
#: 1 for ASCII letters, 2 for other characters of ASCII but the space, 4 for all else.
_KIND = np.array([4 if i >= 128 or i == 32 else 1 if chr(i).isalpha() else 2 for i in range(256)], np.int8)


@dataclass
class Model:
    """Pieces in the order of their merges: single characters first, then by falling score."""

    bpe: bool
    ids: np.ndarray  # piece -> id
    score: np.ndarray
    chars: np.ndarray  # code points of single-character pieces, sorted
    char_piece: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per length: sorted hashes, pieces, code points
    seen: np.ndarray  # slots that a piece's hash falls into: most substrings need no probe
    pair_seen: np.ndarray
    pair_keys: np.ndarray  # sorted first * n + second of pairs that merge
    pair_piece: np.ndarray
    left: np.ndarray  # halves of a piece's last merge; a character is its own
    right: np.ndarray
    byte_ids: np.ndarray | None
    unknown: int
    dummy_prefix: bool
    text_of: list[bytes]  # id -> bytes it decodes to, with the space mark
    pieces: dict[str, int]


def load_model(path: str) -> Model:
    """Read a model file on the driver; the tables are small (they grow with the vocabulary only)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalisation and space marks in front are supported")
    if proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return build_model([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type == 2, norm.add_dummy_prefix)


def build_model(pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True) -> Model:
    normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == _NORMAL]
    normal.sort(key=lambda x: (len(x[0]) > 1, -x[1], x[2]))
    number = {p: k for k, (p, _, _) in enumerate(normal)}
    n = len(normal)
    longest = max((len(p) for p, _, _ in normal), default=1)
    keys = []
    for length in range(1, longest + 1):
        own = [k for k, (p, _, _) in enumerate(normal) if len(p) == length]
        codes = np.array([[ord(c) for c in normal[k][0]] for k in own], np.int32).reshape(len(own), length)
        hashes = _substring_hashes(codes, length)[:, 0] if own else np.zeros(0, np.uint64)
        if len(set(hashes.tolist())) != len(own):
            raise ValueError("two pieces share a hash")
        order = np.argsort(hashes)
        keys.append((hashes[order], np.array(own, np.int32)[order], codes[order]))
    pairs, left, right = {}, np.arange(n), np.arange(n)
    if bpe:
        for k, (p, _, _) in enumerate(normal):
            for i in range(1, len(p)):
                a, b = number.get(p[:i]), number.get(p[i:])
                if a is not None and b is not None:
                    pairs[a * n + b] = k
        for k, (p, _, _) in enumerate(normal):
            if len(p) > 1:
                halves = _merge(p, number, stop=k)
                left[k], right[k] = (number[h] for h in halves) if len(halves) == 2 else (k, k)
    pair_keys = np.array(sorted(pairs), np.int64)
    seen, pair_seen = np.zeros(1 << _SLOT_BITS, bool), np.zeros(1 << _SLOT_BITS, bool)
    for hashes, _, _ in keys:
        seen[_slot(hashes)] = True
    pair_seen[_slot(pair_keys.astype(np.uint64))] = True
    chars = sorted((ord(p), k) for p, k in number.items() if len(p) == 1)
    by_id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
    text_of = []
    for p, _, kind in pieces:
        text_of.append(bytes([int(p[1:-1], 16)]) if kind == _BYTE else p.encode() if kind in (_NORMAL, 4) else " ⁇ ".encode() if kind == _UNKNOWN else b"")
    return Model(
        bpe, np.array([i for _, _, i in normal], np.int32), np.array([s for _, s, _ in normal]), np.array([c for c, _ in chars], np.int32), np.array([k for _, k in chars], np.int32), keys, seen, pair_seen,
        pair_keys, np.array([pairs[k] for k in pair_keys.tolist()], np.int64), left, right,
        np.array([by_id[f"<0x{b:02X}>"] for b in range(256)], np.int32) if len(by_id) == 256 else None,
        next((i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN), 0), dummy_prefix, text_of, number,
    )


def _merge(word: str, rank: dict[str, int], stop: int = -1) -> list[str]:
    """Merge adjacent parts, lowest rank first and leftmost of equals; parts before piece ``stop`` would form."""
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue = [(rank[word[i : i + 2]], i, word[i : i + 2]) for i in range(len(parts) - 1) if word[i : i + 2] in rank]
    heapq.heapify(queue)
    while queue:
        k, i, whole = heapq.heappop(queue)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != whole:
            continue
        if k == stop and len(whole) == len(word):
            break
        parts[i], parts[j], after[i] = whole, None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
            if (more := whole + parts[after[i]]) in rank:
                heapq.heappush(queue, (rank[more], i, more))
        if before[i] >= 0 and (more := parts[before[i]] + whole) in rank:
            heapq.heappush(queue, (rank[more], before[i], more))
    return [p for p in parts if p is not None]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _substring_hashes(codes: np.ndarray, length: int, shorter: np.ndarray | None = None) -> np.ndarray:
    """Unmixed running hashes of all substrings of ``length`` characters, from those one shorter."""
    x = codes.astype(np.uint64)
    if shorter is not None:
        return shorter[:, :-1] * _STEP + x[:, length - 1 :]
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(1, length + 1):
        out = out[:, :-1] * _STEP + x[:, k - 1 :]
    return out


def _consistent(model: Model, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether merging the characters of first + second gives exactly these two pieces."""
    n, ok = len(model.ids), np.ones(len(first), bool)
    at, a, b = np.arange(len(first)), first.astype(np.int64), second.astype(np.int64)
    limit = np.full(len(first), 1 << 40)
    while len(at):
        key = a * n + b
        whole = np.full(len(a), 1 << 41)
        maybe = np.flatnonzero(model.pair_seen[_slot(key.astype(np.uint64))])
        if len(maybe):
            place = np.minimum(np.searchsorted(model.pair_keys, key[maybe]), len(model.pair_keys) - 1)
            hit = model.pair_keys[place] == key[maybe]
            whole[maybe[hit]] = model.pair_piece[place[hit]]
        bad = whole < limit
        ok[at[bad]] = False
        # Undo the later of the two pieces' last merges and look at the pair that then meets at the border.
        undo_a = a > b
        new_limit = np.where(undo_a, a, b + 1)
        na, nb = np.where(undo_a, model.right[a], a), np.where(undo_a, b, model.left[b])
        atom_a, atom_b = undo_a & (na == a), ~undo_a & (nb == b)
        new_limit = np.where(atom_a, b + 1, np.where(atom_b, a, new_limit))
        nb2, na2 = np.where(atom_a, model.left[b], nb), np.where(atom_b, model.right[a], na)
        ends = bad | (atom_a & (nb2 == b)) | (atom_b & (na2 == a))
        keep = ~ends
        at, a, b, limit = at[keep], na2[keep], nb2[keep], new_limit[keep]
    return ok


def _viterbi(model: Model, codes: np.ndarray) -> np.ndarray:
    """Best pieces of words of one length (known characters only): [word, position] -> piece ending there, -1 elsewhere."""
    n, length = codes.shape
    longest = min(len(model.keys), length)
    found = np.full((longest + 1, n, length + 1), -1, np.int32)  # [piece length, word, end]
    hashes = None
    for size in range(1, longest + 1):
        hashes = _substring_hashes(codes, size, hashes)
        sorted_hashes, pieces, points = model.keys[size - 1]
        if not len(pieces):
            continue
        word, start = np.nonzero(model.seen[_slot(hashes)])
        probed = hashes[word, start]
        piece = np.minimum(np.searchsorted(sorted_hashes, probed), len(pieces) - 1)
        hit = sorted_hashes[piece] == probed
        word, start, piece = word[hit], start[hit], piece[hit]
        same = np.ones(len(word), bool)
        for k in range(size):
            same &= codes[word, start + k] == points[piece, k]
        found[size, word[same], start[same] + size] = pieces[piece[same]]
    last = np.full((n, length + 1), -1, np.int32)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    for end in range(1, length + 1):
        sizes = np.arange(1, min(longest, end) + 1)
        candidates = found[sizes, :, end].T  # [word, size]
        previous = best[:, end - sizes]
        word, k = np.nonzero((candidates >= 0) & (previous > -np.inf))
        piece = candidates[word, k]
        value = np.full(candidates.shape, -np.inf)
        if model.bpe:
            before = last[word, end - sizes[k]]
            good = before < 0
            good[~good] = _consistent(model, before[~good], piece[~good])
            value[word[good], k[good]] = 1.0
        else:
            value[word, k] = previous[word, k] + model.score[piece]
        choice = value.argmax(1)
        rows = np.arange(n)
        best[:, end] = value[rows, choice]
        last[:, end] = np.where(best[:, end] > -np.inf, candidates[rows, choice], -1)
    sizes = np.ones(len(model.ids), np.int64)
    for size, (_, pieces, _) in enumerate(model.keys, 1):
        sizes[pieces] = size
    out, end, rows = np.full((n, length), -1, np.int32), np.full(n, length), np.arange(n)
    while len(rows):
        piece = last[rows, end[rows]]
        out[rows, end[rows] - 1] = piece
        end[rows] -= sizes[piece]
        rows = rows[end[rows] > 0]
    return out


class Encoder:
    """Ids of words, remembered between batches of a Python worker."""

    def __init__(self, model: Model):
        self.model, self.alone = model, {chr(c) for c in model.chars.tolist()}
        self.known = Remembered(np.int32, CACHE_WORDS)
        # Where no piece holds an ASCII letter beside an ASCII mark or digit, words may be cut there as well.
        kinds = [_KIND[np.frombuffer(p.encode(), np.uint8)] for p in model.pieces]
        self.cuts = not any((k[1:] + k[:-1] == 3).any() for k in kinds)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words made of known characters only, one word after the other, and their counts; equal lengths advance together."""
        model, rows, ids = self.model, [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            length = int(lengths[order[lo]])
            step = max(1, (1 << 17) // length)
            for at in range(lo, hi, step):
                part = order[at : min(hi, at + step)]
                codes = np.frombuffer("".join([words[i] for i in part.tolist()]).encode("utf-32-le"), np.int32).reshape(len(part), length)
                pieces = _viterbi(model, codes)
                row, col = np.nonzero(pieces >= 0)
                rows.append(part[row])
                ids.append(model.ids[pieces[row, col]])
        row = np.concatenate(rows)
        return np.concatenate(ids)[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(words))

    def _cut(self, word: str) -> list:
        """The word as (known part,) tuples, single unknown characters and ready pieces."""
        model = self.model
        if model.bpe and word.startswith(MARK + MARK):
            return [int(model.ids[model.pieces[p]]) if p in model.pieces else p for p in _merge(word, model.pieces)]
        cut, held = [], ""
        for c in word:
            if c in self.alone:
                held += c
            else:
                cut += [(held,)] if held else []
                cut.append(c)
                held = ""
        return [*cut, (held,)] if held else cut

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after the other, and their counts."""
        model, odd = self.model, {}
        parts: dict[str, int] = {}
        whole = np.full(len(words), -1, np.int64)  # word -> its part, if it is one
        for i, word in enumerate(words):
            if self.alone.issuperset(word) and not (model.bpe and word.startswith(MARK + MARK)):
                whole[i] = parts.setdefault(word, len(parts))
            else:
                odd[i] = self._cut(word)
                for x in odd[i]:
                    if isinstance(x, tuple):
                        parts.setdefault(x[0], len(parts))
        flat, counts = self._words(list(parts))
        starts = np.concatenate([[0], np.cumsum(counts)])
        extra, at = [flat], len(flat)
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = whole >= 0
        begin[plain], size[plain] = starts[whole[plain]], counts[whole[plain]]
        for i, cut in odd.items():
            ids = []
            for x in cut:
                if isinstance(x, tuple):
                    k = parts[x[0]]
                    ids += flat[starts[k] : starts[k + 1]].tolist()
                elif isinstance(x, str):
                    ids += model.byte_ids[list(x.encode())].tolist() if model.byte_ids is not None else [model.unknown]
                else:
                    ids.append(x)
            extra.append(np.array(ids, np.int32))
            begin[i], size[i] = at, len(ids)
            at += len(ids)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return np.concatenate(extra)[np.arange(total) + np.repeat(begin - (ends - size), size)], size

    def _learn(self, words: list[str]) -> None:
        self.known.add(words, *self.encode_words([w.replace(" ", MARK) for w in words]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets of each text's.

        A text is cut in front of each run of spaces (and inside words, where no piece can lie across);
        Arrow numbers the distinct words of the slice.
        """
        raw, offsets = text_bytes(pc.replace_substring(column, MARK, " "))
        if self.model.dummy_prefix:  # one more space in front of each text that has characters
            full = np.diff(offsets) > 0
            raw = np.insert(raw, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        start = raw == 32
        start[1:] &= raw[:-1] != 32
        start[offsets[:-1][offsets[:-1] < len(raw)]] = True
        if self.cuts:
            kind = _KIND[raw]
            start[1:] |= kind[1:] + kind[:-1] == 3
        at = np.flatnonzero(start)
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        ids, ends = self.known.gather(self.known.places(words.dictionary.to_pylist(), self._learn)[words.indices.to_numpy()])
        return ids, ends[np.searchsorted(at, offsets)]


class Decoder:
    """Texts of arrays of ids, a whole slice at once."""

    def __init__(self, text_of: list[bytes], prefix: bool):
        mark = MARK.encode()
        spaced = [x.replace(mark, b" ") for x in text_of]
        self.text_of, self.prefix = text_of, prefix
        self.table = np.frombuffer(b"".join(spaced), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in spaced])])
        # Pieces that are no UTF-8 by themselves, as single bytes are: their texts are decoded one by one.
        self.partial = np.array([not _is_utf8(x) for x in text_of])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.text_of)):
            raise ValueError("an id outside the vocabulary")
        begin = self.starts[ids]
        size = self.starts[ids + 1] - begin
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(self.partial[ids]), "right") - 1)
        texts = [b"".join([self.text_of[k] for k in ids[offsets[i] : offsets[i + 1]].tolist()]).decode("utf-8", "replace").replace(MARK, " ") for i in odd.tolist()]
        # Leave these texts out, then the space in front of each other one.
        size[np.repeat(np.isin(np.arange(len(offsets) - 1), odd), np.diff(offsets))] = 0
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        raw = self.table[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        edges = ends[offsets]
        if self.prefix:
            texts = [t.removeprefix(" ") for t in texts]
            heads = edges[:-1][np.diff(edges) > 0]
            cut = np.zeros(len(raw), bool)
            cut[heads] = raw[heads] == 32
            raw, edges = raw[~cut], edges - np.concatenate([[0], np.cumsum(cut)])[edges]
        out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(edges), pa.py_buffer(raw)).cast(pa.string())
        return pc.replace_with_mask(out, pa.array(np.isin(np.arange(len(out)), odd)), pa.array(texts, pa.string())) if texts else out


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


_kept: dict[tuple[type, int], object] = {}


def _worker(kind: type, broadcast, *parts):
    """The encoder or decoder of this Python worker."""
    key = (kind, id(broadcast.value))
    if key not in _kept:
        for old in [k for k in _kept if k[0] is kind]:
            del _kept[old]
        _kept[key] = kind(*parts)
    return _kept[key]


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one more column in the last place; a column of that name goes."""
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], values], [*kept, name])


def _with_column(df: DataFrame, name: str, kind: T.DataType, fn) -> DataFrame:
    """``df`` with one more column (instead of one of that name), made by fn from each Arrow batch."""
    return df.mapInArrow(fn, T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, kind)]))


def encode(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as array<int>; a column named ``out_col`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(Encoder, shared, shared.value)
        for batch in slices(batches, text_col, ENCODE_BYTES):
            ids, offsets = encoder.encode(batch.column(batch.schema.get_field_index(text_col)))
            yield _replaced(batch, out_col, list_array(ids, offsets))

    return _with_column(docs, out_col, T.ArrayType(T.IntegerType()), run)


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids without null entries, and their offsets; a null array has none."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    here = values.is_valid().to_numpy(zero_copy_only=False)
    left = np.concatenate([[0], np.cumsum(here)])
    return values.drop_null().to_numpy().astype(np.int64), left[np.concatenate([[0], np.cumsum(size)])]


def decode(rows: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids; ids outside the vocabulary raise an error.

    Bytes that are no UTF-8 become U+FFFD. Null arrays give an empty text, null entries are left out.
    A column named ``out_col`` is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.text_of, model.dummy_prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _worker(Decoder, shared, *shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield _replaced(batch, out_col, decoder.decode(*_ids_of(batch.column(batch.schema.get_field_index(ids_col)))))

    return _with_column(rows, out_col, T.StringType(), run)


def codec_report(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding the ids gives the text again (round_trip).

    Encoder and decoder run in one pass, so neither texts nor decoded texts come back to the JVM.
    """
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(Encoder, shared, shared.value)
        decoder = _worker(Decoder, shared, shared.value.text_of, shared.value.dummy_prefix)
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, offsets = encoder.encode(batch.column(1))
            wanted = pc.replace_substring(batch.column(1).fill_null(""), MARK, " ")
            same = pc.equal(decoder.decode(ids, offsets), wanted.cast(pa.string()))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), list_array(ids, offsets), same], ["doc_id", "n_ids", "ids", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {id_kind}, n_ids long, ids array<int>, round_trip boolean")
