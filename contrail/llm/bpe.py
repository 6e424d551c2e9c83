"""Whole texts to token ids with a byte-level BPE of the tokenizers library.

The pre-tokenizer parts a text into pieces that are encoded one by one, so it is
enough to have the library encode each *different* piece once.  The pieces are
found with NumPy by the pattern of the byte-level pre-tokenizer, which looks only
at the class of a character (letter, number, space, other); the classes of
non-ASCII characters are asked of the library itself.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import mix

LETTER, NUMBER, SPACE, OTHER, END, UNKNOWN = 0, 1, 2, 3, 4, 255
#: Pieces that one encoder remembers before it starts over (about 20 MB as Arrow strings, where a dict takes 80), and bytes it takes at once (about 40 MB of arrays).
CACHE_PIECES = 500_000
BATCH_BYTES = 1 << 20
#: Pieces that the library encodes in one call.
RUN = 512

#: Odd factors of the first places of a piece, used again with a shift for longer ones.
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder per worker process, vocabulary file and number of pieces to remember."""
    if (path, pieces) not in _ENCODERS:
        _ENCODERS[path, pieces] = Encoder(path, pieces)
    return _ENCODERS[path, pieces]


class Grown:
    """A NumPy array that grows at its end; its room doubles, so adding costs what is added."""

    def __init__(self, first: np.ndarray):
        self.room, self.size = first.copy(), len(first)

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.empty(max(self.size, len(more)), self.room.dtype)])
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


class HashTable:
    """64-bit hashes to slots by open addressing, half full at most; its room doubles."""

    def __init__(self, room: int = 1 << 14):
        self.mask, self.used = room - 1, 0
        self.keys = np.zeros(room, np.uint64)
        self.slots = np.full(room, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where there is none."""
        out, at = np.full(len(hashes), -1, np.int64), (hashes & np.uint64(self.mask)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            slot = self.slots[at[open_]]
            hit = (slot >= 0) & (self.keys[at[open_]] == hashes[open_])
            out[open_[hit]] = slot[hit]
            open_ = open_[(slot >= 0) & ~hit]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def add(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        if 2 * (self.used + len(hashes)) > self.mask + 1:
            held = self.slots >= 0
            keys, values = self.keys[held], self.slots[held]
            self.__init__(1 << (2 * (self.used + len(hashes)) - 1).bit_length())
            self.add(keys, values)
        self.used += len(hashes)
        at, open_ = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(len(hashes))
        while len(open_):
            free = open_[self.slots[at[open_]] < 0]
            self.slots[at[free]] = slots[free]
            won = free[self.slots[at[free]] == slots[free]]  # of several on one place the last one written
            self.keys[at[won]] = hashes[won]
            open_ = np.setdiff1d(open_, won, assume_unique=True)
            at[open_] = (at[open_] + 1) & self.mask


class Encoder:
    """Ids as ``tokenizer.encode(text, add_special_tokens=False)`` has them: the added
    tokens of the vocabulary are found in a text first, and what is between them is
    text of its own.  Added tokens that take blanks or whole words along are not supported."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most = pieces
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{path}: added tokens that reach beyond their own string")
        self.added = {t.content.encode(): i for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()

    def _forget(self):
        """Starts over with the empty piece alone, as slot 0."""
        self.learnt, self.recent, self.n_recent = pa.array([""], pa.string()), [], 0
        self.table = HashTable()
        self.table.add(self._hashes(self.learnt), np.zeros(1, np.int64))
        self.ids = Grown(np.empty(0, np.uint32))
        self.begin, self.count = Grown(np.zeros(1, np.int64)), Grown(np.zeros(1, np.int64))

    @staticmethod
    def _hashes(words: pa.StringArray) -> np.ndarray:
        """Sums of the bytes times a random factor of their place (pieces are compared
        on a hit, so equal hashes of different pieces cost time only)."""
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
        size = np.diff(ends)
        if not size.any():
            return mix(size.astype(np.uint64))
        value = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(value)) - np.repeat(ends[:-1] - ends[0], size)
        value *= _FACTORS[place & (len(_FACTORS) - 1)] + place.astype(np.uint64) // np.uint64(len(_FACTORS)) * np.uint64(2)
        total = np.zeros(len(words), np.uint64)
        total[size > 0] = np.add.reduceat(value, (ends[:-1] - ends[0])[size > 0])
        return mix(total ^ mix(size.astype(np.uint64)))

    def _remember(self, new: pa.StringArray) -> None:
        """Adds pieces; the small arrays of the last calls are joined when they are many."""
        self.recent.append(new)
        self.n_recent += len(new)
        if 4 * self.n_recent > len(self.learnt):
            self.learnt, self.recent, self.n_recent = pa.concat_arrays([self.learnt, *self.recent]), [], 0

    def _pieces_at(self, slots: np.ndarray) -> pa.StringArray:
        if not self.recent:
            return self.learnt.take(pa.array(slots))
        return pa.chunked_array([self.learnt, pa.concat_arrays(self.recent)]).take(pa.array(slots)).combine_chunks()

    def _class(self, code: int) -> int:
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            return OTHER
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(before + c)) == 1:
                return kind
        return SPACE

    def pieces(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All pieces of all texts in order, an empty one after each text; and the places of those."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        joined = "\0".join(strings) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))) - 1
        kind = self.classes[codes]
        if (new := kind == UNKNOWN).any():
            for code in np.unique(codes[new]).tolist():
                self.classes[code] = self._class(code)
            kind = self.classes[codes]
        kind[ends] = END
        blank = codes == 32
        blank[ends] = False
        before = np.concatenate([[END], kind[:-1]])
        start = kind != before
        # one blank before a run belongs to it
        start[1:] &= ~(blank[:-1] & (kind[1:] != SPACE) & (kind[1:] != END))
        # the last space of a run stands alone if more text follows
        after = np.concatenate([kind[1:], [END]])
        start |= (kind == SPACE) & (before == SPACE) & (after != SPACE) & (after != END)
        start[ends] = True
        self._contractions(codes, kind, start)
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        width[ends] = 0
        at = np.concatenate([[0], np.cumsum(width)])
        first = np.flatnonzero(start)
        offsets = np.append(at[first], at[-1]).astype(np.int32)
        data = "".join(strings).encode("utf-8", "surrogatepass")
        found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
        return found, np.searchsorted(first, ends)

    @staticmethod
    def _contractions(codes: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are pieces where one starts at the apostrophe."""
        i = np.flatnonzero(start & (codes == 39) & (kind == OTHER))
        if not len(i):
            return
        padded = np.concatenate([codes, [0, 0]])
        live = np.concatenate([kind, [END, END]])
        one, two = padded[i + 1], padded[i + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (live[i + 1] == LETTER)
        long = np.zeros(len(i), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b)) & (live[i + 1] == LETTER) & (live[i + 2] == LETTER)
        long &= ~short
        start[i[short | long] + 1] = False
        start[i[short] + 2] = True
        after = i[long] + 3
        start[after[after < len(start)]] = True

    def _known(self, words: pa.StringArray) -> np.ndarray:
        """Slots of different pieces; those not learnt yet are encoded by the library."""
        if self.begin.size > self.most:
            self._forget()
        marks = self._hashes(words)
        slot = self.table.find(marks)
        met = np.flatnonzero(slot >= 0)
        # a hash alone does not tell two pieces apart
        same = pc.equal(words.take(pa.array(met)), self._pieces_at(slot[met])).to_numpy(zero_copy_only=False).astype(bool)
        slot[met[~same]] = -1
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new = words.take(pa.array(missing))
            text = new.to_pylist()
            # a run of pieces is one call, which tells the piece of each id
            runs = [text[i : i + RUN] for i in range(0, len(text), RUN)]
            found = self.tokenizer.encode_batch(runs, is_pretokenized=True, add_special_tokens=False)
            count = np.concatenate([np.bincount(np.array(e.word_ids, np.int64), minlength=len(x)) for e, x in zip(found, runs, strict=True)])
            slot[missing] = self.begin.size + np.arange(len(missing))
            self.begin.add(self.ids.size + np.cumsum(count) - count)
            self.count.add(count)
            self.ids.add(np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32, count.sum()))
            self.table.add(marks[missing], slot[missing])
            self._remember(new)
        return slot

    def _between(self, texts: list[bytes], end_id: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The texts cut at added tokens: parts, the id after each part, and parts per text."""
        if self.added_pattern is None:
            return texts, np.full(len(texts), end_id, np.uint32), np.ones(len(texts), np.int64)
        parts, after, count = [], [], []
        for t in texts:
            cuts, at = list(self.added_pattern.finditer(t)), 0
            for m in cuts:
                parts.append(t[at : m.start()])
                after.append(self.added[m.group()])
                at = m.end()
            parts.append(t[at:] if at else t)
            after.append(end_id)
            count.append(len(cuts) + 1)
        return parts, np.array(after, np.uint32), np.array(count, np.int64)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``; and ids per text."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        parts, after, n_parts = self._between(texts, end_id)
        found, ends = self.pieces(parts)
        coded = found.dictionary_encode()
        slot = self._known(coded.dictionary)[coded.indices.to_numpy()]
        count = self.count.all[slot]
        count[ends] = 1
        stop = np.cumsum(count)
        source = np.repeat(self.begin.all[slot] - (stop - count), count) + np.arange(stop[-1])
        last = stop[ends] - 1
        source[last] = 0
        ids = self.ids.all[source] if self.ids.size else np.zeros(len(source), np.uint32)
        ids[last] = after
        text_ends = ends[np.cumsum(n_parts) - 1]
        return ids, np.diff(np.concatenate([[0], stop[text_ends]]))
