"""Whole-text encoding with a public tokenizer file, memoised by piece.

Both tokenizers cut a text into pre-tokens and encode each by itself, so a text may be cut
beforehand wherever no pre-token can cross: between an ASCII letter and an ASCII character that is
none, with care at apostrophes and white space; for the byte-level file before a single space that
a non-space follows, and after a single line feed; for the word file at ASCII white space, which
it drops.  Distinct pieces are encoded once by the tokenizers library and kept for later steps:
words of Latin letters by its model alone, as nothing can cut them, all others by its whole
chain.  Ids of the texts are gathered from these.

Texts that hold a special token's string are encoded whole by the library, as it cuts these
strings out before anything else.  `marks=False` takes them as ordinary text instead.

Two pieces count as one if two independent 64-bit hashes agree (odds 2**-128 a pair).
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import common as C

#: Pieces that are kept between steps at most, and slots of their table (a power of two).
KEEP, SLOTS = 1 << 20, 1 << 22
#: Pieces in one call of the library, and words in one text for its model.
CALL, WORDS = 4096, 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII that is neither letter nor apostrophe, white space or control.
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~_LETTER
_SIGN[39] = False
#: ASCII after which a letter's run is over.
_OTHER = np.zeros(256, bool)
_OTHER[:128] = ~_LETTER[:128]
#: First bytes of the UTF-8 forms of Unicode white space.
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: What may follow a space or a line feed that begins or ends a piece.
_VISIBLE = C.GRAPHIC & ~_MAYBE
_VISIBLE[:32] = _VISIBLE[127] = False


def _bits(*classes: np.ndarray) -> bytes:
    """A translation table: bit k of a byte's value says whether it is in class k."""
    return sum(c.astype(np.uint8) << k for k, c in enumerate(classes)).astype(np.uint8).tobytes()


def _only(byte: int) -> np.ndarray:
    return np.arange(256) == byte


#: Pairs of neighbours that tell of a cut, by the bit that left and right share: the run of letters ends, it begins after
#: a sign, a space before what is visible, a line feed before a letter, and visible ASCII before a line feed.
_LEFT = _bits(_LETTER, _SIGN, _only(32), _only(10), _VISIBLE & (np.arange(256) < 128))
_RIGHT = _bits(_OTHER, _LETTER, _VISIBLE, _LETTER, _only(10))
_EDGE, _SPACED, _BROKEN = 3, 4, 16


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


_ALPHABET = _visible_bytes()
#: Code points of that alphabet, and what stands before a word that begins without a space: no word has it.
_POINTS = np.array([ord(_ALPHABET.get(b, chr(b))) for b in range(256)], "<u4")
_MARK = _ALPHABET[10]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str, drops_space: bool, marks: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary(path))
        self.tokenizer.encode_special_tokens = not marks
        # the model alone, over words one after another
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.mark,) = self.bare.encode(_MARK, add_special_tokens=False).ids
        known = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(known.values()) + 1, bool)
        self.begins[[self.mark, *(k for x, k in known.items() if x[0] == _ALPHABET[32])]] = True
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, added))) if marks and added else None
        self.drops_space = drops_space
        self.reset()

    def reset(self) -> None:
        self.n, self.used = 0, 0
        self.key, self.second = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.int32)
        self.slots = np.full(SLOTS, -1, np.int32)

    def library(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts by the tokenizers library."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, data: np.ndarray, off: np.ndarray):
        """Which pieces are one pre-token of Latin letters, after a space in the byte-level file; data in the case the model takes."""
        begin = np.zeros(len(data) + 1, bool)
        begin[off] = True
        # letters of two bytes: C3, then 80 to BF without the signs 97 and B7
        tail = ((data & 0xC0) == 0x80) & (data != 0x97) & (data != 0xB7)
        pair = (data[:-1] == 0xC3) & tail[1:] & ~begin[1:-1]
        second = np.append(False, pair)
        good = _LETTER[data] | second
        good[:-1] |= pair
        if self.drops_space:
            data = data + np.uint8(32) * (((data >= 65) & (data <= 90)) | (second & (data <= 0x9E)))
        else:
            good |= (data == 32) & begin[:-1]
        n = np.diff(off)
        return (np.add.reduceat(~good, off[:-1], dtype=np.int64) == 0) & ((n > 1) | (data[off[:-1]] != 32)), data

    def modelled(self, data: np.ndarray, off: np.ndarray):
        """(all ids, ids of each word) by the model.

        One call takes many words; a word begins at a token that begins with a space, or after a mark."""
        n = len(off) - 1
        bare = data[off[:-1]] != 32
        at = off + np.append(0, np.cumsum(1 + 2 * bare))  # a blank after each word, a mark and a blank before it
        points = np.full(at[-1], 32, "<u4")
        points[at[:-1][bare]] = ord(_MARK)
        points[np.arange(len(data)) + np.repeat(at[:-1] + 2 * bare - off[:-1], np.diff(off))] = _POINTS[data]
        flat = []
        for i in range(0, n, WORDS):
            text = points[at[i] : at[min(i + WORDS, n)]].tobytes().decode("utf-32-le")
            flat += self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids
        flat = np.array(flat, np.int32)
        begin = np.flatnonzero(self.begins[flat])
        if len(begin) != n:
            raise ValueError(f"{n} words came back as {len(begin)}")
        return flat[flat != self.mark], np.diff(begin, append=len(flat)) - bare

    def pieces(self, data: np.ndarray, off: np.ndarray):
        """(starts, ends, first piece of each document + total)."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            raw = data.tobytes()
            pair = np.frombuffer(raw.translate(_LEFT), np.uint8)[:-1] & np.frombuffer(raw.translate(_RIGHT), np.uint8)[1:]
            inner = (pair & _EDGE) != 0
            if not self.drops_space:
                inner[:-1] |= (pair[1:] & _SPACED) != 0
                inner[1:] |= ((pair[1:] << 1) & pair[:-1] & _BROKEN) != 0
            cut[1:-1] = inner
        cut[off] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        if self.drops_space:
            keep = np.zeros(len(data), bool)
            keep[starts] = True
            inside = C.GRAPHIC[data]
            keep[1:] |= inside[1:] & ~inside[:-1]
            starts = np.flatnonzero(keep & inside)
            stop = np.zeros(len(data) + 1, bool)
            stop[ends] = True
            stop[1:-1] |= inside[:-1] & ~inside[1:]
            stop[1:] &= inside
            ends = np.flatnonzero(stop)
        return starts, ends, np.searchsorted(starts, off)

    def encode(self, data: np.ndarray, off: np.ndarray):
        """(ids, id bounds of each document) for documents of one step."""
        raw = data.tobytes()
        if self.special is None or not (found := [m.start() for m in self.special.finditer(raw)]):
            return self.memoised(data, off)
        # documents that hold a special token go to the library whole, the others between them as before
        out, bounds, done = [], [np.zeros(1, np.int64)], 0
        total = 0
        for i in np.unique(np.searchsorted(off, found, "right") - 1).tolist():
            for lo, hi, plain in ((done, i, False), (i, i + 1, True)):
                if hi > lo:
                    ids, b = self.whole(raw[off[lo] : off[hi]]) if plain else self.memoised(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    out.append(ids)
                    bounds.append(b[1:] + total)
                    total += len(ids)
            done = i + 1
        if done < len(off) - 1:
            ids, b = self.memoised(data[off[done] :], off[done:] - off[done])
            out.append(ids)
            bounds.append(b[1:] + total)
        return np.concatenate(out), np.concatenate(bounds)

    def whole(self, text: bytes):
        ids = np.array(self.library([text.decode("utf-8", "replace")])[0], np.int32)
        return ids, np.array([0, len(ids)])

    def memoised(self, data: np.ndarray, off: np.ndarray):
        start, end, first = self.pieces(data, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        key, second = C.hash_spans(data, start, end, 11), C.hash_spans(data, start, end, 12)
        place = self.find(key, second)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            if self.n > KEEP:
                self.reset()
                miss = np.arange(len(key))
            one = self.distinct(key[miss], second[miss])
            new = miss[one[0]]
            place[miss] = self.learn(key[new], second[new], *self.each(data, start[new], end[new]))[one[1]]
        size = self.size[place]
        bounds = np.append(0, np.cumsum(size))[first]
        return self.ids[C.ragged(self.at[place], size)], bounds

    @staticmethod
    def distinct(key: np.ndarray, second: np.ndarray):
        """(one row of each (key, second), which of these each row is)."""
        order = np.lexsort((second, key))
        k, s = key[order], second[order]
        new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
        of = np.empty(len(key), np.int64)
        of[order] = np.cumsum(new) - 1
        return order[new], of

    def homes(self, key: np.ndarray, second: np.ndarray):
        """The slots in which a piece may stand, one after another."""
        low = np.uint64(SLOTS - 1)
        for shift in (np.uint64(0), np.uint64(32)):
            for h in (key, second):
                yield ((h >> shift) & low).astype(np.int64)

    def find(self, key: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Place of each piece among the kept ones, else -1."""
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        for home in self.homes(key, second):
            if not len(left):
                break
            place = self.slots[home[left]]
            # a slot of its own never empties, so an empty one ends the search
            left, place = left[place >= 0], place[place >= 0]
            same = (self.key[place] == key[left]) & (self.second[place] == second[left])
            out[left[same]] = place[same]
            left = left[~same]
        return out

    def learn(self, key, second, flat, size) -> np.ndarray:
        """Keep new pieces; their places.  A piece that finds no slot is encoded again when it comes again."""
        lo, hi = self.n, self.n + len(key)
        while hi > len(self.key):
            for name in ("key", "second", "at", "size"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.key[lo:hi], self.second[lo:hi], self.size[lo:hi] = key, second, size
        self.at[lo:hi] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = hi, self.used + len(flat)
        place = np.arange(lo, hi)
        left = place
        for home in self.homes(key, second):
            spot = home[left - lo]
            free = self.slots[spot] < 0
            self.slots[spot[free]] = left[free]  # of several the last one stays
            left = left[self.slots[spot] != left]
        return place

    def each(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each piece)."""
        n = end - start
        data, off = data[C.ragged(start, n)], np.append(0, np.cumsum(n))
        word, cased = self.words(data, off)
        size = np.zeros(len(n), np.int64)
        parts = []
        if word.any():
            ids, size[word] = self.modelled(cased[np.repeat(word, n)], np.append(0, np.cumsum(n[word])))
            parts.append((np.flatnonzero(word), ids))
        rest, raw = np.flatnonzero(~word), data.tobytes()
        for i in range(0, len(rest), CALL):
            some = rest[i : i + CALL]
            made = self.library([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[some].tolist(), off[some + 1].tolist(), strict=True)])
            size[some] = [len(x) for x in made]
            parts.append((some, np.array([k for x in made for k in x], np.int32)))
        flat, at = np.empty(size.sum(), np.int32), np.cumsum(size) - size
        for some, ids in parts:
            flat[C.ragged(at[some], size[some])] = ids
        return flat, size


_encoders: dict = {}


def encoder(path: str, drops_space: bool, marks: bool = True) -> Encoder:
    """One encoder for each Python worker."""
    if (path, marks) not in _encoders:
        _encoders[path, marks] = Encoder(path, drops_space, marks)
    return _encoders[path, marks]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int):
    """The ids with an end id after each document, and the new bounds."""
    n = len(bounds) - 1
    size = np.diff(bounds) + 1
    new = np.append(0, np.cumsum(size))
    out = np.full(new[-1], end, np.int32)
    keep = np.ones(new[-1], bool)
    keep[new[1:] - 1] = False
    out[keep] = ids
    assert len(new) == n + 1
    return out, new
