"""Words of many texts at once: cut, located and hashed in numpy, without a look at single words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np

#: Characters of texts that are measured together; a longer text is measured alone, as a whole.
CHUNK = 1 << 18
LETTER, DIGIT, HAN, BLANK, BREAK, JOIN, END, FORMAT = 1, 2, 4, 8, 16, 32, 64, 128
# Signs that may join two parts of a word, and signs that may end a line of prose.
_JOINS = "'’-_"
_ENDS = ".!?…。！？:;\"'”’»)“"


@cache
def _classes() -> np.ndarray:
    """Classes of every code point, as bits."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalnum():
            kinds[code] = LETTER | (DIGIT if c in "0123456789" else 0)
        elif c.isspace():
            kinds[code] = BLANK
        elif unicodedata.category(c) == "Cf":
            kinds[code] = FORMAT
    for low, high in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)):
        kinds[low:high] |= HAN | LETTER
    for c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":
        kinds[ord(c)] = BLANK | BREAK
    for bit, signs in ((JOIN, _JOINS), (END, _ENDS)):
        for c in signs:
            kinds[ord(c)] |= bit
    return kinds


@dataclass
class Chunk:
    """Several texts in one: code points and their classes, and the words by start, stop and owner. Line breaks stand between texts."""

    text: str
    points: np.ndarray
    kinds: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    owner: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        return _word_hashes(self.points, self.starts, self.stops)

    @cached_property
    def blanks(self) -> np.ndarray:
        """Blank characters before each place."""
        out = np.zeros(len(self.kinds) + 1, np.int64)
        np.cumsum((self.kinds & BLANK) > 0, out=out[1:])
        return out

    def surface(self) -> tuple[np.ndarray, np.ndarray]:
        """(SURFACE by text, visible characters by text)."""
        n_texts = len(self.first) - 1
        shown = np.maximum(1, np.diff(self.first) - np.diff(self.blanks[self.first]))
        n = np.bincount(self.owner, minlength=n_texts)
        within = np.bincount(self.owner, (self.stops - self.starts).astype(float), n_texts)
        digits = np.diff(np.searchsorted(np.flatnonzero(self.kinds & DIGIT), self.first))
        return np.stack([np.where(n > 0, 1 - within / shown, 1.0), digits / shown, within / np.maximum(1, n)], axis=1), shown


#: Bits of a word's hash that stand beside the number of its text in one sort key.
HASH_BITS = 44


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    back = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (base, back))  # type: ignore[return-value]


@cache
def _codes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 0x110000, dtype=np.uint64)


def _word_hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, without a look at single words: differences of a sum of weighted codes, shifted to a common place."""
    up, down = _powers(1 << max(12, len(points).bit_length()))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_codes()[points] * up[: len(points)], out=sums[1:])
    mixed = (sums[stops] - sums[starts]) * down[starts]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def cut(texts: list[str], plain: bool = False) -> Chunk:
    """The words of texts after NFKC and case folding.

    Words are runs of letters and digits (joined by an apostrophe, hyphen or underscore) and single Han characters. With ``plain``
    format characters (category Cf) are dropped and a word is a maximal run of letters and digits, whatever their script;
    ``text`` then lacks what was dropped.
    """
    normal = [(t if t.isascii() else unicodedata.normalize("NFKC", t)).casefold() for t in texts]
    first = np.cumsum([0, *(len(t) + 1 for t in normal)])
    text = "\n".join([*normal, ""])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[points]
    if plain and len(dropped := np.flatnonzero(kinds & FORMAT)):
        kept = np.ones(len(kinds), bool)
        kept[dropped] = False
        first = first - np.searchsorted(dropped, first)
        points, kinds = points[kept], kinds[kept]
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
    part = np.zeros(len(kinds) + 2, bool)
    spelt = part[1:-1]
    if plain:
        np.greater(kinds & LETTER, 0, out=spelt)
    else:
        np.equal(kinds & (LETTER | HAN), LETTER, out=spelt)
        joins = np.flatnonzero(kinds & JOIN)
        spelt[joins[part[joins] & part[joins + 2]]] = True
    edges = np.flatnonzero(part[1:] != part[:-1])
    starts, stops = edges[::2], edges[1::2]
    if not plain and len(alone := np.flatnonzero(kinds & HAN)):
        starts, stops = np.concatenate([starts, alone]), np.concatenate([stops, alone + 1])
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], stops[order]
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, first)))
    return Chunk(text, points, kinds, first, starts, stops, owner)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs; by sorting, which is faster here than hashing."""
    keys = np.sort(keys)
    news = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[news], np.diff(np.append(news, len(keys)))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about CHUNK characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class HashTable:
    """Numbers of known distinct hashes: one slot for most of them, a search for the few that share one."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        bits = max(10, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slots, first, sharing = np.unique(keys >> self.shift, return_index=True, return_counts=True)
        self.keys, self.of = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.keys[slots], self.of[slots] = keys[first], numbers[first]
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slots[sharing > 1]] = True
        rest = np.setdiff1d(np.arange(len(keys)), first)
        order = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_of = keys[order], numbers[order].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.of, self.crowded, self.more_keys, self.more_of))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for unknown ones."""
        slot = hashes >> self.shift
        found = np.where(self.keys[slot] == hashes, self.of[slot], np.int32(-1))
        again = np.flatnonzero(self.crowded[slot] & (found < 0)) if len(self.more_keys) else ()
        if len(again):
            at = np.minimum(np.searchsorted(self.more_keys, hashes[again]), len(self.more_keys) - 1)
            found[again] = np.where(self.more_keys[at] == hashes[again], self.more_of[at], -1)
        return found
