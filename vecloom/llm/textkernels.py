"""Vectorised word hashing over Arrow string buffers, for Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text is one piece of its own.
PIECE = 1 << 18


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def pieces(raw: np.ndarray, off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first, end, bytes, own offsets."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


#: Masks that keep the lowest 0 to 8 bytes of a lane.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 64


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    ``breaks``: 256 booleans, true for bytes outside words.  ``fold`` maps
    A-Z to a-z.  A word is cut into lanes of 8 bytes that are mixed in one
    after the other, so words of one length up to 8 bytes never collide and
    no structure of longer ones does more than chance; words beyond LONG_WORD
    bytes get 64 bits of BLAKE2.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, breaks: np.ndarray, fold: bool = True):
        self.breaks = breaks
        self.table = np.arange(256, dtype=np.uint8)
        if fold:
            self.table[65:91] += 32

    def spans(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text (and past the last) its first word."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        inside = ~self.breaks[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = off[:-1][np.diff(off) > 0]
        begins[edges] = inside[edges]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        last = edges[1:] - 1
        stops[last] = inside[last]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts, ends, np.searchsorted(starts, off)

    def lane(self, padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """The ``k``-th 8 bytes of each word as a number, zero beyond its end."""
        eights = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        value = np.ascontiguousarray(eights[np.minimum(starts + 8 * k, len(padded) - 8)]).view("<u8").ravel()
        return value & LOW_BYTES[np.clip(sizes - 8 * k, 0, 8)]

    def padded(self, raw: np.ndarray) -> np.ndarray:
        """The bytes, folded, with eight more."""
        out = np.zeros(len(raw) + 8, np.uint8)
        np.take(self.table, raw, out=out[:len(raw)])
        return out

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        data, sizes = self.padded(raw), ends - starts
        h = mixed((sizes.astype(np.uint64) + np.uint64(1)) * np.uint64(self.BASE))
        h = mixed(h ^ self.lane(data, starts, sizes, 0))
        longer, k = np.flatnonzero(sizes > 8), 1
        while len(longer) and k < LONG_WORD // 8:
            h[longer] = mixed(h[longer] ^ self.lane(data, starts[longer], sizes[longer], k))
            k += 1
            longer = longer[sizes[longer] > 8 * k]
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
            h[i] = np.uint64(int.from_bytes(digest, "little"))
        return h


def break_table(chars: str) -> np.ndarray:
    """256 booleans from a string of single-byte characters."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


class Shingler:
    """Distinct word n-grams of texts as sorted 64-bit hashes.

    Words are maximal runs of other characters than ``SPACES``, A-Z folded.  A
    text with fewer words than ``width`` has its whole sequence as its one
    shingle; without words it has none.
    """

    def __init__(self, width: int):
        self.width = width
        self.words = WordHasher(break_table(SPACES))
        self.coef = mixed(np.arange(11, 11 + width, dtype=np.uint64) * np.uint64(WordHasher.BASE)) | np.uint64(1)

    def _grams(self, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every gram's hash, its first word and its number of words, in order; bounds of texts."""
        k = self.width
        w = self.words.hashes(raw, starts, ends)
        n_words = np.diff(first)
        n_grams = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        at = np.repeat(first[:-1], n_grams) + np.arange(n_grams.sum()) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
        size = np.minimum(np.repeat(n_words, n_grams), k)
        grams = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        for i in range(k):
            ok = i < size
            grams += np.where(ok, w[np.minimum(at + i, len(w) - 1)], np.uint64(0)) * self.coef[i] if len(w) else np.uint64(0)
        return mixed(grams), at, size, np.concatenate([[0], np.cumsum(n_grams)])

    def sets(self, raw: np.ndarray, off: np.ndarray, digests: bool = False):
        """All texts' shingles, one after the other, each text's sorted and distinct; bounds of texts.

        With ``digests`` also 128 bits of BLAKE2 of each text's words, folded
        and joined by single blanks, as two int64 columns: what tells whether
        two texts are the same sequence of words.
        """
        starts, ends, first = self.words.spans(raw, off)
        grams, _, _, bound = self._grams(starts, ends, first, raw)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if b - a > 1:
                grams[a:b].sort()
        keep = np.ones(len(grams), bool)
        keep[1:] = grams[1:] != grams[:-1]
        keep[bound[:-1][np.diff(bound) > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        if not digests:
            return grams[keep], kept[bound]
        data, at = self._normal(raw, off, starts, ends, first)
        whole = data.tobytes()
        sums = b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
        return grams[keep], kept[bound], np.frombuffer(sums, "<i8").reshape(-1, 2)

    def _normal(self, raw: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts' words, folded, with one blank between two words; bounds of texts."""
        data = self.words.table[raw]
        blank = self.words.breaks[raw]
        keep = ~blank
        inner = np.ones(len(starts), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        before = starts[inner] - 1
        keep[before] = True
        data[before] = 32
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[off]

    def detail(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One text: its distinct grams, sorted, and where each one's words stand in the normal bytes (begin, end, bytes)."""
        off = np.array([0, len(raw)])
        starts, ends, first = self.words.spans(raw, off)
        grams, at, size, _ = self._grams(starts, ends, first, raw)
        data, _ = self._normal(raw, off, starts, ends, first)
        begin = np.cumsum(ends - starts + 1) - (ends - starts + 1)
        grams, pick = np.unique(grams, return_index=True)
        last = at[pick] + size[pick] - 1
        return grams, begin[at[pick]] if len(at) else at, begin[last] + (ends - starts)[last] if len(at) else at, data


def same_grams(x: tuple, y: tuple, least: int = 1) -> int:
    """Grams that two texts (see ``Shingler.detail``) share: equal hashes whose words are equal, byte by byte.

    Fewer than ``least`` equal hashes are returned unchecked.
    """
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if len(common) < max(least, 1):
        return len(common)
    a, b, size = x[1][i], y[1][j], x[2][i] - x[1][i]
    fits = size == y[2][j] - b
    a, b, size = a[fits], b[fits], size[fits]
    owner = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    differs = x[3][a[owner] + step] != y[3][b[owner] + step]
    return len(size) - len(np.unique(owner[differs]))
