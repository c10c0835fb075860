"""64-bit hashes of all words of a batch of texts, by numpy over their UTF-8 bytes.

A word's hash is a polynomial over table values of its bytes, taken from prefix sums, so the
cost is a few array passes whatever the number of words; equal words have equal hashes on
every machine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_ODD = 0x9E3779B97F4A7C15
#: Multipliers for words at successive places of an n-gram.
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = h ^ (h >> _SHIFT)
    h = h * _M1
    h ^= h >> _SHIFT
    h = h * _M2
    h ^= h >> _SHIFT
    return h


@cache
def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of them."""
    if len(_POWERS.get("up", ())) < n:
        base, size = _ODD, max(n, 1 << 19)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def forget() -> None:
    _POWERS.clear()


@cache
def ascii_folded() -> np.ndarray:
    """Byte to byte: A-Z to a-z, all others kept."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


@cache
def white_space() -> np.ndarray:
    """Class of each byte: 0 for space and 9 to 13, 1 for all others."""
    c = np.ones(256, np.uint8)
    c[[9, 10, 11, 12, 13, 32]] = 0
    return c


@cache
def word_classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1 letters, digits and all of multi-byte characters, 2 marks."""
    c = np.full(256, 2, np.uint8)
    c[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    c[[9, 10, 11, 12, 13, 32]] = 0
    return c


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, each followed by a line feed
    hash: np.ndarray  # of each word
    owner: np.ndarray  # text index of each word
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    base: np.ndarray  # offset of each text in data, one more at the end

    def counts(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=len(self.base) - 1)


def words(texts: list[bytes], classes: np.ndarray | None = None) -> Words:
    """Words are maximal runs of bytes of one class other than 0; case of A-Z doesn't count."""
    classes = white_space() if classes is None else classes
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    kind = classes[data]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edges = np.r_[0, change, len(data)] if len(data) else np.zeros(1, np.int64)
    begin, stop = edges[:-1], edges[1:]
    real = kind[begin] != 0 if len(begin) else np.zeros(0, bool)
    begin, stop = begin[real], stop[real]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values()[ascii_folded()[data]] * up[: len(data)], out=sums[1:])
    h = mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    return Words(data, h, np.searchsorted(base, begin, side="right") - 1, begin, stop, base)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words of one text, and the index of its first word."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h += w.hash[j : j + m] * PLACES[j]
    at = np.flatnonzero(w.owner[:m] == w.owner[n - 1 :])
    return mix(h[at]), at
