"""Vectorised hashing of words: numpy over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than ASCII white space, so that the words of a text are
``re.findall(r"[^\\x20\\x09-\\x0D]+", text)``. Hashes are polynomials modulo 2**64, mixed at the end.
Memory is bounded by a slice of text, not by a batch or a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
SLICE = 1 << 20
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = bytes(_lower)
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash so that every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(number of the text, piece): long texts are cut at white space."""
    for k, text in enumerate(texts):
        if len(text) <= SLICE:
            yield k, text
            continue
        at = 0
        while at < len(text):
            to = at + SLICE
            while to < len(text) and not _space[text[to]]:
                to += 1
            yield k, text[at:to]
            at = to


def _slice_hashes(pieces: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(pieces)
    buf = np.frombuffer(joined.translate(LOWER) if lower else joined, np.uint8)
    inside = np.flatnonzero(~_space[buf])
    if not len(inside):
        return np.empty(0, U), np.zeros(len(pieces), np.int64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
    starts = inside[first]
    lengths = np.diff(first, append=len(inside))
    offset = inside - np.repeat(starts, lengths)
    value = (buf[inside].astype(U) + U(1)) * powers(_B1, int(lengths.max()))[offset]
    hashes = mix(np.add.reduceat(value, first) + lengths.astype(U) * U(_B2))
    ends = np.cumsum([len(p) + 1 for p in pieces])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    counts = np.zeros(len(texts), np.int64)
    out, held, numbers, total = [], [], [], 0

    def flush() -> None:
        hashes, n = _slice_hashes(held, lower)
        out.append(hashes)
        np.add.at(counts, numbers, n)

    for k, piece in _pieces(texts):
        if held and total + len(piece) > SLICE:
            flush()
            held, numbers, total = [], [], 0
        held.append(piece)
        numbers.append(k)
        total += len(piece)
    if held:
        flush()
    return (np.concatenate(out) if out else np.empty(0, U)), counts


def window_hashes(words: np.ndarray, starts: np.ndarray, length: int, base: int = _B1) -> np.ndarray:
    """Hash of the ``length`` words from each start; the caller sees to it that they lie in one text. Another odd ``base``, another hash."""
    if not len(starts):
        return np.empty(0, U)
    total = np.zeros(len(starts), U)
    for k in range(length):
        total *= U(base)
        total += words[starts + k]
    return mix(total + U(length * _B2 & (2**64 - 1)))


def positions(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each text."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def slices(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    lo, total = 0, 0
    for k, text in enumerate(texts):
        if k > lo and total + len(text) > limit:
            yield lo, k
            lo, total = k, 0
        total += len(text)
    if lo < len(texts):
        yield lo, len(texts)
