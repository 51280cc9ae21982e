"""Words of texts as 64-bit codes, whole chunks of text at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from bursar.llm.jaccard_join import mixed

#: Bytes of one chunk; a piece without any break may make a chunk larger.
CHUNK_BYTES = 2_000_000

WORD, GAP, BREAK = 0, 1, 2
#: Class of each byte: words are parted by space and tab, pieces by .,;:!? and the line ends 0A to 0D.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = GAP
_CLASS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(max(n, 2 * len(_POWERS[name])), base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The texts' bytes in chunks of about ``limit``, cut only between pieces; a line end parts two texts."""
    held, size = [], 0
    for text in texts:
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        while len(raw) > limit:  # a long text goes piece by piece
            breaks = np.flatnonzero(_CLASS[np.frombuffer(raw, np.uint8)] == BREAK)
            at = int(np.searchsorted(breaks, limit))
            if not len(breaks) or at == 0 and breaks[0] + 1 >= len(raw):
                break
            end = int(breaks[max(0, at - 1)]) + 1
            yield raw[:end]
            raw = raw[end:]
        held.append(raw)
        size += len(raw)
        if size >= limit:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def words_of(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(codes, piece numbers, starts, ends, lower-cased bytes) of a chunk's words, A-Z in lower case.

    A code is a polynomial over the word's bytes modulo 2^64, mixed; it is never 0.
    """
    raw = np.frombuffer(chunk, np.uint8)
    lower, kind = _LOWER[raw], _CLASS[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = kind == WORD
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    codes = mixed((sums[ends] - sums[starts]) * down[starts])
    codes[codes == 0] = 1
    pieces = np.cumsum(kind == BREAK)[starts] if len(raw) else np.zeros(0, np.int64)
    return codes, pieces, starts, ends, lower.tobytes()


def with_breaks(codes: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The codes with a 0 wherever a new piece begins."""
    if not len(codes):
        return codes
    at = np.arange(len(codes))
    at[1:] += np.cumsum(pieces[1:] != pieces[:-1])
    out = np.zeros(at[-1] + 1, np.uint64)
    out[at] = codes
    return out
