"""Vectorised tokenising and hashing of Arrow text columns.

Every function works on whole texts, block by block: a block is a run of
documents of about ``BLOCK_BYTES`` bytes (one longer document is a block of its
own), so temporaries stay small whatever the Arrow batch holds. Hashes depend
on the bytes alone: they agree between workers, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte classes: 0 separates tokens; a token is a run of one other class.
_bytes = np.arange(256)
WHITESPACE = np.where((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)), 0, 1).astype(np.uint8)
_is_word = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x41) & (_bytes <= 0x5A)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
WORDS = _is_word.astype(np.uint8)
WORDS_AND_MARKS = np.where(_is_word, 1, np.where(_bytes <= 0x20, 0, 2)).astype(np.uint8)
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, _BASE_INVERSE)):
            full = np.full(max(n, BLOCK_BYTES * 2), base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of documents."""
    data, at = utf8_parts(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Tokens:
    """Tokens of a block: start and end bytes, 64-bit hash, and for each
    document the first token's index (n + 1 values)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool = True):
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
            return
        kind = classes[data]
        change = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=change[1:n])
        change[offsets] = True
        solid = kind > 0
        self.start = np.flatnonzero(change[:-1] & solid)
        self.end = np.flatnonzero(change[1:] & solid) + 1
        up, down = _powers_to(n + 1)
        code = (_BYTE_CODE[LOWER] if lower else _BYTE_CODE)[data]
        code *= up[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offsets)


def shingles(tokens: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive tokens of each document, and for each document
    the index of its first. A document of fewer tokens, but not none, has its
    whole sequence as one (hashed apart from k-token ones)."""
    h, first = tokens.hash, tokens.first
    count = np.diff(first)
    if k == 1:
        return h, first
    acc = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        acc = mix(acc * _U(0x2545F4914F6CDD1D) + h[i : len(h) - k + 1 + i] + _U(i + 1))
    whole = count >= k
    own = np.where(whole, count - k + 1, np.minimum(count, 1))
    start = np.concatenate(([0], np.cumsum(own)))
    out = np.empty(start[-1], np.uint64)
    inside = np.repeat(first[:-1] - start[:-1], own) + np.arange(start[-1])
    long = np.repeat(whole, own)
    out[long] = acc[inside[long]]
    for d in np.flatnonzero(~whole & (count > 0)):
        x = np.array([count[d]], np.uint64)
        for i in range(first[d], first[d + 1]):
            x = mix(x * _U(0xD6E8FEB86659FD93) + h[i : i + 1])
        out[start[d]] = x[0]
    return out, start


def sums_by_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row sums of each document's run in ``values`` (0 for an empty run)."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    if len(values):
        full = np.flatnonzero(first[1:] > first[:-1])
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=np.float64)
    return out


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point to itself if it is a letter, else to a blank."""
    if not _letters:
        with np.errstate(all="ignore"):
            _letters.append(np.array([c if 0xD800 > c and chr(c).isalpha() or c > 0xDFFF and chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32))
    return _letters[0]


def characters(data: np.ndarray, offsets: np.ndarray, letters_only: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a block with one blank after each document,
    and the documents' first indexes (n + 1 values). With ``letters_only``,
    what isn't a letter is a blank."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    return (letter_table()[points] if letters_only else points), first


def char_grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash in [0, 2**bits) of the n characters that begin at each index; the
    last n - 1 of the block are padded with blanks."""
    padded = np.concatenate((points, np.full(n - 1, 32, np.uint32))) if n > 1 else points
    acc = np.full(len(points), np.uint32(0x811C9DC5 + n), np.uint32)
    for i in range(n):
        acc ^= padded[i : len(points) + i]
        acc *= np.uint32(0x85EBCA6B)
        acc ^= acc >> np.uint32(15)
    acc *= np.uint32(0xC2B2AE35)
    return acc >> np.uint32(32 - bits)
