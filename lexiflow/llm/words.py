"""Words and word-sequence hashes of whole texts, vectorised per Arrow batch.

A word is a maximal run of bytes other than space and 0x09-0x0D; UTF-8 never
uses those bytes inside a character, so the rule holds for any language.
Hashes are 64-bit and not linear: a word's hash adds up a mix of each eight
bytes with their place, a sequence's hash mixes the hashes of its halves, so
no rearrangement of equal parts cancels out.  Different ``seed``s give
independent hashes, two of which make one of 128 bits.  No Python loop runs
over words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Texts are handled in runs of about so many bytes, which bounds memory; one longer text is a run of its own.
RUN_BYTES = 1 << 20

_SEED = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1B54A32D192ED03)

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first 0 .. 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _times(n: int) -> np.uint64:
    return np.uint64(int(_SEED) * n % (1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, UTF-8 texts) in runs of about RUN_BYTES; null counts as empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and size + len(b) > RUN_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def word_hashes(texts: list[bytes], lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, then the first word of each text (one more at the
    end), and the byte spans of the words in ``b"\\n".join(texts)``."""
    a = np.frombuffer(b"\n".join(texts) + b"\n" * 8, np.uint8)
    if lower:
        a = _LOWER[a]
    sep = _SEP[a[:len(a) - 7]]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]          # the last byte is a separator, so words are closed
    text_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(start, text_start)
    return _span_hashes(a, start, end, seed), first, start, end


def _span_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    length = end - start
    salt = _times(2 * seed + 1)
    # eight bytes from every place, as one number, without a copy
    eight = np.lib.stride_tricks.as_strided(a[:8].view("<u8"), (max(len(a) - 7, 0),), (1,))
    h = mix((eight[start] & _FIRST[np.minimum(length, 8)]) ^ salt) + length.astype(np.uint64)
    long = np.flatnonzero(length > 8)
    if len(long):
        parts = (length[long] - 1) // 8
        owner = np.repeat(long, parts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        at = start[owner] + 8 * place
        value = eight[at] & _FIRST[np.minimum(end[owner] - at, 8)]
        more = mix(mix(value ^ salt) + place.astype(np.uint64) * _ODD)
        h[long] += np.add.reduceat(more, np.cumsum(parts) - parts)
    return mix(h)


def sequence_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words (of the whole array:
    the caller leaves out runs that cross a text's edge).  Hashes of runs of
    1, 2, 4 ... words are doubled, those that the length is made of joined."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    whole, done, run, size = None, 0, h, 1
    while True:
        if length & size:
            whole = run if whole is None else _joined(whole, run[done:], size)
            done += size
        if done == length:
            return mix(whole[:len(h) - length + 1] + _times(length))
        run = _joined(run, run[size:], size)
        size *= 2


def _joined(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    n = min(len(left), len(right))
    return mix(left[:n] * _ODD + mix(right[:n] + _times(size)))


def placed_sums(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole sequence of words."""
    place = np.arange(len(h), dtype=np.uint64)
    x = mix(h + place * _SEED)
    y = mix(mix(h ^ _ODD) + place * _ODD)
    return tuple(int(v.sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0 for v in (x, y))


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct ``width``-word shingles of one text (as int64); with
    fewer words the whole sequence is one shingle, without words none."""
    if len(h) == 0:
        return np.empty(0, np.int64)
    return np.unique(sequence_hashes(h, min(width, len(h))).view(np.int64))
