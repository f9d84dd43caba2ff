"""Words of many texts at once, as NumPy arrays over one byte buffer.

The word of the searches is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are
lower-cased: ASCII digits and letters and everything beyond ASCII.
"""

from __future__ import annotations

import numpy as np
import xxhash

_bytes = np.arange(256, dtype=np.uint8)
_upper = (_bytes >= 65) & (_bytes <= 90)
_word = _upper | ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
#: Byte -> lower-cased byte of a word, or a space.
LOWERED = np.where(_upper, _bytes + 32, _bytes).astype(np.uint8)
FOLD = np.where(_word, LOWERED, 32).astype(np.uint8)
FOLD_BYTES = FOLD.tobytes()
P = np.uint64(0x9E3779B97F4A7C15)
LONG = 24  # longer words are hashed one by one


def word_list(text: bytes) -> list[bytes]:
    """The words of one text."""
    return text.translate(FOLD_BYTES).split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_word(word: bytes) -> int:
    """The hash of one word, as hash_words has it."""
    data = np.frombuffer(word, np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(word)]))[0])


def hash_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : start + length] (any integer elements; long words through their bytes)."""
    h = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return h
    order = np.argsort(-np.minimum(lengths, LONG + 1), kind="stable")
    at, size = starts[order], lengths[order]
    n_long = int(np.count_nonzero(size > LONG))
    acc = np.zeros(len(order), np.uint64)
    most = int(min(size[0], LONG))
    # number of words with more than j elements, for each j
    more = np.searchsorted(-np.minimum(size, LONG + 1), -np.arange(most), "left")
    for j in range(most):
        k = more[j]
        acc[:k] = acc[:k] * P + data[at[:k] + j] + np.uint64(1)
    for i in range(n_long):
        acc[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + size[i]].tobytes())
    h[order] = mix(acc ^ (np.minimum(size, 1 << 30).astype(np.uint64) << np.uint64(56)))
    return h


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of `inside` that end at text boundaries: (starts, lengths, first run of each text, and the end)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets, "left")


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and the end, folded bytes)."""
    folded = FOLD[data]
    starts, lengths, firsts = spans(folded != 32, offsets)
    return hash_words(folded, starts, lengths), firsts, folded


def owner(firsts: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[i] : firsts[i + 1]] along axis 0; 0 for no values."""
    total = np.zeros((len(firsts),) + values.shape[1:], np.float64 if values.dtype.kind == "f" else np.int64)
    filled = np.flatnonzero(np.diff(firsts) > 0)
    out = np.zeros((len(firsts) - 1,) + values.shape[1:], total.dtype)
    if len(filled):
        out[filled] = np.add.reduceat(values, firsts[filled], axis=0, dtype=total.dtype)
    return out
