"""Words and word shingles as 64-bit hashes, computed over whole Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import xxhash

# Zero-width space, non-joiner, joiner, word joiner, byte-order mark, soft hyphen.
INVISIBLE = re.compile("[​‌‍⁠﻿­]")
WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """NFKC-folded lower-case text without invisible characters."""
    if text.isascii():
        return text.lower()
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()


#: Texts longer than this are read match by match, without a list of their words.
LONG_TEXT = 2_000_000


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits of the folded text; none of a null text."""
    return WORD.findall(folded(text)) if text else []


class WordHashes(dict):
    """Hashes of words, kept while they fit."""

    limit = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


HASHES = WordHashes()
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def remix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after the other, and the start of each text in them (with the end as last)."""
    arrays, parts, ends = [], [], [0]

    def flush() -> None:
        arrays.append(np.fromiter(map(HASHES.__getitem__, parts), np.uint64, len(parts)))
        parts.clear()

    for text in texts:
        if text and len(text) > LONG_TEXT:
            flush()
            arrays.append(np.fromiter((HASHES[m.group()] for m in WORD.finditer(folded(text))), np.uint64))
            ends.append(ends[-1] + len(arrays[-1]))
        else:
            found = words(text)
            parts += found
            ends.append(ends[-1] + len(found))
    flush()
    return np.concatenate(arrays), np.array(ends, np.int64)


def shingle_hashes(texts: Iterable[str | None], size: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, word position) of every shingle in order of place, the word hashes, and the starts of the texts in them."""
    hashes, ends = word_hashes(texts)
    n = len(hashes) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, hashes, ends
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed = mixed * _MIX[2] + remix(hashes[i : i + n] + np.uint64(i))
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = owner[:n] == owner[size - 1 :]
    at = np.flatnonzero(inside)
    return remix(mixed[at]), owner[at], at - ends[owner[at]], hashes, ends


#: Bits kept of a hash where a whole set of shingles is compared; the other 16 hold the text's index while sorting.
SET_BITS = 48


def distinct_shingles(texts: Iterable[str | None], size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes (48 bits), sorted, one text after the other, and the starts of the texts in them.

    Takes up to 65,536 texts. Two different shingles of a text of n collide with a probability of about n * n / 2**49.
    """
    texts = list(texts)
    if len(texts) > 1 << (64 - SET_BITS):
        raise ValueError("too many texts at once")
    hashes, owner, *_ = shingle_hashes(texts, size)
    keyed = np.sort((owner.astype(np.uint64) << np.uint64(SET_BITS)) | (hashes >> np.uint64(64 - SET_BITS)))
    if len(keyed):
        keyed = keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))]
    owner = (keyed >> np.uint64(SET_BITS)).astype(np.int64)
    return keyed & np.uint64((1 << SET_BITS) - 1), np.searchsorted(owner, np.arange(len(texts) + 1))
