"""Words and shingle sets of texts, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Words that one chunk of texts holds at most, a single longer text aside.
CHUNK_WORDS = 150_000
#: Entries after which a task's word cache starts anew. It bounds memory only.
CACHE_WORDS = 150_000

_SPACES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and everything beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of MurmurHash3, fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _chain(columns: list[np.ndarray]) -> np.ndarray:
    h = mix(columns[0] + np.uint64(len(columns)))
    for c in columns[1:]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


def shingle_sets(texts: Iterable[str | None], width: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its `width`-word shingles.

    Fewer words than `width` make one shingle of the whole sequence; no words make an empty set.
    """
    none = np.empty(0, np.uint64)
    flat: list[bytes] = []
    lengths: list[int] = []

    def flush() -> Iterator[np.ndarray]:
        ids, at = hashes.of(flat), 0
        last = len(ids) - width + 1
        rolled = _chain([ids[j : last + j] for j in range(width)]) if last > 0 else none
        for n in lengths:
            if n >= width:
                yield np.unique(rolled[at : at + n - width + 1])
            elif n:
                yield _chain([ids[at + j : at + j + 1] for j in range(n)])
            else:
                yield none
            at += n

    for text in texts:
        words = space_words(text)
        flat += words
        lengths.append(len(words))
        if len(flat) >= CHUNK_WORDS:
            yield from flush()
            flat, lengths = [], []
    yield from flush()
