"""Word shingles of whole texts as sets of 64-bit hashes, many texts at once."""

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
KEPT_WORDS = 200_000


class WordHashes(dict):
    """Hash of a word, computed once while it is kept."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def spread(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of the `words` words from each position on that has as many."""
    n = len(h) - words + 1
    out = spread(h[:n])
    for k in range(1, words):
        out = spread(out + h[k : n + k])
    return out


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted hashes.

    Words are the runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words has its whole
    sequence as the one shingle; a text without words, or null, has none.
    """
    known = WordHashes()
    out = []
    for text in texts:
        # Bytes: lower() and split() of bytes know ASCII alone.
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if 0 < len(h) < words:
            out.append(rolled(h, len(h)) ^ np.uint64(len(h)))
        else:
            out.append(np.unique(rolled(h, words)) if len(h) else h)
        if len(known) > KEPT_WORDS:
            known.clear()
    return out
