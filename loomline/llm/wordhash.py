"""64-bit hashes of the words of texts.

A word's hash is a keyed BLAKE2 digest, so that no two words can be made to agree by arithmetic; a bounded cache of
distinct words makes it one look-up a word. Texts of any length are cut into words in blocks that end where a word ends.
"""

from __future__ import annotations

import hashlib

import numpy as np

LIMIT = 1 << 20
CACHED = 1 << 18
KEY = b"loomline words"
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a bijection on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY).digest(), "little")
        return found


_digest_of = _Digests().__getitem__


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest_of, words), U64, len(words))


class Words:
    """A way to cut texts into words: `table` maps each byte to the byte that is kept, separators to a space."""

    def __init__(self, table: bytes):
        self.table = table

    def blocks(self, text: str | None, limit: int | None = None):
        """Lists of a text's words, in order, of about `limit` bytes each."""
        data, limit, start = encode(text).translate(self.table), limit or LIMIT, 0
        while start < len(data):
            end = start + limit
            if end < len(data):
                cut = data.rfind(b" ", start, end)
                cut = cut if cut > start else data.find(b" ", end)
                end = cut if cut > 0 else len(data)
            yield data[start:end].split()
            start = end

    def hashes(self, text: str | None) -> np.ndarray:
        """The hashes of all words of a text."""
        parts = [hashes_of(words) for words in self.blocks(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, U64)


#: A-Z become a-z; space and the control characters 9 to 13 separate.
SPACED = Words(bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)))
