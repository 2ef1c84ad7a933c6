"""Token ids of two public vocabularies: a byte-level BPE of `tokenizers` and a BPE of `sentencepiece`.

A vocabulary is loaded once in a Python worker from the path given, which is a parameter of the operators; nothing is trained.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: The pattern that a byte-level pre-tokenizer splits texts by: fixed, as the vocabulary was made with it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from here on are left to `tokenizers`: the other engine's look-ahead recurses over them.
LONG_BLANK = re.compile(r"\s{20000}")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else 256, 257, ... in turn."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids by a `tokenizers` file. Where its merges are in the order of their ids, as in the public files, texts are encoded by
    `tiktoken` from the same merges, which gives the same ids in a quarter of the time; any other file goes to `tokenizers` itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        vocab, character = said["model"]["vocab"], _characters()
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(character[c] for c in token) if all(c in character for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in said["model"]["merges"]]
        plain = said["normalizer"] is None and said["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if plain and made == sorted(made) and not said["model"].get("ignore_merges"):
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocab.values() if i not in self.special.values()}
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """The ids of a text; the special tokens' strings in it are plain text."""
        if self.fast is None or len(text) >= 20000 and LONG_BLANK.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def marked_ids(self, text: str) -> list[int]:
        """The ids of a text; a special token's string in it is that token, as `tokenizers` takes it by default."""
        found = [s for s in self.special if s in text]
        if not found:
            return self.ids(text)
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")", text):
            out += [self.special[part]] if part in self.special else self.ids(part) if part else []
        return out


class Pieces:
    """Ids by a `sentencepiece` model, which puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = [self.model.is_byte(i) for i in range(n)]
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if own else x.replace("▁", " ").encode() for x, own in zip(names, self.is_byte)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def same_bytes(a: ByteLevel, b: Pieces) -> np.ndarray:
    """For each id of `a` the id of `b` of the same bytes, or -1. A whole piece comes before a byte that stands in for what has none."""
    known: dict[bytes, int] = {}
    for i, x in enumerate(b.bytes):
        if x not in known or b.is_byte[known[x]]:
            known[x] = i
    return np.array([known.get(x, -1) for x in a.bytes], np.int64)
