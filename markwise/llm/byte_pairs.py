"""Byte-level BPE vocabularies.

Plain Python for use inside tasks; the operators that spread texts over tasks
are in ``chunked_encoding`` and ``packing``.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import regex
import tiktoken

#: Fixed value: splits a text into the pieces that are merged separately.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The white space of Unicode, which the pattern means by \s.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def exact_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its classes of white space written out."""
    spelt = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(spelt)


class BytePairs:
    """A vocabulary: the bytes of every id; lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.pieces = exact_pattern(pattern)
        self.merger = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.merger.encode_ordinary(text)

    def encode_array(self, text: str) -> np.ndarray:
        return self.merger.encode_to_numpy(text, disallowed_special=())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def from_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones
    for themselves, the others, in order, for 256 and up."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def from_json(content: str) -> dict[bytes, int]:
    """The ranks of a vocabulary whose ids follow the order of its merges."""
    model = json.loads(content)["model"]
    letters, ids = printable_bytes(), model["vocab"]
    order = [ids[a + b] for a, b in model["merges"]]
    if order != sorted(order):
        raise ValueError("ids do not follow the order of the merges")
    return {bytes(letters[c] for c in token): number for token, number in ids.items()}


@functools.lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    """A vocabulary file, read once per Python worker."""
    with open(path, "rb") as file:
        content = file.read()
    return BytePairs(from_json(content.decode()) if path.endswith(".json") else from_ranks(content))
