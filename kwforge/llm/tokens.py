"""Ids of the public byte-level BPE vocabulary, as the tokenizers library gives them.

Texts of ordinary Latin characters go through tiktoken with the same vocabulary and pattern, which gives the same ids
at four times the speed (tests hold the two against each other); any other text goes through tokenizers itself, so that
no difference between the two libraries' Unicode tables can show.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

JSON_FILE, RANK_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ]*")
_LOADED: dict[tuple, object] = {}


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; each task asks on its own machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def plain_encoding(path: str | None = None):
    """tiktoken's encoding of the rank file, loaded once a process."""
    path = path or vocabulary_path(RANK_FILE)
    if ("plain", path) not in _LOADED:
        import public_tokenizers
        import tiktoken

        _LOADED["plain", path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _LOADED["plain", path]


def full_tokenizer(path: str | None = None):
    """The tokenizers library's own object, loaded once a process."""
    path = path or vocabulary_path(JSON_FILE)
    if ("full", path) not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED["full", path] = t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
    return _LOADED["full", path]


def encode(text: str | None) -> np.ndarray:
    """Ids of a whole text (null: none) as little-endian unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, "<u4")
    if _PLAIN.fullmatch(text):
        return np.array(plain_encoding().encode_ordinary(text), "<u4")
    return np.array(full_tokenizer().encode(text, add_special_tokens=False).ids, "<u4")
