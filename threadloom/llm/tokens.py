"""Public tokenizer vocabularies, loaded once per Python worker; their path is a parameter."""

from __future__ import annotations

import base64
import functools
import os

# Fixed value: the folder of the vocabulary files, unless the parameter names another.
DEFAULT_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern that belongs to this byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoding(folder: str = DEFAULT_DIR, name: str = VOCABULARY):
    """The tiktoken encoding of a vocabulary file of ranks."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, folder: str = DEFAULT_DIR) -> int:
    """The tokens of a text; none for null and empty."""
    return len(encoding(folder).encode_ordinary(text)) if text else 0


@functools.lru_cache(maxsize=65536)
def chars_per_subword(text: str, folder: str = DEFAULT_DIR) -> float:
    """Characters per subword: natural words come in long subwords, random strings in short ones."""
    return len(text) / max(1, count_tokens(text, folder))
