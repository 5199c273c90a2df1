"""Public tokenizer vocabularies, loaded once per Python worker from the path of their file."""

from __future__ import annotations

import base64
import functools


@functools.lru_cache(maxsize=4)
def byte_pair_encoder(path: str | None = None):
    """A tiktoken encoder for a file of byte ranks; by default the public 50k byte-level one.

    Its ids are those of the `tokenizers` file of the same vocabulary, without special tokens.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
