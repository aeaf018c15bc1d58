"""Encoding of whole texts by a byte-level vocabulary, however long their white space runs.

The vocabulary's pre-split pattern looks ahead in one place only: a run of white space leaves its last character to
what follows. Matching engines need a slow path, and a deep stack, for that. So runs of two or more are cut off first,
and the pattern without the look-ahead gives the same ids on what is left.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

#: Pre-split pattern of the byte-level vocabulary without its look-ahead, and Unicode white space. Fixed values.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
RUN = re.compile(f"[{WHITE}]{{2,}}")

_encoders: dict[int, Callable[[str], list[int]]] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The file of a public vocabulary (token and rank per line, under a megabyte), read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def encoder(blob: bytes) -> Callable[[str], list[int]]:
    """Text to ids; strings of special tokens are ordinary text. Built once in each Python worker."""
    key = hash(blob)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line)}
        plain = tiktoken.Encoding(str(key), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            run = RUN.search(text)
            if run is None:
                return plain(text)
            ids, at = [], 0
            while run is not None:
                end = run.end() if run.end() == len(text) else run.end() - 1
                ids += plain(text[at : run.start()]) + plain(text[run.start() : end])
                run, at = RUN.search(text, run.end()), end
            return ids + plain(text[at:])

        _encoders[key] = encode
    return _encoders[key]
