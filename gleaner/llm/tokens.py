"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np

# How this vocabulary splits texts before merging; a fixed value of its tokenizer.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# Anything but ASCII and Latin letters, and what may be white space to one library only;
# "<|" may begin a special token.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7f¡-ɏ]|<\\|")


class ByteBpe:
    """Ids as ``tokenizers`` gives them for ``json_path``, without special tokens added.

    With ``ranks_path``, the same vocabulary in rank form, texts of ASCII and Latin
    letters go through ``tiktoken``, which is several times faster and splits these
    characters alike; every other text goes through ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None) -> None:
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(json_path)
        self._fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {
                    base64.b64decode(token): int(rank)
                    for token, rank in map(bytes.split, lines)
                }
            self._fast = tiktoken.Encoding(
                "ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, text: str) -> np.ndarray:
        if self._fast is None or _OTHER.search(text):
            ids = self._slow.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4")
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
