"""Token ids of whole texts, by a given tokenizer file.

The ids are those that the ``tokenizers`` library gives for the file. For a
plain byte-level BPE file they come from a second, faster implementation of the
same algorithm, built from the same file: its vocabulary gives the merge ranks.
All other files, and texts that hold one of the file's special tokens, go to the
library itself. Tests hold both against each other.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The public pre-tokenizer pattern of byte-level BPE.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable_bytes() -> dict[str, int]:
    """Byte-level BPE writes bytes as characters: printable ones as they are, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._fast = self._special = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if plain and spec["model"].get("type") == "BPE" and not spec.get("normalizer"):
            import tiktoken

            byte = _printable_bytes()
            special = {t["content"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self._fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._special = re.compile("|".join(map(re.escape, special))) if special else None

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text by the library."""
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if self._fast is None or (self._special and self._special.search(text)):
            return self.whole(text)
        return self._fast.encode_to_numpy(text, disallowed_special=())
