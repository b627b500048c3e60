"""Byte-level BPE ids from a tokenizer file, fast enough for whole corpora.

The file of the tokenizers library names the vocabulary; merging by its ranks gives the same ids
several times faster, if the file is of the plain byte-level kind: that is checked, and any other file
is left to the library itself. So are texts that hold the string of a special token.
"""

from __future__ import annotations

import importlib
import json
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

#: Splits text before merging, as the tokenizer file's byte-level splitter does (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in the file: bytes that are printable themselves, then the others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: What a file must say, besides its vocabulary and merges, to be read by ranks (fixed values).
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
    "byte_fallback": False, "ignore_merges": False
}


def by_ranks(spec: dict) -> bool:
    """Whether a file's ids are those of merging byte pairs by the rank of the result, after the usual byte-level split."""
    splitter, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or any(splitter.get(k) != v for k, v in _SPLITTER.items()) or any(
        (model.get(k) or None) != (v or None) for k, v in _MODEL.items()
    ):
        return False
    merged = [model["vocab"].get("".join(m.split(" ", 1) if isinstance(m, str) else m)) for m in model["merges"]]
    rest = len(model["vocab"]) - len(merged)
    return rest == 256 and None not in merged and all(
        a < b for a, b in zip(merged[:-1], merged[1:], strict=True)
    ) and min(merged, default=rest) >= rest


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.full, self.fast = Tokenizer.from_file(path), None
        #: Leaves of a text can be encoded on their own where the splitter parts them.
        self.parts_at_spaces = by_ranks(spec)
        if self.parts_at_spaces:
            stand_in = _byte_of()
            ranks = {bytes(stand_in[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
