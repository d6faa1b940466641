"""Byte-level BPE as the tokenizers library's JSON files define it, whole texts to numpy arrays of ids.

The library defines the result. Where the file says no more than a byte-level vocabulary whose merges follow the ids,
tiktoken, given the same vocabulary and pattern, gives the same ids several times faster and is asked instead; its
pattern matcher has no room for very long runs of white space, so texts with such a run go to the library itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

from .word_pieces import byte_letters

#: How byte-level files split texts (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that long is left to the library.
LONG_BLANK = 1 << 16
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}").search


class ByteLevel:
    """One vocabulary; plain: special tokens' strings in a text are ordinary text, else they are those tokens."""

    def __init__(self, file: bytes, plain: bool):
        self.file, self.plain, said = file, plain, json.loads(file)
        specials = {t["content"]: t["id"] for t in said["added_tokens"]}
        letters = {c: b for b, c in byte_letters().items()}
        vocabulary = {bytes(map(letters.__getitem__, k)): i for k, i in said["model"]["vocab"].items() if k not in specials}
        #: Each id's bytes, and how many they are.
        self.tokens = [b""] * (1 + max(*vocabulary.values(), *specials.values(), 0))
        for k, i in [*vocabulary.items(), *((k.encode(), i) for k, i in specials.items())]:
            self.tokens[i] = k
        self.sizes = np.array(list(map(len, self.tokens)))
        self.fast = None
        if _simple(said, vocabulary):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens=specials)
        self.allowed = set() if plain else set(specials)

    @cached_property
    def own(self):
        """The library, where it is needed."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(self.file.decode())
        own.encode_special_tokens = self.plain
        return own

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, without added special tokens."""
        if self.fast is None or len(text) >= LONG_BLANK and _LONG_BLANK(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())


def _simple(said: dict, vocabulary: dict[bytes, int]) -> bool:
    """Does the file ask for nothing but byte-level splitting and merges in the order of the ids they make?"""
    pre, model = said["pre_tokenizer"] or {}, said["model"]
    merged = [vocabulary_id(model["vocab"], m) for m in model["merges"]]
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and merged == sorted(set(merged))
        and len(merged) + 256 == len(vocabulary)
        and sorted(vocabulary.values()) == [*range(len(vocabulary))]
    )


def vocabulary_id(vocab: dict[str, int], merge: str | list[str]) -> int:
    """The id of the token that a merge makes; files write merges as pairs or as two parts with a blank between."""
    return vocab["".join(merge if isinstance(merge, list) else merge.split(" "))]


@lru_cache(maxsize=2)
def byte_level(file: bytes, plain: bool) -> ByteLevel:
    return ByteLevel(file, plain)
