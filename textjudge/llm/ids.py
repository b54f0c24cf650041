"""Token ids of whole texts with the vocabulary of a tokenizer file, by the tiktoken library.

The library merges by the rank of the merged token. That is the rule of the tokenizer file
whenever ids follow the order of its merges, which is checked when the file is read.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import tiktoken

from textjudge.llm.bpe import byte_letters

#: fixed value: the pattern of byte-level pre-tokenizers
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: settings of a tokenizer file that would change ids, with the values that are understood
PLAIN = {"dropout": (None, 0.0), "byte_fallback": (None, False), "ignore_merges": (None, False), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, "")}


class Encoder:
    """Texts to ids; strings of added tokens in a text are those tokens."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, before, added = spec["model"], spec["pre_tokenizer"], spec.get("added_tokens", [])
        odd = [k for k, good in PLAIN.items() if model.get(k) not in good]
        odd += [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or spec.get("normalizer") or before.get("add_prefix_space") or not before.get("use_regex", True) or odd:
            raise ValueError(f"only plain byte-level BPE without normalizer and added prefix space; not understood: {odd}")
        code = {c: b for b, c in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in added}
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        ranks = {bytes(code[c] for c in text): i for text, i in ids.items()}
        made = [ids[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        if made != sorted(set(made)) or len(made) + 256 != len(ranks):
            raise ValueError("ids do not follow the order of the merges")
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.model = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(text, allowed_special="all")


@cache
def encoder(source: str) -> Encoder:
    """One per worker process."""
    return Encoder(source)
