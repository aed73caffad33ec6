"""Byte-level pre-tokens of a text, and the vocabulary files of the public byte-level BPE."""

from __future__ import annotations

import functools
import json
import re

import regex

from panelframe.llm.common import Memo

VOCABULARY = "byte_bpe_50k.json"
# White space as the vocabulary's pattern has it, its pre-token pattern, its special string.
SPACE = "\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
_SPACE_RUN = re.compile(f"[{SPACE}] [{SPACE}]")
# Entries in each generation of a worker's table of known words; about 200 bytes each.
MEMO_ENTRIES = 200_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself where printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """(token bytes -> id, merges in rank order, special string -> id) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    stands = byte_symbols()
    raw = lambda s: bytes(stands[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return ids, [(raw(a), raw(b)) for a, b in pairs], special


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Gives a value for each independent piece of a text.

    A single space before a piece always begins a new pre-token unless a run of white space goes on
    past it, so the text falls apart at its spaces into pieces whose values can be kept and reused.
    `value` gets a piece (with its leading space) and returns what is kept for it.
    """

    def __init__(self, value, limit: int = MEMO_ENTRIES):
        self.value = value
        self.memo = Memo(lambda piece: value(" " + piece), limit)

    def forget(self) -> None:
        """Give back what is kept: workers live on when their task is done."""
        self.memo.clear()
        self.memo.old = {}

    def __call__(self, text: str) -> list:
        if _SPACE_RUN.search(text):
            return [self.value(text)]
        first, *rest = text.split(" ")
        out = [*map(self.memo.__getitem__, rest)]
        if first:
            out.append(self.value(first))
            out[1:], out[0] = out[:-1], out[-1]
        return out
