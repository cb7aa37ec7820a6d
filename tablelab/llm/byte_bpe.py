"""Byte-level BPE of a tokenizers file, run by the faster of two libraries.

The merges of such a file are ranked by the ids that they make, so the vocabulary
is also one for ``tiktoken``, whose loop is several times as fast.  It is used if
the file is plain byte-level BPE with that order, for texts of characters whose
classes both libraries' Unicode tables agree on (assigned since Unicode 3.2) and
without added tokens that are to be recognised.  All others go through the
tokenizers library as they are; ids are the same either way.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

#: Fixed value: how byte-level BPE splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level BPE: bytes
    that are printable stand for themselves, the others for 256, 257, ..."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def _doubtful() -> str:
    """Characters that Unicode 3.2 did not have, or that were white space in it and aren't now."""
    old, spans = unicodedata.ucd_3_2_0.category, []
    for c in range(0x80, 0x110000):
        if old(chr(c)) in ("Cn", "Co", "Cs") or c in (0x180E, 0x200B):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


class ByteBPE:
    """``special_is_text``: special tokens' strings in a text are ordinary text."""

    def __init__(self, tokenizer_file: str, special_is_text: bool):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(tokenizer_file)
        self.tok.encode_special_tokens = special_is_text
        spec = json.loads(self.tok.to_str())
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        byte = byte_level_alphabet()
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        added = [t["content"] for t in spec.get("added_tokens", [])]
        heard = [t["content"] for t in spec.get("added_tokens", []) if not (special_is_text and t.get("special"))]
        self.fast = None
        plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                 and pre.get("use_regex", True) and spec.get("normalizer") is None
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "fuse_unk", "byte_fallback", "ignore_merges")))
        if plain:
            vocab = model["vocab"]
            made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
            single = {vocab.get(c) for c in byte}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
            if (None not in made and None not in single and made == sorted(set(made)) and max(single) < min(made, default=1 << 60)
                    and len(ranks) == len(made) + 256):
                import tiktoken
                self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.slow = re.compile("|".join([_doubtful(), *map(re.escape, heard)])).search
        self.slow_ascii = re.compile("|".join(map(re.escape, heard)) or r"(?!)").search

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        if self.fast is not None:
            run, slow, slow_ascii = self.fast.encode_ordinary, self.slow, self.slow_ascii
            for i, t in enumerate(texts):
                if not (slow_ascii(t) if t.isascii() else slow(t)):
                    out[i] = run(t)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out
