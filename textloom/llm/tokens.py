"""Token ids of a byte-level BPE file, with a cache of words for each Python worker.

Such a tokenizer's pattern never lets a token cross the border before a single space, so a text
falls apart at its spaces into words that are encoded alike wherever they stand. Texts with a
space after other white space are encoded whole. Where added tokens are asked for, a text is split
at them first and each gives its own id, as the ``tokenizers`` library does by default.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

SPACE_AFTER_SPACE = re.compile(r"\s ")
CACHE_WORDS, CACHE_CHARS = 300_000, 40


class WordEncoder:
    def __init__(self, encode):
        self.encode = lambda s: array("I", encode(s)).tobytes()
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers of this machine's (little-endian) order."""
        if SPACE_AFTER_SPACE.search(text):
            return self.encode(text)
        words = text.split(" ")
        head = words[0]
        start = self.first.get(head)
        if start is None:
            start = self.encode(head)
            if len(head) <= CACHE_CHARS and len(self.first) < CACHE_WORDS:
                self.first[head] = start
        words[0] = ""
        known = self.later
        try:
            return start + b"".join(map(known.__getitem__, words[1:]))
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
        once = {}
        for w in set(words[1:]):
            if w not in known:
                (known if len(w) <= CACHE_CHARS else once)[w] = self.encode(" " + w)
        return start + b"".join([once[w] if w in once else known[w] for w in words[1:]])


class AddedTokens:
    """Splits texts at the added tokens, of several that begin at one place at the longest."""

    def __init__(self, words: WordEncoder, ids: dict[str, int]):
        self.words = words
        self.ids = {t: array("I", [i]).tobytes() for t, i in ids.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")").split

    def __call__(self, text: str) -> bytes:
        parts = self.split(text)
        if len(parts) == 1:
            return self.words(text)
        return b"".join([self.ids[x] if i % 2 else self.words(x) for i, x in enumerate(parts) if x])


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> WordEncoder | AddedTokens:
    """For a tokenizer file in the JSON format of the ``tokenizers`` library; ``added``: the file's
    added tokens give their own ids, as by the library's default, else they are read as plain text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    fast, tokens = _ranked(spec), spec.get("added_tokens", []) if added else []
    if fast and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in tokens):
        words = WordEncoder(fast)
        return AddedTokens(words, {t["content"]: t["id"] for t in tokens}) if tokens else words
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not added
    out = WordEncoder(lambda s: t.encode(s, add_special_tokens=False).ids)
    out.__class__ = type("WholeTexts", (WordEncoder,), {"__call__": lambda self, text: self.encode(text)})
    return out


def _ranked(spec: dict):
    """An encode function if the file is plain byte-level BPE with ids in merge order, else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("dropout") or model.get("ignore_merges"):
        return None
    import public_tokenizers
    import tiktoken

    byte_of = {c: b for b, c in _byte_chars().items()}
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE files write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
