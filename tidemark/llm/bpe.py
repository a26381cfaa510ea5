"""Byte-level BPE over whole texts, one distinct word at a time.

A text is cut where the tokenizer's own pre-tokenizer always cuts, whatever stands around: before a white-space run
that follows something else than white space, where letters meet ASCII signs, and around added special tokens.
Encoding the pieces and joining the ids then equals encoding the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

#: Signs that some engines take for white space: a text holding one, or two white-space characters in a row, takes the careful way.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    　﻿"
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters up to an ASCII sign; a line feed before a letter; signs but for the apostrophe up to an ASCII letter, digit or
#: space; else all up to the next plain white space that surely starts a run.
_FINE = re.compile(
    rf" ?[{_LETTER}]++(?=[\x00-\x7f]|\Z)"
    r"|\n(?=[A-Za-z])"
    r"| ?[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9 \n]|\Z)"
    rf"|[ \n\r\t]*+[^ \n\r\t]++(?:(?<=[{_ODD}])[ \n\r\t]++[^ \n\r\t]++)*+"
    r"|[ \n\r\t]++"
)


def fine_units(text: str) -> list[str]:
    """Pieces of a text without special tokens whose encodings join to the text's encoding."""
    return _FINE.findall(text)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str | None = None):
    """The tokenizer of a file, without truncation or padding and on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or default_path())
    t.no_truncation()
    t.no_padding()
    return t


def special_tokens(t) -> list[str]:
    """Added tokens, longest first: the tokenizer takes their strings out of a text before anything else."""
    return sorted((a.content for a in t.get_added_tokens_decoder().values()), key=len, reverse=True)


class Splitter:
    """Cuts texts into words: ``rough`` at single spaces for speed where that is safe, else into fine units."""

    def __init__(self, specials: Iterable[str]):
        self.specials = list(specials)
        self._cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def rough(self, text: str) -> list[str] | None:
        """Parts of which the first stands bare, one that starts with a line feed stands as it is and any other has lost
        the space before it; None where the careful way is needed."""
        if any(p in text for p in _PAIRS) or any(s in text for s in self.specials):
            return None
        if any(c in text for c in (_ODD[:8] if text.isascii() else _ODD)):
            return None
        return text.replace("\n", " \n").split(" ")

    def careful(self, text: str) -> list[str]:
        """Fine units and special tokens of any text."""
        if not self._cut:
            return fine_units(text)
        return [u for k, s in enumerate(self._cut.split(text)) for u in ([s] if k % 2 else fine_units(s))]


#: Letters and signs that every Unicode version at hand classes alike; other texts go to the library itself.
_SURE = re.compile("[\x00-\u017f\u0410-\u044f\u2010-\u2027\u20ac\u4e00-\u9fa5]*")
#: The pre-tokenizer's pattern of byte-level BPE.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def byte_of_char() -> dict[str, int]:
    """The alphabet of byte-level BPE: visible Latin-1 characters stand for themselves, the other bytes, in order, for
    the characters from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


def cut_long(text: str, most: int) -> list[str]:
    """``text`` in pieces of about ``most`` characters, cut only before a space between two ASCII letters, where the
    pre-tokenizer cuts too. A text without such a place stays whole."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most and (m := _CUT.search(text, start + most)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


class Bpe:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    Texts of widely known characters take the ranks of the same file through a faster merge loop, which merges alike
    where ids follow the order of the merges; without that order, and for rarer characters, the library encodes them."""

    def __init__(self, path: str | None = None, piece: int = 1 << 16):
        import tiktoken

        self.tok, self.piece, self.fast = tokenizer(path), piece, None
        self.split = Splitter(special_tokens(self.tok))
        self.special = {s: self.tok.token_to_id(s) for s in self.split.specials}
        with open(path or default_path(), encoding="utf-8") as f:
            j = json.load(f)
        vocab, merges, pre = j["model"]["vocab"], j["model"]["merges"], j.get("pre_tokenizer") or {}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not j.get("normalizer") and all(a < b for a, b in zip(made, made[1:])):
            back = byte_of_char()
            ranks = {bytes(back[c] for c in k): v for k, v in vocab.items() if k not in self.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> list[str]:
        """``text`` cut around added special tokens."""
        return [p for p in self.split._cut.split(text) if p] if any(s in text for s in self.special) else [text]

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit integers."""
        pieces = [self._piece(p) for part in self.parts(text) for p in cut_long(part, self.piece)]
        return pieces[0] if len(pieces) == 1 else np.concatenate([np.empty(0, "<u4"), *pieces])

    def lengths(self, batch: list[str]) -> list[int]:
        """How many ids each text of a batch has; each is an added token or holds none. The batch is encoded in one call
        for each of the two engines."""
        out = [0] * len(batch)
        fast = [k for k, t in enumerate(batch) if self.fast is not None and t not in self.special and (t.isascii() or _SURE.fullmatch(t))]
        for k, x in zip(fast, self.fast.encode_ordinary_batch([batch[k] for k in fast], num_threads=1) if fast else []):
            out[k] = len(x)
        known = set(fast)
        rest = [k for k in range(len(batch)) if k not in known]
        for k, e in zip(rest, self.tok.encode_batch_fast([batch[k] for k in rest], add_special_tokens=False) if rest else []):
            out[k] = len(e.ids)
        return out

    def word(self, word: str) -> list[int]:
        """The ids of a word that is an added token or holds none."""
        if word in self.special:
            return [self.special[word]]
        if self.fast is not None and (word.isascii() or _SURE.fullmatch(word)):
            return self.fast.encode_ordinary(word)
        return self.tok.encode(word, add_special_tokens=False).ids

    def _piece(self, text: str) -> np.ndarray:
        if text in self.special:
            return np.array([self.special[text]], "<u4")
        if self.fast is not None and (text.isascii() or _SURE.fullmatch(text)):
            return self.fast.encode_to_numpy(text)
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")


_LOADED: dict = {}


def loaded(path: str | None = None) -> Bpe:
    """One encoder for each file and Python process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]
