"""Pre-tokens of a byte-level BPE tokenizer, cut as its library cuts them, with each different chunk cut once.

A chunk is a stretch of text that begins with a space behind another character than white space, or with the text. No
pre-token of the usual pattern (contractions, letters, numbers or other marks after one space, white space) reaches over
such a border, nor does what is before it matter behind it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from tapeworks.llm.bpe import byte_chars

#: Latin letters that every version of Unicode knows as letters, and that are one letter in lower case as well.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ƺ"
#: Marks that often stand behind a word, each a pre-token of its own there.
MARKS = ".,;:!?)"


class Pretokens:
    """Cuts texts into chunks and chunks into pre-tokens (as strings of the text).

    Plain words, with at most one mark behind them, are cut here; every other chunk by the library's own pre-tokenizer,
    whose tables of letters and white space may be of another Unicode version than Python's.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        cut = steps["pre_tokenizer"]
        if steps["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or steps["model"]["type"] != "BPE":
            raise ValueError("not a byte-level BPE tokenizer without normalizer")
        if any(t[k] for t in steps["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("a special token that takes more than its own string")
        self.tok = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in steps["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.plain = re.compile(f"( ?[{LETTERS}]+)([{re.escape(MARKS)}]?)").fullmatch
        # Python's white space holds the library's; where in doubt, a border fewer does no harm
        self.odd = re.compile(r"\s ").search
        self.borders = re.compile(r"(?<=\S)(?= )").split
        self.chars = byte_chars()

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens' strings, and how many of these there are."""
        parts = self.special.split(text) if self.specials and any(s in text for s in self.specials) else [text]
        return [p for p in parts if p], len(parts) - 1

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] == " " or self.odd(text):
            return [c for c in self.borders(text) if c]
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def cut(self, chunk: str) -> list[str]:
        if m := self.plain(chunk):
            return [p for p in m.groups() if p]
        return [chunk[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(chunk)]

    def mapped(self, pretoken: str) -> str:
        """Its bytes as the vocabulary's characters."""
        chars = self.chars
        return "".join([chars[b] for b in pretoken.encode("utf-8", "replace")])

    def count(self, pretoken: str) -> int:
        """Number of pieces, without their ids."""
        return len(self.tok.model.tokenize(self.mapped(pretoken)))

    def ids(self, pretoken: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(self.mapped(pretoken))]

    def pretokens(self, text: str) -> Iterable[str]:
        for c in self.chunks(text):
            yield from self.cut(c)
