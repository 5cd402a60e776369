"""Tokenizers of given vocabulary files, a word at a time.

Neither tokenizer merges across a single space in front of a visible character: the byte-level one splits there before it
merges, and no piece of the other has a space behind another character (checked when it is loaded). So a text is cut at
its spaces and every word is encoded once for as long as a worker remembers it. A text in which a space stands at the end
or before white space is encoded whole, as one word.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Words of a generation that a worker remembers; of the one before it, those met again move on.
REMEMBERED = 200_000
#: Words of up to this many characters below OLD_LETTERS go to the faster library, whose classes of characters may differ beyond.
SHORT = 200
OLD_LETTERS = "ɐ"
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def path_of(name: str) -> str:
    """Where a vocabulary file lies; a path stays as it is."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter of every byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE. ``plain``: strings of special tokens are ordinary text; else they are those tokens."""

    def __init__(self, path: str, plain: bool):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        letters = _byte_letters()
        self.special = [t["content"] for t in content["added_tokens"]]
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in content["model"]["vocab"].items() if t not in self.special}
        self.plain = plain
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.quick = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.token_bytes.items()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= SHORT and (text.isascii() or max(text) < OLD_LETTERS) and (self.plain or not self.has_special(text)):
            return self.quick.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)


class PieceBpe:
    """BPE over pieces with byte fallback; it puts a space before every text by itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces cross words")
        self.token_bytes = {i: bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Remembered(dict):
    """word -> make(word), for the words of two generations."""

    def __init__(self, make, most: int = REMEMBERED):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        self[word] = value = self.make(word) if value is None else value
        return value


@lru_cache(4)
def byte_bpe(path: str, plain: bool) -> ByteBpe:
    return ByteBpe(path, plain)


@lru_cache(4)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def words_of(text: str) -> list[str]:
    """The words that stand after the spaces of " " + text; the whole text if it has a loose space."""
    return [text] if text[:1].isspace() or LOOSE_SPACE.search(text) else text.split(" ")
