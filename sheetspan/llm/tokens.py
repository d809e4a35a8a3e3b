"""Token ids of whole texts, for use inside Spark tasks."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

_BEFORE_WORD = re.compile(r" (?=\S)")
#: White space other than a space or a line end.
_RARE_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_PLAIN = re.compile("[\x21-\x7e\xa1-\u024f]+")
#: How this vocabulary cuts a word, given with the space before it, into pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n")
_RARE_ASCII = [c for c in _RARE_SPACES if c.isascii()]
_loaded: dict[str, "Encoder"] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain_lines(text: str) -> bool:
    """Whether words are parted by single spaces or single line ends only."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE_SPACES))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable,
    else the next unused one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class _Memo(dict):
    """A dict that computes what it misses."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value


class Encoder:
    """Byte-level BPE ids of whole texts, with the ids of words kept from one text to the next.

    A byte-level BPE never merges across the start of a word: the space before a word opens a new
    piece.  So a text is cut before each space that a non-space follows and words seen before are
    looked up; the BPE model of the tokenizers library sees each new piece once.  Where lines are parted
    by single line ends, each line is cut by itself.  ``keep`` bounds the words held.

    The strings of special tokens in a text are ordinary text, as the notes on these vocabularies set it
    (``encode_special_tokens``); ``special_as_text=False`` gives them their special ids instead.
    """

    def __init__(self, path: str, keep: int = 300_000, special_as_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = None if special_as_text else re.compile("|".join(re.escape(a.content) for a in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.keep, self.words, self.pieces, self.firsts = keep, _Memo(self._word), _Memo(self._piece), _Memo(self._first)
        self.line_end = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece.isascii():
            spelled = "Ġ" + piece[1:]
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word with the space before it."""
        if word.isalpha():
            return self._piece(" " + word)
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self.words[word[:-1]] + self.pieces[word[-1]]
        if not _PLAIN.fullmatch(word):
            return self._ids(" " + word)
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(" " + word)))

    def _first(self, word: str) -> bytes:
        """Ids of a word at the beginning of a line."""
        if not _PLAIN.fullmatch(word):
            return self._ids(word)
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        look, first, out = self.words.__getitem__, self.firsts.__getitem__, []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.special is not None and self.special.search(t):
                out.append(self._ids(t))
            elif not _plain_lines(t):
                words = _BEFORE_WORD.split(t) if "  " in t else t.split(" ")
                out.append((self._ids(words[0]) if words[0] else b"") + b"".join(map(look, words[1:])))
            else:
                lines = [line.split(" ") for line in t.split("\n")]
                out.append(self.line_end.join([first(words[0]) + b"".join(map(look, words[1:])) for words in lines]))
        if len(self.words) + len(self.firsts) > self.keep:
            self.words.clear()
            self.pieces.clear()
            self.firsts.clear()
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def text_batches(texts: list[str | None], most: int = 1 << 20):
    """Slices whose texts have about ``most`` characters together (one text at least)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))
