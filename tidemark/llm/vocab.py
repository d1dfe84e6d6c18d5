"""Public vocabularies inside tasks: loaded once for each worker, with a bounded memory of pieces."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Pieces whose ids a worker remembers; of at most twice as many, those used last.
REMEMBERED = 600_000
#: Printable ASCII, space, line end and the Latin letters to U+00FF: all libraries agree on their kinds, and none changes under NFC.
_LATIN = re.compile(r"[ \n!-~\xc0-\xff]*")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def path(name: str) -> str:
    """A file of the public vocabularies, or name itself if it is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tiktoken_encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_table() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_table()


def _byte_chars(text: str) -> str:
    if text.isascii():
        return text.replace(" ", "\u0120").replace("\n", "\u010a")
    return text.encode().decode("latin-1").translate(_BYTES)


def _split_pattern(file: str) -> str:
    """The Split pattern of a tokenizers file, without reading its vocabulary into Python."""
    with open(file, encoding="utf-8") as f:
        found = re.search(r'"type":\s*"Split",\s*"pattern":\s*\{\s*"Regex":\s*("(?:[^"\\]|\\.)*")', f.read())
    return json.loads(found[1])


class _Known(dict):
    """Ids of pieces; a new one is taken from those of before or made."""

    def __init__(self, make, before: dict):
        self.make, self.before = make, before

    def __missing__(self, key: str) -> bytes:
        got = self[key] = self.before.get(key) or self.make(key)
        return got


class Encoder:
    """Texts to ids of a tokenizers file, as encode(text, add_special_tokens=False) gives them.

    Texts are cut only where no vocabulary piece can span: before a single space or line end between two
    characters that are no white space ("prefix" files, where a space belongs to the next word), or at
    spaces and line ends ("drop" files, where white space is dropped). A new piece of Latin
    text goes straight to the library's model, by the file's own pattern; any other goes
    through the whole library. Pieces are remembered. A text that holds one of the file's
    special strings is encoded whole.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path(name))
        self.model = self.tok.model
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind, self.code = (np.uint16, "H") if self.vocab_size <= 1 << 16 else (np.uint32, "I")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: A normalizer that makes white space one kind means that white space is dropped.
        self.drops = self.tok.normalizer is not None
        self.words = regex.compile(_split_pattern(path(name)) if self.drops else public_tokenizers.PATTERN).findall
        self.make = self.piece if self.drops else lambda p: self.piece(p if p[:1] == "\n" else " " + p)
        self.known = _Known(self.make, {})
        self.parts: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of a new piece."""
        if not _LATIN.fullmatch(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.drops:
            text = text.lower()
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            return self._word(text)
        if body[:-1].isalpha() and body[-1] in ".,":
            words = [text[:-1], text[-1]]
        else:
            words = self.words(text)
        return b"".join(map(self._part, words))

    def _part(self, word: str) -> bytes:
        """Ids of a word inside a piece; letters alone are a piece that is known by itself."""
        key = word if self.drops else word[1:] if word[0] == " " else ""
        if key.isalpha():
            return self.known[key]
        got = self.parts.get(word)
        if got is None:
            got = self.parts[word] = self._word(word)
        return got

    def _word(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(_byte_chars(word))]).tobytes()

    def _one(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.drops:
            return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))
        plain = not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n") or text[:1] == "\n") and text.replace("\n", "").isprintable()
        parts = text.replace("\n", " \n").split(" ") if plain else _SAFE_SPACE.split(text)
        return self.piece(parts[0]) + b"".join(map(self.known.__getitem__, parts[1:]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, uint16 if the vocabulary allows."""
        if len(self.known) > REMEMBERED:
            self.known = _Known(self.make, dict(self.known))
        if len(self.parts) > REMEMBERED // 4:
            self.parts.clear()
        return [np.frombuffer(self._one(t), self.kind) for t in texts]


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)
