"""Public tokenizers inside tasks: a text's ids are joined from those of its white-space words.

The word vocabulary's pre-tokenizer never matches across white space, so a word has the same ids alone as in its
text; a bounded cache of words then does most of the work.
"""

from __future__ import annotations

import os
import re
import struct

_loaded: dict[str, "WordIds"] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII that is neither letter, digit, white space nor the apostrophe of contractions
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: small letters (Latin, Greek, Cyrillic) that normalizing leaves as they are
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(
    chr(c) for a, b in ((0xDF, 0xF6), (0xF8, 0xFF), (0x3B1, 0x3C9), (0x430, 0x45F)) for c in range(a, b + 1))
#: the characters by which byte-level vocabularies spell bytes that are not printable in Latin-1
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(
    b for b in range(256) if b <= 32 or not chr(b).isprintable())}

ID = struct.Struct("<I")


def spelled(word: bytes) -> str:
    """A word as byte-level vocabularies spell it."""
    text = word.decode("latin-1")
    return text if text.isprintable() else text.translate(BYTE_CHARS)


class WordCache(dict[bytes, bytes]):
    """Ids of words, as little-endian unsigned 32-bit bytes, found when first asked for. When the newer half is full it
    becomes the older one, from which words in use come back; so only words not met for long are tokenized again."""

    LARGEST = 300_000  # words of both halves, some 45 MB

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # letters alone go straight to the vocabulary's merges, if normalizer and pre-tokenizer leave them in one piece
        before = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(LETTERS))
        whole = [w for w, _ in before] == [spelled(LETTERS.encode())]
        self.plain = re.compile(f"[{LETTERS}]+" if whole else "(?!)")

    def __missing__(self, word: bytes) -> bytes:
        got = self.older.get(word)
        if got is None:
            # a word and the marks behind it are separate tokens, so "word," is "word" and ","
            stem = word.rstrip(MARKS)
            ends = stem[-1:].isalnum() or stem and stem.decode()[-1] in LETTERS
            marked = ends and len(stem) < len(word) and b"<|" not in word
            got = self[stem] + self[word[len(stem):]] if marked else self.tokenize(word)
        if len(self) >= self.LARGEST // 2:
            self.older.clear()
            self.older.update(self)
            self.clear()
        self[word] = got
        return got

    def tokenize(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain.fullmatch(text):
            ids = [t.id for t in self.model.tokenize(text if word.isascii() else spelled(word))]
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return b"".join(map(ID.pack, ids))


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.cache = WordCache(path)

    def __call__(self, text: bytes) -> bytes:
        # the vocabulary knows lower case only; but a special token's name is one only as written
        words = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.cache.__getitem__, words))


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker; its file is read once."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
