"""Normalising and cutting text into words, as the word-end tokenizer file prescribes.

Neither step looks across a blank or a line break, so a text can be treated chunk by chunk and
each distinct chunk once. Chunks of plain Latin characters take patterns of this module; any
other chunk goes through the library's own normaliser and pre-tokenizer.
"""

import json
import re

import regex
from tokenizers import Tokenizer

# The word pattern of the tokenizer file, and the same for lower-case ASCII.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
# Printable characters without a canonical decomposition of more than themselves after NFC,
# whose lower case is one character: ASCII, Latin-1 and Latin Extended, without soft hyphen and
# dotted capital I.
PLAIN = "[\x21-\x7e¡-¬®-įı-ɏ]+"
MAX_FILE = 64 << 20
GROUP_CHARS = 1 << 20

_ascii_words = re.compile(ASCII_WORD).findall
_words = regex.compile(WORD).findall
_plain = re.compile(PLAIN).fullmatch


def read_spec(path: str) -> str:
    """The tokenizer file's text, which jobs broadcast: its size is checked here."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_FILE + 1)
    if len(text) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} characters")
    return text


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte value in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others follow, in order, from U+0100.
    """
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


class Splitter:
    """Words of a chunk, in the letters of the byte-level vocabulary."""

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        given = json.loads(spec)
        if WORD not in json.dumps(given["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            raise ValueError("the tokenizer file has another word pattern")
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self._cut_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)").split
        self._find_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)").findall
        self._letters = byte_letters()

    def words(self, chunk: str) -> list[str] | None:
        """The chunk's words, or None where the library's own steps are needed."""
        if chunk.isascii():
            if chunk.isprintable() and "<|" not in chunk:
                return _ascii_words(chunk.lower())
        elif "<|" not in chunk and _plain(chunk):
            return [w if w.isascii() else self.lettered(w) for w in _words(chunk.lower())]
        return None

    def lettered(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self._letters)

    def parts(self, chunk: str) -> list[str | int]:
        """Words and ids of special tokens, by the library's normaliser and pre-tokenizer."""
        found = []
        ids = [self.special[s] for s in self._find_special(chunk)]
        for k, piece in enumerate(self._cut_special(chunk)):
            text = self.library.normalizer.normalize_str(piece)
            found += [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
            found += ids[k : k + 1]
        return found


def groups(texts):
    """The texts of an Arrow column in groups of bounded size; a long text is a group of its own."""
    group, size = [], 0
    for text in texts:
        text = text.as_py()
        group.append(text)
        size += len(text or "")
        if size > GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


class Memo:
    """Results by key, in two halves: when the young half is full, the old one is forgotten.

    What is asked for again moves to the young half, so frequent keys stay.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young, self.old = {}, {}

    def of(self, keys, work) -> dict:
        """A result for each of the distinct ``keys``; ``work`` makes those not known, as a dict."""
        found, new = {}, []
        young, old = self.young, self.old
        for key in keys:
            value = young.get(key)
            if value is None:
                value = old.get(key)
                if value is None:
                    new.append(key)
                    continue
                young[key] = value
            found[key] = value
        if new:
            made = work(new)
            found.update(made)
            young.update(made)
        if len(young) > self.limit // 2:
            self.young, self.old = {}, young if len(young) <= self.limit else {}
        return found
