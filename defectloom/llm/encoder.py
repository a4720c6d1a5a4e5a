"""Encoding of many texts at once: chunks are found on the bytes, each distinct one is encoded once.

How a word becomes ids is left to the method: the trie of ``bpe`` or the library in ``token_files``.
"""

import re

import numpy as np

from defectloom.llm.pretoken import Memo, Splitter
from defectloom.llm.wordstream import Slice

WORDS = 200_000
# Places for chunks, and about so many ids of all of them: some 90 MB a worker when full.
PLACES, IDS = 1 << 21, 8 << 20
# Texts of more bytes are encoded part by part.
LONG_BYTES = 4 << 20
_BLANK = re.compile(b"[ \n]").search

_encoders: dict[tuple[type, str], "ChunkEncoder"] = {}


class ChunkTable:
    """Ids of chunks by their two hashes of 64 bits, asked for many chunks at once.

    A chunk's place follows from its hash, and a new chunk takes the place over; all ids lie in one
    array. Once that is full, everything is forgotten before the next texts.
    """

    def __init__(self, places: int = PLACES, limit: int = IDS):
        self.places, self.limit = places, limit
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.checks = np.zeros(self.places, np.uint64), np.zeros(self.places, np.uint64)
        # Where the ids begin, counted from 1; 0 where no chunk is.
        self.begins, self.sizes = np.zeros(self.places, np.int64), np.zeros(self.places, np.int32)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def trim(self) -> None:
        """Forget all if the ids are more than wanted; what was found before is no longer valid."""
        if self.used > self.limit:
            self._clear()

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's ids begin, or -1, and how many there are."""
        place = (hashes % np.uint64(self.places)).astype(np.int64)
        begins = self.begins[place]
        begins[(self.hashes[place] != hashes) | (self.checks[place] != checks)] = 0
        return begins - 1, self.sizes[place].astype(np.int64)

    def add(self, hashes: np.ndarray, checks: np.ndarray, made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Take in distinct chunks; as ``find``."""
        new = np.frombuffer(b"".join(made), "<u4")
        sizes = np.fromiter((len(ids) >> 2 for ids in made), np.int64, len(made))
        begins = self.used + np.cumsum(sizes) - sizes
        if self.used + len(new) > len(self.ids):
            grown = np.empty(max(2 * len(self.ids), self.used + len(new)), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        # Of new chunks with one place the last has it.
        place = (hashes % np.uint64(self.places)).astype(np.int64)
        last = np.zeros(len(place), bool)
        last[len(place) - 1 - np.unique(place[::-1], return_index=True)[1]] = True
        place = place[last]
        self.hashes[place], self.checks[place] = hashes[last], checks[last]
        self.begins[place], self.sizes[place] = begins[last] + 1, sizes[last]
        return begins, sizes


class ChunkEncoder:
    """Remembers chunks and words up to a bound; a method gives ``words`` and ``whole``."""

    def __init__(self, spec: str):
        self.splitter = Splitter(spec)
        self.by_word, self.by_chunk = Memo(WORDS), ChunkTable()

    @classmethod
    def of(cls, spec: str) -> "ChunkEncoder":
        """One for each worker process, method and file."""
        if (cls, spec) not in _encoders:
            _encoders.clear()
            _encoders[cls, spec] = cls(spec)
        return _encoders[cls, spec]

    def words(self, new) -> dict[str, bytes]:
        """Ids, as unsigned 32-bit integers, of distinct words in byte letters."""
        raise NotImplementedError

    def whole(self, chunk: str) -> bytes:
        """Ids of a chunk that needs the library's own steps."""
        raise NotImplementedError

    def _chunks(self, new: list[bytes]) -> dict[bytes, bytes]:
        # A chunk of plain letters is one word.
        plain = [chunk for chunk in new if chunk.isalpha() and chunk.islower()]
        ids = self.words([chunk.decode("ascii") for chunk in plain])
        out = {chunk: ids[chunk.decode("ascii")] for chunk in plain}
        texts = {chunk: chunk.decode("utf-8") for chunk in new if chunk not in out}
        parts = {chunk: self.splitter.words(text) for chunk, text in texts.items()}
        of = self.by_word.of({w for own in parts.values() if own for w in own}, self.words)
        for chunk, own in parts.items():
            out[chunk] = self.whole(texts[chunk]) if own is None else b"".join(map(of.__getitem__, own))
        return out

    def encode(self, texts) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers.

        Chunks between blanks, line breaks and plain punctuation are found and hashed on the bytes of
        all texts at once; Python sees only chunks that are not known yet, each once.
        """
        held = [(text or "").encode("utf-8") for text in texts]
        if sum(map(len, held)) > LONG_BYTES:
            return [b"".join(self._joined([part])[0] for part in _parts(data)) for data in held]
        return self._joined(held)

    def _joined(self, held: list[bytes]) -> list[bytes]:
        ends = np.cumsum([len(data) + 1 for data in held])
        data = b"\n".join(held)
        if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
            # No special token and no combining mark: capitals count as small letters.
            data = data.lower()
        part = Slice(data, np.zeros(1, np.int64), np.zeros(1, np.int64), len(data), _punctuation_cuts(data))
        if not len(part.starts):
            return [b""] * len(held)
        self.by_chunk.trim()
        hashes, checks = part.words(0), part.words(1)
        begins, sizes = self.by_chunk.find(hashes, checks)
        missing = np.flatnonzero(begins < 0)
        if len(missing):
            first, number = _numbered(hashes[missing], checks[missing])
            first = missing[first]
            chunks = [data[a:b] for a, b in zip(part.starts[first].tolist(), part.ends[first].tolist())]
            made = self._chunks(chunks)
            added = self.by_chunk.add(hashes[first], checks[first], [made[chunk] for chunk in chunks])
            begins[missing], sizes[missing] = (of[number] for of in added)
        after = np.cumsum(sizes)
        places = np.repeat(begins - after + sizes, sizes) + np.arange(int(after[-1]))
        ids = self.by_chunk.ids[places]
        # How many ids lie before each text's end.
        cuts = np.concatenate([[0], after])[np.searchsorted(part.starts, ends)]
        return [ids[a:b].tobytes() for a, b in zip([0, *cuts.tolist()], cuts.tolist())]


def _parts(data: bytes):
    """A text cut at blanks or line breaks into parts of bounded size, but for longer words."""
    start = 0
    while len(data) - start > LONG_BYTES:
        cut = _BLANK(data, start + LONG_BYTES)
        if cut is None:
            break
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:]


# Letters and digits; punctuation that is no part of a contraction or a special token.
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(0x21, 0x7F)]] = 2
_KIND[[ord(c) for c in "'<|>"]] = 0
_KIND[[c for c in range(0x80) if chr(c).isalnum()]] = 1


def _punctuation_cuts(data: bytes) -> np.ndarray:
    """Places between punctuation and a letter or digit of ASCII or Latin-1: words end there for
    the tokenizer, so the parts have the ids of the whole."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 2:
        return np.zeros(0, np.int64)
    kind = _KIND[b]
    letter = kind == 1
    # The second byte of a Latin-1 letter; the signs for times and division are none.
    latin = np.zeros(len(b), bool)
    latin[1:] = (b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7)
    first = np.zeros(len(b), bool)
    first[:-1] = latin[1:]
    mark = kind == 2
    return np.flatnonzero(((letter | latin)[:-1] & mark[1:]) | (mark[:-1] & (letter | first)[1:])) + 1


def _numbered(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct pair of hashes, and each place's number among them."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    if (c[1:] != c[:-1])[~new[1:]].any():
        # Chunks that share one of the two hashes.
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number
