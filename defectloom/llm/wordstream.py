"""Texts as a stream of word hashes, worked out on whole buffers of bytes.

Words are what stands between blanks and tabs; pieces end at ``.,;:!?`` and line breaks. Texts are
joined and cut into slices of bounded size: a text longer than that goes on in the next slice, which
repeats no start of a phrase. A word's hash sums up random numbers per place and byte (tabulation).
"""

import hashlib
import re

import numpy as np

SLICE = 1 << 20
LONGEST = 5
# A word of more bytes is hashed as a whole.
TABLE_BYTES = 256

# Letters that become small, blanks and ends of pieces.
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9
)
_DELIMITER = re.compile(b"[ \n]").search
_AHEAD = re.compile(rb"(?: *[^ \n]+){0,%d}" % (LONGEST - 1)).match
_TABLES = [
    np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, TABLE_BYTES << 8, np.uint64, endpoint=False)
    for seed in (11, 12)
]
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that lets every bit depend on all others."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


class Slice:
    """The words of some text of one or more groups, with their hashes."""

    def __init__(self, data: bytes, groups: np.ndarray, group_starts: np.ndarray, own: int, cuts=None):
        b = np.frombuffer(data, np.uint8)
        inside = (b != 32) & (b != 10)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.data, self.starts, self.ends = data, edges[0::2], edges[1::2]
        if cuts is not None:
            # Places inside words where they are cut once more.
            self.starts = np.sort(np.concatenate([self.starts, cuts]))
            self.ends = np.sort(np.concatenate([self.ends, cuts]))
        self._bytes, self._inside = b, inside
        # Words that follow each other in one piece.
        breaks = np.cumsum(b == 10, dtype=np.int32)
        at = breaks[self.starts]
        self.joined = at[1:] == at[:-1]
        self.group = groups[np.searchsorted(group_starts, self.starts, "right") - 1]
        # Phrases that start from here on belong to the next slice.
        self.own = int(np.searchsorted(self.starts, own))

    def words(self, lane: int) -> np.ndarray:
        """A hash of each word and its group; each lane has numbers of its own."""
        sizes = self.ends - self.starts
        inside, long = self._inside, np.flatnonzero(sizes > TABLE_BYTES)
        if len(long):
            inside = inside.copy()
            for k in long:
                inside[self.starts[k] : self.ends[k]] = False
        short = sizes[sizes <= TABLE_BYTES]
        out = np.empty(len(sizes), np.uint64)
        if len(short):
            first = np.cumsum(short) - short
            place = np.arange(int(short.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), short)
            values = _TABLES[lane][(place << 8) | self._bytes[inside]]
            out[sizes <= TABLE_BYTES] = np.add.reduceat(values, first) + short.astype(np.uint64) * _MIX[0]
        for k in long:
            word = self.data[self.starts[k] : self.ends[k]]
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([lane])).digest(), "little")
        return mixed(out ^ mixed((self.group.astype(np.uint64) + np.uint64(1)) * _MIX[0]))

    def longer(self, shorter: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words from those of ``n - 1`` words, by first word."""
        runs = max(0, len(words) - n + 1)
        return mixed(shorter[:runs] * _MIX[0] + words[n - 1 : n - 1 + runs])

    def unbroken(self, shorter: np.ndarray, n: int) -> np.ndarray:
        """Which runs of ``n`` words lie inside a piece, of those that ``shorter`` allows."""
        runs = max(0, len(self.starts) - n + 1)
        return shorter[:runs] & self.joined[n - 2 :]

    def text(self, first: int, n: int) -> str:
        """A run of words, joined by single blanks."""
        data = self.data[self.starts[first] : self.ends[first + n - 1]]
        return b" ".join(filter(None, data.split(b" "))).decode("utf-8", "replace")


def _parts(data: bytes, size: int):
    """(bytes, how many of them start phrases of this part) of one text."""
    at = 0
    while len(data) - at > 2 * size:
        cut = _DELIMITER(data, at + size)
        if cut is None:
            break
        yield data[at : _AHEAD(data, cut.start()).end()], cut.start() - at
        at = cut.start()
    yield data[at:], len(data) - at


def slices(texts, groups, size: int = SLICE):
    """The slices of texts (strings or None), each with the number of its group."""
    held, starts, of, total = [], [], [], 0

    def made(own=None):
        joined = b"\n".join(held)
        return Slice(joined, np.array(of, np.int64), np.array(starts, np.int64), len(joined) if own is None else own)

    for text, group in zip(texts, groups):
        if not text:
            continue
        data = text.encode("utf-8", "replace").translate(_FOLD)
        if len(data) > 2 * size:
            for part, own in _parts(data, size):
                yield Slice(part, np.array([group]), np.zeros(1, np.int64), own)
            continue
        held.append(data)
        starts.append(total)
        of.append(group)
        total += len(data) + 1
        if total >= size:
            yield made()
            held, starts, of, total = [], [], [], 0
    if held:
        yield made()
