"""Byte-pair encoding by depth-first traversal of a trie of distinct words, and decoding.

The encoding of a word is fixed by the last token of each of its prefixes: dropping that token
leaves the encoding of a shorter prefix. So the new words of a batch go into a trie, and one
traversal finds the last token of every node from those of its ancestors; what words share is
worked out once. A token fits after another if merging both texts together gives just these two
tokens, which their merge histories along the common edge tell without any merging.

The last letter of a word carries the end mark, so a word's end is an edge of its own: it looks
among the end tokens and goes back to the states of the plain prefix.

Null or empty text: no ids, empty decoded text. Other columns stay; an output column replaces a
column of the same name. Empty table: no rows. Texts and words may be of any length: the cost
grows with the length times the longest token, and the traversal doesn't recurse.
"""

import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from defectloom.llm.encoder import ChunkEncoder
from defectloom.llm.pretoken import groups, read_spec
from defectloom.llm.store import ship

PAIRS = 400_000
TRIE_WORDS = 20_000
NEVER = 1 << 60


class Merges:
    """Vocabulary, merge ranks and the test whether two tokens may stand side by side."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        self.end = model["end_of_word_suffix"] or ""
        if not self.end or any(model[k] for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only byte-pair vocabularies with a word-end mark are known here")
        self.ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.halves, self.born = {}, {}
        for a, b in pairs:
            made = self.ids[a + b]
            if made in self.halves:
                raise ValueError(f"two merges give {a + b!r}")
            self.halves[made] = self.ids[a], self.ids[b]
            self.born[made] = len(self.born)
        mark = len(self.end)
        # Letters of plain tokens, and of tokens that end a word without their mark.
        self.plain = {t: k for t, k in self.ids.items() if not t.endswith(self.end)}
        self.ending = {t[:-mark]: k for t, k in self.ids.items() if t.endswith(self.end) and t != self.end}
        # What a longer token may still grow from: beginnings of plain tokens, and of end tokens
        # before their last letter.
        self._starts = {t[:k] for t in self.plain for k in range(len(t) + 1)}
        self._starts |= {t[:k] for t in self.ending for k in range(len(t))}
        self._moves: dict[str, tuple] = {}
        self._closes: dict[str, list] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._sound: dict[int, bool] = {}
        self._fits: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at the token's left (0) or right (1) edge while it is built up,
        each with the rank of the merge that ends it."""
        known = self._edges.get((token, side))
        if known is None:
            spine = [token]
            while spine[-1] in self.halves:
                spine.append(self.halves[spine[-1]][side])
            spine.reverse()
            ends = [self.born[s] for s in spine[1:]] + [NEVER]
            known = self._edges[token, side] = list(zip(spine, ends))
        return known

    def move(self, grown: str) -> tuple[str, list]:
        """For what was left of a prefix and one more letter: what is left now, and the plain
        tokens that may end there, longest first."""
        known = self._moves.get(grown)
        if known is None:
            left = grown
            while left not in self._starts:
                left = left[1:]
            known = self._moves[grown] = left, self._endings(left, self.plain)
        return known

    def close(self, grown: str) -> list:
        """The end tokens that may end a word there, longest first."""
        known = self._closes.get(grown)
        if known is None:
            if len(self._closes) > PAIRS:
                self._closes.clear()
            known = self._closes[grown] = self._endings(grown, self.ending)
        return known

    def _endings(self, text: str, tokens: dict[str, int]) -> list[tuple[int, int]]:
        some = [(tokens.get(text[k:]), len(text) - k) for k in range(len(text))]
        return [(token, size) for token, size in some if token is not None and self.sound(token)]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the letters of both tokens gives just these two tokens."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        ours, theirs, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while True:
            (a, a_ends), (b, b_ends) = ours[i], theirs[j]
            across = self.rank.get((a, b), NEVER)
            # Of equal merges the leftmost comes first: ours before the one across, that before theirs.
            if across < a_ends and across <= b_ends and across != NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def sound(self, token: int) -> bool:
        """Whether merging the token's letters gives the token."""
        known = self._sound.get(token)
        if known is None:
            if token not in self.halves:
                known = True
            else:
                a, b = self.halves[token]
                # Both halves come about, and nothing merges across before they are whole.
                known = self.sound(a) and self.sound(b) and self._meet(a, b)
            self._sound[token] = known
        return known

    def _meet(self, left: int, right: int) -> bool:
        ours, theirs, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while ours[i][0] != left or theirs[j][0] != right:
            (a, a_ends), (b, b_ends) = ours[i], theirs[j]
            across = self.rank.get((a, b), NEVER)
            if across < a_ends and across <= b_ends and across != NEVER:
                return False
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1
        return True


class TrieEncoder(ChunkEncoder):
    """Ids of texts, those of new words by the trie."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self.merges = Merges(spec)

    def words(self, words) -> dict[str, bytes]:
        """Ids, as unsigned 32-bit integers, of distinct words in byte letters."""
        found, ordered = {}, sorted(words)
        for k in range(0, len(ordered), TRIE_WORDS):
            self._traverse(ordered[k : k + TRIE_WORDS], found)
        return found

    def _traverse(self, words: list[str], found: dict[str, bytes]) -> None:
        root: dict = {}
        for word in words:
            node = root
            for letter in word[:-1]:
                below = node.get(letter)
                if below is None:
                    below = node[letter] = {}
                node = below
            # The edge of the last letter with its end mark: two letters never make a plain edge.
            node.setdefault("", []).append(word)
        move, close, known = self.merges.move, self.merges.close, self.merges._fits.get
        fits = self.merges.fits
        last, length = [0], [0]  # the last token of each prefix on the path, and its length
        stack = [(root, 0, "", "")]
        while stack:
            node, depth, before, letter = stack.pop()
            left = before
            if depth:
                left, tokens = move(before + letter)
                del last[depth:], length[depth:]
                for token, size in tokens:
                    if size == depth:
                        break
                    ok = known(last[depth - size] << 32 | token)
                    if fits(last[depth - size], token) if ok is None else ok:
                        break
                else:
                    raise ValueError("the vocabulary lacks a letter")
                last.append(token)
                length.append(size)
            for letter, below in node.items():
                if letter:
                    stack.append((below, depth + 1, left, letter))
                    continue
                # Words that end below this node, one letter further on.
                for word in below:
                    at = depth + 1
                    for token, size in close(left + word[-1]):
                        if size == at or fits(last[at - size], token):
                            break
                    else:
                        raise ValueError("the vocabulary lacks a letter")
                    ids = [token]
                    at -= size
                    while at:
                        ids.append(last[at])
                        at -= length[at]
                    ids.reverse()
                    found[word] = array("I", ids).tobytes()

    def whole(self, chunk: str) -> bytes:
        own = self.splitter.parts(chunk)
        of = self.by_word.of({w for w in own if isinstance(w, str)}, self.words)
        return b"".join([of[p] if isinstance(p, str) else array("I", [p]).tobytes() for p in own])


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def encode(df: DataFrame, tokenizer: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the ids of each whole text as ``array<int>``."""
    ship(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = TrieEncoder.of(spec.value)
        lists = [id_lists(encoder.encode(group)) for group in groups(texts)]
        return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    # Marked so that a later function of the ids reads the column and doesn't encode again.
    return df.withColumn(into, ids.asNondeterministic()(F.col(text)))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of the ids: the tokens as the vocabulary has them, joined by blanks.

    The tokens are an array constant, as long as the vocabulary, and an id is a place in it.
    """
    given = json.loads(read_spec(tokenizer))
    if given["decoder"] is not None:
        raise ValueError("only vocabularies without a decoder are known here")
    names = {k: t for t, k in given["model"]["vocab"].items()}
    names |= {t["id"]: t["content"] for t in given["added_tokens"]}
    tokens = F.split(F.lit("\n".join(names.get(k, "") for k in range(max(names) + 1))), "\n")
    text = F.array_join(F.transform(F.col(ids), lambda i: F.get(tokens, i)), " ")
    return df.withColumn(into, F.coalesce(text, F.lit("")))
