"""Sub-word tokens of texts: greedy longest pieces and byte-pair merges over a given vocabulary.

Vocabularies are read, never trained, and their path is a parameter. A tokenizer
cuts a text into words, a word into tokens, and remembers short words it met. What it
remembers is bounded in bytes, and a count over a column takes one text after the
other from its Arrow batches: a task's memory is that of a batch, however many
texts or distinct words it reads.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distinct words in each of a tokenizer's two memories; when the younger is full, it becomes the older one.
REMEMBERED = 250_000

#: Characters of a word that is remembered; a longer one is cut whenever it is met. At most 255, so that an end is one byte.
REMEMBERED_CHARS = 64


class Subwords:
    """A tokenizer; a kind of it says what the words of a text are and how long the tokens of a word are."""

    def __init__(self):
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def spans(self, text: str) -> Iterable[tuple[int, int]]:
        """Begin and end of each word."""
        raise NotImplementedError

    def cut(self, word: str) -> list[int]:
        """The token ends of a word, in characters; a character that ends no token of its own counts with the next one."""
        raise NotImplementedError

    def ends(self, word: str) -> Sequence[int]:
        known = self._known.get(word)
        if known is None:
            if len(word) > REMEMBERED_CHARS:
                return self.cut(word)
            known = self._older.get(word)
            if known is None:
                known = bytes(self.cut(word))
            if len(self._known) >= REMEMBERED:
                self._older, self._known = self._known, {}
            self._known[word] = known
        return known

    def counts(self, texts: Iterable[str | None]) -> list[int | None]:
        """Tokens of each text; None for None."""
        out: list[int | None] = []
        for text in texts:
            total = 0
            for a, b in self.spans(text) if text else ():
                total += len(self.ends(text[a:b]))
            out.append(None if text is None else total)
        return out

    def head(self, text: str, limit: int) -> str:
        """The beginning of a text that holds its first ``limit`` tokens; never half a character."""
        left, end = limit, 0
        for begin, stop in self.spans(text):
            ends = self.ends(text[begin:stop])
            if len(ends) > left:
                return text[: begin + ends[left - 1]] if left else text[:end]
            left, end = left - len(ends), stop
        return text


class WordPieces(Subwords):
    """Greedy longest match: lower-case words and single marks; pieces inside a word begin with ``##``.

    A word with a place where no piece matches, or of more than ``longest``
    characters, is one unknown token.
    """

    _WORD = re.compile(r"[^\W_]+|[^\w\s]|_")

    def __init__(self, pieces: Iterable[str], longest: int = 100):
        super().__init__()
        self.longest = longest
        # two tries, of nested dictionaries; the empty key marks the end of a piece
        self.begin, self.inside = {}, {}
        for piece in pieces:
            node = self.inside if piece.startswith("##") and len(piece) > 2 else self.begin
            for c in piece[2:] if node is self.inside else piece:
                node = node.setdefault(c, {})
            node[""] = True

    @classmethod
    def load(cls, path: str, **options) -> WordPieces:
        """One piece per line."""
        with open(path, encoding="utf-8") as lines:
            return cls((line.rstrip("\n") for line in lines), **options)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self._WORD.finditer(text))

    def cut(self, word: str) -> list[int]:
        low, ends = word.lower(), []
        if len(low) > self.longest or len(low) != len(word):
            return [len(word)]
        at = 0
        while at < len(low):
            node, best = self.begin if at == 0 else self.inside, at
            for i in range(at, len(low)):
                node = node.get(low[i])
                if node is None:
                    break
                if "" in node:
                    best = i + 1
            if best == at:
                return [len(word)]
            ends.append(best)
            at = best
        return ends


class BytePairs(Subwords):
    """Byte-level pair merges, the pair of lowest rank first, the leftmost of equal ones."""

    #: Fixed value: how the published vocabularies cut a text into words.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        super().__init__()
        self.ranks, self._word = ranks, regex.compile(pattern)

    @classmethod
    def load(cls, path: str, **options) -> BytePairs:
        """Lines of a token in base64 and its rank."""
        with open(path, "rb") as lines:
            rows = (line.split() for line in lines)
            return cls({base64.b64decode(row[0]): int(row[1]) for row in rows if row}, **options)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self._word.finditer(text))

    def merged(self, data: bytes) -> list[int]:
        """The byte ends of a word's tokens; work grows with ``n log n``, so words of any length are merged whole."""
        n, ranks = len(data), self.ranks
        if data in ranks or n < 2:
            return [n] if n else []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = list(range(1, n + 1))
        queue = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            _, at, end = heapq.heappop(queue)
            right = after[at]
            if not alive[at] or right >= n or ends[right] != end or ends[at] != right:
                continue
            alive[right], ends[at], after[at] = False, end, after[right]
            if after[at] < n:
                before[after[at]] = at
                rank = ranks.get(data[at : ends[after[at]]])
                if rank is not None:
                    heapq.heappush(queue, (rank, at, ends[after[at]]))
            if before[at] >= 0:
                rank = ranks.get(data[before[at] : end])
                if rank is not None:
                    heapq.heappush(queue, (rank, before[at], end))
        return [ends[i] for i in range(n) if alive[i]]

    def cut(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        ends = self.merged(data)
        if len(data) == len(word):
            return ends
        # characters that are complete at each byte
        whole = np.cumsum([b & 0xC0 != 0x80 for b in data])
        return [int(whole[e - 1]) if e == len(data) or data[e] & 0xC0 != 0x80 else int(whole[e - 1]) - 1 for e in ends]


def token_count_subword(c: Column, tokenizer: Callable[[], Subwords]) -> Column:
    """Sub-word tokens of a text column as a long; NULL for NULL, 0 for the empty text.

    ``tokenizer`` builds the tokenizer, once per task.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        built = tokenizer()
        for texts in batches:
            yield pa.array(built.counts(text.as_py() for text in texts), pa.int64())

    return count(c)
