"""SentencePiece encoding and decoding with exact n-best segmentations.

The pieces of a text form a lattice; a segmentation's score is the sum of its
pieces' scores. A blank is written as U+2581, with one put before the text. No
piece has a blank inside and characters outside the vocabulary are in no piece,
so the lattice falls into short parts between blanks, and the scores of parts
add up. For each distinct part a forward pass gives the best score up to every
place; a backward A* search with these as exact heuristics then yields its
segmentations in order. A text's n best differ from its best only in the
``n - 1`` parts that lose least by their second best, which forward and backward
passes give for all parts at once.

Characters without a piece of their own become the byte pieces of their UTF-8
form, U+2581 in a text among them, so decoding restores every text exactly.

Equal scores are settled by the shorter last piece, from the end backwards.
Nothing is cut: texts and parts of any length are encoded whole, in memory and
work that grow with the length. Tokenizers are
read, never trained; the vocabulary's path is a parameter and its arrays, whose
size the file bounds, go to the executors.

Defined results: NULL text gives NULL pieces, the empty text none, both without
alternatives; a text with fewer than ``n`` segmentations gives those it has;
repeated rows get equal answers; other columns are ignored or kept unchanged; an
empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.llm.common import whole_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Score of a character without a piece, below the least score of the vocabulary.
UNKNOWN = 10.0
#: Parts up to this length are handled together; distinct parts remembered; characters between two looks for new ones.
TOGETHER, REMEMBERED, BLOCK = 32, 300_000, 1_000_000

_NONE, _BYTES = -1, -2


class Pieces:
    """A vocabulary as arrays: a trie for the lattice, scores, and texts for decoding."""

    def __init__(self, texts: list[str], scores: list[float], kinds: list[str]):
        """``kinds``: ``normal``, ``byte`` or ``control`` for each piece; the byte pieces, if any, are all there."""
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts, kinds)) if k == "byte"}
        self.texts = [t if k == "normal" else "" for t, k in zip(texts, kinds)]
        normal = [(t, i) for i, (t, k) in enumerate(zip(texts, kinds)) if k == "normal"]
        self.shown = [t.replace(SPACE, " ") for t in self.texts]
        self.byte_value = np.full(len(texts), -1)
        for b, i in self.bytes.items():
            self.byte_value[i] = b
        least = min(scores[i] for _, i in normal)
        #: indexed by piece, then -2 (bytes of a character) and -1 (no piece)
        self.score = np.array([*scores, least - UNKNOWN, -np.inf])
        letters = sorted({ord(c) for t, _ in normal for c in t})
        self.letter = np.zeros(0x110000, dtype=np.int64)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.longest = max(len(t) for t, _ in normal)
        if any(SPACE in t.lstrip(SPACE) for t, _ in normal):
            raise ValueError("a piece has a blank inside")
        self.ids = {t: i for t, i in normal}
        if SPACE not in self.ids:
            raise ValueError("the blank has no piece")
        nodes, ids, edges = {"": 0}, [_NONE], []
        for t, i in sorted(normal):
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(ids)
                    ids.append(_NONE)
                    edges.append((nodes[t[: k - 1]] * self.width + int(self.letter[ord(t[k - 1])]), len(ids) - 1))
            ids[nodes[t]] = i
        self.node_id = np.array(ids)
        self.shift = np.uint64(64 - max(4, (4 * len(edges)).bit_length()))
        self.slot_key = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.slot_child = np.zeros(len(self.slot_key), dtype=np.int64)
        keys = np.array([k for k, _ in edges], dtype=np.int64)
        for key, child, at in zip(keys.tolist(), (c for _, c in edges), self._slots(keys).tolist()):
            while self.slot_key[at] >= 0:
                at = (at + 1) % len(self.slot_key)
            self.slot_key[at], self.slot_child[at] = key, child
        apart = "" if self.letter[10] else "\n"  # a line feed mostly has no piece and cuts parts short
        self.part = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|{apart}" if apart else ""))

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
        return cls([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], [kind(i) for i in n])

    def parts(self, text: str) -> list[str | None]:
        """The lattice's independent parts, in order; None stands for a U+2581 of the text itself."""
        if not text:
            return []
        first, *rest = text.split(SPACE)
        out = self.part.findall(SPACE + first.replace(" ", SPACE))
        for more in rest:
            out.append(None)
            out += self.part.findall(more.replace(" ", SPACE))
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """The trie's children under ``node * width + letter``; 0 for none."""
        at = self._slots(keys)
        have = self.slot_key[at]
        out = np.where(have == keys, self.slot_child[at], 0)
        todo = np.flatnonzero((have != keys) & (have >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slot_key)
            have = self.slot_key[at[todo]]
            hit = have == keys[todo]
            out[todo[hit]] = self.slot_child[at[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out

    def coded(self, ids: list[int], text: str) -> list[int]:
        """``ids`` of a segmentation with the byte pieces of each character that has none."""
        out, at = [], 0
        for i in ids:
            if i == _BYTES:
                out += [self.bytes[b] for b in text[at].encode("utf-8", "surrogatepass")] if self.bytes else [0]
                at += 1
            else:
                out.append(i)
                at += len(self.texts[i])
        return out

    def lattice(self, part: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """Per place the pieces that end there ``(start, score, id)``, shorter first, and the best score up to it."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(part) + 1)]
        best = [0.0] + [-np.inf] * len(part)
        for end in range(1, len(part) + 1):
            for n in range(1, min(self.longest, end) + 1):
                i = self.ids.get(part[end - n : end], _BYTES if n == 1 else _NONE)
                if i != _NONE:
                    s = float(self.score[i])
                    ends[end].append((end - n, s, i))
                    best[end] = max(best[end], best[end - n] + s)
        return ends, best

    def graph(self, part: str) -> Lattice:
        """The same as arrays, for parts of any length."""
        size = len(part)
        letters = self.letter[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        found = np.full((size, min(self.longest, size)), _NONE, dtype=np.int32)
        at, node = np.arange(size), np.zeros(size, dtype=np.int64)
        for n in range(found.shape[1]):
            keep = at < size - n
            at, node = at[keep], node[keep]
            letter = letters[at + n]
            child = np.where(letter > 0, self._children(node * self.width + letter), 0)
            at, node = at[child > 0], child[child > 0]
            found[at, n] = self.node_id[node]
        found[:, 0][found[:, 0] == _NONE] = _BYTES
        start, n = np.nonzero(found != _NONE)
        order = np.lexsort((n, start + n))
        start, n = start[order], n[order]
        ids = found[start, n]
        return Lattice(size, start, start + n + 1, self.score[ids], ids)

    def n_best(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of one part, best first, by backward A*."""
        if len(part) > TOGETHER:
            return self.graph(part).sidetracks(n)
        ends, best = self.lattice(part)
        out = []
        # ties: the path whose last pieces are shorter comes first
        queue = [(-best[-1], (), len(part), 0.0, ())]
        while queue and len(out) < n:
            _, turns, at, score, ids = heapq.heappop(queue)
            if at == 0:
                out.append((score, list(ids)))
                continue
            for start, s, i in ends[at]:
                heapq.heappush(queue, (-(best[start] + score + s), (*turns, at - start), start, score + s, (i, *ids)))
        return out


class Lattice:
    """Edges (pieces) in ascending order of their end and length, with forward scores and the best last piece of every place."""

    def __init__(self, size: int, start: np.ndarray, end: np.ndarray, score: np.ndarray, ids: np.ndarray):
        self.size, self.start, self.end, self.score, self.ids = size, start, end, score, ids
        self.first = np.searchsorted(end, np.arange(size + 2))
        best, back = np.full(size + 1, -np.inf), np.zeros(size + 1, dtype=np.int64)
        best[0] = 0.0
        # views, so that a step reads and writes plain numbers and no list of objects is kept
        starts, scores, firsts, bests, backs = map(memoryview, (start, score, self.first, best, back))
        for place in range(1, size + 1):
            top, which = -math.inf, -1
            for e in range(firsts[place], firsts[place + 1]):
                value = bests[starts[e]] + scores[e]
                if value > top:
                    top, which = value, e
            bests[place], backs[place] = top, which
        self.best, self.back = best, back

    def onward(self, place: int) -> list[int]:
        """The edges of the best way from ``place`` back to the beginning."""
        out, starts, backs = [], memoryview(self.start), memoryview(self.back)
        while place:
            out.append(backs[place])
            place = starts[backs[place]]
        return out

    def loss(self, path: list[int]) -> float:
        """What the best segmentation that is not ``path`` (the best one) loses against it."""
        after = np.full(self.size + 1, -np.inf)
        after[self.size] = 0.0
        starts, ends, scores, afters = map(memoryview, (self.start, self.end, self.score, after))
        for e in range(len(starts) - 1, -1, -1):
            value = scores[e] + afters[ends[e]]
            if value > afters[starts[e]]:
                afters[starts[e]] = value
        through = self.best[self.start] + self.score + after[self.end]
        through[path] = -np.inf
        return float(self.best[-1] - through.max())

    def sidetracks(self, n: int) -> list[tuple[float, list[int]]]:
        """The same A* for parts of any length.

        Forward scores are exact, so from any place the search follows the best way
        on without looking left or right; a queue entry is a whole way, and its
        successors leave it once, at a later step. Of these only as many as are still
        wanted can come up. Memory is ``n`` ways, work a pass over the lattice for each.
        """
        out: list[tuple[float, list[int]]] = []
        queue = [(-float(self.best[-1]), self.onward(self.size), 0)]
        while queue and len(out) < n:
            least = min(q[0] for q in queue)
            lead = min((q for q in queue if q[0] == least), key=cmp_to_key(self._sooner))
            queue.remove(lead)
            _, path, free = lead
            edges = np.array(path)
            reached = np.cumsum(self.score[edges])
            out.append((float(reached[-1]), self.ids[edges[::-1]].tolist()))
            wanted = n - len(out)
            # every other edge into the places passed from step ``free`` on
            steps = np.arange(free, len(edges))
            into = self.end[edges[free:]]
            counts = self.first[into + 1] - self.first[into]
            step = np.repeat(steps, counts)
            edge = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[into], counts)
            other = edge != edges[step]
            step, edge = step[other], edge[other]
            before = np.concatenate([[0.0], reached])[step]
            value = self.best[self.start[edge]] + (before + self.score[edge])
            if not len(value) or not wanted:
                continue
            if len(value) > wanted:
                few = np.flatnonzero(value >= np.partition(value, -wanted)[-wanted])
                step, edge, value = step[few], edge[few], value[few]
            # ties among ways that leave this one: shorter pieces first, the last piece counting most
            shorter = self.start[edge] > self.start[edges[step]]
            order = np.lexsort((-self.start[edge], np.where(shorter, step, -step), ~shorter, -value))[:wanted]
            for i in order.tolist():
                way = [*path[: step[i]], int(edge[i])]
                queue.append((-float(value[i]), way + self.onward(int(self.start[edge[i]])), int(step[i]) + 1))
        return out

    def _sooner(self, one: tuple, other: tuple) -> int:
        """Order of ways of equal score: the first different piece, from the end, decides."""
        a, b = (self.end[q[1]] - self.start[q[1]] for q in (one, other))
        k = min(len(a), len(b))
        at = np.flatnonzero(a[:k] != b[:k])
        return int(a[at[0]] - b[at[0]]) if len(at) else len(a) - len(b)


class Encoder:
    """Parts that have been seen, with their best pieces, scores and the loss of their second best."""

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n = pieces, n
        self.clear()

    def clear(self) -> None:
        own = self.pieces.coded([_BYTES], SPACE)
        self.known: dict[str | None, int] = {None: 0}
        self.names: list[str | None] = [None]
        self.flat, self.begin, self.count = np.array(own, np.int32), np.array([0]), np.array([len(own)])
        self.score, self.loss = np.array([float(self.pieces.score[_BYTES])]), np.array([np.inf])
        self.alternatives: dict[int, list[tuple[float, list[int]]]] = {}

    def forget(self, wanted: set[str | None]) -> None:
        """Drop all parts but the ``wanted`` ones, which get new numbers."""
        keep = [i for i, p in enumerate(self.names) if p is None or p in wanted]
        at = np.array(keep)
        self.names = [self.names[i] for i in keep]
        self.known = {p: k for k, p in enumerate(self.names)}
        self.alternatives = {k: self.alternatives[i] for k, i in enumerate(keep) if i in self.alternatives}
        self.score, self.loss, count = self.score[at], self.loss[at], self.count[at]
        begin = np.cumsum(count) - count
        self.flat = self.flat[np.arange(count.sum()) + np.repeat(self.begin[at] - begin, count)]
        self.begin, self.count = begin, count

    def learn(self, new: set[str | None], wanted: list[str | None]) -> bool:
        """Take in the ``new`` parts; if that is too much to remember, all but ``wanted`` are forgotten. Whether numbers changed."""
        again = len(self.known) + len(new) > REMEMBERED
        if again:
            self.forget(set(wanted))
        by_length: dict[int, list[str]] = {}
        alone: list[str] = []
        for p in new:
            if len(p) <= TOGETHER and "\0" not in p:
                by_length.setdefault(len(p), []).append(p)
            else:
                alone.append(p)
        ids, counts, scores, losses, names = [], [], [], [], []
        for length, group in by_length.items():
            for at in range(0, len(group), 2_000):
                few = group[at : at + 2_000]
                got = self._together(few, length)
                ids.append(got[0])
                counts.append(got[1])
                scores.append(got[2])
                losses.append(got[3])
                names += few
        for p in alone:
            best, loss, path = self._single(p)
            ids.append(np.array(path, np.int32))
            counts.append(np.array([len(path)]))
            scores.append(np.array([best]))
            losses.append(np.array([loss]))
            names.append(p)
        for i, p in enumerate(names, len(self.names)):
            self.known[p] = i
        self.names += names
        counts = np.concatenate(counts).astype(np.int64)
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, counts])
        self.score, self.loss = np.concatenate([self.score, *scores]), np.concatenate([self.loss, *losses])
        return again

    def _single(self, part: str) -> tuple[float, float, list[int]]:
        """One part of any length: best score, loss of the second best, best pieces."""
        lattice = self.pieces.graph(part)
        path = lattice.onward(lattice.size)
        return float(lattice.best[-1]), lattice.loss(path), self.pieces.coded(lattice.ids[path[::-1]].tolist(), part)

    def _together(self, parts: list[str], size: int):
        """Parts of one length: pieces end to end, their counts, best scores and losses."""
        p = self.pieces
        rows = len(parts)
        # places run down and parts across, so that each step of a pass works on adjacent numbers
        letters = p.letter[np.array(parts, dtype=f"<U{size}").view(np.uint32).reshape(rows, size).T]
        longest = min(p.longest, size)
        found = np.full((longest, size, rows), _NONE, dtype=np.int32)
        at, row = (x.ravel() for x in np.indices((size, rows), dtype=np.int32))
        node = np.zeros(len(at), dtype=np.int64)
        for n in range(longest):
            keep = at < size - n
            at, row, node = at[keep], row[keep], node[keep]
            letter = letters[at + n, row]
            child = np.where(letter > 0, p._children(node * p.width + letter), 0)
            live = child > 0
            at, row, node = at[live], row[live], child[live]
            found[n, at, row] = p.node_id[node]
        found[0][found[0] == _NONE] = _BYTES
        value = p.score[found]
        best = np.full((size + 1, rows), -np.inf)
        back = np.zeros((size + 1, rows), dtype=np.int64)
        best[0] = 0
        for end in range(1, size + 1):
            for n in range(1, min(longest, end) + 1):
                here = best[end - n] + value[n - 1, end - n]
                better = here > best[end]
                np.copyto(best[end], here, where=better)
                np.copyto(back[end], n, where=better)
        after = np.full((size + 1, rows), -np.inf)
        after[size] = 0
        for start in range(size - 1, -1, -1):
            for n in range(1, min(longest, size - start) + 1):
                np.maximum(after[start], value[n - 1, start] + after[start + n], out=after[start])
        path = np.full((size, rows), _NONE, dtype=np.int32)
        place, step = np.full(rows, size), 0
        live = np.arange(rows)
        through = value
        for n in range(1, longest + 1):
            through[n - 1, : size - n + 1] += best[: size - n + 1]
            through[n - 1, : size - n + 1] += after[n:]
        while len(live):
            n = back[place[live], live]
            start = place[live] - n
            path[size - 1 - step, live] = found[n - 1, start, live]
            through[n - 1, start, live] = -np.inf
            place[live] = start
            live, step = live[start > 0], step + 1
        path = np.ascontiguousarray(path.T)
        other = through.max(axis=(0, 1))
        odd = np.flatnonzero((path == _BYTES).any(axis=1))
        counts = (path != _NONE).sum(axis=1)
        flat = path[path != _NONE]
        if len(odd):
            pieces = np.split(flat, np.cumsum(counts)[:-1])
            for i in odd.tolist():
                pieces[i] = np.array(p.coded(pieces[i].tolist(), parts[i]), np.int32)
                counts[i] = len(pieces[i])
            flat = np.concatenate(pieces)
        return flat, counts, best[size], best[size] - other

    def look_up(self, parts: list[str | None]) -> np.ndarray:
        """The number of each part; unknown ones are learned first."""
        which = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = {parts[i] for i in np.flatnonzero(which < 0).tolist()}
        if new and self.learn(new, parts):
            return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        for i in np.flatnonzero(which < 0).tolist():
            which[i] = self.known[parts[i]]
        return which

    def encode(self, texts: list[list[str | None]]) -> tuple[np.ndarray, np.ndarray, list[float], list[list[dict]]]:
        """Parts of many texts to the best pieces, end to end, their number and score in each text, and the next best segmentations."""
        which = self.look_up([p for parts in texts for p in parts])
        sizes = np.array([len(parts) for parts in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        counts = self.count[which]
        offsets = np.cumsum(counts) - counts
        ids = self.flat[np.arange(counts.sum()) + np.repeat(self.begin[which] - offsets, counts)]
        owner = np.repeat(np.arange(len(texts)), sizes)
        lengths = np.bincount(owner, counts, len(texts)).astype(np.int64)
        scores = np.bincount(owner, self.score[which], len(texts)).tolist()
        others: list[list[dict]] = []
        loss = self.loss[which]
        for i, (start, end) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            if self.n < 2 or start == end:
                others.append([])
            else:
                first = offsets[start]
                others.append(self._others(which[start:end], loss[start:end], offsets[start:end] - first, counts[start:end], scores[i]))
        return ids, lengths, scores, others

    def _others(self, which: np.ndarray, loss: np.ndarray, offsets: np.ndarray, counts: np.ndarray, score: float) -> list[dict]:
        """The next best segmentations of one text as edits of its best."""
        few = min(self.n - 1, len(loss))
        near = np.flatnonzero(loss <= np.partition(loss, few - 1)[few - 1])
        near = near[np.argsort(loss[near], kind="stable")[:few]]
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for k in near.tolist():
            if np.isinf(loss[k]):
                continue
            ways = heapq.nsmallest(
                self.n,
                ((lost + less, (*edits, (k, j)) if j else edits) for lost, edits in ways for j, less in enumerate(self._ways(int(which[k])))),
            )
        out = []
        for lost, edits in ways[1:]:
            changes = []
            for k, j in sorted(edits):
                put = self.alternatives[int(which[k])][j][1]
                changes.append({"at": int(offsets[k]), "drop": int(counts[k]), "put": put})
            out.append({"score": score - lost, "edits": changes})
        return out

    def _ways(self, which: int) -> list[float]:
        """What each of the best segmentations of a part loses against the first."""
        if which not in self.alternatives:
            part = self.names[which]
            found = self.pieces.n_best(part, self.n)
            self.alternatives[which] = [(s, self.pieces.coded(ids, part)) for s, ids in found]
        ways = self.alternatives[which]
        return [ways[0][0] - s for s, _ in ways]


def decode_ids(pieces: Pieces, ids) -> str:
    """The text of a sequence of pieces."""
    ids = np.asarray(ids, dtype=np.int64)
    if not len(ids):
        return ""
    values = pieces.byte_value[ids]
    ends = np.flatnonzero(np.diff(values >= 0)) + 1
    out = []
    for start, end in zip([0, *ends.tolist()], [*ends.tolist(), len(ids)]):
        if values[start] >= 0:
            out.append(values[start:end].astype(np.uint8).tobytes().decode("utf-8", "replace"))
        else:
            out.append("".join(map(pieces.shown.__getitem__, ids[start:end].tolist())))
    return "".join(out)[1:]


_EDIT = "array<struct<score:double,edits:array<struct<at:int,`drop`:int,put:array<int>>>>>"
_ALTERNATIVES = pa.list_(
    pa.struct(
        [
            ("score", pa.float64()),
            ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))]))),
        ]
    )
)


def _encode(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, n)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < BLOCK:
                    texts.append(batch.column("text")[at + len(texts)].as_py())
                    size += len(texts[-1] or "")
                yield _encoded(encoder, batch.slice(at, len(texts)), texts)
                at += len(texts)

    return run


def _encoded(encoder: Encoder, rows: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    ids, lengths, scores, others = encoder.encode([encoder.pieces.parts(t or "") for t in texts])
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    ids = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts]))
    scores = pa.array([None if t is None else s for t, s in zip(texts, scores)], pa.float64())
    others = pa.array(others, _ALTERNATIVES)
    keep = [c for c in rows.schema.names if c not in ("ids", "score", "alternatives")]
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), ids, scores, others], [*keep, "ids", "score", "alternatives"])


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # row by row: the pieces of a whole batch as Python numbers would take many times its size
            rows = (x.values.to_numpy() if x.is_valid else None for x in batch.column("ids"))
            texts = [None if ids is None else decode_ids(shared.value, ids) for ids in rows]
            keep = [c for c in batch.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def encode(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Per row: ``doc_id, text, ids, score, alternatives``.

    ``alternatives`` holds the second to the n-th best segmentation: its score
    and, from left to right, the edits that make it of ``ids``: at piece ``at``
    take ``drop`` pieces out and put ``put`` in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return whole_texts(rows).mapInArrow(_encode(shared, n), f"doc_id long, text string, ids array<int>, score double, alternatives {_EDIT}")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with the text of their ``ids`` as ``decoded``."""
    from pyspark.sql.types import StringType, StructField, StructType

    shared = rows.sparkSession.sparkContext.broadcast(Pieces.load(model))
    fields = [f for f in rows.schema.fields if f.name != "decoded"]
    return whole_texts(rows).mapInArrow(_decode(shared), StructType([*fields, StructField("decoded", StringType())]))


def _round_trip(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decode(shared)(_encode(shared, n)(batches)):
            exact = [a.as_py() == b.as_py() for a, b in zip(batch.column("text"), batch.column("decoded"))]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(exact, pa.bool_())], [*keep, "exact"])

    return run


def round_trip(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Encode, decode and compare in one pass: ``doc_id, decoded, n_pieces, ids, score, alternatives, exact``."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id long, ids array<int>, score double, alternatives {_EDIT}, decoded string, exact boolean"
    count = F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_pieces")
    return whole_texts(rows).mapInArrow(_round_trip(shared, n), schema).select("doc_id", "decoded", count, "ids", "score", "alternatives", "exact")
