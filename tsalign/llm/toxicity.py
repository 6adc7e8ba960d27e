"""Toxicity scores: a lexicon learned from labels, matched with misspellings, weighed in context.

1. From a bounded sample of labelled rows (``FIT_ROWS`` of each class) every stem,
   a beginning of a word, is counted by class in whole texts. Near copies, texts
   with the same smallest word hash, count as one text together. The stems with
   the strongest evidence (log odds of a text holding them) form the lexicon.
2. The lexicon's trie is intersected with Levenshtein automata, as one automaton
   whose states are sets of (trie node, edits so far), built as far as texts need
   it. A word that begins with a stem matches it; a word that as a whole is within
   one edit of a stem of five letters or more (two edits from nine on) is a
   misspelling of it. Edits are an inserted, missing, wrong or swapped letter.
   All words of a batch take their steps together.
3. Each stem has one weight as spelled and one per number of edits, from a second
   count over the sample on top of a share of its own counts, so a stem whose
   neighbours are common words finds no misspellings.
4. A match counts by its context: less within quotation marks or after a word of
   reporting, more near a word of address. A text is described by its sum, its
   strongest window of words, its density and its strongest match; logistic
   regression on the sample turns them into a score.

The model (at most ``TERMS`` stems and a few coefficients) is what the driver
sees and sends to the executors. Scoring then is one pass over the rows.

Defined results: NULL and empty texts and texts without a match get the score of
a text without words; ids, languages, sources and labels are no inputs of a
score, so equal texts have equal scores; ids only decide which labelled rows may
be learned from; a row without id is held out (no checksum) and never learned
from; an id with unlike labels is toxic if any label is; a NULL label says
nothing; rows that repeat an id are learned from together; without both classes in
the sample every score is 1 if it holds toxic rows, else 0; other
columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsalign.llm.common import measured, whole_texts
from tsalign.operators.durable import durable

#: One labelled row in this many is held out, by the checksum of its id.
FOLDS = 5
#: Rows of each class that the model is fitted on at most.
FIT_ROWS = 10_000
#: Stems of the lexicon at most, letters of a stem, texts (near copies together) that must hold it, and its least log odds.
TERMS, LETTERS, SUPPORT, LEAST_ODDS = 500, (4, 12), 4.0, math.log(4)
#: Share of a stem's counts that is taken for granted, per edit, before its misspellings are counted.
SPELLING = 0.25
#: Letters from which a stem may be misspelled with one and with two edits.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words of a context window, and letters on each side of a match that its quotation marks are searched in.
WINDOW, REACH = 50, 200
#: Factors of a match within quotation marks, after a word of reporting, and near a word of address.
QUOTED, REPORTED, ADDRESSED = 0.25, 0.5, 1.25

#: Words that report speech or name a word, and words that address someone.
REPORTING = frozenset(
    "said says called wrote quoted word term phrase sagte nannte schrieb wort begriff dit disait appelé écrit mot terme dijo llamó escribió palabra término".split()
)
ADDRESS = frozenset("you your you're yourself du dich dir dein ihr euch tu toi ton vous votre tú te ti tus usted".split())

_OPEN, _CLOSE = "“„«‹", "”“»›"
_BESIDE = "@$*"
_WORD = re.compile(r"[^\W_]+")
#: States after which the automaton is built anew, and letters handled at once.
_STATES, _BLOCK = 200_000, 1_000_000


def held_out(row_id: Column) -> Column:
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(row_id.cast("string")) % FOLDS == 0, F.lit(True))


def edits_allowed(term: str) -> int:
    return (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)


# ---------------------------------------------------------------------------------------------- the automaton


class Automaton:
    """Levenshtein automata of all terms of a trie, as one automaton that is built when its states are met.

    A state is a set of ``(node, edits, letter due, node after it)``; the last two
    are set halfway through a swap of letters.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[int, int]] = [{}]
        self.term: list[int] = [-1]
        self.limit: list[int] = [0]
        letters = sorted({c for t in terms for c in t})
        #: 0 ends a word, 1 is a letter that no term has.
        self.class_of = np.zeros(0x110000, dtype=np.uint16)
        self.class_of[_word_letters()] = 1
        self.class_of[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.classes = len(letters) + 2
        for number, term in enumerate(terms):
            node, allowed = 0, edits_allowed(term)
            self.limit[0] = max(self.limit[0], allowed)
            for c in term:
                at = int(self.class_of[ord(c)])
                if at not in self.children[node]:
                    self.children[node][at] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.limit.append(0)
                node = self.children[node][at]
                self.limit[node] = max(self.limit[node], allowed)
            self.term[node] = number
        self.allowed = [edits_allowed(t) for t in terms]
        self.forget()

    def forget(self) -> None:
        """Drop all states; 0 is dead, 1 the start."""
        self.sets: list[tuple] = [(), self._closed({(0, 0, 0, 0)})]
        self.number = {s: i for i, s in enumerate(self.sets)}
        self.next = np.full((1024, self.classes), -1, dtype=np.int32)
        self.next[0] = 0
        self.outputs: list[tuple[tuple[int, int], ...]] = [(), self._output(self.sets[1])]

    def _closed(self, items: Iterable[tuple]) -> tuple:
        """With letters missing from the text, and without what a better item covers."""
        best: dict[tuple, int] = {}
        stack = list(items)
        while stack:
            node, edits, due, after = stack.pop()
            if edits > self.limit[after or node] or best.get((node, due, after), 99) <= edits:
                continue
            best[node, due, after] = edits
            if not due:
                stack.extend((child, edits + 1, 0, 0) for child in self.children[node].values())
        return tuple(sorted((n, e, d, a) for (n, d, a), e in best.items()))

    def _step(self, items: tuple, letter: int) -> tuple:
        out = []
        for node, edits, due, after in items:
            if due:
                if due == letter:
                    out.append((after, edits, 0, 0))
                continue
            for c, child in self.children[node].items():
                out.append((child, edits + (c != letter), 0, 0))
                if c != letter and letter in self.children[child]:
                    out.append((node, edits + 1, c, self.children[child][letter]))
            out.append((node, edits + 1, 0, 0))
        return self._closed(out)

    def _output(self, items: tuple) -> tuple[tuple[int, int], ...]:
        return tuple((self.term[n], e) for n, e, due, _ in items if not due and self.term[n] >= 0 and e <= self.allowed[self.term[n]])

    def _learn(self, states: np.ndarray, letters: np.ndarray) -> None:
        for key in np.unique(states.astype(np.int64) * self.classes + letters).tolist():
            state, letter = divmod(key, self.classes)
            if self.next[state, letter] >= 0:
                continue
            items = self._step(self.sets[state], letter)
            to = self.number.get(items)
            if to is None:
                to = self.number[items] = len(self.sets)
                self.sets.append(items)
                self.outputs.append(self._output(items))
                if to >= len(self.next):
                    self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            self.next[state, letter] = to

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letter classes of the text, and starts and ends of its words."""
        classes = self.class_of[codes]
        inside = np.concatenate([[False], classes > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return classes, edge[::2], edge[1::2]

    def matches(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word number, state)`` wherever a word begins with a term or as a whole is near one, a word's best edits only."""
        if len(self.sets) > _STATES:
            self.forget()
        alive, state, at = np.arange(len(starts)), np.ones(len(starts), dtype=np.int32), starts.copy()
        words, states = [], []
        while len(alive):
            letters = classes[at]
            to = self.next[state, letters]
            if (to < 0).any():
                unknown = to < 0
                self._learn(state[unknown], letters[unknown])
                to = self.next[state, letters]
            at = at + 1
            done = at >= ends[alive]
            least = self._least()[to]
            hit = (least == 0) | (done & (least < 9))
            words.append(alive[hit])
            states.append(to[hit])
            on = (to > 0) & ~done
            alive, state, at = alive[on], to[on], at[on]
        words, states = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*states, np.zeros(0, np.int32)])
        best = np.full(len(starts), 9, dtype=np.int8)
        least = self._least()[states]
        np.minimum.at(best, words, least)
        keep = least == best[words]
        return words[keep], states[keep]

    def _least(self) -> np.ndarray:
        """The fewest edits with which each state accepts a term; 9 if none."""
        known = getattr(self, "_fewest", np.zeros(0, dtype=np.int8))
        if len(known) > len(self.outputs):
            known = known[:0]
        if len(known) < len(self.outputs):
            more = [min((e for _, e in o), default=9) for o in self.outputs[len(known) :]]
            self._fewest = known = np.concatenate([known, np.array(more, dtype=np.int8)])
        return known

    def accepted(self, state: int) -> list[tuple[int, int]]:
        """The terms of a state with its fewest edits."""
        least = int(self._least()[state])
        return [(t, e) for t, e in self.outputs[state] if e == least]


@cache
def _word_letters() -> np.ndarray:
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return np.array([c for c in every if chr(c).isalnum() or chr(c) in _BESIDE])


@lru_cache(maxsize=2)
def _automaton(terms: tuple[str, ...]) -> Automaton:
    """One automaton for each worker process."""
    return Automaton(list(terms))


# ------------------------------------------------------------------------------------------------ the texts


def _joined(texts: list[str | None]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """``(number of the first text, lower-case texts, their code points with a blank after each, their begins)`` a block at a time."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        if held and size + len(lowered) > _BLOCK:
            yield first, held, *_codes(held)
            first, held, size = i, [], 0
        held.append(lowered)
        size += len(lowered) + 1
    if held:
        yield first, held, *_codes(held)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    return codes, np.cumsum(lengths) - lengths


def _hits(automaton: Automaton, texts: list[str | None]) -> Iterator[tuple[int, str, int, list[tuple[int, int, int, int]]]]:
    """``(text number, lower-case text, words in it, [(word number, begin, end, state)])`` for every text."""
    for first, lowered, codes, begins in _joined(texts):
        classes, starts, ends = automaton.words(codes)
        words, states = automaton.matches(classes, starts, ends)
        order = np.lexsort((states, words))
        words, states = words[order], states[order]
        edges = np.append(np.searchsorted(starts, begins), len(starts))
        cuts = np.searchsorted(words, edges)
        for i, text in enumerate(lowered):
            few = slice(cuts[i], cuts[i + 1])
            own = words[few]
            spots = zip((own - edges[i]).tolist(), (starts[own] - begins[i]).tolist(), (ends[own] - begins[i]).tolist(), states[few].tolist())
            yield first + i, text, int(edges[i + 1] - edges[i]), list(spots)


def context_factor(text: str, begin: int, end: int) -> float:
    """How much a match of ``text[begin:end]`` (lower case) counts where it stands."""
    before, after = text[max(0, begin - REACH) : begin], text[end : end + REACH]
    before, after = before[before.rfind("\n") + 1 :], after.split("\n", 1)[0]
    near, behind = _WORD.findall(before[-80:])[-5:], _WORD.findall(after[:80])[:5]
    opened = max(before.rfind(c) for c in _OPEN)
    closed = max(before.rfind(c) for c in _CLOSE)
    quoted = (opened > closed and any(c in after for c in _CLOSE)) or (before.count('"') % 2 == 1 and '"' in after)
    factor = QUOTED if quoted else 1.0
    if REPORTING.intersection(near[-3:]):
        factor = min(factor, REPORTED) * (REPORTED if quoted else 1.0)
    elif not quoted and ADDRESS.intersection(near + behind):
        factor = ADDRESSED
    return factor


def features(words: int, spots: list[tuple[int, float]]) -> list[float]:
    """Sum, strongest window, density, strongest match and length of a text with weighted matches ``(word number, weight)``."""
    total = strongest = window = best = 0.0
    first = 0
    for at, weight in spots:
        total += weight
        strongest = max(strongest, weight)
        window += weight
        while at - spots[first][0] >= WINDOW:
            window -= spots[first][1]
            first += 1
        best = max(best, window)
    return [math.log1p(total), math.log1p(best), math.log1p(100 * total / (words + 10)), strongest, math.log1p(words)]


@dataclass
class Model:
    """What a score needs: terms, their weights by number of edits, and the coefficients over the features."""

    terms: list[str]
    weights: dict[tuple[int, int], float]
    coefficients: list[float]
    intercept: float

    def described(self, texts: list[str | None]) -> Iterator[list[float]]:
        """The features of every text."""
        automaton = _automaton(tuple(self.terms))
        worth: dict[int, float] = {}
        for _, text, words, spots in _hits(automaton, texts):
            best: dict[int, tuple[float, int, int]] = {}
            for at, begin, end, state in spots:
                if state not in worth:
                    worth[state] = max((self.weights.get(k, 0.0) for k in automaton.accepted(state)), default=0.0)
                if worth[state] > best.get(at, (0.0,))[0]:
                    best[at] = (worth[state], begin, end)
            worth = {} if len(worth) > _STATES else worth
            yield features(words, [(at, w * context_factor(text, b, e)) for at, (w, b, e) in sorted(best.items())])

    def score(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(rows @ np.array(self.coefficients) + self.intercept)))


# ------------------------------------------------------------------------------------------------- the model


def stems(text: str) -> set[str]:
    """Beginnings of the words of a text that a lexicon may hold."""
    low, high = LETTERS
    return {w[:n] for w in set(_WORD.findall(text.lower())) for n in range(low, min(len(w), high) + 1)}


def log_odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """How much likelier a toxic text is to hold something than a clean one, from weighted counts."""
    return math.log((toxic + 0.5) / (all_toxic + 1.0)) - math.log((clean + 0.5) / (all_clean + 1.0))


def chosen(rows: list[tuple[str, float, float]], all_toxic: float, all_clean: float) -> list[str]:
    """The lexicon from candidates ``(stem, toxic, clean)``: no stem that a longer one with the same evidence makes needless."""
    strength = {s: t * log_odds(t, c, all_toxic, all_clean) for s, t, c in rows}
    counts = {s: t for s, t, _ in rows}
    longer = defaultdict(float)
    for s, t in counts.items():
        longer[s[:-1]] = max(longer[s[:-1]], t)
    kept = [s for s in counts if longer.get(s, 0.0) < 0.95 * counts[s]]
    return sorted(sorted(kept, key=lambda s: (-strength[s], s))[:TERMS])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, rows: int) -> DataFrame:
    """``text, toxic, weight``: unlike labelled texts to learn from, at most ``rows`` of each class, near copies weighing one together."""
    marked = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("marked"))
    marked = measured(marked.agg(F.max(label_col).cast("int").alias("toxic")), "marked")
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).join(marked, F.col("doc_id") == F.col("marked")).withColumn("hash", F.xxhash64("text"))
    known = durable(known.groupBy("hash", "toxic").agg(F.min("doc_id").alias("doc_id")), "labelled").join(known.select("doc_id", "text"), "doc_id")
    cuts = []
    hashes = durable(known.select("hash", "toxic"), "hashes")
    for label in (0, 1):
        last = hashes.where(F.col("toxic") == label).orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]
        cuts.append((F.col("toxic") == label) & (F.col("hash") <= F.lit(last)))
    chosen_rows = known.where(cuts[0] | cuts[1]).dropDuplicates(["hash", "toxic"])
    long_words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= 8)
    family = F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.col("hash"))
    out = durable(chosen_rows.select("text", "toxic", family.alias("family")), "sample")
    sizes = out.groupBy(F.col("family").alias("of"), F.col("toxic").alias("class")).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return out.join(sizes, (F.col("family") == F.col("of")) & (F.col("toxic") == F.col("class"))).select("text", "toxic", "weight")


def _counter(of, names: list[str], types: list):
    """A map over ``text, toxic, weight`` that adds up the weights of both classes for everything that ``of`` finds in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            toxic, weight = batch.column("toxic").to_pylist(), batch.column("weight").to_pylist()
            for i, found in of(batch.column("text").to_pylist()):
                for key in found:
                    sums.setdefault(key, [0.0, 0.0])[toxic[i]] += weight[i]
            if len(sums) > _BLOCK:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    def out(sums: dict) -> pa.RecordBatch:
        keys = zip(*[k if isinstance(k, tuple) else (k,) for k in sums])
        columns = [pa.array(list(k), t) for k, t in zip(keys, types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([v[1] for v in sums.values()]), pa.array([v[0] for v in sums.values()])], [*names, "toxic", "clean"])

    return run


def _stems_of(texts: list[str]) -> Iterator[tuple[int, set[str]]]:
    for i, text in enumerate(texts):
        yield i, stems(text)


def _matches_of(terms: list[str]):
    def run(texts: list[str]) -> Iterator[tuple[int, set[tuple[int, int]]]]:
        automaton = _automaton(tuple(terms))
        for i, _, _, spots in _hits(automaton, texts):
            yield i, {k for s in spots for k in automaton.accepted(s[3])}

    return run


def _describer(model: Model, keep: list[str]):
    """``keep`` and the features of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(model.described(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
    rows: int = FIT_ROWS,
) -> Model:
    """The model of the labelled rows that are not held out."""
    sample = durable(_sample(docs, labels, id_col, text_col, label_id, label_col, rows), "fit")
    sums = {r.toxic: r.weight for r in sample.groupBy("toxic").agg(F.sum("weight").alias("weight")).collect()}
    all_toxic, all_clean = sums.get(1, 0.0), sums.get(0, 0.0)
    if not all_toxic or not all_clean:
        return Model([], {}, [0.0] * 5, 1000.0 if all_toxic else -1000.0)
    texts = whole_texts(sample)
    counts = texts.mapInArrow(_counter(_stems_of, ["stem"], [pa.string()]), "stem string, toxic double, clean double")
    counts = counts.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / F.lit(all_toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(all_clean + 1.0))
    found = counts.where((F.col("t") >= SUPPORT) & (odds >= LEAST_ODDS)).orderBy(F.desc(F.col("t") * odds), "stem").limit(10 * TERMS)
    terms = chosen([tuple(r) for r in found.collect()], all_toxic, all_clean)
    counts = texts.mapInArrow(_counter(_matches_of(terms), ["term", "edits"], [pa.int32(), pa.int32()]), "term int, edits int, toxic double, clean double")
    seen = {(r.term, r.edits): (r.t, r.c) for r in counts.groupBy("term", "edits").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()}
    weights = {}
    for number, term in enumerate(terms):
        exact = seen.get((number, 0), (0.0, 0.0))
        for edits in range(edits_allowed(term) + 1):
            t, c = seen.get((number, edits), (0.0, 0.0))
            share = SPELLING**edits if edits else 0.0
            weights[number, edits] = max(0.0, log_odds(t + share * exact[0], c + share * exact[1], all_toxic, all_clean))
    model = Model(terms, weights, [0.0] * 5, 0.0)
    described = texts.mapInArrow(_describer(model, ["toxic", "weight"]), "toxic int, weight double, x array<double>")
    described = described.select(F.col("toxic").cast("double").alias("toxic"), "weight", array_to_vector("x").alias("x"))
    fitted = LogisticRegression(featuresCol="x", labelCol="toxic", weightCol="weight", regParam=1e-3, maxIter=200).fit(durable(described, "described"))
    return Model(terms, weights, fitted.coefficients.toArray().tolist(), float(fitted.intercept))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    keep = ["doc_id", "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _describer(model, keep)(batches):
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, 5)
            scores = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*keep, "score", "predicted"]
            )

    return whole_texts(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``score`` under the model that ``fit`` learns from the same rows."""
    return score(docs, fit(docs, labels, id_col, text_col, **columns), id_col, text_col)
