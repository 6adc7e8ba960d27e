import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsalign.llm import toxicity as tx

DOCS = "doc_id bigint, text string, lang string, toxic int, score double, held_out boolean, x int"
LABELS = "doc_id bigint, toxic int, quality int, text string"


def distance(a, b):
    """Edits between two words: letters inserted, missing, wrong, or swapped with their neighbour."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def brute(terms, word):
    found = {}
    for t, term in enumerate(terms):
        if word.startswith(term):
            found[t] = 0
        elif (near := distance(term, word)) <= tx.edits_allowed(term):
            found[t] = near
    least = min(found.values(), default=None)
    return {(t, e) for t, e in found.items() if e == least}


def changed(rng, word, n):
    letters = list(word)
    for _ in range(n):
        at, kind = rng.randrange(len(letters)), rng.randrange(4)
        if kind == 0:
            letters.insert(at, rng.choice("abcz"))
        elif kind == 1 and len(letters) > 1:
            del letters[at]
        elif kind == 2:
            letters[at] = rng.choice("abcz")
        elif at:
            letters[at - 1], letters[at] = letters[at], letters[at - 1]
    return "".join(letters)


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_plain_distances(seed, monkeypatch):
    rng = random.Random(seed)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 11))) for _ in range(25)})
    words = [changed(rng, rng.choice(terms), rng.randrange(4)) + rng.choice(["", "", "ab", "zz"]) for _ in range(1500)] + ["z" * 5000, "a"]
    if seed == 2:
        monkeypatch.setattr(tx, "_STATES", 50)
        monkeypatch.setattr(tx, "_BLOCK", 400)
    texts = [" ".join(words[i : i + 50]) + ". " for i in range(0, len(words), 50)]
    automaton, got = tx.Automaton(terms), {}
    for i, _, n, spots in tx._hits(automaton, [None, "", *texts]):
        assert n == len([w for w in (texts[i - 2] if i > 1 else "").rstrip(". ").split() if w])
        for at, begin, end, state in spots:
            word = texts[i - 2][begin:end]
            assert word == words[(i - 2) * 50 + at]
            got.setdefault((i - 2) * 50 + at, set()).update(automaton.accepted(state))
    assert got == {i: f for i, w in enumerate(words) if (f := brute(terms, w))}


def test_words_and_their_places():
    text = "Ein Idiot,\nIDIOT idiot$$$ übel id1ot st*pid"
    (_, lowered, n, spots), = tx._hits(tx.Automaton(["idiot", "stupid"]), [text])
    assert n == 7 and [lowered[b:e] for _, b, e, _ in spots] == ["idiot", "idiot", "idiot$$$", "id1ot", "st*pid"]


@pytest.mark.parametrize(
    "text,factor",
    [
        ("that scum here", 1.0),
        ('he had "all scum here" on it', tx.QUOTED),
        ("er las „so ein scum hier“ vor", tx.QUOTED),
        ('"an end" of scum and "another"', 1.0),
        ("the word scum", tx.REPORTED),
        ('he said "scum and"', tx.QUOTED * tx.REPORTED),
        ("you are scum", tx.ADDRESSED),
        ('you "quote scum now"', tx.QUOTED),
        ("you\nare\nscum", 1.0),
    ],
)
def test_context(text, factor):
    at = text.index("scum")
    assert tx.context_factor(text, at, at + 4) == factor


def test_strongest_window_against_all_windows():
    rng = random.Random(1)
    for _ in range(50):
        spots = sorted((p, rng.random()) for p in rng.sample(range(300), rng.randint(1, 30)))
        best = max(sum(w for p, w in spots if q <= p < q + tx.WINDOW) for q, _ in spots)
        assert np.isclose(tx.features(300, spots)[1], np.log1p(best))


def test_no_needless_stems():
    rows = [("tras", 20.0, 1.0), ("trash", 20.0, 0.0), ("abus", 30.0, 0.0), ("abuse", 20.0, 0.0), ("abusi", 10.0, 0.0)]
    assert tx.chosen(rows, 50.0, 100.0) == ["abus", "abuse", "abusi", "trash"]


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdefghklmn") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["scumbag", "worthless", "pathetic"])
        docs.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic), 1))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(*d, 0, 0.5, True, 1) for d in docs], DOCS).repartition(4),
        spark.createDataFrame([(*x, "other") for x in labels], LABELS),
    )


def scores(spark, docs, labels):
    out = tx.toxic_scores(*frames(spark, docs, labels))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    return sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))


def test_learns_misspells_and_leaves_clean_texts_alone(spark):
    docs, labels = corpus()
    filler = docs[1][1]
    more = [
        (1000, f"{filler} scumbga wortless pathetik scumbag_ worthles", "en"),
        (1001, None, "en"),
        (1002, "", "en"),
        (1003, filler, "xx"),
        (None, filler, "en"),
        (1, filler, "en"),
        (1004, "k" * 300_000, "en"),
    ]
    got = scores(spark, docs + more, labels)
    assert len(got) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {i for i, t, _ in labels if t}
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.doc_id in toxic or r.doc_id == 1000) for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1001] == by_id[1002] and by_id[1003] == by_id[1] == by_id[None]


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = corpus(300)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels]
    assert np.allclose([r.score for r in scores(spark, docs, labels)], [r.score for r in scores(spark, docs, flipped)], atol=1e-9)


def test_labels_that_say_little(spark):
    docs, labels = corpus(60)
    assert {r.score for r in scores(spark, docs, [])} == {0.0}
    assert {r.score for r in scores(spark, docs, [(i, 0, 1) for i, _, _ in labels] + [(None, 1, 1), (3, None, 1)])} == {0.0}
    assert {r.score for r in scores(spark, docs, [(i, 1, 1) for i, _, _ in labels])} == {1.0}
    assert scores(spark, [], labels) == []


def test_the_sample_is_bounded(spark):
    docs, labels = corpus(300)
    d, l = frames(spark, docs + [(2000 + i, docs[0][1], "en") for i in range(50)], labels + [(2000 + i, 1, 1) for i in range(50)])
    kept = tx._sample(d, l, "doc_id", "text", "doc_id", "toxic", 20)
    assert {r.toxic: r["count"] for r in kept.groupBy("toxic").count().collect()} == {0: 20, 1: 20}


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.toxic_scores(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 80 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    above = sum((t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in clean)
    assert above >= 0.95 * len(toxic) * len(clean)
