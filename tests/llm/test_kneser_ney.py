import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from tsalign.llm import kneser_ney as kn

DOCS = "doc_id bigint, text string, lang string, g string, c int, known int"
LABELS = "doc_id bigint, quality int, toxic int, lang string"


def corpus():
    rng = random.Random(2)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))
    docs = [(i, say("abcde", rng.randint(3, 40)), "en") for i in range(60)]
    docs += [(100 + i, say("#@!$%&", 30), "en") for i in range(5)]
    docs += [(200 + i, say("xyzéß😀", 20), None) for i in range(20)]
    docs += [(300, None, "en"), (301, "", "fr"), (302, "a\0b", "de"), (None, "abc ab", "en"), (1, "abc repeated id", "en")]
    labels = [(i, 1, 0, "q") for i in range(50)] + [(i, 0, 0, "q") for i in range(100, 103)] + [(200 + i, 1, 0, "q") for i in range(15)]
    labels += [(3, 1, 0, "q"), (4, 0, 1, "q"), (5, None, 0, "q"), (None, 1, 0, "q")]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "g", 1, 2) for d in docs], DOCS), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("shard", [kn.SHARD, 300])
def test_perplexity_against_brute_force(spark, shard):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels)
    held = {r.doc_id for r in d.where(F.pmod(F.xxhash64("doc_id"), F.lit(kn.FOLDS)) == 0).select("doc_id").distinct().collect()}
    trusted = {i for i, q, _, _ in labels if q == 1} - {i for i, q, _, _ in labels if q != 1} - {None}
    want = brute.kneser_ney([t for i, t, _ in docs if i in trusted and i not in held], [t for _, t, _ in docs])
    got = kn.classify(d, l, shard_rows=shard).collect()
    order = lambda x: (str(x[0]), x[1] or 0)
    got = sorted(((r.doc_id, r.perplexity) for r in got), key=order)
    want = sorted(((i, p) for (i, _, _), p in zip(docs, want)), key=order)
    assert len(got) == len(want)
    for (i, a), (k, b) in zip(got, want):
        assert i == k and (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9))


def test_decisions(spark):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels)
    kept = {r.doc_id: r.kept for r in kn.classify(d, l, tolerance=1.5).collect()}
    assert not any(kept[100 + i] for i in range(5))
    assert kept[300] and kept[301] and kept[None]
    out = kn.drop_rejected(d, l)
    assert out.dtypes == d.dtypes and 300 in {r.doc_id for r in out.collect()}


def test_outlying_trusted_texts_do_not_let_junk_pass(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(known) for _ in range(n))
    docs = [(i, say(rng.randint(60, 200)), "en") for i in range(400)]
    docs += [(400 + i, "".join(rng.choice("äöüß€¥") for _ in range(12)), "en") for i in range(12)]
    docs += [(1000 + i, " ".join(["".join(rng.choice("abcdefgh") for _ in range(6))] * 80), "en") for i in range(20)]
    docs += [(2000 + i, " | ".join(rng.choice(known)[:3] for _ in range(60)), "en") for i in range(20)]
    d, l = frames(spark, docs, [(i, 1, 0, "q") for i in range(412)])
    kept = {r.doc_id: r.kept for r in kn.classify(d, l).collect()}
    assert sum(not kept[1000 + i] for i in range(20)) >= 18 and not any(kept[2000 + i] for i in range(20))
    assert sum(kept[i] for i in range(400)) >= 390


def test_toxic_texts_are_not_trusted(spark):
    rng = random.Random(6)
    known = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(100)]
    docs = [(i, " ".join(rng.choice(known) for _ in range(60)), "en") for i in range(200)]
    docs += [(1000 + i, " ".join(rng.choice(["scum", "trash", "idiot"]) for _ in range(60)), "en") for i in range(100)]
    d, l = frames(spark, docs, [(i, 1, 0, "q") for i in range(200)] + [(1000 + i, 1, 1, "q") for i in range(100)] + [(0, 1, None, "q")])
    kept = {r.doc_id: r.kept for r in kn.classify(d, l).collect()}
    assert not any(kept[1000 + i] for i in range(100)) and sum(kept[i] for i in range(200)) >= 195


def test_empty_tables(spark):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels)
    nothing = kn.classify(d, l.limit(0)).collect()
    assert len(nothing) == len(docs) and all(r.kept and r.perplexity is None for r in nothing)
    assert kn.classify(d.limit(0), l).count() == 0 and kn.drop_rejected(d.limit(0), l).count() == 0


def test_long_texts_do_not_depend_on_the_block(spark, monkeypatch):
    text = "ab cd " * 5000
    whole = [(len(c), len(s)) for c, s, _ in kn._blocks([text])]
    monkeypatch.setattr(kn, "BLOCK", 1000)
    parts = list(kn._blocks([None, text, "x", ""]))
    assert sum(n for _, n in whole) == len(text) + 1 and sum(len(s) for _, s, _ in parts) == len(text) + 3


def test_counts_handed_on_in_parts_add_up(spark, monkeypatch):
    docs, _ = corpus()
    texts = spark.createDataFrame([(t, i % 2 == 0) for i, (_, t, _) in enumerate(docs)], "text string, train boolean").coalesce(1)
    whole = sorted(map(tuple, kn.count_grams(texts).collect()))
    batches = [b for b in texts.toArrow().to_batches()]
    monkeypatch.setattr(kn, "BLOCK", 300)
    monkeypatch.setattr(kn, "GATHERED", 200)
    parts = list(kn._count(iter(batches)))
    sums = {}
    for part in parts:
        assert part.num_rows <= 200 + 2 * (300 + kn.ORDER)
        for k, g, c in zip(*(part.column(n).to_pylist() for n in ("key", "g", "c"))):
            sums[k, g] = sums.get((k, g), 0) + c
    assert len(parts) > 3 and sorted((*k, c) for k, c in sums.items()) == whole
