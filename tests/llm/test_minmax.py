import random

import brute
import numpy as np
import pytest

from tsalign.llm import minmax, shingles
from tsalign.llm.components import components

SCHEMA = "doc_id bigint, text string, n int, node string, bands int, set_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    return rows + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one\ntwo"), (1005, "two one"), (1006, rows[0][1].upper()), (None, rows[0][1]), (1007, "a b c d")]


def key(r):
    return str(tuple(r))


def test_against_brute_force(spark):
    rows = corpus()
    got = sorted(map(tuple, minmax.near_duplicates(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute.near_duplicates(rows), key=key)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = [r for r in corpus() if r[0] is not None]
    monkeypatch.setattr(minmax, "BLOCK_BYTES", 3_000)
    got = sorted(map(tuple, minmax.near_duplicates(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute.near_duplicates(rows), key=key)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = frame(spark, [*rows, rows[0], rows[0]])
    out = minmax.drop_near_duplicates(df)
    want = sorted(str(i) for i, _, _, kept in brute.near_duplicates(rows) if kept)
    assert sorted(str(r.doc_id) for r in out.collect()) == want and out.dtypes == df.dtypes


def test_empty_table(spark):
    assert minmax.near_duplicates(frame(spark, [])).count() == 0
    assert minmax.drop_near_duplicates(frame(spark, [])).count() == 0


def test_words_of_long_texts_do_not_depend_on_the_cut(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(20_000)) + "é" * 5000
    whole = list(shingles.shingle_sets([text]))[0]
    monkeypatch.setattr(shingles, "SEGMENT", 1000)
    parts = list(shingles.shingle_sets(["a", text, None]))
    assert np.array_equal(whole, parts[1]) and len(parts[0]) == 1 and len(parts[2]) == 0


@pytest.mark.parametrize("share", [0.75, 0.8, 0.9])
def test_signature_recall(share):
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        n = 200
        common = int(round(2 * n * share / (1 + share)))
        x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:common], x[n : 2 * n - common]]))
        missed += not (minmax.bands(a) == minmax.bands(b)).any()
    assert missed == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        top[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}
