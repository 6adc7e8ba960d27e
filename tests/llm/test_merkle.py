import hashlib
import random
import zlib

import pytest

from tsalign.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, hash string, idx int, own int, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The top of a tree and, for each node, its siblings with their sides, level by level."""
    ways, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[i : i + 16], at[i : i + 16]) for i in range(0, len(nodes), 16)]
        for run, members in runs:
            for p, below in enumerate(members):
                for i in below:
                    ways[i].append((run[:p], run[p + 1 :]))
        nodes, at = [sha(*run) for run, _ in runs], [sum(m, []) for _, m in runs]
    return nodes[0], ways


def brute(rows):
    by_source = {}
    for doc_id, source, lang, n, text in rows:
        bad = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            bad = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf((doc_id, source, lang, n, text)), leaf((doc_id, source, lang, n, bad))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s]), climb([x[2] for x in sorted(by_source[s])])) for s in order}
    root, upper = climb([trees[s][1][0] for s in order]) if order else (None, [])
    out = []
    for s, above in zip(order, upper):
        members, (top, ways) = trees[s]
        for (known, doc_id, good, bad), way in zip(members, ways):
            node = bad
            for left, right in way + above:
                node = sha(*left, node, *right)
            proof = sha(*[x for left, right in way + above for x in left + right])
            out.append((doc_id if known else None, good, top, root, proof, node, node == root))
    return sorted(out, key=repr)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ab", "cÉ", "", "x\ny", "日本", "Q" * 50])
    rows = [(i, f"s{i % 3}" if i % 7 else "hot", "en", i * 2, " ".join(word() for _ in range(4))) for i in rng.sample(range(n * 3), n)]
    rows += [(-5, None, None, None, None), (5, None, "de", 1, ""), (9, "", "de", 1, "A" * 100_000), (1, "alone", "en", 3, "Abc")]
    return rows + [(None, "s1", "en", 1, "No Id"), (None, None, None, None, None), rows[0], rows[0], (rows[1][0], "s2", "fr", 0, "Other")]


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "h", 1, 2, "r") for r in rows], SCHEMA).repartition(4)
    out = merkle.manifest(frame)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("digits,n", [(1, 700), (2, 700), (3, 60), (3, 5000)])
def test_against_brute_force(spark, monkeypatch, digits, n):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = rows_of(n)
    want = brute(rows)
    assert got(spark, rows) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 2


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    rows = [(i, f"é{i % 300}" if i % 2 else f"z{i % 300}", "en", 1, "Text") for i in range(900)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_edge_sizes(spark, n):
    rows = [(i, "a", "en", 1, "Text") for i in range(n)]
    assert got(spark, rows) == brute(rows)


def test_a_row_without_id_is_not_tampered_with(spark):
    (row,) = got(spark, [(None, None, None, None, "ABC")])
    assert row[-1] and row[1] == row[2] == row[3] == row[5]


def test_a_proof_detects_every_change(spark):
    rows = rows_of(40, seed=3)
    changed = [(i, s, g, n, None if t is None else t + "!") for i, s, g, n, t in rows]
    assert not {r[1] for r in brute(rows)} & {r[1] for r in got(spark, changed) if r[0] not in (-5, None)}
