import math
import random
from itertools import combinations

import brute

from tsalign.llm import seeds

DOCS = "doc_id bigint, text string, item_id bigint, w int, seed string"
ITEMS = "item_id bigint, text string, doc_id bigint"


def cases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (8, 12, 20, 40, 5)]
    docs = [[word() for _ in range(60)] for _ in range(4)]
    for k, item in enumerate(items):
        for swaps in (0, 1, 2, 4):
            w = list(item)
            for j in rng.sample(range(len(w)), min(swaps, len(w))):
                w[j] = "zzzz"
            docs.append([word() for _ in range(rng.randint(0, 30))] + w + [word() for _ in range(rng.randint(0, 30))])
        for period in (4, 5):
            docs.append([word() for _ in range(9)] + [w if j % period else "zzzz" for j, w in enumerate(item)] + [word() for _ in range(9)])
        docs.append(item[: len(item) // 2] + [word() for _ in range(20)])
        docs.append(item[1:])
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    return seeds.report(d, b), seeds.decontaminate(d, b), d


def test_against_brute_force(spark):
    docs, items = cases()
    want = brute.contaminated(list(enumerate(docs)), list(enumerate(items)), seeds.WINDOW, seeds.AGREE, seeds.MIN_WORDS)
    short = [(i, w) for i, w in enumerate(items) if len(w) < seeds.MIN_WORDS]
    exact = brute.contaminated(list(enumerate(docs)), short, seeds.MIN_WORDS, 1.0, seeds.SHORTEST)
    assert exact - want
    want |= exact
    text = lambda w: ", ".join(w).title() + "!"
    got, left, frame = run(spark, [(i, text(w)) for i, w in enumerate(docs)], [(i, text(w)) for i, w in enumerate(items)])
    found = {r.doc_id for r in got.where("contaminated").collect()}
    assert found == want
    assert got.count() == len(docs) and left.count() == len(docs) - len(found) and left.dtypes == frame.dtypes


def arrangements():
    """``(words, places of the other words)``: all that the rule accepts with as many other words as it allows."""
    for n in range(seeds.MIN_WORDS, seeds.WINDOW + 1):
        for places in combinations(range(n), n - math.ceil(seeds.AGREE * n)):
            yield n, places


def test_every_accepted_arrangement_shares_a_seed():
    for n, places in arrangements():
        assert any(
            all(at + i not in places for i, m in enumerate(mask) if m == "1") for mask in seeds.MASKS for at in range(n - len(mask) + 1)
        ), (n, places)


def test_every_accepted_arrangement_is_found(spark):
    items = {n: [f"w{n}x{j}" for j in range(n)] for n in range(seeds.MIN_WORDS, seeds.WINDOW + 1)}
    docs = [["a", "b"] + ["other" if j in places else w for j, w in enumerate(items[n])] + ["c"] for n, places in arrangements()]
    want = brute.contaminated(list(enumerate(docs)), list(items.items()), seeds.WINDOW, seeds.AGREE, seeds.MIN_WORDS)
    got, _, _ = run(spark, [(i, " ".join(w)) for i, w in enumerate(docs)], [(n, " ".join(w)) for n, w in items.items()])
    assert {r.doc_id for r in got.where("contaminated").collect()} == want == set(range(len(docs)))


def test_short_items_word_for_word(spark):
    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in range(1, 9)]
    docs = [(n, f"A b {text.title()}, c.") for n, text in items]
    docs += [(10 + n, text.replace("x1", "other", 1)) for n, text in items if n < 8] + [(20 + n, f"{text} x"[1:]) for n, text in items if n < 8]
    got, left, _ = run(spark, docs, items)
    assert {r.doc_id: r.item_ids for r in got.where("contaminated").collect()} == {n: [n] for n in range(3, 9)}
    assert left.count() == len(docs) - 6


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, item), (1, None), (2, ""), (3, "..."), (4, item.upper()), (4, item.upper()), (5, item + " x" * 50_000), (6, "a b")]
    got, left, _ = run(spark, docs, [(7, item), (7, item), (None, None), (8, "a b"), (9, "")])
    assert sorted((str(r.doc_id), r.item_ids) for r in got.where("contaminated").collect()) == [("4", [7]), ("4", [7]), ("5", [7]), ("None", [7])]
    assert left.count() == 4


def test_empty_tables(spark):
    item = "one two three four five six seven eight nine ten"
    assert run(spark, [], [(1, item)])[0].count() == 0
    got, left, _ = run(spark, [(1, item)], [])
    assert [r.contaminated for r in got.collect()] == [False] and left.count() == 1
