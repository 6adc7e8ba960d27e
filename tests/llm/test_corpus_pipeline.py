"""The pipeline against plain versions of its stages, one after the other."""

import math
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tsalign.llm import kneser_ney as kn
from tsalign.llm import lines, seeds

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, doc int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(120)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(25)) for i in range(4)]
    docs = []
    for i in range(120):
        host = f"h{i % 3}"
        body = "\n".join(say(rng.randint(8, 30)) for _ in range(3))
        docs.append([i, (f"menu of {host}\n" if rng.random() < 0.7 else "") + body, "en", host])
    for k in range(10):
        docs.append([200 + k, docs[k][1].replace("menu of", "menu of") + " end", "en", docs[k][3]])
    for k in range(6):
        docs.append([300 + k, " ".join(rng.choice("#$%&*!") * 5 for _ in range(60)), "en", "h0"])
    for k, (_, t) in enumerate(items):
        docs.append([400 + k, say(20) + " " + t + " " + say(20), "en", "h1"])
    docs += [[500, None, "en", "h0"], [501, "", None, None], [None, say(30), "en", "h2"]]
    rows = [(i, t, l, s, None if t is None else len(t), "r", 1) for i, t, l, s in docs]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 110)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_run(spark, folder):
    start = spark.read.parquet(f"{folder}/documents.parquet")
    docs = [tuple(r) for r in start.collect()]
    held = {r.doc_id for r in start.where(F.pmod(F.xxhash64("doc_id"), F.lit(kn.FOLDS)) == 0).collect()}
    trusted = set(range(110))
    known = brute.kneser_ney([d[1] for d in docs if d[0] in trusted - held], [d[1] for d in docs])
    calibration = sorted({math.log(p) for d, p in zip(docs, known) if d[0] in trusted & held})
    low, middle, high = (calibration[math.ceil(q * len(calibration)) - 1] for q in (0.25, 0.5, 0.75))
    at = math.exp(middle + kn.SPREADS / 1.349 * (high - low)) * kn.TOLERANCE
    left = [d for d, p in zip(docs, known) if p is None or p <= at or d[0] is None]
    clean = dict(enumerate(t for _, t in brute.drop_lines([(d[0], d[3], d[1]) for d in left], lines.RATIO, lines.MIN_PAGES)))
    left = [(d[0], clean[k]) for k, d in enumerate(left)]
    left = [x for x, r in zip(left, brute.near_duplicates(left)) if r[3]]
    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = brute.contaminated([(i, words(t)) for i, t in left], items, seeds.WINDOW, seeds.AGREE, seeds.MIN_WORDS)
    want = sorted(((i, t) for i, t in left if i not in bad), key=str)

    got = cp.run(spark, folder)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    assert bad == {400, 401, 402, 403} and not {300, 301} & {i for i, _ in want} and len(want) < len(docs) - 15

    frame = start
    for _, stage in cp.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.dtypes == start.dtypes
    assert sorted(str(r.doc_id) for r in cp.STAGES[-1][1](spark, frame, folder).collect()) == sorted(str(i) for i, _ in want)


def test_empty_documents(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        empty = stage(spark, empty, folder)
    assert cp.STAGES[-1][1](spark, empty, folder).count() == 0
