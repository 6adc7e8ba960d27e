"""Sub-word tokens against plain recursive versions and, for published vocabularies, their own library."""

import base64
import random
from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tsalign.functions.subwords import BytePairs, Subwords, WordPieces, token_count_subword

FOLDER = Path("/opt/tokenizers")
PIECES = ["a", "b", "ab", "abc", "##a", "##b", "##c", "##bc", "##cab", ".", "é", "##é"]
TEXTS = ["", " ", "abc", "abcab", "ABCab é éa.b", "xyz ab", "a" * 101, "a" * 100, "a_b", "Ⅷ abc!", "c", "acb\n\nab"]


def plain_pieces(word, first=True):
    """Longest match by recursion; None where nothing matches."""
    if not word:
        return []
    for n in range(len(word), 0, -1):
        if (word[:n] if first else "##" + word[:n]) in PIECES:
            rest = plain_pieces(word[n:], False)
            return None if rest is None else [n, *rest]
    return None


def plain_pairs(ranks, parts):
    """The lowest-ranked pair merged, by recursion."""
    pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
    if not pairs:
        return parts
    _, i = min(pairs)
    return plain_pairs(ranks, [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]])


def test_word_pieces():
    t = WordPieces(PIECES)
    for text in TEXTS:
        words = [text[a:b].lower() for a, b in t.spans(text)]
        want = sum(1 if len(w) > 100 or (p := plain_pieces(w)) is None else len(p) for w in words)
        assert t.counts([text]) == [want], text
    assert t.counts([None, "abcab", None, ""]) == [None, 3, None, 0]


def test_byte_pairs_against_plain_merges():
    rng = random.Random(5)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 500:
        a, b = rng.sample(sorted(ranks, key=lambda k: (ranks[k] < 97 or 103 < ranks[k] < 256, rng.random()))[:60], 2)
        ranks.setdefault(a + b, len(ranks))
    t = BytePairs(ranks)
    for _ in range(400):
        data = bytes(rng.choice(b"abcdefg") for _ in range(rng.randint(0, 40)))
        parts = plain_pairs(ranks, [bytes([x]) for x in data])
        assert t.merged(data) == [sum(map(len, parts[: i + 1])) for i in range(len(parts))]


@pytest.mark.skipif(not FOLDER.exists(), reason="no vocabularies")
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_published_byte_pairs(name):
    import tiktoken

    with open(FOLDER / name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    theirs = tiktoken.Encoding("own", pat_str=BytePairs.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = BytePairs.load(str(FOLDER / name))
    texts = ["Hello, world's  end\n\n x", "Größe für ñandú 日本語テキスト 🙂🙂", "    def f(x):\n\treturn x ** 2", "ab" * 3000, "á \x00 it'll", ""]
    assert ours.counts(texts) == [len(theirs.encode_ordinary(t)) for t in texts]
    for text in texts:
        for limit in (0, 1, 3, 7, 10_000):
            head = ours.head(text, limit)
            ids = theirs.encode_ordinary(text)[:limit]
            assert head == theirs.decode_bytes(ids).decode("utf-8", "ignore") and text.startswith(head)


def test_head_of_word_pieces():
    t = WordPieces(PIECES)
    assert [t.head("ABCab  xyz é", n) for n in range(7)] == ["", "ABC", "ABCa", "ABCab", "ABCab  xyz", "ABCab  xyz é", "ABCab  xyz é"]


def test_the_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr("tsalign.functions.subwords.REMEMBERED", 3)
    t = WordPieces(PIECES)
    assert t.counts(["a b ab abc ba c a"]) == [1 + 1 + 1 + 1 + 2 + 1 + 1] and len(t._known) <= 3


def test_memory_does_not_grow_with_the_words_of_a_batch(monkeypatch):
    import tracemalloc

    monkeypatch.setattr("tsalign.functions.subwords.REMEMBERED", 100)
    t = WordPieces(PIECES)
    texts = (" ".join(f"ab{i}x{j}" for j in range(100)) for i in range(500))
    tracemalloc.start()
    try:
        got = t.counts(texts)
        assert tracemalloc.get_traced_memory()[1] < 500_000
        assert got == [100] * 500
        # a long word is cut, not kept; words that come again are
        assert t.counts(["c" + "a" * 1_000_000, "abcab abcab", "abcab"]) == [1, 6, 3]
        assert tracemalloc.get_traced_memory()[0] < 500_000
    finally:
        tracemalloc.stop()


def test_a_word_is_cut_anew_only_after_both_memories_forgot_it(monkeypatch):
    monkeypatch.setattr("tsalign.functions.subwords.REMEMBERED", 3)
    t, cut = WordPieces(PIECES), []
    monkeypatch.setattr(t, "cut", lambda word, f=t.cut: cut.append(word) or f(word))
    assert t.counts(["a b ab abc a ba bab aba a"]) == [1 + 1 + 1 + 1 + 1 + 2 + 3 + 2 + 1]
    assert cut.count("a") == 1 and len(t._known) <= 3 and len(t._older) <= 3
    many = [f"a{'b' * n}" for n in range(50)]
    assert t.counts([" ".join(many)] * 2) == [sum(len(WordPieces(PIECES).cut(w)) for w in many)] * 2


def test_long_words_take_little_time():
    t = BytePairs({**{bytes([i]): i for i in range(256)}, b"ab": 256, b"abab": 257})
    assert t.counts(["ab" * 100_000]) == [50_000]


def test_column(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    got = {r.i: r.n for r in df.select("i", token_count_subword(F.col("t"), partial(WordPieces, PIECES)).alias("n")).collect()}
    assert got == dict(enumerate(WordPieces(PIECES).counts([*TEXTS, None])))
    with pytest.raises(NotImplementedError):
        Subwords().spans("x")


def counting(folder):
    """A builder of encoders that write down what they encode."""

    def build():
        import uuid

        import numpy as np

        def encode(texts):
            lines = [f"{len(texts)}\t{t!r}\n" for t in texts]
            with open(f"{folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as out:
                out.writelines(lines)
            return np.array([[len(t), sum(map(ord, t)) % 1000] for t in texts], dtype=np.float32)

        return encode

    return build


def test_vectors_are_encoded_once_and_resumed(spark, tmp_path):
    from tsalign.operators.features import embed_column, embed_with_store

    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    encoder = counting(str(log))
    seen = lambda: sorted(line.split("\t")[1].rstrip("\n") for f in log.iterdir() for line in f.read_text(encoding="utf-8").splitlines())
    rows = [(i, f"text {i % 7}" * (i % 5 + 1), 0) for i in range(60)] + [(100, None, 0), (101, "", 0), (None, "text 1", 0), (3, "é", 1)]
    df = spark.createDataFrame(rows, "id int, t string, digest int").repartition(4)
    first = embed_with_store(df.where("id < 30"), "t", store, "v", encoder, batch=4).collect()
    once = {repr(t or "") for i, t, _ in rows if i is not None and i < 30}
    assert len(first) == 31 and seen() == sorted(once)
    whole = embed_with_store(df, "t", store, "v", encoder, batch=4)
    assert seen() == sorted({repr(t or "") for _, t, _ in rows})
    again = embed_with_store(df, "t", store, "v", encoder)
    assert seen() == sorted({repr(t or "") for _, t, _ in rows})
    plain = embed_column(df, "t", "v", encoder)
    key = lambda r: repr((r.id, r.t, r.digest, list(r.v)))
    assert sorted(map(key, whole.collect())) == sorted(map(key, again.collect())) == sorted(map(key, plain.collect()))
    assert whole.columns == ["id", "t", "digest", "v"]


def test_the_encoder_reads_the_first_tokens_in_batches_of_like_length(spark, tmp_path):
    from tsalign.operators.features import embed_with_store

    encoder, tokenizer = counting(str(tmp_path)), partial(WordPieces, ["a", "b"])
    df = spark.createDataFrame([("a b " * n,) for n in (9, 1, 8, 2, 7, 3, 0)], "t string").coalesce(1)
    out = embed_with_store(df, "t", str(tmp_path / "store"), "v", encoder, tokenizer, max_tokens=6, batch=3)
    assert {len(r.t): r.v[0] for r in out.collect()} == {4 * n: min(max(4 * n - 1, 0), 11) if n > 3 else 4 * n for n in (9, 1, 8, 2, 7, 3, 0)}
    batches = [[len(eval(x.split("\t")[1])) for x in f.read_text().splitlines()] for f in tmp_path.iterdir() if f.is_file()]
    assert sorted(map(sorted, batches)) == [[0, 4, 8], [11], [11, 11, 12]] or sorted(map(sorted, batches)) == [[0, 4, 8], [11, 11, 11], [12]]
    with pytest.raises(ValueError, match="tokenizer"):
        embed_with_store(df, "t", "x", max_tokens=3)
    assert embed_with_store(df.limit(0), "t", str(tmp_path / "none"), "v", encoder).count() == 0
