import random
from pathlib import Path

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsalign.llm import pieces as P

pytestmark = pytest.mark.skipif(not Path(P.MODEL).exists(), reason="no vocabulary")
MODEL = P.Pieces.load() if Path(P.MODEL).exists() else None


def own():
    """A small vocabulary with equal scores, so that ties are common."""
    texts = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), P.SPACE, "a", "b", "c", "ab", "bc", "abc", P.SPACE + "a", P.SPACE + P.SPACE, "aa"]
    kinds = ["control"] + ["byte"] * 256 + ["normal"] * 10
    return P.Pieces(texts, [0.0] * 257 + [-3.0, -2.0, -2.0, -2.0, -3.0, -4.0, -4.0, -4.0, -5.0, -4.0], kinds)


def encode(model, text, n):
    ids, _, (score,), (others,) = P.Encoder(model, n).encode([model.parts(text)])
    ways = [(score, ids.tolist())]
    for o in others:
        x = ids.tolist()
        for edit in reversed(o["edits"]):
            x[edit["at"] : edit["at"] + edit["drop"]] = edit["put"]
        ways.append((o["score"], x))
    return ways


@pytest.mark.parametrize("small", [True, False])
def test_n_best_against_all_paths(small):
    model = own() if small else MODEL
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("abc  xé" if small else "then ing中") for _ in range(rng.randint(1, 8)))
        whole = P.SPACE + text.replace(" ", P.SPACE)
        want = [(s, model.coded(ids, whole)) for s, ids in brute.segmentations(model.lattice(whole)[0], len(whole), 5)]
        got = encode(model, text, 5)
        assert [s for s, _ in got] == [s for s, _ in want] and got[0] == want[0]
        assert len({tuple(x) for _, x in got}) == len(got)
        for _, ids in got:
            assert P.decode_ids(model, ids) == text


def test_long_parts_agree_with_short_ones(monkeypatch):
    texts = ["abcab" * 9, "the" * 40, "a\0b", "x" * 3000, "inter" * 7 + "national"]
    for model in (own(), MODEL):
        alone = [encode(model, t, 3) for t in texts]
        monkeypatch.setattr(P, "TOGETHER", 400)
        assert [encode(model, t, 3) for t in texts] == alone
        monkeypatch.setattr(P, "TOGETHER", 32)


@pytest.mark.parametrize("small", [True, False])
def test_sidetracks_against_all_paths(small, monkeypatch):
    model = own() if small else MODEL
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("abcaabxé" if small else "thenig中") for _ in range(rng.randint(1, 12)))
        plain = model.n_best(text, 6)
        monkeypatch.setattr(P, "TOGETHER", 0)
        assert model.n_best(text, 6) == plain
        one = P.Encoder(model, 2)
        monkeypatch.setattr(P, "TOGETHER", 32)
        best, loss, ids = one._single(text)
        assert (best, ids) == (plain[0][0], model.coded(plain[0][1], text))
        assert loss == (plain[0][0] - plain[1][0] if len(plain) > 1 else float("inf"))


def test_long_texts_without_blanks_take_linear_memory():
    import time
    import tracemalloc

    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "ab" * 30_000, "中文字" * 10_000):
        tracemalloc.start()
        begin = time.process_time()
        ways = encode(MODEL, text, 3)
        taken, (_, peak) = time.process_time() - begin, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < 300e6 and taken < 60, (peak, taken)
        scores = [s for s, _ in ways]
        assert len(ways) == (1 if "中" in text else 3) == len({tuple(x) for _, x in ways}) and scores == sorted(scores, reverse=True)
        assert all(P.decode_ids(MODEL, x) == text for _, x in ways)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_every_text_comes_back(text):
    text = text.encode("utf-8", "ignore").decode()
    for _, ids in encode(MODEL, text, 2):
        assert P.decode_ids(MODEL, ids) == text


@pytest.mark.parametrize("text", [" ", "   a", "\n\n", P.SPACE, P.SPACE + P.SPACE + " x", "￾￿", "a▁b", "\U0001f600", "tail ", "<0x41>", "<s></s>"])
def test_hard_texts(text):
    assert P.decode_ids(MODEL, encode(MODEL, text, 3)[0][1]) == text


def test_table(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 50)
    rows = [(1, "a text of words", 1, "x"), (1, "a text of words", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (None, "z" * 40_000, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score int, ids string")
    out = P.round_trip(df).collect()
    assert len(out) == 5 and all(r.exact for r in out)
    by = {str(r.doc_id): r for r in out}
    assert by["2"].ids is None and by["2"].n_pieces is None and by["3"].ids == [] and by["3"].alternatives == []
    assert len(by["1"].alternatives) == 2 and by["1"].score >= by["1"].alternatives[0].score
    assert P.round_trip(df.limit(0)).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for i in range(30)) for k in range(8)] + ["w1x1 w2x2"]
    whole = P.Encoder(MODEL, 3).encode([MODEL.parts(t) for t in texts])
    monkeypatch.setattr(P, "REMEMBERED", 50)
    one = P.Encoder(MODEL, 3)
    for k, t in enumerate(texts):
        ids, lengths, scores, others = one.encode([MODEL.parts(t)])
        begin = int(whole[1][:k].sum())
        assert ids.tolist() == whole[0][begin : begin + lengths[0]].tolist() and (scores[0], others[0]) == (whole[2][k], whole[3][k])
