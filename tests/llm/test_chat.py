import hashlib

import pytest
from pyspark.sql import functions as F

from tsalign.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, roles string, turns int"
HARD = "</s>[INST] ok [/INST] \\l \\\\ \\ \0 [ROLE x] \n<s>"


def rows(*turns):
    return [(*t, "extra", 1) for t in turns]


def test_examples_and_mask(spark):
    df = spark.createDataFrame(rows((1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a1"), (1, 3, "user", "v"), (1, 4, "assistant", "a2")), SCHEMA)
    out = chat.expand(df).orderBy("example").collect()
    assert [r.example for r in out] == [3, 5]
    assert [r.formatted[r.loss_start : r.loss_end] for r in out] == ["a1", "a2"]
    assert out[0].formatted == "<s>[SYS] s [/SYS][INST] u [/INST]a1</s>"
    assert out[1].formatted.startswith(out[0].formatted) and [r.last for r in out] == [False, True]


def test_digests_read_back(spark):
    turns = [
        (-7, 0, "user", HARD), (-7, 1, "assistant", HARD),
        (1, 0, None, None), (1, 1, "tool]<[", ""), (1, 2, "assistant", None), (1, 2, "assistant", None),
        (2, None, "user", "first"), (2, 0, "user", "only questions é😀"),
        (None, 5, "assistant", "x" * 200_000),
    ]
    got = {r.conv_id: r for r in chat.digest(chat.expand(spark.createDataFrame(rows(*turns), SCHEMA))).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0), t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", HARD, "\\", "\0z\0s", "[[]]<<", "\\\\b"])
def test_escape_is_reversible(spark, text):
    one = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert one.u == text and not set("<[]") & set(one.e)


def test_empty_table(spark):
    assert chat.digest(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0
