import brute

from tsalign.llm import lines

SCHEMA = "doc_id bigint, source string, text string, host string, keys int, n_chars bigint, clean string"


def frame(spark, rows):
    return spark.createDataFrame([(i, h, t, "h", 3, len(t or ""), "c") for i, h, t in rows], SCHEMA)


ROWS = [
    (1, "a", "menu\nbody one\n menu "), (2, "a", "menu\nbody two"), (3, "a", "menu\n\nbody three\n"), (4, "a", None),
    (5, None, "foot\nx"), (6, None, "foot\ny"), (7, None, "foot"), (8, None, ""),
    (9, "b", "menu\nfew pages"), (9, "b", "menu\nfew pages"), (10, "c", "z\n" * 50_000),
]


def test_against_brute_force(spark):
    got = sorted(((r.row.doc_id, r.clean) for r in lines.drop_boilerplate(frame(spark, ROWS), ratio=0.5).collect()), key=str)
    assert got == sorted(brute.drop_lines(ROWS, 0.5, lines.MIN_PAGES), key=str)


def test_counts(spark):
    got = {r.row.doc_id: (r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(frame(spark, ROWS), ratio=0.5).collect()}
    assert got[1] == (3, 2) and got[3] == (4, 1) and got[4] == (0, 0) and got[7] == (1, 1) and got[8] == (1, 0)


def test_columns_stay(spark):
    df = frame(spark, ROWS)
    out = lines.clean_pages(df, ratio=0.5)
    assert out.dtypes == df.dtypes and out.count() == len(ROWS)
    one = out.where("doc_id = 2").first()
    assert (one.text, one.host, one["keys"], one.clean) == ("body two", "h", 3, "c")


def test_empty_table(spark):
    assert lines.drop_boilerplate(frame(spark, [])).count() == 0
