"""Delimited files read in blocks against Spark's own reader of whole files."""

import random

import pytest

from tsalign.sources import files, records

CELLS = ['plain', '"quoted"', '"two\nlines"', '"a ""b"" c"', '"x, y\n\n"",z"', "", '""', '5" tv', ' "k" ', '"ends""\n"', '"\n"', "é" * 30, '"' + "long line\n" * 40 + '"', '"ab"c']


def content(seed, n, eol="\n"):
    rng = random.Random(seed)
    rows = ["a,b,c"] + [",".join([str(i), rng.choice(CELLS), rng.choice(CELLS)]) for i in range(n)]
    if seed % 2:
        rows.insert(n // 2, "")
    return eol.join(r.replace("\n", eol) for r in rows) + (eol if seed % 3 else "")


@pytest.fixture
def small_blocks(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        for k, v in zip(keys, (size, 0, 1)):
            spark.conf.set(k, str(v))

    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df):
    return sorted(map(tuple, df.select("a", "b", "c").collect()), key=repr)


@pytest.mark.parametrize(("seed", "size", "eol"), [(0, 137, "\n"), (1, 264, "\n"), (3, 164, "\r\n")])
def test_equals_the_whole_file_reader(spark, tmp_path, small_blocks, seed, size, eol):
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_bytes(content(seed + 10 * k, 40 + 20 * k, eol).encode())
    want = rows(files.read_csv(spark, str(tmp_path), multiline=True))
    small_blocks(size)
    df = records.read_csv_records(spark, str(tmp_path), ["a", "b", "c"])
    assert records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    assert rows(df) == want and len(want) == 100
    ordered = df.orderBy("_file", "_block", "_line").collect()
    for k in range(2):
        assert [int(r.a) for r in ordered if r["_file"].endswith(f"f{k}.csv")] == list(range(40 + 20 * k))


def test_a_body_over_many_blocks(spark, tmp_path, small_blocks):
    body = "\n".join(f'he said ""no"" {i}, twice' for i in range(200))
    (tmp_path / "f.csv").write_text(f'published_on,title,body\n2024-01-01,t,"{body}"\n2024-01-02,u,v\n')
    small_blocks(100)
    (first, second) = files.read_news(spark, str(tmp_path)).orderBy(*files.FILE_ORDER).collect()
    assert first.text_content == "t " + body.replace('""', '"') and second.text_content == "u v"


def test_an_open_quote_and_files_without_rows(spark, tmp_path, small_blocks):
    (tmp_path / "open.csv").write_text('a,b,c\n1,x,"never\nclosed,\n2,3')
    (tmp_path / "head.csv").write_text("a,b,c\n")
    (tmp_path / "none.csv").write_text("")
    small_blocks(8)
    assert rows(records.read_csv_records(spark, str(tmp_path), ["a", "b", "c"])) == [("1", "x", "never\nclosed,\n2,3")]


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [("", False, False), ("", True, True), ('a,"b', False, True), ('a,b"', False, False), ('x",y', True, False), ('x"",y', True, True), ('","', False, False), ('"a""', False, True), ('"a"b,"', False, True)],
)
def test_states(line, inside, after):
    assert records.ends_inside(line, inside) == after
