from tsalign.llm import licenses

SCHEMA = "doc_id bigint, text string, digest string, license_id int"


def scan(spark, texts, known=None):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return [r.license_id for r in licenses.scan(docs, known or licenses.known_texts(spark)).orderBy("doc_id").collect()]


def test_variants_of_one_text_match(spark):
    mit = dict(licenses.KNOWN)["BSD-3-Clause"]
    changed = "Copyright (c) 2019 Some One\nAll rights reserved.\n\n" + mit.upper().replace(" ", "  \n").replace(",", ";")
    assert scan(spark, [mit, changed, mit + " and more", "quoted: " + mit]) == ["BSD-3-Clause", "BSD-3-Clause", None, None]


def test_spellings_and_notices(spark):
    assert scan(spark, ["RELEASED under the mit licence", "Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0"]) == ["MIT", "CC-BY-NC-4.0", None]


def test_edges(spark):
    long = "word " * 200_000
    assert scan(spark, [None, "", "...", "All rights reserved.", long, long]) == [None] * 6
    assert scan(spark, []) == []


def test_ties_take_the_smallest_id(spark):
    known = spark.createDataFrame([("b", "Same text"), ("a", "same, TEXT"), ("c", None), ("d", "!!")], "license_id string, text string")
    assert scan(spark, ["same text.", "", None], known) == ["a", None, None]


def test_published_forms(spark, tmp_path):
    body = dict(licenses.KNOWN[::-1])
    wrap = lambda t, n=70: "\n".join(__import__("textwrap").fill(x, n) for x in t.split("\n"))
    bsd = licenses._BSD_HEAD.split("\n")
    numbered = [bsd[0], "", "1. " + bsd[1], "", "2. " + bsd[2], ""]
    forms = {
        "MIT": [
            "The MIT License (MIT)\n\nCopyright (c) 2015 Jane Doe\n\n" + wrap(licenses._MIT_BODY),
            "MIT License\n\nCopyright Jane Doe and contributors\n\n" + wrap(licenses._MIT_BODY, 78),
            "# The MIT License\n\nCopyright 2019-present, The Project Authors. All rights reserved.\n\n" + licenses._MIT_BODY,
        ],
        "ISC": ["ISC License\n\nCopyright (c) 2004-2010 by Example Corp\n\n" + wrap(body["ISC"])],
        "BSD-2-Clause": [
            "BSD 2-Clause License\n\nCopyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + wrap("\n".join(numbered)) + "\n" + wrap(licenses._BSD_END),
            "Copyright (c) 2020\n\n" + wrap("\n".join([bsd[0], "* " + bsd[1], "* " + bsd[2]])) + "\n" + wrap(licenses._BSD_END.replace("HOLDERS", "OWNERS").replace("HOLDER ", "OWNER "), 61),
        ],
        "BSD-3-Clause": ["BSD 3-Clause License\n\nCopyright (c) 2020\n\n" + wrap("\n".join([*numbered, "3. " + licenses._BSD_NAMES])) + wrap(licenses._BSD_END)],
        "Unlicense": [wrap(licenses._UNLICENSE) + "\n\nFor more information, please refer to <https://unlicense.org/>\n"],
        "Zlib": ["zlib License\n\n(C) 2012 Jane Doe\n\n" + wrap(licenses._ZLIB)],
    }
    docs = [(i, text, name) for i, (name, text) in enumerate((n, t) for n, ts in forms.items() for t in ts)]
    docs += [(100, "The MIT License (MIT)", None), (101, licenses._MIT_BODY + " And more.", None), (102, "copyright holders and contributors", None)]
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(frame, licenses.known_texts(spark)).collect()}
    assert got == {i: name for i, _, name in docs}
    (tmp_path / "Own-1.0.txt").write_text("Own License\n\n1. Do as\n   you like.\n")
    own = licenses.known_files(spark, str(tmp_path))
    frame = spark.createDataFrame([(1, "own LICENCE: do as you like"), (2, "else")], "doc_id bigint, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(frame, own).collect()} == {1: "Own-1.0", 2: None}
