"""Line deduplication by site-relative frequency.

A line's pages are counted per host and divided by all pages of that host; lines
above a ratio are boilerplate and are dropped from the pages of that host.
A page is a row. A line counts once per page. Lines are compared without
surrounding blanks; blank lines are neither counted nor dropped.

At most ``mean lines per page / ratio`` lines of a host can exceed the ratio, so
the list that goes to each host's pages is bounded however large the host is.

Defined results: NULL text stays NULL and counts as a page without lines; NULL
hosts are one host; a host with fewer than ``min_pages`` pages keeps all its
lines; repeated rows are pages of their own; a page of dropped lines only
becomes the empty text and stays; all other columns stay as they are, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsalign.operators.durable import durable

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.1
#: A line on fewer pages than this is never boilerplate.
MIN_PAGES = 3


def _key(line: Column) -> Column:
    """96 bits of a line without surrounding blanks."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``host, pages, keys``: per host with any boilerplate, the keys of its boilerplate lines."""
    kept = F.filter(_lines(F.col(text)), lambda x: F.trim(x) != "")
    keys = F.array_distinct(F.transform(kept, _key))
    per_line = (
        pages.select(F.col(host).alias("host"), F.explode(keys).alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    per_host = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    return (
        per_line.alias("l")
        .join(per_host.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy(F.col("h.host").alias("host"), "pages")
        .agg(F.collect_list("key").alias("keys"))
    )


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``n_dropped`` and ``clean`` (the text that is left)."""
    found = durable(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    rows = pages.select(F.struct("*").alias("row"), F.col(host).alias("at"), F.col(text).alias("whole"))
    joined = rows.alias("p").join(found.alias("b"), F.col("p.at").eqNullSafe(F.col("b.host")), "left")
    left = F.filter(_lines(F.col("whole")), lambda x: ~F.array_contains(F.col("keys"), _key(x)) | (F.trim(x) == ""))
    clean = F.when(F.col("keys").isNull(), F.col("whole")).otherwise(F.array_join(left, "\n"))
    out = joined.select("row", F.size(_lines(F.col("whole"))).alias("n"), clean.alias("clean"), "whole")
    lines = F.when(F.col("whole").isNull(), F.lit(0)).otherwise(F.col("n"))
    after = F.when(F.col("clean").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("clean"))))
    all_gone = (F.col("clean") == "") & (F.col("whole") != "")
    return out.select(
        "row",
        lines.cast("long").alias("n_lines"),
        F.when(all_gone, lines).otherwise(lines - after).cast("long").alias("n_dropped"),
        "clean",
    )


def clean_pages(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    sizes: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """``pages`` with the text that is left; ``sizes`` names columns to compute anew from it, where they are present."""
    out = drop_boilerplate(pages, host, text, ratio, min_pages)
    again = {c: f for c, f in (sizes or {}).items() if c in pages.columns}
    types = dict(pages.dtypes)

    def value(c: str) -> Column:
        if c == text:
            return F.col("clean").alias(c)
        if c in again:
            return again[c](F.col("clean")).cast(types[c]).alias(c)
        return F.col("row").getField(c).alias(c)

    return out.select(*map(value, pages.columns))


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    return f"""
        WITH l AS (
            SELECT doc_id, source, pos, string_split(text, chr(10))[pos] AS line
            FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
        per_line AS (
            SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
        per_host AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
        bad AS (
            SELECT source, line FROM per_line JOIN per_host USING (source) WHERE n >= {min_pages} AND n > {ratio} * pages),
        marked AS (SELECT l.*, bad.line IS NOT NULL AS drop FROM l LEFT JOIN bad ON l.source = bad.source AND trim(l.line) = bad.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '') AS clean
        FROM marked GROUP BY doc_id"""
