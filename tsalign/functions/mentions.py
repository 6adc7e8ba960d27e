"""Names mentioned in texts, for any number of search terms in one pass over the words.

One pattern per name costs a scan of the text each. Here a text is cut once
into words and what stands between them, and only places whose word begins a
term are looked at, by a set that is built once per task. All of it is
expressions, so no text leaves the JVM. The time does not grow with the terms;
for a handful of them the patterns of ``detect_assets`` are faster.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = r"[a-z0-9_]+|[^a-z0-9_]+"
_GAP = r"[^a-z0-9_]+"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _terms(terms: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The names of each lower-cased term."""
    names = defaultdict(set)
    for name, words in terms.items():
        for word in words:
            low = word.lower()
            if not re.fullmatch(r"[a-z0-9_]|[a-z0-9_].*[a-z0-9_]", low, re.DOTALL):
                raise ValueError(f"a term begins and ends with a letter or digit: {word!r}")
            names[low].add(name)
    return {term: sorted(found) for term, found in names.items()}


def mentions(c: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """Sorted array of the names any of whose terms occurs in the lower-cased (clean) text as whole words.

    A term is literal text of one or more words, with the very characters
    between them (``s&p 500``); it is found where ``\\bterm\\b`` is, also
    where finds overlap. Letters beyond ASCII part words, as in cleaned text there are none.
    A name may have many terms and a term many names. NULL and empty texts, and no terms, give an empty array.
    """
    known = _terms(terms)
    if not known:
        return F.array().cast("array<string>")
    low = F.lower(F.coalesce(c, F.lit("")))
    pieces = {term: re.findall(_PIECE, term) for term in known}
    single = [term for term, p in pieces.items() if len(p) == 1]
    longer = {term: p for term, p in pieces.items() if len(p) > 1}
    if not longer:
        hits = F.filter(F.split(low, _GAP), lambda w: w.isin(single))
    else:
        begins = sorted({p[0] for p in pieces.values()})
        lengths = sorted({len(p) for p in pieces.values()})

        def found(text: Column) -> Column:
            at = F.filter(F.transform(text, lambda w, i: F.when(w.isin(begins), i)), lambda i: i.isNotNull())
            spans = F.transform(at, lambda i: F.array(*[F.array_join(F.slice(text, i + 1, n), "") for n in lengths]))
            return F.filter(F.flatten(spans), lambda s: s.isin(list(known)))

        hits = _bound(F.regexp_extract_all(low, F.lit(f"({_PIECE})"), 1), found)
    # as one SQL text, since single literals cost the driver a call each
    pairs = [f"{_quoted(term)}, array({', '.join(map(_quoted, names))})" for term, names in known.items()]
    named = F.expr(f"map({', '.join(pairs)})")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(hits), lambda t: F.element_at(named, t)))))


def mention_share(df: DataFrame, found: str, names: Sequence[str]) -> DataFrame:
    """``name``, ``n`` and ``share_pct``: rows that mention each name, from one aggregate over however many names.

    ``found`` is the array of :func:`mentions`; a name twice in it counts once,
    one that is not in ``names`` not at all. Without rows the share is NULL.
    """
    listed = F.filter(F.array_distinct(F.col(found)), lambda x: x.isin(list(names)))
    # one more entry, NULL, per row counts the rows themselves
    each = df.select(F.explode(F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("name"))
    counts = each.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "n"))
    one = counts.agg(F.map_from_entries(F.collect_list(entry)).alias("_n"), F.max(F.when(F.col("name").isNull(), F.col("n"))).alias("_rows"))
    rows = one.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), "_n", "_rows")
    n = F.coalesce(F.element_at("_n", F.col("name")), F.lit(0).cast("long"))
    return rows.select("name", n.alias("n"), F.try_divide(n * 100.0, F.col("_rows")).alias("share_pct"))
