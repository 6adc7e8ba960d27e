"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words at the marked places of a mask and ignores the others,
so a passage with substituted words still shares seeds with its source. Seeds of
the benchmark meet seeds of the documents in a hash join; a hit fixes a diagonal
(document place minus item place), on which all words are then compared. A
document is contaminated if some window of ``WINDOW`` words of an item, or all of
a shorter item, agrees with it in at least ``AGREE`` of its places. An item with
fewer than ``MIN_WORDS`` words must be there word for word: its one mask has its
own length and ignores nothing.

Words are runs of letters and digits of the whole text, lower-cased. Items with
fewer than ``SHORTEST`` words are everyday phrases and no evidence. Words are
compared place by place: an inserted or missing word ends the agreement, and what
is left on either side of it counts by itself.

Defined results: NULL and empty texts are clean; NULL ids are ids like any
other; an id that repeats is contaminated if one of its rows is; repeated items
count once; other columns are ignored or kept unchanged; an empty
benchmark leaves all documents clean; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsalign.llm.common import measured
from tsalign.operators.durable import durable

#: Fixed masks: 1 marks a word that is hashed, 0 one that is ignored. However the other words stand that ``AGREE`` allows in
#: 8 to ``WINDOW`` words, one of the three passes between them (``tests/llm/test_seeds.py`` enumerates all arrangements).
MASKS = ("11101", "100111", "11010001")
#: Words of an item that are compared at once, and the share of them that must agree.
WINDOW, AGREE = 13, 0.75
#: Items with fewer words must agree in all of them; with fewer still they are no evidence.
MIN_WORDS, SHORTEST = 8, 3
#: Seeds of the benchmark up to which they are sent to every executor (24 bytes each).
SEED_ROWS = 2_000_000

#: Words of the benchmark up to which its items are sent to every executor.
ITEM_WORDS = 2_000_000

_AGREES = (
    "transform(sequence(0, size(iw) - 1), j -> CASE WHEN diagonal + j >= 0 AND get(w, diagonal + j) = iw[j] THEN 1 ELSE 0 END)"
)
_BEST = (
    f"array_max(transform(sequence(0, size(iw) - least({WINDOW}, size(iw))),"
    f" s -> aggregate(slice(m, s + 1, {WINDOW}), 0, (a, x) -> a + x))) / least({WINDOW}, size(iw))"
)

_NO_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.array_remove(F.split(F.lower(text), _NO_WORD), "")


def _seeds(w: str, at: str, lengths: list[int]) -> Column:
    """Seeds of all masks, and of whole runs of the given ``lengths``, at the 0-based place ``at``; NULL where a mask passes the end."""
    def one(k: int, mask: str) -> str:
        marked = ", ".join(f"get({w}, {at} + {i})" for i, m in enumerate(mask) if m == "1")
        return f"CASE WHEN {at} + {len(mask)} <= size({w}) THEN xxhash64({k}, {marked}) END"

    masks = [*enumerate(MASKS), *((-n, "1" * n) for n in lengths)]
    return F.expr("array(" + ", ".join(one(k, m) for k, m in masks) + ")")


def _placed(df: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """A row for each seed: the keys, its place and its hash."""
    rows = df.select(*keys, "w", F.posexplode("w").alias("at", "word"))
    return rows.select(*keys, "at", F.explode(_seeds("w", "at", lengths)).alias("seed")).where("seed IS NOT NULL")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """``doc_id, item_ids, best``: the contaminated ids with the items found and the best share of agreeing words."""
    items = durable(
        benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("iw"))
        .where(F.size("iw") >= SHORTEST)
        .distinct(),
        "items",
    )
    # the few lengths that short items have
    lengths = sorted(r.n for r in items.where(F.size("iw") < MIN_WORDS).select(F.size("iw").alias("n")).distinct().collect())
    long, short = (items.where(c).withColumnRenamed("iw", "w") for c in (F.size("iw") >= MIN_WORDS, F.size("iw") < MIN_WORDS))
    known = _placed(long, [], "item")
    for n in lengths:
        known = known.unionByName(_placed(short.where(F.size("w") == n), [n], "item").where("at = 0"))
    known = measured(known, "seeds", seed_rows)
    known = known.select("seed", "item", F.col("at").alias("item_at"))
    texts = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w"))
    hits = (
        _placed(texts, lengths, "doc")
        .join(known, "seed")
        .select("doc", "item", (F.col("at") - F.col("item_at")).alias("diagonal"))
        .distinct()
    )
    hits = measured(hits, "hits")
    # the words of the items stand in one place and come to the hits last; a document's text moves once at most
    if (items.agg(F.sum(F.size("iw") + 8)).first()[0] or 0) <= ITEM_WORDS:
        items = F.broadcast(items)
    shares = (
        texts.alias("d")
        .join(hits.alias("h"), F.col("d.doc").eqNullSafe(F.col("h.doc")))
        .join(items.alias("i"), F.col("h.item").eqNullSafe(F.col("i.item")))
        .select("d.doc", "h.item", "iw", F.expr(_AGREES).alias("m"))
        .select("doc", "item", F.size("iw").alias("n"), F.expr(_BEST).alias("share"))
    )
    return (
        shares.where(F.col("share") >= F.when(F.col("n") < MIN_WORDS, 1.0).otherwise(AGREE))
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("share").alias("best"))
        .select(F.col("doc").alias("doc_id"), "item_ids", "best")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ids are not contaminated, all columns unchanged."""
    found = measured(overlaps(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("found")), "found")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"))
    return rows.join(found, F.col("doc").eqNullSafe(F.col("found")), "left_anti").select("row.*")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, contaminated, item_ids, best`` (empty and NULL where clean)."""
    found = durable(overlaps(docs, benchmark, id_col, text_col), "found").alias("f")
    ids = docs.select(F.col(id_col).alias("doc_id")).alias("d")
    return ids.join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left").select(
        "d.doc_id",
        F.col("best").isNotNull().alias("contaminated"),
        F.coalesce(F.col("item_ids"), F.expr("filter(array(f.doc_id), x -> false)")).alias("item_ids"),
        "best",
    )


def oracle() -> str:
    """The same in SQL."""
    masks = [*((m, f"len(w) >= {MIN_WORDS}") for m in MASKS), *(("1" * n, f"len(w) = {n}") for n in range(SHORTEST, MIN_WORDS))]

    def of(source: str, whole: bool) -> str:
        parts = []
        for k, (mask, which) in enumerate(masks):
            marked = " || ' ' || ".join(f"w[p + {i + 1}]" for i, m in enumerate(mask) if m == "1")
            parts.append(f"SELECT id, p, '{k} ' || {marked} AS seed FROM placed WHERE p + {len(mask)} <= len(w)" + ("" if whole else f" AND {which}"))
        return f"(WITH placed AS (SELECT *, unnest(range(0, len(w))) AS p FROM {source}) {' UNION ALL '.join(parts)})"

    split = f"list_filter(regexp_split_to_array(lower(text), '{_NO_WORD}'), lambda x: x <> '')"
    return f"""
        WITH d AS (SELECT doc_id AS id, {split} AS w FROM documents),
        b AS (SELECT DISTINCT item_id AS id, {split} AS w FROM benchmark WHERE len({split}) >= {SHORTEST}),
        hits AS (
            SELECT DISTINCT x.id AS doc_id, y.id AS item_id, x.p - y.p AS diagonal
            FROM {of('d', True)} x JOIN {of('b', False)} y USING (seed)),
        m AS (
            SELECT doc_id, item_id, len(b.w) AS n, least({WINDOW}, len(b.w)) AS k,
                list_transform(range(0, len(b.w)), lambda j: CASE WHEN diagonal + j >= 0 AND d.w[diagonal + j + 1] = b.w[j + 1] THEN 1 ELSE 0 END) AS m
            FROM hits JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
        shares AS (
            SELECT doc_id, item_id, n, list_max(list_transform(range(0, n - k + 1), lambda s: list_sum(m[s + 1:s + k]))) / k AS share FROM m),
        found AS (
            SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, max(share) AS best FROM shares
            WHERE share >= CASE WHEN n < {MIN_WORDS} THEN 1 ELSE {AGREE} END GROUP BY 1)
        SELECT doc_id, best IS NOT NULL AS contaminated, coalesce(array_to_string(item_ids, ','), '') AS item_ids, best
        FROM documents LEFT JOIN found USING (doc_id)"""
